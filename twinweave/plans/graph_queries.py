"""Queries over the object graph: two-round hashing, closures, weighted draws, differences that matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave import features, model
from twinweave.model import table
from twinweave.operators import closure, convolution, draws, matchloop
from twinweave.plans import match_queries, model_queries, sql
from twinweave.plans.kernel_queries import object_codes_sql, with_code
from twinweave.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


# ---- two-round hashing


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, key, to_type, to_key): what each object contains; an order's line items are counted under its key."""
    out = None
    for child, key, up, parent, _ in (*model.CONTAINMENT, ("lineitem", "l_orderkey", "l_orderkey", "orders", "lineitems")):
        rows = table(spark, sf_dir, child).select(
            F.lit(parent).alias("type"), F.col(up).cast("long").alias("key"), F.lit(child).alias("to_type"), F.col(key).cast("long").alias("to_key")
        )
        # line items share their order's key: one edge stands for all
        rows = rows.distinct() if child == "lineitem" else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and suppliers that an order's line items refer to, each once."""
    items = table(spark, sf_dir, "lineitem")
    out = None
    for (_, other), column in model.REFERENCES.items():
        rows = items.select(F.lit("orders").alias("type"), F.col("l_orderkey").alias("key"), F.lit(other).alias("to_type"), F.col(column).alias("to_key")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


_EDGES_SQL = """
child AS (
  SELECT 'region' AS type, n_regionkey::BIGINT AS key, 'nation' AS to_type, n_nationkey::BIGINT AS to_key FROM nation
  UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey FROM customer
  UNION ALL SELECT 'nation', s_nationkey, 'supplier', s_suppkey FROM supplier
  UNION ALL SELECT 'customer', o_custkey, 'orders', o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'orders', l_orderkey, 'lineitem', l_orderkey FROM lineitem),
refers AS (
  SELECT DISTINCT 'orders' AS type, l_orderkey AS key, 'part' AS to_type, l_partkey AS to_key FROM lineitem
  UNION ALL SELECT DISTINCT 'orders', l_orderkey, 'supplier', l_suppkey FROM lineitem)"""


def _sql_around(edges: str, name: str, more: int, of: int) -> str:
    return f"""{name}_e AS (SELECT e.type, e.key, c.code FROM {edges} e JOIN codes c ON c.type = e.to_type AND c.key = e.to_key WHERE c.code <> 0),
{name}_n AS (SELECT type, key, count(*) AS n FROM {name}_e GROUP BY ALL),
{name}_b AS (SELECT type, key, b, count(*) AS k FROM {name}_e, range(0, 64) t(b) WHERE (code >> b::INT) & 1 = 1 GROUP BY ALL),
{name} AS (SELECT type, key, list(b) AS bits FROM {name}_b JOIN {name}_n USING (type, key) WHERE {of} * k > {more} * n GROUP BY ALL)"""


_FINAL_SQL = f"""{_EDGES_SQL}, {_sql_around("child", "inside", *convolution.CONTAINED)}, {_sql_around("refers", "across", *convolution.REFERRED)},
final AS (SELECT type, key, code, code | {sql.or_positions("coalesce(inside.bits, [])")} | {sql.or_positions("coalesce(across.bits, [])")} AS final_code
  FROM codes LEFT JOIN inside USING (type, key) LEFT JOIN across USING (type, key) WHERE type <> 'lineitem')"""


@query(f"WITH codes AS ({object_codes_sql('default')}), {_FINAL_SQL} SELECT type, key, code, final_code FROM final")
def conv_object_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects' codes, and those with their neighbours'; line items have no key of their own and only vote."""
    codes = written(features.object_codes(spark, sf_dir, "default"), "codes")
    own = codes.filter("type <> 'lineitem'")
    inside = convolution.voted_around(contained(spark, sf_dir), codes, convolution.CONTAINED)
    across = convolution.voted_around(referred(spark, sf_dir), codes, convolution.REFERRED)
    zero = F.lit(0).cast("long")
    met = own.join(inside, ["type", "key"], "left").join(across.withColumnRenamed("around", "across"), ["type", "key"], "left")
    return met.select("type", "key", "code", F.col("code").bitwiseOR(F.coalesce("around", zero)).bitwiseOR(F.coalesce("across", zero)).alias("final_code"))


def tree_final_codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Final codes of both sides of the containment tree: nations, customers, orders by their texts."""
    levels, out = match_queries.tree_sides(spark, sf_dir), []
    above = {"customer": "nation", "orders": "customer"}
    for side in (1, 2):
        codes = edges = None
        for level in levels:
            own = with_code(level[side], "text").select(F.lit(level[0]).alias("type"), F.col("id").alias("key"), "code")
            codes = own if codes is None else codes.unionByName(own)
            if level[0] in above:
                inside = level[side].select(F.lit(above[level[0]]).alias("type"), F.col("parent").alias("key"), F.lit(level[0]).alias("to_type"), F.col("id").alias("to_key"))
                edges = inside if edges is None else edges.unionByName(inside)
        codes = written(codes, "codes")
        out.append(convolution.final_codes(codes, edges, edges.limit(0)))
    return out[0], out[1]


def _sql_tree_codes(side: str) -> str:
    """CTE <side>_final of one side of the containment tree."""
    edges = " UNION ALL ".join(f"SELECT '{up}' AS type, parent AS key, code FROM {t}_{side}" for t, up in (("customer", "nation"), ("orders", "customer")))
    codes = " UNION ALL ".join(f"SELECT '{t}' AS type, id AS key, code FROM {t}_{side}" for t in ("nation", "customer", "orders"))
    return f"""{side}_e AS (SELECT * FROM ({edges}) WHERE code <> 0), {side}_n AS (SELECT type, key, count(*) AS n FROM {side}_e GROUP BY ALL),
{side}_b AS (SELECT type, key, b, count(*) AS k FROM {side}_e, range(0, 64) t(b) WHERE (code >> b::INT) & 1 = 1 GROUP BY ALL),
{side}_w AS (SELECT type, key, list(b) AS bits FROM {side}_b JOIN {side}_n USING (type, key) WHERE 3 * k > n GROUP BY ALL),
{side}_final AS (SELECT type, key, code | {sql.or_positions("coalesce(bits, [])")} AS final_code FROM ({codes}) LEFT JOIN {side}_w USING (type, key))"""


@query(f"""WITH {match_queries._TREE_SIDES}, {_sql_tree_codes("l")}, {_sql_tree_codes("r")},
a AS (SELECT type, final_code, count(*) AS left_n, min(key) AS left_key FROM l_final GROUP BY ALL), b AS (SELECT type, final_code, count(*) AS right_n, min(key) AS right_key FROM r_final GROUP BY ALL)
SELECT type, final_code, left_n, left_key, right_n, right_key FROM a JOIN b USING (type, final_code)""")
def final_code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects of both sides are alike together with what they contain."""
    return convolution.same_final_code(*tree_final_codes(spark, sf_dir))


# ---- closures


@query("""WITH RECURSIVE edge AS (
  SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS up FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders),
reach AS (SELECT node, up, 1 AS steps FROM edge UNION ALL SELECT r.node, e.up, steps + 1 FROM reach r JOIN edge e ON e.node = r.up)
SELECT node, up AS above, steps::BIGINT AS steps FROM reach""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object with all its containers, however far above."""
    edges = None
    for child, key, up, parent, _ in model.CONTAINMENT:
        name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
        rows = table(spark, sf_dir, child).select(name(child, key).alias("node"), name(parent, up).alias("above"))
        edges = rows if edges is None else edges.unionByName(rows)
    return closure.above(edges)


@query(f"""WITH RECURSIVE {model_queries._SQL},
edge AS (SELECT model, c_name AS node, before AS up FROM c WHERE before IS NOT NULL),
reach AS (SELECT model, node, up FROM edge UNION ALL SELECT r.model, r.node, e.up FROM reach r JOIN edge e ON e.model = r.model AND e.node = r.up),
hit AS (SELECT DISTINCT model, c_name FROM c WHERE right(c_name, 1) = '7' UNION SELECT model, node FROM reach WHERE right(up, 1) = '7')
SELECT 'm' || model AS file, c_name AS name, hit.c_name IS NOT NULL AS ignored FROM c LEFT JOIN hit USING (model, c_name)""")
def inherited_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the models' classes those that are ignored: their name ends in 7, or one above them is ignored."""
    found = model_queries.written_models(spark, sf_dir)
    node = lambda file, n: F.concat(F.col(file), F.lit("#"), F.col(n).cast("string"))
    classes = found.objects.filter("type = 'EClass'").select(node("file", "node").alias("node"), "file", "name")
    edges = found.references.filter("feature = 'eSuperTypes' AND target_node IS NOT NULL").select(node("file", "node").alias("node"), node("target_file", "target_node").alias("above"))
    marks = closure.marked_from_above(classes, edges, classes.filter(F.col("name").endswith("7")))
    return classes.join(marks, "node").select("file", "name", F.col("marked").alias("ignored"))


# ---- weighted draws


@query("""WITH w AS (SELECT p_type AS type, sum(p_size) AS weight FROM part GROUP BY 1),
i AS (SELECT type, sum(weight) OVER (ORDER BY type) - weight AS low, sum(weight) OVER (ORDER BY type) AS high FROM w),
d AS (SELECT o_orderkey AS draw, (o_orderkey * 7919 + 13) % (SELECT sum(weight) FROM w) AS number FROM orders)
SELECT draw, number::BIGINT AS number, type FROM d JOIN i ON number >= low AND number < high""")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type for each order, as often as the types' parts weigh: by the order's key, not by chance."""
    weights = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.sum("p_size").alias("weight"))
    ranges = written(draws.intervals(weights, "type", "weight"), "intervals")
    total = ranges.agg(F.max("high")).first()[0] or 1
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), F.pmod(F.col("o_orderkey") * 7919 + 13, F.lit(total)).alias("number"))
    return draws.drawn(asked, "number", ranges).select("draw", "number", "type")


# ---- differences


_FLAGS = """
nm AS ({nested}),
f0 AS (SELECT *, left_id = -1 OR right_id = -1 AS differs, FALSE AS below FROM nm WHERE type = 'nation'),
f1 AS (SELECT c.*, c.left_id = -1 OR c.right_id = -1 AS differs, coalesce(p.differs OR p.below, TRUE) AS below
  FROM (SELECT * FROM nm WHERE type = 'customer') c LEFT JOIN f0 p ON p.left_id = c.parent_match AND c.parent_match <> -1),
f2 AS (SELECT c.*, c.left_id = -1 OR c.right_id = -1 AS differs, coalesce(p.differs OR p.below, TRUE) AS below
  FROM (SELECT * FROM nm WHERE type = 'orders') c LEFT JOIN f1 p ON p.left_id = c.parent_match AND c.parent_match <> -1)"""


@query(f"""WITH {match_queries._NESTED}, {_FLAGS.format(nested=match_queries.NESTED_SQL)}
SELECT type, count(*) AS total, sum(differs::INT)::BIGINT AS diffs, sum((differs AND NOT below)::INT)::BIGINT AS critical,
  round(sum(differs::INT)::DOUBLE / count(*), 9) AS diff_rate, round(sum((differs AND NOT below)::INT)::DOUBLE / count(*), 9) AS critical_rate
FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY type""")
def critical_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without a partner, and those of them that aren't below another one: what went with its container isn't
    a difference of its own."""
    levels = match_queries.tree_sides(spark, sf_dir)
    found = written(matchloop.nested(levels), "nested")
    flagged = matchloop.differences(found, [name for name, _, _ in levels])
    critical = F.col("differs") & ~F.col("below")
    sums = flagged.groupBy("type").agg(F.count("*").alias("total"), F.sum(F.col("differs").cast("long")).alias("diffs"), F.sum(critical.cast("long")).alias("critical"))
    rate = lambda c: F.round(F.col(c) / F.col("total"), 9).alias(f"{c.removesuffix('s')}_rate")
    return sums.select("*", rate("diffs"), rate("critical"))
