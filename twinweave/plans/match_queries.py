"""Queries of joins, matching, profiling, evaluation and mutation, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave import features, model
from twinweave.functions import kernels as K
from twinweave.functions import similarity as S
from twinweave.model import table
from twinweave.operators import evaluation, joins, matching, matchloop, nearest, walk
from twinweave.plans import sql
from twinweave.plans.kernel_queries import with_code
from twinweave.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def coded(parts: DataFrame) -> DataFrame:
    """Parts as objects: id, type, code of the name, and the other features."""
    rows = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )
    return with_code(rows, "name")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    return coded(parts), coded(model.edited_parts(parts))


# ---- joins


@query(f"WITH {sql.CODED} SELECT type, code, lc.n AS left_n, rc.n AS right_n FROM lc JOIN rc USING (type, code)")
def exact_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = sides(spark, sf_dir)
    left, right = joins.distinct_codes(l, "left"), joins.distinct_codes(r, "right")
    same = left.withColumnRenamed("left_code", "code").join(right.withColumnRenamed("right_code", "code"), ["type", "code"])
    return same.select("type", "code", "left_n", "right_n")


_SIM = sql.cosine("lc.code", "rc.code")
_PAIR = "lc.type, lc.code AS left_code, rc.code AS right_code, lc.n AS left_n, rc.n AS right_n"


def _similar(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    return joins.similar_codes(*sides(spark, sf_dir), least)


@query(f"WITH {sql.CODED} SELECT {_PAIR}, round({_SIM}, 6) AS sim FROM lc JOIN rc USING (type) WHERE {_SIM} >= 0.8")
def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _similar(spark, sf_dir, 0.8)
    return found.select("type", "left_code", "right_code", "left_n", "right_n", F.round("sim", 6).alias("sim"))


_BRANDED = f"""WITH {sql.CODED}, lb AS (SELECT type, brand, code, count(*) AS n FROM l GROUP BY ALL), rb AS (SELECT type, brand, code, count(*) AS n FROM r GROUP BY ALL)
SELECT lb.type, lb.brand AS left_brand, rb.brand AS right_brand, sum(lb.n * rb.n)::BIGINT AS candidates FROM lb JOIN rb USING (type)
WHERE {sql.cosine('lb.code', 'rb.code')} >= 0.7 + CASE WHEN lb.brand = rb.brand THEN 0 ELSE {features.container_ratio("part")} END GROUP BY ALL"""


@query(_BRANDED)
def similarity_join_container_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of unlike containers (here brands) must be more similar, by the container's share of a type's distance."""
    l, r = sides(spark, sf_dir)
    pairs = joins.similar_codes(l, r, 0.7).select("type", "left_code", "right_code", "sim")
    own = lambda d, side: d.groupBy("type", "brand", "code").agg(F.count("*").alias(f"{side}_n")).select(
        "type", F.col("brand").alias(f"{side}_brand"), F.col("code").alias(f"{side}_code"), f"{side}_n")
    met = pairs.join(own(l, "left"), ["type", "left_code"]).join(own(r, "right"), ["type", "right_code"])
    penalty = F.when(F.col("left_brand") == F.col("right_brand"), 0.0).otherwise(features.container_ratio("part"))
    kept = met.filter(F.col("sim") >= F.lit(0.7) + penalty).groupBy("type", "left_brand", "right_brand")
    return kept.agg(F.sum(F.col("left_n") * F.col("right_n")).alias("candidates"))


def _sql_near(most: int) -> str:
    d = sql.hamming("lc.code", "rc.code")
    return f"WITH {sql.CODED} SELECT {_PAIR}, {d} AS distance FROM lc JOIN rc USING (type) WHERE {d} <= {most}"


def _near(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    found = joins.near_codes(*sides(spark, sf_dir), most)
    return found.select("type", "left_code", "right_code", "left_n", "right_n", F.col("distance").cast("long").alias("distance"))


@query(_sql_near(6))
def multi_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 6)


@query(_sql_near(3))
def hamming_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 3)


_KNN = sql.hamming("lc.code", "rc.code")


@query(f"""WITH {sql.CODED}, d AS (SELECT lc.type, lc.code AS left_code, rc.code AS right_code, {_KNN} AS distance FROM lc JOIN rc USING (type) WHERE {_KNN} <= 13)
SELECT type, left_code, right_code, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY type, left_code ORDER BY distance, right_code) AS rank FROM d) WHERE rank <= 3""")
def hamming_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest codes within 13 bits."""
    found = _near(spark, sf_dir, 13)
    order = Window.partitionBy("type", "left_code").orderBy("distance", "right_code")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 3")
    return ranked.select("type", "left_code", "right_code", "distance", "rank")


@query(f"WITH {sql.CODED} SELECT {_PAIR}, bit_count(lc.code)::BIGINT AS left_bits, bit_count(rc.code)::BIGINT AS right_bits FROM lc JOIN rc USING (type) WHERE {_SIM} >= 0.6")
def popcount_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _similar(spark, sf_dir, 0.6)
    bits = [F.col(f"{s}_bits").cast("long").alias(f"{s}_bits") for s in ("left", "right")]
    return found.select("type", "left_code", "right_code", "left_n", "right_n", *bits)


@query(f"WITH {sql.CODED} SELECT lc.type, count(*) AS code_pairs, sum(lc.n * rc.n)::BIGINT AS object_pairs FROM lc JOIN rc USING (type) WHERE {_SIM} >= 0.8 GROUP BY 1")
def distinct_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of objects the pairs of codes stand for."""
    found = _similar(spark, sf_dir, 0.8).groupBy("type")
    return found.agg(F.count("*").alias("code_pairs"), F.sum(F.col("left_n") * F.col("right_n")).alias("object_pairs"))


@query(f"WITH {sql.CODED}, a AS (SELECT type, count(*) AS n FROM l GROUP BY 1), b AS (SELECT type, count(*) AS n FROM r GROUP BY 1) SELECT type, a.n AS left_n, b.n AS right_n, a.n * b.n AS candidates FROM a JOIN b USING (type)")
def ignored_type_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a type that isn't hashed every object is a candidate; they are counted, not listed."""
    l, r = sides(spark, sf_dir)
    a, b = l.groupBy("type").agg(F.count("*").alias("left_n")), r.groupBy("type").agg(F.count("*").alias("right_n"))
    return a.join(b, "type").withColumn("candidates", F.col("left_n") * F.col("right_n"))


# ---- matching

_DIST = """round((50.0::DOUBLE * (levenshtein(l.name, r.name)::DOUBLE / greatest(length(l.name), length(r.name), 1))
  + 10.0::DOUBLE * (CASE WHEN l.price IS NOT DISTINCT FROM r.price THEN 0.0 ELSE 1.0 END)) / 60.0::DOUBLE, 9)"""
_CANDIDATES = f"""{sql.CODED}, c AS (SELECT l.id AS left_id, r.id AS right_id, {_DIST} AS dist FROM l JOIN r USING (type) WHERE {sql.cosine('l.code', 'r.code')} >= 0.5)"""
_MUTUAL = f"""{_CANDIDATES}, near AS (SELECT * FROM c WHERE dist <= {matching.TOO_FAR}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS k FROM near) WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY dist, left_id) AS k FROM near) WHERE k = 1),
m AS (SELECT f.left_id, f.right_id, f.dist FROM f JOIN b ON f.left_id = b.left_id AND f.right_id = b.right_id)"""


def matching_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides and the pairs of names whose codes are similar; a few distinct names stand for all objects."""
    l, r = sides(spark, sf_dir)
    return l, r, written(nearest.name_pairs(l, r), "name_pairs")


def mutual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l, r, pairs = matching_sides(spark, sf_dir)
    return l, r, nearest.mutual(l, r, pairs)


def code_candidates(l: DataFrame, r: DataFrame) -> DataFrame:
    """For each (type, code) of the left side how many candidates an object has, and the lowest id of them."""
    own = r.groupBy("type", F.col("code").alias("right_code")).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    near = joins.similar_codes(l, r, nearest.LEAST).select("type", "left_code", "right_code").join(own, ["type", "right_code"])
    return near.groupBy("type", F.col("left_code").alias("code")).agg(F.sum("n").alias("k"), F.min("least").alias("right_id"))


@query(f"WITH {_CANDIDATES} SELECT left_id, right_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS k FROM c) WHERE k = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.best_matches(*matching_sides(spark, sf_dir))


@query(f"WITH {_MUTUAL} SELECT * FROM m")
def mutual_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual(spark, sf_dir)[2]


def _sql_walk(candidates: str, name: str, rounds: int) -> str:
    """CTEs of a candidate walk over (left_id, right_id, dist) for so many rounds; the matches are in the last one, <name>."""
    out, done = [], None
    for k in range(rounds):
        rest = candidates if done is None else f"(SELECT * FROM {candidates} WHERE left_id NOT IN (SELECT left_id FROM {done}) AND right_id NOT IN (SELECT right_id FROM {done}))"
        out.append(f"{name}_b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY dist, left_id) AS k FROM {rest}) WHERE k = 1)")
        out.append(f"{name}_n{k} AS (SELECT left_id, right_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS j FROM {name}_b{k}) WHERE j = 1)")
        before = f"SELECT * FROM {done} UNION ALL " if done else ""
        done = name if k == rounds - 1 else f"{name}_m{k}"
        out.append(f"{done} AS ({before}SELECT * FROM {name}_n{k})")
    return ", ".join(out)


#: Rounds of the walks in SQL; the last ones find nothing more (tests/test_walk.py).
ROUNDS = 9


@query(f"WITH {_CANDIDATES}, near AS (SELECT * FROM c WHERE dist <= {matching.TOO_FAR}), {_sql_walk('near', 'w', ROUNDS)} SELECT * FROM w")
def candidate_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object takes the first of its candidates whose nearest it is; matched ones leave, and the rest goes on."""
    return nearest.walked(*matching_sides(spark, sf_dir))


@query(f"WITH {_MUTUAL} SELECT id FROM l WHERE id NOT IN (SELECT left_id FROM m)")
def unmatched_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _, found = mutual(spark, sf_dir)
    return l.select("id").join(found.select(F.col("left_id").alias("id")), "id", "left_anti")


@query(f"WITH {_MUTUAL} SELECT id FROM r WHERE id NOT IN (SELECT right_id FROM m)")
def unmatched_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, found = mutual(spark, sf_dir)
    return r.select("id").join(found.select(F.col("right_id").alias("id")), "id", "left_anti")


@query(f"WITH {_MUTUAL} SELECT coalesce(l.id, -1) AS left_id, coalesce(m.right_id, -1) AS right_id FROM l LEFT JOIN m ON l.id = m.left_id UNION ALL SELECT -1, id FROM r WHERE id NOT IN (SELECT right_id FROM m)")
def match_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 stands for no partner."""
    l, r, found = mutual(spark, sf_dir)
    done = matching.completed(written(found, "mutual"), l, r)
    return done.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("left_id", "right_id")])


def _sql_near(a: str, b: str, name: str) -> str:
    dist = _DIST.replace("l.", "x.").replace("r.", "y.")
    return f"""{name} AS (SELECT * FROM (SELECT x.id AS left_id, y.id AS right_id, {dist} AS dist FROM {a} x JOIN {b} y USING (type)
  WHERE {sql.cosine('x.code', 'y.code')} >= 0.5) WHERE dist <= {matching.TOO_FAR})"""


_THREE = f"""{sql.CODED}, le AS (SELECT id, type, {sql.string_code("name")} AS code, name, price FROM (
  SELECT id, type, name || CASE WHEN {sql.edit_class('id')} BETWEEN 300 AND 349 THEN ' a' ELSE '' END AS name, price FROM l WHERE {sql.edit_class('id')} < 950)),
{_sql_near("le", "r", "c1")}, {_sql_walk("c1", "w1", ROUNDS)}, {_sql_near("le", "l", "c2")}, {_sql_walk("c2", "w2", ROUNDS)},
rr AS (SELECT * FROM r WHERE id NOT IN (SELECT right_id FROM w1)), oo AS (SELECT * FROM l WHERE id NOT IN (SELECT right_id FROM w2)),
{_sql_near("rr", "oo", "c3")}, {_sql_walk("c3", "w3", ROUNDS)}"""


@query(f"""WITH {_THREE}
SELECT le.id AS left_id, coalesce(w1.right_id, -1) AS right_id, coalesce(w2.right_id, -1) AS origin_id FROM le LEFT JOIN w1 ON w1.left_id = le.id LEFT JOIN w2 ON w2.left_id = le.id
UNION ALL SELECT -1, rr.id, coalesce(w3.right_id, -1) FROM rr LEFT JOIN w3 ON w3.left_id = rr.id
UNION ALL SELECT -1, -1, id FROM oo WHERE id NOT IN (SELECT right_id FROM w3)""")
def three_way_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left objects with their right and origin matches, then what is left of both with each other; -1 where a side
    has none. Every object is in one row."""
    origin, right = sides(spark, sf_dir)
    m = model.edit_class(F.col("id"))
    renamed = F.when(m.between(300, 349), F.concat("name", F.lit(" a"))).otherwise(F.col("name"))
    left = with_code(origin.filter(m < 950).withColumn("name", renamed).drop("code"), "name")

    def matched(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = written(nearest.name_pairs(a, b), "name_pairs")
        return written(nearest.walked(a, b, pairs, singly=True).select("left_id", "right_id"), "matches")

    every = matching.three_sides(left, right, origin, matched)
    return every.select(*[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("left_id", "right_id", "origin_id")])


@query(f"""WITH {_MUTUAL}, x AS (SELECT left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS k FROM c) WHERE k = 1)
SELECT coalesce(x.left_id, m.left_id) AS left_id, (x.right_id IS DISTINCT FROM m.right_id) AS differs FROM x FULL JOIN m ON x.left_id = m.left_id""")
def match_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided best matches against mutual ones."""
    l, r, pairs = matching_sides(spark, sf_dir)
    best = written(nearest.best_matches(l, r, pairs), "best")
    near = best.filter(F.col("dist") <= matching.TOO_FAR)
    both = near.join(nearest.backward(l, r, pairs).select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")
    return matching.agreement(best, both).select("left_id", "differs")


# ---- matching along the containment tree

_MOVED_SQL = f"(CASE WHEN {sql.edit_class('c_custkey')} BETWEEN 150 AND 169 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END)"
_ORDER_EDIT = sql.edit_class("o_orderkey")
_LEVELS = {
    "nation": ("SELECT n_nationkey::BIGINT AS id, NULL::BIGINT AS parent, n_name AS text, 0::DOUBLE AS number FROM nation",
               "SELECT n_nationkey::BIGINT AS id, NULL::BIGINT AS parent, n_name AS text, 0::DOUBLE AS number FROM nation"),
    "customer": ("SELECT c_custkey AS id, c_nationkey::BIGINT AS parent, c_name AS text, c_acctbal AS number FROM customer",
                 f"""SELECT c_custkey AS id, {_MOVED_SQL}::BIGINT AS parent, c_name || CASE WHEN {sql.edit_class('c_custkey')} BETWEEN 50 AND 149 THEN ' v2' ELSE '' END AS text,
                   c_acctbal AS number FROM customer WHERE {sql.edit_class('c_custkey')} >= 50"""),
    "orders": ("SELECT o_orderkey AS id, o_custkey AS parent, o_orderpriority AS text, o_totalprice AS number FROM orders",
               f"""SELECT o_orderkey AS id, o_custkey AS parent, o_orderpriority || CASE WHEN {_ORDER_EDIT} BETWEEN 50 AND 149 THEN '!' ELSE '' END AS text, o_totalprice AS number
                   FROM orders WHERE {_ORDER_EDIT} >= 30 AND {sql.edit_class('o_custkey')} >= 50"""),
}


def tree_sides(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(type, left, right) of nations, customers and orders: customers renamed, moved and deleted with their orders,
    orders with another priority or deleted."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("n_name").alias("text"), F.lit(0.0).alias("number")
    )
    c, m = table(spark, sf_dir, "customer"), model.edit_class(F.col("c_custkey"))
    shape = [F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("parent"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("number")]
    moved = F.when(m.between(150, 169), (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    renamed = F.when(m.between(50, 149), F.concat("c_name", F.lit(" v2"))).otherwise(F.col("c_name"))
    later = c.filter(m >= 50).withColumn("c_nationkey", moved).withColumn("c_name", renamed)
    o, k = table(spark, sf_dir, "orders"), model.edit_class(F.col("o_orderkey"))
    of_order = [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("number")]
    priority = F.when(k.between(50, 149), F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    later_o = o.filter((k >= 30) & (model.edit_class(F.col("o_custkey")) >= 50)).withColumn("o_orderpriority", priority)
    own = [("nation", nations, nations), ("customer", c.select(*shape), later.select(*shape)), ("orders", o.select(*of_order), later_o.select(*of_order))]
    return own


def _sql_identical(a: str, b: str, name: str, *keys: str) -> str:
    cols = ", ".join((*keys, "text", "number"))
    ranked = lambda d: f"(SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY id) AS k FROM {d})"
    return f"{name} AS (SELECT x.id AS left_id, y.id AS right_id FROM {ranked(a)} x JOIN {ranked(b)} y USING ({cols}, k))"


def _sql_level(t: str, above: str) -> str:
    dist = _DIST.replace("l.name", "x.text").replace("r.name", "y.text").replace("l.price", "x.number").replace("r.price", "y.number")
    return f"""l_{t} AS (SELECT l.*, right_id AS box FROM {t}_l l JOIN {above} ON parent = left_id), r_{t} AS (SELECT *, parent AS box FROM {t}_r),
{_sql_identical(f"l_{t}", f"r_{t}", f"i_{t}", "box")},
c_{t} AS (SELECT * FROM (SELECT x.id AS left_id, y.id AS right_id, {dist} AS dist FROM l_{t} x JOIN r_{t} y USING (box) WHERE {sql.cosine('x.code', 'y.code')} >= 0.5
  AND x.id NOT IN (SELECT left_id FROM i_{t}) AND y.id NOT IN (SELECT right_id FROM i_{t})) WHERE dist <= {matching.TOO_FAR}),
{_sql_walk(f"c_{t}", f"w_{t}", ROUNDS)}, d_{t} AS (SELECT * FROM i_{t} UNION ALL SELECT left_id, right_id FROM w_{t}),
{_sql_identical(f"(SELECT * FROM {t}_l WHERE id NOT IN (SELECT left_id FROM d_{t}))", f"(SELECT * FROM {t}_r WHERE id NOT IN (SELECT right_id FROM d_{t}))", f"v_{t}")},
m_{t} AS (SELECT * FROM d_{t} UNION ALL SELECT * FROM v_{t})"""


_TREE_SIDES = ", ".join(f"{t}_{s} AS (SELECT *, {sql.string_code('text')} AS code FROM ({q}))" for t, both in _LEVELS.items() for s, q in zip("lr", both, strict=True))
_NESTED = f"""{_TREE_SIDES}, {_sql_identical("nation_l", "nation_r", "m_nation")},
{_sql_level("customer", "m_nation")}, {_sql_level("orders", "m_customer")}"""


@query(f"WITH {_NESTED} SELECT left_id, right_id FROM i_customer")
def identical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage: customers that are the same on both sides under matched nations."""
    (_, nl, nr), (_, cl, cr), _ = tree_sides(spark, sf_dir)
    above = walk.identical(nl, nr, "text", "number").select(F.col("left_id").alias("parent"), F.col("right_id").alias("box"))
    return walk.identical(cl.join(above, "parent"), cr.withColumn("box", F.col("parent")), "box", "text", "number")


@query(f"WITH {_NESTED} SELECT left_id, right_id FROM m_customer")
def match_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of one level: customers under matched nations, then those that moved."""
    (_, nl, nr), (_, cl, cr), _ = tree_sides(spark, sf_dir)
    return matchloop.match_level(cl, cr, walk.identical(nl, nr, "text", "number"))


def _sql_nested(t: str, above: str | None) -> str:
    turned = f"LEFT JOIN {above} a ON a.right_id = r.parent" if above else ""
    return f"""SELECT '{t}' AS type, coalesce(l.id, -1) AS left_id, coalesce(r.id, -1) AS right_id, coalesce(l.parent, {'a.left_id' if above else 'NULL'}, -1)::BIGINT AS parent_match
FROM (SELECT l.id AS left_id, m.right_id FROM {t}_l l LEFT JOIN m_{t} m ON m.left_id = l.id UNION ALL SELECT NULL, id FROM {t}_r WHERE id NOT IN (SELECT right_id FROM m_{t})) p
LEFT JOIN {t}_l l ON l.id = p.left_id LEFT JOIN {t}_r r ON r.id = p.right_id {turned}"""


NESTED_SQL = f"{_sql_nested('nation', None)} UNION ALL {_sql_nested('customer', 'm_nation')} UNION ALL {_sql_nested('orders', 'm_customer')}"


@query(f"WITH {_NESTED} {NESTED_SQL}")
def nested_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and orders, level by level, each under the match of its container; -1 for none."""
    found = matchloop.nested(tree_sides(spark, sf_dir))
    return found.select("type", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("left_id", "right_id", "parent_match")])


# ---- profiling

_TYPES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM {t}" for t in _TYPES))
def objects_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _TYPES:
        own = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("type"), "n")
        out = own if out is None else out.unionByName(own)
    return out


_FEATURE_CODES = f"""f AS (
  SELECT p_type AS type, 'p_name' AS feature, {sql.string_code("p_name")} AS code FROM part
  UNION ALL SELECT p_type, 'p_brand', {sql.string_code("p_brand")} FROM part)"""


def feature_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, feature, code) of two features of parts."""
    parts = table(spark, sf_dir, "part")
    out = None
    for name in ("p_name", "p_brand"):
        # many parts share a value: it is hashed once, and its rows are a count
        counted = parts.groupBy(F.col("p_type").alias("type"), F.col(name).alias("value")).agg(F.count("*").alias("n"))
        own = counted.select("type", F.lit(name).alias("feature"), K.string_code(F.col("value")).alias("code"), "n")
        out = own if out is None else out.unionByName(own)
    return out


_OCCURRENCES = f"WITH {_FEATURE_CODES}, o AS (SELECT type, feature, b::BIGINT AS bit, count(*) AS n FROM f, range(0, 64) t(b) WHERE (code >> b::INT) & 1 = 1 GROUP BY ALL)"


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(63))
    set_ = F.explode(F.filter(places, lambda k: K.has_bit(F.col("code"), k) == 1))
    bits = feature_codes(spark, sf_dir).select("type", "feature", "n", set_.alias("place"))
    bits = bits.withColumn("bit", F.col("place").cast("long"))
    return bits.groupBy("type", "feature", "bit").agg(F.sum("n").alias("n"))


@query(f"{_OCCURRENCES} SELECT * FROM o")
def bit_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir)


@query(f"{_OCCURRENCES}, t AS (SELECT p_type AS type, count(*) AS total FROM part GROUP BY 1) SELECT type, feature, round(avg(ln(total::DOUBLE / n)), 6) AS uniqueness FROM o JOIN t USING (type) GROUP BY ALL")
def bit_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("total"))
    rare = F.avg(F.ln(F.col("total").cast("double") / F.col("n")))
    return occurrences(spark, sf_dir).join(totals, "type").groupBy("type", "feature").agg(F.round(rare, 6).alias("uniqueness"))


@query(f"WITH {_FEATURE_CODES} SELECT type, feature, round(avg(bit_count(code)::DOUBLE) / 64, 6) AS width FROM f GROUP BY ALL")
def feature_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.sum(F.bit_count("code") * F.col("n")) / F.sum("n").cast("double") / 64
    return feature_codes(spark, sf_dir).groupBy("type", "feature").agg(F.round(width, 6).alias("width"))


# ---- evaluation

_LABELLED = f"""{sql.CODED}, p AS (SELECT l.type AS category, round({sql.cosine("l.code", "r.code")}, 9) AS sim,
  (levenshtein(l.name, r.name)::DOUBLE / greatest(length(l.name), length(r.name), 1) <= 0.25) AS belongs FROM l JOIN r USING (type))"""
_CONFUSION = f"""{_LABELLED}, q AS (SELECT category, floor(sim * 100 + 1e-9) AS reached, belongs, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT range AS threshold FROM range(10, 81)),
k AS (SELECT category, threshold, coalesce(sum(n) FILTER (belongs AND reached >= threshold), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (belongs AND reached < threshold), 0)::BIGINT AS fn,
  coalesce(sum(n) FILTER (NOT belongs AND reached >= threshold), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (NOT belongs AND reached < threshold), 0)::BIGINT AS tn FROM q, t GROUP BY ALL)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, sim, belongs, n) of all pairs of parts and edited parts of one type: similarity and belonging
    depend on the names alone, so a row is a pair of distinct names and n the pairs of objects that have them.
    Evaluation asks for the unlike pairs as well, so its work grows with the square of a type's distinct names."""
    l, r = sides(spark, sf_dir)
    named = lambda d, a: d.groupBy("type", F.col("name").alias(f"{a}_name"), F.col("code").alias(f"{a}_code")).agg(F.count("*").alias(f"{a}_n"))
    met = named(l, "left").join(named(r, "right"), "type")
    belongs = matching.text_distance(F.col("left_name"), F.col("right_name")) <= 0.25
    sim = F.round(S.cosine(F.col("left_code"), F.col("right_code")), 9)
    return met.select(F.col("type").alias("category"), sim.alias("sim"), belongs.alias("belongs"), (F.col("left_n") * F.col("right_n")).alias("n"))


@query(f"WITH {_CONFUSION} SELECT category, threshold::INT AS threshold, tp, fn, fp, tn FROM k")
def threshold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(labelled(spark, sf_dir))


_METRICS = """s AS (SELECT category, threshold, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS tpr, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0) AS fpr,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS prec, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0.0) AS acc FROM k)"""


@query(f"WITH {_CONFUSION}, {_METRICS} SELECT category, threshold::INT AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prec, 6) AS prec, round(acc, 6) AS acc FROM s")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.metrics(evaluation.confusion(labelled(spark, sf_dir)))
    return scores.select("category", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "prec", "acc")])


@query(f"""WITH {_CONFUSION}, {_METRICS}, a AS (SELECT threshold, avg(tpr) AS recall, avg(prec) AS prec FROM s GROUP BY 1),
f AS (SELECT threshold, round(5 * prec * recall / nullif(4 * prec + recall, 0), 9) AS f2 FROM a)
SELECT threshold::INT AS threshold, f2 FROM f WHERE f2 IS NOT NULL ORDER BY f2 DESC, threshold LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_threshold(evaluation.metrics(evaluation.confusion(labelled(spark, sf_dir))))


_QUARTILES = ", ".join(
    f"v[(floor(p{k}))::INT + 1] + (v[least((floor(p{k}))::INT + 2, n)] - v[(floor(p{k}))::INT + 1]) * (p{k} - floor(p{k})) AS q{k}" for k in (1, 2, 3)
)
_PLACES = ", ".join(f"CASE WHEN n >= 4 THEN {p}::DOUBLE * (n + 1) - 1 ELSE (n - 1) * {p}::DOUBLE END AS p{k}" for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))


@query(f"""WITH g AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1),
h AS (SELECT *, {_PLACES} FROM g), q AS (SELECT l_returnflag, {_QUARTILES} FROM h)
SELECT l_returnflag, q1, q2, q3, min(l_quantity) FILTER (l_quantity >= q1 - (q3 - q1) * 2.25 AND l_quantity <= q3 + (q3 - q1) * 2.25) AS low,
  max(l_quantity) FILTER (l_quantity >= q1 - (q3 - q1) * 2.25 AND l_quantity <= q3 + (q3 - q1) * 2.25) AS high FROM q JOIN lineitem USING (l_returnflag) GROUP BY ALL""")
def boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.boxplot(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")


@query(f"""WITH {_MUTUAL}, n AS (SELECT type, count(*) AS n FROM r GROUP BY 1), k AS (SELECT left_id, count(*) AS k FROM c GROUP BY 1)
SELECT l.type, (m.left_id IS NOT NULL) AS matched, round(avg(CASE WHEN m.left_id IS NOT NULL THEN 1 - coalesce(k.k, 0)::DOUBLE / n.n ELSE coalesce(k.k, 0)::DOUBLE / n.n END), 6) AS rate
FROM l JOIN n USING (type) LEFT JOIN k ON k.left_id = l.id LEFT JOIN m ON m.left_id = l.id GROUP BY ALL""")
def candidate_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How few of a type's objects are candidates: spared where there is a match, left where there is none."""
    l, r, found = mutual(spark, sf_dir)
    sizes = r.groupBy("type").agg(F.count("*").alias("n"))
    # candidates are counted by code
    own = code_candidates(l, r).select("type", "code", "k")
    rows = l.join(sizes, "type").join(own, ["type", "code"], "left").join(found.select(F.col("left_id").alias("id"), F.lit(True).alias("found")), "id", "left")
    share = F.coalesce("k", F.lit(0)).cast("double") / F.col("n")
    matched = F.col("found").isNotNull()
    return rows.groupBy("type", matched.alias("matched")).agg(F.round(F.avg(F.when(matched, 1 - share).otherwise(share)), 6).alias("rate"))


_TRIPLES = f"""{sql.CODED}, ln AS (SELECT type, name, code, count(*) AS n FROM l GROUP BY ALL), rn AS (SELECT type, name, code, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT ln.type, ln.name AS a, rn.name AS b, ln.n AS n, rn.n AS m, round({sql.cosine("ln.code", "rn.code")}, 9) AS sim,
  round(levenshtein(ln.name, rn.name)::DOUBLE / greatest(length(ln.name), length(rn.name), 1), 9) AS dist FROM ln JOIN rn USING (type)),
t AS (SELECT x.n * x.m * y.m AS w, (x.dist < y.dist AND x.sim < y.sim) OR (x.dist > y.dist AND x.sim > y.sim) AS wrong,
  x.dist = y.dist AND (x.sim >= 0.5) <> (y.sim >= 0.5) AS tie FROM s x JOIN s y ON x.type = y.type AND x.a = y.a AND x.b < y.b)"""


@query(f"""WITH {_TRIPLES} SELECT sum(w)::BIGINT AS triples, coalesce(sum(w) FILTER (wrong), 0)::BIGINT AS inconsistent, coalesce(sum(w) FILTER (tie), 0)::BIGINT AS ties,
round(coalesce(sum(w) FILTER (wrong), 0)::DOUBLE / sum(w)::DOUBLE, 6) AS inconsistent_rate, round(coalesce(sum(w) FILTER (tie), 0)::DOUBLE / sum(w)::DOUBLE, 6) AS tie_rate FROM t""")
def consistency_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an object and two others of its type with unlike names: how often the nearer one is less similar, and how
    often two equally near ones lie on both sides of 0.5. Triples are counted by their names."""
    l, r = sides(spark, sf_dir)
    named = lambda d, side: d.groupBy("type", F.col("name").alias(side), F.col("code").alias(f"{side}_code")).agg(F.count("*").alias(f"{side}_n"))
    s = named(l, "a").join(named(r, "b"), "type").select(
        "type", "a", "b", F.col("a_n").alias("n"), F.col("b_n").alias("m"), F.round(S.cosine(F.col("a_code"), F.col("b_code")), 9).alias("sim"),
        F.round(matching.text_distance(F.col("a"), F.col("b")), 9).alias("dist"),
    )
    other = s.select("type", "a", *[F.col(c).alias(f"{c}2") for c in ("b", "m", "sim", "dist")])
    t = s.join(other, ["type", "a"]).filter("b < b2").withColumn("w", F.col("n") * F.col("m") * F.col("m2"))
    wrong = F.expr("(dist < dist2 AND sim < sim2) OR (dist > dist2 AND sim > sim2)")
    tie = F.expr("dist = dist2 AND (sim >= 0.5) <> (sim2 >= 0.5)")
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    rate = lambda c: F.round(total(c).cast("double") / F.sum("w").cast("double"), 6)
    return t.agg(F.sum("w").alias("triples"), total(wrong).alias("inconsistent"), total(tie).alias("ties"), rate(wrong).alias("inconsistent_rate"), rate(tie).alias("tie_rate"))


_EDIT = sql.edit_class("p_partkey")
_KINDS = (("deleted", 0, 49), ("renamed", 50, 149), ("moved", 150, 169), ("created", 170, 199))


@query(f"SELECT p_brand, {', '.join(f'count(*) FILTER ({_EDIT} BETWEEN {a} AND {b}) AS {k}' for k, a, b in _KINDS)}, count(*) AS total FROM part GROUP BY 1")
def edit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.edit_class(F.col("p_partkey"))
    counts = [F.count_if(m.between(a, b)).alias(k) for k, a, b in _KINDS]
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*counts, F.count("*").alias("total"))


# ---- mutation

_CUT = sql.edit_class("c_custkey")


@query(f"""WITH d AS (SELECT c_custkey FROM customer WHERE {_CUT} < 50), o AS (SELECT o_orderkey, o_custkey FROM orders SEMI JOIN d ON o_custkey = c_custkey)
SELECT c_custkey AS root, 'customer' AS type, c_custkey AS key, 1 AS n FROM d UNION ALL SELECT o_custkey, 'orders', o_orderkey, 1 FROM o
UNION ALL SELECT o_custkey, 'lineitem', o_orderkey, count(*) FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def mutate_delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted customers with all that they contain: their orders, and how many line items each of these has."""
    dead = table(spark, sf_dir, "customer").filter(model.edit_class(F.col("c_custkey")) < 50).select("c_custkey")
    below = table(spark, sf_dir, "orders").join(dead, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_custkey", "o_orderkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey").join(below, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey")
    own = lambda d, root, type_, key, n: d.select(F.col(root).alias("root"), F.lit(type_).alias("type"), F.col(key).alias("key"), n.cast("long").alias("n"))
    every = own(dead, "c_custkey", "customer", "c_custkey", F.lit(1)).unionByName(own(below, "o_custkey", "orders", "o_orderkey", F.lit(1)))
    return every.unionByName(own(items.agg(F.count("*").alias("n")), "o_custkey", "lineitem", "o_orderkey", F.col("n")))


@query(f"WITH {sql.EDITED} SELECT p_partkey, p_name, p_type FROM edited")
def mutate_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.edited_parts(table(spark, sf_dir, "part")).select("p_partkey", "p_name", "p_type")


@query(f"SELECT c_custkey, {_MOVED_SQL}::INT AS c_nationkey FROM customer")
def mutate_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.edit_class(F.col("c_custkey"))
    moved = F.when(m.between(150, 169), (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", moved.cast("int").alias("c_nationkey"))


@query(f"SELECT p_partkey + {model.CREATED} AS p_partkey, reverse(p_name) AS p_name, p_brand, p_type FROM part WHERE {_EDIT} BETWEEN 170 AND 199")
def mutate_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = model.edited_parts(table(spark, sf_dir, "part"))
    return edited.filter(F.col("p_partkey") >= model.CREATED).select("p_partkey", "p_name", "p_brand", "p_type")


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN {sql.edit_class("o_custkey")} BETWEEN 200 AND 219 THEN n - 1 - ord ELSE ord END AS ord FROM o""")
def mutate_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of some customers, the other way round."""
    rows = model.ordinals(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")
    counts = rows.groupBy("o_custkey").agg(F.count("*").alias("n"))
    turned = model.edit_class(F.col("o_custkey")).between(200, 219)
    place = F.when(turned, F.col("n") - 1 - F.col("ord")).otherwise(F.col("ord"))
    return rows.join(counts, "o_custkey").select("o_orderkey", place.alias("ord"))


@query("""WITH t AS (SELECT r_regionkey, n_nationkey, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
SELECT r_regionkey, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM t GROUP BY 1""")
def subtree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region contains; each level is summed before it meets the one above."""
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per_customer, "c_custkey", "left")
    per_nation = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))
    nations = table(spark, sf_dir, "nation").join(per_nation, "n_nationkey", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"), zero("customers"), zero("orders"))


@query(f"SELECT p_partkey, {_EDIT} AS draw FROM part ORDER BY draw, p_partkey LIMIT 100")
def sample_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred parts by key arithmetic, without replacement: the sample is the feature."""
    rows = table(spark, sf_dir, "part").select("p_partkey", model.edit_class(F.col("p_partkey")).alias("draw"))
    return rows.orderBy("draw", "p_partkey").limit(100)


@query("""WITH t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), c AS (SELECT p_type, n, sum(n) OVER (ORDER BY p_type)::BIGINT AS upto, sum(n) OVER ()::BIGINT AS total FROM t)
SELECT p_type, n, round((upto - n)::DOUBLE / total, 6) AS from_, round(upto::DOUBLE / total, 6) AS to_ FROM c""")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of [0, 1) in which a draw picks each type."""
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    # a row for each type
    upto, total = F.sum("n").over(Window.orderBy("p_type")), F.sum("n").over(Window.partitionBy(F.lit(1)))
    run = counts.withColumn("upto", upto).withColumn("total", total)
    share = lambda c: F.round(c.cast("double") / F.col("total"), 6)
    return run.select("p_type", "n", share(F.col("upto") - F.col("n")).alias("from_"), share(F.col("upto")).alias("to_"))


_RADIUS = "least(ceil(bit_count(lc.code) * (1 + 1 / 0.7::DOUBLE - sqrt(0.7::DOUBLE)) / 2), 13)"


@query(f"WITH {sql.CODED}, d AS (SELECT lc.type, lc.code AS left_code, rc.code AS right_code, {_KNN} AS distance, {_RADIUS} AS radius FROM lc JOIN rc USING (type)) SELECT type, left_code, right_code, distance, radius::BIGINT AS radius FROM d WHERE distance <= radius")
def tree_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes within the radius that a code's own weight and its least similarity ask for."""
    found = _near(spark, sf_dir, 13)
    radius = K.tree_radius(F.bit_count("left_code"), F.lit(0.7)).cast("long")
    return found.withColumn("radius", radius).filter(F.col("distance") <= F.col("radius")).select(
        "type", "left_code", "right_code", "distance", "radius"
    )


@query(f"WITH {_CONFUSION}, {_METRICS}, f AS (SELECT category, threshold, round(5 * prec * tpr / nullif(4 * prec + tpr, 0), 9) AS f2 FROM s) SELECT category, max(f2) AS best_f2, min(f2) AS worst_f2, count(f2) AS n FROM f GROUP BY 1")
def f2_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.metrics(evaluation.confusion(labelled(spark, sf_dir)))
    f2 = scores.withColumn("f2", F.round(evaluation.f_beta(F.col("prec"), F.col("tpr")), 9)).groupBy("category")
    return f2.agg(F.max("f2").alias("best_f2"), F.min("f2").alias("worst_f2"), F.count("f2").alias("n"))


@query(f"WITH {_MUTUAL}, d AS (SELECT coalesce(x.left_id, m.left_id) AS id, (x.right_id IS DISTINCT FROM m.right_id) AS differs FROM (SELECT left_id, min(right_id) AS right_id FROM c GROUP BY 1) x FULL JOIN m ON x.left_id = m.left_id) SELECT type, count(*) AS total, count(*) FILTER (differs) AS diffs, round(count(*) FILTER (differs)::DOUBLE / count(*), 6) AS rate FROM d JOIN l USING (id) GROUP BY 1")
def diff_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two ways of matching differ, by type: the lowest id among the candidates, and mutual best."""
    l, r, found = mutual(spark, sf_dir)
    first = l.join(code_candidates(l, r), ["type", "code"]).select(F.col("id").alias("left_id"), "right_id")
    both = matching.agreement(first, found).select(F.col("left_id").alias("id"), "differs")
    diffs = F.count_if("differs")
    return both.join(l.select("id", "type"), "id").groupBy("type").agg(
        F.count("*").alias("total"), diffs.alias("diffs"), F.round(diffs.cast("double") / F.count("*"), 6).alias("rate")
    )
