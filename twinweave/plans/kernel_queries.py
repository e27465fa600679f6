"""Queries of the hash kernels, locations and similarities, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave import features, model
from twinweave.functions import kernels as K
from twinweave.functions import similarity as S
from twinweave.model import table
from twinweave.plans import sql
from twinweave.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def with_code(rows: DataFrame, text: str) -> DataFrame:
    """Adds code, the text's string code: computed once for each distinct text, which are far fewer than rows."""
    codes = rows.select(text).distinct().withColumn("code", K.string_code(F.col(text)))
    return rows.join(codes, rows[text].eqNullSafe(codes[text])).drop(codes[text])


@query(f"SELECT p_partkey, {sql.string_code('p_name')} AS code FROM part")
def simhash_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "code")


@query(f"SELECT c_custkey, {sql.bit(sql.string_position('c_mktsegment'))} AS code FROM customer")
def onehot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", K.onehot(K.string_position(F.col("c_mktsegment"))).alias("code"))


_SIZE_BIT = sql.bit(f"({K.name_position('p_size') * 31} + {sql.long_position('p_size')}) % 64")


@query(f"SELECT p_partkey, {_SIZE_BIT} AS code FROM part")
def salted_primitive_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", K.salted("p_size", K.long_position(F.col("p_size"))).alias("code"))


@query(f"SELECT o_custkey, bit_or({sql.bit(sql.long_position('o_orderkey'))}) AS code FROM orders GROUP BY 1")
def list_or_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.bit_or(K.onehot(K.long_position(F.col("o_orderkey"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(code.alias("code"))


def lanes(code: str) -> list[Column]:
    """For each bit the number of codes that have it; they combine before a shuffle."""
    return [F.sum(K.has_bit(F.col(code), F.lit(k))).alias(f"b{k}") for k in range(64)]


def from_lanes(keep: Callable[[Column], Column]) -> Column:
    counts = F.array(*[F.col(f"b{k}") for k in range(64)])
    chosen = F.transform(counts, lambda n, k: F.when(keep(n), K.bit(k)).otherwise(F.lit(0).cast("long")))
    return K.or_of(chosen)


@query(f"""
WITH c AS (SELECT o_custkey, {sql.string_code("o_orderpriority")} AS code FROM orders),
n AS (SELECT o_custkey, count(*) AS n, bit_or(code) AS any_ FROM c GROUP BY 1),
bits AS (SELECT o_custkey, b, count(*) AS k FROM c, range(0, 64) t(b) WHERE (code >> b) & 1 = 1 GROUP BY 1, 2),
won AS (SELECT o_custkey, list(b) AS bits FROM bits JOIN n USING (o_custkey) WHERE k > n // 2 GROUP BY 1)
SELECT o_custkey, CASE WHEN n <= 2 THEN any_ ELSE {sql.or_positions("coalesce(bits, [])")} END AS code
FROM n LEFT JOIN won USING (o_custkey)
""")
def list_majority_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = with_code(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_orderpriority")
    votes = codes.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bit_or("code").alias("any_"), *lanes("code"))
    majority = from_lanes(lambda k: k > F.floor(F.col("n") / 2))
    return votes.select("o_custkey", F.when(F.col("n") <= 2, F.col("any_")).otherwise(majority).alias("code"))


def _sql_rotated3(c: str) -> str:
    low = f"({c} & 3)"
    high = f"((CASE WHEN {low} >= 2 THEN 1 ELSE 0 END) * 4611686018427387904 + (CASE WHEN {low} % 2 = 1 THEN 1 ELSE 0 END) * 2305843009213693952)"
    return f"((({c} >> 3) & 2305843009213693951) | ({high})::BIGINT)"


@query(f"""
WITH c AS (SELECT DISTINCT p_name, {sql.string_code("p_name")} AS code FROM part)
SELECT p_name, {_sql_rotated3("code")} AS rotated, code | {_sql_rotated3("code")} AS strengthened FROM c
""")
def rotate_strengthen(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("code", K.string_code(F.col("p_name")))
    return codes.select("p_name", K.rotated3(F.col("code")).alias("rotated"), K.strengthened(F.col("code")).alias("strengthened"))


def _sql_vote(names: list[str], weights: list[tuple[int, int]]) -> str:
    """By the definition: bit by bit the weights for and against."""
    for_ = " + ".join(f"(CASE WHEN ({n} >> b::INT) & 1 = 1 THEN {p + q} ELSE 0 END)" for n, (p, q) in zip(names, weights, strict=True))
    against = " + ".join(f"(CASE WHEN {n} <> 0 THEN {q} ELSE 0 END)" for n, (_, q) in zip(names, weights, strict=True))
    return sql.kept_bits(f"({for_}) > ({against})")


_TREE = """
nat AS (SELECT n_nationkey, '@nations.' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS f FROM nation),
cus AS (SELECT c_custkey, c_nationkey, '@customers.' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS f FROM customer),
sup AS (SELECT s_suppkey, s_nationkey, '@suppliers.' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS f FROM supplier),
ord AS (SELECT o_orderkey, o_custkey, '@orders.' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS f FROM orders),
loc AS (
  SELECT 'region' AS type, r_regionkey::BIGINT AS key, ['0'] AS location FROM region
  UNION ALL SELECT 'part', p_partkey, ['0'] FROM part
  UNION ALL SELECT 'nation', n_nationkey::BIGINT, [f, '0'] FROM nat
  UNION ALL SELECT 'customer', c_custkey, [cus.f, nat.f, '0'] FROM cus JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier', s_suppkey, [sup.f, nat.f, '0'] FROM sup JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT 'orders', o_orderkey, [ord.f, cus.f, nat.f, '0'] FROM ord JOIN cus USING (o_custkey = c_custkey) JOIN nat ON c_nationkey = n_nationkey
)""".replace("USING (o_custkey = c_custkey)", "ON o_custkey = c_custkey")


@query(f"WITH {_TREE} SELECT type, key, list_aggregate(location, 'string_agg', '/') || '/' AS location FROM loc")
def location_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.locations(spark, sf_dir)
    return found.select("type", "key", F.concat(F.array_join("location", "/"), F.lit("/")).alias("location"))


_LOCATION_CODE = sql.or_positions(f"list_transform(location, lambda x: {sql.string_position('x')})")


@query(f"WITH {_TREE} SELECT type, key, {_LOCATION_CODE} AS code FROM loc")
def location_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.locations(spark, sf_dir).select("type", "key", "code")


@query(f"WITH {_TREE} SELECT c_custkey, f AS fragment FROM cus")
def fragment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return model.ordinals(rows, "c_nationkey", "c_custkey").select("c_custkey", model.fragment("customers", F.col("ord")).alias("fragment"))


_PART_FEATURES = ("p_name", "p_brand", "p_type", "p_size")


@query(f"""WITH f AS (SELECT p_partkey, {", ".join(f"{sql.string_code(x) if x != 'p_size' else _SIZE_BIT} AS f{k}" for k, x in enumerate(_PART_FEATURES))} FROM part)
SELECT p_partkey, f0 | {_sql_rotated3('f0')} | f1 | f2 | f3 AS code FROM f""")
def object_hash_weighted_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts, without weights against: the OR of the features' codes, the name's strengthened."""
    values = {f.name: f for f in features.FEATURES if f.type == "part"}
    parts = table(spark, sf_dir, "part").select("p_partkey", *_PART_FEATURES)
    for name in _PART_FEATURES[:3]:
        parts = with_code(parts, name).withColumnRenamed("code", f"_{name}")
    code = K.strengthened(F.col("_p_name")).bitwiseOR(F.col("_p_brand")).bitwiseOR(F.col("_p_type")).bitwiseOR(features.hashed(values["p_size"]))
    return parts.select("p_partkey", code.alias("code"))


# ---- object hashes of all types, by the feature table


def object_attribute_sql(f: features.Feature, strengthen: bool = False) -> str:
    if f.value == "string":
        code = sql.string_code(f.name)
        return _sql_rotated3(code) + f" | {code}" if strengthen else code
    position = sql.long_position(f.name) if f.name == "p_size" else sql.double_position(f.name)
    return sql.bit(f"({K.name_position(f.name) * 31} + {position}) % 64")


def object_codes_sql(kind: str) -> str:
    """A part for each type: the codes of its features, then their vote."""
    parts = []
    for type_, (table_, key, up) in model.TYPES.items():
        columns, votes, joins = [], [], []
        for f, p, q in features.used(type_, kind):
            name = f"f{len(votes)}"
            if f.container:
                columns.append(f"up.code AS {name}")
                joins.append(f"LEFT JOIN lc up ON up.type = '{f.value}' AND up.key = {up}")
            elif f.many:
                columns.append(f"b_{f.name}.code AS {name}")
                joins.append(f"LEFT JOIN below b_{f.name} ON b_{f.name}.feature = '{f.name}' AND b_{f.name}.up = {key}")
            elif f.reference:
                columns.append(f"r_{f.name}.code AS {name}")
                joins.append(f"LEFT JOIN lc r_{f.name} ON r_{f.name}.type = '{f.value}' AND r_{f.name}.key = {model.REFERENCES[type_, f.name]}")
            else:
                columns.append(f"{object_attribute_sql(f, p > 50)} AS {name}")
            votes.append((p, q))
        names = [f"coalesce(f{k}, 0)" for k in range(len(votes))]
        code = _sql_vote(names, votes) if votes else "0::BIGINT"
        own = f"SELECT {key}::BIGINT AS key{''.join(', ' + c for c in columns)} FROM {table_} {' '.join(joins)}"
        parts.append(f"SELECT '{type_}' AS type, key, {code} AS code FROM ({own})")
    return f"""WITH {_TREE}, lc AS (SELECT type, key, location, {_LOCATION_CODE} AS code FROM loc),
below AS (
  SELECT 'nations' AS feature, n_regionkey::BIGINT AS up, bit_or(code) AS code FROM lc JOIN nation ON type = 'nation' AND key = n_nationkey GROUP BY ALL
  UNION ALL SELECT 'customers', c_nationkey, bit_or(code) FROM lc JOIN customer ON type = 'customer' AND key = c_custkey GROUP BY ALL
  UNION ALL SELECT 'suppliers', s_nationkey, bit_or(code) FROM lc JOIN supplier ON type = 'supplier' AND key = s_suppkey GROUP BY ALL
  UNION ALL SELECT 'orders', o_custkey, bit_or(code) FROM lc JOIN orders ON type = 'orders' AND key = o_orderkey GROUP BY ALL
  UNION ALL SELECT 'lineitems', l_orderkey, bit_or(lc.code | {sql.bit(sql.string_position("f"))}) FROM (
    SELECT l_orderkey, '@lineitems.' || (row_number() OVER (PARTITION BY l_orderkey) - 1) AS f FROM lineitem) JOIN lc ON type = 'orders' AND key = l_orderkey GROUP BY ALL
) {" UNION ALL ".join(parts)}"""


def _register_object_codes(kind: str) -> None:
    QUERIES[f"object_hash_{kind}"] = lambda spark, sf_dir: features.object_codes(spark, sf_dir, kind)
    ORACLES[f"object_hash_{kind}"] = object_codes_sql(kind)


for _kind in features.KINDS:
    _register_object_codes(_kind)


@query(f"""
WITH own AS (SELECT n_nationkey, {sql.string_code("n_name")} AS code FROM nation),
c AS (SELECT c_nationkey, {sql.string_code("c_name")} AS code FROM customer),
n AS (SELECT c_nationkey, count(*) AS n FROM c WHERE code <> 0 GROUP BY 1),
bits AS (SELECT c_nationkey, b, count(*) AS k FROM c, range(0, 64) t(b) WHERE (code >> b::INT) & 1 = 1 GROUP BY 1, 2),
won AS (SELECT c_nationkey, list(b) AS bits FROM bits JOIN n USING (c_nationkey) WHERE 3 * k > n GROUP BY 1)
SELECT n_nationkey, code | {sql.or_positions("coalesce(bits, [])")} AS code FROM own LEFT JOIN won ON n_nationkey = c_nationkey
""")
def conv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's code with its customers': a bit of theirs counts if more than a third of them have it."""
    codes = table(spark, sf_dir, "customer").select("c_nationkey", K.string_code(F.col("c_name")).alias("code"))
    votes = codes.filter("code <> 0").groupBy("c_nationkey").agg(F.count("*").alias("n"), *lanes("code"))
    around = votes.select("c_nationkey", from_lanes(lambda k: 3 * k > F.col("n")).alias("around"))
    own = table(spark, sf_dir, "nation").select("n_nationkey", K.string_code(F.col("n_name")).alias("own"))
    joined = own.join(around, own.n_nationkey == around.c_nationkey, "left")
    return joined.select("n_nationkey", F.col("own").bitwiseOR(F.coalesce("around", F.lit(0).cast("long"))).alias("code"))


_PATTERN = " || ',' || ".join(f"bit_count((code >> {8 * k}) & 255)" for k in range(8))


@query(f"WITH c AS (SELECT p_partkey, {sql.string_code('p_name')} AS code FROM part) SELECT p_partkey, {_PATTERN} AS pattern FROM c")
def code_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = with_code(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    return codes.select("p_partkey", F.array_join(K.pattern(F.col("code"), 3).cast("array<string>"), ",").alias("pattern"))


@query("""
SELECT p_partkey, CASE WHEN length(p_name) <= 2 THEN p_name
  ELSE list_aggregate(list_transform(range(1, length(p_name)), lambda i: p_name[i:i + 1]), 'string_agg', '|') END AS grams FROM part
""")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(K.ngrams(F.col("p_name")), "|").alias("grams"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, name, edited, a, b): parts and their edited versions with both string codes."""
    parts = table(spark, sf_dir, "part")
    left = with_code(parts.select("p_partkey", "p_name"), "p_name").select("p_partkey", F.col("p_name").alias("name"), F.col("code").alias("a"))
    right = with_code(model.edited_parts(parts).select("p_partkey", "p_name"), "p_name")
    return left.join(right.select("p_partkey", F.col("p_name").alias("edited"), F.col("code").alias("b")), "p_partkey")


_VERSIONS = f"""{sql.CODED}, v AS (SELECT l.id AS p_partkey, l.name AS name, r.name AS edited, l.code AS a, r.code AS b FROM l JOIN r USING (id))"""


def _measure(name: str, spark_form: Callable[[Column, Column], Column], sql_form: Callable[[str, str], str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return versions(spark, sf_dir).select("p_partkey", F.round(spark_form(F.col("a"), F.col("b")), 6).alias(name))

    QUERIES[f"sim_{name}"] = run
    ORACLES[f"sim_{name}"] = f"WITH {_VERSIONS} SELECT p_partkey, round({sql_form('a', 'b')}, 6) AS {name} FROM v"


_measure("cosine", S.cosine, sql.cosine)
_measure("jaccard", S.jaccard, sql.jaccard)
_measure("sorensen", S.sorensen, sql.sorensen)
_measure("simple", S.simple, sql.simple)
_measure("hamming", S.hamming_similarity, lambda a, b: f"(1.0::DOUBLE - {sql.hamming(a, b)} / 64.0::DOUBLE)")


@query(f"WITH {_VERSIONS} SELECT p_partkey, {sql.hamming('a', 'b')} AS distance FROM v")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("p_partkey", S.hamming(F.col("a"), F.col("b")).cast("long").alias("distance"))


_WORDS = "string_split(name, ' ') AS x, string_split(edited, ' ') AS y"


@query(f"""WITH {_VERSIONS}, w AS (SELECT p_partkey, {_WORDS} FROM v)
SELECT p_partkey, round(length(list_intersect(x, y))::DOUBLE / length(list_distinct(list_concat(x, y))), 6) AS jaccard FROM w""")
def onehot_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.set_jaccard(F.array_distinct(F.split("name", " ")), F.array_distinct(F.split("edited", " ")))
    return versions(spark, sf_dir).select("p_partkey", F.round(words, 6).alias("jaccard"))


@query(f"""WITH {_VERSIONS}, w AS (SELECT p_partkey, {_WORDS} FROM v), s AS (SELECT p_partkey,
  list_distinct(list_transform(x, lambda t: {sql.string_position("t")})) AS x, list_distinct(list_transform(y, lambda t: {sql.string_position("t")})) AS y FROM w)
SELECT p_partkey, (length(x) + length(y) - 2 * length(list_intersect(x, y)))::BIGINT AS distance FROM s""")
def int_set_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.array_distinct(F.transform(F.split(c, " "), K.string_position))
    return versions(spark, sf_dir).select("p_partkey", S.set_hamming(ids("name"), ids("edited")).cast("long").alias("distance"))


_L1 = " + ".join(f"abs(bit_count((a >> {8 * k}) & 255)::BIGINT - bit_count((b >> {8 * k}) & 255)::BIGINT)" for k in range(8))


@query(f"WITH {_VERSIONS} SELECT p_partkey, ({_L1})::BIGINT AS distance FROM v")
def array_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the patterns of two codes; never more than the codes' Hamming distance."""
    pattern = lambda c: K.pattern(F.col(c), 3).cast("array<long>")
    return versions(spark, sf_dir).select("p_partkey", S.l1(pattern("a"), pattern("b")).alias("distance"))


@query("SELECT DISTINCT p_name, dense_rank() OVER (ORDER BY p_name)::BIGINT AS word_id FROM part")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of distinct names. Names are counted within their first letters, then the letters' totals added."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("head", F.substring("p_name", 1, 2))
    totals = names.groupBy("head").agg(F.count("*").alias("n"))
    # a row for each pair of letters
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("head").orderBy("p_name"))
    return names.withColumn("own", own).join(starts, "head").select("p_name", (F.col("start") + F.col("own")).alias("word_id"))


_STRING_HASH = (
    "(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT list_reduce(list_prepend(0::BIGINT, "
    "list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h))"
)


@query(f"SELECT c_custkey, {_STRING_HASH}::BIGINT AS hash FROM customer")
def string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", K.string_hash(F.col("c_name")).alias("hash"))


_PYRAMID = " || ',' || ".join(
    f"bit_count((code >> {64 // n * k}) & {(1 << 64 // n) - 1})" for n in (8, 4, 2) for k in range(n)
) + " || ',' || bit_count(code)"


@query(f"WITH c AS (SELECT DISTINCT p_name, {sql.string_code('p_name')} AS code FROM part) SELECT p_name, {_PYRAMID} AS pyramid FROM c")
def pattern_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("code", K.string_code(F.col("p_name")))
    return codes.select("p_name", F.array_join(K.pyramid(F.col("code"), 3).cast("array<string>"), ",").alias("pyramid"))


_MUTATED = """SELECT s_suppkey,
  CASE WHEN s_suppkey % 10 < 4 THEN substr(s_name, 1, 4) || 'x' || substr(s_name, 5) WHEN s_suppkey % 10 < 6 THEN substr(s_name, 1, 3) || substr(s_name, 5) ELSE s_name END AS s_name,
  round(s_acctbal + (s_suppkey * 37 % 21 - 10), 2) AS s_acctbal, s_suppkey % 2 = 0 AS flag FROM supplier"""


@query(_MUTATED)
def mutate_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of single values: a letter put in or taken out of a name, a number moved a little, a flag turned."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    longer = F.concat(F.substring(name, 1, 4), F.lit("x"), F.substr(name, F.lit(5)))
    shorter = F.concat(F.substring(name, 1, 3), F.substr(name, F.lit(5)))
    edited = F.when(key % 10 < 4, longer).when(key % 10 < 6, shorter).otherwise(name)
    moved = F.round(F.col("s_acctbal") + (key * 37 % 21 - 10), 2)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return rows.select("s_suppkey", edited.alias("s_name"), moved.alias("s_acctbal"), (~(key % 2 == 1)).alias("flag"))


@query(f"""SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT c_custkey, {sql.double_hash("c_acctbal")} AS h FROM customer)""")
def number_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of doubles: their bits folded to 32."""
    return table(spark, sf_dir, "customer").select("c_custkey", K.number_hash(F.col("c_acctbal"), double=True).alias("hash"))


@query("SELECT c_custkey, (CASE WHEN c_acctbal IS NULL THEN 0 WHEN c_acctbal < 0 THEN 1231 ELSE 1237 END)::BIGINT AS hash, CASE WHEN c_acctbal < 0 THEN 1231 % 64 ELSE 1237 % 64 END AS position FROM customer")
def boolean_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    owes = F.col("c_acctbal") < 0
    return table(spark, sf_dir, "customer").select("c_custkey", K.boolean_hash(owes).alias("hash"), K.boolean_position(owes).alias("position"))


_SIGNED_HASH = _STRING_HASH.replace("c_name", "x")


@query(f"""WITH {_TREE}, f AS (SELECT type, key, unnest(location) AS x, length(location) AS n FROM loc), h AS (SELECT type, key, n, {_SIGNED_HASH}::BIGINT AS h FROM f),
bits AS (SELECT type, key, b, any_value(n) AS n, count(*) AS k FROM h, range(0, 64) t(b) WHERE (h >> b::INT) & 1 = 1 GROUP BY ALL),
won AS (SELECT type, key, list(b) AS bits FROM bits WHERE k > n // 2 GROUP BY ALL)
SELECT loc.type, loc.key, {sql.or_positions("coalesce(bits, [])")} AS code FROM loc LEFT JOIN won USING (type, key)""")
def location_majority_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that more than half of a location's fragments have in their whole hash."""
    rows = written(model.locations(spark, sf_dir).select("type", "key", F.explode("location").alias("x")), "fragments")
    # a fragment is hashed once, wherever it stands
    hashes = rows.select("x").distinct().withColumn("h", K.string_hash(F.col("x")))
    votes = rows.join(hashes, "x").groupBy("type", "key").agg(F.count("*").alias("n"), *lanes("h"))
    return votes.select("type", "key", from_lanes(lambda k: k > F.floor(F.col("n") / 2)).alias("code"))


@query(f"""WITH o AS (SELECT o_custkey, list(o_orderkey % 97 ORDER BY o_orderkey) AS v, list_distinct(list(o_orderkey % 256)) AS s FROM orders GROUP BY 1),
n AS (SELECT o_custkey, v, s, length(v)::BIGINT AS n FROM o), h AS (SELECT *, n // 2 AS m FROM n)
SELECT o_custkey, concat_ws(',', coalesce(list_sum(v[1:m // 2]), 0)::BIGINT, coalesce(list_sum(v[m // 2 + 1:m]), 0)::BIGINT, coalesce(list_sum(v[m + 1:(m + n) // 2]), 0)::BIGINT, coalesce(list_sum(v[(m + n) // 2 + 1:n]), 0)::BIGINT) AS sums,
  concat_ws(',', length(list_filter(s, lambda x: x <= 64)), length(list_filter(s, lambda x: x > 64 AND x <= 128)), length(list_filter(s, lambda x: x > 128 AND x <= 192)), length(list_filter(s, lambda x: x > 192))) AS counts FROM h""")
def array_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's order numbers: the sums of the quarters of the list, and how many of the set lie in each quarter of the range."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    values = F.transform("keys", lambda x: x % 97)
    numbers = F.array_distinct(F.transform("keys", lambda x: x % 256))
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    return own.select("o_custkey", shown(K.array_pattern(values, 2)).alias("sums"), shown(K.set_pattern(numbers, 2, 256)).alias("counts"))


@query(f"""WITH {_VERSIONS}, q AS (SELECT p_partkey, {", ".join(f"bit_count((a >> {16 * k}) & 65535)::BIGINT AS a{k}, bit_count((b >> {16 * k}) & 65535)::BIGINT AS b{k}" for k in range(4))} FROM v)
SELECT p_partkey, concat_ws(',', a0 + a1, a2 + a3) AS halves, abs(a0 - b0) + abs(a1 - b1) + abs(a2 - b2) + abs(a3 - b3) BETWEEN 1 AND 3 AS near FROM q""")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code's pattern made coarser, and whether the edited code's pattern is one to three away."""
    a, b = K.pattern(F.col("a"), 2), K.pattern(F.col("b"), 2)
    halves = F.array_join(K.pattern_abstract(a).cast("array<string>"), ",")
    return versions(spark, sf_dir).select("p_partkey", halves.alias("halves"), K.pattern_matches(a, b, 1, 3).alias("near"))


_BAG = """[p_name, p_brand, p_type, p_size::VARCHAR]"""


@query(f"""WITH w AS (SELECT p_partkey, list_sort(list_distinct({_BAG})) AS words FROM part), u AS (SELECT DISTINCT unnest(words) AS word FROM w),
d AS (SELECT word, dense_rank() OVER (ORDER BY word)::BIGINT AS id FROM u), e AS (SELECT p_partkey, unnest(words) AS word FROM w)
SELECT p_partkey, string_agg(id::VARCHAR, ',' ORDER BY id) AS word_ids FROM e JOIN d USING (word) GROUP BY 1""")
def word_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the set of its values, not told apart by feature, as sorted numbers of a dictionary."""
    names = [f.name for f in features.FEATURES if f.type == "part" and features.one_hot(f) and f.name != "p_retailprice"]
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.array(*[F.col(n).cast("string") for n in names]))).alias("word"))
    ids = words.select("word").distinct().withColumn("head", F.substring("word", 1, 2))
    totals = ids.groupBy("head").agg(F.count("*").alias("n"))
    # a row for each pair of letters
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("head").orderBy("word"))
    dictionary = ids.withColumn("own", own).join(starts, "head").select("word", (F.col("start") + F.col("own")).alias("id"))
    # a set has as many words as a part has features
    met = words.join(dictionary, "word").groupBy("p_partkey").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return met.select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("word_ids"))


@query(f"""WITH own AS (SELECT o_orderkey, {sql.string_code("o_orderpriority")} AS code FROM orders),
p AS (SELECT p_partkey, {sql.string_code("p_name")} AS code FROM part), c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, p.code FROM lineitem JOIN p ON l_partkey = p_partkey),
n AS (SELECT l_orderkey, count(*) AS n FROM c WHERE code <> 0 GROUP BY 1),
bits AS (SELECT l_orderkey, b, count(*) AS k FROM c, range(0, 64) t(b) WHERE (code >> b::INT) & 1 = 1 GROUP BY 1, 2),
won AS (SELECT l_orderkey, list(b) AS bits FROM bits JOIN n USING (l_orderkey) WHERE 7 * k > 2 * n GROUP BY 1)
SELECT o_orderkey, code | {sql.or_positions("coalesce(bits, [])")} AS code FROM own LEFT JOIN won ON o_orderkey = l_orderkey""")
def conv_hash_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's code with those of the parts it refers to: a bit counts if more than two sevenths of them have it."""
    parts = with_code(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select(F.col("p_partkey").alias("l_partkey"), "code")
    referred = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").filter("code <> 0")
    votes = referred.groupBy("l_orderkey").agg(F.count("*").alias("n"), *lanes("code"))
    around = votes.select("l_orderkey", from_lanes(lambda k: 7 * k > 2 * F.col("n")).alias("around"))
    own = with_code(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    joined = own.join(around, own.o_orderkey == around.l_orderkey, "left")
    return joined.select("o_orderkey", F.col("code").bitwiseOR(F.coalesce("around", F.lit(0).cast("long"))).alias("code"))


_ATTRIBUTES = [f for f in features.FEATURES if not f.reference and features.hashable(f) and features.hasher(f)]


@query(" UNION ALL ".join(
    f"""SELECT '{f.type}' AS type, '{f.name}' AS feature, count(*) AS n, round(avg(bit_count(code)::DOUBLE) / 64, 6) AS width, bit_count(bit_or(code))::BIGINT AS bits
FROM (SELECT {object_attribute_sql(f)} AS code FROM {model.TYPES[f.type][0]} WHERE {f.name} IS NOT NULL) WHERE code <> 0"""
    for f in _ATTRIBUTES
))
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each attribute of the feature table how many values have a code, how full it is, and how many bits are used."""
    out = None
    for f in _ATTRIBUTES:
        # equal values are hashed once
        rows = table(spark, sf_dir, model.TYPES[f.type][0]).groupBy(f.name).agg(F.count("*").alias("k")).filter(F.col(f.name).isNotNull())
        rows = K.with_double_bits(rows, [f.name] if f.value == "number" and f.name not in features.WHOLE else [])
        codes = rows.select("k", features.hashed(f).alias("code")).filter("code <> 0")
        width = F.sum(F.bit_count("code") * F.col("k")) / F.sum("k").cast("double") / 64
        own = codes.agg(F.sum("k").alias("n"), F.round(width, 6).alias("width"), F.bit_count(F.bit_or("code")).cast("long").alias("bits"))
        own = own.select(F.lit(f.type).alias("type"), F.lit(f.name).alias("feature"), "n", "width", "bits")
        out = own if out is None else out.unionByName(own)
    return out
