"""The object graph over relational tables: typed objects in a containment tree, and edited versions of them.

Region contains nations, a nation customers and suppliers, a customer orders, an order line items; parts
are roots. An edited version follows from each row's key alone (see edit_class), so it can be made anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.functions import kernels as K
from twinweave.storage import table, written

#: Keys of one bucket when places within a parent are counted.
BUCKET = 65_536


def ordinals(rows: DataFrame, parent: str, key: str) -> DataFrame:
    """Adds ord, the place of a row among those of its parent by a whole-number key, from 0.

    Counted in buckets of keys whose running totals are added, so that a parent with a large share of all
    rows isn't one task's work.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(key) / BUCKET))
    counts = bucketed.groupBy(parent, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(parent).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(parent, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(parent, "_bucket").orderBy(key)) - 1
    placed = bucketed.withColumn("_own", own).join(starts, [parent, "_bucket"])
    return placed.withColumn("ord", (F.col("_start") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_start")


def fragment(feature: str, ord_: Column) -> Column:
    return F.concat(F.lit(f"@{feature}."), ord_.cast("string"))


#: Child table, its key, its parent's key, parent table, the containing feature.
CONTAINMENT = (
    ("nation", "n_nationkey", "n_regionkey", "region", "nations"),
    ("customer", "c_custkey", "c_nationkey", "nation", "customers"),
    ("supplier", "s_suppkey", "s_nationkey", "nation", "suppliers"),
    ("orders", "o_orderkey", "o_custkey", "customer", "orders"),
)


#: Of each type its table, its key, and its parent's key.
TYPES = {
    "region": ("region", "r_regionkey", None),
    "nation": ("nation", "n_nationkey", "n_regionkey"),
    "customer": ("customer", "c_custkey", "c_nationkey"),
    "supplier": ("supplier", "s_suppkey", "s_nationkey"),
    "part": ("part", "p_partkey", None),
    "orders": ("orders", "o_orderkey", "o_custkey"),
    "lineitem": ("lineitem", "l_orderkey", "l_orderkey"),
}
#: The columns of references across the tree.
REFERENCES = {("lineitem", "part"): "l_partkey", ("lineitem", "supplier"): "l_suppkey"}


def levels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """For each type with a key of its own (key, fragment, location, code, fragment_code, above_code), level by level.

    location holds the fragments from the object up to its root, code the bits of all of them: each fragment
    is hashed once, and a level adds its own bit to the code above. Levels whose objects contain others are
    written, so that nothing is computed again for what they contain.
    """
    root, bit = F.array(F.lit("0")), K.onehot(F.lit(K.name_position("0")))
    top = [F.lit("0").alias("fragment"), root.alias("location"), bit.alias("code"), bit.alias("fragment_code"), F.lit(None).cast("long").alias("above_code")]
    found = {
        "region": table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), *top),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), *top),
    }
    for child, key, up, parent, feature in CONTAINMENT:
        rows = table(spark, sf_dir, child).select(F.col(key).cast("long").alias("key"), F.col(up).cast("long").alias("up"))
        above = found[parent].select(F.col("key").alias("up"), F.col("location").alias("above"), F.col("code").alias("above_code"))
        own = ordinals(rows, "up", "key").withColumn("fragment", fragment(feature, F.col("ord")))
        own = own.withColumn("fragment_code", K.onehot(K.string_position(F.col("fragment"))))
        placed = own.join(above, "up").select(
            "key", "fragment", F.concat(F.array("fragment"), "above").alias("location"),
            F.col("above_code").bitwiseOR(F.col("fragment_code")).alias("code"), "fragment_code", "above_code", "up",
        )
        found[child] = written(placed, child) if child in ("nation", "customer") else placed
    return found


def places_below(spark: SparkSession, sf_dir: str, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each containing feature (up, code): the bits of all contained objects' locations."""
    out = {}
    for child, _, _, parent, feature in CONTAINMENT:
        inside = found[child].groupBy("up").agg(F.bit_or("fragment_code").alias("inside"))
        above = found[parent].select(F.col("key").alias("up"), F.col("code").alias("above"))
        out[feature] = inside.join(above, "up").select("up", F.col("inside").bitwiseOR(F.col("above")).alias("code"))
    # line items differ in no location but their place, so an order's code needs only how many there are
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("up")).agg(F.count("*").alias("n"))
    bits = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: K.onehot(K.string_position(fragment("lineitems", k))))
    sizes = counts.select("n").distinct().select("n", K.or_of(bits).alias("inside"))
    above = found["orders"].select(F.col("key").alias("up"), F.col("code").alias("above"))
    codes = counts.join(sizes, "n").join(above, "up")
    out["lineitems"] = codes.select("up", F.col("inside").bitwiseOR(F.col("above")).alias("code"))
    return out


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, key, location, code) of all objects with a key of their own."""
    out = None
    for name, rows in levels(spark, sf_dir).items():
        own = rows.select(F.lit(name).alias("type"), "key", "location", "code")
        out = own if out is None else out.unionByName(own)
    return out


def edit_class(key: Column) -> Column:
    """0 to 999, by arithmetic on the key."""
    return F.pmod(key * 7919 + 13, F.lit(1000))


EDIT_SQL = "((({key} * 7919 + 13) % 1000) + 1000) % 1000"
#: Keys of created objects lie this far above those they are made from.
CREATED = 1_000_000_000


def edited_parts(parts: DataFrame) -> DataFrame:
    """The right side: of 1000 parts 50 deleted, 100 renamed, 20 of another type, 30 copied as new ones."""
    m = edit_class(F.col("p_partkey"))
    kept = parts.filter(m >= 50)
    name = F.when(m.between(50, 149), F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name"))
    kind = F.when(m.between(150, 169), F.lit("MOVED")).otherwise(F.col("p_type"))
    changed = kept.withColumn("p_name", name).withColumn("p_type", kind)
    created = parts.filter(m.between(170, 199)).withColumn("p_partkey", F.col("p_partkey") + CREATED)
    return changed.unionByName(created.withColumn("p_name", F.reverse("p_name")))
