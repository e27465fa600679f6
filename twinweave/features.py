"""The feature table of the object graph, and the object hashes that its rows define.

A feature is an attribute (a string, number or boolean) or a reference (to the container, to contained
objects, or across) of a type. Which features count, by which hash and with which weights, are columns of
the table; the hasher of a type is one projection that is built from its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave import model
from twinweave.functions import kernels as K
from twinweave.operators.votes import voted


@dataclass(frozen=True)
class Feature:
    """value: string, number, boolean or other for attributes; for references the other side's type."""

    type: str
    name: str
    value: str
    reference: bool = False
    many: bool = False
    containment: bool = False
    container: bool = False
    derived: bool = False
    transient: bool = False
    changeable: bool = True


def _attributes(type_: str, **values: str) -> list[Feature]:
    return [Feature(type_, name, value) for name, value in values.items()]


#: What the graph's types have. Dates are no kind of value that is hashed.
FEATURES = (
    *_attributes("region", r_name="string"),
    Feature("region", "nations", "nation", reference=True, many=True, containment=True),
    *_attributes("nation", n_name="string"),
    Feature("nation", "region", "region", reference=True, container=True),
    Feature("nation", "customers", "customer", reference=True, many=True, containment=True),
    Feature("nation", "suppliers", "supplier", reference=True, many=True, containment=True),
    *_attributes("customer", c_name="string", c_acctbal="number", c_mktsegment="string"),
    Feature("customer", "nation", "nation", reference=True, container=True),
    Feature("customer", "orders", "orders", reference=True, many=True, containment=True),
    *_attributes("supplier", s_name="string", s_acctbal="number"),
    Feature("supplier", "nation", "nation", reference=True, container=True),
    *_attributes("part", p_name="string", p_brand="string", p_type="string", p_size="number", p_retailprice="number"),
    *_attributes("orders", o_orderstatus="string", o_totalprice="number", o_orderdate="other", o_orderpriority="string"),
    Feature("orders", "customer", "customer", reference=True, container=True),
    Feature("orders", "lineitems", "lineitem", reference=True, many=True, containment=True),
    *_attributes("lineitem", l_quantity="number", l_extendedprice="number", l_discount="number", l_tax="number",
                 l_returnflag="string", l_linestatus="string", l_shipdate="other"),
    Feature("lineitem", "orders", "orders", reference=True, container=True),
    Feature("lineitem", "part", "part", reference=True),
    Feature("lineitem", "supplier", "supplier", reference=True),
)
#: Numbers that are whole; all others are doubles.
WHOLE = {"p_size"}
#: A feature by which objects of its type are told apart most of all.
NAMES = {"r_name", "n_name", "c_name", "s_name", "p_name"}
#: How much each feature says in the distance of two objects; names most.
SIGNIFICANT, USUAL, SMALL = 50, 10, 5
#: What an object's place in its container says, by the same measure.
PARENT = 10
KINDS = ("default", "weighted", "structural")


def hashable(f: Feature) -> bool:
    """Neither derived nor transient nor the reference to the container."""
    return not (f.derived or f.transient or f.container)


def one_hot(f: Feature) -> bool:
    """As hashable, without contained objects and annotations."""
    return hashable(f) and not f.containment and f.name != "eAnnotations"


def mutable(f: Feature) -> bool:
    """What an edit of a single object may change."""
    return hashable(f) and f.changeable and not f.containment


def hasher(f: Feature) -> str | None:
    """By kind of value and number: which hash a feature's values have; None for values that aren't hashed."""
    if f.reference:
        return "locations" if f.many else "location"
    if f.value == "string":
        return "strings" if f.many else "string"
    if f.value in ("number", "boolean"):
        return f"{f.value}s" if f.many else f.value
    return None


def distance_weight(f: Feature) -> int:
    return SIGNIFICANT if f.name in NAMES else SMALL if f.reference else USUAL


def weights(f: Feature, kind: str) -> tuple[int, int]:
    """(for, against) in a kind of table; container references are weighted as the pseudo feature of an object's place."""
    if kind == "weighted":
        return (0 if f.container else min(100, distance_weight(f) // SMALL), 0)
    if not f.reference:
        return (0, 0) if kind == "structural" else (50, 10) if f.name in NAMES else (10, 2)
    if f.container:
        return (5, 1) if kind == "structural" else (0, 0)
    if f.containment:
        return (10, 2) if kind == "structural" else (1, 1)
    return (5, 1)


def container_ratio(type_: str) -> float:
    """By how much more alike objects of unlike containers must be: the place's share of all that a type's distance weighs."""
    own = [f for f in FEATURES if f.type == type_ and not f.container]
    return PARENT / (sum(map(distance_weight, own)) + PARENT)


def feature_table(spark: SparkSession) -> DataFrame:
    """A row for each feature: flags, hash and weights."""
    rows = [
        (f.type, f.name, f.value, f.reference, f.many, f.containment, f.container, hashable(f), one_hot(f), mutable(f), hasher(f),
         *[w for kind in KINDS for w in weights(f, kind)])
        for f in FEATURES
    ]
    cells = ", ".join(f"{kind}_{sign} int" for kind in KINDS for sign in ("pos", "neg"))
    return spark.createDataFrame(
        rows, "type string, feature string, value string, reference boolean, many boolean, containment boolean, container boolean, "
        f"hashable boolean, one_hot boolean, mutable boolean, hasher string, {cells}",
    )


def hashed(f: Feature) -> Column:
    """The code of an attribute's column: strings by their byte pairs, a single other value by its name and hash."""
    value = F.col(f.name)
    if f.value == "string":
        return K.string_code(value)
    if f.value == "boolean":
        position = K.boolean_position(value)
    else:  # doubles by their bits, which with_double_bits has added
        position = K.long_position(value if f.name in WHOLE else F.col(f"_bits_{f.name}"))
    return F.when(value.isNotNull(), K.salted(f.name, position))


def used(type_: str, kind: str) -> list[tuple[Feature, int, int]]:
    """The features of a type that have a hash and a weight."""
    own = [(f, *weights(f, kind)) for f in FEATURES if f.type == type_ and hasher(f) and (hashable(f) or f.container)]
    return [x for x in own if x[1] or x[2]]


def object_codes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(type, key, code) of all objects; kind is one of KINDS. Line items have no key of their own and are
    counted by their values: their key is that of their order."""
    levels = model.levels(spark, sf_dir)
    below = model.places_below(spark, sf_dir, levels)
    out = None
    for type_, (name, key, up) in model.TYPES.items():
        features = used(type_, kind)
        columns = [f.name for f, _, _ in features if not f.reference]
        links = {f.value: model.REFERENCES[type_, f.name] for f, _, _ in features if f.reference and not (f.many or f.container)}
        rows = model.table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), *columns, *links.values())
        rows = K.with_double_bits(rows, [f.name for f, _, _ in features if f.value == "number" and f.name not in WHOLE])
        votes = []
        for f, p, q in features:
            code = f"_code_{f.name}"
            if f.container:
                if type_ == "lineitem":
                    place = levels["orders"].select("key", F.col("code").alias(code))
                else:
                    place = levels[type_].select("key", F.col("above_code").alias(code))
                rows = rows.join(place, "key", "left")
            elif f.many:
                rows = rows.join(below[f.name].select(F.col("up").alias("key"), F.col("code").alias(code)), "key", "left")
            elif f.reference:
                if f.value == "part":  # a root, as every part
                    rows = rows.withColumn(code, F.when(F.col(links["part"]).isNotNull(), K.onehot(F.lit(K.name_position("0")))))
                else:
                    other = levels[f.value].select(F.col("key").alias(links[f.value]), F.col("code").alias(code))
                    rows = rows.join(other, links[f.value], "left")
            else:
                if f.value == "string":  # many objects share a value: it is hashed once
                    codes = rows.select(f.name).distinct().withColumn(code, hashed(f))
                    rows = rows.join(codes.withColumnRenamed(f.name, "_value"), F.col(f.name).eqNullSafe(F.col("_value"))).drop("_value")
                else:
                    rows = rows.withColumn(code, hashed(f))
                if p > 50:
                    rows = rows.withColumn(code, K.strengthened(F.col(code)))
            votes.append((code, p, q))
        coded = voted(rows, votes, "code") if votes else rows.withColumn("code", F.lit(0).cast("long"))
        own = coded.select(F.lit(type_).alias("type"), "key", "code")
        out = own if out is None else out.unionByName(own)
    return out
