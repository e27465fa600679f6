"""XML models as tables: objects in their containment tree, attribute values, references.

A file's elements become rows (its node number, its parent's, the containing feature, the place there, the attributes);
everything else is joins over these rows: types, places, fragments, and the targets of references. A reference is
followed a segment at a time from the root of its file, all references at once, so a path of any depth and any mixture of
``@feature.index``, ``@feature`` and names is found. What isn't found, or lies in a file that wasn't loaded, keeps
its text as a proxy.

What a metamodel calls a reference and what it contains are data (Metamodel); the two below are those of
the files that this reads by suffix. An element whose type isn't named has its feature's.

Defined cases: an empty folder gives empty tables; a file that is no XML is an error that names the file; several roots
(an xmi:XMI element around them) are numbered in order; of siblings with one name the first has it as its segment, the
k-th one after it the name and ``.k``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.storage import written

ELEMENT = "file string, node int, parent int, feature string, attributes map<string,string>, text string, leaf boolean"


@dataclass(frozen=True)
class Metamodel:
    """contained: the type of a feature's elements that name none; single: contained features that hold one object;
    references and lists: features that refer to one and to several objects; others are attributes."""

    contained: dict[str, str] = field(default_factory=dict)
    single: frozenset[str] = frozenset()
    references: frozenset[str] = frozenset()
    lists: frozenset[str] = frozenset()


#: Names of the two metamodels.
ECORE = Metamodel(
    contained={
        "eAnnotations": "EAnnotation", "details": "EStringToStringMapEntry", "eClassifiers": "EClass", "eSubpackages": "EPackage",
        "eStructuralFeatures": "EAttribute", "eOperations": "EOperation", "eParameters": "EParameter", "eLiterals": "EEnumLiteral",
        "eTypeParameters": "ETypeParameter", "eGenericType": "EGenericType", "eGenericSuperTypes": "EGenericType",
        "eGenericExceptions": "EGenericType", "eTypeArguments": "EGenericType", "eBounds": "EGenericType",
        "eLowerBound": "EGenericType", "eUpperBound": "EGenericType",
    },
    single=frozenset({"eGenericType", "eLowerBound", "eUpperBound"}),
    references=frozenset({"eType", "eOpposite", "eClassifier", "eTypeParameter"}),
    lists=frozenset({"eSuperTypes", "eExceptions", "eKeys", "references"}),
)
UML = Metamodel(
    contained={
        "packagedElement": "Class", "nestedClassifier": "Class", "ownedAttribute": "Property", "ownedEnd": "Property",
        "ownedOperation": "Operation", "ownedParameter": "Parameter", "ownedLiteral": "EnumerationLiteral",
        "generalization": "Generalization", "interfaceRealization": "InterfaceRealization", "ownedComment": "Comment",
        "ownedRule": "Constraint", "ownedBehavior": "Activity", "packageImport": "PackageImport", "elementImport": "ElementImport",
        "packageMerge": "PackageMerge", "profileApplication": "ProfileApplication", "slot": "Slot", "value": "LiteralString",
        "specification": "LiteralString", "lowerValue": "LiteralInteger", "upperValue": "LiteralUnlimitedNatural",
        "defaultValue": "LiteralString", "lifeline": "Lifeline", "message": "Message", "fragment": "MessageOccurrenceSpecification",
        "generalOrdering": "GeneralOrdering", "region": "Region", "subvertex": "State", "transition": "Transition",
        "node": "OpaqueAction", "edge": "ControlFlow", "guard": "LiteralBoolean", "weight": "LiteralInteger", "include": "Include",
        "extend": "Extend", "extensionPoint": "ExtensionPoint", "eAnnotations": "EAnnotation", "details": "EStringToStringMapEntry",
    },
    single=frozenset({"lowerValue", "upperValue", "defaultValue", "specification", "guard", "weight"}),
    references=frozenset({
        "type", "general", "association", "definingFeature", "importedPackage", "importedElement", "mergedPackage", "appliedProfile",
        "represents", "sendEvent", "receiveEvent", "start", "finish", "before", "after", "message", "signature", "source", "target",
        "addition", "extendedCase", "contract", "instance", "interaction", "behavior", "opposite",
    }),
    lists=frozenset({
        "memberEnd", "navigableOwnedEnd", "client", "supplier", "annotatedElement", "constrainedElement", "classifier", "covered",
        "coveredBy", "incoming", "outgoing", "subsettedProperty", "redefinedProperty", "redefinedOperation", "raisedException",
        "extensionLocation", "references",
    }),
)
_SPACES = {"http://www.w3.org/2001/XMLSchema-instance": "xsi", "http://www.omg.org/XMI": "xmi"}


def _short(name: str) -> str:
    """A qualified name with the usual prefix; names of other spaces lose theirs."""
    space, _, own = name[1:].rpartition("}") if name[0] == "{" else ("", "", name)
    prefix = _SPACES.get(space) or ("xmi" if "/spec/XMI/" in space else "")
    return f"{prefix}:{own}" if prefix else own


def elements(files: DataFrame) -> DataFrame:
    """From (file, value), whole texts or their bytes: a row for each element, in the order of their start tags. leaf: it holds no other."""

    def of(file: str, text: str | bytes) -> Iterator[tuple]:
        parser = ElementTree.XMLPullParser(("start", "end"))
        try:
            parser.feed(text)
            parser.close()
            open_, n, rows = [], 0, {}
            for event, element in parser.read_events():
                if event == "start":
                    rows[n] = True
                    if open_:
                        rows[open_[-1]] = False
                    open_.append(n)
                    n += 1
                else:
                    node, attributes = open_.pop(), {_short(k): v for k, v in element.attrib.items()}
                    parent = open_[-1] if open_ else None
                    yield file, node, parent, _short(element.tag), attributes, (element.text or "").strip() or None, rows.pop(node)
                    element.clear()
        except ElementTree.ParseError as error:
            raise ValueError(f"{file} is no XML: {error}") from error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, text in zip(frame.file, frame.value, strict=True):
                rows = pd.DataFrame(list(of(file, text)), columns=[x.split()[0] for x in ELEMENT.split(", ")])
                yield rows.astype({"parent": "Int32"})

    return files.select("file", "value").mapInPandas(run, ELEMENT)


#: What a value within a fragment has as percent signs and two digits, besides spaces and control characters.
ESCAPED = "\"#%&',/:<>"


def escaped(value: Column) -> Column:
    """A value as it stands within a fragment."""
    one = lambda c: F.when((F.ascii(c) <= 32) | F.lit(ESCAPED).contains(c), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c == "", c).otherwise(one(c))), "")


def unescaped(segment: Column) -> Column:
    """A path's segment as the name it stands for; what is no valid escape stays."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def fragment(feature: Column, ord_: Column, many: Column) -> Column:
    """``@feature`` of a single contained object, ``@feature.index`` of one among many."""
    return F.concat(F.lit("@"), feature, F.when(many, F.concat(F.lit("."), ord_.cast("string"))).otherwise(F.lit("")))


def keyed_fragment(feature: Column, keys: list[tuple[str, Column]]) -> Column:
    """``@feature[key='value',...]`` of an object that its container tells by keys; a key of several values has them in brackets."""

    def shown(value: Column, several: bool) -> Column:
        quoted = lambda v: F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit("'"), escaped(v), F.lit("'")))
        if several:
            return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(value, F.array().cast("array<string>")), quoted), ","), F.lit("]"))
        return quoted(value.cast("string"))

    parts = []
    for name, value in keys:
        name, several = (name[:-2], True) if name.endswith("[]") else (name, False)
        parts.append(F.concat(F.lit(f"{name}="), shown(value, several)))
    return F.concat(F.lit("@"), feature, F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _known(metamodel: Metamodel, names: frozenset[str] | set[str]) -> Column:
    return F.col("feature").isin(*sorted(names)) if names else F.lit(False)


@dataclass(frozen=True)
class Model:
    """objects (file, node, parent, feature, ord, many, type, name, xmi_id); attributes (file, node, feature, ord, value);
    references (file, node, feature, ord, uri, target_file, target_node), the last two null for proxies."""

    objects: DataFrame
    attributes: DataFrame
    references: DataFrame


def loaded(files: DataFrame, metamodel: Metamodel = ECORE) -> Model:
    """The model in files (file, value)."""
    rows = elements(files)
    wrapper = F.col("feature") == "xmi:XMI"
    type_ = F.coalesce(F.col("attributes")["xsi:type"], F.col("attributes")["xmi:type"])
    refers = F.col("attributes")["href"].isNotNull() | F.col("attributes")["xmi:idref"].isNotNull()
    plain = F.col("leaf") & (F.size("attributes") == 0) & ~_known(metamodel, metamodel.contained.keys())
    default = F.create_map(*[F.lit(x) for pair in metamodel.contained.items() for x in pair])[F.col("feature")]
    root = F.col("parent").isNull() | F.col("below_wrapper")
    marked = (
        rows.withColumn("below_wrapper", (F.col("parent") == 0) & F.max(wrapper & (F.col("node") == 0)).over(Window.partitionBy("file")))
        .filter(~wrapper)
        .withColumn("kind", F.when(root, "object").when(refers, "reference").when(plain, "value").otherwise("object"))
        .withColumn("type", F.regexp_extract(F.when(root, F.coalesce(type_, "feature")).otherwise(F.coalesce(type_, default, "feature")), "([^:]*)$", 1))
        .withColumn("parent", F.when(~root, F.col("parent")))
        .withColumn("feature", F.when(~root, F.col("feature")))
    )
    # places within a file: an element's siblings are in its file, which was one text
    place = F.row_number().over(Window.partitionBy("file", "parent", "feature", "kind").orderBy("node")) - 1
    made = written(marked.withColumn("ord", place), "elements")
    found = made.filter("kind = 'object'")
    objects = found.select(
        "file", "node", "parent", "feature", "ord", (F.col("feature").isNotNull() & ~_known(metamodel, metamodel.single)).alias("many"), "type",
        F.col("attributes")["name"].alias("name"), F.col("attributes")["xmi:id"].alias("xmi_id"),
    )
    cells = found.select("file", "node", F.explode("attributes").alias("feature", "value")).filter(~F.col("feature").contains(":") & (F.col("feature") != "schemaLocation"))
    several = metamodel.references | metamodel.lists
    single = cells.filter(~_known(metamodel, several)).select("file", "node", "feature", F.lit(0).alias("ord"), "value")
    listed = made.filter("kind = 'value'").select("file", F.col("parent").alias("node"), "feature", "ord", F.coalesce("text", F.lit("")).alias("value"))
    # a list of paths may name the type of a target in another file before its path
    tokens = F.filter(F.split("value", r"\s+"), lambda x: (x != "") & ~x.rlike("^[A-Za-z]+:[A-Za-z]+$"))
    inline = cells.filter(_known(metamodel, several)).select("file", "node", "feature", F.posexplode(tokens).alias("ord", "uri"))
    outside = made.filter("kind = 'reference'").select(
        "file", F.col("parent").alias("node"), "feature", "ord", F.coalesce(F.col("attributes")["href"], F.col("attributes")["xmi:idref"]).alias("uri")
    )
    return Model(objects, single.unionByName(listed), resolved(objects, inline.unionByName(outside)))


def segments(objects: DataFrame) -> DataFrame:
    """(file, parent, segment, node): all that a path may call an object within its container; roots by their place."""
    named = objects.filter(F.col("name").isNotNull() & F.col("parent").isNotNull())
    same = F.row_number().over(Window.partitionBy("file", "parent", "name").orderBy("node")) - 1
    by_name = named.select("file", "parent", F.concat("name", F.when(same > 0, F.concat(F.lit("."), same.cast("string"))).otherwise(F.lit(""))).alias("segment"), "node")
    below = objects.filter(F.col("parent").isNotNull())
    by_place = below.select("file", "parent", fragment(F.col("feature"), F.col("ord"), F.col("many")).alias("segment"), "node")
    tops = objects.filter(F.col("parent").isNull())
    place = F.row_number().over(Window.partitionBy("file").orderBy("node")) - 1
    roots = tops.select("file", F.lit(-1).alias("parent"), place.cast("string").alias("segment"), "node")
    # a name may look like a place; the place comes first
    every = by_place.withColumn("rank", F.lit(0)).unionByName(by_name.withColumn("rank", F.lit(1))).unionByName(roots.withColumn("rank", F.lit(0)))
    return every.groupBy("file", "parent", "segment").agg(F.min(F.struct("rank", "node")).alias("first")).select("file", "parent", "segment", "first.node")


def resolved(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Adds target_file and target_node to (file, node, feature, ord, uri)."""
    keys = ["file", "node", "feature", "ord"]
    last = lambda c: F.element_at(F.split(c, "[/\\\\]"), -1)
    document = F.when(F.instr("uri", "#") > 0, F.substring_index("uri", "#", 1)).otherwise(F.lit(""))
    path = F.when(F.instr("uri", "#") > 0, F.expr("substring(uri, instr(uri, '#') + 1)")).otherwise(F.col("uri"))
    asked = written(references.withColumn("document", document).withColumn("path", path), "references")
    files = objects.select("file").distinct().select(F.col("file").alias("other"), last(F.col("file")).alias("base"))
    # of files with one name the first by its whole path
    bases = files.groupBy("base").agg(F.min("other").alias("other"))
    inside = asked.filter("document = ''").withColumn("in_file", F.col("file"))
    across = asked.filter("document <> ''").withColumn("base", last(F.col("document"))).join(bases, "base").withColumnRenamed("other", "in_file").drop("base")
    both = inside.unionByName(across)
    ids = objects.filter(F.col("xmi_id").isNotNull()).groupBy(F.col("file").alias("in_file"), F.col("xmi_id").alias("path")).agg(F.min("node").alias("target_node"))
    by_id = both.filter(~F.col("path").startswith("/")).join(ids, ["in_file", "path"]).select(*keys, "in_file", "target_node")
    # "//a/b" and "/0/a/b" begin at the first root, "/1/a" at the second
    parts = F.transform(F.split(F.expr("substring(path, 2)"), "/"), unescaped)
    first = F.when(parts[0] == "", F.lit("0")).otherwise(parts[0])
    steps = F.filter(F.concat(F.array(first), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), lambda x: x != "")
    open_ = written(both.filter(F.col("path").startswith("/")).select(*keys, "in_file", F.lit(-1).alias("at"), steps.alias("steps")), "paths")
    below = written(segments(objects), "segments").withColumnsRenamed({"file": "in_file", "parent": "at", "node": "next"})
    found = by_id
    # as many rounds as the longest path that leads somewhere has segments
    while not open_.isEmpty():
        step = open_.withColumn("segment", F.col("steps")[0]).join(below, ["in_file", "at", "segment"])
        moved = written(step.select(*keys, "in_file", F.col("next").alias("at"), F.expr("slice(steps, 2, size(steps))").alias("steps")), "paths")
        found = found.unionByName(moved.filter(F.size("steps") == 0).select(*keys, "in_file", F.col("at").alias("target_node")))
        open_ = moved.filter(F.size("steps") > 0)
    targets = found.select(*keys, F.col("in_file").alias("target_file"), "target_node")
    return asked.select(*keys, "uri").join(targets, keys, "left")


def load(spark: SparkSession, path: str, metamodel: Metamodel | None = None) -> Model:
    """A model file, or all of a folder by their suffix; .uml files have the UML metamodel unless another is given."""
    uml = path.endswith(".uml")
    # as bytes, whose encoding the file itself names
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("content").alias("value"))
    return loaded(rows, metamodel or (UML if uml else ECORE))


def feature_rows(model: Model) -> DataFrame:
    """The features that a model of classes declares, as data: (file, type, feature, value, reference, many, containment,
    container, derived, transient, changeable). An unset flag has its metamodel's default; value is what the type's
    name says (string, number, boolean, else other), for references the name of the other class; the end of a
    containment is its container."""
    owner = model.objects.filter("type = 'EClass'").select("file", F.col("node").alias("parent"), F.col("name").alias("type"))
    own = model.objects.filter("type IN ('EAttribute', 'EReference')").select("file", "node", "parent", F.col("name").alias("feature"), (F.col("type") == "EReference").alias("reference"))
    flags = model.attributes.groupBy("file", "node").agg(
        *[F.max(F.when(F.col("feature") == name, F.col("value"))).alias(name) for name in ("upperBound", "containment", "derived", "transient", "volatile", "changeable")]
    )
    first = lambda name: model.references.filter(F.col("feature") == name).select("file", "node", "uri", "target_file", "target_node")
    names = model.objects.select(F.col("file").alias("target_file"), F.col("node").alias("target_node"), F.col("name").alias("target"))
    types = first("eType").join(names, ["target_file", "target_node"], "left").select(
        "file", "node", F.coalesce("target", unescaped(F.regexp_extract("uri", "([^/#]*)$", 1))).alias("of")
    )
    held = flags.filter("containment = 'true'").select(F.col("file").alias("target_file"), F.col("node").alias("target_node"), F.lit(True).alias("container"))
    ends = first("eOpposite").select("file", "node", "target_file", "target_node").join(held, ["target_file", "target_node"]).select("file", "node", "container")
    kind = F.lower(F.regexp_replace("of", "^E(?=[A-Z])", ""))
    value = (
        F.when(F.col("reference"), F.col("of"))
        .when(kind.isin("string", "javalangstring"), "string")
        .when(kind.isin("boolean", "booleanobject"), "boolean")
        .when(kind.isin("int", "integer", "integerobject", "long", "longobject", "double", "doubleobject", "float", "short", "byte", "biginteger", "bigdecimal"), "number")
        .otherwise("other")
    )
    is_ = lambda name, default: F.coalesce(F.col(name) == "true", F.lit(default))
    rows = own.join(owner, ["file", "parent"]).join(flags, ["file", "node"], "left").join(types, ["file", "node"], "left").join(ends, ["file", "node"], "left")
    many = F.coalesce(F.col("upperBound").cast("int"), F.lit(1)) != 1
    return rows.select(
        "file", "type", "feature", value.alias("value"), "reference", many.alias("many"), is_("containment", False).alias("containment"),
        F.coalesce("container", F.lit(False)).alias("container"), is_("derived", False).alias("derived"), is_("transient", False).alias("transient"),
        (is_("changeable", True) & ~is_("volatile", False)).alias("changeable"),
    )
