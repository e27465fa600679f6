import re

import pytest
from pyspark.sql import functions as F

from twinweave.sources import models

ECORE = """<?xml version="1.0" encoding="ISO-8859-1"?>
<ecore:EPackage xmi:version="2.0" xmlns:xmi="http://www.omg.org/XMI" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"
    xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" name="shop" nsURI="http://shop" nsPrefix="s">
  <eAnnotations source="doc"><details key="k" value="caf\xe9"/><references>text only</references></eAnnotations>
  <eClassifiers xsi:type="ecore:EClass" name="Order" eSuperTypes="#//Base other.ecore#//Far #//Gone">
    <eOperations name="total" eType="#//Money"><eParameters name="in" eType="#//sub/Deep"/></eOperations>
    <eOperations name="total"><eParameters name="x" eType="//@eClassifiers.0/total.1"/></eOperations>
    <eStructuralFeatures xsi:type="ecore:EReference" name="items" upperBound="-1" containment="true" eType="#//Item" eOpposite="//Item/order"/>
    <eStructuralFeatures xsi:type="ecore:EAttribute" name="n" derived="true">
      <eType xsi:type="ecore:EDataType" href="http://www.eclipse.org/emf/2002/Ecore#//EInt"/>
    </eStructuralFeatures>
  </eClassifiers>
  <eClassifiers xsi:type="ecore:EClass" name="Item">
    <eStructuralFeatures xsi:type="ecore:EReference" name="order" eType="#/0/Order" eOpposite="#//@eClassifiers.0/@eStructuralFeatures.0"/>
    <eStructuralFeatures name="label" eType="ecore:EDataType platform:/x/other.ecore#//Far"/>
  </eClassifiers>
  <eClassifiers xsi:type="ecore:EClass" name="Base"/>
  <eClassifiers xsi:type="ecore:EDataType" name="Money" instanceClassName="java.math.BigDecimal"/>
  <eClassifiers xsi:type="ecore:EEnum" name="a b/c"><eLiterals name="X"/></eClassifiers>
  <eSubpackages name="sub">
    <eClassifiers xsi:type="ecore:EClass" name="Deep" eSuperTypes="#//a%20b%2Fc"><eGenericSuperTypes eClassifier="//Base"><eTypeArguments/></eGenericSuperTypes></eClassifiers>
  </eSubpackages>
</ecore:EPackage>"""
OTHER = '<EPackage name="other"><eClassifiers name="Far"/></EPackage>'
UML = """<?xml version="1.0" encoding="UTF-8"?>
<xmi:XMI xmlns:xmi="http://www.omg.org/spec/XMI/20131001" xmlns:uml="http://www.eclipse.org/uml2/5.0.0/UML">
  <uml:Model xmi:id="m" name="M">
    <packagedElement xmi:type="uml:Class" xmi:id="c1" name="C"><ownedAttribute xmi:id="p1" name="p" type="c2"><lowerValue xmi:type="uml:LiteralInteger" xmi:id="l1"/></ownedAttribute>
      <generalization xmi:id="g1" general="c2"/><ownedOperation xmi:id="o1" name="f"><ownedParameter xmi:id="q1"><type xmi:idref="c1"/></ownedParameter></ownedOperation></packagedElement>
    <packagedElement xmi:id="c2" name="D"/>
    <packagedElement xmi:type="uml:Association" xmi:id="a1" memberEnd="p1 e1 gone"><ownedEnd xmi:id="e1" type="c1"/></packagedElement>
  </uml:Model>
  <uml:Profile xmi:id="second" name="P"/>
</xmi:XMI>"""


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def ecore(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    (folder / "shop.ecore").write_bytes(ECORE.encode("latin-1"))
    (folder / "other.ecore").write_text(OTHER)
    return models.load(spark, str(folder))


def names(model):
    """Of each reference the owner's name, the feature and the target's name or the proxy's text."""
    own = model.objects.select("file", "node", F.coalesce("name", "type").alias("name"))
    target = own.select(F.col("file").alias("target_file"), F.col("node").alias("target_node"), F.col("name").alias("target"))
    return rows_of(model.references.join(own, ["file", "node"]).join(target, ["target_file", "target_node"], "left"), "name", "feature", "ord", F.coalesce("target", F.concat(F.lit("? "), "uri")))


def test_objects(ecore):
    kinds = {tuple(r) for r in rows_of(ecore.objects.filter("file LIKE '%shop.ecore'").groupBy("feature", "type").count(), "feature", "type", "count")}
    assert kinds == {
        (None, "EPackage", 1), ("eAnnotations", "EAnnotation", 1), ("details", "EStringToStringMapEntry", 1), ("eClassifiers", "EClass", 4), ("eClassifiers", "EDataType", 1),
        ("eClassifiers", "EEnum", 1), ("eLiterals", "EEnumLiteral", 1), ("eOperations", "EOperation", 2), ("eParameters", "EParameter", 2), ("eStructuralFeatures", "EReference", 2),
        ("eStructuralFeatures", "EAttribute", 2), ("eSubpackages", "EPackage", 1), ("eGenericSuperTypes", "EGenericType", 1), ("eTypeArguments", "EGenericType", 1),
    }
    values = {r.value for r in ecore.attributes.collect()}
    assert "caf\xe9" in values and "text only" in values and "java.math.BigDecimal" in values
    parents = {(r.name, r.ord) for r in ecore.objects.filter("feature = 'eClassifiers' AND file LIKE '%shop%'").collect()}
    assert {("Order", 0), ("Item", 1), ("a b/c", 4), ("Deep", 0)} <= parents


def test_references(ecore):
    assert names(ecore) == sorted([
        ("Order", "eSuperTypes", 0, "Base"), ("Order", "eSuperTypes", 1, "Far"), ("Order", "eSuperTypes", 2, "? #//Gone"), ("total", "eType", 0, "Money"),
        ("in", "eType", 0, "Deep"), ("x", "eType", 0, "total"), ("items", "eType", 0, "Item"), ("items", "eOpposite", 0, "order"),
        ("n", "eType", 0, "? http://www.eclipse.org/emf/2002/Ecore#//EInt"), ("order", "eType", 0, "Order"), ("order", "eOpposite", 0, "items"),
        ("label", "eType", 0, "Far"), ("Deep", "eSuperTypes", 0, "a b/c"), ("EGenericType", "eClassifier", 0, "Base"),
    ], key=str)
    targets = ecore.objects.select(F.col("file").alias("target_file"), F.col("node").alias("target_node"), F.col("ord").alias("place"))
    twice = ecore.references.filter("uri = '//@eClassifiers.0/total.1'").join(targets, ["target_file", "target_node"])
    assert [r.place for r in twice.collect()] == [1]


def test_features(ecore):
    found = {(r.type, r.feature): r for r in models.feature_rows(ecore).collect()}
    items, order, n = found["Order", "items"], found["Item", "order"], found["Order", "n"]
    assert items.many and items.containment and items.reference and items.value == "Item" and not items.container
    assert order.container and not order.containment and not order.many
    assert n.value == "number" and n.derived and not n.reference and found["Item", "label"].value == "other"


def test_uml(spark, tmp_path):
    (tmp_path / "m.uml").write_text(UML)
    model = models.load(spark, str(tmp_path / "m.uml"))
    types = {(r.xmi_id, r.type, r.parent is None) for r in model.objects.collect()}
    assert types == {
        ("m", "Model", True), ("second", "Profile", True), ("c1", "Class", False), ("c2", "Class", False), ("p1", "Property", False), ("l1", "LiteralInteger", False),
        ("g1", "Generalization", False), ("o1", "Operation", False), ("q1", "Parameter", False), ("a1", "Association", False), ("e1", "Property", False),
    }
    assert names(model) == sorted([
        ("p", "type", 0, "D"), ("Generalization", "general", 0, "D"), ("Parameter", "type", 0, "C"), ("Association", "memberEnd", 0, "p"),
        ("Association", "memberEnd", 1, "Property"), ("Association", "memberEnd", 2, "? gone"), ("Property", "type", 0, "C"),
    ], key=str)


def test_no_files_and_bad_files(spark, tmp_path):
    none = spark.createDataFrame([], "file string, value string")
    model = models.loaded(none)
    assert model.objects.count() == model.attributes.count() == model.references.count() == 0
    with pytest.raises(Exception, match="b.ecore is no XML"):
        models.loaded(spark.createDataFrame([("b.ecore", "<a><b></a>")], "file string, value string"))


def test_fragments(spark):
    row = spark.createDataFrame([("a b'c/é\t%x", None, ["p", "q,"], 3)], "v string, none string, many array<string>, ord int")
    text = "a%20b%27c%2Fé%09%25x"
    shown = row.select(
        models.escaped(F.col("v")), models.unescaped(models.escaped(F.col("v"))), models.keyed_fragment(F.lit("f"), [("k", F.col("v")), ("n", F.col("none")), ("m[]", F.col("many"))]),
        models.fragment(F.lit("f"), F.col("ord"), F.lit(True)), models.fragment(F.lit("f"), F.col("ord"), F.lit(False)), models.unescaped(F.lit("100%+")),
    ).first()
    assert tuple(shown) == (text, row.first().v, f"@f[k='{text}',n=null,m=['p','q%2C']]", "@f.3", "@f", "100%+")
    every = [chr(k) for k in range(1, 128)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in every], "c string").select(models.escaped(F.col("c"))).collect()]
    want = ["".join(f"%{ord(c):02X}" if ord(c) <= 32 or c in "\"#%&',/:<>" else c) for c in every]
    assert got == want


def test_deep_paths(spark):
    inner = "".join(f'<eSubpackages name="p{k}">' for k in range(30))
    path = "#/" + "".join(f"/p{k}" for k in range(30)) + "/T"
    text = f'<EPackage name="r">{inner}<eClassifiers name="T" eSuperTypes="{path}"/>{"</eSubpackages>" * 30}</EPackage>'
    model = models.loaded(spark.createDataFrame([("f", text)], "file string, value string"))
    (r,) = model.references.collect()
    assert r.target_node == r.node and len(re.findall("/p", r.uri)) == 30
