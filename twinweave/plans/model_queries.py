"""Queries over XML models: written from the given tables, read back by the loader."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.model import table
from twinweave.sources import models
from twinweave.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Order keys in one model file.
FILE_KEYS = 1000


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def write_models(spark: SparkSession, sf_dir: str) -> str:
    """A model for every FILE_KEYS order keys: a class for each of their customers, with its orders as references.

    A class names as its supertype the one at half its place, and its nation, which lies in a file that
    isn't there; an order's type is its customer's class by name, and its opposite the class's first order.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / FILE_KEYS).cast("long").alias("model"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus"
    )
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    path = models.escaped(F.col("c_name"))
    feature = F.format_string(
        '<eStructuralFeatures xsi:type="ecore:EReference" name="o%d"%s%s eType="#//%s" eOpposite="//%s/@eStructuralFeatures.0"/>',
        "key", F.when(F.col("o_orderstatus") == "O", ' upperBound="-1"').otherwise(""), F.when(F.col("o_orderstatus") == "F", ' containment="true"').otherwise(""), path, path,
    )
    # a file has at most FILE_KEYS orders, and so has a class
    classes = orders.join(people, "c_custkey").groupBy("model", "c_custkey", "c_name", "n_name").agg(F.sort_array(F.collect_list(F.struct("key", feature.alias("xml")))).alias("own"))
    place = F.row_number().over(Window.partitionBy("model").orderBy("c_custkey")) - 1
    nation = F.concat(F.lit("nations.ecore#//"), models.escaped(F.col("n_name")))
    above = F.when(F.col("place") > 0, F.concat(F.lit("#//@eClassifiers."), F.floor((F.col("place") - 1) / 2).cast("string"), F.lit(" "))).otherwise(F.lit(""))
    one = F.concat(
        F.lit('<eClassifiers xsi:type="ecore:EClass" name="'), "c_name", F.lit('" eSuperTypes="'), above, F.lit("ecore:EClass "), nation, F.lit('">'),
        F.array_join(F.col("own.xml"), ""), F.lit("</eClassifiers>"),
    )
    whole = classes.withColumn("place", place).select("model", "place", one.alias("xml")).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("place", "xml"))).alias("own"))
    text = F.concat(
        F.lit('<ecore:EPackage xmi:version="2.0" xmlns:xmi="http://www.omg.org/XMI" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" name="m'),
        F.col("model").cast("string"), F.lit('">'), F.array_join(F.col("own.xml"), ""), F.lit("</ecore:EPackage>"),
    )
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    whole.select("model", text.alias("value")).repartition("model").write.partitionBy("model").text(folder)
    return folder


def written_models(spark: SparkSession, sf_dir: str) -> models.Model:
    rows = spark.read.text(write_models(spark, sf_dir), wholetext=True)
    return models.loaded(rows.select(F.concat(F.lit("m"), F.col("model").cast("string")).alias("file"), "value"))


_SQL = f"""
o AS (SELECT o_orderkey // {FILE_KEYS} AS model, o_orderkey AS key, o_custkey, o_orderstatus, c_name, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY o_custkey) - 1 AS place FROM (SELECT DISTINCT model, o_custkey, c_name, n_name FROM o)),
c AS (SELECT p.*, q.c_name AS before FROM p LEFT JOIN p q ON q.model = p.model AND p.place > 0 AND q.place = (p.place - 1) // 2),
f AS (SELECT *, row_number() OVER (PARTITION BY model, o_custkey ORDER BY key) - 1 AS place, first_value(key) OVER (PARTITION BY model, o_custkey ORDER BY key) AS first_key FROM o)
"""


@query(f"""WITH {_SQL}
SELECT 'm' || model AS file, 'EPackage' AS type, 'm' || model AS name, NULL AS parent, NULL AS feature, 0 AS ord FROM (SELECT DISTINCT model FROM o)
UNION ALL SELECT 'm' || model, 'EClass', c_name, 'm' || model, 'eClassifiers', place::INT FROM c
UNION ALL SELECT 'm' || model, 'EReference', 'o' || key, c_name, 'eStructuralFeatures', place::INT FROM f""")
def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of the models with their types and places."""
    found = written_models(spark, sf_dir).objects
    parents = found.select("file", F.col("node").alias("parent"), F.col("name").alias("parent_name"))
    return found.join(parents, ["file", "parent"], "left").select("file", "type", "name", F.col("parent_name").alias("parent"), "feature", "ord")


@query(f"""WITH {_SQL}
SELECT 'm' || model AS file, c_name AS name, 'eSuperTypes' AS feature, 0 AS ord, before AS target, '#//@eClassifiers.' || ((place - 1) // 2) AS uri FROM c WHERE before IS NOT NULL
UNION ALL SELECT 'm' || model, c_name, 'eSuperTypes', (before IS NOT NULL)::INT, NULL, 'nations.ecore#//' || replace(n_name, ' ', '%20') FROM c
UNION ALL SELECT 'm' || model, 'o' || key, 'eType', 0, c_name, '#//' || replace(c_name, '#', '%23') FROM f
UNION ALL SELECT 'm' || model, 'o' || key, 'eOpposite', 0, 'o' || first_key, '//' || replace(c_name, '#', '%23') || '/@eStructuralFeatures.0' FROM f""")
def model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference with the name of what it leads to; none for proxies."""
    found = written_models(spark, sf_dir)
    own = found.objects.select("file", "node", "name")
    targets = found.objects.select(F.col("file").alias("target_file"), F.col("node").alias("target_node"), F.col("name").alias("target"))
    return found.references.join(own, ["file", "node"]).join(targets, ["target_file", "target_node"], "left").select("file", "name", "feature", "ord", "target", "uri")


@query(f"""WITH {_SQL}
SELECT 'm' || model AS file, c_name AS type, 'o' || key AS feature, c_name AS value, o_orderstatus = 'O' AS many, o_orderstatus = 'F' AS containment,
  first_status = 'F' AS container
FROM (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY model, o_custkey ORDER BY key) AS first_status FROM f)""")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table that the models' classes declare."""
    found = models.feature_rows(written_models(spark, sf_dir))
    return found.select("file", "type", "feature", "value", "many", "containment", "container")
