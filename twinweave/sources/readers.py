"""Sources: threshold tables and evaluation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 0.5
#: Least similarity by type, for Ecore models and for UML models; DEFAULT_THRESHOLD for other types.
ECORE_THRESHOLDS = {
    "EPackage": 0.46,
    "EClass": 0.59,
    "EReference": 0.74,
    "EAttribute": 0.72,
    "EEnum": 0.52,
    "EEnumLiteral": 0.53,
    "EOperation": 0.61,
    "EParameter": 0.66,
    "EStringToStringMapEntry": 0.4,
}
UML_THRESHOLDS = {
    "EPackage": 0.15,
    "EClass": 0.55,
    "EReference": 0.65,
    "EOperation": 0.55,
    "EAttribute": 0.68,
    "EStringToStringMapEntry": 0.4,
    "EEnum": 0.5,
    "EEnumLiteral": 0.45,
    "EParameter": 0.5,
    "Activity": 0.76,
    "Actor": 0.63,
    "Class": 0.67,
    "Component": 0.77,
    "Association": 0.5,
    "BehaviorExecutionSpecification": 0.77,
    "Collaboration": 0.67,
    "DataType": 0.61,
    "Dependency": 0.60,
    "ElementImport": 0.65,
    "Enumeration": 0.59,
    "EnumerationLiteral": 0.51,
    "ExecutionOccurrenceSpecification": 0.71,
    "GeneralOrdering": 0.78,
    "Interaction": 0.74,
    "InstanceSpecification": 0.5,
    "Lifeline": 0.57,
    "Message": 0.67,
    "MessageOccurrenceSpecification": 0.73,
    "Model": 0.44,
    "OccurrenceSpecification": 0.72,
    "Operation": 0.66,
    "Package": 0.41,
    "Parameter": 0.67,
    "Property": 0.76,
    "StateMachine": 0.55,
    "UseCase": 0.72,
    "Usage": 0.47,
    "Abstraction": 0.67,
    "ActivityFinalNode": 0.73,
    "DecisionNode": 0.68,
    "FlowFinalNode": 0.68,
    "ForkNode": 0.67,
    "JoinNode": 0.72,
    "Include": 0.74,
    "InitialNode": 0.69,
    "Interface": 0.67,
    "LiteralUnlimitedNatural": 0.50,
    "LiteralInteger": 0.50,
    "LiteralString": 0.20,
}


def built_in_thresholds(spark: SparkSession, uml: bool = False) -> DataFrame:
    values = UML_THRESHOLDS if uml else ECORE_THRESHOLDS
    return spark.createDataFrame(list(values.items()), "type string, min_sim double")


def thresholds_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(type, min_sim) from lines like ``Name = 0.53`` with white space around; other lines are ignored."""
    shape = r"^\s+([A-Za-z]+)\s*=\s*([0-9]+(?:\.[0-9]+)?)\s+$"
    found = lines.filter(F.col(column).rlike(shape))
    part = lambda k: F.regexp_extract(column, shape, k)
    return found.select(part(1).alias("type"), part(2).cast("double").alias("min_sim"))


def threshold_table(spark: SparkSession, path: str) -> DataFrame:
    return thresholds_from_text(spark.read.text(path))


def with_threshold(rows: DataFrame, thresholds: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds min_sim; a type without one has the line ``default``'s, else the given default."""
    own = thresholds.filter("type <> 'default'")
    fallback = thresholds.filter("type = 'default'").agg(F.max("min_sim").alias("_default"))
    out = rows.join(own, "type", "left").crossJoin(F.broadcast(fallback))  # one row
    return out.withColumn("min_sim", F.coalesce("min_sim", "_default", F.lit(default))).drop("_default")


#: How lines of evaluation logs mark a summary and its end, and how the summary's two lines begin.
SUMMARY, CONFIG = "[SUMMARY]", "[CONFIG]"
TIME_LINE, RATE_LINE = "Time:", "Diff Rate:"


def fields(line: str) -> Column:
    """All ``name=number`` within a line, in order, as (name, value)."""
    part = lambda k: F.regexp_extract_all(F.col(line), F.lit(r"([A-Za-z]\w*(?:\(\w+\))?)=([0-9]+(?:\.[0-9]+)?)"), F.lit(k))
    return F.arrays_zip(part(1).alias("name"), part(2).cast("array<double>").alias("value"))


def _value(found: Column, name: str) -> Column:
    """The first value of a name; null if the line has none."""
    return F.get(F.filter(found, lambda x: x["name"] == name), F.lit(0))["value"]


def _others(lines: DataFrame, column: str) -> list[str]:
    return [c for c in lines.columns if c != column]


def log_lines(files: DataFrame, column: str = "value", place: str = "line") -> DataFrame:
    """The lines of whole log files with their place, and whether they lie in the summary (up to the configuration)."""
    lines = F.split(column, "\r?\n")
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: x.contains(SUMMARY)), True), F.lit(0))
    last = F.array_position(F.transform(lines, lambda x: x.contains(CONFIG)), True)
    upto = F.when(last > 0, last).otherwise(F.size(lines) + 1)
    marked = files.select(*_others(files, column), first.alias("_first"), upto.alias("_upto"), F.posexplode(lines).alias(place, column))
    inside = (F.col("_first") > 0) & (F.col(place) + 1 > F.col("_first")) & (F.col(place) + 1 < F.col("_upto"))
    return marked.withColumn("in_summary", inside).drop("_first", "_upto")


def estimations(lines: DataFrame, column: str = "value") -> DataFrame:
    """(type, hash, sim, threshold, tpr, fpr, prec, recall, acc, f2); word sets have hash OHR and sim Jac."""
    names = {"threshold": "threshold", "tpr": "TPR", "fpr": "FPR", "prec": "Prec", "recall": "Recall", "acc": "Acc", "f2": "F2"}
    others = _others(lines, column)
    heads = F.regexp_extract_all(column, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    read = lines.select(*others, heads.alias("_heads"), fields(column).alias("_fields")).filter(F.size("_heads") == 2)
    head = lambda k: F.get(F.col("_heads"), F.lit(k))
    method, words = F.split(head(1), "_"), head(1) == "OneHot"
    found = read.select(
        *others, head(0).alias("type"), F.when(words, "OHR").otherwise(F.get(method, F.lit(0))).alias("hash"), F.when(words, "Jac").otherwise(F.get(method, F.lit(1))).alias("sim"),
        *[_value(F.col("_fields"), name).alias(c) for c, name in names.items()],
    )
    return found.dropna(subset=["sim", *names])


def comparisons(lines: DataFrame, column: str = "value") -> DataFrame:
    """(edits, diffs, total, critical) of each run."""
    names = {"edits": "numOfEdits", "diffs": "diffs", "total": "total", "critical": "criticalMiss"}
    read = lines.select(*_others(lines, column), fields(column).alias("_fields"))
    found = read.select(*_others(lines, column), *[_value(F.col("_fields"), name).cast("long").alias(c) for c, name in names.items()])
    return found.dropna(subset=list(names))


def summaries(lines: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """(own_time, base_time, diff_rate, critical_rate) of each log's summary."""
    inside = lines.filter("in_summary").withColumn("_fields", fields(column))
    times = F.when(F.col(column).startswith(TIME_LINE), F.col("_fields"))
    rates = F.when(F.col(column).startswith(RATE_LINE), F.col("_fields"))
    cells = {
        "own_time": F.get(times, F.lit(0))["value"], "base_time": F.get(times, F.lit(1))["value"],
        "diff_rate": _value(rates, "Total"), "critical_rate": _value(rates, "Critical"),
    }
    return inside.groupBy(*by).agg(*[F.max(cell).alias(name) for name, cell in cells.items()])


def models_in(spark: SparkSession, folder: str, pattern: str = "*.xmi") -> DataFrame:
    """The text files of a folder, one row each."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("file", F.input_file_name())
