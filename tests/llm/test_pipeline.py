import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_likeness import brute_kept
from twinweave.llm import decontaminate, pii
from twinweave.llm.common import table


def test_stages(spark, sf):
    """Each stage on what the one before kept, against plain Python on the same rows."""
    docs = table(spark, sf, "documents")
    rows = docs.collect()
    stages = dict(P.STAGES)
    mild = stages["toxicity"](spark, docs, sf)
    assert mild.columns == docs.columns and 0.7 * len(rows) < mild.count() <= len(rows)
    kept = stages["simhash"](spark, mild, sf).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept([(r.doc_id, r.text) for r in mild.collect()])
    frame = spark.createDataFrame(kept, docs.schema)
    bench = table(spark, sf, "benchmark").collect()
    index = decontaminate.Index([(r.item_id, r.text) for r in bench])
    clean = stages["decontamination"](spark, frame, sf).collect()
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in kept if not index.search([r.text or ""])[0])
    frame = spark.createDataFrame(clean, docs.schema)
    safe = stages["pii"](spark, frame, sf).collect()
    want = {r.doc_id: r.text for r in pii.pseudonymized(frame, pii.key_of(spark)).collect()}
    assert {r.doc_id: r.text for r in safe} == want
    packed = stages["packing"](spark, spark.createDataFrame(safe, docs.schema), sf)
    assert {r.doc_id for r in packed.collect()} == set(want)


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and all(r.length > 0 for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, odd, sf, empty):
    """Null and empty texts (copies of each other), repeated rows, a null id, clashing columns; an empty table."""
    docs = odd.limit(0) if empty else odd.withColumn("leaks", F.lit("clash")).withColumn("toxicity_score", F.lit("clash"))
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = sorted((str(r.doc_id) for r in docs.select("doc_id").distinct().collect()))
    assert ids == ([] if empty else ["1", "3", "4", "None"])


@pytest.mark.parametrize("stage", ["toxicity", "simhash", "decontamination", "packing"])
def test_batches_that_go_to_python(spark, docs, sf, stage):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        dict(P.STAGES)[stage](spark, docs([]), sf)
        seen = spark.range(0, 9000, 1, 1).mapInPandas(lambda frames: (pd.DataFrame({"n": [len(x)]}) for x in frames), "n long")
        assert max(r.n for r in seen.collect()) <= P.BATCH_ROWS
        spark.conf.set(name, 100)
        P.small_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
