"""The pipeline stage by stage against plain versions of what each stage does to its own input."""

import random

import pytest
from corpus import edited, prose
from pyspark.sql import functions as F
from test_dedup_operators import brute_lines, brute_near

import __spark_entry__
import corpus_pipeline
from skycadence.llm import mixing
from skycadence.llm.shared import documents, written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    item = prose(rng, 30, 5000)
    base = prose(rng, 120, 5000)
    texts = [prose(rng, 60, 5000) + (" vile vile" if k % 3 == 0 else "") for k in range(240)]
    texts += [edited(rng, base, 2) for _ in range(10)] + [prose(rng, 20, 5000) + " " + item for _ in range(5)]
    texts += [prose(rng, 20, 5000) + "\nAll rights reserved by us\n" + prose(rng, 20, 5000) for _ in range(6)] + [None, "", "one"]
    path = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", f"src{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages(spark, folder):
    path, item = folder
    steps, docs = {}, documents(spark, path)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path), "step")
        steps[name] = {(r.doc_id, r.text) for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == documents(spark, path).columns
    start = {(r.doc_id, r.text) for r in documents(spark, path).collect()}
    assert steps["toxicity"] == {(i, t) for i, t in start if "vile" not in (t or "")}
    ids, texts = zip(*sorted(steps["toxicity"]))
    assert steps["line dedup"] == {(i, t) for i, t, *_ in brute_lines(texts, ids, True)}
    ids, texts = zip(*sorted(steps["line dedup"]))
    kept = {i for i, _, low in brute_near(texts, ids, width=5) if i == low}
    assert steps["near dedup"] == {(i, t) for i, t in steps["line dedup"] if i in kept} and len(kept) < len(ids)
    assert steps["decontamination"] == {(i, t) for i, t in steps["near dedup"] if item not in (t or "")}
    assert len(steps["near dedup"]) - len(steps["decontamination"]) == 5
    again = mixing.mix(spark.createDataFrame([(i, t, "en", f"src{i % 5}", 0) for i, t in steps["decontamination"]], COLUMNS))
    assert {(r.doc_id, r.copy) for r in again.collect()} == {(r.doc_id, r.copy) for r in docs.collect()}


def test_run_and_registration(spark, folder):
    found = corpus_pipeline.run(spark, folder[0])
    assert found.columns[-3:] == ["copy", "repeats", "rate"] and found.count() == found.select("doc_id", "copy").distinct().count() > 0
    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= names and len([n for n in names if n.startswith("op")]) == 13
    assert set(__spark_entry__.oracle_sql()) <= names


def test_clashing_columns_and_empty_tables(spark, folder):
    path, _ = folder
    docs = documents(spark, path).limit(40).withColumns({"score": F.lit("s"), "kept": F.lit(1), "n": F.lit(2), "bucket": F.lit("b"), "content": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.count() >= 0
        assert stage(spark, docs.where("false"), path).count() == 0
