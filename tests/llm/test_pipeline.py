"""The corpus pipeline against a plain version of its stages' decisions on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("value", F.lit(1)).cache()
    rows = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        rows[name] = docs
    all_ids = [r.doc_id for r in rows["documents"].select("doc_id").collect()]
    quality = {r.doc_id for r in rows["quality"].collect()}
    assert quality < set(all_ids)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i, q in labels.items() if (i in quality) != bool(q)]
    assert len(wrong) <= 0.1 * len(labels)
    kept = rows["near_dedup"].collect()
    assert rows["near_dedup"].columns == rows["documents"].columns
    texts = [r.text.lower() for r in kept]
    assert len(texts) == len(set(texts)) and {r.doc_id for r in kept} <= quality
    before, after = {r.doc_id: r.text for r in kept}, {r.doc_id: r for r in rows["secrets"].collect()}
    assert before.keys() == after.keys() and all(len(r.text) == r.n_chars for r in after.values() if r.text != before[r.doc_id])
    assert not any('token = "' in r.text and '"<secret>"' not in r.text for r in after.values())
    mixed = rows["mixing"].collect()
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == after[r.doc_id].text
    assert copies.keys() <= after.keys() and max(copies.values()) <= 3
    coded = rows["pieces"].collect()
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed) and all(r.round_trip for r in coded)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty(), name
        if name != "pieces":
            docs = spark.createDataFrame([], docs.schema)


def test_stages_on_odd_rows_and_clashing_columns(spark):
    """Null texts, ids and sources, repeated ids, a very long text and columns that the stages' own might clash with."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    body = "Die Prüfung der Waren ist in allen Märkten gleich und wird jeden Tag von neuem begonnen. "
    rows = [
        (1, body * 3, "a"), (2, body * 3, "a"), (2, body * 3, "a"), (None, "ein ganz anderer Text ohne Bezug zu den anderen Zeilen", "b"), (4, None, "b"), (5, "", None), (6, "kurz", None), (7, " ".join(f"w{i}" for i in range(60_000)), "b"),
        (8, 'wir nutzen token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" hier ' + body, "a"),
    ]
    clash = ("mix_id", "mix_copies", "kept_id", "__id", "__copies", "__words", "__epoch", "mix_source", "taken", "size", "node", "comp", "value", "score")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, c in enumerate(clash):
        docs = docs.withColumn(c, F.lit(i))
    kept = P.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == ["1", "4", "5", "6", "7", "8", "None"]
    clean = P.secrets(spark, docs, "")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and "9f86d081" not in texts[8] and texts[4] is None and texts[7] == rows[7][1]
    mixed = P.mixing(spark, docs, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {1, 2, None, 6, 7, 8}
    coded = P.pieces(spark, docs, "")
    assert coded.count() == len(rows)
    none = docs.limit(0)
    assert all(stage(spark, none, "").count() == 0 for stage in (P.near_dedup, P.secrets, P.mixing, P.pieces))
