"""The corpus pipeline: five stages over ``documents``, each on all rows its predecessor kept.

Quality classifier, MinHash near-dedup, secret redaction, mixing to target weights, SentencePiece
encoding. Every stage is a function of (session, documents, folder of tables) and returns a table;
``run`` writes each result as Parquet in the shared folder and reads it back for the next stage.
All but the last return the columns of their input, whatever columns it has besides doc_id, text
and source. Null texts are scored, deduplicated and redacted like empty ones and take no part in
the mix, which is counted in words; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import let, materialise, remove_scratch, scratch_mark, table, word_count
from factloom.llm.mixing import mix_sources
from factloom.llm.near_dedup import near_duplicates
from factloom.llm.rule_ensemble import CUTOFF, fit_sample, statistics
from factloom.llm.secret_scan import Forest, labelled_findings, redact_secrets
from factloom.llm.unigram_pieces import default_model, encode_pieces


def _free(name: str, docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the rule ensemble, fitted on the folder's labels, scores at ``CUTOFF`` or more."""
    model = fit_sample(docs, table(spark, sf_dir, "labels"))
    # Bound by a lambda: a filter on a struct column would be pushed below it and measure once a rule.
    return docs.filter(let(statistics(F.col("text")), lambda s: model.column(lambda name: s[name])) >= CUTOFF)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every component of near copies."""
    own = _free("kept_id", docs)
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; a column n_chars follows its text."""
    clean = redact_secrets(docs, Forest.fit(labelled_findings(spark)))
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it, to whole documents, or leave it out.

    The one document of a source that the budget cuts within stays if at least half of it is taken.
    """
    mixed = mix_sources(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    share = mixed.groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken")).filter("size > 0")
    own, source, size, copies, words, epoch = (_free(n, docs) for n in ("mix_id", "mix_source", "mix_size", "mix_copies", "mix_words", "mix_epoch"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    repeats = share.select(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("size").alias(size), times.alias(copies)).filter(F.col(copies) > 0)
    sized = docs.select("*", word_count(F.col("text")).alias(words))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    repeated = sized.join(repeats, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(epoch))
    return repeated.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document of the mix, with a check that they decode to its text."""
    return encode_pieces(docs, default_model())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: The stages fit a classifier and a forest and segment by Viterbi, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    before = scratch_mark()
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        inner = scratch_mark()
        docs = materialise(result, f"stage-{name}")
        # What the stage wrote, and its input, are read no more once its result is written.
        remove_scratch(spark, before, inner)
        before = inner
    return docs
