"""A training-data pipeline over the documents table.

quality rules -> language ID -> near-duplicate removal -> mixing to source weights -> BPE encoding

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet below the shared checkpoint folder and reads it back as the next
stage's docs. All stages but the last return the columns they were given, extra ones
included, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import bpe, flow_mix, hyperdim_langid, jaccard_join, quality_llr
from tabforge.llm.common import WORD_PATTERN, stored, table
from tabforge.llm.queries import BPE_PATH

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Cosine to the nearest language prototype below which a text is no language of the corpus.
LEAST_LANGUAGE_SCORE = 0.2


def _apart(docs: DataFrame, names: list[str]) -> DataFrame:
    """Only ``names`` keep their names; other columns get names that no operator uses."""
    others = [c for c in docs.columns if c not in names]
    return docs.withColumnsRenamed({c: f"__column_{i}" for i, c in enumerate(others)})


def _together(rows: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs``, from rows that went through ``_apart``."""
    others = [c for c in docs.columns if c not in names]
    back = {c: f"__column_{i}" for i, c in enumerate(others)}
    return rows.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; an empty table stays empty."""
    names = ["doc_id", "text"]
    judged = quality_llr.quality_rules(_apart(docs, names), table(spark, sf_dir, "labels"))
    return _together(judged.where("kept"), docs, names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own ``lang`` values teach; repeated rows fare alike.

    Rejects ``und`` (null texts, texts without a letter) and texts far from every
    prototype. Where no row has a ``lang`` nothing can be learned, and only texts
    without a letter are rejected.
    """
    names = ["text", "lang"]
    rows = _apart(docs, names)
    found = hyperdim_langid.predict_language(rows, train=F.lit(True))
    if docs.where(F.col("lang").isNotNull()).limit(1).count() == 0:
        kept = rows.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    else:
        kept = found.where((F.col("lang_pred") != hyperdim_langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _together(kept, docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join: the one with the smallest doc_id, rows without one last.

    A row is named by its doc_id, a digest of its text and a hash of its other columns, so
    that unlike texts under one doc_id all stay, and of rows equal in all columns one does.
    Null texts and texts without words are copies of nothing and stay. An empty table stays
    empty.
    """
    names = ["doc_id", "text"]
    rows = _apart(docs, names)
    ordered = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    others = F.xxhash64(F.lit(0), *(F.col(c) for c in rows.columns if c not in names))
    name = F.concat(F.coalesce(F.concat(F.lit("0"), ordered), F.lit("1")), F.md5("text"), F.hex(others))
    worded = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    named = rows.where(worded).withColumn("__name", name)
    found = jaccard_join.jaccard_components(named.select("__name", "text"), key="__name")
    first = found.where("__name = component_id").select("__name").distinct()
    kept = named.join(first, "__name", "left_semi").dropDuplicates(["__name"])
    return _together(kept.drop("__name").unionByName(rows.where(~worded)), docs, names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times), each time as a row of its own.

    Texts without words are never taken. Documents without a source are a source of their
    own. Rows that repeat doc_id and text are taken equally often; which of several equally
    good choices is made follows from a seeded hash of both. An empty table stays empty.
    """
    names = ["doc_id", "text", "source"]
    words = flow_mix.word_count(F.col("text"))
    targets = flow_mix.source_targets(flow_mix.source_sizes(docs, words, "source"))
    identity = [F.col("doc_id"), F.xxhash64("text")]
    mixed = flow_mix.mix_sources(_apart(docs, names), words, F.array("source"), targets, identity)
    repeated = mixed.where("repeats > 0").withColumn("__repeat", F.explode(F.sequence(F.lit(1), "repeats")))
    return _together(repeated, docs, names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of them and of the decoded text.

    The last stage: of the columns of documents only doc_id stays. Null and empty texts have
    no ids; repeated rows get equal ones; texts of any length are encoded whole; an empty
    table gives an empty result.
    """
    return bpe.encode_texts(docs.select("doc_id", "text"), BPE_PATH, digest=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mixing),
    ("bpe_encode_decode", encoding),
]

#: The fitted verdicts, the seeded mix and the token ids are no SQL; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
