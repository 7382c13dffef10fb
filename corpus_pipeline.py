"""From raw documents to token ids: the stages of the corpus pipeline, in order.

Every stage takes and returns all columns of ``documents`` (the last one returns tokens) and works
on whatever its predecessor kept. Empty tables pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.batches import staged
from tideline.llm.bpe import encode_and_decode
from tideline.llm.decontaminate import mark_benchmark
from tideline.llm.language import UNKNOWN, identify, learn_profiles
from tideline.llm.queries import digests_of_tokens, table, tokenizer_file
from tideline.llm.repeats import remove_repeats
from tideline.llm.simhash import group_near_copies

#: No SQL: byte-level deduplication, fingerprint components and tokenization are beyond it.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts that are null or have no letter go.

    Profiles are learned from the documents that name their language (if none does, all texts are
    taken as one language, so that only texts without letters go). A missing ``lang`` is filled in.
    """
    profiles = learn_profiles(docs)
    named = bool(profiles)
    told = identify(docs, profiles or learn_profiles(docs.withColumn("lang", F.lit("any"))))
    lang = F.coalesce("lang", "lang_pred") if named else F.col("lang")
    return told.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", lang).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Of rows that repeat an id, and of texts without an id that share a fingerprint, one stays.
    """
    grouped = group_near_copies(docs)
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return first.dropDuplicates(["doc_id", "fingerprint"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without repeated passages of 50 words; ``n_chars`` counts what is left.

    A passage goes wherever it is found, in one document or in several. Null texts become empty,
    texts of fewer words stay as they are, and rows that repeat a long text lose all its words.
    """
    cut = remove_repeats(docs, unit="words")
    return cut.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay, as does every row that repeats a clean one.
    """
    marked = mark_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("hits") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the digests of the round trip.

    Null and empty texts have no tokens; each row is encoded for itself, repeated ones too.
    """
    return digests_of_tokens(encode_and_decode(docs, tokenizer_file()), "lang", "source", "ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
