"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token output.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the
columns of ``documents``; the last returns each written document's place: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import discard, free_name, scratch, stored, table
from gridspark.llm.decontaminate import decontaminate
from gridspark.llm.language import identify, learn_profiles
from gridspark.llm.mixing import mix, repeated
from gridspark.llm.queries import held_out
from gridspark.llm.simhash import keep_one
from gridspark.llm.token_output import read_files, token_files

#: A document whose best language scores less than this is rejected, and so is one without letters.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in none of the learned languages (``und``, or below ``LEAST_LANGUAGE_SCORE``): so null texts and texts without
    letters go. Where no language can be learned (no labels) all stay."""
    profiles = learn_profiles(docs.where(~held_out()).select("text", "lang"))
    if not profiles.langs:
        return docs
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")  # the caller may have columns of these names
    found = identify(docs, profiles, lang_pred=lang, score=score).where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return found.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, on shingles of five words."""
    return keep_one(docs, width=5)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edited or not."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them twice, so that every source comes to its target."""
    return repeated(mix(docs), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back."""
    import public_tokenizers

    return read_files(token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can't express the stages; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read back. The token files stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as made:  # a stage's own tables, and its input, are deleted when its result is there
            docs = stored(stage(spark, before, sf_dir), "stage")
            made.remove(docs)
        if hasattr(before, "stored_at"):
            discard(before)
    return docs
