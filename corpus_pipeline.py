"""From raw documents to a training mix: STAGES in order, each written as Parquet and read again.

Language ID rejects texts without a language; of near-duplicates one document stays; long passages
that repeat across documents are cut; documents that hold benchmark items go; sources are mixed
to target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.decontaminate import drop_contaminated
from tidegraph.llm.language import fit_language, identify
from tidegraph.llm.mixing import take_mix
from tidegraph.llm.neardup import drop_near_duplicates
from tidegraph.llm.runtime import fresh, stored, table
from tidegraph.llm.substring import remove_repeats

#: Words of a passage that is cut where it repeats.
PASSAGE = 50
#: Language ID rejects undetermined texts, and texts below this score.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a learned language; ``lang`` stays as given.

    Null and empty texts and texts without a letter go.  Ties go to the first language by name; repeated rows are judged alike.
    """
    label, score = fresh(docs.columns, "lang_pred", "lang_score")
    return identify(docs, fit_language(docs), (label, score)).where((F.col(label) != "und") & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more; the smallest doc_id, and of its rows one.

    Texts without words are in no group and stay, as rows without a doc_id do, one of each text.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of PASSAGE words or more; n_chars follows the text where it changes.

    Every row stays; null and empty texts stay as they are; repeated rows repeat their passages, and all places of a passage are cut.
    """
    words, removed = fresh(docs.columns, "n_words", "n_removed")
    cut = remove_repeats(docs, window=PASSAGE, with_text=True, names=(words, removed))
    return cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: five-word shingles, containment 0.8 or more.

    Null and empty texts and items match nothing; repeated rows are judged alike, and rows without a doc_id like others.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``repeats``, the number of times it takes them.

    Null texts have size 0; null sources are a source; rows equal in doc_id, text and source are taken equally often, others by their own hash.
    """
    return take_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL expresses neither language ID nor the later stages on its result; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
