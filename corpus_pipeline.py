"""From raw documents to a training mix, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that
the stage before it kept; its result is written as Parquet and read again, and
what the stage wrote on the way is deleted then, with the result before it.

All stages take any table with the columns of ``documents``, in any order, with
further columns of any name, which they pass on.  An empty table gives an empty
one.  Nulls, ties and repeated rows are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.fmindex import drop_contaminated
from tessera.llm.mixing import mix_sources
from tessera.llm.partenum import keep_one_of_each
from tessera.llm.pii import pii_key, replace_personal_data
from tessera.llm.quality import judge_quality
from tessera.llm.storage import scope, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is low go.

    A null or empty text has no words and goes.  Equal rows go or stay together.
    """
    return judge_quality(docs, only_kept=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    A text without words stays.  A null id counts as greater than all others;
    rows with one id are told apart by their texts; of equal rows one stays.
    """
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    A null or empty text is clean.  Equal rows go or stay together.  An empty
    benchmark, or one without texts, removes nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to surrogates; n_chars follows the new text.

    A null text stays null, with a null n_chars.  Equal rows stay equal.  The
    key is the one that the session names.
    """
    changed = replace_personal_data(docs, key=pii_key(spark), counts=False)
    return changed.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words that it takes of each.

    A null source is one of its own, the last.  Texts without words are not
    taken.  Repeated rows are drawn one by one; ties of key go by id and size.
    """
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("mixing sources to target weights", mixing),
]

#: The fits and keyed digests of the stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as results:
        for _, stage in STAGES[:-1]:
            with scope(spark) as made:
                docs = written(stage(spark, docs, sf_dir))
                made.remove(but=1)
            results.remove(but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
