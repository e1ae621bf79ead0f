"""The corpus pipeline: from raw documents to token ids, stage by stage.

Every stage reads what the stage before it wrote. All stages but the last
return the columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.bpe import bpe_encode
from concord.llm.common import remainder, scratch, table, unused
from concord.llm.decontaminate import decontaminate
from concord.llm.linededup import line_dedup
from concord.llm.queries import vocabulary
from concord.llm.simhash import keep_one
from concord.llm.toxicity import toxicity


def _with(docs: DataFrame, added: tuple[str, ...], operator) -> tuple[DataFrame, list]:
    """``operator(docs)`` and the columns of ``docs`` in it, also where ``docs`` has columns named like those it adds."""
    clash = [c for c in docs.columns if c.lower() in added]
    other = dict(zip(clash, unused([*docs.columns, *added], *clash)))
    return operator(docs.withColumnsRenamed(other)), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")

    def scored(d):
        return toxicity(d, d.where(remainder(F.col("doc_id"), 4) != 2), labels)

    out, own = _with(docs, ("score", "predicted"), scored)
    return out.where("predicted = 0").select(*own)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; ``n_chars`` follows the text."""
    out, own = _with(docs, ("n_lines", "n_removed"), line_dedup)
    out = out.select(*own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest id."""
    return keep_one(docs, width=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with digests of ids and decoded text."""
    return bpe_encode(docs, vocabulary(), with_ids=True).drop("text_key")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_near),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Scores, fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
