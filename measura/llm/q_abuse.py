"""Problem 9: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm.abuse import AbuseModel, abuse_scores, labelled
from measura.session import table


def fitted(spark: SparkSession, sf_dir: str) -> AbuseModel:
    told = labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_reviews"), group="lang")
    return AbuseModel.fit([t for t, *_ in told], [v for _, v, _ in told], [g for *_, g in told])


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fitted(spark, sf_dir)
    scored = docs.select("doc_id", "source", abuse_scores(docs, model, "text").alias("score"))
    return scored.withColumn("flagged", F.col("score") >= model.threshold)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their rate for each source."""
    n, bad = F.count("*"), F.count_if("flagged")
    return p9_scores(spark, sf_dir).groupBy("source").agg(n.alias("documents"), bad.alias("flagged"), F.round(bad / n, 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
