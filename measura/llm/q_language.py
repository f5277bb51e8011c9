"""Problem 3: missing and wrong language labels, and records in several languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.llm.encoding import STAMP
from measura.llm.language import label_code, record_languages, trained
from measura.session import table

KEYS = ["rec_kind", "rec_id"]
#: lines (cues) that a language needs to count as one of several
MIXED_LINES = 3
#: confidence that such a line needs
LINE_CONFIDENCE = 0.8


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_kind, rec_id, item, line) of the cues of attempts and the lines of lyric sheets; item is cue_id or the line's place."""
    cues = table(spark, sf_dir, "raw_cues").select(F.lit("attempt").alias("rec_kind"), F.col("attempt_id").alias("rec_id"), F.col("cue_id").alias("item"), F.col("text").alias("line"))
    sheets = table(spark, sf_dir, "embedded_lyrics").select(F.lit("lyrics").alias("rec_kind"), F.col("lyrics_id").alias("rec_id"), F.posexplode(F.split("text", "\r?\n")))
    return cues.unionByName(sheets.select("rec_kind", "rec_id", F.col("pos").cast("long").alias("item"), F.regexp_replace("col", STAMP, "").alias("line")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, name).select(F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"), label_code("language_code").alias("label")) for kind, name, key in (("attempt", "attempts", "attempt_id"), ("lyrics", "embedded_lyrics", "lyrics_id"))]
    return parts[0].unionByName(parts[1]).dropDuplicates(KEYS)


def p3_lines(spark: SparkSession, sf_dir: str, parts: bool = False) -> DataFrame:
    """(rec_kind, rec_id, item, part, lang, conf, words) of every line with words."""
    net = trained(table(spark, sf_dir, "language_samples"))
    return record_languages(record_lines(spark, sf_dir), net, KEYS, "item", "line", parts)


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of each record with text, the confidence in it, and the languages of three or more lines."""
    per = p3_lines(spark, sf_dir).groupBy(*KEYS, "lang").agg(F.count("*").alias("n"), F.sum("conf").alias("sure"), F.count_if(F.col("conf") >= LINE_CONFIDENCE).alias("n_sure"))
    whole = per.groupBy(*KEYS).agg(
        F.max_by("lang", F.struct("n", "sure", "lang")).alias("language_code"),
        (F.max(F.struct("n", "sure"))["sure"] / F.sum("n")).alias("language_confidence"),
        F.sum("n").alias("n_lines"),
        F.array_sort(F.collect_list(F.when(F.col("n_sure") >= MIXED_LINES, F.col("lang")))).alias("languages"),
    )
    return whole.join(_labels(spark, sf_dir), KEYS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("language_code"), "wrong")
    one = F.filter(F.array(F.struct(issue.alias("issue"), "language_code")), lambda x: x["issue"].isNotNull())
    mixed = F.when(F.size("languages") > 1, F.transform("languages", lambda x: F.struct(F.lit("mixed").alias("issue"), x.alias("language_code")))).otherwise(F.array())
    return p3_records(spark, sf_dir).select(*KEYS, F.explode(F.concat(one, mixed)).alias("x")).select(*KEYS, "x.issue", "x.language_code")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of consecutive words of one language in a record, over its lines and inside them: its language, confidence, lines and words."""
    order = table(spark, sf_dir, "raw_cues").select(F.lit("attempt").alias("rec_kind"), F.col("attempt_id").alias("rec_id"), F.col("cue_id").alias("item"), F.col("start_s").alias("at")).dropDuplicates([*KEYS, "item"])
    lines = p3_lines(spark, sf_dir, parts=True).join(order, [*KEYS, "item"], "left").withColumn("at", F.coalesce(F.nanvl("at", F.lit(None).cast("double")), F.lit(0.0)))
    w = W.partitionBy(*KEYS).orderBy("at", "item", "part")  # the lines of one record
    cut = F.coalesce((F.lag("lang").over(w) != F.col("lang")).cast("int"), F.lit(0))
    parts = lines.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w).cast("int"))
    sure = F.sum(F.col("conf") * F.col("words")) / F.sum("words")
    return parts.groupBy(*KEYS, "segment").agg(F.min("lang").alias("language_code"), F.round(sure, 4).alias("language_confidence"), F.count_distinct("item").alias("n_lines"), F.sum("words").alias("n_words"), F.min_by("item", F.struct("at", "item")).alias("first_item"), F.max_by("item", F.struct("at", "item")).alias("last_item"))


QUERIES = {"p3_found": p3_found, "p3_records": p3_records, "p3_segments": p3_segments}
ORACLES: dict[str, str] = {}
