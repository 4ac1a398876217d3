"""Quality classifier: text features by built-in functions, scored by an additive model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.llm import gam

#: At most so many labelled rows are learned from: those of the least hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "symbols", "bangs", "bars", "upper", "digits", "ends", "distinct", "distinct_lines", "line_words", "first_upper")


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the features of each text; a null text counts as empty, and an empty one gives zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.select(*keep, text.alias("t"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.split(text, "\n").alias("l"))
    words, chars, lines = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("t"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern))

    made = {
        "log_words": F.log1p(F.size("w")),
        "word_length": chars / words,
        "symbols": count(r"[#*$%&<>]") / words,
        "bangs": count(r"!") / words,
        "bars": count(r"\|") / words,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "ends": count(r"[.,;:?](?=\s|$)") / words,
        "distinct": F.size(F.array_distinct("w")) / words,
        "distinct_lines": F.size(F.array_distinct("l")) / lines,
        "line_words": F.log1p(words / lines),
        "first_upper": count(r"(?<=\s)\p{Lu}") / words,
    }
    return base.select(*keep, *(made[f].cast("double").alias(f) for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> gam.Gam:
    """Learn from ``labels`` (doc_id, quality) that join ``docs``; null labels are left out."""
    rows = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's bound makes it fit to send to every executor.
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = features(joined, ["doc_id", "quality"]).toPandas().sort_values(["doc_id", *FEATURES])
    return gam.fit(found[list(FEATURES)].to_numpy(), found["quality"].to_numpy())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: gam.Gam) -> DataFrame:
    """(doc_id, score) of each row; repeated rows are scored each."""

    @F.pandas_udf("double")
    def additive(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x.to_numpy(np.float64)))

    return features(docs, ["doc_id"]).select("doc_id", additive(F.struct(*FEATURES)).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Labels of held-out ids are never learned from.  Without labels of both kinds every score is the
    labels' share.  A null or empty text is scored like any other, a null id isn't held out.  An empty
    table gives no rows.  Extra columns are ignored.
    """
    model = train(docs, labels.where(~held_out()), sample=sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; cases as in :func:`classify`."""
    model = train(docs, labels.where(~held_out()), sample=sample)
    rows = features(docs.select(F.struct("*").alias("row"), "text"), ["row"])

    @F.pandas_udf("double")
    def additive(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x.to_numpy(np.float64)))

    return rows.withColumn("score", additive(F.struct(*FEATURES))).where(F.col("score") >= threshold).select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
