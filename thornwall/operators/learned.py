"""A linear classifier on hashed words, fitted by Spark: logistic regression with exact sums of gradients.

Each round, tasks add up the gradients of their rows as whole numbers, so the sums, and with them the weights, do not
depend on how rows are dealt. Weights are stored as a table and sent to workers once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from thornwall.config import stored

BUCKETS = 1 << 14
#: Gradients count in steps of this size.
UNIT = 2.0**-20


def hashed_words(text: Column, buckets: int = BUCKETS) -> Column:
    """The different buckets of a text's lower-case words (runs of letters and digits)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def _margins(weights: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Bias plus the mean-square-scaled sum of each row's weights; the bias is the last weight."""
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.full(len(lists), weights[-1])
    if sizes.sum():
        rows = np.repeat(np.arange(len(lists)), sizes)
        out += np.bincount(rows, weights=weights[np.concatenate(lists)], minlength=len(lists)) / np.sqrt(np.maximum(sizes, 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(labelled: DataFrame, text: str, label: str, rounds: int = 30, shrink: float = 0.01, buckets: int = BUCKETS) -> DataFrame:
    """(feature, weight) of a classifier for ``label`` (0 or 1); feature -1 is the bias. Null texts and labels teach nothing.

    A round moves every weight by its gradient over an upper bound of its curvature, with momentum.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = stored(known.select(F.col(label).cast("double").alias("label"), hashed_words(F.col(text), buckets).alias("features")), "features")
    weights = np.zeros(buckets + 1)
    ahead, curvature = weights.copy(), None
    for n in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = ahead) -> Iterator[pa.RecordBatch]:
            slopes, seen = np.zeros(buckets + 1), np.zeros(buckets + 1)
            for batch in batches:
                lists = [np.asarray(x, np.int64) for x in batch.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                error = _sigmoid(_margins(weights, lists)) - batch.column(0).to_numpy()
                each = np.rint(error / np.sqrt(np.maximum(sizes, 1)) / UNIT)
                if sizes.sum():
                    flat = np.concatenate(lists)
                    slopes += np.bincount(flat, weights=np.repeat(each, sizes), minlength=buckets + 1)
                    seen += np.bincount(flat, minlength=buckets + 1)
                slopes[-1] += np.rint(error / UNIT).sum()
                seen[-1] += len(lists)
            used = np.flatnonzero(seen)
            columns = [pa.array(used), pa.array(slopes[used].astype(np.int64)), pa.array(seen[used].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "slope", "seen"])

        sums = rows.mapInArrow(run, "feature long, slope long, seen long").groupBy("feature").agg(F.sum("slope").alias("slope"), F.sum("seen").alias("seen"))
        slopes, seen = np.zeros(buckets + 1), np.zeros(buckets + 1)
        for row in sums.collect():  # a row per bucket at most
            slopes[row.feature], seen[row.feature] = row.slope * UNIT, row.seen
        if curvature is None:
            curvature = 0.5 * seen  # a quarter, twice: half of it is the bias's
        moved = ahead - (slopes + shrink * ahead) / (curvature + shrink)
        ahead, weights = moved + n / (n + 3) * (moved - weights), moved
    spark = labelled.sparkSession
    used = np.flatnonzero(weights)
    table = [(int(f) if f < buckets else -1, float(weights[f])) for f in used]
    return spark.createDataFrame(table, "feature long, weight double")


def save(weights: DataFrame, path: str) -> None:
    weights.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """Stored weights as one array, the bias last."""
    weights = np.zeros(buckets + 1)
    for row in spark.read.parquet(path).collect():  # a row per bucket at most
        weights[row.feature] = row.weight
    return weights


def with_learned_probability(df: DataFrame, path: str, text: str = "text", into: str = "model_probability", buckets: int = BUCKETS) -> DataFrame:
    """Add the probability of the stored classifier; words are hashed before they leave the JVM. Null reads as empty."""
    shared = df.sparkSession.sparkContext.broadcast(load(df.sparkSession, path, buckets))

    @F.pandas_udf(DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for batch in batches:
            yield pd.Series(_sigmoid(_margins(weights, [np.asarray(x, np.int64) for x in batch])), index=batch.index)

    return df.withColumn(into, probability(hashed_words(F.col(text), buckets)))
