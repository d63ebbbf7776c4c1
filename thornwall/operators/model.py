"""Pluggable classifier: a model's probability in place of the keyword score."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from thornwall.functions import rules as R
from thornwall.functions.slices import slices

log = logging.getLogger(__name__)

Predictor = Callable[[Sequence[str]], Sequence[float]]


def first_tokens(text: Column, limit: int) -> Column:
    """The first white-space separated tokens; the rest is dropped, as a model's input limit does."""
    tokens = F.split(F.regexp_replace(text, rf"^[{R.SPACE}]+", ""), rf"[{R.SPACE}]+", limit + 1)
    return F.array_join(F.slice(tokens, 1, limit), " ")


def with_model_probability(
    df: DataFrame, load: Callable[[], Predictor], text: str = "text", into: str = "model_probability", max_tokens: int | None = None
) -> DataFrame:
    """Add a classifier's risk probability.

    ``load`` runs once per Python worker task and returns the predictor, which gets texts in batches of about a
    megabyte (``SLICE_BYTES``). A model with
    a limit on its input states it as ``max_tokens``; text is then cut before it leaves the JVM. Where a batch fails,
    its texts are tried one by one, and only those that fail alone score 0. Null reads as empty text.
    """

    @F.arrow_udf(DoubleType())
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = load()
        for batch in batches:
            for first, many in slices(batch):
                texts = [text or "" for text in batch.slice(first, many).to_pylist()]
                try:
                    values = list(predict(texts))
                except Exception:
                    values = [alone(predict, text) for text in texts]
                if len(values) != many:
                    raise ValueError(f"the model gave {len(values)} values for {many} texts")
                yield pa.array(np.asarray(values, "float64"), from_pandas=True)

    def alone(predict: Predictor, text: str) -> float:
        try:
            return float(predict([text])[0])
        except Exception as error:
            log.warning("model failed on a text of %d characters: %s", len(text), error)
            return 0.0

    read = F.col(text) if max_tokens is None else first_tokens(F.col(text), max_tokens)
    return df.withColumn(into, probability(read))


def with_external_probability(df: DataFrame, scores: DataFrame, key: str, into: str = "model_probability") -> DataFrame:
    """Add probabilities that a model job has written before, by a unique key; null where there is none."""
    return df.join(scores.select(key, F.col("probability").alias(into)), key, "left")
