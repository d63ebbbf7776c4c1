"""OCR words, given as a table with one row per word, read back into images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.functions import rules as R

# Words per part. A part is built by one task, so even an image with a large share of all words
# is assembled by many tasks and only its finished parts meet.
_PART = 4096


def images(words: DataFrame, detect_hidden: bool = True, segments: bool = True) -> DataFrame:
    """One row per image: text, word_count, confidence, hidden_segments (unless switched off), has_hidden_text.

    ``words`` has image_id, word_idx, text and conf; word_idx is unique within an image, which keeps a part at
    4,096 words. Blank words do not count. Confidence is the mean
    of the positive ones; a word with confidence between 0 and 30 counts as hidden.
    """
    full = F.rlike("text", F.lit(f"[^{R.SPACE}]"))
    sure = full & (F.col("conf") > 0)
    hidden = sure & (F.col("conf") < 30) & F.lit(detect_hidden)
    word = F.when(full, F.struct("word_idx", "text"))
    hidden_word = F.when(hidden, F.struct("word_idx", "text", (F.col("conf") / 100.0).alias("confidence")))
    parts = words.groupBy("image_id", F.floor(F.col("word_idx") / _PART).alias("part")).agg(
        F.array_sort(F.collect_list(word)).alias("words"),
        *([F.array_sort(F.collect_list(hidden_word)).alias("hidden")] if segments else []),
        F.max(F.coalesce(hidden, F.lit(False))).alias("any_hidden"),
        F.sum(F.when(sure, F.col("conf") / 100.0)).alias("total"),
        F.count(F.when(sure, 1)).alias("sure"),
    )
    parts = parts.select(
        "image_id",
        "total",
        "sure",
        F.size("words").alias("n"),
        F.when(
            F.size("words") > 0,
            F.struct("part", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text")),
        ).alias("piece"),
        *([F.when(F.size("hidden") > 0, F.struct("part", "hidden")).alias("hidden_piece")] if segments else []),
        "any_hidden",
    )
    whole = parts.groupBy("image_id").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        *([F.array_sort(F.collect_list("hidden_piece")).alias("hidden_pieces")] if segments else []),
        F.max("any_hidden").alias("has_hidden_text"),
        F.sum("total").alias("total"),
        F.sum("sure").alias("sure"),
        F.sum("n").cast("bigint").alias("word_count"),
    )
    listed = F.transform(
        F.flatten(F.transform("hidden_pieces", lambda p: p["hidden"])),
        lambda h: F.struct(
            h["text"].alias("text"), h["confidence"].alias("confidence"), F.lit("low_confidence").alias("reason")
        ),
    )
    return whole.select(
        "image_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), " ").alias("text"),
        "word_count",
        F.when(F.col("sure") > 0, F.col("total") / F.col("sure")).otherwise(F.lit(0.0)).alias("confidence"),
        *([listed.alias("hidden_segments")] if segments else []),
        "has_hidden_text",
    )


def hidden_words(words: DataFrame) -> DataFrame:
    """The hidden words themselves, straight from the table (no grouping)."""
    full = F.rlike("text", F.lit(f"[^{R.SPACE}]"))
    found = words.filter((F.col("conf") > 0) & (F.col("conf") < 30) & full)
    return found.select(
        "image_id", "word_idx", "text", (F.col("conf") / 100.0).alias("confidence"), F.lit("low_confidence").alias("reason")
    )


def confidences(words: DataFrame) -> DataFrame:
    """Mean confidence per image, without assembling any text."""
    sure = F.rlike("text", F.lit(f"[^{R.SPACE}]")) & (F.col("conf") > 0)
    means = words.groupBy("image_id").agg(F.avg(F.when(sure, F.col("conf") / 100.0)).alias("confidence"))
    return means.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
