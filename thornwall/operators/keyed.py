"""Joins and running values by key that spread a key with many rows over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwall.config import DEFAULT, ScanConfig, stored


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column (in any case of letters)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def looked_up(rows: DataFrame, groups: DataFrame, key: str, spread: str, hot: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per ``key`` and counts its rows in ``many``; else nulls.

    Fewer than ``hot`` keys can hold more than a ``hot``-th of all counted rows each: these are sent to every task. The
    others meet by a shuffle in which no key is large; rows that have their group by then are spread by ``spread``.
    """
    total = groups.agg(F.sum("many")).first()[0] or 0
    names = [name for name in groups.columns if name != key]
    few = groups.where(F.col("many") > F.lit(total / hot)).select(key, *[F.col(n).alias(f"__hot_{n}") for n in names])
    rest = groups.where(F.col("many") <= F.lit(total / hot)).withColumn("__salt", F.lit(0).cast("long"))
    met = F.col("__hot_many").isNotNull()
    joined = rows.join(F.broadcast(few), key, "left")
    joined = joined.withColumn("__salt", F.when(met, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    joined = joined.join(rest, [key, "__salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{n}", n).alias(n) for n in names])


def block_of(turn: str, bits: int) -> Column:
    """The block of 2^bits turn numbers that a turn is in; negative numbers too lie in blocks of that size."""
    return F.shiftright(F.col(turn).cast("long"), bits)


def escalation(
    scored: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    score: str = "injection_score",
    limit: float = 200.0,
    config: ScanConfig = DEFAULT,
    bits: int = 10,
) -> DataFrame:
    """How the risk of a conversation builds up: (key, turn, score, running_max, running_total, first_turn_over, gradual).

    Running values cover the conversation up to and including a turn; rows of one turn share them. first_turn_over is the
    first turn so far that scores ``guard_from`` or more, and ``gradual`` marks turns by which the scores add up to ``limit``
    though none of them reached ``guard_from``. Scores count in whole hundredths, null ones as 0. Rows without a key or a
    turn stand alone.

    Running values are taken within blocks of 2^bits turn numbers, and each block's totals are added to the blocks after
    it, so one long conversation spreads over tasks; what meets per conversation is a row per block.
    """
    cents = F.coalesce(F.round(F.col(score) * 100).cast("long"), F.lit(0).cast("long"))
    rows = stored(scored.select(key, turn, score, cents.alias("cents"), block_of(turn, bits).alias("block")), "scored")
    over = F.when(F.col("cents") >= round(config.guard_from * 100), F.col(turn))
    whole = F.col(key).isNotNull() & F.col(turn).isNotNull()
    running = Window.partitionBy(key, "block").orderBy(turn).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    values = {"top": F.max("cents"), "total": F.sum("cents"), "first": F.min(over)}
    within = rows.where(whole).select(key, turn, score, "block", *[v.over(running).alias(n) for n, v in values.items()])
    blocks = rows.where(whole).groupBy(key, "block").agg(*[v.alias(n) for n, v in values.items()])
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"top": F.max("top"), "total": F.sum("total"), "first": F.min("first")}
    before = blocks.select(key, "block", *[v.over(earlier).alias(f"{n}_before") for n, v in carried.items()])
    joined = within.join(before, [key, "block"], "left")
    joined = joined.select(
        key, turn, score,
        F.greatest("top", "top_before").alias("top"),
        (F.col("total") + F.coalesce("total_before", F.lit(0).cast("long"))).alias("total"),
        F.least("first", "first_before").alias("first"),
    )
    alone = rows.where(~whole).select(key, turn, score, F.col("cents").alias("top"), F.col("cents").alias("total"), over.alias("first"))
    gradual = (F.col("total") >= round(limit * 100)) & (F.col("top") < round(config.guard_from * 100))
    return joined.unionByName(alone).select(
        key, turn, score,
        (F.col("top") / 100).alias("running_max"),
        (F.col("total") / 100).alias("running_total"),
        F.col("first").alias("first_turn_over"),
        gradual.alias("gradual"),
    )


def next_answers(turns: DataFrame, bits: int = 10) -> DataFrame:
    """(conv_id, turn, prompt, response): user turns with the assistant turn that follows, null where a user's follows.

    Turns may be numbered with gaps. Of several answers under one number the first in order of text counts, and a number
    under which a user speaks answers nothing, so there is one row per prompt. Prompts without a conversation or a turn have
    no response. The next turn is found within blocks of 2^bits turn numbers; the first turn of each block is carried to
    the block before it, so one long conversation spreads over tasks.
    """
    rows = turns.where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.col("role") == "user", 0).otherwise(1).alias("kind")
    answer = F.when(F.col("role") == "assistant", F.col("text")).alias("text")
    event = F.struct("turn", kind, answer)
    placed = rows.select("conv_id", "turn", "role", "text", event.alias("event"), block_of("turn", bits).alias("block"))
    known = placed.where("conv_id is not null and turn is not null")
    later = Window.partitionBy("conv_id", "block").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)
    within = known.select("conv_id", "turn", "role", "text", "block", F.min("event").over(later).alias("next"))
    heads = known.groupBy("conv_id", "block").agg(F.min("event").alias("head"))
    following = F.lead("head").over(Window.partitionBy("conv_id").orderBy("block"))
    carried = heads.select("conv_id", "block", following.alias("carried"))
    prompts = within.where(F.col("role") == "user").join(carried, ["conv_id", "block"], "left")
    found = F.coalesce("next", "carried")
    prompts = prompts.select("conv_id", "turn", F.col("text").alias("prompt"), F.when(found["kind"] == 1, found["text"]).alias("response"))
    alone = placed.where("role = 'user' and (conv_id is null or turn is null)")
    return prompts.unionByName(alone.select("conv_id", "turn", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("response")))
