"""Running values and answers by conversation, with one conversation that holds most turns."""

import random

import pytest
from pyspark.sql import functions as F

from thornwall.operators import guard as G
from thornwall.operators import keyed as K


def slow_escalation(rows, limit, least=30.0):
    out = []
    for conv, turn, score in rows:
        own = [(t, s or 0.0) for c, t, s in rows if c == conv and t is not None and turn is not None and t <= turn]
        if conv is None or turn is None:
            own = [(turn, score or 0.0)]
        cents = [round(s * 100) for _, s in own]
        over = [t for (t, _), c in zip(own, cents) if c >= least * 100 and t is not None]
        top, total = max(cents), sum(cents)
        out.append((conv, turn, score, top / 100, total / 100, min(over, default=None), total >= limit * 100 and top < least * 100))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [10, 3, 0])
def test_running_values_match_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(0, t, rng.choice([0.0, 3.5, 12.25, 29.99, 30.0, 77.1])) for t in rng.sample(range(-300, 3000), 250)]
    rows += [(c, rng.randrange(-20, 40) * 50, rng.choice([0.0, 5.5, 40.0, None])) for c in range(1, 40) for _ in range(6)]
    rows += rows[:5] + [(None, 1, 50.0), (None, 2, 1.0), (3, None, 31.0), (3, None, 2.0), (None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, injection_score double").repartition(5)
    got = K.escalation(df, limit=60.0, bits=bits)
    assert got.columns == ["conv_id", "turn", "injection_score", "running_max", "running_total", "first_turn_over", "gradual"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_escalation(rows, 60.0)
    assert K.escalation(df.limit(0)).count() == 0


def test_a_conversation_with_half_of_all_turns_spreads(spark):
    turns = spark.range(60000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit(0.01).alias("injection_score")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = K.escalation(turns, limit=200.0)
        sizes = [r["count"] for r in got.where("conv_id = 0").groupBy(F.spark_partition_id()).count().collect()]
        last = got.where("conv_id = 0").orderBy(F.desc("turn")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 0.35 * 30000
    assert last.running_total == 300.0 and last.gradual and last.first_turn_over is None


def slow_answers(rows):
    out = []
    for conv, turn, role, text in rows:
        if role != "user":
            continue
        later = [(t, r, x) for c, t, r, x in rows if c == conv and conv is not None and t is not None and turn is not None and t > turn and r in ("user", "assistant")]
        first = min((t for t, _, _ in later), default=None)
        at = [(r, x) for t, r, x in later if t == first]
        answers = [x for r, x in at if r == "assistant"]
        known = sorted(x for x in answers if x is not None)
        response = None if any(r == "user" for r, _ in at) or not answers or len(known) < len(answers) else known[0]
        out.append((conv, turn, text, response))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [10, 2, 0])
def test_answers_match_brute_force(spark, bits):
    rng = random.Random(bits)
    roles = ["user", "assistant", "assistant", "system"]
    rows = [(0, t * rng.choice([1, 1, 7]), rng.choice(roles), f"text {rng.randrange(50)}") for t in range(-100, 300)]
    rows += [(c, rng.randrange(-5, 20) * 300, rng.choice(roles), f"text {rng.randrange(9)}") for c in range(1, 60) for _ in range(7)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, None, "user", "q"), (5, None, "assistant", "a"), (70, 1, "user", None), (71, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = K.next_answers(turns, bits)
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_answers(rows)


def test_gaps_and_several_answers_give_one_row_a_prompt(spark):
    rows = [(1, 0, "user", "q"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 3, "assistant", "later"), (2, 0, "user", "q"), (2, 5000, "assistant", "far")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.response for r in G.conversation_prompts(turns).collect()}
    assert got == {1: "a", 2: "far"} and G.conversation_prompts(turns).count() == 2


def test_a_hot_key_is_spread(spark):
    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'hot' else 'k' || (id % 1500) end as key")
    groups = rows.groupBy("key").agg({"*": "count"}).toDF("key", "many").selectExpr("key", "many", "'v' || key as value")
    joined = K.looked_up(rows, groups, "key", "id", hot=16)
    assert joined.count() == 4000 and joined.where("value = 'v' || key").count() == 4000
    assert K.looked_up(rows, groups.limit(0), "key", "id").where("value is null").count() == 4000
