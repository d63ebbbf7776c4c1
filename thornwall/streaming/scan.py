"""The scan as streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thornwall.config import DEFAULT, ScanConfig
from thornwall.operators import guard as G
from thornwall.operators.analyze import analyze
from thornwall.sources import manifest


def stream_analyze(content: DataFrame, config: ScanConfig = DEFAULT, segments: bool | str = True) -> DataFrame:
    """``analyze`` over a stream; stateless, so it keeps up by adding tasks. ``segments="count"`` gives their number only."""
    return analyze(content, config=config, segments=segments)


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to Parquet files; a restart from the checkpoint writes each row once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def stream_guard(
    prompts: DataFrame,
    path: str,
    checkpoint: str,
    prompt: str = "prompt",
    mode: str | Column = "balanced",
    response: str | None = None,
    trigger: dict | None = None,
    config: ScanConfig = DEFAULT,
) -> StreamingQuery:
    """Guard a prompt stream into ``path/audit``, partitioned by action.

    Blocked prompts are the partition ``sanitization_action=BLOCKED`` of the same table. The file sink logs what
    each batch wrote, so a repeated batch adds nothing; there are as many directories as actions, and batches set
    the number of files (choose the trigger accordingly).
    """
    guarded = G.guard(prompts, prompt, mode, response, config)
    writer = guarded.writeStream.format("parquet").outputMode("append").partitionBy("sanitization_action")
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(f"{path}/audit")


def stream_stats(
    guarded: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Guard statistics per tumbling window; scores are summed as whole hundredths."""
    action = F.col("sanitization_action")
    grouped = guarded.withWatermark(time, late).groupBy(F.window(time, window).alias("window"))
    totals = grouped.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("injection_detected")).alias("threats_detected"),
        F.count_if(action == "BLOCKED").alias("requests_blocked"),
        F.count_if(F.col("was_sanitized")).alias("requests_sanitized"),
        F.count_if(action.startswith("PASSED")).alias("requests_passed"),
        F.sum(F.round(F.col("injection_score") * 100).cast("bigint")).alias("cents"),
    )
    average = F.round(F.col("cents") / (F.col("total_requests") * 100.0), 4)
    return totals.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[c for c in totals.columns if c not in ("window", "cents")],
        average.alias("average_injection_score"),
    )


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A Parquet folder (or file pattern) as a stream, with the schema of what is there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run_stats(stats: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", every: int = 10) -> DataFrame:
    """Run windowed statistics over what has arrived and read the totals of all windows.

    Update mode: a batch writes the windows it changed, under its own number, so windows still open count too, state
    of windows behind the watermark is dropped, and a batch that is repeated replaces what it wrote. Every ``every``
    batches ``compact_stats`` merges them. ``late`` is that of ``stream_stats``.
    """
    writer = stats.writeStream.outputMode("update").foreachBatch(stats_writer(path, late, every))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_stats(stats.sparkSession, path)


def stats_writer(path: str, late: str, every: int) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            compact_stats(batch.sparkSession, path, number, late)

    return write


_NOTHING = {"closed": [], "open": None, "through": -1}
#: Folders of closed windows that are merged into one.
_CLOSED = 8


def _open_rows(spark: SparkSession, path: str, state: dict, through: int | None = None) -> DataFrame | None:
    """The last totals of each window that may still change, up to a batch."""
    parts = [spark.read.parquet(f"{path}/{state['open']}").withColumn("batch", F.lit(-1))] if state["open"] else []
    for name in manifest.names(spark, path):
        if name.startswith("batch=") and state["through"] < int(name[6:]) and (through is None or int(name[6:]) <= through):
            parts.append(spark.read.parquet(f"{path}/{name}").withColumn("batch", F.lit(int(name[6:]))))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    names = [c for c in rows.columns if c not in ("batch", "window_start", "window_end")]
    last = F.max_by(F.struct(*names), "batch").alias("last")
    return rows.groupBy("window_start", "window_end").agg(last).select("window_start", "window_end", "last.*")


def compact_stats(spark: SparkSession, path: str, through: int, late: str) -> None:
    """Merge the batches up to one: windows that can't change any more go to folders that are not read again until a reader
    comes, the others to one folder. Both count from the moment ``stats.json`` names them; only then the batches go.

    A window is closed if it ends ``late`` before the start of the latest window: later rows for it lie behind the
    watermark. Folders of closed windows are merged when there are many, so their number is bounded.
    """
    state = manifest.get(spark, f"{path}/stats.json") or _NOTHING
    rows = _open_rows(spark, path, state, through)
    if rows is None:
        return
    rows = rows.persist()
    latest = rows.agg(F.max("window_start")).first()[0]
    done = F.col("window_end") <= F.lit(latest) - F.expr(f"interval {late}")
    done = F.coalesce(done, F.lit(False))
    new = {"closed": list(state["closed"]), "open": f"open-{uuid.uuid4().hex}", "through": through}
    rows.where(~done).write.parquet(f"{path}/{new['open']}")
    if not rows.where(done).isEmpty():
        new["closed"].append(f"closed-{uuid.uuid4().hex}")
        rows.where(done).write.parquet(f"{path}/{new['closed'][-1]}")
    if len(new["closed"]) > _CLOSED:
        merged = f"closed-{uuid.uuid4().hex}"
        spark.read.parquet(*[f"{path}/{name}" for name in new["closed"]]).write.parquet(f"{path}/{merged}")
        new["closed"] = [merged]
    rows.unpersist()
    manifest.put(spark, f"{path}/stats.json", new)
    kept = {*new["closed"], new["open"], "stats.json"}
    for name in manifest.names(spark, path):
        if name.startswith(("open-", "closed-")) and name not in kept or name.startswith("batch=") and int(name[6:]) <= through:
            manifest.remove(spark, f"{path}/{name}")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The last totals of each window: closed ones as they are, the others from the open folder and later batches."""
    state = manifest.get(spark, f"{path}/stats.json") or _NOTHING
    rows = _open_rows(spark, path, state)
    parts = [spark.read.parquet(*[f"{path}/{name}" for name in state["closed"]])] if state["closed"] else []
    parts += [rows] if rows is not None else []
    if not parts:
        raise ValueError(f"no statistics are stored in {path}")
    return reduce(DataFrame.unionByName, parts)
