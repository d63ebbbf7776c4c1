"""Streams that score each content once: rows with known content take the score that is on record."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thornwall.operators.keyed import looked_up
from thornwall.sources import manifest


class ScoreOnce:
    """Writes every row of a stream with the scores of its content, which is scored when it is first seen.

    ``score`` gets (key, content) with one row per key and returns key and score columns. Scores stay on record while the
    content keeps coming: a key that was last seen more than ``late`` before the latest time on record is dropped, and
    scored anew should it come back, so the record is bounded by the contents of that span. Late rows come out like any
    other. Rows with a null key have null scores; a null time keeps nothing on record beyond its batch.

    Each batch writes ``rows/batch=N`` and its keys to ``state/batch=N``, then, every ``every`` batches, one merged record
    takes the place of the others in one step (``state.json``). A batch that is repeated sees the record that it saw
    first, and replaces what it wrote.
    """

    def __init__(
        self,
        path: str,
        score: Callable[[DataFrame], DataFrame],
        id_col: str,
        time: str = "ts",
        late: str = "1 day",
        key: str = "content_hash",
        content: str = "text",
        every: int = 10,
    ) -> None:
        self.path, self.score, self.id_col, self.time = path, score, id_col, time
        self.late, self.key, self.content, self.every = late, key, content, every

    def _record(self, spark: SparkSession, before: int) -> DataFrame | None:
        """(key, seen, scored_in, scores) as it was before a batch."""
        state = manifest.get(spark, f"{self.path}/state.json") or {"base": None, "through": -1}
        folders = [f"{self.path}/state/{state['base']}"] if state["base"] else []
        for name in manifest.names(spark, f"{self.path}/state"):
            if name.startswith("batch=") and state["through"] < int(name[6:]) < before:
                folders.append(f"{self.path}/state/{name}")
        if not folders:
            return None
        rows = spark.read.parquet(*folders)
        last = F.max_by(F.struct("scored_in", "scores"), "written").alias("last")
        merged = rows.groupBy(self.key).agg(F.max("seen").alias("seen"), last)
        merged = merged.select(self.key, "seen", "last.scored_in", "last.scores")
        latest = rows.agg(F.max("seen")).first()[0]
        horizon = F.lit(latest) - F.expr(f"interval {self.late}")
        return merged.where(F.col("seen") >= horizon)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Process a batch of the stream."""
        spark, key = batch.sparkSession, self.key
        batch = batch.persist()
        known = batch.where(F.col(key).isNotNull())
        keys = known.groupBy(key).agg(F.max(self.time).alias("now"), F.count(F.lit(1)).alias("many"), F.first(self.content).alias(self.content))
        record = self._record(spark, number)
        fresh = keys if record is None else keys.join(record, key, "left_anti")
        scored = self.score(fresh.select(key, self.content))
        names = [c for c in scored.columns if c != key]
        scored = scored.select(key, F.lit(number).cast("long").alias("scored_in"), F.struct(*names).alias("scores"))
        counts = keys.select(key, "now", "many")
        entries = counts.join(scored, key).select(key, F.col("now").alias("seen"), "scored_in", "scores", "many")
        if record is not None:
            old = counts.join(record, key).select(key, F.greatest("now", "seen").alias("seen"), "scored_in", "scores", "many")
            entries = entries.unionByName(old)
        folder = f"{self.path}/state/batch={number}"
        entries.withColumn("written", F.lit(number).cast("long")).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder).select(key, "scored_in", "scores", "many")
        rows = looked_up(batch.drop(self.content), found, key, self.id_col)
        rows.select(*[c for c in batch.columns if c != self.content], "scored_in", "scores.*").write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        batch.unpersist()
        if (number + 1) % self.every == 0:
            self.compact(spark, number)

    def compact(self, spark: SparkSession, through: int) -> None:
        """Merge the record up to a batch; what it replaces goes once the new one counts."""
        record = self._record(spark, through + 1)
        if record is None:
            return
        base = f"base-{uuid.uuid4().hex}"
        record.withColumn("written", F.lit(through).cast("long")).write.parquet(f"{self.path}/state/{base}")
        manifest.put(spark, f"{self.path}/state.json", {"base": base, "through": through})
        for name in manifest.names(spark, f"{self.path}/state"):
            if name != base and (not name.startswith("batch=") or int(name[6:]) <= through):
                manifest.remove(spark, f"{self.path}/state/{name}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows written so far, with their batch."""
        return spark.read.parquet(f"{self.path}/rows")
