"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.config import shared_folder
from thornwall.operators.keyed import free_name, looked_up  # noqa: F401


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the cluster's shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and the name of that column, which none of them has."""
    name = free_name(docs, "row")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def text_bytes(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null becomes the empty text."""
    return [value or b"" for value in column.cast("binary").to_pylist()]


def _trees(edges: DataFrame) -> DataFrame:
    """(node, root): the components of few edges, found by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if batch.num_rows]
        if not held:
            return
        ends = [np.concatenate(side) for side in zip(*held, strict=True)]
        nodes = np.unique(np.concatenate(ends))
        a, b = (np.searchsorted(nodes, side) for side in ends)
        parent = np.arange(len(nodes))
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, few: int = 1 << 20) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root), the root being one node of the component.

    Each round every node goes to the neighbour (or itself) with the smallest hash, by another hash each round, and the
    edges are contracted. Whatever the order of the nodes, about half of them or fewer are left, so rounds grow with the
    logarithm of the longest chain; once at most ``few`` edges are left, one task ends it. Rounds are written to the
    shared folder and composed at the end. A node with many edges is spread. Nodes without an edge to another node are not
    in the result. Null ends are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    maps: list[DataFrame] = []
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while edges.count() > few:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.xxhash64(F.lit(len(maps)), F.col(side)) for side in ("a", "b"))
        near = both.select(F.col("a").alias("node"), "b", own.alias("own"), other.alias("other"))
        lowest = near.groupBy("node", "own").agg(F.min("other").alias("least"), F.min_by("b", "other").alias("b"), F.count("*").alias("many"))
        up = written(lowest.select("node", F.when(F.col("own") <= F.col("least"), F.col("node")).otherwise(F.col("b")).alias("up"), "many"), "up")
        maps.append(up.select("node", "up"))
        moved = looked_up(edges, up.toDF("a", "ua", "many"), "a", "b").drop("many")
        moved = looked_up(moved, up.toDF("b", "ub", "many"), "b", "a").where("ua <> ub")
        edges = written(moved.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct(), "edges")
    result = written(_trees(edges), "trees")
    for up in reversed(maps):
        result = up.join(result.toDF("up", "root"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return result


def some_of_each(rows: DataFrame, group: str, many: int, groups: int = 64) -> list[tuple]:
    """(id, group) of the ``many`` ids of each group whose hashes are smallest, for fitting a model.

    ``rows`` has the columns id and ``group``, without nulls. Groups are counted first, and only hashes below a bound
    that some twice ``many`` ids of a group meet go on to be ranked, so no task sorts a whole group.
    """
    ids = rows.select("id", F.col(group).alias("side")).distinct()
    counts = ids.groupBy("side").count().limit(groups + 1).collect()
    if len(counts) > groups:
        raise ValueError(f"more than {groups} values of {group}")
    if not counts:
        return []
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    shares = {side: (2 * many + 10 * many**0.5) / count for side, count in counts if count > 4 * many}
    low = F.lit(True)
    if shares:
        bound = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("side")]
        low = F.col("place") < F.coalesce(bound, F.lit(2.0))
    order = Window.partitionBy("side").orderBy("place", "id")
    ranked = ids.withColumn("place", place).where(low).withColumn("n", F.row_number().over(order))
    return [(row.id, row.side) for row in ranked.where(F.col("n") <= many).select("id", "side").collect()]


def file_system(uri: str):
    """(file system, path) for a folder or file of the shared storage, for tasks that write their own formats."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return FileSystem.from_uri(uri)


def task_name() -> tuple[int, int]:
    """(partition, attempt) of the running task; attempts differ, so a repeated task never meets its old file."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), task.taskAttemptId()
