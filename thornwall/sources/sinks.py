"""Sinks for results.

Analyses are stored by run. A run is one folder of files in buckets of ids, and a manifest that names it: writing a run
again replaces the manifest, and with it all of the run, in one step.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwall.sources import manifest

BUCKETS = 16


def runs(spark: SparkSession, path: str) -> list[dict]:
    """The committed runs of a store (run, number, folder, buckets), by number."""
    found = [manifest.get(spark, f"{path}/runs/{name}") for name in manifest.names(spark, f"{path}/runs") if name.endswith(".json")]
    return sorted((run for run in found if run), key=lambda run: (run["number"], run["run"]))


def _bucket(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def write_analysis(analysis: DataFrame, path: str, run: str, number: int | None = None, buckets: int = BUCKETS) -> None:
    """Store the analyses of one run; earlier runs stay.

    A run that is written again is replaced as a whole, whatever rows and categories it had, and keeps its number; a new
    run gets the next ``number`` unless one (a counter or a time) is given. ``buckets`` is fixed by the first run. Folders of
    replaced runs stay readable for jobs that use them until ``remove_replaced``.
    """
    spark = analysis.sparkSession
    known = {r["run"]: r for r in runs(spark, path)}
    buckets = next(iter(known.values()))["buckets"] if known else buckets
    if number is None:
        number = known[run]["number"] if run in known else 1 + max((r["number"] for r in known.values()), default=0)
    folder = f"{path}/data/set={uuid.uuid4().hex}"
    rows = analysis.withColumns({"run": F.lit(run), "run_number": F.lit(number).cast("long"), "bucket": _bucket(F.col("analysis_id"), buckets)})
    rows = rows.hint("rebalance", F.col("bucket"))  # a few files per bucket, large buckets in several
    rows.write.option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(folder)
    entry = {"run": run, "number": number, "folder": folder.removeprefix(f"{path}/"), "buckets": buckets}
    manifest.put(spark, f"{path}/runs/{quote(run, safe='')}.json", entry)


def read_analysis(spark: SparkSession, path: str, latest: bool = False, ids: list[str] | None = None) -> DataFrame:
    """The stored analyses with their run and run_number.

    ``latest`` keeps of each id the row of the run with the largest number. ``ids`` reads only the buckets of these ids.
    """
    known = runs(spark, path)
    if not known:
        raise ValueError(f"no run is stored in {path}")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/{run['folder']}" for run in known])
    if ids is not None:
        wanted = [_bucket(F.lit(i), known[0]["buckets"]) for i in ids]
        rows = rows.where(F.col("bucket").isin(wanted) & F.col("analysis_id").isin(list(ids)))
    if latest:
        # numbers first; the texts of other runs are left where they are
        newest = rows.groupBy("analysis_id").agg(F.max("run_number").alias("run_number"))
        rows = rows.join(newest, ["analysis_id", "run_number"], "left_semi")
    return rows.drop("bucket", "set")


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that no run names (replaced runs, and jobs that died before their manifest); returns their names.

    Run it when no job writes to the store.
    """
    used = {run["folder"].rsplit("/", 1)[1] for run in runs(spark, path)}
    gone = [name for name in manifest.names(spark, f"{path}/data") if name not in used]
    for name in gone:
        manifest.remove(spark, f"{path}/data/{name}")
    return gone


def write_reports(reports: DataFrame, path: str) -> None:
    """Store rendered reports by id."""
    reports.select("report_id", "analysis_id", "report_html").write.mode("overwrite").parquet(path)
