import pytest
from pyspark.sql import functions as F

from thornwall.operators import guard as G
from thornwall.operators.analyze import analyze
from thornwall.sources import content as C
from thornwall.sources import manifest
from thornwall.streaming import once as SO
from thornwall.streaming import scan as ST


def _texts(spark):
    rows = [(i, f"text {i} " + ("jailbreak" if i % 3 == 0 else "you are now x" if i % 3 == 1 else "")) for i in range(60)]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


def _content(df):
    return C.from_text(df, F.col("id").cast("string"))


def test_stream_equals_batch_and_restarts_add_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    _texts(spark).write.parquet(source)
    stream = ST.read_stream(spark, source, maxFilesPerTrigger="1")
    for _ in range(2):
        ST.write_stream(ST.stream_analyze(_content(stream)), out, checkpoint).awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).collect()))
    assert got == sorted(map(str, analyze(_content(_texts(spark))).collect()))


def test_stream_guard_separates_blocked_prompts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    _texts(spark).withColumnRenamed("text", "prompt").write.parquet(source)
    stream = ST.read_stream(spark, source, maxFilesPerTrigger="2")
    for _ in range(2):  # a restart finds nothing new
        ST.stream_guard(stream, out, checkpoint, mode="strict").awaitTermination()
    stored = spark.read.parquet(f"{out}/audit")
    assert stored.count() == 60
    assert stored.filter("sanitization_action = 'BLOCKED'").count() == 40


def test_stream_stats_cover_all_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    timed = _texts(spark).withColumn("ts", F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000))
    timed.withColumnRenamed("text", "prompt").write.parquet(source)
    stream = ST.read_stream(spark, source, maxFilesPerTrigger="1")
    stats = ST.stream_stats(G.decide(stream, "prompt", "balanced"), "ts", "1 hour", late="1 day")
    for _ in range(2):  # a restart finds nothing new
        rows = ST.run_stats(stats, str(tmp_path / "stats"), str(tmp_path / "checkpoint")).collect()
    assert sum(r.total_requests for r in rows) == 60 and sum(r.requests_sanitized for r in rows) == 40
    batch = G.decide(spark.read.parquet(source), "prompt", "balanced")
    expected = ST.stream_stats(batch, "ts", "1 hour").collect()
    assert sorted(map(str, rows)) == sorted(map(str, expected))


def _windows(spark, rows):
    return spark.createDataFrame(rows, "start long, total_requests long").select(
        F.timestamp_seconds(F.col("start") * 3600).alias("window_start"), F.timestamp_seconds(F.col("start") * 3600 + 3600).alias("window_end"), "total_requests"
    )


def _totals(spark, path):
    return {int(r.window_start.timestamp()) // 3600: r.total_requests for r in ST.read_stats(spark, path).collect()}


def test_a_hundred_batches_leave_few_folders(spark, tmp_path):
    path = str(tmp_path / "stats")
    write = ST.stats_writer(path, "2 hours", 5)
    expected, most = {}, 0
    for n in range(100):  # each batch opens a window and changes the two before it
        rows = [(n - k, 10 * (3 - k)) for k in range(3) if n >= k]
        expected.update(rows)
        write(_windows(spark, rows).coalesce(1), n)
        most = max(most, len([x for x in manifest.names(spark, path) if "=" in x or "-" in x]))
        if n % 33 == 7:
            assert _totals(spark, path) == expected
    assert _totals(spark, path) == expected and ST.read_stats(spark, path).count() == 100
    assert most <= 5 + ST._CLOSED + 3
    state = manifest.get(spark, f"{path}/stats.json")
    closed = spark.read.parquet(*[f"{path}/{name}" for name in state["closed"]])
    assert closed.count() == closed.select("window_start").distinct().count() >= 90
    write(_windows(spark, [(99, 30), (98, 20), (97, 10)]), 99)  # repeated after its compaction: counts no more
    assert _totals(spark, path) == expected


def test_a_crash_between_the_steps_of_a_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stats")
    write, expected = ST.stats_writer(path, "1 hour", 1000), {}
    for n in range(6):
        rows = [(n, 1), (n - 1, 2)]
        expected.update(rows)
        write(_windows(spark, rows).coalesce(1), n)

    def fail(*_):
        raise OSError("lost")

    for step in ("put", "remove"):
        with monkeypatch.context() as patch:
            patch.setattr(manifest, step, fail)
            with pytest.raises(OSError):
                ST.compact_stats(spark, path, 4, "1 hour")
        assert _totals(spark, path) == expected
    ST.compact_stats(spark, path, 5, "1 hour")  # what was left behind goes too
    assert _totals(spark, path) == expected
    state = manifest.get(spark, f"{path}/stats.json")
    left = [n for n in manifest.names(spark, path) if not n.endswith(".crc")]
    assert sorted(left) == sorted([*state["closed"], state["open"], "stats.json"])


class _Once:
    """A score-once store that notes which contents were scored."""

    def __init__(self, path, **options):
        self.scored = []
        self.store = SO.ScoreOnce(path, self.score, "id", content="text", **options)

    def score(self, df):
        self.scored.append(sorted(r.content_hash for r in df.collect()))
        return df.select("content_hash", F.length("text").alias("size"))


def _rows(spark, rows):
    rows = spark.createDataFrame(rows, "id long, content_hash string, text string, second long").repartition(3)
    return rows.select("id", "content_hash", "text", F.timestamp_seconds("second").alias("ts"))


def test_each_content_is_scored_once_and_every_row_comes_out(spark, tmp_path):
    once = _Once(str(tmp_path / "out"), late="100 seconds", every=3)
    batches = [
        [(n, f"h{n % 4}", "x" * (n % 4), n) for n in range(40)],
        [(100 + n, f"h{n % 6}", "x" * (n % 6), 50) for n in range(30)] + [(199, None, None, 50)],
        [(200, "h0", "", 10), (201, "h9", "xxxx", 60)],  # a late row
        [(300, "h5", "xxxxx", 100), (301, "new", "yy", 155)],
        [(400, "h1", "x", 156), (401, "h5", "xxxxx", 157)],  # h1 was last seen at 50: dropped by now
        [(500, "h1", "x", 158)],
    ]
    for n, rows in enumerate(batches):
        once.store(_rows(spark, rows), n)
    assert once.scored == [["h0", "h1", "h2", "h3"], ["h4", "h5"], ["h9"], ["new"], ["h1"], []]
    got = {r.id: r for r in once.store.read(spark).collect()}
    assert set(got) == {r[0] for rows in batches for r in rows} and once.store.read(spark).count() == len(got)
    assert all(got[r[0]]["size"] == (None if r[1] is None else len(r[2])) for rows in batches for r in rows)
    assert {got[i].scored_in for i in (0, 4, 100, 200)} == {0} and got[400].scored_in == 4 and got[500].scored_in == 4
    folders = manifest.names(spark, f"{tmp_path}/out/state")
    assert len(folders) == 1 and folders[0].startswith("base-")
    record = spark.read.parquet(f"{tmp_path}/out/state/{folders[0]}")
    assert {r.content_hash for r in record.collect()} == {"h5", "new", "h1", "h9"}


def test_repeated_batches_and_crashes_change_nothing(spark, tmp_path, monkeypatch):
    once = _Once(str(tmp_path / "out"), late="1 hour", every=2)
    batches = [_rows(spark, [(10 * b + n, f"h{n + b}", "x" * (n + b), b) for n in range(5)]) for b in range(4)]
    once.store(batches[0], 0)
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            once.store(batches[1], 1)
    before = sorted(map(str, once.store.read(spark).collect()))
    once.store(batches[1], 1)  # the stream repeats the batch: it sees the record it saw first
    assert sorted(map(str, once.store.read(spark).collect())) == before
    once.store(batches[1], 1)  # once more after its compaction: nothing is left to score
    assert once.scored == [[f"h{n}" for n in range(5)], ["h5"], ["h5"], []]
    assert sorted(map(str, once.store.read(spark).collect())) == before
    for n in (2, 3):
        once.store(batches[n], n)
    got = {r.id: r["size"] for r in once.store.read(spark).collect()}
    assert got == {10 * b + n: n + b for b in range(4) for n in range(5)}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    once = _Once(out, late="1 day", every=10)
    for part in range(2):
        _rows(spark, [(100 * part + n, f"h{n % 7}", "x" * (n % 7), n) for n in range(60)]).write.mode("append").parquet(source)
        once.store.start(ST.read_stream(spark, source, maxFilesPerTrigger="1"), checkpoint).awaitTermination()
    assert sorted(h for keys in once.scored for h in keys) == [f"h{n}" for n in range(7)]
    rows = once.store.read(spark)
    assert rows.count() == 120 and rows.where("size <> cast(substring(content_hash, 2) as int)").count() == 0


def test_a_hot_content_does_not_stay_in_one_task(spark, tmp_path):
    once = _Once(str(tmp_path / "out"))
    once.store(_rows(spark, [(n, "hot" if n % 3 else f"h{n}", "same", n) for n in range(6000)]), 0)
    assert once.store.read(spark).where("size = 4").count() == 6000
