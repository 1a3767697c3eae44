"""Late rows are dropped by the watermark and counted; batch twin equality is in test_parity."""

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from valuescope.sources.tables import SCHEMAS
from valuescope.streaming import streams as S


def _write(spark, folder, name, rows):
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    pdf["ts"] = pd.to_datetime(pdf["ts"])
    spark.createDataFrame(pdf, schema=SCHEMAS["events"]).coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_rows_dropped_and_counted(spark):
    src = tempfile.mkdtemp(prefix="vs-late-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="vs-late-out-", dir="/tmp")
    _write(spark, src, "b1", [(1, "2024-01-10 10:00:00", 1, "purchase", 5.0, "{}"),
                              (2, "2024-01-12 10:00:00", 1, "purchase", 7.0, "{}")])
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
              .parquet(f"{src}/*"))
    agg = (S.with_event_time(stream).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"))
           .agg(F.count(F.lit(1)).alias("n")))
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    # second file: one on-time row and one far behind the watermark (event time 2024-01-01)
    _write(spark, src, "b2", [(3, "2024-01-12 11:00:00", 2, "click", 0.0, "{}"),
                              (4, "2024-01-01 09:00:00", 2, "click", 0.0, "{}")])
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress if p.get("stateOperators"))
    assert dropped == 1
    got = spark.read.parquet(f"{out}/data")
    assert got.where(F.col("window.start").cast("date") == "2024-01-01").count() == 0


def test_stream_score_scores_every_purchase_once(spark):
    from .conftest import SMALL
    out = S.stream_score(spark, SMALL)
    ev = spark.read.parquet(f"{SMALL}/events.parquet").where("event_type = 'purchase'")
    assert out.count() == ev.count()
    assert out.select("event_id").distinct().count() == ev.count()
    assert out.where("predicted_ltv30 < 0").count() == 0


def _replay(spark, job, batches):
    """Run ``job(spark, events, paths)`` once for each batch, as restarts of one stream."""
    src = tempfile.mkdtemp(prefix="vs-replay-", dir="/tmp")
    paths = S._paths(spark, "replay")
    out = None
    for k, rows in enumerate(batches):
        _write(spark, src, f"b{k}", rows)
        out = job(spark, spark.readStream.schema(SCHEMAS["events"]).parquet(f"{src}/*"), paths)
    return out, paths


BATCHES = [
    [(1, "2024-01-10 10:00:00", 1, "purchase", 5.10, "{}"), (2, "2024-01-10 10:20:00", 1, "click", 7.0, "{}"),
     (3, "2024-01-10 11:10:00", 1, "purchase", 0.20, "{}"), (4, "2024-01-10 09:00:00", 2, "signup", 1.0, "{}"),
     (5, "2024-01-12 23:00:00", 2, "purchase", 3.0, "{}"), (5, "2024-01-12 23:00:00", 2, "purchase", 3.0, "{}")],
    # late but within the watermark: it bridges two sessions of user 3, and one row is far too late
    [(6, "2024-01-12 22:00:00", 3, "click", 1.0, "{}"), (7, "2024-01-12 22:50:00", 3, "purchase", 9.99, "{}"),
     (8, "2024-01-01 08:00:00", 1, "purchase", 100.0, "{}"), (9, "2024-01-13 04:00:00", None, "purchase", 2.0, "{}")],
    [(10, "2024-01-12 22:25:00", 3, "click", 1.0, "{}"), (11, "2024-01-12 21:45:00", 3, "error", 1.0, "{}"),
     (12, "2024-01-25 01:00:00", 2, "purchase", 4.0, "{}")],
]
KEPT = [r for b in BATCHES for r in b if r[0] != 8]


def _static(spark, rows):
    folder = tempfile.mkdtemp(prefix="vs-kept-", dir="/tmp")
    _write(spark, folder, "events.parquet", rows)
    return folder


def _duck(folder, name):
    import duckdb

    from valuescope import catalog
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return con.execute(catalog.load_all()[name].sql)


def _same(df, cur):
    names = [d[0] for d in cur.description]
    assert set(names) == set(df.columns)
    plain = lambda r: tuple(str(x) for x in r)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, cur.fetchall()))


def test_batches_with_late_and_repeated_rows_equal_the_batch_twin(spark):
    folder = _static(spark, KEPT)
    for job, name in ((S.daily_kpis, "stream_daily_kpis"), (S.sessions, "stream_sessions"), (S.checkpoints, "stream_checkpoints")):
        got, _ = _replay(spark, job, BATCHES)
        _same(got, _duck(folder, name))


def test_a_repeated_epoch_gives_the_same_rows(spark):
    got, (_, out) = _replay(spark, S.daily_kpis, BATCHES)
    before = sorted(map(str, got.collect()))
    again = S.epoch_writer(out)
    for epoch in (0, 1):
        again(spark.createDataFrame(spark.read.parquet(f"{out}/epoch={epoch}").collect(), spark.read.parquet(f"{out}/epoch={epoch}").schema), epoch)
    assert sorted(map(str, S.latest_by_key(spark, out, ["day"]).collect())) == before


def _state(spark, chk, var):
    return spark.read.format("statestore").option("stateVarName", var).load(chk)


def test_state_of_checkpoints_is_empty_after_the_seventh_day(spark):
    _, (chk, _) = _replay(spark, S.checkpoints, BATCHES[:1])
    assert _state(spark, chk, "days").count() > 0
    _, (chk, _) = _replay(spark, S.checkpoints, [*BATCHES, [(13, "2024-02-20 01:00:00", 1, "click", 4.0, "{}")]])
    assert _state(spark, chk, "days").count() == 0


def test_state_of_sessions_is_bounded_by_the_watermark(spark):
    _, (chk, _) = _replay(spark, S.sessions, BATCHES)
    left = _state(spark, chk, "open").count()
    assert left == 1  # the session of the last day; the others ended before the watermark


def test_late_counts_agree_with_the_watermark_of_spark(spark):
    src = tempfile.mkdtemp(prefix="vs-late2-", dir="/tmp")
    _write(spark, src, "events.parquet", BATCHES[0])
    rows, dropped = [], []
    paths, own = S._paths(spark, "late"), S._paths(spark, "dedup")
    for k, b in enumerate(BATCHES):
        _write(spark, src, f"in/{k}", b)
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{src}/in/*")
        rows = S.late_counts(spark, stream, paths).orderBy("epoch").collect()
        q = (S.with_event_time(stream).withWatermark("ts", S.WATERMARK).dropDuplicates(["event_id", "ts"]).writeStream.format("parquet")
             .option("path", own[1]).option("checkpointLocation", own[0]).trigger(availableNow=True).start())
        q.awaitTermination()
        dropped.append(sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p.get("stateOperators")))
    assert [r["dropped"] for r in rows] == dropped == [0, 1, 0]
    assert [(r["n_rows"], r["on_time"], r["late_kept"]) for r in rows] == [(6, 6, 0), (4, 1, 2), (3, 1, 2)]


class _Store:
    """A state store that counts its calls: value states, map states and timers of one key."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def _call(self, put=None, gone=None):
        self.calls += 1
        if put:
            self.kept[put[0]] = put[1]
        self.kept.pop(gone, None)

    def getValueState(self, *_):  # noqa: N802
        from types import SimpleNamespace
        return SimpleNamespace(get=lambda: (self._call(), self.kept.get(0))[1], exists=lambda: (self._call(), 0 in self.kept)[1],
                               update=lambda v: self._call(put=(0, v)), clear=lambda: self._call(gone=0))

    def getMapState(self, *_):  # noqa: N802
        from types import SimpleNamespace
        return SimpleNamespace(iterator=lambda: (self._call(), iter(list(self.kept.items())))[1], removeKey=lambda k: self._call(gone=k),
                               updateValue=lambda k, v: self._call(put=(k, v)))

    def registerTimer(self, at):  # noqa: N802
        self._call()
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self._call()
        self.timers.discard(at)


def test_calls_of_the_state_store_do_not_grow_with_the_sessions_of_a_user():
    from types import SimpleNamespace
    gap, store, job = S.GAP_US, _Store(), S.Sessions()
    job.init(store)
    runs = [SimpleNamespace(start=2 * k * gap, stop=(2 * k + 1) * gap, n=1, cents=k) for k in range(100)]
    assert len(list(job.handleInputRows((1,), iter(runs), None))) == 100
    assert store.calls <= 4 and len(store.timers) == 1
    # the run between two of them joins both; what ended by the watermark goes, the others stay with one timer
    bridge = SimpleNamespace(start=101 * gap - 1, stop=102 * gap + 1, n=1, cents=5)
    got = {(r.start, r.stop, r.n, r.cents) for r in job.handleInputRows((1,), iter([bridge]), None)}
    assert got == {(100 * gap, 103 * gap, 3, 106), (102 * gap, 102 * gap, 0, 0)}
    mark = 150 * gap // 1000
    for at in [t for t in sorted(store.timers) if t <= mark]:
        store.timers.discard(at)
        list(job.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
    assert len(store.timers) == 1 and min(job._held()[0]) == 150 * gap
    assert store.calls <= 12
