"""Streams on files: late bars, replayed batches, positions with sells and restarts."""

from datetime import datetime, timedelta
from pathlib import Path

from panelforge.streaming import bars as S

DAY = 86_400_000
BARS = "pair string, open_time long, close double, seq long"


def bars_at(spark, rows):
    return spark.createDataFrame(rows, BARS)


def read(spark, path):
    return {(r.pair, r.open_time): r.close for r in S.stored_bars(spark, path).collect()}


def parts(path, day):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).glob(f"day={day}/**/*.parquet")}


def test_late_bars_touch_only_their_days(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert S.stored_bars(spark, path) is None
    S.upsert_batch(bars_at(spark, [("A", 0, 1.0, 1), ("A", 0, 2.0, 2), ("B", DAY, 3.0, 1), ("A", 2 * DAY, 4.0, 1)]), 0, path, "seq")
    assert read(spark, path) == {("A", 0): 2.0, ("B", DAY): 3.0, ("A", 2 * DAY): 4.0}
    first, second = parts(path, "1970-01-01"), parts(path, "1970-01-02")
    late = bars_at(spark, [("B", DAY, 5.0, 2), ("B", DAY + 1, 6.0, 1), ("C", 3 * DAY, 7.0, 1)])
    S.upsert_batch(late, 1, path, "seq")
    want = {("A", 0): 2.0, ("B", DAY): 5.0, ("B", DAY + 1): 6.0, ("A", 2 * DAY): 4.0, ("C", 3 * DAY): 7.0}
    assert read(spark, path) == want and parts(path, "1970-01-01") == first and set(second) <= set(parts(path, "1970-01-02"))
    S.upsert_batch(late, 1, path, "seq")  # replayed
    assert read(spark, path) == want
    S.upsert_batch(bars_at(spark, [("B", DAY, 0.5, 1)]), 2, path, "seq")  # an older sequence number arrives last
    assert read(spark, path) == want and not any("v=0" in p for p in parts(path, "1970-01-02"))


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    S.upsert_batch(bars_at(spark, [("A", 0, 1.0, 1)]), 0, path, "seq")

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(S.files, "mark", fail)
    try:
        S.upsert_batch(bars_at(spark, [("A", 0, 9.0, 2)]), 1, path, "seq")
    except OSError:
        pass
    monkeypatch.undo()
    assert read(spark, path) == {("A", 0): 1.0}
    S.upsert_batch(bars_at(spark, [("A", 0, 9.0, 2)]), 1, path, "seq")
    assert read(spark, path) == {("A", 0): 9.0}


def test_upserts_of_a_stream(spark, tmp_path):
    for k, rows in enumerate([[("A", 0, 1.0, 1), ("A", 1, 1.5, 1)], [("A", 0, 2.0, 2)]]):
        bars_at(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(BARS).parquet(str(tmp_path / "in"))
        assert S.upsert_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "seq").awaitTermination(120)
    assert read(spark, str(tmp_path / "out")) == {("A", 0): 2.0, ("A", 1): 1.5}


def test_positions_buy_sell_restart_expire(spark, tmp_path):
    start, seen = datetime(2024, 1, 1), []

    def feed(*fills):
        """Each call is one batch of a query that is started again from its checkpoint."""
        rows = [(p, start + timedelta(days=d), n, s, float(q), float(x)) for n, (p, d, s, q, x) in enumerate(fills)]
        table = spark.createDataFrame(rows, "pair string, ts timestamp, seq long, side string, quantity double, price double")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = S.running_positions(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), idle_ms=10 * DAY)
        sink = out.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect())))
        assert sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
        found, seen[:] = sorted(seen), []
        return found

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        assert feed(("A", 0, "BUY", 2, 10), ("A", 0, "BUY", 2, 20), ("B", 1, "BUY", 1, 5)) == [("A", 4.0, 60.0, False), ("B", 1.0, 5.0, False)]
        assert feed(("A", 2, "SELL", 1, 30)) == [("A", 3.0, 45.0, False)]
        assert feed(("B", 3, "SELL", 9, 1), ("A", 3, "SELL", 1.5, 1)) == [("A", 1.5, 22.5, False), ("B", 0.0, 0.0, False)]
        later = feed(("C", 30, "BUY", 1, 1)) + feed(("C", 31, "BUY", 1, 1))
        assert ("A", 1.5, 22.5, True) in later and ("B", 0.0, 0.0, True) in later and ("C", 2.0, 2.0, False) in later
        assert feed(("A", 32, "BUY", 1, 7)) == [("A", 1.0, 7.0, False)]  # starts anew
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
