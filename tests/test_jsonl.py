"""The JSON-lines source: ranges, half-written lines, time slices, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from panelforge.sources import jsonl

SCHEMA = "at string, n long, note string"


@pytest.fixture(scope="module")
def logs(spark):
    jsonl.register(spark)
    return spark


def write(path, rows, mode="a", tail="\n"):
    with open(path, mode) as f:
        f.write("\n".join(json.dumps(r) for r in rows) + tail)


def row(n):
    return {"at": f"2024-01-{n % 28 + 1:02d}", "n": n, "note": "é" * (n % 50), "other": [1]}


@pytest.mark.parametrize("size", [1, 7, 100, 32 << 20])
def test_each_line_once_whatever_the_ranges(logs, tmp_path, size):
    write(tmp_path / "a.jsonl", [row(n) for n in range(40)])
    write(tmp_path / "b.json", [row(n) for n in range(40, 60)], tail="")  # no end of the last line
    write(tmp_path / "_tmp.json", [row(99)])
    (tmp_path / "c.jsonl").write_text("\n\n" + json.dumps({"n": 60}) + "\n\n")
    got = logs.read.format("jsonlog").schema(SCHEMA).option("rangeBytes", max(size, 5)).load(str(tmp_path)).collect()
    assert sorted(r.n for r in got) == list(range(61)) and all(r.note == "é" * (r.n % 50) for r in got if r.n < 60)
    assert [r.at for r in got if r.n == 60] == [None]
    assert logs.read.format("jsonlog").schema(SCHEMA).load(str(tmp_path / "none")).count() == 0


def test_time_slices_are_pushed_and_files_outside_not_opened(logs, tmp_path):
    write(tmp_path / "2024-01-01_2024-01-10.jsonl", [row(n) for n in range(9)])
    (tmp_path / "2024-02-01_2024-03-01.jsonl").write_text("this is no JSON\n")
    read = logs.read.format("jsonlog").schema(SCHEMA).option("timeColumn", "at").load(str(tmp_path))
    part = read.filter("at >= '2024-01-03' and at < '2024-01-05' and n <> 3")
    assert [r.n for r in part.collect()] == [2]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PythonFilter" in plan or ">=" not in plan.split("BatchScan")[0]


def test_stream_reads_what_is_added(logs, tmp_path):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()

    def run(**options):
        read = logs.readStream.format("jsonlog").schema(SCHEMA).options(timeColumn="at", **options).load(str(folder))
        sink = read.writeStream.foreachBatch(lambda b, _: seen.extend(r.n for r in b.collect()))
        q = sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        found, seen[:] = sorted(seen), []
        return found

    write(folder / "a.jsonl", [row(n) for n in range(5)])
    whole = json.dumps(row(5))
    with open(folder / "a.jsonl", "a") as f:
        f.write(whole[:20])
    assert run() == [0, 1, 2, 3, 4]  # the half-written line waits
    with open(folder / "a.jsonl", "a") as f:
        f.write(whole[20:] + "\n")
    write(folder / "b.jsonl", [row(n) for n in range(6, 9)])
    assert run() == [5, 6, 7, 8]
    write(folder / "b.jsonl", [row(9), row(20)])
    assert run(**{"from": "2024-01-05", "until": "2024-01-15"}) == [9]
    assert logs.read.format("jsonlog").schema(SCHEMA).load(str(folder)).agg(F.count("*")).first()[0] == 11
