import datetime as dt
import json

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.plans.session import shared_dir
from tidemark.sources.jdbc import read_jdbc, write_jdbc
from tidemark.sources.store import KeyedTable
from tidemark.sources.kafka import kafka_options, parse_events, read_event_files, read_kafka
from tidemark.streaming import runs, windows

BASE = dt.datetime(2024, 1, 1)


def event(seconds, ip="1", host="h"):
    time = (BASE + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return json.dumps({"ip": ip, "event_time": time, "host": host, "url": "/"})


def batch(spark, lines):
    return parse_events(spark.createDataFrame([(line,) for line in lines], "value string"))


def drain(spark, tmp_path, files, build, max_files=None):
    """Feed the files in order, run the stream to its end; what it wrote and its progress."""
    source = tmp_path / "in"
    source.mkdir()
    for n, lines in enumerate(files):
        file = source / f"{n}.json"
        file.write_text("\n".join(lines))
        stamp = 1_700_000_000 + 10 * n
        import os

        os.utime(file, (stamp, stamp))
    counts = build(read_event_files(spark, str(source), max_files))
    out = str(tmp_path / "out")
    run = runs.append_to_files(counts, out, str(tmp_path / "checkpoint"), interval=None)
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out), run.recentProgress


FAR = event(10_000_000, "far", "far")
LINES = [event(s, str(s % 3), f"h{s % 2}") for s in range(0, 5000, 37)]


@pytest.mark.parametrize("build", [windows.tumbling_counts, windows.session_counts])
def test_stream_equals_table(spark, tmp_path, build):
    stream, _ = drain(spark, tmp_path, [LINES, [FAR]], build)
    table = build(batch(spark, LINES))
    assert rows(stream, *table.columns) == rows(table)
    assert stream.count() > 0


def test_session_gap_is_exclusive(spark):
    lines = [event(0), event(299), event(599), event(599.001 - 0.001), event(899), event(1199)]
    found = windows.session_counts(batch(spark, lines))
    # 0 and 299 are together; 599 comes exactly five minutes later and starts a session.
    assert [r.num_logs for r in found.orderBy("window_start").collect()] == [2, 2, 1, 1]
    ends = [r.window_end for r in found.orderBy("window_start").collect()]
    assert ends[0] == BASE + dt.timedelta(seconds=599)


@pytest.mark.parametrize("max_rows", [3, 20])
def test_cut_sessions_equal_spark_session_windows(spark, max_rows):
    import random

    rng = random.Random(19)
    lines = [
        event(rng.choice([rng.randrange(300), rng.randrange(100_000)]), rng.choice("1112"), None)
        for _ in range(400)
    ]
    table = batch(spark, lines)
    expected = (
        table.groupBy(F.session_window("window_timestamp", "5 minutes"), "ip", "host")
        .count()
        .select("ip", "host", "session_window.start", "session_window.end", "count")
    )
    found = windows.session_counts(table, max_rows=max_rows)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("build", [windows.tumbling_counts, windows.session_counts])
def test_late_event_is_dropped(spark, tmp_path, build):
    """The watermark filters one batch after it has risen, so the late event comes in the third."""
    files = [[event(3600)], [event(3610)], [event(0)], [FAR]]
    stream, progress = drain(spark, tmp_path, files, build, max_files=1)
    dropped = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    assert dropped == 1
    assert sum(r.num_logs for r in stream.collect()) == 2


def test_foreach_batch_sink(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join([*LINES, FAR]))
    counts = windows.tumbling_counts(read_event_files(spark, str(source)))
    target = str(tmp_path / "table")

    def write(rows, options):
        rows.write.mode("append").parquet(options["dbtable"])

    run = runs.append_to_jdbc(
        counts, {"dbtable": target}, str(tmp_path / "checkpoint"), interval=None, write=write
    )
    run.awaitTermination()
    expected = windows.tumbling_counts(batch(spark, LINES))
    assert rows(spark.read.parquet(target)) == rows(expected)


def test_unreadable_messages_do_not_stop_the_stream(spark):
    found = batch(spark, ["no json", '{"ip": "1", "event_time": "yesterday"}', event(0)])
    assert sorted(r.window_timestamp is None for r in found.collect()) == [False, True, True]
    assert windows.tumbling_counts(found).count() == 1


def test_average_session_size(spark):
    sessions = spark.createDataFrame(
        [("1", "a.example", 1), ("1", "a.example", 2), ("2", "a.example", 4), ("1", "b.test", 10)],
        "ip string, host string, num_logs long",
    )
    assert rows(windows.average_session_size(sessions, host_like="%example%")) == [
        ("1", "a.example", 1.5, 1), ("2", "a.example", 4.0, 4)
    ]
    by_host = windows.average_session_size(sessions, ["host"])
    assert [(h, round(a, 6), i) for h, a, i in rows(by_host)] == [("a.example", 2.333333, 2), ("b.test", 10.0, 10)]


def test_kafka_options():
    plain = kafka_options("host:1", "topic")
    assert plain["startingOffsets"] == "latest" and "kafka.sasl.mechanism" not in plain
    secure = kafka_options("host:1", "topic", "group", "name", "secret")
    assert secure["kafka.security.protocol"] == "SASL_SSL"
    assert secure["kafka.group.id"] == "group"
    assert 'username="name" password="secret"' in secure["kafka.sasl.jaas.config"]


def test_wrappers_reach_their_sources(spark):
    """Neither package is here: what fails is the lookup of the source or driver, by its name."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_kafka(spark, kafka_options("host:1", "topic"))
    options = {"url": "jdbc:none://nowhere/db", "dbtable": "t"}
    with pytest.raises(Exception, match="(?i)driver"):
        read_jdbc(spark, options)
    with pytest.raises(Exception, match="(?i)driver"):
        write_jdbc(spark.range(1), options)


def test_shared_folder_for_checkpoints(spark):
    assert shared_dir(spark, "stream")
    assert "HashAggregate" in plan(windows.tumbling_counts(batch(spark, LINES)))


def test_updates_by_key_survive_a_repeated_batch(spark, tmp_path):
    """Each file changes windows of the one before; the last batch is sent again, as after a crash."""
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(LINES[n::3]))
    counts = windows.tumbling_counts(read_event_files(spark, str(source), 1), lateness=None)
    table = KeyedTable(spark, str(tmp_path / "table"), counts.schema, ["ip", "host", "window_start"], 4)
    checkpoint = tmp_path / "checkpoint"
    runs.upsert_to_table(counts, table, str(checkpoint), interval=None).awaitTermination()
    want = windows.tumbling_counts(batch(spark, LINES))
    assert rows(table.read()) == rows(want)
    version = table.log.latest()
    assert version == 3
    for name in ("2", ".2.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    run = runs.upsert_to_table(counts, table, str(checkpoint), interval=None)
    run.awaitTermination()
    assert [p.batchId for p in run.recentProgress if p.numInputRows] == [2]
    assert table.log.latest() == version and rows(table.read()) == rows(want)


def test_running_sums_count_each_batch_once(spark, tmp_path):
    """Sessions finish in several batches; a batch that is sent again is not added again."""
    source = tmp_path / "in"
    source.mkdir()
    import os

    parts = [LINES[at : at + 34] for at in range(0, len(LINES), 34)]
    for n, lines in enumerate([*parts, [FAR]]):
        (source / f"{n}.json").write_text("\n".join(lines))
        os.utime(source / f"{n}.json", (1_700_000_000 + 10 * n,) * 2)
    sessions = windows.session_counts(read_event_files(spark, str(source), 1), gap="60 seconds")
    schema = spark.createDataFrame([], "host string, sessions bigint, logs bigint").schema
    table = KeyedTable(spark, str(tmp_path / "table"), schema, ["host"], 4)
    checkpoint = tmp_path / "checkpoint"

    def run():
        sums = lambda batch: windows.session_sums(batch, ["host"])
        runs.upsert_to_table(sessions, table, str(checkpoint), None, "append", sums).awaitTermination()

    run()
    want = windows.average_session_size(windows.session_counts(batch(spark, LINES), gap="60 seconds"), ["host"])
    assert rows(windows.averages_of_sums(table.read())) == rows(want)
    assert table.log.latest() > 2
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    run()
    assert rows(windows.averages_of_sums(table.read())) == rows(want)
