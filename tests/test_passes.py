"""The passes and the stale-event filter as streams, under shuffled micro-batches and restarts."""

import random

import duckdb
import pytest

from tessera.plans import event_queries
from tessera.streaming import passes

EVENTS = "path long, seq long, stage string, epoch long"


def plain_passes(events):
    out = {}
    for path in {e[0] for e in events if e[0] is not None}:
        of = lambda stage, p=path: [e[1] for e in events if e[0] == p and e[2] == stage]
        gone = min(of("error"), default=passes.NEVER)
        first = min((s for s in of("transcribe") if s < gone), default=None)
        if first is not None:
            out[path] = (first, min((s for s in of("summarize") if first < s < gone), default=None))
    return out


def plain_kept(events):
    out = {}
    for path in {e[0] for e in events if e[0] is not None}:
        own = [e for e in events if e[0] == path]
        current = max(own, key=lambda e: e[1])[3]
        of_epoch = [e[1] for e in own if e[3] == current]
        out[path] = (len(of_epoch), max(of_epoch))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_equal_the_batch_forms(spark, tmp_path, seed):
    rng = random.Random(seed)
    stages = ["transcribe"] * 3 + ["summarize"] * 5 + ["error", "other"]
    events = [(rng.choice([*range(12), None]), seq, rng.choice(stages), rng.choice([1, 2, 3])) for seq in range(300)]
    events += [(50, 1, "summarize", 1), (51, 5, "error", 2), (51, 7, "transcribe", 2), (52, 9, "transcribe", None), (52, 8, "summarize", None)]
    rng.shuffle(events)
    parts = [events[:3], events[3:120], events[120:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if k == 0:
            continue
        seen = [e for p in parts[: k + 1] for e in p]
        got = passes.run(spark, passes.two_pass(stream()), str(tmp_path / "two")).where("first_pass IS NOT NULL").collect()
        assert {r.path: (r.first_pass, r.full_pass) for r in got} == plain_passes(seen)
        got = passes.run(spark, passes.stale_drop(stream()), str(tmp_path / "stale")).collect()
        assert {r.path: (r.kept, r.seq) for r in got} == plain_kept(seen)


def test_filter_counts_in_spark_and_sends_no_row_to_python(spark, tmp_path):
    events = [(1, s, "other", s % 1000) for s in range(20_000)] + [(2, 5, "other", -1), (2, 4, "other", None), (3, 1, "other", 7), (3, None, "other", 7), (4, None, "other", 7), (None, 1, "other", 7)]
    late = [(1, 3, "other", 999), (1, 4, "other", 5), (2, 3, "other", -1), (3, None, "other", 8)]
    for k, part in enumerate((events, late)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = passes.stale_drop(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
        got = {r.path: (r.kept, r.seq) for r in passes.run(spark, stream, str(tmp_path / "out")).collect()}
        assert got == {1: (20 + k, 19_999), 2: (1 + k, 5), 3: (2, 1)}
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [path" in plan and "WithState" not in plan


def test_filter_of_a_stream_that_has_nothing_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = passes.stale_drop(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    assert passes.run(spark, stream, str(tmp_path / "out")).collect() == []


def test_filter_query_equals_its_sql_with_nulls(spark, tmp_path):
    rows = [(1, 1, 1), (2, 1, 2), (3, 1, None), (None, 1, 2), (4, 2, None), (5, None, 1), (6, 3, -1), (5, 3, None), (None, 4, 3)]
    values = ", ".join(f"({e}, {u}, {k})".replace("None", "NULL") for e, u, k in rows)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT e::BIGINT AS event_id, u::BIGINT AS user_id, 'click' AS event_type, 1.5::DOUBLE AS value, '{{\"k\": ' || k || '}}' AS props FROM (VALUES {values}) t(e, u, k)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.execute(event_queries._STALE).fetchall()
    assert sorted(want) == [(1, 2, 2), (3, 1, 6)]
    assert sorted(map(tuple, event_queries.str_stale_drop_stream(spark, str(tmp_path)).collect())) == sorted(want)
