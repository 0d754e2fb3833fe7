"""Reply logs that are merged as they grow, and reply state that ends with event time."""

import math
import random
from datetime import datetime, timedelta

import pytest

from talkloom.streaming import replies as ST

SNAPSHOT = "conv_id long, turn long, prompt string, seq long, resp string"


def batches(n, replies=40):
    """Micro-batches over some replies, each with a few newer snapshots and an older one."""
    rng = random.Random(3)
    state, out = {}, []
    for _ in range(n):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            key = rng.randrange(replies), rng.randrange(2)
            seq, text = state.get(key, (0, ""))
            rows.append((*key, "p", seq, text)) if seq else None
            state[key] = seq + 1, text + rng.choice("ab中")
            rows.append((*key, "p", *state[key]))
        out.append(rows)
    return out, {k: text for k, (_, text) in state.items()}


def newest(df):
    return {(r.conv_id, r.turn): r.resp for r in df.collect()}


@pytest.fixture
def log(spark, tmp_path):
    return ST.ReplyLog(spark, f"file://{tmp_path}/log")


def test_reads_stay_as_large_as_the_live_replies(spark, log):
    arrived, final = batches(14)
    for epoch, rows in enumerate(arrived):
        log.store(spark.createDataFrame(rows, SNAPSHOT), epoch)
        parts = log.table.manifest()["parts"]
        held = [p["rows"] for p in parts]
        assert all(n > sum(held[i + 1 :]) for i, n in enumerate(held[:-1]))
        assert sum(held) < 2 * log.latest().count() and len(held) <= math.log2(sum(held)) + 1
        assert sum(len(p["tokens"]) for p in parts) == len(parts)
    assert newest(log.latest()) == final


def test_an_epoch_that_dies_or_repeats(spark, log, monkeypatch):
    arrived, final = batches(3)
    frames = [spark.createDataFrame(rows, SNAPSHOT) for rows in arrived]
    log.store(frames[0], 0)
    seen = newest(log.latest())

    def die(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(log.table, "_put_manifest", die)
        with pytest.raises(OSError):
            log.store(frames[1], 1)
        with pytest.raises(OSError):
            log.table.merge([log.table.manifest()["parts"][0]["folder"]], ST.latest_snapshot)
    assert newest(log.latest()) == seen and len(log.table.unnamed()) == 2
    for epoch in (1, 1, 2, 2):
        version = log.table.version()
        log.store(frames[epoch], epoch)
    assert log.table.version() == version and newest(log.latest()) == final
    assert newest(log.latest(1)) == seen


def test_expired_versions_go_and_commits_under_way_stay(spark, log):
    arrived, final = batches(5)
    for epoch, rows in enumerate(arrived):
        log.store(spark.createDataFrame(rows, SNAPSHOT), epoch)
    lost = log.table._stored(log.latest())["folder"]
    assert log.table.expire() and log.table.expire() == []
    assert newest(log.latest()) == final and log.table.unnamed() == [lost]
    with pytest.raises(ValueError):
        log.latest(1)
    with pytest.raises(ValueError):
        log.table.expire(0)


def test_a_stream_keeps_the_log(spark, log, tmp_path):
    arrived, final = batches(4)
    for rows in arrived:
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.read_snapshots(spark, str(tmp_path / "in"), files_per_batch=1)
    for _ in range(2):
        ST.compacted_snapshot_stream(stream, log, str(tmp_path / "c")).awaitTermination()
    assert newest(log.latest()) == final


def test_state_ends_with_event_time(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def file(hour, convs, texts):
        rows = []
        for c in convs:
            for seq, text in texts:
                rows.append((c, 0, "p", seq, text, start + timedelta(hours=hour, minutes=seq)))
        df = spark.createDataFrame(rows, SNAPSHOT + ", at timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    file(0, range(20), [(1, "a"), (2, "ab")])
    file(0.2, range(10), [(2, "ab"), (3, "abc")])  # the same replies go on
    file(5, range(20, 25), [(1, "x")])
    file(0.1, [0, 99], [(9, "late")])  # arrives before the watermark: dropped
    file(10, [0, 30], [(4, "abcd")])  # reply 0 was forgotten and begins anew
    stream = ST.read_snapshots(spark, str(tmp_path / "in"), files_per_batch=1, arrival="at")
    deltas = ST.suffix_delta_stream(stream, idle_ms=3_600_000, arrival="at", delay="10 minutes")
    query = ST.store_deltas(deltas, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    held = [o["numRowsTotal"] for o in operators]
    assert max(held) >= 20 and held[-1] <= 2
    got = sorted(map(tuple, spark.read.schema(ST.DELTA).parquet(str(tmp_path / "out")).collect()))
    expected = [(c, 0, s, d) for c in range(20) for s, d in [(1, "a"), (2, "b")] + ([(3, "c")] if c < 10 else [])]
    expected += [(c, 0, 1, "x") for c in range(20, 25)] + [(0, 0, 4, "abcd"), (30, 0, 4, "abcd")]
    assert got == sorted(expected)
    with pytest.raises(ValueError):
        ST.suffix_delta_stream(stream, arrival="at")
