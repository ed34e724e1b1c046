import random

import pytest
from sluice.streaming import jobs, machine

POLICY = machine.Policy(max_retries=1, back_off=1000, time_out=5000)


def play(events, policy, end, item=None):
    """All events of one item in order, then its timers up to the end."""
    item, out = item or machine.Item(), []
    for seq, at, kind in sorted(events):
        if seq > item.last:
            item.last = seq
            out += [*item.until(policy, at), *item.hear(policy, seq, at, kind)]
    return item, out + list(item.until(policy, end))


def test_moves():
    _, out = play([(0, 0, "add"), (1, 10, "complete"), (2, 20, "begin"), (3, 30, "fail"), (4, 40, "begin"), (5, 50, "reset"), (6, 1040, "complete")], POLICY, 9000)
    assert out == [
        (0, 0, "add", "pending", 0, True), (1, 10, "complete", "pending", 0, False), (2, 20, "begin", "running", 1, True), (3, 30, "fail", "waiting", 1, True),
        (5, 50, "reset", "waiting", 1, False), (None, 1030, "ready", "pending", 1, True), (4, 1030, "begin", "running", 2, True), (6, 1040, "complete", "completed", 2, True),
    ]
    item, out = play([(0, 0, "add"), (1, 0, "begin"), (2, 99_999, "reset"), (3, 99_999, "ready"), (4, 99_999, "nonsense")], POLICY, 99_999)
    assert [o[1:4] for o in out[2:4]] == [(5000, "timeout", "waiting"), (6000, "ready", "pending")] and [o[5] for o in out[-2:]] == [False, False]
    item, out = play([(0, 0, "add"), (1, 0, "begin"), (2, 1, "begin"), (3, 2, "fail"), (4, 3, "reset")], POLICY, 10)
    assert out[3][3] == "quarantined" and (item.state, item.attempts) == ("pending", 0)


def random_events(seed, n):
    rng = random.Random(seed)
    kinds = ["begin", "begin", "begin", "fail", "fail", "complete", "warn", "skip", "reset", "ready", "nonsense", "add"]
    times = sorted(rng.randrange(60_000) for _ in range(n))
    return [(f"j{rng.randrange(2)}", rng.randrange(3), s, t, "add" if s < 25 else rng.choice(kinds)) for s, t in enumerate(times)]


@pytest.mark.parametrize("pieces", [1, 4])
def test_results_do_not_depend_on_batches(spark, tmp_path, pieces):
    events = random_events(4, 300)
    source, path, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = "job_id string, position long, seq long, ms long, kind string"
    known = spark.createDataFrame([("j0", 0, "running", 1), ("j9", 5, "skipped", 3)], "job_id string, position int, state string, attempts int")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source).selectExpr("job_id", "position", "seq", "timestamp_millis(ms) AS at", "kind")
    for k in range(pieces):
        part = events[max(0, 300 * k // pieces - 10 * bool(k)) : 300 * (k + 1) // pieces]  # ten of the last ones once more
        part = part + ([(None, None, None, 5, "add"), ("j0", 0, 7000, None, "reset")] if k == 0 else [])
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        accepted, rejected = machine.run(stream, path, check, POLICY, "20 seconds", known)
    got = [tuple(r) for r in accepted.unionAll(rejected).collect()]
    assert all(r.accepted for r in accepted.collect()) and rejected.where("accepted").isEmpty() and rejected.count() > 20
    end = max(e[3] for e in events) - 20_000  # the watermark
    want, last = [], {}
    for key in {e[:2] for e in events}:
        first = machine.Item("pending", 1) if key == ("j0", 0) else None
        item, out = play([e[2:] for e in events if e[:2] == key], POLICY, end, first)
        last[key] = (item.state, item.attempts, item.last, item.deadline)
        want += [(*key, *o) for o in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(o[4] == "timeout" for o in got) and len({o[3] for o in got}) > 100
    last["j9", 5] = ("skipped", 3, -1, None)
    assert {(r.job_id, r.position): (r.state, r.attempts, r.last, r.deadline) for r in machine.states(spark, check).collect()} == last


def test_timers_of_silent_items(spark, tmp_path):
    rows = [("a", 0, 0, 1000, "add"), ("a", 0, 1, 1010, "begin"), ("b", 0, 2, 500_000, "add")]
    source = f"file://{tmp_path}/in"
    schema = "job_id string, position long, seq long, ms long, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source).selectExpr("job_id", "position", "seq", "timestamp_millis(ms) AS at", "kind")
    got = [tuple(r)[2:5] for r in machine.timeline(stream, POLICY).where("job_id = 'a'").orderBy("at").collect()]
    assert got == [(0, 1000, "add"), (1, 1010, "begin"), (None, 6010, "timeout"), (None, 7010, "ready")]


def test_fold_resumes(spark, tmp_path):
    check = f"file://{tmp_path}/check"
    a = jobs.fold_events(spark, "/root/testdata/sf0.001", check)
    b = jobs.fold_events(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
