import threading

import pytest
from sluice.operators.joblog import JobLog, VolatileJobLog, final_state, job_id, run_batch


def test_identity():
    a = job_id("rescale", ["1", "2"], [("x.png", 10, 5)], {"b": 1, "a": [1, 2]})
    assert a == job_id("rescale", ["1", "2"], [("x.png", 10, 5)], {"a": [1, 2], "b": 1}) and len(a) == 24
    assert a != job_id("rescale", ["1", "2"], [("x.png", 11, 5)], {"b": 1, "a": [1, 2]})
    with pytest.raises(ValueError):
        job_id("t", [], [], {"x": float("nan")})


def test_batch_with_retries(spark, tmp_path):
    log, marks = JobLog(spark, str(tmp_path / "log")), tmp_path / "tries"
    marks.mkdir()

    def work(path):
        import os
        import uuid

        open(f"{marks}/{path}-{uuid.uuid4().hex}", "w").close()
        if path == "bad":
            raise OSError("broken")
        if path == "flaky" and sum(n.startswith("flaky") for n in os.listdir(marks)) < 3:
            return "failed", "later", True
        return "completed", "", False

    assert log.submit("j", ["a", "bad", "flaky"]) == "new"
    counts = run_batch(log, "j", work, max_retries=2)
    assert (counts["completed"], counts["quarantined"], counts["pending"]) == (2, 1, 0)
    assert sorted(p.name.split("-")[0] for p in marks.iterdir()) == ["a", "bad", "flaky", "flaky", "flaky"]
    report = log.reports().collect()
    assert report[0].state == "completed_with_warnings" and [i.attempts for i in report[0]["items"]] == [1, 1, 3]
    assert log.submit("j", ["a", "bad", "flaky"]) == "complete" and log.reports(0).count() == 0
    log.reset("j", [1])
    assert log.one("j", 1)["attempts"] == 0 and [r.position for r in log.pending("j").collect()] == [1]
    log.begin("j", 1)
    again = JobLog(spark, log.path)  # a restarted driver
    assert again.seq == log.seq and again.submit("j", []) == "recovered"
    assert again.one("j", 1) | {"updated_at": 0, "details": ""} == {"job_id": "j", "position": 1, "path": "bad", "state": "pending", "attempts": 1, "details": "", "updated_at": 0}
    for wrong in (lambda: again.finish("j", 1, "completed"), lambda: again.begin("j", 0), lambda: again.one("j", 9), lambda: again.defer("j", 0)):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        again.submit("j", ["a", "bad"])


def test_volatile_log(spark):
    log = VolatileJobLog(spark)
    assert log.submit("j", ["a", "b"]) == "new"
    counts = run_batch(log, "j", lambda path: ("completed" if path == "a" else "skipped", "", False))
    assert counts["completed"] == counts["skipped"] == 1 and log.submit("j", ["a", "b"]) == "complete"
    assert log.reports().first().state == "completed_with_warnings"


def test_final_state():
    assert final_state({"completed": 2}) == "completed" and final_state({"completed": 1, "skipped": 1}) == "completed_with_warnings" and final_state({"pending": 1}) == "running"


def test_states_are_hashed_not_sorted(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"))
    assert log.submit("j", ["a", "b"]) == "new" and log.begin("j", 1) == 1
    states = log.items().select("position", "state")
    assert "SortAggregate" not in states._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, states.collect())) == [(0, "pending"), (1, "running")]
    paths = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b")], "position int, path string")
    assert log.same_inputs("j", paths.distinct()) and not log.same_inputs("j", paths) and not log.same_inputs("j", paths.limit(1))
