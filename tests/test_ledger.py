"""The trial ledger: a killed search ends with the same table."""

import math

import pytest

from dyad.operators.ledger import Trial, TrialLedger

TRIALS = [Trial(i, {"x": str(i - 3), "kind": "ab"[i % 2]}) for i in range(7)]


def loss(params):
    return float(params["x"]) ** 2 + (params["kind"] == "b")


def rows(table):
    return [(r.number, r.state, r.value, r.params) for r in table.orderBy("number").collect()]


def test_a_killed_search_ends_with_the_same_table(spark, tmp_path):
    whole = rows(TrialLedger(spark, str(tmp_path / "whole")).run(TRIALS, loss))
    path, calls = str(tmp_path / "cut"), []

    def dies(params):
        calls.append(params["x"])
        if params["x"] == "0":
            raise KeyboardInterrupt  # the process is killed: no failure is recorded
        return loss(params)

    with pytest.raises(KeyboardInterrupt):
        TrialLedger(spark, path).run(TRIALS, dies)
    assert [s for _, s, _, _ in rows(TrialLedger(spark, path).table())] == ["COMPLETE"] * 3 + ["RUNNING"]
    again = []
    assert rows(TrialLedger(spark, path).run(TRIALS, lambda p: again.append(p["x"]) or loss(p))) == whole
    assert calls == ["-3", "-2", "-1", "0"] and again == ["0", "1", "2", "3"]
    assert rows(TrialLedger(spark, path).run(TRIALS, dies)) == whole  # nothing is left to run
    best, model = TrialLedger(spark, path).refit(lambda p: p["x"])
    assert (best.number, model) == (3, "0") or loss(best.params) == min(v for _, _, v, _ in whole)
    times = TrialLedger(spark, path).table().select("datetime_start", "datetime_complete").collect()
    assert all(r.datetime_start <= r.datetime_complete for r in times)


def test_failures_ties_and_wrong_calls(spark, tmp_path):
    ledger = TrialLedger(spark, str(tmp_path / "f"))
    assert ledger.table().count() == 0 and ledger.run([], loss).count() == 0
    with pytest.raises(ValueError, match="no trial"):
        ledger.best()
    for bad in (None, math.nan):
        with pytest.raises(ValueError, match="no value"):
            ledger.run(TRIALS[:2], lambda p: bad)
    (row,) = ledger.table().collect()
    assert row.state == "FAIL" and row.value is None and "no value" in row.error
    ledger.run(TRIALS[:3], lambda p: 1.0, max_new=2)
    assert ledger.best().number == 0 and [t.number for t in ledger.missing(TRIALS[:3])] == [2]
    with pytest.raises(ValueError, match="other parameters"):
        ledger.run([Trial(0, {"x": "9"})], loss)
    with pytest.raises(ValueError, match="twice"):
        ledger.run([TRIALS[4], TRIALS[4]], loss)
