"""Trial ledger of a search, with resume.

A study is an append-only Parquet table in a shared folder.  A trial is appended
when it starts (``RUNNING``) and when it ends (``COMPLETE`` with its value, or
``FAIL`` with the error); nothing is ever rewritten, so a search that is killed
loses at most the trial it was running.  A later run of the same trials computes
only those that are not complete, and ends with the same numbers, parameters,
states and values.

The table has one row per trial: its completion if there is one (the first, if
two runs completed it), else its last event.  One search at a time may run on a
study.  A number that the study holds with other parameters is an error, as is a
number given twice.  A value that is None or NaN makes the trial fail."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("number long, state string, value double, params map<string,string>, datetime_start timestamp, "
         "datetime_complete timestamp, error string")


@dataclass(frozen=True)
class Trial:
    number: int
    params: dict[str, str]


class TrialLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], EVENT).write.mode("ignore").parquet(path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(self.path)

    def table(self) -> DataFrame:
        """One row per trial."""
        done = F.col("state") == "COMPLETE"
        first = F.when(done, -F.unix_micros("datetime_complete")).otherwise(F.unix_micros(F.coalesce("datetime_complete", "datetime_start")))
        last = F.max_by(F.struct("state", "value", "params", "datetime_start", "datetime_complete", "error"), F.struct(done, first))
        return self.events().groupBy("number").agg(last.alias("e")).select("number", "e.*")

    def _append(self, *event) -> None:
        self.spark.createDataFrame([event], EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def missing(self, trials: Sequence[Trial]) -> list[Trial]:
        """The trials that are not complete, in their order."""
        if len({t.number for t in trials}) < len(trials):
            raise ValueError("a trial number is given twice")
        held = {r.number: r for r in self.table().select("number", "state", "params").collect()}
        for t in trials:
            if t.number in held and dict(held[t.number].params) != t.params:
                raise ValueError(f"trial {t.number} is in the study with other parameters")
        return [t for t in trials if t.number not in held or held[t.number].state != "COMPLETE"]

    def run(self, trials: Sequence[Trial], objective: Callable[[dict[str, str]], float], max_new: int | None = None) -> DataFrame:
        """Compute the missing trials (at most ``max_new``) and return the table.
        An error of the objective is recorded and raised."""
        for trial in self.missing(trials)[:max_new]:
            start = dt.datetime.now()
            self._append(trial.number, "RUNNING", None, trial.params, start, None, None)
            try:
                value = objective(trial.params)
                if value is None or math.isnan(value):
                    raise ValueError(f"trial {trial.number} has no value")
            except Exception as e:
                self._append(trial.number, "FAIL", None, trial.params, start, dt.datetime.now(), str(e))
                raise
            self._append(trial.number, "COMPLETE", float(value), trial.params, start, dt.datetime.now(), None)
        return self.table()

    def best(self) -> Trial:
        """The complete trial of the lowest value (ties: the lowest number)."""
        row = self.table().filter("state = 'COMPLETE'").orderBy("value", "number").first()
        if row is None:
            raise ValueError("no trial is complete")
        return Trial(row.number, dict(row.params))

    def refit(self, fit: Callable[[dict[str, str]], object]) -> tuple[Trial, object]:
        """The best trial and the model that ``fit`` makes with its parameters."""
        best = self.best()
        return best, fit(best.params)
