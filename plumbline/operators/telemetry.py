"""Run records, retries and lineage events of a pipeline; driver-side bookkeeping."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, stage string, status string, seconds double, rows_in long, rows_out long, error string"


@dataclass
class Stage:
    run_id: str
    stage: str
    status: str = "running"
    seconds: float = 0.0
    rows_in: int | None = None
    rows_out: int | None = None
    error: str | None = None


@dataclass
class Run:
    """Stage timings and row counts; a stage that reads rows and returns none fails."""

    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    stages: list[Stage] = field(default_factory=list)

    def stage(self, name: str, work: Callable[[], tuple[int | None, int | None]]) -> Stage:
        s, began = Stage(self.run_id, name), time.monotonic()
        self.stages.append(s)
        try:
            s.rows_in, s.rows_out = work()
            s.status = "failed" if s.rows_in and not s.rows_out else "ok"
        except Exception as error:  # noqa: BLE001  recorded with the run
            s.status, s.error = "failed", str(error)
        s.seconds = time.monotonic() - began
        return s

    def failed(self) -> bool:
        return any(s.status == "failed" for s in self.stages)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(s).values()) for s in self.stages], RUNS)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with its row count observed while it is written: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def written(df: DataFrame, change: Callable[[DataFrame], DataFrame], path: str) -> tuple[int, int]:
    """Write change(df) to path; (rows in, rows out), both observed during the write."""
    before, seen_in = counted(df, f"in-{uuid.uuid4().hex}")
    after, seen_out = counted(change(before), f"out-{uuid.uuid4().hex}")
    after.write.mode("overwrite").parquet(path)
    return seen_in.get["rows"], seen_out.get["rows"]


def healed(work: Callable[[], object], retryable: Callable[[Exception], bool], tries: int = 3, wait: float = 0.0) -> tuple[object, list[dict]]:
    """The result of work and the healing events; errors that are not retryable, and the last one, are raised."""
    events = []
    for k in range(tries):
        try:
            return work(), events
        except Exception as error:
            events.append({"attempt": k + 1, "error": type(error).__name__})
            if not retryable(error) or k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError("unreachable")


def lineage_events(run_id: Column, job: str, inputs: list[str], outputs: list[str], event: Column, at: Column) -> Column:
    """The same event as a column, a row for each run of a job."""
    name = lambda x: F.struct(F.lit(x).alias("name"), F.lit("plumbline").alias("namespace"))
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), event.alias("eventType"), F.array(*map(name, inputs)).alias("inputs"), name(job).alias("job"), F.array(*map(name, outputs)).alias("outputs"), F.struct(run_id.alias("runId")).alias("run")))


def lineage(run_id: str, job: str, inputs: list[str], outputs: list[str], event: str, at: str) -> str:
    """A lineage event as JSON in the open standard's shape."""
    names = lambda xs: [{"namespace": "plumbline", "name": x} for x in xs]
    return json.dumps({"eventType": event, "eventTime": at, "run": {"runId": run_id}, "job": {"namespace": "plumbline", "name": job}, "inputs": names(inputs), "outputs": names(outputs)}, sort_keys=True)
