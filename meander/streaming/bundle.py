"""Several sources read step by step under one cursor, such that a step that is run again reads the identical rows.

Before a step runs, an offset record pins what it reads: for each source the files
that are there, with their sizes, and the range of times. The rows are then copied
to the step's cache, with a digest of each source in one record; the body gets the
cached rows. Only when the body has returned is the step committed, for all
sources at once. If it fails, or the driver is lost, the next run of the step finds its
records and reads the same again: files that came later, grew or went make no
difference to it. Caches of committed steps are deleted.

A source has a cadence. One that is at most as long as a step gives the rows of
the step, and of the part of its interval that lies before the step's start, if they don't begin together; a longer one
gives the rows of the interval that holds the step, as far as the step's end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lookup import IntegrityError
from ..plans.temporal import EPOCH, Schedule
from ..sources import files


@dataclass(frozen=True)
class Source:
    """Parquet files of a folder; rows of a cadence's interval have its start as their time, or lie in it."""

    path: str
    schema: StructType
    time: str
    cadence: timedelta
    origin: datetime = EPOCH

    def span(self, start: datetime, end: datetime) -> tuple[datetime, datetime]:
        """The times that a step from ``start`` to ``end`` reads."""
        held = start - (start - self.origin) % self.cadence
        return held, end


class Bundle:
    def __init__(self, spark: SparkSession, folder: str, schedule: Schedule, sources: dict[str, Source]):
        self.spark, self.folder, self.schedule, self.sources = spark, folder.rstrip("/"), schedule, dict(sources)

    def next_step(self) -> int:
        """The cursor: the first step that is not committed."""
        done = [int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/commits") if n.endswith(".json") and not n.startswith(".")]
        return max(done, default=-1) + 1

    def _bounds(self, step: int) -> tuple[datetime, datetime]:
        if not 0 <= step < len(self.schedule):
            raise IntegrityError(f"step {step} is not one of {len(self.schedule)}")
        start = self.schedule.start + step * self.schedule.step
        return start, min(start + self.schedule.step, self.schedule.end)

    def _pinned(self, step: int) -> dict:
        """The offset record of a step, made when the step is first asked for."""
        path = f"{self.folder}/offsets/{step}.json"
        if (held := files.read_record(self.spark, path)) is None:
            start, end = self._bounds(step)
            record = {}
            for name, source in self.sources.items():
                a, b = source.span(start, end)
                record[name] = {"files": files.sizes(self.spark, source.path), "from": a.isoformat(), "until": b.isoformat()}
            files.publish(self.spark, path, record)
            held = files.read_record(self.spark, path)  # another driver may have been first
        if set(held) != set(self.sources):
            raise IntegrityError(f"step {step} was pinned with sources {sorted(held)}, not {sorted(self.sources)}")
        return held

    def read(self, step: int) -> dict[str, DataFrame]:
        """The rows of a step by source: the same each time, until the step is committed."""
        pinned, cache = self._pinned(step), f"{self.folder}/cache/{step}"
        done = files.read_record(self.spark, f"{cache}/read.json")
        if done is None:
            files.delete(self.spark, cache)  # what a lost driver has begun
            digests = {}
            for name, source in self.sources.items():
                self._range(source, pinned[name]).write.parquet(f"{cache}/{name}")
                digests[name] = self._digest(self.spark.read.schema(source.schema).parquet(f"{cache}/{name}"))
            files.publish(self.spark, f"{cache}/read.json", digests)
            done = digests
        out = {name: self.spark.read.schema(s.schema).parquet(f"{cache}/{name}") for name, s in self.sources.items()}
        for name, df in out.items():
            if self._digest(df) != done[name]:
                raise IntegrityError(f"step {step}: the cached rows of {name} have changed")
        return out

    def _range(self, source: Source, pinned: dict) -> DataFrame:
        there = files.sizes(self.spark, source.path)
        if lost := [f for f, n in pinned["files"].items() if there.get(f) != n]:
            raise IntegrityError(f"{source.path}: {lost[:3]} are not as they were when the step was pinned")
        df = self.spark.read.schema(source.schema)
        df = df.parquet(*[f"{source.path.rstrip('/')}/{f}" for f in pinned["files"]]) if pinned["files"] else self.spark.createDataFrame([], source.schema)
        a, b = (F.lit(datetime.fromisoformat(pinned[k])).cast("timestamp_ntz") for k in ("from", "until"))
        return df.where((F.col(source.time) >= a) & (F.col(source.time) < b))

    @staticmethod
    def _digest(df: DataFrame) -> dict:
        found = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest")).first()
        return {"rows": found["rows"], "digest": str(found["digest"])}

    def run(self, body: Callable[[int, dict[str, DataFrame]], None]) -> int:
        """Run ``body(step, rows by source)`` for the next step and move the cursor; it stays where it is if the body fails."""
        step = self.next_step()
        body(step, self.read(step))
        if not files.publish(self.spark, f"{self.folder}/commits/{step}.json", {"step": step}):
            raise IntegrityError(f"step {step} has been committed by another")
        files.delete(self.spark, f"{self.folder}/cache/{step}")
        return step
