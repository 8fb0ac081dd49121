"""Managed steps over a stream: ordered, exactly once, with a state table that outlives the query.

Each micro-batch is checked to follow the last step, joined to the state, and
written under its step number; a batch that is replayed after a failure
overwrites its own output, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import scratch
from ..sources.changelog import ChangeLog
from .windows import ordered_steps_only


class StepRunner:
    """Applies ``advance(state, batch)`` to each batch of whole steps; state versions are Parquet tables by batch number.

    A version is needed until the next one is committed (a batch that is replayed starts from it), so the last ``keep`` are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, initial: DataFrame, advance: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3):
        self.spark, self.folder, self.advance, self.keep = spark, folder.rstrip("/"), advance, max(2, keep)
        initial.withColumn("last_step", F.lit(-1).cast("long")).write.mode("ignore").parquet(self._path(-1))

    def _path(self, version: int) -> str:
        return f"{self.folder}/state/version={version}"

    def state(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def _batch(self, rows: DataFrame, number: int) -> None:
        before = self.state(number - 1)
        last = before.agg(F.max("last_step")).first()[0]
        last = ordered_steps_only(rows, -1 if last is None else last)
        after = self.advance(before.drop("last_step"), rows).withColumn("last_step", F.lit(last).cast("long"))
        after.write.mode("overwrite").parquet(self._path(number))
        old = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(number - self.keep))
        old.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Works through what is available; called again, it goes on where it ended."""
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


class ChangeRunner:
    """Applies ``change(state, batch)``, which gives only the rows that change, to each batch of whole steps; state is a ``ChangeLog``.

    A batch is a step of the log: a replayed one is skipped, a failed one leaves nothing, one that a lost driver left half-done
    is taken back when ``run`` is called again.
    """

    def __init__(self, log: ChangeLog, initial: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], cursor: str = "last_step"):
        self.log, self.change, self.cursor = log, change, cursor
        log.begin(initial.withColumn(cursor, F.lit(-1).cast("long")))

    def _batch(self, rows: DataFrame, number: int) -> None:
        def body(state: DataFrame) -> DataFrame:
            last = state.agg(F.max(self.cursor)).first()[0]
            last = ordered_steps_only(rows, -1 if last is None else last)
            return self.change(state.drop(self.cursor), rows).withColumn(self.cursor, F.lit(last).cast("long"))

        self.log.run(number, body)

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Works through what is available; called again, it goes on where it ended."""
        self.log.recover()
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.log.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def bundled(streams: dict[str, DataFrame]) -> DataFrame:
    """Several sources as one stream, with ``source``: one query reads it, so that all offsets are committed together or not at all."""
    out = None
    for name, stream in streams.items():
        tagged = stream.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


class Prepared:
    """Tables that are built once for a name and specialization, and then read wherever they are asked for."""

    def __init__(self):
        self.tables: dict[tuple, DataFrame] = {}

    def get(self, name: str, build: Callable[[], DataFrame], *specialization: object) -> DataFrame:
        if not name:
            raise ValueError("a prepared table needs a name")
        key = (name, *specialization)
        if key not in self.tables:
            self.tables[key] = scratch.saved(build(), name)
        return self.tables[key]
