"""Keyed state kept as changes by step, published in two phases.

A step writes only the rows that change, dealt to ranks, into a folder of its own
(an attempt), then a manifest of each rank's rows and digest. Nobody reads an
attempt until the one commit record names it; the record is a file that is renamed
into place, so a step is published whole or not at all, and a second commit of
the same step is refused. State is the last base with the latest change of each
key over it; every ``compact_every`` steps the two are written as a new base.

A step that fails before its commit leaves the state and the cursor where they
were (its attempt is deleted), and may be run again. A step that stopped half-way
without saying so (a lost driver) leaves its mark: further steps are refused until
``recover`` has taken it back, since what its body did elsewhere is unknown.

Layout: ``commits/<step>.json``, ``compactions/<step>.json``, ``running.json``, ``bases/<step>-<id>/...``,
``changes/step=<n>/attempt=<id>/rank=<r>/...``, ``manifests/<step>-<id>/...``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import IntegrityError, require_unique
from . import files

#: Name of a column of changes that, where it is true, removes the key.
REMOVED = "removed"


class Poisoned(RuntimeError):
    """A step stopped half-way; see ``ChangeLog.recover``."""


def summary(rows: DataFrame, rank: str, ranks: int) -> DataFrame:
    """(rank, rows, digest) of every rank, of those without rows, too; digests don't depend on the order of rows."""
    columns = sorted(set(rows.columns) - {"step", "attempt"})
    found = rows.groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))
    every = rows.sparkSession.range(ranks).select(F.col("id").cast("int").alias("rank"))
    return every.join(found, "rank", "full").select("rank", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest", F.lit(0)).cast("string").alias("digest"))


class ChangeLog:
    """State of unique ``key`` columns in ``folder``. rank: the rank of a row, 0 to ``ranks`` - 1, from its key; default one rank."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], ranks: int = 1, rank: Column | None = None, compact_every: int = 8):
        self.spark, self.folder, self.key, self.ranks, self.compact_every = spark, folder.rstrip("/"), list(key), ranks, max(1, compact_every)
        self.rank = rank.cast("int") if rank is not None else F.lit(0)

    # -- what is published

    def _commit(self, step: int) -> dict | None:
        return files.read_record(self.spark, f"{self.folder}/commits/{step}.json")

    def last_step(self) -> int | None:
        """The last published step; -1 after ``begin``, None before."""
        found = [int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/commits") if n.endswith(".json") and not n.startswith(".")]
        return max(found, default=None)

    def begin(self, initial: DataFrame) -> None:
        """Publish the state before the first step; does nothing where there is one."""
        if self.last_step() is None:
            base = f"bases/-1-{uuid.uuid4().hex}"
            self._dealt(require_unique(initial, *self.key)).write.partitionBy("_rank").parquet(f"{self.folder}/{base}")
            files.publish(self.spark, f"{self.folder}/commits/-1.json", {"step": -1, "base": base, "base_step": -1, "attempts": [], "ranks": []})

    def state(self, step: int | None = None) -> DataFrame:
        """The state after a step (the last one), as of its commit."""
        commit = self._commit(self.last_step() if step is None else step)
        if commit is None:
            raise IntegrityError(f"{self.folder}: step {step} is not published")
        base = self.spark.read.parquet(f"{self.folder}/{commit['base']}").drop("_rank")
        if not commit["attempts"]:
            return base
        latest = self._changes(commit).groupBy(*self.key).agg(F.max_by(F.struct(*base.columns, REMOVED), "step").alias("_r")).select("_r.*")
        return base.join(latest.select(self.key), self.key, "left_anti").unionByName(latest.where(~F.col(REMOVED)).drop(REMOVED))

    def _changes(self, commit: dict) -> DataFrame:
        paths = [f"{self.folder}/changes/{a}" for a in commit["attempts"]]
        return self.spark.read.option("basePath", f"{self.folder}/changes").parquet(*paths)

    def verify(self, step: int | None = None) -> None:
        """Raise unless the rows of a step's changes are those of its manifest, rank by rank."""
        commit = self._commit(self.last_step() if step is None else step)
        if commit["attempts"]:
            own = commit["attempts"][-1]
            rows = self.spark.read.option("basePath", f"{self.folder}/changes/{own}").parquet(f"{self.folder}/changes/{own}")
            got = [r.asDict() for r in summary(rows, "rank", self.ranks).orderBy("rank").collect()]  # a row a rank
            if got != commit["ranks"]:
                raise IntegrityError(f"step {commit['step']}: {got}, the commit has {commit['ranks']}")

    # -- a step

    def _dealt(self, rows: DataFrame, name: str = "_rank") -> DataFrame:
        return rows.withColumn(name, self.rank).hint("rebalance", name)

    def prepare(self, step: int, attempt: str, changes: DataFrame) -> None:
        """First phase: an attempt's rows, and then its manifest."""
        if REMOVED not in changes.columns:
            changes = changes.withColumn(REMOVED, F.lit(False))
        path = f"{self.folder}/changes/step={step}/attempt={attempt}"
        self._dealt(changes, "rank").write.partitionBy("rank").parquet(path)
        if not any(n.startswith("rank=") for n in files.names(self.spark, path)):  # nothing changes
            self._dealt(changes, "rank").limit(0).coalesce(1).write.mode("overwrite").parquet(path + "/rank=0")
        rows = self.spark.read.option("basePath", path).parquet(path)
        require_unique(rows, *self.key)
        summary(rows, "rank", self.ranks).coalesce(1).write.parquet(f"{self.folder}/manifests/{step}-{attempt}")

    def commit(self, step: int, attempt: str) -> None:
        """Second phase: one record, if every rank has a manifest and the step is the next one."""
        last = self.last_step()
        if last is None or step != last + 1:
            raise IntegrityError(f"step {step} does not follow {last}")
        path = f"{self.folder}/manifests/{step}-{attempt}"
        if not files.exists(self.spark, f"{path}/_SUCCESS"):
            raise IntegrityError(f"step {step}: not all ranks are prepared")
        ranks = [r.asDict() for r in self.spark.read.parquet(path).orderBy("rank").collect()]  # a row a rank
        if [r["rank"] for r in ranks] != list(range(self.ranks)):
            raise IntegrityError(f"step {step}: ranks {[r['rank'] for r in ranks]}, not 0 to {self.ranks - 1}")
        before = self._commit(last)
        if compacted := files.read_record(self.spark, f"{self.folder}/compactions/{last}.json"):
            before = {"base": compacted["base"], "base_step": last, "attempts": []}
        record = {"step": step, "base": before["base"], "base_step": before["base_step"], "attempts": [*before["attempts"], f"step={step}/attempt={attempt}"], "ranks": ranks}
        if not files.publish(self.spark, f"{self.folder}/commits/{step}.json", record):
            raise IntegrityError(f"step {step} has been published by another")

    def run(self, step: int, body: Callable[[DataFrame], DataFrame]) -> bool:
        """Run ``body(state)``, which gives the rows that change, as the next step. False if the step is published already (a batch that is replayed)."""
        last = self.last_step()
        if last is not None and step <= last:
            return False
        if mark := files.read_record(self.spark, f"{self.folder}/running.json"):
            raise Poisoned(f"step {mark['step']} stopped half-way")
        if last is None or step != last + 1:
            raise IntegrityError(f"step {step} does not follow {last}")
        attempt = uuid.uuid4().hex
        files.publish(self.spark, f"{self.folder}/running.json", {"step": step, "attempt": attempt})
        try:
            self.prepare(step, attempt, body(self.state()))
            self.commit(step, attempt)
        except Exception:
            self._take_back(step, attempt)
            raise
        files.delete(self.spark, f"{self.folder}/running.json")
        if step - self._commit(step)["base_step"] >= self.compact_every:
            self.compact()
        return True

    def _take_back(self, step: int, attempt: str) -> None:
        for path in (f"changes/step={step}/attempt={attempt}", f"manifests/{step}-{attempt}", "running.json"):
            files.delete(self.spark, f"{self.folder}/{path}")

    def recover(self) -> int | None:
        """Take back a step that stopped half-way, unless its commit was made; the last published step."""
        if mark := files.read_record(self.spark, f"{self.folder}/running.json"):
            last = self.last_step()
            if last is None or last < mark["step"]:
                self._take_back(mark["step"], mark["attempt"])
            files.delete(self.spark, f"{self.folder}/running.json")
        return self.last_step()

    def compact(self) -> None:
        """Write the state as a base of its own, from which the next commits start. States before the last base but one go."""
        last = self.last_step()
        commit = self._commit(last)
        base = f"bases/{last}-{uuid.uuid4().hex}"
        self._dealt(self.state(last)).write.partitionBy("_rank").parquet(f"{self.folder}/{base}")
        if not files.publish(self.spark, f"{self.folder}/compactions/{last}.json", {"base": base}):
            files.delete(self.spark, f"{self.folder}/{base}")
            return
        old = commit["base_step"]
        for kind, step_of in (("commits", lambda n: int(n[:-5])), ("changes", lambda n: int(n[5:])), ("manifests", lambda n: int(n.rpartition("-")[0])), ("bases", lambda n: int(n.rpartition("-")[0]))):
            for name in files.names(self.spark, f"{self.folder}/{kind}"):
                if not name.startswith((".", "_")) and step_of(name) <= old - (kind == "bases"):
                    files.delete(self.spark, f"{self.folder}/{kind}/{name}")
