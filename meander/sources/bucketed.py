"""Tables laid out by key, so that joins and groupings by that key need no exchange.

The rows are hashed into a fixed number of buckets, each file of which holds one bucket,
sorted. Two tables with the same keys and number of buckets are joined bucket by
bucket; so a mapping that is applied to frame after frame, or state that is joined
with every step's rows, is dealt out once, when it is written. A key with
much of all rows fills one bucket: lay such tables out by a further key as well.

Tables are external ones of the session's catalog, with their files in the shared
folder. What is read back is a plain DataFrame; ``buckets`` must be fit for the cluster, since a
bucket is read by one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from . import scratch


def laid_out(df: DataFrame, keys: list[str], buckets: int, name: str = "laid_out") -> DataFrame:
    """Write ``df`` by ``keys`` into so many buckets and read it back."""
    if buckets < 1 or not keys:
        raise ValueError("a layout needs keys and at least one bucket")
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)  # as the buckets are hashed: one file a bucket
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch.new_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def exchanges(df: DataFrame) -> list[str]:
    """The hash exchanges of a DataFrame's plan; for tests and for a look before a long run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
