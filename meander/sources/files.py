"""Small records in the shared folder, through the file systems that Spark itself uses."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_record(spark: SparkSession, path: str) -> dict | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, record: dict) -> bool:
    """Write a record under a temporary name and rename it: all of it is there or nothing. False if there is one already."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(temporary, p):
        fs.delete(temporary, False)
        return False
    return True


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The data files of a folder, with their lengths."""
    fs, p = _at(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    return {n: f.getLen() for f in found if f.isFile() and not (n := f.getPath().getName()).startswith((".", "_"))}
