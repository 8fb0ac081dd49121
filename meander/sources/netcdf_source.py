"""NetCDF classic files as a Spark data source, and result files by rank as a sink with a catalog.

Reading: the driver reads headers and time axes only, and plans a partition for
each range of steps of a file, of ``CHUNK`` bytes at most, so no file is held
whole. A range of times leaves out steps, and with a catalog whole files unopened;
so does a range of points. Ranges are given to ``read``. They may also come from
the query's own comparisons (``pushdown``), but Spark 4.1 keeps what a Python source
was told for as long as the loaded table lives: a table that is filtered in
two ways would lose rows, so that is for tables that are used once.

Writing: a file holds one rank's points (of one year, say) as (time, point)
frames. Tasks write under temporary names; the commit renames the files and then
writes the catalog, which is what makes them visible: per file the rank, split,
committed steps, points, and the least and greatest time and point. Reading with
a catalog refuses other formats and versions, files shorter than committed, and
ranks that are missing, repeated, or differ in their times.

Call ``register`` once a session. Missing values are NaN; times are whole microseconds
in the standard calendar; a step without a value at some point has NaN there.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.lookup import IntegrityError
from . import netcdf, scratch

#: What marks result files.
FORMAT, VERSION, CATALOG = "meander-rank-frames", 1, "_catalog.json"
#: Bytes of a partition's steps, at most (or one step), and values of a batch.
CHUNK, BATCH = 32 << 20, 200_000
_UNITS = "seconds since 1970-01-01 00:00:00"


def register(spark: SparkSession) -> None:
    """Make the format ``netcdf`` known, and let comparisons reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Reading:
    """A file's header and ranges of its steps, by seeking."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.file = where.open_input_file(path)
        size, length = 8192, self.file.size()
        while True:
            try:
                self.head = netcdf.header(memoryview(self.file.read_at(min(size, length), 0)), length)
                break
            except (IndexError, struct.error):
                if size >= length:
                    raise ValueError(f"{path}: the header is cut off") from None
                size *= 8
        self.length = length

    def steps(self, name: str, first: int, end: int) -> Iterator[np.ndarray]:
        """Slices ``first`` to ``end`` of the leading dimension, each flat."""
        v = self.head.variables[name]
        count, apart = netcdf.extent(self.head, v)
        for k in range(first, end):
            raw = self.file.read_at(count * np.dtype(v.dtype).itemsize, v.begin + k * apart)
            yield netcdf.real(np.frombuffer(raw, v.dtype), v)

    def axis(self, name: str) -> np.ndarray:
        if name not in self.head.variables:
            return np.arange(self.head.dims[name], dtype=float)
        v = self.head.variables[name]
        if v.dims != [name]:
            raise ValueError(f"{name} is not a coordinate")
        if v.record:
            return np.concatenate([np.zeros(0), *self.steps(name, 0, v.shape[0])])
        return netcdf.real(np.frombuffer(self.file.read_at(v.shape[0] * np.dtype(v.dtype).itemsize, v.begin), v.dtype), v)

    def times(self, name: str) -> np.ndarray:
        """Microseconds since 1970."""
        units = self.head.variables[name].attributes.get("units", "") if name in self.head.variables else ""
        return np.array(netcdf.times(self.axis(name), units), "datetime64[us]").astype(np.int64)


@dataclass
class Steps(InputPartition):
    path: str
    first: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.first, self.end))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _us(x: datetime) -> int:
    since = (x.astimezone(UTC).replace(tzinfo=None) if x.tzinfo else x) - datetime(1970, 1, 1)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


class NetcdfSource(DataSource):
    """Options: ``path`` (a file, or a folder of .nc files), ``variables`` (with the same dimensions, separated by commas), ``chunk`` (bytes of a partition).

    ``start``, ``end`` (a half-open range of times), ``least``, ``greatest`` (a closed range of points), ``pushdown`` (see above).
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _variables(self) -> list[str]:
        return [v.strip() for v in self.options["variables"].split(",")]

    def schema(self) -> str:
        where, path = store(self.options["path"])
        files = found(where, path)
        if not files:
            raise FileNotFoundError(f"{path} has no .nc files")
        dims = dims_of(Reading(where, files[0]), files[0], self._variables())
        return ", ".join(["file string", "time timestamp_ntz", *(f"`{d}` double" for d in dims[1:]), *(f"`{v}` double" for v in self._variables())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NetcdfReader(self.options, self._variables(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RankWriter(self.options["path"], self._variables()[0], schema.names)


def found(where: fs.FileSystem, path: str) -> list[str]:
    """The files of a folder: those of its catalog, or else all."""
    if where.get_file_info(path).type == fs.FileType.File:
        return [path]
    if listed := catalog(where, path):
        return [f"{path.rstrip('/')}/{f['file']}" for f in listed["files"]]
    return sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".nc") and not f.base_name.startswith((".", "_")))


def catalog(where: fs.FileSystem, path: str) -> dict | None:
    name = f"{path.rstrip('/')}/{CATALOG}"
    if where.get_file_info(name).type != fs.FileType.File:
        return None
    with where.open_input_stream(name) as f:
        return json.loads(f.read())


def dims_of(reading: Reading, path: str, variables: list[str]) -> list[str]:
    for v in variables:
        if v not in reading.head.variables:
            raise KeyError(f"{path} has no variable {v}")
    dims = {tuple(reading.head.variables[v].dims) for v in variables}
    if len(dims) > 1 or not next(iter(dims)):
        raise ValueError(f"{path}: {variables} differ in dimensions, or have none")
    return list(dims.pop())


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict, variables: list[str], schema: StructType):
        self.path, self.variables, self.schema = options["path"], variables, schema
        self.chunk = int(options.get("chunk", CHUNK))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.listens = options.get("pushdown", "false").lower() == "true"
        if "start" in options:
            self.low["time"] = _us(datetime.fromisoformat(options["start"]))
        if "end" in options:
            self.high["time"] = _us(datetime.fromisoformat(options["end"])) - 1
        self.points = float(options.get("least", -np.inf)), float(options.get("greatest", np.inf))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of time and of the other coordinates; Spark still checks them row by row, as ranges of steps are coarser."""
        for f in filters:
            yield f
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else ()
            values = [_us(x) if isinstance(x, datetime) else x for x in values]
            if not self.listens or len(getattr(f, "attribute", ())) != 1 or not values or not all(isinstance(x, (int, float)) for x in values):
                continue
            name = f.attribute[0]
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low.get(name, min(values)), min(values))
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high.get(name, max(values)), max(values))

    def _apart(self, name: str, least: float, most: float) -> bool:
        return most < self.low.get(name, -np.inf) or least > self.high.get(name, np.inf)

    def _meets(self, least: float, most: float) -> bool:
        return most >= self.points[0] and least <= self.points[1]

    def partitions(self) -> list[Steps]:
        where, path = store(self.path)
        listed = {f"{path.rstrip('/')}/{f['file']}": f for f in (catalog(where, path) or {"files": []})["files"]}
        if listed:
            check_catalog(catalog(where, path), path)
        out = []
        for file in found(where, path):
            if (f := listed.get(file)) and (self._apart("time", f["first_us"], f["last_us"]) or self._apart(f["point"], f["least_point"], f["greatest_point"]) or not self._meets(f["least_point"], f["greatest_point"])):
                continue
            reading = Reading(where, file)
            dims = dims_of(reading, file, self.variables)
            if f:
                check_file(f, reading, file)
            at = reading.times(dims[0])
            inside = np.flatnonzero((at >= self.low.get("time", -np.inf)) & (at <= self.high.get("time", np.inf)))
            if not len(inside) or any(self._apart(d, (axis := reading.axis(d)).min(initial=np.inf), axis.max(initial=-np.inf)) for d in dims[1:]):
                continue
            first, end = int(inside[0]), int(inside[-1]) + 1
            bytes_ = sum(netcdf.extent(reading.head, reading.head.variables[v])[0] * 8 for v in self.variables)
            apart = max(1, self.chunk // max(1, bytes_))
            out += [Steps(file, k, min(k + apart, end)) for k in range(first, end, apart)]
        return out

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        if partition is None:  # every file is left out
            return
        reading = Reading(store(self.path)[0], partition.path)
        dims = dims_of(reading, partition.path, self.variables)
        at = reading.times(dims[0])[partition.first : partition.end]
        axes = [reading.axis(d) for d in dims[1:]]
        sizes = [len(a) for a in axes]
        wanted = np.flatnonzero((axes[0] >= self.points[0]) & (axes[0] <= self.points[1])) if len(axes) == 1 else np.arange(int(np.prod(sizes)))
        names = ["file", "time", *dims[1:], *self.variables]
        for t, *values in zip(at, *(reading.steps(v, partition.first, partition.end) for v in self.variables)):
            for i in range(0, len(wanted), BATCH):
                part = wanted[i : i + BATCH]
                mesh = [axis[k] for axis, k in zip(axes, np.unravel_index(part, sizes) if sizes else [])]
                fixed = [pa.array([partition.path.rpartition("/")[2]]).take(pa.array(np.zeros(len(part), np.int32))), pa.array(np.full(len(part), t), pa.int64()).cast(pa.timestamp("us"))]
                yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, mesh), *(pa.array(v[part]) for v in values)], names)


class RankWriter(DataSourceArrowWriter):
    """Rows (rank, split, steps, time, point, value), sorted by all but the last: those without time name a file's points, those without point its steps."""

    def __init__(self, path: str, variable: str, names: list[str]):
        self.path, self.variable, self.names = path, variable, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        done: list[dict] = []
        now, points, begun = None, [], None
        for batch in iterator:
            rank, split, steps, at, point, value = (batch.column(self.names.index(c)) for c in ("rank", "split", "steps", "time", "point", "value"))
            us = np.where(at.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, at.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy())
            ranks, named, point = rank.to_numpy(), point.is_valid().to_numpy(zero_copy_only=False), point.fill_null(0).to_numpy()
            value = value.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            splits = split.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (ranks[1:] != ranks[:-1]) | (splits[1:] != splits[:-1]) | (us[1:] != us[:-1]))) if len(us) else []
            for a, b in zip(edges, [*edges[1:], len(us)]):
                if now != (key := (int(ranks[a]), splits[a], steps[int(a)].as_py())):
                    if begun:
                        done.append(begun.finish())
                    now, points, begun = key, [], None
                if us[a] == np.iinfo(np.int64).min:
                    points.append(point[a:b])
                    continue
                begun = begun or RankFile(where, path, self.variable, now, np.concatenate([np.zeros(0, np.int64), *points]))
                begun.add(int(us[a]), point[a:b][named[a:b]], value[a:b][named[a:b]])
        if begun:
            done.append(begun.finish())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        for f in files:
            where.move(f"{path}/{f.pop('temporary')}", f"{path}/{f['file']}")
        text = json.dumps({"format": FORMAT, "version": VERSION, "variable": self.variable, "ranks": len({f["rank"] for f in files}), "files": files}, indent=1)
        temporary = f"{path}/.{CATALOG}-{uuid.uuid4().hex}"
        with where.open_output_stream(temporary) as f:
            f.write(text.encode())
        where.move(temporary, f"{path}/{CATALOG}")

    def abort(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        for f in (f for m in messages if m for f in m.files):
            if where.get_file_info(f"{path}/{f['temporary']}").type == fs.FileType.File:
                where.delete_file(f"{path}/{f['temporary']}")


class RankFile:
    """One file, written step by step; holds its points and one frame."""

    def __init__(self, where: fs.FileSystem, path: str, variable: str, key: tuple[int, str, int], points: np.ndarray):
        rank, split, self.steps = key
        if not len(points) or (np.diff(points) <= 0).any():
            raise IntegrityError(f"rank {rank}: points repeat, or there are none")
        self.points, self.seen, self.held = points, [], None
        name = f"{variable}_rank{rank}{f'_{split}' if split else ''}.nc"
        self.entry = {"file": name, "temporary": f".{name}-{uuid.uuid4().hex}", "rank": rank, "split": split, "steps": self.steps, "points": len(points), "point": "point", "least_point": int(points[0]), "greatest_point": int(points[-1])}
        variables = {"point": (["point"], ">f8", {}), "time": (["time"], ">f8", {"units": _UNITS}), variable: (["time", "point"], ">f8", {})}
        head, _, _ = netcdf.packed({"time": None, "point": len(points)}, variables, {"format": FORMAT, "version": VERSION, "rank": rank, "committed_steps": self.steps}, self.steps)
        self.file = where.open_output_stream(f"{path}/{self.entry['temporary']}")
        self.file.write(head + points.astype(">f8").tobytes())

    def add(self, us: int, points: np.ndarray, values: np.ndarray) -> None:
        """Part of a step, or all of it; a step may come in several batches."""
        if not self.seen or self.seen[-1] != us:
            self._out()
            self.seen.append(us)
            self.held, self.filled = np.full(len(self.points), np.nan), np.zeros(len(self.points), bool)
        at = np.searchsorted(self.points, points)
        if self.filled[at].any() or (np.diff(at) == 0).any():
            raise IntegrityError(f"{self.entry['file']}: two values of one time and point")
        self.held[at], self.filled[at] = values, True

    def _out(self) -> None:
        if self.held is not None:
            self.file.write(np.array([self.seen[-1] / 1e6], ">f8").tobytes() + self.held.astype(">f8").tobytes())

    def finish(self) -> dict:
        self._out()
        self.file.close()
        if len(self.seen) != self.steps:
            raise IntegrityError(f"{self.entry['file']}: {len(self.seen)} steps, not {self.steps}")
        times = np.array(self.seen, np.int64)
        return self.entry | {"first_us": self.seen[0], "last_us": self.seen[-1], "times": int(np.bitwise_xor.reduce(times * np.int64(0x9E3779B97F4A7C1 | 1)))}


def check_catalog(listed: dict, path: str) -> None:
    """Raise unless format and version are known, the ranks of each split are all there once, and agree in their times."""
    if (listed.get("format"), listed.get("version")) != (FORMAT, VERSION):
        raise IntegrityError(f"{path}: {listed.get('format')} of version {listed.get('version')}, not {FORMAT} of {VERSION}")
    splits: dict[str, list[dict]] = {}
    for f in listed["files"]:
        splits.setdefault(f["split"], []).append(f)
    for split, files in splits.items():
        if sorted(f["rank"] for f in files) != list(range(listed["ranks"])):
            raise IntegrityError(f"{path}: ranks {sorted(f['rank'] for f in files)} of {split or 'all'}, not 0 to {listed['ranks'] - 1}")
        if len({(f["steps"], f["first_us"], f["last_us"], f["times"]) for f in files}) > 1:
            raise IntegrityError(f"{path}: the ranks of {split or 'all'} differ in their times")


def check_file(entry: dict, reading: Reading, path: str) -> None:
    """Raise unless the file is what the catalog says, with all its committed steps."""
    a, head = reading.head.attributes, reading.head
    if (a.get("format"), a.get("version"), a.get("rank")) != (FORMAT, VERSION, entry["rank"]):
        raise IntegrityError(f"{path}: not rank {entry['rank']} of a {FORMAT} of version {VERSION}")
    steps = (reading.length - min(v.begin for v in head.variables.values() if v.record)) // head.record_size
    if not entry["steps"] == a.get("committed_steps") == head.records == steps:
        raise IntegrityError(f"{path}: {entry['steps']} steps in the catalog, {a.get('committed_steps')} committed, {head.records} in the header, {steps} in the file")


def write_ranks(df: DataFrame, path: str, variable: str, time: str, point: str, value: str, ranks: int, rank: Column | None = None, split: Column | None = None) -> None:
    """``df`` as frames: a file for each rank (0 to ``ranks`` - 1; the point modulo that, unless given) and split.

    A rank's points are the same in all its files, and all ranks have all times. Two values of one time and point are an error, and so is a point of several ranks.
    """
    rank = rank if rank is not None else F.pmod(F.col(point), F.lit(ranks))
    rows = df.select(rank.cast("int").alias("rank"), (split.cast("string") if split is not None else F.lit("")).alias("split"), F.col(time).cast("timestamp_ntz").alias("time"), F.col(point).cast("long").alias("point"), F.col(value).cast("double").alias("value"))
    if bad := rows.where(f"rank IS NULL OR rank NOT BETWEEN 0 AND {ranks - 1} OR time IS NULL OR point IS NULL OR split IS NULL").limit(1).collect():
        raise ValueError(f"a row outside {ranks} ranks, or without time, point or split: {bad[0]}")
    times = scratch.saved(rows.select("split", "time").distinct(), "times")  # a row a step
    steps = times.groupBy("split").agg(F.count("*").alias("steps"))
    each = F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank")
    frames = times.join(steps, "split").select(each, "split", "steps", "time", F.lit(None).cast("long").alias("point"), F.lit(None).cast("double").alias("value"))
    points = rows.select("rank", "point").distinct().join(steps.select(each, "split", "steps"), "rank").withColumns({"time": F.lit(None).cast("timestamp_ntz"), "value": F.lit(None).cast("double")})
    every = rows.join(steps, "split").unionByName(points).unionByName(frames)
    dealt = every.repartition("rank", "split").sortWithinPartitions("rank", "split", "time", "point")  # nulls first
    if both := rows.select("rank", "point").distinct().groupBy("point").count().where("count > 1").limit(5).collect():
        raise IntegrityError(f"points of several ranks: {[r[0] for r in both]}")
    register(df.sparkSession)
    dealt.select("rank", "split", "steps", "time", "point", "value").write.format("netcdf").option("path", path).option("variables", variable).mode("append").save()


def read(spark: SparkSession, path: str, *variables: str, start: datetime | None = None, end: datetime | None = None, points: tuple[float, float] | None = None, **options) -> DataFrame:
    """(file, time, a double for each further dimension, a double for each variable) with start <= time < end; ``points``: from and to, of files with one further dimension."""
    register(spark)
    if points:
        options |= {"least": points[0], "greatest": points[1]}
    options |= {k: t.isoformat() for k, t in (("start", start), ("end", end)) if t}
    return spark.read.format("netcdf").options(path=path, variables=",".join(variables), **options).load()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The checked catalog, a row a file: file, rank, split, steps, points, least_point, greatest_point, first, last."""
    where, at = store(path)
    listed = catalog(where, at)
    if not listed:
        raise FileNotFoundError(f"{path} has no catalog")
    check_catalog(listed, path)
    stamp = lambda us: datetime(1970, 1, 1) + (datetime.fromtimestamp(us / 1e6, UTC).replace(tzinfo=None) - datetime(1970, 1, 1))
    rows = [(f["file"], f["rank"], f["split"], f["steps"], f["points"], f["least_point"], f["greatest_point"], stamp(f["first_us"]), stamp(f["last_us"])) for f in listed["files"]]
    return spark.createDataFrame(rows, "file string, rank int, split string, steps int, points int, least_point long, greatest_point long, first timestamp_ntz, last timestamp_ntz")
