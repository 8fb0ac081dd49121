"""NetCDF classic files (CDF-1, CDF-2, CDF-5 headers without 64-bit types), one Spark row per value.

Headers are parsed from the first bytes of a file, and values are read by ranges
of the leading dimension; ``netcdf_source`` plans Spark partitions from that.
``variable`` is for stores that only Spark's own readers reach: there files come
through the binaryFile source, each whole, in one task. NetCDF-4 files are HDF5
and need a library that isn't assumed here.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Numpy types by NetCDF type number, and list tags of the header.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
_UNITS = re.compile(r"(second|minute|hour|day)s? since (\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+)(?::(\d+))?)?", re.I)


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    dtype: str
    attributes: dict
    begin: int
    record: bool
    size: int = 0


@dataclass
class Header:
    dims: dict[str, int] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0


class _Cursor:
    def __init__(self, data: memoryview):
        self.data, self.at = data, 0

    def number(self, kind: str = ">i") -> int:
        (x,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return x

    def padded(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise IndexError("the header goes on")
        out = bytes(self.data[self.at : self.at + n])
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def listed(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a NetCDF classic header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTES)):
            name, kind, n = self.name(), self.number(), self.number()
            values = np.frombuffer(self.padded(n * np.dtype(TYPES[kind]).itemsize), TYPES[kind])
            out[name] = values.tobytes().decode() if kind == 2 else values[0].item() if n == 1 else values.tolist()
        return out


def header(data: memoryview, length: int | None = None) -> Header:
    """The header at the start of ``data``; ``length`` is the whole file's, where data is less. Too little data is an IndexError or struct.error."""
    if bytes(data[:3]) != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    c, out = _Cursor(data), Header()
    c.at = 4
    records = c.number()
    names = []
    for _ in range(c.listed(DIMENSIONS)):
        names.append(c.name())
        out.dims[names[-1]] = c.number()
    out.attributes = c.attributes()
    for _ in range(c.listed(VARIABLES)):
        name = c.name()
        dims = [names[c.number()] for _ in range(c.number())]
        attributes, kind = c.attributes(), c.number()
        size, begin = c.number(), c.number(">i" if data[3] == 1 else ">q")
        out.variables[name] = Variable(name, dims, [out.dims[d] for d in dims], TYPES[kind], attributes, begin, bool(dims) and out.dims[dims[0]] == 0, size)
    varying = [v for v in out.variables.values() if v.record]
    own = lambda v: int(np.prod(v.shape[1:])) * np.dtype(v.dtype).itemsize
    out.record_size = own(varying[0]) if len(varying) == 1 else sum(-(-own(v) // 4) * 4 for v in varying)
    if records < 0 and varying:  # still being written: as many as there are
        records = ((length or len(data)) - min(v.begin for v in varying)) // out.record_size
    out.records = max(records, 0)
    for v in varying:
        v.shape[0] = out.records
    out.dims = {d: n or out.records for d, n in out.dims.items()}
    return out


def slices(data: memoryview, head: Header, name: str) -> Iterator[np.ndarray]:
    """The variable along its leading dimension, each slice flat, as doubles; fill values become NaN; scaled."""
    v = head.variables[name]
    count, step = extent(head, v)
    for k in range(v.shape[0] if v.shape else 1):
        yield real(np.frombuffer(data, v.dtype, count, v.begin + k * step), v)


def extent(head: Header, v: Variable) -> tuple[int, int]:
    """Values of one slice of the leading dimension, and bytes from one slice to the next."""
    count = int(np.prod(v.shape[1:]))
    return count, head.record_size if v.record else count * np.dtype(v.dtype).itemsize


def real(raw: np.ndarray, v: Variable) -> np.ndarray:
    """Stored values as doubles: fill values become NaN, others are scaled."""
    x, a = raw.astype(float), v.attributes
    for fill in (a.get("_FillValue"), a.get("missing_value")):
        if fill is not None:
            x[raw == fill] = np.nan
    return x * a.get("scale_factor", 1.0) + a.get("add_offset", 0.0)


def packed(dims: dict[str, int | None], variables: dict[str, tuple[list[str], str, dict]], attributes: dict, records: int) -> tuple[bytes, dict[str, int], int]:
    """A header (64-bit offsets), where each variable begins, and the bytes of a record. dims: length, or None for the leading, growing one; variables: (dims, type, attributes)."""
    number = {t: n for n, t in TYPES.items()}

    def text(x: str) -> bytes:
        b = x.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def value(x) -> bytes:
        kind, raw, n = (2, x.encode(), len(x.encode())) if isinstance(x, str) else (4, struct.pack(">i", x), 1) if isinstance(x, int) else (6, struct.pack(">d", x), 1)
        return struct.pack(">ii", kind, n) + raw + b"\0" * (-len(raw) % 4)

    attrs = lambda a: listed(ATTRIBUTES, [text(k) + value(x) for k, x in a.items()])
    names = list(dims)
    bytes_of = {v: -(-int(np.prod([dims[d] for d in ds if dims[d] is not None])) * np.dtype(t).itemsize // 4) * 4 for v, (ds, t, _) in variables.items()}
    growing = [v for v, (ds, _, _) in variables.items() if ds and dims[ds[0]] is None]

    def build(begin: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", records) + listed(DIMENSIONS, [text(d) + struct.pack(">i", n or 0) for d, n in dims.items()]) + attrs(attributes)
        return out + listed(VARIABLES, [text(v) + struct.pack(f">i{len(ds)}i", len(ds), *(names.index(d) for d in ds)) + attrs(a) + struct.pack(">iiq", number[t], min(bytes_of[v], 2**31 - 4), begin.get(v, 0)) for v, (ds, t, a) in variables.items()])

    at, begin = len(build({})), {}
    for v in [v for v in variables if v not in growing] + growing:
        begin[v] = at
        at += bytes_of[v]
    return build(begin), begin, sum(bytes_of[v] for v in growing)


def times(values: np.ndarray, units: str) -> list[datetime]:
    found = _UNITS.match(units)
    if not found:
        raise ValueError(f"unknown time units {units!r}")
    unit, *date = found.groups()
    origin = datetime(*(int(x or 0) for x in date))
    return [origin + timedelta(microseconds=round(x * 1e6 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.lower()])) for x in values.tolist()]


def variable(spark: SparkSession, path: str, name: str, dims: tuple[str, ...], glob: str = "*.nc") -> DataFrame:
    """(file, time, one column of coordinate values per further dimension, value) of a variable with exactly these dimensions.

    The first dimension is time (in CF units of the standard calendar). A dimension without coordinate variable counts from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                head = header(data)
                if name not in head.variables or tuple(head.variables[name].dims) != dims:
                    raise ValueError(f"{path}: {name} is not a variable of {dims}")
                axis = lambda d: np.concatenate(list(slices(data, head, d))) if d in head.variables else np.arange(head.dims[d], dtype=float)
                at = times(axis(dims[0]), head.variables[dims[0]].attributes.get("units", ""))
                mesh = [m.reshape(-1) for m in np.meshgrid(*map(axis, dims[1:]), indexing="ij")]
                for t, x in zip(at, slices(data, head, name)):
                    n = len(x)
                    columns = [pa.array([path.rpartition("/")[2]] * n), pa.array([t] * n, pa.timestamp("us")), *map(pa.array, mesh), pa.array(x)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "time", *dims[1:], "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, time timestamp_ntz, " + "".join(f"`{d}` double, " for d in dims[1:]) + "value double")
