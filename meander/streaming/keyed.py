"""Two-level windows over streams by keyed state: arg and best-of-K results, and windows that the caller's flags open and close.

State is kept per bucket of points with ``transformWithState``: the open inner windows
(a few numbers each, as columns), the open outer ones (what their closed inner windows
have come to: K pairs per best-of-K), and a timer at the first end. When the
watermark passes an inner window's end, the window is numbered and folded into
its outer one; when it passes an outer window's end, the row comes out. State is thus bounded
by the windows that are open, not by samples. Points share buckets because a call to the
state costs more than a window's arithmetic. A bucket's samples of a batch are added one by one
in order of time (equal times: of value), to what earlier batches have come to. Where they are
more than ``HELD``, each block of so many is put in order by itself, as they come.

``open_windows`` reads the same state back from a stream's checkpoint, running or
stopped: what the open outer windows hold so far.

Windows end on whole milliseconds. Rows with a null or NaN value, or without time or
point, are left out, and so are late ones (the watermark decides). Equal values keep the earliest
inner window, as in batch. The RocksDB state store is needed: call ``prepare``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.statistics import Operation, operation
from ..plans.temporal import at_micros, check_nested, micros

#: Columns of a point's part of an inner window.
_PART = {"total": "double", "n": "long", "most": "double", "least": "double", "first_at": "long", "first": "double", "last_at": "long", "last": "double"}
#: Samples of a bucket and batch that are held at a time.
HELD = 1_000_000
_WINDOW = {"end_ms": "long", "start": "long", "outer_start": "long", "outer_end": "long"}
#: Columns behind the points, as the processors get them: by place, since Spark renames them.
_SAMPLE = ("_t", "_us", "_value", "start", "end_ms", "outer_start", "outer_end")
_STEP = ("_us", "_value", "_first", "_last", "_outer_first", "_outer_last")
_STEPS = "total double, n long, most double, least double, first double, last double"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ops(names: list[str]) -> list[Operation]:
    ops = [operation(o) for o in dict.fromkeys(names)]
    if bad := [o.name for o in ops if o.outer is None or "mid" in (o.inner, o.outer)]:
        raise ValueError(f"not for streams: {bad}")
    return ops


def merged(old: tuple | None, new: tuple) -> tuple:
    """Two parts of one window: (total, n, most, least, first_at, first, last_at, last)."""
    if old is None:
        return new
    first, last = old if old[4] <= new[4] else new, new if new[6] >= old[6] else old
    return (old[0] + new[0], old[1] + new[1], _most(old[2], new[2]), _least(old[3], new[3]), first[4], first[5], last[6], last[7])


def _most(a: float, b: float) -> float:
    return a if math.isnan(a) or a > b else b  # NaN is the largest, as in batch


def _least(a: float, b: float) -> float:
    return b if math.isnan(a) or a > b else a


def inner_value(kind: str, w: tuple) -> float:
    return {"mean": w[0] / w[1], "sum": w[0], "max": w[2], "min": w[3], "first": w[5], "last": w[7]}[kind]


class Folds:
    """Folds inner results into the slots of an outer window: one number an operation, or K (value, ordinal) pairs."""

    def __init__(self, ops: list[Operation]):
        self.ops = ops
        self.sizes = [2 * o.k if o.arg or o.k > 1 else 1 for o in ops]

    def folded(self, slots: list[float] | None, n: int, inner: tuple) -> list[float]:
        """The slots after inner window number ``n`` (from 0)."""
        out: list[float] = []
        at = 0
        for o, size in zip(self.ops, self.sizes):
            old, v = slots[at : at + size] if n else [], inner_value(o.inner, inner)
            at += size
            if size > 1 or o.arg:
                best = [(x, k) for x, k in zip(old[::2], old[1::2])][: min(n, o.k)] + [(v, float(n))]
                best.sort(key=lambda b: (_order(b[0], o.outer == "max"), b[1]))
                best = (best + [(0.0, -1.0)] * o.k)[: o.k]
                out += [x for b in best for x in b]
            elif n == 0 or o.outer == "last":
                out.append(v)
            else:
                out.append({"mean": lambda a, b: a + b, "sum": lambda a, b: a + b, "max": _most, "min": _least, "first": lambda a, b: a}[o.outer](old[0], v))
        return out

    def results(self, slots: list[float], n: int) -> list:
        out: list = []
        at = 0
        for o, size in zip(self.ops, self.sizes):
            own = slots[at : at + size]
            at += size
            if size > 1 or o.arg:
                found = [int(x) for x in own[1::2]] if o.arg else list(own[::2])
                out.append(found[0] if o.k == 1 else found[: min(n, o.k)])
            else:
                out.append(own[0] / n if o.outer == "mean" else own[0])
        return out

    def schema(self) -> str:
        kind = lambda o: ("bigint" if o.arg else "double") if o.k == 1 else f"array<{'bigint' if o.arg else 'double'}>"
        return ", ".join(f"`{o.name}` {kind(o)}" for o in self.ops)


def _order(x: float, down: bool) -> tuple:
    """Sorting key of a value: NaN is the largest."""
    nan = math.isnan(x)
    return (not nan, 0.0 if nan else -x) if down else (nan, 0.0 if nan else x)


def _row(points: tuple, outer: int, last: int, n: int, results: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: [v] for c, v in zip(names, (*points, outer, last, n, *results))})


def _carried(schema: StructType, points: list[str]) -> dict[str, str]:
    """Names and types by which points pass through Python: times as microseconds and bytes as text, which are the same on both sides."""
    as_is = lambda t: ("p", t)
    found = [{"timestamp": ("t", "bigint"), "timestamp_ntz": ("z", "bigint"), "binary": ("b", "string")}.get(t, as_is(t)) for t in (schema[p].dataType.simpleString() for p in points)]
    return {f"_{how}{k}": kind for k, (how, kind) in enumerate(found)}


def _encoded(carried: Iterable[str], points: list[str]) -> list[Column]:
    to = {"p": lambda c: c, "t": F.unix_micros, "z": micros, "b": F.hex}
    return [to[name[1]](F.col(p)).alias(name) for name, p in zip(carried, points)]


def _decoded(carried: Iterable[str], points: list[str]) -> list[Column]:
    back = {"p": lambda c: c, "t": F.timestamp_micros, "z": at_micros, "b": F.unhex}
    return [back[name[1]](F.col(name)).alias(p) for name, p in zip(carried, points)]


def _reduced(parts: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """One row a group: ``merged`` over its rows, whose totals are added in their order."""
    if len(parts) < 2:
        return parts
    code = parts.groupby(by, sort=False).ngroup().to_numpy()
    size = int(code.max()) + 1
    early, late = np.lexsort((parts["first_at"].to_numpy(), code)), np.lexsort((parts["last_at"].to_numpy(), code))  # stable
    edges = np.searchsorted(code[early], np.arange(size + 1))
    heads, tails = early[edges[:-1]], late[edges[1:] - 1]
    out = parts.iloc[heads].reset_index(drop=True)
    for c in ("total", "n"):
        out[c] = np.bincount(code, weights=parts[c].to_numpy(), minlength=size).astype(out[c].dtype)
    out["most"], out["least"] = (f.reduceat(parts[c].to_numpy()[early], edges[:-1]) for f, c in ((np.maximum, "most"), (np.minimum, "least")))
    for c in ("last_at", "last"):
        out[c] = parts[c].to_numpy()[tails]
    return out


def _samples(frame: pd.DataFrame) -> pd.DataFrame:
    """Samples as parts of their inner windows, in order of time."""
    frame = frame.iloc[np.lexsort((frame["_value"].to_numpy(), frame["_us"].to_numpy()))]
    x, us = frame["_value"].to_numpy(), frame["_us"].to_numpy()
    found = {"total": x, "n": np.ones(len(x), "int64"), "most": x, "least": x, "first_at": us, "first": x, "last_at": us, "last": x}
    return frame.drop(columns=["_t", "_us", "_value"]).assign(**found)


def _blocks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames put together until they have ``HELD`` rows."""
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= HELD:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


class TwoLevel(StatefulProcessor):
    def __init__(self, carried: dict[str, str], ops: list[Operation]):
        self.points, self.folds = list(carried), Folds(ops)
        self.kinds = (_WINDOW | carried | _PART, {"end_ms": "long", "outer_start": "long"} | carried | {"n": "long", "last": "long", "slots": "array<double>"})
        self.names = [*self.points, "outer_us", "last_us", "n_inner", *(o.name for o in ops)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = lambda kinds: ", ".join(f"{c} array<{t}>" for c, t in kinds.items())
        self.handle = handle
        self.inner, self.outer = (handle.getValueState(name, arrays(kinds)) for name, kinds in zip(("inner", "outer"), self.kinds))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by, columns = ["end_ms", *self.points], list(self.kinds[0])
        both = None
        for block in _blocks(f.set_axis(["_bucket", *self.points, *_SAMPLE], axis=1) for f in rows if len(f)):
            new = _samples(block)[columns]
            if both is None and self.inner.exists():
                both = pd.DataFrame(dict(zip(columns, self.inner.get()))).astype(dict(new.dtypes))
            both = _reduced(new if both is None else pd.concat([both, new], ignore_index=True), by)
        if both is not None:
            self.inner.update(tuple(both[c].tolist() for c in columns))
            self.handle.registerTimer(int(both["end_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Folds all windows that the watermark has passed; the next timer is the first end among the others."""
        now, width = timerValues.getCurrentWatermarkInMs(), len(self.points)
        inner = list(zip(*self.inner.get())) if self.inner.exists() else []
        held = {r[: 2 + width]: r[2 + width :] for r in zip(*self.outer.get())} if self.outer.exists() else {}
        at = len(_WINDOW) + width
        for w in sorted((w for w in inner if w[0] <= now), key=lambda w: w[0]):  # windows close in time order
            end, start, outer_start, outer_end = w[:4]
            outer = (outer_end, outer_start, *w[4:at])
            n, _, slots = held.get(outer, (0, 0, None))
            held[outer] = (n + 1, start, self.folds.folded(slots, n, w[at:]))
        opened = [w for w in inner if w[0] > now]
        rest = [(*o, *h) for o, h in held.items() if o[0] > now]
        if len(opened) < len(inner):
            _keep(self.inner, opened)
        if len(opened) < len(inner) or len(rest) < len(held):
            _keep(self.outer, rest)
        if ends := [r[0] for r in opened + rest]:
            self.handle.registerTimer(min(ends))
        done = [(*o[2:], o[1], last, n, *self.folds.results(list(slots), n)) for o, (n, last, slots) in held.items() if o[0] <= now]
        if done:
            yield pd.DataFrame(dict(zip(self.names, map(list, zip(*done)))))

    def close(self) -> None:
        pass


def _keep(state, rows: list[tuple]) -> None:
    if rows:
        state.update(tuple(map(list, zip(*rows))))
    else:
        state.clear()


def _named(df: DataFrame, carried: Iterable[str], points: list[str], ops: list[Operation]) -> DataFrame:
    return df.select(*_decoded(carried, points), at_micros(F.col("outer_us")).alias("outer_start"), at_micros(F.col("last_us")).alias("time"), "n_inner", *(o.name for o in ops))


def _types(schema: StructType, points: list[str]) -> str:
    return ", ".join(f"`{p}` {schema[p].dataType.simpleString()}" for p in points)


def _kinds(carried: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in carried.items())


def two_level_keyed(stream: DataFrame, points: list[str], time: str, value: str, inner, outer, operations: list[str], late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """``two_level`` of a stream, any operation but mid: (points, outer_start, time, n_inner, a column per operation), a row when the outer window has passed.

    ``inner`` and ``outer`` are window rules with starts and ends (calendar or interval windows). ``buckets``: how many groups
    of points keep their state together; tasks have whole buckets, and the number is fixed as long as a checkpoint lives.
    """
    check_nested(inner, outer)
    ops, carried = _ops(operations), _carried(stream.schema, points)
    t = F.col(time).cast("timestamp_ntz")
    i, o = inner.start(t), outer.start(t)
    ms = lambda end: F.ceil(micros(end) / 1000).cast("long")
    keyed = stream.dropna(subset=[*points, time, value])  # of NaN, too
    bucket = F.pmod(F.xxhash64(*points), F.lit(buckets)).cast("int").alias("_bucket")
    keyed = keyed.select(bucket, *_encoded(carried, points), F.col(time).cast("timestamp").alias("_t"), micros(t).alias("_us"), F.col(value).cast("double").alias("_value"), micros(i).alias("start"), ms(inner.end(i)).alias("end_ms"), micros(o).alias("outer_start"), ms(outer.end(o)).alias("outer_end"))
    out = f"{_kinds(carried)}, outer_us bigint, last_us bigint, n_inner bigint, {Folds(ops).schema()}"
    found = keyed.withWatermark("_t", late).groupBy("_bucket").transformWithStateInPandas(TwoLevel(carried, ops), out, "Append", "EventTime")
    return _named(found, carried, points, ops)


def open_windows(spark: SparkSession, checkpoint: str, points: list[str], operations: list[str], operator: int = 0) -> DataFrame:
    """What the outer windows that a ``two_level_keyed`` stream has not yet put out hold, as ``two_level`` would have it.

    Read from the state of the last committed batch; the open inner windows count as if they ended now.
    """
    ops = _ops(operations)
    folds = Folds(ops)
    read = lambda name: spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint)
    opened, outer = (read(name).select("value.*") for name in ("inner", "outer"))
    carried = dict(t for t in ((f.name, f.dataType.elementType.simpleString()) for f in outer.schema if f.name.startswith("_")))
    keys = [*carried, "outer_us"]
    opened = opened.select(F.inline(F.arrays_zip(*opened.columns))).withColumnRenamed("outer_start", "outer_us")
    inner = opened.select(*keys, F.struct("start", "total", "n", "most", "least", "first_at", "first", "last_at", "last").alias("w"))
    outer = outer.select(F.inline(F.arrays_zip(*outer.columns))).withColumnRenamed("outer_start", "outer_us").select(*keys, F.struct("n", "last", "slots").alias("h"))
    both = inner.groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("ws"))  # the open inner windows of one outer window
    both = both.join(outer, keys, "full").select(*keys, "ws", "h")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for ws, h in zip(f["ws"], f["h"]):
                n, last, slots = (h["n"], h["last"], list(h["slots"])) if h is not None else (0, 0, None)
                for w in ws if ws is not None else ():
                    slots = folds.folded(slots, n, tuple(w[c] for c in ("total", "n", "most", "least", "first_at", "first", "last_at", "last")))
                    n, last = n + 1, w["start"]
                done.append((last, n, *folds.results(slots, n)))
            named = pd.DataFrame({c: list(x) for c, x in zip(["last_us", "n_inner", *(o.name for o in ops)], zip(*done))}) if done else pd.DataFrame(columns=["last_us", "n_inner", *(o.name for o in ops)])
            yield pd.concat([f[keys].reset_index(drop=True), named], axis=1)

    return _named(both.mapInPandas(run, f"{_kinds(carried)}, outer_us bigint, last_us bigint, n_inner bigint, {folds.schema()}"), carried, points, ops)


class Flagged(StatefulProcessor):
    """Inner and outer windows opened and closed by four flags; state is the two open windows of a point."""

    def __init__(self, points: list[str], ops: list[Operation]):
        self.points, self.folds, self.names = points, Folds(ops), [*points, "outer_us", "last_us", "n_inner", *(o.name for o in ops)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner = handle.getValueState("inner", f"start long, {_STEPS}")
        self.outer = handle.getValueState("outer", "number long, n long, last long, slots array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        steps = pd.concat([f.set_axis([*self.points, *_STEP], axis=1) for f in rows if len(f)]).sort_values("_us", kind="stable")
        w = tuple(self.inner.get()) if self.inner.exists() else None
        number, n, last, slots = tuple(self.outer.get()) if self.outer.exists() else (-1, 0, 0, None)
        done = []
        for us, v, first, end, outer_first, outer_end in zip(*(steps[c].tolist() for c in ("_us", "_value", "_first", "_last", "_outer_first", "_outer_last"))):
            if (outer_first or outer_end) and not end:
                raise ValueError(f"outer flags need the inner window's last step: {key} at {us}")
            w = (us, v, 1, v, v, v, v) if first or w is None else (w[0], w[1] + v, w[2] + 1, _most(w[3], v), _least(w[4], v), w[5], v)
            if not end:
                continue
            if outer_first or number < 0:
                number, n, slots = number + 1, 0, None
            slots = self.folds.folded(slots, n, (w[1], w[2], w[3], w[4], 0, w[5], 0, w[6]))
            n, last, w = n + 1, w[0], None
            if outer_end:
                done.append((number, last, n, self.folds.results(slots, n)))
                n, slots = 0, None
        if w is None:
            self.inner.clear()
        else:
            self.inner.update(w)
        self.outer.update((number, n, last, slots or []))
        for number, last, n, results in done:
            yield _row(key, number, last, n, results, self.names)

    def close(self) -> None:
        pass


def flagged(stream: DataFrame, points: list[str], time: str, value: str, operations: list[str], first: str = "first", last: str = "last", outer_first: str = "outer_first", outer_last: str = "outer_last") -> DataFrame:
    """(points, outer, time, n_inner, a column per operation) of windows that four flags of each step open and close.

    An inner window begins where ``first`` says so (or none is open) and ends with ``last``; an outer one is numbered anew at the
    inner window whose last step has ``outer_first`` (or at the first), and comes out at ``outer_last``. Batches must follow in time.
    """
    ops = _ops(operations)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"_{n}") for c, n in ((first, "first"), (last, "last"), (outer_first, "outer_first"), (outer_last, "outer_last"))]
    keyed = stream.dropna(subset=[*points, time, value]).select(*points, micros(F.col(time).cast("timestamp_ntz")).alias("_us"), F.col(value).cast("double").alias("_value"), *flags)
    out = f"{_types(stream.schema, points)}, outer_us bigint, last_us bigint, n_inner bigint, {Folds(ops).schema()}"
    found = keyed.groupBy(*points).transformWithStateInPandas(Flagged(points, ops), out, "Append", "None")
    return found.select(*points, F.col("outer_us").alias("outer"), at_micros(F.col("last_us")).alias("time"), "n_inner", *(o.name for o in ops))
