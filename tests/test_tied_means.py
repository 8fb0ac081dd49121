"""Windows whose means are equal but for rounding, against SQL over a table in order of time."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from meander.operators import statistics
from meander.plans.temporal import CalendarWindow
from meander.queries import QUERIES, SQL
from meander.streaming import keyed

from .comparing import oracle, rows_of

USERS = 120


def added(xs):
    total = 0.0
    for x in xs:
        total += x
    return total


def tied(rng, low, high):
    """Two lists of three values (times 100 whole) with equal sums, which adding one by one makes different."""
    while True:
        a, b = ([rng.randrange(low, high) for _ in range(3)] for _ in range(2))
        b[2] = sum(a) - b[0] - b[1]
        x, y = ([v / 100 for v in vs] for vs in (a, b))
        if low <= b[2] < high and math.fsum(x) == math.fsum(y) and added(x) != added(y):
            return x, y


@pytest.fixture(scope="module")
def events():
    """Per user five days of one outer window: two tied ones of high means, two of low ones, one between; a last event closes it."""
    rng, first, rows = random.Random(5), datetime(2024, 1, 3), []
    for user in range(USERS):
        days = [*tied(rng, 20_000, 30_000), *tied(rng, 100, 9_000), [rng.randrange(12_000, 16_000) / 100]]
        rng.shuffle(days)
        rows += [(first + timedelta(days=k, hours=1 + 7 * n, seconds=user), user, v) for k, day in enumerate(days) for n, v in enumerate(day)]
    rows = [*sorted(rows), (datetime(2024, 1, 9), USERS, 1.0)]
    return pd.DataFrame([(k, t, u, "view", v, "{}") for k, (t, u, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    path = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.register("e", events)
    con.execute(f"COPY (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, props FROM e) TO '{path}/events.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["d26_best_times", "j2_stream_best", "d26_arg_time", "e4_arg", "e5_argmax3_mean"])
def test_query(spark, folder, name):
    df, found = QUERIES[name](spark, folder), oracle(folder).execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("weighted", [False, True])
def test_samples_are_added_in_order_of_time(spark, events, weighted):
    """Whatever the order of the rows and the partitions."""
    rng, weights = random.Random(6), [0.1, 0.3, 0.7] if weighted else [1.0]
    data = [(r.ts.to_pydatetime(), r.user_id, r.value, weights[k % len(weights)]) for k, r in enumerate(events.itertuples())]
    want = {}
    for t, u, v, w in data:
        days = want.setdefault(u, {}).setdefault(t.date(), [])
        days.append((v * w, w))
    mean = lambda day: added(x for x, _ in day) / added(w for _, w in day)
    want = {u: sorted(range(len(days)), key=lambda k, own=[mean(days[d]) for d in sorted(days)]: (own[k], k)) for u, days in want.items()}
    for parts in (1, 5):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "t timestamp_ntz, p long, v double, w double").repartition(parts)
        out = statistics.two_level(df, ["p"], "t", "v", CalendarWindow("day"), CalendarWindow("month"), ["argmin5_mean"], "w" if weighted else None)
        assert {r.p: r.argmin5_mean for r in out.collect()} == want


def test_streamed_samples_are_added_in_order_of_time(events, monkeypatch):
    """Frame by frame in any order, behind what an earlier batch has come to; also as blocks, which are ordered each."""
    rows = events[events["user_id"] < 40].assign(_t=0, start=0, outer_start=0, outer_end=0, end_ms=lambda f: f["ts"].dt.day, p=lambda f: f["user_id"], _us=lambda f: f["ts"].astype("int64"), _value=lambda f: f["value"])
    rows = rows[["p", *keyed._SAMPLE]]
    own = lambda f: {k: added(g.sort_values("_us")["_value"]) for k, g in f.groupby(["end_ms", "p"])}
    totals = lambda f: {(r.end_ms, r.p): r.total for r in f.itertuples()}
    mixed = rows.sample(frac=1, random_state=1)
    blocks = list(keyed._blocks(mixed.iloc[k : k + 50] for k in range(0, len(mixed), 50)))
    assert len(blocks) == 1 and totals(keyed._reduced(keyed._samples(blocks[0]), ["end_ms", "p"])) == own(rows)
    early = keyed._reduced(keyed._samples(mixed[mixed["_us"] % 3 == 0]), ["end_ms", "p"])
    late = mixed[mixed["_us"] % 3 != 0]
    both = keyed._reduced(pd.concat([early, keyed._samples(late)], ignore_index=True), ["end_ms", "p"])
    assert totals(both) == {k: added([*([totals(early)[k]] if k in totals(early) else []), *late[(late["end_ms"] == k[0]) & (late["p"] == k[1])].sort_values("_us")["_value"]]) for k in own(rows)}
    monkeypatch.setattr(keyed, "HELD", 100)
    blocks = list(keyed._blocks(mixed.iloc[k : k + 50] for k in range(0, len(mixed), 50)))
    assert [len(b) for b in blocks] == [100] * (len(mixed) // 100) + [len(mixed) % 100]
