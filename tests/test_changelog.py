"""State by changes: two phases, retries, half-done steps, compaction; streams that run on it."""

import pytest
from meander.operators.lookup import IntegrityError
from meander.sources import changelog, files
from meander.sources.changelog import ChangeLog, Poisoned
from pyspark.sql import functions as F


def table(spark, held):
    return spark.createDataFrame(list(held.items()), "k long, v long")


def held(df):
    return {r.k: r.v for r in df.collect()}


def log_of(spark, path, **options):
    return ChangeLog(spark, f"file://{path}/log", ["k"], 3, F.col("k") % 3, **options)


def test_changes_removals_and_bases(spark, tmp_path):
    log, want = log_of(spark, tmp_path, compact_every=3), {k: 0 for k in range(9)}
    assert log.last_step() is None
    log.begin(table(spark, want))
    log.begin(table(spark, {1: 1}))  # there is a state already
    for step in range(8):
        changed = {step: step + 100, 20 + step: step}
        gone = {step - 1} if step % 2 else set()

        def body(state):
            assert held(state) == want
            return table(spark, changed | {k: 0 for k in gone}).withColumn("removed", F.col("k").isin(*gone) if gone else F.lit(False))

        before = dict(want)
        assert log.run(step, body) and log.last_step() == step
        want = {k: v for k, v in (want | changed).items() if k not in gone}
        log.verify()
        assert held(log.state()) == want
        if step % 3:
            assert held(log.state(step - 1)) == before
        assert not log.run(step, lambda state: 1 / 0)  # a batch that is replayed
    assert len(files.names(spark, f"{log.folder}/bases")) <= 2 and len(files.names(spark, f"{log.folder}/changes")) <= 6
    # what is read is read anew by another process
    assert held(log_of(spark, tmp_path).state()) == want
    log.run(8, lambda state: state.limit(0))
    assert held(log.state()) == want


def test_a_failed_step_leaves_nothing_and_may_be_run_again(spark, tmp_path):
    log = log_of(spark, tmp_path)
    with pytest.raises(IntegrityError, match="does not follow"):
        log.run(0, lambda s: s)
    log.begin(table(spark, {1: 1, 2: 2}))
    fails = F.raise_error(F.lit("a bad row")).cast("long")
    for body, error in ((lambda s: 1 / 0, ZeroDivisionError), (lambda s: s.withColumn("v", fails), Exception), (lambda s: s.unionByName(s), IntegrityError)):
        with pytest.raises(error):
            log.run(0, body)
        assert log.last_step() == -1 and held(log.state()) == {1: 1, 2: 2}
        assert not files.names(spark, f"{log.folder}/manifests") and not files.exists(spark, f"{log.folder}/running.json")
    with pytest.raises(IntegrityError, match="does not follow"):
        log.run(1, lambda s: s)
    assert log.run(0, lambda s: s.withColumn("v", F.col("v") * 10)) and held(log.state()) == {1: 10, 2: 20}


@pytest.mark.parametrize("phase", ["body", "rows", "manifest", "commit"])
def test_lost_between_the_phases(spark, tmp_path, monkeypatch, phase):
    """The driver is lost in a step: nothing is taken back, as by an exception. The next one refuses, recovers, and goes on to equal totals."""
    log = log_of(spark, tmp_path)
    log.begin(table(spark, {1: 1, 2: 2}))
    add = lambda s: s.withColumn("v", F.col("v") + 1)
    log.run(0, add)

    class Lost(BaseException):
        pass

    def lose(*a, **b):
        raise Lost

    with monkeypatch.context() as m:
        if phase == "rows":
            m.setattr(changelog, "require_unique", lose)
        elif phase == "manifest":
            m.setattr(log, "commit", lose)
        elif phase == "commit":
            m.setattr(files, "delete", lose)
        with pytest.raises(Lost):
            log.run(1, lose if phase == "body" else add)
    again = log_of(spark, tmp_path)
    done = phase == "commit"
    assert held(again.state()) == ({1: 3, 2: 4} if done else {1: 2, 2: 3})
    with pytest.raises(Poisoned, match="step 1 stopped half-way"):
        again.run(2 if done else 1, add)
    assert again.recover() == (1 if done else 0) and again.recover() == (1 if done else 0)
    for step in range(1, 3):
        again.run(step, add)
    assert held(again.state()) == {1: 4, 2: 5}
    again.verify()


def test_only_one_commit_of_a_step(spark, tmp_path):
    a, b = log_of(spark, tmp_path), log_of(spark, tmp_path)
    a.begin(table(spark, {1: 1}))
    a.prepare(0, "a", table(spark, {1: 2}))
    b.prepare(0, "b", table(spark, {1: 3}))
    with pytest.raises(IntegrityError, match="not all ranks are prepared"):
        a.commit(0, "c")
    b.commit(0, "b")
    with pytest.raises(IntegrityError, match="does not follow"):
        a.commit(0, "a")
    assert not files.publish(spark, f"{a.folder}/commits/0.json", {}) and held(a.state()) == {1: 3}


def test_rows_outside_the_ranks_and_damage(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", ["k"], 2, F.col("k"))
    log.begin(table(spark, {0: 0}))
    with pytest.raises(IntegrityError, match="ranks"):
        log.run(0, lambda s: table(spark, {5: 1}))
    log.run(0, lambda s: table(spark, {1: 1}))
    path = f"{log.folder}/changes/{log._commit(0)['attempts'][-1]}/rank=1"
    table(spark, {7: 7}).withColumn("removed", F.lit(False)).write.mode("append").parquet(path)
    with pytest.raises(IntegrityError, match="the commit has"):
        log.verify()
