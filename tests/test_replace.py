"""Files put in place of others: a crash at each step ends in the old or the new state; kept tables and two writers."""

import threading

import pytest
from pyspark.sql import functions as F

from cuewright.sources import sinks
from cuewright.sources.replace import Journal


@pytest.fixture
def made(spark, tmp_path):
    root = tmp_path
    rows = []
    for k in range(1, 9):
        path = lambda kind, k=k: str(root / f"{k}.{kind}")
        if k != 4:
            (root / f"{k}.in").write_text("old")
        if k != 5:
            (root / f"{k}.temp").write_text("new")
        rows.append((k, path("in"), path("temp"), path("in") if k % 2 else path("out"), path("backup")))
    journal = Journal(spark, str(root / "journal"))
    journal.plan(spark.createDataFrame(rows, "plan_id bigint, input string, temp string, final string, backup string"))
    return journal, root


def found(root):
    return {p.name: p.read_text() for p in root.iterdir() if p.is_file()}


def states(journal):
    return {r.plan_id: r.state for r in journal.states().collect()}


NEW = {f"{k}.{'in' if k % 2 else 'out'}": "new" for k in (1, 2, 3, 4, 6, 7, 8)} | {"5.in": "old"}
OLD = {f"{k}.in": "old" for k in (1, 2, 3, 5, 6, 7, 8)}


def test_commit(made):
    journal, root = made
    assert states(journal) == {k: "refused" if k == 5 else "planned" for k in range(1, 9)}
    journal.commit()
    assert found(root) == NEW
    assert states(journal) == {k: "refused" if k == 5 else "done" for k in range(1, 9)}
    journal.recover()
    journal.commit()
    assert found(root) == NEW


@pytest.mark.parametrize("steps, want", [((), OLD), (("move",), OLD), (("move", "promote"), NEW), (("move", "promote", "finish"), NEW)])
def test_a_crash_between_steps(made, steps, want):
    journal, root = made
    for step in steps:
        getattr(journal, step)()
    again = Journal(journal.spark, journal.folder)
    again.recover()
    again.recover()
    assert found(root) == want
    assert set(states(again).values()) <= {"done", "rolled back", "refused"}


@pytest.mark.parametrize("step", ["move", "promote", "finish"])
def test_a_crash_before_a_step_is_written_down(made, monkeypatch, step):
    """The files of a step were renamed, but its rows never reached the journal."""
    journal, root = made
    for before in ("move", "promote", "finish")[: ("move", "promote", "finish").index(step)]:
        getattr(journal, before)()
    plain = Journal._step

    def lost(self, todo, act):
        kept, self.folder = self.folder, f"{self.folder}/lost"
        try:
            plain(self, todo, act)
        finally:
            self.folder = kept

    with monkeypatch.context() as m:
        m.setattr(Journal, "_step", lost)
        getattr(journal, step)()
    journal.recover()
    assert found(root) == (OLD if step == "move" else NEW)


def test_a_failed_promotion_restores_the_original(made):
    journal, root = made
    journal.move()
    (root / "2.out").mkdir()
    (root / "2.out" / "x").write_text("in the way")
    journal.promote()
    row = journal.states().filter("plan_id = 2").first()
    assert row.state == "rolled back" and row.error
    assert found(root)["2.in"] == "old"


def test_of_two_writers_one_fails(spark, tmp_path):
    folder, slow = str(tmp_path / "table"), F.pandas_udf(lambda s: (__import__("time").sleep(2), s)[1], "long")
    made = []

    def write(k):
        try:
            made.append(sinks.write_table(spark.range(3).select(slow(F.col("id")).alias("id"), F.lit(k).alias("writer")), folder))
        except FileExistsError:
            made.append(None)

    for _ in range(2):
        both = [threading.Thread(target=write, args=(k,)) for k in range(2)]
        for t in both:
            t.start()
        for t in both:
            t.join()
    assert sorted(x for x in made if x) == [1, 2] and made.count(None) == 2
    for v in (1, 2):
        assert spark.read.parquet(f"{folder}/v={v}").select("writer").distinct().count() == 1
    assert sinks.versions(spark, folder) == [1, 2] and not list(tmp_path.glob("table/_new*"))
