"""Drains that touch what changed, drains beside other writers, builds in groups, reads by class."""

import datetime

import pytest
from pyspark.sql import functions as F

from cubeloom import Config, Engine
from cubeloom.cli import main
from cubeloom.demo.tables import EventDays, Sales, catalog
from cubeloom.errors import ConcurrentWriteError, CubeError
from cubeloom.operators.cells import affected_cells
from cubeloom.plans.keys import Keys
from cubeloom.sources.store import RollupStore

SF = "/root/testdata/sf0.001"


def moved(frame, keys):
    return frame.withColumn("o_custkey", F.when(F.col("o_orderkey").isin(keys), F.col("o_custkey") % 10 + 1).otherwise(F.col("o_custkey")))


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, catalog(spark, SF), str(tmp_path / "cubes"), Config(buckets=2)).register(Sales)


def pushed(frame):
    return [line for line in frame._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line]


def test_a_drain_narrows_its_scans_by_key(spark, engine):
    keys = [r[0] for r in engine.catalog.frame("orders").orderBy("o_orderkey").select("o_orderkey").limit(3).collect()]
    engine.mutate(orders=moved(engine.catalog.frame("orders"), keys))
    cells = affected_cells(engine.plan(Sales), engine.projection(Sales), engine.log, (0, 0), engine.log.end())
    scans = pushed(cells)
    for column in ("l_orderkey", "o_orderkey"):
        assert any(f"GreaterThanOrEqual({column},{keys[0]})" in s and f"LessThanOrEqual({column},{keys[-1]})" in s for s in scans), (column, scans)
    assert cells.distinct().count() > 0


def test_a_drain_goes_on_after_another_writer(engine, monkeypatch):
    engine.backfill(Sales)
    engine.mutate(orders=moved(engine.catalog.frame("orders"), [1, 2, 3, 4, 5, 6, 7]))
    write, lost = RollupStore.write, []

    def contended(self, *args, **kwargs):
        if len(lost) < 2:
            lost.append(1)
            raise ConcurrentWriteError("another writer was first")
        return write(self, *args, **kwargs)

    monkeypatch.setattr(RollupStore, "write", contended)
    assert engine.drain() > 0 and len(lost) == 2 and engine.drain() == 0
    assert engine.verify(Sales).clean
    monkeypatch.setattr(RollupStore, "write", lambda *a, **k: (_ for _ in ()).throw(ConcurrentWriteError("always")))
    engine.mutate(orders=moved(engine.catalog.frame("orders"), [5]).withColumn("o_custkey", F.col("o_custkey") + 1))
    with pytest.raises(ConcurrentWriteError):
        engine.drain()


def test_rollups_that_no_change_concerns_are_not_planned(engine, monkeypatch):
    import cubeloom.engine as module

    engine.register(EventDays)
    for r in (Sales, EventDays):
        engine.backfill(r)
    engine.mutate(orders=moved(engine.catalog.frame("orders"), [1, 2, 3]))
    planned = []
    own = module.affected_cells
    monkeypatch.setattr(module, "affected_cells", lambda plan, *a: (planned.append(plan.definition.name), own(plan, *a))[1])
    engine.drain()
    assert planned == ["Sales"] and engine.pending() == 0


def test_a_build_in_groups_equals_one_commit(engine, tmp_path):
    told = []
    days = engine.backfill(EventDays, group=20, on_slice=lambda v, i, n: told.append((v, i, n)))
    assert [i for _, i, _ in told] == list(range(1, days + 1)) and sorted(v for v, _, _ in told) == [v for v, _, _ in told]
    grouped = sorted(map(tuple, engine.rows(EventDays).collect()))
    again = []
    assert engine.backfill(EventDays, on_slice=lambda v, i, n: again.append((v, i, n))) == days and again == told
    assert sorted(map(tuple, engine.rows(EventDays).collect())) == grouped and engine.verify(EventDays).clean


def test_classes_read_through_their_engine(engine):
    with pytest.raises(CubeError, match="engine.bind"):
        Sales.where(nation=3)
    try:
        engine.bind(Sales)
        assert Sales.backfill() > 0 and Sales.verify().clean
        want = engine.query(Sales).where(nation=3).by(ordered_on="year").rows()
        assert Sales.where(nation=3).by(ordered_on="year").rows() == want == Sales.by(ordered_on="year").where(nation=3).rows()
        assert Sales.across_tenants().value("line_count") == engine.query(Sales).across_tenants().value("line_count")
        assert Sales.between("1995-01-01", "1995-12-31").across_tenants().value("line_count") > 0
    finally:
        Sales.bound_engine = None


def test_command_line_options(engine, monkeypatch):
    import tests.test_narrow as module

    monkeypatch.setattr(module, "made", lambda: engine, raising=False)
    lines = []
    assert main(["backfill", "tests.test_narrow:made", "Sales", "--group", "2000", "--pause", "0"], lines.append) == 0
    engine.mutate(orders=moved(engine.catalog.frame("orders"), [1, 2, 3]))
    assert main(["drain", "tests.test_narrow:made", "--limit", "2", "--seconds", "600"], lines.append) == 0 and engine.pending() == 0
    assert main(["verify", "tests.test_narrow:made", "Sales", "--between", "1995-01-01", "1995-03-31"], lines.append) == 0


def test_keys_as_conditions(spark):
    rows = spark.createDataFrame([(1, "a'b"), (2, "c\\d"), (None, None), (7, "e")], "n long, s string")
    number = lambda keys, column: rows.where(keys.holds(column)).count()
    assert number(Keys.listed([1, 7, 9]), "n") == 2 == number(Keys.listed([1, 7, 9]), F.col("n"))
    assert number(Keys.listed(["a'b", "c\\d"]), "s") == 2 and number(Keys.listed([1, None]), "n") == 2 and number(Keys.listed([]), "n") == 0
    assert Keys.of(rows.select("n")) == Keys(1, 7, (1, 2, 7), True) and Keys.of(rows.select("n"), 2) == Keys(1, 7, None, True)
    assert Keys.of(rows.select(F.col("n").cast("double"))) is None
    days = Keys.listed([datetime.date(2024, 1, 1), datetime.date(2024, 1, 3)])
    assert spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-04')) as d").where(days.holds("d")).count() == 2
