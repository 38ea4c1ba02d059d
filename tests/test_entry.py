import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from cubeloom import cli
from cubeloom.demo import queries as demo

from .shop import COFFEE, S1, Shop, ShopMetrics

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
_engine = {}


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and "ordered_on" in rows[0].asDict()


def test_names():
    assert set(demo.oracle_sql()) == set(demo.queries())
    assert set(demo.queries()) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["by_month", "null_dimension_cell", "two_routes_same_table", "events_day_tz", "drain_parent_move", "verify_three_kinds", "capture_narrowed", "local_filter_and_dates", "read_in_order", "read_as_dict", "tenant_guard", "recompute_one_slice", "capture_of_two_rollups", "report_in_order"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(demo.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = demo.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    fold = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(map(fold, r)) for r in got.select(*columns).collect()), key=repr) == sorted((tuple(map(fold, r)) for r in want.fetchall()), key=repr)


def test_library_stands_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "cubeloom", tmp_path / "cubeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'by_month' in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def app():
    return _engine["engine"]


def test_command_line(spark, tmp_path):
    shop = Shop(spark)
    import datetime

    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", None)
    shop.put("line_items", 1, 1, COFFEE, 1, 5)
    engine = _engine["engine"] = shop.engine(tmp_path, ShopMetrics)
    said = []
    run = lambda *a: cli.main([a[0], f"{__name__}:app", *a[1:]], said.append)
    assert run("backfill", "shop_metrics") == 0 and said[-1] == "ShopMetrics: 1 slices"
    assert run("verify") == 0
    engine.store(ShopMetrics).write(engine.rows(ShopMetrics).where("false"), engine.store(ShopMetrics).version(), (0, 0))
    assert run("verify") == 1 and "missing" in said[-1]
    assert run("verify", "--tenant", "2") == 0
    assert run("repair") == 0 and run("verify") == 0
    assert run("drain") == 0 and said[-1] == "0 changes applied"
    assert run("capture") == 0 and "line_items: every update" in said
    assert run("describe") == 0


def test_queries_drain_without_a_deadline(monkeypatch):
    from cubeloom.demo import queries as demo

    made = []
    monkeypatch.setattr(demo, "Engine", lambda spark, sources, folder, config: made.append(config) or type("E", (), {"register": lambda self, *r: None})())
    monkeypatch.setattr(demo, "shared_folder", lambda *a: "")
    demo._fresh(None, "", sources=object())
    assert made[0].max_run_seconds == float("inf")
