import datetime
import random

import pytest

from cubeloom import Rollup, dimension, fact, measure, tenant
from cubeloom.errors import ChangeLogOverflowError, ConcurrentWriteError, CubeError, StaleSchemaError, VerificationError

from .shop import COFFEE, MUG, S1, S2, CategoryCounts, Discounts, Halves, Shop, ShopMetrics, cells

D = datetime.date
DAY = D(2026, 8, 19)


def paid_order(spark):
    shop = Shop(spark)
    shop.put("orders", 1, S1, DAY, "paid", None)
    return shop


def started(spark, folder, *rollups, shop=None, **config):
    shop = shop or paid_order(spark)
    engine = shop.engine(folder, *(rollups or (ShopMetrics,)), **config)
    for r in rollups or (ShopMetrics,):
        engine.backfill(r)
    return shop, engine


def revenue(engine):
    return {k: v["revenue_cents"] for k, v in cells(engine, ShopMetrics).items()}


def settle(shop, engine, **options):
    shop.apply(engine)
    engine.drain(**options)
    for d in engine.registry.definitions():
        report = engine.verify(d)
        assert report.clean, str(report)


# Draining


def test_insert_update_move_delete(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    settle(shop, engine)
    assert revenue(engine) == {(S1, DAY, COFFEE): 1000}
    shop.put("line_items", 2, 1, COFFEE, 3, 100)
    settle(shop, engine)
    assert cells(engine, ShopMetrics)[S1, DAY, COFFEE] == {"line_count": 2, "units": 5, "revenue_cents": 1300, "largest_line": 1000, "smallest_line": 300}
    shop.put("line_items", 1, 1, MUG, 1, 700)
    settle(shop, engine)
    assert revenue(engine) == {(S1, DAY, COFFEE): 300, (S1, DAY, MUG): 700}
    shop.drop("line_items", 1)
    shop.drop("line_items", 2)
    settle(shop, engine)
    assert revenue(engine) == {}


def test_parents_move_lines(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    shop.put("line_items", 1, 1, COFFEE, 10, 500)
    settle(shop, engine)
    shop.put("orders", 1, S2, DAY, "paid", None)
    settle(shop, engine)
    assert revenue(engine) == {(S2, DAY, COFFEE): 5000}
    shop.put("orders", 1, S2, D(2026, 9, 1), "paid", None)
    settle(shop, engine)
    assert revenue(engine) == {(S2, D(2026, 9, 1), COFFEE): 5000}
    shop.put("orders", 1, S2, D(2026, 9, 1), "pending", None)
    settle(shop, engine)
    assert revenue(engine) == {}
    shop.put("orders", 1, S2, D(2026, 9, 1), "paid", None)
    settle(shop, engine)
    assert revenue(engine) == {(S2, D(2026, 9, 1), COFFEE): 5000}


def test_null_dimension_is_a_cell_of_its_own(spark, tmp_path):
    shop, engine = started(spark, tmp_path, CategoryCounts)
    shop.put("line_items", 1, 1, COFFEE, 1, 1)
    shop.put("line_items", 2, 1, MUG, 1, 1)
    settle(shop, engine)
    assert cells(engine, CategoryCounts) == {(S1, 7): {"line_count": 1}, (S1, None): {"line_count": 1}}
    shop.put("products", MUG, 7, "mug")
    settle(shop, engine)
    assert cells(engine, CategoryCounts) == {(S1, 7): {"line_count": 2}}


def test_measures_through_parents(spark, tmp_path):
    shop = Shop(spark)
    for i, (store, state, n) in enumerate([(S1, "paid", 2), (S1, "pending", 3), (S2, "paid", 9)]):
        shop.put("orders", i, store, DAY, state, None)
        shop.put("line_items", i, i, COFFEE, n, 100)
    _, engine = started(spark, tmp_path, Discounts, shop=shop)
    assert cells(engine, Discounts) == {(S1, COFFEE): {"line_count": 2, "paid_lines": 1, "local_cents": 500}, (S2, COFFEE): {"line_count": 1, "paid_lines": 1, "local_cents": 0}}
    shop.put("orders", 1, S1, DAY, "paid", None)
    settle(shop, engine)
    assert cells(engine, Discounts)[S1, COFFEE]["paid_lines"] == 2
    shop.put("stores", S1, "USD")
    settle(shop, engine)
    assert cells(engine, Discounts)[S1, COFFEE]["local_cents"] == 0


def test_draining_nothing_and_twice(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    assert engine.drain() == 0
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    assert shop.apply(engine) == 1 and engine.pending() == 1
    assert engine.drain() == 1
    before = engine.store(ShopMetrics).version()
    assert engine.drain() == 0 and engine.store(ShopMetrics).version() == before


def test_steps_claim_at_most_the_limit(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    for i in range(7):
        shop.put("line_items", i, 1, COFFEE, 1, 1)
    shop.apply(engine)
    assert [engine.drain_step(3) for _ in range(4)] == [3, 3, 1, 0]
    assert cells(engine, ShopMetrics)[S1, DAY, COFFEE]["line_count"] == 7
    for i in range(3):
        shop.drop("line_items", i)
    shop.apply(engine)
    assert engine.drain(limit=1, max_seconds=0) == 1


@pytest.mark.parametrize("limit", [1, 2, 100])
def test_parent_and_child_change_before_one_drain(spark, tmp_path, limit):
    shop = paid_order(spark)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    shop.put("orders", 2, S1, D(2026, 8, 20), "paid", None)
    shop.put("line_items", 2, 2, MUG, 2, 500)
    _, engine = started(spark, tmp_path, shop=shop)
    # A cascade, in one append.
    shop.drop("orders", 1)
    shop.drop("line_items", 1)
    # A move and then a delete, in two.
    shop.put("orders", 2, S2, D(2026, 8, 20), "paid", None)
    shop.apply(engine)
    shop.drop("line_items", 2)
    settle(shop, engine, limit=limit)
    assert revenue(engine) == {}


def test_two_moves_with_a_drain_between(spark, tmp_path):
    shop = paid_order(spark)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    _, engine = started(spark, tmp_path, shop=shop)
    for store, day in ((S2, DAY), (S1, D(2026, 8, 21))):
        shop.put("orders", 1, store, day, "paid", None)
        settle(shop, engine)
    assert revenue(engine) == {(S1, D(2026, 8, 21), COFFEE): 1000}


def test_extremes_over_nothing_are_null(spark, tmp_path):
    shop = paid_order(spark)
    shop.put("line_items", 1, 1, COFFEE, 0, 500)
    shop.put("line_items", 2, 1, MUG, 2, 500)
    _, engine = started(spark, tmp_path, shop=shop)
    assert cells(engine, ShopMetrics)[S1, DAY, COFFEE]["smallest_line"] is None
    assert engine.query(ShopMetrics).where(store=S1).smallest_line == 1000
    assert engine.verify(ShopMetrics).clean


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_changes_never_leave_a_stale_cell(spark, tmp_path, seed):
    rng = random.Random(seed)
    shop = paid_order(spark)
    rollups = (ShopMetrics, CategoryCounts, Discounts)
    _, engine = started(spark, tmp_path, *rollups, shop=shop)

    def change():
        kind = rng.random()
        orders, lines = sorted(shop.tables["orders"]), sorted(shop.tables["line_items"])
        if kind < 0.25 or not orders:
            key = rng.randint(1, 12)
            shop.put("orders", key, rng.choice([S1, S2]), D(2026, 8, rng.randint(1, 3)), rng.choice(["paid", "pending"]), None)
        elif kind < 0.6:
            shop.put("line_items", rng.randint(1, 25), rng.choice(orders), rng.choice([COFFEE, MUG]), rng.randint(0, 5), rng.randint(1, 9))
        elif kind < 0.7 and lines:
            shop.drop("line_items", rng.choice(lines))
        elif kind < 0.8:
            gone = rng.choice(orders)
            shop.drop("orders", gone)
            for i in [i for i, row in shop.tables["line_items"].items() if row[1] == gone and rng.random() < 0.7]:
                shop.drop("line_items", i)
        elif kind < 0.9:
            shop.put("products", rng.choice([COFFEE, MUG]), rng.choice([None, 7, 8]), "p")
        else:
            shop.put("stores", rng.choice([S1, S2]), rng.choice(["COP", "USD"]))

    for _ in range(4):
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 6)):
                change()
            shop.apply(engine)
        if rng.random() < 0.4:
            engine.drain_step(rng.randint(1, 3))
    settle(shop, engine, limit=rng.choice([2, 50]), max_seconds=600)


def test_streaming_drain_and_restart(spark, tmp_path):
    shop, engine = started(spark, tmp_path / "store")
    for n, product in enumerate((COFFEE, MUG), 1):
        shop.put("line_items", n, 1, product, 2, 500)
        shop.apply(engine)
        engine.drain_stream(str(tmp_path / "checkpoint")).awaitTermination()
        assert engine.verify(ShopMetrics).clean and len(cells(engine, ShopMetrics)) == n
    before = engine.store(ShopMetrics).version()
    engine.drain_stream(str(tmp_path / "checkpoint")).awaitTermination()
    engine.drain_stream(str(tmp_path / "another")).awaitTermination()  # all files are replayed, nothing is left to apply
    assert engine.store(ShopMetrics).version() == before


def test_crash_between_rollups_is_made_good(spark, tmp_path, monkeypatch):
    shop, engine = started(spark, tmp_path, ShopMetrics, CategoryCounts)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    shop.apply(engine)
    real = engine.plan

    def failing(d):
        if getattr(d, "name", "") == "CategoryCounts":
            raise RuntimeError("lost")
        return real(d)

    monkeypatch.setattr(engine, "plan", failing)
    with pytest.raises(RuntimeError):
        engine.drain()
    assert len(cells(engine, ShopMetrics)) == 1 and cells(engine, CategoryCounts) == {}
    monkeypatch.setattr(engine, "plan", real)
    engine.drain()
    assert engine.verify(ShopMetrics).clean and engine.verify(CategoryCounts).clean


def test_limits_and_missing_builds(spark, tmp_path):
    shop = paid_order(spark)
    engine = shop.engine(tmp_path, ShopMetrics, max_pending=1)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    shop.apply(engine)
    with pytest.raises(CubeError):
        engine.drain()
    shop.put("line_items", 2, 1, COFFEE, 2, 500)
    shop.apply(engine)
    with pytest.raises(ChangeLogOverflowError):
        engine.drain()
    engine.backfill(ShopMetrics)
    assert engine.drain() == 0 and engine.verify(ShopMetrics).clean


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    store = engine.store(ShopMetrics)
    base = store.version()
    store.write(store.read(base), base, base.offset)
    with pytest.raises(ConcurrentWriteError):
        store.write(store.read(base), base, base.offset)


def test_vacuum_keeps_what_is_needed(spark, tmp_path):
    shop, engine = started(spark, tmp_path)
    for i in range(1, 5):
        shop.put("line_items", i, 1, COFFEE, 2, 500)
        settle(shop, engine)
    gone = engine.vacuum()
    assert gone["ShopMetrics"] > 0 and gone["changes"] > 0
    assert engine.verify(ShopMetrics).clean
    shop.put("line_items", 9, 1, MUG, 2, 500)
    settle(shop, engine)


# Backfill


def history(spark):
    shop = Shop(spark)
    for n, day in enumerate((17, 18, 20), 1):
        shop.put("orders", n, S1, D(2026, 8, day), "paid", None)
        shop.put("line_items", n, n, COFFEE, n, 100)
    shop.put("orders", 4, S2, D(2026, 8, 17), "paid", None)
    shop.put("line_items", 4, 4, MUG, 5, 200)
    shop.put("orders", 5, S1, D(2026, 8, 17), "pending", None)
    shop.put("line_items", 5, 5, COFFEE, 99, 999)
    return shop


def test_backfill_visits_days_with_data(spark, tmp_path):
    seen = []
    engine = history(spark).engine(tmp_path, ShopMetrics)
    assert engine.backfill(ShopMetrics, on_slice=lambda *x: seen.append(x)) == 3
    days = [D(2026, 8, d) for d in (17, 18, 20)]
    assert seen == [(d, i, 3) for i, d in enumerate(days, 1)]
    assert len(cells(engine, ShopMetrics)) == 4
    assert cells(engine, ShopMetrics)[S1, days[1], COFFEE]["revenue_cents"] == 200
    before = cells(engine, ShopMetrics)
    engine.backfill(ShopMetrics)
    assert cells(engine, ShopMetrics) == before and engine.verify(ShopMetrics).clean


def test_backfill_from_a_day(spark, tmp_path):
    engine = history(spark).engine(tmp_path, ShopMetrics)
    assert engine.backfill(ShopMetrics, from_=D(2026, 8, 18)) == 2 and len(cells(engine, ShopMetrics)) == 2
    engine.backfill(ShopMetrics, from_=D(2026, 8, 17))
    assert engine.verify(ShopMetrics).clean


def test_backfill_by_tenant_without_time(spark, tmp_path):
    seen = []
    engine = history(spark).engine(tmp_path, CategoryCounts)
    assert engine.backfill(CategoryCounts, on_slice=lambda *x: seen.append(x[0])) == 2 and seen == [S1, S2]


def test_full_backfill_clears_what_is_gone(spark, tmp_path):
    shop = history(spark)
    engine = shop.engine(tmp_path, ShopMetrics)
    engine.backfill(ShopMetrics)
    shop.drop("line_items", 1)
    engine.catalog.replace("line_items", shop.frame("line_items"))  # unseen by the log
    assert engine.verify(ShopMetrics).count_of("extra") == 1
    engine.backfill(ShopMetrics)
    assert engine.verify(ShopMetrics).clean


def test_backfill_then_drain(spark, tmp_path):
    shop = history(spark)
    engine = shop.engine(tmp_path, ShopMetrics)
    shop.put("line_items", 6, 1, MUG, 1, 1)
    shop.apply(engine)
    engine.backfill(ShopMetrics)
    assert engine.drain() == 0
    shop.drop("line_items", 6)
    settle(shop, engine)


def test_recompute_slice(spark, tmp_path):
    shop = history(spark)
    engine = shop.engine(tmp_path, ShopMetrics)
    engine.backfill(ShopMetrics)
    shop.put("line_items", 1, 1, COFFEE, 7, 100)
    shop.put("line_items", 2, 2, COFFEE, 7, 100)
    engine.catalog.replace("line_items", shop.frame("line_items"))
    engine.recompute_slice(ShopMetrics, D(2026, 8, 17))
    got = revenue(engine)
    assert got[S1, D(2026, 8, 17), COFFEE] == 700 and got[S1, D(2026, 8, 18), COFFEE] == 200


def test_changed_declarations_are_noticed(spark, tmp_path):
    shop, engine = started(spark, tmp_path, CategoryCounts)

    class Other(Rollup):
        lines = fact("line_items")
        store_id = tenant({"order": "store_id"})
        product_id = dimension("product_id")
        line_count = measure(count=True)

    Other.definition()
    changed = Other.definition().__class__.of("CategoryCounts", Other._declared)
    again = shop.engine(tmp_path, changed)
    with pytest.raises(StaleSchemaError):
        again.rows(changed)
    again.backfill(changed)
    assert again.verify(changed).clean


# Verifying


@pytest.fixture
def verified(spark, tmp_path):
    shop = paid_order(spark)
    shop.put("line_items", 1, 1, COFFEE, 2, 500)
    shop.put("line_items", 2, 1, MUG, 1, 100)
    return started(spark, tmp_path, shop=shop)[1]


def corrupt(engine, change):
    store = engine.store(ShopMetrics)
    base = store.version()
    rows = [change(r.asDict()) for r in store.read(base).collect()]
    store.write(engine.spark.createDataFrame([r for r in rows if r], store.schema), base, base.offset)


def test_wrong_and_repair(verified):
    corrupt(verified, lambda r: r | {"revenue_cents": 999999} if r["product_id"] == COFFEE else r)
    report = verified.verify(ShopMetrics)
    assert report.counts == {"wrong": 1} and report.listed[0].expected["revenue_cents"] == 1000 and "999999" in str(report)
    fixed = verified.verify(ShopMetrics, repair=True)
    assert fixed.repaired == 1 and fixed.count == 1 and verified.verify(ShopMetrics).clean


def test_missing(verified):
    corrupt(verified, lambda r: r if r["product_id"] == COFFEE else None)
    report = verified.verify(ShopMetrics, repair=True)
    assert report.count_of("missing") == 1 and report.listed[0].stored is None and verified.verify(ShopMetrics).clean


def test_extra_and_scopes(verified):
    corrupt(verified, lambda r: r | {"ordered_on": D(2020, 1, 1), "store_id": S2} if r["product_id"] == MUG else r)
    assert verified.verify(ShopMetrics).counts == {"missing": 1, "extra": 1}
    assert verified.verify(ShopMetrics, tenant=S2).counts == {"extra": 1}
    assert verified.verify(ShopMetrics, tenant=S1, between=(D(2026, 1, 1), D(2026, 12, 31))).counts == {"missing": 1}
    assert verified.verify(ShopMetrics, between=(D(2019, 1, 1), D(2019, 12, 31))).clean
    assert verified.verify(ShopMetrics, repair=True).repaired == 2 and verified.verify(ShopMetrics).clean
    with pytest.raises(VerificationError):
        verified.verify(CategoryCounts, between=(DAY, DAY))


def test_rounded_sums_agree_with_themselves(spark, tmp_path):
    shop = paid_order(spark)
    shop.put("line_items", 1, 1, COFFEE, 5, 1)
    _, engine = started(spark, tmp_path, Halves, shop=shop)
    assert cells(engine, Halves) == {(S1,): {"halves": 3}} and engine.verify(Halves).clean
    with pytest.raises(ValueError):
        engine.verify(Halves).count_of("odd")
