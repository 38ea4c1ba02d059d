import datetime

import pytest

from cubeloom.errors import CubeError, MissingTenantError, UnknownDimensionError

from .shop import COFFEE, MUG, S1, S2, CategoryCounts, Shop, ShopMetrics

D = datetime.date
AUG10, AUG20, SEP5 = D(2026, 8, 10), D(2026, 8, 20), D(2026, 9, 5)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    shop = Shop(spark)
    lines = [(S1, AUG10, COFFEE, 2, 100), (S1, AUG10, MUG, 1, 500), (S1, AUG20, COFFEE, 3, 100), (S1, SEP5, COFFEE, 4, 100), (S2, AUG10, COFFEE, 9, 100)]
    for i, (store, day, product, quantity, cents) in enumerate(lines):
        shop.put("orders", i, store, day, "paid", None)
        shop.put("line_items", i, i, product, quantity, cents)
    engine = shop.engine(tmp_path_factory.mktemp("reads"), ShopMetrics)
    engine.backfill(ShopMetrics)
    return engine


@pytest.fixture
def query(engine):
    return engine.query(ShopMetrics)


def test_totals(query):
    q = query.where(store=S1)
    assert (q.revenue_cents, q.line_count) == (1400, 4) and query.for_(store_id=S2).value("revenue_cents") == 900


def test_nothing_there(query):
    q = query.where(store=99)
    assert (q.revenue_cents, q.line_count, q.largest_line, q.average_unit_price) == (0, 0, None, None)


def test_groups(query):
    q = query.where(store=S1)
    assert q.by("product").revenue_cents == {COFFEE: 900, MUG: 500}
    assert q.by("ordered_on", "product").revenue_cents[AUG10, COFFEE] == 200
    assert q.by(ordered_on="month").revenue_cents == {D(2026, 8, 1): 1000, D(2026, 9, 1): 400}
    assert q.by("product").average_unit_price == {COFFEE: 100.0, MUG: 500.0} and q.average_unit_price == 140.0
    assert q.between(D(2026, 8, 1), D(2026, 8, 31)).largest_line == 500
    assert q.by("product").rows()[0].keys() >= {"product_id", "units", "average_unit_price"}
    assert q.by("product").to_dict()[MUG]["units"] == 1


def test_lists(query):
    q = query.where(store=S1)
    assert q.where(product=[COFFEE, MUG]).revenue_cents == 1400 and q.where(product=[MUG]).revenue_cents == 500
    assert q.where(product=[]).revenue_cents == 0 and q.where(product=[]).by("product").rows() == []


def test_composition(query):
    q = query.where(store=S1)
    assert q.where(product=COFFEE).where(product=MUG).revenue_cents == 500
    assert q.where(product=COFFEE).by("product") is not q and q.revenue_cents == 1400
    assert q.between(AUG10, AUG10).between(SEP5, SEP5).revenue_cents == 400
    assert q.between((AUG10, AUG20)).revenue_cents == 1000
    assert q.where(ordered_on=AUG20).revenue_cents == 300


def test_across_tenants(query):
    q = query.across_tenants()
    assert (q.revenue_cents, q.line_count) == (2300, 5)
    assert q.between(D(2026, 8, 1), D(2026, 8, 31)).by("product").revenue_cents == {COFFEE: 1400, MUG: 500}


@pytest.mark.parametrize("narrow", [lambda q: q, lambda q: q.where(store=None), lambda q: q.where(store=[None]), lambda q: q.where(store=[S1, None]), lambda q: q.by("product")])
def test_the_guard_stands_before_plan_and_text(query, narrow):
    for use in (lambda q: q.df(), lambda q: q.sql(), lambda q: q.rows(), lambda q: q.value("units")):
        with pytest.raises(MissingTenantError):
            use(narrow(query))


def test_an_empty_tenant_list_reads_nothing(query):
    assert query.where(store=[]).revenue_cents == 0


def test_refusals(query, engine):
    with pytest.raises(CubeError):
        query.by(ordered_on="decade")
    with pytest.raises(CubeError):
        query.by(product="month")
    with pytest.raises(UnknownDimensionError):
        query.by("color")
    with pytest.raises(CubeError):
        query.between(AUG10)
    with pytest.raises(CubeError):
        engine.query(CategoryCounts).between(AUG10, AUG20)
    with pytest.raises(AttributeError):
        query.where(store=S1).value("color")
    with pytest.raises(AttributeError):
        _ = query.color
    assert hasattr(query.where(store=S1), "units") and not hasattr(query, "color")


def test_records_stand_for_their_ids(query):
    class Record:
        id = S1

    assert query.where(store=Record()).revenue_cents == 1400 and query.where(store=[Record()]).revenue_cents == 1400


def test_rows_are_in_order(query):
    days = [r["ordered_on"] for r in query.where(store=S1).by("ordered_on").rows()]
    assert days == sorted(days)


def test_text_equals_plan(spark, engine, query):
    engine.register_views()
    for q in (
        query.where(store=S1).by("product", ordered_on="month"),
        query.where(store=[S1, S2], product=[COFFEE, None]).by("store"),
        query.where(store=S1).between(AUG10, AUG20),
        query.where(store=S1, product=[]).by("product"),
        query.across_tenants(),
    ):
        assert [tuple(r) for r in spark.sql(q.sql()).collect()] == [tuple(r) for r in q.df().collect()]


def test_live_reads_agree(engine):
    assert engine.live_query(ShopMetrics).where(store=S1).by("product").to_dict() == engine.query(ShopMetrics).where(store=S1).by("product").to_dict()


def test_null_coordinates(spark, tmp_path):
    shop = Shop(spark)
    shop.put("products", 12, 9, "tea")
    shop.put("orders", 1, S1, AUG10, "paid", None)
    for i, product in enumerate([COFFEE] * 10 + [12] * 20 + [MUG] * 5):
        shop.put("line_items", i, 1, product, 1, 1)
    engine = shop.engine(tmp_path)
    engine.backfill(CategoryCounts)
    q = engine.query(CategoryCounts).where(store=S1)
    assert q.line_count == 35 and q.where(category=None).line_count == 5
    assert q.where(category=[7]).line_count == 10 and q.where(category=[7, None]).line_count == 15
    assert q.where(category=[None]).line_count == 5 and q.where(category=[]).line_count == 0
    assert list(q.by("category").line_count) == [7, 9, None]
