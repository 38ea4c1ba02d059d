import datetime
import logging

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom import BelongsTo, Catalog, Config, Engine, Rollup, Source, dimension, fact, measure, tenant, time
from cubeloom.errors import AssociationError, CubeError, UnknownRollupError
from cubeloom.functions.scalars import around_days, coarsen, day_of, divided, to_type
from cubeloom.streaming.capture import row_changes, watched_columns

from .shop import CENTS, COFFEE, MUG, S1, CategoryCounts, Discounts, Shop, ShopMetrics


def test_schema_types_and_nullability(spark, tmp_path):
    engine = Shop(spark).engine(tmp_path, ShopMetrics)
    schema = engine.projection(ShopMetrics).schema()
    assert [f.name for f in schema] == list(ShopMetrics.definition().columns)
    assert schema["store_id"].dataType == T.LongType() and schema["ordered_on"].dataType == T.DateType()
    assert schema["largest_line"].nullable and not schema["revenue_cents"].nullable
    assert "joins order: orders" in engine.describe(ShopMetrics) and "line_items: every update" in engine.describe(ShopMetrics)


@pytest.mark.parametrize("via", [{"lines": "x"}, {"nothing": "x"}, {"order": "no_column"}, {"order": {"lines": "x"}}])
def test_bad_associations_are_refused(spark, tmp_path, via):
    class Bad(Rollup):
        lines = fact("orders") if "lines" in via else fact("line_items")
        who = tenant(via)
        n = measure(count=True)

    with pytest.raises(AssociationError):
        Shop(spark).engine(tmp_path).register(Bad)


def test_unknown_source(spark, tmp_path):
    class Nowhere(Rollup):
        lines = fact("nowhere")
        who = tenant("x")
        n = measure(count=True)

    with pytest.raises(CubeError):
        Shop(spark).engine(tmp_path).register(Nowhere)


def test_null_intermediate_key_drops_the_row(spark, tmp_path):
    class ByCategoryName(Rollup):
        lines = fact("line_items")
        store_id = tenant({"order": "store_id"})
        category = dimension({"product": {"category": "name"}})
        n = measure(count=True)

    shop = Shop(spark)
    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", None)
    shop.put("line_items", 1, 1, COFFEE, 1, 5)
    shop.put("line_items", 2, 1, MUG, 1, 5)
    engine = shop.engine(tmp_path)
    engine.backfill(ByCategoryName)
    assert [(r.category, r.n) for r in engine.rows(ByCategoryName).collect()] == [("drinks", 1)]


def test_day_of(spark):
    rows = spark.sql("SELECT timestamp_ntz'2026-03-01 03:30:00' AS n, timestamp'2026-03-01 03:30:00 UTC' AS t, date'2026-03-01' AS d")
    for session in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            got = rows.select(
                day_of(F.col("n"), T.TimestampNTZType(), "America/New_York").alias("n"),
                day_of(F.col("t"), T.TimestampType(), "America/New_York").alias("t"),
                day_of(F.col("n"), T.TimestampNTZType(), "UTC").alias("u"),
                day_of(F.col("d"), T.DateType(), "America/New_York").alias("d"),
            ).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        feb, march = datetime.date(2026, 2, 28), datetime.date(2026, 3, 1)
        assert got.asDict() == {"n": feb, "t": feb, "u": march, "d": march}
    with pytest.raises(CubeError):
        day_of(F.col("n"), T.StringType(), "UTC")


@pytest.mark.parametrize("kind", [T.TimestampNTZType(), T.TimestampType(), T.DateType()])
def test_ranges_hold_their_days_in_any_zone(spark, kind):
    hours = spark.range(0, 24 * 6).select(F.expr(f"CAST(timestamp_ntz'2026-03-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS {kind.simpleString()})").alias("t"))
    day = datetime.date(2026, 3, 3)
    for zone in ("UTC", "Pacific/Kiritimati", "Pacific/Pago_Pago"):
        inside = hours.where(day_of(F.col("t"), kind, zone) == F.lit(day))
        assert inside.count() == inside.where(around_days(F.col("t"), kind, day, day)).count() > 0
    assert hours.where(around_days(F.col("t"), kind, day, day)).count() < 24 * 5


def test_scalars(spark):
    one = spark.sql("SELECT date'2026-08-19' AS d, 2.5D AS x, -2.5D AS y, 3 AS n, 0 AS z, CAST(null AS INT) AS e").select(
        *[coarsen(F.col("d"), u).alias(u) for u in ("day", "week", "month", "quarter", "year")],
        to_type(F.col("x"), T.LongType()).alias("x"),
        to_type(F.col("y"), T.LongType()).alias("y"),
        divided(F.col("n"), F.col("z")).alias("zero"),
        divided(F.col("e"), F.col("n")).alias("none"),
        divided(F.col("n"), F.col("n")).alias("one"),
    ).first()
    assert (one.week, one.month, one.quarter, one.year) == tuple(datetime.date(2026, *x) for x in ((8, 17), (8, 1), (7, 1), (1, 1)))
    assert (one.x, one.y, one.zero, one.none, one.one) == (3, -3, None, None, 1.0)
    with pytest.raises(CubeError):
        coarsen(F.col("d"), "decade")


def test_nullable_filter_value(spark, tmp_path):
    class Unnoted(Rollup):
        lines = fact("orders", where={"notes": None})
        store_id = tenant("store_id")
        n = measure(count=True)

    shop = Shop(spark)
    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", None)
    shop.put("orders", 2, S1, datetime.date(2026, 8, 1), "paid", "x")
    engine = shop.engine(tmp_path)
    engine.backfill(Unnoted)
    assert engine.query(Unnoted).where(store=S1).value("n") == 1


# Capture


def test_watched_columns(spark, tmp_path):
    catalog = Shop(spark).catalog()
    assert watched_columns(ShopMetrics.definition(), catalog) == {"line_items": None, "orders": ("placed_on", "state", "store_id")}
    assert watched_columns(CategoryCounts.definition(), catalog) == {"line_items": None, "orders": ("store_id",), "products": ("category_id",)}
    assert watched_columns(Discounts.definition(), catalog) == {"line_items": None, "orders": None, "stores": None}


def test_union_never_narrows(spark, tmp_path):
    engine = Shop(spark).engine(tmp_path, ShopMetrics, CategoryCounts)
    assert engine.capture_policy()["orders"].columns == ("placed_on", "state", "store_id")
    engine.register(Discounts)
    assert engine.capture_policy()["orders"].columns is None


def test_immutable_paths_are_joined_but_not_watched(spark, tmp_path):
    class Currencies(Rollup):
        lines = fact("line_items")
        store_id = tenant({"order": "store_id"})
        currency = dimension({"order": {"store": "currency"}}, immutable=True)
        n = measure(count=True)

    engine = Shop(spark).engine(tmp_path, Currencies)
    assert set(engine.capture_policy()) == {"line_items", "orders"}
    assert ("order", "store") in engine.plan(Currencies).tables()
    assert [d.name for d in engine.registry.for_table("stores")] == []


def test_narrowed_updates_are_quiet(spark, tmp_path):
    shop = Shop(spark)
    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", None)
    engine = shop.engine(tmp_path, ShopMetrics)
    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", "a note")
    assert shop.apply(engine) == 0
    shop.put("orders", 1, S1, datetime.date(2026, 8, 2), "paid", "a note")
    shop.put("stores", 3, "EUR")
    assert shop.apply(engine) == 1


def test_keyless_changes_keep_multiplicity(spark):
    source = Source("t", None, ())
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    after = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "c")], "x int, y string")
    got = sorted((r.operation, (r.previous or {"x": None})["x"]) for r in row_changes(source, before, after).collect())
    assert got == [("delete", 1), ("insert", None), ("insert", None)]


def test_before_images_keep_their_types(spark, tmp_path):
    from cubeloom.sources.changelog import ChangeLog, operation

    stamp = datetime.datetime(2026, 8, 1, 1, 2, 3, 456789)
    before = spark.createDataFrame([(1, stamp, None)], "id long, at timestamp_ntz, note string")
    log = ChangeLog(spark, str(tmp_path))
    log.append({"t": row_changes(Source("t", None, "id"), before, before.where("false"))})
    row = log.entries("t", before.schema, (0, 0)).first()
    assert row.previous.at == stamp and row.previous.note is None and row.operation == "delete" and row.row_id == "1"
    assert operation(" UPDATE ") == "update"
    with pytest.raises(ValueError):
        operation("upsert")


# Registry


def test_registry(spark, tmp_path, caplog):
    engine = Shop(spark).engine(tmp_path, ShopMetrics, Discounts)
    assert engine.registry.lookup("shop_metrics").name == "ShopMetrics" and engine.registry.lookup("DiscountsRollup").name == "Discounts"
    with pytest.raises(UnknownRollupError):
        engine.registry.lookup("nothing")
    assert {d.name for d in engine.registry.for_table("stores")} == {"Discounts"}

    class Base(Rollup):
        pass

    class Deep(Base):
        lines = fact("line_items")
        store_id = tenant({"order": "store_id"})
        n = measure(count=True)

    class Broken(Base):
        lines = fact("line_items")
        store_id = tenant({"nowhere": "x"})
        n = measure(count=True)

    engine.registry.reset()
    with caplog.at_level(logging.WARNING, "cubeloom"):
        assert [d.name for d in engine.registry.discover(Base)] == ["Deep"]
    assert "Broken" in caplog.text


def test_filters_reach_the_scan(spark, tmp_path):
    shop = Shop(spark)
    shop.put("orders", 1, S1, datetime.date(2026, 8, 1), "paid", None)
    shop.put("line_items", 1, 1, COFFEE, 1, 5)
    engine = shop.engine(tmp_path, ShopMetrics)
    engine.backfill(ShopMetrics)
    plan = engine.query(ShopMetrics).where(store=S1).df()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(store_id,1)" in plan and "ReadSchema" in plan


def test_config():
    assert Config().batch_size == 1000 and Config().time_zone == "UTC"
    with pytest.raises(ValueError):
        Config(batch_size=0)


def test_composite_keys_name_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5), (1, 2, 6)], "a int, b int, v int")
    source = Source("t", lambda _: rows, ("a", "b"), {"u": BelongsTo("u", "v")})
    ids = [r[0] for r in rows.select(source.row_id(rows.columns)).collect()]
    assert len(set(ids)) == 2
    catalog = Catalog(spark, [source, Source("u", lambda _: rows, ("a", "b"))])

    class Pairs(Rollup):
        lines = fact("t")
        a = tenant({"u": "a"})
        n = measure(count=True)

    with pytest.raises(AssociationError):
        Engine(spark, catalog, str(tmp_path)).register(Pairs).backfill(Pairs)


def test_measures_over_time_zone(spark, tmp_path):
    ts = [datetime.datetime(2026, 3, 1, 3, 30), datetime.datetime(2026, 3, 1, 6, 0)]
    frame = spark.createDataFrame([(i, "k", t) for i, t in enumerate(ts)], "id long, kind string, ts timestamp_ntz")

    class Kinds(Rollup):
        lines = fact("e")
        kind = tenant("kind")
        on = time("ts", bucket="day")
        n = measure(count=True)

    engine = Engine(spark, Catalog(spark, [Source("e", lambda _: frame)]), str(tmp_path), Config(time_zone="America/New_York"))
    assert engine.backfill(Kinds) == 2
    assert engine.query(Kinds).where(kind="k").by("on").value("n") == {datetime.date(2026, 2, 28): 1, datetime.date(2026, 3, 1): 1}
    assert CENTS
