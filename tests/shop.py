"""A small shop as sources, and rollups over it."""

from __future__ import annotations

import datetime

from cubeloom import BelongsTo, Catalog, Config, Engine, HasMany, Rollup, Source, dimension, fact, measure, ratio, tenant, time

DAY = datetime.date

SCHEMAS = {
    "stores": "id long, currency string",
    "categories": "id long, name string",
    "products": "id long, category_id long, name string",
    "orders": "id long, store_id long, placed_on date, state string, notes string",
    "line_items": "id long, order_id long, product_id long, quantity int, unit_price_cents long",
}
S1, S2, COFFEE, MUG = 1, 2, 10, 11
CENTS = "f.quantity * f.unit_price_cents"


class Shop:
    """Tables as dicts of rows; ``apply`` moves the engine's catalog to the current state and logs the difference."""

    def __init__(self, spark):
        self.spark = spark
        self.tables = {t: {} for t in SCHEMAS}
        self.put("stores", S1, "COP")
        self.put("stores", S2, "USD")
        self.put("categories", 7, "drinks")
        self.put("products", COFFEE, 7, "coffee")
        self.put("products", MUG, None, "mug")

    def put(self, table, *row):
        self.tables[table][row[0]] = row

    def drop(self, table, key):
        del self.tables[table][key]

    def frame(self, table):
        return self.spark.createDataFrame(sorted(self.tables[table].values()), SCHEMAS[table])

    def catalog(self):
        belongs = {
            "products": {"category": BelongsTo("categories", "category_id")},
            "orders": {"store": BelongsTo("stores", "store_id")},
            "line_items": {"order": BelongsTo("orders", "order_id"), "product": BelongsTo("products", "product_id")},
        }
        many = {"orders": {"lines": HasMany("line_items", "order_id")}}
        return Catalog(self.spark, [Source(t, lambda _, t=t: self.frame(t), "id", belongs.get(t, {}), many.get(t, {})) for t in SCHEMAS])

    def engine(self, folder, *rollups, **config):
        engine = Engine(self.spark, self.catalog(), str(folder), Config(buckets=3, **config)).register(*rollups)
        # The engine sees a state until ``apply`` moves it on.
        for t in SCHEMAS:
            engine.catalog.replace(t, self.frame(t))
        return engine

    def apply(self, engine):
        return engine.mutate(**{t: self.frame(t) for t in SCHEMAS})


class ShopMetrics(Rollup):
    lines = fact("line_items", where={"order": {"state": "paid"}})
    store_id = tenant({"order": "store_id"})
    ordered_on = time({"order": "placed_on"}, bucket="day")
    product_id = dimension("product_id")
    line_count = measure(count=True)
    units = measure(sum="f.quantity", type="bigint")
    revenue_cents = measure(sum=CENTS, type="bigint")
    largest_line = measure(max=CENTS, type="bigint")
    smallest_line = measure(min=f"CASE WHEN f.quantity > 0 THEN {CENTS} END", type="bigint")
    average_unit_price = ratio(of="revenue_cents", over="units")


class CategoryCounts(Rollup):
    lines = fact("line_items")
    store_id = tenant({"order": "store_id"})
    category_id = dimension({"product": "category_id"})
    line_count = measure(count=True)


class Discounts(Rollup):
    lines = fact("line_items")
    store_id = tenant({"order": "store_id"})
    product_id = dimension("product_id")
    line_count = measure(count=True)
    paid_lines = measure(sum="CASE WHEN g_order.state = 'paid' THEN 1 ELSE 0 END", type="bigint", through="order")
    local_cents = measure(sum=f"CASE WHEN g_order_store.currency = 'COP' THEN {CENTS} ELSE 0 END", type="bigint", through={"order": "store"})


class Halves(Rollup):
    lines = fact("line_items")
    store_id = tenant({"order": "store_id"})
    halves = measure(sum="f.quantity / 2.0", type="bigint")


def cells(engine, rollup):
    keys = rollup.definition().keys
    rows = engine.rows(rollup).collect()
    out = {tuple(r[k] for k in keys): {c: r[c] for c in r.asDict() if c not in keys} for r in rows}
    assert len(out) == len(rows), "a cell is stored twice"
    return out
