"""Queries over the test tables, one per capability, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.config import Config
from cubeloom.demo.tables import EventDays, GappyBrands, LabelCounts, RegionFlows, ReturnedLines, Sales, SupplierOrders, catalog
from cubeloom.engine import Engine
from cubeloom.errors import MissingTenantError
from cubeloom.sources.scratch import shared_folder

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}
_ENGINES: dict[tuple, Engine] = {}

SALES_SQL = """
SELECT c.c_nationkey AS nation_id, CAST(o.o_orderdate AS DATE) AS ordered_on, p.p_brand AS brand, l.l_returnflag AS returnflag,
       count(*) AS line_count, CAST(sum(CAST(round(l.l_quantity) AS BIGINT)) AS BIGINT) AS units,
       CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents,
       max(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS largest_line,
       min(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS smallest_line
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
     JOIN part p ON p.p_partkey = l.l_partkey
WHERE o.o_orderstatus = 'F' GROUP BY 1, 2, 3, 4
"""
SALES = SALES_SQL.format(lineitem="lineitem", orders="orders")
MEASURES = (
    "CAST(coalesce(sum(line_count), 0) AS BIGINT) AS line_count, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, "
    "CAST(coalesce(sum(revenue_cents), 0) AS BIGINT) AS revenue_cents, max(largest_line) AS largest_line, min(smallest_line) AS smallest_line, "
    "CAST(coalesce(sum(revenue_cents), 0) AS DOUBLE) / nullif(coalesce(sum(units), 0), 0) AS average_unit_price"
)


def _engine(spark: SparkSession, sf_dir: str, *rollups, zone: str = "UTC") -> Engine:
    """An engine with the rollups built; kept per session, data and rollups, as a rollup outlives its reads."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(r.__name__ for r in rollups), zone)
    if key not in _ENGINES:
        _ENGINES[key] = _fresh(spark, sf_dir, *rollups, zone=zone)
    return _ENGINES[key]


def _fresh(spark: SparkSession, sf_dir: str, *rollups, zone: str = "UTC", sources=None) -> Engine:
    engine = Engine(spark, sources or catalog(spark, sf_dir), shared_folder(spark, "rollups"), Config(time_zone=zone, batch_size=100_000, max_run_seconds=float("inf")))
    engine.register(*rollups)
    for r in rollups:
        engine.backfill(r)
    return engine


def _query(sql: str | None = None):
    def add(f: Builder) -> Builder:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(where: str = "", by: str = "") -> str:
    groups = [g.strip() for g in by.split(",") if g.strip()]
    names = ", ".join(f"{g}," for g in groups).replace(",,", ",")
    return f"WITH r AS ({SALES}) SELECT {names} {MEASURES} FROM r {'WHERE ' + where if where else ''} {'GROUP BY ALL' if groups else ''}"


def _sales(spark: SparkSession, sf_dir: str):
    return _engine(spark, sf_dir, Sales).query(Sales)


# Reads


@_query(_read("nation_id = 3"))
def total_ungrouped(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3).df()


@_query(_read())
def total_across_tenants(spark, sf_dir):
    return _sales(spark, sf_dir).across_tenants().df()


@_query(_read("nation_id = 3", "brand"))
def by_brand(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation=3).by("brand").df()


@_query(_read("", "nation_id, returnflag"))
def by_two_dims(spark, sf_dir):
    return _sales(spark, sf_dir).across_tenants().by("nation", "returnflag").df()


@_query(_read("nation_id = 5", "ordered_on, brand"))
def by_day_and_brand(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=5).by("ordered_on").by("brand").df()


def _coarse(unit: str) -> None:
    def read(spark, sf_dir):
        return _sales(spark, sf_dir).where(nation_id=3).by(ordered_on=unit).df()

    read.__name__ = f"by_{unit}"
    _query(_read("nation_id = 3", f"CAST(date_trunc('{unit}', ordered_on) AS DATE) AS ordered_on"))(read)


for _unit in ("week", "month", "quarter", "year"):
    _coarse(_unit)


@_query(_read("nation_id = 3 AND ordered_on BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'", "CAST(date_trunc('month', ordered_on) AS DATE) AS ordered_on"))
def between_dates(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3).between("1995-01-01", "1995-12-31").by(ordered_on="month").df()


@_query(_read("nation_id = 3 AND brand = 'Brand#12'", "returnflag"))
def filter_scalar(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3, brand="Brand#12").by("returnflag").df()


@_query(_read("nation_id IN (3, 5) AND brand IN ('Brand#12', 'Brand#21')", "nation_id, brand"))
def filter_list(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=[3, 5], brand=["Brand#12", "Brand#21"]).by("nation_id", "brand").df()


@_query(_read("nation_id = 3 AND FALSE", "brand"))
def filter_empty_list(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3, brand=[]).by("brand").df()


@_query(_read("nation_id = 3 AND ordered_on < DATE '1900-01-01'"))
def ratio_over_nothing(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3).between("1800-01-01", "1899-12-31").df()


@_query(_read("nation_id = 3", "CAST(date_trunc('month', ordered_on) AS DATE) AS ordered_on, returnflag"))
def extremes_by_month(spark, sf_dir):
    return _sales(spark, sf_dir).where(nation_id=3).by("returnflag", ordered_on="month").df()


@_query(_read("nation_id = 3", "brand"))
def sql_text(spark, sf_dir):
    engine = _engine(spark, sf_dir, Sales)
    engine.register_views()
    return spark.sql(engine.query(Sales).where(nation_id=3).by("brand").sql())


@_query(_read("", "brand"))
def live_read(spark, sf_dir):
    return _engine(spark, sf_dir, Sales).live_query(Sales).across_tenants().by("brand").df()


_GAPPY = """
SELECT s.s_nationkey AS nation_id, nullif(p.p_brand, 'Brand#11') AS brand, count(*) AS line_count,
       count(nullif(l.l_tax, 0.0)) AS taxed_lines, CAST(sum(CAST(round(l.l_quantity) AS BIGINT)) AS BIGINT) AS units
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2
"""


def _gappy_read(where: str, by: str = "") -> str:
    sums = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in ("line_count", "taxed_lines", "units"))
    return f"WITH r AS ({_GAPPY}) SELECT {by + ',' if by else ''} {sums} FROM r WHERE {where} {'GROUP BY ' + by if by else ''}"


def _gappy(spark, sf_dir):
    return _engine(spark, sf_dir, GappyBrands).query(GappyBrands)


@_query(_GAPPY)
def null_dimension_cell(spark, sf_dir):
    return _engine(spark, sf_dir, GappyBrands).rows(GappyBrands)


@_query(_gappy_read("nation_id = 3 AND (brand IN ('Brand#12') OR brand IS NULL)", "brand"))
def filter_list_with_null(spark, sf_dir):
    return _gappy(spark, sf_dir).where(nation_id=3, brand=["Brand#12", None]).by("brand").df()


@_query(_gappy_read("nation_id = 3 AND brand IS NULL"))
def filter_null(spark, sf_dir):
    return _gappy(spark, sf_dir).where(nation_id=3, brand=None).df()


@_query(_gappy_read("TRUE", "nation_id"))
def count_nonnull(spark, sf_dir):
    return _gappy(spark, sf_dir).across_tenants().by("nation").df()


@_query(
    """SELECT l.l_suppkey AS supplier_id, count(*) AS line_count, CAST(sum(CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1"""
)
def through_one_hop(spark, sf_dir):
    return _engine(spark, sf_dir, SupplierOrders).rows(SupplierOrders).select("supplier_id", "line_count", "open_lines")


@_query(
    """SELECT l.l_suppkey AS supplier_id,
 CAST(sum(CASE WHEN c.c_mktsegment = 'BUILDING' THEN CAST(round(l.l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS building_cents
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1"""
)
def through_two_hops(spark, sf_dir):
    return _engine(spark, sf_dir, SupplierOrders).rows(SupplierOrders).select("supplier_id", "building_cents")


_FLOWS = """
SELECT bn.n_regionkey AS buyer_region, sn.n_regionkey AS seller_region, count(*) AS line_count,
       CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
     JOIN nation bn ON bn.n_nationkey = c.c_nationkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
     JOIN nation sn ON sn.n_nationkey = s.s_nationkey GROUP BY 1, 2
"""


@_query(f"WITH r AS ({_FLOWS}) SELECT buyer_region, CAST(sum(line_count) AS BIGINT) AS line_count, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM r GROUP BY 1")
def three_hop_dimension(spark, sf_dir):
    return _engine(spark, sf_dir, RegionFlows).query(RegionFlows).across_tenants().by("buyer_region").df()


@_query(_FLOWS)
def two_routes_same_table(spark, sf_dir):
    return _engine(spark, sf_dir, RegionFlows).rows(RegionFlows)


_EVENTS = """
SELECT event_type, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}' AS DATE) AS happened_on, count(*) AS events,
       CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS thousandths FROM events GROUP BY 1, 2
"""


@_query(_EVENTS.format(zone="America/New_York"))
def events_day_tz(spark, sf_dir):
    return _engine(spark, sf_dir, EventDays, zone="America/New_York").rows(EventDays)


@_query("SELECT event_type, CAST(ts AS DATE) AS happened_on, count(*) AS events, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS thousandths FROM events GROUP BY 1, 2")
def events_day_utc(spark, sf_dir):
    return _engine(spark, sf_dir, EventDays).rows(EventDays)


@_query("SELECT l.quality, d.lang, count(*) AS labels, CAST(sum(l.toxic) AS BIGINT) AS toxic FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def labels_by_lang(spark, sf_dir):
    return _engine(spark, sf_dir, LabelCounts).rows(LabelCounts)


@_query(
    """SELECT l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS shipped_on, count(*) AS line_count,
 CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS units FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"""
)
def local_filter_and_dates(spark, sf_dir):
    return _engine(spark, sf_dir, ReturnedLines).rows(ReturnedLines)


# Order and results on the driver: each read below is a report of a few groups, numbered as it arrives.


@_query(f"SELECT row_number() OVER (ORDER BY brand NULLS LAST) AS place, brand, line_count, units FROM ({_gappy_read('TRUE', 'brand')}) r")
def read_in_order(spark, sf_dir):
    rows = _gappy(spark, sf_dir).across_tenants().by("brand").rows()
    return spark.createDataFrame([(i, r["brand"], r["line_count"], r["units"]) for i, r in enumerate(rows, 1)], "place long, brand string, line_count long, units long")


@_query("SELECT row_number() OVER (ORDER BY slice NULLS LAST) AS place, slice FROM (SELECT DISTINCT s_nationkey AS slice FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) r")
def slices_in_order(spark, sf_dir):
    slices = _engine(spark, sf_dir, GappyBrands).slices(GappyBrands).collect()
    return spark.createDataFrame([(i, r.slice) for i, r in enumerate(slices, 1)], "place long, slice int")


@_query(f"WITH r AS ({_read('nation_id = 3', 'returnflag, brand')}) SELECT returnflag, brand, revenue_cents, average_unit_price FROM r")
def read_as_dict(spark, sf_dir):
    """Rows keyed by both groups."""
    found = _sales(spark, sf_dir).where(nation_id=3).by("returnflag", "brand").to_dict()
    rows = [(flag, brand, r["revenue_cents"], r["average_unit_price"]) for (flag, brand), r in found.items()]
    return spark.createDataFrame(rows, "returnflag string, brand string, revenue_cents long, average_unit_price double")


@_query(f"WITH r AS ({_read('nation_id = 3', 'brand')}) SELECT brand, units, average_unit_price FROM r")
def values_by_name(spark, sf_dir):
    """A measure asked for by name and a ratio as an attribute, both by group."""
    read = _sales(spark, sf_dir).where(nation_id=3).by("brand")
    units, prices = read.value("units"), read.average_unit_price
    return spark.createDataFrame([(brand, units[brand], price) for brand, price in prices.items()], "brand string, units long, average_unit_price double")


@_query("SELECT * FROM (VALUES ('all tenants asked for', FALSE), ('no tenant', TRUE), ('no tenant, as text', TRUE), ('null', TRUE), ('null in a list', TRUE), ('one tenant', FALSE)) v(read, refused)")
def tenant_guard(spark, sf_dir):
    """Which reads are refused for want of a tenant."""
    sales = _sales(spark, sf_dir)
    reads = {
        "all tenants asked for": sales.across_tenants().df,
        "no tenant": sales.by("brand").df,
        "no tenant, as text": sales.by("brand").sql,
        "null": lambda: sales.where(nation_id=None).df(),
        "null in a list": lambda: sales.where(nation_id=[3, None]).df(),
        "one tenant": sales.where(nation_id=3).df,
    }

    def refused(read) -> bool:
        try:
            read()
        except MissingTenantError:
            return True
        return False

    return spark.createDataFrame([(name, refused(read)) for name, read in reads.items()], "read string, refused boolean")


# Building


@_query(SALES)
def backfill_full(spark, sf_dir):
    return _fresh(spark, sf_dir, Sales).rows(Sales)


@_query(f"WITH r AS ({SALES}) SELECT * FROM r WHERE ordered_on >= DATE '1996-01-01'")
def backfill_from(spark, sf_dir):
    engine = Engine(spark, catalog(spark, sf_dir), shared_folder(spark, "rollups"))
    engine.backfill(Sales, from_="1996-01-01")
    engine.backfill(Sales, from_="1997-01-01")
    return engine.rows(Sales)


@_query(f"WITH r AS ({SALES}) SELECT DISTINCT ordered_on AS slice FROM r WHERE ordered_on >= DATE '1996-01-01'")
def distinct_slices(spark, sf_dir):
    import datetime

    return _engine(spark, sf_dir, Sales).slices(Sales, datetime.date(1996, 1, 1))


@_query("SELECT DISTINCT s_nationkey AS slice FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def counter_cache_slices(spark, sf_dir):
    return _engine(spark, sf_dir, GappyBrands).slices(GappyBrands)


# Changes. Each builds from one state, moves the tables to another, drains, and must equal the aggregate over the latter.

_SOME_ORDERS = "o_orderkey % 97 = 0"
_SOME_LINES = "l_orderkey % 97 = 0"


def _after(lineitem: str = "lineitem", orders: str = "orders") -> str:
    return SALES_SQL.format(lineitem=f"({lineitem})" if " " in lineitem else lineitem, orders=f"({orders})" if " " in orders else orders)


@_query(_after())
def drain_insert(spark, sf_dir):
    engine = _before_lines(spark, sf_dir, f"NOT ({_SOME_LINES})")
    engine.mutate(lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    engine.drain()
    return engine.rows(Sales)


def _before_lines(spark, sf_dir, where: str) -> Engine:
    sources = catalog(spark, sf_dir)
    sources.replace("lineitem", sources.frame("lineitem").where(where))
    return _fresh(spark, sf_dir, Sales, sources=sources)


@_query(_after(lineitem=f"SELECT * FROM lineitem WHERE NOT ({_SOME_LINES})"))
def drain_delete(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(lineitem=engine.catalog.frame("lineitem").where(f"NOT ({_SOME_LINES})"))
    engine.drain()
    return engine.rows(Sales)


@_query(_after(lineitem=f"SELECT * REPLACE (CASE WHEN {_SOME_LINES} THEN l_quantity + 3 ELSE l_quantity END AS l_quantity) FROM lineitem"))
def drain_update(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(lineitem=engine.catalog.frame("lineitem").withColumn("l_quantity", F.expr(f"CASE WHEN {_SOME_LINES} THEN l_quantity + 3 ELSE l_quantity END")))
    engine.drain()
    return engine.rows(Sales)


@_query(_after(lineitem=f"SELECT * REPLACE (CASE WHEN {_SOME_LINES} THEN 1 + l_partkey % 50 ELSE l_partkey END AS l_partkey) FROM lineitem"))
def drain_move(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(lineitem=engine.catalog.frame("lineitem").withColumn("l_partkey", F.expr(f"CASE WHEN {_SOME_LINES} THEN 1 + l_partkey % 50 ELSE l_partkey END")))
    engine.drain()
    return engine.rows(Sales)


_FLIP = "CASE WHEN o_orderkey % 89 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'F' END ELSE o_orderstatus END"


@_query(_after(orders=f"SELECT * REPLACE ({_FLIP} AS o_orderstatus) FROM orders"))
def drain_filter_flip(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(orders=engine.catalog.frame("orders").withColumn("o_orderstatus", F.expr(_FLIP)))
    engine.drain()
    return engine.rows(Sales)


_MOVE = f"CASE WHEN {_SOME_ORDERS} THEN 1 + o_custkey % 100 ELSE o_custkey END"


@_query(_after(orders=f"SELECT * REPLACE ({_MOVE} AS o_custkey) FROM orders"))
def drain_parent_move(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(orders=engine.catalog.frame("orders").withColumn("o_custkey", F.expr(_MOVE)))
    engine.drain()
    return engine.rows(Sales)


@_query(_after(lineitem=f"SELECT * FROM lineitem WHERE NOT ({_SOME_LINES})", orders=f"SELECT * FROM orders WHERE NOT ({_SOME_ORDERS})"))
def drain_cascade_delete(spark, sf_dir):
    """Parents and children go before one drain, which claims them in several steps."""
    engine = _fresh(spark, sf_dir, Sales)
    tables = engine.catalog
    entries = engine.mutate(orders=tables.frame("orders").where(f"NOT ({_SOME_ORDERS})"), lineitem=tables.frame("lineitem").where(f"NOT ({_SOME_LINES})"))
    engine.drain(limit=max(1, entries // 2))
    return engine.rows(Sales)


@_query(_after(lineitem=f"SELECT * FROM lineitem WHERE NOT ({_SOME_LINES})", orders=f"SELECT * REPLACE ({_MOVE} AS o_custkey) FROM orders"))
def drain_move_then_delete(spark, sf_dir):
    """Orders move to other customers, then their lines go, all before one drain."""
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(orders=engine.catalog.frame("orders").withColumn("o_custkey", F.expr(_MOVE)))
    engine.mutate(lineitem=engine.catalog.frame("lineitem").where(f"NOT ({_SOME_LINES})"))
    engine.drain()
    return engine.rows(Sales)


@_query(
    f"""WITH now AS ({_GAPPY}), before AS ({_GAPPY.replace("FROM lineitem l", f"FROM (SELECT * FROM lineitem WHERE NOT ({_SOME_LINES})) l")})
SELECT * FROM before WHERE nation_id <> 3 UNION ALL SELECT * FROM now WHERE nation_id = 3"""
)
def recompute_one_slice(spark, sf_dir):
    """Lines arrive unlogged; one tenant is rebuilt, the others stay as they were."""
    sources = catalog(spark, sf_dir)
    every_line = sources.frame("lineitem")
    sources.replace("lineitem", every_line.where(f"NOT ({_SOME_LINES})"))
    engine = _fresh(spark, sf_dir, GappyBrands, sources=sources)
    sources.replace("lineitem", every_line)
    engine.recompute_slice(GappyBrands, 3)
    return engine.rows(GappyBrands)


@_query(SALES)
def immutable_path_unwatched(spark, sf_dir):
    """A promise that a brand never changes: when it does, nothing is logged and the cells stay."""
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(part=engine.catalog.frame("part").withColumn("p_brand", F.lit("Brand#99")))
    engine.drain()
    return engine.rows(Sales)


@_query(_after(orders=f"SELECT * REPLACE ({_MOVE} AS o_custkey) FROM orders"))
def drain_stream(spark, sf_dir):
    engine = _fresh(spark, sf_dir, Sales)
    engine.mutate(orders=engine.catalog.frame("orders").withColumn("o_custkey", F.expr(_MOVE)))
    engine.drain_stream(shared_folder(spark, "drain")).awaitTermination()
    return engine.rows(Sales)


# Verifying


def _corrupted(spark, sf_dir) -> Engine:
    """One brand's numbers wrong, another's cells missing, and cells of a nation that isn't."""
    engine = _fresh(spark, sf_dir, Sales)
    store = engine.store(Sales)
    base = store.version()
    rows = store.read(base)
    wrong = rows.where("brand != 'Brand#13'").withColumn("revenue_cents", F.expr("revenue_cents + CASE WHEN brand = 'Brand#12' THEN 1 ELSE 0 END"))
    extra = rows.where("brand = 'Brand#14'").withColumn("nation_id", F.lit(99))
    store.write(wrong.unionByName(extra), base, base.offset)
    return engine


_STORED_COLUMNS = ("line_count", "units", "revenue_cents", "largest_line", "smallest_line")


def _compare(scope: str = "TRUE") -> str:
    keys = ("nation_id", "ordered_on", "brand", "returnflag")
    return f"""
WITH truth AS ({SALES}), stored AS (
  SELECT nation_id, ordered_on, brand, returnflag, line_count, units,
         revenue_cents + CASE WHEN brand = 'Brand#12' THEN 1 ELSE 0 END AS revenue_cents, largest_line, smallest_line
  FROM truth WHERE brand <> 'Brand#13'
  UNION ALL SELECT 99, ordered_on, brand, returnflag, line_count, units, revenue_cents, largest_line, smallest_line FROM truth WHERE brand = 'Brand#14'
), extra_folded AS (SELECT nation_id, ordered_on, brand, returnflag, {", ".join(f"max({c}) AS {c}" for c in _STORED_COLUMNS)} FROM stored GROUP BY ALL)
SELECT {", ".join(f"coalesce(s.{k}, t.{k}) AS {k}" for k in keys)},
       {", ".join(f"s.{c} AS stored_{c}, t.{c} AS expected_{c}" for c in _STORED_COLUMNS)},
       CASE WHEN s.nation_id IS NULL THEN 'missing' WHEN t.nation_id IS NULL THEN 'extra' ELSE 'wrong' END AS kind
FROM (SELECT * FROM extra_folded WHERE {scope}) s FULL JOIN (SELECT * FROM truth WHERE {scope}) t
  ON {" AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)}
WHERE s.nation_id IS NULL OR t.nation_id IS NULL OR {" OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in _STORED_COLUMNS)}"""


_NO_DIFFERENCE = ", ".join(f"{c} AS stored_{c}, {c} AS expected_{c}" for c in _STORED_COLUMNS)


@_query(f"WITH r AS ({SALES}) SELECT nation_id, ordered_on, brand, returnflag, {_NO_DIFFERENCE}, 'none' AS kind FROM r WHERE FALSE")
def verify_clean(spark, sf_dir):
    return _engine(spark, sf_dir, Sales).discrepancies(Sales)


@_query(_compare())
def verify_three_kinds(spark, sf_dir):
    return _corrupted(spark, sf_dir).discrepancies(Sales)


@_query(_compare("nation_id = 3 AND ordered_on BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"))
def verify_scoped(spark, sf_dir):
    return _corrupted(spark, sf_dir).discrepancies(Sales, tenant=3, between=("1994-01-01", "1996-12-31"))


@_query(SALES)
def repair(spark, sf_dir):
    engine = _corrupted(spark, sf_dir)
    engine.verify(Sales, repair=True)
    return engine.rows(Sales)


# Capture


@_query(
    """SELECT * FROM (VALUES ('customer', 'c_nationkey'), ('lineitem', NULL), ('orders', 'o_custkey'), ('orders', 'o_orderdate'), ('orders', 'o_orderstatus'))
AS v(table_name, column_name)"""
)
def watched_columns(spark, sf_dir):
    """Tables and columns whose changes are logged; null: every update."""
    policy = Engine(spark, catalog(spark, sf_dir), shared_folder(spark, "rollups")).register(Sales).capture_policy()
    rows = [(p.table, c) for p in policy.values() for c in (p.columns or [None])]
    return spark.createDataFrame(rows, "table_name string, column_name string")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'update' AS operation, o_orderstatus AS previous_status FROM orders WHERE o_orderkey % 89 = 0")
def capture_narrowed(spark, sf_dir):
    """Every order changes its priority, a few their status: only the latter are logged."""
    engine = Engine(spark, catalog(spark, sf_dir), shared_folder(spark, "rollups")).register(Sales)
    orders = engine.catalog.frame("orders")
    engine.record("orders", orders, orders.withColumn("o_orderpriority", F.lit("none")).withColumn("o_orderstatus", F.expr(_FLIP)))
    entries = engine.log.entries("orders", engine.catalog.schema("orders"), (0, 0))
    return entries.select("row_id", "operation", F.col("previous.o_orderstatus").alias("previous_status"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS row_id, c_custkey % 11 = 0 AS moved FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0")
def capture_of_two_rollups(spark, sf_dir):
    """What one rollup watches and what the other does are both logged: customers move, or change their segment."""
    engine = Engine(spark, catalog(spark, sf_dir), shared_folder(spark, "rollups")).register(Sales, SupplierOrders)
    customers = engine.catalog.frame("customer")
    moved = customers.withColumn("c_nationkey", F.expr("CAST(CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS INT)"))
    engine.record("customer", customers, moved.withColumn("c_mktsegment", F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'NONE' ELSE c_mktsegment END")))
    entries = engine.log.entries("customer", engine.catalog.schema("customer"), (0, 0))
    return entries.select("row_id", (F.col("row_id").cast("long") % 11 == 0).alias("moved"))


@_query(
    f"""SELECT row_number() OVER (ORDER BY nation_id, ordered_on, brand, returnflag) AS place, nation_id, ordered_on, brand, returnflag, kind
FROM ({_compare()}) r QUALIFY place <= 1000"""
)
def report_in_order(spark, sf_dir):
    """The cells that a report of disagreements lists, which are the first 1000 by key, as it lists them."""
    listed = _corrupted(spark, sf_dir).verify(Sales).listed
    rows = [(i, *d.cell.values(), d.kind) for i, d in enumerate(listed, 1)]
    return spark.createDataFrame(rows, "place long, nation_id int, ordered_on date, brand string, returnflag string, kind string")


@_query(f"WITH r AS ({_compare()}) SELECT kind, count(*) AS cells FROM r GROUP BY 1")
def report_counts(spark, sf_dir):
    report = _corrupted(spark, sf_dir).verify(Sales)
    return spark.createDataFrame([(kind, report.count_of(kind)) for kind in ("wrong", "missing", "extra")], "kind string, cells long")


def queries() -> dict[str, Builder]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
