"""The star schema of the test tables as sources, and rollups over it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cubeloom.model.definition import Rollup, dimension, fact, measure, ratio, tenant, time
from cubeloom.sources.catalog import BelongsTo, Catalog, HasMany, Source

CENTS = "CAST(ROUND(f.l_extendedprice * 100) AS BIGINT)"
UNITS = "CAST(ROUND(f.l_quantity) AS BIGINT)"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def table(name, pk, **associations):
        return Source.parquet(name, f"{sf_dir}/{name}.parquet", pk, **associations)

    def branded(session: SparkSession):
        parts = session.read.parquet(f"{sf_dir}/part.parquet")
        return parts.withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#11")))

    def shipped(session: SparkSession):
        lines = session.read.parquet(f"{sf_dir}/lineitem.parquet")
        return lines.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))

    return Catalog(
        spark,
        [
            table("region", "r_regionkey"),
            table("nation", "n_nationkey", belongs_to={"region": BelongsTo("region", "n_regionkey")}),
            table("customer", "c_custkey", belongs_to={"nation": BelongsTo("nation", "c_nationkey")}),
            table("supplier", "s_suppkey", belongs_to={"nation": BelongsTo("nation", "s_nationkey")}),
            table("part", "p_partkey"),
            Source("part_with_gaps", branded, "p_partkey"),
            table("orders", "o_orderkey", belongs_to={"customer": BelongsTo("customer", "o_custkey")}, has_many={"lines": HasMany("lineitem", "l_orderkey")}),
            table(
                "lineitem",
                (),
                belongs_to={
                    "order": BelongsTo("orders", "l_orderkey"),
                    "part": BelongsTo("part", "l_partkey"),
                    "gappy_part": BelongsTo("part_with_gaps", "l_partkey"),
                    "supplier": BelongsTo("supplier", "l_suppkey"),
                },
            ),
            Source("shipments", shipped, ()),
            table("events", "event_id"),
            table("documents", "doc_id"),
            table("labels", (), belongs_to={"document": BelongsTo("documents", "doc_id")}),
        ],
    )


class Sales(Rollup):
    lines = fact("lineitem", where={"order": {"o_orderstatus": "F"}})
    nation_id = tenant({"order": {"customer": "c_nationkey"}})
    ordered_on = time({"order": "o_orderdate"}, bucket="day")
    brand = dimension({"part": "p_brand"}, immutable=True)
    returnflag = dimension("l_returnflag")
    line_count = measure(count=True)
    units = measure(sum=UNITS, type="bigint")
    revenue_cents = measure(sum=CENTS, type="bigint")
    largest_line = measure(max=CENTS, type="bigint")
    smallest_line = measure(min=CENTS, type="bigint")
    average_unit_price = ratio(of="revenue_cents", over="units")


class GappyBrands(Rollup):
    """A nullable dimension, and no time."""

    lines = fact("lineitem")
    nation_id = tenant({"supplier": "s_nationkey"})
    brand = dimension({"gappy_part": "p_brand"})
    line_count = measure(count=True)
    taxed_lines = measure(count="nullif(f.l_tax, 0.0D)")
    units = measure(sum=UNITS, type="bigint")


class SupplierOrders(Rollup):
    """Measures that read one and two hops away."""

    lines = fact("lineitem")
    supplier_id = tenant("l_suppkey")
    line_count = measure(count=True)
    open_lines = measure(sum="CASE WHEN g_order.o_orderstatus = 'O' THEN 1 ELSE 0 END", type="bigint", through="order")
    building_cents = measure(sum=f"CASE WHEN g_order_customer.c_mktsegment = 'BUILDING' THEN {CENTS} ELSE 0 END", type="bigint", through={"order": "customer"})


class RegionFlows(Rollup):
    """Three hops, and one table by two routes."""

    lines = fact("lineitem")
    buyer_region = tenant({"order": {"customer": {"nation": "n_regionkey"}}})
    seller_region = dimension({"supplier": {"nation": "n_regionkey"}})
    line_count = measure(count=True)
    revenue_cents = measure(sum=CENTS, type="bigint")


class ReturnedLines(Rollup):
    """A filter on the fact itself, and days that are dates already."""

    lines = fact("shipments", where={"l_returnflag": "R"})
    supplier_id = tenant("l_suppkey")
    shipped_on = time("l_shipdate", bucket="day")
    line_count = measure(count=True)
    units = measure(sum=UNITS, type="bigint")


class EventDays(Rollup):
    clicks = fact("events")
    event_type = tenant("event_type")
    happened_on = time("ts", bucket="day")
    events = measure(count=True)
    thousandths = measure(sum="CAST(ROUND(f.value * 1000) AS BIGINT)", type="bigint")


class LabelCounts(Rollup):
    rows = fact("labels")
    quality = tenant("quality")
    lang = dimension({"document": "lang"})
    labels = measure(count=True)
    toxic = measure(sum="f.toxic", type="bigint")
