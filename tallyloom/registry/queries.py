"""Every operator as a query over the whole test tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import customers as c
from tallyloom.operators import distinct_sketches as d
from tallyloom.operators import experiment as e
from tallyloom.operators import funnel as f
from tallyloom.operators import products as p
from tallyloom.operators import quality as q
from tallyloom.operators import retention as r
from tallyloom.operators import sales as s
from tallyloom.operators.cohort_bitmaps import CohortStore
from tallyloom.operators.order_facts import SplitLines
from tallyloom.operators.sale_batch import SaleBatch, apply_sales
from tallyloom.plans.load import load_checked
from tallyloom.session import cut_lineage, scratch_path
from tallyloom.sources.order_store import OrderStore
from tallyloom.sources.raw_csv import FILES, read_clean_csv, read_table
from tallyloom.sources.sinks import with_provenance, write_report
from tallyloom.sources.star import StarTables

Query = Callable[[SparkSession, str], DataFrame]

EVENT_STEPS = [("View Item", "view"), ("Add to Cart", "click"), ("Purchase", "purchase")]

CHECKOUT_TEST = e.Experiment(
    test_name="Error rate by user parity",
    control=0,
    treatment=1,
    treatment_label="odd users",
    control_label="even users",
    control_description="users with an even number",
    treatment_description="users with an odd number",
    experimental_unit="checkout attempt",
    conversion_metric="purchase instead of error",
)


def _sale_batch(t: StarTables, hot_product: bool = False) -> SaleBatch:
    """Every order line asked for once more; with ``hot_product`` half of them ask for product 1."""
    requests, inventory = t.sale_requests, t.inventory
    if hot_product:
        hot = F.when(F.col("order_id") % 2 == 0, 1).otherwise(F.col("product_id"))
        requests = requests.withColumn("product_id", hot)
        inventory = inventory.withColumn("stock", F.when(F.col("product_id") == 1, 400_000).otherwise(F.col("stock")))
    return apply_sales(
        requests,
        t.customers,
        t.sellers,
        t.products,
        inventory,
        t.orders_without_seller,
        as_of=date(2001, 8, 2),
        items=t.items,
    )


def _shared_path(spark: SparkSession) -> str:
    path = scratch_path(spark)
    if path is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return path


def _through_csv(t: StarTables, table: str, columns: dict[str, Column], df: DataFrame) -> DataFrame:
    """The whole table written as raw CSV and ingested again."""
    path = _shared_path(t.spark)
    df.select(*(column.alias(header) for header, column in columns.items())).write.csv(path, header=True)
    read = read_table(t.spark, table, path)
    money = {name: F.col(name).cast("double") for name, kind in read.dtypes if kind.startswith("decimal")}
    return read.withColumns(money) if money else read


def _csv_customers(t: StarTables) -> DataFrame:
    headers = {"state": "state", "Customer ID": "customer_id", " last_name ": "last_name", "first_name": "first_name"}
    return _through_csv(t, "customers", {h: F.col(c) for h, c in headers.items()}, t.customers)


def _csv_orders(t: StarTables) -> DataFrame:
    return _through_csv(t, "orders", {c: F.col(c) for c in t.orders.columns}, t.orders)


def _csv_order_items(t: StarTables) -> DataFrame:
    columns = {c: F.col(c) for c in ("order_item_id", "order_id", "product_id", "quantity")}
    return _through_csv(t, "order_items", columns | {"price_per_unit": F.col("total_sale")}, t.items)


def _load_with_rejects(t: StarTables) -> DataFrame:
    """Counts of a load whose files hold orders without a right date and lines without a right quantity."""
    raw, path = _shared_path(t.spark), _shared_path(t.spark)
    day = F.when(F.col("order_id") % 97 == 0, "soon").otherwise(F.col("order_date").cast("string"))
    t.orders.withColumn("order_date", day).write.csv(f"{raw}/{FILES['orders']}", header=True)
    quantity = F.when(F.col("order_item_id") % 89 == 0, "many").otherwise(F.col("quantity").cast("string"))
    lines = t.items.select("order_item_id", "order_id", "product_id", quantity.alias("quantity"), F.col("total_sale").alias("price_per_unit"))
    lines.write.csv(f"{raw}/{FILES['order_items']}", header=True)
    loaded = load_checked(t.spark, raw, path, ("orders", "order_items"))
    rejects = loaded.rejects.groupBy("table_name", "reject_reason").agg(F.count(F.lit(1)).alias("rejects"))
    return loaded.audit.join(rejects, "table_name")


def _csv_plain(table: str) -> Callable[[StarTables], DataFrame]:
    """Tables whose headers are their columns' names, but for one that is renamed on the way in."""

    def run(t: StarTables) -> DataFrame:
        df = t.model_tables()[table]
        columns = {c.replace("shipping_providers", "shipping providers"): F.col(c) for c in df.columns}
        return _through_csv(t, table, columns, df)

    return run


def _report_round_trip(t: StarTables) -> DataFrame:
    """The fulfilment funnel with its provenance, written as a report and read back."""
    funnel = f.fulfillment_funnel(t.orders_without_seller).drop("is_simulated")
    report = with_provenance(funnel, False, "measured")
    path = _shared_path(t.spark)
    write_report(report, path)
    back = read_clean_csv(t.spark, path)
    return back.select(*(F.col(name).cast(kind).alias(name) for name, kind in report.dtypes))


def _retention_of_bitmaps(t: StarTables) -> DataFrame:
    """Retention from months added in three goes, the second with orders that the first had too."""
    store = CohortStore(t.spark, _shared_path(t.spark))
    orders, year = t.orders_without_seller, F.year("order_date")
    for part in (year < 1998, year.between(1997, 2000), year >= 2000):
        store.add(orders.filter(part))
    return store.retention()


def _stored(report: Callable[[StarTables, DataFrame, SplitLines], DataFrame]) -> Callable[[StarTables], DataFrame]:
    """A report over orders and lines that are stored bucketed and by month; orders of seven lines count as hot."""

    def run(t: StarTables) -> DataFrame:
        path = _shared_path(t.spark)
        store = OrderStore(t.spark, path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_"), path, buckets=4)
        store.write(t.orders, t.items, most_lines=6)
        return report(t, store.orders(), store.lines())

    return run


def _readout(t: StarTables) -> DataFrame:
    row = e.ab_test_readout(t.attempts, "arm", "success", CHECKOUT_TEST)
    return row.withColumn("p_value", F.round("p_value", 10))


def _kpi_sketched(t: StarTables) -> DataFrame:
    """Exact headline counts of customers, and whether the sketched ones lie within the error bound."""
    tables = (t.customers, t.orders_without_seller, t.items, t.products, t.sellers)
    sketched = s.kpi_summary(*tables, sketch_lg_k=d.LG_K)
    exact = s.kpi_summary(*tables).select("total_customers", "customers_with_orders", "total_orders")
    return exact.withColumns(
        {
            f"{c}_near": F.abs(sketched.select(c).scalar() - F.col(c)) <= d.error_bound(F.col(c))
            for c in ("total_customers", "customers_with_orders")
        }
    )


def _funnel_sketched(t: StarTables) -> DataFrame:
    """The exact funnel, and whether each sketched stage and drop-off lies within the error bound."""
    orders = t.orders_without_seller
    sketched = f.fulfillment_funnel(orders, d.LG_K).select("stage", F.col("orders").alias("sketched"))
    near = F.abs(F.col("sketched") - F.col("orders")) <= d.error_bound(F.col("orders"))
    return f.fulfillment_funnel(orders).join(sketched, "stage").select("stage", "stage_order", "orders", near.alias("near"))


def _quarterly_sketched(t: StarTables) -> DataFrame:
    """Customers and orders per quarter, and whether what monthly sketches merge to is near.

    The sketches are stored in two goes, the second with orders that the first had too.
    """
    columns = ("customer_id", "order_id")
    orders = t.orders_without_seller
    store = d.SketchStore(t.spark, _shared_path(t.spark), columns)
    store.add(orders.filter(F.col("order_id") % 3 != 0), "order_date")
    store.add(orders.filter(F.col("order_id") % 2 == 0), "order_date")
    store.add(orders.filter(F.col("order_id") % 3 == 0), "order_date")
    exact = orders.groupBy(F.to_date(F.date_trunc("quarter", "order_date")).alias("first_month")).agg(
        F.countDistinct("customer_id").alias("customers"), F.countDistinct("order_id").alias("orders")
    )
    near = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= d.error_bound(F.col(b))).alias(f"{b}_near")
    return exact.join(store.per_months(3), "first_month").select(
        "first_month", "customers", "orders", near("customer_id", "customers"), near("order_id", "orders")
    )


_ON_TABLES: dict[str, Callable[[StarTables], DataFrame]] = {
    # sales, products, customers, sellers, shipping
    "top_products": lambda t: p.top_products(t.orders_without_seller, t.items, t.products),
    "category_revenue_share": lambda t: p.category_revenue_share(t.items, t.products, t.category),
    "customer_aov": lambda t: c.customer_aov(t.orders_without_seller, t.items, t.customers),
    "monthly_sales_trend": lambda t: s.monthly_sales_trend(t.orders_without_seller, t.items),
    "customers_never_ordered": lambda t: c.customers_never_ordered(t.customers, t.orders_without_seller),
    "customers_not_ordered_lately": lambda t: c.customers_never_ordered(t.customers, t.orders_without_seller, 6),
    "least_category_per_state": lambda t: c.least_category_per_state(
        t.orders_without_seller, t.items, t.customers, t.products, t.category
    ),
    "customer_clv_rank": lambda t: c.customer_clv_rank(t.orders_without_seller, t.items, t.customers),
    "low_inventory": lambda t: p.low_inventory(t.inventory, t.products),
    "slow_shipping": lambda t: s.slow_shipping(t.shippings, t.orders_without_seller, t.customers),
    "payment_status_share": lambda t: s.payment_status_share(t.orders_without_seller, t.payments),
    "top_seller_success": lambda t: s.top_seller_success(t.orders, t.items, t.sellers),
    "product_margin_rank": lambda t: p.product_margin_rank(t.items, t.products),
    "top_returned_products": lambda t: p.top_returned_products(t.orders_without_seller, t.items, t.products),
    "inactive_sellers": lambda t: s.inactive_sellers(t.orders, t.items, t.sellers, null_safe=True),
    "inactive_sellers_not_in": lambda t: s.inactive_sellers(t.orders, t.items, t.sellers),
    # the same NOT IN over orders that all have a seller: no NULL empties it
    "inactive_sellers_not_in_known": lambda t: s.inactive_sellers(
        t.orders.filter(F.col("seller_id").isNotNull()), t.items, t.sellers
    ),
    "customer_return_class": lambda t: c.customer_return_class(t.orders_without_seller, t.items, t.customers),
    "top_customers_per_state": lambda t: c.top_customers_per_state(t.orders_without_seller, t.items, t.customers),
    "top_customers_per_state_by_id": lambda t: c.top_customers_per_state(
        t.orders_without_seller, t.items, t.customers, by_id=True
    ),
    "provider_performance": lambda t: s.provider_performance(t.shippings, t.orders_without_seller, t.items),
    "yoy_decline": lambda t: p.yoy_decline(t.orders_without_seller, t.items, t.products, 1999, 2000),
    "kpi_summary": lambda t: s.kpi_summary(t.customers, t.orders_without_seller, t.items, t.products, t.sellers),
    "kpi_summary_sketched": _kpi_sketched,
    "quarterly_customers_sketched": _quarterly_sketched,
    "fulfillment_funnel_sketched": _funnel_sketched,
    # the same reports over stored orders and lines
    "monthly_sales_trend_stored": _stored(lambda t, orders, lines: s.monthly_sales_trend(orders, lines)),
    "yoy_decline_stored": _stored(lambda t, orders, lines: p.yoy_decline(orders, lines, t.products, 1999, 2000)),
    "customer_clv_rank_stored": _stored(lambda t, orders, lines: c.customer_clv_rank(orders, lines, t.customers)),
    "top_seller_success_stored": _stored(lambda t, orders, lines: s.top_seller_success(orders, lines, t.sellers)),
    "order_count_distribution": lambda t: c.order_count_distribution(t.orders_without_seller),
    "state_revenue": lambda t: c.state_revenue(t.orders_without_seller, t.items, t.customers),
    "never_ordered_share": lambda t: c.never_ordered_share(t.customers, t.orders_without_seller),
    "not_ordered_lately_share": lambda t: c.never_ordered_share(t.customers, t.orders_without_seller, 6),
    "return_share": lambda t: s.return_share(t.orders_without_seller),
    "only_cancelled_customers": lambda t: c.only_cancelled_customers(t.orders_without_seller),
    # two neighbouring order numbers as one customer, so that some have cancelled orders only
    "only_cancelled_order_blocks": lambda t: c.only_cancelled_customers(
        t.orders_without_seller.withColumn("customer_id", F.floor(F.col("order_id") / 2))
    ),
    # the same revenue reports over kept orders only
    "top_products_completed": lambda t: p.top_products(
        t.orders_without_seller, t.items, t.products, statuses=["Completed"]
    ),
    "category_revenue_share_completed": lambda t: p.category_revenue_share(
        t.items, t.products, t.category, t.orders_without_seller, ["Completed"]
    ),
    "customer_clv_rank_completed": lambda t: c.customer_clv_rank(
        t.orders_without_seller, t.items, t.customers, ["Completed"]
    ),
    # retention
    "cohort_retention": lambda t: r.cohort_retention(t.orders_without_seller),
    # The pivot reads the retention twice; written, it is a few hundred rows.
    "cohort_pivot": lambda t: r.cohort_pivot(cut_lineage(r.cohort_retention(t.orders_without_seller))),
    "retention_window": lambda t: r.retention_window(
        r.cohort_pivot(r.cohort_retention(t.orders_without_seller), range(13)), 12
    ),
    "cohort_retention_bitmaps": _retention_of_bitmaps,
    "retention_curve": lambda t: r.retention_curve(r.cohort_retention(t.orders_without_seller)),
    # funnels and the test readout
    "fulfillment_funnel": lambda t: f.fulfillment_funnel(t.orders_without_seller),
    "order_completion_rate": lambda t: f.order_completion_rate(t.orders_without_seller),
    "event_funnel": lambda t: f.event_funnel(t.events, EVENT_STEPS, within_hours=12),
    "ab_test_groups": lambda t: e.ab_test_groups(t.attempts, "arm", "success", CHECKOUT_TEST),
    "ab_test_z": lambda t: e.ab_test_z(t.attempts, "arm", "success", CHECKOUT_TEST).withColumn("z", F.round("z", 8)),
    "ab_test_readout": _readout,
    # sale requests
    "apply_sales_outcomes": lambda t: _sale_batch(t).outcomes.drop("seq"),
    "apply_sales_hot_product": lambda t: _sale_batch(t, hot_product=True).outcomes.drop("seq"),
    "apply_sales_orders": lambda t: _sale_batch(t).orders,
    "apply_sales_items": lambda t: _sale_batch(t).items.withColumns(
        {"price_per_unit": F.col("price_per_unit").cast("double"), "total_sale": F.col("total_sale").cast("double")}
    ),
    "apply_sales_inventory": lambda t: _sale_batch(t).inventory,
    # ingest
    "csv_ingest_customers": _csv_customers,
    "csv_ingest_orders": _csv_orders,
    "csv_ingest_order_items": _csv_order_items,
    "csv_ingest_category": _csv_plain("category"),
    "csv_ingest_sellers": _csv_plain("sellers"),
    "csv_ingest_products": _csv_plain("products"),
    "csv_ingest_inventory": _csv_plain("inventory"),
    "csv_ingest_payments": _csv_plain("payments"),
    "csv_ingest_shippings": _csv_plain("shippings"),
    "load_with_rejects": _load_with_rejects,
    # sinks
    "report_round_trip": _report_round_trip,
    # data quality
    "load_audit": lambda t: q.load_audit(t.model_tables()),
    "primary_key_audit": lambda t: q.primary_key_audit(t.model_tables()),
    "foreign_key_audit": lambda t: q.foreign_key_audit(t.model_tables()),
    "text_width_audit": lambda t: q.text_width_audit(t.model_tables()),
    "duplicate_keys": lambda t: q.duplicate_keys(t.source("lineitem"), "l_orderkey", "l_linenumber"),
    "status_matrix": lambda t: q.status_matrix(t.orders_without_seller, t.payments, t.shippings),
    "funnel_reconciliation": lambda t: q.funnel_reconciliation(t.orders_without_seller),
    "cohort_checks": lambda t: q.cohort_checks(r.cohort_retention(t.orders_without_seller)),
}


def _query(run: Callable[[StarTables], DataFrame]) -> Query:
    return lambda spark, folder: run(StarTables(spark, folder))


QUERIES: dict[str, Query] = {name: _query(run) for name, run in _ON_TABLES.items()}
