"""Reference SQL (DuckDB dialect) for the registered queries.

Each text starts with the views it needs, as common table expressions. Ratios
are rounded in whole numbers, half away from zero, so that they are exact.
"""

from __future__ import annotations

_STATUS = """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'Cancelled'
            WHEN o_orderstatus = 'P' THEN 'Returned'
            WHEN o_orderstatus = 'O' THEN 'Inprogress'
            WHEN o_orderstatus = 'F' THEN 'Completed' END"""

# view -> (views it reads, body)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_category": (
        (),
        """SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS category_id, p_type AS category_name
           FROM (SELECT DISTINCT p_type FROM part)""",
    ),
    "fx_customers": (
        (),
        """SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
                  split_part(c_name, '#', 2) AS last_name, n_name AS state, 'xxxx' AS address
           FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "fx_sellers": (
        (),
        """SELECT s_suppkey AS seller_id, s_name AS seller_name, n_name AS origin
           FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    ),
    "fx_products": (
        ("fx_category",),
        """SELECT p_partkey AS product_id, p_name AS product_name,
                  CAST(p_retailprice AS DECIMAL(18,2)) AS price,
                  CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS cogs,
                  category_id
           FROM part JOIN fx_category ON category_name = p_type""",
    ),
    "fx_orders": (
        (),
        f"""SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id,
                   seller_id, {_STATUS} AS order_status
            FROM orders
            LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS seller_id FROM lineitem GROUP BY l_orderkey)
              ON l_orderkey = o_orderkey""",
    ),
    "fx_items": (
        (),
        """SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
                  CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_sale
           FROM lineitem""",
    ),
    "fx_payments": (
        ("fx_orders",),
        """SELECT order_id AS payment_id, order_id, order_date AS payment_date,
                  CASE order_status WHEN 'Cancelled' THEN 'Payment Failed' WHEN 'Returned' THEN 'Refunded'
                       ELSE 'Payment Successed' END AS payment_status
           FROM fx_orders""",
    ),
    "fx_ship": (
        ("fx_orders",),
        """SELECT order_id AS shipping_id, order_id, first_day AS shipping_date,
                  CASE WHEN order_status = 'Returned' THEN last_day END AS return_date,
                  o_orderpriority AS shipping_providers,
                  CASE order_status WHEN 'Inprogress' THEN 'Shipped' WHEN 'Completed' THEN 'Delivered'
                       ELSE 'Returned' END AS delivery_status
           FROM fx_orders
           JOIN orders ON o_orderkey = order_id
           JOIN (SELECT l_orderkey, CAST(MIN(l_shipdate) AS DATE) AS first_day, CAST(MAX(l_shipdate) AS DATE) AS last_day
                 FROM lineitem GROUP BY l_orderkey) ON l_orderkey = order_id
           WHERE order_status <> 'Cancelled'""",
    ),
    "fx_inv": (
        (),
        """SELECT p_partkey AS inventory_id, p_partkey AS product_id, p_size AS stock, 1 AS warehouse_id,
                  DATE '2001-08-01' AS last_stock_date
           FROM part""",
    ),
    "fx_attempts": (
        (),
        """SELECT user_id % 2 AS arm, event_type = 'purchase' AS success
           FROM events WHERE event_type IN ('purchase', 'error')""",
    ),
    "cohorts": (
        ("fx_orders",),
        """SELECT cohort_month, months_since_cohort, cohort_size, retained_users,
                  {rate} AS retention_rate
           FROM (SELECT cohort_month,
                        CAST((year(m) - year(cohort_month)) * 12 + month(m) - month(cohort_month) AS INTEGER)
                          AS months_since_cohort,
                        COUNT(DISTINCT customer_id) AS retained_users
                 FROM (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS m
                       FROM fx_orders WHERE order_status <> 'Cancelled')
                 JOIN (SELECT customer_id, CAST(date_trunc('month', MIN(order_date)) AS DATE) AS cohort_month
                       FROM fx_orders WHERE order_status <> 'Cancelled' GROUP BY customer_id) USING (customer_id)
                 GROUP BY ALL)
           JOIN (SELECT cohort_month, COUNT(*) AS cohort_size
                 FROM (SELECT customer_id, CAST(date_trunc('month', MIN(order_date)) AS DATE) AS cohort_month
                       FROM fx_orders WHERE order_status <> 'Cancelled' GROUP BY customer_id)
                 GROUP BY cohort_month) USING (cohort_month)""",
    ),
    "stages": (
        ("fx_orders",),
        """SELECT COUNT(DISTINCT order_id) AS placed,
                  COUNT(*) FILTER (order_status <> 'Cancelled') AS paid,
                  COUNT(*) FILTER (order_status IN ('Completed', 'Returned')) AS delivered,
                  COUNT(*) FILTER (order_status = 'Completed') AS kept
           FROM fx_orders""",
    ),
    "requests": (
        ("fx_customers", "fx_sellers"),
        """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY product_id, quantity, day) AS turn
           FROM (SELECT l_orderkey * 10 + l_linenumber + 1000000000000 AS order_id, o_custkey AS customer_id,
                        l_suppkey AS seller_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
                        CAST(l_shipdate AS DATE) AS day
                 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    ),
    # Requests of a product folded one after the other, carrying what is left.
    "sold": (
        ("requests", "fx_inv"),
        """SELECT unnest(fold.taken) AS order_id
           FROM (SELECT list_reduce(
                          list_prepend(
                            {{'size': CAST(ANY_VALUE(stock) AS BIGINT), 'taken': CAST([] AS BIGINT[])}},
                            list({{'size': CAST(quantity AS BIGINT), 'taken': CAST([order_id] AS BIGINT[])}} ORDER BY order_id)),
                          lambda held, ask: CASE WHEN ask.size <= held.size
                            THEN {{'size': held.size - ask.size, 'taken': list_concat(held.taken, ask.taken)}}
                            ELSE held END) AS fold
                 FROM requests JOIN (SELECT product_id, MAX(stock) AS stock FROM fx_inv GROUP BY product_id)
                   USING (product_id)
                 WHERE turn = 1
                 GROUP BY product_id)""",
    ),
    "outcomes": (
        ("requests", "sold"),
        """SELECT r.*, CASE WHEN turn > 1 THEN 'repeated_order_id' WHEN s.order_id IS NULL THEN 'not_enough_stock'
                            ELSE 'accepted' END AS outcome
           FROM requests AS r LEFT JOIN sold AS s ON s.order_id = r.order_id""",
    ),
}


def _ratio(num: str, den: str, digits: int = 2, scale: int = 1) -> str:
    """Half-away-from-zero rounding of ``scale * num / den`` for whole ``num`` and ``den``."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    units = f"((2 * {scale * 10**digits} * abs({n}) + abs({d})) // (2 * nullif(abs({d}), 0)))"
    return f"(sign({n}) * sign({d}) * CAST({units} AS DOUBLE) / CAST({10**digits} AS DOUBLE))"


def _pct(part: str, whole: str) -> str:
    return _ratio(part, whole, 2, 100)


def _cents(money: str) -> str:
    return f"({money}) * 100"


def _views(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in [*_views(_VIEWS[name][0]), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def _sql(views: str, body: str) -> str:
    names = _views(tuple(views.split()))
    if not names:
        return body
    rate = _pct("retained_users", "cohort_size")
    texts = []
    for name in names:
        text = _VIEWS[name][1]
        texts.append(f"{name} AS ({text.format(rate=rate) if '{' in text else text})")
    return "WITH " + ",\n".join(texts) + "\n" + body


def _top_products(where: str = "") -> str:
    return _sql(
        "fx_orders fx_items fx_products",
        f"""SELECT product_id, product_name, CAST(SUM(total_sale) AS DOUBLE) AS total_sales, COUNT(order_id) AS total_orders
            FROM fx_orders JOIN fx_items USING (order_id) JOIN fx_products USING (product_id) {where}
            GROUP BY product_id, product_name
            ORDER BY SUM(total_sale) DESC NULLS FIRST, product_id LIMIT 10""",
    )


def _category_share(items: str) -> str:
    return _sql(
        "fx_orders fx_items fx_products fx_category",
        f"""SELECT p.category_id, category_name, CAST(SUM(total_sale) AS DOUBLE) AS total_sale,
                   {_pct(_cents("SUM(total_sale)"), f"(SELECT {_cents('SUM(total_sale)')} FROM {items})")} AS pct_contribution
            FROM {items} JOIN fx_products AS p USING (product_id)
            LEFT JOIN fx_category AS c ON c.category_id = p.category_id
            GROUP BY p.category_id, category_name
            ORDER BY SUM(total_sale) DESC NULLS FIRST, p.category_id""",
    )


def _clv(where: str = "") -> str:
    return _sql(
        "fx_orders fx_items fx_customers",
        f"""SELECT customer_id, first_name || ' ' || last_name AS full_name, CAST(SUM(total_sale) AS DOUBLE) AS clv,
                   dense_rank() OVER (ORDER BY SUM(total_sale) DESC NULLS FIRST) AS customer_ranking
            FROM fx_items JOIN fx_orders USING (order_id) JOIN fx_customers USING (customer_id) {where}
            GROUP BY customer_id, first_name, last_name""",
    )


_LATE_BUYERS = """SELECT customer_id FROM fx_orders
                  WHERE order_date >= (SELECT MAX(order_date) - INTERVAL 6 MONTH FROM fx_orders)"""


def _ordered_share(buyers: str) -> str:
    return _sql(
        "fx_orders fx_customers",
        f"""SELECT total_customers, never_ordered, {_pct("never_ordered", "total_customers")} AS never_ordered_pct,
                   {_pct("total_customers - never_ordered", "total_customers")} AS ordered_pct
            FROM (SELECT COUNT(*) AS total_customers,
                         COUNT(*) FILTER (customer_id NOT IN ({buyers})) AS never_ordered FROM fx_customers)""",
    )


def _inactive(not_null: str) -> str:
    return _sql(
        "fx_orders fx_items fx_sellers",
        f"""SELECT o.seller_id, MAX(order_date) AS last_sale_date, CAST(MAX(total_sale) AS DOUBLE) AS last_sale_amount
            FROM fx_orders AS o JOIN fx_items USING (order_id)
            JOIN fx_sellers AS s ON s.seller_id = o.seller_id
            WHERE s.seller_id NOT IN (
              SELECT seller_id FROM fx_orders
              WHERE order_date >= (SELECT MAX(order_date) - INTERVAL 6 MONTH FROM fx_orders) {not_null})
            GROUP BY o.seller_id""",
    )


def _top_in_state(extra: str) -> str:
    return _sql(
        "fx_orders fx_items fx_customers",
        f"""SELECT * FROM (
              SELECT state, first_name || ' ' || last_name AS customer, {extra} COUNT(order_id) AS total_orders,
                     CAST(SUM(total_sale) AS DOUBLE) AS total_sale,
                     CAST(dense_rank() OVER (PARTITION BY state ORDER BY COUNT(order_id) DESC) AS INTEGER) AS rnk
              FROM fx_customers JOIN fx_orders USING (customer_id) JOIN fx_items USING (order_id)
              GROUP BY state, {extra} first_name, last_name)
            WHERE rnk <= 5""",
    )


def _pivot(offsets: range) -> str:
    cells = ", ".join(f"MAX(CASE WHEN months_since_cohort = {k} THEN retention_rate END) AS month_{k}" for k in offsets)
    return _sql("cohorts", f"SELECT cohort_month, {cells} FROM cohorts GROUP BY cohort_month")


def _funnel(stages: list[tuple[str, str]], source: str, count: str, extra: list[str] | None = None) -> str:
    rows = []
    for k, (label, column) in enumerate(stages):
        previous = stages[k - 1][1]
        drop = f"{previous} - {column}" if k else "CAST(NULL AS BIGINT)"
        step = _pct(column, previous) if k else "CAST(NULL AS DOUBLE)"
        start = _pct(column, stages[0][1]) if k else "CAST(100 AS DOUBLE)"
        more = f", {extra[k]} AS attempts" if extra else ""
        rows.append(
            f"SELECT '{label}' AS stage, {k + 1} AS stage_order, {column} AS {count}, {drop} AS drop_off, "
            f"{step} AS conversion_from_previous_pct, {start} AS conversion_from_start_pct{more}, "
            f"FALSE AS is_simulated FROM {source}"
        )
    return "\nUNION ALL ".join(rows)


_FULFILMENT = _funnel(
    [("Orders Placed", "placed"), ("Payment Successful", "paid"), ("Delivered", "delivered"), ("Kept (Not Returned)", "kept")],
    "stages",
    "orders",
)

_EVENT_FUNNEL = (
    """WITH clicked AS (
      SELECT v.user_id, v.event_id, MIN(c.ts) AS click_ts
      FROM events AS v LEFT JOIN events AS c
        ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts > v.ts AND c.ts <= v.ts + INTERVAL 12 HOUR
      WHERE v.event_type = 'view' GROUP BY v.user_id, v.event_id),
    bought AS (
      SELECT v.user_id, v.event_id, ANY_VALUE(v.click_ts) AS click_ts, MIN(p.ts) AS buy_ts
      FROM clicked AS v LEFT JOIN events AS p
        ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > v.click_ts
           AND p.ts <= v.click_ts + INTERVAL 12 HOUR
      GROUP BY v.user_id, v.event_id),
    totals AS (
      SELECT COUNT(DISTINCT user_id) AS u0, COUNT(DISTINCT user_id) FILTER (click_ts IS NOT NULL) AS u1,
             COUNT(DISTINCT user_id) FILTER (buy_ts IS NOT NULL) AS u2,
             COUNT(*) AS a0, COUNT(click_ts) AS a1, COUNT(buy_ts) AS a2 FROM bought)
    """
    + _funnel([("View Item", "u0"), ("Add to Cart", "u1"), ("Purchase", "u2")], "totals", "users", ["a0", "a1", "a2"])
)

_COUNTS = """(SELECT COUNT(*) FILTER (arm = 0) AS n_a, COUNT(*) FILTER (arm = 0 AND success) AS x_a,
                     COUNT(*) FILTER (arm = 1) AS n_b, COUNT(*) FILTER (arm = 1 AND success) AS x_b
              FROM fx_attempts)"""
_LIFTS = f"""{_ratio("x_b * n_a - x_a * n_b", "n_a * n_b", 4)} AS absolute_lift,
             {_pct("x_b * n_a - x_a * n_b", "x_a * n_b")} AS relative_lift_pct"""
_Z = """((x_b / n_b - x_a / n_a) / sqrt(((x_a + x_b) / (n_a + n_b)) * (1 - (x_a + x_b) / (n_a + n_b))
        * (1 / n_a + 1 / n_b)))"""

# p = 1 - erf(|z| / sqrt 2), with erf as its power series.
_READOUT = f""", test AS (SELECT *, {_Z} AS z FROM {_COUNTS}),
    terms AS (
      WITH RECURSIVE series(k, x, term) AS (
        SELECT 0, abs(z) / sqrt(2.0::DOUBLE), abs(z) / sqrt(2.0::DOUBLE) FROM test
        UNION ALL SELECT k + 1, x, -term * x * x / (k + 1) FROM series WHERE k < 80)
      SELECT 1 - 2 / sqrt(pi()) * SUM(term / (2 * k + 1) ORDER BY k DESC) AS p FROM series)
    SELECT 'Error rate by user parity' AS test_name, FALSE AS is_simulated, 'checkout attempt' AS experimental_unit,
           'purchase instead of error' AS conversion_metric, 'p_treatment = p_control' AS hypothesis_null,
           'p_treatment != p_control (two-tailed)' AS hypothesis_alt, CAST(0.05 AS DOUBLE) AS alpha, {_LIFTS},
           round(z, 4) AS z_statistic, round(p, 10) AS p_value,
           CASE WHEN p < 0.0001 THEN printf('%.2e', p) ELSE printf('%.4f', p) END AS p_value_display,
           p < 0.05 AS is_significant,
           CASE WHEN p < 0.05 AND z > 0 THEN 'odd users'
                WHEN p < 0.05 AND z < 0 THEN 'even users'
                ELSE 'No statistically significant difference' END AS winner
    FROM test, terms"""

_TABLES = {
    "category": ("fx_category", "category_id"),
    "customers": ("fx_customers", "customer_id"),
    "sellers": ("fx_sellers", "seller_id"),
    "products": ("fx_products", "product_id"),
    "orders": ("fx_orders", "order_id"),
    "order_items": ("fx_items", "order_item_id"),
    "payments": ("fx_payments", "payment_id"),
    "shippings": ("fx_ship", "shipping_id"),
    "inventory": ("fx_inv", "inventory_id"),
}
_REFERENCES = [
    ("products", "category_id", "category"),
    ("orders", "customer_id", "customers"),
    ("orders", "seller_id", "sellers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("payments", "order_id", "orders"),
    ("shippings", "order_id", "orders"),
    ("inventory", "product_id", "products"),
]
_WIDTHS = [
    ("category", "category_name", 20),
    ("customers", "first_name", 20),
    ("customers", "last_name", 20),
    ("customers", "state", 20),
    ("customers", "address", 5),
    ("sellers", "seller_name", 25),
    ("sellers", "origin", 10),
    ("products", "product_name", 60),
    ("orders", "order_status", 15),
    ("payments", "payment_status", 20),
    ("shippings", "shipping_providers", 50),
    ("shippings", "delivery_status", 50),
]
_ALL_VIEWS = " ".join(view for view, _ in _TABLES.values())


def _load_audit() -> str:
    rows = []
    for name, (view, _) in _TABLES.items():
        missing = "COUNT(*) FILTER (total_sale IS NULL)" if name == "order_items" else "CAST(NULL AS BIGINT)"
        rows.append(f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, {missing} AS null_total_sale FROM {view}")
    return _sql(_ALL_VIEWS, "\nUNION ALL ".join(rows))


def _key_audit() -> str:
    rows = [
        f"""SELECT '{name}' AS table_name, '{key}' AS key_column,
                   COUNT(*) FILTER (k IS NOT NULL AND n > 1) AS duplicate_keys,
                   CAST(COALESCE(SUM(n) FILTER (k IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_rows,
                   CAST(COALESCE(SUM(n) FILTER (k IS NULL), 0) AS BIGINT) AS null_rows
            FROM (SELECT {key} AS k, COUNT(*) AS n FROM {view} GROUP BY {key})"""
        for name, (view, key) in _TABLES.items()
    ]
    return _sql(_ALL_VIEWS, "\nUNION ALL ".join(rows))


def _reference_audit() -> str:
    rows = []
    for child, column, parent in _REFERENCES:
        view, (parent_view, key) = _TABLES[child][0], _TABLES[parent]
        rows.append(
            f"""SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table,
                       COUNT(DISTINCT {column}) AS orphan_keys, COUNT(*) AS orphan_rows
                FROM {view} AS c WHERE {column} IS NOT NULL
                  AND NOT EXISTS (SELECT 1 FROM {parent_view} AS p WHERE p.{key} = c.{column})"""
        )
    return _sql(_ALL_VIEWS, "\nUNION ALL ".join(rows))


def _width_audit() -> str:
    rows = [
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {width} AS max_length,
                   COUNT(*) FILTER (length({column}) > {width}) AS too_long, CAST(MAX(length({column})) AS INTEGER) AS widest
            FROM {_TABLES[table][0]}"""
        for table, column, width in _WIDTHS
    ]
    return _sql(_ALL_VIEWS, "\nUNION ALL ".join(rows))


def _hot_product(sql: str) -> str:
    """Half of all requests ask for product 1, which has a large stock."""
    asked = "CASE WHEN order_id % 2 = 0 THEN 1 ELSE product_id END AS product_id"
    held = "CASE WHEN product_id = 1 THEN 400000 ELSE stock END AS stock"
    hot = f"requests AS (SELECT * REPLACE ({asked}) FROM asked),\nfx_inv AS (SELECT * REPLACE ({held}) FROM held),\n"
    sql = sql.replace("requests AS (", "asked AS (", 1).replace("fx_inv AS (", "held AS (", 1)
    return sql.replace("sold AS (", f"{hot}sold AS (", 1)


ORACLE_SQL: dict[str, str] = {
    "top_products": _top_products(),
    "top_products_completed": _top_products("WHERE order_status = 'Completed'"),
    "category_revenue_share": _category_share("fx_items"),
    "category_revenue_share_completed": _category_share(
        "(SELECT i.* FROM fx_items AS i JOIN fx_orders USING (order_id) WHERE order_status = 'Completed')"
    ),
    "customer_aov": _sql(
        "fx_orders fx_items fx_customers",
        f"""SELECT customer_id, first_name || ' ' || last_name AS full_name,
                   {_ratio(_cents("SUM(total_sale)"), "COUNT(order_id) * 100")} AS aov, COUNT(order_id) AS total_orders
            FROM fx_items JOIN fx_orders USING (order_id) JOIN fx_customers USING (customer_id)
            GROUP BY customer_id, first_name, last_name HAVING COUNT(order_id) > 5""",
    ),
    "monthly_sales_trend": _sql(
        "fx_orders fx_items",
        """SELECT year, month, CAST(sale AS DOUBLE) AS current_month_sale,
                  CAST(LAG(sale, 1) OVER (ORDER BY year, month) AS DOUBLE) AS last_month_sale
           FROM (SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
                        SUM(total_sale) AS sale
                 FROM fx_orders JOIN fx_items USING (order_id)
                 WHERE order_date >= (SELECT MAX(order_date) - INTERVAL 1 YEAR FROM fx_orders)
                 GROUP BY ALL)""",
    ),
    "customers_never_ordered": _sql(
        "fx_orders fx_customers",
        "SELECT c.* FROM fx_customers AS c LEFT JOIN fx_orders AS o ON o.customer_id = c.customer_id WHERE o.customer_id IS NULL",
    ),
    "customers_not_ordered_lately": _sql(
        "fx_orders fx_customers",
        f"SELECT * FROM fx_customers WHERE customer_id NOT IN ({_LATE_BUYERS})",
    ),
    "least_category_per_state": _sql(
        "fx_orders fx_items fx_customers fx_products",
        """SELECT * FROM (
             SELECT state, category_name, CAST(SUM(total_sale) AS DOUBLE) AS total_sale,
                    CAST(rank() OVER (PARTITION BY state ORDER BY SUM(total_sale) ASC NULLS LAST) AS INTEGER) AS rnk
             FROM fx_orders JOIN fx_customers USING (customer_id) JOIN fx_items USING (order_id)
             JOIN fx_products USING (product_id) JOIN fx_category USING (category_id)
             GROUP BY state, category_name) WHERE rnk = 1""",
    ),
    "customer_clv_rank": _clv(),
    "customer_clv_rank_completed": _clv("WHERE order_status = 'Completed'"),
    "low_inventory": _sql(
        "fx_inv fx_products",
        """SELECT inventory_id, product_name, stock AS current_stock_left, last_stock_date, warehouse_id
           FROM fx_inv JOIN fx_products USING (product_id) WHERE stock < 10""",
    ),
    "slow_shipping": _sql(
        "fx_ship fx_orders fx_customers",
        """SELECT CAST(shipping_date - order_date AS INTEGER) AS days_to_ship, customer_id, first_name, last_name, order_id, order_date,
                  order_status, shipping_providers
           FROM fx_ship JOIN fx_orders USING (order_id) JOIN fx_customers USING (customer_id)
           WHERE shipping_date - order_date >= 4""",
    ),
    "payment_status_share": _sql(
        "fx_orders fx_payments",
        f"""SELECT payment_status, COUNT(*) AS total_cnt,
                   {_pct("COUNT(*)", "(SELECT COUNT(*) FROM fx_payments)")} AS pct_of_all_payments
            FROM fx_orders JOIN fx_payments USING (order_id) GROUP BY payment_status""",
    ),
    "top_seller_success": _sql(
        "fx_orders fx_items fx_sellers",
        f"""SELECT seller_id, seller_name, CAST(SUM(done) AS BIGINT) AS completed_orders,
                   CAST(SUM(1 - done) AS BIGINT) AS cancelled_orders, COUNT(done) AS total_orders,
                   {_pct("SUM(done)", "COUNT(done)")} AS successful_orders_percentage
            FROM (SELECT seller_id, seller_name,
                         row_number() OVER (ORDER BY SUM(total_sale) DESC NULLS FIRST, seller_id) AS place
                  FROM fx_sellers JOIN fx_orders USING (seller_id) JOIN fx_items USING (order_id)
                  GROUP BY seller_id, seller_name) AS best
            JOIN (SELECT seller_id, CAST(order_status = 'Completed' AS BIGINT) AS done FROM fx_orders
                  WHERE order_status IN ('Completed', 'Cancelled')) AS finished USING (seller_id)
            WHERE place <= 5 GROUP BY seller_id, seller_name""",
    ),
    "product_margin_rank": _sql(
        "fx_items fx_products",
        f"""SELECT *, dense_rank() OVER (ORDER BY profit_margin DESC NULLS FIRST) AS product_ranking
            FROM (SELECT product_id, product_name,
                         {_pct(_cents("SUM(total_sale - cogs * quantity)"), _cents("SUM(total_sale)"))} AS profit_margin
                  FROM fx_products JOIN fx_items USING (product_id) GROUP BY product_id, product_name)""",
    ),
    "top_returned_products": _sql(
        "fx_orders fx_items fx_products",
        f"""SELECT product_id, product_name, COUNT(*) AS total_order_lines,
                   COUNT(*) FILTER (order_status = 'Returned') AS total_returned,
                   {_pct("COUNT(*) FILTER (order_status = 'Returned')", "COUNT(*)")} AS return_rate_pct
            FROM fx_orders JOIN fx_items USING (order_id) JOIN fx_products USING (product_id)
            GROUP BY product_id, product_name ORDER BY return_rate_pct DESC NULLS FIRST, product_id LIMIT 10""",
    ),
    "inactive_sellers": _inactive("AND seller_id IS NOT NULL"),
    "inactive_sellers_not_in": _inactive(""),
    "inactive_sellers_not_in_known": _inactive("AND seller_id IS NOT NULL"),
    "customer_return_class": _sql(
        "fx_orders fx_items fx_customers",
        """SELECT concat_ws(' ', first_name, last_name) AS customer, n AS total_orders, back AS total_return,
                  ['New', 'Returning_customer'][1 + CAST(back >= 6 AS INTEGER)] AS customer_category
           FROM fx_customers
           JOIN (SELECT customer_id, COUNT(*) AS n, count_if(order_status = 'Returned') AS back
                 FROM fx_items JOIN fx_orders USING (order_id) GROUP BY customer_id) AS lines USING (customer_id)""",
    ),
    "top_customers_per_state": _top_in_state(""),
    "top_customers_per_state_by_id": _top_in_state("customer_id,"),
    "provider_performance": _sql(
        "fx_ship fx_orders fx_items",
        f"""SELECT shipping_providers, COUNT(order_id) AS orders_handled, CAST(SUM(total_sale) AS DOUBLE) AS total_sale,
                   COALESCE({_ratio("SUM(return_date - shipping_date)", "COUNT(return_date - shipping_date)", 1)}, 0)
                     AS avg_return_days
            FROM fx_ship JOIN fx_orders USING (order_id) JOIN fx_items USING (order_id)
            GROUP BY shipping_providers""",
    ),
    "yoy_decline": _sql(
        "fx_orders fx_items fx_products",
        f"""SELECT product_id, CAST(a AS DOUBLE) AS revenue_1999, CAST(b AS DOUBLE) AS revenue_2000,
                   CAST(a - b AS DOUBLE) AS revenue_diff, {_pct(_cents("a - b"), _cents("a"))} AS revenue_decline_pct
            FROM (SELECT product_id, SUM(total_sale) FILTER (year(order_date) = 1999) AS a,
                         SUM(total_sale) FILTER (year(order_date) = 2000) AS b
                  FROM fx_products JOIN fx_items USING (product_id) JOIN fx_orders USING (order_id)
                  GROUP BY product_id)
            WHERE b < a ORDER BY revenue_decline_pct DESC NULLS FIRST, product_id LIMIT 10""",
    ),
    "kpi_summary": _sql(
        "fx_customers fx_orders fx_items fx_products fx_sellers",
        f"""SELECT (SELECT COUNT(DISTINCT customer_id) FROM fx_customers) AS total_customers,
                   (SELECT COUNT(DISTINCT customer_id) FROM fx_orders) AS customers_with_orders,
                   (SELECT COUNT(*) FROM fx_orders) AS total_orders,
                   (SELECT CAST(SUM(total_sale) AS DOUBLE) FROM fx_items) AS total_revenue,
                   (SELECT {_ratio(_cents("SUM(total_sale)"), "COUNT(total_sale) * 100")} FROM fx_items) AS avg_order_value,
                   (SELECT MIN(order_date) FROM fx_orders) AS first_order_date,
                   (SELECT MAX(order_date) FROM fx_orders) AS last_order_date,
                   (SELECT COUNT(*) FROM fx_products) AS total_products,
                   (SELECT COUNT(*) FROM fx_sellers) AS total_sellers""",
    ),
    "kpi_summary_sketched": _sql(
        "fx_customers fx_orders",
        """SELECT (SELECT COUNT(DISTINCT customer_id) FROM fx_customers) AS total_customers,
                  COUNT(DISTINCT customer_id) AS customers_with_orders, COUNT(*) AS total_orders,
                  TRUE AS total_customers_near, TRUE AS customers_with_orders_near
           FROM fx_orders""",
    ),
    "quarterly_customers_sketched": _sql(
        "fx_orders",
        """SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS first_month, COUNT(DISTINCT customer_id) AS customers,
                  COUNT(DISTINCT order_id) AS orders, TRUE AS customers_near, TRUE AS orders_near
           FROM fx_orders WHERE order_date IS NOT NULL GROUP BY 1""",
    ),
    "fulfillment_funnel_sketched": _sql(
        "stages", f"SELECT stage, stage_order, orders, TRUE AS near FROM ({_FULFILMENT})"
    ),
    "order_count_distribution": _sql(
        "fx_orders",
        f"""SELECT COUNT(*) AS ordering_customers, MIN(n) AS min_orders, MAX(n) AS max_orders,
                   CAST(median(n) AS DOUBLE) AS median_orders, {_ratio("SUM(n)", "COUNT(*)")} AS mean_orders
            FROM (SELECT customer_id, COUNT(*) AS n FROM fx_orders WHERE customer_id IS NOT NULL GROUP BY customer_id)""",
    ),
    "state_revenue": _sql(
        "fx_orders fx_items fx_customers",
        """SELECT state, COUNT(*) AS customers, COUNT(b.customer_id) AS ordering_customers,
                  CAST(SUM(revenue) AS DOUBLE) AS revenue
           FROM fx_customers AS c
           LEFT JOIN (SELECT customer_id, SUM(total_sale) AS revenue
                      FROM fx_orders LEFT JOIN fx_items USING (order_id) GROUP BY customer_id) AS b
             ON b.customer_id = c.customer_id
           GROUP BY state""",
    ),
    "never_ordered_share": _ordered_share("SELECT customer_id FROM fx_orders WHERE customer_id IS NOT NULL"),
    "not_ordered_lately_share": _ordered_share(_LATE_BUYERS),
    "return_share": _sql(
        "fx_orders",
        f"""SELECT total_orders, returned_orders, {_pct("returned_orders", "total_orders")} AS return_share_pct
            FROM (SELECT COUNT(*) AS total_orders, COUNT(*) FILTER (order_status = 'Returned') AS returned_orders
                  FROM fx_orders)""",
    ),
    "only_cancelled_customers": _sql(
        "fx_orders",
        """SELECT customer_id, COUNT(*) AS total_orders FROM fx_orders
           WHERE customer_id NOT IN (SELECT customer_id FROM fx_orders WHERE order_status <> 'Cancelled')
           GROUP BY customer_id""",
    ),
    "only_cancelled_order_blocks": _sql(
        "fx_orders",
        """SELECT order_id // 2 AS customer_id, COUNT(*) AS total_orders FROM fx_orders
           GROUP BY order_id // 2 HAVING bool_and(order_status = 'Cancelled')""",
    ),
    "cohort_retention": _sql("cohorts", "SELECT * FROM cohorts"),
    "cohort_pivot": _pivot(range(79)),
    "retention_window": _pivot(range(13)),
    "retention_curve": _sql(
        "cohorts",
        f"""SELECT months_since_cohort, retained_users, present_size, eligible_size,
                   {_pct("retained_users", "present_size")} AS rate_present_only,
                   {_pct("retained_users", "eligible_size")} AS rate_eligible
            FROM (SELECT months_since_cohort, CAST(SUM(retained_users) AS BIGINT) AS retained_users,
                         CAST(SUM(cohort_size) AS BIGINT) AS present_size
                  FROM cohorts GROUP BY months_since_cohort) AS r
            JOIN (SELECT k AS months_since_cohort, CAST(SUM(cohort_size) AS BIGINT) AS eligible_size
                  FROM (SELECT DISTINCT cohort_month, cohort_size FROM cohorts)
                  JOIN (SELECT DISTINCT months_since_cohort AS k FROM cohorts)
                    ON cohort_month + to_months(k) <=
                       (SELECT MAX(cohort_month + to_months(months_since_cohort)) FROM cohorts)
                  GROUP BY k) AS e USING (months_since_cohort)""",
    ),
    "fulfillment_funnel": _sql("stages", _FULFILMENT),
    "order_completion_rate": _sql("stages", f"SELECT kept AS kept_orders, {_pct('kept', 'placed')} AS completion_rate_pct FROM stages"),
    "event_funnel": _EVENT_FUNNEL,
    "ab_test_groups": _sql(
        "fx_attempts",
        f"""SELECT CASE arm WHEN 0 THEN 'even users'
                            ELSE 'odd users' END AS "group",
                   CASE arm WHEN 0 THEN 'users with an even number' ELSE 'users with an odd number' END AS group_description,
                   COUNT(*) AS checkout_attempts, COUNT(*) FILTER (success) AS successful_checkouts,
                   {_ratio("COUNT(*) FILTER (success)", "COUNT(*)", 4)} AS conversion_rate
            FROM fx_attempts GROUP BY arm""",
    ),
    "ab_test_z": _sql("fx_attempts", f"SELECT n_a, x_a, n_b, x_b, {_LIFTS}, round({_Z}, 8) AS z FROM {_COUNTS}"),
    "ab_test_readout": _sql("fx_attempts", "").rstrip() + _READOUT,
    "apply_sales_outcomes": _sql("outcomes", "SELECT order_id, product_id, quantity, outcome FROM outcomes"),
    "apply_sales_hot_product": _hot_product(
        _sql("outcomes", "SELECT order_id, product_id, quantity, outcome FROM outcomes")
    ),
    "apply_sales_orders": _sql(
        "outcomes",
        """SELECT order_id, DATE '2001-08-02' AS order_date, customer_id, seller_id, 'Inprogress' AS order_status
           FROM outcomes WHERE outcome = 'accepted'""",
    ),
    "apply_sales_items": _sql(
        "outcomes fx_products",
        """SELECT order_id AS order_item_id, order_id, product_id, quantity, CAST(price AS DOUBLE) AS price_per_unit,
                  CAST(quantity * price AS DOUBLE) AS total_sale
           FROM outcomes JOIN fx_products USING (product_id) WHERE outcome = 'accepted'""",
    ),
    "apply_sales_inventory": _sql(
        "outcomes fx_inv",
        """SELECT inventory_id, i.product_id, CAST(stock - COALESCE(used, 0) AS INTEGER) AS stock, warehouse_id, last_stock_date
           FROM fx_inv AS i
           LEFT JOIN (SELECT product_id, SUM(quantity) AS used FROM outcomes WHERE outcome = 'accepted'
                      GROUP BY product_id) AS u ON u.product_id = i.product_id""",
    ),
    "csv_ingest_customers": _sql("fx_customers", "SELECT * FROM fx_customers"),
    "csv_ingest_orders": _sql("fx_orders", "SELECT * FROM fx_orders"),
    "csv_ingest_order_items": _sql(
        "fx_items",
        """SELECT order_item_id, order_id, product_id, quantity, CAST(total_sale AS DOUBLE) AS price_per_unit,
                  CAST(quantity * total_sale AS DOUBLE) AS total_sale
           FROM fx_items""",
    ),
    "csv_ingest_category": _sql("fx_category", "SELECT * FROM fx_category"),
    "csv_ingest_sellers": _sql("fx_sellers", "SELECT * FROM fx_sellers"),
    "csv_ingest_products": _sql(
        "fx_products",
        """SELECT product_id, product_name, CAST(price AS DOUBLE) AS price, CAST(cogs AS DOUBLE) AS cogs, category_id
           FROM fx_products""",
    ),
    "csv_ingest_inventory": _sql("fx_inv", "SELECT * FROM fx_inv"),
    "csv_ingest_payments": _sql("fx_payments", "SELECT * FROM fx_payments"),
    "csv_ingest_shippings": _sql("fx_ship", "SELECT * FROM fx_ship"),
    "report_round_trip": _sql(
        "stages", f"SELECT * EXCLUDE (is_simulated), FALSE AS is_simulated, 'measured' AS methodology FROM ({_FULFILMENT})"
    ),
    "load_audit": _load_audit(),
    "primary_key_audit": _key_audit(),
    "foreign_key_audit": _reference_audit(),
    "text_width_audit": _width_audit(),
    "duplicate_keys": """SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem
                         GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "status_matrix": _sql(
        "fx_orders fx_payments fx_ship",
        """SELECT order_status, payment_status, delivery_status, COUNT(*) AS orders,
                  COALESCE((order_status, payment_status, COALESCE(delivery_status, 'none')) IN (
                    ('Cancelled', 'Payment Failed', 'none'), ('Inprogress', 'Payment Successed', 'Shipped'),
                    ('Completed', 'Payment Successed', 'Delivered'), ('Returned', 'Refunded', 'Returned')), FALSE) AS is_legal
           FROM fx_orders LEFT JOIN fx_payments USING (order_id) LEFT JOIN fx_ship USING (order_id)
           GROUP BY order_status, payment_status, delivery_status""",
    ),
    "funnel_reconciliation": _sql(
        "stages",
        f"""SELECT stage, drop_off, order_status, n AS status_orders, drop_off = n AS reconciles
            FROM ({_FULFILMENT})
            JOIN (SELECT order_status, COUNT(*) AS n FROM fx_orders GROUP BY order_status)
              ON order_status = CASE stage_order WHEN 2 THEN 'Cancelled' WHEN 3 THEN 'Inprogress' WHEN 4 THEN 'Returned' END""",
    ),
    "cohort_checks": _sql(
        "cohorts",
        """SELECT COUNT(*) AS cohort_rows, COUNT(*) FILTER (months_since_cohort = 0) AS cohorts,
                  CAST(SUM(cohort_size) FILTER (months_since_cohort = 0) AS BIGINT) AS cohort_customers,
                  COUNT(*) FILTER (months_since_cohort = 0 AND retention_rate <> 100) AS start_not_full,
                  COUNT(*) FILTER (months_since_cohort < 0) AS negative_offsets,
                  COUNT(*) FILTER (retained_users > cohort_size) AS retained_over_size
           FROM cohorts""",
    ),
}

# Stored tables change how a report is read, not what it says.
ORACLE_SQL |= {
    f"{name}_stored": ORACLE_SQL[name]
    for name in ("monthly_sales_trend", "yoy_decline", "customer_clv_rank", "top_seller_success")
}
ORACLE_SQL["cohort_retention_bitmaps"] = ORACLE_SQL["cohort_retention"]
ORACLE_SQL["load_with_rejects"] = _sql(
    "fx_orders fx_items",
    """SELECT 'orders' AS table_name, COUNT(*) FILTER (order_id % 97 <> 0) AS row_count, CAST(NULL AS BIGINT) AS null_total_sale,
              COUNT(*) FILTER (order_id % 97 = 0) AS rejected_rows, 'order_date is not date' AS reject_reason,
              COUNT(*) FILTER (order_id % 97 = 0) AS rejects
       FROM fx_orders
       UNION ALL
       SELECT 'order_items', COUNT(*) FILTER (order_item_id % 89 <> 0),
              COUNT(*) FILTER (order_item_id % 89 <> 0 AND quantity * total_sale IS NULL),
              COUNT(*) FILTER (order_item_id % 89 = 0), 'quantity is not int', COUNT(*) FILTER (order_item_id % 89 = 0)
       FROM fx_items""",
)
