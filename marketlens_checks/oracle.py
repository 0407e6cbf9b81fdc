"""The registered queries once more, as SQL over the given tables.

Word lists and question templates are data and come from the library. Everything else is
written out here a second time.
"""

from marketlens.operators.semantic import REGISTRY
from marketlens.plans import evidence, explain, followups, investigate, routing
from marketlens.schema import ORDER_ITEMS
from marketlens.sources import adapter


def _text(value):
    return "'" + value.replace("'", "''") + "'"


def _list(values):
    return "[" + ", ".join(_text(v) for v in values) + "]"


# --- source tables and the order-item table ------------------------------------------------

STAGING = """
st_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    o_orderstatus AS order_status,
    CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate END AS order_purchase_timestamp,
    CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate END AS order_approved_at,
    CASE WHEN o_orderkey % 211 <> 0 AND o_orderstatus <> 'P' THEN o_orderdate END
      AS order_delivered_carrier_date,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST((o_orderkey * 7) % 41 AS INT))
      + to_hours(CAST(o_orderkey % 24 AS INT)) END AS order_delivered_customer_date,
    CASE WHEN o_orderkey % 97 <> 0
      THEN o_orderdate + to_days(CAST((o_orderkey * 3 + 11) % 15 + 12 AS INT)) END
      AS order_estimated_delivery_date
  FROM orders),
st_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
    (CAST(round(l_extendedprice * 100) AS BIGINT) * 100 + CAST(l_quantity AS BIGINT)) * 10
      + l_linenumber AS order_item_id,
    CAST(l_partkey AS VARCHAR) AS product_id,
    CASE WHEN l_suppkey % 33 <> 3 THEN CAST(l_suppkey AS VARCHAR) END AS seller_id,
    l_extendedprice AS price, l_quantity AS freight_value
  FROM lineitem),
st_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id,
    c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer, nation WHERE c_nationkey = n_nationkey AND c_custkey % 41 <> 7),
st_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
    CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category
  FROM part WHERE p_partkey % 37 <> 5),
st_payments AS (
  SELECT order_id, payment_type, installments AS payment_installments,
    CAST(v AS DOUBLE) AS payment_value FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
      ['credit_card', 'voucher', 'boleto', 'debit_card'][o_orderkey % 4 + 1] AS payment_type,
      CAST(o_orderkey % 10 + 1 AS INT) AS installments,
      CASE WHEN o_orderkey % 5 = 0
        THEN CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 2 + 1e-9, 2) AS DECIMAL(18,2))
        ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS v
    FROM orders WHERE o_orderkey % 53 <> 0
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR),
      ['credit_card', 'voucher', 'boleto', 'debit_card'][(o_orderkey + 1) % 4 + 1], 1,
      CAST(o_totalprice AS DECIMAL(18,2))
        - CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 2 + 1e-9, 2) AS DECIMAL(18,2))
    FROM orders WHERE o_orderkey % 53 <> 0 AND o_orderkey % 5 = 0)),
st_reviews AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, (o_orderkey * 13) % 5 + 1 AS review_score
  FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), (o_orderkey * 11) % 4 + 1
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 50 = 0),
paid AS (
  SELECT order_id, CAST(sum(CAST(payment_value AS DECIMAL(18,2))) AS DOUBLE) AS total_payment_value,
    max(payment_installments) AS max_payment_installments, count(*) AS payment_record_count,
    string_agg(DISTINCT payment_type, ', ' ORDER BY payment_type) AS payment_types
  FROM st_payments GROUP BY order_id),
reviewed AS (
  SELECT order_id, avg(review_score) AS average_review_score, count(*) AS review_count
  FROM st_reviews GROUP BY order_id),
categorized AS (
  SELECT product_id, CASE
      WHEN category IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') THEN lower(category) || '_goods'
      WHEN category IS NULL THEN 'unknown' ELSE category END AS product_category
  FROM st_products),
oi AS (
  SELECT o.order_id, i.order_item_id, o.customer_id, c.customer_unique_id, c.customer_city,
    c.customer_state, o.order_status, order_purchase_timestamp AS purchase_timestamp,
    order_approved_at AS approved_timestamp,
    order_delivered_carrier_date AS delivered_carrier_timestamp,
    order_delivered_customer_date AS delivered_customer_timestamp,
    order_estimated_delivery_date AS estimated_delivery_timestamp,
    i.product_id, p.product_category, i.seller_id, i.price AS item_price, i.freight_value,
    i.price + i.freight_value AS item_total_value,
    total_payment_value, max_payment_installments, payment_record_count, payment_types,
    average_review_score, review_count,
    date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS delivery_days,
    date_diff('day', order_purchase_timestamp, order_estimated_delivery_date)
      AS estimated_delivery_days,
    date_diff('day', order_estimated_delivery_date, order_delivered_customer_date)
      AS delivery_delay_days,
    CASE WHEN order_delivered_customer_date IS NULL THEN NULL
      WHEN order_delivered_customer_date > order_estimated_delivery_date THEN TRUE
      ELSE FALSE END AS is_late_delivery,
    year(order_purchase_timestamp) AS purchase_year,
    month(order_purchase_timestamp) AS purchase_month,
    CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS purchase_month_start
  FROM st_items i JOIN st_orders o USING (order_id)
    LEFT JOIN st_customers c ON c.customer_id = o.customer_id
    LEFT JOIN categorized p ON p.product_id = i.product_id
    LEFT JOIN paid ON paid.order_id = o.order_id
    LEFT JOIN reviewed ON reviewed.order_id = o.order_id)"""


def _on(select, *ctes, recursive=False):
    """A query over the staging tables and `oi`, with further common tables before it."""
    start = "WITH RECURSIVE " if recursive else "WITH "
    return start + ",\n".join([STAGING.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()


# A small negative value rounds to -0.0 in DuckDB and to 0.0 in Spark; "+ 0.0" makes both 0.0.

# --- metrics --------------------------------------------------------------------------------

RATE = "round(100.0 * avg(CASE is_late_delivery WHEN TRUE THEN 1 WHEN FALSE THEN 0 END), 2)"

PER_ORDER = """
per_order AS (
  SELECT order_id, sum(item_price) AS revenue, sum(freight_value) AS freight,
    max(delivery_days) AS delivery_days, max(delivery_delay_days) AS delivery_delay_days,
    bool_or(is_late_delivery) AS is_late_delivery, max(average_review_score) AS score,
    max(customer_state) AS customer_state, count(*) AS item_rows
  FROM oi GROUP BY order_id)"""


def _months(minimum):
    return f"""
months AS (
  SELECT purchase_month_start, round(sum(item_price), 2) AS item_revenue,
    count(DISTINCT order_id) AS order_count
  FROM oi WHERE purchase_month_start IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT order_id) >= {minimum})"""


GROWTH = """
grown AS (
  SELECT *, round(100.0 * (item_revenue - before) / nullif(before, 0), 2) + 0.0
      AS month_over_month_growth_percentage
  FROM (SELECT *, lag(item_revenue) OVER (ORDER BY purchase_month_start) AS before FROM months))"""

TREND = (
    "SELECT purchase_month_start, item_revenue, order_count, month_over_month_growth_percentage "
    "FROM grown"
)

COMPONENTS = """
valued AS (
  SELECT *, round(item_revenue / nullif(order_count, 0), 2) AS average_order_value FROM months),
lagged AS (
  SELECT *, lag(item_revenue) OVER w AS previous_item_revenue,
    lag(order_count) OVER w AS previous_order_count,
    lag(average_order_value) OVER w AS previous_average_order_value,
    lag(purchase_month_start) OVER w AS previous_month_start
  FROM valued WINDOW w AS (ORDER BY purchase_month_start)),
components AS (
  SELECT *, round(item_revenue - previous_item_revenue, 2) + 0.0 AS revenue_change_amount,
    round(100.0 * (item_revenue - previous_item_revenue) / nullif(previous_item_revenue, 0), 2) + 0.0
      AS revenue_change_percentage,
    order_count - previous_order_count AS order_count_change,
    round(100.0 * (order_count - previous_order_count) / nullif(previous_order_count, 0), 2) + 0.0
      AS order_count_change_percentage,
    round(average_order_value - previous_average_order_value, 2) + 0.0 AS average_order_value_change,
    round(100.0 * (average_order_value - previous_average_order_value)
      / nullif(previous_average_order_value, 0), 2) + 0.0 AS average_order_value_change_percentage
  FROM lagged)"""


def _segments(dimension, where="TRUE", order="DESC", limit=None):
    return _on(
        f"""
SELECT {dimension}, item_revenue, order_count,
  round(100.0 * item_revenue / nullif(sum(item_revenue) OVER (), 0), 2)
    AS revenue_share_percentage
FROM segments WHERE {where} ORDER BY item_revenue {order}, {dimension}
{f"LIMIT {limit}" if limit else ""}""",
        f"""
segments AS (
  SELECT {dimension}, round(sum(item_price), 2) AS item_revenue,
    count(DISTINCT order_id) AS order_count
  FROM oi WHERE {dimension} IS NOT NULL GROUP BY {dimension})""",
    )


REVIEW_COUNTS = """count(*) AS order_count, count(score) AS reviewed_order_count,
  round(100.0 * count(score) / nullif(count(*), 0), 2) AS review_coverage_percentage"""

SCORES = f"""{REVIEW_COUNTS},
  round(avg(delivery_days), 2) AS average_delivery_days,
  round(median(delivery_days), 2) AS median_delivery_days,
  {RATE} AS late_delivery_rate_percentage,
  round(avg(delivery_delay_days), 2) + 0.0 AS average_delay_days,
  round(avg(CASE WHEN is_late_delivery THEN delivery_delay_days END), 2)
    AS average_late_days_among_late_orders,
  round(avg(score), 2) AS average_review_score"""


def _units(dimension):
    return f"""
units AS (
  SELECT order_id, {dimension}, max(delivery_days) AS delivery_days,
    max(delivery_delay_days) AS delivery_delay_days, bool_or(is_late_delivery) AS is_late_delivery,
    max(average_review_score) AS score
  FROM oi WHERE {dimension} IS NOT NULL GROUP BY order_id, {dimension})"""


def _scorecard(source, dimension, minimum):
    return f"""
SELECT {dimension}, {SCORES} FROM {source} WHERE {dimension} IS NOT NULL
GROUP BY {dimension} HAVING count(*) >= {minimum}
ORDER BY late_delivery_rate_percentage DESC NULLS LAST, order_count DESC, {dimension}"""


BANDS = """
banded AS (
  SELECT *, CASE WHEN delivery_delay_days <= -8 THEN 1 WHEN delivery_delay_days <= -1 THEN 2
      WHEN delivery_delay_days = 0 THEN 3 WHEN delivery_delay_days <= 3 THEN 4
      WHEN delivery_delay_days <= 7 THEN 5 WHEN delivery_delay_days >= 8 THEN 6 END AS band
  FROM per_order),
labelled AS (
  SELECT *, CASE band WHEN 1 THEN 'more_than_7_days_early' WHEN 2 THEN '1_to_7_days_early'
      WHEN 3 THEN 'on_estimated_date' WHEN 4 THEN '1_to_3_days_late'
      WHEN 5 THEN '4_to_7_days_late' WHEN 6 THEN 'more_than_7_days_late' END AS label
  FROM banded)"""


# --- revenue change -------------------------------------------------------------------------


def _change(dimension):
    def month(start, name):
        return f"""
{name} AS (
  SELECT {dimension} AS v, sum(CAST(item_price AS DECIMAL(18,2))) AS r FROM oi
  WHERE purchase_month_start = TIMESTAMP '{start}' AND {dimension} IS NOT NULL GROUP BY 1)"""

    return _on(
        f"""
SELECT v AS {dimension}, CAST(p AS DOUBLE) AS previous_revenue, CAST(c AS DOUBLE)
    AS current_revenue, CAST(c - p AS DOUBLE) AS change_amount,
  round(100.0 * CAST(c - p AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0), 2) + 0.0 AS change_percentage,
  round(100.0 * CAST(c - p AS DOUBLE) / nullif(CAST(sum(c - p) OVER () AS DOUBLE), 0), 2) + 0.0
    AS contribution_to_total_change_percentage
FROM (SELECT coalesce(cur.v, prev.v) AS v, coalesce(prev.r, 0) AS p, coalesce(cur.r, 0) AS c
  FROM prev FULL OUTER JOIN cur ON prev.v = cur.v)""",
        month("2001-06-01", "prev"),
        month("2001-07-01", "cur"),
    )


def _all_changes(dimension, name):
    """A dense grid of comparable months and values, zero where nothing was sold."""
    return f"""
{name}_sold AS (
  SELECT purchase_month_start AS m, {dimension} AS v, sum(CAST(item_price AS DECIMAL(18,2))) AS r
  FROM oi WHERE {dimension} IS NOT NULL GROUP BY 1, 2),
{name}_grid AS (
  SELECT t.purchase_month_start AS target_month, t.previous_month_start AS pm, d.v
  FROM components t, (SELECT DISTINCT v FROM {name}_sold) d
  WHERE t.previous_month_start IS NOT NULL),
{name}_sides AS (
  SELECT target_month, g.v, coalesce(p.r, 0) AS p, coalesce(c.r, 0) AS c,
    coalesce(c.r, 0) - coalesce(p.r, 0) AS ch
  FROM {name}_grid g
    LEFT JOIN {name}_sold p ON p.m = g.pm AND p.v = g.v
    LEFT JOIN {name}_sold c ON c.m = g.target_month AND c.v = g.v
  WHERE p.v IS NOT NULL OR c.v IS NOT NULL),
{name}_changes AS (
  SELECT target_month, v AS dimension_value, CAST(p AS DOUBLE) AS previous_revenue,
    CAST(c AS DOUBLE) AS current_revenue, CAST(ch AS DOUBLE) AS change_amount,
    round(100.0 * CAST(ch AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0), 2) + 0.0 AS change_percentage,
    round(100.0 * CAST(ch AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 2) + 0.0
      AS contribution_to_total_change_percentage,
    row_number() OVER (PARTITION BY target_month
      ORDER BY CASE WHEN total < 0 THEN ch ELSE -ch END, v) AS change_rank,
    '{dimension}' AS dimension
  FROM (SELECT *, sum(ch) OVER (PARTITION BY target_month) AS total FROM {name}_sides))"""


CHANGES = (
    _all_changes("product_category", "cat"),
    _all_changes("customer_state", "sta"),
    """
all_changes AS (SELECT * FROM cat_changes UNION ALL SELECT * FROM sta_changes)""",
)

# --- questions ------------------------------------------------------------------------------

QUESTIONS = f"""
q AS (
  SELECT o_orderkey AS question_id, o_custkey AS conv_id, o_orderkey AS turn,
    replace(replace(replace(
      {_list(adapter.QUESTION_TEMPLATES)}[(o_orderkey * 31 + o_custkey * 17)
        % {len(adapter.QUESTION_TEMPLATES)} + 1],
      '{{ym}}', strftime(o_orderdate, '%Y-%m')), '{{year}}', strftime(o_orderdate, '%Y')),
      '{{name}}', strftime(o_orderdate, '%B')) AS question
  FROM orders)"""


def _normal(c):
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _any(c, words):
    return "(" + " OR ".join(f"contains({c}, {_text(w)})" for w in words) + ")"


def _route_case(c, of):
    arms = " ".join(
        "WHEN " + " AND ".join(_any(c, words) for words in route.needs) + " THEN " + _text(of(route))
        for route in routing.ROUTES
    )
    return f"CASE {arms} ELSE "


def _analysis(c):
    return _route_case(c, lambda r: r.analysis_type) + "'unsupported' END"


def _rule(c):
    return (
        f"CASE WHEN {c} = '' THEN 'empty_question' ELSE "
        + _route_case(c, lambda r: r.rule)
        + "'no supported deterministic route matched' END END"
    )


def _routed(source, text, *keys):
    keys = ", ".join(keys)
    return f"""
routed AS (
  SELECT *, {_analysis("n")} AS analysis_type, {_rule("n")} AS matched_rule
  FROM (SELECT {keys}, {_normal(f"coalesce({text}, '')")} AS n FROM {source}))"""


ROUTED = _routed("q", "question", "question_id", "question")


def _month_key(c):
    """The key of the month a lower-case text names."""
    named = " ".join(
        f"WHEN regexp_matches({c}, '\\b{name}\\b') THEN {i}"
        for i, name in enumerate(investigate.MONTHS, 1)
    )
    number = f"(CASE {named} END)"
    full = f"regexp_extract({c}, '\\b20\\d{{2}}-(0[1-9]|1[0-2])\\b', 0)"
    year = f"regexp_extract({c}, '\\b20\\d{{2}}\\b', 0)"
    return f"""CASE WHEN {full} <> '' THEN 'ym:' || {full}
      WHEN {number} IS NOT NULL AND {year} <> '' THEN 'my:' || {number} || '-' || {year}
      WHEN {number} IS NOT NULL THEN 'm:' || {number} ELSE 'decline' END"""


MONTH_KEYS = """
usable AS (
  SELECT purchase_month_start AS m, revenue_change_percentage AS g FROM components
  WHERE previous_item_revenue IS NOT NULL AND revenue_change_percentage IS NOT NULL),
month_keys AS (
  SELECT 'ym:' || strftime(m, '%Y-%m') AS month_key, m AS target_month FROM usable
  UNION ALL SELECT 'my:' || month(m) || '-' || year(m), m FROM usable
  UNION ALL SELECT 'm:' || month(m), max(m) FROM usable GROUP BY month(m)
  UNION ALL (SELECT 'decline', m FROM usable ORDER BY g, m LIMIT 1))"""

ASKED_MONTHS = f"""
asked AS (
  SELECT r.*, target_month FROM (SELECT *, {_month_key("n")} AS month_key FROM routed) r
  LEFT JOIN month_keys USING (month_key))"""

# --- evidence -------------------------------------------------------------------------------


def _two_places(c):
    return f"CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR)"


def _metric_rows(source, entries, month="NULL"):
    parts = [
        f"SELECT CAST({month} AS VARCHAR) AS month, {_text(k)} AS metric, {v} AS value FROM {source}"
        for k, v in entries.items()
    ]
    return "\nUNION ALL ".join(parts)


def _plain(c):
    return f"CAST({c} AS VARCHAR)"


KPIS = f"""
kpis AS (
  SELECT coalesce(round(sum(revenue), 2), 0) AS item_revenue,
    coalesce(round(sum(freight), 2), 0) AS freight_value, count(order_id) AS order_count,
    coalesce(round(avg(revenue), 2), 0) AS average_order_value,
    coalesce({RATE}, 0) AS late_delivery_rate_percentage,
    coalesce(round(avg(score), 2), 0) AS average_review_score
  FROM per_order)"""


def _leader(dimension, noun):
    return _on(
        _metric_rows(
            "top1",
            {
                f"leading_{noun}": dimension,
                f"leading_{noun}_revenue": _two_places("item_revenue"),
                f"leading_{noun}_order_count": _plain("order_count"),
                f"leading_{noun}_revenue_share_percentage": _two_places("share"),
            },
        ),
        f"""
segments AS (
  SELECT {dimension}, round(sum(item_price), 2) AS item_revenue,
    count(DISTINCT order_id) AS order_count
  FROM oi WHERE {dimension} IS NOT NULL GROUP BY {dimension}),
top1 AS (
  SELECT *, round(100.0 * item_revenue / nullif(sum(item_revenue) OVER (), 0), 2) AS share
  FROM segments ORDER BY item_revenue DESC, {dimension} LIMIT 1)""",
    )


LATE_GROUPS = f"""
late_groups AS (
  SELECT CASE WHEN is_late_delivery THEN 'late' ELSE 'on_time' END AS delivery_status,
    {REVIEW_COUNTS}, round(avg(delivery_days), 2) AS average_delivery_days,
    round(median(delivery_days), 2) AS median_delivery_days,
    round(avg(score), 2) AS average_review_score
  FROM per_order WHERE is_late_delivery IS NOT NULL GROUP BY 1)"""

LATE_PAIR = """
pair AS (
  SELECT l.order_count AS lo, t.order_count AS too, l.average_review_score AS ls,
    t.average_review_score AS ts, l.average_delivery_days AS ld, t.average_delivery_days AS td
  FROM late_groups l, late_groups t
  WHERE l.delivery_status = 'late' AND t.delivery_status = 'on_time')"""

TOP_CHANGES = """
leaders AS (
  SELECT target_month, max(dimension_value) FILTER (dimension = 'product_category') AS category,
    max(change_amount) FILTER (dimension = 'product_category') AS category_amount,
    max(dimension_value) FILTER (dimension = 'customer_state') AS state,
    max(change_amount) FILTER (dimension = 'customer_state') AS state_amount
  FROM all_changes WHERE change_rank = 1 GROUP BY 1)"""

INVESTIGATION_METRICS = {
    "current_month": "month",
    "previous_month": "strftime(previous_month_start, '%Y-%m')",
    "current_revenue": _two_places("item_revenue"),
    "previous_revenue": _two_places("previous_item_revenue"),
    "revenue_change_amount": _two_places("revenue_change_amount"),
    "revenue_change_percentage": _two_places("revenue_change_percentage"),
    "current_order_count": _plain("order_count"),
    "previous_order_count": _plain("previous_order_count"),
    "order_count_change_percentage": _two_places("order_count_change_percentage"),
    "current_average_order_value": _two_places("average_order_value"),
    "previous_average_order_value": _two_places("previous_average_order_value"),
    "average_order_value_change_percentage": _two_places("average_order_value_change_percentage"),
    "larger_relative_component": "CASE WHEN abs(order_count_change_percentage) "
    ">= abs(average_order_value_change_percentage) THEN 'order volume' "
    "ELSE 'average order value' END",
    "largest_category_contributor": "category",
    "largest_category_change_amount": _two_places("category_amount"),
    "largest_state_contributor": "state",
    "largest_state_change_amount": _two_places("state_amount"),
}

SUPPORTING = f"""
{{0}},
support AS (
  SELECT 'core_kpis' AS analysis_type, NULL AS month, 1 AS row, NULL AS label,
    item_revenue AS value FROM kpis
  UNION ALL
  SELECT 'monthly_revenue_trend', NULL, row_number() OVER (ORDER BY purchase_month_start),
    strftime(purchase_month_start, '%Y-%m-%dT%H:%M:%S.000'), item_revenue FROM components
  UNION ALL
  SELECT 'revenue_by_category', NULL, r, v, value FROM (
    SELECT v, value, row_number() OVER (ORDER BY value DESC, v) AS r FROM (
      SELECT product_category AS v, round(sum(item_price), 2) AS value FROM oi
      WHERE product_category IS NOT NULL GROUP BY 1)) WHERE r <= 10
  UNION ALL
  SELECT 'revenue_by_state', NULL, r, v, value FROM (
    SELECT v, value, row_number() OVER (ORDER BY value DESC, v) AS r FROM (
      SELECT customer_state AS v, round(sum(item_price), 2) AS value FROM oi
      WHERE customer_state IS NOT NULL GROUP BY 1)) WHERE r <= 10
  UNION ALL
  SELECT 'delivery_by_state', NULL, r, v, value FROM (
    SELECT v, value, row_number() OVER (ORDER BY value DESC NULLS LAST, n DESC, v) AS r FROM (
      SELECT customer_state AS v, count(*) AS n, {RATE} AS value FROM per_order
      WHERE customer_state IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)) WHERE r <= 10
  UNION ALL
  SELECT 'late_vs_on_time', NULL, row_number() OVER (ORDER BY delivery_status), delivery_status,
    order_count FROM late_groups
  UNION ALL
  SELECT 'revenue_change_investigation', strftime(target_month, '%Y-%m'),
    row_number() OVER (PARTITION BY target_month ORDER BY dimension = 'customer_state', change_rank),
    dimension_value, change_amount FROM all_changes WHERE change_rank <= 5)"""

EVIDENCE = (
    PER_ORDER,
    _months(100),
    COMPONENTS,
    *CHANGES,
    KPIS,
    LATE_GROUPS,
)

# What each analysis lists in its metrics, and its number of warnings.
METRIC_KEYS = {
    routing.CORE_KPIS: [
        "item_revenue",
        "freight_value",
        "order_count",
        "average_order_value",
        "late_delivery_rate_percentage",
        "average_review_score",
    ],
    routing.MONTHLY_TREND: [
        "latest_complete_month",
        "previous_complete_month",
        "latest_item_revenue",
        "previous_item_revenue",
        "month_over_month_growth_percentage",
    ],
    routing.BY_CATEGORY: [
        "leading_category",
        "leading_category_revenue",
        "leading_category_order_count",
        "leading_category_revenue_share_percentage",
    ],
    routing.BY_STATE: [
        "leading_state",
        "leading_state_revenue",
        "leading_state_order_count",
        "leading_state_revenue_share_percentage",
    ],
    routing.DELIVERY_BY_STATE: [
        "highest_late_delivery_state",
        "late_delivery_rate_percentage",
        "order_count",
        "average_delivery_days",
        "median_delivery_days",
        "average_review_score",
    ],
    routing.LATE_VS_ON_TIME: [
        "late_order_count",
        "on_time_order_count",
        "late_average_review_score",
        "on_time_average_review_score",
        "review_score_gap",
        "late_average_delivery_days",
        "on_time_average_delivery_days",
    ],
    routing.INVESTIGATION: list(INVESTIGATION_METRICS),
}
WARNINGS = {
    routing.CORE_KPIS: 2,
    routing.MONTHLY_TREND: 2,
    routing.BY_CATEGORY: 1,
    routing.BY_STATE: 1,
    routing.DELIVERY_BY_STATE: 2,
    routing.LATE_VS_ON_TIME: 2,
    routing.INVESTIGATION: 3,
}
# Analyses whose methodology has an entry called "grain"
WITH_GRAIN = (
    routing.MONTHLY_TREND,
    routing.BY_CATEGORY,
    routing.BY_STATE,
    routing.DELIVERY_BY_STATE,
    routing.LATE_VS_ON_TIME,
)


def _per_analysis(values, otherwise):
    arms = " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in values.items())
    return f"CASE analysis_type {arms} ELSE {otherwise} END"


ANSWERED = f"""
answered AS (
  SELECT a.question_id, a.question, a.analysis_type, a.matched_rule,
    a.analysis_type = 'revenue_change_investigation' AS investigated, a.target_month AS found
  FROM asked a),
answers AS (
  SELECT question_id, question, analysis_type, matched_rule,
    CASE WHEN investigated THEN found END AS target_month,
    investigated AND found IS NULL AS failed,
    analysis_type <> 'unsupported' AND NOT (investigated AND found IS NULL) AS supported
  FROM answered),
support_sizes AS (
  SELECT analysis_type, month, count(*) AS rows FROM support GROUP BY 1, 2),
sized AS (
  SELECT a.*, coalesce(s.rows, 0) AS rows, coalesce(s.rows, 0) >= CASE
      WHEN a.analysis_type IN ('monthly_revenue_trend', 'late_vs_on_time') THEN 2 ELSE 1 END
      AS shown
  FROM answers a LEFT JOIN support_sizes s ON s.analysis_type = a.analysis_type
    AND s.month IS NOT DISTINCT FROM strftime(a.target_month, '%Y-%m'))"""


def _answers_with(select):
    return _on(
        select,
        SUPPORTING.format(",\n".join(c.strip() for c in EVIDENCE)),
        QUESTIONS,
        ROUTED,
        MONTH_KEYS,
        ASKED_MONTHS,
        ANSWERED,
    )


# --- explanations ---------------------------------------------------------------------------

EXPLAINED = f"""
explained AS (
  SELECT o_orderkey AS question_id, o_orderkey % 13 AS row_number, o_orderkey % 5 AS warning_number,
    replace(replace(replace(replace({_text(adapter.EXPLANATION_TEMPLATE)},
      '{{key}}', CAST(o_orderkey AS VARCHAR)),
      '{{price}}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)),
      '{{row}}', CAST(o_orderkey % 13 AS VARCHAR)),
      '{{warning}}', CAST(o_orderkey % 5 AS VARCHAR)) AS explanation
  FROM orders)"""


def _displayed(explained=EXPLAINED):
    """The texts cut into lines, each line shown on its own. Patterns are written out here."""
    title = "(Direct answer|Key evidence|Business interpretation|Limitations)"
    head = rf"'(?i)^[ \t]*(?:#{{1,6}}[ \t]*)?(?:\*\*)?{title}(?:\*\*)?[ \t]*:?[ \t]*'"
    line = r"regexp_replace(l, '(?i)`*[\[【]\s*(?:metric|row|method|warning):[^\]】]+[\]】]`*', '', 'g')"
    line = rf"regexp_replace(regexp_replace({line}, '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g')"
    found = f"regexp_extract({line}, {head}, 1)"
    named = f"upper({found}[1]) || lower({found}[2:])"
    shown = (
        f"CASE WHEN {found} <> '' THEN '**' || {named} || '**' || chr(10) || chr(10) || "
        f"regexp_replace({line}, {head}, '') ELSE {line} END"
    )
    c = f"array_to_string(list_transform(string_split(explanation, chr(10)), lambda l: {shown}), chr(10))"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    # A dollar that has its backslash keeps it; the others get one.
    escaped = rf"replace(replace(replace({c}, '\$', chr(1)), '$', '\$'), chr(1), '\$')"
    return f"WITH {explained.strip()}\nSELECT question_id, {escaped} AS shown FROM explained"


def _citations():
    """The references of the template, in the order they stand there."""
    leading_state = f"(shown AND analysis_type = {_text(routing.BY_STATE)})"
    item_revenue = f"analysis_type = {_text(routing.CORE_KPIS)}"
    grain = f"(shown AND analysis_type IN ({', '.join(_text(t) for t in WITH_GRAIN)}))"
    # An empty trend carries one warning, other empty analyses none.
    warnings = (
        f"CASE WHEN shown THEN {_per_analysis(WARNINGS, 0)} "
        "WHEN analysis_type = 'monthly_revenue_trend' THEN 1 ELSE 0 END"
    )
    return _answers_with(
        f"""
SELECT question_id, analysis_type, c.position, c.kind, c.target, c.is_known FROM (
  SELECT question_id, analysis_type, unnest([
    {{'position': 0, 'kind': 'metric', 'target': 'item_revenue', 'is_known': {item_revenue}}},
    {{'position': 1, 'kind': 'row', 'target': '1', 'is_known': rows >= 1}},
    {{'position': 2, 'kind': 'row', 'target': CAST(question_id % 13 AS VARCHAR),
      'is_known': question_id % 13 BETWEEN 1 AND rows}},
    {{'position': 3, 'kind': 'metric', 'target': 'leading_state', 'is_known': {leading_state}}},
    {{'position': 4, 'kind': 'method', 'target': 'grain', 'is_known': {grain}}},
    {{'position': 5, 'kind': 'warning', 'target': '1', 'is_known': {warnings} >= 1}},
    {{'position': 6, 'kind': 'warning', 'target': CAST(question_id % 5 AS VARCHAR),
      'is_known': question_id % 5 BETWEEN 1 AND {warnings}}},
    {{'position': 7, 'kind': 'metric', 'target': 'no_such_key', 'is_known': FALSE}}]) AS c
  FROM sized WHERE supported)"""
    )


def _unsupported():
    parts = [
        ("Direct answer", evidence.UNSUPPORTED_SUMMARY),
        ("Key evidence", "No supported analysis produced evidence for this question."),
        ("Business interpretation", "The available analyses do not allow a reliable answer."),
        ("Limitations", evidence.UNSUPPORTED_WARNING),
    ]
    text = " || chr(10) || chr(10) || ".join(
        f"{_text(title + ':')} || chr(10) || {_text(body)}" for title, body in parts
    )
    return (
        f"WITH {QUESTIONS.strip()},\n{ROUTED.strip()}\n"
        f"SELECT question_id, FALSE AS supported, {text} AS explanation FROM routed "
        "WHERE analysis_type = 'unsupported'"
    )


# --- follow-ups -----------------------------------------------------------------------------


def _leans(c):
    """Whether a text leans on an earlier question."""
    n = _normal(f"coalesce({c}, '')")
    bare = f"trim({n}, ' ?.!,:;')"
    fragments = ", ".join(_text(t) for t in followups.TOPIC_FRAGMENTS)
    prefixes = " OR ".join(f"starts_with({n}, {_text(p)})" for p in followups.FOLLOW_UP_PREFIXES)
    tokens = f"list_distinct(regexp_extract_all({n}, '[a-z0-9]+'))"
    return (
        f"({bare} <> '' AND ({bare} IN ({fragments}) OR {prefixes} OR "
        f"(list_has_any({tokens}, {_list(followups.PRONOUNS)}) AND len({tokens}) <= 12)))"
    )


def _resolved():
    month = rf"'(?i){followups.MONTH_REFERENCE}'"
    topic = "CASE " + " ".join(
        f"WHEN {_any('lower(question)', words)} THEN {_text(name)}"
        for name, words in followups.TOPICS
    )
    topic += f" WHEN {_any('lower(question)', followups.CAUSE_PHRASES)} THEN 'cause' END"
    in_change = (
        "(last_type = 'revenue_change_investigation' OR (contains(lower(prev), 'revenue') AND "
        + _any("lower(prev)", followups.CHANGE_WORDS)
        + "))"
    )
    rewritten = f"""CASE
      WHEN NOT leans OR last_question IS NULL THEN question
      WHEN topic = 'state' THEN CASE WHEN {in_change} AND ref <> ''
        THEN 'Which states contributed most to the revenue change in ' || ref || '?'
        ELSE 'Which states generate the most revenue?' END
      WHEN topic = 'category' THEN CASE WHEN {in_change} AND ref <> ''
        THEN 'Which product categories contributed most to the revenue change in ' || ref || '?'
        ELSE 'Which product categories generate the most revenue?' END
      WHEN topic = 'order_value' THEN CASE WHEN {in_change} AND ref <> ''
        THEN 'How much did average order value contribute to the revenue change in ' || ref || '?'
        ELSE prev || '. Focus on average order value.' END
      WHEN topic = 'orders' THEN CASE WHEN {in_change} AND ref <> ''
        THEN 'How much did order count contribute to the revenue change in ' || ref || '?'
        ELSE prev || '. Focus on order volume.' END
      WHEN topic = 'delivery' THEN prev || '. Focus on delivery performance.'
      WHEN topic = 'reviews' THEN prev || '. Focus on customer review scores.'
      WHEN ref <> '' THEN CASE WHEN contains(lower(prev), 'revenue')
        THEN 'What drove the revenue change in ' || ref || '?'
        ELSE prev || ' for ' || ref || '?' END
      WHEN topic = 'cause' THEN 'What drove the result described by this question: ' || prev || '?'
      ELSE question END"""
    return _on(
        """
SELECT conv_id, turn, question, resolved_question, analysis_type, answered,
  question <> resolved_question AS was_rewritten
FROM chain WHERE k > 0
UNION ALL SELECT conv_id, turn, trim(question), trim(question), 'unsupported', FALSE, FALSE
FROM q WHERE trim(question) = ''""",
        _months(100),
        COMPONENTS,
        MONTH_KEYS,
        QUESTIONS,
        f"""
turns AS (
  SELECT *, {topic} AS topic, {_leans("question")} AS leans,
    regexp_extract(question, {month}, 0) AS own_month
  FROM (SELECT conv_id, turn, trim(question) AS question,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
    FROM q WHERE trim(question) <> '')),
chain AS (
  SELECT DISTINCT conv_id, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS question,
    CAST(NULL AS VARCHAR) AS resolved_question, CAST(NULL AS VARCHAR) AS analysis_type,
    CAST(NULL AS BOOLEAN) AS answered, CAST(0 AS BIGINT) AS k,
    CAST(NULL AS VARCHAR) AS last_question, CAST(NULL AS VARCHAR) AS last_type
  FROM turns
  UNION ALL
  SELECT conv_id, turn, question, resolved_question, analysis_type, answered, k,
    CASE WHEN answered THEN resolved_question ELSE last_question END,
    CASE WHEN answered THEN analysis_type ELSE last_type END
  FROM (
    SELECT *, analysis_type <> 'unsupported' AND (analysis_type <> 'revenue_change_investigation'
        OR month_key IN (SELECT month_key FROM month_keys)) AS answered
    FROM (
      SELECT *, {_analysis("n")} AS analysis_type, {_month_key("n")} AS month_key
      FROM (
        SELECT *, {_normal("resolved_question")} AS n
        FROM (
          SELECT *, {rewritten} AS resolved_question
          FROM (
            SELECT *, CASE WHEN own_month <> '' THEN own_month
                ELSE coalesce(regexp_extract(prev, {month}, 0), '') END AS ref
            FROM (
              SELECT t.*, c.last_question, c.last_type,
                rtrim(trim(c.last_question), ' ?.!') AS prev
              FROM chain c JOIN turns t ON t.conv_id = c.conv_id AND t.k = c.k + 1)))))))""",
        recursive=True,
    )


# --- whole evidence records -----------------------------------------------------------------

# Literal, so that a wrong word in the library shows: (method entries, warnings) by analysis.
RECORD_TEXTS = {
    "core_kpis": (
        "order_count_calculation=COUNT(DISTINCT order_id)|order_level_metrics=reviews and delivery "
        "are taken once per order|revenue_calculation=SUM(item_price)|table_grain=one row per order item",
        "Item revenue leaves out freight and is not profit.|Without product cost there is no margin.",
    ),
    "monthly_revenue_trend": (
        "grain=calendar month|growth_method=change against the month before, as a share of its revenue|"
        "metric=SUM(item_price)|minimum_order_count_per_month=100",
        "Months with fewer than 100 orders count as incomplete and are left out.|"
        "That minimum suits this data and is no general standard.",
    ),
    "revenue_by_category": (
        "grain=order item|grouping_dimension=product_category|metric=SUM(item_price)|"
        "ranking=item_revenue descending|returned_categories=10",
        "Revenue is not profit; product cost is unknown.",
    ),
    "revenue_by_state": (
        "grain=order item|grouping_dimension=customer_state|metric=SUM(item_price)|"
        "ranking=item_revenue descending|returned_states=10",
        "Where customers live goes along with revenue but does not explain it.",
    ),
    "delivery_by_state": (
        "grain=one row per order|grouping_dimension=customer_state|minimum_order_count=100|"
        "ranking_metric=late_delivery_rate_percentage descending",
        "States with fewer than 100 orders are not ranked.|"
        "Where an order goes is linked to delays but is not shown to cause them.",
    ),
    "late_vs_on_time": (
        "comparison_groups=late, on_time|grain=one row per order|"
        "review_metric=mean score of the orders that have a review",
        "The gap is an association; lateness is not shown to cause it.|"
        "Only orders with a review enter the average scores.",
    ),
    "revenue_change_investigation": (
        "average_order_value_metric=item revenue per order of the month|"
        "category_decomposition=change of item revenue by product category|"
        "comparison_grain=complete calendar month|minimum_order_count_per_month=100|"
        "order_volume_metric=COUNT(DISTINCT order_id)|revenue_metric=SUM(item_price)|"
        "state_decomposition=change of item revenue by customer state",
        "The listed contributors describe the change and do not prove its cause.|"
        "Order count and average order value are linked; their changes do not add up to the revenue "
        "change.|Revenue leaves out freight and is not profit.",
    ),
    "unsupported": (
        "",
        "Supported topics are the core KPIs, monthly revenue and the causes of its changes, revenue "
        "by category or state, delivery by state, and reviews of late and on-time orders.",
    ),
}


# What an analysis without enough data says instead: (summary, method entries, warnings).
EMPTY_TEXTS = {
    "monthly_revenue_trend": (
        "There are too few complete months for a revenue trend.",
        "minimum_order_count_per_month=100",
        "A trend needs at least two complete months.",
    ),
    "revenue_by_category": ("There is no revenue by category to report.", "", ""),
    "revenue_by_state": ("There is no revenue by state to report.", "", ""),
    "delivery_by_state": ("No state has enough orders to be compared.", "", ""),
    "late_vs_on_time": ("The data does not hold both late and on-time orders.", "", ""),
}


def _records():
    """Summary, methods and warnings of every evidence record, in words."""

    def money(c):
        return f"format('{{:,.2f}}', CAST({c} AS DOUBLE))"

    def two(c):
        return f"format('{{:.2f}}', CAST({c} AS DOUBLE))"

    def number(c):
        return f"format('{{:,}}', CAST({c} AS BIGINT))"

    def word(c, up, down, same):
        return f"CASE WHEN {c} > 0 THEN '{up}' WHEN {c} < 0 THEN '{down}' ELSE '{same}' END"

    def month(c):
        return f"strftime({c}, '%Y-%m')"

    change = "revenue_change_percentage"
    orders, value = "order_count_change_percentage", "average_order_value_change_percentage"

    def leader(analysis, dimension):
        return f"""
SELECT '{analysis}', NULL, (SELECT {dimension} || ' had the most item revenue with ' || {money("r")}
  || ', ' || {two("s")} || '% of the total.' FROM (
    SELECT {dimension}, r, round(100.0 * r / sum(r) OVER (), 2) AS s FROM (
      SELECT {dimension}, round(sum(item_price), 2) AS r FROM oi
      WHERE {dimension} IS NOT NULL GROUP BY 1)) ORDER BY r DESC, {dimension} LIMIT 1)"""

    summaries = [
        f"""
SELECT 'core_kpis' AS analysis_type, CAST(NULL AS VARCHAR) AS month, 'Item revenue was '
  || {money("item_revenue")} || ' over ' || {number("order_count")}
  || ' orders; the average order value was ' || {money("average_order_value")} || '.' AS summary
FROM kpis""",
        f"""
SELECT 'monthly_revenue_trend', NULL, (SELECT 'Item revenue ' || {word(change, "increased", "decreased", "remained unchanged")}
  || ' by ' || {two(f"abs({change})")} || '% from ' || {month("previous_month_start")} || ' to '
  || {month("purchase_month_start")} || '; the latest complete month had ' || {money("item_revenue")}
  || ' over ' || {number("order_count")} || ' orders.'
  FROM components ORDER BY purchase_month_start DESC LIMIT 1)""",
        leader("revenue_by_category", "product_category"),
        leader("revenue_by_state", "customer_state"),
        f"""
SELECT 'delivery_by_state', NULL, (SELECT 'Of the states with enough orders, ' || customer_state
  || ' had the most late deliveries: ' || {two("late_delivery_rate_percentage")} || '% of '
  || {number("order_count")} || ' orders.' FROM ({_scorecard("per_order", "customer_state", 100)}) LIMIT 1)""",
        f"""
SELECT 'late_vs_on_time', NULL, (SELECT 'Late orders were reviewed at ' || {two("ls")}
  || ' on average and on-time orders at ' || {two("ts")} || ', a gap of ' || {two("round(ts - ls, 2)")}
  || ' points.' FROM pair)""",
        f"""
SELECT 'revenue_change_investigation', {month("purchase_month_start")}, 'Item revenue '
  || {word("revenue_change_amount", "increased", "decreased", "did not change")} || ' by '
  || {two(f"abs({change})")} || '% from ' || {month("previous_month_start")} || ' to '
  || {month("purchase_month_start")} || ', by ' || {money("revenue_change_amount")}
  || '. Orders changed by ' || {two(orders)} || '% and the average order value by ' || {two(value)}
  || '%; relatively, the ' || CASE WHEN abs({orders}) >= abs({value})
    THEN 'order volume' ELSE 'average order value' END || ' moved more.'
FROM components WHERE previous_month_start IS NOT NULL""",
        "SELECT 'unsupported', NULL, 'This question is not supported by the available analyses.'",
    ]
    texts = ", ".join(
        f"({_text(k)}, {_text(methods)}, {_text(warnings)})"
        for k, (methods, warnings) in RECORD_TEXTS.items()
    )
    empty = ", ".join(f"({', '.join(_text(x) for x in (k, *v))})" for k, v in EMPTY_TEXTS.items())
    return _on(
        "SELECT analysis_type, month, coalesce(summary, no_summary) AS summary, "
        "CASE WHEN summary IS NULL THEN no_methods ELSE methods END AS methods, "
        "CASE WHEN summary IS NULL THEN no_warnings ELSE warnings END AS warnings "
        "FROM told JOIN texts USING (analysis_type) LEFT JOIN empty USING (analysis_type)",
        PER_ORDER,
        KPIS,
        _months(100),
        COMPONENTS,
        LATE_GROUPS,
        LATE_PAIR,
        f"told AS ({_union(summaries)})",
        f"texts(analysis_type, methods, warnings) AS (VALUES {texts})",
        f"empty(analysis_type, no_summary, no_methods, no_warnings) AS (VALUES {empty})",
    )


# --- profile --------------------------------------------------------------------------------

TYPE_NAMES = [(f.name, f.dataType.simpleString()) for f in ORDER_ITEMS.fields]
NUMERIC = [n for n, t in TYPE_NAMES if t in ("bigint", "int", "double")]
TEMPORAL = [n for n, t in TYPE_NAMES if t == "timestamp_ntz"]
CATEGORICAL = [n for n, t in TYPE_NAMES if t in ("string", "boolean")]


def _union(parts):
    return "\nUNION ALL ".join(parts)


def _count_rows():
    return _union(
        [
            f"SELECT {i} AS position, '{n}' AS column_name, '{t}' AS database_type, "
            f"count(*) - count({n}) AS null_count, "
            f"round((count(*) - count({n})) / count(*) * 100, 2) AS null_percentage, "
            f"count(DISTINCT {n}) AS unique_count, "
            f"round(count(DISTINCT {n}) / count(*), 4) AS cardinality_ratio FROM oi"
            for i, (n, t) in enumerate(TYPE_NAMES, 1)
        ]
    )


def _column_counts():
    return _on(_count_rows())


def _profile():
    """All parts of the profile of every column, lists as texts."""
    numbers = _union(
        [
            f"SELECT '{n}' AS column_name, CAST(min({n}) AS DOUBLE) AS least, "
            f"CAST(max({n}) AS DOUBLE) AS most, round(avg({n}), 4) AS mean, "
            f"CAST(median({n}) AS DOUBLE) AS median FROM oi"
            for n in NUMERIC
        ]
    )
    times = _union(
        [
            f"SELECT '{n}' AS column_name, CAST(min({n}) AS VARCHAR) AS first_time, "
            f"CAST(max({n}) AS VARCHAR) AS last_time FROM oi"
            for n in TEMPORAL
        ]
    )
    listed = "SELECT column_name, string_agg({}, '|' ORDER BY rank) AS {} FROM ({}) GROUP BY 1"
    samples = listed.format("value", "samples", _leading([n for n, _ in TYPE_NAMES], "value"))
    common = listed.format(
        "value || '=' || frequency", "common_values", _leading(CATEGORICAL, "frequency DESC, value")
    )
    return _on(
        "SELECT * FROM counts LEFT JOIN numbers USING (column_name) LEFT JOIN times USING "
        "(column_name) LEFT JOIN samples USING (column_name) LEFT JOIN common USING (column_name)",
        f"counts AS ({_count_rows()})",
        f"numbers AS ({numbers})",
        f"times AS ({times})",
        f"samples AS ({samples})",
        f"common AS ({common})",
    )


def _leading(columns, order):
    return _union(
        [
            f"(SELECT '{n}' AS column_name, row_number() OVER (ORDER BY {order}) AS rank, value, "
            f"frequency FROM (SELECT CAST({n} AS VARCHAR) AS value, count(*) AS frequency FROM oi "
            f"WHERE {n} IS NOT NULL GROUP BY 1) ORDER BY {order} LIMIT 5)"
            for n in columns
        ]
    )


def _registry():
    values = ", ".join(
        f"('{n}', '{e['semantic_role']}', '{e['entity']}', '{e['metric_grain']}', "
        f"'{e['default_aggregation']}', {e['is_additive']})"
        for n, e in REGISTRY.items()
    )
    counts = _union(
        [f"SELECT '{n}' AS column_name, count({n}) AS known_values FROM oi" for n, _ in TYPE_NAMES]
    )
    return _on(
        "SELECT column_name, known_values, semantic_role, entity, metric_grain, "
        "default_aggregation, is_additive FROM counts JOIN registry USING (column_name)",
        f"counts AS ({counts})",
        "registry(column_name, semantic_role, entity, metric_grain, default_aggregation, "
        f"is_additive) AS (VALUES {values})",
    )


def _metadata():
    values = ", ".join(
        f"('{n}', {i}, '{REGISTRY[n]['semantic_role']}', '{REGISTRY[n]['metric_grain']}', "
        f"'{','.join(REGISTRY[n]['allowed_aggregations'])}', "
        f"'{REGISTRY[n]['default_aggregation']}', {REGISTRY[n]['is_additive']})"
        for i, (n, _) in enumerate(TYPE_NAMES, 1)
    )
    counts = _union(
        [
            f"SELECT '{n}' AS column_name, count(DISTINCT {n}) AS unique_count FROM oi"
            for n, _ in TYPE_NAMES
        ]
    )
    return _on(
        "SELECT column_name, position, semantic_role, metric_grain, allowed, default_aggregation, "
        "is_additive, 'business_registry' AS inference_source, unique_count "
        "FROM counts JOIN registry USING (column_name)",
        f"counts AS ({counts})",
        "registry(column_name, position, semantic_role, metric_grain, allowed, "
        f"default_aggregation, is_additive) AS (VALUES {values})",
    )


def _fallback():
    columns = {
        "line_id": ("l_orderkey", "identifier", "count_distinct", "count_distinct"),
        "l_quantity": ("l_quantity", "measure", "average", "average,minimum,maximum,median"),
        "l_returnflag": ("l_returnflag", "dimension", "group_by", "group_by,count_distinct"),
        "l_shipdate": ("l_shipdate", "time_dimension", "group_by", "group_by,minimum,maximum"),
        "taxed": ("l_tax > 0.04", "boolean_measure", "percentage_true", "percentage_true,count_true"),
        "label": (
            "concat_ws('-', l_orderkey, l_partkey, l_linenumber)",
            "attribute",
            "none",
            "count_distinct",
        ),
    }
    return _union(
        [
            f"SELECT '{n}' AS column_name, count(DISTINCT ({e})) AS unique_count, "
            f"round(count(DISTINCT ({e})) / count(*), 4) AS cardinality_ratio, "
            f"'{role}' AS semantic_role, '{default}' AS default_aggregation, '{allowed}' AS allowed, "
            "'heuristic' AS inference_source FROM lineitem"
            for n, (e, role, default, allowed) in columns.items()
        ]
    )


# --- validation -----------------------------------------------------------------------------


def _report(source):
    return f"""
report AS (
  SELECT (SELECT count(*) FROM {source}) AS row_count,
    (SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM {source}))
      AS unique_order_item_keys,
    (SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY order_id, order_item_id
      HAVING count(*) > 1)) AS duplicate_order_item_keys,
    count(DISTINCT order_id) AS distinct_orders,
    coalesce(round(sum(item_price), 2), 0) AS item_revenue,
    coalesce(round(sum(freight_value), 2), 0) AS freight_revenue,
    count(*) FILTER (order_id IS NULL) AS null_order_ids,
    count(*) FILTER (order_item_id IS NULL) AS null_order_item_ids,
    count(*) FILTER (product_id IS NULL) AS null_product_ids,
    count(*) FILTER (item_price < 0 OR freight_value < 0 OR item_total_value < 0)
      AS invalid_prices,
    count(*) FILTER (average_review_score < 1 OR average_review_score > 5)
      AS invalid_review_scores,
    count(*) FILTER (delivery_days < 0) AS invalid_delivery_days
  FROM {source}),
judged AS (
  SELECT *, row_count = unique_order_item_keys AND duplicate_order_item_keys = 0
      AND null_order_ids = 0 AND null_order_item_ids = 0 AS grain_is_valid FROM report)"""


SIZES = ("row_count", "unique_order_item_keys", "distinct_orders", "item_revenue", "freight_revenue")
FAULTS = (
    "duplicate_order_item_keys",
    "null_order_ids",
    "null_order_item_ids",
    "null_product_ids",
    "invalid_prices",
    "invalid_review_scores",
    "invalid_delivery_days",
)


def _checks():
    return _on(
        _union(
            [
                f"SELECT '{n}' AS \"check\", CAST({n} AS DOUBLE) AS value, "
                "CAST(NULL AS BOOLEAN) AS passed FROM judged"
                for n in SIZES
            ]
            + [
                f"SELECT '{n}', CAST({n} AS DOUBLE), {n} = 0 FROM judged" for n in FAULTS
            ]
            + ["SELECT 'grain_is_valid', CAST(grain_is_valid AS DOUBLE), grain_is_valid FROM judged"]
        ),
        _report("oi"),
    )


RAW_LINEITEM = """
raw_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
    CASE WHEN l_partkey % 101 <> 0 THEN l_linenumber END AS order_item_id,
    CASE WHEN l_suppkey % 29 <> 0 THEN l_partkey END AS product_id,
    l_extendedprice - 1000 AS item_price, l_quantity AS freight_value,
    l_extendedprice - 1000 + l_quantity AS item_total_value,
    CAST(l_linenumber - 1 AS DOUBLE) AS average_review_score,
    CAST(l_quantity - 3 AS BIGINT) AS delivery_days
  FROM lineitem)"""


def oracle_queries():
    order_items = ", ".join(ORDER_ITEMS.fieldNames())
    trend_metrics = {
        "latest_complete_month": "strftime(purchase_month_start, '%Y-%m')",
        "previous_complete_month": "strftime(previous_month_start, '%Y-%m')",
        "latest_item_revenue": _two_places("item_revenue"),
        "previous_item_revenue": _two_places("previous_item_revenue"),
        "month_over_month_growth_percentage": _two_places("revenue_change_percentage"),
    }
    worst_state = f"""
worst AS (SELECT customer_state AS s, * FROM ({_scorecard("per_order", "customer_state", 100)}) LIMIT 1)"""
    return {
        "SRC2_malformed_rows": """
SELECT source, CAST(sum(good) AS BIGINT) AS good_rows, CAST(sum(few) AS BIGINT) AS too_few_fields,
       CAST(sum(many) AS BIGINT) AS too_many_fields, CAST(0 AS BIGINT) AS without_key
FROM (
    SELECT 'order_items' AS source, CAST(l_orderkey % 13 > 1 AS INT) AS good,
           CAST(l_orderkey % 13 = 0 AS INT) AS few, CAST(l_orderkey % 13 = 1 AS INT) AS many
    FROM lineitem)
GROUP BY source""",
        "SRC1_SRC2_source_row_counts": _on(
            _union(
                [
                    f"SELECT '{name}' AS source, count(*) AS source_rows, 0 AS bad_values "
                    f"FROM {table}"
                    for name, table in (
                        ("orders", "st_orders"),
                        ("order_items", "st_items"),
                        ("customers", "st_customers"),
                        ("products", "st_products"),
                        ("payments", "st_payments"),
                        ("reviews", "st_reviews"),
                        (
                            "category_translation",
                            "(SELECT DISTINCT p_type FROM part "
                            "WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL'))",
                        ),
                    )
                ]
            )
        ),
        "SRC2_staged_orders": _on("SELECT * FROM st_orders"),
        "SRC2_staged_order_items": _on("SELECT * FROM st_items"),
        "SRC2_staged_customers": _on("SELECT * FROM st_customers"),
        "SRC2_staged_products": _on(
            "SELECT product_id, category AS product_category_name FROM st_products"
        ),
        "SRC2_staged_reviews": _on("SELECT * FROM st_reviews"),
        "SRC2_staged_category_translation": "SELECT DISTINCT p_type AS product_category_name, "
        "lower(p_type) || '_goods' AS product_category_name_english FROM part "
        "WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL')",
        "SRC2_staged_payments": _on(
            "SELECT order_id, payment_type, payment_installments, payment_value FROM st_payments"
        ),
        "SRC3_stored_table": _on(f"SELECT {order_items} FROM oi"),
        "SRC6_table_schema": _on(
            "SELECT row_count, column_name, column_type "
            "FROM (SELECT count(*) AS row_count FROM oi), (VALUES "
            + ", ".join(f"('{n}', '{t}')" for n, t in TYPE_NAMES)
            + ") AS t(column_name, column_type)"
        ),
        "SRC6_table_summary": _on("SELECT count(*) AS row_count, 31 AS column_count FROM oi"),
        "SRC7_build_from_files": _on(f"SELECT {order_items} FROM oi"),
        "SC11_delay_bands": _on(
            "SELECT order_id, delivery_delay_days, band, label FROM labelled", PER_ORDER, BANDS
        ),
        "M1_payment_summary": _on("SELECT * FROM paid"),
        "M2_review_summary": _on("SELECT * FROM reviewed"),
        "M3_translated_products": _on("SELECT * FROM categorized"),
        "M4_order_level_reduction": _on(
            "SELECT order_id, delivery_days, delivery_delay_days, is_late_delivery, "
            "score AS average_review_score, customer_state, item_rows FROM per_order",
            PER_ORDER,
        ),
        "M5_analytical_table": _on(f"SELECT {order_items} FROM oi"),
        "M5_split_orders": _on(f"SELECT {order_items} FROM oi"),
        "M5_bucketed_orders": _on(f"SELECT {order_items} FROM oi"),
        "A1_item_revenue": _on(
            "SELECT coalesce(round(sum(item_price), 2), 0) AS item_revenue FROM oi"
        ),
        "A2_freight_value": _on(
            "SELECT coalesce(round(sum(freight_value), 2), 0) AS freight_value FROM oi"
        ),
        "A3_order_count": _on("SELECT count(DISTINCT order_id) AS order_count FROM oi"),
        "A4_average_order_value": _on("SELECT average_order_value FROM kpis", PER_ORDER, KPIS),
        "A5_late_delivery_rate": _on(
            "SELECT late_delivery_rate_percentage FROM kpis", PER_ORDER, KPIS
        ),
        "A6_average_review_score": _on("SELECT average_review_score FROM kpis", PER_ORDER, KPIS),
        "A7_business_kpis": _on("SELECT * FROM kpis", PER_ORDER, KPIS),
        "A7_business_kpis_of_items": _on("SELECT * FROM kpis", PER_ORDER, KPIS),
        "A8_monthly_revenue_trend": _on(TREND, _months(0), GROWTH),
        "A9_revenue_by_category": _segments("product_category"),
        "A10_revenue_by_state": _segments("customer_state"),
        "A11_top_revenue_categories": _segments("product_category", limit=5),
        "A12_bottom_revenue_categories": _segments(
            "product_category", "item_revenue > 0", "ASC", 5
        ),
        "A13_complete_monthly_revenue": _on(TREND, _months(100), GROWTH),
        "A14_largest_monthly_changes": _on(
            TREND + " WHERE month_over_month_growth_percentage IS NOT NULL "
            "ORDER BY abs(month_over_month_growth_percentage) DESC, purchase_month_start LIMIT 5",
            _months(100),
            GROWTH,
        ),
        "A15_delivery_by_state": _on(_scorecard("per_order", "customer_state", 100), PER_ORDER),
        "A15_delivery_by_state_of_items": _on(_scorecard("per_order", "customer_state", 100), PER_ORDER),
        "A16_delivery_by_category": _on(
            _scorecard("units", "product_category", 100), _units("product_category")
        ),
        "A17_worst_delivery_sellers": _on(
            _scorecard("units", "seller_id", 50) + " LIMIT 10", _units("seller_id")
        ),
        "A18_late_vs_on_time": _on("SELECT * FROM late_groups", PER_ORDER, LATE_GROUPS),
        "A19_delivery_review_relationship": _on(
            f"""SELECT label AS delivery_delay_band, {REVIEW_COUNTS},
  round(avg(delivery_delay_days), 2) + 0.0 AS average_delay_days,
  round(median(delivery_delay_days), 2) + 0.0 AS median_delay_days,
  round(avg(score), 2) AS average_review_score
FROM labelled WHERE band IS NOT NULL GROUP BY label, band""",
            PER_ORDER,
            BANDS,
        ),
        "A19_delivery_review_relationship_of_items": _on(
            f"""SELECT label AS delivery_delay_band, {REVIEW_COUNTS},
  round(avg(delivery_delay_days), 2) + 0.0 AS average_delay_days,
  round(median(delivery_delay_days), 2) + 0.0 AS median_delay_days,
  round(avg(score), 2) AS average_review_score
FROM labelled WHERE band IS NOT NULL GROUP BY label, band""",
            PER_ORDER,
            BANDS,
        ),
        "A20_state_overview": _on(
            """
SELECT m.customer_state, m.order_count, m.item_revenue, m.freight_revenue,
  o.average_review_score, o.late_delivery_percentage
FROM money m LEFT JOIN operations o ON m.customer_state = o.customer_state
ORDER BY item_revenue DESC, m.customer_state LIMIT 10""",
            f"""
money AS (
  SELECT customer_state, count(DISTINCT order_id) AS order_count,
    round(sum(item_price), 2) AS item_revenue, round(sum(freight_value), 2) AS freight_revenue
  FROM oi GROUP BY customer_state),
operations AS (
  SELECT customer_state, round(avg(score), 2) AS average_review_score,
    {RATE} AS late_delivery_percentage
  FROM (SELECT order_id, customer_state, max(average_review_score) AS score,
      bool_or(is_late_delivery) AS is_late_delivery FROM oi GROUP BY 1, 2)
  GROUP BY customer_state)""",
        ),
        "A21_monthly_components": _on(
            "SELECT * EXCLUDE (previous_month_start) FROM components", _months(100), COMPONENTS
        ),
        "A22_category_revenue_change": _change("product_category"),
        "A22_state_revenue_change": _change("customer_state"),
        "A22_all_months_changes": _on(
            "SELECT * FROM all_changes", _months(100), COMPONENTS, *CHANGES
        ),
        "A23_investigations": _on(
            """
SELECT a.question_id, a.target_month, c.previous_month_start, c.revenue_change_amount,
  c.order_count_change, c.average_order_value_change,
  CASE d.dimension WHEN 'product_category' THEN 'category_change'
    WHEN 'customer_state' THEN 'state_change' END AS evidence_scope,
  d.change_rank, d.dimension_value, d.change_amount, d.contribution_to_total_change_percentage
FROM asked a LEFT JOIN components c ON c.purchase_month_start = a.target_month
  LEFT JOIN all_changes d ON d.target_month = a.target_month AND d.change_rank <= 5
WHERE a.analysis_type = 'revenue_change_investigation'""",
            _months(100),
            COMPONENTS,
            *CHANGES,
            QUESTIONS,
            ROUTED,
            MONTH_KEYS,
            ASKED_MONTHS,
        ),
        "Q1_Q13_validation_report": _on("SELECT * FROM judged", _report("oi")),
        "Q1_Q13_report_of_write": _on("SELECT * FROM judged", _report("oi")),
        "Q1_Q13_validation_checks": _checks(),
        "Q13_failing_grain": f"WITH {RAW_LINEITEM.strip()},\n{_report('raw_items').strip()}\n"
        "SELECT * FROM judged",
        "P1_column_counts": _column_counts(),
        "P1_merged_month_sketches": _on(
            " UNION ALL ".join(
                f"SELECT '{n}' AS column_name, count({n}) AS known_values, TRUE AS is_near FROM oi"
                for n, _ in TYPE_NAMES
                if n != "purchase_month_start"
            )
        ),
        "P2_numeric_statistics": _on(
            _union(
                [
                    f"SELECT '{n}' AS column_name, CAST(min({n}) AS DOUBLE) AS minimum, "
                    f"CAST(max({n}) AS DOUBLE) AS maximum, round(avg({n}), 4) AS mean, "
                    f"CAST(median({n}) AS DOUBLE) AS median FROM oi"
                    for n in NUMERIC
                ]
            )
        ),
        "P2_dense_numbers": _union(
            [
                f"SELECT '{n}' AS column_name, CAST(min({e}) AS DOUBLE) AS minimum, "
                f"CAST(max({e}) AS DOUBLE) AS maximum, {m} AS median FROM lineitem"
                for n, e, m in (
                    ("far_id", "1000000000000 + l_orderkey", "1000000000000 + median(l_orderkey)"),
                    ("share", "l_tax / 1e6", "median(l_tax / 1e6)"),
                    ("below_zero", "-l_orderkey", "-median(l_orderkey)"),
                    (
                        "exact",
                        "CAST(l_extendedprice AS DECIMAL(18,2))",
                        "median(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE))",
                    ),
                    (
                        "gaps",
                        "CASE WHEN l_orderkey % 7 = 0 THEN CAST('nan' AS DOUBLE) "
                        "WHEN l_orderkey % 11 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity END",
                        "median(CASE WHEN l_orderkey % 7 = 0 THEN CAST('nan' AS DOUBLE) "
                        "WHEN l_orderkey % 11 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity END)",
                    ),
                )
            ]
        ),
        "P3_temporal_statistics": _on(
            _union(
                [
                    f"SELECT '{n}' AS column_name, CAST(min({n}) AS VARCHAR) AS minimum, "
                    f"CAST(max({n}) AS VARCHAR) AS maximum FROM oi"
                    for n in TEMPORAL
                ]
            )
        ),
        "P4_most_common_values": _on(_leading(CATEGORICAL, "frequency DESC, value")),
        "P4_frequent_by_summaries": _on(_leading(CATEGORICAL, "frequency DESC, value")),
        "P5_sample_values": _on(
            "SELECT column_name, rank, value FROM (\n"
            + _leading([n for n, _ in TYPE_NAMES], "value")
            + ")"
        ),
        "P5_smallest_by_summaries": _on(
            "SELECT column_name, rank, value FROM (\n"
            + _leading([n for n, _ in TYPE_NAMES], "value")
            + ")"
        ),
        "P6_table_profile": _profile(),
        "S1_column_registry": _registry(),
        "S2_fallback_semantics": _fallback(),
        "S3_SRC5_semantic_metadata": _metadata(),
        "S4_role_counts": "SELECT semantic_role, count(*) AS columns FROM (VALUES "
        + ", ".join(f"('{REGISTRY[n]['semantic_role']}')" for n, _ in TYPE_NAMES)
        + ") AS t(semantic_role) GROUP BY semantic_role",
        "S3_table_metadata": _on(
            "SELECT 'order_items' AS table_name, count(*) AS row_count, 31 AS column_count, "
            "'One row is one purchased item of an order.' AS table_grain, "
            "'order_id,order_item_id' AS grain_key_columns, 3 AS rules FROM oi"
        ),
        "S4_warnings": "SELECT * FROM (VALUES "
        + ", ".join(
            f"('{n}', 'Repeats on every item row of an order; take one value per order first.')"
            for n in (
                "total_payment_value max_payment_installments payment_record_count "
                "average_review_score review_count delivery_days estimated_delivery_days "
                "delivery_delay_days is_late_delivery"
            ).split()
        )
        + ") AS t(column_name, warning)",
        "S5_fallback_aggregations": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, "
        "round(100.0 * count(*) FILTER (l_tax > 0.04) / count(*), 2) AS taxed, "
        "round(avg(l_quantity), 2) AS quantity, median(l_quantity) AS middle, "
        "max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_returnflag",
        "S5_payment_value_by_state": _on(
            """
SELECT customer_state, round(sum(v), 2) AS value FROM (
  SELECT order_id, customer_state, max(total_payment_value) AS v FROM oi
  WHERE customer_state IS NOT NULL GROUP BY 1, 2) GROUP BY customer_state"""
        ),
        "S5_median_price_by_category": _on(
            "SELECT product_category, round(median(item_price), 2) AS value FROM oi "
            "WHERE product_category IS NOT NULL GROUP BY 1"
        ),
        "S5_late_share_by_week": _on(
            f"""
SELECT purchase_timestamp, {RATE} AS value FROM (
  SELECT order_id, CAST(date_trunc('week', purchase_timestamp) AS DATE) AS purchase_timestamp,
    bool_or(is_late_delivery) AS is_late_delivery
  FROM oi WHERE purchase_timestamp IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
        ),
        "S5_sellers_by_year": _on(
            "SELECT purchase_year, count(DISTINCT seller_id) AS value FROM oi "
            "WHERE purchase_year IS NOT NULL GROUP BY 1"
        ),
        "EV1_normalized_questions": f"WITH {QUESTIONS.strip()}\n"
        f"SELECT question_id, {_normal('question')} AS normalized_question FROM q",
        "EV2_routes": f"WITH {QUESTIONS.strip()},\n{ROUTED.strip()}\n"
        "SELECT question_id, n AS normalized_question, analysis_type, matched_rule FROM routed",
        "EV2_conversation_routes": f"WITH {_routed('conversations', 'text', 'conv_id', 'turn').strip()}\n"
        "SELECT conv_id, turn, analysis_type, matched_rule FROM routed",
        "EV2_document_routes": f"WITH {_routed('documents', 'text', 'doc_id').strip()}\n"
        "SELECT doc_id, analysis_type, matched_rule FROM routed",
        "EV3_core_kpis": _on(
            _metric_rows(
                "kpis",
                {
                    k: _plain(k) if k == "order_count" else _two_places(k)
                    for k in METRIC_KEYS[routing.CORE_KPIS]
                },
            ),
            PER_ORDER,
            KPIS,
        ),
        "EV4_monthly_trend": _on(
            _metric_rows("last", trend_metrics),
            _months(100),
            COMPONENTS,
            """
last AS (SELECT * FROM components WHERE previous_month_start IS NOT NULL
  ORDER BY purchase_month_start DESC LIMIT 1)""",
        ),
        "EV5_category_revenue": _leader("product_category", "category"),
        "EV5_state_revenue": _leader("customer_state", "state"),
        "EV6_state_delivery": _on(
            _metric_rows(
                "worst",
                {
                    "highest_late_delivery_state": "s",
                    **{
                        k: _plain(k) if k == "order_count" else _two_places(k)
                        for k in METRIC_KEYS[routing.DELIVERY_BY_STATE][1:]
                    },
                },
            ),
            PER_ORDER,
            worst_state,
        ),
        "EV7_late_versus_on_time": _on(
            _metric_rows(
                "pair",
                {
                    "late_order_count": _plain("lo"),
                    "on_time_order_count": _plain("too"),
                    "late_average_review_score": _two_places("ls"),
                    "on_time_average_review_score": _two_places("ts"),
                    "review_score_gap": _two_places("ts - ls"),
                    "late_average_delivery_days": _two_places("ld"),
                    "on_time_average_delivery_days": _two_places("td"),
                },
            ),
            PER_ORDER,
            LATE_GROUPS,
            LATE_PAIR,
        ),
        "EV8_target_months": _on(
            "SELECT question_id, month_key, target_month, target_month IS NULL AS failed FROM asked",
            _months(100),
            COMPONENTS,
            QUESTIONS,
            ROUTED,
            MONTH_KEYS,
            ASKED_MONTHS,
        ),
        "EV9_investigation": _on(
            _metric_rows("facts", INVESTIGATION_METRICS, "month"),
            _months(100),
            COMPONENTS,
            *CHANGES,
            TOP_CHANGES,
            """
facts AS (
  SELECT c.*, l.*, strftime(c.purchase_month_start, '%Y-%m') AS month
  FROM components c JOIN leaders l ON l.target_month = c.purchase_month_start
  WHERE c.previous_month_start IS NOT NULL)""",
        ),
        "EV3_EV9_records": _records(),
        "EV10_EX1_unsupported": _unsupported(),
        "EV11_answers": _answers_with(
            f"""
SELECT question_id, analysis_type, supported, target_month, failed, rows,
  CASE WHEN shown THEN {_per_analysis({k: len(v) for k, v in METRIC_KEYS.items()}, 0)}
    ELSE 0 END AS metrics,
  CASE WHEN NOT failed THEN matched_rule END AS router_rule
FROM sized"""
        ),
        "EV12_supporting_rows": _on(
            "SELECT analysis_type, month, row, label, CAST(value AS DOUBLE) AS value FROM support",
            SUPPORTING.format(",\n".join(c.strip() for c in EVIDENCE)),
        ),
        "FU1_needs_context": f"WITH {QUESTIONS.strip()}\n"
        f"SELECT question_id, {_leans('question')} AS leans FROM q",
        "FU1_conversation_turns": f"SELECT conv_id, turn, {_leans('text')} AS leans "
        "FROM conversations",
        "FU2_FU3_resolved_conversations": _resolved(),
        "FU3_streamed_conversations": _resolved(),
        "EX2_prompts": _answers_with(
            f"""
SELECT question_id, TRUE AS starts_with_question, analysis_type, question, rows,
  CASE WHEN shown THEN {_per_analysis(WARNINGS, 0)}
    WHEN analysis_type = 'monthly_revenue_trend' THEN 1 ELSE 0 END AS warnings,
  CASE WHEN shown AND analysis_type = 'revenue_by_state' THEN (
    SELECT customer_state FROM (SELECT customer_state, round(sum(item_price), 2) AS r FROM oi
      WHERE customer_state IS NOT NULL GROUP BY 1) ORDER BY r DESC, customer_state LIMIT 1) END
    AS leading_state
FROM sized WHERE supported"""
        ),
        "EX3_display_markdown": _displayed(),
        "EX4_citations": _citations(),
    }
