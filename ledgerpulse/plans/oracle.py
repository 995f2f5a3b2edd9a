"""The catalogue's queries in plain SQL, written independently of the DataFrame code."""

from __future__ import annotations

CUSTOMERS = """customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, signup_date, n_name AS country,
         CASE WHEN c_acctbal < 4500 THEN 'basic' WHEN c_acctbal < 7800 THEN 'pro' ELSE 'enterprise' END AS plan,
         CAST(CASE WHEN c_acctbal < 4500 THEN 29 WHEN c_acctbal < 7800 THEN 99 ELSE 499 END AS DOUBLE) AS monthly_price,
         c_mktsegment AS segment, r_name AS first_source
  FROM customer
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS signup_date FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey)"""

SUBSCRIPTIONS = """subscriptions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS subscription_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         o_orderdate AS period_start, o_orderdate + INTERVAL 30 DAY AS period_end,
         CAST(o_totalprice AS DECIMAL(18,2)) AS revenue,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS is_renewal,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS churn_flag,
         o_orderstatus <> 'F' AS active,
         coalesce(lines, 0) AS num_logins, usage AS feature_x_usage
  FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS lines,
                    CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(l_discount) * 100 AS usage
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

TRANSACTIONS = """transactions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS transaction_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(l_extendedprice AS DECIMAL(18,2))
           * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS amount,
         l_shipdate AS transaction_date, l_returnflag AS payment_method
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)"""

CLEAN_CUSTOMERS = """clean_customers AS (
  SELECT customer_id, CASE WHEN plan <> 'enterprise' THEN signup_date END AS signup_date,
         CASE WHEN first_source = 'EUROPE' THEN country || chr(10) || 'Europe'
              WHEN first_source <> 'ASIA' THEN country END AS country, plan,
         CASE WHEN plan <> 'basic' THEN monthly_price END AS monthly_price,
         CASE WHEN segment <> 'BUILDING' THEN segment END AS segment, first_source, 'import' AS batch
  FROM customers)"""

CLEAN_SUBSCRIPTIONS = """clean_subscriptions AS (
  SELECT DISTINCT subscription_id, customer_id, period_start, period_end, CAST(revenue AS DOUBLE) AS revenue,
         is_renewal, churn_flag, active, num_logins, feature_x_usage
  FROM subscriptions)"""

CLEAN_TRANSACTIONS = """clean_transactions AS (
  SELECT DISTINCT transaction_id, customer_id,
         CASE WHEN payment_method <> 'R' THEN CAST(amount AS DOUBLE) END AS amount,
         transaction_date, payment_method
  FROM transactions)"""

MRR = """mrr AS (
  SELECT CAST(date_trunc('month', period_start) AS DATE) AS date, CAST(sum(revenue) AS DOUBLE) AS MRR
  FROM subscriptions WHERE active GROUP BY 1)"""

CHURN = """churn AS (
  SELECT CAST(date_trunc('month', period_start) AS DATE) AS date,
         count(DISTINCT customer_id) AS customers_start,
         count(DISTINCT CASE WHEN churn_flag = 1 THEN customer_id END) AS churned,
         count(DISTINCT CASE WHEN churn_flag = 1 THEN customer_id END) / count(DISTINCT customer_id) * 100 AS churn_rate
  FROM subscriptions GROUP BY 1)"""

ARPU = """arpu AS (
  SELECT CAST(date_trunc('month', period_start) AS DATE) AS date,
         CAST(sum(revenue) AS DOUBLE) / count(DISTINCT customer_id) AS ARPU
  FROM subscriptions WHERE active GROUP BY 1)"""

GROWTH = """aged AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS age FROM mrr),
growth AS (
  SELECT round_even((max(MRR) FILTER (age = 1) - max(MRR) FILTER (age = 2)) / max(MRR) FILTER (age = 2) * 100, 2)
           AS mrr_growth_mom,
         round_even((avg(MRR) FILTER (age <= 3) - avg(MRR) FILTER (age BETWEEN 4 AND 6))
           / avg(MRR) FILTER (age BETWEEN 4 AND 6) * 100, 2) AS mrr_growth_qoq
  FROM aged)"""

KPIS = """kpis AS (
  SELECT (SELECT arg_max(MRR, date) FROM mrr) AS current_mrr,
         (SELECT arg_max(MRR, date) FROM mrr) * 12 AS arr,
         (SELECT mrr_growth_mom FROM growth) AS mrr_growth_mom,
         (SELECT count(DISTINCT customer_id) FROM subscriptions WHERE active) AS active_customers,
         (SELECT arg_max(ARPU, date) FROM arpu) AS arpu,
         CASE WHEN (SELECT arg_max(churn_rate, date) FROM churn) > 0
              THEN (SELECT arg_max(ARPU, date) FROM arpu) / ((SELECT arg_max(churn_rate, date) FROM churn) / 100)
              ELSE (SELECT arg_max(ARPU, date) FROM arpu) * 36 END AS clv,
         (SELECT arg_max(churn_rate, date) FROM churn) AS churn_rate,
         100 - (SELECT arg_max(churn_rate, date) FROM churn) AS retention_rate)"""

COHORTS = """joined AS (
  SELECT s.customer_id, s.active, CAST(date_trunc('month', c.signup_date) AS DATE) AS cohort,
         (year(s.period_start) * 12 + month(s.period_start)) - (year(c.signup_date) * 12 + month(c.signup_date))
           AS months_since_signup
  FROM subscriptions s JOIN customers c ON s.customer_id IS NOT DISTINCT FROM c.customer_id),
sizes AS (SELECT cohort, count(DISTINCT customer_id) AS cohort_size FROM joined GROUP BY cohort),
grid AS (
  SELECT cohort, months_since_signup, count(DISTINCT customer_id) AS customer_id,
         CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active
  FROM joined GROUP BY cohort, months_since_signup)"""

FEATURES = """today AS (SELECT max(period_end) AS reference_date FROM subscriptions),
activity AS (
  SELECT customer_id, max(period_end) AS period_end, count(*) AS subscription_count,
         CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue,
         coalesce(stddev_samp(CAST(revenue AS DOUBLE)), 0) AS revenue_std,
         CAST(min(revenue) AS DOUBLE) AS min_revenue, CAST(max(revenue) AS DOUBLE) AS max_revenue,
         CAST(sum(num_logins) AS BIGINT) AS total_logins, avg(num_logins) AS avg_logins,
         max(num_logins) AS max_logins,
         coalesce(avg(feature_x_usage), 0) AS avg_feature_usage,
         coalesce(max(feature_x_usage), 0) AS max_feature_usage,
         arg_max(active, row(period_end, active)) AS active,
         arg_max(churn_flag, row(period_end, churn_flag)) AS churn_flag
  FROM subscriptions GROUP BY customer_id),
features AS (
  SELECT a.*, c.signup_date, c.plan, c.segment, c.monthly_price,
         CAST(floor((epoch(t.reference_date) - epoch(a.period_end)) / 86400) AS BIGINT) AS days_since_last_activity,
         CAST(floor((epoch(t.reference_date) - epoch(c.signup_date)) / 86400) AS BIGINT) AS tenure_days,
         floor((epoch(t.reference_date) - epoch(c.signup_date)) / 86400) / 30.0 AS tenure_months,
         a.churn_flag AS churned
  FROM activity a LEFT JOIN customers c ON a.customer_id = c.customer_id CROSS JOIN today t)"""

RISK = """scored AS (
  SELECT *, days_since_last_activity / (days_since_last_activity + 30.0::DOUBLE) AS churn_probability FROM features),
risk AS (
  SELECT customer_id, churn_probability, monthly_price AS current_revenue, tenure_months, active,
         churn_probability * monthly_price AS risk_score
  FROM scored),
top AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, customer_id) AS place
  FROM risk WHERE churn_probability >= 0.7
  ORDER BY place LIMIT 20)"""

ROUNDED_RISK = """customer_id, round(churn_probability, 6) AS churn_probability, current_revenue,
       round(tenure_months, 6) AS tenure_months, active, round(risk_score, 6) AS risk_score"""


def _model(mode: str = "multiplicative", source: str = "mrr", by: str = "") -> str:
    """Trend, calendar-month effect, spread and the dated forecast of each series in ``source``."""
    keys, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    times, over, neutral = ("*", "/", 1) if mode == "multiplicative" else ("+", "-", 0)
    return f"""points AS (SELECT {lead}date, MRR AS y, year(date) * 12 + month(date) - 1 AS t, month(date) AS m FROM {source}),
line AS (SELECT {lead}regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, max(date) AS last_date,
         count(y) AS months, avg(t) AS centre, sum(t * t) - sum(t) * avg(t) AS extent FROM points {group}),
effects AS (SELECT {lead}m, {neutral} + (avg(y {over} (slope * t + intercept)) - {neutral}) * ((count(y) - 1) / count(y)) AS effect
            FROM points JOIN line {using} GROUP BY {lead}m),
frame AS (
  SELECT {lead}date, y AS actual FROM points
  UNION ALL
  SELECT {lead}CAST(last_date + to_months(CAST(i AS INTEGER)) AS DATE), NULL FROM line, range(1, 4) r(i)),
valued AS (
  SELECT f.*, (slope * (year(f.date) * 12 + month(f.date) - 1) + intercept) {times} coalesce(effect, {neutral}) AS predicted
  FROM frame f JOIN line l {f'ON f.{by} = l.{by}' if by else 'ON true'}
  LEFT JOIN effects e ON e.m = month(f.date) {f'AND e.{by} = f.{by}' if by else ''}),
spreads AS (SELECT {lead}coalesce(stddev_samp(actual - predicted), 0) AS spread FROM valued {group}),
forecast AS (
  SELECT {lead}date, predicted, predicted - margin AS lower_bound, predicted + margin AS upper_bound, actual
  FROM (SELECT *, spread * 1.2816::DOUBLE * sqrt(1 + 1 / months + coalesce((year(date) * 12 + month(date) - 1 - centre) ** 2
                    / nullif(extent, 0), 0)) AS margin
        FROM valued JOIN spreads {using} JOIN (SELECT {lead}months, centre, extent FROM line) {using})),
summary AS (
  SELECT {lead}date, round_even(predicted, 2) AS predicted, round_even(lower_bound, 2) AS lower_bound,
         round_even(upper_bound, 2) AS upper_bound, round_even(actual, 2) AS actual FROM forecast)"""


def _sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{select}" if ctes else select


def _profile(table: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, (SELECT count(*) FROM clean_{table}) AS total_rows, '{c}' AS column_name, "
        f"(SELECT count(*) FROM clean_{table} WHERE {c} IS NULL) AS missing"
        for c in columns
    )
    return rows


PROFILE = "profile AS (SELECT *, round_even(missing / total_rows * 100, 2) AS missing_pct FROM (" + " UNION ALL ".join(
    [
        _profile("customers", "customer_id signup_date country plan monthly_price segment first_source batch".split()),
        _profile(
            "subscriptions",
            "subscription_id customer_id period_start period_end revenue is_renewal churn_flag active num_logins "
            "feature_x_usage".split(),
        ),
        _profile("transactions", "transaction_id customer_id amount transaction_date payment_method".split()),
    ]
) + "))"

CLEANED = (CUSTOMERS, SUBSCRIPTIONS, TRANSACTIONS, CLEAN_CUSTOMERS, CLEAN_SUBSCRIPTIONS, CLEAN_TRANSACTIONS)
REVENUE = (SUBSCRIPTIONS, MRR)
ALL_KPIS = (SUBSCRIPTIONS, MRR, CHURN, ARPU, GROWTH, KPIS)
SCORED = (CUSTOMERS, SUBSCRIPTIONS, FEATURES, RISK)
FORECAST = (SUBSCRIPTIONS, MRR, _model())

SEGMENT_MRR = """segment_mrr AS (
  SELECT c.segment, CAST(date_trunc('month', period_start) AS DATE) AS date, CAST(sum(revenue) AS DOUBLE) AS MRR
  FROM subscriptions s LEFT JOIN customers c ON s.customer_id IS NOT DISTINCT FROM c.customer_id
  WHERE active GROUP BY 1, 2)"""

TXN_SUMMARY = """txn_summary AS (
  SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total_transaction_amount, count(amount) AS transaction_count,
         CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_transaction_amount,
         min(transaction_date) AS first_transaction_date, max(transaction_date) AS last_transaction_date
  FROM transactions WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

LATEST = "SELECT customer_id, " + ", ".join(
    f"arg_max({expression}, row(period_end IS NULL, period_end, subscription_id)) FILTER ({column} IS NOT NULL) AS {column}"
    for column, expression in {
        "subscription_id": "subscription_id",
        "period_start": "period_start",
        "period_end": "period_end",
        "revenue": "CAST(revenue AS DOUBLE)",
        "is_renewal": "is_renewal",
        "churn_flag": "churn_flag",
        "active": "active",
        "num_logins": "num_logins",
        "feature_x_usage": "round(feature_x_usage, 6)",
    }.items()
) + " FROM subscriptions WHERE customer_id IS NOT NULL GROUP BY customer_id"

# Newton's method for the weighted logistic loss with the penalty of one unit of weight on the slope.
NEWTON = """split AS (
  SELECT customer_id, churned, tenure_days,
         row_number() OVER (PARTITION BY churned ORDER BY md5(concat(customer_id, '42')), customer_id)
           <= round(0.2 * count(*) OVER (PARTITION BY churned)) AS is_test
  FROM features),
scale AS (SELECT avg(tenure_days) AS centre, stddev_samp(tenure_days) AS width, count(*) AS n, sum(churned) AS positives
          FROM split WHERE NOT is_test),
train AS (SELECT (tenure_days - centre) / width AS x, churned AS y, n,
                 n / (2.0::DOUBLE * CASE WHEN churned = 1 THEN positives ELSE n - positives END) AS w
          FROM split, scale WHERE NOT is_test),
newton AS (
  SELECT 0 AS step, 0::DOUBLE AS b0, 0::DOUBLE AS b1
  UNION ALL
  SELECT step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT step, b0, b1, sum(w * (p - y)) / n AS g0, (sum(w * (p - y) * x) + b1) / n AS g1,
               sum(w * p * (1 - p)) / n AS h00, sum(w * p * (1 - p) * x) / n AS h01, (sum(w * p * (1 - p) * x * x) + 1) / n AS h11
        FROM (SELECT step, b0, b1, x, y, w, n, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM newton, train WHERE step < 25)
        GROUP BY step, b0, b1, n))"""

ONE_INPUT_SCORES = """SELECT customer_id, round(p, 4) AS churn_probability, monthly_price AS current_revenue,
       round(tenure_months, 6) AS tenure_months, active, round(p * monthly_price, 1) AS risk_score
FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * (tenure_days - centre) / width))) AS p
      FROM features, scale, (SELECT b0, b1 FROM newton ORDER BY step DESC LIMIT 1))"""

DIGEST = """SELECT coalesce(string_agg(printf('Customer %s ($%.0f/mo, %.0f%% risk)', customer_id, current_revenue,
         churn_probability * 100), ', ' ORDER BY place), 'No high-risk customers identified') AS at_risk_summary
FROM top WHERE place <= 5"""

TREND = """CASE WHEN mrr_growth_mom > 5 THEN 'strong growth' WHEN mrr_growth_mom > 0 THEN 'moderate growth'
            WHEN mrr_growth_mom > -5 THEN 'slight decline' ELSE 'concerning decline' END"""

FUTURE = "SELECT * FROM summary WHERE date > (SELECT max(date) FROM mrr)"
EXPECTED = "coalesce((SELECT arg_max(predicted, date) FROM summary WHERE actual IS NULL), (SELECT arg_max(MRR, date) FROM mrr) * 1.05)"

MEASURES = """SELECT round_even(avg(abs(actual - predicted)), 2) AS "MAE", round_even(sqrt(avg((actual - predicted) ** 2)), 2) AS "RMSE",
       round_even(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 2) AS "MAPE"
FROM forecast WHERE actual IS NOT NULL"""

ORACLES: dict[str, str] = {
    "customers_view": _sql("SELECT * FROM customers", CUSTOMERS),
    "subscriptions_view": _sql(
        "SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue, round(feature_x_usage, 6) AS feature_x_usage) FROM subscriptions",
        SUBSCRIPTIONS,
    ),
    "transactions_view": _sql("SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM transactions", TRANSACTIONS),
    "clean_customers": _sql("SELECT * FROM clean_customers", CUSTOMERS, CLEAN_CUSTOMERS),
    "clean_subscriptions": _sql(
        "SELECT * REPLACE (round(feature_x_usage, 6) AS feature_x_usage) FROM clean_subscriptions",
        SUBSCRIPTIONS, CLEAN_SUBSCRIPTIONS,
    ),
    "clean_transactions": _sql("SELECT * FROM clean_transactions", TRANSACTIONS, CLEAN_TRANSACTIONS),
    "date_votes": _sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS column_name, count(*) FILTER ({known}) AS cells, 0 AS iso,
       count(*) FILTER ({known} AND {by_day} AND d > 12) AS only_day_first,
       count(*) FILTER ({known} AND {by_month} AND d > 12) AS only_month_first,
       count(*) FILTER ({known} AND ({by_day} OR {by_month}) AND d <= 12) AS either,
       count(*) FILTER ({known} AND NOT ({by_day} OR {by_month})) AS other_formats, 0 AS unread,
       CASE WHEN count(*) FILTER ({known} AND {by_day} AND d > 12) = 0 THEN 'month_first'
            WHEN count(*) FILTER ({known} AND {by_month} AND d > 12) = 0 THEN 'day_first' ELSE 'unsure' END AS date_order
FROM (SELECT day(transaction_date) AS d, payment_method FROM transactions)"""
            for name, known, by_day, by_month in (
                ("day_first", "true", "true", "false"),
                ("month_first", "payment_method <> 'N'", "false", "true"),
                ("both", "true", "payment_method <> 'A'", "payment_method = 'A'"),
                ("named", "true", "false", "false"),
            )
        ),
        TRANSACTIONS,
    ),
    "voted_dates": _sql(
        """SELECT DISTINCT transaction_id, t AS day_first, CASE WHEN payment_method <> 'N' THEN t END AS month_first,
       CASE WHEN day(t) > 12 OR day(t) = month(t) THEN t END AS both, t AS named
FROM (SELECT *, CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) AS t FROM transactions)""",
        TRANSACTIONS,
    ),
    "removed_duplicates": "SELECT 2 * count(*) AS rows_before, count(*) AS rows_after, count(*) AS duplicates_removed FROM customer",
    "csv_load_and_merge": _sql(
        """SELECT plan, count(*) AS periods, round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue,
       count(*) FILTER (segment IS NULL) AS without_segment, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
       min(period_start) AS first_period
FROM clean_subscriptions s
LEFT JOIN clean_customers c ON s.customer_id IS NOT DISTINCT FROM c.customer_id
LEFT JOIN (SELECT customer_id, count(amount) AS transaction_count FROM clean_transactions GROUP BY customer_id) t
  ON t.customer_id = s.customer_id
GROUP BY plan""",
        *CLEANED,
    ),
    "quality_report": _sql("SELECT * FROM profile WHERE missing > 0", *CLEANED, PROFILE),
    "quality_scores": _sql(
        """SELECT table_name, max(total_rows) AS total_rows, count(*) AS total_columns,
       coalesce(round_even(100 - avg(missing_pct) FILTER (missing > 0), 1), 100.0) AS quality_score
FROM profile GROUP BY table_name""",
        *CLEANED, PROFILE,
    ),
    "dataset_summary": _sql(
        """SELECT (SELECT count(*) FROM customers) AS customers_count, (SELECT count(*) FROM subscriptions) AS subscriptions_count,
       (SELECT count(*) FROM transactions) AS transactions_count, (SELECT min(signup_date) FROM customers) AS first_signup,
       (SELECT max(signup_date) FROM customers) AS last_signup,
       (SELECT count(*) FROM subscriptions WHERE active) AS active_subscriptions,
       (SELECT CAST(sum(churn_flag) AS BIGINT) FROM subscriptions) AS churned_subscriptions,
       (SELECT CAST(sum(revenue) AS DOUBLE) FROM subscriptions) AS total_revenue""",
        CUSTOMERS, SUBSCRIPTIONS, TRANSACTIONS,
    ),
    "stored_dataset_summary": _sql(
        """SELECT (SELECT count(*) FROM clean_customers) AS customers_count, (SELECT count(*) FROM clean_subscriptions) AS subscriptions_count,
       (SELECT count(*) FROM clean_transactions) AS transactions_count, (SELECT min(signup_date) FROM clean_customers) AS first_signup,
       (SELECT max(signup_date) FROM clean_customers) AS last_signup,
       (SELECT count(*) FROM clean_subscriptions WHERE active) AS active_subscriptions,
       (SELECT CAST(sum(churn_flag) AS BIGINT) FROM clean_subscriptions) AS churned_subscriptions,
       (SELECT round(sum(CAST(revenue AS DECIMAL(18,2)))::DOUBLE, 2) FROM clean_subscriptions) AS total_revenue, """
        + ", ".join(
            f"""(SELECT coalesce(round_even(100 - avg(missing_pct) FILTER (missing > 0), 1), 100.0) FROM profile
        WHERE table_name = '{t}') AS {t}_quality"""
            for t in ("customers", "subscriptions", "transactions")
        ),
        *CLEANED, PROFILE,
    ),
    "directory_summary": _sql(
        """SELECT (SELECT count(*) FROM clean_customers) AS customers_count, (SELECT count(*) FROM clean_subscriptions) AS subscriptions_count,
       (SELECT count(*) FROM clean_transactions) AS transactions_count, (SELECT min(signup_date) FROM clean_customers) AS first_signup,
       (SELECT CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) FROM clean_subscriptions) AS total_revenue""",
        *CLEANED,
    ),
    "file_formats": _sql(
        """SELECT format, count(*) AS row_count, count(DISTINCT customer_id) AS ids,
       CAST(sum(CAST(monthly_price AS DECIMAL(18,2))) AS DOUBLE) AS prices
FROM customers, (VALUES ('csv'), ('parquet'), ('json'), ('orc')) f(format) GROUP BY format""",
        CUSTOMERS,
    ),
    "bad_csv_rows": _sql(
        "SELECT 'customers' AS table_name, count(*) AS total_rows, count(*) FILTER (plan = 'pro') AS bad_rows FROM customers", CUSTOMERS
    ),
    "schema_validation": _sql(
        """SELECT 'customers' AS table_name, true AS valid, '' AS missing_columns, 'batch' AS extra_columns, 2 * count(*) AS total_rows FROM customers
UNION ALL SELECT 'subscriptions', false, 'active', '', count(*) FROM subscriptions
UNION ALL SELECT 'transactions', true, '', '', count(*) FROM transactions""",
        CUSTOMERS, SUBSCRIPTIONS, TRANSACTIONS,
    ),
    "plan_counts": _sql("SELECT plan, count(*) AS row_count FROM customers GROUP BY plan", CUSTOMERS),
    "quality_gate": _sql(
        """SELECT 'missing:' || c AS check_name, round(m / n, 6) AS measured, m / n <= 0.2 AS passed
FROM (SELECT unnest(['customer_id', 'revenue', 'period_start']) AS c,
             unnest([count(*) - count(customer_id), count(*) - count(revenue), count(*) - count(period_start)]) AS m,
             count(*) AS n FROM clean_subscriptions)
UNION ALL
SELECT 'date_range', CAST(count(*) FILTER (period_end < period_start) AS DOUBLE), count(*) FILTER (period_end < period_start) = 0
FROM clean_subscriptions
UNION ALL
SELECT 'duplicates', CAST(count(subscription_id) - count(DISTINCT subscription_id) AS DOUBLE),
       count(subscription_id) = count(DISTINCT subscription_id) FROM clean_subscriptions""",
        SUBSCRIPTIONS, CLEAN_SUBSCRIPTIONS,
    ),
    "transactions_per_customer": _sql(
        "SELECT * FROM txn_summary",
        TRANSACTIONS, TXN_SUMMARY,
    ),
    "merged_table": _sql(
        """SELECT s.* REPLACE (CAST(revenue AS DOUBLE) AS revenue, round(feature_x_usage, 6) AS feature_x_usage),
       c.* EXCLUDE (customer_id),
       t.* EXCLUDE (customer_id)
FROM subscriptions s
LEFT JOIN customers c ON s.customer_id IS NOT DISTINCT FROM c.customer_id
LEFT JOIN txn_summary t ON t.customer_id = s.customer_id""",
        CUSTOMERS, SUBSCRIPTIONS, TRANSACTIONS, TXN_SUMMARY,
    ),
    "preview_rows": _sql(
        """SELECT subscription_id, customer_id, period_start, period_end, CAST(revenue AS DOUBLE) AS revenue, churn_flag, active
FROM subscriptions ORDER BY period_start, subscription_id LIMIT 100""",
        SUBSCRIPTIONS,
    ),
    "mrr_by_month": _sql("SELECT * FROM mrr", *REVENUE),
    "mrr_by_month_and_segment": _sql("SELECT * FROM segment_mrr", CUSTOMERS, SUBSCRIPTIONS, SEGMENT_MRR),
    "current_mrr_and_arr": _sql("SELECT arg_max(MRR, date) AS current_mrr, arg_max(MRR, date) * 12 AS arr FROM mrr", *REVENUE),
    "churn_by_month": _sql(
        """SELECT strftime(date, '%Y-%m') AS period, date, customers_start, churned, round(churn_rate, 6) AS churn_rate
FROM churn""",
        SUBSCRIPTIONS, CHURN,
    ),
    "churn_by_quarter": _sql(
        """SELECT year(date) || 'Q' || quarter(date) AS period, date, customers_start, churned,
       round(churned / customers_start * 100, 6) AS churn_rate
FROM (SELECT CAST(date_trunc('quarter', period_start) AS DATE) AS date, count(DISTINCT customer_id) AS customers_start,
             count(DISTINCT CASE WHEN churn_flag = 1 THEN customer_id END) AS churned
      FROM subscriptions GROUP BY 1)""",
        SUBSCRIPTIONS,
    ),
    "current_churn": _sql(
        """SELECT round(arg_max(churn_rate, date), 6) AS churn_rate, round(100 - arg_max(churn_rate, date), 6) AS retention_rate
FROM churn""",
        SUBSCRIPTIONS, CHURN,
    ),
    "retention_by_month": _sql(
        "SELECT date, round(100 - churn_rate, 6) AS retention_rate, round(churn_rate, 6) AS churn_rate FROM churn",
        SUBSCRIPTIONS, CHURN,
    ),
    "arpu_by_month": _sql("SELECT date, round(ARPU, 6) AS ARPU FROM arpu", SUBSCRIPTIONS, ARPU),
    "current_arpu": _sql("SELECT round(arg_max(ARPU, date), 6) AS arpu FROM arpu", SUBSCRIPTIONS, ARPU),
    "clv_simple": _sql("SELECT round(clv, 6) AS clv FROM kpis", *ALL_KPIS),
    "clv_cohort": _sql(
        """SELECT round(CAST(sum(r) AS DOUBLE) / count(*), 6) AS clv
FROM (SELECT customer_id, sum(revenue) AS r FROM subscriptions GROUP BY customer_id)""",
        SUBSCRIPTIONS,
    ),
    "active_customers": _sql("SELECT count(DISTINCT customer_id) AS active_customers FROM subscriptions WHERE active", SUBSCRIPTIONS),
    "growth_mom_qoq": _sql("SELECT * FROM growth", SUBSCRIPTIONS, MRR, GROWTH),
    "dashboard_kpis": _sql(
        """SELECT * REPLACE (round(arpu, 6) AS arpu, round(clv, 6) AS clv, round(churn_rate, 6) AS churn_rate,
                  round(retention_rate, 6) AS retention_rate) FROM kpis""",
        *ALL_KPIS,
    ),
    "dashboard_kpis_by_segment": _sql(
        """SELECT segment, current_mrr, current_mrr * 12 AS arr,
       round_even((current_mrr - previous) / previous * 100, 2) AS mrr_growth_mom, active_customers, round(arpu, 6) AS arpu,
       round(CASE WHEN churn_rate > 0 THEN arpu / (churn_rate / 100) ELSE arpu * 36 END, 6) AS clv,
       round(churn_rate, 6) AS churn_rate, round(100 - churn_rate, 6) AS retention_rate
FROM (SELECT segment, arg_max(MRR, date) AS current_mrr, arg_max(before, date) AS previous, arg_max(arpu, date) AS arpu
      FROM (SELECT segment, date, MRR, MRR / customers AS arpu, lag(MRR) OVER (PARTITION BY segment ORDER BY date) AS before
            FROM (SELECT segment, CAST(date_trunc('month', period_start) AS DATE) AS date,
                         CAST(sum(revenue) AS DOUBLE) AS MRR, count(DISTINCT customer_id) AS customers
                  FROM owned WHERE active GROUP BY 1, 2)) GROUP BY segment)
JOIN (SELECT segment, arg_max(rate, date) AS churn_rate
      FROM (SELECT segment, CAST(date_trunc('month', period_start) AS DATE) AS date,
                   count(DISTINCT CASE WHEN churn_flag = 1 THEN customer_id END) / count(DISTINCT customer_id) * 100 AS rate
            FROM owned GROUP BY 1, 2) GROUP BY segment) USING (segment)
JOIN (SELECT segment, count(DISTINCT customer_id) AS active_customers FROM owned WHERE active GROUP BY segment) USING (segment)""",
        CUSTOMERS, SUBSCRIPTIONS,
        "owned AS (SELECT s.*, c.segment FROM subscriptions s LEFT JOIN customers c ON s.customer_id = c.customer_id)",
    ),
    "dashboard_series": _sql(
        """SELECT 'mrr_series' AS series, date, round(MRR, 6) AS value FROM mrr
UNION ALL SELECT 'churn_series', date, round(churn_rate, 6) FROM churn
UNION ALL SELECT 'arpu_series', date, round(ARPU, 6) FROM arpu""",
        SUBSCRIPTIONS, MRR, CHURN, ARPU,
    ),
    "cohort_grid": _sql(
        """SELECT grid.*, cohort_size, round(active / cohort_size * 100, 6) AS retention_rate
FROM grid JOIN sizes USING (cohort)""",
        CUSTOMERS, SUBSCRIPTIONS, COHORTS,
    ),
    "cohort_sizes": _sql("SELECT * FROM sizes", CUSTOMERS, SUBSCRIPTIONS, COHORTS),
    "reference_date": _sql("SELECT max(period_end) AS reference_date FROM subscriptions", SUBSCRIPTIONS),
    "latest_record": _sql(LATEST, SUBSCRIPTIONS),
    "customer_features": _sql(
        "SELECT * REPLACE ("
        + ", ".join(
            f"round({c}, {d}) AS {c}"
            for c, d in (("avg_logins", 6), ("tenure_months", 6), ("avg_feature_usage", 6), ("max_feature_usage", 6),
                         ("revenue_std", 4))
        )
        + "), round(total_revenue / CASE WHEN tenure_months < 1 THEN 1 ELSE tenure_months END, 6) AS revenue_per_month, "
        + ", ".join(f"CAST(plan = '{p}' AS INTEGER) AS plan_{p}" for p in ("basic", "enterprise", "pro"))
        + ", "
        + ", ".join(
            f"CAST(segment = '{s}' AS INTEGER) AS \"segment_{s}\""
            for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
        )
        + " FROM features",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "features_of_repeated_listings": _sql(
        """SELECT customer_id, CASE WHEN plan = 'pro' THEN 'pro' ELSE 'moved' END AS plan, segment,
       CAST(1 AS DOUBLE) AS monthly_price, signup_date + INTERVAL 5 DAY AS signup_date, subscription_count * 2 AS subscription_count,
       total_revenue * 2 AS total_revenue, tenure_days - 5 AS tenure_days FROM features""",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "stored_churn_model": _sql("SELECT customer_id, CAST(0 AS DOUBLE) AS difference FROM features", CUSTOMERS, SUBSCRIPTIONS, FEATURES),
    "churn_forest_features": _sql(
        """SELECT feature, true AS is_share, CAST(1 AS DOUBLE) AS total FROM (
  SELECT unnest(['days_since_last_activity', 'tenure_days', 'tenure_months', 'subscription_count', 'total_revenue', 'avg_revenue',
                 'revenue_std', 'min_revenue', 'max_revenue', 'revenue_per_month', 'monthly_price', 'total_logins', 'avg_logins',
                 'max_logins', 'avg_feature_usage', 'max_feature_usage']) AS feature
  UNION SELECT 'plan_' || plan FROM features WHERE plan IS NOT NULL
  UNION SELECT 'segment_' || segment FROM features WHERE segment IS NOT NULL)""",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "churn_logistic_one_input": _sql(
        """SELECT round(b0, 3) AS intercept, round(b1, 3) AS slope,
       count(*) FILTER (y = 1 AND z > 0) AS true_positives, count(*) FILTER (y = 0 AND z > 0) AS false_positives,
       count(*) FILTER (y = 1 AND z <= 0) AS false_negatives, count(*) FILTER (y = 0 AND z <= 0) AS true_negatives
FROM (SELECT b0, b1, churned AS y, b0 + b1 * (tenure_days - centre) / width AS z
      FROM split, scale, (SELECT * FROM newton ORDER BY step DESC LIMIT 1) WHERE is_test) GROUP BY b0, b1""",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES, NEWTON,
    ).replace("WITH", "WITH RECURSIVE", 1),
    "churn_one_input_scores": _sql(ONE_INPUT_SCORES, CUSTOMERS, SUBSCRIPTIONS, FEATURES, NEWTON).replace("WITH", "WITH RECURSIVE", 1),
    "churn_one_input_at_risk": _sql(
        ONE_INPUT_SCORES + " WHERE p >= 0.5 ORDER BY p * monthly_price DESC, customer_id LIMIT 20",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES, NEWTON,
    ).replace("WITH", "WITH RECURSIVE", 1).replace("SELECT customer_id, round(p", "SELECT CAST(row_number() OVER (ORDER BY p * monthly_price DESC, customer_id) AS INTEGER) AS place, customer_id, round(p", 1),
    "standardised_features": _sql(
        "SELECT customer_id, "
        + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}"
            for c in ("tenure_days", "subscription_count", "avg_logins")
        )
        + " FROM features",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "label_base_rate": _sql("SELECT round(avg(churned), 6) AS base_rate FROM features", CUSTOMERS, SUBSCRIPTIONS, FEATURES),
    "class_weights": _sql(
        """SELECT churned, count(*) AS row_count,
       round((SELECT count(*) FROM features) / ((SELECT count(DISTINCT churned) FROM features) * count(*)), 6) AS class_weight
FROM features GROUP BY churned""",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "train_test_split": _sql(
        """SELECT customer_id, churned,
       row_number() OVER (PARTITION BY churned ORDER BY md5(concat(customer_id, '42')), customer_id)
         <= round(0.2 * count(*) OVER (PARTITION BY churned)) AS is_test
FROM features""",
        CUSTOMERS, SUBSCRIPTIONS, FEATURES,
    ),
    "recency_roc_auc": _sql(
        """SELECT round((sum(mid_rank) FILTER (churned = 1) - positives * (positives + 1) / 2.0::DOUBLE)
             / (positives * (total - positives)), 6) AS auc
FROM (SELECT churned, rank() OVER (ORDER BY churn_probability)
               + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0::DOUBLE AS mid_rank,
             count(*) FILTER (churned = 1) OVER () AS positives, count(*) OVER () AS total
      FROM scored)
GROUP BY positives, total""",
        *SCORED,
    ),
    "recency_roc_auc_by_segment": _sql(
        """SELECT p.segment, round((count(*) FILTER (p.s > n.s) + 0.5::DOUBLE * count(*) FILTER (p.s = n.s)) / count(*), 6) AS auc
FROM (SELECT segment, churn_probability AS s FROM scored WHERE churned = 1) p
JOIN (SELECT segment, churn_probability AS s FROM scored WHERE churned = 0) n ON n.segment = p.segment GROUP BY p.segment""",
        *SCORED,
    ),
    "recency_threshold_metrics": _sql(
        """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT count(*) FILTER (churned = 1 AND churn_probability > 0.5) AS tp,
             count(*) FILTER (churned <> 1 AND churn_probability > 0.5) AS fp,
             count(*) FILTER (churned = 1 AND churn_probability <= 0.5) AS fn,
             count(*) FILTER (churned <> 1 AND churn_probability <= 0.5) AS tn FROM scored)""",
        *SCORED,
    ),
    "risk_ranking": _sql(f"SELECT {ROUNDED_RISK} FROM risk", *SCORED),
    "high_risk_customers": _sql(f"SELECT {ROUNDED_RISK} FROM risk WHERE churn_probability >= 0.7", *SCORED),
    "top_at_risk": _sql(f"SELECT {ROUNDED_RISK} FROM top", *SCORED),
    "at_risk_csv_export": _sql(f"SELECT {ROUNDED_RISK} FROM top", *SCORED),
    "forecast_input": _sql("SELECT date AS ds, MRR AS y FROM mrr", *REVENUE),
    "forecast_model": _sql(
        """SELECT round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(spread, 3) AS spread,
       CAST(m AS INTEGER) AS month, round(effect, 6) AS effect
FROM effects, line, spreads""",
        *FORECAST,
    ),
    "forecast_future_frame": _sql("SELECT date, actual FROM frame", *FORECAST),
    "forecast_summary": _sql("SELECT * FROM summary", *FORECAST),
    "forecast_summary_additive": _sql("SELECT * FROM summary", SUBSCRIPTIONS, MRR, _model("additive")),
    "forecast_future": _sql(FUTURE, *FORECAST),
    "stored_forecast": _sql(
        f"""SELECT summary.*, true AS same_from_model, measures.* FROM summary, ({MEASURES}) measures""",
        *FORECAST,
    ),
    "forecast_in_one_call": _sql(
        f"""SELECT summary.*, "MAE", "RMSE", "MAPE" FROM summary JOIN line USING (segment)
JOIN ({MEASURES.replace("SELECT", "SELECT segment,", 1)} GROUP BY segment) USING (segment) WHERE date > last_date""",
        CUSTOMERS, SUBSCRIPTIONS, SEGMENT_MRR, _model(source="segment_mrr", by="segment"),
    ),
    "forecast_by_segment": _sql(
        "SELECT summary.* FROM summary JOIN line USING (segment) WHERE date > last_date",
        CUSTOMERS, SUBSCRIPTIONS, SEGMENT_MRR, _model(source="segment_mrr", by="segment"),
    ),
    "forecast_bends_of_lines": _sql(
        """SELECT segment, round(regr_slope(v, t), 6) AS slope, round(regr_intercept(v, t), 3) AS intercept, CAST(0 AS INTEGER) AS n_bends
FROM (SELECT segment, year(date) * 12 + month(date) - 1 AS t, (year(date) * 12 + month(date) - 1) * len(segment) * 10 + 5000 AS v FROM segment_mrr)
GROUP BY segment""",
        CUSTOMERS, SUBSCRIPTIONS, SEGMENT_MRR,
    ),
    "forecast_accuracy": _sql(MEASURES, *FORECAST),
    "forecast_csv_export": _sql("SELECT * FROM summary", *FORECAST),
    "forecast_mrr": _sql(f"SELECT {EXPECTED} AS forecast_mrr", *FORECAST),
    "forecast_chart": _sql(
        """SELECT date, 'Actual MRR' AS line, actual AS value FROM summary WHERE actual IS NOT NULL
UNION ALL SELECT date, 'Predicted MRR', predicted FROM summary
UNION ALL SELECT date, 'Upper Bound', upper_bound FROM summary
UNION ALL SELECT date, 'Lower Bound', lower_bound FROM summary""",
        *FORECAST,
    ),
    "kpi_cards": _sql(
        """SELECT 'Current MRR' AS label, format('${:,.0f}', current_mrr) AS value FROM kpis
UNION ALL SELECT 'ARR', format('${:,.0f}', arr) FROM kpis
UNION ALL SELECT 'Active Customers', format('{:,}', active_customers) FROM kpis
UNION ALL SELECT 'Churn Rate', printf('%.1f%%', churn_rate) FROM kpis
UNION ALL SELECT 'ARPU', format('${:,.2f}', arpu) FROM kpis
UNION ALL SELECT 'CLV', format('${:,.2f}', clv) FROM kpis""",
        *ALL_KPIS,
    ),
    "kpi_deltas": _sql(
        f"""SELECT printf('%+.1f%% MoM', mrr_growth_mom) AS mrr_delta, printf('%.1f%%', churn_rate - 5) AS churn_delta,
       {TREND} AS mrr_trend
FROM kpis""",
        *ALL_KPIS,
    ),
    "risk_table": _sql(
        """SELECT customer_id, CAST(round_even(churn_probability * 100, 1) AS VARCHAR) || '%' AS churn_probability,
       printf('$%.2f', current_revenue) AS current_revenue, round_even(risk_score, 2) AS risk_score,
       round_even(tenure_months, 1) AS tenure_months
FROM top WHERE place <= 10""",
        *SCORED,
    ),
    "risk_display": _sql(
        """SELECT customer_id, round_even(churn_probability * 100, 1) AS churn_probability,
       round_even(current_revenue, 2) AS current_revenue, round_even(risk_score, 2) AS risk_score,
       round(tenure_months, 6) AS tenure_months
FROM top""",
        *SCORED,
    ),
    "risk_digest": _sql(DIGEST, *SCORED),
    "narrative_inputs": _sql(
        f"""SELECT current_mrr, mrr_growth_mom, {EXPECTED} AS forecast_mrr, round(churn_rate, 6) AS churn_rate, active_customers,
       (SELECT count(*) FROM top) AS at_risk_count, {TREND} AS mrr_trend
FROM kpis""",
        CUSTOMERS, SUBSCRIPTIONS, MRR, CHURN, ARPU, GROWTH, KPIS, FEATURES, RISK, _model(),
    ),
}
