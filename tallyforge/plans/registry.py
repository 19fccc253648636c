"""Queries over the star-schema tables by operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import periods, pii, text
from tallyforge.functions.money import MONEY
from tallyforge.operators import advisor, anomalies, budgets, debt, forecast, graph, guard, matchers, memo, mutations, net_worth, replay, search, spending, statements
from tallyforge.sources import ledger
from tallyforge.sources.places import cut
from tallyforge.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PERIOD = "1997_03"
INSIDE = "date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"

_CASES = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(ledger.CATEGORY_NAMES, 1))
TX = f"""tx AS (
  SELECT 't_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, CAST(l_shipdate AS DATE) AS date,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount,
         s_name || ' ' || p_name AS raw_description, 'acct_' || o_custkey AS account_id,
         'stmt_' || o_custkey || '_' || STRFTIME(l_shipdate, '%Y%m') AS statement_id, 'm_' || l_suppkey AS merchant_id,
         LOWER(p_type) AS category, CASE LOWER(p_type) {_CASES} END AS category_id, STRFTIME(l_shipdate, '%Y_%m') AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
merchants AS (
  SELECT 'm_' || s_suppkey AS id, s_name AS canonical_name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 6 + 1 AS INTEGER) END AS category_id,
         [UPPER(s_name), REPLACE(s_name, '#', ' ')] AS aliases FROM supplier),
categories AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(ledger.CATEGORY_NAMES, 1))}) AS c(id, name)),
accounts AS (SELECT 'acct_' || c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'savings' WHEN 'MACHINERY' THEN 'checking' ELSE 'credit' END AS type FROM customer)"""


def query(name: str, sql: str | None = None, recursive: bool = False, prefix: bool = True):
    """Register a query; ``sql`` follows the ledger's common tables unless ``prefix`` is off."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            joint = "," if body.upper().startswith("WITH ") else ""
            body = body[5:] if joint else body
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{TX}{joint}\n{body}" if prefix else sql.strip()
        return f

    return keep


def tx(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return ledger.transactions(s, d, *columns)


def values(s: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return s.createDataFrame(rows, schema)


# Rollups


@query("a1_category_totals", f"SELECT category, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total, COUNT(*) AS txn_count FROM tx WHERE {INSIDE} GROUP BY category")
def _(s, d):
    return spending.category_totals(tx(s, d, "date", "amount", "category_id"), ledger.categories(s), PERIOD)


@query("a2_merchant_topk", f"SELECT merchant_id, canonical_name, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total, COUNT(*) AS txn_count FROM tx JOIN merchants m ON m.id = merchant_id WHERE {INSIDE} GROUP BY ALL ORDER BY total DESC, merchant_id LIMIT 10")
def _(s, d):
    return spending.merchant_totals(tx(s, d, "date", "amount", "merchant_id"), ledger.merchants(s, d), PERIOD)


@query("a3_account_delta", f"SELECT account_id, CAST(SUM(amount) AS DECIMAL(18,2)) AS delta FROM tx WHERE {INSIDE} GROUP BY account_id")
def _(s, d):
    return spending.account_delta(tx(s, d, "date", "amount", "account_id"), PERIOD)


@query("a4_merchant_months", "SELECT merchant_id, period, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total, COUNT(*) AS txn_count FROM tx GROUP BY ALL")
def _(s, d):
    return spending.merchant_months(tx(s, d, "date", "amount", "merchant_id"))


@query("a13_category_history", "SELECT category, period, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total FROM tx GROUP BY ALL")
def _(s, d):
    return spending.category_history(tx(s, d, "date", "amount", "category_id"), ledger.categories(s))


@query("a21_signed_rollup", "SELECT merchant_id, CAST(YEAR(date) AS INTEGER) AS year, CAST(SUM(amount) AS DECIMAL(18,2)) AS total, COUNT(*) AS txn_count FROM tx GROUP BY ALL")
def _(s, d):
    return spending.signed_rollup(tx(s, d, "date", "amount", "merchant_id"), "merchant_id", "year")


@query("a14_merge_preview", "SELECT COUNT(*) AS affected FROM tx WHERE merchant_id = 'm_3'")
def _(s, d):
    return mutations.merge_preview(tx(s, d, "merchant_id"), "m_3")


@query("a15_multimaps", "SELECT account_id, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT merchant_id)), ',') AS merchants FROM tx GROUP BY account_id")
def _(s, d):
    return memo.multimap(tx(s, d, "account_id", "merchant_id"), "account_id", "merchant_id").select("account_id", F.array_join("values", ",").alias("merchants"))


@query("a16_allocate_ids", "SELECT CAST(6 + ROW_NUMBER() OVER (ORDER BY name) AS INTEGER) AS id, name FROM (SELECT DISTINCT p_brand AS name FROM part)")
def _(s, d):
    return mutations.allocate_ids(ledger.categories(s), ledger.read(s, d, "part").select(F.col("p_brand").alias("name")))


# Anomalies

HISTORY = f"""months AS (SELECT merchant_id, period, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total FROM tx WHERE period <= '{PERIOD}' GROUP BY ALL),
past AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY period DESC) AS k FROM months WHERE period < '{PERIOD}'),
history AS (SELECT merchant_id, AVG(CAST(total AS DOUBLE)) AS mean, STDDEV_POP(CAST(total AS DOUBLE)) AS sd, COUNT(*) AS months FROM past WHERE k <= 6 GROUP BY merchant_id HAVING COUNT(*) >= 2),
scored AS (
  SELECT merchant_id, m.total AS this_total, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, h.months,
         ROUND(CASE WHEN ROUND(sd, 6) = 0 AND ROUND(CAST(m.total AS DOUBLE) - h.mean, 6) <> 0 THEN 999.0 WHEN ROUND(sd, 6) = 0 THEN 0.0 ELSE (CAST(m.total AS DOUBLE) - h.mean) / sd END, 6) AS z_score
  FROM months m JOIN history h USING (merchant_id) WHERE m.period = '{PERIOD}')"""


@query("a6_merchant_outliers", f"WITH {HISTORY} SELECT * FROM scored WHERE ABS(z_score) >= 1.0")
def _(s, d):
    return anomalies.merchant_outliers(tx(s, d, "date", "amount", "merchant_id"), PERIOD, z=1.0)


PATTERNS = """patterns AS (
  SELECT 'p_' || merchant_id AS id, merchant_id,
         CAST((2 * SUM(CAST(ABS(amount) * 100 AS BIGINT)) + COUNT(*)) // (2 * COUNT(*)) AS DECIMAL(18,2)) / 100 AS expected, MAX(date) AS last_seen
  FROM tx WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY merchant_id),
expecting AS (SELECT id, merchant_id, CAST(expected AS DECIMAL(18,2)) AS expected_amount, last_seen FROM patterns)"""


def patterns(s, d):
    return anomalies.derive_patterns(tx(s, d, "date", "amount", "merchant_id"), "1996_01", "1996_12")


DRIFT = f"""{PATTERNS},
drift AS (
  SELECT t.id AS transaction_id, t.merchant_id, amount, expected_amount,
         ROUND(ABS(CAST(ABS(amount) AS DOUBLE) - CAST(expected_amount AS DOUBLE)) / CAST(expected_amount AS DOUBLE), 6) AS delta_pct
  FROM tx t JOIN expecting e ON e.merchant_id = t.merchant_id WHERE {INSIDE})"""


def drift(s, d):
    charges = tx(s, d, "id", "date", "amount", "merchant_id").select("id", "date", "amount", F.concat(F.lit("p_"), "merchant_id").alias("pattern_id"))
    return anomalies.subscription_drift(charges, patterns(s, d), PERIOD)


@query("a7_subscription_drift", f"WITH {DRIFT} SELECT * FROM drift WHERE delta_pct > 0.05")
def _(s, d):
    return drift(s, d)


@query("m8_link_patterns", f"""WITH {PATTERNS}
SELECT t.id, CASE WHEN ABS(ABS(amount) - expected_amount) <= 0.05 * expected_amount THEN e.id END AS pattern_id
FROM tx t LEFT JOIN expecting e ON e.merchant_id = t.merchant_id""")
def _(s, d):
    return anomalies.link_patterns(tx(s, d, "id", "amount", "merchant_id"), patterns(s, d)).select("id", "pattern_id")


@query("a8_recurring", """WITH stats AS (
  SELECT merchant_id, CAST(CAST((2 * SUM(CAST(ABS(amount) * 100 AS BIGINT)) + COUNT(*)) // (2 * COUNT(*)) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS expected_amount,
         COUNT(DISTINCT period) AS months, MAX(date) AS last_seen, AVG(CAST(ABS(amount) AS DOUBLE)) AS mean, STDDEV_SAMP(CAST(ABS(amount) AS DOUBLE)) AS sd FROM tx GROUP BY merchant_id)
SELECT merchant_id, 'monthly' AS cadence, expected_amount, months, last_seen, ROUND(LEAST(1.0, 0.5 + CAST(0.1 AS DOUBLE) * months), 6) AS confidence
FROM stats WHERE months >= 3 AND (sd IS NULL OR mean = 0 OR sd / mean <= 0.56)""")
def _(s, d):
    return anomalies.recurring(tx(s, d, "date", "amount", "merchant_id"), max_cv=0.56)


# Net worth

MONTHLY = "monthly AS (SELECT period, CAST(SUM(SUM(amount)) OVER (ORDER BY period) AS DECIMAL(18,2)) AS total_amount FROM tx GROUP BY period)"


@query("a10_positions", "SELECT a.id AS account_id, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS position FROM accounts a LEFT JOIN tx ON account_id = a.id AND date <= DATE '1997-03-31' GROUP BY a.id")
def _(s, d):
    return net_worth.positions(tx(s, d, "date", "amount", "account_id"), ledger.accounts(s, d), PERIOD)


@query("a10_snapshot", f"SELECT '{PERIOD}' AS period, CAST(SUM(amount) AS DECIMAL(18,2)) AS total_amount, (SELECT COUNT(*) FROM accounts) AS accounts FROM tx WHERE date <= DATE '1997-03-31'")
def _(s, d):
    return net_worth.snapshot_totals(net_worth.snapshot(tx(s, d, "date", "amount", "account_id"), ledger.accounts(s, d), PERIOD))


@query("w6_running_positions", "SELECT account_id, period, CAST(SUM(amount) AS DECIMAL(18,2)) AS net, CAST(SUM(SUM(amount)) OVER (PARTITION BY account_id ORDER BY period) AS DECIMAL(18,2)) AS position FROM tx GROUP BY account_id, period")
def _(s, d):
    return net_worth.running_positions(tx(s, d, "date", "amount", "account_id"))


@query("nw1_month_over_month", f"""WITH {MONTHLY}, stored AS (SELECT * FROM monthly WHERE CAST(RIGHT(period, 2) AS INTEGER) % 5 <> 0)
SELECT m.period, m.total_amount, p.total_amount AS previous, CAST(m.total_amount - p.total_amount AS DECIMAL(18,2)) AS delta,
       CASE WHEN p.total_amount <> 0 THEN ROUND(CAST(m.total_amount - p.total_amount AS DOUBLE) / CAST(p.total_amount AS DOUBLE), 6) END AS delta_pct
FROM monthly m LEFT JOIN stored p ON STRPTIME(p.period || '_01', '%Y_%m_%d') + INTERVAL 1 MONTH = STRPTIME(m.period || '_01', '%Y_%m_%d')""")
def _(s, d):
    monthly = net_worth.monthly_totals(tx(s, d, "date", "amount"))
    return net_worth.month_over_month(monthly, monthly.where(F.right("period", F.lit(2)).cast("int") % 5 != 0))


@query("w3_snapshot_lag", f"WITH {MONTHLY} SELECT period, total_amount, CAST(total_amount - LAG(total_amount) OVER (ORDER BY period) AS DECIMAL(18,2)) AS delta FROM monthly")
def _(s, d):
    return net_worth.lagged(net_worth.monthly_totals(tx(s, d, "date", "amount")))


@query("l5_latest_snapshots", f"WITH {MONTHLY} SELECT * FROM monthly WHERE period <= '{PERIOD}' ORDER BY period DESC LIMIT 3")
def _(s, d):
    return net_worth.latest(net_worth.monthly_totals(tx(s, d, "date", "amount")), PERIOD)


@query("w5_declines", f"""WITH {MONTHLY}, l AS (SELECT *, LAG(total_amount, 1) OVER (ORDER BY period) AS a, LAG(total_amount, 2) OVER (ORDER BY period) AS b FROM monthly)
SELECT period, total_amount, CAST(total_amount - b AS DECIMAL(18,2)) AS fall FROM l WHERE total_amount < a AND a < b""")
def _(s, d):
    return net_worth.declines(net_worth.monthly_totals(tx(s, d, "date", "amount")))


# Budgets and goals

BUDGET_ROWS = [("b1", PERIOD, "category", "economy", "250000.00"), ("b2", "annual:1997", "category", "large", "1000000.10"), ("b3", PERIOD, "merchant", "m_3", "50000.00"), ("b4", PERIOD, "category", "promo", "0.00"), ("b5", "1997_04", "category", "small", "1.00"), ("b6", PERIOD, "category", "nothing", "10.00"), ("b7", PERIOD, "category", "none", "0.00")]
BUDGETS = "budgets AS (SELECT id, period, scope_type, scope_id, CAST(t AS DECIMAL(18,2)) AS target_amount FROM (VALUES " + ", ".join(str(b) for b in BUDGET_ROWS) + ") AS v(id, period, scope_type, scope_id, t))"
VARIANCE = f"""{BUDGETS},
spent AS (SELECT 'category' AS scope_type, category AS scope_id, SUM(ABS(amount)) AS actual FROM tx WHERE {INSIDE} GROUP BY ALL UNION ALL SELECT 'merchant', merchant_id, SUM(ABS(amount)) FROM tx WHERE {INSIDE} GROUP BY ALL),
lined AS (SELECT b.id, b.scope_type, b.scope_id, CAST(CASE WHEN b.period LIKE 'annual%' THEN ROUND_EVEN(CAST(target_amount AS DOUBLE) / 12, 2) ELSE target_amount END AS DECIMAL(18,2)) AS target, CAST(COALESCE(actual, 0) AS DECIMAL(18,2)) AS actual
  FROM budgets b LEFT JOIN spent s ON s.scope_type = b.scope_type AND s.scope_id = b.scope_id WHERE b.period IN ('{PERIOD}', 'annual:1997')),
gaps AS (SELECT *, CAST(actual - target AS DECIMAL(18,2)) AS delta, CASE WHEN target <> 0 THEN ROUND(CAST(actual - target AS DOUBLE) / CAST(target AS DOUBLE), 6) WHEN actual <> target THEN CAST('Infinity' AS DOUBLE) ELSE 0.0 END AS delta_pct FROM lined),
variances AS (SELECT *, CASE WHEN ABS(delta_pct) <= 0.05 THEN 'on_track' WHEN delta_pct > 0 THEN 'over' ELSE 'under' END AS status FROM gaps)"""


def budget_rows(s):
    return values(s, "id string, period string, scope_type string, scope_id string, t string", BUDGET_ROWS).withColumn("target_amount", F.col("t").cast(MONEY))


def variances(s, d):
    return budgets.budget_variance(budget_rows(s), budgets.actuals(tx(s, d, "date", "amount", "category_id", "merchant_id"), ledger.categories(s), PERIOD), PERIOD)


@query("b1_budget_variance", f"WITH {VARIANCE} SELECT * FROM variances")
def _(s, d):
    return variances(s, d)


@query("j17_budgets_with_variances", f"WITH {VARIANCE} SELECT b.id, b.period, b.target_amount, v.actual, v.delta, v.status FROM budgets b LEFT JOIN variances v ON v.id = b.id")
def _(s, d):
    return budgets.with_variance(budget_rows(s), variances(s, d)).select("id", "period", "target_amount", "actual", "delta", "status")


GOAL_ROWS = [("g1", "Save", "50000.00", "1998-12-31", "savings_account", "acct_1", "active", "1996-01-01"), ("g2", "Cap", "90000000.00", "1997-12-31", "category_underspend", "economy", "active", "1997-01-01"), ("g3", "Done", "1.00", "1997-01-31", "savings_account", "acct_2", "achieved", "1996-01-01"), ("g4", "Late", "900000000.00", "1997-03-31", "savings_account", "acct_3", "active", "1996-06-15"), ("g5", "Debt", "5000.00", "1999-01-01", "debt_payoff", "x", "active", None), ("g6", "Past", "10.00", "1996-01-01", "custom", "x", "active", "1997-01-01")]


def goal_rows(s):
    rows = values(s, "id string, name string, t string, d string, scope_type string, scope_id string, status string, f string", GOAL_ROWS)
    return rows.select("id", "name", F.col("t").cast(MONEY).alias("target_amount"), F.col("d").cast("date").alias("target_date"), "scope_type", "scope_id", "status", F.col("f").cast("date").alias("started_at"))


def goals(s, d):
    return budgets.active_goal_progress(goal_rows(s), tx(s, d, "date", "amount", "account_id", "category"), PERIOD)


_GOALS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in g) + ")" for g in GOAL_ROWS)


GOALS = f"""goals AS (SELECT id, CAST(t AS DECIMAL(18,2)) AS target, CAST(d AS DATE) AS due, scope_type, scope_id, status, COALESCE(CAST(f AS DATE), DATE '1997-03-31') AS since
  FROM (VALUES {_GOALS}) AS v(id, name, t, d, scope_type, scope_id, status, f) WHERE status = 'active'),
sums AS (SELECT g.id, SUM(amount) AS net, SUM(ABS(amount)) AS spent FROM goals g JOIN tx ON date BETWEEN since AND DATE '1997-03-31' AND ((scope_type = 'savings_account' AND account_id = scope_id) OR (scope_type = 'category_underspend' AND category = scope_id)) GROUP BY g.id),
a AS (SELECT g.*, CAST(CASE scope_type WHEN 'savings_account' THEN GREATEST(COALESCE(net, 0), 0) WHEN 'category_underspend' THEN GREATEST(target - COALESCE(spent, 0), 0) ELSE 0 END AS DECIMAL(18,2)) AS current,
  CAST(CASE WHEN due < since THEN 0 ELSE (YEAR(due) - YEAR(since)) * 12 + MONTH(due) - MONTH(since) + 1 END AS INTEGER) AS months_total,
  CAST(CASE WHEN DATE '1997-03-31' < since THEN 0 ELSE (1997 - YEAR(since)) * 12 + 3 - MONTH(since) + 1 END AS INTEGER) AS run FROM goals g LEFT JOIN sums USING (id)),
b AS (SELECT *, LEAST(run, months_total) AS months_elapsed, CASE WHEN target > 0 THEN ROUND(CAST(current AS DOUBLE) / CAST(target AS DOUBLE), 6) ELSE 0.0 END AS pct FROM a),
c AS (SELECT *, CASE WHEN months_total > 0 THEN ROUND(CAST(months_elapsed AS DOUBLE) / months_total, 6) ELSE 1.0 END AS expected_pct,
  CAST(CASE WHEN months_total > months_elapsed THEN ROUND_EVEN(CAST(target - current AS DOUBLE) / (months_total - months_elapsed), 2) ELSE 0 END AS DECIMAL(18,2)) AS monthly_required FROM b),
progressed AS (SELECT id, scope_type, scope_id, target, current, months_total, months_elapsed, pct, expected_pct, monthly_required,
  CASE WHEN current >= target THEN 'achieved' WHEN months_elapsed >= months_total THEN 'missed' WHEN ABS(ROUND(pct - expected_pct, 6)) <= 0.05 THEN 'on_track' WHEN pct > expected_pct THEN 'ahead' ELSE 'behind' END AS progress FROM c)"""


@query("gp2_goal_progress", f"WITH {GOALS} SELECT * FROM progressed")
def _(s, d):
    return goals(s, d)


# Forecasts: one row per category and step

LAST = "2000_12"


def _forecasts(s, d, lookback):
    history = spending.category_history(tx(s, d, "date", "amount", "category_id"), ledger.categories(s))
    return forecast.forecast(forecast.monthly_series(history, "category", LAST, lookback), LAST)


def _steps(df):
    return df.select("category", "method", F.posexplode("forecast").alias("k", "forecast"), "rmse", "monthly_average")


def _spine(n):
    return f"""spine AS (SELECT STRFTIME(DATE '2000-12-01' - to_months(CAST({n} - 1 - i AS INTEGER)), '%Y_%m') AS period, i FROM RANGE({n}) r(i)),
named AS (SELECT DISTINCT category FROM tx),
totals AS (SELECT category, period, SUM(ABS(amount)) AS total FROM tx GROUP BY ALL),
series AS (SELECT category, i, CAST(COALESCE(total, 0) AS DOUBLE) AS y FROM named CROSS JOIN spine LEFT JOIN totals USING (category, period)),
means AS (SELECT category, AVG(y) AS mean FROM series GROUP BY category)"""


@query("n1_linear_forecast", f"""WITH {_spine(4)}, fit AS (SELECT category, REGR_SLOPE(y, i) AS b, REGR_INTERCEPT(y, i) AS a FROM series GROUP BY category),
err AS (SELECT category, SQRT(SUM((y - a - b * i) * (y - a - b * i)) / 4) AS rmse FROM series JOIN fit USING (category) GROUP BY category)
SELECT category, 'linear' AS method, CAST(k AS INTEGER) AS k, ROUND(GREATEST(a + b * (4 + k), 0.0), 6) AS forecast, ROUND(rmse, 6) AS rmse, ROUND(mean, 6) AS monthly_average
FROM fit JOIN err USING (category) JOIN means USING (category) CROSS JOIN RANGE(3) r(k)""")
def _(s, d):
    return _steps(_forecasts(s, d, 4))


HOLT = f"""{_spine(12)},
holt AS (
  SELECT a.category, 1 AS i, 0.5 * b.y + 0.5 * b.y AS level, 0.2 * (b.y - a.y) + 0.8 * (b.y - a.y) AS trend, CAST(0 AS DOUBLE) AS sse FROM series a JOIN series b ON b.category = a.category AND a.i = 0 AND b.i = 1
  UNION ALL
  SELECT h.category, h.i + 1, 0.5 * s.y + 0.5 * (level + trend), 0.2 * (0.5 * s.y + 0.5 * (level + trend) - level) + 0.8 * trend, sse + (s.y - level - trend) * (s.y - level - trend)
  FROM holt h JOIN series s ON s.category = h.category AND s.i = h.i + 1)"""


@query("n2_holt_forecast", f"""WITH {HOLT}
SELECT category, 'holt' AS method, CAST(k AS INTEGER) AS k, ROUND(GREATEST(level + (k + 1) * trend, 0.0), 6) AS forecast, ROUND(SQRT(sse / 11), 6) AS rmse, ROUND(mean, 6) AS monthly_average
FROM holt JOIN means USING (category) CROSS JOIN RANGE(3) r(k) WHERE i = 11""", recursive=True)
def _(s, d):
    return _steps(_forecasts(s, d, 12))


@query("l3_top_forecasts", f"""WITH {HOLT},
largest AS (SELECT category FROM totals WHERE period = '{PERIOD}' ORDER BY total DESC, category LIMIT 4)
SELECT category, CAST(k AS INTEGER) AS k, ROUND(GREATEST(level + (k + 1) * trend, 0.0), 6) AS forecast FROM holt JOIN largest USING (category) CROSS JOIN RANGE(3) r(k) WHERE i = 11""", recursive=True)
def _(s, d):
    history = spending.category_history(tx(s, d, "date", "amount", "category_id"), ledger.categories(s))
    series = forecast.monthly_series(forecast.of_largest(history, "category", PERIOD, 4), "category", LAST, 12)
    return _steps(forecast.forecast(series, LAST)).select("category", "k", "forecast")


@query("n3_seasonal_forecast", f"""WITH {_spine(24)},
err AS (SELECT b.category, SQRT(AVG((b.y - a.y) * (b.y - a.y))) AS rmse FROM series a JOIN series b ON a.category = b.category AND b.i = a.i + 12 GROUP BY b.category)
SELECT category, 'seasonal_naive' AS method, CAST(i - 12 AS INTEGER) AS k, ROUND(y, 6) AS forecast, ROUND(rmse, 6) AS rmse, ROUND(mean, 6) AS monthly_average
FROM series JOIN err USING (category) JOIN means USING (category) WHERE i BETWEEN 12 AND 14""")
def _(s, d):
    return _steps(_forecasts(s, d, 24))


@query("w8_scaled_history", """WITH h AS (SELECT category, period, CAST(SUM(ABS(amount)) AS DECIMAL(18,2)) AS total FROM tx GROUP BY ALL)
SELECT category, period, total, ROUND(CAST(total - MIN(total) OVER w AS DOUBLE) / CASE WHEN MAX(total) OVER w = MIN(total) OVER w THEN 1.0 ELSE CAST(MAX(total) OVER w - MIN(total) OVER w AS DOUBLE) END, 6) AS scaled FROM h WINDOW w AS (PARTITION BY category)""")
def _(s, d):
    return forecast.scaled(spending.category_history(tx(s, d, "date", "amount", "category_id"), ledger.categories(s)), "category", "total")


# Debt

#: Loans of the customers who owe something; the rate is a twelfth of the yearly one, in units of 1e-16, amounts are in cents.
LOANS = """loans AS (SELECT 'l_' || c_custkey AS id, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS outstanding, (c_custkey % 36) / 100.0 AS apr,
  CAST(((c_custkey % 36) * 100000000000000 + 6) // 12 AS BIGINT) AS rate, CAST(2500 + 100 * (c_custkey % 500) AS BIGINT) AS payment FROM customer WHERE c_acctbal > 0)"""


def _cents(c):
    return f"CAST(CAST({c} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def _schedule(name, source):
    interest = "CAST(v // 10000000000000000 + CASE WHEN v % 10000000000000000 > 5000000000000000 OR v % 10000000000000000 = 5000000000000000 AND (v // 10000000000000000) % 2 = 1 THEN 1 ELSE 0 END AS BIGINT)"
    return f"""{name} AS (
  SELECT id, 0 AS month, rate, payment, CAST(0 AS BIGINT) AS interest, CAST(0 AS BIGINT) AS principal, outstanding AS balance FROM {source}
  WHERE outstanding > 0 AND payment > 0 AND CAST(outstanding AS HUGEINT) * rate < CAST(payment AS HUGEINT) * 10000000000000000
  UNION ALL
  SELECT id, month + 1, rate, payment, i, LEAST(payment - i, balance), balance - LEAST(payment - i, balance)
  FROM (SELECT *, {interest} AS i FROM (SELECT *, CAST(balance AS HUGEINT) * rate AS v FROM {name} WHERE balance > 1 AND month < 600)))"""


SCHEDULE = f"{LOANS},\n{_schedule('steps', 'loans')}"


def loans(s, d):
    c = ledger.read(s, d, "customer").where("c_acctbal > 0")
    return c.select(F.concat(F.lit("l_"), "c_custkey").alias("id"), F.col("c_acctbal").cast(MONEY).alias("outstanding"), (F.col("c_custkey") % 36 / 100).cast("decimal(10,6)").alias("apr"), (F.col("c_custkey") % 500 + 25).cast(MONEY).alias("payment"))


@query("d1_amortisation", f"WITH RECURSIVE {SCHEDULE} SELECT id, CAST(month AS INTEGER) AS month, {_cents('interest + principal')} AS payment, {_cents('interest')} AS interest, {_cents('principal')} AS principal, {_cents('balance')} AS balance FROM steps WHERE month > 0", prefix=False)
def _(s, d):
    return debt.amortisation(loans(s, d))


@query("d2_payoff", f"WITH RECURSIVE {SCHEDULE} SELECT l.id, CAST(COALESCE(NULLIF(MAX(month), 0), -1) AS INTEGER) AS months, {_cents('COALESCE(SUM(interest), 0)')} AS total_interest FROM loans l LEFT JOIN steps s ON s.id = l.id GROUP BY l.id", prefix=False)
def _(s, d):
    return debt.payoff(loans(s, d))


LEVEL = "CAST(ROUND_EVEN(CASE WHEN apr = 0 THEN CAST(outstanding AS DOUBLE) / 100 / {n} ELSE CAST(outstanding AS DOUBLE) / 100 * (CAST(apr AS DOUBLE) / 12) / (1 - POW(1 + CAST(apr AS DOUBLE) / 12, -{n})) END, 2) AS DECIMAL(18,2))"


@query("d4_recommended_payment", f"WITH {LOANS} SELECT id, {LEVEL.format(n=12)} AS payment FROM loans", prefix=False)
def _(s, d):
    return loans(s, d).select("id", debt.recommended_payment(F.col("outstanding"), F.col("apr"), F.lit(12)).alias("payment"))


# Listings and lookups


@query("j5_merchant_listing", "SELECT m.id, canonical_name, c.name AS category, COUNT(t.id) AS txn_count FROM merchants m LEFT JOIN categories c ON c.id = m.category_id LEFT JOIN tx t ON t.merchant_id = m.id GROUP BY ALL")
def _(s, d):
    counts = tx(s, d, "merchant_id").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))
    named = ledger.categories(s).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    rows = ledger.merchants(s, d).join(named, "category_id", "left").join(counts, F.col("id") == F.col("merchant_id"), "left")
    return rows.select("id", "canonical_name", "category", F.coalesce("n", F.lit(0)).alias("txn_count"))


@query("f8_merchant_lookup", "SELECT id, canonical_name FROM merchants WHERE LOWER(canonical_name) LIKE '%#00000000%' AND category_id = 2 ORDER BY canonical_name, id LIMIT 5")
def _(s, d):
    return search.lookup(ledger.merchants(s, d), "#00000000", 2, 5).select("id", "canonical_name")


@query("j8_statement_counts", "SELECT statement_id AS id, account_id, CAST(DATE_TRUNC('month', date) AS DATE) AS period_start, LAST_DAY(date) AS period_end, COUNT(*) AS txn_count FROM tx GROUP BY ALL")
def _(s, d):
    counts = tx(s, d, "statement_id").groupBy("statement_id").agg(F.count(F.lit(1)).alias("txn_count"))
    return ledger.statements(s, d).join(counts, F.col("id") == F.col("statement_id"), "left").select("id", "account_id", "period_start", "period_end", F.coalesce("txn_count", F.lit(0)).alias("txn_count"))


@query("w2_latest_statements", "WITH st AS (SELECT DISTINCT statement_id AS id, account_id, LAST_DAY(date) AS period_end FROM tx WHERE LAST_DAY(date) <= DATE '1997-03-31') SELECT id, account_id, period_end FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY period_end DESC, id DESC) AS k FROM st) WHERE k = 1")
def _(s, d):
    return advisor.latest_statement(ledger.statements(s, d), periods.window(PERIOD)[1]).select("id", "account_id", "period_end")


@query("f5_statements_touching", "SELECT DISTINCT statement_id AS id, CAST(DATE_TRUNC('month', date) AS DATE) AS period_start FROM tx WHERE DATE_TRUNC('month', date) <= DATE '1997-04-10' AND LAST_DAY(date) >= DATE '1997-03-20'")
def _(s, d):
    return ledger.statements(s, d).where((F.col("period_start") <= F.lit(date(1997, 4, 10))) & (F.col("period_end") >= F.lit(date(1997, 3, 20)))).select("id", "period_start")


@query("l4_recent_transactions", "SELECT id, date, amount FROM tx WHERE merchant_id = 'm_3' ORDER BY date DESC, id LIMIT 50")
def _(s, d):
    return tx(s, d, "id", "date", "amount", "merchant_id").where("merchant_id = 'm_3'").select("id", "date", "amount").orderBy(F.desc("date"), "id").limit(50)


@query("j12_new_descriptions", "SELECT DISTINCT raw_description FROM tx WHERE NOT EXISTS (SELECT 1 FROM merchants m WHERE CAST(SUBSTR(m.id, 3) AS INTEGER) % 3 <> 0 AND (CONTAINS(LOWER(raw_description), LOWER(canonical_name)) OR LIST_CONTAINS(aliases, raw_description)))")
def _(s, d):
    known = ledger.merchants(s, d).where(F.substring("id", 3, 20).cast("int") % 3 != 0)
    return mutations.new_descriptions(tx(s, d, "raw_description"), known)


#: Ids made of parts' names: a word, two words, and both with the brand or size behind them.
IDS = "ids AS (SELECT DISTINCT UNNEST([SPLIT_PART(p_name, ' ', 1), REPLACE(p_name, ' ', '_'), REPLACE(p_name, ' ', '_') || '_' || REPLACE(p_brand, '#', '_'), SPLIT_PART(p_name, ' ', 1) || '_x_' || p_size]) AS id FROM part)"


def part_ids(s, d):
    flat = F.replace("p_name", F.lit(" "), F.lit("_"))
    word = F.substring_index("p_name", " ", 1)
    forms = F.array(word, flat, F.concat_ws("_", flat, F.replace("p_brand", F.lit("#"), F.lit("_"))), F.concat_ws("_x_", word, "p_size"))
    return ledger.read(s, d, "part").select(F.explode(forms).alias("id")).distinct()


SHORT_IDS = """short AS (SELECT id FROM ids WHERE LENGTH(id) <= 16 AND LENGTH(id) - LENGTH(REPLACE(id, '_', '')) <= 1 AND NOT REGEXP_MATCHES(id, '[0-9]')),
hit AS (SELECT i.id AS old_id, s.id AS new_id, ROW_NUMBER() OVER (PARTITION BY i.id ORDER BY LENGTH(s.id) DESC) AS k FROM ids i JOIN short s ON STARTS_WITH(i.id, s.id || '_') WHERE i.id NOT IN (SELECT id FROM short))"""


@query("j14_prefix_redirects", f"WITH {IDS}, {SHORT_IDS} SELECT old_id, new_id FROM hit WHERE k = 1", prefix=False)
def _(s, d):
    return mutations.prefix_redirects(part_ids(s, d)).select("old_id", "new_id")


@query("a19_a24_suite_summary", "SELECT event_type AS suite, COUNT(*) AS total, CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM events GROUP BY event_type", prefix=False)
def _(s, d):
    return replay.suite_summary(ledger.read(s, d, "events").select(F.col("event_type").alias("suite"), (F.col("value") > 50).alias("passed")))


@query("u2_alias_union", "SELECT id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_CONCAT(aliases, [canonical_name]))), '|') AS aliases FROM merchants")
def _(s, d):
    return ledger.merchants(s, d).select("id", F.array_join(F.sort_array(F.array_union("aliases", F.array("canonical_name"))), "|").alias("aliases"))


# Text


@query("x13_slugs", "SELECT s_suppkey AS id, COALESCE(NULLIF(TRIM(REGEXP_REPLACE(LOWER(TRIM(s_name)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'merchant') AS slug FROM supplier", prefix=False)
def _(s, d):
    return ledger.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), text.slug("s_name").alias("slug"))


@query("x10_currency_values", r"SELECT doc_id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(text, '\b\d[\d,]*\.\d{2}\b'), lambda x: REPLACE(x, ',', '')))), '|') AS found FROM documents", prefix=False)
def _(s, d):
    return ledger.read(s, d, "documents").select("doc_id", F.array_join(F.sort_array(text.currency_values("text")), "|").alias("found"))


@query("x19_mask_emails_and_numbers", None)
def _(s, d):
    docs = ledger.read(s, d, "documents")
    return docs.select("doc_id", F.sha2(pii.mask("text", ("loser",)), 256).alias("masked"), pii.residual("text").alias("residual"))


#: Each document cites every second of its own numbers, and for ids divisible by three nothing.
@query("x18_unsupported_numbers", r"""WITH found AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, REGEXP_EXTRACT_ALL(text, '[£$]-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\b\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?%') AS t FROM documents),
each AS (SELECT id, doc_id, UNNEST(t) AS token, UNNEST(RANGE(LEN(t))) AS position FROM found),
formed AS (SELECT *, REGEXP_EXTRACT(token, '-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?') AS n FROM each),
forms AS (SELECT *, LIST_DISTINCT([token, REGEXP_REPLACE(token, '^[£$]+', ''), REPLACE(token, ',', ''), n, REPLACE(n, ',', '')]) AS f FROM formed),
cited AS (SELECT id, LIST_DISTINCT(FLATTEN(LIST(f))) AS b FROM forms WHERE position % 2 = 0 AND doc_id % 3 <> 0 GROUP BY id)
SELECT f.id, CAST(position AS INTEGER) AS position, token FROM forms f LEFT JOIN cited c ON c.id = f.id WHERE b IS NULL OR NOT LIST_HAS_ANY(f, b)""", prefix=False)
def _(s, d):
    docs = ledger.read(s, d, "documents")
    cited = F.when(F.col("doc_id") % 3 != 0, F.filter(text.money_tokens("text"), lambda x, i: i % 2 == 0))
    return text.unsupported_numbers(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), cited.alias("cited"))).select("id", "position", "token")


def rendered(s, d):
    """The ledger's statements as Markdown, each in its account's format."""
    return statements.render(tx(s, d, "id", "date", "amount", "raw_description", "account_id", "statement_id"), ledger.accounts(s, d))


#: Savings statements write years with two digits, which are taken for this century's.
READ_BACK = "CASE WHEN a.type = 'savings' AND YEAR(date) < 2000 THEN CAST(date + INTERVAL 100 YEAR AS DATE) ELSE date END"


@query("x9_statement_parse", f"SELECT statement_id AS doc, {READ_BACK} AS date, raw_description, amount FROM tx JOIN accounts a ON a.id = account_id")
def _(s, d):
    return statements.parse(rendered(s, d)).select("doc", "date", "raw_description", "amount")


@query("x11_missing_values", r"""WITH held AS (SELECT l_orderkey AS id, LIST(DISTINCT CAST(ABS(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR)) AS v FROM lineitem GROUP BY l_orderkey),
found AS (SELECT doc_id, LIST_DISTINCT(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(text, '\b\d[\d,]*\.\d{2}\b'), lambda x: REPLACE(x, ',', ''))) AS f FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, ARRAY_TO_STRING(LIST_SORT(LIST_FILTER(f, lambda x: v IS NULL OR NOT LIST_CONTAINS(v, x))), '|') AS missing FROM found LEFT JOIN held ON held.id = doc_id""", prefix=False)
def _(s, d):
    docs = ledger.read(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("md"))
    parsed = ledger.read(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.col("l_extendedprice").cast(MONEY).alias("amount"))
    return statements.missing_values(docs, parsed).select("id", F.array_join("missing", "|").alias("missing"))


# Graph and search

EDGES = """edges AS (
  SELECT DISTINCT account_id AS src, statement_id AS dst, 'HAS_STATEMENT' AS type FROM tx UNION ALL SELECT DISTINCT statement_id, id, 'HAS_TRANSACTION' FROM tx
  UNION ALL SELECT DISTINCT id, merchant_id, 'AT_MERCHANT' FROM tx UNION ALL SELECT DISTINCT id, 'category::' || category_id, 'IN_CATEGORY' FROM tx)"""


def the_graph(s, d):
    t = tx(s, d, "id", "date", "amount", "account_id", "statement_id", "merchant_id", "category_id")
    st = ledger.statements(s, d)
    nodes = graph.vertices(ledger.accounts(s, d), st, ledger.categories(s), ledger.merchants(s, d), t.dropDuplicates(["id"]))
    return nodes, graph.edges(st, t)


def the_edges(s, d):
    """The graph's edges between ends that exist."""
    t = tx(s, d, "id", "account_id", "statement_id", "merchant_id", "category_id")
    return graph.ledger_edges(ledger.accounts(s, d), ledger.categories(s), ledger.merchants(s, d), t)


def the_ends(s, d):
    """The graph's vertices where only those that edges name are asked for: lines without an order or part, of which there are no edges, are not dropped."""
    t = tx(s, d, "id", "date", "amount").dropDuplicates(["id"])
    return graph.vertices(ledger.accounts(s, d), ledger.statements(s, d), ledger.categories(s), ledger.merchants(s, d), t)


@query("g1_vertices", "SELECT id, 'Account' AS label FROM accounts UNION ALL SELECT DISTINCT statement_id, 'Statement' FROM tx UNION ALL SELECT 'category::' || id, 'Category' FROM categories UNION ALL SELECT id, 'Merchant' FROM merchants UNION ALL SELECT DISTINCT id, 'Transaction' FROM tx")
def _(s, d):
    return the_graph(s, d)[0].select("id", "label")


@query("g1_edges", f"WITH {EDGES} SELECT * FROM edges")
def _(s, d):
    return the_edges(s, d).select("src", "dst", "type")


@query("g3_evidence", "SELECT id, MIN(date) AS date, MIN(amount) AS amount FROM tx WHERE merchant_id = 'm_3' GROUP BY id ORDER BY date DESC, id LIMIT 10")
def _(s, d):
    return graph.evidence(the_ends(s, d), the_graph(s, d)[1], "m_3")


@query("g4_neighbours", f"""WITH {EDGES}, ways AS (SELECT src AS a, dst AS b, src, dst, type FROM edges UNION ALL SELECT dst, src, src, dst, type FROM edges),
one AS (SELECT * FROM ways WHERE a = 'stmt_1_199703' OR a = 'acct_1'), two AS (SELECT * FROM ways WHERE a IN (SELECT b FROM one WHERE a = 'acct_1')),
used AS (SELECT src, dst, type FROM one WHERE a = 'acct_1' UNION SELECT src, dst, type FROM two)
SELECT id FROM (SELECT src AS id FROM used UNION SELECT dst FROM used)""")
def _(s, d):
    return graph.neighbours(the_ends(s, d), cut(the_edges(s, d), "edges"), "acct_1", 2)[0].select("id")


@query("g5_graph_stats", f"""WITH {EDGES}
SELECT CASE type WHEN 'HAS_STATEMENT' THEN 'Account' WHEN 'HAS_TRANSACTION' THEN 'Statement' ELSE 'Transaction' END AS from_label, type,
       CASE type WHEN 'HAS_STATEMENT' THEN 'Statement' WHEN 'HAS_TRANSACTION' THEN 'Transaction' WHEN 'AT_MERCHANT' THEN 'Merchant' ELSE 'Category' END AS to_label, COUNT(*) AS n FROM edges GROUP BY type""")
def _(s, d):
    nodes, _ = the_graph(s, d)
    return graph.stats(nodes, the_edges(s, d))[1]


@query("g6_statement_merchants", "SELECT statement_id, merchant_id, COUNT(DISTINCT id) AS weight FROM tx GROUP BY ALL")
def _(s, d):
    return graph.statement_merchants_of(tx(s, d, "id", "statement_id", "merchant_id"))


@query("g6_linked_merchants", "SELECT statement_id, merchant_id, COUNT(DISTINCT id) AS weight FROM tx GROUP BY ALL")
def _(s, d):
    return graph.statement_merchants(the_edges(s, d))


@query("j23_merchant_categories", "SELECT 'category::' || category_id AS category, COUNT(DISTINCT id) AS n FROM tx WHERE merchant_id = 'm_3' GROUP BY ALL")
def _(s, d):
    return graph.merchant_categories(the_graph(s, d)[1].distinct(), "m_3")


@query("g7_undeclared_links", f"WITH {EDGES} SELECT type, COUNT(*) AS n FROM edges WHERE type <> 'AT_MERCHANT' GROUP BY type")
def _(s, d):
    nodes, _ = the_graph(s, d)
    allowed = values(s, "from_label string, type string, to_label string", [("Transaction", "AT_MERCHANT", "Merchant")])
    return graph.undeclared_links(nodes, the_edges(s, d), allowed).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def query_vector(k: int) -> list[float]:
    return [round(((i * 37 + k * 11) % 64) / 64 - 0.5, 4) for i in range(64)]


def _dot(k):
    return "ROUND(" + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * ({x})" for i, x in enumerate(query_vector(k))) + ", 6)"


@query("v2_vector_topk", f"SELECT vec_id AS id, {_dot(1)} AS score FROM embeddings ORDER BY score DESC, id LIMIT 10", prefix=False)
def _(s, d):
    return search.vector(ledger.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), query_vector(1))


@query("v3_rank_fusion", f"""WITH a AS (SELECT vec_id AS id, {_dot(1)} AS score FROM embeddings ORDER BY score DESC, id LIMIT 20), b AS (SELECT vec_id AS id, {_dot(2)} AS score FROM embeddings ORDER BY score DESC, id LIMIT 20),
r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 AS pos FROM a UNION ALL SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 FROM b)
SELECT id, ROUND(SUM(CAST(1.0 AS DOUBLE) / (60 + pos)), 6) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 8""", prefix=False)
def _(s, d):
    v = ledger.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.blend([search.vector(v, query_vector(1), 20), search.vector(v, query_vector(2), 20)], 8)


@query("v1_full_text", r"""WITH words AS (SELECT p_partkey AS id, LIST_FILTER(STRING_SPLIT_REGEX(LOWER(p_name || ' ' || p_brand), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM part),
size AS (SELECT COUNT(*) AS n, AVG(LEN(t)) AS mean FROM words), post AS (SELECT id, LEN(t) AS len, UNNEST(t) AS term FROM words),
tf AS (SELECT id, len, term, COUNT(*) AS tf FROM post WHERE term IN ('cold', 'widget', '13') GROUP BY ALL), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term)
SELECT id, ROUND(SUM(LN(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))), 6) AS score
FROM tf JOIN df USING (term) CROSS JOIN size GROUP BY id ORDER BY score DESC, id LIMIT 10""", prefix=False)
def _(s, d):
    parts = ledger.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return search.full_text(parts, "Cold widget #13")


# Writes


def _halves(s, d):
    rows = tx(s, d, "id", "date", "amount", "raw_description", "account_id")
    early = F.col("date") < F.lit(date(1998, 1, 1))
    return rows.where(early), rows.where(~early | (F.month("date") == 2))


@query("m1_insert_new", """WITH old AS (SELECT id, date, amount, raw_description, account_id FROM tx WHERE date < DATE '1998-01-01'), new AS (SELECT id, date, amount, raw_description, account_id FROM tx WHERE date >= DATE '1998-01-01' OR MONTH(date) = 2),
first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, date, amount, raw_description ORDER BY id) AS k FROM new) WHERE k = 1)
SELECT * FROM old UNION ALL SELECT id, date, amount, raw_description, account_id FROM first f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.account_id = f.account_id AND o.date = f.date AND o.amount = f.amount AND o.raw_description = f.raw_description)""")
def _(s, d):
    old, new = _halves(s, d)
    return mutations.insert_new(old, new, ["account_id", "date", "amount", "raw_description"], "id")


@query("m3_upsert", "SELECT id, canonical_name, category_id, CAST(1 AS INTEGER) AS version FROM merchants WHERE category_id IS NULL OR category_id <> 2 UNION ALL SELECT id, UPPER(canonical_name), category_id, CAST(2 AS INTEGER) FROM merchants WHERE category_id = 2")
def _(s, d):
    old = ledger.merchants(s, d).select("id", "canonical_name", "category_id", F.lit(1).alias("version"))
    new = old.where("category_id = 2").select("id", F.upper("canonical_name").alias("canonical_name"), "category_id", F.lit(2).alias("version"))
    return mutations.upsert(old, new, ["id"], "version")


@query("m7_apply_rules", "SELECT id, CASE WHEN p % 2 = 0 THEN merchant_id ELSE r.m END AS merchant_id FROM (SELECT *, CAST(SPLIT_PART(id, '_', 4) AS INTEGER) AS p FROM tx) t LEFT JOIN (SELECT raw_description AS surface, MIN(merchant_id) AS m FROM tx WHERE category_id < 4 GROUP BY raw_description) r ON r.surface = t.raw_description")
def _(s, d):
    rows = tx(s, d, "id", "raw_description", "merchant_id", "category_id")
    rules = rows.where("category_id < 4").groupBy(F.col("raw_description").alias("surface")).agg(F.min("merchant_id").alias("merchant_id"), F.min("category_id").alias("category_id"))
    holes = rows.withColumn("merchant_id", F.when(F.split("id", "_")[3].cast("int") % 2 == 0, F.col("merchant_id")))
    return mutations.apply_rules(holes, rules).select("id", "merchant_id")


@query("m9_merge_merchant", "SELECT id, CASE WHEN merchant_id = 'm_3' THEN 'm_4' ELSE merchant_id END AS merchant_id FROM tx")
def _(s, d):
    return mutations.merge_merchant(tx(s, d, "id", "merchant_id"), ledger.merchants(s, d), "m_3", "m_4")[0].select("id", "merchant_id")


@query("m9_merged_merchants", "SELECT id, ARRAY_TO_STRING(CASE WHEN id = 'm_4' THEN LIST_SORT(LIST_DISTINCT(LIST_CONCAT(aliases, (SELECT LIST_CONCAT(aliases, [canonical_name]) FROM merchants WHERE id = 'm_3')))) ELSE aliases END, '|') AS aliases FROM merchants WHERE id <> 'm_3'")
def _(s, d):
    return mutations.merge_merchant(tx(s, d, "merchant_id"), ledger.merchants(s, d), "m_3", "m_4")[1].select("id", F.array_join("aliases", "|").alias("aliases"))


@query("m5_upsert_merchants", "SELECT id, canonical_name, ARRAY_TO_STRING(LIST_CONCAT(aliases, ['new']), '|') AS aliases FROM merchants UNION ALL SELECT 'm_new', 'New', 'new'")
def _(s, d):
    old = ledger.merchants(s, d)
    new = old.select("id", F.upper("canonical_name").alias("canonical_name"), "category_id", F.array(F.lit("new")).alias("aliases")).unionByName(values(s, "id string, canonical_name string, category_id int, aliases array<string>", [("m_new", "New", 1, ["new"])]))
    return mutations.upsert_merchants(old, new, ledger.merchants(s, d).select(F.col("id").alias("merchant_id"))).select("id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


# Guards, replay and extensions


@query("q1_guarded_sql", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 7", prefix=False)
def _(s, d):
    ledger.read(s, d, "supplier").createOrReplaceTempView("guarded_supplier")
    return guard.query(s, "SELECT s_suppkey, s_name FROM guarded_supplier WHERE s_suppkey < :n;", {"n": 7})


@query("q6_reconcile", "SELECT CAST(SUM(amount) AS DECIMAL(18,2)) AS actual, COUNT(*) AS n, CAST(342.18 AS DECIMAL(18,4)) AS claimed, CAST(SUM(amount) - 342.18 AS DECIMAL(18,4)) AS gap, ABS(SUM(amount) - 342.18) <= 0.01 AS matches FROM tx WHERE merchant_id = 'm_3' AND date >= DATE '1997-03-01' AND date < DATE '1997-04-01'")
def _(s, d):
    return guard.reconcile(tx(s, d, "date", "amount", "merchant_id"), date(1997, 3, 1), date(1997, 4, 1), "342.18", merchant_id="m_3")


REPLAYED = """WITH counted AS (
  SELECT event_id, event_type, COUNT(*) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS live_pages,
         CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) - SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY ts) AS BIGINT) AS prior_decisions FROM events)
SELECT CAST(event_id AS VARCHAR) AS decision_id, live_pages, prior_decisions, event_id % 1000 = 0 AND event_id > 0 AS drift FROM counted"""


def replayed(s, d, asked):
    events = ledger.read(s, d, "events")
    log = events.select("ts", F.when(F.col("event_type") == "purchase", "Decision").otherwise("Page").alias("type"), F.lit("now").alias("fingerprint"))
    recorded = F.when(F.col("event_id") == 0, "").when(F.col("event_id") % 1000 == 0, "then").otherwise("now")
    asks = events.where(asked).select(F.col("event_id").cast("string").alias("decision_id"), F.col("ts").alias("cutoff"), recorded.alias("recorded"))
    return replay.replay(log, asks)


@query("q7_replay", REPLAYED, prefix=False)
def _(s, d):
    return replayed(s, d, "true")


@query("q7_replay_decisions", f"{REPLAYED} WHERE event_type = 'purchase'", prefix=False)
def _(s, d):
    return replayed(s, d, "event_type = 'purchase'")


@query("x30_assertions", """WITH e AS (SELECT event_type AS suite, props, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
p AS (SELECT suite, 'about_five' AS check_name, ABS(k - 5) <= 0.05 AS passed FROM e UNION ALL SELECT suite, 'at_least_three', k >= 3 FROM e UNION ALL SELECT suite, 'is_two', k = 2 FROM e
  UNION ALL SELECT suite, 'digit_seven', CONTAINS(json_extract_string(props, '$.k'), '7') FROM e UNION ALL SELECT suite, 'low', REGEXP_MATCHES(json_extract_string(props, '$.k'), '^[0-4]$') FROM e)
SELECT suite, check_name, COUNT(*) AS total, CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM p GROUP BY suite, check_name""", prefix=False)
def _(s, d):
    props = F.col("props")
    checks = {
        "about_five": matchers.numeric_field(props, "k", "approx", 5.0),
        "at_least_three": matchers.numeric_field(props, "k", "gte", 3.0),
        "is_two": matchers.field_equals(props, "k", "2"),
        "digit_seven": matchers.contains_substring(props, "k", "7"),
        "low": matchers.regex_match(props, "k", "^[0-4]$"),
    }
    found = matchers.assertions(ledger.read(s, d, "events"), F.col("event_type"), checks)
    return replay.suite_summary(found.withColumn("suite", F.struct("suite", "check_name"))).select("suite.suite", "suite.check_name", "total", "passed")


@query("a17_table_counts", "SELECT 'accounts' AS table_name, COUNT(*) AS n FROM customer UNION ALL SELECT 'merchants', COUNT(*) FROM supplier UNION ALL SELECT 'transactions', COUNT(*) FROM lineitem", prefix=False)
def _(s, d):
    return replay.table_counts({"accounts": ledger.accounts(s, d), "merchants": ledger.merchants(s, d), "transactions": tx(s, d, "merchant_id")})


@query("r2_budget_adjust", f"WITH {VARIANCE} SELECT 'budget_adjust' AS kind, id AS citation, CAST(actual AS VARCHAR) || ',' || CAST(target AS VARCHAR) AS cited FROM variances WHERE status = 'over' AND delta_pct >= 0.2")
def _(s, d):
    return cited(advisor.budget_adjust(variances(s, d), PERIOD), 2)


def cited(drafts: DataFrame, n: int) -> DataFrame:
    """A draft's kind, its citations and the first ``n`` values it cites."""
    return advisor.recommendations([drafts], PERIOD).select("kind", F.array_join("citations", ",").alias("citation"), F.array_join(F.slice("cited_values", 1, n), ",").alias("cited"))


@query("r1_subscription_cancel", f"WITH {DRIFT} SELECT 'subscription_cancel' AS kind, merchant_id AS citation, CAST(amount AS VARCHAR) || ',' || CAST(expected_amount AS VARCHAR) AS cited FROM drift WHERE delta_pct >= 0.5")
def _(s, d):
    return cited(advisor.subscription_cancel(drift(s, d), PERIOD), 2)


@query("r3_goal_off_track", f"""WITH {GOALS}
SELECT 'goal_off_track' AS kind, id AS citation, CONCAT_WS(',', current, target, monthly_required, months_elapsed, months_total, GREATEST(months_total - months_elapsed, 1)) AS cited
FROM progressed WHERE progress IN ('behind', 'missed')""")
def _(s, d):
    return cited(advisor.goal_off_track(goals(s, d)), 6)


@query("r4_anomaly_investigate", f"WITH {HISTORY} SELECT 'anomaly_investigate' AS kind, merchant_id AS citation, CAST(this_total AS VARCHAR) AS cited FROM scored WHERE ABS(z_score) >= 3")
def _(s, d):
    return cited(advisor.anomaly_investigate(anomalies.merchant_outliers(tx(s, d, "date", "amount", "merchant_id"), PERIOD), PERIOD), 1)


def cards(s, d):
    return loans(s, d).select("id", F.concat(F.lit("acct_"), "id").alias("account_id"), "outstanding", "apr", F.col("payment").alias("min_payment"))


@query("r5_credit_payoff_accelerate", f"""WITH RECURSIVE {SCHEDULE},
slow AS (SELECT id, MAX(month) AS months, SUM(interest) AS interest FROM steps GROUP BY id HAVING MAX(month) >= 24),
half AS (SELECT l.*, months, interest, GREATEST(months // 2, 12) AS aim FROM loans l JOIN slow USING (id) WHERE apr >= 0.1),
levels AS (SELECT *, {LEVEL.format(n="aim")} AS level FROM half),
sped AS (SELECT id, outstanding, rate, CAST(level * 100 AS BIGINT) AS payment FROM levels),
{_schedule("faster", "sped")}
SELECT 'credit_payoff_accelerate' AS kind, 'acct_' || h.id || ',' || h.id AS citation,
       CONCAT_WS(',', {_cents('h.outstanding')}, {_cents('h.payment')}, level, {_cents('h.interest')}, {_cents('f.interest')}, months, aim) AS cited
FROM levels h JOIN (SELECT id, SUM(interest) AS interest FROM faster GROUP BY id) f USING (id)""", prefix=False)
def _(s, d):
    return cited(advisor.credit_payoff_accelerate(cards(s, d)), 7)


@query("r6_forecast_overshoot", f"""WITH {VARIANCE}, {HOLT},
ahead AS (SELECT category, SUM(CAST(ROUND_EVEN(ROUND(GREATEST(level + (k + 1) * trend, 0.0), 6), 2) AS DECIMAL(18,2))) AS ahead FROM holt CROSS JOIN RANGE(3) r(k) WHERE i = 11 GROUP BY category),
projected AS (SELECT id, target, actual, CAST(actual + ahead AS DECIMAL(18,2)) AS projected FROM variances JOIN ahead ON scope_type = 'category' AND scope_id = category WHERE target > 0)
SELECT 'forecast_overshoot' AS kind, id AS citation,
       CONCAT_WS(',', projected, target, CAST(projected - target AS DECIMAL(18,2)), CAST(ROUND_EVEN(CAST(target - actual AS DOUBLE) / 3, 2) AS DECIMAL(18,2))) AS cited
FROM projected WHERE CAST(projected - target AS DOUBLE) > CAST(target AS DOUBLE) * 0.1""", recursive=True)
def _(s, d):
    return cited(advisor.forecast_overshoot(_forecasts(s, d, 12), variances(s, d)), 4)


@query("r7_net_worth_decline", f"""WITH {MONTHLY}, l AS (SELECT period AS now, total_amount AS a, LAG(period, 1) OVER w AS one, LAG(total_amount, 1) OVER w AS b, LAG(period, 2) OVER w AS two, LAG(total_amount, 2) OVER w AS c FROM monthly WINDOW w AS (ORDER BY period))
SELECT 'net_worth_decline' AS kind, 'snap_' || now || ',snap_' || one || ',snap_' || two AS citation, CONCAT_WS(',', a, b, c) AS cited FROM l WHERE now = '{PERIOD}' AND a < b AND b < c""")
def _(s, d):
    return cited(advisor.net_worth_decline(net_worth.monthly_totals(tx(s, d, "date", "amount")), PERIOD), 3)


@query("r_recommendations", f"""WITH {VARIANCE}
SELECT 'budget_adjust' AS kind, id AS citation, CAST(actual AS VARCHAR) || ',' || CAST(target AS VARCHAR) AS cited FROM variances WHERE status = 'over' AND delta_pct >= 0.2""")
def _(s, d):
    drafts = advisor.recommendations([advisor.budget_adjust(variances(s, d), PERIOD)], PERIOD)
    return drafts.select("kind", F.array_join("citations", ",").alias("citation"), F.array_join(F.slice("cited_values", 1, 2), ",").alias("cited"))


@query("r0_all_recommendations")
def _(s, d):
    rows = tx(s, d, "date", "amount", "merchant_id")
    parts = [
        advisor.subscription_cancel(drift(s, d), PERIOD),
        advisor.budget_adjust(variances(s, d), PERIOD),
        advisor.goal_off_track(goals(s, d)),
        advisor.anomaly_investigate(anomalies.merchant_outliers(rows, PERIOD), PERIOD),
        advisor.credit_payoff_accelerate(cards(s, d)),
        advisor.forecast_overshoot(_forecasts(s, d, 12), variances(s, d)),
        advisor.net_worth_decline(net_worth.monthly_totals(rows), PERIOD),
    ]
    return advisor.recommendations(parts, PERIOD)


@query("x26_memo")
def _(s, d):
    rows = tx(s, d, "date", "amount", "merchant_id", "category_id")
    c = ledger.categories(s)
    worth = net_worth.monthly_totals(rows).where(F.col("period") == PERIOD)
    return memo.render(PERIOD, spending.category_totals(rows, c, PERIOD), spending.merchant_totals(rows, ledger.merchants(s, d), PERIOD), variances(s, d), goals(s, d), anomalies.merchant_outliers(rows, PERIOD), _forecasts(s, d, 12), worth)


@query("ext_event_windows", "SELECT TIME_BUCKET(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY ALL", prefix=False)
def _(s, d):
    return arrivals.event_windows(ledger.read(s, d, "events"))


@query("ext_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM n GROUP BY user_id, k""", prefix=False)
def _(s, d):
    return arrivals.sessions(ledger.read(s, d, "events"))


from tallyforge.plans import stored  # noqa: E402, F401 - registers its queries
