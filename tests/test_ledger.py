"""Hand-made ledgers with known answers."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import periods
from tallyforge.operators import advisor, anomalies, budgets, debt, forecast, net_worth, spending


def transactions(spark, rows):
    """(id, date, amount, account, merchant, category id, pattern)"""
    made = [(i, date.fromisoformat(d), D(a), acct, m, c, p) for i, d, a, acct, m, c, p in rows]
    return spark.createDataFrame(made, "id string, date date, amount decimal(18,2), account_id string, merchant_id string, category_id int, pattern_id string")


def monthly(spark, amounts, start="2024_11", merchant="x", category=1, account="a"):
    months = [start, *periods.following(start, len(amounts) - 1)]
    return transactions(spark, [(f"t{i}", f"{m.replace('_', '-')}-15", a, account, merchant, category, None) for i, (m, a) in enumerate(zip(months, amounts, strict=True))])


def test_spending(spark):
    t = transactions(spark, [("1", "2025-04-01", "-25", "a", "tesco", 1, None), ("2", "2025-04-30", "-50", "a", "tesco", 1, None), ("3", "2025-04-02", "-30", "a", "sains", 1, None), ("4", "2025-04-02", "-4.50", "a", "costa", 3, None), ("5", "2025-04-02", "-100", "a", "amazon", 8, None), ("6", "2025-03-31", "-1000", "b", "tesco", 1, None)])
    m = spark.createDataFrame([(x, x.title()) for x in ("tesco", "sains", "costa", "amazon")], "id string, canonical_name string")
    c = schemas.seed_categories(spark)
    assert spending.category_totals(t, c, "2025_04").first()[:2] == ("groceries", D("105.00"))
    assert [r.merchant_id for r in spending.merchant_totals(t, m, "2025-04", 2).collect()] == ["amazon", "tesco"]
    assert spending.merchant_totals(t, m, "2025_04", None).count() == 4
    assert [tuple(r) for r in spending.account_delta(t, "2025_04").collect()] == [("a", D("-209.50"))]


def test_periods():
    assert periods.window("2024_02")[1].day == 29 and periods.window("2025-02")[1].day == 28 and periods.window("2025_04")[1].day == 30
    for bad in ("April 2025", "2025_13", "2025_00", "202504"):
        with pytest.raises(ValueError):
            periods.window(bad)
    assert periods.following("2025_11", 3) == ["2025_12", "2026_01", "2026_02"]
    assert periods.between("2024_11", "2025_02") == ["2024_11", "2024_12", "2025_01", "2025_02"]
    assert periods.previous("2025_01") == "2024_12"


def test_drift(spark):
    t = transactions(spark, [("ok", "2025-04-01", "-11.99", "a", "netflix", 4, "p"), ("drift", "2025-04-02", "-14.99", "a", "netflix", 4, "p")])
    p = spark.createDataFrame([("p", "netflix", D("11.99"))], "id string, merchant_id string, expected_amount decimal(12,2)")
    (found,) = anomalies.subscription_drift(t, p, "2025_04").collect()
    assert found.transaction_id == "drift" and 0.24 < found.delta_pct < 0.26
    assert anomalies.subscription_drift(t, p, "2025_04", 0.3).count() == 0


def test_outlier_of_a_flat_history(spark):
    t = monthly(spark, ["-100"] * 6 + ["-500"], "2024_10")
    (found,) = anomalies.merchant_outliers(t, "2025_04").collect()
    assert (found.this_total, found.mean, found.z_score) == (D("500.00"), 100.0, 999.0)
    assert anomalies.merchant_outliers(monthly(spark, ["-100"] * 7, "2024_10"), "2025_04").count() == 0


def test_recurring_and_links(spark):
    t = monthly(spark, ["-10.99"] * 3, "2026_01", "netflix")
    (found,) = anomalies.recurring(t).collect()
    assert (found.merchant_id, found.cadence, found.expected_amount, found.confidence) == ("netflix", "monthly", D("10.99"), 0.8)
    p = spark.createDataFrame([("sub", "netflix", D("10.99"))], "id string, merchant_id string, expected_amount decimal(12,2)")
    once = anomalies.link_patterns(t, p)
    assert {r.pattern_id for r in once.collect()} == {"sub"}
    assert sorted(once.collect()) == sorted(anomalies.link_patterns(once, p).select(once.columns).collect())
    assert anomalies.recurring(t.where("merchant_id is null")).count() == 0


def test_budgets(spark):
    t = transactions(spark, [("1", "2025-04-01", "-100", "a", "tesco", 1, None), ("2", "2025-04-02", "-50", "a", "tesco", 3, None)])
    rows = [("under", "2025_04", "category", "groceries", "200"), ("over", "2025_04", "category", "dining", "40"), ("year", "annual:2025", "category", "groceries", "1200"), ("shop", "2025_04", "merchant", "tesco", "100")]
    b = spark.createDataFrame([(*r[:4], D(r[4])) for r in rows], "id string, period string, scope_type string, scope_id string, target_amount decimal(12,2)")
    got = {r.id: r for r in budgets.budget_variance(b, budgets.actuals(t, schemas.seed_categories(spark), "2025_04"), "2025_04").collect()}
    assert (got["under"].delta, got["under"].status) == (D("-100.00"), "under")
    assert (got["over"].delta, got["over"].status) == (D("10.00"), "over")
    assert (got["year"].target, got["year"].status) == (D("100.00"), "on_track")
    assert got["shop"].status == "over"


def test_goals(spark):
    save = monthly(spark, ["500"] * 4, "2025_01", account="s").withColumn("category", F.lit("x"))
    eat = monthly(spark, ["-25", "-30", "-20", "-15"], "2025_01").withColumn("category", F.lit("dining"))
    rows = [("g1", "8000", "2026-04-30", "savings_account", "s"), ("g2", "12000", "2026-04-30", "savings_account", "s"), ("g3", "4000", "2026-04-30", "savings_account", "s"), ("g4", "500", "2026-04-30", "savings_account", "s"), ("g5", "200", "2025-12-31", "category_underspend", "dining")]
    g = spark.createDataFrame([(i, i, D(t), date.fromisoformat(d), s, x, "active", date(2025, 1, 1)) for i, t, d, s, x in rows], "id string, name string, target_amount decimal(18,2), target_date date, scope_type string, scope_id string, status string, started_at date")
    got = {r.id: r for r in budgets.active_goal_progress(g, save.unionByName(eat), "2025_04").collect()}
    assert (got["g1"].progress, got["g1"].months_total, got["g1"].months_elapsed, got["g1"].current) == ("on_track", 16, 4, D("2000.00"))
    assert (got["g2"].progress, got["g2"].monthly_required) == ("behind", D("833.33"))
    assert (got["g3"].progress, got["g4"].progress) == ("ahead", "achieved")
    assert got["g5"].current == D("110.00")


def test_net_worth(spark):
    t = monthly(spark, ["500"] * 4, "2025_01", account="s").unionByName(monthly(spark, ["-100"] * 4, "2025_01", account="c"))
    accounts = spark.createDataFrame([("s",), ("c",), ("idle",)], "id string")
    rows = net_worth.snapshot(t, accounts, "2025_04")
    assert {r.account_id: r.position for r in rows.collect()} == {"s": D("2000.00"), "c": D("-400.00"), "idle": D("0.00")}
    stored = spark.createDataFrame([("2025_03", D("1200"))], "period string, total_amount decimal(18,2)")
    now = net_worth.snapshot_totals(rows)
    assert [tuple(r) for r in now.collect()] == [("2025_04", D("1600.00"), 3)]
    (d,) = net_worth.month_over_month(now, stored).collect()
    assert (d.delta, round(d.delta_pct, 3)) == (D("400.00"), 0.333)
    (n,) = net_worth.month_over_month(now, stored.limit(0)).collect()
    assert n.previous is None and n.delta is None and n.delta_pct is None


@pytest.mark.parametrize(
    ("values", "method", "first"),
    [([100.0] * 5, "linear", 100.0), ([100.0, 110, 120, 130], "linear", 140.0), ([50.0], "mean", 50.0), ([], "mean", 0.0), ([100.0, 50, 0], "linear", 0.0), ([float(x) for x in range(1, 25)], "seasonal_naive", 13.0), ([100.0, 110, 120, 125, 130, 140], "holt", None)],
)
def test_forecasts(spark, values, method, first):
    s = spark.createDataFrame([("c", [float(v) for v in values])], "category string, values array<double>")
    row = forecast.forecast(s, "2025_04").first()
    assert row.method == method and row.periods == ["2025_05", "2025_06", "2025_07"] and len(row.forecast) == 3
    if first is not None:
        assert row.forecast[0] == first
    else:
        level, trend, sse = values[0], values[1] - values[0], 0.0
        for t, y in enumerate(values[1:]):
            fit = level + trend
            sse += (y - fit) ** 2 if t else 0.0
            new = 0.5 * y + 0.5 * fit
            level, trend = new, 0.2 * (new - level) + 0.8 * trend
        assert abs(row.forecast[2] - (level + 3 * trend)) < 1e-6 and abs(row.rmse - (sse / 5) ** 0.5) < 1e-6
        assert abs(row.monthly_average - 120.833333) < 1e-6


def test_gaps_are_zero(spark):
    h = spark.createDataFrame([("c", "2025_01", D("5")), ("c", "2025_03", D("7"))], "category string, period string, total decimal(18,2)")
    assert forecast.monthly_series(h, "category", "2025_04", 4).first()["values"] == [5.0, 0.0, 7.0, 0.0]


def test_debt(spark):
    rows = [("a", "1200", "0", "100"), ("b", "2400", "0.199", "75"), ("c", "10000", "0.24", "100")]
    loans = spark.createDataFrame([(i, D(o), D(r), D(p)) for i, o, r, p in rows], "id string, outstanding decimal(18,2), apr decimal(10,6), payment decimal(18,2)")
    got = {r.id: r for r in debt.payoff(loans).collect()}
    assert got["a"].months == 12 and 40 < got["b"].months < 60 and 500 < got["b"].total_interest < 2000 and got["c"].months == -1
    pay = loans.select("id", debt.recommended_payment(F.col("outstanding"), F.col("apr"), F.lit(12)).alias("p"))
    assert {r.id: r.p for r in pay.collect()}["a"] == D("100.00")
    with pytest.raises(Exception, match="months must be positive"):
        loans.select(debt.recommended_payment(F.col("outstanding"), F.col("apr"), F.lit(0))).collect()


def test_schedule_against_decimals(spark):
    import decimal

    loans = spark.createDataFrame([("x", D("5231.77"), D("0.1999"), D("181.3"))], "id string, outstanding decimal(18,2), apr decimal(10,6), payment decimal(18,2)")
    left, rate, want = D("5231.77"), D("0.1999") / 12, []
    while left > D("0.01"):
        interest = (left * rate).quantize(D("0.01"), decimal.ROUND_HALF_EVEN)
        principal = min(D("181.30") - interest, left)
        left -= principal
        want.append((len(want) + 1, interest, principal, left))
    got = [(r.month, r.interest, r.principal, r.balance) for r in debt.amortisation(loans).orderBy("month").collect()]
    assert got == want


def test_advisor(spark):
    cards = spark.createDataFrame([("s1", "card", D("2400"), D("0.199"), D("75")), ("s2", "low", D("2400"), D("0.05"), D("75")), ("s3", "never", D("10000"), D("0.24"), D("100"))], "id string, account_id string, outstanding decimal(18,2), apr decimal(10,6), min_payment decimal(18,2)")
    (r,) = advisor.credit_payoff_accelerate(cards).collect()
    assert r.citations == ["card", "s1"]
    snaps = spark.createDataFrame([("2025_02", D("30")), ("2025_03", D("20")), ("2025_04", D("10")), ("2025_05", D("99"))], "period string, total_amount decimal(18,2)")
    fall = advisor.net_worth_decline(snaps, "2025_04")
    assert fall.count() == 1 and advisor.net_worth_decline(snaps, "2025_05").count() == 0
    one, two = (advisor.recommendations([fall], "2025_04").first().id for _ in range(2))
    assert one == two and one.startswith("rec_2025_04_") and len(one) == len("rec_2025_04_") + 8
    names = spark.createDataFrame([("m", "Other"), ("n", "Tesco")], "id string, canonical_name string")
    assert [r.id for r in advisor.flag_generic(names).collect()] == ["m"]


def test_new_ledger(spark):
    made = schemas.new_ledger(spark)
    assert len(made) == 11 and made["categories"].count() == 8 and made["transactions"].count() == 0


def test_schedules_of_many_loans(spark):
    """payoff walks a batch of loans by months; wide balances, halves of a cent, nulls and all 600 months come out as by decimals."""
    import decimal
    import random

    dice = random.Random(7)
    rows = [(k, D(dice.randrange(1, 10 ** dice.randrange(2, 9))) / 100, D(dice.randrange(0, 40)) / 100, D(dice.randrange(1, 90_000)) / 100) for k in range(300)]
    rows += [(300, D("9999999999999.99"), D("0.19"), D("170000000000.01")), (301, D("50000"), D("0.12"), D("500.01")), (302, D("0.01"), D("0"), D("1")), (303, D("3.00"), D("0.02"), D("1"))]
    loans = spark.createDataFrame([*rows, (304, None, D("0.1"), D("1")), (305, D("10"), None, D("1"))], "id long, outstanding decimal(18,2), apr decimal(10,6), payment decimal(18,2)")
    want, totals = set(), {304: (-1, D(0)), 305: (-1, D(0))}
    with decimal.localcontext(decimal.Context(prec=60)):
        for k, left, apr, pay in rows:
            rate, month, paid = (apr / 12).quantize(D("1e-16"), decimal.ROUND_HALF_UP), 0, D(0)
            while left * rate < pay and left > D("0.01") and month < 600:
                interest = (left * rate).quantize(D("0.01"), decimal.ROUND_HALF_EVEN)
                principal = min(pay - interest, left)
                left, month, paid = left - principal, month + 1, paid + interest
                want.add((k, month, interest + principal, interest, principal, left))
            totals[k] = (month or -1, paid)
    assert {tuple(r) for r in debt.amortisation(loans).collect()} == want
    assert {r.id: (r.months, r.total_interest) for r in debt.payoff(loans).collect()} == totals


def test_loans_of_one_file_are_dealt_to_tasks(spark):
    loans = spark.range(100).coalesce(1).select("id", F.lit(D("1200")).alias("outstanding"), F.lit(D("0.1")).alias("apr"), F.lit(D("100")).alias("payment"))
    assert debt.payoff(loans).select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert debt.amortisation(loans).select(F.spark_partition_id().alias("p")).distinct().count() == 4
