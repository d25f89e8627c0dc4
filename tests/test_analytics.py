from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillframe.operators import analytics, churn, forecast, smoothing

KPI = "product_id string, product_name string, category string, revenue double, margin double, quantity long, avg_rating double, reviews long, positive long, negative long, neutral long"


def kpi(spark, data):
    return spark.createDataFrame(
        [(p, p, "Divers", rev, rev / 4, qty, note, n, n, neg, 0) for p, rev, qty, note, n, neg in data], KPI
    )


def test_summary_skips_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.01, None), (None, None)], "a double, b double")
    got = [tuple(r) for r in analytics.column_summary(df, ["a", "b"]).collect()]
    assert got == [("a", 1.0, 4.01, 2.34, 2.0)]


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.correlation for r in analytics.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1], abs=1e-3)
    assert got["a", "a"] == 1.0 and got["a", "c"] is None
    with pytest.raises(ValueError):
        analytics.correlation_matrix(df, ["a"])


def test_trend_fills_missing_months(spark):
    df = spark.createDataFrame(
        [(datetime(2023, 1, 5), 10.0), (datetime(2023, 1, 31, 23), 5.0), (datetime(2023, 4, 1), 1.0)], "invoice_ts timestamp_ntz, revenue double"
    ).withColumn("revenue", F.col("revenue").cast("decimal(12,2)"))
    got = [(r.month_end, r.revenue) for r in analytics.monthly_trend(df).collect()]
    assert got == [(datetime(2023, 1, 31), 15.0), (datetime(2023, 2, 28), 0.0), (datetime(2023, 3, 31), 0.0), (datetime(2023, 4, 30), 1.0)]
    assert analytics.monthly_trend(df.limit(0)).count() == 0


CUSTOMERS = "customer_id string, name string, orders long, revenue double, avg_rating double"


def test_segments(spark):
    data = [("a", "A", 1, 10.0, 1.0), ("b", "B", 1, 20.0, 5.0), ("c", "C", 1, 30.0, 2.0), ("d", "D", 1, 40.0, 4.0), ("e", "E", 1, None, 4.0)]
    segments = analytics.customer_segments(spark.createDataFrame(data, CUSTOMERS))
    assert {r.customer_id: r.segment for r in segments.collect()} == {
        "a": "Inactifs", "b": "Fans Peu Dépensiers", "c": "Déçus Rentables", "d": "Champions",
    }
    one = analytics.segment_profile(analytics.customer_segments(spark.createDataFrame(data[:1], CUSTOMERS)))
    got = {r.segment: (r.customers, r.top_customers) for r in one.collect()}
    assert got == {"Champions": (1, "A"), "Déçus Rentables": (0, ""), "Fans Peu Dépensiers": (0, ""), "Inactifs": (0, "")}


def test_rfm_matches_quantile_cut(spark):
    rng = np.random.default_rng(3)
    orders, money = rng.permutation(50) + 1, rng.permutation(50) * 10.0
    data = [(str(i), str(i), int(o), float(m), 4.0) for i, (o, m) in enumerate(zip(orders, money))]
    got = {r.customer_id: r for r in analytics.rfm_scores(spark.createDataFrame(data, CUSTOMERS)).collect()}
    f = pd.qcut(pd.Series(orders), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    m = pd.qcut(pd.Series(money), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    for i in range(50):
        assert (got[str(i)].f_score, got[str(i)].m_score) == (f[i], m[i])


def test_rfm_with_collapsing_edges(spark):
    data = [(str(i), str(i), 1 if i < 18 else i, float(i), 4.0) for i in range(20)]
    got = {r.customer_id: r.f_score for r in analytics.rfm_scores(spark.createDataFrame(data, CUSTOMERS)).collect()}
    assert got["0"] == 1 and got["17"] == 1 and got["19"] >= got["18"] >= 1


def test_product_score_ranks_ties_at_their_mean(spark):
    data = [("a", 10.0, 1, 3.0, 1, 0), ("b", 10.0, 1, 3.0, 1, 0), ("c", 0.0, 1, 1.0, 1, 0), ("d", 99.0, 9, 5.0, 0, 0)]
    got = {r.product_id: (r.score, r.rank) for r in analytics.product_score(kpi(spark, data)).collect()}
    # constant columns count as 0.5, unreviewed products are left out
    assert got == {"a": (0.85, 1), "b": (0.85, 1), "c": (0.15, 3)}


def test_rank_equals_average_rank(spark):
    rng = np.random.default_rng(1)
    data = [(f"p{i:03d}", float(rng.integers(0, 4)), 1, float(rng.integers(1, 3)), 1, 0) for i in range(60)]
    got = pd.DataFrame([r.asDict() for r in analytics.product_score(kpi(spark, data)).collect()])
    want = got["score"].rank(ascending=False).astype(int)
    assert (got["rank"] == want).all()


def test_radar(spark):
    got = {r.product_id: r for r in analytics.radar_metrics(kpi(spark, [("a", 10.0, 0, 4.0, 2, 0), ("b", 4.0, 0, None, 1, 0)])).collect()}
    assert got["a"].revenue == 1.0 and got["b"].revenue == 0.4 and got["a"].quantity == 0.0 and got["b"].avg_rating is None


def test_clusters(spark):
    data = [(str(i), float(i % 2) * 100 + i * 0.01, float(i % 2)) for i in range(60)]
    clusters = analytics.Clusters(spark.createDataFrame(data, "id string, a double, b double"), "id", ["a", "b"], k=3)
    assert {r.cluster for r in clusters.labelled.select("cluster").distinct().collect()} == {0, 1, 2}
    labelled = clusters.labelled.collect()
    assert len(labelled) == 60 and len({r.id for r in labelled}) == 60
    # points of the two far groups never share a cluster
    sides = {}
    for r in labelled:
        sides.setdefault(r.cluster, set()).add(int(r.id) % 2)
    assert all(len(s) == 1 for s in sides.values())
    assert clusters.profile().agg(F.sum("rows")).first()[0] == 60
    assert {r.column for r in clusters.importance().collect()} == {"a", "b"}


@pytest.mark.parametrize("rows, k", [(4, 0), (5, 2), (59, 2), (60, 3), (79, 3), (80, 4), (400, 4)])
def test_number_of_clusters_follows_the_rows(spark, rows, k):
    data = [(str(i), float(i * 37 % 101), float(i % 7)) for i in range(rows)]
    clusters = analytics.Clusters(spark.createDataFrame(data, "id string, a double, b double"), "id", ["a", "b"])
    labels = {r.cluster for r in clusters.labelled.collect()}
    assert clusters.k == k and labels == (set(range(k)) if k else {None})
    assert clusters.profile().agg(F.sum("rows")).first()[0] == rows and clusters.importance().count() == (2 if k else 0)


# --- churn ------------------------------------------------------------------------------


def history(spark, count):
    day = datetime(2023, 1, 1)
    lines = []
    for i in range(count):
        lines.append((f"I{i}", f"c{i}", "10.00", day + timedelta(days=i * 5, hours=i % 24)))
        lines.append((f"J{i}", f"c{i}", "5.50", day + timedelta(days=i * 5 + 1)))
        lines.append((f"J{i}", f"c{i}", "1.00", day + timedelta(days=i * 5 + 1)))
    sales = spark.createDataFrame(lines, "invoice_no string, customer_id string, r string, invoice_ts timestamp_ntz")
    sales = sales.withColumn("revenue", F.col("r").cast("decimal(12,2)"))
    customers = sales.select("customer_id").distinct().withColumn("country", F.lit("UK"))
    return customers, sales


def test_rfm_base(spark):
    base = {r.customer_id: r for r in churn.customer_rfm_base(*history(spark, 12)).collect()}
    assert base["c0"].frequency == 2 and base["c0"].monetary == 16.5 and base["c0"].relation_days == 1
    # elapsed whole days: c11 ordered last on day 56 at midnight
    assert base["c11"].recency_days == 0 and base["c0"].recency_days == 55
    assert base["c5"].relation_days == 1  # 19 hours count as no day, and then as at least one


def test_churn_labels(spark):
    base = churn.customer_rfm_base(*history(spark, 40))
    labels = churn.churn_labels(base).collect()
    days = np.array([r.recency_days for r in labels])
    limit = max(30, int(np.quantile(days, 0.7)))
    assert {r.threshold_days for r in labels} == {limit}
    assert all(r.churned == int(r.recency_days > limit) for r in labels)
    rate = churn.churn_rate(churn.churn_labels(base)).first()
    assert rate.customers == 40 and rate.churned == int((days > limit).sum())
    few = churn.churn_labels(churn.customer_rfm_base(*history(spark, 9))).collect()
    assert [(r.status, r.churned, r.threshold_days) for r in few] == [("too few customers", None, None)] * 9
    assert churn.churn_labels(churn.customer_rfm_base(*history(spark, 9)), min_customers=5).where("status = 'ok'").count() == 9
    assert {r.status for r in labels} == {"ok"}
    hist = churn.recency_histogram(base).collect()
    assert sum(r.customers for r in hist) == 40 and {r.bin for r in hist} <= set(range(1, 31))


def test_churn_model(spark):
    model = churn.ChurnModel(churn.churn_labels(churn.customer_rfm_base(*history(spark, 80))), trees=10)
    risk = model.risk().collect()
    assert len(risk) == 80 and all(0 <= r.churn_probability <= 1 for r in risk)
    for r in risk:
        p = r.churn_probability
        assert r.risk == (None if p <= 0 else "Faible" if p <= 0.33 else "Moyen" if p <= 0.66 else "Élevé")
    assert sum(r.importance for r in model.importance().collect()) == pytest.approx(1.0)
    assert sum(r["rows"] for r in model.quality().collect()) == 80
    top = model.top_risk(5).collect()
    assert len(top) <= 5 and all(r.risk == "Élevé" for r in top)
    assert sum(r.customers for r in model.histogram().collect()) == 80
    one = churn.churn_labels(churn.customer_rfm_base(*history(spark, 40))).withColumn("churned", F.lit(0).cast("long"))
    with pytest.raises(ValueError):
        churn.ChurnModel(one)


# --- forecasts ---------------------------------------------------------------------------


def series(spark, **values):
    data = [
        (name, (datetime(2020, 1, 1) + pd.DateOffset(months=i)).to_pydatetime(), float(v))
        for name, ys in values.items()
        for i, v in enumerate(ys)
    ]
    return spark.createDataFrame(data, "series string, month timestamp_ntz, value double")


def test_linear_forecast_continues_a_line(spark):
    df = series(spark, line=[10, 12, 14, 16], short=[1, 2])
    got = [(r.series, r.month, r.forecast, r.status) for r in forecast.linear_forecast(df, 2).orderBy("month").collect()]
    short = [("short", None, None, "too few months")]
    assert got == short + [("line", datetime(2020, 5, 1), 18.0, "ok"), ("line", datetime(2020, 6, 1), 20.0, "ok")]
    assert forecast.linear_forecast(df, 2, min_months=2).where("status <> 'ok'").count() == 0


def plain_holt(y):
    best = None
    for a in forecast.STEPS:
        for b in forecast.STEPS:
            level, trend, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                e = level + trend
                new = a * v + (1 - a) * e
                trend = b * (new - level) + (1 - b) * trend
                level = new
                sse += (v - e) ** 2
            if best is None or (sse, a, b) < best[:3]:
                best = (sse, a, b, level, trend)
    return best


def test_holt_equals_a_plain_search(spark):
    rng = np.random.default_rng(4)
    values = {"x": list(rng.random(20) * 100), "y": list(np.arange(15) * 3.0 + rng.random(15)), "tiny": [1.0, 2.0]}
    got = {(r.series, r.month): r for r in forecast.holt_forecast(series(spark, **values), 2).collect()}
    assert {k[0] for k in got} == {"x", "y", "tiny"} and got["tiny", None].status == "too few months"
    for name in ("x", "y"):
        sse, a, b, level, trend = plain_holt(values[name])
        last = datetime(2020, 1, 1) + pd.DateOffset(months=len(values[name]) - 1)
        for h in (1, 2):
            r = got[name, (last + pd.DateOffset(months=h)).to_pydatetime()]
            half = 1.96 * np.sqrt(sse / len(values[name]))
            assert (r.alpha, r.beta) == (a, b)
            assert r.forecast == pytest.approx(level + h * trend, abs=0.01)
            assert r.lower == pytest.approx(max(level + h * trend - half, 0), abs=0.01)
            assert r.upper == pytest.approx(level + h * trend + half, abs=0.01)


def test_seasonal_forecast(spark):
    season = np.array([0, 5, 9, 4, -3, -8, -2, 6, 12, 3, -9, -17.0])
    months = np.arange(48)
    values = {
        "add": list(200 + 2.0 * months + season[months % 12]),
        "mul": list((100 + months[:20]) * (1 + season[months[:20] % 12] / 50)),
        "flat": [5.0] * 6,
        "zero": [0.0] * 14,
        "tiny": [1.0, 2.0],
    }
    got = {}
    for r in forecast.holt_winters_forecast(series(spark, **values), 3).orderBy("month").collect():
        got.setdefault(r.series, []).append(r)
    assert [r.status for r in got.pop("tiny")] == ["too few months"]
    assert set(got) == {"add", "mul", "flat", "zero"} and all(len(v) == 3 for v in got.values())
    assert got["add"][0].model == "trend + additive season" and got["mul"][0].model == "trend * multiplicative season"
    # a multiplicative season needs positive values
    assert got["zero"][0].model == "trend" and got["flat"][0].forecast == 5.0
    for h, r in enumerate(got["add"]):
        assert r.forecast == pytest.approx(200 + 2.0 * (48 + h) + season[h % 12], abs=3)
        assert 0 <= r.lower <= r.forecast <= r.upper


def test_search_is_never_worse_than_the_grid():
    rng = np.random.default_rng(6)
    for months, trend, season in ((5, True, None), (9, False, None), (30, True, "add"), (17, True, "mul")):
        y = 50 + np.cumsum(rng.normal(0, 5, (8, months)), axis=1) + 10 * np.sin(np.arange(months))
        y = np.maximum(y, 1.0)
        weights, error, converged = smoothing.fit(y, trend, season)
        assert converged.all() and (weights >= 0).all() and (weights <= 1).all()
        for row, w, e in zip(y, weights, error):
            on_grid, _ = forecast._smooth(row, trend, season, 1)
            assert e <= on_grid * (1 + 1e-9)
            again, ahead = smoothing.smooth(row[None], w[None, None], trend, season, 3)
            assert again[0, 0] == pytest.approx(e)
            near = np.clip(w + rng.normal(0, 1e-3, (200, 3)) * [1, trend, season is not None], 0, 1)
            assert smoothing.smooth(row[None], near[None], trend, season)[0].min() >= e * (1 - 1e-5)  # a minimum


def test_smoothing_equals_one_series_at_a_time():
    rng = np.random.default_rng(7)
    y = 20 + rng.random((3, 14)) * 5
    w = np.array([[0.3, 0.1, 0.5]])
    errors, ahead = smoothing.smooth(y, w[None], True, "mul", 2)
    for k in range(3):
        e, a = smoothing.smooth(y[k : k + 1], w[None], True, "mul", 2)
        assert e[0, 0] == errors[k, 0] and (a[0, 0] == ahead[k, 0]).all()
    one, _ = smoothing.smooth(y[:1, :6], np.array([[[0.4, 0.2, 0.0]]]), True, None)
    level, trend, sse = y[0, 0], y[0, 1] - y[0, 0], 0.0
    for v in y[0, 1:6]:
        expected = level + trend
        new = 0.4 * v + 0.6 * expected
        trend, level, sse = 0.2 * (new - level) + 0.8 * trend, new, sse + (v - expected) ** 2
    assert one[0, 0] == pytest.approx(sse)


def test_smoothing_takes_many_series_at_a_time(spark, monkeypatch):
    """Batches of Arrow are gathered, short series come with them, and nothing depends on what is smoothed together."""
    frames = [pd.DataFrame({"series": [str(k)], "values": [[1.0]]}) for k in range(7)]
    assert [len(f) for f in smoothing._gathered(iter(frames), 3)] == [3, 3, 1]
    rng = np.random.default_rng(5)
    y = 20 + rng.random((9, 26)).cumsum(1)
    whole = smoothing.fit(y, True, "add")
    monkeypatch.setattr(smoothing, "CELLS", 1)
    assert all((a == b).all() for a, b in zip(whole, smoothing.fit(y, True, "add")))
    months = pd.date_range("2020-01-01", periods=26, freq="MS")
    rows = [(f"s{k}", months[i].to_pydatetime(), float(v)) for k, line in enumerate(y) for i, v in enumerate(line[: 26 if k else 2])]
    series = spark.createDataFrame(rows, "series string, month timestamp_ntz, value double")
    plan = smoothing.smoothing_forecast(series)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Union" not in plan
    got = smoothing.smoothing_forecast(series).collect()
    assert {r.series for r in got if r.status == "ok"} == {f"s{k}" for k in range(1, 9)}
    (short,) = [r for r in got if r.series == "s0"]
    assert short.status != "ok" and all(short[c] is None for c in ("month", "model", "forecast", "lower", "upper"))


def test_cascade_ends_in_a_line(spark, monkeypatch):
    season = np.array([0, 5, 9, 4, -3, -8, -2, 6, 12, 3, -9, -17.0])
    months = np.arange(48)
    values = {
        "add": list(200 + 2.0 * months + season[months % 12]), "mul": list((100 + months[:20]) * (1 + season[months[:20] % 12] / 50)),
        "flat": [5.0] * 6, "zero": [0.0] * 14, "tiny": [1.0, 2.0], "line": [10.0, 12.0, 14.0, 16.0],
    }
    df = series(spark, **values)
    got = {}
    for r in smoothing.smoothing_forecast(df, 3).orderBy("month").collect():
        got.setdefault(r.series, []).append(r)
    assert [(r.status, r.month, r.forecast) for r in got.pop("tiny")] == [("too few months", None, None)]
    assert {k: v[0].model for k, v in got.items()} == {
        "add": "trend + additive season", "mul": "trend * multiplicative season", "flat": "trend", "zero": "trend", "line": "trend"
    }
    for h, r in enumerate(got["add"]):
        assert r.forecast == pytest.approx(200 + 2.0 * (48 + h) + season[h % 12], abs=3) and 0 <= r.lower <= r.forecast <= r.upper
    assert [r.forecast for r in got["line"]] == [18.0, 20.0, 22.0]
    assert got["line"][0].month == datetime(2020, 5, 1)
    weights, error, converged = smoothing.fit(np.random.default_rng(1).random((2, 9)), True, None)
    assert converged.all()
    monkeypatch.setattr(smoothing, "ROUNDS", 1)  # no search comes to rest
    model, _, ahead = smoothing.fitted(np.array([[1.0, 2.0, 3.5, 4.0]]), 2)
    slope, start = np.polyfit(np.arange(4), [1.0, 2.0, 3.5, 4.0], 1)
    assert model.tolist() == ["line"] and ahead[0] == pytest.approx([start + 4 * slope, start + 5 * slope])
    assert smoothing.smoothing_forecast(df.where("series = 'none'")).count() == 0


def test_horizon_is_checked(spark):
    with pytest.raises(ValueError):
        forecast.linear_forecast(series(spark, a=[1, 2, 3]), 13)
