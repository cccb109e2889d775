"""Supervised models, their measures and forecasts on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableloom.functions.scalars import money_sum, rounded
from tableloom.operators import forecast, splits, supervised
from tableloom.plans.base import money, query, r, round_all, sql_day, day, table

_SCORED_SQL = "s as (select l_extendedprice as y, l_quantity * 2000 as p, (l_quantity > 25)::int as c, l_discount * 10 as score, (l_extendedprice > 45000)::int as label from lineitem)"


def _scored(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("c"),
        (F.col("l_discount") * 10).alias("score"), (F.col("l_extendedprice") > 45000).cast("int").alias("label"))


@query("regression_metrics", f"""
    with {_SCORED_SQL} select count(*) as n, {r('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 6)} as r2, {r('avg((y - p) ** 2)', 2)} as mse,
    {r('avg(abs(y - p))', 4)} as mae, {r('sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2))', 6)} as rmsle from s""")
def regression_metrics(spark, sf):
    out = supervised.regression_metrics(_scored(spark, sf), "y", "p")
    return round_all(round_all(round_all(out, 6, "r2", "rmsle"), 2, "mse"), 4, "mae")


@query("forecast_metrics", f"""
    with {_SCORED_SQL} select count(*) as n, {r('avg(abs((y - p) / y)) * 100', 4)} as mape, {r('sqrt(avg((y - p) ** 2))', 4)} as rmse,
    {r('avg(abs(y - p))', 4)} as mae from s""")
def forecast_metrics(spark, sf):
    return round_all(supervised.forecast_metrics(_scored(spark, sf), "y", "p"), 4)


@query("confusion_metrics", f"""
    with {_SCORED_SQL}, c as (select count(*) filter (label = 1 and c = 1) as tp, count(*) filter (label = 0 and c = 1) as fp,
      count(*) filter (label = 1 and c = 0) as fn, count(*) filter (label = 0 and c = 0) as tn from s)
    select tp, fp, fn, tn, {r('tp::double / (tp + fp)', 6)} as precision, {r('tp::double / (tp + fn)', 6)} as recall, {r('2.0::double * tp / (2 * tp + fp + fn)', 6)} as f1 from c""")
def confusion_metrics(spark, sf):
    return round_all(supervised.classification_metrics(_scored(spark, sf), "label", "c"), 6)


@query("auc_rank", f"""
    with {_SCORED_SQL}, g as (select y % 1000 as v, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from s group by 1),
    k as (select pos, neg, coalesce(sum(neg) over (order by v rows between unbounded preceding and 1 preceding), 0) as below from g)
    select {r('sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)::double)', 6)} as auc from k""")
def auc_rank(spark, sf):
    rows = _scored(spark, sf).select("label", (F.col("y") % 1000).alias("v"))
    return round_all(supervised.auc(rows, "label", "v"), 6)


_BUCKET = "(('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100)"


@query("records_info", f"""
    select split, count(*) as total, count(price) as used from (select case when {_BUCKET} < 70 then 'train' when {_BUCKET} < 90 then 'valid' else 'infer' end as split,
      case when o_orderpriority <> '5-LOW' then o_totalprice end as price from orders) group by 1""")
def records_info(spark, sf):
    rows = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
    return supervised.records_info(splits.split(rows, "o_orderkey", "random"), "split", ["price", "o_custkey"])


# --- training and scoring ---

ORDER_FEATURES = ("n_lines", "quantity", "discount", "tax", "priority")


def order_features(spark, sf) -> DataFrame:
    """One row per order with line totals, an urgency target and a random split."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("value"))
    orders = table(spark, sf, "orders").withColumn("priority", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    target = F.when(F.col("value") > 200000, 1).otherwise(0)
    rows = joined.select("o_orderkey", "o_orderdate", "o_totalprice", "n_lines", "quantity", "discount", "tax", "priority", "value", target.alias("target"))
    return splits.split(rows, "o_orderkey", "random")


@query("train_regressors")
def train_regressors(spark, sf):
    found = supervised.train(order_features(spark, sf), "value", "regression", ORDER_FEATURES)
    return supervised.rank_models(found.metrics, "regression")


@query("train_classifiers")
def train_classifiers(spark, sf):
    found = supervised.train(order_features(spark, sf), "target", "classification", ORDER_FEATURES)
    return supervised.rank_models(found.metrics, "classification")


@query("score_regression")
def score_regression(spark, sf):
    rows = order_features(spark, sf)
    found = supervised.train(rows, "value", "regression", ORDER_FEATURES, ["linear"])
    return supervised.score(rows.where("split = 'infer'"), found.models["linear"], "regression", ORDER_FEATURES)


@query("score_classification")
def score_classification(spark, sf):
    rows = order_features(spark, sf)
    found = supervised.train(rows, "target", "classification", ORDER_FEATURES, ["logistic"])
    return supervised.score(rows.where("split = 'infer'"), found.models["logistic"], "classification", ORDER_FEATURES)


# --- forecasting ---


@query("month_grid", """
    with s as (select o_custkey, date_trunc('month', min(o_orderdate)) as start from orders group by 1)
    select o_custkey, i::int as step, strftime(last_day(start + to_months(i::int)), '%Y-%m-%d') as date from s, range(6) t(i)""")
def month_grid(spark, sf):
    out = forecast.month_grid(table(spark, sf, "orders"), "o_orderdate", 9, ["o_custkey"])
    return out.withColumn("date", day("date"))


@query("exog_hold", """
    with f as (select o_custkey, o_totalprice, split_part(o_orderpriority, '-', 1)::double as priority, date_trunc('month', o_orderdate) as start from orders
               qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)
    select o_custkey, i::int as step, strftime(last_day(start + to_months(i::int)), '%Y-%m-%d') as date, o_totalprice, priority from f, range(3) t(i)""")
def exog_hold(spark, sf):
    rows = table(spark, sf, "orders").withColumn("priority", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    out = forecast.exog_hold(rows, "o_orderdate", ["o_totalprice", "priority"], ["o_orderkey"], "abc", ["o_custkey"])
    return out.withColumn("date", day("date"))


_SERIES_SQL = f"""m as (select c_nationkey as nation, strftime(o_orderdate, '%Y-%m') as month, (year(o_orderdate) * 12 + month(o_orderdate))::int as t,
    {money('o_totalprice')} as revenue from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"""


def nation_series(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return forecast.monthly_series(rows, "o_orderdate", "price", ["nation"], "revenue").withColumn("revenue", F.col("revenue").cast("double"))


@query("monthly_series", f"with {_SERIES_SQL} select nation, month, t, revenue from m")
def monthly_series(spark, sf):
    return nation_series(spark, sf)


@query("lag_features", f"""
    with {_SERIES_SQL} select m.nation, m.month, m.revenue, a.revenue as revenue_lag1, b.revenue as revenue_lag12
    from m left join m a on a.nation = m.nation and a.t = m.t - 1 left join m b on b.nation = m.nation and b.t = m.t - 12""")
def lag_features(spark, sf):
    return forecast.lag_features(nation_series(spark, sf), "revenue", [1, 12], ["nation"]).drop("t")


@query("forecast_trend_season", f"""
    with {_SERIES_SQL}, f as (select nation, regr_slope(revenue, (t - 23640)::double) as b, regr_intercept(revenue, (t - 23640)::double) as a, max(t) as last from m group by 1),
    s as (select m.nation, t % 12 as moy, avg(revenue - (a + b * (t - 23640))) as season from m join f using (nation) group by 1, 2),
    g as (select nation, a, b, i::int as step, last + i as t from f, range(1, 4) x(i))
    select g.nation, step, strftime(last_day(make_date(((t - 1) // 12)::int, ((t - 1) % 12 + 1)::int, 1)), '%Y-%m-%d') as date,
           {r('a + b * (t - 23640) + coalesce(season, 0)', 2)} as "Predicted revenue"
    from g left join s on s.nation = g.nation and s.moy = g.t % 12""")
def forecast_trend_season(spark, sf):
    out = forecast.forecast_trend_season(nation_series(spark, sf), "revenue", ["nation"])
    return round_all(out, 2).withColumn("date", day("date"))


_TREND_SQL = f"""{_SERIES_SQL}, f as (select nation, regr_slope(revenue, (t - 23640)::double) as b, regr_intercept(revenue, (t - 23640)::double) as a, max(t) as last from m group by 1),
    s as (select m.nation, t % 12 as moy, avg(revenue - (a + b * (t - 23640))) as season from m join f using (nation) group by 1, 2),
    g as (select nation, a, b, i::int as step, last + i as t from f, range(1, 4) x(i)),
    p as (select g.nation, last_day(make_date(((t - 1) // 12)::int, ((t - 1) % 12 + 1)::int, 1)) as date, a + b * (t - 23640) + coalesce(season, 0) as p from g left join s on s.nation = g.nation and s.moy = g.t % 12)"""


@query("forecast_table", f"""
    with {_TREND_SQL} select nation, 'trend_season' as model, strftime(min(date), '%Y-%m-%d') as period_from, strftime(max(date), '%Y-%m-%d') as period_to, count(*) as periods,
      {r('sum(p)', 2)} as total, {r('avg(p)', 2)} as mean from p group by 1""")
def forecast_table(spark, sf):
    made = forecast.forecast_trend_season(nation_series(spark, sf), "revenue", ["nation"])
    out = forecast.forecast_table(made, "revenue", ["nation"], "trend_season")
    return round_all(out, 2).withColumns({c: day(c) for c in ("period_from", "period_to")})


# Two lags: the normal equations in closed form, then month after month.
@query("forecast_ar", f"""
    with recursive {_SERIES_SQL}, x as (select a.nation, a.revenue as y, b.revenue as l1, c.revenue as l12 from m a
      join m b on b.nation = a.nation and b.t = a.t - 1 join m c on c.nation = a.nation and c.t = a.t - 12),
    f as (select nation, var_pop(l1) as s11, var_pop(l12) as s22, covar_pop(l1, l12) as s12, covar_pop(y, l1) as s1, covar_pop(y, l12) as s2, avg(y) as my, avg(l1) as m1, avg(l12) as m2 from x group by 1),
    c as (select nation, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) as b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) as b2, my, m1, m2 from f),
    ahead(nation, step, t, p) as (
      select nation, 0, max(t), arg_max(revenue, t) from m group by 1
      union all select a.nation, a.step + 1, a.t + 1, c.my + c.b1 * (a.p - c.m1) + c.b2 * (m.revenue - c.m2)
      from ahead a join c on c.nation = a.nation join m on m.nation = a.nation and m.t = a.t + 1 - 12 where a.step < 6)
    select nation, step, strftime(last_day(make_date(((t - 1) // 12)::int, ((t - 1) % 12 + 1)::int, 1)), '%Y-%m-%d') as date, {r('p', 2)} as "Predicted revenue" from ahead where step > 0""")
def forecast_ar(spark, sf):
    return round_all(forecast.forecast_ar(nation_series(spark, sf), "revenue", ["nation"], periods=6), 2).withColumn("date", day("date"))
