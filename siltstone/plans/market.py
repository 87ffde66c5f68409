"""Market analytics over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import market as symbols
from siltstone.operators import accuracy, timeseries, trading
from siltstone.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, day, total: a series for each type of event."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))


_DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY ALL)"
_NEWEST = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""
    WITH r AS (SELECT *, l_extendedprice AS p, l_quantity * p_retailprice AS a, l_quantity * 1000 AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in _NEWEST)}) AS rn FROM r WHERE a > 0)
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs((a - p) / a)), 5) AS mape, round(sqrt(avg((a - p) * (a - p))), 2) AS rmse,
           round(avg(CASE WHEN b > 0 THEN CASE WHEN sign(a - b) = sign(p - b) THEN 1 ELSE 0 END END), 5) AS hit_rate
    FROM m WHERE rn <= 30 GROUP BY ALL""")
def accuracy_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumns(accuracy.row_metrics(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), F.col("l_quantity") * 1000))
    grid = accuracy.accuracy_grid(rows, ["l_returnflag", "l_linestatus"], [F.desc_nulls_last(c) for c in _NEWEST], 30)
    return grid.select("l_returnflag", "l_linestatus", "n", F.round("mape", 5).alias("mape"), F.round("rmse", 2).alias("rmse"), F.round("hit_rate", 5).alias("hit_rate"))


@query("""
    SELECT o_orderkey, o_custkey AS custkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def evaluate_pending(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    real = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return accuracy.evaluate_pending(made, real, done, "o_orderkey", ["custkey"])


@query("""
    SELECT user_id, event_type, n_all, n_recent, round(mean_all, 4) AS mean_all, round(mean_recent, 4) AS mean_recent FROM (
        SELECT user_id, event_type, count(value) AS n_all, count(value) FILTER (ts >= TIMESTAMP '2024-01-23') AS n_recent,
               avg(value) AS mean_all, avg(value) FILTER (ts >= TIMESTAMP '2024-01-23') AS mean_recent FROM events GROUP BY ALL)
    WHERE n_all >= 5 AND n_recent >= 2 AND mean_all > 0 AND mean_recent / mean_all >= 1.2""")
def drift_ratio(spark, sf_dir):
    got = accuracy.drift(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", F.lit("2024-01-23").cast("timestamp_ntz"), min_all=5, min_recent=2, ratio=1.2)
    return got.withColumns({"mean_all": F.round("mean_all", 4), "mean_recent": F.round("mean_recent", 4)})


@query("""
    SELECT l.event_id, l.user_id, r.ts AS right_ts, round(l.value - r.value, 4) AS spread
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') r
      ON l.user_id = r.user_id AND l.ts >= r.ts
    WHERE epoch(l.ts) - epoch(r.ts) <= 86400""")
def asof_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    left = e.where("event_type = 'purchase'").drop("event_type")
    got = timeseries.asof_join(left, e.where("event_type = 'view'"), ["user_id"], "ts", "value", 86_400)
    return got.select("event_id", "user_id", "right_ts", F.round(F.col("value") - F.col("right_value"), 4).alias("spread"))


@query("""
    WITH d AS (SELECT l_returnflag AS f, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
    SELECT a.day, round(a.v / b.v, 5) AS ratio FROM d a JOIN d b ON a.day = b.day WHERE a.f = 'A' AND b.f = 'N' AND b.v <> 0""")
def ratio_join(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("v"))
    got = timeseries.ratio(d.where("l_returnflag = 'A'"), d.where("l_returnflag = 'N'"), ["day"], "v")
    return got.select("day", F.round("ratio", 5).alias("ratio"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, ts) AS last_value FROM events GROUP BY ALL")
def baseline_latest_in_day(spark, sf_dir):
    return timeseries.latest_in_day(table(spark, sf_dir, "events"), ["user_id"], "ts", "value")


def _grid(spark, sf_dir, mode):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey")
    made = orders.select("nation", "day", F.col("o_totalprice").alias("predicted"), F.col("o_orderkey").alias("made_at"))
    real = orders.groupBy("nation", "day").agg(F.count(F.lit(1)).alias("actual"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return accuracy.horizon_grid(nations, "nation", [1, 2, 3, 4, 5], made, real, F.lit("1998-06-15").cast("date"), mode)


def _grid_sql(day: str, target: str) -> str:
    return f"""
    WITH o AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, o_totalprice, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT nation, day, arg_max(o_totalprice, o_orderkey) AS predicted, count(*) AS actual FROM o GROUP BY ALL),
    g AS (SELECT n_nationkey AS nation, CAST(h AS INT) AS horizon, CAST({day} AS DATE) AS day, CAST({target} AS DATE) AS target_day FROM nation, range(1, 6) t(h))
    SELECT g.nation, horizon, g.day, target_day, p.predicted, r.actual FROM g
    LEFT JOIN p ON p.nation = g.nation AND p.day = g.day LEFT JOIN p r ON r.nation = g.nation AND r.day = g.target_day"""


@query(_grid_sql("DATE '1998-06-15' - CAST(h AS INT)", "DATE '1998-06-15'"))
def horizon_grid_target(spark, sf_dir):
    return _grid(spark, sf_dir, "target")


@query(_grid_sql("DATE '1998-06-15'", "DATE '1998-06-15' + CAST(h AS INT)"))
def horizon_grid_anchor(spark, sf_dir):
    return _grid(spark, sf_dir, "anchor")


@query("""
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS order_keys FROM orders GROUP BY o_custkey""")
def by_target_nest(spark, sf_dir):
    back = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey")
    nest = F.transform(F.array_sort(F.collect_list(back)), lambda x: x["o_orderkey"].cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(nest, ",").alias("order_keys"))


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'view', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 4")
def label_division(spark, sf_dir):
    wanted = ["click", "purchase", "view", "error"]
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(wanted))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where(F.col("n") == len(wanted)).select("user_id")


_RULES_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'deep_discount' AS rule, l_discount AS score FROM lineitem WHERE l_discount >= 0.08
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'bulk', l_quantity / 50 FROM lineitem WHERE l_quantity >= 40
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'returned', l_tax FROM lineitem WHERE l_returnflag = 'R'"""


def _signals(spark, sf_dir):
    rules = {
        "deep_discount": (F.col("l_discount") >= 0.08, F.col("l_discount")),
        "bulk": (F.col("l_quantity") >= 40, F.col("l_quantity") / 50),
        "returned": (F.col("l_returnflag") == "R", F.col("l_tax")),
    }
    return trading.fire_rules(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(_RULES_SQL)
def rules_engine(spark, sf_dir):
    return _signals(spark, sf_dir)


@query(f"SELECT rule, count(*) AS n, round(sum(score), 2) AS total, round(avg(score), 5) AS mean FROM ({_RULES_SQL}) GROUP BY rule")
def pnl_by_rule(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"), F.round(F.avg("score"), 5).alias("mean"))


@query("""
    SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS returned FROM lineitem""")
def pnl_summary(spark, sf_dir):
    back = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(back).alias("n_returned"), F.round(F.coalesce(F.sum(F.when(back, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("returned")
    )


@query("""
    WITH h AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS qty,
                      sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END * (l_extendedprice / l_quantity)) AS cost FROM lineitem GROUP BY l_partkey),
    v AS (SELECT *, coalesce(p_retailprice, abs(cost / qty)) * abs(qty) AS value FROM h LEFT JOIN part ON l_partkey = p_partkey WHERE qty <> 0)
    SELECT l_partkey, qty, round(value, 2) AS value, round(value - abs(cost), 2) AS unrealized, round(value / sum(value) OVER (), 7) AS pct,
           sum(value) OVER () >= 5000 AND count(*) OVER () >= 4 AND value / sum(value) OVER () > 0.05 AS flagged FROM v""")
def positions(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    trades = table(spark, sf_dir, "lineitem").select("l_partkey", signed.alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    quotes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("quote"))
    got = trading.positions(trades, "l_partkey", quotes)
    return got.select("l_partkey", "qty", F.round("value", 2).alias("value"), F.round("unrealized", 2).alias("unrealized"), F.round("pct", 7).alias("pct"), "flagged")


@query("""
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_open,
           count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_pending FROM orders GROUP BY ALL""")
def status_buckets(spark, sf_dir):
    return trading.bucket_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", {"done": ["F"], "open": ["O"]}, "pending")


@query("""
    SELECT CAST(d AS DATE) AS day, count(event_id) AS n, round(coalesce(sum(value), 0), 3) AS total
    FROM generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) t(d)
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def daily_gapfill(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("day", F.to_date("ts"))
    got = timeseries.gapfill_daily(e, "day", "2023-12-28", "2024-02-03", {"n": F.count("event_id"), "total": F.sum("value")})
    return got.select("day", "n", F.round("total", 3).alias("total"))


@query(f"""
    WITH {_DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM daily)
    SELECT event_type, count(*) AS n, round(coalesce(regr_slope(total, i), 0), 4) AS slope FROM i GROUP BY event_type""")
def slope_drift(spark, sf_dir):
    return trading.slope(daily(spark, sf_dir), ["event_type"], "day", "total").select("event_type", "n", F.round("slope", 4).alias("slope"))


@query("""
    WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_acted, count(*) FILTER (event_type = 'error') AS n_skipped FROM events GROUP BY user_id),
    r AS (SELECT *, n_acted / nullif(n_acted + n_skipped, 0) AS rate FROM g)
    SELECT user_id, n_acted, n_skipped, round(rate, 6) AS rate, CASE WHEN rate >= 0.30 THEN 'green' WHEN rate >= 0.15 THEN 'yellow' WHEN rate IS NOT NULL THEN 'red' ELSE 'unknown' END AS band FROM r""")
def action_rate_band(spark, sf_dir):
    got = trading.action_rate(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")
    return got.withColumn("rate", F.round("rate", 6))


@query("""
    WITH e AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000 AS age,
                      CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE 0 END AS w FROM events)
    SELECT user_id, count(*) AS n_items, round(sum(w * exp(-ln(2) * age / 7)), 4) AS attention FROM e WHERE age BETWEEN 0 AND 14 GROUP BY user_id""")
def attention_decay(spark, sf_dir):
    weights = {"purchase": 3.0, "signup": 2.0, "click": 1.0, "view": 0.5}
    got = trading.attention(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", weights, F.lit("2024-01-31").cast("timestamp_ntz"))
    return got.withColumn("attention", F.round("attention", 4))


@query(f"""
    WITH {_DAILY}, s AS (SELECT *, avg(total) OVER w AS sma, count(*) OVER w AS c, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS back
        FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT event_type, count(*) AS n_points, count(*) FILTER (back <= 2 AND c = 7 AND total < sma) = 2 AND count(*) >= 9 AS fired FROM s GROUP BY event_type""")
def sma_streak(spark, sf_dir):
    return timeseries.below_mean_streak(daily(spark, sf_dir), ["event_type"], "day", "total", 7, 2)


@query("""
    WITH d AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM events)
    SELECT user_id, count(*) FILTER (value > 20) = 3 AS fired FROM d WHERE back <= 3 GROUP BY user_id""")
def threshold_streak(spark, sf_dir):
    return timeseries.threshold_streak(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 20, 3)


@query(f"""
    WITH {_DAILY}, e AS (SELECT event_type, arg_min(total, day) AS a, arg_max(total, day) AS b FROM daily GROUP BY event_type)
    SELECT event_type, round(CASE WHEN a <> 0 THEN (b - a) / abs(a) * 100 END, 4) AS pct, coalesce(CASE WHEN a <> 0 THEN (b - a) / abs(a) * 100 END >= 5, false) AS fired FROM e""")
def change_pct(spark, sf_dir):
    got = timeseries.change_pct(daily(spark, sf_dir), ["event_type"], "day", "total", 5)
    return got.withColumn("pct", F.round("pct", 4))


@query(f"""
    WITH {_DAILY}, r AS (SELECT event_type, day, total, lag(total, 14) OVER w AS old, lag(total, 5) OVER w AS near FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)),
    s AS (SELECT event_type, day, CASE WHEN old <> 0 THEN 100 * total / old END AS rs, CASE WHEN near <> 0 THEN total / near - 1 END AS momentum FROM r)
    SELECT event_type, day, round(rs, 4) AS rs, round(momentum, 6) AS momentum,
           CASE WHEN momentum > 0.005 THEN 'up' WHEN momentum < -0.005 THEN 'down' WHEN momentum IS NOT NULL THEN 'flat' END AS direction,
           CASE WHEN rs IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY day, rs IS NULL ORDER BY rs DESC, event_type) AS INT) END AS place FROM s""")
def rs_rank(spark, sf_dir):
    rs = timeseries.relative_strength(daily(spark, sf_dir), ["event_type"], "day", "total", 14, 5)
    got = timeseries.rank_across(rs, ["day"], "rs", "event_type", "place")
    return got.select("event_type", "day", F.round("rs", 4).alias("rs"), F.round("momentum", 6).alias("momentum"), "direction", "place")


@query(f"""
    WITH {_DAILY}, s AS (SELECT event_type, day, total, avg(total) OVER w AS m, stddev_pop(total) OVER w AS sd, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i
        FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT event_type, day, round(CASE WHEN i > 7 AND sd > 0 THEN (total - m) / sd ELSE 0 END, 4) AS z FROM s""")
def zscore(spark, sf_dir):
    return timeseries.zscore(daily(spark, sf_dir), ["event_type"], "day", "total", 7).select("event_type", "day", F.round("z", 4).alias("z"))


_RETURNS = f"""{_DAILY}, o AS (SELECT *, lag(total) OVER (PARTITION BY event_type ORDER BY day) AS old FROM daily),
    ret AS (SELECT event_type, day, CASE WHEN old > 0 AND total > 0 THEN ln(total / old) ELSE 0 END AS ret FROM o WHERE old IS NOT NULL)"""


@query(f"""
    WITH {_RETURNS}, p AS (SELECT a.day, corr(a.ret, b.ret) OVER w AS c, count(*) OVER w AS n FROM ret a JOIN ret b ON a.day = b.day
        WHERE a.event_type = 'click' AND b.event_type = 'view' WINDOW w AS (ORDER BY a.day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT day, round(CASE WHEN n = 10 THEN coalesce(c, 0) END, 4) AS corr FROM p""")
def rolling_corr(spark, sf_dir):
    r = timeseries.log_returns(daily(spark, sf_dir), ["event_type"], "day", "total").where("ret is not null")
    got = timeseries.rolling_correlation(r.where("event_type = 'click'"), r.where("event_type = 'view'"), "day", "ret", 10)
    return got.select("day", F.round("corr", 4).alias("corr"))


@query(f"""
    WITH {_RETURNS}, l AS (SELECT * FROM ret QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 20)
    SELECT a.event_type AS a, b.event_type AS b, CASE WHEN a.event_type = b.event_type THEN 1.0 ELSE round(coalesce(corr(a.ret, b.ret), 0), 4) END AS corr
    FROM l a JOIN l b ON a.day = b.day GROUP BY a.event_type, b.event_type""")
def corr_matrix(spark, sf_dir):
    r = timeseries.log_returns(daily(spark, sf_dir), ["event_type"], "day", "total").where("ret is not null")
    return timeseries.correlation_matrix(r, "event_type", "day", "ret", 20).withColumn("corr", F.round("corr", 4))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id AS id FROM events),
    kept AS (
        SELECT user_id, event_type, min({'t': t, 'id': id}) AS k FROM e GROUP BY ALL
        UNION ALL
        SELECT e.user_id, e.event_type, min({'t': e.t, 'id': e.id}) FROM kept JOIN e ON e.user_id = kept.user_id AND e.event_type = kept.event_type AND e.t >= kept.k.t + 3600000000 GROUP BY ALL),
    n AS (SELECT user_id, event_type, k.t AS t, k.id AS id, lead(k.t) OVER (PARTITION BY user_id, event_type ORDER BY k.t) AS following FROM kept)
    SELECT n.user_id, n.event_type, make_timestamp(n.t) AS kept_ts, n.id AS kept_id, count(e.id) - 1 AS n_dropped
    FROM n JOIN e ON e.user_id = n.user_id AND e.event_type = n.event_type AND (e.t > n.t OR e.t = n.t AND e.id >= n.id) AND (n.following IS NULL OR e.t < n.following) GROUP BY ALL""")
def dedupe_window(spark, sf_dir):
    """Events of a user and type that lie an hour or more after the last one kept."""
    return timeseries.keep_min_gap(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 3600)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 3)}, "1 hour")


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, event_type, count(*) AS n FROM events, range(0, 4) t(k) GROUP BY ALL""")
def sliding_window(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], {"n": F.count(F.lit(1))}, "24 hours", "6 hours")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], {"n": F.count(F.lit(1))}, "12 hours")


@query("""
    SELECT event_id, event_type FROM events
    WHERE (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000 <= CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 14 ELSE 30 END""")
def ttl_expire(spark, sf_dir):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return streams.unexpired(table(spark, sf_dir, "events"), "ts", "event_type", {"view": 7, "click": 14}, 30, now).select("event_id", "event_type")


@query("""
    SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value, max(event_id) FILTER (ts = m) AS event_id
    FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY user_id, event_type""")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value", "event_id")
    old, new = e.where("ts < timestamp_ntz'2024-01-15'"), e.where("ts >= timestamp_ntz'2024-01-15'")
    return timeseries.upsert_latest(old, new, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
    SELECT o_orderpriority, o_orderkey, CAST(place AS INT) AS place, place > 5 AS is_deferred FROM (
        SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders)""")
def topn_deferred(spark, sf_dir):
    got = trading.defer_beyond(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 5)
    return got.select("o_orderpriority", "o_orderkey", "place", "is_deferred")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS cost FROM events GROUP BY event_type")
def cost_json_path(spark, sf_dir):
    cost = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"))


@query("""
    WITH c AS (SELECT l_partkey, l_returnflag AS ch FROM lineitem UNION ALL SELECT l_partkey, l_linestatus || '2' FROM lineitem WHERE l_quantity > 25),
    g AS (SELECT l_partkey, count(DISTINCT ch) AS n_channels, count(*) AS n_signals, string_agg(DISTINCT ch, ',' ORDER BY ch) AS channels FROM c GROUP BY l_partkey)
    SELECT CAST(l_partkey AS VARCHAR) AS part, n_channels, n_signals, channels,
           CAST(CASE WHEN n_channels >= 4 THEN 1 WHEN n_channels = 3 THEN 2 WHEN n_channels = 2 AND n_signals >= 5 THEN 3 END AS INT) AS tier FROM g""")
def tiering_channels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"), F.lit(None).cast("string").alias("company"), "l_returnflag", "l_linestatus", "l_quantity")
    channels = {f: rows.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")}
    channels |= {f"{s}2": rows.where((F.col("l_linestatus") == s) & (F.col("l_quantity") > 25)) for s in ("F", "O")}
    got = trading.merge_channels(channels, "part", "company")
    return got.select("part", "n_channels", "n_signals", "channels", trading.tier(F.col("n_channels"), F.col("n_signals")).alias("tier"))


@query("""
    SELECT c_custkey, 'both' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_acctbal > 0
    UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    with_orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both = c.where("c_acctbal > 0").select("c_custkey").intersect(with_orders)
    idle = c.select("c_custkey").join(with_orders, "c_custkey", "left_anti")
    return both.withColumn("side", F.lit("both")).unionAll(idle.withColumn("side", F.lit("idle")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
    WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events),
    c AS (SELECT event_type, day, CASE event_type WHEN 'click' THEN 'crypto' WHEN 'view' THEN ' Stock ' WHEN 'error' THEN 'etf' END AS asset FROM d)
    SELECT event_type, day FROM c WHERE asset IS NULL OR asset = 'crypto' OR isodow(day) < 6""")
def trading_days(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    asset = F.when(F.col("event_type") == "click", "crypto").when(F.col("event_type") == "view", " Stock ").when(F.col("event_type") == "error", "etf")
    return days.where(symbols.is_trading_day(asset, F.col("day"))).select("event_type", "day")


@query("""
    WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'x-usd' WHEN 1 THEN ' p' || p_size || 'USDT' WHEN 2 THEN 'spy' WHEN 3 THEN 'XETH' ELSE p_brand END AS symbol FROM part),
    u AS (SELECT p_partkey, upper(trim(symbol)) AS s FROM s)
    SELECT p_partkey, CASE WHEN s LIKE '%-USD' THEN 'crypto' WHEN s = 'SPY' THEN 'etf' WHEN s LIKE '__%USDT' AND len(s) > 5 THEN 'crypto' ELSE 'stock' END AS asset FROM u""")
def asset_classes(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    symbol = F.when(key == 0, F.concat(size, F.lit("x-usd"))).when(key == 1, F.concat(F.lit(" p"), size, F.lit("USDT"))).when(key == 2, "spy").when(key == 3, "XETH").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", symbols.asset_class(symbol, ("SPY",)).alias("asset"))


@query(f"""
    WITH {_DAILY}, j AS (SELECT a.day, a.total AS x, b.total AS y FROM daily a JOIN daily b ON a.day = b.day WHERE a.event_type = 'click' AND b.event_type = 'view'),
    r AS (SELECT day, ln(x / lag(x) OVER (ORDER BY day)) AS p, ln(y / lag(y) OVER (ORDER BY day)) AS q FROM j)
    SELECT day, CASE WHEN count(*) OVER w = 10 THEN round(coalesce(corr(p, q) OVER w, 0), 4) END AS corr FROM r WHERE p IS NOT NULL
    WINDOW w AS (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def aligned_corr(spark, sf_dir):
    d = daily(spark, sf_dir)
    got = timeseries.aligned_correlation(d.where("event_type = 'click'"), d.where("event_type = 'view'"), "day", "total", 10)
    return got.select("day", F.round("corr", 4).alias("corr"))
