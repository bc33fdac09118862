"""The registered queries over the test tables, each with its DuckDB SQL. Keys are the operators' numbers in the coverage list with a short name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import scalar as S
from siltworks.operators import checks as D
from siltworks.operators import geo as G
from siltworks.operators import loads as L
from siltworks.operators import relational as R
from siltworks.plans import marts as M
from siltworks.sources import tables as T
from siltworks.sources.commits import at_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.path = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


c = F.col


def time0():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# Derived inputs, the same in SQL: coordinates of cities and events, an order log, payments.
CITIES = "SELECT n_nationkey AS city_id, n_name AS city, -38.0 + n_nationkey * 0.5 AS lat, 140.0 + n_nationkey * 0.4 AS lng FROM nation"
PLACED = "SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'reaction' WHEN 'purchase' THEN 'subscription' ELSE event_type END AS event_type, CASE WHEN event_id % 3 <> 0 THEN -38.0 + ((user_id * 7 + event_id) % 25) * 0.5 + value / 10000 END AS lat, CASE WHEN event_id % 3 <> 0 THEN 140.0 + ((user_id * 7 + event_id) % 25) * 0.4 END AS lon FROM events"
ORDER_LOG = "SELECT concat('o', l_orderkey, '_', l_linenumber) AS uniq_id, l_shipdate AS date_time, o_custkey AS customer_id, l_partkey % 20 AS item_id, l_quantity AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_amount, CASE l_returnflag WHEN 'R' THEN 'refunded' ELSE 'shipped' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
PAYMENTS = "SELECT event_id % 5000 AS operation_id, user_id - 5 AS account_number_from, CAST(400 + user_id % 5 * 10 AS INTEGER) AS currency_code, CAST(value AS DECIMAL(18,2)) AS amount, ts AS transaction_dt FROM events"
RATES = "SELECT DISTINCT CAST(400 + user_id % 5 * 10 AS INTEGER) AS currency_code, 420 AS currency_code_with, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS rate_ts, CAST((user_id % 5 + 1) * 0.25 AS DECIMAL(5,2)) AS rate FROM events WHERE user_id % 5 < 4"


def derived(t: Tables, sql: str) -> DataFrame:
    for name in ("nation", "events", "lineitem", "orders", "customer"):
        getattr(t, name).createOrReplaceTempView(f"siltworks_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM siltworks_{name}").replace(f"JOIN {name}", f"JOIN siltworks_{name}")
    return t.spark.sql(sql)


# -- flagship


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def a5_agg_by(t):
    return R.agg_by(t.lineitem.filter(c("l_shipdate") <= "2000-09-02"), ["l_returnflag", "l_linestatus"], {"sum_qty": "CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double)", "sum_price": "CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double)", "n_lines": "count(*)"})


# -- projections and filters


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' AND value IS NOT NULL")
def p1_nested_fields(t):
    parsed = t.events.filter((c("event_type") == "click") & c("value").isNotNull()).select("event_id", F.from_json("props", "struct<k bigint>").alias("p"))
    return parsed.select("event_id", c("p.k").alias("k"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events")
def p2_expand(t):
    return R.expand(t.events.select(F.from_json(S.row_json("event_id", "props"), "struct<event_id bigint, props string>").alias("m")), "m").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, upper(event_type) AS kind, CAST(floor(value) AS BIGINT) AS whole FROM events")
def p3_computed(t):
    return t.events.withColumns({"kind": F.upper("event_type"), "whole": F.floor("value")}).drop("ts", "user_id", "event_type", "value", "props")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN 'low' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band FROM supplier")
def p7_tier(t):
    return t.supplier.select("s_suppkey", S.tier(c("s_acctbal"), [(1000, "low"), (5000, "mid")], "high").alias("band"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed_qty FROM lineitem")
def p8_signed(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.signed(c("l_quantity"), c("l_returnflag"), "R").alias("signed_qty"))


@query("SELECT event_id, value / nullif(user_id % 3, 0) AS ratio FROM events")
def p9_safe_div(t):
    return t.events.select("event_id", S.safe_div(c("value"), c("user_id") % 3).alias("ratio"))


@query("SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM nullif(o_orderstatus, 'F')")
def p10_distinct_from(t):
    return t.orders.filter(S.distinct_from(F.nullif(c("o_orderstatus"), F.lit("P")), F.nullif(c("o_orderstatus"), F.lit("F")))).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = upper('Building')")
def p11_same_text(t):
    return t.customer.filter(S.same_text(c("c_mktsegment"), "Building")).select("c_custkey")


@query("SELECT event_id, greatest(value * 0.05, 5.0) AS fee, 'run' AS load_src FROM events WHERE event_type IN ('click', 'view')")
def p13_greatest(t):
    return t.events.filter(c("event_type").isin("click", "view")).select("event_id", F.greatest(c("value") * 0.05, F.lit(5.0)).alias("fee"), F.lit("run").alias("load_src"))


@query("SELECT count(*) AS n FROM orders WHERE regexp_matches(substr(o_orderpriority, 1, 1), '^[0-9]+$')")
def p15_digits(t):
    return t.orders.filter(S.digits_only(F.substring("o_orderpriority", 1, 1))).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-15' AND TIMESTAMP '1997-06-15' < o_orderdate + INTERVAL 30 DAY")
def p17_active(t):
    spans = t.orders.withColumn("ends", c("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return R.active_at(spans, "o_orderdate", "ends", F.lit("1997-06-15").cast("timestamp")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(concat('0x', substr(md5(concat('42_', l_orderkey)), 1, 8)) AS UBIGINT) % 10000 < 1000")
def p18_sample(t):
    return R.sample_df(t.lineitem, 0.1, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS \"left\", greatest(l_partkey, l_suppkey) AS \"right\" FROM lineitem WHERE l_partkey <> l_suppkey")
def p20_canonical_pair(t):
    return R.canonical_pair(t.lineitem, "l_partkey", "l_suppkey")


# -- joins


@query("SELECT r_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def j1_join_dims(t):
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return R.join_dims(t.customer, [(nation, "c_nationkey"), (t.region, "r_regionkey")]).groupBy("r_name").agg(F.count("*").alias("n_customers"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j2_left_join(t):
    orders = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return R.left_join(t.customer.select("c_custkey"), orders, "c_custkey").fillna(0, ["n_orders"])


@query("SELECT count(*) AS n FROM supplier, region")
def j4_cross_small(t):
    return R.cross_small(t.supplier, t.region).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup') SELECT DISTINCT a.user_id AS \"left\", b.user_id AS \"right\" FROM m a JOIN m b ON a.day = b.day AND a.user_id < b.user_id")
def j5_peer_pairs(t):
    return R.peer_pairs(t.events.filter("event_type = 'signup'").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_exclude(t):
    return R.exclude(t.customer.select("c_custkey"), t.orders.select(c("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderstatus = 'F' AND e.o_orderdate < o.o_orderdate) AS has_history FROM orders o")
def j8_has_history(t):
    return R.has_history(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", t.orders.filter("o_orderstatus = 'F'"), "o_orderdate").select("o_orderkey", "has_history")


VERSIONS = "SELECT o_custkey AS user_id, o_orderkey AS version_id, o_orderdate AS active_from, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '2099-12-31') AS active_to FROM orders"


def _asof(t, **more):
    rows = t.lineitem.filter("l_linenumber = 1").join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_partkey", c("o_custkey").alias("user_id"), "l_shipdate").distinct()
    return R.asof_join(rows, derived(t, VERSIONS), "user_id", "l_shipdate", **more).select("l_orderkey", "l_partkey", "l_shipdate", "version_id")


_ASOF_ROWS = f"WITH v AS ({VERSIONS}), r AS (SELECT DISTINCT l_orderkey, l_partkey, o_custkey AS user_id, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1) "


@query(_ASOF_ROWS + "SELECT l_orderkey, l_partkey, l_shipdate, version_id FROM r JOIN v ON r.user_id = v.user_id AND l_shipdate >= active_from AND l_shipdate < active_to")
def j9_asof(t):
    return _asof(t)


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey % 60 AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n OR a.k IS NULL OR b.k IS NULL")
def j11_full_diff(t):
    sides = [t.orders.filter(c("o_orderstatus") == s).groupBy((c("o_custkey") % m).alias("k")).agg(F.count("*").alias("n")) for s, m in (("F", 50), ("O", 60))]
    return R.full_diff(*sides, ["k"], ["n"])


@query("SELECT 'resolved' AS side, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT 'unresolved', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j13_resolve_keys(t):
    good, bad = R.resolve_keys(t.orders, t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("o_custkey")), ["o_custkey"])
    return R.row_counts({"resolved": good, "unresolved": bad}).withColumnRenamed("table_name", "side")


@query("SELECT l_orderkey, l_linenumber AS line, l_partkey AS part FROM lineitem")
def j14_explode_json(t):
    documents = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(c("l_linenumber").alias("line"), c("l_partkey").alias("part")))).alias("items"))
    return R.explode_json(documents, "items", "struct<line int, part bigint>").select("l_orderkey", "item.*")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j15_only_in(t):
    return R.only_in(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey")


@query(f"WITH p AS ({PAYMENTS}), r AS ({RATES}) SELECT currency_code, count(*) AS n, count(rate) AS n_rated FROM (SELECT p.*, r.rate FROM p LEFT JOIN r ON p.currency_code = r.currency_code AND CAST(transaction_dt AS DATE) = CAST(rate_ts AS DATE)) GROUP BY 1")
def j16_join_rate(t):
    return R.join_rate(derived(t, PAYMENTS), derived(t, RATES), "currency_code", "transaction_dt", 420).groupBy("currency_code").agg(F.count("*").alias("n"), F.count("rate").alias("n_rated"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2))))"
_NEAR = f"(SELECT p.*, city_id, city, round(km, 6) AS distance_km FROM p JOIN (SELECT event_id, city_id, city, km, row_number() OVER (PARTITION BY event_id ORDER BY km, city_id) AS k FROM (SELECT event_id, city_id, city, {_KM} AS km FROM (SELECT event_id, p.lat AS a_lat, p.lon AS a_lon, x.lat AS b_lat, x.lng AS b_lon, city_id, city FROM p, ({CITIES}) x WHERE p.lat IS NOT NULL))) USING (event_id) WHERE k = 1)"


@query(f"WITH p AS ({PLACED}) SELECT event_id, city_id, distance_km FROM {_NEAR}")
def j17_nearest(t):
    return R.nearest(derived(t, PLACED).filter("lat IS NOT NULL"), derived(t, CITIES), "lat", "lon").select("event_id", "city_id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH x AS ({CITIES}) SELECT a, b FROM (SELECT a, b, {_KM} AS km FROM (SELECT m.city_id AS a, n.city_id AS b, m.lat AS a_lat, m.lng AS a_lon, n.lat AS b_lat, n.lng AS b_lon FROM x m JOIN x n ON m.city_id < n.city_id)) WHERE km <= 150")
def j18_within_km(t):
    x = derived(t, CITIES)
    pairs = x.select(c("city_id").alias("a"), c("lat").alias("a_lat"), c("lng").alias("a_lon")).join(x.select(c("city_id").alias("b"), c("lat").alias("b_lat"), c("lng").alias("b_lon")), c("a") < c("b"))
    return R.within_km(pairs, "a_lat", "a_lon", "b_lat", "b_lon", 150).select("a", "b")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def j20_enrich_items(t):
    menus = t.part.filter("p_size > 25").withColumnRenamed("p_partkey", "l_partkey")
    return R.enrich_items(t.lineitem, menus, ["l_partkey"], "p_type").select("l_orderkey", "l_linenumber", "l_partkey", "p_type")


# -- aggregations


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a1_count_by(t):
    return R.count_by(t.events, ["event_type"])


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM events GROUP BY 1")
def a2_pivot_counts(t):
    return R.pivot_counts(t.events, ["user_id"], "event_type", ["click", "view", "error"])


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS sum_o FROM orders GROUP BY 1")
def a3_filtered_agg(t):
    return R.filtered_agg(t.orders, ["o_custkey"], {"n_f": ("count(*)", "o_orderstatus = 'F'"), "sum_o": ("sum(CAST(o_totalprice AS decimal(18,2)))", "o_orderstatus = 'O'")}).withColumn("sum_o", c("sum_o").cast("double"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem GROUP BY 1")
def a4_distinct_counts(t):
    return R.distinct_counts(t.lineitem, ["l_returnflag"], ["l_suppkey", "l_partkey"])


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), ',') AS kinds FROM events GROUP BY 1")
def a6_ordered_list(t):
    return R.ordered_list(t.events, ["user_id"], ["ts", "event_id"], "event_type", "kinds").withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT l_returnflag, CAST(CAST(count(DISTINCT l_partkey) / count(DISTINCT l_suppkey) AS DECIMAL(18,2)) AS DOUBLE) AS ratio FROM lineitem GROUP BY 1")
def a7_ratio_of_distinct(t):
    return R.ratio_of_distinct(t.lineitem, ["l_returnflag"], "l_partkey", "l_suppkey").withColumn("ratio", c("ratio").cast("double"))


@query(f"WITH p AS ({PAYMENTS}), r AS ({RATES}) SELECT p.currency_code, CAST(CAST(sum(amount * coalesce(rate, 1)) AS DECIMAL(18,2)) AS DOUBLE) AS amount_total FROM p LEFT JOIN r ON p.currency_code = r.currency_code AND CAST(transaction_dt AS DATE) = CAST(rate_ts AS DATE) GROUP BY 1")
def a8_sum_converted(t):
    rated = R.join_rate(derived(t, PAYMENTS), derived(t, RATES), "currency_code", "transaction_dt", 420)
    return R.sum_converted(rated, ["currency_code"], "amount", "rate").withColumn("amount_total", c("amount_total").cast("double"))


@query("SELECT l_suppkey, CAST(sum(abs(CAST(-l_extendedprice AS DECIMAL(18,2)))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS amount FROM lineitem GROUP BY 1")
def a9_sum_abs_where(t):
    return R.sum_abs_where(t.lineitem, ["l_suppkey"], "CAST(-l_extendedprice AS decimal(18,2))", "l_returnflag = 'R'").withColumn("amount", c("amount").cast("double"))


@query("SELECT c_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a10_sum0(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(R.sum0(c("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"))


@query("SELECT user_id, round(sum(CASE WHEN rate < 4 THEN greatest(value * 0.05, 100) WHEN rate < 4.5 THEN greatest(value * 0.07, 150) WHEN rate < 4.9 THEN greatest(value * 0.08, 175) ELSE greatest(value * 0.10, 200) END), 4) AS payout FROM (SELECT user_id, value, user_id % 3 + 2.7 AS rate FROM events) GROUP BY 1")
def a11_payout(t):
    return t.events.withColumn("rate", c("user_id") % 3 + 2.7).groupBy("user_id").agg(F.round(R.payout(c("rate"), c("value"), M.PAYOUT_BANDS), 4).alias("payout"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, max(ts) AS last FROM events")
def a12_summarise(t):
    return R.summarise(t.events, {"n": "count(*)", "n_users": "count(DISTINCT user_id)", "last": "max(ts)"})


@query("SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL")
def a14_count_once_per(t):
    return R.count_once_per(t.lineitem, ["l_orderkey"], ["l_suppkey", "l_returnflag"])


@query("SELECT o_custkey, l_partkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def a15_count_lines(t):
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))


# -- windows


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w1_latest_per(t):
    return R.latest_per(t.events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def w2_first_per(t):
    return R.first_per(t.events.filter("event_type = 'signup'"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT event_id % 3000 AS op, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY ts DESC, event_id DESC) = 1")
def w3_dedup_newest(t):
    return R.dedup_newest(t.events.select((c("event_id") % 3000).alias("op"), "event_id", "ts"), ["op"], "ts", "event_id").select("op", "event_id")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w4_distinct_on(t):
    return R.distinct_on(t.orders, ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1")
def w5_min_per(t):
    return R.min_per(t.events, ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def w6_with_previous(t):
    return R.with_previous(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous")


_STAYS = "SELECT user_id, event_type, island, min(CAST(ts AS DATE)) AS start, max(CAST(ts AS DATE)) AS \"end\", max(ts) AS last_ts, CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS INTEGER) AS days FROM (SELECT *, CAST(sum(CASE WHEN b IS NOT NULL AND b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, event_type, island HAVING date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 >= 2"


@query(_STAYS)
def w8_stays(t):
    return R.stays(t.events, "user_id", "ts", "event_id", "event_type", 2)


@query(f"SELECT user_id, event_type, island FROM ({_STAYS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, island DESC) = 1")
def w9_latest_stay(t):
    return R.latest_stay(R.stays(t.events, "user_id", "ts", "event_id", "event_type", 2), "user_id").select("user_id", "event_type", "island")


# -- sorts, limits, sets


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def o3_in_top_k(t):
    ranking = t.customer.select(c("c_custkey").alias("o_custkey"), (-c("c_acctbal")).alias("least"))
    return R.in_top_k(t.orders, ranking, "o_custkey", ["least", "o_custkey"], 10).select("o_orderkey")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def o4_batch(t):
    return R.batch(t.events.select("event_id", "ts"), ["ts", "event_id"], 100)


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def o5_top_k(t):
    return R.top_k(R.count_by(t.events, ["user_id"]), "n", "user_id", 10)


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def u1_union_all(t):
    return R.union_all(t.orders.select(c("o_custkey").alias("k")), t.customer.select(c("c_custkey").alias("k")), t.supplier.select(c("s_suppkey").alias("k")))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def u2_row_counts(t):
    return R.row_counts({"orders": t.orders, "lineitem": t.lineitem})


@query("SELECT 'only_a' AS side, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT 'only_b', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def u3_except_all(t):
    return R.except_all_counts(*[t.lineitem.filter(c("l_returnflag") == f).select("l_suppkey") for f in "AN"])


# -- scalar functions


@query("SELECT o_orderkey, concat(o_orderkey, '_', o_custkey) AS k, concat(substr(md5(concat(o_orderkey, '_', o_custkey)), 1, 8), '-', substr(md5(concat(o_orderkey, '_', o_custkey)), 9, 4), '-', substr(md5(concat(o_orderkey, '_', o_custkey)), 13, 4), '-', substr(md5(concat(o_orderkey, '_', o_custkey)), 17, 4), '-', substr(md5(concat(o_orderkey, '_', o_custkey)), 21)) AS u FROM orders")
def h1_h3_keys(t):
    key = S.join_key(c("o_orderkey"), c("o_custkey"))
    return t.orders.select("o_orderkey", key.alias("k"), S.md5_uuid(key).alias("u"))


@query("SELECT o_orderkey, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS h FROM (SELECT o_orderkey, CAST(CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT) AS HUGEINT) AS v FROM orders)")
def h2_md5_bigint(t):
    return t.orders.select("o_orderkey", S.md5_bigint(c("o_orderkey")).alias("h"))


@query("SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('week', ts) AS DATE) AS week, date_trunc('second', ts) AS second, CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) + 1 AS INTEGER) AS span, CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%H:%M:%S') AS time, CAST(CAST(ts AS DATE) - INTERVAL 31 DAY AS DATE) AS earlier FROM events")
def h7_h15_dates(t):
    ts, parts = c("ts"), S.time_parts(c("ts"))
    return t.events.select("event_id", S.month_of(ts).alias("month"), S.week_of(ts).alias("week"), S.to_second(ts).alias("second"), S.day_span(F.lit("2023-12-25").cast("date"), S.as_date(ts)).alias("span"), parts["year"].alias("year"), parts["time"].alias("time"), S.days_before(S.as_date(ts), 31).alias("earlier"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') IS NOT NULL AS has FROM events")
def h19_json(t):
    return t.events.select("event_id", S.json_str(c("props"), "$.k").alias("k"), S.json_has(c("props"), "$.absent").alias("has"))


# -- loads


def _halves(t):
    log = t.orders.select("o_orderkey", (c("o_orderkey") % 4000).alias("k"), c("o_orderstatus").alias("s"), c("o_orderdate").alias("dt"))
    return log.filter("dt >= '1998-01-01'"), L.upsert(log.filter("dt < '1998-01-01'"), log.limit(0), ["k"], "dt")


_LOG = "WITH l AS (SELECT o_orderkey, o_orderkey % 4000 AS k, o_orderstatus AS s, o_orderdate AS dt FROM orders), src AS (SELECT * FROM l WHERE dt >= TIMESTAMP '1998-01-01'), tgt AS (SELECT * FROM l WHERE dt < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY k ORDER BY dt DESC, o_orderkey DESC, s DESC) = 1), new AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY k ORDER BY dt DESC, o_orderkey DESC, s DESC) = 1) "


@query(_LOG + "SELECT * FROM tgt WHERE s NOT IN (SELECT s FROM src WHERE s <> 'P') UNION ALL SELECT * FROM src WHERE s <> 'P'")
def l2_replace_slice(t):
    source, target = _halves(t)
    return L.replace_slice(source.filter("s <> 'P'"), target, ["s"])


@query(_LOG + "SELECT * FROM new UNION ALL SELECT * FROM tgt WHERE k NOT IN (SELECT k FROM src)")
def l3_upsert(t):
    return L.upsert(*_halves(t), ["k"], "dt")


@query(_LOG + "SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE k NOT IN (SELECT k FROM tgt) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1")
def l4_insert_new(t):
    return L.insert_new(*_halves(t), ["k"])


@query(_LOG + "SELECT tgt.o_orderkey, tgt.k, coalesce(new.s, tgt.s) AS s, tgt.dt FROM tgt LEFT JOIN new USING (k)")
def l5_scd1(t):
    source, target = _halves(t)
    return L.scd1(source, target, "k", ["s"], "dt")


@query("WITH x AS (SELECT o_custkey AS k, o_orderdate AS dt, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), y AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY dt) AS b FROM x), z AS (SELECT * FROM y WHERE b IS DISTINCT FROM s) SELECT k, s, dt AS active_from, coalesce(lead(dt) OVER (PARTITION BY k ORDER BY dt), TIMESTAMP '2099-12-31') AS active_to FROM z")
def l6_scd2(t):
    empty = t.spark.createDataFrame([], "k bigint, s string, active_from timestamp, active_to timestamp")
    log = t.orders.select(c("o_custkey").alias("k"), c("o_orderstatus").alias("s"), c("o_orderdate").alias("dt"))
    first = L.scd2(log.filter("dt < '1998-01-01'"), empty, "k", ["s"], "dt")
    return L.scd2(log.filter("dt >= '1998-01-01'"), first, "k", ["s"], "dt")


@query("SELECT DISTINCT ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, strftime(ts, '%H:%M:%S') AS time, CAST(ts AS DATE) AS date FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def l8_time_dim(t):
    return L.build_time_dim(t.events, "ts")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def l9_read_since(t):
    return L.read_since(t.events.select("event_id", "ts"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def l11_window(t):
    return L.reprocess_window(t.events, "ts", "2024-01-20", 5).select("event_id")


@query("SELECT md5(CAST(c_custkey AS VARCHAR)) AS plain, CAST(c_custkey AS VARCHAR) AS c_custkey, 'crm' AS load_src FROM customer")
def l12_hub(t):
    empty = t.spark.createDataFrame([], "hub_key string, c_custkey string, load_dt timestamp, load_src string")
    once = L.load_hub(t.customer.filter("c_custkey % 2 = 0"), empty, "c_custkey", "crm", time0())
    return L.load_hub(t.customer, once, "c_custkey", "crm", time0()).select(F.replace("hub_key", F.lit("-"), F.lit("")).alias("plain"), "c_custkey", "load_src")


@query("SELECT DISTINCT md5(concat(o_custkey, '_', o_orderstatus)) AS plain, md5(CAST(o_custkey AS VARCHAR)) AS customer FROM orders")
def l13_link(t):
    empty = t.spark.createDataFrame([], "link_key string, hk_o_custkey string, hk_o_orderstatus string, load_dt timestamp, load_src string")
    link = L.load_link(t.orders, empty, ["o_custkey", "o_orderstatus"], "crm", time0())
    return link.select(F.replace("link_key", F.lit("-"), F.lit("")).alias("plain"), F.replace("hk_o_custkey", F.lit("-"), F.lit("")).alias("customer"))


@query("SELECT c_custkey, c_mktsegment, md5(c_mktsegment) AS plain FROM customer UNION ALL SELECT c_custkey, 'MOVED', md5('MOVED') FROM customer WHERE c_nationkey = 3")
def l14_satellite(t):
    empty = t.spark.createDataFrame([], "c_custkey bigint, c_mktsegment string, hashdiff string, load_dt timestamp, load_src string")
    one = L.load_satellite(t.customer, empty, "c_custkey", ["c_mktsegment"], "crm", time0())
    moved = t.customer.withColumn("c_mktsegment", F.when(c("c_nationkey") == 3, "MOVED").otherwise(c("c_mktsegment")))
    two = L.load_satellite(moved, one, "c_custkey", ["c_mktsegment"], "crm", F.lit("2024-03-01").cast("timestamp"))
    return two.select("c_custkey", "c_mktsegment", F.replace("hashdiff", F.lit("-"), F.lit("")).alias("plain"))


@query("SELECT o_custkey, l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def l15_counters(t):
    lines = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "o_custkey", "l_returnflag")
    counters, ledger = t.spark.createDataFrame([], "o_custkey bigint, l_returnflag string, n bigint"), t.spark.createDataFrame([], "l_orderkey bigint")
    for part in (lines.filter("l_orderkey % 2 = 0"), lines):  # the second batch repeats the first
        counters, ledger = L.apply_counters(part, counters, ledger, "l_orderkey", ["o_custkey", "l_returnflag"])
    return counters.withColumn("n", c("n").cast("bigint"))


# -- data quality


@query("SELECT avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS null_rate FROM orders")
def d1_null_rate(t):
    return D.null_rate(t.orders.select(F.nullif(c("o_orderstatus"), F.lit("P")).alias("s")), "s")


@query("SELECT 'c_nationkey' AS column_name, count(*) AS n_rows, count(c_nationkey) AS n_present, count(DISTINCT c_nationkey) AS n_distinct FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer")
def d2_profile(t):
    return D.profile(t.customer, ["c_nationkey", "c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT l_discount < 0.05")
def d3_violations(t):
    return D.violations(t.lineitem, c("l_discount") < 0.05).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'small' AS rule, count(*) FILTER (WHERE NOT l_quantity < 30) AS n_failed FROM lineitem UNION ALL SELECT 'positive', count(*) FILTER (WHERE NOT l_tax >= 0) FROM lineitem")
def d6_check_rules(t):
    return D.check_rules(t.lineitem, {"small": "l_quantity < 30", "positive": "l_tax >= 0"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d7_check_unique(t):
    return D.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 4)")
def d8_check_fk(t):
    return D.check_fk(t.orders, "o_custkey", t.customer.filter("c_nationkey <> 4"), "c_custkey").select("o_orderkey")


# -- marts

_ODS = f"WITH q AS ({PLACED}), m AS (SELECT user_id, lat, lon FROM q WHERE event_type = 'message' AND lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), p AS (SELECT event_id, ts, q.user_id, event_type, coalesce(q.lat, m.lat) AS lat, coalesce(q.lon, m.lon) AS lon FROM q LEFT JOIN m ON q.user_id = m.user_id WHERE coalesce(q.lat, m.lat) IS NOT NULL), o AS {_NEAR.replace('FROM p JOIN', 'FROM p JOIN')} "


def _ods(t):
    return M.events_with_cities(derived(t, PLACED), derived(t, CITIES))


@query(_ODS + "SELECT event_id, user_id, city_id, city, distance_km FROM o")
def m1_events_with_cities(t):
    return _ods(t).select("event_id", "user_id", "city_id", "city", F.round("distance_km", 6).alias("distance_km"))


_LOCAL = "timezone('Australia/Sydney', timezone('UTC', {}))"


def _geo_sql(days):
    return (
        ", e AS (SELECT *, lag(city) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM o WHERE event_type = 'message'), i AS (SELECT *, sum(CASE WHEN b <> city THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e), "
        f"st AS (SELECT user_id, city, island, max(ts) AS last_ts FROM i GROUP BY 1, 2, 3 HAVING date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 >= {days}), h AS (SELECT user_id, city AS home_city FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, island DESC) = 1) "
        "SELECT user_id, act_city, home_city, travel_count, travels, local_time FROM (SELECT user_id, max_by(city, struct_pack(t := ts, e := event_id)) AS act_city, CAST(count(*) FILTER (WHERE b IS NULL OR b <> city) AS BIGINT) AS travel_count, array_to_string(list(city ORDER BY ts, event_id) FILTER (WHERE b IS NULL OR b <> city), ',') AS travels, "
        + _LOCAL.format("max(ts)") + " AS local_time FROM e GROUP BY 1) LEFT JOIN h USING (user_id)"
    )


def _geo(ods, days):
    return M.user_geo_report(ods, days).select("user_id", "act_city", "home_city", "travel_count", F.array_join("travel_array", ",").alias("travels"), "local_time")


@query(_ODS + _geo_sql(1))
def m2_user_geo_report(t):
    return _geo(_ods(t), 1)


# users who stay in one city but for their events with an id that 97 divides: stays of 27 days and returns
_STILL = PLACED.replace("((user_id * 7 + event_id) % 25)", "((user_id + CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END) % 25)")


@query(_ODS.replace(PLACED, _STILL) + _geo_sql(27))
def m2_home_city_27(t):
    return _geo(M.events_with_cities(derived(t, _STILL), derived(t, CITIES)), 27)


_KINDS = ("message", "reaction", "subscription", "registration")


def _counts_sql(prefix):
    return ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {prefix}_{k}" for k in _KINDS)


@query(_ODS + f", f AS (SELECT ts, city_id, event_type FROM o WHERE event_type IN ('message', 'reaction', 'subscription') UNION ALL (SELECT ts, city_id, 'registration' FROM o WHERE event_type = 'message' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)), w AS (SELECT city_id, CAST(date_trunc('week', ts) AS DATE) AS week, {_counts_sql('week')} FROM f GROUP BY 1, 2), mo AS (SELECT city_id AS c, CAST(date_trunc('month', ts) AS DATE) AS m, {_counts_sql('month')} FROM f GROUP BY 1, 2) SELECT w.*, CAST(date_trunc('month', week) AS DATE) AS month, mo.* EXCLUDE (c, m) FROM w LEFT JOIN mo ON w.city_id = c AND m = CAST(date_trunc('month', week) AS DATE)")
def m3_zone_mart(t):
    return M.zone_mart(_ods(t))


@query(_ODS + f", l AS (SELECT user_id, city_id, lat, lon, ts FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), s AS (SELECT DISTINCT user_id, event_id % 40 AS channel FROM events WHERE event_type = 'purchase'), g AS (SELECT DISTINCT a.user_id AS user_left, b.user_id AS user_right, x.city_id, x.ts, x.lat AS a_lat, x.lon AS a_lon, y.lat AS b_lat, y.lon AS b_lon FROM s a JOIN s b ON a.channel = b.channel AND a.user_id < b.user_id JOIN l x ON x.user_id = a.user_id JOIN l y ON y.user_id = b.user_id AND x.city_id = y.city_id) SELECT user_left, user_right, city_id, {_LOCAL.format('ts')} AS local_time FROM g WHERE {_KM} <= 3 AND NOT EXISTS (SELECT 1 FROM events e WHERE least(e.user_id, e.event_id % 150) = user_left AND greatest(e.user_id, e.event_id % 150) = user_right AND e.event_type = 'view')")
def m4_friend_recommendations(t):
    subscriptions = t.events.filter("event_type = 'purchase'").select("user_id", (c("event_id") % 40).alias("channel"))
    messages = t.events.filter("event_type = 'view'").select(c("user_id").alias("user_from"), (c("event_id") % 150).alias("user_to"))
    return M.friend_recommendations(_ods(t), subscriptions, messages, 3.0)


_SALES = f"WITH s AS (SELECT *, CAST(date_time AS DATE) AS date_id FROM ({ORDER_LOG}) QUALIFY row_number() OVER (PARTITION BY uniq_id, status ORDER BY date_time DESC, item_id DESC, payment_amount DESC, quantity DESC, customer_id DESC) = 1) "


@query(_SALES + "SELECT CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS order_id, date_id, item_id, customer_id, quantity, status, CAST(payment_amount AS DOUBLE) / nullif(quantity, 0) AS price, CAST(CASE WHEN status = 'refunded' THEN -payment_amount ELSE payment_amount END AS DOUBLE) AS payment_amount FROM (SELECT *, CAST(CAST(concat('0x', substr(md5(uniq_id), 1, 16)) AS UBIGINT) AS HUGEINT) AS v FROM s)")
def m5_f_sales(t):
    return M.f_sales(derived(t, ORDER_LOG)).withColumn("payment_amount", c("payment_amount").cast("double"))


@query(_SALES + ", p AS (SELECT CAST(date_trunc('week', date_id) AS DATE) AS period_id, item_id, customer_id, count(*) FILTER (WHERE status = 'shipped') AS k, count(*) FILTER (WHERE status = 'refunded') AS r, sum(payment_amount) FILTER (WHERE status = 'shipped') AS a, sum(payment_amount) FILTER (WHERE status = 'refunded') AS b FROM s GROUP BY 1, 2, 3), h AS (SELECT customer_id, min(date_id) AS first FROM s WHERE status = 'shipped' GROUP BY 1), x AS (SELECT p.*, coalesce(first < period_id, false) AS old FROM p LEFT JOIN h USING (customer_id)) SELECT period_id, item_id, count(*) FILTER (WHERE k = 1 AND NOT old) AS new_customers_count, count(*) FILTER (WHERE k > 1 OR old) AS returning_customers_count, count(*) FILTER (WHERE r > 0) AS refunded_customer_count, CAST(coalesce(sum(a) FILTER (WHERE k = 1 AND NOT old), 0) AS DOUBLE) AS new_customers_revenue, CAST(coalesce(sum(a) FILTER (WHERE k > 1 OR old), 0) AS DOUBLE) AS returning_customers_revenue, CAST(coalesce(sum(b), 0) AS DOUBLE) AS customers_refunded FROM x GROUP BY 1, 2")
def m6_customer_retention(t):
    out = M.f_customer_retention(M.f_sales(derived(t, ORDER_LOG)))
    return out.withColumns({k: c(k).cast("double") for k in ("new_customers_revenue", "returning_customers_revenue", "customers_refunded")})


@query("WITH l AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS s, CAST(l_discount * 100 AS DECIMAL(14,2)) AS p, CAST(l_tax * 100 AS DECIMAL(14,2)) AS g FROM lineitem), r AS (SELECT o_custkey % 30 AS restaurant_id, c_name AS restaurant_name, CAST(o_orderdate AS DATE) AS order_date, count(DISTINCT o_orderkey) AS orders_count, sum(s) AS total, sum(p) AS bonus, sum(g) AS bonus_grant FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey % 30 WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT restaurant_id, restaurant_name, order_date, orders_count, CAST(total AS DOUBLE) AS total_sum_total, CAST(bonus AS DOUBLE) AS bonus_payment_total, CAST(bonus_grant AS DOUBLE) AS bonus_grant_total, CAST(CAST(total * 0.25 AS DECIMAL(14,2)) AS DOUBLE) AS order_processing_fee, CAST(total - CAST(total * 0.25 AS DECIMAL(14,2)) - bonus AS DOUBLE) AS restaurant_reward_sum FROM r")
def m8_settlement_report(t):
    money = [c(a).cast("decimal(14,2)").alias(b) if a == "l_extendedprice" else (c(a) * 100).cast("decimal(14,2)").alias(b) for a, b in (("l_extendedprice", "total_sum"), ("l_discount", "bonus_payment"), ("l_tax", "bonus_grant"))]
    orders = t.orders.select(c("o_orderkey").alias("order_id"), (c("o_custkey") % 30).alias("restaurant_id"), F.to_date("o_orderdate").alias("order_date"), F.when(c("o_orderstatus") == "F", "Closed").otherwise("open").alias("status"))
    restaurants = t.customer.filter("c_custkey < 30").select(c("c_custkey").alias("restaurant_id"), c("c_name").alias("restaurant_name"))
    out = M.settlement_report(t.lineitem.select(c("l_orderkey").alias("order_id"), *money), orders, restaurants)
    return out.withColumns({k: c(k).cast("double") for k in ("total_sum_total", "bonus_payment_total", "bonus_grant_total", "order_processing_fee", "restaurant_reward_sum")})


@query("WITH d AS (SELECT user_id AS courier_id, event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, event_id % 3 + 3.0 AS rate, value, value * 0.1 AS tip FROM events), a AS (SELECT courier_id, y, m, avg(rate) AS r FROM d GROUP BY 1, 2, 3), z AS (SELECT courier_id, y, m, count(DISTINCT event_id) AS n, sum(value) AS s, max(r) AS r, sum(CASE WHEN r < 4 THEN greatest(value * 0.05, 100) WHEN r < 4.5 THEN greatest(value * 0.07, 150) WHEN r < 4.9 THEN greatest(value * 0.08, 175) ELSE greatest(value * 0.10, 200) END) AS p, sum(tip) AS tips FROM d JOIN a USING (courier_id, y, m) GROUP BY 1, 2, 3) SELECT courier_id, y AS settlement_year, m AS settlement_month, n AS orders_count, round(s, 6) AS orders_total_sum, round(r, 6) AS rate_avg, round(p, 6) AS courier_order_sum, round(tips, 6) AS courier_tips_sum, round(s * 0.25, 6) AS order_processing_fee, round(p + tips * 0.95, 6) AS courier_reward_sum FROM z")
def m9_courier_ledger(t):
    deliveries = t.events.select(c("user_id").alias("courier_id"), c("event_id").alias("order_id"), c("ts").alias("order_ts"), (c("event_id") % 3 + 3.0).alias("rate"), c("value").alias("sum"), (c("value") * 0.1).alias("tip_sum"))
    rounded = {k: F.round(k, 6) for k in ("orders_total_sum", "courier_order_sum", "courier_tips_sum", "order_processing_fee", "courier_reward_sum")}
    return M.courier_ledger(deliveries).withColumns(rounded | {"rate_avg": F.round("rate_avg", 6)})


@query("WITH g AS (SELECT user_id % 40 AS group_id, min(ts) AS registered FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10), a AS (SELECT event_id % 40 AS group_id, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'signup' GROUP BY 1), w AS (SELECT event_id % 40 AS group_id, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'view' AND value > 100 GROUP BY 1) SELECT a.group_id, a.n AS cnt_added_users, coalesce(w.n, 0) AS cnt_users_in_group_with_messages, coalesce(w.n, 0) / a.n AS group_conversion FROM a JOIN g USING (group_id) LEFT JOIN w USING (group_id)")
def m10_group_conversion(t):
    groups = t.events.groupBy((c("user_id") % 40).alias("group_id")).agg(F.min("ts").alias("registered"))
    by_group = t.events.withColumn("group_id", c("event_id") % 40)
    return M.group_conversion(by_group.filter("event_type = 'signup'").select("group_id", "user_id"), groups, by_group.filter("event_type = 'view' AND value > 100").select("group_id", "user_id"))


_METRICS = f"WITH p AS (SELECT * FROM ({PAYMENTS}) QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY transaction_dt DESC, amount DESC) = 1), r AS ({RATES}), z AS (SELECT CAST(transaction_dt AS DATE) AS date_update, p.currency_code AS currency_from, CAST(sum(amount * coalesce(rate, 1)) AS DOUBLE) AS amount_total, count(DISTINCT operation_id) AS cnt_transactions, CAST(CAST(count(DISTINCT operation_id) / count(DISTINCT account_number_from) AS DECIMAL(18,2)) AS DOUBLE) AS avg_transactions_per_account, count(DISTINCT account_number_from) AS cnt_accounts_make_transactions FROM p LEFT JOIN r ON p.currency_code = r.currency_code AND CAST(transaction_dt AS DATE) = CAST(rate_ts AS DATE) WHERE account_number_from >= 0 AND amount > 0 GROUP BY 1, 2) "


def _metrics(t):
    return M.global_metrics(derived(t, PAYMENTS), derived(t, RATES)).withColumns({k: c(k).cast("double") for k in ("amount_total", "avg_transactions_per_account")})


@query(_METRICS.replace("CAST(sum(amount * coalesce(rate, 1)) AS DOUBLE)", "CAST(CAST(sum(amount * coalesce(rate, 1)) AS DECIMAL(18,2)) AS DOUBLE)") + "SELECT * FROM z")
def m11_global_metrics(t):
    return _metrics(t)


@query(_METRICS + "SELECT date_update, currency_from, cnt_transactions FROM z WHERE date_update >= DATE '2024-01-10' AND date_update <> DATE '2024-01-15' AND currency_from IN (410, 420)")
def m15_metrics_view(t):
    return R.metrics_view(_metrics(t), "cnt_transactions", "date_update", "2024-01-10", {"currency_from": [410, 420]}, "2024-01-15")


# -- operators that are parts of the above, each on its own


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), 'other') AS kind FROM events")
def p6_fallback(t):
    return t.events.select("event_id", F.coalesce(F.nullif(c("event_type"), F.lit("view")), F.lit("other")).alias("kind"))


@query(f"SELECT operation_id, account_number_from FROM (SELECT * FROM ({PAYMENTS}) QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY transaction_dt DESC, amount DESC) = 1) WHERE account_number_from >= 0 AND amount > 0")
def p16_clean_payments(t):
    newest = R.dedup_newest(derived(t, PAYMENTS), ["operation_id"], "transaction_dt", "amount")
    return R.clean_payments(newest, "account_number_from", "amount").select("operation_id", "account_number_from")


@query("SELECT DISTINCT user_id, event_type FROM events")
def p19_distinct(t):
    return t.events.select("user_id", "event_type").distinct()


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def j3_left_dictionary(t):
    customers = t.customer.select("c_custkey", c("c_nationkey").alias("n_nationkey"))
    return R.left_join(customers, t.nation.filter("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), "n_nationkey", broadcast=True).select("c_custkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j7_not_exists(t):
    kept = R.not_exists(t.orders.select(c("o_orderkey").alias("l_orderkey")), t.lineitem.filter("l_returnflag = 'R'"), ["l_orderkey"])
    return kept.select(c("l_orderkey").alias("o_orderkey"))


LATE_VERSIONS = "SELECT user_id, version_id, active_from, coalesce(lead(active_from) OVER (PARTITION BY user_id ORDER BY active_from), TIMESTAMP '2099-12-31') AS active_to FROM (SELECT o_custkey AS user_id, max(o_orderkey) AS version_id, o_orderdate AS active_from FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey, o_orderdate)"


@query(f"WITH v AS ({LATE_VERSIONS}), r AS (SELECT DISTINCT l_orderkey, l_partkey, o_custkey AS user_id, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1) SELECT l_orderkey, l_partkey, l_shipdate, version_id FROM r JOIN v ON r.user_id = v.user_id QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_shipdate, r.user_id ORDER BY (l_shipdate >= active_from AND l_shipdate < active_to) DESC, active_from DESC) = 1")
def j10_asof_latest(t):
    rows = t.lineitem.filter("l_linenumber = 1").join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_partkey", c("o_custkey").alias("user_id"), "l_shipdate").distinct()
    found = R.asof_join(rows, derived(t, LATE_VERSIONS), "user_id", "l_shipdate", fallback="latest")
    return found.select("l_orderkey", "l_partkey", "l_shipdate", "version_id")


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def j19_surrogate_lookup(t):
    known, _ = R.surrogate_lookup(t.orders, t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"])
    return known.select("o_orderkey", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(nullif(l_discount, 0), 0) * l_quantity, 6) AS total FROM lineitem")
def a16_line_total(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.line_total(F.nullif(c("l_discount"), F.lit(0.0)), c("l_quantity")), 6).alias("total"))


@query("SELECT event_id, CAST(sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)")
def w7_island_id(t):
    before = R.with_previous(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return R.island_id(before, ["user_id"], ["ts", "event_id"], c("previous") != c("event_type")).select("event_id", "island")


@query(f"WITH p AS ({PLACED}) SELECT event_id, round({_KM}, 6) AS km FROM (SELECT event_id, lat AS a_lat, lon AS a_lon, CAST(-33.87 AS DOUBLE) AS b_lat, CAST(151.21 AS DOUBLE) AS b_lon FROM p WHERE lat IS NOT NULL)")
def h16_haversine(t):
    return derived(t, PLACED).filter("lat IS NOT NULL").select("event_id", F.round(S.haversine_km(c("lat"), c("lon"), F.lit(-33.87), F.lit(151.21)), 6).alias("km"))


@query("SELECT o_orderkey, round(o_totalprice - o_totalprice * 0.25, 4) AS reward FROM orders")
def h17_net(t):
    return t.orders.select("o_orderkey", F.round(S.net(c("o_totalprice"), S.pct_fee(c("o_totalprice"), 0.25)), 4).alias("reward"))


@query("SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS parts FROM lineitem GROUP BY 1")
def h24_build_message(t):
    built = R.build_message(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    items = F.from_json("message", "struct<items array<struct<l_partkey bigint>>>")["items"]["l_partkey"]
    return built.select("l_orderkey", F.array_join(items.cast("array<string>"), ",").alias("parts"))


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def l1_full_refresh(t):
    return L.full_refresh(t.orders, t.orders.select("o_orderstatus", "o_orderkey").limit(0))


@query("WITH x AS (SELECT o_custkey AS k, o_orderdate AS dt, o_orderstatus AS s, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderstatus DESC, o_orderpriority DESC) = 1), y AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY dt) AS b, lag(p) OVER (PARTITION BY k ORDER BY dt) AS q FROM x), z AS (SELECT * FROM y WHERE b IS DISTINCT FROM s OR q IS DISTINCT FROM p) SELECT k, s, p, dt AS active_from, coalesce(lead(dt) OVER (PARTITION BY k ORDER BY dt), TIMESTAMP '2099-12-31') AS active_to FROM z")
def l7_scd2_several(t):
    empty = t.spark.createDataFrame([], "k bigint, s string, p string, active_from timestamp, active_to timestamp")
    log = t.orders.select(c("o_custkey").alias("k"), c("o_orderstatus").alias("s"), c("o_orderpriority").alias("p"), c("o_orderdate").alias("dt"))
    first = L.scd2(log.filter("dt < '1998-01-01'"), empty, "k", ["s", "p"], "dt")
    return L.scd2(log.filter("dt >= '1998-01-01'"), first, "k", ["s", "p"], "dt")


@query("SELECT event_id, ts FROM events")
def l9_incremental(t):
    source, state = t.events.select("event_id", "ts"), t.spark.createDataFrame([], "workflow_key string, last_value string")
    target = source.limit(0)
    for part in (source.filter("ts < '2024-01-15'"), source):
        target, state = L.incremental(part, target, state, "events", "ts", lambda new, now: L.insert_new(new, now, ["event_id"]))
    return target


@query("SELECT CAST(o_orderkey % 4000 AS VARCHAR) AS object_id, max(o_orderdate) AS update_ts FROM orders GROUP BY 1")
def l16_land_documents(t):
    written = F.to_json(F.struct((c("o_orderkey") % 4000).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts")))
    return L.land_documents(t.orders.select(written.alias("document")), "document", ["$._id", "$.id"], "$.ts", time0()).select("object_id", "update_ts")


@query("SELECT * FROM (SELECT CAST(ts AS DATE) AS day, round(count(*) / count(DISTINCT user_id), 6) AS ratio FROM events GROUP BY 1) WHERE ratio > 2")
def d12_flag_days(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.count("*") / F.count_distinct("user_id"), 6).alias("ratio"))
    return D.flag_days(daily, "ratio", 2.0)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, l_partkey * 2 + CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END AS version_id, CAST(CAST(max(l_extendedprice) AS DECIMAL(14,2)) * CAST(max(l_quantity) AS INTEGER) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, o_orderdate")
def m7_product_sales(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").cast("decimal(14,2)").alias("price"), F.max("l_quantity").cast("int").alias("quantity"))
    item = F.struct(c("l_partkey").cast("string").alias("product_id"), "price", "quantity", F.lit(0).alias("bonus_payment"), F.lit(0).alias("bonus_grant"))
    grouped = lines.groupBy(c("l_orderkey").cast("string").alias("order_id")).agg(F.collect_list(item).alias("product_payments"))
    events = grouped.select(F.to_json(F.struct("order_id", "product_payments")).alias("event_value"))
    split = F.inline(F.expr("array(struct(p_partkey * 2 AS version_id, TIMESTAMP '1990-01-01' AS active_from, TIMESTAMP '1996-01-01' AS active_to), struct(p_partkey * 2 + 1 AS version_id, TIMESTAMP '1996-01-01' AS active_from, TIMESTAMP '2099-12-31' AS active_to))"))
    products = t.part.select(c("p_partkey").cast("string").alias("product_id"), split)
    sold = M.product_sales(events, t.orders.select(c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").alias("order_ts")), products)
    return sold.select("order_id", "product_id", "version_id", c("total_sum").cast("double").alias("total"))


@query("SELECT DISTINCT md5(concat(user_id, '_', event_id % 20)) AS plain, event_type AS event FROM events WHERE event_type IN ('signup', 'click') AND user_id IN (SELECT c_custkey FROM customer) AND event_id % 20 IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 15)")
def m12_group_activity(t):
    link = t.spark.createDataFrame([], "link_key string, hk_user_id string, hk_group_id string, load_dt timestamp, load_src string")
    satellite = t.spark.createDataFrame([], "link_id string, event string, event_dt timestamp, hashdiff string, load_dt timestamp, load_src string")
    log = t.events.filter("event_type IN ('signup', 'click')").select("user_id", (c("event_id") % 20).alias("group_id"), c("event_type").alias("event"), c("ts").alias("event_dt"))
    users, groups = t.customer.select(c("c_custkey").alias("user_id")), t.nation.filter("n_nationkey < 15").select(c("n_nationkey").alias("group_id"))
    link, satellite = M.load_group_activity(log, users, groups, link, satellite, "log", time0())
    events = satellite.select(S.md5_uuid(c("link_id")).alias("link_key"), "event").distinct()
    return link.join(events, "link_key").select(F.replace("link_key", F.lit("-"), F.lit("")).alias("plain"), "event")


@query("SELECT o_custkey AS user_id, l_returnflag AS category, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def m13_guest_counters(t):
    lines = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("l_orderkey").alias("order_id"), c("o_custkey").alias("user_id"), c("l_returnflag").alias("category"))
    counters, ledger = t.spark.createDataFrame([], "user_id bigint, category string, n bigint"), t.spark.createDataFrame([], "order_id bigint")
    for part in (lines.filter("order_id % 2 = 0"), lines):  # the second batch repeats the first
        counters, ledger = M.guest_counters(part, counters, ledger, "category", True)
    return counters


# -- scalar functions, satellites and sources that the above don't reach


@query("SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS DECIMAL(10,2)) AS DOUBLE) AS amount, json_extract_string(props, '$.k') AS first, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS money, TRY_CAST(substr(event_type, 1, 1) AS INTEGER) AS tried, date_trunc('day', ts) AS day, date_trunc('second', ts) AS parsed, date_trunc('second', ts) AS from_document, CAST(event_id AS VARCHAR) AS document_id, 'Australia/' || CASE WHEN event_type = 'click' THEN 'Perth' ELSE 'Sydney' END AS zone, timezone('Australia/Perth', timezone('UTC', date_trunc('second', ts))) AS local FROM events")
def h18_scalars(t):
    ts, props = c("ts"), c("props")
    document = F.to_json(F.struct(F.struct(c("event_id").cast("string").alias("$oid")).alias("_id"), F.struct((F.unix_timestamp(ts) * 1000).alias("$date")).alias("at")))
    return t.events.select(
        "event_id", S.json_dec(props, "$.k", 10, 2).cast("double").alias("amount"), S.first_path(props, "$.absent", "$.k").alias("first"), S.to_decimal(c("value"), 12, 2).cast("double").alias("money"), S.try_as(F.substring("event_type", 1, 1), "int").alias("tried"),
        S.day_floor(ts).alias("day"), S.parse_ts(F.date_format(ts, "dd.MM.yyyy HH:mm:ss"), "dd.MM.yyyy HH:mm:ss").alias("parsed"), S.document_ts(document, "$.at").alias("from_document"), S.document_id(document, "$.id", "$._id").alias("document_id"),
        S.city_zone(c("event_type"), {"click": "Australia/Perth"}).alias("zone"), S.to_local(S.to_second(ts), F.lit("Australia/Perth")).alias("local"),
    )


@query("SELECT user_id AS k, event_type AS s, ts AS load_dt FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY 1, 2)) WHERE b IS DISTINCT FROM event_type")
def l14_satellite_of_changes(t):
    states = t.events.groupBy(c("user_id").alias("k"), "ts").agg(F.max("event_type").alias("s"))
    target = t.spark.createDataFrame([], "k bigint, s string, hashdiff string, load_dt timestamp, load_src string")
    for part in (states.filter("ts < '2024-01-15'"), states):  # the second batch repeats the first
        target = L.load_satellite(part, target, "k", ["s"], "log", "ts")
    return target.select("k", "s", "load_dt")


@query("SELECT 'hub_' || k AS table_name, n FROM (SELECT 'user_id' AS k, count(DISTINCT o_custkey) AS n FROM j UNION ALL SELECT 'product_id', count(DISTINCT l_partkey) FROM j UNION ALL SELECT 'category', count(DISTINCT p_brand) FROM j UNION ALL SELECT 'restaurant_id', count(DISTINCT l_suppkey % 10) FROM j UNION ALL SELECT 'order_id', count(DISTINCT l_orderkey) FROM j) "
       "UNION ALL SELECT 'link_order_id_user_id', count(*) FROM (SELECT DISTINCT l_orderkey, o_custkey FROM j) UNION ALL SELECT 'link_order_id_product_id', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM j) UNION ALL SELECT 'link_product_id_restaurant_id', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey % 10 FROM j) UNION ALL SELECT 'link_product_id_category', count(*) FROM (SELECT DISTINCT l_partkey, p_brand FROM j) "
       "UNION ALL SELECT 'sat_user_names', count(DISTINCT o_custkey) FROM j UNION ALL SELECT 'sat_product_names', count(DISTINCT l_partkey) FROM j UNION ALL SELECT 'sat_restaurant_names', count(DISTINCT l_suppkey % 10) FROM j UNION ALL SELECT 'sat_order_cost', count(DISTINCT l_orderkey) FROM j UNION ALL SELECT 'sat_order_status', count(DISTINCT l_orderkey) FROM j".replace("FROM j", "FROM (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"))
def m13_guest_vault(t):
    return R.row_counts(_guest_vault(_guest_lines(t)))


def _guest_vault(lines):
    """After half of the orders and then all of them. The lines, and the first load's rows, are stored: the joins are made once, and a table's first load is not made again for its second."""
    # joined with the orders last, the lines of an order lie together, so what is distinct by order is found before it is shuffled
    lines = T.stored(lines, "guest-lines")
    first = M.guest_vault(lines.filter("order_id % 2 = 0"), M.empty_vault(lines), "orders", time0(), time0())
    first = dict(zip(first, at_once(lambda x: T.stored(x[1], x[0]), first.items())))
    return M.guest_vault(lines, first, "orders", time0(), time0())


def _guest_lines(t):
    j = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).join(t.orders, c("l_orderkey") == c("o_orderkey"))
    text = {"order_id": c("l_orderkey"), "user_id": c("o_custkey"), "user_name": F.concat(F.lit("u"), c("o_custkey")), "restaurant_id": c("l_suppkey") % 10, "restaurant_name": F.concat(F.lit("r"), c("l_suppkey") % 10), "product_id": c("l_partkey"), "product_name": c("p_name"), "category": c("p_brand"), "status": c("o_orderstatus")}
    money = c("o_totalprice").cast("decimal(18,2)")
    return j.select(*[v.cast("string").alias(k) for k, v in text.items()], money.alias("cost"), money.alias("payment"))


def uuid_sql(x: str) -> str:
    return f"CAST(CAST(md5({x}) AS UUID) AS VARCHAR)"


def vault_sql(lines: str) -> str:
    """All rows of the vault's tables: table_name, key, load_dt and the other columns as text. ``lines``: SQL of order lines with order_dt; a state of a key holds from its first time on."""
    load = "2024-02-01 00:00:00"
    parts = [f"SELECT 'hub_{k}' AS table_name, {uuid_sql(k)} AS key, '{load}' AS load_dt, concat_ws('|', {k}, 'orders') AS rest FROM (SELECT DISTINCT {k} FROM l)" for k in M.HUBS]
    parts += [f"SELECT 'link_{a}_{b}', {uuid_sql(f'concat({a}, chr(95), {b})')}, '{load}', concat_ws('|', {uuid_sql(a)}, {uuid_sql(b)}, 'orders') FROM (SELECT DISTINCT {a}, {b} FROM l)" for a, b in M.LINKS]
    for name, (key, attributes) in M.SATELLITES.items():
        text = ", ".join(attributes)
        parts.append(f"SELECT 'sat_{name}', {key}, strftime(min(order_dt), '%Y-%m-%d %H:%M:%S'), concat_ws('|', {text}, {uuid_sql(f'concat_ws(chr(95), {text})')}, 'orders') FROM l GROUP BY {key}, {text}")
    return f"WITH l AS ({lines}) " + " UNION ALL ".join(parts)


def vault_as_rows(vault: dict[str, DataFrame]) -> DataFrame:
    """A vault's tables as one, see ``vault_sql``."""
    one = lambda name, df: df.select(F.lit(name).alias("table_name"), c(df.columns[0]).alias("key"), F.date_format("load_dt", "yyyy-MM-dd HH:mm:ss").alias("load_dt"), F.concat_ws("|", *[x for x in df.columns[1:] if x != "load_dt"]).alias("rest"))
    return R.union_all(*[one(name, df) for name, df in vault.items()])


@query(vault_sql("SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, concat('u', o_custkey) AS user_name, CAST(l_suppkey % 10 AS VARCHAR) AS restaurant_id, concat('r', l_suppkey % 10) AS restaurant_name, CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS category, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS cost, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS payment, o_orderstatus AS status, TIMESTAMP '2024-02-01' AS order_dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"))
def m13_guest_vault_rows(t):
    """The fourteen tables whole: keys, hashes, attributes."""
    return vault_as_rows(_guest_vault(_guest_lines(t)))


@query(_ODS + "SELECT o.event_id, o.ts, o.user_id, o.event_type, o.lat, o.lon, city_id, city, distance_km, 'Australia/' || CASE WHEN city IN ('ALGERIA', 'BRAZIL') THEN 'Perth' ELSE 'Sydney' END AS zone FROM o")
def m1_events_whole(t):
    """All columns of the events with their cities."""
    ods = M.events_with_cities(derived(t, PLACED), derived(t, CITIES), {"ALGERIA": "Australia/Perth", "BRAZIL": "Australia/Perth"})
    return ods.select("event_id", "ts", "user_id", "event_type", "lat", "lon", "city_id", "city", F.round("distance_km", 6).alias("distance_km"), "zone")


@query("WITH l AS (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice * 0.01 AS DECIMAL(14,2)) AS pay, CAST(l_tax * 100 AS DECIMAL(14,2)) AS grnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY price DESC, q DESC, pay DESC, grnt DESC) = 1) "
       "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, l_partkey * 3 + CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 2 ELSE 0 END AS version_id, q AS count, CAST(price AS DOUBLE) AS price, CAST(price * q AS DOUBLE) AS total_sum, CAST(pay AS DOUBLE) AS bonus_payment, CAST(grnt AS DOUBLE) AS bonus_grant FROM l JOIN part ON l_partkey = p_partkey")
def m7_product_sales_whole(t):
    """Every line of every order as it stands in the events, with its bonuses; products of three versions, of which the last is closed, so a fact before or after all of them takes the newest."""
    item = F.struct(c("l_partkey").cast("string").alias("product_id"), c("l_extendedprice").cast("decimal(14,2)").alias("price"), c("l_quantity").cast("int").alias("quantity"), S.nearest_decimal(c("l_extendedprice") * 0.01, 14, 2).alias("bonus_payment"), S.nearest_decimal(c("l_tax") * 100, 14, 2).alias("bonus_grant"))
    grouped = t.lineitem.groupBy(c("l_orderkey").cast("string").alias("order_id")).agg(F.collect_list(item).alias("product_payments"))
    events = grouped.select(F.to_json(F.struct("order_id", "product_payments")).alias("event_value"))
    at = ("1990-01-01", "1996-01-01", "1999-01-01", "2099-12-31")
    split = F.inline(F.array(*[F.struct((c("p_partkey") * 3 + n % 3).alias("version_id"), F.lit(a).cast("timestamp").alias("active_from"), F.lit(b).cast("timestamp").alias("active_to")) for n, a, b in zip((1, 2, 3), at, at[1:])]))
    products = t.part.select(c("p_partkey").cast("string").alias("product_id"), split)
    sold = M.product_sales(events, t.orders.select(c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").alias("order_ts")), products)
    return sold.withColumns({k: c(k).cast("double") for k in ("price", "total_sum", "bonus_payment", "bonus_grant")})


@query(f"WITH l AS (SELECT user_id, event_id % 20 AS group_id, event_type AS event, ts, event_id % 9 AS user_id_from FROM events WHERE event_type IN ('signup', 'click') AND user_id IN (SELECT c_custkey FROM customer) AND event_id % 20 IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 15)) SELECT DISTINCT 'link' AS table_name, {uuid_sql('concat(user_id, chr(95), group_id)')} AS key, concat_ws('|', {uuid_sql('CAST(user_id AS VARCHAR)')}, {uuid_sql('CAST(group_id AS VARCHAR)')}) AS rest, CAST(NULL AS TIMESTAMP) AS event_dt FROM l UNION ALL SELECT 'satellite', concat(user_id, '_', group_id), concat_ws('|', min(user_id_from), event), ts FROM l GROUP BY user_id, group_id, event, ts")
def m12_group_activity_whole(t):
    """Link and satellite whole, after the same log twice."""
    link = t.spark.createDataFrame([], "link_key string, hk_user_id string, hk_group_id string, load_dt timestamp, load_src string")
    satellite = t.spark.createDataFrame([], "link_id string, user_id_from bigint, event string, event_dt timestamp, hashdiff string, load_dt timestamp, load_src string")
    log = t.events.filter("event_type IN ('signup', 'click')").select("user_id", (c("event_id") % 20).alias("group_id"), (c("event_id") % 9).alias("user_id_from"), c("event_type").alias("event"), c("ts").alias("event_dt"))
    users, groups = t.customer.select(c("c_custkey").alias("user_id")), t.nation.filter("n_nationkey < 15").select(c("n_nationkey").alias("group_id"))
    for _ in range(2):
        link, satellite = M.load_group_activity(log, users, groups, link, satellite, "log", time0())
    links = link.select(F.lit("link").alias("table_name"), c("link_key").alias("key"), F.concat_ws("|", "hk_user_id", "hk_group_id").alias("rest"), F.lit(None).cast("timestamp").alias("event_dt"))
    return links.unionByName(satellite.select(F.lit("satellite").alias("table_name"), c("link_id").alias("key"), F.concat_ws("|", "user_id_from", "event").alias("rest"), "event_dt"))


@query("SELECT DISTINCT o_custkey, o_orderstatus, md5(concat(o_custkey, chr(31), o_orderstatus))[1:8] AS high FROM orders")
def h4_hash_key(t):
    key = S.hash_key(c("o_custkey"), c("o_orderstatus"))
    return t.orders.select("o_custkey", "o_orderstatus", F.lower(F.lpad(F.hex(F.shiftrightunsigned(key, 32)), 8, "0")).alias("high")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'u' || l_suppkey AS user_name, 'r' || l_orderkey % 7 AS restaurant_name, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS category FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def s12_document_lookup(t):
    """Users and restaurants are JSON documents under their ids, the restaurants' with a menu; of several documents of an id the newest counts. Order lines look up names and categories by id."""
    user = lambda name: F.struct(F.struct(c("s_suppkey").cast("string").alias("$oid")).alias("_id"), name.alias("name"), F.lit("2024-01-02").alias("update_ts"))
    older = t.supplier.select(F.to_json(F.struct(c("s_suppkey").cast("string").alias("_id"), F.lit("old").alias("name"), F.lit("2024-01-01").alias("update_ts"))).alias("document"))
    users = older.unionByName(t.supplier.select(F.to_json(user(F.concat(F.lit("u"), "s_suppkey"))).alias("document")))
    # a menu is one document, so the parts are dealt over the seven restaurants
    menu = F.collect_list(F.struct(c("p_partkey").cast("string").alias("_id"), c("p_brand").alias("category"))).alias("menu")
    menus = t.part.filter("p_size > 25").groupBy((c("p_partkey") % 7).alias("r")).agg(menu)
    restaurants = menus.select(F.to_json(F.struct(c("r").cast("string").alias("_id"), F.concat(F.lit("r"), "r").alias("name"), F.lit("2024-01-01").alias("update_ts"), "menu")).alias("document"))
    users, restaurants = (L.read_documents(x, "struct<name string, menu array<struct<_id string, category string>>>", ["$._id"], "$.update_ts", time0()) for x in (users, restaurants))
    items = restaurants.select(F.explode("value.menu").alias("m")).select(c("m._id").alias("part"), c("m.category").alias("category"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c("l_suppkey").cast("string").alias("user"), (c("l_orderkey") % 7).cast("string").alias("restaurant"), c("l_partkey").cast("string").alias("part"))
    named = lines.join(users.select(c("object_id").alias("user"), c("value.name").alias("user_name")), "user").join(restaurants.select(c("object_id").alias("restaurant"), c("value.name").alias("restaurant_name")), "restaurant")
    return R.enrich_items(named, items, ["part"], "category").select("l_orderkey", "l_linenumber", "l_partkey", "user_name", "restaurant_name", "category")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS position, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END AS data_type, true AS nullable, (SELECT count(*) FROM {n}) AS n_rows FROM (DESCRIBE {n})" for n in ("orders", "lineitem", "part")))
def d11_schemas(t):
    """The columns of tables, beside how many rows each table has."""
    tables = {n: getattr(t, n) for n in ("orders", "lineitem", "part")}
    return D.describe_schema(t.spark, tables).join(R.row_counts(tables).withColumnRenamed("n", "n_rows"), "table_name")


# -- joins and windows of hot keys, large groups and many places

_HOT_ROWS = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS user_id, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_HOT_VERSIONS = "SELECT user_id, version_id, active_from, coalesce(lead(active_from) OVER (PARTITION BY user_id ORDER BY active_from), TIMESTAMP '2001-06-01') AS active_to FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS user_id, max(o_orderkey) AS version_id, o_orderdate AS active_from FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 3)"


@query(f"WITH v AS ({_HOT_VERSIONS}), r AS ({_HOT_ROWS}), m AS (SELECT user_id, max_by(version_id, active_from) AS newest FROM v GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE WHEN l_shipdate < active_to THEN version_id ELSE newest END AS version_id FROM r JOIN m USING (user_id) ASOF LEFT JOIN v ON r.user_id = v.user_id AND l_shipdate >= active_from")
def j10_asof_hot_key(t):
    """A third of all rows and versions are of one key, which is cut into slices of a month."""
    found = R.asof_join(derived(t, _HOT_ROWS), derived(t, _HOT_VERSIONS), "user_id", "l_shipdate", fallback="latest", width=30)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "version_id")


@query(_STAYS.replace("FROM events", "FROM (SELECT event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id FROM events)"))
def w8_stays_hot_key(t):
    """A third of all events are one user's, whose days are cut apart and stitched."""
    events = t.events.withColumn("user_id", F.when(c("event_id") % 3 == 0, 7).otherwise(c("user_id")))
    return R.stays(events, "user_id", "ts", "event_id", "event_type", 2, width=1)


@query("WITH d AS (SELECT DISTINCT c_nationkey AS g, c_custkey AS u FROM customer) SELECT a.u AS left, b.u AS right FROM d a JOIN d b ON a.g = b.g AND a.u < b.u")
def j5_pairs_in_blocks(t):
    """Customers of one nation, whose groups are cut into blocks of sixteen."""
    return R.peer_pairs(t.customer, "c_custkey", "c_nationkey", block=16)


SPOTS = "SELECT c_custkey AS city_id, c_name AS city, (c_custkey * 7919 % 18001) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36001) / 100.0 - 180 AS lng FROM customer"
POINTS = "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN (event_id * 6007 % 180001) / 1000.0 - 90 END AS lat, (event_id * 90001 % 360001) / 1000.0 - 180 AS lon FROM events"
_GLOBE_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lon) / 2), 2))))"


@query(f"WITH a AS ({POINTS}), b AS ({SPOTS}) SELECT event_id, round(min({_GLOBE_KM}), 4) AS distance_km FROM a, b WHERE a.lat IS NOT NULL GROUP BY 1 UNION ALL SELECT event_id, NULL FROM a WHERE lat IS NULL")
def j17_nearest_of_many(t):
    """The nearest of as many places as there are customers, over the whole globe, from cubes that are refined together."""
    found = G.nearest_of_many(derived(t, POINTS), derived(t, SPOTS), "lat", "lon")
    return found.select("event_id", F.round("distance_km", 4).alias("distance_km"))


@query(f"WITH a AS (SELECT city_id, lat, lng AS lon FROM ({SPOTS})), b AS ({SPOTS}) SELECT a.city_id AS a, b.city_id AS b FROM a, b WHERE a.city_id < b.city_id AND {_GLOBE_KM} <= 400")
def j18_pairs_within(t):
    """Pairs of places within 400 km, over date line and poles."""
    places = derived(t, SPOTS).select("city_id", "lat", "lng")
    near = G.pairs_within(places, places, 400, "lat", "lng", block=8, where="l.city_id < r.city_id")
    return near.select(c("l.city_id").alias("a"), c("r.city_id").alias("b"))


@query(ORACLE_SQL["l7_scd2_several"])
def l7_scd2_late_rows(t):
    """The same history as by ordered arrival, from three loads in which rows come long after later ones."""
    log = t.orders.select(c("o_custkey").alias("k"), c("o_orderstatus").alias("s"), c("o_orderpriority").alias("p"), c("o_orderdate").alias("dt"), F.pmod(F.xxhash64("o_orderkey"), F.lit(3)).alias("load"))
    versions = t.spark.createDataFrame([], "k bigint, s string, p string, active_from timestamp, active_to timestamp")
    seen = t.spark.createDataFrame([], "k bigint, s string, p string, dt timestamp")
    for n in (2, 0, 1):
        versions, seen = L.scd2_of_log(log.filter(c("load") == n), versions, seen, "k", ["s", "p"], "dt")
    return versions
