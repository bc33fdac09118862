"""End-to-end marts, each a composition of the library's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions.scalar import as_date, city_zone, hashdiff, md5_bigint, month_of, safe_div, signed, to_local, week_of
from siltworks.operators import geo as G
from siltworks.operators import relational as R
from siltworks.operators.loads import apply_counters, insert_new, load_link, missing_hubs, missing_links, satellite_changes
from siltworks.sources.tables import stored

#: Share of an order's sum that a courier gets and the least per order, by average rate below the bound (fixed values).
PAYOUT_BANDS = [(4.0, 0.05, 100.0), (4.5, 0.07, 150.0), (4.9, 0.08, 175.0), (None, 0.10, 200.0)]
FEE, TIPS_SHARE = 0.25, 0.95
#: Most channels, and most users written to, that lie beside a user as a list.
FEW = 1000


def events_with_cities(events: DataFrame, cities: DataFrame, zones: dict[str, str] | None = None, message: str = "message") -> DataFrame:
    """Each event with coordinates, its own or those of its user's last message that has some, and the nearest city, its distance and zone. One row per event."""
    known = events.filter((F.col("event_type") == message) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("user_id").isNotNull())
    last = known.groupBy("user_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "event_id")).alias("_last"))
    placed = events.join(last, "user_id", "left").withColumns({"lat": F.coalesce("lat", "_last.lat"), "lon": F.coalesce("lon", "_last.lon")}).drop("_last")
    placed = placed.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return G.nearest_place(placed, cities, "lat", "lon").withColumn("zone", city_zone(F.col("city"), zones or {}))


def user_geo_report(ods: DataFrame, min_days: int = 27, message: str = "message") -> DataFrame:
    """Per user: act_city (of the last message), home_city (of the latest stay of min_days), travel_count and travel_array (each arrival, the first city included), local_time of the last message."""
    messages = ods.filter((F.col("event_type") == message) & F.col("city").isNotNull() & F.col("user_id").isNotNull())
    act = R.latest_per(messages, ["user_id"], "ts", "event_id").select("user_id", F.col("city").alias("act_city"), to_local(F.col("ts"), F.col("zone")).alias("local_time"))
    home = R.latest_stay(R.stays(messages, "user_id", "ts", "event_id", "city", min_days), "user_id").select("user_id", F.col("city").alias("home_city"))
    moves = R.with_previous(messages, ["user_id"], ["ts", "event_id"], "city").filter(F.col("previous").isNull() | (F.col("previous") != F.col("city")))
    travels = R.ordered_list(moves, ["user_id"], ["ts", "event_id"], "city", "travel_array").withColumn("travel_count", F.size("travel_array").cast("bigint"))
    return act.join(home, "user_id", "left").join(travels, "user_id", "left").select("user_id", "act_city", "home_city", "travel_count", "travel_array", "local_time")


def zone_mart(ods: DataFrame, types: tuple[str, ...] = ("message", "reaction", "subscription"), registration: str = "registration") -> DataFrame:
    """Counts of each type and of registrations (a user's first message) per city and week, with those of the month of the week's Monday."""
    first = R.first_per(ods.filter((F.col("event_type") == types[0]) & F.col("user_id").isNotNull()), ["user_id"], "ts", "event_id").withColumn("event_type", F.lit(registration))
    every = R.union_all(ods.filter(F.col("event_type").isin(*types)), first).withColumns({"week": week_of(F.col("ts")), "month": month_of(F.col("ts"))})
    kinds = [*types, registration]
    # one pass: each small count goes to its week and its month, and a window brings the month's sums to the weeks
    counted = R.pivot_counts(every, ["city_id", "week", "month"], "event_type", kinds)
    periods = F.explode(F.array(F.struct(F.lit("week").alias("kind"), F.col("week").alias("period")), F.struct(F.lit("month").alias("kind"), F.col("month").alias("period")))).alias("x")
    sums = counted.select("city_id", periods, *[f"n_{k}" for k in kinds]).groupBy("city_id", "x.kind", "x.period").agg(*[F.sum(f"n_{k}").alias(f"week_{k}") for k in kinds])
    of = Window.partitionBy("city_id", "month")
    both = sums.withColumn("month", month_of(F.col("period"))).withColumns({f"month_{k}": F.max(F.when(F.col("kind") == "month", F.col(f"week_{k}"))).over(of) for k in kinds})
    return both.filter("kind = 'week'").select("city_id", "month", F.col("period").alias("week"), *[f"{p}_{k}" for p in ("week", "month") for k in kinds])


def friend_recommendations(ods: DataFrame, subscriptions: DataFrame, messages: DataFrame, km: float = 1.0) -> DataFrame:
    """Pairs (user_left < user_right) that share a channel, never wrote to each other and were last at most ``km`` apart in the same city.

    ``subscriptions``: user_id, channel; ``messages``: user_from, user_to; ``ods``: as events_with_cities returns it. Users of a channel meet
    those in the same and neighbouring cubes of side ``km`` only, so a very large channel of one city has little more candidates than pairs (see ``pairs_within``).

    A pair is made once, in the first channel of both, and is not shuffled: beside a user lie their channels and those of their city whom they wrote to. The largest channels come first and are bits of a
    number, so two numbers tell whether a pair was made before; the smaller ones are listed. Users with over ``FEW`` listed of either have no such lists; pairs that they are in are made distinct and looked up among the messages.
    """
    last = stored(R.latest_per(ods.filter("user_id IS NOT NULL"), ["user_id"], "ts", "event_id").select("user_id", "city_id", "lat", "lon", "zone", "ts"), "last")
    subscribed = subscriptions.dropna().distinct()
    wrote = R.canonical_pair(messages, "user_from", "user_to").select(F.col("left").alias("user_left"), F.col("right").alias("user_right")).dropna().distinct()
    city = last.select("user_id", "city_id")
    beside = wrote.join(city.toDF("user_left", "city_id"), "user_left").join(city.toDF("user_right", "_city"), "user_right").filter("city_id = _city")

    def lists(df: DataFrame, user: str, of: str, alias: str) -> DataFrame:
        ranked = df.select(F.col(user).alias("user_id"), of).withColumn("_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(of)))
        return ranked.filter(F.col("_rank") <= FEW + 1).groupBy("user_id").agg(F.sort_array(F.collect_list(of)).alias(alias))

    largest = subscribed.groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(R.LARGEST)
    ranked = subscribed.join(F.broadcast(largest.select("channel", (F.row_number().over(Window.orderBy(F.desc("n"), "channel")) - 1).alias("_rank"))), "channel", "left")
    bit = F.expr("shiftleft(1L, _rank)")
    bits = ranked.groupBy("user_id").agg(F.coalesce(F.sum(bit), F.lit(0).cast("bigint")).alias("bits"))
    users = last.join(bits, "user_id").join(lists(ranked.filter("_rank IS NULL"), "user_id", "channel", "channels"), "user_id", "left").join(lists(beside, "user_left", "user_right", "wrote"), "user_id", "left")
    users = users.withColumn("many", (F.coalesce(F.size("channels"), F.lit(0)) > FEW) | (F.coalesce(F.size("wrote"), F.lit(0)) > FEW))
    members = stored(ranked.join(users, "user_id").withColumn("before", F.coalesce(bit - 1, F.lit(-1).cast("bigint"))).drop("_rank"), "members")  # the bits of the channels before this one
    beside_ = ["many", "bits", "before", "channels", "wrote"]
    few, many = members.filter("NOT many").drop("many"), members.filter("many").drop(*beside_)
    order, on = "l.user_id < r.user_id", ["channel", "city_id"]
    once = "l.bits & r.bits & l.before = 0 AND (l.before >= 0 OR l.channel = array_min(array_intersect(l.channels, r.channels))) AND (l.wrote IS NULL OR NOT array_contains(l.wrote, r.user_id))"
    pair = [F.col("l.user_id").alias("user_left"), F.col("r.user_id").alias("user_right"), "l.city_id", "l.zone", "l.ts"]
    near = G.pairs_within(few, few.drop("before", "wrote", "zone", "ts"), km, on=on, where=f"{order} AND {once}").select(*pair)
    any_ = members.drop(*beside_)
    rest = G.pairs_within(any_, many, km, on=on, where=order).select(*pair).unionByName(G.pairs_within(many, few.drop(*beside_), km, on=on, where=order).select(*pair))
    fresh = near.unionByName(R.exclude(rest.distinct(), wrote, ["user_left", "user_right"]))
    return fresh.select("user_left", "user_right", "city_id", to_local(F.col("ts"), F.col("zone")).alias("local_time"))


def f_sales(order_log: DataFrame, negative: str = "refunded") -> DataFrame:
    """The newest row of each order and status, with unit price and signed amount.

    ``order_log``: uniq_id, date_time, customer_id, item_id, quantity, payment_amount, status.
    """
    newest = R.top_per(order_log, ["uniq_id", "status"], [F.desc_nulls_last(x) for x in ("date_time", "item_id", "payment_amount", "quantity", "customer_id")])
    amount = F.col("payment_amount")
    return newest.select(md5_bigint(F.col("uniq_id")).alias("order_id"), as_date(F.col("date_time")).alias("date_id"), "item_id", "customer_id", "quantity", "status", safe_div(amount, F.col("quantity")).alias("price"), signed(amount, F.col("status"), negative).alias("payment_amount"))


def f_customer_retention(sales: DataFrame, shipped: str = "shipped", refunded: str = "refunded") -> DataFrame:
    """Per week and item: new customers (one shipped order this week and none of any item before), returning (more, or history), refunded; their numbers and revenue."""
    week = sales.withColumn("period_id", week_of(F.col("date_id")))
    per = R.filtered_agg(week, ["period_id", "item_id", "customer_id"], {"n_shipped": ("count(*)", f"status = '{shipped}'"), "n_refunded": ("count(*)", f"status = '{refunded}'"), "shipped_sum": ("sum(payment_amount)", f"status = '{shipped}'"), "refunded_sum": ("sum(abs(payment_amount))", f"status = '{refunded}'")})
    known = R.has_history(per, "customer_id", "period_id", sales.filter(F.col("status") == shipped), "date_id")
    new, back, refund = "n_shipped = 1 AND NOT has_history", "(n_shipped > 1 OR has_history)", "n_refunded > 0"
    return R.agg_by(known, ["period_id", "item_id"], {
        "new_customers_count": f"count_if({new})", "returning_customers_count": f"count_if({back})", "refunded_customer_count": f"count_if({refund})",
        "new_customers_revenue": f"coalesce(sum(shipped_sum) FILTER (WHERE {new}), 0)", "returning_customers_revenue": f"coalesce(sum(shipped_sum) FILTER (WHERE {back}), 0)", "customers_refunded": f"coalesce(sum(refunded_sum), 0)",
    })


def product_sales(bonus_events: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Sales lines of bonus events: (order_id, product_id, version_id, count, price, total_sum, bonus_payment, bonus_grant).

    ``bonus_events``: event_value, JSON with order_id and product_payments; ``orders``: order_id, order_ts; ``products``: version_id, product_id, active_from, active_to.
    """
    lines = R.explode_json(bonus_events.select(F.get_json_object("event_value", "$.order_id").alias("order_id"), F.get_json_object("event_value", "$.product_payments").alias("payments")), "payments", "struct<product_id string, price decimal(14,2), quantity int, bonus_payment decimal(14,2), bonus_grant decimal(14,2)>")
    split = lines.select("order_id", "item.*")
    # of a product's lines in an order the greatest by price, quantity and bonuses counts; dealt by order, as the join with the orders needs them too
    newest = R.top_per(split.repartition("order_id"), ["order_id", "product_id"], [F.desc_nulls_last(x) for x in split.columns if x not in ("order_id", "product_id")])
    found = R.asof_join(newest.join(orders, "order_id"), products, "product_id", "order_ts", fallback="latest", width=365)
    return found.select("order_id", "product_id", "version_id", F.col("quantity").alias("count"), "price", (F.col("price") * F.col("quantity")).cast("decimal(14,2)").alias("total_sum"), "bonus_payment", "bonus_grant")


def settlement_report(facts: DataFrame, orders: DataFrame, restaurants: DataFrame, closed: str = "CLOSED") -> DataFrame:
    """Per restaurant and day: closed orders, sums, a fee of a quarter and the reward that is left.

    ``facts``: order_id, total_sum, bonus_payment, bonus_grant; ``orders``: order_id, restaurant_id, order_date, status; ``restaurants``: restaurant_id, restaurant_name.
    """
    done = R.join_dims(facts, [(orders.filter(F.upper("status") == closed.upper()), "order_id"), (restaurants, "restaurant_id")])
    sums = done.groupBy("restaurant_id", "restaurant_name", "order_date").agg(F.count_distinct("order_id").alias("orders_count"), *[R.sum0(F.col(c)).alias(f"{c}_total") for c in ("total_sum", "bonus_payment", "bonus_grant")])
    fee = (F.col("total_sum_total") * F.lit(FEE).cast("decimal(3,2)")).cast("decimal(14,2)")
    return sums.withColumn("order_processing_fee", fee).withColumn("restaurant_reward_sum", (F.col("total_sum_total") - F.col("order_processing_fee") - F.col("bonus_payment_total")).cast("decimal(14,2)"))


def courier_ledger(deliveries: DataFrame, bands: list = PAYOUT_BANDS) -> DataFrame:
    """Per courier and month: orders, sums, average rate, fee, payout by the average rate's band and reward.

    ``deliveries``: courier_id, order_id, order_ts, rate, sum, tip_sum.
    """
    keyed = deliveries.withColumns({"settlement_year": F.year("order_ts"), "settlement_month": F.month("order_ts")})
    keys = ["courier_id", "settlement_year", "settlement_month"]
    both = keyed.withColumn("rate_avg", F.avg("rate").over(Window.partitionBy(*keys)))
    out = both.groupBy(*keys).agg(F.count_distinct("order_id").alias("orders_count"), F.sum("sum").alias("orders_total_sum"), F.max("rate_avg").alias("rate_avg"), R.payout(F.col("rate_avg"), F.col("sum"), bands).alias("courier_order_sum"), F.sum("tip_sum").alias("courier_tips_sum"))
    return out.withColumns({"order_processing_fee": F.col("orders_total_sum") * FEE, "courier_reward_sum": F.col("courier_order_sum") + F.col("courier_tips_sum") * TIPS_SHARE})


def group_conversion(members: DataFrame, groups: DataFrame, messages: DataFrame, k: int = 10) -> DataFrame:
    """Of the k oldest groups: distinct users who joined, who wrote, and their ratio, the best first.

    ``members``: group_id, user_id (who were added); ``groups``: group_id, registered; ``messages``: group_id, user_id.
    """
    oldest = groups.orderBy("registered", "group_id").limit(k).select("group_id")
    added = R.only_in(members, oldest, ["group_id"]).groupBy("group_id").agg(F.count_distinct("user_id").alias("cnt_added_users"))
    wrote = R.only_in(messages, oldest, ["group_id"]).groupBy("group_id").agg(F.count_distinct("user_id").alias("cnt_users_in_group_with_messages"))
    both = R.left_join(added, wrote, "group_id").fillna(0, ["cnt_users_in_group_with_messages"])
    ratio = safe_div(F.col("cnt_users_in_group_with_messages").cast("double"), F.col("cnt_added_users").cast("double"))
    return both.withColumn("group_conversion", ratio).orderBy(F.desc("group_conversion"), "group_id")


def global_metrics(transactions: DataFrame, rates: DataFrame, target: int = 420) -> DataFrame:
    """Per day and currency: the sum in the target currency, transactions, their average by account, accounts.

    ``transactions``: operation_id, account_number_from, currency_code, amount, transaction_dt. The newest row of an operation counts, test accounts and
    amounts that aren't positive then go, and a missing rate is 1.
    """
    newest = R.dedup_newest(transactions, ["operation_id"], "transaction_dt", "amount")
    clean = R.clean_payments(newest, "account_number_from", "amount")
    rated = R.join_rate(clean, rates, "currency_code", "transaction_dt", target).withColumn("date_update", F.to_date("transaction_dt"))
    accounts = F.count_distinct("account_number_from")
    return rated.groupBy("date_update", F.col("currency_code").alias("currency_from")).agg(F.sum(F.col("amount") * F.coalesce("rate", F.lit(1))).cast("decimal(18,2)").alias("amount_total"), F.count_distinct("operation_id").alias("cnt_transactions"), safe_div(F.count_distinct("operation_id"), accounts).cast("decimal(18,2)").alias("avg_transactions_per_account"), accounts.alias("cnt_accounts_make_transactions"))


def load_group_activity(log: DataFrame, users: DataFrame, groups: DataFrame, link: DataFrame, satellite: DataFrame, load_src: str, load_dt: Column) -> tuple[DataFrame, DataFrame]:
    """(link, satellite) of the join and leave log (user_id, group_id, event, event_dt); rows of unknown users or groups go.

    An event of a user and group at one time is one row of the satellite; columns that it has besides (such as user_id_from) come from the log, the least of several.
    """
    known, _ = R.resolve_keys(log, users.select("user_id"), ["user_id"])
    known, _ = R.resolve_keys(known, groups.select("group_id"), ["group_id"])
    fixed = {"link_id": F.concat_ws("_", "user_id", "group_id"), "hashdiff": hashdiff(F.col("event"), F.col("event_dt")), "load_dt": load_dt, "load_src": F.lit(load_src)}
    rows = known.select(*[fixed[k].alias(k) if k in fixed else F.col(k) for k in satellite.columns])
    return load_link(known, link, ["user_id", "group_id"], load_src, load_dt), insert_new(rows, satellite, ["link_id", "hashdiff"])


#: Business keys, links of them, and what describes them (fixed names).
HUBS = ("user_id", "product_id", "category", "restaurant_id", "order_id")
LINKS = (("order_id", "user_id"), ("order_id", "product_id"), ("product_id", "restaurant_id"), ("product_id", "category"))
SATELLITES = {"user_names": ("user_id", ["user_name"]), "product_names": ("product_id", ["product_name"]), "restaurant_names": ("restaurant_id", ["restaurant_name"]), "order_cost": ("order_id", ["cost", "payment"]), "order_status": ("order_id", ["status"])}


def empty_vault(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of the guest vault without rows."""
    types, of = dict(lines.dtypes), lines.sparkSession.createDataFrame
    out = {f"hub_{k}": of([], f"hub_key string, {k} string, load_dt timestamp, load_src string") for k in HUBS}
    out |= {f"link_{a}_{b}": of([], f"link_key string, hk_{a} string, hk_{b} string, load_dt timestamp, load_src string") for a, b in LINKS}
    for name, (key, attributes) in SATELLITES.items():
        out[f"sat_{name}"] = of([], ", ".join(f"{c} {types[c]}" for c in (key, *attributes)) + ", hashdiff string, load_dt timestamp, load_src string")
    return out


def guest_vault(lines: DataFrame, vault: dict[str, DataFrame], load_src: str, load_dt: Column, order: str | Column) -> dict[str, DataFrame]:
    """The five hubs, four links and five satellites after order lines (order_id, user_id, user_name, restaurant_id, restaurant_name, product_id, product_name, category, cost, payment, status).

    ``order``: the time of each line's state, or that of all.
    """
    return {name: vault[name].unionByName(rows) for name, rows in vault_rows(lines, vault, load_src, load_dt, order).items()}


def vault_rows(lines: DataFrame, vault: dict[str, DataFrame], load_src: str, load_dt: Column, order: str | Column) -> dict[str, DataFrame]:
    """What the tables of the guest vault lack of the order lines. ``vault`` need only hold rows with the lines' keys."""
    hubs = {f"hub_{k}": missing_hubs(lines, vault[f"hub_{k}"], k, load_src, load_dt) for k in HUBS}
    links = {f"link_{a}_{b}": missing_links(lines, vault[f"link_{a}_{b}"], [a, b], load_src, load_dt) for a, b in LINKS}
    return hubs | links | {f"sat_{n}": satellite_changes(lines, vault[f"sat_{n}"], key, attributes, load_src, order) for n, (key, attributes) in SATELLITES.items()}


def guest_counters(lines: DataFrame, counters: DataFrame, ledger: DataFrame, by: str, once_per_order: bool) -> tuple[DataFrame, DataFrame]:
    """(counters, ledger) of orders per user and ``by``: a category counts once an order, a product every time."""
    return apply_counters(lines, counters, ledger, "order_id", ["user_id", by], once_per_order)
