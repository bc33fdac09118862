"""What the queries don't cover: files, streams, document dates, versions that overlap, edges of each operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltworks.functions import scalar as S
from siltworks.operators import checks as D
from siltworks.operators import loads as L
from siltworks.operators import relational as R
from siltworks.plans import marts as M
from siltworks.sources import tables as T
from siltworks.sources.commits import Store
from siltworks.streaming import streams as X


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def test_document_dates_and_ids(spark):
    docs = ['{"d": {"$date": "2024-01-02T03:04:05Z"}}', '{"d": {"$date": {"$numberLong": "1704164645000"}}}', '{"d": "1704164645"}', '{"d": 1704164645000}', '{"d": "2024-01-02 03:04:05"}', '{"d": "soon"}', "{}", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in docs], "j string").select(S.document_ts(F.col("j"), "$.d")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 5 + [None] * 3
    ids = spark.createDataFrame([('{"_id": {"$oid": "a"}}',), ('{"id": "b"}',), ("{}",)], "j string").select(S.document_id(F.col("j"), "$._id", "$.id"))
    assert [r[0] for r in ids.collect()] == ["a", "b", None]


def test_scalars(spark):
    row = spark.range(1).select(
        S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), S.md5_bigint(F.lit("abc")).alias("h"), S.parse_ts(F.lit("02/01/2024"), "yyyy-MM-dd", "dd/MM/yyyy").alias("ts"),
        S.parse_ts(F.lit("x"), "yyyy").alias("none"), S.join_key(F.lit(1), F.lit(None).cast("int")).alias("k"), S.city_zone(F.lit("Perth"), {"Perth": "Australia/Perth"}).alias("z"), S.city_zone(F.lit("?"), {}).alias("z0"),
        S.to_local(now(), F.lit("Australia/Sydney")).alias("local"), S.try_as(F.lit("x"), "int").alias("t"), S.epoch_now(5).alias("e"), S.hashdiff(F.lit("a"), F.lit(None).cast("string")).alias("d"), S.line_total(F.lit(None).cast("int"), F.lit(2)).alias("n"),
    ).first()
    assert row.half == pytest.approx(20015.08, abs=0.1) and row.h == -8070080442485551184
    assert row.ts == dt.datetime(2024, 1, 2) and row.none is None and row.k is None and row.z == "Australia/Perth" and row.z0 == "Australia/Sydney"
    assert row.local == dt.datetime(2024, 5, 1, 10) and row.t is None and row.e == 5 and len(row.d) == 36 and row.n == 0


def test_doubles_near_a_half_cent_round_as_in_duckdb(spark):
    import duckdb

    prices = [52567.5, 25752.5, 51829.5, 56429.5, 103321.5, 12.5, 37.5, -52567.5, -12.5, 0.0, 17.3]
    rows = spark.createDataFrame([(p,) for p in prices], "p double").select("p", S.nearest_decimal(F.col("p") * 0.01, 14, 2).cast("double").alias("d")).collect()
    for p, d in rows:
        assert d == duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) * 0.01::DOUBLE AS DECIMAL(14,2))::DOUBLE", [p]).fetchone()[0]
    assert dict(map(tuple, rows))[52567.5] == 525.67
    assert spark.range(1).select(S.nearest_decimal(F.lit(None).cast("double"), 14, 2)).first()[0] is None


def test_guest_lines_are_joined_once(spark):
    from siltworks.plans import registry

    vault = registry.QUERIES["m13_guest_vault_rows"](spark, "/root/testdata/sf0.001")
    text = vault._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in text and "o_custkey" not in text  # the lines are read as they were stored
    lines = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), ("c", "d")], "x string, y string")
    link = spark.createDataFrame([], "link_key string, hk_x string, hk_y string, load_dt timestamp, load_src string")
    now = F.lit("2024-01-01").cast("timestamp")
    first = L.load_link(lines.limit(2), link, ["x", "y"], "s", now)
    assert L.missing_links(lines, first, ["x", "y"], "s", now).columns == link.columns
    assert L.load_link(lines, first, ["x", "y"], "s", now).count() == 2
    text = L.missing_links(lines, link, ["x", "y"], "s", now)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("hk_x") < text.index("Window")  # hub keys are made above the shuffles


def test_the_vault_shuffles_no_text_of_hashes(spark):
    """Hub and link keys were looked up as the text of their hashes, and satellites' rows dealt with it."""
    now = F.lit("2024-01-01").cast("timestamp")
    lines = spark.createDataFrame([("a_b", "c", "n"), ("a", "b_c", "n"), ("a", "c", "m"), ("a", "c", "m"), (None, "c", "m"), ("d", "e_", "o")], "x string, y string, z string")
    link = spark.createDataFrame([], "link_key string, hk_x string, hk_y string, load_dt timestamp, load_src string")
    uuid = lambda text: spark.range(1).select(S.md5_uuid(F.lit(text))).first()[0]
    got = {(r.link_key, r.hk_x, r.hk_y) for r in L.load_link(lines, link, ["x", "y"], "s", now).collect()}
    assert got == {(uuid("a_b_c"), uuid("a"), uuid("b_c")), (uuid("a_c"), uuid("a"), uuid("c")), (uuid("d_e_"), uuid("d"), uuid("e_"))}  # the least of two with one link key
    held = L.load_link(lines.filter("y = 'c'"), link, ["x", "y"], "s", now)
    assert sorted(r.link_key for r in L.missing_links(lines, held, ["x", "y"], "s", now).collect()) == [uuid("d_e_")]
    hub = spark.createDataFrame([], "hub_key string, x string, load_dt timestamp, load_src string")
    first = L.missing_hubs(lines.limit(1), hub, "x", "s", now)
    assert sorted(r.hub_key for r in L.missing_hubs(lines, first, "x", "s", now).collect()) == sorted([uuid("a"), uuid("d")])
    sat = spark.createDataFrame([], "x string, z string, hashdiff string, load_dt timestamp, load_src string")
    old = L.load_satellite(lines.limit(3), sat, "x", ["z"], "s", now)
    assert sorted((r.x, r.hashdiff) for r in old.collect()) == sorted([("a", max(uuid("n"), uuid("m"))), ("a_b", uuid("n"))])
    assert [r.x for r in L.satellite_changes(lines, old, "x", ["z"], "s", F.lit("2024-01-02").cast("timestamp")).filter("x <> 'a'").collect()] == ["d"]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        source, kept = (lines.repartition(3), spark.range(9).selectExpr("uuid() AS link_key", "'' AS x"))
        for df, text in ((L.missing_links(source, kept.selectExpr("link_key", "'' hk_x", "'' hk_y", "now() AS load_dt", "'' load_src"), ["x", "y"], "s", now), "link_key"), (L.missing_hubs(source, kept.selectExpr("link_key AS hub_key", "x", "now() AS load_dt", "'' load_src"), "x", "s", now), "hub_key")):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            made = [i for i, line in enumerate(plan) if "regexp_replace" in line]
            assert made and all(f"AS {text}" in plan[i] and "LeftAnti" in plan[i + 1] for i in made)  # the text is made above all shuffles
    finally:
        for k in off:
            spark.conf.unset(k)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\noops,y\n,z\n")
    good, bad = T.load_with_rejects(spark, str(tmp_path / "a.csv"), StructType([StructField("id", LongType()), StructField("name", StringType())]))
    assert [tuple(r) for r in good.collect()] == [(1, "x"), (None, "z")] and [r.line for r in bad.collect()] == ["oops,y"]
    assert D.reject_report({"a": bad}).first().n == 1
    df = T.ensure_columns(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, day string"), {"status": "shipped", "id": 9})
    T.write_lake(df, str(tmp_path / "lake"), ["day"])
    T.write_lake(df.filter("id = 2").withColumn("id", F.lit(7)), str(tmp_path / "lake"), ["day"])
    assert sorted(r.id for r in T.read_lake(spark, str(tmp_path / "lake")).collect()) == [1, 7]
    (tmp_path / "p-1.csv").write_text("id,ts\n1,2024-01-01 10:00:00\n2,2024-01-02 10:00:00\n")
    assert [r.id for r in T.read_csv_day(spark, str(tmp_path / "p-*.csv"), "id int, ts string", "ts", "2024-01-02").collect()] == [2]
    (tmp_path / "d.csv").write_text("id;city\n1;Perth\n")
    assert T.read_dict(spark, str(tmp_path / "d.csv"), "id int, city string").first().city == "Perth"
    assert T.LakePaths("/x/").ods("events") == "/x/ods/events"


def test_versions_of_tables(spark, tmp_path):
    base = str(tmp_path / "t")
    assert T.current(spark, base, "a", "id int").count() == 0
    for n in (1, 2):
        table = T.current(spark, base, "a", "id int")
        T.publish({"a": table.union(spark.createDataFrame([(n,)], "id int"))}, base)
    assert sorted(r.id for r in T.current(spark, base, "a", "id int").collect()) == [1, 2]


def test_asof_with_fallback(spark):
    versions = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20)], "k int, v string, active_from int, active_to int")
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 1, 99), (4, 2, 5)], "id int, k int, t int")
    got = R.asof_join(rows, versions, "k", "t", fallback="latest")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "b")]
    assert R.asof_join(rows.union(rows), versions, "k", "t", fallback="latest").count() == 6
    assert sorted((r.id, r.v) for r in R.asof_join(rows, versions, "k", "t").collect()) == [(1, "a"), (2, "b")]


def test_incremental_and_scd2(spark):
    state, empty = spark.createDataFrame([], "workflow_key string, last_value string"), spark.createDataFrame([], "id bigint, v string")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id bigint, v string")
    target, state = L.incremental(source, empty, state, "w", "id", lambda s, t: L.upsert(s, t, ["id"], "v"))
    more = source.union(spark.createDataFrame([(3, "d")], source.schema))
    target2, state2 = L.incremental(more, target, state, "w", "id", lambda s, t: L.upsert(s, t, ["id"], "v"))
    assert sorted(r.id for r in target2.collect()) == [1, 2, 3] and state2.first().last_value == "3"
    log = spark.createDataFrame([("k", "x", "2024-01-01"), ("k", "x", "2024-01-02"), ("k", "y", "2024-01-03"), ("k", "y", "2024-01-03"), (None, "z", "2024-01-01")], "k string, v string, t string")
    none = spark.createDataFrame([], "k string, v string, active_from timestamp, active_to timestamp")
    got = L.scd2(log, none, "k", ["v"], "t")
    want = [("x", "2024-01-01", "2024-01-03"), ("y", "2024-01-03", "2099-12-31")]
    assert sorted((r.v, str(r.active_from)[:10], str(r.active_to)[:10]) for r in got.collect()) == want
    assert sorted((r.v, str(r.active_from)[:10], str(r.active_to)[:10]) for r in L.scd2(log, got, "k", ["v"], "t").collect()) == want


def test_raw_documents(spark):
    df = spark.createDataFrame([('{"_id": {"$oid": "a"}, "ts": "2024-01-01 00:00:00", "v": 1}',), ('{"id": "a", "ts": "2024-01-02 00:00:00", "v": 2}',), ('{"v": 3}',)], "d string")
    got = L.land_documents(df, "d", ["$._id", "$.id"], "$.ts", now()).collect()
    assert [(r.object_id, r.update_ts.day) for r in got] == [("a", 2)]


def test_group_activity_and_guests(spark):
    log = spark.createDataFrame([(1, 7, "add", "t1"), (1, 7, "add", "t1"), (2, 7, "leave", "t2"), (9, 7, "add", "t3")], "user_id bigint, group_id bigint, event string, event_dt string")
    link = spark.createDataFrame([], "link_key string, hk_user_id string, hk_group_id string, load_dt timestamp, load_src string")
    sat = spark.createDataFrame([], "link_id string, event string, event_dt string, hashdiff string, load_dt timestamp, load_src string")
    users, groups = spark.createDataFrame([(1,), (2,)], "user_id bigint"), spark.createDataFrame([(7,)], "group_id bigint")
    for _ in range(2):
        link, sat = M.load_group_activity(log, users, groups, link, sat, "s", now())
    assert link.count() == 2 and sat.count() == 2
    lines = spark.createDataFrame([("o1", "u", "p1", "c"), ("o1", "u", "p2", "c"), ("o2", "u", "p1", "c")], "order_id string, user_id string, product_id string, category string")
    for by, once, want in (("category", True, {"c": 2}), ("product_id", False, {"p1": 2, "p2": 1})):
        counters, ledger = spark.createDataFrame([], f"user_id string, {by} string, n bigint"), spark.createDataFrame([], "order_id string")
        for _ in range(2):
            counters, ledger = M.guest_counters(lines, counters, ledger, by, once)
        assert {r[by]: r.n for r in counters.collect()} == want


def test_product_sales(spark):
    events = spark.createDataFrame([('{"order_id": "o", "product_payments": [{"product_id": "p", "price": 2.5, "quantity": 2, "bonus_payment": 1, "bonus_grant": 0}]}',)], "event_value string")
    orders = spark.createDataFrame([("o", 5)], "order_id string, order_ts int")
    products = spark.createDataFrame([(1, "p", 0, 4), (2, "p", 4, 9)], "version_id int, product_id string, active_from int, active_to int")
    r = M.product_sales(events, orders, products).first()
    assert (r.version_id, r["count"], float(r.total_sum)) == (2, 2, 5.0)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"rid": "a", "s": 0, "e": 100}', '{"rid": "b", "s": 0, "e": 10}', "broken", '{"rid": "c", "s": 0, "e": 100}']
    (tmp_path / "in" / "1.txt").write_text("\n".join(lines))
    subscribers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "rid string, client bigint")
    feedback = Store(spark, str(tmp_path / "t"), {"feedback": ("rid string, client bigint, created int", ["rid", "client"])}, 4)
    counted = Store(spark, str(tmp_path / "c"), {"counters": ("rid string, n bigint", ["rid"]), "ledger": ("client bigint", ["client"])}, 4)
    for _ in range(2):  # the second run finds a checkpoint; a third with a new one repeats the batch
        good, _bad = X.parse_stream(spark.readStream.text(str(tmp_path / "in")), "rid string, s bigint, e bigint")
        out = X.notify(good, subscribers, "s", "e", "rid", "created", now=50)
        sink = X.dual_sink(X.keyed_sink(feedback, "a", "feedback"), X.counting_sink(counted, "a", "client", ["rid"]))
        X.start(out, sink, str(tmp_path / "check")).awaitTermination()
    sink = X.dual_sink(X.keyed_sink(feedback, "b", "feedback"), X.counting_sink(counted, "b", "client", ["rid"]))
    X.start(X.notify(X.parse_stream(spark.readStream.text(str(tmp_path / "in")), "rid string, s bigint, e bigint")[0], subscribers, "s", "e", "rid", "created", now=50), sink, str(tmp_path / "check2")).awaitTermination()
    got = feedback.read("feedback").collect()
    assert sorted((r.rid, r.client, r.created) for r in got) == [("a", 1, 50), ("a", 2, 50)]
    assert [(r.rid, r.n) for r in counted.read("counters").collect()] == [("a", 2)]
    _, bad = X.parse_stream(spark.read.text(str(tmp_path / "in")), "rid string, s bigint, e bigint")
    assert [r.raw for r in bad.collect()] == ["broken"]


def test_newest_sink(spark, tmp_path):
    batch = spark.createDataFrame([("o1", "u", "new", 1), ("o1", "u", "done", 2), ("o2", "u", "new", 5)], "order_id string, user_id string, status string, at int")
    store = Store(spark, str(tmp_path / "s"), {"orders": ("order_id string, user_id string, status string, at int", ["order_id"])}, 4)
    for k in range(2):
        X.newest_sink(store, "s", "orders", "at")(batch, k)
    X.newest_sink(store, "s", "orders", "at")(batch.filter("at = 1"), 2)
    assert sorted((r.order_id, r.status) for r in store.read("orders").collect()) == [("o1", "done"), ("o2", "new")]


def test_satellite_keeps_each_change_of_a_batch(spark):
    rows = [("o1", "new", "2024-01-01"), ("o1", "done", "2024-01-02"), ("o1", "done", "2024-01-03"), ("o1", "new", "2024-01-04"), ("o2", "a", "2024-01-01"), (None, "x", "2024-01-01")]
    source = spark.createDataFrame(rows, "k string, s string, at string")
    target = spark.createDataFrame([], "k string, s string, hashdiff string, load_dt timestamp, load_src string")
    for part in (source.filter("at < '2024-01-03'"), source, source):
        target = L.load_satellite(part, target, "k", ["s"], "x", "at")
    assert [(r.k, r.s, r.load_dt.day) for r in target.orderBy("k", "load_dt").collect()] == [("o1", "new", 1), ("o1", "done", 2), ("o1", "new", 4), ("o2", "a", 1)]


def test_orders_are_enriched_and_thinned(spark):
    payload = '{"date": "d", "cost": 5.0, "payment": 4.0, "final_status": "CLOSED", "user": {"id": "u"}, "restaurant": {"id": "r"}, "order_items": [{"id": "b", "name": "B", "price": 1.0, "quantity": 2}, {"id": "a", "name": "A", "price": 3.0, "quantity": 1}, {"id": "b", "name": "B", "price": 1.0, "quantity": 1}]}'
    raw = spark.createDataFrame([(f'{{"object_id": "{i}", "object_type": "order", "sent_dttm": "t{k}", "payload": {payload}}}',) for i, k in ((1, 1), (1, 2), (2, 1))] + [("broken",)], "value string")
    orders, bad = X.parse_stream(raw, X.ORDER)
    named = spark.createDataFrame([("u", "Ann")], "id string, name string")
    menus = spark.createDataFrame([("r", "a", "soup")], "restaurant_id string, id string, category string")
    out = X.enrich_orders(orders, named, named.limit(0), menus)
    assert sorted(r.object_id for r in out.collect()) == ["1", "2"] and bad.count() == 1
    enriched = X.parse_stream(out, X.ENRICHED)[0]
    p = enriched.filter("object_id = '1'").first().payload
    assert (p.id, p.status, p.user.name, p.restaurant.id, p.restaurant.name) == ("1", "CLOSED", "Ann", "r", None)
    assert [(x.id, x.category, x.quantity) for x in p.products] == [("b", "", 2), ("a", "soup", 1), ("b", "", 1)]
    thin = X.parse_stream(X.thin_messages(enriched), X.THIN)[0].filter("object_id = '2'").first().payload
    assert thin.user_id == "u" and [x.category for x in thin.products] == ["", "soup", ""]
    assert X.order_lines(enriched).count() == 6


def test_options_of_topics_and_databases():
    assert T.kafka_options("h:1") == {"kafka.bootstrap.servers": "h:1"}
    login = T.kafka_options("h:1", "u", "p")
    assert login["kafka.security.protocol"] == "SASL_SSL" and 'username="u" password="p"' in login["kafka.sasl.jaas.config"]


def test_messages_batches_and_rows_to_look_at(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert sorted(r.value for r in T.as_messages(df).collect()) == ['{"id":1,"v":"a"}', '{"id":2}']
    base = str(tmp_path)
    assert T.read_batches(spark, base, "t", "id int, v string").count() == 0
    for _ in range(2):
        T.append_batch(df, base, "t", 4)
    assert sorted(tuple(r) for r in T.read_batches(spark, base, "t", "id int, v string").collect()) == [(1, "a", 4), (2, None, 4)]
    T.compact(spark, base, "t", "id int, v string", "whole")
    assert T.read_batches(spark, base, "whole", "id int, v string").count() == 2
    T.write_lake(df, f"{base}/flat")
    assert spark.read.parquet(f"{base}/flat").count() == 2
    assert R.sample_rows(df, 1).count() == 1 and T.LakePaths("b/").analytics("x") == "b/analytics/x"


def test_schema_report_and_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [(r.table_name, r.position, r.column_name, r.data_type, r.nullable) for r in D.describe_schema(spark, {"t": df}).collect()] == [("t", 1, "k", "string", True)]
    assert [r.k for r in R.count_by(df, ["k"]).collect()] == ["b", "a"]
    assert D.check_rules(df, {"some": "k IS NOT NULL"}).agg(D.all_pass(None)).first()[0]


def test_places_are_bounded(spark):
    places = spark.range(4).selectExpr("id AS city_id", "'c' AS city", "0D AS lat", "0D AS lng")
    with pytest.raises(ValueError):
        R.nearest(spark.createDataFrame([(0.0, 0.0)], "lat double, lon double"), places, "lat", "lon", 3)
