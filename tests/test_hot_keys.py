"""Joins and windows where one key, group or city has most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltworks.functions.scalar import haversine_km
from siltworks.operators import checks as D
from siltworks.operators import geo as G
from siltworks.operators import loads as L
from siltworks.operators import relational as R
from siltworks.plans import marts as M


def km(a, b):
    (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def versions_and_rows(spark):
    rng = random.Random(3)
    versions, rows = [], []
    for k in range(12):
        at = sorted(rng.sample(range(0, 400), rng.randint(1, 12)))
        ends = [b if rng.random() < 0.7 else (a + b) // 2 for a, b in zip(at, at[1:])] + [rng.choice([at[-1] + 30, 10**6])]
        versions += [(k, f"{k}.{n}", a, b) for n, (a, b) in enumerate(zip(at, ends))]
    rows = [(i, 1 if rng.random() < 0.4 else rng.randint(0, 15), rng.choice([None, *range(-20, 450)])) for i in range(3000)] + [(9000, None, 5)]
    return versions, rows, spark.createDataFrame(versions, "k int, v string, active_from int, active_to int"), spark.createDataFrame(rows, "id int, k int, t int")


@pytest.mark.parametrize("width", [None, 1, 37, 5000])
def test_asof_as_by_definition(spark, width):
    versions, rows, v, r = versions_and_rows(spark)
    held = lambda k, t: [n for a, n, lo, hi in versions if a == k and t is not None and lo <= t < hi]
    newest = {k: max((lo, n) for a, n, lo, _ in versions if a == k)[1] for k in {x[0] for x in versions}}
    got = R.asof_join(r, v, "k", "t", width=width)
    assert got.columns == ["id", "k", "t", "v", "active_from", "active_to"]
    assert sorted((x.id, x.v) for x in got.collect()) == sorted((i, n) for i, k, t in rows for n in held(k, t))
    got = R.asof_join(r, v, "k", "t", fallback="latest", width=width)
    assert sorted((x.id, x.v) for x in got.collect()) == sorted((i, (held(k, t) or [newest[k]])[0]) for i, k, t in rows if k in newest)


def test_asof_shuffles_rows_once_and_cuts_a_hot_key(spark):
    *_, v, r = versions_and_rows(spark)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, x in off.items():
        spark.conf.set(k, x)
    try:
        lines = plan(R.asof_join(r, v, "k", "t", width=20)).splitlines()
        keyed = R.asof_join(r.filter("k = 1"), v, "k", "t", width=20).withColumn("task", F.spark_partition_id())
        assert keyed.select("task").distinct().count() > 1
    finally:
        for k in off:
            spark.conf.unset(k)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    second = [i for i in range(join + 1, len(lines)) if depth(lines[i]) == depth(lines[join + 1])][1]
    rows = lines[join:second]  # the branch that the rows go through
    assert sum("Exchange" in x for x in rows) == 1 and sum("Sort [" in x for x in rows) == 1


def test_stays_of_a_hot_user_in_many_slices(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(4000):
        at += rng.choice([0, 0, 1, 5, 40])
        rows.append((i, 1 if i % 3 else rng.randint(2, 9), at, rng.choice("aab") if (at // 700) % 2 else "a", None))
    df = spark.createDataFrame(rows, "id int, u int, h int, c string, extra string").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, h)"))
    key = lambda d: sorted(map(tuple, d.select("u", "c", "island", "start", "end", "last_ts", "days").collect()))
    whole = key(R.stays(df, "u", "ts", "id", "c", 1, width=None))
    for width in (0.5, 3, 50):
        assert key(R.stays(df, "u", "ts", "id", "c", 1, width=width)) == whole
    runs, before = 0, {}
    for _, u, _, c, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        runs += before.get(u) != c
        before[u] = c
    assert len(whole) == runs


def test_history_by_any_arrival(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 6), rng.choice("ab"), rng.choice(["x", None]), rng.randint(0, 60)) for _ in range(400)] + [(None, "a", "x", 1)]
    df = spark.createDataFrame(rows, "k int, s string, p string, n int").withColumn("dt", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, n)")).drop("n")
    empty, log = spark.createDataFrame([], "k int, s string, p string, active_from timestamp, active_to timestamp"), df.limit(0)
    want = sorted(map(repr, map(tuple, L.scd2(df, empty, "k", ["s", "p"], "dt").collect())))
    for parts in (1, 4):
        target, seen = empty, log
        for n in range(parts):
            target, seen = L.scd2_of_log(df.filter(F.pmod(F.hash("k", "s", "p", "dt"), F.lit(parts)) == n), target, seen, "k", ["s", "p"], "dt")
        assert sorted(map(repr, map(tuple, target.collect()))) == want
        again, _ = L.scd2_of_log(df.limit(50), target, seen, "k", ["s", "p"], "dt")
        assert sorted(map(repr, map(tuple, again.collect()))) == want


def test_pairs_of_a_large_group_in_blocks(spark):
    df = spark.createDataFrame([(u, 1) for u in range(300)] + [(u, 2) for u in range(295, 303)] + [(None, 1), (4, None), (7, 1)], "u int, g int")
    want = sorted({(a, b) for a in range(300) for b in range(a + 1, 300)} | {(a, b) for a in range(295, 303) for b in range(a + 1, 303)})
    for block in (7, 1000):
        assert sorted(map(tuple, R.peer_pairs(df, "u", "g", block).collect())) == want


def test_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(u, g) for u in range(60) for g in rng.sample(range(90), rng.randint(0, 12))] + [(u, 200 + u // 2) for u in range(60)] + [(u, 500 + k) for u in (3, 4) for k in range(70)]
    df, groups = spark.createDataFrame(rows, "u int, g int"), {}
    for u, g in rows:
        groups.setdefault(g, set()).add(u)
    want = sorted({(a, b) for x in groups.values() for a in x for b in x if a < b})
    for largest, listed, block in ((63, 64, 3), (5, 64, 3), (0, 4, 50), (63, 0, 2), (5, 3, 1)):
        monkeypatch.setattr(R, "LARGEST", largest)
        monkeypatch.setattr(R, "LISTED", listed)
        assert sorted(map(tuple, R.peer_pairs(df, "u", "g", block).collect())) == want
    # of a group cut into sixteen blocks a member goes to at most five squares, where it went to sixteen, and its pairs stay where they are made
    one = R.peer_pairs(spark.range(1600).selectExpr("id AS u", "1 AS g"), "u", "g", 100)
    keys = "keys=[left#"
    text = plan(one)
    at = next(i for i, line in enumerate(text.splitlines()) if "Union" in line)
    before_union = text.splitlines()[:at]
    assert not any(keys in line or "Exchange" in line for line in before_union) and one.count() == 1600 * 1599 // 2


def test_copies_of_a_member_of_a_very_large_group_are_bounded(spark, monkeypatch):
    """The root of the number of blocks, here 116 and 368, was the number of copies."""
    sides = spark.createDataFrame([(n,) for n in (1, 16, 100, 1000, 13_500, 135_000)], "n int").select("n", R.square_side(F.col("n"), 16).alias("side")).collect()
    assert [-(-x.n // x.side) for x in sides] == [1, 4, 10, 32, 32, 33]
    df, want = spark.range(90).selectExpr("id AS u", "id % 2 AS g"), sorted((a, b) for a in range(90) for b in range(a + 2, 90, 2))
    for squares, wide in ((1, 1000), (2, 1000), (3, 4)):
        monkeypatch.setattr(R, "SQUARES", squares)
        monkeypatch.setattr(R, "WIDE", wide)
        assert sorted(map(tuple, R.peer_pairs(df, "u", "g", 2).collect())) == want


def test_a_member_meets_blocks_not_a_block_blocks(spark):
    """A row of the join was two blocks, all of whose pairs a task made before it handed on the first."""
    lines = plan(R.peer_pairs(spark.range(100).selectExpr("id AS u", "1 AS g"), "u", "g", 10)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    join = next(i for i, line in enumerate(lines) if "_low" in line and "Join" in line)
    below = next((i for i in range(join + 1, len(lines)) if depth(lines[i]) <= depth(lines[join])), len(lines))
    assert "SortMergeJoin" in lines[join] and sum("explode(_as" in x for x in lines[join:below]) == 1 and not any("explode(_bs" in x for x in lines[join:below])


def test_candidates_of_one_city_follow_its_pairs(spark):
    def city(n):
        rng = random.Random(6)
        side = 0.0005 * math.sqrt(n)  # the same density whatever the size
        return spark.createDataFrame([(i, 50 + rng.uniform(0, side), 10 + rng.uniform(0, side)) for i in range(n)], "id int, lat double, lon double")

    counts = {}
    for n in (1000, 4000):
        df = city(n)
        counts[n] = G.candidates(df, df, 0.1).count()
        assert G.candidates(df, df, 0.1, block=2).count() == counts[n]
    assert counts[4000] < 5 * counts[1000] and counts[4000] < 4000 * 60


def test_full_cubes_are_not_cut_where_they_are_many(spark):
    """Each of a thousand equal cubes was cut in five, so the other side was copied five times more; points in space went with each copy."""
    many = G._cut(spark.range(125_000).selectExpr("id % 1000 AS _cell"), ["_cell"], 1, 12)
    assert many.count() == 1000 and many.filter("_parts <> 1").count() == 0
    one = G._cut(spark.range(125_000).selectExpr("if(id < 1000, id, 0) AS _cell"), ["_cell"], 1, 12)
    assert {x["_cell"]: x["_parts"] for x in one.filter("_parts <> 1").collect()} == {0: 48}
    places = spark.range(50).selectExpr("id", "id * 1D AS lat", "id * 2D AS lon")
    lines = plan(G.pairs_within(places, places, 400)).splitlines()
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and not any("_vx" in x for x in lines[dealt[1] :])


def test_pairs_over_the_date_line_and_the_poles(spark):
    points = [(0, 0.0, 179.95), (1, 0.0, -179.95), (2, 89.99, 0.0), (3, 89.99, 180.0), (4, -90.0, 12.0), (5, -89.95, -100.0), (6, 40.0, 5.0), (7, 40.0, 5.0), (8, None, 5.0)]
    rng = random.Random(7)
    points += [(9 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    df = spark.createDataFrame(points, "id int, lat double, lon double").withColumn("r", F.lit("clash"))
    want = sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and None not in (a[1], b[1]) and km(a[1:], b[1:]) <= 400)
    assert {(0, 1), (2, 3), (4, 5), (6, 7)} <= set(want)
    for block in (3, 2000):
        assert sorted((x.a, x.b) for x in G.pairs_within(df, df, 400, block=block).selectExpr("l.id AS a", "r.id AS b").filter("a < b").collect()) == want
    assert G.pairs_within(df, df, 400, on=["id"]).count() == len(points) - 1


def test_nearest_of_many_places(spark):
    rng = random.Random(8)
    places = [(i, f"c{i}", rng.gauss(50, 0.02), rng.gauss(10, 0.02)) for i in range(700)] + [(800, "pole", 90.0, 0.0), (801, "line", 0.0, 180.0), (802, "same", 20.0, 20.0), (795, "same", 20.0, 20.0), (810, "none", None, 1.0)]
    rows = [(i, rng.gauss(50, 0.03), rng.gauss(10, 0.03)) for i in range(250)] + [(300 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)] + [(500, 89.0, 170.0), (501, 0.01, -179.99), (502, 20.0, 20.1), (503, None, 4.0), (500, 89.0, 170.0)]
    p = spark.createDataFrame(places, "city_id int, city string, lat double, lng double")
    r = spark.createDataFrame(rows, "id int, lat double, lon double")
    known = [x for x in places if x[2] is not None]
    want = []
    for i, a, b in rows:
        d, c = min((km((a, b), x[2:]), x[0]) for x in known) if a is not None else (None, None)
        want.append((i, c, None if d is None else round(d, 6)))
    got = G.nearest_of_many(r, p, "lat", "lon", enough=8)
    assert got.columns == ["id", "lat", "lon", "city_id", "city", "distance_km"]
    assert sorted(map(repr, ((x.id, x.city_id, None if x.distance_km is None else round(x.distance_km, 6)) for x in got.collect()))) == sorted(map(repr, want))
    nothing = G.nearest_of_many(r, p.limit(0), "lat", "lon")
    assert nothing.count() == len(rows) and nothing.filter("city_id IS NOT NULL").count() == 0
    assert sorted(map(repr, ((x.id, x.city_id) for x in G.nearest_place(r, p, "lat", "lon", most_places=100).collect()))) == sorted(map(repr, (w[:2] for w in want)))


def test_several_distinct_counts_copy_no_row(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, None, 6), (2, None, None), (None, "a", 1), (None, "a", 2)]
    df = spark.createDataFrame(rows, "k int, s string, v int")
    out = R.distinct_counts(df, ["k"], ["s", "v"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, 2, 2), (2, 0, 0), (None, 1, 2)]))
    assert "Expand" not in plan(out) and "Expand" not in plan(D.profile(df, ["k", "s", "v"]))
    assert sorted(map(tuple, D.profile(df, ["k", "s", "v"]).collect())) == [("k", 6, 4, 2), ("s", 6, 4, 2), ("v", 6, 5, 4)]
    assert sorted(map(tuple, D.profile(df.limit(0), ["k"]).collect())) == [("k", 0, 0, 0)]


def test_pairs_of_a_small_table_are_many_tasks(spark):
    df = spark.range(0, 300, 1, 1).selectExpr("id", "10 + id % 20 / 10.0 AS lat", "20 + floor(id / 20) / 10.0 AS lon")
    for where in (None, "l.id < r.id"):
        near = G.pairs_within(df, df, 40, where=where).selectExpr("l.id AS a", "r.id AS b", "distance_km", "spark_partition_id() AS task").collect()
        assert len({x.task for x in near}) > 1
        want = df.toDF("a", "lat", "lon").crossJoin(df.toDF("b", "lat2", "lon2")).select("a", "b", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")).filter("km <= 40")
        assert sorted((x.a, x.b) for x in near) == sorted((x.a, x.b) for x in want.collect() if where is None or x.a < x.b)
        assert max(x.distance_km for x in near) <= 40


def test_friends_are_made_once_with_and_without_lists(spark, monkeypatch):
    ods = spark.range(60).selectExpr("id AS user_id", "id % 2 AS city_id", "-33 - id % 6 / 500.0 AS lat", "151 + id % 5 / 500.0 AS lon", "'Australia/Sydney' AS zone", "timestamp '2024-01-01' AS ts", "id AS event_id")
    subscriptions = spark.range(400).selectExpr("id * 7 % 61 AS user_id", "id % 9 AS channel")
    messages = spark.range(300).selectExpr("id % 60 AS user_from", "id * 13 % 59 AS user_to")
    wrote = {(min(x), max(x)) for x in messages.collect()}
    channels, at = {}, {x.user_id: x for x in ods.collect()}
    for x in subscriptions.collect():
        channels.setdefault(x.user_id, set()).add(x.channel)
    near = {(x.a, x.b) for x in G.pairs_within(ods, ods, 1.0).selectExpr("l.user_id AS a", "r.user_id AS b").collect()}
    want = sorted(p for p in near if p[0] < p[1] and p not in wrote and at[p[0]].city_id == at[p[1]].city_id and channels.get(p[0], set()) & channels.get(p[1], set()))
    for few in (1000, 6, 0):
        monkeypatch.setattr(M, "FEW", few)
        out = M.friend_recommendations(ods, subscriptions, messages, 1.0)
        assert sorted((x.user_left, x.user_right) for x in out.collect()) == want and want
    monkeypatch.setattr(M, "FEW", 1000)
    plan = M.friend_recommendations(ods, subscriptions, messages, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")  # pairs with lists are neither made distinct nor joined again


def test_friends_of_large_channels_are_told_by_bits(spark, monkeypatch):
    """Lists of channels were intersected for each near pair; now only those beyond the largest channels are listed."""
    ods = spark.range(40).selectExpr("id AS user_id", "1 AS city_id", "-33 - id / 5000.0 AS lat", "151D AS lon", "'Australia/Sydney' AS zone", "timestamp '2024-01-01' AS ts", "id AS event_id")
    subscriptions = spark.range(300).selectExpr("id * 7 % 41 AS user_id", "pmod(xxhash64(id), 12) AS channel")
    messages = spark.createDataFrame([(3, 4), (9, 1)], "user_from bigint, user_to bigint")
    channels = {}
    for x in subscriptions.collect():
        channels.setdefault(x.user_id, set()).add(x.channel)
    near = {(x.a, x.b) for x in G.pairs_within(ods, ods, 1.0).selectExpr("l.user_id AS a", "r.user_id AS b").collect()}
    want = sorted(p for p in near if p[0] < p[1] and p not in {(3, 4), (1, 9)} and channels.get(p[0], set()) & channels.get(p[1], set()))
    made = {}
    monkeypatch.setattr(M, "stored", lambda df, name: made.setdefault(name, df.cache()))
    for largest in (63, 5, 0):
        made.clear()
        monkeypatch.setattr(R, "LARGEST", largest)
        out = M.friend_recommendations(ods, subscriptions, messages, 1.0)
        assert sorted((x.user_left, x.user_right) for x in out.collect()) == want and want
        listed = {k for x in made["members"].collect() for k in x.channels or []}
        assert len(listed) == max(12 - largest, 0)


def test_a_level_of_cubes_is_written_once(spark, tmp_path, monkeypatch):
    """Only the pairs that a level keeps are written; all that it measures, several times as many, were written too and dealt by cube twice."""
    monkeypatch.setattr(G, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(300).selectExpr("id", "id * 37 % 170 - 85D AS lat", "id * 91 % 350 - 175D AS lon")
    places = spark.range(200).selectExpr("id AS city_id", "concat('c', id) AS city", "id * 53 % 170 - 85D AS lat", "id * 71 % 350 - 175D AS lng")
    got = {r.id: (r.city_id, r.distance_km) for r in G.nearest_of_many(rows, places, "lat", "lon", enough=8).collect()}
    spots = places.collect()
    for r in rows.collect():
        assert got[r.id][1] == pytest.approx(min(km((r.lat, r.lon), (p.lat, p.lng)) for p in spots), abs=1e-6)
    assert len(got) == 300 and not [p.name for p in (tmp_path / "nearest").iterdir() if p.name.endswith("-all")]
