"""Projections, joins, aggregations, windows, sorts and set operations as functions of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from siltworks.functions.scalar import distinct_from, haversine_km, safe_div

Keys = list[str]

# -- projections and filters


def expand(df: DataFrame, struct: str) -> DataFrame:
    return df.select(f"{struct}.*")


def active_at(df: DataFrame, start: str, end: str, now: Column) -> DataFrame:
    """Rows with start <= now < end."""
    return df.filter((F.col(start) <= now) & (now < F.col(end)))


def sample_df(df: DataFrame, fraction: float, key: str | None = None, seed: int = 42) -> DataFrame:
    """A sample; with ``key``, by a hash of it, the same for any layout of the table."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.filter(F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(seed), key)), 1, 8), 16, 10).cast("bigint") % 10_000 < int(fraction * 10_000))


def canonical_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different values, as (left, right) with left < right."""
    return df.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).filter("left < right").distinct()


def clean_payments(df: DataFrame, account: str, amount: str) -> DataFrame:
    """Without test accounts (negative) and amounts that aren't positive; apply it after deduplication."""
    return df.filter((F.col(account) >= 0) & (F.col(amount) > 0))


def metrics_view(df: DataFrame, measure: str, day: str, date_from: str | None = None, filters: dict | None = None, without_day: str | None = None) -> DataFrame:
    """Day, the filtered dimensions and one measure, in order."""
    if date_from:
        df = df.filter(F.col(day) >= date_from)
    if without_day:
        df = df.filter(F.col(day) != without_day)
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df.select(day, *(filters or {}), measure).orderBy(day, *(filters or {}), measure)


# -- joins


def join_dims(fact: DataFrame, dims: list[tuple[DataFrame, str | Keys]]) -> DataFrame:
    """Inner equi joins; which side is broadcast is left to its measured size."""
    return reduce(lambda df, dim: df.join(dim[0], dim[1]), dims, fact)


def left_join(df: DataFrame, other: DataFrame, on, broadcast: bool = False) -> DataFrame:
    """``broadcast`` only for a side that is known to be small, such as a fixed dictionary."""
    return df.join(F.broadcast(other) if broadcast else other, on, "left")


#: Members of a group or cell that one task pairs with as many others.
BLOCK = 2000


#: Most squares of blocks on a side, so most copies of a member, whatever the size of its group; and the members beyond which a side has no more of them.
SQUARES, WIDE = 32, 65_536

#: The largest groups, each of which is one bit of a number; and the smaller groups of a member that are listed beside it.
LARGEST, LISTED = 63, 64


def many_tasks(df: DataFrame) -> int:
    """Tasks for rows of few bytes that make many: Spark would put them into one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def square_side(blocks: Column, block: int) -> Column:
    """Blocks on the side of a square, of a group of so many: their root, or what makes ``SQUARES`` squares if that is more."""
    return F.greatest(F.floor(F.sqrt(blocks)), F.least(F.ceil(blocks / SQUARES), F.lit(max(WIDE // block, 1)))).cast("int")


def peer_pairs(df: DataFrame, user: str, group: str, block: int = BLOCK) -> DataFrame:
    """Distinct (left, right), left < right, of users who share a group. The number of pairs grows with the square of a group; that is the result.

    A group is cut into blocks of about ``block`` members by a hash; a block is one row, and squares of blocks are the keys of the join, about as many for a group as it has blocks.
    So a group is many tasks, and what is shuffled grows with its size to the power of 1.5 where the pairs grow with its square, and beyond ``SQUARES`` squares a side in proportion to its size. A member
    goes alone to the blocks of its square: what a task makes before it hands rows on is a member's pairs in a square, not those of two blocks.

    A pair is made once, in the first group that both are in: the largest groups come first and are bits of a number, the smaller ones are listed. So pairs are not shuffled,
    except those of a user who is in more than ``LISTED`` smaller groups.
    """
    one = df.select(group, user).dropna().distinct()
    sizes = one.groupBy(group).agg(F.count("*").alias("_n"))
    largest = sizes.orderBy(F.desc("_n"), group).limit(LARGEST)
    ranked = largest.select(group, (F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1).alias("_rank"))
    large = sizes.join(F.broadcast(ranked), group, "left").filter((F.col("_n") > block) | F.col("_rank").isNotNull())
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("int")
    of, bit = Window.partitionBy(user), F.expr("shiftleft(1L, _rank)")
    rows = one.join(large, group, "left").withColumns({"_blocks": blocks, "_bits": F.coalesce(F.sum(bit).over(of), F.lit(0)), "_small": F.collect_list(F.when(F.col("_rank").isNull(), F.col(group))).over(of)})
    rows = rows.withColumn("_long", F.size("_small") > LISTED)
    earlier = F.when(F.col("_rank").isNull() & ~F.col("_long"), F.filter("_small", lambda x: x < F.col(group)))
    member = F.struct(F.col(user).alias("u"), F.when(F.col("_rank").isNull(), F.col("_bits")).otherwise(F.col("_bits").bitwiseAND(bit - 1)).alias("bits"), earlier.alias("listed"))
    side = square_side(F.col("_blocks"), block)
    packed = rows.groupBy(group, "_long", "_blocks", F.pmod(F.xxhash64(user), "_blocks").cast("int").alias("_block")).agg(F.collect_list(member).alias("_members"))
    packed = packed.withColumns({"_square": F.floor(F.col("_block") / side).cast("int"), "_last": F.floor((F.col("_blocks") - 1) / side).cast("int")})
    low = packed.select(group, F.col("_square").alias("_i"), F.explode(F.sequence("_square", "_last")).alias("_j"), F.col("_block").alias("_low"), F.col("_long").alias("_long_a"), F.col("_members").alias("_as"))
    high = packed.select(group, F.explode(F.sequence(F.lit(0), "_square")).alias("_i"), F.col("_square").alias("_j"), F.col("_block").alias("_high"), F.col("_long").alias("_long_b"), F.col("_members").alias("_bs"))

    square, tasks = [group, "_i", "_j"], many_tasks(df)

    def pairs(low: DataFrame, high: DataFrame) -> DataFrame:
        # blocks are shuffled, members are joined; merged, since of a broadcast side a block would meet all members of a square at once
        one = low.repartition(tasks, *square).select(*square, "_low", F.explode("_as").alias("a"))
        met = one.hint("merge").join(high.repartition(tasks, *square), square).filter("_low <= _high OR _i < _j")
        return met.select("_low", "_high", "a", F.explode("_bs").alias("b")).filter("_low <> _high OR a.u < b.u")

    ordered = lambda df: df.select(F.least("a.u", "b.u").alias("left"), F.greatest("a.u", "b.u").alias("right"))
    first = pairs(low.filter("NOT _long_a"), high.filter("NOT _long_b")).filter("a.bits & b.bits = 0 AND NOT coalesce(arrays_overlap(a.listed, b.listed), false)")
    return ordered(first).unionByName(ordered(pairs(low.filter("_long_a"), high).unionByName(pairs(low.filter("NOT _long_a"), high.filter("_long_b"))).filter("a.u <> b.u")).distinct())


def exclude(df: DataFrame, seen: DataFrame, keys: Keys) -> DataFrame:
    return df.join(seen.select(*keys), keys, "left_anti")


not_exists = exclude


def only_in(df: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    return df.join(wanted.select(*keys), keys, "left_semi")


def has_history(df: DataFrame, key: str, period_start: str, events: DataFrame, event_date: str) -> DataFrame:
    """A boolean has_history: whether the key has an event before the period. The first event of each key decides, so one row joins each."""
    first = events.groupBy(F.col(key).alias("_key")).agg(F.min(event_date).alias("_first"))
    joined = df.join(first, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("has_history", F.coalesce(F.col("_first") < F.col(period_start), F.lit(False))).drop("_key", "_first")


def time_slice(df: DataFrame, column: str, width: float | None) -> Column:
    """The number of the slice of ``width`` that a value falls into: days for dates and timestamps, the column's own units for numbers. Null falls into the first of all; without a width there is one slice."""
    if width is None:
        return F.lit(0).cast("bigint")
    value = F.col(column)
    kind = df.schema[column].dataType.typeName()
    number = F.unix_micros(value.cast("timestamp")) / 86_400_000_000 if kind.startswith(("date", "timestamp", "string")) else value.cast("double")
    return F.coalesce(F.floor(number / width), F.lit(-(2**62))).cast("bigint")


def asof_join(df: DataFrame, versions: DataFrame, key: str, ts: str, start: str = "active_from", end: str = "active_to", fallback: str | None = None, width: float | None = 90) -> DataFrame:
    """Each row with the version of its key that holds at ``ts``, start <= ts < end; versions of a key don't overlap, and one without a start is none.

    With fallback 'latest', a row without such a version gets the key's newest. Repeated rows stay repeated; rows of keys without versions go.

    Rows and versions are one sequence, sorted once for each key and slice of time (``time_slice``), in which the last version is carried over the rows after it; what
    holds where a slice begins comes from one row for each key and slice. So a row never meets the versions of its key, rows are shuffled once,
    and the rows of a hot key go to as many tasks as they have slices.
    """
    rest = [x for x in versions.columns if x != key]
    v = versions.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("_key"), time_slice(versions, start, width).alias("_slice"), F.col(start).alias("_at"), F.struct(*rest).alias("_version"))
    # key and time are in the sequence already, where both sides have one type for them
    known = {c: at for c, at, other in ((key, "_key", key), (ts, "_at", start)) if df.schema[c].dataType == versions.schema[other].dataType}
    rest_of_row = [c for c in df.columns if c not in known]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), time_slice(df, ts, width).alias("_slice"), F.col(ts).alias("_at"), F.struct(*(rest_of_row or [F.lit(True).alias("_is")])).alias("_row"))
    newest = F.max_by("_version", F.struct("_at", f"_version.{end}", "_version"))
    # a row for each key and slice that has rows or versions: the last version before it, and the newest of all
    some = v.groupBy("_key", "_slice").agg(newest.alias("_last")).unionByName(rows.select("_key", "_slice").distinct(), allowMissingColumns=True)
    some = some.groupBy("_key", "_slice").agg(F.max("_last").alias("_last"))
    of = Window.partitionBy("_key").orderBy("_slice")
    every = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = some.select("_key", "_slice", F.last("_last", True).over(of.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_last", True).over(every).alias("_newest")).filter(F.col("_newest").isNotNull())
    both = v.unionByName(rows, allowMissingColumns=True)
    carried = F.last("_version", True).over(Window.partitionBy("_key", "_slice").orderBy(F.col("_at").asc_nulls_first(), F.col("_row").isNotNull(), F.col(f"_version.{end}")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_held", carried).filter(F.col("_row").isNotNull()).join(before, ["_key", "_slice"])
    held = F.coalesce("_held", "_before")
    found = F.when(F.col("_at") < held[end], held)
    if fallback is None:
        out = placed.withColumn("_found", found).filter(F.col("_found").isNotNull())
    else:
        out = placed.withColumn("_found", F.coalesce(found, F.col("_newest")))
    return out.select(*[F.col(known[c]).alias(c) if c in known else F.col("_row")[c].alias(c) for c in df.columns], "_found.*")


def full_diff(a: DataFrame, b: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """Keys with the columns of both sides (_a, _b) where any differs or a side is missing."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    differs = reduce(lambda x, y: x | y, [distinct_from(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in columns], F.col("in_a").isNull() | F.col("in_b").isNull())
    return left.join(right, keys, "full").filter(differs).withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})


def resolve_keys(df: DataFrame, dim: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """(rows with their dimension, rows whose key it lacks)."""
    return df.join(dim, keys), df.join(dim.select(*keys), keys, "left_anti")


surrogate_lookup = resolve_keys


def explode_json(df: DataFrame, column: str, schema: str, alias: str = "item", outer: bool = False) -> DataFrame:
    """One row for each element of a JSON array."""
    each = F.explode_outer if outer else F.explode
    return df.withColumn(alias, each(F.from_json(column, f"array<{schema}>")))


def join_rate(df: DataFrame, rates: DataFrame, currency: str, day: str, target: int) -> DataFrame:
    """Left join of the day's rate into ``target``. Of several rates for a currency and day only the newest counts, so no row multiplies.

    ``rates``: currency_code, currency_code_with, rate_ts, rate.
    """
    into = rates.filter(F.col("currency_code_with") == target).select(F.col("currency_code").alias("_code"), F.to_date("rate_ts").alias("_day"), "rate_ts", "rate")
    newest = into.groupBy("_code", "_day").agg(F.max_by("rate", F.struct("rate_ts", "rate")).alias("rate"))
    return df.join(newest, (F.col(currency) == F.col("_code")) & (F.to_date(day) == F.col("_day")), "left").drop("_code", "_day")


def nearest(df: DataFrame, places: DataFrame, lat: str, lon: str, most_places: int = 10_000) -> DataFrame:
    """Adds the nearest place (city_id, city, distance_km) to each row; ties go to the lowest city_id. Rows without coordinates get nulls.

    ``places``: city_id, city, lat, lng. They are one broadcast row, so no row is multiplied and none is shuffled; for more than
    ``most_places`` this raises, as that row would no longer be small.
    """
    if places.limit(most_places + 1).count() > most_places:
        raise ValueError(f"over {most_places} places are too many to hold beside each row")
    listed = places.agg(F.array_sort(F.collect_list(F.struct("city_id", "city", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng")))).alias("_places"))
    measured = F.transform("_places", lambda p: F.struct(haversine_km(F.col(lat), F.col(lon), p["place_lat"], p["place_lng"]).alias("distance_km"), p["city_id"].alias("city_id"), p["city"].alias("city")))
    joined = df.join(F.broadcast(listed)).withColumn("_near", F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.array_min(measured)))
    return joined.select(*df.columns, "_near.city_id", "_near.city", "_near.distance_km")


def cross_small(df: DataFrame, small: DataFrame, most_rows: int = 100) -> DataFrame:
    """Every combination with a dictionary of at most ``most_rows`` rows, which is checked."""
    if small.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows")
    return df.crossJoin(F.broadcast(small))


def within_km(df: DataFrame, a_lat: str, a_lon: str, b_lat: str, b_lon: str, km: float) -> DataFrame:
    return df.withColumn("distance_km", haversine_km(F.col(a_lat), F.col(a_lon), F.col(b_lat), F.col(b_lon))).filter(F.col("distance_km") <= km)


def enrich_items(orders: DataFrame, menus: DataFrame, item_keys: Keys, attribute: str, default: str = "") -> DataFrame:
    """One row for each order item with its menu attribute, ``default`` where the menu lacks it."""
    return orders.join(menus.select(*item_keys, attribute), item_keys, "left").withColumn(attribute, F.coalesce(attribute, F.lit(default)))


def build_message(df: DataFrame, keys: Keys, item_columns: Keys, alias: str = "message") -> DataFrame:
    """One JSON document per key: the keys and ``items``, its rows' item columns as an array in their own order."""
    items = F.array_sort(F.collect_list(F.struct(*item_columns))).alias("items")
    return df.groupBy(*keys).agg(items).select(*keys, F.to_json(F.struct(*keys, "items")).alias(alias))


# -- aggregations


def count_by(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def pivot_counts(df: DataFrame, keys: Keys, type_col: str, types: list[str], prefix: str = "n_") -> DataFrame:
    """A column of counts for each type, in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(type_col) == t).alias(f"{prefix}{t}") for t in types])


def filtered_agg(df: DataFrame, keys: Keys, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggs``: name to (aggregate, condition), both SQL."""
    return df.groupBy(*keys).agg(*[F.expr(f"{agg} FILTER (WHERE {cond})").alias(name) for name, (agg, cond) in aggs.items()])


def distinct_counts(df: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """Exact numbers of distinct values of each column, n_<column>, for each key; nulls are no value.

    Each column is a pass of its own, which reads the keys and that column alone and aggregates map-side; one aggregation of several distinct counts would copy
    every row once a column before that. The passes are joined by their keys, a row for each.
    """
    if len(columns) == 1:
        return df.groupBy(*keys).agg(F.count_distinct(columns[0]).alias(f"n_{columns[0]}"))
    marks = [f"_key{i}" for i in range(len(keys))]
    parts = [df.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], c).distinct().groupBy(*marks).agg(F.count(c).alias(f"n_{c}")) for c in columns]
    out = parts[0]
    for part in parts[1:]:
        other = part.withColumnsRenamed({m: f"{m}_" for m in marks})
        out = out.join(other, reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(f"{m}_")) for m in marks], F.lit(True))).drop(*[f"{m}_" for m in marks])
    return out.select(*[F.col(m).alias(k) for k, m in zip(keys, marks)], *[f"n_{c}" for c in columns])


def agg_by(df: DataFrame, keys: Keys, aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])


def ordered_list(df: DataFrame, keys: Keys, order: Keys, value: str, alias: str) -> DataFrame:
    """The values of each key in a stated order, whatever the order of arrival."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_value"]).alias(alias))


def ratio_of_distinct(df: DataFrame, keys: Keys, num: str, den: str, scale: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(safe_div(F.count_distinct(num), F.count_distinct(den)).cast(f"decimal(18,{scale})").alias("ratio"))


def sum_converted(df: DataFrame, keys: Keys, amount: str, rate: str, default: float = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(amount) * F.coalesce(rate, F.lit(default))).cast("decimal(18,2)").alias("amount_total"))


def sum0(value: Column, precision: int = 14, scale: int = 2) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(f"decimal({precision},{scale})")


def sum_abs_where(df: DataFrame, keys: Keys, column: str, condition: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.expr(f"sum(abs({column})) FILTER (WHERE {condition})").alias("amount"))


def payout(rate: Column, amount: Column, bands: list[tuple[float | None, float, float]]) -> Column:
    """Sum over orders of the greater of a share and a floor, by bands (upper bound of the rate, share, floor); the last bound is None. A null rate is in the lowest."""
    out = None
    for bound, share, floor in bands:
        each = F.greatest(amount * F.lit(share), F.lit(floor))
        fits = rate.isNull() | (rate < bound) if out is None and bound is not None else (rate < bound if bound is not None else F.lit(True))
        out = F.when(fits, each) if out is None else out.when(fits, each)
    return F.sum(out)


def summarise(df: DataFrame, aggs: dict[str, str]) -> DataFrame:
    return df.agg(*[F.expr(e).alias(n) for n, e in aggs.items()])


def count_once_per(df: DataFrame, unit: Keys, keys: Keys, alias: str = "n") -> DataFrame:
    """Count by keys, each (unit, keys) once."""
    return df.select(*unit, *[k for k in keys if k not in unit]).distinct().groupBy(*keys).agg(F.count("*").alias(alias))


# -- windows


def _ordered(keys: Keys, order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def top_per(df: DataFrame, keys: Keys, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; with n = 1 Spark keeps one row a group and task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(_ordered(keys, order))).filter(F.col("_rank") <= n).drop("_rank")


def latest_per(df: DataFrame, keys: Keys, order: str, tiebreak: str) -> DataFrame:
    return top_per(df, keys, [F.desc(order), F.desc(tiebreak)])


def first_per(df: DataFrame, keys: Keys, order: str, tiebreak: str) -> DataFrame:
    return top_per(df, keys, [F.asc(order), F.asc(tiebreak)])


dedup_newest = latest_per
distinct_on = latest_per


def min_per(df: DataFrame, keys: Keys, measure: str, tiebreak: str) -> DataFrame:
    return top_per(df, keys, [F.asc_nulls_last(measure), F.asc(tiebreak)])


def with_previous(df: DataFrame, keys: Keys, order: Keys, column: str, alias: str = "previous") -> DataFrame:
    return df.withColumn(alias, F.lag(column).over(_ordered(keys, order)))


def island_id(df: DataFrame, keys: Keys, order: Keys, changed: Column, alias: str = "island") -> DataFrame:
    """A running count of changes; rows, not ranges, so equal timestamps don't merge."""
    frame = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.sum(F.when(changed, 1).otherwise(0)).over(frame))


def stays(df: DataFrame, key: str, ts: str, tiebreak: str, value: str, min_days: int = 1, width: float | None = 7) -> DataFrame:
    """(key, value, island, start, end, last_ts, days) of unbroken runs of a value that span at least ``min_days`` days.

    Changes are counted within slices of ``width`` days of a key, and each slice says its first and last value and how many changes it has; the slices of a key are
    then stitched, so that a key with very many rows is many tasks.
    """
    parts = df.withColumn("_slice", time_slice(df, ts, width))
    before = with_previous(parts, [key, "_slice"], [ts, tiebreak], value, "_before")
    changed = lambda before, now: before.isNotNull() & (before != now)
    local = island_id(before, [key, "_slice"], [ts, tiebreak], changed(F.col("_before"), F.col(value)), "_local")
    order = F.struct(F.col(ts).isNotNull(), ts, tiebreak)
    ends = local.groupBy(key, "_slice").agg(F.min_by(F.struct(value), order)[value].alias("_first"), F.max_by(F.struct(value), order)[value].alias("_last"), F.max("_local").alias("_changes"))
    of = Window.partitionBy(key).orderBy("_slice")
    started = ends.withColumn("_opens", F.when(changed(F.lag("_last").over(of), F.col("_first")), 1).otherwise(0))
    offset = started.withColumn("_passed", F.col("_opens") + F.coalesce(F.lag("_changes").over(of), F.lit(0))).select(F.col(key).alias("_key"), F.col("_slice").alias("_part"), F.sum("_passed").over(of.rowsBetween(Window.unboundedPreceding, 0)).alias("_offset"))
    marked = local.join(offset, local[key].eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_part"))).withColumn("island", F.col("_local") + F.col("_offset"))
    return island_summary(marked, [key, value], ts).filter(F.col("days") >= min_days)


def island_summary(islands: DataFrame, keys: Keys, ts: str, island: str = "island") -> DataFrame:
    """start, end, last_ts and days of each island."""
    spans = islands.groupBy(*keys, island).agg(F.min(F.to_date(ts)).alias("start"), F.max(F.to_date(ts)).alias("end"), F.max(ts).alias("last_ts"))
    return spans.withColumn("days", F.datediff("end", "start") + 1)


def latest_stay(spans: DataFrame, key: str) -> DataFrame:
    return latest_per(spans, [key], "last_ts", "island")


# -- sorts, limits, sets


def in_top_k(df: DataFrame, ranking: DataFrame, key: str, order: Keys, k: int) -> DataFrame:
    """Rows whose key is among the first ``k`` of the ranking."""
    return df.join(ranking.orderBy(*order).limit(k).select(key), key, "left_semi")


def batch(df: DataFrame, order: Keys, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, order: str, tiebreak: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(order), tiebreak).limit(k)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(*[df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def except_all_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows only one side has, counting repeats; one pass over both."""
    both = a.select("*", F.lit(1).alias("_side")).unionByName(b.select("*", F.lit(-1).alias("_side")))
    more = both.groupBy(*a.columns).agg(F.sum("_side").alias("_more"))
    counts = more.agg(F.sum(F.greatest("_more", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("_more"), F.lit(0))).alias("b"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f"only_{s}").alias("side"), F.coalesce(s, F.lit(0)).alias("n")) for s in "ab"])))


def sample_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """Up to ``n`` rows to look at, whichever come first."""
    return df.limit(n)
