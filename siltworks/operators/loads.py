"""Table maintenance: each load is a function of the source and the present target that returns the new target.

A caller publishes the result with ``siltworks.sources.tables.publish``, which switches versions atomically.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions.scalar import hashdiff, join_key, md5_uuid, time_parts
from siltworks.operators.relational import top_per
from siltworks.sources.commits import Change, Snapshot, Store

Keys = list[str]
END_OF_TIME = "2099-12-31"


def full_refresh(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select(target.columns)


def replace_slice(source: DataFrame, target: DataFrame, slices: Keys) -> DataFrame:
    """The target with the slices that the source has replaced by it."""
    there = source.select(*slices).distinct()
    return target.join(there, slices, "left_anti").select(target.columns).unionByName(source.select(target.columns))


def _newest(source: DataFrame, keys: Keys, order: str) -> DataFrame:
    """One row a key: the newest; of equal ones the greatest by all columns. Rows with a null key are dropped."""
    known = source.dropna(subset=keys)
    rest = [F.desc_nulls_last(c) for c in source.columns if c not in keys and c != order]
    return top_per(known, keys, [F.desc_nulls_last(order), *rest])


def upsert(source: DataFrame, target: DataFrame, keys: Keys, order: str) -> DataFrame:
    """The newest source row of each key, and the target's rows of other keys."""
    new = _newest(source, keys, order).select(target.columns)
    return target.join(new.select(*keys), keys, "left_anti").select(target.columns).unionByName(new)


def missing(source: DataFrame, target: DataFrame, keys: Keys) -> DataFrame:
    """For each key that the target lacks the least source row."""
    new = top_per(source.dropna(subset=keys), keys, [F.asc(c) for c in source.columns]).select(target.columns)
    return new.join(target.select(*keys), keys, "left_anti").select(target.columns)


def insert_new(source: DataFrame, target: DataFrame, keys: Keys) -> DataFrame:
    """The target and, for each key that it lacks, the least source row."""
    return target.unionByName(missing(source, target, keys))


def scd1(source: DataFrame, target: DataFrame, key: str, columns: Keys, order: str) -> DataFrame:
    """Attributes overwritten by the newest source row; the target's other columns, such as its surrogate id, stay. New keys are not added."""
    new = _newest(source, [key], order).select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = target.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def scd2(source: DataFrame, target: DataFrame, key: str, tracked: Keys, ts: str, end_of_time: str = END_OF_TIME) -> DataFrame:
    """Versions (key, tracked, active_from, active_to) after the source's rows, several of a key at once too.

    A version opens where a tracked attribute changes and closes where the next opens; the last is open until
    ``end_of_time``. Closed versions of the target stay as they are; source rows older than the current version are ignored. Of source rows with the same
    key and time the greatest counts.
    """
    eot = F.lit(end_of_time).cast("timestamp")
    closed, current = target.filter(F.col("active_to") < eot), target.filter(F.col("active_to") >= eot)
    columns = [key, *tracked, "active_from"]
    new = top_per(source.dropna(subset=[key, ts]), [key, ts], [F.desc_nulls_last(c) for c in tracked]).select(key, *tracked, F.col(ts).cast("timestamp").alias("active_from"))
    since = current.select(F.col(key).alias("_key"), F.col("active_from").alias("_since"))
    new = new.join(since, F.col(key) == F.col("_key"), "left").filter(F.col("_since").isNull() | (F.col("active_from") > F.col("_since"))).select(columns)
    of = Window.partitionBy(key).orderBy("active_from")
    state = F.struct(*tracked)
    ordered = current.select(columns).unionByName(new).withColumns({"_before": F.lag(state).over(of), "_n": F.row_number().over(of)})
    opened = ordered.filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(state))
    versions = opened.select(*columns, F.coalesce(F.lead("active_from").over(of), eot).alias("active_to"))
    return closed.select(*columns, "active_to").unionByName(versions)


def scd2_of_log(source: DataFrame, target: DataFrame, log: DataFrame, key: str, tracked: Keys, ts: str, end_of_time: str = END_OF_TIME) -> tuple[DataFrame, DataFrame]:
    """(versions, log) after the source's rows, whenever they arrive: any order and any division into loads gives the same history.

    ``log`` (key, tracked, ts) keeps each state that was seen, as closed versions alone don't tell whether a state was seen again after a late row's time. Of
    states with one key and time the greatest counts. Only the keys of the source are made anew, from their states; the versions of others stay.
    """
    seen = source.dropna(subset=[key, ts]).select(key, *tracked, F.col(ts).cast("timestamp").alias(ts))
    keys = seen.select(key).distinct()
    states = top_per(log.join(keys, key, "left_semi").select(seen.columns).unionByName(seen), [key, ts], [F.desc_nulls_last(c) for c in tracked])
    of = Window.partitionBy(key).orderBy(ts)
    state = F.struct(*tracked)
    opened = states.withColumns({"_before": F.lag(state).over(of), "_n": F.row_number().over(of)}).filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(state))
    versions = opened.select(key, *tracked, F.col(ts).alias("active_from"), F.coalesce(F.lead(ts).over(of), F.lit(end_of_time).cast("timestamp")).alias("active_to"))
    others = target.join(keys, key, "left_anti").select(versions.columns)
    return others.unionByName(versions), log.join(keys, key, "left_anti").select(seen.columns).unionByName(states)


def build_time_dim(df: DataFrame, ts: str) -> DataFrame:
    """One row for each second observed: ts, year, month, day, time, date."""
    seconds = df.select(F.date_trunc("second", ts).alias("ts")).dropna().distinct()
    return seconds.select("ts", *[c.alias(n) for n, c in time_parts(F.col("ts")).items()])


def read_since(df: DataFrame, cursor: str, last, tiebreak: str | None = None, last_tie=None, limit: int | None = None) -> DataFrame:
    """Rows beyond a high-water mark, ascending if limited. With ``tiebreak`` the mark is a pair, so a limited batch loses no rows that tie with its last."""
    if last is not None:
        beyond = F.col(cursor) > F.lit(last)
        if tiebreak and last_tie is not None:
            beyond = beyond | ((F.col(cursor) == F.lit(last)) & (F.col(tiebreak) > F.lit(last_tie)))
        df = df.filter(beyond)
    return df if limit is None else df.orderBy(cursor, *([tiebreak] if tiebreak else [])).limit(limit)


def incremental(source: DataFrame, target: DataFrame, state: DataFrame, workflow: str, cursor: str, load: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(new target, new state). Loads the source's rows beyond the state's cursor; an empty target starts over.

    ``state``: workflow_key, last_value as text. The caller publishes the data before the state.
    """
    row = state.filter(F.col("workflow_key") == workflow).select("last_value").first()
    last = row[0] if row and not target.isEmpty() else None
    kind = source.schema[cursor].dataType
    new = source if last is None else source.filter(F.col(cursor) > F.lit(last).cast(kind))
    top = new.agg(F.max(cursor).cast("string")).first()[0] or last
    entry = state.sparkSession.createDataFrame([(workflow, top)], "workflow_key string, last_value string")
    return load(new, target), state.filter(F.col("workflow_key") != workflow).unionByName(entry)


def load_since(store: Store, table: str, source: DataFrame, cursor: str, tiebreak: str, order: str, limit: int | None = None) -> int:
    """Upsert the source's rows beyond the table's cursor, the pair of ``cursor`` and ``tiebreak``, at most ``limit`` of them in that order, into the buckets of
    their keys. Rows and cursor are one commit; a writer that finds another one's commit there starts anew from that one's cursor, so no load is lost or
    made twice. Where the table is empty the cursor is not heeded. Of source rows with one key the newest by ``order`` counts. Returns the commit's number.
    """
    kinds = {k: source.schema[k].dataType for k in (cursor, tiebreak)}
    _, keys = store.tables[table]
    taken: dict[int, dict] = {}

    def change(now: Snapshot) -> dict[str, Change]:
        at = now.state["cursors"].get(table) if not now.read(table).isEmpty() else None
        last, tie = (F.lit(x).cast(kinds[k]) for x, k in zip(at or (None, None), (cursor, tiebreak)))
        new = read_since(source, cursor, last if at else None, tiebreak, tie, limit)
        top = new.agg(F.max(F.struct(cursor, tiebreak)).alias("top")).select(*[F.col(f"top.{k}").cast("string") for k in (cursor, tiebreak)]).first()
        taken[now.number] = {table: list(top) if top[0] is not None else at}
        touched = now.touched(table, new)
        held = now.read(table, touched)
        return {table: Change(upsert(new.select(held.columns), held, keys, order), touched)}

    return store.update(change, cursors=lambda now: taken[now.number])


def reprocess_window(df: DataFrame, day: str, last_day, days: int = 31) -> DataFrame:
    """Whole days from ``days`` before the last processed one on."""
    return df.filter(F.to_date(day) >= F.date_sub(F.lit(last_day).cast("date"), days))


# -- Data Vault


def hub_rows(source: DataFrame, business_key: str, load_src: str, load_dt: Column, distinct: bool = False) -> DataFrame:
    """hub_key (UUID of the business key's MD5), business key, load_dt, load_src; null keys have no row. ``distinct``: the source has each key once."""
    keys = source.select(F.col(business_key).cast("string").alias(business_key)).dropna()
    keys = keys if distinct else keys.distinct()
    return keys.select(md5_uuid(F.col(business_key)).alias("hub_key"), business_key, load_dt.alias("load_dt"), F.lit(load_src).alias("load_src"))


def load_hub(source: DataFrame, target: DataFrame, business_key: str, load_src: str, load_dt: Column) -> DataFrame:
    """The hub with the business keys that it lacked."""
    return insert_new(hub_rows(source, business_key, load_src, load_dt), target, ["hub_key"])


def missing_hubs(source: DataFrame, target: DataFrame, business_key: str, load_src: str, load_dt: Column) -> DataFrame:
    """What a hub lacks, see ``hub_rows``; keys are looked up as they are, and hashed when nothing is shuffled any more."""
    keys = source.select(F.col(business_key).cast("string").alias(business_key)).dropna().distinct()
    new = keys.join(target.select(F.col(business_key).cast("string").alias(business_key)), business_key, "left_anti")
    return hub_rows(new, business_key, load_src, load_dt, True).select(target.columns)


def _digest(uuid: Column) -> Column:
    """The 16 bytes of an MD5 that is written as a UUID; they sort as its text does."""
    return F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))


def missing_links(source: DataFrame, target: DataFrame, keys: Keys, load_src: str, load_dt: Column) -> DataFrame:
    """What a link lacks: link_key, one hub key for each of ``keys`` (hk_<name>), load_dt, load_src; rows with a null key have none, of combinations with one link key the least counts.

    Different combinations have one link key only where a part has the separator in it, so only those are compared. Link keys are shuffled as 16 bytes, and they and the hub keys are written out for what is left in the end.
    """
    pairs = source.select(*keys).dropna()
    parted = reduce(lambda x, y: x | y, [F.contains(F.col(k).cast("string"), F.lit("_")) for k in keys])
    link = join_key(*[F.col(k) for k in keys])
    odd = top_per(pairs.filter(parted).distinct().withColumn("_link", F.unhex(F.md5(link))), ["_link"], [F.asc(k) for k in keys])
    every = pairs.filter(~parted).distinct().withColumn("_link", F.unhex(F.md5(link))).unionByName(odd)
    new = every.join(target.select(_digest(F.col("link_key")).alias("_link")), "_link", "left_anti")
    return new.select(md5_uuid(link).alias("link_key"), *[md5_uuid(F.col(k)).alias(f"hk_{k}") for k in keys], load_dt.alias("load_dt"), F.lit(load_src).alias("load_src")).select(target.columns)


def load_link(source: DataFrame, target: DataFrame, keys: Keys, load_src: str, load_dt: Column) -> DataFrame:
    """The link with the combinations that it lacked."""
    return target.unionByName(missing_links(source, target, keys, load_src, load_dt))


def satellite_changes(source: DataFrame, target: DataFrame, key: str, attributes: Keys, load_src: str, order: str | Column) -> DataFrame:
    """The rows that a satellite lacks: key, attributes, hashdiff, load_dt, load_src, one for each change of state after the key's newest row.

    ``order``: the time of each state, a column or, for a snapshot with one state a key, its time; it becomes load_dt. Of states of a key at one time the
    one with the greatest hash counts. Rows with a null key or time have none.
    """
    at = (F.col(order) if isinstance(order, str) else order).cast("timestamp")
    hash_ = F.md5(F.concat_ws("_", *[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes]))  # see ``hashdiff``
    states = source.select(key, *attributes, at.alias("load_dt")).dropna(subset=[key, "load_dt"]).withColumn("_hash", F.unhex(hash_))
    states = top_per(states, [key, "load_dt"], [F.desc("_hash")])
    newest = target.groupBy(key).agg(F.max_by("hashdiff", "load_dt").alias("_was"), F.max("load_dt").alias("load_dt"))
    every = states.withColumn("_new", F.lit(True)).unionByName(newest.select(key, "load_dt", _digest(F.col("_was")).alias("_hash"), F.lit(False).alias("_new")), allowMissingColumns=True)
    # rows of a key by time: the newest of the target comes first of those that count
    of = Window.partitionBy(key)
    since = F.max(F.when(~F.col("_new"), F.col("load_dt"))).over(of)
    counted = every.withColumn("_since", since).filter("NOT _new OR _since IS NULL OR load_dt > _since")
    before = F.lag("_hash").over(of.orderBy("load_dt"))
    changed = counted.withColumn("_before", before).filter(F.col("_new") & ~F.col("_hash").eqNullSafe(F.col("_before")))
    return changed.select(key, *attributes, hashdiff(*[F.col(a) for a in attributes]).alias("hashdiff"), "load_dt", F.lit(load_src).alias("load_src")).select(target.columns)


def load_satellite(source: DataFrame, target: DataFrame, key: str, attributes: Keys, load_src: str, order: str | Column, mode: str = "by_change") -> DataFrame:
    """The satellite (key, attributes, hashdiff, load_dt, load_src) with the rows that it lacked.

    by_change: one for each change of state, see ``satellite_changes``. by_load_dt: where the key has none at that time. by_event: where the same key and attributes are
    not there yet.
    """
    if mode == "by_change":
        return target.unionByName(satellite_changes(source, target, key, attributes, load_src, order))
    at = (F.col(order) if isinstance(order, str) else order).cast("timestamp")
    rows = source.select(key, *attributes, hashdiff(*[F.col(a) for a in attributes]).alias("hashdiff"), at.alias("load_dt"), F.lit(load_src).alias("load_src"))
    return insert_new(rows, target, [key, "hashdiff"] if mode == "by_event" else [key, "load_dt"])


def apply_counters(batch: DataFrame, counters: DataFrame, ledger: DataFrame, unit: str, keys: Keys, once_per_unit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new counters, new ledger): each unit counts once for ever. ``counters``: keys, n. ``ledger``: unit. Publish both together."""
    new = batch.dropna(subset=[unit]).join(ledger, unit, "left_anti")
    rows = new.select(unit, *keys).distinct() if once_per_unit else new
    added = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    totals = counters.select(*keys, "n").unionByName(added).groupBy(*keys).agg(F.sum("n").alias("n"))
    return totals, ledger.unionByName(new.select(unit).distinct())


def land_documents(df: DataFrame, document: str, key_paths: Keys, ts_path: str, now: Column) -> DataFrame:
    """object_id, object_value, update_ts of raw JSON documents: the first id found, the newest document of each. Documents without id are dropped."""
    ids = F.coalesce(*[F.get_json_object(document, p) for path in key_paths for p in (f"{path}.$oid", path)])
    rows = df.select(ids.alias("object_id"), F.col(document).alias("object_value"), F.coalesce(F.try_to_timestamp(F.get_json_object(document, ts_path)), now).alias("update_ts"))
    return _newest(rows, ["object_id"], "update_ts")


def read_documents(df: DataFrame, schema: str, key_paths: Keys, ts_path: str, now: Column, document: str = "document") -> DataFrame:
    """(object_id, value): the newest document of each id, parsed; a lookup by id is a join with it. A document that isn't JSON has no id and goes."""
    return land_documents(df, document, key_paths, ts_path, now).select("object_id", F.from_json("object_value", schema).alias("value"))
