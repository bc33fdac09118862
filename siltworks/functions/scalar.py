"""Column expressions: keys and hashes, dates, numbers, JSON, geography. All are native, none is a Python UDF."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- conditions and arithmetic


def tier(value: Column, bands: list[tuple[float, object]], otherwise) -> Column:
    """The result of the first band whose upper bound is above ``value``; a null value is in the lowest band."""
    out = F.when(value.isNull(), F.lit(bands[0][1]))
    for bound, result in bands:
        out = out.when(value < bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def signed(amount: Column, status: Column, negative: str) -> Column:
    return F.when(status == negative, -amount).otherwise(amount)


def safe_div(a: Column, b: Column) -> Column:
    """Null where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0).cast("int"))


def distinct_from(a: Column, b: Column) -> Column:
    """Inequality that treats nulls as equal to each other."""
    return ~a.eqNullSafe(b)


def same_text(a: Column, b: Column | str) -> Column:
    """Equal but for letter case; null counts as empty."""
    b = F.lit(b) if isinstance(b, str) else b
    return F.upper(F.coalesce(a, F.lit(""))) == F.upper(F.coalesce(b, F.lit("")))


def digits_only(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def line_total(price: Column, quantity: Column) -> Column:
    return F.coalesce(price, F.lit(0)) * F.coalesce(quantity, F.lit(0))


def pct_fee(amount: Column, pct: float) -> Column:
    return amount * F.lit(pct)


def net(total: Column, *less: Column) -> Column:
    for x in less:
        total = total - x
    return total


def to_decimal(value: Column, precision: int, scale: int) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def nearest_decimal(value: Column, precision: int, scale: int) -> Column:
    """A double as a decimal by its binary value times ten to the scale, halves away from zero, as DuckDB casts it. Spark's own cast rounds the shortest text of the double: 525.675 gives 525.68, here 525.67 (525.675 * 100 = 52567.49999999999)."""
    return (F.round(value * F.lit(float(10**scale))).cast(f"decimal({precision},0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def try_as(value: Column, kind: str) -> Column:
    """Null where the cast fails."""
    return value.try_cast(kind)


# -- keys and hashes


def join_key(*cols: Column) -> Column:
    """The parts joined by '_'; null if any part is, unlike concat_ws."""
    parts = [cols[0].cast("string")]
    for c in cols[1:]:
        parts += [F.lit("_"), c.cast("string")]
    return F.concat(*parts)


def md5_bigint(value: Column) -> Column:
    """The first 64 bits of the MD5 as a signed integer."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 16), 16, -10).cast("bigint")


def md5_uuid(value: Column) -> Column:
    return F.regexp_replace(F.md5(value.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def hash_key(*cols: Column) -> Column:
    """64 bits of the MD5 of several parts; nulls count as empty, and no part runs into the next. Any engine can compute it."""
    return md5_bigint(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def hashdiff(*cols: Column) -> Column:
    """UUID text of the attributes' MD5; nulls count as empty."""
    return md5_uuid(F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


# -- dates


def parse_ts(value: Column, *formats: str) -> Column:
    """The first format that fits, then the default one, else null."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats], F.try_to_timestamp(value))


def as_date(ts: Column) -> Column:
    return F.to_date(ts)


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def week_of(ts: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def day_span(start: Column, end: Column) -> Column:
    """Days from start to end, both counted."""
    return F.datediff(end, start) + 1


def to_local(ts_utc: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts_utc, zone)


def epoch_now(as_of: int | None = None) -> Column:
    return F.lit(as_of).cast("int") if as_of is not None else F.unix_timestamp().cast("int")


def time_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "time": F.date_format(ts, "HH:mm:ss"), "date": F.to_date(ts)}


def to_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def days_before(day: Column, n: int) -> Column:
    return F.date_sub(day, n)


def day_floor(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def document_ts(doc: Column, path: str) -> Column:
    """A date in a JSON document, written as {"$date": ...}, {"$date": {"$numberLong": ...}}, digits (milliseconds above 1e12, else seconds) or ISO text."""
    text = F.coalesce(F.get_json_object(doc, f"{path}.$date.$numberLong"), F.get_json_object(doc, f"{path}.$date"), F.get_json_object(doc, path))
    number = F.when(digits_only(text), text.try_cast("bigint"))
    seconds = F.when(number > 10**12, F.timestamp_millis(number)).when(number.isNotNull(), F.timestamp_seconds(number))
    return F.coalesce(seconds, F.when(~digits_only(text), F.try_to_timestamp(text)))


# -- JSON


def json_str(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def json_dec(doc: Column, path: str, precision: int, scale: int) -> Column:
    return F.get_json_object(doc, path).try_cast(f"decimal({precision},{scale})")


def json_has(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path).isNotNull()


def row_json(*cols: str) -> Column:
    return F.to_json(F.struct(*(cols or ("*",))))


def document_id(doc: Column, *paths: str) -> Column:
    """The first id found under the paths, as {"$oid": ...} or a scalar."""
    return F.coalesce(*[F.get_json_object(doc, p) for path in paths for p in (f"{path}.$oid", path)])


def first_path(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


# -- geography


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, r: float = 6371.0) -> Column:
    """Great-circle distance of degrees; rounding beyond a half circle is clamped."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * r) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def city_zone(city: Column, zones: dict[str, str], default: str = "Australia/Sydney") -> Column:
    pairs = [F.lit(x) for kv in zones.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[city], F.lit(default)) if pairs else F.lit(default)
