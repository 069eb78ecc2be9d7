"""Column builders: no UDFs, so all of them stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; the argument of asin is held to 1."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def round_positive(c, digits: int) -> Column:
    """Rounds a double that isn't negative, halves up, by arithmetic alone. F.round prints each value
    and reads it again as a decimal, which costs more than a distance does."""
    up = col(c) * F.lit(10.0**digits)
    low = F.floor(up)
    return (low + F.when(up - low >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)


def cell(lat, lon, size: float) -> Column:
    """Name of the grid cell of a position."""
    return F.concat_ws("_", F.floor(col(lat) / F.lit(size)).cast("string"), F.floor(col(lon) / F.lit(size)).cast("string"))


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts) -> Column:
    return micros(ts) / F.lit(1e6)


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def lenient_timestamp(c, formats=("dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def lenient(c, kind: str) -> Column:
    return col(c).try_cast(kind)


def position_ok(lat, lon, box=(-90.0, 90.0, -180.0, 180.0)) -> Column:
    lat, lon = col(lat), col(lon)
    return F.coalesce(lat.between(*box[:2]) & lon.between(*box[2:]) & ~((lat == 0) & (lon == 0)), F.lit(False))


def contains_any(c, words) -> Column:
    """Whether the lower-cased text holds any of the words; null holds none."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def number_valid(imo) -> Column:
    """Seven digits, the first not 0, whose weighted sum (7 to 2) ends in the last digit."""
    n = col(imo).cast("long")
    total = sum(((F.floor(n / F.lit(10**p)) % 10) * w for p, w in zip(range(6, 0, -1), range(7, 1, -1))), F.lit(0))
    return F.coalesce(n.between(1_000_000, 9_999_999) & (total % 10 == n % 10), F.lit(False))


def numbers_in(text) -> Column:
    """Numbers of one to three digits before an optional fraction, as they stand in a text."""
    return F.regexp_extract_all(col(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def names_port(c, codes: str, names: str) -> Column:
    """Whether a destination names a port, by code or by its name without spaces and signs."""
    up = F.upper(F.coalesce(col(c), F.lit("")))
    return up.rlike(codes) | F.regexp_replace(up, "[^A-Z0-9]", "").rlike(names)


def in_boxes(lat, lon, boxes) -> Column:
    out = F.lit(False)
    for lo_lat, hi_lat, lo_lon, hi_lon in boxes:
        out = out | (col(lat).between(lo_lat, hi_lat) & col(lon).between(lo_lon, hi_lon))
    return out


def synthetic_id(*parts) -> Column:
    return F.concat(F.lit("syn:"), F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, 16))


def upper_median(values) -> Column:
    """Of an array: the upper of the two middle values where their number is even."""
    s = F.array_sort(F.filter(col(values), lambda x: x.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))
