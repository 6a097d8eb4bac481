"""Scalar column functions: text repair, keys, codes, geography, overlap measures, file-name dates.

All are Catalyst expressions. Missing is NULL throughout: NaN is turned into NULL where it can arise, and divisions by
zero give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
SPHERE_M = 6378137.0


def not_nan(c: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1, undone; text that isn't such is unchanged."""
    return F.when(c.rlike(r"^[\x{00}-\x{FF}]*$"), F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")), c)).otherwise(c)


def parse_number(c: Column) -> Column:
    """Text with thousands commas to double; anything else to NULL."""
    return not_nan(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double"))


def parse_flag(c: Column) -> Column:
    """'True', ' true ' and the like; everything else, NULL too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def match_key(name: Column, country: Column) -> Column:
    """Composite key of two trimmed lower-case texts; NULL if either is missing, so that it never matches."""
    return F.concat(F.lower(F.trim(name)), F.lit("||"), F.lower(F.trim(country)))


def climate_group(code: Column) -> Column:
    """Climate code 1-30 to its major group; other values to NULL."""
    return F.when(code.isNull() | F.isnan(code.cast("double")), None).when(code <= 3, "A").when(code <= 7, "B").when(code <= 16, "C").when(code <= 28, "D").otherwise("E")


def clipped_log(c: Column, least: float | None = None, base10: bool = False) -> Column:
    """Logarithm, of at least `least` if given; NULL outside the domain."""
    x = c if least is None else F.greatest(c, F.lit(least))
    return F.when(x > 0, F.log10(x) if base10 else F.ln(x))


def row_mean(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) / F.lit(float(len(columns)))


def any_missing(columns: Sequence[Column]) -> Column:
    return F.exists(F.array(*columns), lambda x: x.isNull() | F.isnan(x))


def any_negative(columns: Sequence[Column]) -> Column:
    return F.exists(F.array(*columns), lambda x: F.coalesce(x < 0, F.lit(False)))


def any_infinite(columns: Sequence[Column]) -> Column:
    return F.exists(F.array(*columns), lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_xyz(lat: Column, lon: Column) -> Column:
    """Point on the unit sphere, as an array."""
    a, b = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def tile_id(lat: Column, lon: Column, degrees: float = 10.0) -> Column:
    return (F.floor((lat + 90) / degrees) * 1000 + F.floor((lon + 180) / degrees)).cast("long")


def to_mollweide(lat: Column, lon: Column, radius: float = SPHERE_M, rounds: int = 25) -> Column:
    """struct(x, y) in metres; the auxiliary angle by Newton's method."""
    phi = F.radians(lat)
    target = F.lit(3.141592653589793) * F.sin(phi)
    step = lambda t, _: F.when(F.abs(F.cos(t / 2)) < 1e-9, t).otherwise(t - (t + F.sin(t) - target) / (1 + F.cos(t)))
    theta = F.when(F.abs(lat) >= 90, F.signum(lat) * F.lit(3.141592653589793 / 2)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), phi, step) / 2)
    return F.struct((F.lit(2 * 2**0.5 / 3.141592653589793 * radius) * F.radians(lon) * F.cos(theta)).alias("x"), (F.lit(2**0.5 * radius) * F.sin(theta)).alias("y"))


def from_mollweide(x: Column, y: Column, radius: float = SPHERE_M) -> Column:
    """struct(lat, lon) in degrees, in closed form; NULL beyond the map."""
    s = y / F.lit(2**0.5 * radius)
    theta = F.asin(F.when(F.abs(s) <= 1, s))
    lat = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (2 * theta + F.sin(2 * theta)) / F.lit(3.141592653589793)))))
    return F.struct(lat.alias("lat"), F.degrees(F.lit(3.141592653589793) * x / F.nullif(F.lit(2 * 2**0.5 * radius) * F.cos(theta), F.lit(0.0))).alias("lon"))


def overlap_measures(inter: Column, a: Column, b: Column) -> dict[str, Column]:
    """Shares of an overlap in both areas, in the smaller one, in the union, and the area ratio; NULL over a zero area."""
    return {"frac_a": ratio(inter, a), "frac_b": ratio(inter, b), "overlap_over_min": ratio(inter, F.least(a, b)), "iou": ratio(inter, a + b - inter), "area_ratio": ratio(a, b)}


def is_link(overlap_over_min: Column, least: float = 0.5) -> Column:
    return F.coalesce(overlap_over_min >= least, F.lit(False))


def strict_pair(iou: Column, area_ratio: Column, distance_km: Column, least_iou: float = 0.25, ratios: tuple[float, float] = (0.25, 4.0), most_km: float = 25.0) -> Column:
    return F.coalesce((iou >= least_iou) & area_ratio.between(*ratios) & (distance_km <= most_km), F.lit(False))


def response_field(name: Column) -> Column:
    """struct(period, diurnal) of a response column's name, such as `Summer_day`; NULL for others."""
    pattern = r"(?i)^(annual|summer|winter)_(day|nig(?:ht)?)$"
    return F.when(name.rlike(pattern), F.struct(F.initcap(F.regexp_extract(name, pattern, 1)).alias("period"), F.substring(F.lower(F.regexp_extract(name, pattern, 2)), 1, 3).alias("diurnal")))


_YMD = r"(?<!\d)(\d{4})[-_]?(\d{2})[-_]?(\d{2})(?!\d)"
_YJ = r"(?<!\d)(\d{4})[-_]?(\d{3})(?!\d)"


def date_in_name(name: Column) -> Column:
    """Date in a file name: year-month-day first, then year and day of year; NULL if there is none that exists."""
    part = lambda p, i: F.regexp_extract(name, p, i)
    full = F.when(name.rlike(_YMD), F.to_date(F.try_to_timestamp(F.concat_ws("-", part(_YMD, 1), part(_YMD, 2), part(_YMD, 3)), F.lit("yyyy-MM-dd"))))
    year, day = part(_YJ, 1).try_cast("int"), part(_YJ, 2).try_cast("int")
    start = F.to_date(F.try_to_timestamp(F.concat(part(_YJ, 1), F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    julian = F.when(name.rlike(_YJ) & (day >= 1), F.date_add(start, F.coalesce(day, F.lit(1)) - 1))
    return F.coalesce(full, F.when(F.year(julian) == year, julian))


def canonical_name(date: Column, pattern: str = "yyyy_MM_dd", suffix: str = "_DMLST.tif") -> Column:
    return F.concat(F.date_format(date, pattern), F.lit(suffix))


def unit_of(metadata: Column, low: Column, high: Column) -> Column:
    """struct(unit, evidence) of temperatures: from the words of their metadata, else from their range."""
    said = F.lower(metadata)
    kelvin = said.rlike(r"kelvin|\"k\"|unit[^a-z]*k\b")
    celsius = said.rlike("celsius|degc|°c|\\\\u00b0c")
    return (
        F.when(kelvin, F.struct(F.lit("K").alias("unit"), F.lit("metadata").alias("evidence")))
        .when(celsius, F.struct(F.lit("degC").alias("unit"), F.lit("metadata").alias("evidence")))
        .when((low >= 180) & (high <= 380), F.struct(F.lit("K").alias("unit"), F.lit("numeric_diagnostic_only").alias("evidence")))
        .when((low >= -100) & (high <= 100), F.struct(F.lit("degC").alias("unit"), F.lit("numeric_diagnostic_only").alias("evidence")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("unit"), F.lit("unresolved").alias("evidence")))
    )


def mentions(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def split_ids(joined: Column, by: str = ";") -> Column:
    return F.transform(F.split(joined, by), lambda x: F.trim(x).cast("long"))


def join_ids(ids: Column, by: str = ";") -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), by)


def cross_products(z: Column) -> Column:
    """Nine products of four standardised columns: the squares, and all cross terms but the third with the fourth."""
    pairs = [(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    return F.array(*[z[i] * z[j] for i, j in pairs])


def quadratic(z: Column, width: int) -> Column:
    """All terms of degree one and two of an array of `width` columns, without a constant."""
    return F.concat(z, F.array(*[z[i] * z[j] for i in range(width) for j in range(i, width)]))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_draw(seed: Column, modulo: int) -> Column:
    """A whole number below `modulo` from the first 32 bits of an MD5: the same in every engine and on every partition."""
    return (F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long") % modulo).cast("long")
