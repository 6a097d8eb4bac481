import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as S


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("MÃ©xico", "México"), ("México", "México"), ("Tokyo", "Tokyo"), ("東京", "東京"), (None, None), ("", "")])
def test_mojibake(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(S.repair_mojibake(F.col("s")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("given", "want"), [("1,234,567", 1234567.0), (" 12 ", 12.0), ("nan", None), ("x", None), (None, None)])
def test_numbers(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(S.parse_number(F.col("s")).alias("x")).first()["x"] == want


def test_flags_and_keys(spark):
    df = spark.createDataFrame([(" True ", " Foo", "BAR "), ("0", None, "b")], "f string, a string, b string")
    rows = df.select(S.parse_flag(F.col("f")).alias("f"), S.match_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [(True, "foo||bar"), (False, None)]


def test_ratio_over_zero_is_null(spark):
    assert one(spark, S.ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None


def test_climate_groups(spark):
    df = spark.createDataFrame([(v,) for v in (1, 3, 4, 7, 8, 16, 17, 28, 29, None)], "c int")
    assert "".join(r[0] or "-" for r in df.select(S.climate_group(F.col("c"))).collect()) == "AABBCCDDE-"


@pytest.mark.parametrize(("name", "want"), [("LST_20180101.tif", "2018-01-01"), ("x_2018-12-31.tif", "2018-12-31"), ("x_2018365.tif", "2018-12-31"), ("x_2019366.tif", None), ("x_20181331.tif", None), ("none.tif", None), ("12018010199", None)])
def test_dates_in_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(S.date_in_name(F.col("n")).alias("d")).first()["d"]
    assert (None if got is None else str(got)) == want


def test_equal_area_projection(spark):
    """One-degree boxes keep their area: about 12,360 square kilometres at the equator and half of that at 60 degrees."""
    for lat, low, high in ((0.0, 12_300, 12_420), (60.0, 5_900, 6_200)):
        corners = [(lat, 0.0), (lat, 1.0), (lat + 1, 1.0), (lat + 1, 0.0)]
        df = spark.createDataFrame(corners, "lat double, lon double")
        pts = [(r["p"]["x"], r["p"]["y"]) for r in df.select(S.to_mollweide(F.col("lat"), F.col("lon")).alias("p")).collect()]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True))) / 2e6
        assert low < area < high


def test_mollweide_poles(spark):
    p = one(spark, S.to_mollweide(F.col("a"), F.col("b")), a=90.0, b=30.0)
    assert p["x"] == pytest.approx(0, abs=1e-3)
    assert p["y"] == pytest.approx(math.sqrt(2) * S.SPHERE_M)


def test_haversine(spark):
    assert one(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * S.EARTH_KM)


def test_units_from_escaped_degree(spark):
    u = one(spark, S.unit_of(F.col("m"), F.col("a"), F.col("b")), m='{"u": "\\u00b0C"}', a=-5000.0, b=9000.0)
    assert tuple(u) == ("degC", "metadata")


def test_id_lists(spark):
    assert one(spark, S.join_ids(F.array(F.lit(10), F.lit(9), F.lit(100)))) == "9;10;100"
    assert one(spark, S.split_ids(F.lit("3; 4;5"))) == [3, 4, 5]


def test_tiles_floor_below_zero(spark):
    assert one(spark, S.tile_id(F.lit(-90.0), F.lit(-180.0))) == 0
    assert one(spark, S.tile_id(F.lit(-0.5), F.lit(-0.5))) == 8017
