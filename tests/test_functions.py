"""Scalar rules on chosen values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramline.functions import text, timeofday


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (timeofday.normalise, {"4:25 AM": "04:25", "1:05 PM": "13:05", "12:30 AM": "00:30", "12:30 pm": "12:30", "05:55:00": "05:55", "9:05": "09:05", "24:00": None, "9:60": None, "junk": None, "": None, None: None}),
        (timeofday.twelve_hour, {"4:25 AM": "04:25", "12:01 PM": "12:01", "9:05": None, "9:61 AM": None}),
        (timeofday.service_day, {"06:15": "06:15", "6:32": "06:32", "0648": "06:48", "27:10": "27:10", "28:00": None, "0670": None, "": None}),
        (timeofday.usable, {"9:05": "9:05", " 23:59 ": "23:59", "24:00": None, "_ _ : _ _": None}),
        (timeofday.notice_board, {"12 noon": "12:00", "12:15 midnight": "00:15", "7": "07:00", "5:30 PM": "17:30", "hourly": "hourly", "": None}),
        (timeofday.lenient, {"dep. 7:05 pm daily": "19:05", "no time": None}),
        (text.alias, {"Burdwan Station": "bardhaman", "Old Howrah Gate (West)": "howrah", "KGP": "kharagpur"}),
        (text.suffix_strip, {"Garia Bus Stand": "garia", "Ruby Mor Crossing": "ruby", "Market": "market", "Naya Bazaar Market": "naya"}),
        (text.gov_stop, {"Esplanade  Bus Terminus": "esplanade", "A-B Stand": "a b"}),
        (text.transfer_key, {"Kempegowda Bus Stand": "majestic", "KBS Majestic Metro Station": "majestic", "M.G. Road": "m g road"}),
        (text.slug, {" A & B ": "a-and-b", "x__y": "x-y"}),
        (text.phone, {"+91 98300-12345": "9830012345", "033 2214": "0332214"}),
        (text.candidate_kind, {"Home": "Filter/UI Element", "Login here": "Authentication", "Privacy": "Static Content", "Nadia district": "District Page", "Bolton to Howrah": "Route", "A-B": "Unknown", "xy - zz": "Filter/UI Element", "Bolton": "Unknown"}),
        (text.service_class, {"AC Volvo": "PREMIUM", "Express bus": "EXPRESS", "Night owl": "NIGHT", "Place": "REGULAR"}),
    ],
)
def test_rule(spark, rule, cases):
    assert values(spark, rule, list(cases)) == list(cases.values())


def test_via_and_stop_list(spark):
    assert values(spark, text.split_via, ["via A, B→C – D", ""]) == [["A", "B", "C", "D"], []]
    row = spark.sql("select array('via', 'X', 'X  Bus Stand', 'nil', 'Y') v").select(text.stop_list(F.lit("A"), F.col("v"), F.lit("Y terminus")).alias("s")).first()
    assert row["s"] == ["A", "X", "Y"]


def test_recover_ends(spark):
    df = spark.createDataFrame([("OP \n Reg No : X \n Digha ( Howrah \n 12 stops )",), ("OP \n Reg No : X \n Digha \n",), (None,)], "v string")
    o, a, b = text.recover_ends(F.col("v"))
    assert [tuple(r) for r in df.select(o, a, b).collect()] == [("OP", "Digha", "Howrah"), ("OP", "Digha", None), (None, None, None)]


def test_normalisers_are_idempotent(spark):
    inputs = ["Bus Stand  Metro", "  A & B / C ", "Old-New (Gate) halt", "ÉCOLE", ""]
    for rule in (text.name_key, text.spaces, text.alnum_space, text.slug, text.transfer_key, text.suffix_strip):
        once = values(spark, rule, inputs)
        assert values(spark, rule, once) == once


def test_clock_never_prints_sixty(spark):
    got = spark.range(0, 1440).select(timeofday.from_minutes(F.col("id") + 0.6).alias("t")).collect()
    assert all(r["t"][3:] < "60" for r in got) and got[-1]["t"] == "00:00"


def test_geodesics(spark):
    """Published lengths on the ellipsoid, to a millimetre; the shorter way over the 180th meridian; the sphere where it doesn't settle; the sphere's slack."""
    from pyspark.sql import functions as F

    from tramline.functions import geo

    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)
    pairs = [(dms(-37, 57, 3.7203), dms(144, 25, 29.5244), dms(-37, 39, 10.1561), dms(143, 55, 35.3839)), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 90.0, 0.0), (10.0, 20.0, 10.0, 20.0), (10.0, 179.9, 10.0, -179.9), (10.0, 0.1, 10.0, 0.3), (0.0, 0.0, 0.5, 179.7), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [tuple(r) for r in df.select(geo.geodesic_m(*map(F.col, "abcd")), geo.distance_m(*map(F.col, "abcd"))).collect()]
    for (metres, _), want in zip(got, [54972.271, 111319.491, 10001965.729, 0.0], strict=False):
        assert abs(metres - want) < 0.001
    assert abs(got[4][0] - got[5][0]) < 1e-6 and got[6][0] == got[6][1] and got[7] == (None, None)
    near = spark.range(3000).select(((F.rand(1) - 0.5) * 170).alias("a"), (F.rand(2) * 300).alias("b"), F.rand(3).alias("y"), F.rand(4).alias("x")).select("a", "b", (F.col("a") + F.col("y") - 0.5).alias("c"), (F.col("b") + F.col("x")).alias("d"))
    ratio = geo.geodesic_m(*map(F.col, "abcd")) / geo.distance_m(*map(F.col, "abcd"))
    low, high = near.agg(F.min(ratio), F.max(ratio)).first()
    assert 1 / geo.SPHERE_SLACK < low and high < geo.SPHERE_SLACK
