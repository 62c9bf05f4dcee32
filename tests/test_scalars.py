import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from nightglass.functions import scalars as X
from nightglass.functions import text as T
from nightglass.operators import headers as H
from nightglass.operators import pixels as P
from nightglass.operators import quality as Q
from nightglass.operators import stars as ST


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("12 30 45", 12.5125), ("-45 30 15", -45.50416666666667), ("0 0 0", 0.0), ("not a coordinate", None), ("12 30", None), ("-0 30 0", -0.5), ("1 2 3 4", 1 + 2 / 60 + 3 / 3600), ("1:2:3", None)])
def test_sexagesimal(spark, text, want):
    got = one(spark, T.parse_sexagesimal(F.lit(text)))
    assert got == want if want is None else math.isclose(got, want)


def test_plate_scale_and_field(spark):
    assert one(spark, X.plate_scale(F.lit(5.0), F.lit(1000.0))) == pytest.approx(1.031325, abs=1e-4)
    assert one(spark, X.plate_scale(F.lit(None).cast("double"), F.lit(1000.0))) is None
    assert one(spark, X.plate_scale(F.lit(5.0), F.lit(0.0))) == math.inf
    f = one(spark, X.field_of_view(F.lit(4096), F.lit(2160), X.plate_scale(F.lit(5.0), F.lit(1000.0))))
    assert (f["width"], f["height"]) == (pytest.approx(70.48, abs=0.1), pytest.approx(37.14, abs=0.1))


@pytest.mark.parametrize("longitude,hours", [(0, 0), (15, 1), (-75, -5), (127.5, 9), (None, None)])
def test_zone(spark, longitude, hours):
    assert one(spark, X.zone_hours(F.lit(longitude).cast("double"))) == hours


@pytest.mark.parametrize("obs,longitude,want", [((15, 2), None, (14, 12)), ((15, 14), None, (15, 12)), ((15, 14), -75.0, (14, 12))])
def test_session_date(spark, obs, longitude, want):
    at = F.lit(dt.datetime(2023, 5, *obs)).cast("timestamp_ntz")
    assert one(spark, X.session_date(at, F.lit(longitude).cast("double")).cast("timestamp_ntz")) == dt.datetime(2023, 5, *want)


@pytest.mark.parametrize("text,ok", [("1.5", True), ("1.5f", False), (" 2 ", False), ("1.5D3", False), ("1e3", True), ("", False), ("T", False), (".5", True), ("5.", True), ("nan", True)])
def test_numbers(spark, text, ok):
    assert (one(spark, T.parse_number(F.lit(text), "double")) is not None) == ok
    assert one(spark, T.parse_integer(F.lit("120.0"))) is None


@pytest.mark.parametrize("text,ok", [("2024-09-04T08:39:13.204", True), ("2024-09-04T08:39:13Z", True), ("2024-09-04 08:39:13", True), ("2024-09-04", False), ("2024-09-04T08:39:13+00:00", False), ("2024-13-04T08:39:13", False)])
def test_dates(spark, text, ok):
    assert (one(spark, T.parse_date_time(F.lit(text))) is not None) == ok


def test_shapes_and_snr(spark):
    assert one(spark, X.eccentricity(F.lit(5.0), F.lit(5.0))) == 0
    assert one(spark, X.eccentricity(F.lit(10.0), F.lit(5.0))) == pytest.approx(0.866, abs=1e-3)
    assert math.isnan(one(spark, X.eccentricity(F.lit(1.0), F.lit(2.0))))
    assert one(spark, X.fwhm(F.lit(6.0), F.lit(4.0))) == 5
    nan = F.lit(float("nan"))
    for err, want in ((2.0, 5.0), (0.0, 3.0), (-1.0, 3.0)):
        assert one(spark, X.star_snr(F.lit(9.0), F.lit(10.0), F.lit(err))) == want
    assert one(spark, X.star_snr(F.lit(9.0), F.lit(10.0), nan)) == 3
    assert one(spark, X.star_snr(nan, F.lit(10.0), F.lit(0.0))) == 0


def test_header_text(spark):
    assert one(spark, T.clean_card_value(F.lit(" 'it''s  ' "))) == "it's"
    assert one(spark, T.card_keyword(F.lit("HIERARCH ESO X = 1"))) == "HIERARCH ESO X"
    assert one(spark, T.card_keyword(F.lit("HIERARCH"))) == "HIERARCH"
    assert one(spark, T.xml_attribute(F.lit('<a id="" name="x">'), "id")) == ""
    assert one(spark, T.xml_attribute(F.lit("<a>"), "id")) is None
    assert one(spark, T.key_values(F.lit("a=1;b=x;c;a=2;d=3=4"))) == {"a": 2.0}
    assert one(spark, T.geometry(F.lit("2:3:1")))["height"] == 3
    assert one(spark, T.geometry(F.lit("2:0:1"))) is None
    assert one(spark, T.attachment_location(F.lit("attachment:512:8")))["offset"] == 512
    assert one(spark, T.attachment_location(F.lit("inline:512:8"))) is None
    assert one(spark, T.frame_id(F.lit("/a/b.fits//"))) == "b.fits"
    assert one(spark, T.frame_id(F.lit(""))) == "unknown"
    assert one(spark, T.xml_header(F.lit("junk<?xml a?>\0zz"))) == "<?xml a?>"
    assert one(spark, T.xml_header(F.lit("junk"))) is None
    assert one(spark, T.xml_header(F.lit("junk"), strict=False)) == "junk"


def test_header_map_and_aliases(spark):
    rows = [("DUPKEY", "one"), ("DUPKEY", "two"), ("OBJECT", None), ("GAIN", "x"), ("EGAIN", "3"), ("object", "M42")]
    df = spark.createDataFrame([([(0, i + 1, k, v, None, None) for i, (k, v) in enumerate(rows)],)], "cards array<struct<hdu_index:int,card_index:int,keyword:string,value:string,comment:string,raw_card:string>>")
    df = df.withColumn("h", H.header_map("cards"))
    r = df.select("h", H.lookup("h", "OBJECT").alias("o"), H.first_float("h", ["GAIN", "EGAIN"]).alias("g"), H.first_string("h", ["NONE", "DUPKEY"]).alias("s")).first()
    assert r["h"] == {"DUPKEY": "two", "GAIN": "x", "EGAIN": "3", "object": "M42"}
    assert (r["o"], r["g"], r["s"]) == ("M42", 3.0, "two")


@pytest.mark.parametrize("px,want", [([100.0, 200, 300, 400, 500], [0, 0.25, 0.5, 0.75, 1]), ([], []), ([42.0], [0]), ([10.0, 10, 10], [0, 0, 0])])
def test_normalize(spark, px, want):
    assert one(spark, P.normalize_pixels(F.array(*map(F.lit, px)) if px else F.expr("cast(array() as array<double>)"))) == want


def test_pixel_stats(spark):
    px = F.array(F.lit(1.0), F.lit(3.0), F.lit(float("nan")), F.lit(float("inf")))
    s = one(spark, P.pixel_stats(px))
    assert (s["min"], s["max"], s["mean"]) == (1, 3, 1)
    assert one(spark, P.has_nonfinite(px)) and not one(spark, P.has_nonfinite(F.array(F.lit(1.0))))


STARS = [(1, 1000.0, 6.0, 4.0, 0.8, 5.0, 10.0, 1200.0, 20.0, 1.5, 0), (2, 2000.0, 8.0, 6.0, 0.7, 7.0, 12.0, 2400.0, 30.0, 1.33, 1), (3, 3000.0, 4.0, 3.0, 0.6, 3.5, 8.0, 3600.0, 40.0, 1.33, 0)]


def test_star_stats(spark):
    df = spark.createDataFrame([("f", *s) for s in STARS], "frame_id string, star_idx int, flux double, a double, b double, eccentricity double, fwhm double, kron_radius double, flux_auto double, fluxerr_auto double, elongation double, flag int")
    df = df.withColumn("snr", X.star_snr("flux", "flux_auto", "fluxerr_auto"))
    r = ST.star_stats(df, "frame_id").first()
    assert (r["count"], r["median_fwhm"], r["median_eccentricity"]) == (3, 5.0, 0.7)
    assert r["flagged_fraction"] == pytest.approx(1 / 3)
    top = ST.star_stats(df, "frame_id", top=2, order=["star_idx"]).first()
    assert (top["count"], top["median_fwhm"]) == (3, 7.0)  # the upper median of 3.5 and 7
    frames = spark.createDataFrame([("f",), ("g",)], "frame_id string")
    empty = ST.with_starless(frames, ST.star_stats(df, "frame_id"), "frame_id").filter("frame_id = 'g'").first()
    assert empty["count"] == 0 and empty["median_fwhm"] == 0


def test_quality(spark):
    cols = dict(median_fwhm=3.0, median_eccentricity=0.2, fwhm_std_dev=0.5, eccentricity_std_dev=0.05, median_kron_radius=5.0, median_flux=1000.0, median_snr=50.0, median_elongation=1.2, flagged_fraction=0.05, kron_radius_std_dev=1.0, flux_std_dev=200.0, snr_std_dev=10.0, bg_median=100.0, bg_rms=5.0, bg_min=90.0, bg_max=110.0, bg_uniformity=0.9, count=100)
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    r = Q.quality_scores(df).first()
    for k, v in dict(fwhm=0.74, eccentricity=0.9, background=0.78, kron=0.5, snr=0.833333, flag=0.95, overall=0.763833).items():
        assert r[f"{k}_score"] == pytest.approx(v, abs=1e-5)
    starless = df.select(*[F.lit(1.0 if c == "bg_uniformity" else 0.0).alias(c) for c in cols])
    s = Q.quality_scores(starless).first()
    assert [s[f"{p}_score"] for p in ("fwhm", "eccentricity", "kron", "snr", "flag")] == [0.7, 1.5, 1, 0, 1]
    assert Q.quality_scores(starless, clamp=True).first()["eccentricity_score"] == 1
    assert Q.quality_scores(df, X.QualityWeights(0, 0, 0, 0, 0, 0)).first()["overall_score"] == 0
    assert Q.frame_metrics(df.withColumn("path", F.lit("/x/a.fits")), "path").first()["frame_id"] == "a.fits"


def test_background_constructors(spark):
    plain = one(spark, Q.background(F.lit(5.0), F.lit(1.0)))
    assert (plain["min"], plain["max"], plain["uniformity"]) == (0, 0, 1)
    assert one(spark, Q.background(F.lit(5.0), F.lit(1.0), F.lit(8.0), F.lit(10.0)))["uniformity"] == pytest.approx(0.8)


def test_profile_counts_files_once(spark):
    """Four files, three with a filter, one of them with it twice: 75, and 66.67 to 33.33 of the three."""
    from nightglass.operators import profile as R

    long = spark.createDataFrame([("1", "filter.name", "Ha"), ("1", "filter.name", "Ha"), ("2", "filter.name", "Ha"), ("3", "filter.name", "OIII"), ("4", "exposure.ra", "1")], "file string, element string, value string")
    assert {r[0]: r[2] for r in R.element_presence(long, 4).collect()} == {"filter.name": "75.000000", "exposure.ra": "25.000000"}
    assert {(r[0], r[1]): r[3] for r in R.value_distribution(long).collect()} == {("filter.name", "Ha"): "66.666667", ("filter.name", "OIII"): "33.333333"}


def test_flatten_arrays_and_maps(spark):
    from nightglass.operators import profile as R

    df = spark.createDataFrame([("f", [("a", " x "), ("a", "")], {"k": 1.5, "n": float("nan")}, True, [], b"", 0.1)], "path string, items array<struct<id:string,note:string>>, m map<string,double>, ok boolean, none array<int>, icc binary, f float")
    got = {(r["element"], r["value"], r["first"]) for r in R.flatten(df, "path").collect()}
    assert got == {("items[].id", "a", True), ("items[].note", "x", True), ("m.k", "1.5", True), ("ok", "true", True), ("icc", "<binary>", True), ("f", "0.10000000149011612", True)}


def test_plans(spark):
    """Columns and filters reach the scan, and profiles shuffle aggregates only."""
    from nightglass.operators import profile as R

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ST.with_shapes(li.select(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), F.lit(1.0).alias("flux"), F.lit(1.0).alias("flux_auto"), F.lit(1.0).alias("fluxerr_auto"))).filter("a > 10").select("fwhm")
    text = plan._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text and "GreaterThan(l_quantity,10.0)" in text
    c = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    text = R.element_presence(R.flatten(c, "c_custkey"), 10)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_count" in text
    top = ST.brightest(li, "l_suppkey", 5, ["l_orderkey"], "l_extendedprice")._jdf.queryExecution().executedPlan().toString()
    assert top.count("WindowGroupLimit") == 2
