"""The operators bound to the driver's tables, each beside its DuckDB SQL.

``Q`` maps a query's name to (function of (spark, sf_dir), SQL or None).
Doubles are rounded to six places on both sides, as sums differ in their last
bits with the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightglass.functions import scalars as X
from nightglass.functions import text as T
from nightglass.operators import headers as H
from nightglass.operators import metadata as M
from nightglass.operators import pixels as P
from nightglass.operators import profile as R
from nightglass.operators import quality as Q_
from nightglass.operators import stars as ST

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, tuple[Query, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        Q[f.__name__] = (f, sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(X.col(c), 6)


TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]
STARS = """SELECT l_suppkey AS frame_id, l_extendedprice AS flux, l_quantity AS a, l_quantity * (1 - l_discount) AS b, l_quantity / 5 AS kron_radius,
  l_extendedprice * (1 - l_discount) AS flux_auto, l_extendedprice * l_tax AS fluxerr_auto, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem"""
SHAPED = f"""SELECT *, CASE WHEN a = 0 THEN 0.0 ELSE sqrt(1 - b * b / (a * a)) END AS eccentricity, (a + b) / 2 AS fwhm, CASE WHEN a > 0 AND b > 0 THEN a / b ELSE 1.0 END AS elongation,
  CASE WHEN fluxerr_auto > 0 THEN flux_auto / fluxerr_auto WHEN flux > 0 THEN sqrt(flux) ELSE 0.0 END AS snr FROM ({STARS}) AS s0"""
MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC)"
STATS = ", ".join(
    [f"{MEDIAN.format(m)} AS {n}" for m, n in (("fwhm", "median_fwhm"), ("eccentricity", "median_eccentricity"), ("kron_radius", "median_kron_radius"), ("flux_auto", "median_flux"), ("snr", "median_snr"), ("elongation", "median_elongation"))]
    + [f"stddev_pop({m}) AS {n}" for m, n in (("fwhm", "fwhm_std_dev"), ("eccentricity", "eccentricity_std_dev"), ("kron_radius", "kron_radius_std_dev"), ("flux_auto", "flux_std_dev"), ("snr", "snr_std_dev"))]
    + ["avg(CASE WHEN flag <> 0 THEN 1.0 ELSE 0.0 END) AS flagged_fraction"]
)
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ST.STATS)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return li.select(
        F.col("l_suppkey").alias("frame_id"), price.alias("flux"), F.col("l_quantity").alias("a"), (F.col("l_quantity") * (1 - discount)).alias("b"), (F.col("l_quantity") / 5).alias("kron_radius"),
        (price * (1 - discount)).alias("flux_auto"), (price * F.col("l_tax")).alias("fluxerr_auto"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag"), *TIE,
    )


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.with_shapes(stars(spark, sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(eccentricity, 6) AS eccentricity, round(fwhm, 6) AS fwhm, round(elongation, 6) AS elongation FROM ({SHAPED}) AS s")
def star_shape(spark, sf_dir):
    return shaped(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(c) for c in ("eccentricity", "fwhm", "elongation")])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(snr, 6) AS snr FROM ({SHAPED}) AS s")
def star_snr(spark, sf_dir):
    return shaped(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r6("snr").alias("snr"))


@query(f"SELECT frame_id, round({MEDIAN.format('fwhm')}, 6) AS median_fwhm, round({MEDIAN.format('flux')}, 6) AS median_flux FROM ({SHAPED}) AS s GROUP BY frame_id")
def upper_median(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("frame_id").agg(r6(ST.upper_median("fwhm")).alias("median_fwhm"), r6(ST.upper_median("flux")).alias("median_flux"))


@query(f"SELECT frame_id, round(stddev_pop(fwhm), 6) AS fwhm_std_dev, round(stddev_pop(snr), 6) AS snr_std_dev FROM ({SHAPED}) AS s GROUP BY frame_id")
def stddev_pop(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("frame_id").agg(r6(F.stddev_pop("fwhm")).alias("fwhm_std_dev"), r6(F.stddev_pop("snr")).alias("snr_std_dev"))


@query(f"SELECT frame_id, round(avg(CASE WHEN flag <> 0 THEN 1.0 ELSE 0.0 END), 6) AS flagged_fraction FROM ({STARS}) AS s GROUP BY frame_id")
def flagged_fraction(spark, sf_dir):
    return stars(spark, sf_dir).groupBy("frame_id").agg(r6(ST.flagged_fraction()).alias("flagged_fraction"))


ALL_STATS = f"SELECT frame_id, count(*) AS \"count\", {STATS} FROM ({SHAPED}) AS s GROUP BY frame_id"
FRAMES = f"""SELECT s_suppkey AS frame_id, coalesce("count", 0) AS "count", {", ".join(f"coalesce({c}, 0) AS {c}" for c in ST.STATS)} FROM supplier LEFT JOIN ({ALL_STATS}) AS st ON st.frame_id = s_suppkey"""


def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"))
    return ST.with_starless(frames, ST.star_stats(shaped(spark, sf_dir), "frame_id"), "frame_id")


@query(f'SELECT frame_id, "count", {ROUNDED} FROM ({FRAMES}) AS f')
def star_stats(spark, sf_dir):
    return rounded(all_stats(spark, sf_dir), *ST.STATS)


@query(f"""SELECT frame_id, max(n) AS "count", {", ".join(f"round({x.split(' AS ')[0]}, 6) AS {x.split(' AS ')[1]}" for x in STATS.split(", "))} FROM (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n,
  row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, {", ".join(TIE)}) AS k FROM ({SHAPED}) AS s) AS t WHERE k <= 50 GROUP BY frame_id""")
def star_stats_topn(spark, sf_dir):
    return rounded(ST.star_stats(shaped(spark, sf_dir), "frame_id", top=50, order=TIE), *ST.STATS)


@query(f"SELECT frame_id, flux, {', '.join(TIE)} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, {', '.join(TIE)}) AS k FROM ({STARS}) AS s) AS t WHERE k <= 10")
def brightest_stars(spark, sf_dir):
    return ST.brightest(stars(spark, sf_dir), "frame_id", 10, TIE).select("frame_id", "flux", *TIE)


BACKGROUND = f"""SELECT l_suppkey AS frame_id, {MEDIAN.format('l_quantity')} AS bg_median, stddev_pop(l_quantity) AS bg_rms, min(l_quantity) AS bg_min, max(l_quantity) AS bg_max,
  CASE WHEN max(l_quantity) > 0 THEN 1 - (max(l_quantity) - min(l_quantity)) / max(l_quantity) ELSE 1.0 END AS bg_uniformity FROM lineitem GROUP BY l_suppkey"""
BG = ("bg_median", "bg_rms", "bg_min", "bg_max", "bg_uniformity")


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id"), "l_quantity")
    return Q_.background_stats(cells, "frame_id", "l_quantity")


@query(f"SELECT frame_id, {', '.join(f'round({c}, 6) AS {c}' for c in BG)} FROM ({BACKGROUND}) AS b")
def background_stats(spark, sf_dir):
    return rounded(backgrounds(spark, sf_dir), *BG)


MEASURED = f"SELECT f.*, {', '.join(f'coalesce(b.{c}, {1 if c == BG[-1] else 0}) AS {c}' for c in BG)} FROM ({FRAMES}) AS f LEFT JOIN ({BACKGROUND}) AS b ON b.frame_id = f.frame_id"


def _one_less(x: str) -> str:
    return f"greatest(0.0, 1 - least(1.0, {x}))"


SCORE_SQL = {
    "fwhm": f"0.7 * {_one_less('median_fwhm / 10')} + 0.3 * (CASE WHEN median_fwhm > 0 THEN {_one_less('fwhm_std_dev / median_fwhm')} ELSE 0.0 END)",
    "eccentricity": f"{_one_less('(median_elongation - 1) / 2')}",
    "background": f"0.7 * bg_uniformity + 0.3 * {_one_less('bg_rms / 10')}",
    "kron": _one_less("median_kron_radius / 10"),
    "snr": "greatest(0.0, 1 - 10 / (10 + median_snr))",
    "flag": "1 - flagged_fraction",
}
NAMES = [f"{p}_score" for p in X.PARTS] + ["overall_score"]


def scored_sql(w: X.QualityWeights, measured: str = MEASURED) -> str:
    total = sum(getattr(w, p) for p in X.PARTS)
    parts = f"SELECT *, {', '.join(f'{v} AS {k}_score' for k, v in SCORE_SQL.items())} FROM ({measured}) AS m"
    overall = " + ".join(f"{p}_score * {getattr(w, p)!r}" for p in X.PARTS)
    return f"SELECT *, ({overall}) / {total!r} AS overall_score FROM ({parts}) AS p"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = all_stats(spark, sf_dir).join(backgrounds(spark, sf_dir), "frame_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(1.0 if c == BG[-1] else 0.0)) for c in BG})


DEFAULT, OTHER = X.QualityWeights(), X.QualityWeights(1.0, 0.0, 0.5, 0.5, 0.5, 0.5)


@query(f"SELECT frame_id, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES[:-1])} FROM ({scored_sql(DEFAULT)}) AS q")
def quality_scores(spark, sf_dir):
    return rounded(Q_.quality_scores(measured(spark, sf_dir)), *NAMES).select("frame_id", *NAMES[:-1])


@query(f"SELECT frame_id, round(overall_score, 6) AS overall_score FROM ({scored_sql(DEFAULT)}) AS q")
def overall_score(spark, sf_dir):
    return Q_.quality_scores(measured(spark, sf_dir)).select("frame_id", r6("overall_score").alias("overall_score"))


def _metrics(spark: SparkSession, sf_dir: str, weights: X.QualityWeights) -> DataFrame:
    frames = measured(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.concat(F.lit("/data/"), "s_name").alias("path")), "frame_id")
    made = Q_.frame_metrics(frames, "path", weights)
    return made.select("frame_id", F.col("star_stats.count").alias("count"), r6("star_stats.median_fwhm").alias("median_fwhm"), r6("background.uniformity").alias("uniformity"), *[r6(f"scores.{p}").alias(f"{p}_score") for p in (*X.PARTS, "overall")])


def _metrics_sql(w: X.QualityWeights) -> str:
    return f"""SELECT s_name AS frame_id, "count", round(median_fwhm, 6) AS median_fwhm, round(bg_uniformity, 6) AS uniformity, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)}
  FROM ({scored_sql(w)}) AS q JOIN supplier ON s_suppkey = q.frame_id"""


@query(_metrics_sql(DEFAULT))
def frame_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, DEFAULT)


@query(_metrics_sql(OTHER))
def frame_metrics_weighted(spark, sf_dir):
    return _metrics(spark, sf_dir, OTHER)


@query(f"SELECT frame_id, round(overall_score, 6) AS overall_score FROM ({scored_sql(DEFAULT)}) AS q ORDER BY round(overall_score, 6) DESC, frame_id LIMIT 10")
def frame_ranking(spark, sf_dir):
    scored = Q_.quality_scores(measured(spark, sf_dir)).select("frame_id", r6("overall_score").alias("overall_score"))
    return Q_.ranking(scored, 10)


@query(f"""WITH q AS (SELECT frame_id, overall_score AS x FROM ({scored_sql(DEFAULT)}) AS s0), m AS (SELECT quantile_cont(x, 0.5) AS c FROM q), d AS (SELECT quantile_cont(abs(x - c), 0.5) AS mad FROM q, m)
  SELECT frame_id, round(x, 6) AS overall_score FROM q, m, d WHERE abs(x - c) <= 2 * mad""")
def outlier_reject(spark, sf_dir):
    scored = Q_.quality_scores(measured(spark, sf_dir)).select("frame_id", "overall_score")
    return rounded(Q_.reject_outliers(scored, "overall_score", 2.0), "overall_score")


@query(f"""WITH q AS (SELECT frame_id, overall_score AS x FROM ({scored_sql(DEFAULT)}) AS s0), m AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM q)
  SELECT frame_id, round(coalesce(greatest(0.0, least(1.0, (x - lo) / nullif(hi - lo, 0))), 0), 6) AS score FROM q, m""")
def percentile_score(spark, sf_dir):
    scored = Q_.quality_scores(measured(spark, sf_dir)).select("frame_id", "overall_score")
    return rounded(Q_.percentile_score(scored, "overall_score"), "score").select("frame_id", "score")


# --- pixels: embeddings as images of 8 by 8


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))


FLAT = "SELECT vec_id AS frame, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


@query(f"""SELECT frame, i::INT AS i, round(CASE WHEN hi = lo THEN 0.0 ELSE (value - lo) / (hi - lo) END, 6) AS value
  FROM (SELECT *, min(value) OVER (PARTITION BY frame) AS lo, max(value) OVER (PARTITION BY frame) AS hi FROM ({FLAT}) AS f) AS g""")
def normalize_pixels(spark, sf_dir):
    made = images(spark, sf_dir).select("frame", F.posexplode(P.normalize_pixels("pixels")).alias("i", "value"))
    return made.select("frame", "i", r6("value").alias("value"))


@query(f"SELECT frame, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value) / count(*), 6) AS mean FROM ({FLAT}) AS f GROUP BY frame")
def pixel_stats(spark, sf_dir):
    made = images(spark, sf_dir).select("frame", P.pixel_stats("pixels").alias("s"))
    return made.select("frame", *[r6(f"s.{c}").alias(c) for c in ("min", "max", "mean")])


@query("SELECT vec_id AS frame, vec_id % 7 IN (1, 2, 3) AND len(embedding) > 5 AS nonfinite FROM embeddings")
def nonfinite_gate(spark, sf_dir):
    """A NaN, an infinity or its negative in the sixth pixel of some frames."""
    odd = F.element_at(F.array(*[F.lit(float(x)) for x in ("nan", "inf", "-inf")]), (F.col("frame") % 7).cast("int"))
    some = images(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda p, i: F.when((F.col("frame") % 7).between(1, 3) & (i == 5), odd).otherwise(p.cast("double"))))
    return some.select("frame", P.has_nonfinite("pixels").alias("nonfinite"))


@query(f"""SELECT frame, (i // 8 // 4)::INT AS cell_y, (i % 8 // 4)::INT AS cell_x, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS rms, round(min(value), 6) AS min, round(max(value), 6) AS max
  FROM ({FLAT}) AS f GROUP BY ALL""")
def background_cells(spark, sf_dir):
    return rounded(P.background_cells(images(spark, sf_dir), "frame", "pixels", 8, 4), "mean", "rms", "min", "max")


# --- headers: events as cards


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a user; keywords by the event's type, values with and without a fraction, some missing."""
    ev = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 0, F.lit("")).when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return ev.select(F.col("user_id").alias("file"), F.col("event_id").alias("card_index"), F.col("event_type").alias("keyword"), value.alias("value"))


CARDS = """SELECT user_id AS file, event_id AS card_index, event_type AS keyword,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') ELSE 'v' || event_id::VARCHAR END AS value FROM events"""
LAST = f"SELECT file, keyword, arg_max(value, card_index) AS value FROM ({CARDS}) AS c WHERE value IS NOT NULL GROUP BY file, keyword"


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.header_maps(cards(spark, sf_dir), "file", ["card_index"])


@query(LAST)
def header_last_wins(spark, sf_dir):
    return H.last_values(cards(spark, sf_dir), "file", ["card_index"])


def _pivot(*exprs: str) -> str:
    return f"SELECT file, {', '.join(exprs)} FROM ({LAST}) AS l GROUP BY file"


def _last(keyword: str) -> str:
    return f"max(value) FILTER (WHERE lower(keyword) = '{keyword.lower()}')"


def _int(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[+-]?[0-9]+') THEN try_cast({x} AS INT) END"


def _float(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({x} AS FLOAT)::DOUBLE END"


@query(_pivot(f"{_last('click')} AS value"))
def header_ci_lookup(spark, sf_dir):
    return maps(spark, sf_dir).select("file", H.lookup("header", "CLICK").alias("value"))


@query(_pivot(f"coalesce(nullif({_last('click')}, ''), nullif({_last('view')}, '')) AS value"))
def alias_string(spark, sf_dir):
    return maps(spark, sf_dir).select("file", H.first_string("header", ["click", "view"]).alias("value"))


@query(_pivot(f"coalesce({_float(_last('click'))}, {_float(_last('view'))}, {_float(_last('purchase'))}) AS value"))
def alias_float(spark, sf_dir):
    return maps(spark, sf_dir).select("file", H.first_float("header", ["click", "view", "purchase"], "double").alias("value"))


@query(_pivot(f"coalesce({_int(_last('view'))}, {_int(_last('click'))}) AS value"))
def alias_int(spark, sf_dir):
    return maps(spark, sf_dir).select("file", H.first_integer("header", ["view", "click"]).alias("value"))


@query(f"SELECT c.file, d.value FROM (SELECT DISTINCT file FROM ({CARDS}) AS a) AS c LEFT JOIN (SELECT file, arg_max(value, card_index) AS value FROM ({CARDS}) AS b WHERE keyword IN ('click', 'view') AND value IS NOT NULL GROUP BY file) AS d ON d.file = c.file")
def xisf_dispatch(spark, sf_dir):
    """The last card of two keywords, in the document's order, of each file's cards as an array."""
    some = F.filter(F.array_sort(F.collect_list(F.struct("card_index", "keyword", "value"))), lambda c: c["value"].isNotNull())
    return cards(spark, sf_dir).groupBy("file").agg(some.alias("cards")).select("file", H.last_of("cards", ["click", "view"]).alias("value"))


# part as headers of files: a keyword a column
PART = """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CASE WHEN p_size % 4 = 0 THEN 'reducer ' || p_brand ELSE p_brand END AS instrume FROM part"""


def part_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), lambda c: F.col(c).cast("string")
    entries = {
        "TELESCOP": s("p_name"), "FOCALLEN": s("p_size"), "APERTURE": F.when(F.col("p_size") % 5 == 0, F.lit("0")).otherwise(F.lit("80")), "INSTRUME": F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("reducer "), "p_brand")).otherwise(F.col("p_brand")),
        "NAXIS1": s("p_partkey"), "XBINNING": F.when(F.col("p_size") % 2 == 0, F.lit("2")), "FOCUSPOS": s("p_size"), "OBJECT": s("p_type"), "EXPTIME": s("p_size"), "RA": s("p_size"), "DEC": s("p_size"),
        "PIERSIDE": F.when(F.col("p_size") % 3 == 0, F.lit("West")), "MFLIP": F.when(F.col("p_size") % 3 == 1, F.lit("1")), "NINA-VERSION": F.when(F.col("p_size") % 7 == 0, s("p_size")), "EKOS-VERSION": F.when(F.col("p_size") % 7 == 1, s("p_size")), "SWCREATE": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "SQM": F.when(F.col("p_size") % 7 == 2, F.lit("21")),
        "FILTER": s("p_brand"), "FILTERID": F.when(F.col("p_size") % 3 == 0, F.lit("")), "FLTPOS": F.when(F.col("p_size") % 5 != 1, s("p_size")), "WAVELEN": F.when(F.col("p_size") % 2 == 0, F.concat(s("p_size"), F.lit(".5"))),
        "CTYPE1": F.lit("RA---TAN"), "CRPIX1": F.when(F.col("p_size") % 4 == 0, s("p_size")), "CRVAL2": F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("-"), s("p_size"), F.lit("e-1"))), "CD1_1": F.lit("0.25"), "crval1": F.lit("7"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return p.select("p_partkey", F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("header"))


@query(f"""SELECT p_partkey, p_name AS telescope_name, p_size::DOUBLE AS focal_length, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 80.0 END::DOUBLE AS aperture,
  round(CASE WHEN p_size % 5 <> 0 THEN p_size / 80.0 END, 6)::DOUBLE AS focal_ratio, CASE WHEN contains(instrume, 'reducer') OR contains(instrume, 'flattener') THEN instrume END AS reducer_flattener, p_size::INT AS focuser_position FROM ({PART}) AS p""")
def meta_equipment(spark, sf_dir):
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "equipment").alias("e"))
    return made.select("p_partkey", "e.telescope_name", F.col("e.focal_length").cast("double").alias("focal_length"), F.col("e.aperture").cast("double").alias("aperture"), r6(F.col("e.focal_ratio").cast("double")).alias("focal_ratio"), "e.reducer_flattener", "e.focuser_position")


@query(f"SELECT p_partkey, instrume AS camera_name, p_partkey::BIGINT AS width, 0::BIGINT AS height, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS binning_x, 1::BIGINT AS binning_y FROM ({PART}) AS p")
def meta_detector(spark, sf_dir):
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "detector").alias("d"))
    return made.select("p_partkey", "d.camera_name", "d.width", "d.height", "d.binning_x", "d.binning_y")


@query(f"SELECT p_partkey, p_type AS object_name, p_size * 15.0::DOUBLE AS ra, p_size::DOUBLE AS dec, p_size::DOUBLE AS exposure_time FROM ({PART}) AS p")
def meta_exposure(spark, sf_dir):
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "exposure").alias("e"))
    return made.select("p_partkey", "e.object_name", "e.ra", "e.dec", F.col("e.exposure_time").cast("double").alias("exposure_time"))


@query(f"SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 5 <> 1 THEN p_size END::BIGINT AS position, CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 END::DOUBLE AS wavelength FROM ({PART}) AS p")
def meta_filter(spark, sf_dir):
    """An empty alias doesn't count, so the next one gives the position."""
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "filter").alias("f"))
    return made.select("p_partkey", "f.name", "f.position", F.col("f.wavelength").cast("double").alias("wavelength"))


@query(f"""SELECT p_partkey, p_size % 4 < 2 AS has_wcs, CASE WHEN p_size % 4 < 2 THEN 'RA---TAN' END AS ctype1, CASE WHEN p_size % 4 = 0 THEN p_size END::DOUBLE AS crpix1, CASE WHEN p_size % 4 = 1 THEN round(-p_size / 10.0, 6) END::DOUBLE AS crval2,
  CASE WHEN p_size % 4 < 2 THEN 0.25 END::DOUBLE AS cd1_1, CASE WHEN p_size % 4 < 2 THEN 7 END::DOUBLE AS crval1 FROM ({PART}) AS p""")
def meta_wcs(spark, sf_dir):
    """The gate is in exact case, the lookup isn't."""
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "wcs").alias("w"))
    return made.select("p_partkey", F.col("w").isNotNull().alias("has_wcs"), "w.ctype1", "w.crpix1", r6("w.crval2").alias("crval2"), "w.cd1_1", "w.crval1")


@query(f"SELECT p_partkey, p_size % 3 <> 2 AS has_mount, CASE WHEN p_size % 3 = 0 THEN 'West' END AS pier_side, CASE WHEN p_size % 3 = 1 THEN true END AS meridian_flip FROM ({PART}) AS p")
def gated_struct(spark, sf_dir):
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "mount").alias("m"))
    return made.select("p_partkey", F.col("m").isNotNull().alias("has_mount"), "m.pier_side", "m.meridian_flip")


@query(f"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'NINA ' || p_size::VARCHAR WHEN p_size % 7 = 1 THEN 'EKOS ' || p_size::VARCHAR WHEN p_size % 2 = 0 AND p_size % 7 = 2 THEN p_brand END AS software_version FROM ({PART}) AS p""")
def software_version(spark, sf_dir):
    made = part_headers(spark, sf_dir).select("p_partkey", M.fits_group("header", "environment").alias("e"))
    return made.select("p_partkey", "e.software_version")


# --- XML text: pages


@query("""SELECT page_id, i - 1 AS n, l[i] AS tag FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">') AS l FROM pages) AS p) AS q""")
def tag_scan(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.xml_tags("html", '<a href="[^"]*">')).alias("n", "tag"))
    return tags.select("page_id", F.col("n").cast("bigint").alias("n"), "tag")


@query("""SELECT page_id, CASE WHEN contains(html, 'lang="') THEN regexp_extract(html, 'lang="([^"]*)"', 1) END AS lang, CASE WHEN contains(html, 'charset="') THEN regexp_extract(html, 'charset="([^"]*)"', 1) END AS charset FROM pages""")
def xml_attr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.xml_attribute("html", "lang").alias("lang"), T.xml_attribute("html", "charset").alias("charset"))


PROPERTY = """SELECT page_id, '<Property id="PCL:Title" type="String"> ' || regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || ' </Property>' AS xml FROM pages"""


@query(f"SELECT page_id, trim(regexp_extract(xml, '(?s)id=\"PCL:Title\" type=\"[^>]*>(.*?)</Property>', 1), ' \t\n\r') AS title FROM ({PROPERTY}) AS p")
def xml_property(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<Property id="PCL:Title" type="String"> '), title, F.lit(" </Property>")).alias("xml"))
    return made.select("page_id", T.xml_property("xml", "PCL:Title").alias("title"))


@query("""SELECT page_id, (i - 1)::BIGINT AS n, coalesce(CASE WHEN contains(l[i], 'href="') THEN regexp_extract(l[i], 'href="([^"]*)"', 1) END, '') AS target, coalesce(CASE WHEN contains(l[i], 'id="') THEN regexp_extract(l[i], 'id="([^"]*)"', 1) END, 'image' || (i - 1)::VARCHAR) AS id
  FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">') AS l FROM pages) AS p) AS q""")
def attachments(spark, sf_dir):
    # links stand in for <Image ...> tags
    xml = F.regexp_replace("html", '<a href="([^"]*)">', '<Image geometry="$1">')
    made = table(spark, sf_dir, "pages").select("page_id", F.posexplode(M.attachments(xml)).alias("n", "a"))
    return made.select("page_id", F.col("n").cast("bigint").alias("n"), F.col("a.geometry").alias("target"), "a.id")


@query("""SELECT page_id, k AS key, v AS value FROM (SELECT page_id, string_split(unnest(string_split(string_split(url, '?')[2], '&')), '=') AS kv, kv[1] AS k, CASE WHEN regexp_full_match(kv[2], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(kv[2] AS DOUBLE) END AS v
  FROM pages WHERE contains(url, '?')) AS p WHERE len(kv) = 2 AND v IS NOT NULL""")
def kv_params(spark, sf_dir):
    made = table(spark, sf_dir, "pages").filter(F.col("url").contains("?")).select("page_id", F.explode(T.key_values(F.get(F.split("url", r"\?"), F.lit(1)), "&")).alias("key", "value"))
    return made


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/]+)/*$', 1), ''), 'unknown') AS frame_id FROM pages")
def frame_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.frame_id("url").alias("frame_id"))


# --- scalars


@query("SELECT p_partkey, round((p_size::DOUBLE / p_retailprice) * 206.265, 6) AS plate_scale FROM part")
def plate_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(X.plate_scale("p_size", "p_retailprice")).alias("plate_scale"))


@query("SELECT p_partkey, p_size % 3 <> 0 AND p_size % 5 <> 0 AS possible FROM part")
def can_calculate_plate_scale(spark, sf_dir):
    unless = lambda n: F.when(F.col("p_size") % n != 0, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", X.can_calculate_plate_scale(unless(3), unless(5)).alias("possible"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS median, l_discount AS rms, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE least(l_quantity, l_tax) END AS min, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_quantity END AS max,
  round(CASE WHEN l_linenumber % 2 = 0 OR l_quantity <= 0 THEN 1.0 ELSE 1 - (l_quantity - least(l_quantity, l_tax)) / l_quantity END, 6) AS uniformity FROM lineitem""")
def background_constructors(spark, sf_dir):
    """A background of two figures, and one of a mesh."""
    quantity, tax = F.col("l_quantity"), F.least("l_quantity", "l_tax")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_linenumber") % 2 == 0, Q_.background(quantity, F.col("l_discount"))).otherwise(Q_.background(quantity, F.col("l_discount"), tax, quantity)).alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "b.median", "b.rms", "b.min", "b.max", r6("b.uniformity").alias("uniformity"))


@query("SELECT p_partkey, round(4096 * (p_size::DOUBLE / p_retailprice * 206.265) / 60, 6) AS width, round(2160 * (p_size::DOUBLE / p_retailprice * 206.265) / 60, 6) AS height FROM part")
def field_of_view(spark, sf_dir):
    fov = X.field_of_view(F.lit(4096), F.lit(2160), X.plate_scale("p_size", "p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", fov.alias("f")).select("p_partkey", r6("f.width").alias("width"), r6("f.height").alias("height"))


@query("""SELECT event_id, date_trunc('day', ts + to_hours(z::INT) - INTERVAL 12 HOUR) + INTERVAL 12 HOUR AS session_date FROM (SELECT event_id, ts, round(((user_id % 360) - 180) / 15.0) AS z FROM events) AS e""")
def session_date(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", "ts", ((F.col("user_id") % 360) - 180).alias("longitude"))
    return made.select("event_id", X.session_date("ts", "longitude").cast("timestamp_ntz").alias("session_date"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END * (o_custkey % 24 + (o_orderkey % 60) / 60.0 + (o_custkey % 60) / 3600.0), 6) AS degrees FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 11 = 0""")
def sexagesimal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sign = F.when(key % 2 == 1, F.lit("-")).otherwise(F.lit(""))
    text = F.when(key % 11 == 0, F.lit("12 30")).otherwise(F.concat(sign, (cust % 24).cast("string"), F.lit(" "), (key % 60).cast("string"), F.lit("  "), (cust % 60).cast("string")))
    return o.select("o_orderkey", r6(T.parse_sexagesimal(text)).alias("degrees"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_date(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.'000'")).when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return ev.select("event_id", T.parse_date_time(text).cast("timestamp_ntz").alias("parsed"))


@query("SELECT o_orderkey, o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/$$OTHER$$_' || o_orderpriority || '.fits' AS path FROM orders")
def path_tokens(spark, sf_dir):
    tokens = {"TARGETNAME": F.col("o_orderstatus"), "DATE": F.date_format("o_orderdate", "yyyy-MM-dd"), "FILTER": F.col("o_orderpriority")}
    return table(spark, sf_dir, "orders").select("o_orderkey", T.path_tokens("$$TARGETNAME$$/$$DATE$$/$$OTHER$$_$$FILTER$$.fits", tokens).alias("path"))


@query("SELECT page_id, regexp_extract(lower(url), '\\.([^./]+)$', 1) AS extension, regexp_extract(lower(url), '\\.([^./]+)$', 1) IN ('fits', 'fit', 'fts', 'xisf') AS supported FROM pages")
def extension_predicate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_extension("url").alias("extension"), T.is_supported("url").alias("supported"))


@query("SELECT p_partkey, p_size::BIGINT AS width, (p_partkey % 3)::BIGINT AS height FROM part WHERE p_size > 0 AND p_partkey % 3 > 0")
def geometry(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", T.geometry(F.concat_ws(":", F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"), F.lit("1"))).alias("g"))
    return made.filter("g IS NOT NULL").select("p_partkey", "g.width", "g.height")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'it''s ' || event_type ELSE event_type END AS value,
  CASE event_id % 3 WHEN 0 THEN 'HIERARCH ESO ' || event_type WHEN 1 THEN 'HIERARCH' ELSE upper(substr(event_type, 1, 8)) END AS keyword FROM events""")
def card_fields(spark, sf_dir):
    """Values with and without quotes; keywords of plain cards and of HIERARCH cards with and without a value."""
    ev, kind = table(spark, sf_dir, "events"), F.col("event_id") % 3
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 'it''s "), "event_type", F.lit("   ' "))).otherwise(F.concat(F.lit("  "), "event_type", F.lit("  ")))
    card = F.when(kind == 0, F.concat(F.lit("HIERARCH ESO "), "event_type", F.lit(" = 1"))).when(kind == 1, F.concat(F.lit("HIERARCH "), "event_type")).otherwise(F.rpad(F.upper("event_type"), 80, " "))
    return ev.select("event_id", T.clean_card_value(raw).alias("value"), T.card_keyword(card).alias("keyword"))


# --- profiles: customer and part as metadata records

LONG_SQL = """SELECT c_custkey AS file, 'name' AS element, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'exposure.ra', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 'exposure.segment', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise(F.lit("  "))
    return c.select(F.col("c_custkey").alias("path"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.struct(F.col("c_custkey").alias("ra"), segment.alias("segment")).alias("exposure"))


@query(LONG_SQL)
def flatten_long(spark, sf_dir):
    return R.flatten(records(spark, sf_dir), "path").drop("first")


@query(f"SELECT element AS metadata_element, count(DISTINCT file) AS files, printf('%.6f', count(DISTINCT file)::DOUBLE / (SELECT count(*) FROM customer) * 100) AS percent_of_files FROM ({LONG_SQL}) AS l GROUP BY element")
def element_presence(spark, sf_dir):
    files = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("all"))
    long = R.flatten(records(spark, sf_dir), "path").join(F.broadcast(files))  # one row
    return R.element_presence(long, "all")


VALUES = f"SELECT element AS metadata_element, value, count(DISTINCT file) AS files FROM ({LONG_SQL}) AS l WHERE element <> 'exposure.ra' GROUP BY element, value"


@query(f"SELECT metadata_element, value, files, printf('%.6f', files::DOUBLE / sum(files) OVER (PARTITION BY metadata_element) * 100) AS percent_of_element FROM ({VALUES}) AS v")
def value_distribution(spark, sf_dir):
    return R.value_distribution(R.flatten(records(spark, sf_dir), "path"))


@query(f"SELECT file, element, value FROM ({LONG_SQL}) AS l WHERE element <> 'exposure.ra'")
def value_tracking_filter(spark, sf_dir):
    return R.tracked(R.flatten(records(spark, sf_dir), "path")).drop("first")


@query("""SELECT * FROM (SELECT p_partkey AS file, 'v.price' AS element, CASE WHEN p_size % 5 > 1 THEN p_retailprice::VARCHAR END AS value FROM part UNION ALL SELECT p_partkey, 'v.text', CASE WHEN p_size % 2 = 0 THEN trim(p_name) END FROM part
  UNION ALL SELECT p_partkey, 'v.blob', '<binary>' FROM part UNION ALL SELECT p_partkey, 'v.flag', CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' END FROM part
  UNION ALL SELECT p_partkey, 'list[].k', p_brand FROM part UNION ALL SELECT p_partkey, 'map.' || p_brand, 'x' FROM part) AS l WHERE value IS NOT NULL""")
def sanitize(spark, sf_dir):
    """NaN, infinities and blank texts are left out, bytes are named, copies inside a list count once."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    price = F.when(size % 5 == 0, F.lit(float("nan"))).when(size % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("p_retailprice"))
    text = F.when(size % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit("\t"))).otherwise(F.lit("  \n"))
    flag = F.when(size % 3 == 0, F.lit(True)).when(size % 3 == 1, F.lit(False))
    made = p.select(F.col("p_partkey").alias("path"), F.struct(price.alias("price"), text.alias("text"), F.col("p_name").cast("binary").alias("blob"), flag.alias("flag")).alias("v"), F.array(*[F.struct(F.col("p_brand").alias("k"))] * 2).alias("list"), F.create_map("p_brand", F.lit("x")).alias("map"), F.lit("z").alias("xml"))
    return R.flatten(made, "path").drop("first")


@query("SELECT o_orderstatus AS status, count(*) AS files FROM orders GROUP BY o_orderstatus")
def run_summary(spark, sf_dir):
    return R.run_summary(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def failures_topk(spark, sf_dir):
    return R.first_failures(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "o_orderkey", "o_orderpriority")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: stars to frames to scores to a ranking."""
    return frame_metrics(spark, sf_dir)
