import csv
import ctypes
import glob
import os
import subprocess
import sys

import numpy as np
import pytest

from files import hdu, xisf
from nightglass.functions import scalars as X_
from nightglass.operators import detect as D
from nightglass.operators import headers as H
from nightglass.operators import metadata as M
from nightglass.operators import stars as ST
from nightglass.plans import reports
from nightglass.sources import fits, scan
from nightglass.sources import xisf as X

XML = '<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="2:2:1" sampleFormat="UInt16" location="attachment:512:8" colorSpace="Gray"></Image></xisf>'


def payload(values):
    return np.array(values, "<u2").tobytes()


def test_fits_cards():
    raw = hdu(True, np.zeros((2, 2), "f4"), [("OBJECT", "M42"), ("EXPTIME", 120.5), ("COMMENT", None, "some text"), ("DUPKEY", "one"), ("DUPKEY", "two", "it's")])
    raw += hdu(False, np.zeros((2, 2), "f4"), [("EXTKEY", 42)])
    cards, shape = fits.all_cards(raw)
    assert shape == [2, 2]
    assert [c["value"] for c in cards if c["keyword"] == "DUPKEY"] == ["one", "two"]
    assert next(c for c in cards if c["keyword"] == "COMMENT")["raw_card"].endswith("some text")
    ext = next(c for c in cards if c["keyword"] == "EXTKEY")
    assert (ext["hdu_index"], ext["value"]) == (1, "42")
    assert next(c for c in cards if c["value"] == "two")["comment"] == "it's"


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "f4", "f8"])
def test_fits_image(kind):
    px = np.arange(6).reshape(2, 3).astype(kind)
    got, w, h = fits.primary_image(hdu(True, px, [("BZERO", 32768), ("BSCALE", 2)] if kind == "i2" else []))
    assert (w, h) == (3, 2) and (got.reshape(2, 3) == (px.astype(float) * 2 + 32768 if kind == "i2" else px)).all()


@pytest.mark.parametrize("raw", [b"", b"junk" * 900, hdu(True), hdu(True, np.zeros((2, 2, 2), "f4")), hdu(True, np.zeros((99, 99), "f4"))[:4000]])
def test_fits_errors(raw):
    assert scan.decode_image("/x/a.fits", raw)["status"] == "failed"


def test_xisf_image():
    px, w, h = X.primary_image(xisf(XML, payload([0, 32768, 65535, 16384])))
    assert (w, h) == (2, 2) and np.allclose(px, [0, 0.5, 1, 0.25], atol=1e-3)


@pytest.mark.parametrize("change,word", [(('geometry="2:2:1" ', ""), "geometry"), ((' location="attachment:512:8"', ""), "location"), (("attachment:512:8", "attachment:512:6"), "truncated"), (("UInt16", "Float32"), "sampleFormat")])
def test_xisf_errors(change, word):
    row = scan.decode_image("/x/a.xisf", xisf(XML.replace(*change), payload([0, 1, 2, 3])))
    assert row["status"] == "failed" and word in row["error"]


@pytest.fixture
def collection(tmp_path):
    r = np.random.default_rng(1)
    px = r.normal(100, 5, (128, 160)).astype("f4")
    yy, xx = np.mgrid[0:128, 0:160]
    for x, y in ((30.3, 40.6), (100.2, 90.5), (60.7, 20.4)):
        px += (20000 / (2 * np.pi * 4) * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 8)).astype("f4")
    head = [("OBJECT", "M42"), ("EXPTIME", 300), ("FILTER", "Ha"), ("FOCALLEN", 1000), ("XPIXSZ", 5), ("DATE-OBS", "2023-05-15T02:00:00"), ("SITELONG", 0.0), ("SITELAT", 1.0), ("RA", 2)]
    (tmp_path / "a.fits").write_bytes(hdu(True, px, head))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "B.FIT").write_bytes(hdu(True, np.full((64, 64), 7, "i2"), [("FILTER", "Ha"), ("OBJECT", "M31")]))
    keywords = '<FITSKeyword name="FILTER" value="\'OIII\'" comment=""/><FITSKeyword name="DATE-OBS" value="\'2024-09-04T08:39:13.204\'"/><FITSKeyword name="RA" value="\'1 0 0\'"/>'
    properties = '<Property id="XISF:CreationTime" type="TimePoint">2024-09-06T10:31:17</Property><Property id="XISF:CreatorApplication" type="String">PixInsight 1.8.9-3</Property>'
    xml = XML.replace("</Image>", f"{keywords}</Image>{properties}").replace(":512:", ":2048:")
    (tmp_path / "c.xisf").write_bytes(xisf(xml, payload([0, 1, 2, 3]), offset=2048))
    (tmp_path / "broken.fts").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_scan_and_metadata(spark, collection):
    assert scan.discover(spark, str(collection)).count() == 4
    headers = scan.read_headers(spark, str(collection))
    assert {r["status"]: r["count"] for r in headers.groupBy("status").count().collect()} == {"ok": 3, "failed": 1}
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in M.metadata(headers.filter("status = 'ok'")).collect()}
    a, c = rows["a.fits"], rows["c.xisf"]
    assert (a["exposure"]["object_name"], a["exposure"]["exposure_time"], a["detector"]["width"], a["detector"]["binning_x"]) == ("M42", 300, 160, 1)
    assert a["exposure"]["ra"] == 30 and a["mount"]["longitude"] == 0 and a["wcs"] is None
    assert str(a["exposure"]["session_date"]) == "2023-05-14 12:00:00"
    assert (c["filter"]["name"], c["exposure"]["ra"], c["detector"]["width"], c["detector"]["binning_x"]) == ("OIII", 15, 2, 1)
    assert (c["xisf"]["creator"], str(c["xisf"]["creation_time"]), str(c["exposure"]["date_obs"])) == ("PixInsight 1.8.9-3", "2024-09-06 10:31:17", "2024-09-04 08:39:13.204000")
    assert c["color_management"]["color_space"] == "Gray" and len(c["attachments"]) == 1
    assert "OBJECT" in a["raw_headers"]
    text = {r["path"].rsplit("/", 1)[-1]: r["report"] for r in reports.metadata_report(M.metadata(headers)).collect()}
    assert "\n=== Exposure Information ===\nObject: M42\nExposure Time: 300.00 seconds\nObservation Date: 2023-05-15 02:00:00 UTC\n" in text["a.fits"] and "Focal Length: 1000 mm" in text["a.fits"] and "Plate Scale: 1.031 arcsec/pixel" in text["a.fits"]
    assert "=== Color Management ===\nColor Space: Gray\n" in text["c.xisf"] and "[0] image0 | geometry=2:2:1 | sample=UInt16 | bits=16" in text["c.xisf"] and "Creation Time: 2024-09-06 10:31:17 UTC" in text["c.xisf"]
    assert any('"object_name":"M42"' in r["json"] for r in reports.as_json(M.metadata(headers.filter("status = 'ok'"))).collect())


def test_command_line(spark, collection, tmp_path_factory, capsys):
    assert reports.main(["stats", "--count", str(collection)]) == 0
    assert capsys.readouterr().out.strip() == "4"
    assert reports.main(["dump", str(collection / "a.fits")]) == 0
    assert "M42" in capsys.readouterr().out
    assert reports.main(["dump", str(collection / "broken.fts")]) == 1
    assert reports.main(["stats", "--out", str(tmp_path_factory.mktemp("o")), str(collection)]) == 0
    assert "Processed 3 of 4" in capsys.readouterr().out


def test_headers_only(spark, collection):
    plain = {r["path"]: r for r in scan.read_headers(spark, str(collection)).collect()}
    lazy = {r["path"]: r for r in scan.read_headers_only(spark, str(collection)).collect()}
    assert plain == lazy


def test_stream(spark, collection, tmp_path_factory):
    out = D.detect_stars(scan.stream_images(spark, str(collection))).selectExpr("frame_id", "status", "size(stars) AS n")
    done = out.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path_factory.mktemp("c"))).trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert {r["frame_id"]: (r["status"], r["n"]) for r in spark.table("frames").collect()} == {"a.fits": ("ok", 3), "B.FIT": ("ok", 0), "c.xisf": ("ok", 0), "broken.fts": ("failed", 0)}


def test_card_table(spark, collection):
    cards = scan.card_table(scan.read_headers(spark, str(collection)), hdu=0)
    assert cards.filter("keyword = 'OBJECT'").count() == 2


def test_statistics(spark, collection, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    s = reports.metadata_statistics(spark, str(collection), str(out))
    assert (s.discovered, s.processed, s.failed, s.skipped) == (4, 3, 1, 0) and "broken.fts" in s.text()
    rows = list(csv.DictReader(open(glob.glob(f"{out}/{reports.ELEMENTS}/part*.csv")[0])))
    percent = {r["metadata_element"]: r["percent_of_files"] for r in rows}
    assert percent["filter.name"] == "100.000000" and percent["exposure.object_name"] == "66.666667"
    assert [r["metadata_element"] for r in rows] == sorted(percent) and not any("raw_headers" in k for k in percent)
    values = list(csv.DictReader(open(glob.glob(f"{out}/{reports.VALUES}/part*.csv")[0])))
    held = {(r["metadata_element"], r["value"]): r["percent_of_element"] for r in values}
    assert held["filter.name", "Ha"] == "66.666667" and held["filter.name", "OIII"] == "33.333333"
    assert not any(k == "exposure.date_obs" for k, _ in held)
    with pytest.raises(reports.ReportError):
        reports.metadata_statistics(spark, str(collection / "broken.fts"), str(out))


UNREADABLE = """
import sys
from pyspark.sql import SparkSession
from nightglass.plans import reports
from nightglass.sources import scan
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
path, out = sys.argv[1:]
s = reports.metadata_statistics(spark, path, out)
print("GOT", s.discovered, s.processed, s.failed, s.skipped)
print("GOT", sorted((r["path"].rsplit("/", 1)[1], r["status"]) for r in scan.read_images(spark, path).select("path", "status").collect()))
print("GOT", sorted((r["frame_id"], r["status"]) for r in reports.frame_report(spark, path).collect()))
s = reports.metadata_statistics(spark, path + "/../all", out)
print("GOT", s.discovered, s.processed, s.failed, s.skipped, s.text().splitlines()[1])
"""


def test_unreadable_file_and_folder(tmp_path):
    root = tmp_path / "c"
    (root / "shut").mkdir(parents=True)
    for name in ("a.fits", "closed.fits", "shut/b.fits"):
        (root / name).write_bytes(hdu(True, np.zeros((20, 20), "f4"), [("OBJECT", "M42")]))
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "closed.fits").write_bytes(hdu(True))
    (tmp_path / "all" / "closed.fits").chmod(0)
    (root / "closed.fits").chmod(0)
    (root / "shut").chmod(0)

    def drop():  # root reads all but without these capabilities: CAP_DAC_OVERRIDE, CAP_DAC_READ_SEARCH
        for cap in (1, 2):
            ctypes.CDLL(None).prctl(24, cap, 0, 0, 0)

    try:
        done = subprocess.run([sys.executable, "-c", UNREADABLE, str(root), str(tmp_path / "out")], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), preexec_fn=drop, capture_output=True, text=True, timeout=180)
    finally:
        (root / "shut").chmod(0o700)
    got = [line for line in done.stdout.splitlines() if line.startswith("GOT")]
    assert got == ["GOT 3 1 0 2", "GOT [('a.fits', 'ok'), ('closed.fits', 'skipped'), ('shut', 'skipped')]", "GOT [('a.fits', 'ok'), ('closed.fits', 'skipped')]", "GOT 1 0 0 1 Skipped 1 files without permission"], done.stderr[-3000:]


def test_frames_prints_every_row(spark, monkeypatch, capsys):
    monkeypatch.setattr(reports, "frame_report", lambda spark, path: spark.range(30).selectExpr("format_string('f%02d', 29 - id) AS path"))
    monkeypatch.setattr("nightglass.session.session", lambda: spark)
    assert reports.main(["frames", "x"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines == [f'{{"path":"f{k:02d}"}}' for k in range(30)]


def test_detection(spark, collection):
    scored = reports.score_frames(scan.read_images(spark, str(collection))).collect()
    by = {r["frame_id"]: r for r in scored}
    assert by["a.fits"]["star_stats"]["count"] == 3 and by["B.FIT"]["star_stats"]["count"] == 0
    assert by["a.fits"]["background"]["median"] == pytest.approx(100, abs=1)
    assert by["B.FIT"]["scores"]["eccentricity"] == 1.5
    report = reports.frame_report(spark, str(collection)).collect()
    assert {r["status"] for r in report} == {"ok", "failed"}


def starry(places, side=96):
    image = np.random.default_rng(len(places)).normal(100, 2, (side, side))
    yy, xx = np.mgrid[0:side, 0:side]
    for x, y, height in places:
        image += height * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 8)
    return image.astype("f4")


def test_frames_of_one_name(spark, tmp_path):
    """Camera software reuses names every night; each file is a frame of its own."""
    for night, places in (("n1", [(30, 40, 900)]), ("n2", [(20, 20, 900), (60, 30, 700), (40, 70, 500)])):
        (tmp_path / night).mkdir()
        (tmp_path / night / "L_001.fits").write_bytes(hdu(True, starry(places), [("OBJECT", night)]))
    scored = {r["path"].split("/")[-2]: r for r in reports.score_frames(scan.read_images(spark, str(tmp_path))).collect()}
    assert {k: (r["frame_id"], r["star_stats"]["count"]) for k, r in scored.items()} == {"n1": ("L_001.fits", 1), "n2": ("L_001.fits", 3)}
    report = {r["path"].split("/")[-2]: r for r in reports.frame_report(spark, str(tmp_path), recursive=True).collect()}
    for k, r in report.items():
        assert (r["object_name"], r["star_stats"], r["scores"], r["background"]) == (k, scored[k]["star_stats"], scored[k]["scores"], scored[k]["background"])
        assert min(r["header_seconds"], r["load_seconds"], r["detect_seconds"]) >= 0 and r["pixel_stats"]["max"] > 500


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_files_once(spark, collection):
    assert "content" not in plan_of(M.metadata(scan.read_headers(spark, str(collection))))
    plan = plan_of(reports.frame_report(spark, str(collection)))
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_statistics_over_arrays(spark, collection):
    found = D.detect_stars(scan.read_images(spark, str(collection))).filter("background IS NOT NULL")
    stars = D.star_table(found).withColumn("snr", X_.star_snr("flux", "flux_auto", "fluxerr_auto"))
    by_group = {r["path"]: r.asDict() for r in ST.with_starless(found, ST.star_stats(stars, "path"), "path").collect()}
    by_array = {r["path"]: r.asDict() for r in found.select("path", *[v.alias(k) for k, v in ST.array_stats("stars").items()]).collect()}
    assert by_group.keys() == by_array.keys()
    for path, row in by_group.items():
        assert {k: pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in row.items() if k != "path"} == {k: v for k, v in by_array[path].items() if k != "path"}


def test_cleaning_by_cells():
    """As when each star is compared with all brighter ones."""
    r, how = np.random.default_rng(7), D.Detection()
    stars = []
    for _ in range(600):
        a = float(r.choice([1.0, 2.0, 3.0, 12.0], p=[0.5, 0.3, 0.19, 0.01]))
        stars.append({"x": float(r.random() * 150), "y": float(r.random() * 150), "a": a, "peak": float(r.random() * 500), "flux": float(r.random() * 900), "npix": int(r.integers(5, 60)), "_form": (1 / a**2, 1 / a**2, 0.0)})
    kept = []
    for s in sorted(stars, key=lambda s: -s["flux"]):
        def under(t):
            r2 = ((s["x"] - t["x"]) ** 2 + (s["y"] - t["y"]) ** 2) / t["a"] ** 2
            return r2 < 9 and (t["peak"] - 10.0) / (1 + how.clean * r2) ** 2.5 > s["flux"] / s["npix"]

        if not any(map(under, kept)):
            kept.append(s)
    got = D._cleaned(stars, 10.0, how)
    assert 50 < len(got) < 590 and [id(s) for s in got] == [id(s) for s in kept]


def test_header_map_keeps_the_last(spark):
    cards = [("A", "1"), ("B", "x"), ("A", None), ("A", "2"), ("C", None), ("B", "y"), (None, "z")]
    df = spark.createDataFrame([([c for c in cards if c[0]],), ([],), (None,)], "cards array<struct<keyword:string,value:string>>")
    assert [r[0] for r in df.select(H.header_map("cards")).collect()] == [{"A": "2", "B": "y"}, {}, None]


def test_planted_stars():
    image = np.zeros((60, 60), np.float32) + 10
    yy, xx = np.mgrid[0:60, 0:60]
    for x, y, f in ((20.25, 30.5, 5000), (40.5, 15.75, 3000)):
        image += (f / (2 * np.pi * 4) * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 8)).astype(np.float32)
    got = D.detect(image, 10.0, 1.0)
    assert len(got) == 2
    for s, (x, y, f) in zip(got, ((40.5, 15.75, 3000), (20.25, 30.5, 5000))):
        assert abs(s["x"] - x) < 0.05 and abs(s["y"] - y) < 0.05 and s["flux_auto"] == pytest.approx(f, rel=0.05)
    assert D.detect(image[:2], 10.0, 1.0) == []
    sparse = np.zeros((20, 20), np.float32)
    sparse[10, 10] = 100
    assert D.detect(sparse, 0.0, 1.0) == []  # under five pixels


def test_discover_folders_of_parts(spark, tmp_path):
    """A table written in parts is one file, whatever folders lie in it; the root's own name doesn't count."""
    from nightglass.plans import synthetic
    from nightglass.sources import scan

    root = tmp_path / "all.parquet" / "a b"
    for i, name in enumerate(synthetic._TABLES):
        parts = ["part-0.parquet", "key=1/part-1.snappy.parquet", "_SUCCESS"] if i % 2 else [""]
        for part in parts:
            file = root / f"{name}.parquet" / part
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(b"12345")
    (root / "notes.txt").write_bytes(b"1")
    got = sorted(tuple(r) for r in synthetic.discover_files(spark, str(root)).collect())
    assert got == sorted((f"{t}.parquet", False) for t in synthetic._TABLES)
    lengths = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in scan.discover(spark, f"{root}/", extensions=("parquet",), folders=True).collect()}
    assert lengths == {f"{t}.parquet": 10 if i % 2 else 5 for i, t in enumerate(synthetic._TABLES)}
    inner = root / "deep" / "x.PARQUET"
    inner.parent.mkdir()
    inner.write_bytes(b"1")
    assert {tuple(r) for r in synthetic.discover_files(spark, str(root)).collect()} - set(got) == {("x.PARQUET", True)}


def test_planted_frames_are_dealt_to_all_cores(spark):
    from pyspark.sql import functions as F

    from nightglass.plans.synthetic import planted_images

    frames = planted_images(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(frames) == 4 and max(r["count"] for r in frames) < 0.6 * sum(r["count"] for r in frames)


def test_levels_of_a_group_are_labelled_together(monkeypatch):
    """As many labellings as blocks of levels, with the same stars whatever the blocks."""
    yy, xx = np.mgrid[0:64, 0:64]
    spot = lambda y, x, h: h * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 8)
    image = (np.random.default_rng(4).normal(100, 1, (64, 64)) + spot(30, 28, 900) + spot(30, 36, 700) + spot(37, 32, 500)).astype(np.float32)
    calls, labels = [], D._labels
    monkeypatch.setattr(D, "_labels", lambda mask: calls.append(mask.shape) or labels(mask))
    stars = D.detect(image, 100, 1)
    assert len(stars) == 3 and all(s["flag"] & 2 for s in stars) and len(calls) < 8
    monkeypatch.setattr(D, "LABELLED", 1)
    assert D.detect(image, 100, 1) == stars and len(calls) > 30
