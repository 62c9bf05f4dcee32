"""Reports over image collections: frame quality, metadata statistics, dumps, and their command line."""

from __future__ import annotations

import argparse
import re
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nightglass.functions import scalars as X
from nightglass.operators import detect as D
from nightglass.operators import metadata as M
from nightglass.operators import pixels as P
from nightglass.operators import profile as R
from nightglass.operators import quality as Q
from nightglass.operators import stars as ST
from nightglass.sources import scan

FIRST_FAILURES = 10
ELEMENTS, VALUES = "metadata_elements", "metadata_values"


class ReportError(RuntimeError):
    """A run that can't be reported on; the message says why."""


def score_frames(images: DataFrame, weights: X.QualityWeights = X.QualityWeights(), how: D.Detection = D.Detection()) -> DataFrame:
    """Images to (path, frame_id, star_stats, background, scores): detection, statistics of each frame, scores.

    Frames are told apart by path; files of one name in two folders are two
    frames.  A frame's stars stay in its row, so nothing is shuffled.
    """
    return frame_scores(D.detect_stars(images, how), weights)


def frame_scores(found: DataFrame, weights: X.QualityWeights = X.QualityWeights()) -> DataFrame:
    """(path, frame_id, star_stats, background, scores) of rows of (path, background, stars) that have a background."""
    frames = found.filter("background IS NOT NULL").select("path", *[F.col(f"background.{c}").cast("double").alias(f"bg_{c}") for c in ("median", "rms", "min", "max", "uniformity")], *[v.alias(k) for k, v in ST.array_stats("stars").items()])
    return Q.frame_metrics(frames, "path", weights, keep=["path"])


def frame_report(spark: SparkSession, path: str, max_stars: int | None = None, recursive: bool = False) -> DataFrame:
    """One row for each file: metadata figures, pixel statistics, whether pixels are finite, the frame's scores, and the seconds of its stages.

    Each file is read and decoded once, and nothing is shuffled.
    """
    frames = M.metadata(D.read_frames(spark, path, D.Detection(max_stars=max_stars), recursive))
    headed, scale = F.col("status") == "ok", X.plate_scale("detector.pixel_size", "equipment.focal_length")
    stats = ST.array_stats("stars")
    columns = {f"bg_{c}": F.col(f"background.{c}").cast("double") for c in ("median", "rms", "min", "max", "uniformity")} | stats
    figures = {"object_name": "exposure.object_name", "exposure_time": "exposure.exposure_time", "filter_name": "filter.name"}
    named = frames.select(
        "path", "width", "height", F.coalesce("image_status", "status").alias("status"), F.coalesce("image_error", "error").alias("error"), "pixel_stats", "nonfinite", *[F.when(headed, F.col(c)).alias(k) for k, c in figures.items()],
        F.when(headed, scale).alias("plate_scale"), F.when(headed, X.field_of_view("detector.width", "detector.height", scale)).alias("field_of_view"), "header_seconds", "load_seconds", "detect_seconds", F.col("background").isNotNull().alias("searched"), *[v.alias(k) for k, v in columns.items()],
    )
    kept = ["path", "width", "height", "status", "error", "pixel_stats", "nonfinite", *figures, "plate_scale", "field_of_view", "header_seconds", "load_seconds", "detect_seconds", "searched"]
    scored = Q.frame_metrics(named, "path", keep=kept)
    return scored.select("frame_id", *(c for c in kept if c != "searched"), *[F.when(F.col("searched"), F.col(c)).alias(c) for c in ("star_stats", "background", "scores")])


@dataclass
class Summary:
    discovered: int
    processed: int
    failed: int
    skipped: int
    failures: list[Row]

    def text(self) -> str:
        lines = [f"Processed {self.processed} of {self.discovered} files"]
        if self.skipped:
            lines.append(f"Skipped {self.skipped} files without permission")
        if self.failed:
            lines.append(f"Failed: {self.failed}")
            lines += [f"  {r['path']}: {r['error']}" for r in self.failures]
            if self.failed > len(self.failures):
                lines.append(f"  ... and {self.failed - len(self.failures)} more")
        return "\n".join(lines)


def metadata_reports(headers: DataFrame, processed: int) -> tuple[DataFrame, DataFrame]:
    """(metadata_element, percent_of_files) and (metadata_element, value, percent_of_element) of scanned headers."""
    long = R.flatten(M.metadata(headers.filter("status = 'ok'")), "path", list(M.S.METADATA))
    return R.element_presence(long, processed).drop("files"), R.value_distribution(long).drop("files")


def metadata_statistics(spark: SparkSession, path: str, out: str) -> Summary:
    """Scan a directory, write both CSV reports under ``out``, and count what became of its files.

    Raises if there are no files, or if all failed; if all were skipped the
    reports are empty.
    """
    headers = scan.read_headers(spark, path).cache()
    try:
        counts = {r["status"]: r["files"] for r in R.run_summary(headers).collect()}  # three rows at most
        found = Summary(sum(counts.values()), counts.get("ok", 0), counts.get("failed", 0), counts.get("skipped", 0), [])
        if not found.discovered:
            raise ReportError(f"no image files under {path}")
        if found.failed:
            found.failures = R.first_failures(headers.filter("status = 'failed'"), n=FIRST_FAILURES).collect()
            if not found.processed and not found.skipped:
                raise ReportError(f"all files failed\n{found.text()}")
        elements, values = metadata_reports(headers, found.processed)
        R.write_csv(elements, f"{out}/{ELEMENTS}", ["metadata_element"])
        R.write_csv(values, f"{out}/{VALUES}", ["metadata_element", "value"])
        return found
    finally:
        headers.unpersist()


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


# The metadata report's sections, in order; of each its struct if it is left out without one, and its lines: text, columns.
REPORT = (
    ("Equipment Information", None, (("Telescope: {}", "equipment.telescope_name"), ("Focal Length: {} mm", "equipment.focal_length"), ("Aperture: {} mm", "equipment.aperture"), ("Focal Ratio: f/{:.1}", "equipment.focal_ratio"))),
    ("Detector Information", None, (("Camera: {}", "detector.camera_name"), ("Image Dimensions: {}x{} pixels", "detector.width", "detector.height"), ("Binning: {}x{}", "binning.x", "binning.y"), ("Sensor Temperature: {:.1} °C", "detector.temperature"))),
    ("Exposure Information", None, (("Object: {}", "exposure.object_name"), ("Exposure Time: {:.2} seconds", "exposure.exposure_time"), ("Frame Type: {}", "exposure.frame_type"), ("Observation Date: {} UTC", "exposure.date_obs"), ("Coordinates: RA={:.6}°, Dec={:.6}°", "exposure.ra", "exposure.dec"))),
    ("Filter Information", None, (("Filter: {}", "filter.name"),)),
    ("Mount Information", "mount", (("Pier Side: {}", "mount.pier_side"), ("Location: Lat={:.6}°, Long={:.6}°", "mount.latitude", "mount.longitude"), ("Guide RMS: {:.2} pixels", "mount.guide_rms"))),
    ("Environment Information", "environment", (("Ambient Temperature: {:.1} °C", "environment.ambient_temp"), ("Humidity: {:.1}%", "environment.humidity"), ("Sky Quality: {:.2} mag/arcsec²", "environment.sqm"), ("Software Version: {}", "environment.software_version"))),
    ("Calculated Values", None, (("Plate Scale: {:.3} arcsec/pixel", "scale"), ("Field of View: {:.2}' × {:.2}' (arcmin)", "view.width", "view.height"))),
    ("XISF Information", "xisf", (("Format Version: {}", "xisf.version"), ("Creator: {}", "xisf.creator"), ("Creation Time: {} UTC", "xisf.creation_time"), ("Block Alignment: {} bytes", "xisf.block_alignment"))),
    ("Color Management", "color_management", (("Color Space: {}", "color_management.color_space"), ("ICC Profile: {}", "icc"), ("Display Function: {}", "color_management.display_function.function_type"), ("Display Parameters: {}", "display"))),
)
_HOLE = re.compile(r"\{(?::\.([0-9]))?\}")


def _shown(c: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.regexp_replace(c.cast("string"), r"\.0$", "") if kind in ("float", "double") else c.cast("string")


def _filled(records: DataFrame, text: str, names: tuple[str, ...]) -> Column:
    """The text with its holes filled; null if one of the columns is."""
    parts: list[Column] = []
    for k, piece in enumerate(_HOLE.split(text)):  # plain texts and digits in turn
        if k % 2 == 0:
            parts.append(F.lit(piece))
            continue
        c = F.col(names[k // 2])
        parts.append(F.format_string(f"%.{piece}f", c.cast("double")) if piece else _shown(c, records.select(c).dtypes[0][1]))
        parts[-1] = F.when(c.isNotNull(), parts[-1])
    return F.concat(*parts)


def metadata_report(records: DataFrame) -> DataFrame:
    """(path, status and error where they are there, report) of rows of metadata: sections, units and digits as fixed; nulls and a binning of 1 are left out."""
    scale = X.plate_scale("detector.pixel_size", "equipment.focal_length")
    binned, d = (F.col("detector.binning_x") > 1) | (F.col("detector.binning_y") > 1), F.col("color_management.display_function.parameters")
    pairs = F.transform(F.array_sort(F.map_entries(d)), lambda e: F.concat(e["key"], F.lit("="), _shown(e["value"], "double")))
    kind = F.upper("format")
    df = records.withColumns(
        {
            "scale": scale, "view": X.field_of_view("detector.width", "detector.height", scale), "icc": F.when(F.col("color_management.icc_profile").isNotNull(), F.lit("present")), "display": F.when(F.size(d) > 0, F.array_join(pairs, ", ")),
            "binning": F.when(binned, F.struct(F.col("detector.binning_x").alias("x"), F.col("detector.binning_y").alias("y"))),
        }
    )
    lines = [F.array(F.concat(kind, F.lit(" Metadata for: "), F.col("path")))]
    for title, gate, rows in REPORT:
        made = F.array_compact(F.array(F.lit(f"\n=== {title} ==="), *[_filled(df, text, names) for text, *names in rows]))
        lines.append(made if gate is None else F.when(F.col(gate).isNotNull(), made).otherwise(F.array().cast("array<string>")))
    line = lambda c, name: F.when(c[name].isNotNull(), F.concat(F.lit(f"\n    {name.replace('_', ' ').title()}: "), c[name])).otherwise("")
    label = lambda a, i: F.when(a["id"] == "", F.concat(F.lit("attachment"), i.cast("string"))).otherwise(a["id"])
    attached = F.transform(
        "attachments",
        lambda a, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), label(a, i), F.lit(" | geometry="), a["geometry"], F.lit(" | sample="), a["sample_format"], F.lit(" | bits="), a["bits_per_sample"].cast("string"), *[line(a, n) for n in ("compression", "checksum_type", "checksum")]),
    )
    lines.append(F.when(F.size("attachments") > 0, F.concat(F.array(F.lit("\n=== XISF Attachments ===")), attached)).otherwise(F.array().cast("array<string>")))
    body = lambda c: F.when(c["value"].isNotNull(), F.concat(c["keyword"], F.lit(" = "), c["value"], F.coalesce(F.concat(F.lit(" / "), c["comment"]), F.lit("")))).otherwise(F.coalesce(F.concat(c["keyword"], F.lit(" / "), c["comment"]), c["raw_card"], c["keyword"]))
    cards = F.transform("cards", lambda c: F.concat(F.format_string("[HDU %d #%03d] ", c["hdu_index"], c["card_index"]), body(c)))
    lines.append(F.concat(F.array(F.when(F.col("format") == "fits", F.lit("\n=== Raw FITS Header Cards ===")).otherwise(F.lit("\n=== Raw XISF FITS Keywords ==="))), F.coalesce(cards, F.array().cast("array<string>"))))
    return df.select("path", *(c for c in ("status", "error") if c in df.columns), F.array_join(F.concat(*lines), "\n").alias("report"))


def dump_file(spark: SparkSession, path: str) -> str:
    """One file's metadata report."""
    rows = metadata_report(M.metadata(scan.read_headers(spark, path))).limit(1).collect()
    if not rows or rows[0]["status"] != "ok":
        raise ReportError(f"{path}: {rows[0]['error'] if rows else 'not an image file'}")
    return rows[0]["report"]


def main(argv: list[str] | None = None) -> int:
    """``stats [--count] PATH``, ``dump PATH`` or ``frames PATH``; 1 on an error."""
    parser = argparse.ArgumentParser(prog="nightglass")
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats", help="metadata elements and values of a directory, as CSV")
    stats.add_argument("--count", action="store_true", help="only count the files")
    stats.add_argument("--out", default=".")
    stats.add_argument("path")
    for name in ("dump", "frames"):
        commands.add_parser(name).add_argument("path")
    args = parser.parse_args(argv)
    from nightglass.session import session

    spark = session()
    try:
        if args.command == "stats" and args.count:
            print(scan.discover(spark, args.path).count())
        elif args.command == "stats":
            print(metadata_statistics(spark, args.path, args.out).text())
        elif args.command == "dump":
            print(dump_file(spark, args.path))
        else:
            for row in as_json(frame_report(spark, args.path).orderBy("path")).toLocalIterator():
                print(row["json"])
        return 0
    except ReportError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
