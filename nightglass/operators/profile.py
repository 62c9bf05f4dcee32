"""Profiles of metadata: which elements files have, and which values.

A nested record is flattened to (file, element, value) by expressions made from
its schema.  Copies are dropped inside the record's row, so that counting files
needs no distinct: each report is one aggregation with map-side combine, whose
shuffle holds a row for each element or value and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightglass.functions import scalars as X

# Elements that change from exposure to exposure, whose presence is counted and whose values are not.
VARYING = (
    "equipment.focuser_position", "equipment.focuser_temperature", "detector.temperature", "detector.temp_setpoint", "detector.cooler_power", "exposure.ra", "exposure.dec", "exposure.date_obs",
    "exposure.session_date", "exposure.frame_number", "exposure.dither_offset_x", "exposure.dither_offset_y", "mount.guide_rms", "mount.peak_ra_error", "mount.peak_dec_error", "environment.ambient_temp",
    "environment.humidity", "environment.dew_heater_power", "environment.voltage", "environment.current", "environment.sqm", "wcs.crpix1", "wcs.crpix2", "wcs.crval1", "wcs.crval2", "wcs.cd1_1", "wcs.cd1_2",
    "wcs.cd2_1", "wcs.cd2_2", "wcs.crota2", "wcs.airmass", "wcs.altitude", "wcs.azimuth", "xisf.creation_time", "attachments[].checksum",
)
BINARY = "<binary>"


def value_text(c: Column, kind: T.DataType) -> Column:
    """A scalar as the report writes it; null where it has no text: empty strings, NaN and infinities."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(X.finite(d), d.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.lit(BINARY))
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def _leaves(c: Column, kind: T.DataType, path: str) -> list[Column]:
    """Array columns of (element, value) that together hold all leaves under ``c``."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(c.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return [leaf for f in kind.elementType.fields for leaf in _each(F.transform(c, _field(f.name)), f.dataType, f"{path}[].{f.name}")]
        return _each(c, kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(f"{path}."), e["key"].cast("string")).alias("element"), value_text(e["value"], kind.valueType).alias("value")))
        return [F.coalesce(pairs, _none())]
    return [F.array(F.struct(F.lit(path).alias("element"), value_text(c, kind).alias("value")))]


def _field(name: str):
    return lambda e: e.getField(name)


def _each(items: Column, kind: T.DataType, path: str) -> list[Column]:
    if isinstance(kind, T.MapType):
        flat = F.flatten(F.transform(F.coalesce(items, F.expr("array()").cast(T.ArrayType(kind))), lambda m: F.coalesce(F.map_entries(m), F.expr("array()").cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))))
        return [F.transform(flat, lambda e: F.struct(F.concat(F.lit(f"{path}."), e["key"].cast("string")).alias("element"), value_text(e["value"], kind.valueType).alias("value")))]
    return [F.coalesce(F.transform(items, lambda v: F.struct(F.lit(path).alias("element"), value_text(v, kind).alias("value"))), _none())]


def _none() -> Column:
    return F.expr("cast(array() as array<struct<element:string,value:string>>)")


def flatten(records: DataFrame, file: str, columns: list[str] | None = None) -> DataFrame:
    """(file, element, value, first) once for each leaf that has a text; raw headers and the file itself are left out.

    ``records`` has one row for each file.  ``first`` marks one row of each
    element of a file.  No shuffle.
    """
    skipped = {file, "raw_headers", "cards", "xml"}
    names = columns or [c for c in records.columns if c not in skipped]
    leaves = [leaf for n in names for leaf in _leaves(F.col(n), records.schema[n].dataType, n)]
    some = F.array_distinct(F.filter(F.concat(*leaves), lambda e: e["value"].isNotNull()))
    rows = records.select(F.col(file).alias("file"), some.alias("e"))
    marked = F.transform("e", lambda e, i: F.struct(e["element"].alias("element"), e["value"].alias("value"), (F.array_position(F.col("e.element"), e["element"]) == i + 1).alias("first")))
    return rows.select("file", F.explode(marked).alias("e")).select("file", "e.element", "e.value", "e.first")


def _files_by_element(long: DataFrame, file: str, element: str, *more: Column) -> DataFrame:
    """Files that have each element; a table without ``first`` may hold copies, which cost a distinct."""
    once = long.filter("first") if "first" in long.columns else long.dropDuplicates([file, element])
    return once.groupBy(F.col(element).alias("metadata_element")).agg(F.count(F.lit(1)).alias("files"), *more)


def element_presence(long: DataFrame, files: int | str, file: str = "file", element: str = "element") -> DataFrame:
    """(metadata_element, files, percent_of_files), one row for each element; ``files``: how many there are, or the column that says so."""
    held = _files_by_element(long, file, element, *([F.max(files).alias("all")] if isinstance(files, str) else []))
    total = F.col("all") if isinstance(files, str) else F.lit(files)
    return held.select("metadata_element", "files", X.format_percentage(X.percentage(F.col("files"), total)).alias("percent_of_files"))


def tracked(long: DataFrame, varying: tuple[str, ...] = VARYING, element: str = "element") -> DataFrame:
    """Only elements whose values are counted; the filter stands before any shuffle."""
    return long.filter(~F.col(element).isin(*varying))


def value_distribution(long: DataFrame, varying: tuple[str, ...] = VARYING, file: str = "file", element: str = "element", value: str = "value") -> DataFrame:
    """(metadata_element, value, files, percent_of_element); each value once a file."""
    used = tracked(long, varying, element)
    once = used if "first" in long.columns else used.select(file, element, value).distinct()
    values = once.groupBy(F.col(element).alias("metadata_element"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("files"))
    held = _files_by_element(used, file, element).withColumnRenamed("files", "_held")
    joined = values.join(held, "metadata_element")
    return joined.select("metadata_element", "value", "files", X.format_percentage(X.percentage(F.col("files"), F.col("_held"))).alias("percent_of_element"))


def run_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("files"))


def first_failures(rows: DataFrame, path: str = "path", message: str = "error", n: int = 10) -> DataFrame:
    """The first ``n`` failures by path."""
    return rows.select(path, message).orderBy(path).limit(n)


def write_csv(report: DataFrame, path: str, order: list[str]) -> None:
    """A sorted report as one CSV file with a header; a report has a row for each element or value, not for each file."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
