"""Column functions on header text, XML text and paths, without Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightglass.functions.scalars import col

FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
EXTENSIONS = ("fits", "fit", "fts", "xisf")


def parse_number(x: Column | str, kind: str = "float") -> Column:
    """The number that the whole text is, without spaces or suffixes, else null."""
    x = col(x)
    return F.when(x.rlike(FLOAT), x.try_cast(kind))


def parse_integer(x: Column | str, kind: str = "int", signed: bool = True) -> Column:
    """The integer that the whole text is, else null; a fraction is none."""
    x = col(x)
    return F.when(x.rlike(r"^[+-]?[0-9]+$" if signed else r"^\+?[0-9]+$"), x.try_cast(kind))


def parse_flag(x: Column | str) -> Column:
    """'true' in any case, or '1'."""
    return (F.lower(col(x)) == "true") | (col(x) == "1")


def parse_sexagesimal(x: Column | str) -> Column:
    """Degrees of 'D M S' or hours of 'H M S'; null with fewer than three numbers, more are ignored."""
    trimmed = F.regexp_replace(col(x), r"^\s+|\s+$", "")
    parts = F.split(trimmed, r"\s+")
    d, m, s = (parse_number(F.get(parts, F.lit(i)), "double") for i in range(3))
    sign = F.when((d < 0) | trimmed.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(F.size(parts) >= 3, sign * (F.abs(d) + m / 60 + s / 3600))


_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?| [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)$"


def parse_date_time(x: Column | str) -> Column:
    """T or space between date and time, perhaps a fraction, perhaps Z after a T; else null."""
    x = col(x)
    return F.when(x.rlike(_DATE), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, "Z$", ""), "T", " ")))


def clean_card_value(x: Column | str) -> Column:
    """A header card's value: trimmed, or without its quotes, doubled quotes made single."""
    t = F.trim(col(x))
    return F.when((F.length(t) >= 2) & t.startswith("'") & t.endswith("'"), F.rtrim(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'")))).otherwise(t)


def card_keyword(raw: Column | str) -> Column:
    """A raw card's keyword: its first eight characters, or what stands before '=' in a HIERARCH card."""
    raw = col(raw)
    t = F.rtrim(raw)
    return F.when(t.startswith("HIERARCH"), F.when(F.instr(t, "=") > 0, F.trim(F.substring_index(t, "=", 1))).otherwise("HIERARCH")).otherwise(F.trim(F.substring(raw, 1, 8)))


def xml_attribute(x: Column | str, name: str) -> Column:
    """The first ``name="..."``, without regard for what stands before the name; null if there is none."""
    x = col(x)
    mark = f'{name}="'
    rest = F.substr(x, F.instr(x, mark) + F.lit(len(mark)))
    return F.when((F.instr(x, mark) > 0) & (F.instr(rest, '"') > 0), F.substring_index(rest, '"', 1))


def xml_property(x: Column | str, name: str) -> Column:
    """The trimmed text of the first element with ``id="name" type="``; null if there is none."""
    pattern = rf'(?s)id="{re.escape(name)}" type="[^>]*>(.*?)</Property>'
    x = col(x)
    return F.when(x.rlike(pattern), F.regexp_replace(F.regexp_extract(x, pattern, 1), r"^\s+|\s+$", ""))


def xml_tags(x: Column | str, pattern: str) -> Column:
    """All matches of a tag's pattern, in order."""
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(0))


def key_values(x: Column | str, between: str = ";", kind: str = "double") -> Column:
    """A map of 'k=v;k=v'; pairs that aren't k=v with a number are dropped, the last of a key stays."""
    parts = F.transform(F.split(col(x), re.escape(between)), lambda p: F.split(p, "="))
    value = (lambda p: parse_number(F.get(p, F.lit(1)), kind)) if kind != "string" else (lambda p: F.get(p, F.lit(1)))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), value(p).alias("value")))
    good = F.filter(pairs, lambda p: p["value"].isNotNull())
    # fold, as a later pair replaces an earlier one
    empty = F.expr(f"cast(map() as map<string,{kind}>)")
    return F.aggregate(good, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_entries(F.array(p))))


def geometry(x: Column | str) -> Column:
    """(width, height, channels) of 'w:h:c', three positive whole numbers; else null."""
    parts = F.split(col(x), ":")
    w, h, c = (parse_integer(F.get(parts, F.lit(i)), "bigint", signed=False) for i in range(3))
    return F.when((F.size(parts) == 3) & (w > 0) & (h > 0) & (c > 0), F.struct(w.alias("width"), h.alias("height"), c.alias("channels")))


def attachment_location(x: Column | str) -> Column:
    """(offset, size) of 'attachment:offset:size'; else null."""
    parts = F.split(col(x), ":")
    offset, size = (parse_integer(F.get(parts, F.lit(i)), "bigint", signed=False) for i in (1, 2))
    return F.when((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "attachment") & offset.isNotNull() & size.isNotNull(), F.struct(offset.alias("offset"), size.alias("size")))


def xml_header(x: Column | str, strict: bool = True) -> Column:
    """The text from ``<?xml`` to the first NUL; without ``<?xml`` null, or from the start if not ``strict``."""
    x = col(x)
    at = F.instr(x, "<?xml")
    start = F.when(at > 0, at) if strict else F.greatest(at, F.lit(1))
    return F.substring_index(F.substr(x, start), "\0", 1)


def file_extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def is_supported(path: Column | str) -> Column:
    """The extension is that of an image file, in any case."""
    return file_extension(path).isin(*EXTENSIONS)


def frame_id(path: Column | str) -> Column:
    """The path's last part, or 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_extract(col(path), r"([^/]+)/*$", 1), F.lit("")), F.lit("unknown"))


def path_tokens(pattern: str, tokens: dict[str, Column]) -> Column:
    """A path from a pattern such as ``$$TARGETNAME$$/$$FILTER$$``; unknown tokens stay, missing values are empty."""
    parts = re.split(r"\$\$([A-Z0-9]+)\$\$", pattern)
    out = [F.coalesce(tokens[p].cast("string"), F.lit("")) if i % 2 and p in tokens else F.lit(f"$${p}$$" if i % 2 else p) for i, p in enumerate(parts)]
    return F.concat(*out)
