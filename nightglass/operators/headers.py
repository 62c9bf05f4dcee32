"""Header cards: maps, lookups and alias lookups.

A header is an array of cards, or a table with a row for each card.  The
functions here are column expressions, or one aggregation by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass.functions import text as T
from nightglass.functions.scalars import col


def header_map(cards: Column | str) -> Column:
    """Keyword to value of an array of cards in order; cards without a value are skipped, the last of a keyword stays."""
    some = F.filter(col(cards), lambda c: c["value"].isNotNull())
    # sorted by keyword and place, an entry stays that the next one doesn't replace
    placed = F.array_sort(F.transform(some, lambda c, i: F.struct(c["keyword"].alias("keyword"), i.alias("at"), c["value"].alias("value"))))
    after = F.concat(F.slice(F.transform(placed, lambda e: e["keyword"]), F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    paired = F.filter(F.arrays_zip(placed.alias("e"), after.alias("after")), lambda p: p["e"].isNotNull() & ~p["after"].eqNullSafe(p["e"]["keyword"]))
    return F.map_from_entries(F.transform(paired, lambda p: F.struct(p["e"]["keyword"], p["e"]["value"])))


def last_values(cards: DataFrame, file: str, order: Sequence[str], keyword: str = "keyword", value: str = "value") -> DataFrame:
    """(file, keyword, value) of a table of cards: each keyword's last value that isn't null.

    One aggregation with map-side combine; a keyword without any value is left out.
    """
    some = cards.filter(F.col(value).isNotNull())
    return some.groupBy(file, keyword).agg(F.max_by(value, F.struct(*order)).alias(value))


def header_maps(cards: DataFrame, file: str, order: Sequence[str], keyword: str = "keyword", value: str = "value") -> DataFrame:
    """(file, header) with the map of each file's last values."""
    last = last_values(cards, file, order, keyword, value)
    return last.groupBy(file).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(keyword, value)))).alias("header"))


def lookup(header: Column | str, key: str) -> Column:
    """The value of exactly ``key``, else of the first key, in order, that equals it without regard to ASCII case."""
    header = col(header)
    other = F.filter(F.array_sort(F.map_entries(header)), lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(header, F.lit(key)), F.get(other, F.lit(0))["value"])


def first_string(header: Column | str, aliases: Sequence[str]) -> Column:
    """The first alias with a value that isn't empty."""
    return F.coalesce(*[F.nullif(lookup(header, a), F.lit("")) for a in aliases])


def first_float(header: Column | str, aliases: Sequence[str], kind: str = "float") -> Column:
    """The first alias whose value is a number."""
    return F.coalesce(*[T.parse_number(lookup(header, a), "float").cast(kind) for a in aliases])


def first_integer(header: Column | str, aliases: Sequence[str], kind: str = "int", signed: bool = True) -> Column:
    """The first alias whose value is a whole number."""
    return F.coalesce(*[T.parse_integer(lookup(header, a), kind, signed) for a in aliases])


def first_unsigned(header: Column | str, aliases: Sequence[str]) -> Column:
    """The whole number that the first alias with a value holds, without falling through to the next."""
    return T.parse_integer(first_string(header, aliases), "bigint", signed=False)


def last_of(cards: Column | str, aliases: Sequence[str]) -> Column:
    """The value of the last card, in the document's order, with one of the keywords."""
    held = F.filter(col(cards), lambda c: c["keyword"].isin(*aliases))
    return F.when(F.size(held) > 0, F.element_at(held, -1)["value"])


def xisf_cards(xml: Column | str) -> Column:
    """Cards of every ``<FITSKeyword .../>`` that has a name and a value, numbered from 1, quotes around values stripped."""
    tags = T.xml_tags(xml, r"(?s)<FITSKeyword .*?/>")
    found = F.transform(tags, lambda t: F.struct(T.xml_attribute(t, "name").alias("keyword"), F.regexp_replace(T.xml_attribute(t, "value"), r"^'+|'+$", "").alias("value")))
    kept = F.filter(found, lambda c: c["keyword"].isNotNull() & c["value"].isNotNull())
    none = F.lit(None).cast("string")
    return F.transform(kept, lambda c, i: F.struct(F.lit(0).alias("hdu_index"), (i + 1).cast("int").alias("card_index"), c["keyword"].alias("keyword"), c["value"].alias("value"), none.alias("comment"), none.alias("raw_card")))
