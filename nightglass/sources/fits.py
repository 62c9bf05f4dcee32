"""FITS decoding: header cards of all HDUs, and the primary image, from bytes."""

from __future__ import annotations

import re

import numpy as np

BLOCK, CARD = 2880, 80
# Sample types by BITPIX.
SAMPLES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_LOGICAL_KEYWORDS = frozenset(("COMMENT", "HISTORY", ""))


class FormatError(ValueError):
    """The bytes aren't what they should be; the message says why."""


def clean_value(raw: str) -> str:
    """A value without its quotes, doubled quotes made single, and no space at its end."""
    t = raw.strip()
    if len(t) >= 2 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'").rstrip()
    return t


def keyword_of(raw: str) -> str:
    """The first eight characters, or what stands before '=' in a HIERARCH card."""
    t = raw.rstrip()
    if t.startswith("HIERARCH"):
        return t.split("=", 1)[0].strip() if "=" in t else "HIERARCH"
    return raw[:8].strip()


_VALUE = re.compile(r"\s*('(?:[^']|'')*'|[^/]*)\s*(?:/(.*))?$", re.S)


def parse_card(raw: str) -> tuple[str, str | None, str | None]:
    """Keyword, value and comment of a card; empty ones are None."""
    keyword = keyword_of(raw)
    if keyword in _LOGICAL_KEYWORDS or (raw[8:10] != "= " and not (raw.startswith("HIERARCH") and "=" in raw)):
        comment = raw[8:].strip()
        return keyword, None, comment or None
    if raw.startswith("HIERARCH"):
        keyword = keyword.removeprefix("HIERARCH").strip()
        body = raw.split("=", 1)[1]
    else:
        body = raw[10:]
    m = _VALUE.match(body)
    value, comment = (m[1].strip(), m[2]) if m else (body.strip(), None)
    comment = comment.strip() if comment else None
    return keyword, clean_value(value) if value else None, comment or None


def header_cards(data, start: int, hdu: int) -> tuple[list[dict], int]:
    """The cards of the header at ``start``, and where its data begin."""
    cards, at = [], start
    while True:
        block = data[at : at + BLOCK]
        if len(block) < CARD:
            raise FormatError("FITS header has no END")
        at += BLOCK
        for i in range(0, len(block) - CARD + 1, CARD):
            raw = block[i : i + CARD].decode("latin-1")
            if raw[:8].rstrip() == "END":
                return cards, at
            if not raw.strip() and not cards:
                continue
            keyword, value, comment = parse_card(raw)
            cards.append({"hdu_index": hdu, "card_index": len(cards) + 1, "keyword": keyword, "value": value, "comment": comment, "raw_card": raw.rstrip()})


def numbers(cards: list[dict]) -> dict[str, str]:
    return {c["keyword"]: c["value"] for c in cards if c["value"] is not None}


def image_shape(header: dict[str, str]) -> list[int]:
    """NAXIS1, NAXIS2, ... as whole numbers."""
    return [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]


def data_bytes(header: dict[str, str]) -> int:
    shape = image_shape(header)
    if not shape:
        return 0
    n = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + int(np.prod(shape, dtype=np.int64)))
    return -(-n // BLOCK) * BLOCK


def all_cards(data, first_only: bool = False) -> tuple[list[dict], list[int]]:
    """Cards of every HDU in order, and the primary image's shape, of bytes or of what is sliced like bytes."""
    if data[:6] != b"SIMPLE":
        raise FormatError("not a FITS file")
    cards, shape, at, hdu = [], [], 0, 0
    while at < len(data) and len(data) - at >= BLOCK:
        own, at = header_cards(data, at, hdu)
        header = numbers(own)
        if not hdu:
            shape = image_shape(header)
        cards += own
        at += data_bytes(header)
        hdu += 1
        if first_only:
            break
    return cards, shape


def primary_image(data: bytes) -> tuple[np.ndarray, int, int]:
    """Row-major 32-bit pixels, width and height of the primary HDU, scaled by BSCALE and BZERO, as raw counts."""
    if not data.startswith(b"SIMPLE"):
        raise FormatError("not a FITS file")
    cards, at = header_cards(data, 0, 0)
    header = numbers(cards)
    shape = image_shape(header)
    if len(shape) != 2:
        raise FormatError(f"the primary HDU is no image of two axes: it has {len(shape)}")
    bitpix = int(header.get("BITPIX", 0))
    if bitpix not in SAMPLES:
        raise FormatError(f"unknown BITPIX {bitpix}")
    width, height = shape
    n = width * height
    kind = np.dtype(SAMPLES[bitpix])
    if len(data) - at < n * kind.itemsize:
        raise FormatError("FITS image is truncated")
    px = np.frombuffer(data, kind, n, at)
    scale, zero = float(header.get("BSCALE", 1) or 1), float(header.get("BZERO", 0) or 0)
    if bitpix > 0 and "BLANK" in header:
        px = np.where(px == int(header["BLANK"]), np.nan, px.astype(np.float64))
    if (scale, zero) != (1.0, 0.0):
        px = px.astype(np.float64) * scale + zero
    return px.astype(np.float32), width, height


def normalize(px: np.ndarray) -> np.ndarray:
    """0 to 1 between the least and greatest pixel; zeros where all are equal."""
    if not len(px):
        return px
    low, high = np.nanmin(px), np.nanmax(px)
    return np.zeros_like(px) if high == low else (px - low) / (high - low)
