"""XISF decoding: the XML header, and one image of 16-bit samples, from bytes."""

from __future__ import annotations

import re
import struct

import numpy as np

from nightglass.sources.fits import FormatError

SIGNATURE = b"XISF0100"


def attribute(text: str, name: str) -> str | None:
    """The first ``name="..."`` of the text."""
    mark = f'{name}="'
    at = text.find(mark)
    end = text.find('"', at + len(mark)) if at >= 0 else -1
    return text[at + len(mark) : end] if end >= 0 else None


def xml_header(data, strict: bool = True) -> str:
    """The XML text of bytes, or of what is sliced like bytes.

    Strict: the header must be whole, ``<?xml`` be there and the text UTF-8.
    Else the text may start anywhere, broken characters are replaced, and a
    short header counts as empty.
    """
    if data[:8] != SIGNATURE:
        raise FormatError("not an XISF file")
    if len(data) < 12:
        raise FormatError("XISF header size is missing")
    (size,) = struct.unpack("<I", data[8:12])
    raw = data[12 : 12 + size]
    if len(raw) < size:
        if strict:
            raise FormatError("XISF header is truncated")
        return ""
    at = raw.find(b"<?xml")
    if at < 0:
        if strict:
            raise FormatError("XISF header has no XML declaration")
        at = 0
    raw = raw[at:].split(b"\0", 1)[0]
    try:
        return raw.decode("utf-8", "strict" if strict else "replace")
    except UnicodeDecodeError as e:
        raise FormatError(f"XISF header is not UTF-8: {e}") from e


def first_tag(xml: str) -> str:
    m = re.search(r"(?s)<Image [^>]*>", xml)
    if not m:
        raise FormatError("no <Image> element")
    return m[0]


def image_geometry(value: str) -> tuple[int, int, int]:
    parts = value.split(":")
    if len(parts) != 3 or not all(re.fullmatch(r"\+?[0-9]+", p) for p in parts):
        raise FormatError(f"invalid geometry {value!r}")
    w, h, c = map(int, parts)
    if not w * h * c:
        raise FormatError(f"geometry {value!r} has a zero")
    return w, h, c


def image_location(value: str) -> tuple[int, int]:
    parts = value.split(":")
    if len(parts) != 3 or parts[0] != "attachment" or not all(re.fullmatch(r"\+?[0-9]+", p) for p in parts[1:]):
        raise FormatError(f"unsupported location {value!r}")
    return int(parts[1]), int(parts[2])


def image_block(xml: str) -> tuple[int, int, int, int]:
    """Width, height, offset and size; checked in the order geometry, sampleFormat, compression, channels, location."""
    tag = first_tag(xml)
    geometry = attribute(tag, "geometry")
    if geometry is None:
        raise FormatError("image has no geometry")
    w, h, c = image_geometry(geometry)
    kind = attribute(tag, "sampleFormat")
    if kind != "UInt16":
        raise FormatError(f"unsupported sampleFormat {kind}")
    if attribute(tag, "compression") is not None:
        raise FormatError("compressed images are not supported")
    if c != 1:
        raise FormatError(f"image has {c} channels")
    location = attribute(tag, "location")
    if location is None:
        raise FormatError("image has no location")
    return w, h, *image_location(location)


def samples(payload: bytes, width: int, height: int) -> np.ndarray:
    """Little-endian 16-bit samples as 0 to 1; what is beyond the image is ignored."""
    need = width * height * 2
    if len(payload) < need:
        raise FormatError(f"image data are truncated: {len(payload)} of {need} bytes")
    return (np.frombuffer(payload, "<u2", width * height) / np.float32(65535.0)).astype(np.float32)


def primary_image(data: bytes) -> tuple[np.ndarray, int, int]:
    w, h, offset, size = image_block(xml_header(data))
    if offset + size > len(data):
        raise FormatError("image data are truncated")
    return samples(data[offset : offset + size], w, h), w, h
