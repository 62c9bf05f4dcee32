"""Writers of FITS and XISF bytes for tests."""

import struct

import numpy as np


def card(keyword, value=None, comment=None):
    if value is None:
        return f"{keyword:<8}{'  ' if keyword not in ('COMMENT', 'HISTORY') else ''}{comment or ''}"[:80].ljust(80)
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value is True else "F" if value is False else str(value)).rjust(20)
    return f"{keyword:<8}= {text}{f' / {comment}' if comment else ''}"[:80].ljust(80)


def hdu(first, pixels=None, cards=(), bitpix=None):
    kinds = {np.dtype("u1"): 8, np.dtype("i2"): 16, np.dtype("i4"): 32, np.dtype("f4"): -32, np.dtype("f8"): -64}
    head = [card("SIMPLE", True) if first else card("XTENSION", "IMAGE")]
    shape = [] if pixels is None else pixels.shape[::-1]
    head += [card("BITPIX", 8 if pixels is None else kinds[pixels.dtype]), card("NAXIS", len(shape)), *(card(f"NAXIS{i + 1}", n) for i, n in enumerate(shape))]
    head += [c if isinstance(c, str) else card(*c) for c in cards]
    raw = "".join([*head, "END".ljust(80)]).encode("latin-1")
    raw += b" " * (-len(raw) % 2880)
    if pixels is not None:
        data = pixels.astype(pixels.dtype.newbyteorder(">")).tobytes()
        raw += data + b"\0" * (-len(data) % 2880)
    return raw


def xisf(xml, payload=b"", offset=512):
    header = xml.encode().ljust(offset - 12, b"\0")
    return b"XISF0100" + struct.pack("<I", offset - 12) + header + payload
