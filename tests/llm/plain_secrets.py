"""Plain versions of the secret scan's features, a token and a text at a time."""

import re

import numpy as np

from nightglass.llm.crf_secrets import _ADDRESS, _NAMED, _NEAR, BOTH, FEATURES, PLACE, SHAPE

SPLIT = r"""\s"'`“”‘’„«»()\[\]{}<>,;:="""
TOKEN = re.compile(rf"[^{SPLIT}.\-](?:[^{SPLIT}]*[^{SPLIT}.\-])?")
SIGN = re.compile(r"[^A-Za-z0-9_+/.\-']", re.A)
SMALL, CAPITAL, DIGIT = (frozenset(c) for c in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))


def tokens_of(text):
    return [m.span() for m in TOKEN.finditer(text)]


def shape(t: str) -> tuple[bool, ...]:
    """The features of a token by itself, and whether it has a digit."""
    n = len(t)
    kind = [0 if c in DIGIT else 1 if c in CAPITAL else 2 if c in SMALL else 3 for c in t]
    digits, upper, lower = kind.count(0), kind.count(1), kind.count(2)
    changes = sum(a != b for a, b in zip(kind, kind[1:])) / n
    variety = len(set(t)) / min(n, 24)
    vowels = sum(c in "aeiouAEIOU" for c in t) / max(1, upper + lower)
    longest_word = max(map(len, re.findall(r"[a-z]+", t)), default=0)
    share, core = digits / n, t.rstrip("!?")
    letters, sign = core.isalpha(), bool(SIGN.search(core)) and not core.isalpha()
    mixed = bool(upper and lower and digits)
    return (
        True, n < 4, 4 <= n < 8, 8 <= n < 12, 12 <= n < 16, 16 <= n < 20, 20 <= n < 32, 32 <= n < 48, n >= 48, digits == n, set(t) <= set("0123456789abcdef"), upper == 0, lower == 0, mixed,
        share < 0.1, 0.1 <= share < 0.3, 0.3 <= share < 0.6, variety < 0.4, variety > 0.7, changes < 0.1, 0.1 <= changes < 0.3, changes >= 0.3, "." in t, "/" in t, "-" in t,
        "_" in t, longest_word >= 7, 0.25 <= vowels <= 0.6, letters, letters and n >= 12, letters and n >= 20, bool(digits and upper + lower) and n >= 16, mixed and n >= 20, sign, sign and digits > 0, not t.isascii(), bool(_ADDRESS.fullmatch(t)),
        any(b == 1 and a == 2 for a, b in zip(kind, kind[1:])), upper == n >= 8, letters and (upper == 0 or lower == 0), digits > 0,
    )


def places(text: str, spans: np.ndarray, whole: tuple[bool, bool]) -> np.ndarray:
    """The features of ``PLACE`` of the tokens at ``spans``, a row of 0 or 1 for each.  ``whole``: the text's own features."""
    start, end = spans[:, 0], spans[:, 1]
    out = np.zeros((len(spans), len(PLACE)), bool)
    code = np.frombuffer(("  " + text + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    one, two, after = code[start + 1], code[start], code[end + 2]
    is_in = lambda c, chars: np.logical_or.reduce([c == ord(x) for x in chars])
    quoted = is_in(one, "\"'`")
    last = np.where(is_in(one, " \"'`"), two, one)
    space = np.where(is_in(last, " \"'`") & (start > 2), code[np.maximum(start - 1, 0)], last)
    out[:, 0], out[:, 1] = is_in(space, "=:"), quoted
    near = np.array([m.end() for m in _NEAR.finditer(text)], np.int64) if whole[0] else np.zeros(0, np.int64)
    lines = np.array([m.end() for m in re.finditer("\n", text)], np.int64)
    line = np.concatenate(([0], lines))[np.searchsorted(lines, start, "right")]
    if len(near):
        latest = np.concatenate(([-1000], near))[np.searchsorted(near, start, "right")]
        out[:, 2] = start - latest <= 24
        out[:, 3] = (start - latest <= 60) & (latest > line)
    at = np.flatnonzero(code == 64) - 2
    out[:, 4] = (one == 64) | (after == 64)
    slashes = np.array([m.start() for m in re.finditer("://", text)], np.int64) if "://" in text else np.zeros(0, np.int64)
    for signs, reach in ((slashes, 60), (at, 24)):
        if len(signs):
            latest = np.concatenate(([-1000], signs))[np.searchsorted(signs, start, "left")]
            out[:, 5] |= (start - latest <= reach) & (latest >= line)
    out[:, 6], out[:, 7] = after == 58, is_in(after, "%°")
    glued = np.zeros(len(spans), bool)
    blank = np.concatenate(([0], np.cumsum(is_in(code, " \t\n\r\x0b\x0c 　"))))
    glued[1:] = blank[start[1:] + 2] == blank[end[:-1] + 2]
    out[:, 8], out[:-1, 9] = glued, glued[1:]
    if whole[0]:
        for m in _NAMED.finditer(text):
            k = int(np.searchsorted(start, m.end()))
            if k < len(start) and start[k] - m.end() <= 1:
                out[k, 10 if m[1] else 11] = True
                out[k, 12] = bool(m[1]) and any(c in m[0] for c in "=:")
    out[:, 13], out[:, 14] = whole
    return out


def features(text):
    run, whole = tokens_of(text), (bool(_NEAR.search(text)), 20 * sum(map(text.count, "0123456789")) > len(text))
    shapes = np.array([shape(text[a:b]) for a, b in run], bool).reshape(len(run), len(SHAPE) + 1)
    both = shapes[:, [len(SHAPE) if f == "has digit" else SHAPE.index(f) for f in BOTH]]
    place = places(text, np.array(run, np.int64).reshape(-1, 2), whole) if run else np.zeros((0, len(PLACE)), bool)
    named = [both & place[:, PLACE.index(f), None] for f in ("password named", "password assigned", "key named")]
    return run, np.hstack((shapes[:, :-1], place, *named)).reshape(len(run), len(FEATURES))
