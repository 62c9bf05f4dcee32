"""Secret scans: fixed patterns, and spans added by a linear-chain CRF.

The CRF labels each token begin (B), inside (I) or outside (O) of a secret from
its shape, its neighbouring words and features of the whole text, and Viterbi
decodes it.  All tokens of a text make one chain: a token is a run of
characters other than white space, quotes, brackets and ``,;:=``, without dots
and dashes at its ends.  Where bounds on the scores show that no best labelling
has a token in a secret, it is O, and the chain falls apart; the rest is
decoded, so the labels are those of the whole chain.

The model is trained here, on generated lines (``TRAINING_LINES``, fixed seed):
keys and passwords of many makes, and words, dates, addresses, paths, versions
and the like.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightglass.llm import textcore as tc
from nightglass.llm.textcore import column, tidied

TRAINING_LINES = 4000
KINDS = ("assign", "access", "hex", "crf")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of texts that are tokenised together.
BLOCK_CHARS = 500_000
# What parts tokens, and what is no part of one at its ends.
_SPLIT, _TRIMMED = r"""\s"'`“”‘’„«»()\[\]{}<>,;:=""", ".-"
_NEAR = re.compile(r"passw|passwd|pwd|passphrase|secret|token|key|auth|bearer|credential|private", re.I | re.A)
_NAMED = re.compile(r"""(?:(passw(?:or)?d|pwd|passphrase|secret)|(?:[a-z]+[_\x20-])?(?:token|key|bearer|credential))["']?(?:\x20(?:is|was)\x20|\x20?(?:[:=]|=>)\x20?|\x20)["'`]?(?=[^\s"'`])""", re.I | re.A)
O, B, I = 0, 1, 2


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind.  ``low``: the text in small letters."""
    out = []
    low = text.lower() if low is None else low
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2])) if len(out) > 1 else out


SHAPE = (
    "bias", "len<4", "len<8", "len<12", "len<16", "len<20", "len<32", "len<48", "long", "digits only", "hex only", "no capital", "no small letter", "mixed",
    "digits<10%", "digits<30%", "digits<60%", "few kinds of character", "many kinds", "changes<2", "changes<5", "many changes", "has dot", "has slash", "has dash",
    "has underscore", "ends in word", "vowels like a word", "letters only", "letters only, 12 or more", "letters only, 20 or more", "digits and letters, 16 or more", "mixed, 20 or more", "sign inside", "sign and digit", "beyond ASCII", "like an address", "capital inside", "all capitals, 8 or more", "letters of one case",
)
PLACE = (
    "assigned", "quoted", "named before", "named before on line", "at sign beside", "slash or @ near", "colon after", "unit after", "glued to the token before", "glued to the token after",
    "password named", "key named", "password assigned", "text names secrets", "text has many digits",
)
#: Of a token that a name stands right before, its shape besides: what a password may be, a common word isn't.
BOTH = ("letters only", "len<4", "len<8", "len<12", "letters only, 12 or more", "letters only, 20 or more", "all capitals, 8 or more", "has digit", "digits only", "sign inside", "mixed", "beyond ASCII")
FEATURES = (*SHAPE, *PLACE, *(f"password named, {f}" for f in BOTH), *(f"password assigned, {f}" for f in BOTH), *(f"key named, {f}" for f in BOTH))
_AT = {f: i for i, f in enumerate(SHAPE)}
_PLACE = {f: i for i, f in enumerate(PLACE)}
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\S*//\S+|/?(?:[\w.-]+/)+[\w.-]*|(?:[\w-]+\.)+[a-z]{2,6}(?:[/?]\S*)?")
_TABLE = 1 << 16


def _marked(chars: str) -> np.ndarray:
    """Of each code point of the first plane, whether it is one of ``chars``."""
    out = np.zeros(_TABLE, bool)
    out[[ord(c) for c in chars]] = True
    return out


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Classes of the first plane's code points; others are like its last one, which is in none."""
    small, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = [chr(i) for i in range(_TABLE)]
    splits = re.compile(f"[{_SPLIT}]")
    kind = np.full(_TABLE, 3, np.int8)
    for k, chars in enumerate((digit, small.upper(), small)):
        kind[_marked(chars)] = k
    return {
        "split": np.array([bool(splits.match(c)) for c in every]), "alpha": np.array([c.isalpha() for c in every]), "kind": kind, "hex": _marked(digit + "abcdef"), "vowel": _marked("aeiouAEIOU"),
        "sign": ~_marked(small + small.upper() + digit + "_+/.-'"), "shout": _marked("!?"), "trimmed": _marked(_TRIMMED), "blank": _marked(" \t\n\r\x0b\x0c\xa0\u3000"), "quote": _marked("\"'`"), "open": _marked(" \"'`"), "assign": _marked("=:"), "unit": _marked("%°"),
    }


class Tokens:
    """The tokens of some texts and their features.

    The texts stand side by side with two blanks around each, as code points;
    ``start``, ``end`` and ``doc`` say where each token is.  ``number`` is equal
    for equal tokens, and ``shapes`` has a row for each number: the features of
    ``SHAPE``, and whether the token has a digit.
    """

    def __init__(self, texts: list[str]):
        text = "".join([f"  {t}  " for t in texts])
        self.code = code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.texts, self.base = texts, np.cumsum(sizes + 4) - sizes - 2  # where each text begins
        flat, t = np.minimum(code, _TABLE - 1), _tables()
        split = t["split"][flat]
        core = np.flatnonzero(~(split | t["trimmed"][flat]))
        runs = np.cumsum(split, dtype=np.int32)[core]
        new = np.ones(len(core), bool)
        new[1:] = runs[1:] != runs[:-1]
        first = np.flatnonzero(new)
        self.start, self.end = core[first], core[np.append(first[1:], len(core)) - 1] + 1 if len(core) else core
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        digits = np.concatenate(([0], np.cumsum(t["kind"][flat] == 0, dtype=np.int64)))
        self.many_digits = 20 * (digits[self.base + sizes] - digits[self.base]) > sizes
        # equal tokens have one number
        top = int(code.max(initial=0))
        kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
        width = np.dtype(kind).itemsize
        self.number = tc.span_numbers(code.astype(kind).view(np.uint8), self.start * width, self.end * width)
        one = np.empty(int(self.number.max(initial=-1)) + 1, np.int64)
        one[self.number] = np.arange(len(self.number))
        self.shapes = self._shapes(self.start[one], self.end[one]) if len(one) else np.zeros((0, len(SHAPE) + 1), bool)

    def _shapes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        t, size = _tables(), end - start
        at = np.cumsum(size) - size
        ch = self.code[np.repeat(start - at, size) + np.arange(int(size.sum()))]
        owner, flat = np.repeat(np.arange(len(size)), size), np.minimum(ch, _TABLE - 1)
        kind = t["kind"][flat]
        count = lambda mask: np.add.reduceat(mask, at, dtype=np.int64)
        any_ = lambda mask: np.logical_or.reduceat(mask, at)
        has = lambda c: any_(ch == ord(c))
        digits, upper, lower = (count(kind == k) for k in range(3))
        beside = owner[1:] == owner[:-1]
        pad = lambda mask: np.append(mask, False)
        changes = count(pad(beside & (kind[1:] != kind[:-1]))) / size
        inside = any_(pad(beside & (kind[:-1] == 2) & (kind[1:] == 1)))
        key = np.sort(owner << 21 | ch)
        kinds = np.bincount(key[np.concatenate(([True], key[1:] != key[:-1]))] >> 21, minlength=len(size))
        variety, vowels = kinds / np.minimum(size, 24), count(t["vowel"][flat]) / np.maximum(1, upper + lower)
        small = kind == 2
        seven = small.copy()  # the first of seven small letters of one token
        for k in range(1, 7):
            seven[:-k] &= small[k:]
            seven[-k:] = False
        seven[:-6] &= owner[6:] == owner[:-6]
        # the token without the marks at its end
        place = np.arange(len(ch))
        stop = np.maximum.reduceat(np.where(t["shout"][flat], -1, place), at) + 1
        within = place < np.repeat(stop, size)
        alpha = t["alpha"][flat]
        for k in np.flatnonzero(ch >= _TABLE):
            alpha[k] = chr(ch[k]).isalpha()
        letters = ~any_(within & ~alpha) & (stop > at)
        sign = any_(within & t["sign"][flat]) & ~letters
        dot, slash = has("."), has("/")
        address = np.zeros(len(size), bool)
        for k in np.flatnonzero(dot | slash | has("@")):
            address[k] = bool(_ADDRESS.fullmatch("".join(map(chr, ch[at[k] : at[k] + size[k]]))))
        share, n, mixed = digits / size, size, (upper > 0) & (lower > 0) & (digits > 0)
        return np.stack(
            [
                np.ones(len(n), bool), n < 4, (4 <= n) & (n < 8), (8 <= n) & (n < 12), (12 <= n) & (n < 16), (16 <= n) & (n < 20), (20 <= n) & (n < 32), (32 <= n) & (n < 48), n >= 48, digits == n, ~any_(~t["hex"][flat]), upper == 0, lower == 0, mixed,
                share < 0.1, (0.1 <= share) & (share < 0.3), (0.3 <= share) & (share < 0.6), variety < 0.4, variety > 0.7, changes < 0.1, (0.1 <= changes) & (changes < 0.3), changes >= 0.3, dot, slash, has("-"),
                has("_"), any_(seven), (0.25 <= vowels) & (vowels <= 0.6), letters, letters & (n >= 12), letters & (n >= 20), (digits > 0) & (upper + lower > 0) & (n >= 16), mixed & (n >= 20), sign, sign & (digits > 0), any_(ch > 127), address,
                inside, (upper == n) & (n >= 8), letters & ((upper == 0) | (lower == 0)), digits > 0,
            ],
            axis=1,
        )

    def places(self, names: np.ndarray) -> np.ndarray:
        """The features of ``PLACE``, a row of 0 or 1 for each token.  ``names``: the texts that name secrets."""
        t, start, end, code = _tables(), self.start, self.end, self.code
        at = lambda k: np.minimum(code[np.maximum(k, 0)], _TABLE - 1)
        out = np.zeros((len(start), len(PLACE)), bool)
        if not len(start):
            return out
        put = lambda name, mask: out.__setitem__((slice(None), _PLACE[name]), mask)
        one, two, after, base = at(start - 1), at(start - 2), at(end), self.base[self.doc]
        last = np.where(t["open"][one], two, one)
        space = np.where(t["open"][last] & (start - base > 2), at(start - 3), last)
        put("assigned", t["assign"][space])
        put("quoted", t["quote"][one])
        breaks = np.sort(np.concatenate((np.flatnonzero(code == 10) + 1, self.base)))
        line = breaks[np.searchsorted(breaks, start, "right") - 1]
        latest = lambda signs, side: np.concatenate(([-1000], signs))[np.searchsorted(signs, start, side)]
        ats = np.flatnonzero(code == 64)
        slashes = np.flatnonzero(code == 58)
        slashes = slashes[(code[slashes + 1] == 47) & (code[slashes + 2] == 47)]
        put("at sign beside", (one == 64) | (after == 64))
        near = [latest(signs, "left") for signs in (slashes, ats)]
        put("slash or @ near", np.logical_or.reduce([(start - x <= reach) & (x >= line) for x, reach in zip(near, (60, 24))]))
        put("colon after", after == 58)
        put("unit after", t["unit"][after])
        blank = np.concatenate(([0], np.cumsum(t["blank"][np.minimum(code, _TABLE - 1)], dtype=np.int32)))
        glued = np.zeros(len(start) + 1, bool)
        glued[1:-1] = blank[start[1:]] == blank[end[:-1]]
        put("glued to the token before", glued[:-1])
        put("glued to the token after", glued[1:])
        put("text names secrets", names[self.doc])
        put("text has many digits", self.many_digits[self.doc])
        said = []
        for d in np.flatnonzero(names):
            b, text = int(self.base[d]), self.texts[d]
            said += [b + m.end() for m in _NEAR.finditer(text)]
            for m in _NAMED.finditer(text):
                k = int(np.searchsorted(start, b + m.end()))
                if k < len(start) and start[k] - b - m.end() <= 1:
                    out[k, _PLACE["password named" if m[1] else "key named"]] = True
                    out[k, _PLACE["password assigned"]] = bool(m[1]) and any(c in m[0] for c in "=:")
        if said:
            x = latest(np.array(said, np.int64), "right")
            put("named before", (start - x <= 24) & (x > base))
            put("named before on line", (start - x <= 60) & (x > line))
        return out


#: Features of a token whose name stands before it: those of ``PLACE`` whose rows of ``BOTH`` follow in ``FEATURES``.
_NAMES = tuple(_PLACE[f] for f in ("password named", "password assigned", "key named"))
_BOTH = [len(SHAPE) if f == "has digit" else _AT[f] for f in BOTH]


def features(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """The texts' tokens, and a row of 0 or 1 for each."""
    tokens = Tokens(texts)
    place, shapes = tokens.places(np.array([names_secrets(t) for t in texts], bool)), tokens.shapes[tokens.number]
    return tokens, np.hstack((shapes[:, :-1], place, *(shapes[:, _BOTH] & place[:, k, None] for k in _NAMES))).astype(np.float32)


# Each match of ``_NEAR`` holds one of these.
_NEAR_WORDS = ("passw", "pwd", "passphrase", "secret", "token", "key", "auth", "bearer", "credential", "private")


def names_secrets(text: str, low: str | None = None) -> bool:
    """Whether the text has a word that names secrets.  ``low``: the text in small letters."""
    low = text.lower() if low is None else low
    return any(w in low for w in _NEAR_WORDS) and bool(_NEAR.search(text))


class Crf:
    """Weights by label and feature, and transitions; O to I is impossible."""

    def __init__(self):
        self.w = np.zeros((len(FEATURES), 3))
        self.t = np.zeros((3, 3))

    def _bound(self) -> np.ndarray:
        t = self.t.copy()
        t[O, I] = -1e9
        return t

    def emissions(self, tokens: Tokens, names: np.ndarray) -> np.ndarray:
        """``features(...) @ w``, a token's shape weighed once for all its equals."""
        n = len(SHAPE)
        place, out = tokens.places(names), np.einsum("ij,jk->ik", tokens.shapes[:, :n], self.w[:n])[tokens.number]  # not worth BLAS's threads
        for k in range(len(PLACE)):
            out[place[:, k]] += self.w[n + k]
        for i, k in enumerate(_NAMES):
            some = np.flatnonzero(place[:, k])
            out[some] += tokens.shapes[tokens.number[some]][:, _BOTH] @ self.w[n + len(PLACE) + i * len(BOTH) :][: len(BOTH)]
        return out

    def open_runs(self, e: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(first, last + 1) of the runs of tokens of one text (``doc``) that a best labelling may have in a secret.

        If setting a token to O in any labelling, and an I after it to B, makes
        the labelling better, it is O in the best one.
        """
        d = self._bound() - self.t[O, O]
        gain = e[:, 1:] - e[:, :1]
        out = d[1:, O]
        # the most that a token labelled B or I, and the step to it, can be worth beside O
        came = np.array([max(d[O, k], *(d[1:, k] - out)) for k in (B, I)])
        onward = np.full(len(e), -np.inf)
        onward[:-1] = np.where(doc[1:] == doc[:-1], gain[1:, 1] - gain[1:, 0], -np.inf)
        worth = [gain[:, k - 1] + came[k - 1] + np.maximum(max(d[k, O], d[k, B] - d[O, B]), onward + d[k, I] - d[O, B]) for k in (B, I)]
        at = np.flatnonzero(np.maximum(*worth) >= -1e-9)
        if not len(at):
            return []
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]))))
        return list(zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + 1).tolist()))

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi over one run, between tokens that are O."""
        return self.best(x @ self.w)

    def best(self, e: np.ndarray) -> list[int]:
        t = self._bound()
        score, back = t[O] + e[0], []
        for row in e[1:]:
            through = score[:, None] + t
            back.append(through.argmax(0))
            score = through.max(0) + row
        labels = [int((score + t[:, O]).argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]

    def fit(self, runs: list[tuple[np.ndarray, list[int]]], steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Crf:
        """Maximise the conditional likelihood by Adam, with forward and backward sums over all runs at once."""
        runs = sorted(runs, key=lambda r: -len(r[1]))
        n, size = len(runs), np.array([len(y) for _, y in runs])
        m, ends, at = int(size[0]), size - 1, np.cumsum(size) - size
        # the tokens of all runs, by their place in the run and then by run: those at place k are of the first upto[k] runs
        upto = [int((size > k).sum()) for k in range(m)]
        x = np.vstack([x for x, _ in runs])
        order = np.concatenate([at[:u] + k for k, u in enumerate(upto)])
        x, y = np.ascontiguousarray(x[order], np.float32), np.concatenate([y for _, y in runs])[order]
        cut = np.concatenate(([0], np.cumsum(upto)))
        final = cut[ends] + np.arange(n)
        gold_w = x.T @ np.eye(3, dtype=np.float32)[y]
        gold_t = np.zeros((3, 3))
        for _, labels in runs:
            path = [O, *labels, O]
            np.add.at(gold_t, (path[:-1], path[1:]), 1)
        moments = [np.zeros_like(p) for p in (self.w, self.t, self.w, self.t)]
        for step in range(1, steps + 1):
            e, t = (x @ self.w.astype(np.float32)).astype(np.float64), np.exp(self._bound())
            # scaled sums: each token's forward and backward sums are divided by the forward one's total
            top = e.max(1, keepdims=True)
            u = np.exp(e - top)
            fwd, bwd, scale = np.empty_like(u), np.empty_like(u), np.empty(len(u))
            for k in range(m):
                i, j = cut[k], cut[k + 1]
                f = (t[O] if k == 0 else fwd[cut[k - 1] : cut[k - 1] + j - i] @ t) * u[i:j]
                scale[i:j] = f.sum(1)
                fwd[i:j] = f / scale[i:j, None]
            last = fwd[final] @ t[:, O]
            bwd[final] = t[:, O] / last[:, None]
            want_t = np.zeros((3, 3))
            for k in range(m - 1, 0, -1):
                i, j, h = cut[k], cut[k + 1], cut[k - 1]
                right = u[i:j] * bwd[i:j] / scale[i:j, None]
                bwd[h : h + j - i] = right @ t.T
                want_t += t * (fwd[h : h + j - i].T @ right)
            node = fwd * bwd
            want_t[O] += node[: cut[1]].sum(0)
            want_t[:, O] += node[final].sum(0)
            grads = ((x.T @ node.astype(np.float32)) - gold_w) / n + decay * self.w, (want_t - gold_t) / n + decay * self.t
            for j, (p, g) in enumerate(zip((self.w, self.t), grads)):
                moments[j] = 0.9 * moments[j] + 0.1 * g
                moments[j + 2] = 0.99 * moments[j + 2] + 0.01 * g * g
                p -= rate * (moments[j] / (1 - 0.9**step)) / (np.sqrt(moments[j + 2] / (1 - 0.99**step)) + 1e-8)
        return self


def training_line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A generated line and the spans of its secrets."""
    pick = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    small, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_, hexa = small + small.upper() + digit, digit + "abcdef"
    word = lambda: "".join(r.choice(("the", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st")) for _ in range(r.randint(1, 4)))
    secrets = (
        lambda: pick(any_, 20, 44), lambda: pick(any_ + "+/", 28, 64), lambda: pick(hexa, 24, 64), lambda: "ghp_" + pick(any_, 36, 36), lambda: "sk-" + pick(any_, 32, 48), lambda: "xoxb-" + pick(digit, 10, 12) + "-" + pick(any_, 24, 24),
        lambda: "eyJ" + pick(any_, 17, 30) + "." + pick(any_ + "-_", 30, 60) + "." + pick(any_ + "-_", 30, 43), lambda: "AKIA" + pick(small.upper() + digit, 16, 16), lambda: "AIza" + pick(any_ + "-_", 35, 35), lambda: pick(any_, 12, 18),
        lambda: pick(any_, 24, 32) + " " + pick(any_, 24, 32),
    )
    # what only a name beside it tells: passwords of letters, short ones and punctuated ones
    signs = "!@#$%^&*?+~"
    phrase = lambda: "".join(word() for _ in range(6))[: r.randint(14, 32)]
    signed = lambda: pick(any_, 1, 4) + r.choice(signs) + pick(any_ + signs, 3, 9) + r.choice(any_)
    short = (
        phrase, lambda: phrase().upper(), lambda: pick(small, 10, 24), lambda: pick(small.upper(), 10, 24), lambda: phrase().capitalize(), lambda: word() + pick(digit, 1, 4), lambda: word().capitalize() + pick(digit, 1, 4),
        lambda: pick(any_, 6, 11) + r.choice(digit), lambda: pick(small + digit, 6, 11) + r.choice(digit), signed, signed, signed, lambda: word().capitalize() + r.choice(signs) + pick(digit, 1, 4) + r.choice(small), lambda: word() + r.choice("@!$") + word() + pick(digit, 1, 3),
    )
    plain = (
        lambda: f"20{pick(digit, 2, 2)}-{pick(digit, 2, 2)}-{pick(digit, 2, 2)}", lambda: f"20{pick(digit, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{pick(digit, 2, 2)}:{pick(digit, 2, 2)}:{pick(digit, 2, 2)}", lambda: ".".join(pick(digit, 1, 3) for _ in range(4)),
        lambda: f"{word()}{pick(digit, 1, 3)}.{word()}@mail{pick(digit, 1, 2)}.example.com", lambda: f"http://{word()}{r.randint(1, 9)}.example.org/{word()}/{pick(digit, 2, 4)}?page={r.randint(1, 9)}", lambda: f"+{r.randint(1, 99)}-{pick(digit, 3, 3)}-{pick(digit, 3, 4)}-{pick(digit, 4, 4)}",
        lambda: pick(digit, 8, 16), lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-beta{r.randint(1, 9)}", lambda: word() + word().capitalize() + word().capitalize(), lambda: f"{word()}_{word()}_{pick(digit, 1, 4)}", lambda: word().upper() + "-" + pick(digit, 3, 5),
        lambda: f"/usr/lib/{word()}{r.randint(1, 9)}/{word()}{word()}/{word()}.py", lambda: word() + word() + word() + str(r.randint(0, 99)), lambda: f"{pick(digit, 3, 3)}-{pick(digit, 2, 2)}-{pick(digit, 4, 4)}", lambda: "-".join(pick(digit, 4, 4) for _ in range(4)), lambda: f"{pick(digit, 1, 3)},{pick(digit, 3, 3)}.{pick(digit, 2, 2)}EUR",
        lambda: word().capitalize() + word() + "." + word().capitalize() + word(), lambda: f"{pick(hexa, 8, 8)}-{pick(hexa, 4, 4)}-{pick(hexa, 4, 4)}-{pick(hexa, 4, 4)}-{pick(hexa, 12, 12)}",
    )
    out, spans, at = [], [], 0
    said = lambda: r.choice((word, word, word, word, lambda: word().capitalize(), lambda: word().upper(), lambda: word() + r.choice(",.;:!?"), lambda: word() + r.choice("-'/_") + word(), lambda: word() + word(), lambda: f"({word()})", lambda: f'"{word()}"', lambda: pick(digit, 1, 6), lambda: pick("éèüößçñ漢字日本" + small, 3, 12), lambda: pick("#*$%&|<>", 1, 4)))()
    for _ in range(r.randint(2, 9)):
        out.append(said())
    for _ in range(r.randint(1, 3)):
        x = r.random()
        if x < 0.2:
            lead, s = r.choice(("password is ", "password: ", "Password: ", "password=", "pwd=", "pwd: ", "PASSWORD=", "passwd = ", "passphrase: ", "the password was ", 'password="', "secret: ", "secret=")), r.choice(short)()
            out.append(("mark", lead, s))
        elif x < 0.28:
            out.append((r.choice(("password is ", "the password was ", "secret is ", "key is ", "token ", "the key ", "password ", "password: ", "key: ", "secret ", "private ", "auth ")), r.choice((word, word, lambda: word() + word()[:3]))()))
        elif x < 0.6:
            s = r.choice(secrets)()
            lead = r.choice(("", "", "key ", "token: ", "api key = ", "PRIVATE_KEY=", 'secret: "', "Authorization: Bearer ", "password is ", "pwd="))
            if len(s) < 20 and not lead:
                lead = "password is "
            out.append(("mark", lead, s))
        else:
            out.append((r.choice(("", "", "on ", "id ", "see ", "to: ", "=")), r.choice(plain)()))
        out += [said() for _ in range(r.randint(0, 5))]
    text = ""
    for part in out:
        text += " " if text else ""
        if isinstance(part, str):
            text += part
        elif len(part) == 2:
            text += part[0] + part[1]
        else:
            at = len(text) + len(part[1])
            spans.append((at, at + len(part[2])))
            text += part[1] + part[2] + ('"' if part[1].endswith('"') else "")
    return text + r.choice((".", "", "\n", ",")), spans


@lru_cache(maxsize=2)
def train(lines: int = TRAINING_LINES, seed: int = 7) -> Crf:
    """The model, the same whenever and wherever it is trained."""
    r = random.Random(seed)
    made = [training_line(r) for _ in range(lines)]
    tokens, x = features([text for text, _ in made])
    labels = np.zeros(len(tokens.start), np.int64)
    for d, (_, spans) in enumerate(made):
        for a, b in spans:
            held = np.flatnonzero((tokens.doc == d) & (tokens.start >= tokens.base[d] + a) & (tokens.end <= tokens.base[d] + b))
            labels[held] = I
            labels[held[:1]] = B
    cuts = [0, *(np.flatnonzero(np.diff(tokens.doc)) + 1).tolist(), len(labels)]
    return Crf().fit([(x[i:j], labels[i:j].tolist()) for i, j in zip(cuts, cuts[1:])])


def added_spans(tokens: Tokens, crf: Crf, names: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The CRF's spans in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in tokens.texts]
    if not len(tokens.start):
        return out
    e = crf.emissions(tokens, names)
    for first, upto in crf.open_runs(e, tokens.doc):
        d, start, end = int(tokens.doc[first]), None, None
        spans = zip((tokens.start[first:upto] - tokens.base[d]).tolist(), (tokens.end[first:upto] - tokens.base[d]).tolist())
        for (a, b), label in [*zip(spans, crf.best(e[first:upto])), ((0, 0), O)]:
            if label != I and start is not None:
                out[d].append((start, end, 3))
                start = None
            if label == B:
                start = a
            end = b
    return out


def scan(texts: list[str], crf: Crf) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text; the CRF's spans inside a base span are left out."""
    low = [t.lower() for t in texts]
    bases = list(map(base_spans, texts, low))
    added = added_spans(Tokens(texts), crf, np.fromiter(map(names_secrets, texts, low), bool, len(texts)))
    kept = [[s for s in more if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)] for base, more in zip(bases, added)]
    return [(base, sorted([*base, *more], key=lambda s: (s[0], s[2])) if more else base) for base, more in zip(bases, kept)]


def scan_all(texts: Iterable[str], crf: Crf) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """``scan``, for about ``BLOCK_CHARS`` characters at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield from scan(held, crf)
            held, size = [], 0
    if held:
        yield from scan(held, crf)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None, redacted: bool = False, passing: tuple[str, ...] = ()) -> DataFrame:
    """Scan each whole text, without a shuffle.

    Returns ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_crf,
    the ``passing`` columns unchanged (one with the name of a result column is
    left out) and, with ``redacted``, redacted (the text without its secrets;
    null stays null).  Spans are kind:start:end in code points, by start and
    then kind.
    Null and empty texts have none.  Repeated rows each give a row, null ids
    stay null, other columns are not read, an empty table gives none.
    """
    crf = model or train()
    passing = tuple(c for c in passing if c not in (id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "redacted"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long" + ", redacted string" * redacted
    schema += "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in passing)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = column(batch, text_col).to_pylist()
            for text, (base, spans) in zip(texts, scan_all((t or "" for t in texts), crf)):
                n = [sum(k == j for _, _, k in spans) for j in range(4)]
                row = [*n[:3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n[3]]
                rows.append([*row, redact(text, spans) if spans else text] if redacted else row)
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", *["redacted"] * redacted]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = {"base_sha256": pa.string(), "spans": pa.string(), "redacted": pa.string()}
            yield pa.RecordBatch.from_pydict({id_col: column(batch, id_col)} | {c: pa.array(list(v), kinds.get(c, pa.int64())) for c, v in zip(names, cols)} | {c: column(batch, c) for c in passing})

    return docs.select(*dict.fromkeys([id_col, text_col, *passing])).mapInArrow(run, schema)
