"""Small documents with every awkward case, and brute-force versions of the operators."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(seed=1, n=60):
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "naïve", "straße", "日本", "x1", "42", "don't", "!!", "a|b", "it's", " nb", "é"] + [f"w{i}" for i in range(60)]
    passage = " ".join(r.choices(vocab, k=40))
    out = []
    for i in range(n):
        text = " ".join(r.choices(vocab, k=r.randint(0, 90)))
        if i % 4 == 0:
            text = f"{text} {passage}\n{text}"
        if i % 9 == 0 and out:
            text = out[r.randrange(len(out))][1]
        if i % 11 == 0 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            text = " ".join(w[:-1] + ["changed"])
        out.append((i * 3 + 1, text))
    out += [(500, None), (501, ""), (502, None), (503, "one"), (504, "one"), (505, " \n\t "), (506, "a a a a " * 30), (507, "line\nline\nline\n\n"), (508, "long " + "b" * 3000 + " " + "cd" * 900)]
    out += [(509, passage), (510, passage + " end"), (510, passage + " end"), (None, passage), (None, None), (511, "<|endoftext|> in the text <|endoftext|>"), (512, " ".join(f"u{i}" for i in range(4000)))]
    r.shuffle(out)
    return out


def frame(spark, rows, kind="long"):
    """With columns whose names clash with the operators' own."""
    wide = [(i, t, "en", "src", len(t or ""), 7, "x") for i, t in rows]
    return spark.createDataFrame(wide, f"doc_id {kind}, text string, lang string, source string, n_chars long, n_tokens int, bucket string").repartition(3)


def repeated(text, n):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    held = set()
    for i in range(len(w) - n + 1):
        if grams[tuple(w[i : i + n])] > 1:
            held |= set(range(i, i + n))
    return w, held


def classes(rows, threshold=0.8, size=5):
    """Class of each id by comparing all pairs of documents."""
    bags = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            bags.setdefault(i, []).append((t or "", collections.Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else collections.Counter()))
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b):
                for ta, x in bags[a]:
                    for tb, y in bags[b]:
                        least, most = sum((x & y).values()), sum((x | y).values())
                        if ta == tb or (least / most if most else 1.0) >= threshold:
                            ra, rb = sorted((root(a), root(b)))
                            parent[rb] = ra
    return {i: root(i) for i in ids}


def kept_words(rows, window=13):
    """For each row, its words' masks after taking out repeats of documents with smaller ids."""
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        mask = [True] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    mask[k : k + window] = [False] * window
        out.append((i, w, mask))
    return out
