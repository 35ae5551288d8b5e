"""Documents with awkward cases, and plain-Python versions of the definitions."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size int, p string, q string, comp long, score double, dropped int, kept boolean, h long, __id long, line string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, size=5):
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def prose(n, seed):
    rng = random.Random(seed)
    syl = ["an", "be", "tion", "er", "ou", "re", "st", "wh", "ing", "és", "ü", "le", "on"]
    return " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    base = prose(120, 1)
    w = base.split()
    edited = " ".join([*w[:60], "changed", *w[61:]])
    far = " ".join(x if i % 4 else "other" for i, x in enumerate(w))
    texts = [None, "", " \n\t ", "one", "one two three", base, base, edited, base.upper(), far, "\n".join([base[:200], base[200:], base[:200]]), prose(20_000, 2), "12 34 !! %%", "a\x00b ﻿ ÉÈ 漢字 😀 " * 30]
    texts += [prose(60 + i, 100 + i) for i in range(12)] + ["\n".join([f"shared line of boiler plate text number seven {'x' * (i % 2)}", prose(70, 200 + i)]) for i in range(8)]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), -i, i, "p", "q", 7, 0.5, 3, True, i, i, "line") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base, "en", "s1", 1, 0, 0, "", "", 0, 0.0, 0, False, 0, 0, "")]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
