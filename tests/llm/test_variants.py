"""Operator 11 against a brute-force version, also with long words and a short LONG."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from emporia.llm import spelling_variants

DOCS = "doc_id bigint, text string, word string, n int"


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = brute_words(rows)
    forms, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if x != w and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        forms[w] = form
        out[w] = (n, len(others), form, counts[form] if form else None)
    def root(w):
        return root(forms[w]) if forms[w] else w
    return {w: (forms[w], root(w), n, k, m) for w, (n, k, _, m) in out.items()}


def rows():
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    out = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = list(rng.choice(base[: rng.choice([1, 3, 12])]))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "Z", "ÿ"])
            words.append("".join(w))
        out.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    chain = ["w" * 9] * 2 + ["w" * 10] * 25 + ["w" * 11] * 400  # forms of forms
    out += [(1000 + i, w) for i, w in enumerate(chain)]
    out += [(None, "nullword nullword"), (5, None), (5, ""), (7, "repeated repeated"), (7, "repeated repeated"), (8, "ÀÉÎabc àéîabc ×÷÷××÷× ×÷÷××÷×")]
    long = "".join(rng.choice("xyz") for _ in range(3000))
    out += [(2000 + i, long) for i in range(30)] + [(2100 + i, long[:1500] + "q" + long[1500:]) for i in range(3)]
    out += [(2200 + i, long[:1500] + "q" + long[1501:]) for i in range(3)] + [(2300 + i, long[1:]) for i in range(30)]
    for size in (62, 63, 64, 65, 66, 67):  # on both sides of LONG
        out += [(3000 + size * 10 + i, "k" * size) for i in range(3 if size % 2 else 40)]
    return out


@pytest.mark.parametrize("long", [64, 8])
def test_variants_equal_brute_force(spark, long):
    data = rows()
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in data], DOCS)
    want = brute(data)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(df, long=long).collect()}
    assert got == want
    assert any(f and r != f for f, r, *_ in want.values()) and len(want) > 150
    assert spelling_variants.variants(df.limit(0)).count() == 0


def test_pieces_cut_no_run():
    text = "abc defghij é" * 50 + "x" * 300 + " end"
    parts = list(spelling_variants.pieces(text, 10))
    assert "".join(parts) == text and len(parts) > 20
    assert sorted(w for p in parts for w in re.findall("[A-Za-zé]+", p)) == sorted(re.findall("[A-Za-zé]+", text))


def test_groups_are_bounded_by_the_alphabet(spark):
    words = spark.createDataFrame([(f"abc{chr(97 + i)}defg", 2) for i in range(26)] + [("abcdefg", 3)], "word string, n bigint")
    turned = spelling_variants.rotations(words, 12345)
    assert turned.groupBy("key").count().agg({"count": "max"}).first()[0] <= 27
    got = {r.word: (r.n_near, r.best) for r in spelling_variants.near_words(words).collect()}
    assert got["abcdefg"] == (26, "abcadefg") and got["abcadefg"] == (26, "abcdefg")
