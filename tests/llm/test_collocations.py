"""Collocations against plain counting, with whole numbers of any size."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations


def naive(docs, min_count, max_words, top):
    out = {}
    for lang in {x or "und" if x is None else x for _, x in docs}:
        counts, n = Counter(), 0
        for text, x in docs:
            if ("und" if x is None else x) == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    n += len(words)
                    counts.update(tuple(words[i : i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
        found = []
        frequent = {p: a for p, a in counts.items() if len(p) >= 2 and a >= min_count}
        for p, a in frequent.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (s, a, p, l, r, k) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n, -s, k)
    return out


@pytest.mark.parametrize("bits", [15, 18])
def test_against_plain_counting(spark, bits, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "new", "york", "city", "São", "漢", "a_b", "\x1cx", "it's", "zz", "q", "old"]
    texts = []
    for i in range(120):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(60))
        if i % 3 == 0:
            words[5:5] = ["in", "new", "york", "city"] * 2
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for w in words))
    docs = [(t, rng.choice(["en", "fr", "", None])) for t in texts] + [(None, "en"), ("", None), (" \n. ", "es"), (texts[3], "en"), (texts[3], "en"), ("new york " * 3000, "und")]
    frame = spark.createDataFrame(docs, "text string, lang string").withColumns({"words": F.lit(1), "gram": F.lit("x"), "n": F.lit(0), "rank": F.lit(0)}).repartition(3)
    counts = collocations.phrase_counts(frame, min_count=6, filter_bits=bits)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score, r.cut) for r in collocations.collocations(counts, top=25).collect()}
    want = naive(docs, 6, 5, 25)
    assert got == want and len(got) > 50


def test_large_numbers_are_exact(spark):
    a, l, r, n = 4_000_000_000_000, 9_000_000_000_001, 7_000_000_000_003, 1_000_000_000_000_007
    rows = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, words int, gram string, n long"), max_words=3).collect()
    assert [(x.score, x.l, x.r, x.cut) for x in got] == [(1000 * a * n // (l * r), l, r, 1)]


def test_empty_and_short(spark):
    frame = spark.createDataFrame([("one two one two", "en")], "text string, lang string")
    assert collocations.collocations(collocations.phrase_counts(frame.filter("lang = 'x'"))).count() == 0
    assert collocations.collocations(collocations.phrase_counts(frame)).count() == 0
    only = collocations.collocations(collocations.phrase_counts(frame, min_count=2, max_words=2), max_words=2, top=None).collect()
    assert [(x.phrase, x.a, x.score) for x in only] == [("one two", 2, 2000)]


def test_bitmap_finds_all_that_was_put_in(spark):
    grams = pa.array([f"word{i}".encode() for i in range(500)])
    hashes = lambda lang: collocations.gram_hashes(collocations.word_hashes(lang, grams), np.arange(500), np.arange(499), 2)
    bitmap = collocations.bitmap_of(spark.createDataFrame([(int(h),) for h in hashes("en")], "h long"), 16)
    assert collocations.frequent(hashes("en"), bitmap).all()
    assert np.unpackbits(bitmap).sum() <= 499 and collocations.frequent(hashes("fr"), bitmap).mean() < 0.1
