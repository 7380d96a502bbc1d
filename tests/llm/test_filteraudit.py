"""The filter audit against a loop over every order and document."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from cairn.llm import filteraudit

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", "\n\t ", "one two", LONG, LONG.upper(), LONG + " 5%", "a b " * 80, "É" * 40 + " ÀB", "x|y", "word " * 99 + "end", LONG.replace(" ", "\n")]


def naive(docs, labels):
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        checks = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        marks = [x for x in labels if doc_id is not None and x[0] == doc_id]
        fails.append((lang or "", {f for f, bad in checks.items() if bad}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "mask": F.lit(9), "n": F.lit(7)})
    return d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


def test_every_order(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(TEXTS), rng.choice(["en", "fr", "", None])) for i in range(150)]
    docs += [docs[4], docs[4], docs[9], (None, LONG, "en"), (None, None, None), (3, LONG, "fr"), (3, "x|y", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1)]
    got = filteraudit.audit(filteraudit.mask_counts(*frames(spark, docs, labels))).collect()
    want = naive(docs, labels)
    assert len(got) == len(want) == 3 * 600
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want


def test_empty_tables(spark):
    docs, labels = frames(spark, [(1, "one", "en")], [(1, 1, 1)])
    assert filteraudit.audit(filteraudit.mask_counts(docs.filter("doc_id < 0"), labels)).count() == 0
    alone = filteraudit.audit(filteraudit.mask_counts(docs, labels.filter("doc_id < 0"))).filter("filter_order = 'ABCDE' AND step = 1").first()
    assert (alone.kept, alone.removed, alone.good_lost) == (0, 1, 0)


def test_survivors_of_three_filters(spark):
    rng = random.Random(5)
    counts = [("p", m, rng.randrange(50), rng.randrange(9), 0) for m in range(8) if m != 3]
    got = filteraudit.survivors(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), 3).first()
    assert got.n == [sum(c[2] for c in counts if not c[1] & s) for s in range(8)]
    assert got.good == [sum(c[3] for c in counts if not c[1] & s) for s in range(8)]
