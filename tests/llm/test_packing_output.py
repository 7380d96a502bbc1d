"""Step groups of skewed mixes of lengths, and the ids of windows."""

from collections import Counter

import public_tokenizers
from cairn.llm import packing
from tokenizers import Tokenizer

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_step_groups_are_even(spark):
    tiers, step = (16, 32, 64), 512
    rows = [(i, "the cat sat on the mat " * (1 if i % 3 else 4 if i % 2 else 40)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = packing.pack(docs, BYTE, tiers=tiers, step_tokens=step).collect()
    ids, windows = Counter(), Counter({(r.tier, r.sequence_id, r.step_group): 1 for r in got})
    for r in got:
        ids[r.step_group] += r.length
    groups = -(-sum(ids.values()) // step)
    assert sorted(ids) == list(range(groups)) and groups > 20
    # The last window may be short.
    mean = sum(ids.values()) / groups
    assert max(ids.values()) < mean + sum(tiers) and min(ids.values()) > mean - sum(tiers) - max(tiers)
    for tier in tiers:
        share = Counter(g for t, _, g in windows if t == tier)
        assert max(share.values()) - min(share.get(g, 0) for g in range(groups)) <= 1
    assert len({(s, g) for _, s, g in windows}) == len({s for _, s, _ in windows})


def test_windows_carry_their_ids(spark):
    texts = {i: "the cat sat on the mat " * i for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3, "doc_id")
    got = packing.pack(docs, BYTE, tiers=(16, 32, 64)).collect()
    model = Tokenizer.from_file(BYTE)
    for i, text in texts.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert all(len(r.ids) == r.length for r in pieces)
        assert [x for r in pieces for x in r.ids] == [*model.encode(text, add_special_tokens=False).ids, 1]
