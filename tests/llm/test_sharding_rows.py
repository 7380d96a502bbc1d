"""Shards hold the documents themselves."""

from cairn.llm import sharding


def test_shards_carry_all_columns(spark):
    rows = [(i, None if i == 5 else f"text {i % 40} " * (i % 7), f"s{i}", "own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    out = sharding.shard(docs, shards=4, runs=2)
    assert out.columns == ["doc_id", "text", "source", "input_shard", "size", "shard", "slot"]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[:4] for r in got] == rows and all(r["size"] == 8 + len(r.text or "") for r in got)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_tasks_grow_with_bytes(spark):
    assert [sharding.runs_for(n, 24, 1 << 27) for n in (0, 10**9, 10**11, 10**13, 10**15)] == [1, 1, 32, 682, 682]
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(400)], "doc_id long, text string")
    for part_bytes in (1 << 27, 1 << 12):
        out = sharding.shard(docs, shards=3, part_bytes=part_bytes)
        rows = out.collect()
        for k in range(3):
            assert sorted(r.slot for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
        sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(3)]
        assert max(sizes) - min(sizes) < 1000
