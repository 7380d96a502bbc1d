"""The operators against plain Python on small fixtures with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from cairn.llm import bpe, htmltext, langid, packing, quality, sharding, simhash, tokencount, topk, urlfilter
from pyspark.sql import functions as F

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PROSE = "the cat sat on the mat and looked at a bird that sang in the old tree near our house while rain fell on stones"
TEXTS = [None, "", " \n ", PROSE, PROSE, PROSE.upper(), PROSE + " today", "one two", "it's İstanbul <|endoftext|> 漢字 x", "a b c a b c a b c", "##### | %%% word", "x" * 3000 + " end", "line one\nline one\nother", PROSE * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(3, PROSE, 1, "clash"), (None, PROSE, 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, shard string").repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def naive_fingerprint(text):
    """The contract word for word, one bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    digests = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def test_simhash_links_like_brute_force(docs, empty):
    got = simhash.near_duplicates(docs, limit=4).collect()
    fp = {i: naive_fingerprint(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(got) == len(TEXTS) + 2
    for r in got:
        key = 3 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (f"{fp[key]:016x}", root[key])
    assert simhash.near_duplicates(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", *[f"shard AS {c}" for c in ("rep", "_fp", "_fp2", "own_fp", "_rep", "id", "Fp")])
    kept = simhash.keep_first(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted({root[i] for i in root})
    assert {tuple(r)[2:] for r in kept.collect()} == {("clash",) * 7}


def test_simhash_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    assert simhash.fingerprint(text) == naive_fingerprint(text)


@pytest.mark.parametrize("k", [1, 2, 4, 7])
def test_every_pair_within_the_budget_shares_a_trie(k):
    rng = np.random.default_rng(k)
    for _ in range(300):
        bits = rng.choice(64, k, replace=False)
        inside = [sum((b - simhash.STARTS[t]) % 64 < simhash.WIDTHS[t] for b in bits) <= simhash.budget_at(t, 0, k) for t in range(simhash.TRIES)]
        assert any(inside)


def test_trie_walk_finds_all_links(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(4):
        keys = np.append(keys, keys[rng.integers(0, len(keys), 60)] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    keys = np.unique(keys)
    parent = np.arange(len(keys))
    simhash.merge_roots(parent, *np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4))
    fps = spark.createDataFrame([(int(i), int(k)) for i, k in enumerate(keys.view(np.int64))], "rep long, fp long")
    found = dict(simhash.components(simhash.hamming_forest(fps, 4, limit=16)).collect())
    assert [found.get(i, i) for i in range(len(keys))] == parent.tolist()


def test_quality_rules(docs, empty):
    row = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        words = (t or "").split()
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        assert (row[i].n_words, row[i].word_chars, row[i].n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert row[i].base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (row[i].base_failed and row[i].kept)
    assert row[10].n_symbols == 9 and row[12].n_dup_lines == 1
    assert quality.judge(empty).count() == 0 and quality.keep(docs).columns == docs.columns


def test_quality_verdict_needs_no_certain_order(spark):
    good = " ".join(f"word{i % 70}x{i}" for i in range(120))
    texts = [good, good.upper(), " ".join(["12"] * 60 + [f"{i}a" for i in range(40)]), "\n".join(["the same line"] * 20 + [f"other line {i} of it" for i in range(16)]), good.replace(" ", " # "), " ".join(f"{i:020d}q" for i in range(60)), good + " a"]
    docs = spark.createDataFrame([(i, t, i, True) for i, t in enumerate(texts)] * 30, "doc_id long, text string, n_words int, kept boolean").repartition(5)
    want = {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    rules = quality.RULES
    for order in (rules, rules[::-1]):
        for rows in (1, 20, 10**6):
            assert {(r.doc_id, r.kept) for r in quality.judge(docs, rules=order, sample_rows=rows).collect()} == set(want.items())
    assert {r.doc_id for r in quality.keep(docs).collect()} == {0, 6} and quality.judge(docs).filter("kept AND n_words > 3").count() == 60
    # Costs and selectivities decide the order.
    stated = quality.order_rules(docs.select("text"), quality.base_failed(50, 50), sample_rows=10**6)
    assert [r.name for r in stated].index("symbols") < [r.name for r in stated].index("capitals")


def test_quality_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(1_000_000)) + " w0 w1 w2"
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words) == (1_000_003, 1_000_003) and row.base_failed and not row.kept


def test_language_id(spark, docs, empty):
    words = {"en": "the and of with that is for".split(), "de": "der und die mit von das nicht".split()}
    rows = [(i, " ".join(words[k][(i * j) % 7] for j in range(1, 40)), k) for i in range(60) for k in words]
    langs, prob = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the that is with of"), (2, "nicht das von der"), (3, None), (4, "123 !"), (5, "the of and that is " * 9 + "der und die nicht " * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(test, langs, prob).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "en"]
    assert got[3].score == 0 and set(got[5].shares) == {"en", "de"} and 0.5 < got[5].score < 1
    assert [r.doc_id for r in langid.keep_identified(test, langs, prob).orderBy("doc_id").collect()] == [1, 2, 5]
    assert {r.lang_pred for r in langid.predict(docs, [], np.zeros((langid.BUCKETS, 0))).collect()} == {"und"} and langid.predict(empty, langs, prob).count() == 0


def check_shards(rows, got, shards, largest):
    """Everything the contract says, from the rows alone."""
    size = {i: len((t or "").encode()) + 8 for i, t in rows}
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert all(r["size"] == size[r.doc_id] and 0 <= r.shard < shards for r in got)
    whole, load = sum(size[i] for i, _ in rows), Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert all(abs(load[s] - whole / shards) <= 2 * largest + 0.02 * whole / shards for s in range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def naive_identify(text, prob, penalty=3.0, rounds=20):
    """One document, one trigram at a time."""
    chars, was = [" "], " "
    for c in [*(text or "").lower(), " "]:
        c = c if unicodedata.category(c).startswith("L") else " "
        if (c, was) != (" ", " "):
            chars.append(c)
        was = c
    a, b, c = (int(x) for x in langid.MIX)
    seen = Counter()
    for x, y, z in zip(chars, chars[1:], chars[2:]):
        h = (ord(x) * a ^ ord(y) * b ^ ord(z) * c) & 0xFFFFFFFF
        seen[(h ^ h >> 15) % langid.BUCKETS] += 1
    if not seen:
        return {}
    n = sum(seen.values())

    def em(langs):
        pi = [1 / len(langs)] * len(langs)
        like = lambda: sum(k * math.log(sum(p * prob[g, m] for p, m in zip(pi, langs))) for g, k in seen.items())
        for _ in range(rounds):
            new = [sum(k * pi[j] * prob[g, m] / sum(p * prob[g, o] for p, o in zip(pi, langs)) for g, k in seen.items()) / n for j, m in enumerate(langs)]
            moved = max(abs(x - y) for x, y in zip(new, pi))
            pi = new
            if moved < 1e-3:
                break
        return pi, like()

    every = range(prob.shape[1])
    best = [max(every, key=lambda m: sum(k * math.log(prob[g, m]) for g, k in seen.items()))]
    pi, value = em(best)
    shares, _ = em(list(every))
    for m in sorted(every, key=lambda m: -shares[m]):
        if m not in best:
            trial, gain = em([*best, m])
            if gain - value <= penalty * math.log(n + 1):
                break
            best, pi, value = [*best, m], trial, gain
    return dict(zip(best, pi))


def test_language_id_equals_one_document_at_a_time(spark):
    rng = np.random.default_rng(1)
    sounds = {k: rng.choice(list("abcdefghijklmnopqrstuvwxyzéß漢"), (40, 3)) for k in ("aa", "bb", "cc", "dd")}
    make = lambda k, n: " ".join("".join(sounds[k][i]) for i in rng.integers(0, 40, n))
    langs, prob = langid.learn(spark.createDataFrame([(i, make(k, 60), k) for i in range(40) for k in sounds], "doc_id long, text string, lang string"))
    texts = [None, "", "12 ?!", "a", "aß", *(make(k, n) for k in sounds for n in (1, 2, 9, 80)), *(make(a, 30) + " 5; " + make(b, m) for a in sounds for b in sounds for m in (3, 12, 40)), " ".join(make(k, 20) for k in sounds), make("aa", 90_000) + make("bb", 20_000)]
    want = [naive_identify(t, prob) for t in texts]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), langs, prob).collect()
    for r in got:
        shares = {langs[k]: p for k, p in want[r.doc_id].items()}
        assert set(r.shares) == set(shares) and all(abs(r.shares[k] - p) < 1e-6 for k, p in shares.items())
        assert r.lang_pred == (max(sorted(shares), key=shares.get) if shares else "und") and abs(r.score - max(shares.values(), default=0)) < 1e-6
    # Batches cut otherwise give the same.
    one = np.concatenate([langid.identify([t], prob, np.log(prob), langid.letter_table()) for t in texts[:40]])
    assert np.allclose(one, langid.shares_of(texts[:40], prob, np.log(prob), langid.letter_table(), 3.0))


def test_letters_and_dirty_languages(spark):
    letters = langid.letter_table()
    assert all(letters[c] == (unicodedata.category(chr(c))[0] == "L") for c in (0x41, 0xD7B0, 0xD7FB, 0x32000, 0x323AF, 0x3130, 0x9FFF, 0x2FFFF, 0xE0041))
    assert langid.learn(spark.createDataFrame([(i, "text", str(i)) for i in range(9)], "doc_id long, text string, lang string"), max_languages=5)[0] == ["0", "1", "2", "3", "4"]


def test_sharding(spark, docs, empty):
    rows = [(i, "same" if i % 3 == 0 else None if i % 97 == 0 else (str(i) + "é") * (i % 50)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6, runs=2).collect()
    check_shards(rows, got, 6, 400)
    few = sharding.shard(docs, shards=24).collect()
    assert len(few) == len(TEXTS) + 2 and {r.doc_id: r["size"] for r in few}[0] == 8 and sharding.shard(empty).count() == 0


def test_sharding_cuts_repeated_rows(spark):
    rows = [(7, "again and again")] * 1500 + [(i, f"text {i} " * (i % 9)) for i in range(100, 800)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=5, runs=3).collect()
    check_shards(rows, got, 5, 80)
    assert len({r.shard for r in got if r.doc_id == 7}) > 2


def test_sharding_query(spark, tmp_path):
    from cairn.llm.queries import op4_sharding

    rows = [(i, None if i == 3 else f"tëxt {i % 40} " * (i % 30)) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op4_sharding(spark, f"file://{tmp_path}").collect()
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    assert len(got) == 600 and {r.shard for r in got} == set(range(24))


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vec = {i: rng.normal(size=6).round(2).tolist() for i in range(400)}
    vec[7] = vec[8] = vec[9] = vec[100]
    bad = {400: None, 401: [1.0, None], 402: [float("nan")] * 6}
    rows = [(i, v) for i, v in (vec | bad).items()] + [(9, vec[9])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=5, block=90, query_block=2, tasks=4).collect()
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vec.items()}
    for q in range(0, 400, 100):
        want = sorted((-int(whole[q] @ whole[i]), i) for i in [*vec, 9] if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("lists", [1, 3, 8])
def test_top_k_of_clustered_vectors_and_ties(spark, lists):
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(12, 16)) * 3
    vec = np.round(heart[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.3, 1)
    vec[:40] = vec[50]
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vec)], "vec_id long, embedding array<float>, cutoff string")
    got = topk.top_k(rows, F.col("vec_id") % 20 == 0, k=7, lists=lists, block=100, query_block=10, tasks=2).collect()
    whole = np.floor(1024 * vec.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 900, 20):
        score = whole @ whole[q]
        want = sorted((-int(score[i]), i) for i in range(900) if i != q)[:7]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_uniform_threshold_collects_what_suffices():
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(30, 32)) * 500
    for lists, v in ((4, heart[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 32)) * 20), (2, rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=(4000, 1)) * 2) * 100)):
        v = v.astype(np.int64)
        q, c, score = topk.Block(v[:50], np.arange(50), lists), topk.Block(v, np.arange(4000), lists), v[:50] @ v.T
        for cutoff in (np.partition(score.astype(float), -11, axis=1)[:, -11], np.full(50, np.nan), np.where(np.arange(50) % 2, -5.0, 1e300)):
            found, collected = topk.sufficient(q, c, cutoff)
            low = np.where(np.isnan(cutoff), -np.inf, cutoff)
            assert {(a, b, int(x)) for a, b, x in zip(*found)} == {(a, b, int(score[a, b])) for a, b in zip(*np.nonzero(score >= low[:, None]))}
            assert len(found[0]) <= collected <= score.size
        assert topk.sufficient(q, c, np.partition(score.astype(float), -11, axis=1)[:, -11])[1] < 0.4 * score.size


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e18, 2.0]), (2, [-1e300, 0.0]), (3, [3.0, 4.0]), (4, [5.0, 0.5]), (100, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3).collect()
    top, low = 2**63 - 1, -(2**63)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0] == [(1, top), (3, top), (4, top)]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 100] == [(0, top), (1, top), (3, 7 * 2**20)]
    assert low < 0


def test_url_filters(spark):
    want = {"http://WWW.Example.com/en/x?y": ("www.example.com/en/", "allow"), "https://a.example.com/en/": ("example.com/en/", "block"), "http://b.com": (None, "allow"), "http://b.com/q": ("com/", "allow"),
            "x://a.net/fr/1#z": ("net/fr/", "block"), "nothing": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://notexample.com/en/": ("com/", "allow")}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*want, "x://a.net/fr/1#z"])], "page_id long, url string, host string")
    for limit in (0, 100):
        got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark), broadcast_rules=limit).collect()
        assert len(got) == 10 and all((r.rule, r.verdict) == want[r.url] for r in got)
    odd = pages.selectExpr("page_id", "url", "host AS _best", "host AS `_url`", "host AS n_rows", "host AS short")
    got = urlfilter.judge_urls(odd, urlfilter.rule_table(spark))
    assert got.columns == [*odd.columns, "host", "path", "rule", "verdict"] and all((r.rule, r.verdict, r._best) == (*want[r.url], "clash") for r in got.collect())
    none = urlfilter.judge_urls(pages, urlfilter.rule_table(spark).filter("rule = ''"), default="block").collect()
    assert len(none) == 10 and {(r.rule, r.verdict) for r in none} == {(None, "block")}
    assert urlfilter.judge_urls(pages.filter("page_id < 0"), urlfilter.rule_table(spark)).count() == 0


def test_token_counts_and_cache(docs, empty, tmp_path):
    model = Tokenizer.from_file(BYTE)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = tokencount.count_tokens(docs, BYTE, cache, limit=20).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            t = PROSE if r.doc_id is None else TEXTS[r.doc_id] or ""
            n = len(model.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20)
    assert tokencount.read_cache(docs.sparkSession, cache).count() == len({t or "" for t in TEXTS})
    assert tokencount.count_tokens(empty, BYTE).count() == 0


def test_rows_repeated_under_one_id_are_encoded_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, PROSE)] * 400 + [(i, PROSE) for i in range(50)] + [(None, None)] * 60, "doc_id long, text string").repartition(6)
    cache = f"file://{tmp_path}/cache"
    got = tokencount.count_tokens(docs, BYTE, cache)
    n = len(Tokenizer.from_file(BYTE).encode(PROSE, add_special_tokens=False).ids)
    assert {(r.doc_id is None, r.n_tokens) for r in got.collect()} == {(False, n), (True, 0)} and got.count() == 510
    assert spark.read.parquet(cache).count() == 2


def test_html_extraction(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now and save.</div>
    <article><h1>A title</h1><p>First   paragraph &amp; more words in it.<p>Short.</p><aside>Read also this one</aside></article><section id="comments"><p>I like it very much indeed</p></section><footer>&copy; me</footer></body></html>"""
    pages = spark.createDataFrame([(1, page, "clash"), (2, None, "c"), (3, "", "c"), (4, "<p", "c"), (1, page, "clash")], "page_id long, html string, text string")
    pages = pages.withColumns({c: F.lit("c") for c in ("_html", "page", "n_chars")})
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "_html", "page", "text", "n_chars"] and htmltext.extract(pages.filter("page_id < 0")).count() == 0
    got = got.collect()
    assert [r.text for r in got if r.page_id == 1] == ["A title\nFirst paragraph & more words in it.\nShort."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))


def test_bpe_round_trip(docs, empty):
    model = Tokenizer.from_file(WORD)
    for r in bpe.encode_and_decode(docs, WORD).collect():
        ids = model.encode(PROSE if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, model.decode(ids, skip_special_tokens=False))
    first = bpe.encode_and_decode(docs.filter("doc_id = 7"), WORD, digests=True).first()
    assert first.ids_sha256 == hashlib.sha256(" ".join(map(str, model.encode(TEXTS[7], add_special_tokens=False).ids)).encode()).hexdigest()
    assert bpe.encode_and_decode(empty, WORD).count() == 0


def test_packing_holds_every_id_once(docs, empty):
    model = Tokenizer.from_file(BYTE)
    own = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = packing.pack(own, BYTE, tiers=(16, 32, 64)).collect()
    for i, t in enumerate(TEXTS):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    odd = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        odd += at not in (16, 32, 64)
    assert odd <= 1 and packing.pack(docs, BYTE).filter("doc_id IS NULL").count() >= 1 and packing.pack(empty, BYTE).count() == 0
