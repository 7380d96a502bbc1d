"""Collocations: phrases whose words come together far more often than apart.

All 1- to max_words-grams that can reach the least count leave the tasks as
DataFrame rows and are counted by hash aggregation.  A gram is never more frequent than the grams within it, so they
go by size: words; pairs of frequent words; longer grams of frequent pairs.
These passes count 40-bit hashes, whose sums can only be too high; what reaches
the least count travels as a bitmap of fixed size to the last pass, which has a
row for every occurrence of a gram and counts the grams themselves.  A false hit costs a row that this count drops,
and no frequent gram is missed at any size of the table.

Prefix and suffix counts of every cut are joined to the candidates, scores are
decimal, phrases that a one-word extension explains are dropped by an
anti-join, and a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, join_counted

#: What ends a piece of text, and what parts words within one (fixed values).
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
LINE, BLANK = 10, 32
TO_PLAIN = bytes.maketrans(PIECE_ENDS + BLANKS, b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
#: Bytes of text that are counted at a time.
CHUNK = 1 << 22
SCHEMA = "lang string, words int, gram binary, n long"
#: Bits of a gram's hash, and its multipliers (odd numbers).
HASH_BITS, MIX = 40, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bits of a row of Spark's bitmap functions.
ROW_BITS = 15


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word of the texts its number in a dictionary and that of its piece; the dictionary."""
    flat = np.frombuffer(b"\n".join(texts).lower().translate(TO_PLAIN), np.uint8)
    inside = np.concatenate([[False], (flat != LINE) & (flat != BLANK), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside[1:-1]])]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(flat == LINE)[starts], words.dictionary


def word_hashes(lang: str, dictionary: pa.Array) -> np.ndarray:
    """64 bits for each word of a language."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def gram_hashes(words: np.ndarray, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """HASH_BITS bits for each gram of `size` words that starts at the given words."""
    h = words[ids[at]]
    for j in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * MIX[0] + words[ids[at + j]] * MIX[1]
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << HASH_BITS) - 1)


def frequent(hashes: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    """Whether each hash's bit is set; all are where there is no bitmap."""
    if bitmap is None:
        return np.ones(len(hashes), bool)
    slots = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def spelled(dictionary: pa.Array, ids: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The grams of `size` words that start at the given words."""
    return pc.binary_join_element_wise(*[dictionary.take(pa.array(ids[at + j])) for j in range(size)], b" ")


def counted_grams(ids: np.ndarray, piece: np.ndarray, words: np.ndarray, sizes: range, bitmap: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, first word, hash, count) of the distinct grams of some words; longer ones only where all words and pairs within are frequent.

    ids, piece: see split_words; words: hashes of the dictionary.  Grams are
    told apart by their words' numbers, not by hashes.
    """
    places = np.zeros(len(words), np.int64)
    places[ids[::-1]] = np.arange(len(ids))[::-1]
    single = gram_hashes(words, ids, places, 1)
    if 1 in sizes:
        yield 1, places, single, np.bincount(ids, minlength=len(words))
    if sizes[-1] == 1:
        return
    known = frequent(single, bitmap)
    at = np.flatnonzero((piece[1:] == piece[:-1]) & known[ids[1:]] & known[ids[:-1]])
    _, first, pair_of, counts = np.unique(ids[at] * len(words) + ids[at + 1], return_index=True, return_inverse=True, return_counts=True)
    hashes = gram_hashes(words, ids, at[first], 2)
    if 2 in sizes:
        yield 2, at[first], hashes, counts
    if sizes[-1] == 2 or not len(at):
        return
    known = frequent(hashes, bitmap)
    pair = np.full(len(ids), -1)  # the frequent pair that starts at a word
    pair[at] = np.where(known[pair_of], pair_of, -1)
    gram, at = pair, np.flatnonzero(pair >= 0)
    for size in range(3, sizes[-1] + 1):
        at = at[at + size - 1 < len(ids)]
        at = at[pair[at + size - 2] >= 0]
        _, first, gram_of, counts = np.unique(gram[at] * len(hashes) + pair[at + size - 2], return_index=True, return_inverse=True, return_counts=True)
        if len(at):
            yield size, at[first], gram_hashes(words, ids, at[first], size), counts
        gram = np.full(len(ids), -1)
        gram[at] = gram_of


def runs_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of at most about CHUNK bytes, of batches (_lang, _text)."""
    for batch in batches:
        order = pc.sort_indices(batch.column(0))
        langs, texts, at = batch.column(0).take(order).to_pylist(), batch.column(1), 0
        while at < len(langs):
            lang, held, size = langs[at], [], 0
            while at < len(langs) and langs[at] == lang and (not held or size < CHUNK):
                held.append(texts[order[at].as_py()].as_py())
                size += len(held[-1])
                at += 1
            yield lang, held


def frequent_hashes(texts: DataFrame, sizes: range, min_count: int, known: Broadcast | None) -> DataFrame:
    """(h): hashes of grams of the given sizes that come to min_count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value if known is not None else None
        for lang, held in runs_of_texts(batches):
            ids, piece, dictionary = split_words(held)
            if len(ids):
                for size, _, hashes, counts in counted_grams(ids, piece, word_hashes(lang, dictionary), sizes, bitmap):
                    if size in sizes:
                        yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).select("h")


def frequent_grams(texts: DataFrame, max_words: int, min_count: int, known: Broadcast) -> DataFrame:
    """(lang, words, gram, n) of all grams with n >= min_count; with words, the number of all of them as the gram of no word.

    Every occurrence is a row, which Spark counts within its task before
    anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for lang, held in runs_of_texts(batches):
            ids, piece, dictionary = split_words(held)
            if not len(ids):
                continue
            found = [(0, pa.array([b""], pa.binary()), np.array([len(ids)]))]
            for size, at, hashes, counts in counted_grams(ids, piece, word_hashes(lang, dictionary), range(1, max_words + 1), bitmap):
                keep = frequent(hashes, bitmap)
                each = np.repeat(np.arange(np.count_nonzero(keep)), counts[keep])
                found.append((size, spelled(dictionary, ids, at[keep], size).take(pa.array(each)), np.ones(len(each), np.int64)))
            for words, grams, counts in found:
                n = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, words, np.int32)), grams, pa.array(counts.astype(np.int64))], ["lang", "words", "gram", "n"])

    rows = texts.mapInArrow(run, SCHEMA)
    return checkpoint(rows.groupBy("lang", "words", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The lowest bits of all hashes (h) as a bitmap of 2^bits bits, which tasks make and the driver only lays side by side."""
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    found = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND((1 << ROW_BITS) - 1)).alias("bits"))
    out = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row in found.collect():
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.ravel()


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5, filter_bits: int = 26) -> DataFrame:
    """(lang, words, gram, n) of all phrases of 1 to max_words words with n >= min_count, and the number of all words as the gram of no word.

    Null languages count as `und`; null and empty texts hold no words; texts of
    any length are read whole, and repeated rows count each.  A phrase never
    crosses the end of a piece.  filter_bits: log2 of the bits that say which
    words and pairs are frequent, 15 at least; fewer cost time, never a phrase.
    """
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).cast("binary").alias("_text"))
    sc = docs.sparkSession.sparkContext
    bitmap = bitmap_of(frequent_hashes(texts, range(1, 2), min_count, None), filter_bits)
    for sizes in (range(2, 3), range(3, max_words + 1)):
        if sizes and sizes[-1] <= max_words:
            bitmap = bitmap | bitmap_of(frequent_hashes(texts, sizes, min_count, sc.broadcast(bitmap)), filter_bits)
    return frequent_grams(texts, max_words, min_count, sc.broadcast(bitmap)).withColumn("gram", F.col("gram").cast("string"))


def collocations(counts: DataFrame, max_words: int = 5, top: int | None = 2000, inside_percent: int = 100) -> DataFrame:
    """The best phrases of every language of counts (see phrase_counts, with the same max_words): lang, rank, phrase, a, l, r, n, score and cut.

    a: count of the phrase; l, r: counts of its first `cut` words and of the
    rest; n: words of the language; score: floor(1000 * a * n / (l * r)) at the
    cut where that is lowest, of equal ones the first.  Phrases that lie within
    a longer one which has inside_percent of their count are dropped: then one
    of the extensions by one word on the way to it has so much as well.  Ties go
    by count, then by the phrase's bytes; top=None ranks all.
    """
    phrases = counts.filter("words >= 2")
    words = F.split("gram", " ")
    # The most frequent extension of every phrase by one word.
    ends = phrases.filter("words >= 3").select("lang", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("gram"), "n")
    longer = ends.groupBy("lang", "gram").agg(F.max("n").alias("longest"))
    same = (phrases["lang"] == longer["lang"]) & (phrases["gram"] == longer["gram"])
    left = checkpoint(phrases.join(longer, same & (100 * longer["longest"] >= inside_percent * phrases["n"]), "left_anti"))
    # Each cut asks for two counts; a word may begin or end very many phrases.
    asked = left.withColumn("_w", F.split("gram", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    sides = F.inline(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"))))
    asked = asked.select("lang", "gram", "n", "k", sides).withColumn("key", F.struct("lang", F.col("part").alias("gram"))).drop("part")
    wanted = asked.groupBy("key").agg(F.count("*").alias("n_rows"))
    parts = checkpoint(wanted.join(counts.select(F.struct("lang", "gram").alias("key"), F.col("n").alias("f")), "key"))
    answered = join_counted(asked, parts, "key").groupBy("lang", "gram").agg(
        F.max("n").alias("a"), *[F.max(F.when((F.col("k") == k) & (F.col("first") == side), F.col("f"))).alias(f"{c}{k}") for k in range(1, max_words) for side, c in ((True, "l"), (False, "r"))]
    )
    answered = checkpoint(answered)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("words_in_all")).join(answered.groupBy("lang").agg(F.count("*").alias("n_rows")), "lang")
    scored = join_counted(answered, checkpoint(totals), "lang").withColumnRenamed("words_in_all", "n")
    score = lambda k: F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0)) div (CAST(l{k} AS DECIMAL(16, 0)) * CAST(r{k} AS DECIMAL(16, 0)))")
    cuts = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)])
    lowest = scored.select("lang", "gram", "a", "n", F.array_min(cuts).alias("c"))  # nulls are skipped
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = lowest.select("lang", F.col("gram").alias("phrase"), "a", "c.l", "c.r", "n", "c.score", "c.cut").withColumn("rank", rank)
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
