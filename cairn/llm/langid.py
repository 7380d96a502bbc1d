"""Language identification as a mixture of languages, fitted by expectation-maximisation.

Every language has smoothed log-likelihoods of hashed letter trigrams, learnt
from labelled rows.  A document is a mixture of languages: EM estimates the
proportions from its trigram counts, and the set of languages grows while the
penalised likelihood does.  The documents of a batch lie in one flat array of
trigram counts and go through the rounds of EM together.  Whole texts are
read; only the training rows are a sample, bounded by a parameter per language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import local_table, ship, shipped, small

UNKNOWN = "und"
#: Trigrams are hashed into 2^16 buckets.
BUCKETS = 1 << 16
#: Multipliers of the trigram hash.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


#: Characters of texts, times languages, that go through EM together.
CHUNK = 1 << 19


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def hashed_trigrams(codes: np.ndarray) -> np.ndarray:
    mixed = (codes[:-2] * MIX[0]) ^ (codes[1:-1] * MIX[1]) ^ (codes[2:] * MIX[2])
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def trigrams(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct letter trigrams of every text, by text; each text is padded with a space, and what is no letter is one."""
    padded = [f" {(t or '').lower()} " for t in texts]
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(32))
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    whole = of[2:] == of[:-2]
    if len(texts) == 1 and len(codes) > 4 * BUCKETS:  # cheaper than sorting
        counts = np.zeros(BUCKETS, np.int64)
        for i in range(0, len(codes) - 2, CHUNK):
            counts += np.bincount(hashed_trigrams(codes[i : i + CHUNK + 2]), minlength=BUCKETS)
        found = np.flatnonzero(counts)
        return np.zeros(len(found), np.int64), found, counts[found].astype(float)
    keys, counts = np.unique(of[:-2][whole] * BUCKETS + hashed_trigrams(codes)[whole], return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts.astype(float)


def chunks(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """texts in runs of at most `most` characters, or of one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "") + 2
    if run:
        yield run


def mixture(members: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, counts: np.ndarray, prob: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of each text's members (text, language) and its log-likelihood; sizes: its distinct trigrams, one at least."""
    n, size = members.shape
    pi, value = np.full((n, size), 1.0 / size), np.zeros(n)
    # One array for each member: whole arrays are multiplied and added up by text.
    like = [prob[bucket, np.repeat(members[:, j], sizes)] for j in range(size)]
    live, starts = np.arange(n), np.cumsum(sizes) - sizes
    total, active = np.add.reduceat(counts, starts), np.ones(n, bool)

    def mean_of(like: list[np.ndarray], shares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = like[0] * np.repeat(shares[:, 0], sizes)
        for j in range(1, size):
            out += like[j] * np.repeat(shares[:, j], sizes)
        return out

    for _ in range(rounds):
        ratio = counts / mean_of(like, pi[live], sizes)
        new = np.stack([np.add.reduceat(ratio * x, starts) for x in like], 1) * pi[live] / total[:, None]
        moved = np.abs(new - pi[live]).max(axis=1) >= 1e-3
        pi[live[active]] = new[active]
        active &= moved
        if not active.any():
            break
        if np.count_nonzero(active) < 0.7 * len(active):  # texts at rest leave now and then, with their likelihood
            stay = np.repeat(active, sizes)
            rest = ~stay
            gone = live[~active]
            logs = counts[rest] * np.log(mean_of([x[rest] for x in like], pi[gone], sizes[~active]))
            value[gone] = np.add.reduceat(logs, np.cumsum(sizes[~active]) - sizes[~active])
            like, counts = [x[stay] for x in like], counts[stay]
            live, total, sizes = live[active], total[active], sizes[active]
            starts, active = np.cumsum(sizes) - sizes, np.ones(len(live), bool)
    value[live] = np.add.reduceat(counts * np.log(mean_of(like, pi[live], sizes)), starts)
    return pi, value


def identify(texts: list[str | None], prob: np.ndarray, logp: np.ndarray, letters: np.ndarray, penalty: float = 3.0, rounds: int = 20) -> np.ndarray:
    """Proportions (text, language); a text without letters has none."""
    out = np.zeros((len(texts), prob.shape[1]))
    of, bucket, counts = trigrams(texts, letters)
    if not len(of) or not prob.shape[1]:
        return out
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rows, sizes = of[at], np.diff(np.append(at, len(of)))
    n, langs = len(rows), prob.shape[1]
    scores = np.stack([np.add.reduceat(counts * logp[bucket, k], at) for k in range(langs)], 1)
    members = np.argmax(scores, axis=1)[:, None]
    pi, value = np.ones((n, 1)), scores[np.arange(n), members[:, 0]]
    room = penalty * np.log(np.add.reduceat(counts, at) + 1)
    # The set grows by the languages that the full mixture finds, in order of their shares.
    shares, _ = mixture(np.tile(np.arange(langs), (n, 1)), sizes, bucket, counts, prob, rounds)
    order = np.argsort(-shares, axis=1, kind="stable")
    # The best single language is in the set already; the others keep their order.
    others = order[order != members].reshape(n, langs - 1)
    for k in range(langs - 1):
        trial = np.concatenate([members, others[:, k : k + 1]], axis=1)
        trial_pi, trial_value = mixture(trial, sizes, bucket, counts, prob, rounds)
        better = trial_value - value > room
        done = ~better
        out[np.repeat(rows[done], k + 1), members[done].ravel()] = pi[done].ravel()
        if not better.any():
            return out
        mine = np.repeat(better, sizes)
        bucket, counts, sizes, rows, others, room = bucket[mine], counts[mine], sizes[better], rows[better], others[better], room[better]
        members, pi, value = trial[better], trial_pi[better], trial_value[better]
    out[np.repeat(rows, members.shape[1]), members.ravel()] = pi.ravel()
    return out


def shares_of(texts: list[str | None], prob: np.ndarray, logp: np.ndarray, letters: np.ndarray, penalty: float) -> np.ndarray:
    """identify() in chunks of bounded size."""
    found = [identify(run, prob, logp, letters, penalty) for run in chunks(texts, CHUNK // max(4, prob.shape[1]))]
    return np.concatenate(found) if found else np.zeros((0, prob.shape[1]))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 1500, smoothing: float = 0.2, max_languages: int = 100) -> tuple[list[str], np.ndarray]:
    """Languages and P(bucket | language), from about docs_per_language labelled rows of each language.

    Rows are chosen by the hash of their id at the rate that gives this number
    in the mean; one counting pass finds the rates.  The max_languages values
    of the column with most rows are learnt (of equal ones the first in order),
    any others teach nothing and are never predicted; so the model has at most
    BUCKETS * max_languages numbers, whatever docs holds.  Null languages and
    texts teach nothing; no labelled row gives an empty model.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(max_languages).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    table = local_table(docs.sparkSession, [(k, i, min(1.0, docs_per_language / sizes[k])) for i, k in enumerate(langs)], "_lang string, _code int, _rate double")
    chance = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string")), 11) / float(1 << 53)
    sample = labelled.join(F.broadcast(table), "_lang").filter(chance < F.col("_rate")).select("_code", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = letter_table(), {}
        for batch in batches:
            own: dict[int, list[str]] = {}
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(code, []).append(text)
            for code, texts in own.items():
                for run in chunks(texts, CHUNK // 4):
                    _, found, counts = trigrams(run, letters)
                    sums[code] = sums.get(code, 0) + np.bincount(found, counts, BUCKETS)
        for code, counts in sums.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), code, np.int32)), pa.array(found, pa.int32()), pa.array(counts[found].astype(np.int64))], ["code", "bucket", "n"])

    counted = sample.mapInArrow(count, "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n")).toPandas()
    prob = np.full((BUCKETS, len(langs)), smoothing)
    prob[counted["bucket"].to_numpy(), counted["code"].to_numpy()] += counted["n"].to_numpy()
    return langs, prob / prob.sum(axis=0)


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """docs' id with lang_pred, score (the share of lang_pred) and shares (a map of the languages found).

    Texts that are null or have no letter are `und` with score 0, as are all
    texts where nothing could be learnt.  Very long texts are read whole; of
    tied shares the first language in order wins.  Repeated rows are judged
    each; empty tables give no rows.  Only the id and the text are read.
    """
    sent = ship(docs.sparkSession, lambda p: (letter_table(), p, np.log(p)), prob)
    names = np.array([*langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table, logs = shipped(sent)
        for batch in small(batches):
            shares = shares_of(batch.column(1).to_pylist(), table, logs, letters, penalty)
            none = ~shares.any(axis=1) if len(langs) else np.ones(len(shares), bool)
            top = np.where(none, len(langs), shares.argmax(axis=1) if len(langs) else 0)
            score = np.minimum(1.0, shares.max(axis=1)) if len(langs) else np.zeros(len(shares))
            at, lang = np.nonzero(shares)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(shares)))]).astype(np.int32)
            mixed = pa.MapArray.from_arrays(pa.array(ends), pa.array(names[lang], pa.string()), pa.array(shares[at, lang]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[top], pa.string()), pa.array(score), mixed], ["_id", "lang_pred", "score", "shares"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_id {kind}, lang_pred string, score double, shares map<string,double>").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, langs: list[str], prob: np.ndarray, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """The rows of docs, with all their columns, that predict() doesn't call `und`."""
    sent = ship(docs.sparkSession, lambda p: (letter_table(), p, np.log(p)), prob)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table, logs = shipped(sent)
        for batch in small(batches):
            yield batch.filter(pa.array(shares_of(batch.column(at).to_pylist(), table, logs, letters, penalty).any(axis=1), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows kept from training: crc32 of the id as text, modulo folds, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
