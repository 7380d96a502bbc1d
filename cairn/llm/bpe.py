"""BPE encoding and decoding with batched numpy merge rounds.

Texts of a batch lie in one flat array of characters, in which words are cut
by character classes.  The symbols of all distinct words lie in another one:
a round looks up neighbouring pairs by binary search over sorted pair keys,
finds the lowest rank in each word, and merges all its occurrences there;
words without a known pair leave.  Documents are then put together from their
words, ids and decoded text alike, by gathering slices.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ship, shipped
from cairn.llm.tokencount import byte_alphabet

#: Unicode white space, as the normalizer replaces it.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters whose lower case Python and a character-wise mapping give alike, and that are composed.
SIMPLE = re.compile("[\x00-įı-˿]*")
NONE = np.int32(np.iinfo(np.int32).max)
#: Characters of text that are put through one batch of merges: few enough for its arrays to stay in the CPU's cache.
BATCH_CHARS = 50_000
#: The word pattern that the character classes below stand for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, OTHER = range(4)
#: Multiplier of the word hash; equal hashes are compared byte by byte.
PRIME = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """BLANK, LETTER, DIGIT or OTHER for each code point, as the tokenizers library itself cuts a text of all of them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = "".join(map(chr, points.tolist()))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        for _, (start, stop) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[start:stop]] = kind
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start .. start + length - 1 of every slice, one after the other."""
    ends = np.cumsum(length, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((start - (ends - length)).astype(np.int32), length)


class WordBpe:
    """Encoder and decoder of a tokenizers BPE file whose pre-tokenizer cuts words out and maps bytes to characters."""

    def __init__(self, spec: str, classes: np.ndarray | None = None):
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]["pretokenizers"]
        if not (model["type"] == "BPE" and pre[0]["type"] == "Split" and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not data.get("decoder") and pre[0]["pattern"]["Regex"] == PATTERN):
            raise ValueError("only BPE files with this Split pattern, a ByteLevel pre-tokenizer and no decoder are read")
        self.classes = character_classes() if classes is None else classes
        self.spec, self.normalizer = spec, None
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.size = max(*vocab.values(), *self.special.values(), 0) + 1
        self.token = {i: t for t, i in (vocab | self.special).items()}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.sym = np.uint32 if self.size**2 < 1 << 32 else np.uint64
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], self.sym)
        made = np.array([vocab[a + b] for a, b in pairs], self.sym)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys, self.made = key[self.order], made[self.order]
        alphabet = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], self.sym)
        self.last = np.array([vocab[alphabet[b] + self.end] for b in range(256)], self.sym)
        # Digits and tokens, each followed by a space, for gathering.
        self.id_text = self.slices([str(i) for i in range(self.size)])
        self.token_text = self.slices([self.token.get(i, "") for i in range(self.size)])

    def normalize(self, text: str) -> str:
        if SIMPLE.fullmatch(text):
            return BLANKS.sub(" ", text).lower()
        if self.normalizer is None:
            from tokenizers import Tokenizer

            self.normalizer = Tokenizer.from_str(self.spec).normalizer
        return self.normalizer.normalize_str(text)

    @staticmethod
    def slices(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8") + b" " for t in texts]
        length = np.array([len(r) for r in raw], np.int32)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length, dtype=np.int32) - length, length

    def segments(self, text: str) -> list[str | int]:
        """Normalized text, and the ids of special strings."""
        if self.special_re is None or not self.special_re.search(text):
            return [self.normalize(text)]
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self.normalize(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self.normalize(text[at:])]

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word of a normalized text, in characters."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[codes]
        first = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))[: len(kind)]
        quote = np.flatnonzero((codes == ord("'")) & first)
        if len(quote):
            near = np.append(codes, [0, 0]).astype(np.uint32)
            a, b = near[quote + 1], near[quote + 2]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                three |= (a == ord(x)) & (b == ord(y))
            hit = two | three
            quote, size = quote[hit], np.where(three, 3, 2)[hit]
            first[quote + 1] = False
            after = quote + size
            first[after[after < len(first)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(codes))
        word = kind[start] != BLANK
        return start[word], end[word]

    def encode_words(self, byte: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words whose bytes follow each other, and the number of ids of each."""
        sym = self.inner[byte]
        stop = np.cumsum(length)
        sym[stop - 1] = self.last[byte[stop - 1]]
        of = np.repeat(np.arange(len(length), dtype=np.int32), length)
        done_of, done_sym = [], []
        rank, made = self.look_up(sym[:-1], sym[1:], of[:-1] == of[1:])
        rank, made = np.append(rank, NONE), np.append(made, made[:1] if len(made) else sym)
        while len(sym):
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            over = low == NONE
            done_of.append(of[over])
            done_sym.append(sym[over])
            hit = np.flatnonzero((rank == low) & ~over)
            keep = ~over
            if len(hit):
                # Of overlapping occurrences every other one merges, from the left.
                first = np.append(True, np.diff(hit) != 1)
                run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
                sym[hit] = made[hit]
                keep[hit + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[hit] = True
            sym, of, rank, made, moved = sym[keep], of[keep], rank[keep], made[keep], moved[keep]
            # Only the pairs beside a merged symbol are looked up again.
            again = np.flatnonzero(moved | np.append(moved[1:], False)) if len(sym) else hit[:0]
            inside = again[again + 1 < len(sym)]
            rank[inside], made[inside] = self.look_up(sym[inside], sym[inside + 1], of[inside] == of[inside + 1])
            if len(sym):
                rank[-1] = NONE
        if not done_of:
            return sym, np.zeros(0, np.int64)
        of, sym = np.concatenate(done_of), np.concatenate(done_sym)
        return sym[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(length))

    def look_up(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and result of pairs of symbols of the same word."""
        key = left * self.sym(self.size) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same, self.order[at], NONE), self.made[at]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        parts: list[str] = []
        special: list[tuple[int, int]] = []  # character position and id
        ends, at = [], 0
        for text in texts:
            for x in self.segments(text or ""):
                if isinstance(x, int):
                    special.append((at, x))
                    x = ""
                parts.append(x + " ")
                at += len(x) + 1
            ends.append(at)
        joined = "".join(parts)
        start, end = self.cut(joined)
        byte = np.frombuffer(joined.encode("utf-8"), np.uint8)
        lead = np.append(np.flatnonzero((byte & 0xC0) != 0x80), len(byte)).astype(np.int32)
        b0, size = lead[start], lead[end] - lead[start]
        flat = byte[ragged(b0, size)]
        if len(size):
            first = np.cumsum(size, dtype=np.int32) - size
            within = np.arange(len(flat), dtype=np.int32) - np.repeat(first, size)
            power = np.cumprod(np.full(int(size.max()), PRIME | 1, np.uint64), dtype=np.uint64)
            digest = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * power[within], first)
            _, rep, which = np.unique(digest, return_index=True, return_inverse=True)
            # Words that only share a hash with their representative stand for themselves.
            same = size[rep[which]] == size
            alike = flat == flat[np.minimum(np.repeat(first[rep[which]], size) + within, len(flat) - 1)]
            same &= np.logical_and.reduceat(alike, first)
            odd = np.flatnonzero(~same)
            which[odd] = len(rep) + np.arange(len(odd))
            rep = np.append(rep, odd)
            ids, count = self.encode_words(flat[ragged(first[rep], size[rep])], size[rep])
            origin = np.cumsum(count) - count
            n, out = count[which], ids[ragged(origin[which], count[which])]
        else:
            n, out = np.zeros(0, np.int64), np.zeros(0, self.sym)
        if special:
            place, extra = np.array(special).T
            before = np.searchsorted(start, place)  # words before each special string
            out = np.insert(out, np.append(0, np.cumsum(n))[before], extra)
            start, n = np.insert(start, before, place), np.insert(n, before, 1)
        until = np.append(0, np.cumsum(n))[np.searchsorted(start, np.array(ends, np.int64))]
        return out, np.diff(np.append(0, until))

    def join(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """For each text the table's slices of its ids, joined by spaces."""
        data, start, length = table
        size = length[ids]
        text = data[ragged(start[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]

    def run(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
        """(ids, ids joined by spaces, decoded text) of each text."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= BATCH_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            ids, count = self.encode_batch(texts[at:stop])
            yield from zip(np.split(ids, np.cumsum(count)[:-1]), self.join(self.id_text, ids, count), self.join(self.token_text, ids, count))
            at = stop


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """docs' id with n_tokens, ids (array of int) and decoded (text).

    digests: the SHA-256 of the ids joined by spaces, and of the decoded text,
    instead of themselves.  tokenizer: path of the file, read on the driver.
    Null and empty texts have no ids; texts of any length are encoded whole.
    Special strings in texts are their special ids.  Repeated rows, and rows
    with a null id, are encoded each; an empty table gives no rows.  Other
    columns are not read, so their names don't matter.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = ship(docs.sparkSession, WordBpe, f.read(), character_classes())
    sha = lambda s: hashlib.sha256(s).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(sent)
        for batch in batches:
            n, ids, decoded = [], [], []
            for own, joined, text in model.run(batch.column(1).to_pylist()):
                n.append(len(own))
                ids.append(sha(joined) if digests else own.tolist())
                decoded.append(sha(text) if digests else text.decode("utf-8"))
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())], names)

    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["_id", "n_tokens", "ids", "decoded"]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_id {kind}, n_tokens long, {names[2]} {'string' if digests else 'array<int>'}, {names[3]} string").withColumnRenamed("_id", id_col)
