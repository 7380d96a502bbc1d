"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, n_tokens), with a folder for
each tokenizer digest.  Rows whose digests it holds take the stored count; of
the others one row for each distinct content is encoded, and the new counts
are appended.  Texts are moved once, spread by id, and only those that are
encoded; everything else that is shuffled are digests.  Contents that very
many rows have meet their count by broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SHARE, checkpoint, fresh_dir, join_counted, ship, shipped, utf8_bytes

SCHEMA = "tokenizer string, content binary, n_tokens long"
#: The pre-tokenizer pattern of byte-level BPE files with use_regex (fixed value), in possessive form.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_encoding(spec: dict):
    """A tiktoken encoding equal to a plain byte-level BPE file, or None if the file is anything else."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor")
    added = spec.get("added_tokens", [])
    plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if not plain:
        return None
    import tiktoken

    special = {t["content"]: t["id"] for t in added}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made) or len(ranks) != 256 + len(pairs):
        return None  # ids don't follow the order of the merges, so they can't stand for ranks
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


def id_encoder(spec: str) -> Callable:
    """text -> ids (numpy uint32) of a tokenizers JSON file, without begin, end or added special tokens.

    Plain byte-level BPE runs on tiktoken with the file's own vocabulary, which
    gives the same ids some twenty times faster; other files on tokenizers.
    """
    import numpy as np

    fast = byte_level_encoding(json.loads(spec))
    if fast is not None:
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(spec)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def count_encoder(path: str, content: bytes) -> Callable[[str], int]:
    """text -> number of tokens, for a tokenizers .json or a sentencepiece .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda text: len(model.encode(text, num_threads=1))
    encode = id_encoder(content.decode("utf-8"))
    return lambda text: len(encode(text))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache; empty where its folder doesn't exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs' id with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file,
    read on the driver.  cache: folder of the cache, appended to; None: a new
    one in the shared folder.  Content is normalised by nothing but null to
    empty, as any more could change counts.  Very long texts are encoded whole.
    Repeated rows and ids are counted each, and encoded once.  Rows with a null
    id are counted as well.  Empty tables give no rows and store nothing.
    Other columns are not read, so their names don't matter.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        content = f.read()
    version = hashlib.sha256(content).hexdigest()
    sent = ship(spark, count_encoder, tokenizer, content)
    cache = cache or fresh_dir(spark, "token-cache")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.lit(1)).alias("_spread"), text.alias("_text")).withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    narrow = checkpoint(rows.select("_id", "_spread", "_digest", utf8_bytes(F.col("_text")).alias("n_bytes")))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select(F.col("content").alias("_digest"), "n_tokens")
    # One id stands for each missing content: that with the least hash; n_rows says how many rows have the content.
    per_id = narrow.groupBy("_digest", "_spread").agg(F.count("*").alias("n"))
    contents = checkpoint(per_id.groupBy("_digest").agg(F.min(F.struct("_spread", "n")).alias("one"), F.sum("n").alias("n_rows")))
    misses = checkpoint(contents.join(known, "_digest", "left_anti").select("_digest", "one._spread", F.col("one.n").alias("n_rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shipped(sent), set()
        for batch in batches:
            digests, counts = [], []
            for digest, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(count(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    texts = rows.select("_spread", "_digest", "_text")
    # Rows repeated under one id and content come to one task, which encodes the first.  Where they are many, Spark
    # keeps one of each task before anything moves; such contents number at most SHARE.
    repeated = F.broadcast(misses.filter(F.col("n_rows") * SHARE > (misses.agg(F.sum("n_rows")).first()[0] or 0)).filter("n_rows > 1").drop("n_rows"))
    chosen = texts.join(misses.drop("n_rows").join(repeated, ["_spread", "_digest"], "left_anti").hint("shuffle_hash"), ["_spread", "_digest"]).select("_digest", "_text")
    once = texts.join(repeated, ["_spread", "_digest"], "left_semi").groupBy("_digest").agg(F.first("_text").alias("_text"))
    new = chosen.unionByName(once).mapInArrow(run, "content binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)

    # Two runs that fill one cache at a time may store a content twice, with the same count.
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy(F.col("content").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens"))
    counts = checkpoint(contents.select("_digest", "n_rows").join(stored, "_digest"))
    return join_counted(narrow, counts, "_digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
