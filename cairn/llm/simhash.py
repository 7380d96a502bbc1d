"""SimHash near-duplicate detection by a binary trie self-join.

Fingerprints are 64-bit keys of a binary trie.  Node pairs of the trie are
walked together from the root; each step adds the bits in which the two
children differ and drops the pair once it is over the error budget.  The
upper trie is walked with DataFrame joins until a pair of subtrees holds few
enough fingerprints for one task; the rest of the walk is numpy in that task.

TRIES tries share the work.  The key is cut into as many parts, and budgets
are given to the parts that add up, plus one each, to one more than k: a pair
with at most k differing bits keeps at least one part's budget.  Trie i reads
the key from part i on, with that part's budget there and k beyond; so the
node pairs stay bounded by binomials of a third of a key and a small budget.

Subtrees are cut by the number of distinct fingerprints below them, so
groups of copies, however large, never meet in one task.  Tasks return
spanning forests, not all pairs; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import checkpoint, join_counted, small, unused

SEED = 42
BITS = 64
#: Where each trie's keys start, and how many bits its first part has.
STARTS, WIDTHS = (0, 22, 43), (22, 21, 21)
TRIES = len(STARTS)
#: Trie levels walked by one DataFrame step, and levels counted at once.
STEP, SPAN = 2, 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the XXH64 of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size) + np.arange(n)
    start = (end - size)[: n - shingle + 1].tolist()
    stop = end[shingle - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(start), 1 << 16):
        part = [digest(joined[a:b], SEED) for a, b in zip(start[i : i + (1 << 16)], stop[i : i + (1 << 16)])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * ones > len(start)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return kept.mapInArrow(run, "id long, fp long")


def budget_at(tree: int, depth: int, k: int) -> int:
    """Differing bits allowed in the first `depth` bits of a trie's keys; -1 if the trie isn't needed."""
    part = (k + 1) // TRIES + (tree < (k + 1) % TRIES) - 1
    return k if depth > WIDTHS[tree] and part >= 0 else part


def merge_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest index; every entry of parent is a root before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def walk(keys: np.ndarray, left: int, tree: int, depth: int, diff: int, k: int, chunk: int = 1 << 16, leaf: int = 64) -> np.ndarray:
    """Roots of the components that the linked pairs between two subtrees make.

    keys: unsigned keys of the first subtree, sorted, then, from `left` on,
    those of the second, sorted (none: the pair of the first with itself).
    """
    n = len(keys)
    parent = np.arange(n)
    same = left == n
    stack = [(depth, np.array([[0, left, 0 if same else left, n, diff]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        # Pairs of subtrees that lie in one component already can add nothing: dense groups are left after few compares.
        step = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
        alo, ahi, blo, bhi, _ = pairs.T
        pairs = pairs[(step[alo] != step[ahi - 1]) | (step[blo] != step[bhi - 1]) | (parent[alo] != parent[blo])]
        if not len(pairs):
            continue
        if len(pairs) > chunk:
            stack += [(depth, pairs[: len(pairs) // 2]), (depth, pairs[len(pairs) // 2 :])]
            continue
        alo, ahi, blo, bhi, d = pairs.T
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (depth == BITS)
        if small.any():
            s = pairs[small]
            na, nb = s[:, 1] - s[:, 0], s[:, 3] - s[:, 2]
            each = na * nb
            of = np.repeat(np.arange(len(s)), each)
            at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            i, j = s[of, 0] + at // nb[of], s[of, 2] + at % nb[of]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= k)
            merge_roots(parent, i[near], j[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        alo, ahi, blo, bhi, d = pairs.T
        bit = np.uint64(BITS - 1 - depth)
        above = ~np.uint64(0) << bit if depth else np.uint64(0)
        one = np.uint64(1) << bit
        high = above & ~one

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            first = keys[lo]
            edge = (first & high) | one
            mid = np.searchsorted(keys[:left], edge)
            if not same:
                second = lo >= left
                mid = np.where(second, left + np.searchsorted(keys[left:], edge), mid)
            return np.clip(mid, lo, hi)

        amid, bmid = split(alo, ahi), split(blo, bhi)
        own = (alo == blo) & (ahi == bhi)
        child = [
            np.stack([alo, amid, blo, bmid, d], 1),
            np.stack([amid, ahi, bmid, bhi, d], 1),
            np.stack([alo, amid, bmid, bhi, d + 1], 1),
            np.stack([amid, ahi, blo, bmid, d + 1], 1)[~own],
        ]
        child = np.concatenate(child)
        allowed = budget_at(tree, depth + 1, k)
        child = child[(child[:, 1] > child[:, 0]) & (child[:, 3] > child[:, 2]) & (child[:, 4] <= allowed)]
        if len(child):
            stack.append((depth + 1, child))
    return parent


def subtree_pairs(keys: DataFrame, k: int, limit: int) -> tuple[DataFrame, list[int]]:
    """Walk node pairs from the root until each holds at most `limit` fingerprints.

    keys: (tree, key).  Returns (tree, depth, p, q, diff) and the depths used.
    """
    spark = keys.sparkSession
    prefix = lambda c, d: F.shiftrightunsigned(c, BITS - d) if d else F.lit(0).cast("long")
    n = keys.groupBy("tree").count()
    level = checkpoint(
        n.select("tree", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("diff"), F.col("count").alias("n"))
    )
    done, depths, depth, live, base = [level.filter(F.col("n") <= limit)], [0], 0, keys, None
    big = level.filter(F.col("n") > limit)
    while depth < BITS and not big.isEmpty():
        if depth % SPAN == 0:
            if depth:
                hot = big.select("tree", F.col("p").alias("node")).union(big.select("tree", F.col("q").alias("node"))).distinct()
                live = live.withColumn("node", prefix(F.col("key"), depth)).join(hot, ["tree", "node"], "left_semi").select("tree", "key")
            base = checkpoint(live.groupBy("tree", prefix(F.col("key"), depth + SPAN).alias("node")).agg(F.count("*").alias("n")))
            base_depth = depth + SPAN
        depth += STEP
        nodes = base.groupBy("tree", F.shiftrightunsigned("node", base_depth - depth).alias("node")).agg(F.sum("n").alias("n"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("node", STEP))
        a = nodes.select("tree", F.col("up").alias("p"), F.col("node").alias("cp"), F.col("n").alias("np"))
        b = nodes.select("tree", F.col("up").alias("q"), F.col("node").alias("cq"), F.col("n").alias("nq"))
        allowed = F.element_at(F.array(*[F.lit(budget_at(t, depth, k)) for t in range(TRIES)]), F.col("tree") + 1)
        level = checkpoint(
            big.select("tree", "p", "q", "diff")
            .join(a, ["tree", "p"])
            .join(b, ["tree", "q"])
            .withColumn("diff", F.col("diff") + F.bit_count(F.col("cp").bitwiseXOR(F.col("cq")).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))))
            .filter((F.col("diff") <= allowed) & ((F.col("p") != F.col("q")) | (F.col("cp") <= F.col("cq"))))
            .select("tree", F.lit(depth).alias("depth"), F.col("cp").alias("p"), F.col("cq").alias("q"), "diff", F.when(F.col("cp") == F.col("cq"), F.col("np")).otherwise(F.col("np") + F.col("nq")).alias("n"))
        )
        small = (F.col("n") <= limit) | F.lit(depth == BITS)
        done.append(level.filter(small))
        depths.append(depth)
        big = level.filter(~small)
    items = done[0]
    for x in done[1:]:
        items = items.unionByName(x)
    items = items.drop("n")
    used = sorted(r[0] for r in items.select("depth").distinct().collect())
    return items, used or [0]


def hamming_forest(fps: DataFrame, k: int = 4, limit: int = 32768) -> DataFrame:
    """Edges (u, v), v < u, that connect exactly the fingerprints linked at k or fewer differing bits.

    fps: (rep, fp), fp distinct and rep a distinct long for each.
    """
    turned = [F.shiftleft("fp", b).bitwiseOR(F.shiftrightunsigned("fp", BITS - b)) if b else F.col("fp") for b in STARTS]
    needed = F.array(*[F.struct(F.lit(t).alias("tree"), key.alias("key")) for t, key in enumerate(turned) if budget_at(t, 0, k) >= 0])
    keys = fps.select("rep", F.inline(needed))
    items, depths = subtree_pairs(keys.select("tree", "key"), k, limit)
    sides = items.withColumn("node", F.explode(F.array_distinct(F.array("p", "q"))))
    at = [F.struct(F.lit(d).alias("depth"), (F.shiftrightunsigned("key", BITS - d) if d else F.lit(0).cast("long")).alias("node")) for d in depths]
    placed = keys.select("tree", "key", "rep", F.inline(F.array(*at)))
    work = placed.join(sides, ["tree", "depth", "node"]).select("tree", "depth", "p", "q", "diff", "key", "rep")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tree, depth, p, q, diff = (int(x) for x in part.iloc[0, :5])
        key = part["key"].to_numpy(np.int64).view(np.uint64)
        rep = part["rep"].to_numpy(np.int64)
        first = np.ones(len(key), bool) if p == q else (key >> np.uint64(BITS - depth)).astype(np.int64) == p
        order = np.lexsort((key, ~first))
        key, rep, left = key[order], rep[order], int(first.sum())
        roots = walk(key, left, tree, depth, diff, k)
        low = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(low, roots, rep)
        v = low[roots]
        return pd.DataFrame({"u": rep, "v": v})[rep != v]

    return work.groupBy("tree", "depth", "p", "q").applyInPandas(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the least node of its component.

    Alternates the large-star and small-star steps until the edges stop changing.
    """
    edges, before = checkpoint(edges.filter("u <> v").distinct()), None

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).withColumn("m", F.least("u", "m"))

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The hub of a large component meets its neighbours by broadcast.  After that a node has one row for each distinct least of its neighbours.
        large = join_counted(both, least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tied = down.join(least(down).drop("n_rows"), "u")
        small = tied.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        edges = checkpoint(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def labelled_groups(sig: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """(fp, rep, component_id, n_rows) for every distinct fingerprint of sig (id, fp); rep is its least id."""
    reps = checkpoint(sig.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows")))
    found = components(hamming_forest(reps.filter("rep is not null").select("rep", "fp"), max_bits, limit))
    return checkpoint(reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "rep").alias("component_id"), "n_rows"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, limit: int = 32768) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Fingerprints link at max_bits or fewer differing bits; component_id is the
    least id reachable over links.  Null or word-less texts have fingerprint
    zero, linked like any other.  Repeated rows stay and share a component.
    Rows with a null id get the component of the ids that share their
    fingerprint, else null.  Empty tables give no rows.  Other columns of docs
    are not read, so their names don't matter.
    """
    sig = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    named = labelled_groups(sig, max_bits, limit).select("fp", "component_id", "n_rows")
    return join_counted(sig, named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, limit: int = 32768) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the least id.

    Of rows repeated under that id one stays; a group whose ids are all null keeps one row.
    """
    sig = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    return keep_representatives(docs, labelled_groups(sig, max_bits, limit).filter(F.col("rep").eqNullSafe(F.col("component_id"))).select("rep", "fp"), id_col, text_col, lambda t: fingerprint(t, shingle))


def keep_representatives(docs: DataFrame, first: DataFrame, id_col: str, text_col: str, print_of: Callable[[str | None], int]) -> DataFrame:
    """One row of docs, with all its columns, for each (rep, fp) of first: of that id and fingerprint."""
    own_fp, key, none = (unused(docs.columns, n) for n in ("own_fp", "key", "none"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([print_of(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield batch.append_column(own_fp, pa.array(fps))

    def keyed(rows: DataFrame, own: Column) -> DataFrame:
        return rows.withColumns({key: F.coalesce(own.cast("long"), F.lit(0)), none: own.isNull()})

    own = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own_fp, T.LongType())]))
    # Joined by id and fingerprint, a group of copies of any size spreads over all tasks; rows move once.
    wanted = keyed(first, F.col("rep")).select(key, none, F.col("fp").alias(own_fp))
    kept = keyed(own, F.col(id_col)).join(wanted, [key, none, own_fp], "left_semi")
    return kept.dropDuplicates([key, none, own_fp]).select(*[f"`{c}`" for c in docs.columns])
