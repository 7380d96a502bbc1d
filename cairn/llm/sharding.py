"""Sharding by histogram sort: near-equal bytes in every shard.

Rows are ordered by (text hash, id hash), so equal texts stand together and a
group of copies of any size can still be cut.  Splitters at equal shares of
the bytes are found without sorting: exact bytes and rows are counted in the
cells of the still open key ranges, the cells that hold a splitter become the
next ranges, and so on until every splitter is within tolerance.  That reads
narrow keys only.  Then the rows move once, with all their columns.  What leaves the cluster is at most `probes` counts for each
splitter and round; the number of splitters is shards * runs, a parameter.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, local_table, utf8_bytes

#: Keys use 62 bits, so that differences of keys stay in a long.
KEY_BITS = 62
#: Leading bits by which splitters are looked up.
CELL_BITS = 10


@dataclass
class Range:
    """An open key range: rows with lo <= (h, t) <= hi, and what lies before it."""

    lo: tuple[int, int]
    hi: tuple[int, int]
    before: int
    size: int
    rows: int
    rows_before: int


def keyed(docs: DataFrame, id_col: str, text_col: str, overhead: int, *own: Column) -> DataFrame:
    """The columns own, size and the key (h, t); null texts count as empty.

    The id hash is a bijection of the id, so rows tie only if their ids do.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unsigned = lambda c: F.shiftrightunsigned(c, 64 - KEY_BITS)
    return docs.select(
        *own,
        (utf8_bytes(F.col(text_col)) + overhead).alias("size"),
        unsigned(F.xxhash64(text)).alias("h"),
        unsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")))).alias("t"),
    )


def placed(rows: DataFrame, edges: list[tuple[int, int]], name: str) -> DataFrame:
    """rows with the number of edges (sorted) below their key.

    The edges travel as a broadcast table of 2^CELL_BITS rows, one for each
    leading part of h: how many edges lie before it, and those inside.
    """
    shift = KEY_BITS - CELL_BITS
    inside: list[list[tuple[int, int]]] = [[] for _ in range(1 << CELL_BITS)]
    for h, t in edges:
        inside[h >> shift].append((h, t))
    before = [0, *accumulate(map(len, inside))]
    table = local_table(rows.sparkSession, [(i, before[i], [{"h": h, "t": t} for h, t in x]) for i, x in enumerate(inside)], "cell int, before int, edges array<struct<h: long, t: long>>")
    below = F.size(F.filter("edges", lambda e: (e["h"] < F.col("h")) | ((e["h"] == F.col("h")) & (e["t"] < F.col("t")))))
    joined = rows.withColumn("cell", F.shiftright("h", shift).cast("int")).join(F.broadcast(table), "cell")
    return joined.withColumn(name, F.col("before") + F.when(F.size("edges") == 0, 0).otherwise(below)).drop("cell", "before", "edges")


def splitters(rows: DataFrame, parts: int, tolerance: float, probes: int) -> tuple[list[tuple[int, int]], list[int], set[tuple[int, int]]]:
    """Keys that end parts 0 .. parts-2, the rows before each part, and keys of several rows that stood in the way of a splitter."""
    whole = rows.agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("t"), F.max("t")).first()
    total, count = whole[0] or 0, whole[1]
    if not count:
        return [], [0] * parts, set()
    slack = max(1, int(tolerance * total / parts))
    targets = [total * i // parts for i in range(1, parts)]
    ranges = [Range((whole[2], whole[4]), (whole[3], whole[5]), 0, total, count, 0)]
    found: dict[int, tuple[tuple[int, int], int]] = {}  # target -> key and rows up to it
    tied: set[tuple[int, int]] = set()
    while len(found) < len(targets):
        open_targets = [i for i in range(len(targets)) if i not in found]
        ends = [r.before + r.size for r in ranges]
        wanted = sorted({bisect_left(ends, targets[i]) for i in open_targets})
        live = [ranges[j] for j in wanted]
        # Cells of a range: equal steps of h, or of t where the range has one h only.
        table = local_table(
            rows.sparkSession,
            [(j, r.lo[0], r.hi[0], r.lo[1], r.hi[1], r.lo[0] == r.hi[0], max(1, -(-((r.hi[1] - r.lo[1]) if r.lo[0] == r.hi[0] else (r.hi[0] - r.lo[0])) // probes))) for j, r in enumerate(live)],
            "j int, h0 long, h1 long, t0 long, t1 long, one boolean, step long",
        )
        edges = [(r.hi[0], r.hi[1] if r.lo[0] == r.hi[0] else 1 << KEY_BITS) for r in live]
        inside = placed(rows, edges, "j").join(F.broadcast(table), "j").filter("h >= h0 AND h <= h1 AND (NOT one OR t >= t0)")
        cells = (
            inside.groupBy("j", F.expr("CASE WHEN one THEN (t - t0) DIV step ELSE (h - h0) DIV step END").alias("cell"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("hmin"), F.max("h").alias("hmax"), F.min("t").alias("tmin"), F.max("t").alias("tmax"))
            .collect()
        )
        of: list[list[tuple]] = [[] for _ in live]
        for c in sorted(map(tuple, cells)):
            of[c[0]].append(c[2:])
        finer: list[Range] = []
        for r, own in zip(live, of):
            before, seen = r.before, r.rows_before
            for size, n, hmin, hmax, tmin, tmax in own:
                # The bounds in t mean something only where a cell has a single h.
                finer.append(Range((hmin, tmin), (hmax, tmax), before, size, n, seen))
                before, seen = before + size, seen + n
        ends = [r.before + r.size for r in finer]
        for i in open_targets:
            r = finer[bisect_left(ends, targets[i])]
            over, under = r.before + r.size - targets[i], targets[i] - r.before
            if r.lo == r.hi and r.rows > 1 and min(over, under) > slack:
                tied.add(r.lo)
            if under < over and (under <= slack or r.lo == r.hi):
                found[i] = ((r.lo[0], (r.lo[1] if r.lo[0] == r.hi[0] else 0) - 1), r.rows_before)
            elif over <= slack or r.lo == r.hi:
                # A cell of several h holds all their t.
                found[i] = ((r.hi[0], r.hi[1] if r.lo[0] == r.hi[0] else 1 << KEY_BITS), r.rows_before + r.rows)
        ranges = finer
    keys = [found[i] for i in range(len(targets))]
    return [k for k, _ in keys], [0, *[n for _, n in keys]], tied


#: Most key ranges of all shards together, whose edges and counts the driver holds.
MOST_PARTS = 16_384


def runs_for(total: int, shards: int, part_bytes: int) -> int:
    """Key ranges of a shard, such that a range holds about part_bytes; at most MOST_PARTS in all."""
    return max(1, min(MOST_PARTS // shards, -(-total // (shards * part_bytes))))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, runs: int | None = None, part_bytes: int = 1 << 27, tolerance: float = 0.01, probes: int = 64) -> DataFrame:
    """All columns of docs, moved to their shard, with size, shard and slot: shards of near-equal bytes; slot counts gapless from 0 in each.

    size is the UTF-8 length plus overhead.  A shard is cut into `runs` key
    ranges of near-equal bytes (None: of about part_bytes each, so their number
    grows with docs), which are the tasks that order its rows; each
    part's bytes are off by the largest row or tolerance of a part at most.
    Null texts count as empty, null ids are alike.  Very long texts are one row
    like any other.  Rows of one id and one text are interchangeable; where so
    many repeat that a splitter falls among them, each gets a number of its own
    to be cut by.  Fewer rows than parts leave parts empty; an empty table
    gives no rows.  A column of docs named size, shard or slot is returned as
    input_size, input_shard or input_slot.
    """
    rows = checkpoint(keyed(docs, id_col, text_col, overhead))
    whole = keyed(docs, id_col, text_col, overhead, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    runs = runs or runs_for(rows.agg(F.sum("size")).first()[0] or 0, shards, part_bytes)
    parts = shards * runs
    edges, starts, tied = splitters(rows, parts, tolerance, probes)
    if tied:  # fewer than parts
        keys = F.broadcast(local_table(docs.sparkSession, sorted(tied), "h long, t long"))
        own = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)
        # Stored, so that a row keeps its number.
        cut = checkpoint(whole.join(keys, ["h", "t"], "left_semi").select("row", "size", "h", own.alias("t")))
        whole = whole.join(keys, ["h", "t"], "left_anti").select("row", "size", "h", "t").unionByName(cut)
        rows = checkpoint(rows.join(keys, ["h", "t"], "left_anti").select("size", "h", "t").unionByName(cut.select("size", "h", "t")))
        edges, starts, _ = splitters(rows, parts, tolerance, probes)
    dealt = placed(whole, edges, "part")
    first = F.expr("array(" + ", ".join(f"{starts[p] - starts[p - p % runs]}L" for p in range(parts)) + ")")
    within = F.row_number().over(Window.partitionBy("part").orderBy("h", "t")).cast("long") - 1
    own = [F.col("row").getField(c).alias(f"input_{c}" if c in ("size", "shard", "slot") else c) for c in docs.columns]
    return dealt.select(*own, "size", F.floor(F.col("part") / runs).cast("int").alias("shard"), (within + F.element_at(first, F.col("part") + 1)).alias("slot"))
