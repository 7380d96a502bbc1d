"""Hierarchical packing of documents into training sequences of several lengths.

Windows of the longest length are cut from long documents first.  What is
left of a document goes to the shortest tier that holds it; each tier packs
its pieces back to back and cuts windows of exactly its own length, so they
need no padding.  A tier's rest fills the gap of the next longer tier.  The
rest of the longest tier leaves the task and meets those of other tasks in a
second, small round.  So only the very last window of a group of tasks can
need padding.  Documents are tokenized once and never shuffled.

Step groups are given out when all windows are made and counted: each tier's
windows are dealt in proportion over all groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, ship, shipped
from cairn.llm.tokencount import id_encoder

TIERS = (256, 512, 1024, 2048)
#: Bits of a sequence number within its task, and tasks whose rests are packed together.
LOCAL_BITS, GROUP = 32, 64
#: Rows of the table of tasks and tiers that are sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sequence numbers of the second round start here.
SECOND = 1 << 62

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"
ARROW = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Packer:
    """Packs pieces (doc, start, doc_tokens, ids) into windows; finished rows gather in `rows`."""

    def __init__(self, tiers: tuple[int, ...], first_id: int):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.open: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.made = dict.fromkeys(self.tiers, 0)
        self.next_id, self.first_id = first_id, first_id
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        """A document, or a part of one from `start`; its ids end with the end mark."""
        total = len(ids) if total is None else total
        while len(ids) >= self.longest:
            self.close(self.longest, [(doc, start, total, ids[: self.longest])])
            ids, start = ids[self.longest :], start + self.longest
        if len(ids):
            self.put(next(t for t in self.tiers if len(ids) <= t), (doc, start, total, ids))

    def put(self, tier: int, piece: tuple) -> None:
        doc, start, total, ids = piece
        while len(ids):
            take = min(len(ids), tier - self.held[tier])
            self.open[tier].append((doc, start, total, ids[:take]))
            self.held[tier] += take
            ids, start = ids[take:], start + take
            if self.held[tier] == tier:
                self.close(tier, self.open[tier])
                self.open[tier], self.held[tier] = [], 0

    def close(self, tier: int, pieces: list[tuple]) -> None:
        """Write a window; in place of its step group stands its number among the task's windows of the tier."""
        offset = 0
        for doc, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, total, self.next_id, offset, tier, self.made[tier], ids.astype(np.int32)))
            offset += len(ids)
        self.made[tier] += 1
        self.next_id += 1

    def rest(self) -> list[tuple]:
        """Pieces that fill no window: rests of short tiers have filled the gaps of longer ones as far as they reach."""
        for tier, longer in zip(self.tiers, self.tiers[1:]):
            pieces, self.open[tier], self.held[tier] = self.open[tier], [], 0
            for piece in pieces:
                self.put(longer, piece)
        return self.open[self.longest]

    def finish(self) -> None:
        """Close the last window, shorter than the longest tier."""
        if pieces := self.rest():
            self.close(self.longest, pieces)
            self.open[self.longest], self.held[self.longest] = [], 0

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def to_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *ARROW.types])], ["_id", *ARROW.names])


def step_groups(windows: DataFrame, step_tokens: int) -> DataFrame:
    """windows with step_group, in which stood the number among a task's windows of the tier.

    Of n windows of a tier, number i goes to group i * groups // n; so each
    group has a tier's share rounded down or up.
    """
    rows = windows.withColumn("_task", F.shiftright("sequence_id", LOCAL_BITS))
    made = checkpoint(rows.groupBy("_task", "tier").agg((F.max("step_group") + 1).alias("_made"), F.sum("length").alias("_ids")))
    # A row for each tier of a task.
    own = Window.partitionBy("tier")
    before = F.coalesce(F.sum("_made").over(own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole, lines = made.agg(F.sum("_ids"), F.count("*")).first()
    groups = -(-(whole or 0) // step_tokens)
    table = made.select("_task", "tier", before.alias("_before"), F.sum("_made").over(own).alias("_n"))
    if lines <= BROADCAST_ROWS:
        table = F.broadcast(table)
    dealt = rows.join(table, ["_task", "tier"]).withColumn("step_group", F.expr(f"((_before + step_group) * {groups}L) DIV _n"))
    return dealt.select(*windows.columns)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", step_tokens: int = 1 << 16) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    A document's ids are those of its whole text and end_id; a piece has its
    own in ids, and a window's in order of offset are the sequence.  Windows hold
    exactly `tier` ids; of every GROUP tasks one window may hold fewer and is
    padded to the longest tier.  step_group, from 0, numbers groups of windows
    with equal shares of every tier, to one window, and so of step_tokens ids
    at most on average; a group is off the average by less than one window of
    every tier.  Null and empty texts give one id; texts of any length are
    packed whole.  Repeated rows, and rows with a null id, are packed each; an
    empty table gives no rows.  Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = ship(docs.sparkSession, id_encoder, f.read())
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, {COLUMNS}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = shipped(sent)
        packer, arrow_kind = Packer(tiers, TaskContext.get().partitionId() << LOCAL_BITS), None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            arrow_kind = batch.schema.types[0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), end]))
            yield to_batch(packer.drain(), arrow_kind)
        if arrow_kind is not None:
            rest = packer.rest()
            tails = [(doc, start, len(ids), None, total, packer.first_id, None, None, None, ids.astype(np.int32)) for doc, start, total, ids in rest]
            yield to_batch(packer.drain() + tails, arrow_kind)

    def second(part: pa.Table) -> pa.Table:
        part = part.sort_by([("sequence_id", "ascending"), ("_id", "ascending"), ("start", "ascending")])
        rows = part.to_pylist()
        packer = Packer((max(tiers),), SECOND | ((rows[0]["sequence_id"] >> LOCAL_BITS) // GROUP) << LOCAL_BITS)
        for r in rows:
            packer.put(packer.longest, (r["_id"], r["start"], r["doc_tokens"], np.array(r["ids"], np.uint32)))
        packer.finish()
        return pa.Table.from_batches([to_batch(packer.drain(), part.schema.types[0])])

    packed = checkpoint(narrow.mapInArrow(first, schema))
    rests = packed.filter("tier IS NULL").groupBy(F.floor(F.shiftright("sequence_id", LOCAL_BITS) / GROUP)).applyInArrow(second, schema)
    windows = packed.filter("tier IS NOT NULL").unionByName(checkpoint(rests))
    return step_groups(windows, step_tokens).withColumnRenamed("_id", id_col)
