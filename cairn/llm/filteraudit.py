"""Interaction of document filters: what every order of five filters removes, by a subset-zeta transform.

Each document has a mask of the filters that it fails.  One pass counts
documents, good and toxic ones by part and mask.  The zeta transform over the
2^n masks turns these counts into survivors of every subset of filters: those
whose mask lies within the complement of the subset.  A step of an order takes
the filters before it, a subset, to the subset with its own filter added, so
all of its figures are differences of two neighbouring survivors.

The fifth filter, copies of a smaller id's text, is no expression over its own
row.  It follows from counts as well: of the rows with one text all but those
of the smallest id fail it.  Rows are counted by digest and part before they
move, so a text that very many rows share is one row for each task and part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import SPACE

#: Letters of the filters, by bit; the last is that of copies.
FILTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Conditions of the filters A to D over a text that isn't null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def mask_of(conditions: list[Column]) -> Column:
    """Bit i is set where condition i holds."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters.

    Null texts count as empty, null parts as the empty string.  A row with a
    null id has no label, and neither fails as a copy nor makes another row
    fail.  Rows repeated under one id don't make each other fail, and count
    each.  An id is good (toxic) if any of its rows in labels says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"), mask_of(text_failures(F.col("_text"))).alias("_mask"))
    # Rows that are equal in all this are counted before they move.
    rows = rows.groupBy("_id", "part", "_digest", "_mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("_good"), (F.col("toxic") == 1).alias("_toxic")).filter("_id IS NOT NULL AND (_good OR _toxic)")
    marks = marks.groupBy("_id").agg(F.max(F.coalesce("_good", F.lit(False))).alias("_good"), F.max(F.coalesce("_toxic", F.lit(False))).alias("_toxic"))
    weigh = lambda c: F.when(F.col(c), F.col("n")).otherwise(0).cast("long")
    rows = rows.join(marks, "_id", "left").select("_id", "part", "_digest", "_mask", "n", weigh("_good").alias("good"), weigh("_toxic").alias("toxic"))
    # The least id of a text and part, and rows that no id can make copies; then the least of all parts.
    known = F.when(F.col("_id").isNotNull(), F.struct("_id", "n", "good", "toxic"))
    without = lambda c: F.sum(F.when(F.col("_id").isNull(), F.col(c)).otherwise(0))
    texts = rows.groupBy("_digest", "part", "_mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.min(known).alias("_least"), *[without(c).alias(f"_free_{c}") for c in ("n", "good", "toxic")])
    # One row for each part that has the text.
    texts = texts.withColumn("_first", F.min("_least._id").over(Window.partitionBy("_digest")))
    is_first = F.col("_least._id") == F.col("_first")
    passed = F.struct(F.col("_mask").alias("mask"), *[(F.col(f"_free_{c}") + F.when(is_first, F.col(f"_least.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    copies = F.struct((F.col("_mask") + (1 << (len(FILTERS) - 1))).alias("mask"), *[(F.col(c) - F.col(f"_free_{c}") - F.when(is_first, F.col(f"_least.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    return texts.select("part", F.inline(F.array(passed, copies))).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def survivors(counts: DataFrame, bits: int) -> DataFrame:
    """(part, n, good, toxic): arrays over all subsets of `bits` filters, subset s at s + 1, of the rows of counts (part, mask, n, good, toxic) that fail none of its filters.

    The zeta transform: after the round of a bit, an entry holds the sum over
    all masks that equal its own but for this bit and those before, which may
    be missing.  The survivors of a subset are the sum at its complement.
    """
    names = ("n", "good", "toxic")
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    sums = counts.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(1 << bits)]).alias(c) for c in names])
    for b in range(bits):
        sums = sums.select("part", *[F.expr(f"transform({c}, (x, m) -> CASE WHEN m & {1 << b} = 0 THEN x ELSE x + {c}[m - {1 << b}] END)").alias(c) for c in names])
    return sums.select("part", *[F.reverse(c).alias(c) for c in names])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part of counts (part, mask, n, good, toxic), each order of filters and each step of it.

    kept and removed: documents after and at the step; redundant: those that
    fail its filter but left earlier; unique_fails: those that fail this filter
    alone; good_lost, toxic_lost: labelled ones removed at the step; shapley:
    what the filter removes, summed over all orders.  Orders are letters of
    filters, the first of which has bit 0.  No counts give no rows.
    """
    size = len(filters)
    everything = (1 << size) - 1
    # A filter comes right after subset p in |p|! (size - 1 - |p|)! orders.
    after = lambda p: factorial(p.bit_count()) * factorial(size - 1 - p.bit_count())
    whole = lambda b: sum((after(p) * (F.col("n")[p] - F.col("n")[p | b]) for p in range(1 << size) if not p & b), F.lit(0))
    sums = survivors(counts, size).withColumn("shapleys", F.array(*[whole(1 << i) for i in range(size)]))
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(filters))), ",")
    steps = sums.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    letter = lambda: F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = lambda f: F.instr("filter_order", f) < F.col("step")
    steps = steps.withColumns({
        "_before": sum((F.when(earlier(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)),
        "_own": sum((F.when(letter() == f, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)),
    }).withColumn("_after", F.col("_before") + F.col("_own"))
    lost = lambda c: F.col(c)[F.col("_before")] - F.col(c)[F.col("_after")]
    n = F.col("n")
    return steps.select(
        "part", "filter_order", "step", n[F.col("_after")].alias("kept"), lost("n").alias("removed"), (n[0] - n[F.col("_own")] - lost("n")).alias("redundant"),
        (n[everything - F.col("_own")] - n[everything]).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.col("shapleys")[F.instr(F.lit(filters), letter()) - 1].alias("shapley"),
    )
