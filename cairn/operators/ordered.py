"""Order within tracks of any length: stretches of a track that tasks order apart, and what they carry over to each other.

A window by track puts a whole track into one task.  Here a track that holds
many rows is cut into stretches at rows drawn from it, so stretches hold about
equal numbers of rows however they lie in time.  Rows move once, to their
(track, stretch).  What earlier stretches add up to, and the few rows next to
a cut, come from aggregates over the cut tracks alone; there is at most a row
for each cut, and the number of cuts is a parameter, so these are broadcast.
Cuts only say where work is split: any choice of them gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch, on average, and the most cuts of a table.
ROWS, CUTS = 1 << 20, 10_000
#: Rows that are drawn for each cut.
DRAWN = 40
#: Cuts that a row is compared with at a time: every GROUP-th first, then those of one group.
GROUP = 100
LEAST = -(1 << 63)


def moment(ts: str = "ts", ix: str = "ix") -> Column:
    """Place of a row in its track: time, then number; missing ones come first, as they do in windows."""
    return F.struct(F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(LEAST)).alias("us"), F.coalesce(F.col(ix).cast("long"), F.lit(LEAST)).alias("ix"))


@dataclass(frozen=True)
class Stretches:
    """rows: the points with _stretch and _at (their moment); cut: the tracks that have cuts (track), None if none has."""

    rows: DataFrame
    cut: DataFrame | None

    def of_cut_tracks(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.cut), "track", "left_semi")


def within() -> Window:
    return Window.partitionBy("track", "_stretch").orderBy("_at")


def stretches(points: DataFrame, rows: int = ROWS, most: int = CUTS) -> Stretches:
    """points (track, ix, ts, ...) with their stretch of about `rows` rows; one count, and a scan for the draw where the table is larger.

    Rows without a track are left out.  Tables up to `rows` rows, and tracks in
    which no cut falls, have one stretch for each track.
    """
    placed = points.filter(F.col("track").isNotNull()).withColumn("_at", moment())
    n = placed.count()
    parts = min(most, -(-n // max(1, rows)))
    if parts < 2:
        return Stretches(placed.withColumn("_stretch", F.lit(0)), None)
    drawn = placed.select("track", "_at").sample(fraction=min(1.0, parts * DRAWN / n), seed=11).orderBy("track", "_at").collect()
    step = max(1, len(drawn) // parts)
    chosen = sorted({(r["track"], tuple(r["_at"])) for r in drawn[step // 2 :: step]})
    by_track: dict = {}
    for track, at in chosen:
        by_track.setdefault(track, []).append(at)
    if not by_track:
        return Stretches(placed.withColumn("_stretch", F.lit(0)), None)
    key = points.schema["track"].dataType.simpleString()
    listed = points.sparkSession.createDataFrame([(t, ats[::GROUP], [ats[i : i + GROUP] for i in range(0, len(ats), GROUP)]) for t, ats in by_track.items()], f"track {key}, _heads array<struct<us:long,ix:long>>, _groups array<array<struct<us:long,ix:long>>>")
    placed = placed.join(F.broadcast(listed), "track", "left")
    # Groups of cuts that begin at or before the row; then cuts of the last of them.
    group = F.size(F.filter("_heads", lambda c: c <= F.col("_at")))
    inside = F.size(F.filter(F.get("_groups", group - 1), lambda c: c <= F.col("_at")))
    number = F.when(F.col("_heads").isNull() | (group == 0), 0).otherwise((group - 1) * GROUP + inside)
    return Stretches(placed.withColumn("_stretch", number.cast("int")).drop("_heads", "_groups"), listed.select("track"))


#: How a measure is folded over rows, and a stretch's fold into what comes before it.
FOLDS = {"min": (F.min, F.min, F.least), "max": (F.max, F.max, F.greatest), "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)), "count": (F.count, F.sum, lambda a, b: F.coalesce(a + b, a, b))}


def so_far(points: DataFrame, measures: dict[str, tuple[str, Column]], rows: int = ROWS, most: int = CUTS) -> DataFrame:
    """points with running measures in order of time: name -> (min, max, sum or count, column), the row's own included."""
    found = stretches(points, rows, most)
    own = within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = found.rows.withColumns({f"_r_{n}": FOLDS[kind][0](c).over(own) for n, (kind, c) in measures.items()})
    kept = [c for c in points.columns if c not in measures]
    if found.cut is None:
        return out.select(*kept, *[F.col(f"_r_{n}").alias(n) for n in measures])
    totals = found.of_cut_tracks().groupBy("track", "_stretch").agg(*[FOLDS[kind][0](c).alias(f"_t_{n}") for n, (kind, c) in measures.items()])
    earlier = Window.partitionBy("track").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("track", "_stretch", *[FOLDS[kind][1](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in measures.items()])
    out = out.join(F.broadcast(carry), ["track", "_stretch"], "left")
    return out.select(*kept, *[FOLDS[kind][2](F.col(f"_c_{n}"), F.col(f"_r_{n}")).alias(n) for n, (kind, _) in measures.items()])


def ranked(points: DataFrame, number: str = "_i", total: str = "_n", rows: int = ROWS, most: int = CUTS) -> DataFrame:
    """points with their number in the track, from 0, and the number of the track's points."""
    found = stretches(points, rows, most)
    whole = Window.partitionBy("track", "_stretch")
    out = found.rows.withColumns({number: F.row_number().over(within()).cast("long") - 1, total: F.count("*").over(whole)})
    if found.cut is not None:
        sizes = found.of_cut_tracks().groupBy("track", "_stretch").agg(F.count("*").alias("_size"))
        by_track = Window.partitionBy("track")
        carry = sizes.select("track", "_stretch", (F.sum("_size").over(by_track.orderBy("_stretch")) - F.col("_size")).alias("_before"), F.sum("_size").over(by_track).alias("_whole"))
        out = out.join(F.broadcast(carry), ["track", "_stretch"], "left").withColumns({number: F.col(number) + F.coalesce("_before", F.lit(0)), total: F.coalesce("_whole", total)})
    return out.select(*[c for c in points.columns if c not in (number, total)], number, total)


def with_neighbours(points: DataFrame, columns: dict[str, tuple[str, int]], rows: int = ROWS, most: int = CUTS) -> DataFrame:
    """points with values of rows near them in their track: name -> (column, how many rows on; negative: back); null beyond the ends.

    The rows next to a cut are copied to the stretches on its other side.
    Every stretch but the first holds the row it begins with, so `reach` rows
    come from `reach` stretches at most.
    """
    found = stretches(points, rows, most)
    shifted = lambda df: df.withColumns({n: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(within()) for n, (c, k) in columns.items()})
    kept = [c for c in points.columns if c not in columns]
    if found.cut is None:
        return shifted(found.rows).select(*kept, *columns)
    all_rows = found.rows.withColumn("_copy", F.lit(False))
    for reach, sign in ((max([0, *[k for _, k in columns.values()]]), -1), (max([0, *[-k for _, k in columns.values()]]), 1)):
        if reach:
            # The first (last) rows of every stretch; Spark keeps that many of each task before they move.
            order = within() if sign < 0 else Window.partitionBy("track", "_stretch").orderBy(F.desc("_at"))
            ends = found.of_cut_tracks().withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= reach)
            sent = ends.withColumn("_stretch", F.explode(F.sequence(F.col("_stretch") + sign, F.col("_stretch") + sign * reach))).filter("_stretch >= 0").drop("_k")
            all_rows = all_rows.unionByName(sent.withColumn("_copy", F.lit(True)))
    return shifted(all_rows).filter("NOT _copy").select(*kept, *columns)


def as_of(probes: DataFrame, points: DataFrame, values: list[str], rows: int = ROWS, most: int = CUTS) -> DataFrame:
    """probes (track, ts, ...) with, of the last point of their track at or before them, values as at_<name>, and at_ts; null where there is none.

    Probes and points go through one order, a point before the probes of its
    time; the last point so far is the greatest by time and number.  Probes or
    points without a time or track are left out.
    """
    point = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ix").cast("long").alias("ix"), F.struct(F.col("ts").alias("ts"), *[F.col(v) for v in values]).alias("p"))
    timed = lambda df: df.filter("ts IS NOT NULL AND track IS NOT NULL")
    seen = timed(points).select("track", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("ix"), point.alias("_point"))
    asked = timed(probes).select("track", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("ix"), F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("_probe"))
    both = seen.unionByName(asked, allowMissingColumns=True)
    out = so_far(both, {"_last": ("max", F.col("_point"))}, rows, most).filter("_probe IS NOT NULL")
    return out.select("_probe.*", F.col("_last.p.ts").alias("at_ts"), *[F.col(f"_last.p.{v}").alias(f"at_{v}") for v in values])
