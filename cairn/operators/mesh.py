"""Delaunay triangulation of the points of each cell, of any number of points.

A cell is cut into strips of about equal numbers of points, triangulated apart.
A triangle is final if its circle lies within its strip, as no other strip can
then put a point into it.  What is left of a strip are the corners of its other
triangles, and the edges where those meet final ones.  Neighbouring strips are
joined in pairs, round by round: the corners left of both are triangulated
together, what lies behind the edges is covered by final triangles and drops
out, and of the rest again those with circles within the pair are final.  In the
last round nothing lies outside, so all are.  Corners left lie near the sides of
strips, so a task holds the points of one strip or a small share of those of
some.

Points are added along a snake through a grid, so a walk from the last triangle
finds the next one in a few steps; triangles whose circle holds the new point
make way (Bowyer and Watson).  Coordinates are rounded to a grid of 2^26 steps
over the cell, where all tests, those of circles against strips too, are exact
integers; points that fall on one grid point are one vertex, that of the least
vid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordered import ranked
from cairn.sources.shared import spread, stored

STEPS = 1 << 26
FAR = 1 << 40


def snake(xy: np.ndarray) -> np.ndarray:
    """An order of points that goes up and down the columns of a grid; about as high as wide are its cells, whatever the shape of the cloud, and hold four points."""
    low = xy.min(axis=0)
    wide, high = (xy.max(axis=0) - low + 1).tolist()
    n = min(max(1, int(np.sqrt(len(xy) / 4 * wide / high))), len(xy))
    column = (xy[:, 0] - low[0]) * n // wide
    return np.lexsort((np.where(column % 2, -xy[:, 1], xy[:, 1]), column))


def delaunay(xy: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int, int]], dict[int, list[int | None]]]:
    """Points on the grid, in the order of `snake` and three far ones; corners of triangles, turning left; the neighbour opposite each corner."""
    p = [(int(a), int(b)) for a, b in xy[snake(xy)]]
    n = len(p)
    p += [(-FAR, -FAR), (FAR * 2, -FAR), (-FAR, FAR * 2)]
    corners = {0: (n, n + 1, n + 2)}
    across = {0: [None, None, None]}  # neighbour opposite each corner
    last, made = 0, 1
    for v in range(n):
        x, y = p[v]
        while True:  # walk towards the point, across the edge that has it on its right
            a, b, c = corners[last]
            (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
            ax, ay, bx, by, cx, cy = ax - x, ay - y, bx - x, by - y, cx - x, cy - y
            if bx * cy < by * cx:
                last = across[last][0]
            elif cx * ay < cy * ax:
                last = across[last][1]
            elif ax * by < ay * bx:
                last = across[last][2]
            else:
                break
        gone, stack, rim = {last}, [last], []
        while stack:
            here = stack.pop()
            t, near = corners[here], across[here]
            for k in range(3):
                there = near[k]
                if there in gone:
                    continue
                if there is not None:
                    # Whether the point lies inside the circle of the triangle, which turns left.
                    a, b, c = corners[there]
                    (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
                    ax, ay, bx, by, cx, cy = ax - x, ay - y, bx - x, by - y, cx - x, cy - y
                    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
                    if ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0:
                        gone.add(there)
                        stack.append(there)
                        continue
                rim.append((t[k - 2], t[k - 1], there))
        starts, ends = {}, {}
        for a, b, out in rim:
            if out in gone:  # an edge looked at before its neighbour went is inside
                continue
            corners[made], across[made] = (v, a, b), [out, None, None]
            if out is not None:
                o = corners[out]
                across[out][next(k for k in range(3) if o[k] not in (a, b))] = made
            starts[a], ends[b] = made, made
            made += 1
        for a, new in starts.items():
            near = across[new]
            near[1], near[2] = starts[corners[new][2]], ends[a]
        for g in gone:
            del corners[g], across[g]
        last = made - 1
    return p, corners, across


def within(p: list[tuple[int, int]], t: tuple[int, int, int], low: int | None, high: int | None) -> bool:
    """Whether the circle of a triangle lies strictly between low and high (None: no bound), exactly."""
    (ax, ay), (bx, by), (cx, cy) = (p[k] for k in t)
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = cy * b2 - by * c2, bx * c2 - cx * b2  # centre from a, times d
    r2 = ux * ux + uy * uy
    left, right = (None if low is None else ux - (low - ax) * d), (None if high is None else (high - ax) * d - ux)
    return (left is None or left > 0 and left * left > r2) and (right is None or right > 0 and right * right > r2)


def merged(vid: np.ndarray, xy: np.ndarray, edges: np.ndarray, low: int | None, high: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final triangles (vids, turning left), positions of the points left, and edges left, of the points of a strip or of what some strips left.

    edges (vids): they have final triangles on their left, so whatever can be
    reached from there without crossing one is covered already.
    """
    if len(xy) == 0:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    order = snake(xy)
    p, corners, across = delaunay(xy)
    n, name = len(xy), vid[order]
    place = {v: k for k, v in enumerate(name.tolist())}
    cut = {(place[a], place[b]) for a, b in edges.tolist()}
    sides = lambda t: [(t[k - 2], t[k - 1], k) for k in range(3)]  # each edge, and the corner opposite
    covered = {here for here, t in corners.items() if any((a, b) in cut for a, b, _ in sides(t))} if cut else set()
    stack = list(covered)
    while stack:
        here = stack.pop()
        for a, b, k in sides(corners[here]):
            there = across[here][k]
            if there is not None and there not in covered and (a, b) not in cut and (b, a) not in cut:
                covered.add(there)
                stack.append(there)
    final = {here for here, t in corners.items() if here not in covered and max(t) < n and within(p, t, low, high)}
    left, rim = set(), []
    for here, t in corners.items():
        if here in covered or here in final:
            continue
        left.update(c for c in t if c < n)
        for a, b, k in sides(t):
            there = across[here][k]
            if there in final or (b, a) in cut:
                rim.append((b, a))
    as_array = lambda found, width: np.array(found, np.int64).reshape(-1, width)
    return name[as_array([corners[k] for k in final], 3)], order[as_array(sorted(left), 1).ravel()], name[as_array(rim, 2)]


def triangles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the triangles, as positions of the points, turning left; rows of three."""
    low = np.array([x.min(), y.min()])
    span = max(x.max() - low[0], y.max() - low[1]) or 1.0
    xy, first = np.unique(np.round((np.stack([x, y], 1) - low) / span * STEPS).astype(np.int64), axis=0, return_index=True)
    return merged(first, xy, np.zeros((0, 2), np.int64), None, None)[0] if len(xy) >= 3 else np.zeros((0, 3), np.int64)


#: Most strips of a cell.
MOST_STRIPS = 1024
ROW = "_part int, kind string, a long, b long, c long"


def triangulate(points: DataFrame, cell: str = "cell", least: int = 3, strip_points: int = 50_000) -> DataFrame:
    """(cell, tid, a, b, c): the triangles of each cell's points (cell, vid, x, y), by their vid, turning left from the least, numbered in order.

    A cell with fewer than `least` points is no surface and has no triangles, nor
    have points on one line.  vid is a key within its cell, 0 or more.  Points
    with a null part, NaN or infinite place, and those without a cell are left
    out.  strip_points: how many points of a cell go into a strip, on average;
    their number changes no triangle, but for points that lie on one circle.
    """
    kind = points.schema[cell].dataType.simpleString()
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("x", "y"))
    found = points.select(F.col(cell).alias("cell"), F.col("vid").cast("long").alias("vid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(f"cell IS NOT NULL AND vid IS NOT NULL AND {finite}")
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    boxes = found.groupBy("cell").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.when(span > 0, span).otherwise(1.0).alias("_span"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    grid = lambda c: F.rint((F.col(c) - F.col(f"_{c}")) / F.col("_span") * STEPS).cast("long")
    placed = found.join(boxes, "cell").select("cell", "vid", grid("x").alias("gx"), grid("y").alias("gy"), "_n").groupBy("cell", "gx", "gy").agg(F.min("vid").alias("vid"), F.max("_n").alias("_n"))
    placed = stored(placed, "mesh-places")
    large = placed.filter(F.col("_n") > strip_points)
    cuts = large.groupBy("cell").agg(F.max("_n").alias("_n"), F.percentile_approx("gx", [k / MOST_STRIPS for k in range(1, MOST_STRIPS)], 10_000).alias("_at"))
    strips = F.least(F.ceil(F.col("_n") / strip_points), F.lit(MOST_STRIPS)).cast("int")
    cuts = cuts.select("cell", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), strips - 1), lambda k: F.element_at("_at", F.floor(k * MOST_STRIPS / strips).cast("int"))))).alias("_cuts"))
    # A strip holds the grid columns above one cut up to the next.
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("gx"))), F.lit(0)).cast("int")
    cuts = stored(cuts, "mesh-cuts")
    most = (cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0) + 1
    rows = placed.join(cuts, "cell", "left").select("cell", part.alias("_part"), F.lit("point").alias("kind"), F.col("vid").alias("a"), F.col("gx").alias("b"), F.col("gy").alias("c"))

    def join_parts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name, group = key[0], int(key[1])
        own, edge = frame[frame["kind"] == "point"].drop_duplicates("a").sort_values("a"), frame[frame["kind"] == "edge"]
        low, high = (None if pd.isna(frame[c].iloc[0]) else int(frame[c].iloc[0]) for c in ("_low", "_high"))
        vid, xy = own["a"].to_numpy(np.int64), own[["b", "c"]].to_numpy(np.int64)
        final, left, rim = merged(vid, xy, edge[["a", "b"]].to_numpy(np.int64), low, high)
        if low is None and high is None:
            left, rim = left[:0], rim[:0]
        out = np.concatenate([final, np.column_stack([vid[left], xy[left]]), np.column_stack([rim, np.zeros(len(rim), np.int64)])])
        if not len(out):
            return pd.DataFrame()
        kinds = ["triangle"] * len(final) + ["point"] * len(left) + ["edge"] * len(rim)
        return pd.DataFrame({"cell": [name] * len(out), "_part": np.full(len(out), group, np.int32), "kind": kinds, "a": out[:, 0], "b": out[:, 1], "c": out[:, 2]})

    level, made = 0, None
    while True:
        keyed = rows.withColumn("_part", F.col("_part") if level == 0 else F.shiftright("_part", 1)).join(cuts, "cell", "left")
        # Of the cuts only those on both sides of the group go with its rows.
        first, after = F.shiftleft("_part", level), F.shiftleft(F.col("_part") + 1, level)
        keyed = keyed.withColumns({"_low": F.get("_cuts", first - 1), "_high": F.get("_cuts", after - 1) + 1}).drop("_cuts")
        step = stored(spread(keyed, "cell", "_part").groupBy("cell", "_part").applyInPandas(join_parts, f"cell {kind}, {ROW}"), "mesh-round")
        made = step if made is None else made.unionByName(step)
        if most <= 1 << level:
            break
        rows, level = step.filter("kind <> 'triangle'"), level + 1
    made = made.filter("kind = 'triangle'")
    # Corners from the least on, in their turn.
    turned = F.when((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")), F.struct("a", "b", "c")).when((F.col("b") < F.col("a")) & (F.col("b") < F.col("c")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))).otherwise(F.struct(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))
    named = made.select(F.col("cell").alias("track"), turned.alias("t")).select("track", "t.*")
    # An edge has one triangle on its left, so (a, b) orders them.
    numbered = ranked(named.withColumns({"ts": F.timestamp_micros("a"), "ix": F.col("b")}), "tid")
    return numbered.select(F.col("track").alias(cell), "tid", "a", "b", "c")
