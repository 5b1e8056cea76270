"""What polygons cover, tile by tile: areas of unions and intersections, lengths of lines inside polygons or near them.

Edges go to the tiles that they pass, and each polygon tells of every tile whether the tile's lower left corner lies inside (the even-odd parity of
the edges below it in the tile's column; a polygon without an edge in a tile covers all of it or nothing). With both, a tile knows all that
matters in it. It is cut into quarters until a polygon covers a cell whole, where nothing is left to compute however many others lie there, or few edges are left. Of these,
edges are met with vertical lines between neighbouring ends and crossings (areas) or with the lines themselves (lengths), so that work and shuffle
grow with edges and lines, not with the pairs that cross.

Parities count edges by half-open spans and by one formula for the height of an edge, so that all steps agree on every point.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import cut

#: Edges in a cell that isn't cut any more, pairs of line and edge likewise, the most cuts, and numbers in one step's arrays (as a cache holds).
LEAF, PAIRS, DEPTH, STEP = 100, 20_000, 14, 1 << 16

#: Lines or edges that one task holds of a tile at a time, and tiles that lines may pass on an average.
CROWD, PASSED = 200_000, 3

Box = tuple[float, float, float, float]


def spread(segs: DataFrame, tile: float, halo: float = 0.0) -> DataFrame:
    """``segs`` with tx, ty: the tiles that a segment passes at most ``halo`` away, column by column, not all those of its box."""
    at = lambda c: F.floor(c / tile).cast("long")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    columns = segs.withColumn("tx", F.explode(F.sequence(at(left - halo), at(right + halo))))
    # heights at the two ends of what lies in the column and its halo; more than rounding can lose is added
    y = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) * (F.least(right, F.greatest(left, x)) - x1) / (x2 - x1))
    spare = halo + tile * 1e-6
    ends = columns.withColumns({"_y1": y(F.col("tx") * tile - spare), "_y2": F.when(x1 == x2, y2).otherwise(y((F.col("tx") + 1) * tile + spare))})
    return ends.withColumn("ty", F.explode(F.sequence(at(F.least("_y1", "_y2") - spare), at(F.greatest("_y1", "_y2") + spare)))).drop("_y1", "_y2")


def in_tiles(edge: DataFrame, key: str, sets: list[str], tile: float, halo: float = 0.0) -> DataFrame:
    """sets, tx, ty, poly, x1, y1, x2, y2: each edge (from left to right) in the tiles that it passes at most ``halo`` away; without coordinates, the
    tiles whose lower left corner the polygon covers."""
    whole = isinstance(edge.schema[key].dataType, T.IntegralType)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    swap = (ends[0] > ends[2]) | ((ends[0] == ends[2]) & (ends[1] > ends[3]))
    turned = [F.when(swap, b).otherwise(a).cast("double").alias(n) for a, b, n in zip(ends, ends[2:] + ends[:2], ("x1", "y1", "x2", "y2"))]
    poly = F.col(key).cast("long") if whole else F.to_json(F.struct(key))
    e = edge.where("x1 <> x2 or y1 <> y2").select(*sets, poly.alias("poly"), *turned)
    column = F.sequence(F.floor(F.col("x1") / tile).cast("long"), F.ceil(F.col("x2") / tile).cast("long"))
    left = F.col("tx") * tile
    crossed = e.select("*", F.explode(column).alias("tx")).where((F.col("x1") <= left) & (left < F.col("x2")))
    height = F.col("y1") + (F.col("y2") - F.col("y1")) * ((left - F.col("x1")) / (F.col("x2") - F.col("x1")))
    row = F.ceil(F.col("y") / tile).cast("long")
    first = F.when((row - 1) * tile >= F.col("y"), row - 1).when(row * tile < F.col("y"), row + 1).otherwise(row)
    above = crossed.select(*sets, "poly", "tx", height.alias("y")).groupBy(*sets, "poly", "tx").agg(F.array_sort(F.collect_list(first)).alias("t"))
    pair = F.filter(F.transform(F.sequence(F.lit(0), (F.size("t") / 2).cast("int") - 1), lambda i: F.struct(F.get("t", 2 * i).alias("a"), F.get("t", 2 * i + 1).alias("b"))), lambda p: p["a"] < p["b"])
    inside = above.where(F.size("t") >= 2).select(*sets, "poly", "tx", F.explode(pair).alias("p")).select(*sets, "tx", F.explode(F.sequence("p.a", F.col("p.b") - 1)).alias("ty"), "poly", *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return spread(e, tile, halo).select(*sets, "tx", "ty", "poly", "x1", "y1", "x2", "y2").unionByName(inside)


class Shape(NamedTuple):
    """Edges of polygons in a cell, by polygon, and which polygons cover the cell's lower left corner."""

    e: np.ndarray  # (edges, 4), from left to right
    pid: np.ndarray
    corner: np.ndarray
    side: np.ndarray  # of each polygon

    @property
    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.append(True, self.pid[1:] != self.pid[:-1])) if len(self.pid) else np.zeros(0, dtype=np.int64)


def shape_of(sides: list[pa.Table]) -> Shape:
    es, pids, corners, side, n = [], [], [], [], 0
    for s, rows in enumerate(sides):
        if not rows.num_rows:
            continue
        poly = np.unique(rows.column("poly").combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)[1]
        e = np.stack([rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        is_corner, k = np.isnan(e[:, 0]), int(poly.max()) + 1
        corner = np.zeros(k, dtype=bool)
        corner[poly[is_corner]] = True
        order = np.argsort(poly[~is_corner], kind="stable")
        es.append(e[~is_corner][order])
        pids.append(poly[~is_corner][order] + n)
        corners.append(corner)
        side.append(np.full(k, s))
        n += k
    if not es:
        return Shape(np.zeros((0, 4)), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    return Shape(np.concatenate(es), np.concatenate(pids), np.concatenate(corners), np.concatenate(side))


def heights(e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The height of each edge at x; its ends' own heights at and beyond them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        y = e[:, 1] + (e[:, 3] - e[:, 1]) * ((x - e[:, 0]) / (e[:, 2] - e[:, 0]))
    return np.where(x >= e[:, 2], e[:, 3], np.where(x <= e[:, 0], e[:, 1], y))


def parity(box: Box, s: Shape, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(points, polygons): which polygons cover the points of the cell."""
    x, y, e = x[:, None], y[:, None], s.e
    low, high = np.maximum(e[:, 0], box[0])[None], np.minimum(e[:, 2], x)
    now = heights(e, x)
    passed = (low < high) & ((heights(e, low) <= box[1]) != (heights(e, high) <= box[1]))
    passed |= (e[:, 0] == e[:, 2]) & (e[:, 0] > box[0]) & (e[:, 0] <= x) & ((e[:, 1] <= box[1]) != (e[:, 3] <= box[1]))
    below = (e[:, 0] <= x) & (x < e[:, 2]) & ((now <= y) != (now <= box[1]))
    out = np.repeat(s.corner[None], len(x), axis=0)
    if len(e):
        out[:, s.pid[s.starts]] ^= np.logical_xor.reduceat(passed ^ below, s.starts, axis=1)
    return out


def narrowed(box: Box, s: Shape, sides: int, reach: float = 0.0) -> tuple[np.ndarray, Shape]:
    """Which sides cover the cell whole, and what of the shape matters in it."""
    x0, y0, x1, y1 = box
    ax, ay, bx, by = s.e.T
    keep = (bx + reach > x0) & (ax - reach < x1) & (np.maximum(ay, by) + reach > y0) & (np.minimum(ay, by) - reach < y1)
    e, pid = s.e[keep], s.pid[keep]
    full = np.zeros(sides, dtype=bool)
    if len(e):
        ax, ay, bx, by = e.T
        dx, dy = bx - ax, by - ay
        size = np.hypot(dx, dy)
        cx, cy = np.array([x0, x1, x0, x1])[:, None] - ax, np.array([y0, y0, y1, y1])[:, None] - ay
        off = (dx * cy - dy * cx) / size
        spare = reach + 1e-9 * (np.abs(box).max() + 1)
        far = (off > spare).all(axis=0) | (off < -spare).all(axis=0)
        if reach:
            along = np.clip((cx * dx + cy * dy) / (size * size), 0, 1)
            near = (np.hypot(cx - along * dx, cy - along * dy) <= reach).all(axis=0)
            full[np.unique(s.side[pid[near]])] = True
        e, pid = e[~far], pid[~far]
    has = np.zeros(len(s.corner), dtype=bool)
    has[pid] = True
    full[np.unique(s.side[s.corner & ~has])] = True
    mine = has & ~full[s.side]
    number = np.cumsum(mine) - 1
    stay = mine[pid]
    return full, Shape(e[stay], number[pid[stay]], s.corner[mine], s.side[mine])


def quarters(box: Box, s: Shape) -> list[tuple[Box, Shape]]:
    x0, y0, x1, y1 = box
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    at = parity(box, s, np.array([xm, x0, xm]), np.array([y0, ym, ym]))
    return [((x0, y0, xm, ym), s), ((xm, y0, x1, ym), s._replace(corner=at[0])), ((x0, ym, xm, y1), s._replace(corner=at[1])), ((xm, ym, x1, y1), s._replace(corner=at[2]))]


def covered(p: np.ndarray, q: np.ndarray, box: Box, s: Shape, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (0 to 1) of the parts into which edges cut the lines from p to q (in the cell), and which of them every side covers."""
    n, m, r = len(s.e), len(p), np.arange(len(p))
    d = q - p
    dx, dy = d[:, :1], d[:, 1:]
    ax, ay, bx, by = s.e.T
    sa, sb = dx * (ay - p[:, 1:]) - dy * (ax - p[:, :1]), dx * (by - p[:, 1:]) - dy * (bx - p[:, :1])
    # an end on the line is told apart as in parity(), where a point stands for what lies a little to its right and above
    tie = (dy > 0) | ((dy == 0) & (dx < 0))
    crosses = ((sa > 0) | ((sa == 0) & tie)) != ((sb > 0) | ((sb == 0) & tie))
    u = np.divide(sa, sa - sb, out=np.zeros_like(sa), where=crosses)
    t = ((ax + u * (bx - ax) - p[:, :1]) * dx + (ay + u * (by - ay) - p[:, 1:]) * dy) / (dx * dx + dy * dy)
    t = np.where(crosses & (t > 0) & (t < 1), t, 2.0)
    order = np.argsort(t, axis=1, kind="stable")
    ts = np.take_along_axis(t, order, axis=1)
    most = int((ts < 1).sum(axis=1).max(initial=0))
    order, ts = order[:, :most], ts[:, :most]
    bounds = np.concatenate([np.zeros((m, 1)), np.minimum(ts, 1.0), np.ones((m, 1))], axis=1)
    # parities are taken where no edge is near, in the middle of the longest part, and carried from there
    best = np.diff(bounds, axis=1).argmax(axis=1)
    tm = (bounds[r, best] + bounds[r, best + 1]) / 2
    state = parity(box, s, p[:, 0] + tm * d[:, 0], p[:, 1] + tm * d[:, 1])
    if n:
        state[:, s.pid[s.starts]] ^= np.logical_xor.reduceat(t < tm[:, None], s.starts, axis=1)
    who, on = s.pid[order], ts < 1
    # of a polygon's crossings in their order, every second one leads out of it
    by = np.argsort(who, axis=1, kind="stable")
    of, place = np.take_along_axis(who, by, axis=1), np.arange(most)
    rank = place - np.maximum.accumulate(np.where(np.diff(of, axis=1, prepend=-1) != 0, place, 0), axis=1)
    step = np.empty_like(who)
    np.put_along_axis(step, by, np.where(state[r[:, None], of] ^ (rank % 2 == 1), -1, 1), axis=1)
    step *= on
    out = np.ones((m, most + 1), dtype=bool)
    for k in np.flatnonzero(~full):
        first = state[:, s.side == k].sum(axis=1)
        out &= np.cumsum(np.concatenate([first[:, None], np.where(s.side[who] == k, step, 0)], axis=1), axis=1) > 0
    return bounds, out


def area(box: Box, s: Shape, full: np.ndarray, depth: int = 0) -> float:
    """The area of the cell that polygons of every side cover."""
    more, s = narrowed(box, s, len(full))
    full = full | more
    x0, y0, x1, y1 = box
    if full.all():
        return (x1 - x0) * (y1 - y0)
    if not np.isin(np.flatnonzero(~full), s.side).all():
        return 0.0
    if full.any():  # what a whole side covers asks no more of it
        mine = ~full[s.side]
        number = np.cumsum(mine) - 1
        stay = mine[s.pid]
        s = Shape(s.e[stay], number[s.pid[stay]], s.corner[mine], s.side[mine])
    if len(s.e) > LEAF and depth < DEPTH:
        return sum(area(b, c, full, depth + 1) for b, c in quarters(box, s))
    ax, ay, bx, by = s.e.T
    dx, dy = bx - ax, by - ay
    cuts = [np.array([x0, x1]), ax, bx]
    slanted = np.flatnonzero((dy != 0) & (dx != 0))
    for y in (y0, y1):
        cuts.append(ax[slanted] + (y - ay[slanted]) / dy[slanted] * dx[slanted])
    for i in slanted:
        cross = dx[i] * dy - dy[i] * dx
        with np.errstate(divide="ignore", invalid="ignore"):
            x = ax[i] + ((ax - ax[i]) * dy - (ay - ay[i]) * dx) / cross * dx[i]
        cuts.append(x[(cross != 0) & (x > x0) & (x < x1)])
    x = np.unique(np.concatenate(cuts))
    x = x[(x >= x0) & (x <= x1)]
    width, middle, total = np.diff(x), (x[1:] + x[:-1]) / 2, 0.0
    step = max(1, STEP // max(1, len(s.e)))
    for i in range(0, len(middle), step):
        m = middle[i : i + step]
        bounds, on = covered(np.stack([m, np.full(len(m), y0)], axis=1), np.stack([m, np.full(len(m), y1)], axis=1), box, s, full)
        total += float((width[i : i + step] * (np.diff(bounds, axis=1) * on).sum(axis=1)).sum()) * (y1 - y0)
    return total


def near_parts(p: np.ndarray, d: np.ndarray, e: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The part (lo, hi) of each line p + t d that is at most ``reach`` from the edge beside it; lo above hi if there is none.

    What is that near forms a disc at either end and a strip between them. The three are convex as one, so the parts of a line
    in each of them, the roots of a quadratic and of linear functions, make one interval.
    """
    (dx, dy), inf = d.T, np.inf
    a = dx * dx + dy * dy
    lo, hi = np.full(len(p), inf), np.full(len(p), -inf)
    for at in (e[:, :2], e[:, 2:]):
        px, py = (p - at).T
        b = px * dx + py * dy
        root = b * b - a * (px * px + py * py - reach * reach)
        size = np.sqrt(np.maximum(root, 0))
        lo, hi = np.where(root >= 0, np.minimum(lo, (-b - size) / a), lo), np.where(root >= 0, np.maximum(hi, (-b + size) / a), hi)
    ex, ey = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    size = np.hypot(ex, ey)
    ux, uy = ex / size, ey / size
    px, py = (p - e[:, :2]).T
    low, high = np.full_like(lo, -inf), np.full_like(hi, inf)
    for at, slope, least, most in ((px * uy - py * ux, dx * uy - dy * ux, -reach, np.full_like(size, reach)), (px * ux + py * uy, dx * ux + dy * uy, 0.0, size)):
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = (least - at) / slope, (most - at) / slope
        level, within = slope == 0, (at >= least) & (at <= most)
        low = np.maximum(low, np.where(level, np.where(within, -inf, inf), np.minimum(one, two)))
        high = np.minimum(high, np.where(level, np.where(within, inf, -inf), np.maximum(one, two)))
    strip = low <= high
    return np.where(strip, np.minimum(lo, low), lo), np.where(strip, np.maximum(hi, high), hi)


def met(p: np.ndarray, q: np.ndarray, e: np.ndarray, reach: float, spare: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (line, edge) of which the line from p to q may come ``reach`` near to the edge, by line, and which of these may cross."""
    far = reach + spare
    low, high = np.minimum(p, q), np.maximum(p, q)
    bottom, top = np.minimum(e[:, 1], e[:, 3]) - far, np.maximum(e[:, 1], e[:, 3]) + far
    line, edge = np.nonzero((low[:, :1] <= e[:, 2] + far) & (high[:, :1] >= e[:, 0] - far) & (low[:, 1:] <= top) & (high[:, 1:] >= bottom))
    if not len(line):
        return line, edge, np.zeros(0, dtype=bool)
    (px, py), (qx, qy), (ax, ay, bx, by) = p[line].T, q[line].T, e[edge].T
    ux, uy = bx - ax, by - ay
    size = np.hypot(ux, uy)
    one, two = ((px - ax) * uy - (py - ay) * ux) / size, ((qx - ax) * uy - (qy - ay) * ux) / size
    side = np.maximum(np.minimum(one, two), -np.maximum(one, two))  # how far the line stays on one side of the edge
    ux, uy = qx - px, qy - py
    size = np.maximum(np.hypot(ux, uy), 1e-300)
    one, two = ((ax - px) * uy - (ay - py) * ux) / size, ((bx - px) * uy - (by - py) * ux) / size
    side = np.maximum(side, np.maximum(np.minimum(one, two), -np.maximum(one, two)))
    keep = side <= far
    return line[keep], edge[keep], side[keep] <= spare


def lengths(box: Box, s: Shape, p: np.ndarray, d: np.ndarray, who: np.ndarray, reach: float, out: np.ndarray, depth: int = 0, inside: np.ndarray | None = None) -> None:
    """Adds to ``out`` the share of each line p + t d (0 to 1) that lies in the cell and in a polygon, or at most ``reach`` from one; to ``inside``,
    if given, the share in a polygon.

    A line along the border of two cells belongs to the upper or right one.
    """
    a, b = np.zeros(len(who)), np.ones(len(who))
    for i in (0, 1):
        at, by = p[who, i], d[who, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = (box[i] - at) / by, (box[i + 2] - at) / by
        level = by == 0
        within = (at >= box[i]) & (at < box[i + 2])
        a = np.maximum(a, np.where(level, np.where(within, 0.0, 1.0), np.minimum(one, two)))
        b = np.minimum(b, np.where(level, np.where(within, 1.0, 0.0), np.maximum(one, two)))
    there = a < b
    who, a, b = who[there], a[there], b[there]
    if not len(who):
        return
    full, near = narrowed(box, s, 1, reach)
    if full[0]:
        out[who] += b - a
        if inside is not None:  # the cell may be near to an edge everywhere and not be covered
            lengths(box, s, p, d, who, 0.0, inside, depth)
        return
    s = near
    if not len(s.e):
        return
    if len(s.e) > 16 and len(s.e) * len(who) > PAIRS and depth < DEPTH:
        for b_, c in quarters(box, s):
            lengths(b_, c, p, d, who, reach, out, depth + 1, inside)
        return
    spare = 1e-9 * (np.abs(box).max() + 1)
    step = max(1, STEP // len(s.e))
    for i in range(0, len(who), step):
        w, a_, b_ = who[i : i + step], a[i : i + step, None], b[i : i + step, None]
        start, end = p[w] + a_ * d[w], p[w] + b_ * d[w]
        line, edge, crosses = met(start, end, s.e, reach, spare)
        crossing = np.zeros(len(w), dtype=bool)
        crossing[line[crosses]] = True
        # a line that crosses no edge is covered whole or not at all
        plain, crossing = np.flatnonzero(~crossing), np.flatnonzero(crossing)
        share = np.zeros(len(w))
        middle = (start[plain] + end[plain]) / 2
        wet = plain[parity(box, s, middle[:, 0], middle[:, 1]).any(axis=1)]
        share[wet] = (b_ - a_)[wet, 0]
        bounds, on = covered(start[crossing], end[crossing], box, s, full)
        bounds = a_[crossing] + bounds * (b_ - a_)[crossing]
        share[crossing] = (np.diff(bounds, axis=1) * on).sum(axis=1)
        if inside is not None:
            inside[w] += share
        if not reach:
            out[w] += share
            continue
        # what is near and what is inside, as parts of each line that has both or the first alone, side by side
        some = np.zeros(len(w), dtype=bool)
        some[line] = True
        some[wet] = False
        out[w[~some]] += share[~some]
        row, rows = np.cumsum(some) - 1, int(some.sum())
        mine = some[line]
        line, edge = line[mine], edge[mine]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        width = int(place.max(initial=-1)) + 1
        lo, hi = np.full((rows, width + on.shape[1]), 2.0), np.full((rows, width + on.shape[1]), -1.0)
        found = near_parts(p[w[line]], d[w[line]], s.e[edge], reach)
        lo[row[line], place], hi[row[line], place] = np.maximum(found[0], a_[line, 0]), np.minimum(found[1], b_[line, 0])
        lo[row[crossing], width:], hi[row[crossing], width:] = bounds[:, :-1], np.where(on, bounds[:, 1:], -1.0)
        lo = np.where(lo < hi, lo, 2.0)
        hi = np.where(lo < hi, hi, -1.0)
        order = np.argsort(lo, axis=1)
        lo, hi = np.take_along_axis(lo, order, axis=1), np.take_along_axis(hi, order, axis=1)
        reached = np.maximum.accumulate(np.concatenate([np.full((rows, 1), -1.0), hi[:, :-1]], axis=1), axis=1)
        out[w[some]] += np.maximum(0.0, hi - np.maximum(lo, reached)).sum(axis=1)


def by_tile(rows: DataFrame, *sets: str) -> GroupedData:
    """Rows of a tile together; few bytes are much work here, so the number of tasks is the session's and not made smaller by size."""
    keys = [*sets, "tx", "ty"]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def tile_box(tx: int, ty: int, tile: float) -> Box:
    return tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile


def fitted(lines: DataFrame, water: DataFrame, tile: float) -> tuple[int, DataFrame]:
    """How many tiles to put together each way so that lines (x1, y1, tx, ty) pass few of them, as long as no task gets more than CROWD edges;
    and of these larger tiles the ones of more than CROWD lines: tx, ty, parts. Of every CROWD lines at most one row is left."""
    begins = (F.floor(F.col("x1") / tile) == F.col("tx")) & (F.floor(F.col("y1") / tile) == F.col("ty"))
    seen = cut(lines.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if(begins).alias("own")))
    n, own = seen.agg(F.sum("n"), F.sum("own")).first()
    larger = lambda f: [F.floor(F.col(c) / f).alias(c) for c in ("tx", "ty")]
    f = 1
    while own and 1 + (n / own - 1) / f > PASSED:
        f *= 2
    while f > 1 and (water.groupBy(*larger(f)).count().agg(F.max("count")).first()[0] or 0) > CROWD:
        f //= 2
    full = seen.groupBy(*larger(f)).agg(F.sum("n").alias("n")).where(F.col("n") > CROWD)
    return f, full.select("tx", "ty", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))


def line_lengths(segs: DataFrame, edge: DataFrame, key: str, reach: dict[str, float], poly: str, tile: float, whole: str | None = None) -> DataFrame:
    """key and, for each name of ``reach``, the length of each line in the polygons or at most so far from them; lines without any may be missing.

    With ``whole``, the length of each line is under that name too, and none is missing. Lines that are long against the tiles get larger ones;
    where more lines stand in a tile than one task should hold, they are dealt to several, each with the tile's edges.
    """
    kind, halo = segs.schema[key].dataType.simpleString(), max(reach.values())
    segs = segs.select(key, "x1", "y1", "x2", "y2")
    f, crowded = fitted(spread(segs, tile), in_tiles(edge, poly, [], tile, halo), tile)
    tile *= f
    crowded = F.broadcast(crowded)
    part = F.coalesce(F.pmod(F.xxhash64(key, "x1", "y1", "x2", "y2"), F.col("parts")).cast("int"), F.lit(0))
    lines = spread(segs, tile).join(crowded, ["tx", "ty"], "left").select(key, "x1", "y1", "x2", "y2", "tx", "ty", part.alias("part"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    water = in_tiles(edge, poly, [], tile, halo).join(crowded, ["tx", "ty"], "left").withColumn("part", parts).drop("parts")
    near = [n for n, far in reach.items() if far]
    in_passing = [n for n, far in reach.items() if not far] if near else []

    def run(at: tuple, lines: pa.Table, rows: pa.Table) -> pa.Table:
        x1, y1, x2, y2 = (lines.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
        found = {n: np.zeros(len(x1)) for n in reach}
        if len(x1) and rows.num_rows:
            box, s = tile_box(at[1].as_py(), at[2].as_py(), tile), shape_of([rows])
            p, d = np.stack([x1, y1], axis=1), np.stack([x2 - x1, y2 - y1], axis=1)
            for n, far in reach.items():
                if n not in in_passing:
                    inside = found[in_passing[0]] if in_passing and n == near[0] else None
                    lengths(box, s, p, d, np.arange(len(x1)), far, found[n], inside=inside)
        for n in in_passing[1:]:
            found[n] = found[in_passing[0]]
        if whole:  # counted where the line begins
            found[whole] = ((np.floor(x1 / tile) == at[1].as_py()) & (np.floor(y1 / tile) == at[2].as_py())).astype(float)
        some = np.flatnonzero(np.any([f > 0 for f in found.values()], axis=0))
        size = np.hypot(x2 - x1, y2 - y1)[some]
        return pa.table([lines.column(key).take(pa.array(some)), *(pa.array(found[n][some] * size) for n in names)], [key, *names])

    names = [*([whole] if whole else []), *reach]
    found = by_tile(lines, "part").cogroup(by_tile(water, "part")).applyInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
