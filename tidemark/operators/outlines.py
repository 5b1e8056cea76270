"""Outlines of connected cells as polygons, put together across tasks.

Every side of a cell without a neighbour of its component is a directed edge with the cell on its left, where rows count downwards. Edges go to
the tile in which they begin and to the one in which they end; there each finds the one that follows it. Rings that a tile holds whole are done in it; of
the others it tells only the runs that enter and leave. These are put together by pointer jumping: in each round a run learns the smallest edge within
twice as many runs as before, and how far away it is, so that the rounds grow with the logarithm of the longest ring. The smallest
edge names the ring and the steps to it give the order, without a component or a long ring in one task. Areas are
sums over edges, so small polygons and all but the largest go before any ring becomes a value. Only the corners of the rings that stay are
collected, each ring as the one value that it is in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spatial import inside
from tidemark.operators.tiles import SIZE
from tidemark.operators.vector import simplify
from tidemark.sources.shared import cut


def outline_edges(cells: DataFrame, key: str = "component") -> DataFrame:
    """key, x1, y1, x2, y2: sides of cells (row, col) without a neighbour of the same key, the cell on the left."""
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "x1", "y1", "x2", "y2"), s)]) for s in ((-1, 0, 1, 0, 0, 0), (0, -1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 1), (0, 1, 1, 1, 1, 0))])
    all_sides = cells.select(key, "row", "col", F.explode(sides).alias("s"))
    other = cells.select(F.col(key).alias("_k"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    own = all_sides.join(other, (F.col(key) == F.col("_k")) & (F.col("row") + F.col("s.dr") == F.col("_r")) & (F.col("col") + F.col("s.dc") == F.col("_c")), "left_anti")
    return own.select(key, *[(F.col("col" if n[0] == "x" else "row") + F.col(f"s.{n}")).alias(n) for n in ("x1", "y1", "x2", "y2")])


def _number(rows: pa.Table) -> np.ndarray:
    return rows.column("name").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)


def _linked(rows: pa.Table, key: str, top: int, left: int, size: int) -> pa.Table:
    """Rows of a tile (see ``chained``) from the edges that begin in it (own) and those that only end in it."""
    e = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("x1", "y1", "x2", "y2")], axis=1)
    k, mine = _number(rows), rows.column("own").to_numpy(zero_copy_only=False)
    order = np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0], k, ~mine))  # own ones come first, in the order of key and edge
    e, k, n, source = e[order], k[order], int(mine.sum()), rows.column(key).take(pa.array(order))
    code = lambda x, y: (k * size + x - left) * size + y - top
    start = code(e[:, 0], e[:, 1])[:n]
    ends = np.flatnonzero((e[:, 2] // size == left // size) & (e[:, 3] // size == top // size))
    wanted = code(e[:, 2], e[:, 3])[ends]
    first, last = np.searchsorted(start, wanted), np.searchsorted(start, wanted, "right") - 1
    there = first <= last
    ends, first, last = ends[there], first[there], last[there]
    d = e[:, 2:] - e[:, :2]
    turn = lambda a, b: d[b, 0] * d[a, 1] - d[b, 1] * d[a, 0]
    follows = np.where(turn(ends, last) >= turn(ends, first), last, first)
    corner = np.ones(n, dtype=bool)
    corner[follows] = (d[follows] != d[ends]).any(axis=1)
    within = ends < n
    follow, back = np.full(n, -1), np.full(n, -1)
    follow[ends[within]], back[follows[within]] = follows[within], ends[within]
    # to the beginning of each run by doubling steps; what has none is a ring
    jump, off, span = np.where(back < 0, np.arange(n), back), (back >= 0).astype(np.int64), 1
    while span < n:
        jump, off, span = jump[jump], off + off[jump], span * 2
    closed = back[jump] >= 0 if n else np.zeros(0, dtype=bool)
    low, steps, ahead, span = np.arange(n), np.zeros(n, dtype=np.int64), np.where(closed, follow, np.arange(n)), 1
    while span < n:
        better = low[ahead] < low
        low, steps, ahead, span = np.where(better, low[ahead], low), np.where(better, steps[ahead] + span, steps), ahead[ahead], span * 2
    count = np.bincount(low[closed], minlength=n) if n else low
    ring, run = np.flatnonzero(closed), np.flatnonzero(~closed)
    run = run[np.argsort(jump[run], kind="stable")]
    heads = np.flatnonzero(np.diff(jump[run], prepend=-1))
    least = np.minimum.reduceat(run, heads) if len(run) else run
    head, tail = jump[run[heads]], run[(follow[run] < 0)]
    tail = tail[np.argsort(jump[tail])]
    visit = np.flatnonzero(~within)
    none = lambda m: np.zeros(m, dtype=np.int64)
    parts = [
        (RING, ring, low[ring], ring, none(len(ring)), (count[low[ring]] - steps[ring]) % np.maximum(count[low[ring]], 1), corner[ring]),
        (RUN, run, jump[run], run, none(len(run)), off[run], corner[run]),
        (PATH, tail, head, least, off[tail] + 1, off[least], np.zeros(len(tail), dtype=bool)),
        (LINK, ends[visit], follows[visit], ends[visit], none(len(visit)), none(len(visit)), np.zeros(len(visit), dtype=bool)),
    ]
    kind = np.concatenate([np.full(len(p[1]), p[0], dtype=np.int32) for p in parts])
    a, b, c, size_, at, bends = (np.concatenate([p[i] for p in parts]) for i in range(1, 7))
    return pa.table([pa.array(kind), source.take(pa.array(a)), _edges(e[a]), _edges(e[b]), _edges(e[c]), pa.array(size_), pa.array(at), pa.array(bends)], ["kind", key, "edge", "head", "low", "n", "pos", "corner"])


def _edges(e: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in e.T], ["x1", "y1", "x2", "y2"])


#: What a tile tells: edges of rings that it holds whole, edges of runs that leave it, these runs, and which run follows an edge from outside.
RING, RUN, PATH, LINK = range(4)
_EDGE = "struct<x1:long,y1:long,x2:long,y2:long>"


def chained(edges: DataFrame, key: str = "component", size: int = SIZE) -> DataFrame:
    """key, ring, pos, corner, x1, y1, x2, y2: edges with their ring, their place in it and whether it turns where they begin.

    ring: the smallest of its edges (struct x1, y1, x2, y2), where pos is 0. Where two outlines touch, a ring stays with its own cells.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    tile = lambda n: F.floor(F.col(n) / F.lit(size)).cast("long")
    own = F.struct(tile("x1").alias("tx"), tile("y1").alias("ty"), F.lit(True).alias("own"))
    other = F.struct(tile("x2").alias("tx"), tile("y2").alias("ty"), F.lit(False).alias("own"))
    inner = (tile("x1") == tile("x2")) & (tile("y1") == tile("y2"))
    dealt = edges.select(key, F.to_json(F.struct(key)).alias("name"), "x1", "y1", "x2", "y2", F.explode(F.when(inner, F.array(own)).otherwise(F.array(own, other))).alias("t"))

    def run(at: tuple, rows: pa.Table) -> pa.Table:
        return _linked(rows, key, at[1].as_py() * size, at[0].as_py() * size, size)

    found = dealt.select(key, "name", "x1", "y1", "x2", "y2", "t.tx", "t.ty", "t.own").groupBy("tx", "ty").applyInArrow(run, f"kind int, {key} {kinds[key]}, edge {_EDGE}, head {_EDGE}, low {_EDGE}, n long, pos long, corner boolean")
    found = cut(found)
    links = found.where(F.col("kind") == LINK).select(F.col(key).alias("_key"), F.col("edge").alias("_edge"), F.col("head").alias("_next"))
    paths = found.where(F.col("kind") == PATH).join(links, F.col(key).eqNullSafe(F.col("_key")) & (F.col("edge") == F.col("_edge")))
    name = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("edge"))
    now = paths.select(name("head").alias("id"), name("_next").alias("next"), name("low").alias("low"), F.col("pos").alias("steps"), F.col("n").alias("far"), "n")
    now, before = cut(now), None
    while True:
        mark = now.agg(F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()[0]  # one number
        if mark == before:
            break
        before = mark
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("low").alias("l2"), F.col("steps").alias("s2"), F.col("far").alias("f2"))
        lower = F.col("l2") < F.col("low")
        now = cut(now.join(ahead, "next").select("id", F.col("n2").alias("next"), F.when(lower, F.col("l2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("far") + F.col("s2")).otherwise(F.col("steps")).alias("steps"), (F.col("far") + F.col("f2")).alias("far"), "n"))
    sizes = now.groupBy("low").agg(F.sum("n").alias("all"))
    placed = now.join(sizes, "low").select("id", F.col("low.edge").alias("ring"), "steps", "all")
    runs = found.where(F.col("kind") == RUN).select(name("head").alias("id"), key, "edge", F.col("pos").alias("off"), "corner").join(placed, "id").select(key, "ring", F.pmod(F.col("off") - F.col("steps"), F.col("all")).alias("pos"), "corner", "edge")
    whole = found.where(F.col("kind") == RING).select(key, F.col("head").alias("ring"), "pos", "corner", "edge").unionByName(runs)
    ends = ("x1", "y1", "x2", "y2")
    ring = F.struct(*[F.col(f"ring.{n}").cast(kinds[n]).alias(n) for n in ends])
    return whole.select(key, ring.alias("ring"), "pos", "corner", *[F.col(f"edge.{n}").cast(kinds[n]).alias(n) for n in ends])


def ring_areas(chain: DataFrame, key: str = "component") -> DataFrame:
    """key, ring, area: positive for outer rings, negative for holes."""
    base = F.col("ring.y1")
    return chain.groupBy(key, "ring").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y1") - base + F.col("y2") - base) / 2).alias("area"))


def rings(edges: DataFrame, key: str = "component") -> DataFrame:
    """key, ring (array<struct<x,y>>): outline edges joined end to end, corners only."""
    return _points(chained(edges, key), key).select(key, F.col("points").alias("ring"))


def _points(chain: DataFrame, key: str) -> DataFrame:
    at = F.struct("pos", F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    ordered = chain.where("corner").groupBy(key, "ring").agg(F.array_sort(F.collect_list(at)).alias("p"))
    return ordered.select(key, "ring", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def polygons(cells: DataFrame, width: float = 1.0, least_area: float = 0.0, most: int | None = None, tolerance: float = 0.0, key: str = "component", tile: float = 64.0) -> DataFrame:
    """key, shell, area, rings of the polygons that cells (key, row, col) form; ``width`` is a cell's, areas and coordinates are in its unit.

    Each hole belongs to the smallest outer ring of its component around it. Polygons under ``least_area`` go; of the rest the ``most`` largest
    stay (ties to the smaller key and shell); their rings, the outer one first, are simplified by ``tolerance``.
    """
    chain = cut(chained(outline_edges(cells, key), key))
    area = cut(ring_areas(chain, key))
    sign = F.signum("area")
    outer = chain.join(area.where(sign > 0).select(key, "ring"), [key, "ring"], "left_semi").select(F.struct(key, "ring").alias("poly_id"), "x1", "y1", "x2", "y2")
    # a point of the region beside the first edge of each hole
    first = chain.where("pos = 0").join(area.where(sign < 0), [key, "ring"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = first.select(F.struct(key, "ring").alias("hole"), ((F.col("x1") + F.col("x2")) / 2 + dy * 0.25).alias("px"), ((F.col("y1") + F.col("y2")) / 2 - dx * 0.25).alias("py"))
    within = inside(side, outer, "hole", "px", "py", tile=tile).where(F.col(f"hole.{key}").eqNullSafe(F.col(f"poly_id.{key}")))
    shells = area.where(sign > 0).select(F.struct(key, "ring").alias("poly_id"), F.col("area").alias("outer"))
    owner = within.join(shells, "poly_id").groupBy("hole").agg(F.min(F.struct("outer", "poly_id")).alias("o")).select(F.col(f"hole.{key}").alias(key), F.col("hole.ring").alias("ring"), F.col("o.poly_id.ring").alias("shell"))
    member = area.where(sign > 0).select(key, "ring", F.col("ring").alias("shell"), "area").unionByName(area.join(owner, [key, "ring"]).select(key, "ring", "shell", "area"))
    member = cut(member)
    whole = member.groupBy(key, "shell").agg((F.sum("area") * width * width).alias("area")).where(F.col("area") >= least_area)
    if most is not None:
        whole = whole.orderBy(F.desc("area"), key, "shell").limit(most)
    whole = cut(whole)
    kept = member.drop("area").join(whole.select(key, "shell"), [key, "shell"], "left_semi")
    points = _points(chain.join(kept.select(key, "ring"), [key, "ring"], "left_semi"), key).join(kept, [key, "ring"])
    scaled = points.withColumn("points", F.transform("points", lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * width).alias("y"))))
    if tolerance > 0:
        closed = simplify(F.concat("points", F.slice("points", 1, 1)), F.lit(float(tolerance)))
        scaled = scaled.withColumn("points", closed).withColumn("points", F.slice("points", 1, F.size("points") - 1)).where(F.size("points") >= 3)
    one = F.struct((F.col("ring") != F.col("shell")).alias("hole"), "ring", "points")
    put = scaled.groupBy(key, "shell").agg(F.array_sort(F.collect_list(one)).alias("r")).select(key, "shell", F.transform("r", lambda r: r["points"]).alias("rings"))
    return put.join(whole, [key, "shell"]).select(key, "shell", "area", "rings")
