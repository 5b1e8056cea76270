"""Exact top-k search by a Voronoi kNN join.

Vectors are grouped by their nearest pivot; pivots are rows, and there are more of them in larger tables. Summaries of the
groups (rows and radius for each ring of a cell) and the pivots' own scores give every query a score that its best k
neighbours surely reach, and every (query group, cell) the smallest distance from the cell's pivot at which a row can
still matter. Only such rows are copied to the query group; the group is solved in bounded chunks by matrix products,
and the chunks' best rows are merged. Vectors travel packed in the smallest integer type that holds a batch.

With integer components and inner product as score: q.x <= q.p + |q||x - p| for the pivot p of x's cell.

Rows that are equal in vector and id are one row with a count. Ties go to the smaller id, so of equal vectors only the
k + 1 smallest ids can appear in any answer, and equal queries are solved once.

A query's own row takes no part in its answer, once; other rows of the same id do. If an id is repeated, each of its rows
is a query with an answer of its own.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
vectors are compared with those of their own length only; an empty table gives no rows. Components and scores must fit into 64 bits
after scaling: larger ones raise an error that says so, and nothing is rounded or wrapped around.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

LEAST_PIVOTS, MOST_PIVOTS, QUERY_BLOCK, CHUNK, SCORES = 16, 256, 2048, 16_384, 1 << 22
LIMIT, TOO_LARGE = 1 << 62, "top-k search: a component or score doesn't fit into 64 bits"


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, v: floor(scale * component) as long, of the vectors that take part."""
    size = lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) >= float(LIMIT), F.raise_error(F.lit(TOO_LARGE)).cast("double")).otherwise(x.cast("double") * scale))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, size).alias("v"))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column."""
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return [flat[a:b] for a, b in zip(starts, starts[1:])]


def _packed(vectors: list[np.ndarray]) -> pa.Array:
    """Each vector in the bytes of the smallest integer type for all of them, after the bytes a component takes."""
    most = max((int(np.abs(v).max()) for v in vectors if len(v)), default=0)
    size = next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n - 1))
    return pa.array([bytes([size]) + v.astype(f"i{size}").tobytes() for v in vectors], pa.binary())


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=f"i{x[0]}", offset=1).astype(np.int64) for x in column.to_pylist()]


def _near(vectors: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of the same length and the distance from it; -1 and 0 where there is none."""
    cell, far = np.full(len(vectors), -1, dtype=np.int32), np.zeros(len(vectors))
    for d in {len(v) for v in vectors}:
        own = [i for i, p in enumerate(pivots) if len(p) == d]
        rows = np.array([i for i, v in enumerate(vectors) if len(v) == d])
        if own:
            x, p = np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), d), np.array([pivots[i] for i in own], dtype=np.float64).reshape(len(own), d)
            gap = np.stack([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in p], axis=1)
            best = gap.argmin(axis=1)
            cell[rows], far[rows] = np.array(own)[best], gap[np.arange(len(rows)), best]
    return cell, far


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if q.size and x.size and int(np.abs(q).max()) * int(np.abs(x).max()) * q.shape[1] >= 1 << 53:
        exact = q.astype(object) @ x.astype(object).T
        if max(exact.max(), -exact.min()) >= 1 << 63:
            raise OverflowError(TOO_LARGE)
        return exact.astype(np.int64)
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to the smaller column."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    begin = np.searchsorted(row, np.arange(len(scores)))
    kept = np.arange(len(row)) - begin[row] < k
    return row[kept], column[kept]


def top_k_inner(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of ``vectors`` (id, v) with ``is_query``."""
    vectors = cut(vectors)
    first = Window.partitionBy("v").orderBy("id")
    data = vectors.groupBy("v", "id").agg(F.count("*").alias("n")).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k + 1).select("id", "v", F.least("n", F.lit(k + 1)).cast("int").alias("n"))
    members = vectors.where(is_query)
    # equal ids may stand for several vectors, so a query is known by its vector's number
    asked = cut(members.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"))

    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(vectors.count()) // 4))
    pivots = [np.array(r["v"], dtype=np.int64) for r in data.orderBy(F.xxhash64("id", "v"), "id", "v").limit(most).select("v").collect()]

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column("v"))
            cell, far = _near(rows, pivots)
            ring = np.floor(2 * np.log2(far + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), pa.array(ring), b.column("id"), _packed(rows), b.column("n")], ["cell", "far", "ring", "id", "v", "n"])

    cells = cut(data.mapInArrow(to_cells, "cell int, far double, ring int, id long, v binary, n int"))
    rings = [(r["cell"], r["far"], r["rows"]) for r in cells.groupBy("cell", "ring").agg(F.max("far").alias("far"), F.count("*").alias("rows")).collect()]
    used = sorted({c for c, _, _ in rings if c >= 0})

    # no more groups of queries than blocks of them: a row is copied once for each group that may need it
    groups = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its group, the nearest of the first pivots, and for each cell the least distance at which a row matters."""
        for b in batches:
            rows = _matrix(b.column("v"))
            group, _ = _near(rows, pivots[:groups])
            need = []
            for q in rows:
                q_ = q.astype(np.float64)
                size = float(np.sqrt((q_**2).sum()))
                dot = {c: float(q_ @ pivots[c].astype(np.float64)) for c in used if len(pivots[c]) == len(q)}
                scored = sorted((float(q_ @ p.astype(np.float64)) for p in pivots if len(p) == len(q)), reverse=True)
                sure, floor = 0, scored[k] if len(scored) > k else -math.inf
                for low, n in sorted(((dot[c] - size * far, n) for c, far, n in rings if c in dot), reverse=True):
                    sure += n
                    if sure > k:
                        floor = max(floor, low)
                        break
                slack = 1e-9 * (abs(floor) + size * size) + 1e-6 if floor > -math.inf else 0.0
                need.append([{"cell": c, "least": -1.0 if floor == -math.inf or not size else (floor - slack - x) / size} for c, x in dot.items()] + [{"cell": -1, "least": -1.0}])
            yield pa.RecordBatch.from_arrays([pa.array(group), b.column(0), _packed(rows), pa.array(need, pa.list_(pa.struct([("cell", pa.int32()), ("least", pa.float64())])))], ["grp", "query", "v", "need"])

    queries = cut(asked.select("query", "v").mapInArrow(to_groups, "grp int, query long, v binary, need array<struct<cell:int,least:double>>"))
    sizes = queries.groupBy("grp").agg(F.count("*").alias("n")).collect()
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["grp"], math.ceil(r["n"] / QUERY_BLOCK))]), F.col("grp")), F.lit(1)) if sizes else F.lit(1)
    queries = queries.withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int"))
    needs = queries.select(F.col("grp").alias("to_grp"), F.col("part").alias("to_part"), F.explode("need").alias("need")).groupBy("to_grp", "to_part", F.col("need.cell").alias("to_cell")).agg(F.min("need.least").alias("least"))
    chunks = max(1, math.ceil(sum(n for _, _, n in rings) / CHUNK))
    copies = cells.join(needs, (F.col("cell") == F.col("to_cell")) & (F.col("far") >= F.col("least"))).select("to_grp", "to_part", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int").alias("chunk"), "id", "v", "n")
    spread = queries.select("grp", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.col("query").alias("id"), "v")

    def solve(asking: pa.Table, having: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if asking.num_rows and having.num_rows:
            having = having.sort_by("id")
            qs, xs = _unpacked(asking.column("v")), _unpacked(having.column("v"))
            qn, xn = (np.array([len(v) for v in vectors]) for vectors in (qs, xs))
            qid, xid, times = asking.column("id").to_numpy(), having.column("id").to_numpy(), having.column("n").to_numpy()
            for d in set(qn.tolist()) & set(xn.tolist()):
                xi = np.flatnonzero(xn == d)
                x = np.array([xs[i] for i in xi]).reshape(len(xi), d)
                step = max(1, SCORES // len(xi))
                every = np.flatnonzero(qn == d)
                for qi in np.split(every, np.arange(step, len(every), step)):
                    q = np.array([qs[i] for i in qi]).reshape(len(qi), d)
                    scores = _products(q, x)
                    row, column = _best(scores, k + 1)
                    for to, found in zip(out, (qid[qi[row]], xid[xi[column]], scores[row, column], times[xi[column]], (q[row] == x[column]).all(axis=1))):
                        to.append(found)
        names, kinds = ("query", "vec_id", "score", "n", "twin"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], names)

    part = spread.groupBy("grp", "part", "chunk").cogroup(copies.groupBy("to_grp", "to_part", "chunk")).applyInArrow(solve, "query long, vec_id long, score long, n int, twin boolean")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "twin")
    merged = part.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k + 1)
    answers = merged.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_rn", "vec_id", "score", "n", "twin"))).alias("best"))
    own = members.select("v", F.col("id").alias("query_id")).join(asked, "v").select("query_id", "query")
    times = lambda x: x["n"] - F.when(x["twin"] & (x["vec_id"] == F.col("query_id")), 1).otherwise(0)
    kept = F.slice(F.flatten(F.transform("best", lambda x: F.array_repeat(F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")), times(x)))), 1, k)
    return (
        own.join(answers, "query")
        .select("query_id", F.posexplode(kept).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner(quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 50 == 0, 5)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.row <> q.row WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
