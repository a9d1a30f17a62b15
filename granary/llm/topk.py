"""Operator 10: exact top-k by integer inner product, by dual cover trees.

Method: in each task a block of queries and a block of data are each indexed by a cover tree (children
are picked farthest-first, so they lie apart by at least the radius that they cover; every node
knows its exact covering radius).  Node pairs are visited from the most promising on and pruned where
the best possible product of any pair below them, <p, q> + rp |q| + rq |p| + rp rq, is less than the worst k-th
score of the query group.  Ties are never pruned.

The top level of the tree is shared by all tasks: up to ``max_cells`` centers picked farthest-first from a sample of
``sample`` rows; every row goes to the cell of its nearest center, and each cell knows its exact radius and greatest norm.  A first pass
searches the own cell of every query, which gives a floor for its k-th score.  Then a query goes only to those cells whose best
possible product, min(<q, c> + r |q|, |q| max |p|), reaches its floor, and a cell's rows only to the blocks of queries that ask for them:
pairs of blocks are pruned before the shuffle.  Cells and the queries of a cell are cut into blocks by hash, so no group grows with
the data, and a task holds a block of each.  Its k best per query go on to a merge by query.  Vectors of a length that the sample
lacks have one cell of their own.

A component x becomes floor(64 x).  Vectors that are null or hold null or non-finite components take no
part; vectors of different lengths have no product.  Every row is a candidate, also of a repeated id, but for the rows
of the query's own id, as in the SQL; query rows of one id share its k places.  Equal rows beyond the k-th can't be in a
result and are left out before the search.  Ties go by id; rows equal in id and score can't be told apart in the result.  A query with fewer than k
candidates gets them all; an empty table gives no rows; null ids take no part; other columns don't matter.  Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, pieces, read_table, ship, stage, staging

K, SCALE = 20, 64
CELL_ROWS, MAX_CELLS, SAMPLE = 8192, 1024, 4096  # rows a cell aims at, cells, rows that centers are picked from
LEAF, FANOUT, CHUNK = 48, 16, 1024  # rows of a leaf, children, data rows compared at once


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray, children: list):
        self.center, self.norm, self.radius, self.rows, self.children = center, float(np.linalg.norm(center)), radius, rows, children


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, first: int | None = None) -> Node:
    """A tree over the rows of ``points``; leaves hold up to ``LEAF`` rows, or any number of equal ones."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    at = 0 if first is None else int(np.flatnonzero(rows == first)[0])
    away = np.linalg.norm(own - own[at], axis=1)
    node = Node(own[at], float(away.max()), rows, [])
    if len(rows) <= LEAF or node.radius == 0:
        return node
    nearest, owner, centers = away, np.zeros(len(rows), np.int64), [at]
    while len(centers) < FANOUT and nearest.max() > node.radius / 2:
        new = int(nearest.argmax())
        distance = np.linalg.norm(own - own[new], axis=1)
        closer = distance < nearest
        owner[closer] = len(centers)
        nearest = np.where(closer, distance, nearest)
        centers.append(new)
    for i, center in enumerate(centers):
        node.children.append(cover_tree(points, rows[owner == i], int(rows[center])))
    return node


class Search:
    """Exact k best data rows of every query row."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        limit = max((float((np.abs(x).astype(np.float64) ** 2).sum(1).max()) if len(x) else 0.0) for x in (queries, data))
        self.wide = limit >= 2.0**52  # else products and their sums are exact in doubles
        self.q, self.p = queries.astype(np.float64), data.astype(np.float64)
        self.exact = (queries, data)
        self.query_ids, self.data_ids, self.k = query_ids, data_ids, k
        n = len(queries)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), np.int64)
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)] if self.wide else []
        self.floor = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
        self.floor -= np.where(np.abs(self.floor) < 2.0**52, 0, np.abs(self.floor) * 1e-9)  # products are exact in doubles up to there
        self.worst = self.floor.copy()

    def results(self) -> list[list[tuple[int, int]]]:
        """(score, id) of each query, best first."""
        if self.wide:
            return [[(-s, i) for s, i in row] for row in self.found]
        return [[(int(s), i) for s, i in zip(row, own) if s > -np.inf] for row, own in zip(self.scores.tolist(), self.ids.tolist())]

    def run(self) -> None:
        if not len(self.q) or not len(self.p):
            return
        root, data = cover_tree(self.q), cover_tree(self.p)
        self.visit(root, [data])

    def bounds(self, node: Node, others: list[Node]) -> np.ndarray:
        centers = np.stack([o.center for o in others])
        norms, radii = np.array([o.norm for o in others]), np.array([o.radius for o in others])
        top = centers @ node.center + node.radius * norms + radii * node.norm + node.radius * radii
        return top + 1e-9 * (1 + np.abs(top) + node.norm * norms)

    def visit(self, node: Node, others: list[Node]) -> None:
        """Every pair of a query below ``node`` and a row below ``others``."""
        if node.children:
            opened = [c for o in others for c in (o.children or [o])] if len(others) < 256 else others
            keep = self.bounds(node, opened) >= self.worst[node.rows].min()
            opened = [o for o, use in zip(opened, keep.tolist()) if use]
            for child in node.children:
                self.visit(child, opened)
            return
        queue = [(-b, i, o) for i, (b, o) in enumerate(zip(self.bounds(node, others).tolist(), others))]
        heapq.heapify(queue)
        serial, waiting, size = len(queue), [], 0
        while queue:
            bound, _, other = heapq.heappop(queue)
            if -bound < self.worst[node.rows].min():
                break
            if not other.children:
                waiting.append(other.rows)
                size += len(other.rows)
                if size >= CHUNK:
                    self.leaves(node.rows, np.concatenate(waiting))
                    waiting, size = [], 0
                continue
            for b, child in zip(self.bounds(node, other.children).tolist(), other.children):
                if b >= self.worst[node.rows].min():
                    heapq.heappush(queue, (-b, serial, child))
                    serial += 1
        if waiting:
            self.leaves(node.rows, np.concatenate(waiting))

    def leaves(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Exact products of the queries in ``rows`` with the data in ``others``."""
        ids, k = self.data_ids[others], self.k
        if self.wide:
            products = self.exact[0][rows].astype(object) @ self.exact[1][others].astype(object).T
            for i, row in enumerate(rows.tolist()):
                new = [(-int(s), j) for s, j in zip(products[i], ids.tolist()) if j != self.query_ids[row]]
                self.found[row] = heapq.nsmallest(k, self.found[row] + new)
                if len(self.found[row]) == k:
                    last = -self.found[row][-1][0]
                    self.worst[row] = max(self.floor[row], last - abs(last) * 1e-9)  # bounds are doubles: the last bits don't prune
            return
        products = self.q[rows] @ self.p[others].T
        products[self.query_ids[rows][:, None] == ids] = -np.inf
        scores = np.concatenate((self.scores[rows], products), axis=1)
        kth = scores.shape[1] - k
        least = np.partition(scores, kth, axis=1)[:, kth]
        own = self.ids[rows]
        for i, row in enumerate(rows.tolist()):
            use = np.flatnonzero(scores[i] >= least[i])
            found = np.concatenate((own[i], ids))[use] if len(use) > 4 * k else np.where(use < k, own[i][np.minimum(use, k - 1)], ids[np.maximum(use - k, 0)])
            order = np.lexsort((found, -scores[i][use]))[:k]
            self.scores[row], self.ids[row] = scores[i][use][order], found[order]
        self.worst[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 1) -> DataFrame:
    """vec_id, v (integers): the rows that take part, of equal ones up to ``copies``."""
    v = F.col("v")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("vec_id", F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(copies)).cast("int")))).select("vec_id", "v")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def pick_centers(data: DataFrame, cells: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centers by vector length, picked farthest-first from at most ``sample`` rows (those of least hash)."""
    rows = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toArrow()["v"].to_pylist()
    sizes = {}
    for v in rows:
        sizes.setdefault(len(v), []).append(v)
    out = {}
    for size, own in sizes.items():
        points = np.array(own, np.float64).reshape(len(own), size)
        chosen, away = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < max(1, cells * len(own) // len(rows)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[size] = points[chosen]
    return out


def _in_cells(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, v, size, cell (-1 for a length without centers), distance to the center, norm."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)  # at most ``max_cells`` vectors

    def run(batches):
        for batch in pieces(batches, 4096):
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            cell, away, norm = np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = _matrix(batch.column(1).take(pa.array(at)), len(at)).astype(np.float64)
                norm[at] = np.linalg.norm(own, axis=1)
                if (c := shared.value.get(size)) is not None:
                    cell[at] = ((c * c).sum(1)[None, :] - 2 * own @ c.T).argmin(1)
                    away[at] = np.linalg.norm(own - c[cell[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell, pa.int32()), pa.array(away), pa.array(norm)], ["vec_id", "v", "size", "cell", "away", "norm"])

    return map_batches(rows.select("vec_id", "v"), run, "vec_id long, v array<long>, size int, cell int, away double, norm double")


def _search(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query among the data of its group.  ``left`` has a floor of the k-th score or null."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return schema.empty_table()
        (query_ids, q), (data_ids, p) = ((t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), len(t))) for t in (mine, theirs))
        floor = pc.fill_null(mine["floor"].cast(pa.float64(), safe=False), -np.inf).to_numpy()
        search = Search(q, query_ids, p, data_ids, k, floor)
        search.run()
        rows = [(int(i), j, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, found in zip(query_ids, search.results()) for s, j in found]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else schema.empty_table()

    ship(left.sparkSession)
    side = lambda df, *more: df.select(*keys, "vec_id", "v", *more).groupBy(*keys)
    return side(left, "floor").cogroup(side(right)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cells_in_reach(queries: DataFrame, stats: list, centers: dict[int, np.ndarray]) -> DataFrame:
    """The queries, once for each other cell whose best possible product reaches the floor: columns and ``target``."""
    table = {size: [(r["cell"], r["radius"], r["largest"]) for r in stats if r["size"] == size] for size in centers}
    shared = queries.sparkSession.sparkContext.broadcast((table, centers))  # a row a cell
    names = queries.columns

    def run(batches):
        for batch in pieces(batches, 2048):
            sizes = batch.column(names.index("size")).to_numpy()
            own = batch.column(names.index("cell")).to_numpy()
            floor = pc.fill_null(batch.column(names.index("floor")).cast(pa.float64(), safe=False), -np.inf).to_numpy(zero_copy_only=False)
            rows, targets = [], []
            for size in np.unique(sizes).tolist():
                cells = shared.value[0].get(size)
                if not cells:  # one cell holds all of this length
                    continue
                at = np.flatnonzero(sizes == size)
                q = _matrix(batch.column(names.index("v")).take(pa.array(at)), len(at)).astype(np.float64)
                norm = np.linalg.norm(q, axis=1)[:, None]
                ids, radius, largest = (np.array(c) for c in zip(*cells))
                product = q @ shared.value[1][size][ids].T
                top = np.minimum(product + norm * radius, norm * largest)
                top += 1e-9 * (1 + np.abs(product) + norm * (radius + largest))
                found = np.nonzero((top >= floor[at][:, None]) & (ids[None, :] != own[at][:, None]))
                rows.append(at[found[0]])
                targets.append(ids[found[1]])
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(np.concatenate(rows))).columns, pa.array(np.concatenate(targets), pa.int32())], [*names, "target"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return map_batches(queries, run, schema + ", target int")


def top_k(queries: DataFrame, data: DataFrame, k: int = K, query_block: int = 4096, data_block: int = 8192, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score; both sides as ``integer_vectors`` gives them."""
    root = staging(data.sparkSession, "topk")
    data = stage(data.select("vec_id", "v"), f"{root}/vectors")
    centers = pick_centers(data, min(max_cells, -(-data.count() // cell_rows)), sample)
    place = ["size", "cell"]
    points = stage(_in_cells(data, centers), f"{root}/points")
    asked = stage(_in_cells(queries, centers), f"{root}/queries")
    held = points.groupBy(*place).agg(F.max("away").alias("radius"), F.max("norm").alias("largest"), F.ceil(F.count(F.lit(1)) / data_block).cast("int").alias("blocks"))
    held = stage(held, f"{root}/cells")
    met = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("query_blocks"))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = held.join(met, place)
    asked = asked.join(both.select(*place, "query_blocks"), place).select(*place, "vec_id", "v", block("query_blocks").alias("qb"), F.lit(None).cast("long").alias("floor"))
    points = points.join(held.select(*place, "blocks"), place).select(*place, "vec_id", "v", block("blocks").alias("db"))
    left = asked.join(held.select(*place, "blocks"), place).select("*", every("blocks").alias("db"))
    right = points.join(both.select(*place, "query_blocks"), place).select("*", every("query_blocks").alias("qb"))
    near = stage(_best(_search(left, right, [*place, "qb", "db"], k), k), f"{root}/near")
    floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    asking = asked.drop("floor").join(floors, "vec_id", "left").select(*place, "vec_id", "v", "qb", F.col("known").alias("floor"))
    stats = held.filter("cell >= 0").collect()  # a row a cell
    sent = cells_in_reach(asking, stats, centers).withColumnRenamed("cell", "own").withColumnRenamed("target", "cell")
    sent = stage(sent.join(held.select(*place, "blocks"), place).select(*place, "own", "qb", "vec_id", "v", "floor", every("blocks").alias("db")), f"{root}/sent")
    wanted = sent.select(*(F.col(c).alias(c) for c in (*place, "db", "own", "qb"))).distinct()
    far = _search(sent, points.join(wanted, [*place, "db"]), [*place, "db", "own", "qb"], k)
    return _best(near.drop("rank").unionByName(far), k)


def query(spark, sf_dir):
    data = integer_vectors(read_table(spark, sf_dir, "embeddings"), copies=K)
    return top_k(data.filter(F.col("vec_id") % 20 == 0), data)


ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
