"""Nearest neighbours by cosine from a hierarchical k-means tree, best bin first.

1. A tree of spherical k-means is fitted on a bounded sample (``SAMPLE`` vectors by a hash
   of their values): nodes are split ``BRANCH``-fold until a leaf stands for ``LEAF`` rows
   of the table, or for ``LEAST_SAMPLE`` of the sample. Its size is bounded by the sample's,
   so it is broadcast. All rows are then placed in its leaves. Rows of leaves that are
   crowded, because the sample can't split them further, are dealt by hash to parts.
2. A query goes down the tree with a priority queue: the nearest node yet unopened is
   opened next, whether it lies under the last one or not. Leaves come in that order.
3. Calibration: ``CALIBRATION`` queries by hash are compared with all rows in blocks. The
   width, the number of leaves a query visits, is doubled until the mean share of true
   neighbours found reaches ``TARGET``.
4. All queries visit so many leaves in two rounds. The first, over an eighth of them, gives
   each query the score that its second round must reach.
5. Equal vectors: a query's nearest ``k`` hold none but the first ``k + 1`` of them by id, so
   no more are searched, and equal queries are searched once. Neither changes a result.

Scores are sums of products over the original components in double precision, the same for
equal vectors, divided by the lengths.

Cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows
without an id, take no part; vectors of different lengths are no candidates for one
another, each length has a tree of its own; rows that repeat an id count once, by the vector
of the smallest digest; ties go to the smaller id; an empty table, or one without queries,
gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybridge.llm import arrays
from tallybridge.llm.vector_tables import directions, foremost, matrix
from tallybridge.workspace import Workspace

SAMPLE = 32_768
BRANCH, LEAF, LEAST_SAMPLE = 16, 256, 24
STEPS = 8
CALIBRATION, TARGET = 256, 0.95
# Rows of a block, and queries that meet it at a time.
MEMBERS, ASKED = 4096, 1024
# Components that a re-scoring of candidates holds at a time.
_HELD = 1 << 22
# Rounding of products of matrices, against which candidates are scored anew.
_MARGIN = 1e-9

_ROWS = "vec_id long, dim int, key binary, x binary"
_HITS = "q long, vec_id long, score double"


class Tree:
    """Nodes with unit centres; a node's children stand together, a leaf has none."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray, leaf: np.ndarray) -> None:
        self.centres, self.first, self.count, self.leaf = centres, first, count, leaf

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def place(self, units: np.ndarray) -> np.ndarray:
        """The leaf at the end of the way down by the nearest children."""
        at = np.zeros(len(units), np.int64)
        while True:
            open_ = np.flatnonzero(self.count[at])
            if not len(open_):
                return self.leaf[at]
            for node in np.unique(at[open_]):
                own = open_[at[open_] == node]
                a, n = self.first[node], self.count[node]
                at[own] = a + np.argmax(units[own] @ self.centres[a : a + n].T, axis=1)

    def visits(self, unit: np.ndarray, width: int) -> list[int]:
        """The first ``width`` leaves, best bin first."""
        found: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(found) < width:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                continue
            a, n = int(self.first[node]), int(self.count[node])
            for child, near in enumerate((self.centres[a : a + n] @ unit).tolist(), a):
                heapq.heappush(queue, (-near, child))
        return found


def _split(units: np.ndarray, ways: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and the nearest one of every vector."""
    rng = np.random.RandomState(seed)
    centres = units[rng.choice(len(units), ways, replace=False)]
    for _ in range(STEPS):
        near = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    near = np.argmax(units @ centres.T, axis=1)
    used = np.unique(near)
    return centres[used], np.searchsorted(used, near)


def fit(sample: np.ndarray, rows: int) -> Tree:
    """A tree for a table of ``rows`` vectors, from unit vectors of a sample."""
    dim = sample.shape[1]
    centres, first, count, leaf = [np.zeros(dim)], [0], [0], [-1]
    waiting, leaves = [(0, np.arange(len(sample)))], 0
    while waiting:
        node, own = waiting.pop()
        stands_for = len(own) * rows / max(len(sample), 1)
        ways = min(BRANCH, int(stands_for // LEAF), len(own) // LEAST_SAMPLE)
        parts = _split(sample[own], ways, node) if ways > 1 else None
        if parts is None or len(parts[0]) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], count[node] = len(centres), len(parts[0])
        for k, centre in enumerate(parts[0]):
            waiting.append((len(centres), own[parts[1] == k]))
            centres.append(centre)
            first.append(0)
            count.append(0)
            leaf.append(-1)
    return Tree(np.stack(centres), np.array(first), np.array(count), np.array(leaf))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _best(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, floors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``most`` nearest of ``y`` to each of ``x``, no worse than its floor, and their scores."""
    near = _units(x) @ _units(y).T
    few = min(most, len(y))
    least = np.maximum(np.partition(near, len(y) - few, axis=1)[:, len(y) - few], floors) - _MARGIN
    rows, columns = np.nonzero(near >= least[:, None])
    lx, ly = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    score = np.empty(len(rows))
    step = max(1, _HELD // x.shape[1])
    for a in range(0, len(rows), step):
        r, c = rows[a : a + step], columns[a : a + step]
        score[a : a + step] = (x[r] * y[c]).sum(1) / (lx[r] * ly[c])
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (place < most) & (score >= floors[rows])
    return asked[rows[keep]], ids[columns[keep]], score[keep]


def _hits(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


def _foremost_hits(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {most}")


def _sample(heads: DataFrame, rows: int) -> list:
    """About ``SAMPLE`` vectors by a hash of their values, ``SAMPLE`` at most."""
    share = min(1.0, 1.2 * SAMPLE / max(rows, 1))
    place = F.xxhash64("key", F.lit(3))
    return heads.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(place, "key").limit(SAMPLE).select("dim", "x").collect()


def _exact(asked: list, rows: DataFrame, most: int) -> DataFrame:
    """The true nearest of a bounded set of queries, which meets all rows in blocks."""
    queries = {}
    for dim in {r["dim"] for r in asked}:
        own = [r for r in asked if r["dim"] == dim]
        queries[dim] = np.array([r["q"] for r in own]), np.stack([np.frombuffer(r["x"]) for r in own])
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                if dim in shared.value:
                    own = batch.filter(pa.array(dims == dim))
                    for a in range(0, own.num_rows, MEMBERS):
                        some = own.slice(a, MEMBERS)
                        q, x = shared.value[dim]
                        floors = np.full(len(q), -2.0)
                        yield from _hits(*_best(q, x, some.column(0).to_numpy(), matrix(some.column(3), dim), floors, most)).to_batches()

    return _foremost_hits(rows.select("vec_id", "dim", "key", "x").mapInArrow(compare, _HITS), most)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, width, calibrated_recall`` for all rows that ``is_query``."""
    spark = vectors.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    most = k + 1
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asks = given.where("asks AND vec_id IS NOT NULL").select("vec_id").distinct()
    every = workspace.store(directions(given.select("vec_id", "v")), "vectors")
    rows = foremost(every, ["key"], most, workspace, "rows")
    n = rows.count()
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = _sample(rows.dropDuplicates(["key"]), n)
    trees = {}
    for dim, size in dims.items():
        own = [np.frombuffer(r["x"]) for r in sample if r["dim"] == dim]
        trees[dim] = fit(_units(np.stack(own)), size) if own else fit(np.zeros((0, dim)), 0)
    shared = spark.sparkContext.broadcast(trees)

    # Workers take the columns in this order.
    rows = rows.select("vec_id", "dim", "key", "x")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                leaf[at] = shared.value[dim].place(_units(matrix(batch.column(3).take(pa.array(at)), dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    members = workspace.store(rows.mapInArrow(placed, f"{_ROWS}, leaf long"), "members")
    asking = every.join(asks, "vec_id", "left_semi")
    queries = asking.groupBy("key").agg(F.first("dim").alias("dim"), F.first("x").alias("x"))
    queries = workspace.store(queries.select(F.monotonically_increasing_id().alias("q"), "key", "dim", "x"), "queries")

    # Calibration: the visit at which each true neighbour's leaf comes up.
    chosen = queries.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(CALIBRATION).collect()
    if not chosen:
        return given.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"),
            F.lit(0).alias("width"), F.lit(None).cast("double").alias("calibrated_recall"),
        ).where(F.lit(False))
    true = _exact(chosen, rows, most).join(members.select("vec_id", "leaf"), "vec_id").select("q", "leaf").collect()
    order = {r["q"]: {leaf: i for i, leaf in enumerate(trees[r["dim"]].visits(_units(np.frombuffer(r["x"])[None, :])[0], 1 << 30))} for r in chosen}
    came = {r["q"]: [] for r in chosen}
    for r in true:
        came[r["q"]].append(order[r["q"]][r["leaf"]])
    leaves = max(tree.leaves for tree in trees.values())
    width, recall = 1, 0.0
    while True:
        recall = float(np.mean([np.mean([v < width for v in own]) for own in came.values()]))
        if recall >= TARGET or width >= leaves:
            break
        width *= 2
    width = min(width, leaves)

    sizes = members.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))

    def search(asked: DataFrame, begin: int, end: int) -> DataFrame:
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                found = [
                    shared.value[dim].visits(_units(np.frombuffer(x)[None, :])[0], end)[begin:]
                    for dim, x in zip(dims.tolist(), batch.column(2).to_pylist())
                ]
                times = np.array(list(map(len, found)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q, times)), pa.array(np.repeat(dims, times)), pa.array([v for own in found for v in own], pa.int64())],
                    ["q", "dim", "leaf"],
                )

        visiting = workspace.store(asked.select("q", "dim", "x").mapInArrow(visits, "q long, dim int, leaf long"), "visits")
        crowd = visiting.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("crowds"))
        left = (
            visiting.join(crowd, ["dim", "leaf"]).join(sizes, ["dim", "leaf"]).join(asked.select("q", "x", "floor"), "q")
            .select("dim", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("q"), "crowds").cast("int").alias("crowd"), "q", "x", "floor")
        )
        right = (
            members.join(sizes, ["dim", "leaf"]).join(crowd, ["dim", "leaf"])
            .select("dim", "leaf", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "vec_id", F.col("x").alias("y"))
        )

        def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
            if not len(asked) or not len(found):
                return _hits(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            dim = asked["dim"][0].as_py()
            x, y = matrix(asked["x"], dim), matrix(found["y"], dim)
            return _hits(*_best(asked["q"].to_numpy(), x, found["vec_id"].to_numpy(), y, asked["floor"].to_numpy(), most))

        key = ["dim", "leaf", "part", "crowd"]
        return workspace.store(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, _HITS), "hits")

    narrow = max(1, width // 8)
    hits = search(queries.withColumn("floor", F.lit(-2.0)), 0, narrow)
    if narrow < width:
        floors = _foremost_hits(hits, most).where(f"rank = {most}").select("q", F.col("score").alias("floor"))
        hits = hits.unionByName(search(queries.join(floors, "q", "left").na.fill(-2.0, ["floor"]), narrow, width))
    own = asking.select(F.col("vec_id").alias("query_id"), "key").join(queries.select("q", "key"), "key").select("query_id", "q")
    pairs = own.join(_foremost_hits(hits, most).drop("rank"), "q").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select(
        "query_id", "rank", "vec_id", "score", F.lit(width).alias("width"), F.lit(recall).alias("calibrated_recall")
    )
