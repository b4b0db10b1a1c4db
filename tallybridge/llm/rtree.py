"""Hard negatives by inner product from an STR-packed R-tree, best first.

1. Vectors become integers, ``floor(scale * x)``, so that scores are exact.
2. Packing: Sort-Tile-Recursive over the widest coordinates cuts a bounded sample
   (``SAMPLE`` vectors) into about ``TILES`` tiles at most. All rows are placed in tiles, crowded
   tiles are dealt by hash to parts, and every part is packed by STR into pages of ``PAGE``
   rows and nodes of ``FANOUT`` children. Boxes are the true minima and maxima of the rows.
3. A box gives each coordinate's interval of products with an anchor; their sum bounds all
   scores inside. A priority queue opens the box with the highest bound. A box is pruned if
   its interval lies outside all score windows that are asked for, or strictly below the
   kth score found in every one of them.
4. Anchors meet the tiles in two rounds: the best tile first, whose kth scores then prune
   the others. In a tile, blocks of anchors meet parts of rows.
5. The same search finds an anchor's positives (same label, no window) and then, for every
   positive, the negatives (other labels, scores in the positive's window).

The result is exact. Equal vectors of a label count by the first of them by id only, as
nobody else of them can come first; equal anchors of a label are searched once.

Cases: rows with a NULL id, label or vector, or with NULL or non-finite components, take no
part, nor do empty vectors, those with a component beyond 64 bits, and pairs whose score is; a
zero vector takes part; vectors of different lengths are no partners; of rows that repeat
an id the one of the smallest label and digest counts; ties go to the smaller id; without
anchors, positives or negatives there are no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybridge.llm import arrays
from tallybridge.llm.vector_tables import foremost, matrix, one_per_id
from tallybridge.workspace import Workspace

SAMPLE = 32_768
TILES, TILE_ROWS = 1024, 8192
PAGE, FANOUT = 128, 16
ASKED = 512

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_ROWS = "vec_id long, label long, dim int, key binary, x binary"
_PACKED = "dim int, tile long, part int, ids binary, labels binary, x binary, low binary, high binary"
_HITS = "q long, window long, vec_id long, score long"


def _integers(scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], []]
        for key, label, values in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key is None or label is None or not values or None in values:
                continue
            with np.errstate(all="ignore"):
                x = np.floor(scale * np.array(values, np.float64))
            if (np.abs(x) < 2.0**63).all():  # false for what is not finite
                whole = x.astype(np.int64).tobytes()
                for column, value in zip(out, (key, label, len(x), hashlib.blake2b(whole, digest_size=16).digest(), whole)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["vec_id", "label", "dim", "key", "x"])


def widest(x: np.ndarray, pages: int) -> list[int]:
    """The coordinates that packing sorts by: the widest, about four slabs for each."""
    few = max(1, min(x.shape[1], round(log(max(pages, 2), 4))))
    return np.argsort(-x.astype(np.float64).var(0), kind="stable")[:few].tolist()


def pack(x: np.ndarray, own: np.ndarray, size: int, axes: list[int]) -> list[np.ndarray]:
    """Pages of ``size`` rows: sorted by one coordinate, cut in slabs, each packed by the next ones."""
    pages = ceil(len(own) / size)
    if pages <= 1:
        return [own] if len(own) else []
    own = own[np.argsort(x[own, axes[0]], kind="stable")]
    if len(axes) == 1:
        return [own[a : a + size] for a in range(0, len(own), size)]
    slabs = ceil(pages ** (1 / len(axes)))
    width = ceil(pages / slabs) * size
    return [page for a in range(0, len(own), width) for page in pack(x, own[a : a + width], size, axes[1:])]


class Tiles:
    """Cuts of the space: slabs by one coordinate, and each slab's own cuts by the next ones."""

    def __init__(self, x: np.ndarray, tiles: int, axes: list[int] | None = None, base: int = 0) -> None:
        self.first, self.count, self.inner = base, max(tiles, 1), None
        if tiles <= 1 or not len(x):
            self.count = 1
            return
        axes = axes or widest(x, tiles)
        self.axis = axes[0]
        x = x[np.argsort(x[:, self.axis], kind="stable")]
        slabs = tiles if len(axes) == 1 else ceil(tiles ** (1 / len(axes)))
        ends = [round(len(x) * (k + 1) / slabs) for k in range(slabs)]
        self.cuts = x[[e for e in ends[:-1] if e < len(x)], self.axis]
        self.inner, self.count, begin = [], 0, 0
        for k in range(len(self.cuts) + 1):
            end = ends[k] if k < len(self.cuts) else len(x)
            part = Tiles(x[begin:end], ceil(tiles / slabs) if len(axes) > 1 else 1, axes[1:] or None, base + self.count)
            self.inner.append(part)
            self.count += part.count
            begin = end

    def place(self, x: np.ndarray) -> np.ndarray:
        if self.inner is None:
            return np.full(len(x), self.first, np.int64)
        slab = np.searchsorted(self.cuts, x[:, self.axis], "right")
        out = np.empty(len(x), np.int64)
        for k in np.unique(slab):
            out[slab == k] = self.inner[k].place(x[slab == k])
        return out


def _pack_part(group: pa.Table) -> pa.Table:
    """A part of a tile as one row: its rows in the order of their pages, and its box."""
    dim = group["dim"][0].as_py()
    group = group.sort_by("vec_id")
    x = matrix(group["x"], dim, np.int64)
    order = np.concatenate(pack(x, np.arange(len(x)), PAGE, widest(x, ceil(len(x) / PAGE))))
    x = x[order]
    values = {
        "ids": group["vec_id"].to_numpy()[order], "labels": group["label"].to_numpy()[order], "x": x, "low": x.min(0), "high": x.max(0)
    }
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()), "tile": pa.array([group["tile"][0].as_py()], pa.int64()),
            "part": pa.array([group["part"][0].as_py()], pa.int32()),
            **{name: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for name, v in values.items()},
        }
    )


def _box(group: pa.Table) -> pa.Table:
    """The box around a tile's parts."""
    dim = group["dim"][0].as_py()
    low, high = matrix(group["low"], dim, np.int64).min(0), matrix(group["high"], dim, np.int64).max(0)
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()), "tile": pa.array([group["tile"][0].as_py()], pa.int64()),
            "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()),
        }
    )


def intervals(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all scores of each anchor in each box, from each coordinate's interval."""
    a, low, high = asked.astype(np.float64), low.astype(np.float64), high.astype(np.float64)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    # Sums beyond 53 bits are rounded.
    slack = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(slack < 2.0**53, 0.0, slack * 1e-9)
    return least - slack, most + slack


class Part:
    """The R-tree of one part: pages of rows, and levels of nodes above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.reach = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.floats = x.astype(np.float64)
        begins = np.arange(0, len(x), PAGE)
        low, high = np.minimum.reduceat(x, begins, axis=0), np.maximum.reduceat(x, begins, axis=0)
        self.low, self.high, self.pages = [low], [high], len(begins)
        # First child of every node above the pages; children are consecutive.
        self.children: list[range] = []
        below, count = 0, len(begins)
        while count > FANOUT:
            cuts = np.arange(0, count, FANOUT)
            low, high = np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children += [range(below + a, below + min(a + FANOUT, count)) for a in cuts.tolist()]
            below, count = below + count, len(cuts)
        self.top = range(below, below + count)

    def scores(self, asked: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Exact products of an anchor with rows, and which of them are 64-bit numbers (None: all)."""
        bound = self.reach * float(np.abs(asked.astype(np.float64)).max(initial=0)) * len(asked)
        if bound < 2.0**53:
            return (self.floats[begin:end] @ asked.astype(np.float64)).astype(np.int64), None
        if bound < 2.0**62:
            return self.x[begin:end] @ asked, None
        wide = [sum(a * b for a, b in zip(asked.tolist(), row)) for row in self.x[begin:end].tolist()]
        fits = np.array([LEAST <= v <= MOST for v in wide])
        return np.array([v if ok else 0 for v, ok in zip(wide, fits)], np.int64), fits

    def search(self, asked: np.ndarray, label: int, same: bool, windows: list[tuple[int, int, int]], bounds: tuple[list, list], most: int) -> list[list[tuple[int, int]]]:
        """For every window ``(low, high, floor)``: the first ``most`` ``(-score, id)``.

        Scores below the floor can't be among the first any more.
        """
        least, highest = bounds
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        needed = [max(low, floor) for low, _, floor in windows]
        queue = [(-highest[node], node) for node in self.top]
        heapq.heapify(queue)
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < min(needed):
                break
            alive = [w for w, (_, high, _) in enumerate(windows) if -bound >= needed[w] and least[node] <= high]
            if not alive:
                continue
            if node >= self.pages:
                for child in self.children[node - self.pages]:
                    heapq.heappush(queue, (-highest[child], child))
                continue
            begin, end = node * PAGE, min((node + 1) * PAGE, len(self.ids))
            scores, fits = self.scores(asked, begin, end)
            right = (self.labels[begin:end] == label) == same
            if fits is not None:
                right &= fits
            for w in alive:
                at = np.flatnonzero(right & (scores >= needed[w]) & (scores <= windows[w][1]))
                if len(at):
                    new = zip((-scores[at]).tolist(), self.ids[begin:end][at].tolist())
                    found[w] = heapq.nsmallest(most, [*found[w], *new])
                    if len(found[w]) == most:
                        needed[w] = max(needed[w], -found[w][-1][0])
        return found


def _meet(same: bool, most: int, asked: pa.Table, packed: pa.Table) -> pa.Table:
    """Every anchor of a block against one part."""
    out = [[], [], [], []]
    if len(asked) and len(packed):
        dim = packed["dim"][0].as_py()
        ids, labels, x = (np.frombuffer(packed[c][0].as_py(), np.int64) for c in ("ids", "labels", "x"))
        part = Part(ids, labels, x.reshape(-1, dim))
        anchors = matrix(asked["x"], dim, np.int64)
        least, highest = intervals(anchors, np.concatenate(part.low), np.concatenate(part.high))
        for k, (q, label, windows) in enumerate(zip(*(asked[c].to_pylist() for c in ("q", "label", "windows")))):
            spans = [(w["low"], w["high"], w["floor"]) for w in windows]
            for w, best in zip(windows, part.search(anchors[k], label, same, spans, (least[k].tolist(), highest[k].tolist()), most)):
                for score, vec_id in best:
                    for column, value in zip(out, (q, w["window"], vec_id, -score)):
                        column.append(value)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("q", "window", "vec_id", "score"), out)})


def _first(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q", "window").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {most}")


class Index:
    """The packed rows of a table, and the boxes of its tiles."""

    def __init__(self, rows: DataFrame, workspace: Workspace) -> None:
        spark = rows.sparkSession
        self.workspace = workspace
        dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        n = sum(dims.values())
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        place = F.xxhash64("key", "vec_id", F.lit(11))
        sample = rows.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(place, "vec_id").limit(SAMPLE).select("dim", "x").collect()
        tiles = {}
        for dim, size in dims.items():
            own = [np.frombuffer(r["x"], np.int64) for r in sample if r["dim"] == dim]
            few = min(ceil(size / TILE_ROWS), ceil(TILES * size / n), max(1, len(own) // 8))
            tiles[dim] = Tiles(np.stack(own) if own else np.zeros((0, dim), np.int64), few)
        shared = spark.sparkContext.broadcast(tiles)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(2).to_numpy()
                tile = np.zeros(len(dims), np.int64)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    tile[at] = shared.value[dim].place(matrix(batch.column(4).take(pa.array(at)), dim, np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

        key = ["dim", "tile"]
        rows = workspace.store(rows.select("vec_id", "label", "dim", "key", "x").mapInArrow(placed, f"{_ROWS}, tile long"), "placed")
        self.sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts"))
        dealt = rows.join(self.sizes, key).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
        self.parts = workspace.store(dealt.groupBy(*key, "part").applyInArrow(_pack_part, _PACKED), "packed")
        boxes = self.parts.select(*key, "low", "high").groupBy(*key).applyInArrow(_box, "dim int, tile long, low binary, high binary").collect()
        directory = {}
        for dim in {r["dim"] for r in boxes}:
            own = sorted((r for r in boxes if r["dim"] == dim), key=lambda r: r["tile"])
            directory[dim] = (
                np.array([r["tile"] for r in own]), *(np.stack([np.frombuffer(r[c], np.int64) for r in own]) for c in ("low", "high"))
            )
        # A box a tile: about TILES of them, whatever the table's size.
        self.directory = spark.sparkContext.broadcast(directory)

    def _round(self, asked: DataFrame, begin: int, end: int | None, same: bool, most: int) -> DataFrame:
        """Hits in the tiles that come ``begin`` to ``end`` by their bounds, and can't be pruned."""
        directory = self.directory

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [[], [], []]
                for q, dim, x, windows in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if dim not in directory.value:
                        continue
                    tiles, low, high = directory.value[dim]
                    least, most_ = (v[0] for v in intervals(np.frombuffer(x, np.int64)[None, :], low, high))
                    alive = np.zeros(len(tiles), bool)
                    for w in windows:
                        alive |= (most_ >= max(w["low"], w["floor"])) & (least <= w["high"])
                    for k in np.argsort(-most_, kind="stable")[begin:end]:
                        if alive[k]:
                            for column, value in zip(out, (q, dim, int(tiles[k]))):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64()))], ["q", "dim", "tile"])

        key = ["dim", "tile"]
        visiting = self.workspace.store(asked.select("q", "dim", "x", "windows").mapInArrow(visits, "q long, dim int, tile long"), "visits")
        crowd = visiting.groupBy(*key).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("crowds"))
        left = (
            visiting.join(crowd, key).join(self.sizes, key).join(asked.select("q", "label", "x", "windows"), "q")
            .select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("q"), "crowds").cast("int").alias("crowd"), "q", "label", "x", "windows")
        )
        right = self.parts.join(crowd, key).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds", "low", "high")
        key = [*key, "part", "crowd"]

        def meet(asked: pa.Table, packed: pa.Table) -> pa.Table:
            return _meet(same, most, asked, packed)

        return self.workspace.store(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, _HITS), "hits")

    def first(self, asked: DataFrame, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """``q, window, vec_id, score, rank``: the first ``most`` of every ``(q, window, low, high)``."""

        def with_floors(floors: DataFrame | None) -> DataFrame:
            own = windows.withColumn("floor", F.lit(LEAST)) if floors is None else (
                windows.join(floors, ["q", "window"], "left").na.fill(LEAST, ["floor"])
            )
            lists = own.groupBy("q").agg(F.collect_list(F.struct("window", "low", "high", "floor")).alias("windows"))
            return self.workspace.store(asked.join(lists, "q"), "asked")

        hits = self._round(with_floors(None), 0, 1, same, most)
        floors = _first(hits, most).where(f"rank = {most}").select("q", "window", F.col("score").alias("floor"))
        return _first(hits.unionByName(self._round(with_floors(floors), 1, None, same, most)), most)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A negative's score lies between ``low`` and ``high`` hundredths of its positive's.
    """
    spark = rows.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    given = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    whole = given.select("vec_id", "label", "v").mapInArrow(lambda b: _integers(scale, b), _ROWS)
    every = workspace.store(one_per_id(whole, ["label", "key", "dim", "x"]), "vectors")
    most = positives + 1
    index = Index(foremost(every, ["key", "label"], max(most, negatives), workspace, "rows"), workspace)
    anchors = every.join(given.where("asks").select("vec_id").distinct(), "vec_id", "left_semi")
    asked = anchors.groupBy("key", "label").agg(F.first("dim").alias("dim"), F.first("x").alias("x"))
    asked = workspace.store(asked.select(F.monotonically_increasing_id().alias("q"), "key", "label", "dim", "x"), "anchors")

    whole_range = asked.select("q", F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = workspace.store(index.first(asked.drop("key"), whole_range, True, most).select("q", "vec_id", "score"), "positives")
    own = anchors.select(F.col("vec_id").alias("anchor_id"), "key", "label").join(asked.select("q", "key", "label"), ["key", "label"])
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = (
        own.select("anchor_id", "q").join(near, "q").where("anchor_id <> vec_id").withColumn("place", F.row_number().over(order))
        .where(f"place <= {positives}").select("anchor_id", "q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # A window is named by its positive's score.
    limit = "cast({f}(cast(score as decimal(20, 0)) * {share} / 100) as long)"
    windows = near.select("q", "score").distinct().select(
        "q", F.col("score").alias("window"), F.expr(limit.format(f="ceil", share=low)).alias("low"), F.expr(limit.format(f="floor", share=high)).alias("high")
    ).where("low <= high")
    found = index.first(asked.drop("key"), workspace.store(windows, "windows"), False, negatives)
    found = found.select("q", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["q", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
