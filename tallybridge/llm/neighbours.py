"""Near-duplicate vectors by NN-descent over a distributed neighbour graph.

1. Equal vectors are one node with a weight, found by a 128-bit digest; the rest works on
   nodes, so copies never fill each other's lists.
2. The graph starts from blocks: in each of several trees nodes that agree on the signs of a
   few random projections meet, all of them. A block returns the nearest few of every member
   and, in double precision, a spanning forest of all links among its members: nothing that
   the block connects is lost to a list's length. There are as many trees as leave a pair
   at the threshold apart in all of them with a chance of ``MISS``, whatever the data.
3. Neighbours-of-neighbours joins refine the lists, of ``LIST`` entries at first, until a
   round adds less than ``SETTLED`` of the links known. A list is saturated when it is full
   and its last entry still is a link: such lists double and are joined again, they alone,
   until none is saturated or they hold ``MOST`` entries. Links beyond those are not needed as edges:
   the forests of 2 hold what they connect, the counts of 4 are taken without lists, and 5
   tells when anything is missing. ``block_links``, ``joined_links`` and ``widened_links``
   tell how many links the lists held after 2, after the joins, and after the doubling.
4. Links give components. Links are counted exactly by comparing a component's nodes in
   blocks, and are never kept as pairs.
5. A sample that grows with the table (``AUDIT_ROOTS`` times the root of its nodes, ``AUDIT``
   at least) is compared with all nodes. The recall is the mean over audited nodes with
   links, or over those with at most ``FEW_LINKS`` if that is less; as long as it is below
   ``TARGET``, more trees and joins follow.

Cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components link with
nothing; vectors of different lengths never link; rows that repeat an id are one node and
do not link with themselves, and the links of an id's different vectors add up; NULL ids
link with nothing and have a NULL component; ``audit_recall`` is NULL where no audited node
has a link; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count
from math import acos, ceil, isqrt, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays
from tallybridge.llm.components import connected_components
from tallybridge.workspace import Workspace

THRESHOLD = 0.95
BLOCK = 1024
MISS = 1e-5
LIST, FEW, MOST = 8, 4, 64
# Nearest others that every member of a local join gets from it, for a list of ``LIST``.
PARTNERS = 2
# Rows that are compared with the audited vectors at a time.
TILE = 512
SETTLED = 0.001
AUDIT, AUDIT_ROOTS, FEW_LINKS, TARGET = 256, 4, 4, 0.99
# Rounding of single-precision candidates.
_MARGIN = 1e-4

_CANDIDATES = "a long, b long, sim float"
_FOUND = "a long, b long, sim float, sure boolean"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of all rows that have a direction."""
    for batch in batches:
        ids, units, sizes, keys = [], [], [], []
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key is None or not values or None in values:
                continue
            x = np.array(values, np.float64)
            with np.errstate(all="ignore"):
                length = np.sqrt(x @ x)
                if np.isfinite(x).all() and length > 0:
                    if not np.isfinite(length) or length < 1e-100:  # squares left the range
                        x = x / np.abs(x).max()
                        length = np.sqrt(x @ x)
                    ids.append(key)
                    units.append((x / length + 0.0).tobytes())  # no negative zeros
                    sizes.append(len(x))
                    keys.append(hashlib.blake2b(units[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            ["vec_id", "dim", "key", "unit"],
        )


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _codes(trees: range, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and tree: the code it falls in."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            x = _matrix(own.column(2))
            for tree in trees:
                planes = np.random.RandomState(1000 + tree).standard_normal((int(dim), max(bits, 1)))
                code = ((x @ planes > 0) @ (1 << np.arange(max(bits, 1)))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), tree, np.int32)), pa.array(np.full(len(x), dim, np.int32)),
                        pa.array(code.astype(np.int64)), own.column(0),
                    ],
                    ["tree", "dim", "code", "node"],
                )


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their vectors in single precision."""
    for batch in batches:
        single = [np.frombuffer(u).astype(np.float32).tobytes() for u in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(single, pa.binary())], ["u", "unit"])


def _nearest(ids: np.ndarray, sims: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member's few nearest others, from all similarities; -2 stands for no pair."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], sims[:0, 0]
    few = min(few, n - 1)
    best = np.argpartition(-sims, few - 1, axis=1)[:, :few]
    rows = np.repeat(np.arange(n), few)
    cols = best.ravel()
    real = sims[rows, cols] > -2
    return ids[rows[real]], ids[cols[real]], sims[rows[real], cols[real]]


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that the symmetric matrix of links connects."""
    left = hit.any(1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(hit[u] & left)
            left[new] = False
            a.append(np.full(len(new), u))
            b.append(new)
            stack.extend(new)
    return np.concatenate(a), np.concatenate(b)


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    ok = a != b
    return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(b[ok], pa.int64()), "sim": pa.array(s[ok].astype(np.float32))})


def _block(group: pa.Table) -> pa.Table:
    """The nearest few of every member of a pair of a code's blocks, and its links' forest."""
    ids, part = group["node"].to_numpy(), group["part"].to_numpy()
    x = _matrix(group["unit"])
    sims = x @ x.T
    if group["x"][0].as_py() == group["y"][0].as_py():
        np.fill_diagonal(sims, -2)
    else:
        sims[part[:, None] == part[None, :]] = -2
    near = _pairs([_nearest(ids, sims, FEW)])
    a, b = _forest(sims >= THRESHOLD)
    sure = _pairs([(ids[a], ids[b], sims[a, b])])
    near, sure = (t.append_column("sure", pa.array(np.full(t.num_rows, k))) for t, k in ((near, False), (sure, True)))
    return pa.concat_tables([near, sure])


def _local_join(partners: int, group: pa.Table) -> pa.Table:
    """For every centre in the group: compare its neighbours with each other."""
    group = group.sort_by("v")
    v, ids = group["v"].to_numpy(), group["u"].to_numpy()
    cuts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    units = group["unit"].to_pylist()
    parts = []
    for a, b in zip(cuts, np.append(cuts[1:], len(v))):
        if b - a > 1:
            x = np.frombuffer(b"".join(units[a:b]), np.float32).reshape(b - a, -1)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            parts.append(_nearest(ids[a:b], sims, partners))
    return _pairs(parts)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (batch.column(c).to_pylist() for c in (2, 3))
            keep = [
                len(p) == len(q) and float(np.frombuffer(p) @ np.frombuffer(q)) >= THRESHOLD for p, q in zip(x, y)
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _count_links(group: pa.Table) -> pa.Table:
    """Links of every node inside a pair of a component's blocks, weighted."""
    same = group["x"][0].as_py() == group["y"][0].as_py()
    node, ids, block = (group[c].to_numpy() for c in ("node", "vec_id", "block"))
    weight = group["weight"].to_numpy().astype(float)
    x = _matrix(group["unit"])
    if same:
        hit = x @ x.T >= THRESHOLD
        hit &= ids[:, None] != ids[None, :]
        return pa.table({"node": pa.array(node), "n": pa.array((hit @ weight + weight - 1).astype(np.int64))})
    left = block == group["x"][0].as_py()
    hit = x[left] @ x[~left].T >= THRESHOLD
    hit &= ids[left][:, None] != ids[~left][None, :]
    return pa.table(
        {
            "node": pa.array(np.concatenate([node[left], node[~left]])),
            "n": pa.array(np.concatenate([hit @ weight[~left], weight[left] @ hit]).astype(np.int64)),
        }
    )


def _shorten(pairs: DataFrame, widen: bool = False) -> DataFrame:
    """The nearest of every vector, as many as its list has ``room`` for.

    With ``widen``, saturated lists get twice the room for what comes next.
    """
    room = F.col("room")
    if widen:
        saturated = (F.size("near") >= room) & (F.element_at("near", -1)["sim"] >= THRESHOLD - _MARGIN)
        room = F.when(saturated & (room < MOST), room * 2).otherwise(room)
    return (
        pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("room").alias("room"))
        .groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False).alias("near"), F.max("room").alias("room"))
        .select("a", F.slice("near", F.lit(1), F.col("room")).alias("near"), "room")
        .select("a", "near", room.alias("room"))
        .select("a", "room", F.explode("near").alias("n")).select("a", "n.b", "n.sim", "room")
    )


def _links(graph: DataFrame) -> DataFrame:
    """The pairs of the lists that link, each once."""
    near = graph.where(F.col("sim") >= THRESHOLD - _MARGIN)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _refined(graph: DataFrame, narrow: DataFrame, partners: int, groups: int, wide_only: bool = False) -> DataFrame:
    """The lists after one join of all neighbours of a vector with each other.

    With ``wide_only``, of the vectors whose lists were doubled.
    """
    near = graph.where(F.col("room") > LIST) if wide_only else graph
    # Those who list a vector, as far as there is room for them.
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", F.lit(LIST).alias("room"))
    lists = near.select(F.col("a").alias("v"), F.col("b").alias("u")).union(_shorten(back).select("a", "b")).distinct()
    joined = (
        lists.join(narrow, "u").withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)))
        .groupBy("g").applyInArrow(lambda group: _local_join(partners, group), _CANDIDATES)
    )
    return _shorten(graph.unionByName(joined.withColumn("room", F.lit(LIST))))


def _settled(graph: DataFrame, narrow: DataFrame, groups: int, workspace: Workspace) -> DataFrame:
    """The lists when a round adds next to no links."""
    while True:
        last, graph = graph, workspace.store(_refined(graph, narrow, PARTNERS, groups), "graph")
        linked = [g.where(F.col("sim") >= THRESHOLD - _MARGIN).select("a", "b") for g in (last, graph)]
        if linked[1].join(linked[0], ["a", "b"], "left_anti").count() <= SETTLED * linked[1].count():
            return graph


def _widened(graph: DataFrame, narrow: DataFrame, groups: int, workspace: Workspace) -> DataFrame:
    """The lists after the saturated ones were doubled and joined, as often as they may be."""
    while True:
        wide = workspace.store(_shorten(graph, widen=True), "graph")
        (before,), (after, widest) = graph.agg(F.sum("room")).head(), wide.agg(F.sum("room"), F.max("room")).head()
        if before == after:
            return graph
        graph = workspace.store(_refined(wide, narrow, PARTNERS * widest // LIST, groups, True), "graph")


def _collapse(units: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """``node, vec_id, dim, unit, weight`` of every distinct vector, and whose it is.

    An id with several vectors has nodes of its own, so that it never links with itself.
    """
    owned = units.select("vec_id", "key").distinct()
    several = owned.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("own"))
    owned = workspace.store(owned.join(several, "vec_id", "left"), "owned")
    heads = owned.groupBy("key", "own").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    rows = units.groupBy("vec_id", "key").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    nodes = rows.join(heads, ["vec_id", "key"]).select(F.monotonically_increasing_id().alias("node"), "vec_id", "key", "own", "weight", "dim", "unit")
    nodes = workspace.store(nodes, "nodes")
    heads = nodes.select("key", F.col("own").alias("_own"), "node", F.col("vec_id").alias("head"))
    members = owned.join(heads, (owned["key"] == heads["key"]) & F.col("own").eqNullSafe(F.col("_own"))).select("vec_id", "head", "node")
    return nodes, workspace.store(members, "members")


def _components(nodes: DataFrame, members: DataFrame, sure: DataFrame, graph: DataFrame, workspace: Workspace) -> DataFrame:
    """``vec_id, component`` of every linked id."""
    exact = (
        _links(graph).join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b")
        .select("a", "b", "ua", "ub")
        .mapInArrow(_exact, "a long, b long")
    )
    name = nodes.select("node", "vec_id")
    links = (
        sure.unionByName(exact).distinct()
        .join(name.toDF("a", "ia"), "a").join(name.toDF("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
        .unionByName(members.where("vec_id <> head").select(F.col("vec_id").alias("a"), F.col("head").alias("b")))
    )
    found = connected_components(workspace.store(links, "links"), workspace).toDF("vec_id", "component")
    return workspace.store(found, "components")


def _counted(nodes: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """``vec_id, component, n_links`` of every linked id."""
    placed = found.join(nodes.select("vec_id", "node", "dim", "weight", "unit"), "vec_id")
    sizes = found.join(nodes.select("vec_id"), "vec_id").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spots = (
        placed.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", "dim", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "vec_id", "weight", "unit")
    )
    counts = spots.groupBy("component", "dim", "x", "y").applyInArrow(_count_links, "node long, n long")
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    counts = members.join(counts, "node").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return found.join(counts, "vec_id")


def _recall(nodes: DataFrame, found: DataFrame, n: int) -> float | None:
    """Share of an audited node's links that lie in its component, by nodes; None without links."""
    size = max(AUDIT, AUDIT_ROOTS * isqrt(n))
    placed = nodes.select("node", "vec_id", "dim", "unit").join(found, "vec_id", "left").select(
        "node", "dim", F.coalesce("component", "vec_id").alias("component"), "unit"
    )
    asked = placed.orderBy(F.xxhash64("node"), "node").limit(size).collect()
    queries = {}
    for dim in {r["dim"] for r in asked}:
        own = [r for r in asked if r["dim"] == dim]
        queries[dim] = (
            np.array([r["node"] for r in own]), np.array([r["component"] for r in own]), np.stack([np.frombuffer(r["unit"]) for r in own])
        )
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                if dim in shared.value:
                    ids, places, x = shared.value[dim]
                    own = batch.filter(pa.array(dims == dim))
                    n, hit = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    for start in range(0, own.num_rows, TILE):
                        tile = own.slice(start, TILE)
                        hits = x @ _matrix(tile.column(3)).T >= THRESHOLD
                        hits &= ids[:, None] != tile.column(0).to_numpy()[None, :]
                        n += hits.sum(1)
                        hit += (hits & (places[:, None] == tile.column(2).to_numpy()[None, :])).sum(1)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(hit[at])], ["node", "n", "hit"])

    seen = placed.mapInArrow(compare, "node long, n long, hit long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    means = seen.agg(F.avg(F.expr("hit / n")), F.avg(F.expr(f"CASE WHEN n <= {FEW_LINKS} THEN hit / n END"))).head()
    return min((m for m in means if m is not None), default=None)


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept, audit_recall`` and the lists' links for every row."""
    spark = vectors.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"))
    units = workspace.store(rows.mapInArrow(_units, "vec_id long, dim int, key binary, unit binary"), "units")
    nodes, members = _collapse(units, workspace)
    n = nodes.count()
    bits = max(0, ceil(log2(max(n, 1) / BLOCK)))
    # The chance that a pair at the threshold agrees on all signs of a tree.
    together = (1 - acos(THRESHOLD) / pi) ** bits
    trees_each = 1 if together >= 1 else ceil(log(MISS) / log(1 - together))
    singles = nodes.select("node", "dim", "unit")
    graph, sure = None, None
    for attempt in count():
        trees = range(attempt * trees_each, (attempt + 1) * trees_each)
        placed = singles.mapInArrow(lambda b, t=trees: _codes(t, bits, b), "tree int, dim int, code long, node long")
        crowds = workspace.store(placed, "codes")
        key = ["tree", "dim", "code"]
        sizes = crowds.groupBy(*key).agg(F.count("*").alias("n")).select(
            *key, F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("parts")
        )
        dealt = (
            crowds.join(sizes, key)
            .withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(*key, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node")
            .join(singles.select("node", "unit"), "node")
        )
        found = workspace.store(dealt.groupBy(*key, "x", "y").applyInArrow(_block, _FOUND), "found")
        more = found.where("sure").select("a", "b").distinct()
        sure = more if sure is None else sure.unionByName(more)
        pairs = found.where("NOT sure").drop("sure")
        pairs = pairs.withColumn("room", F.lit(LIST))
        graph = workspace.store(_shorten(pairs if graph is None else graph.unionByName(pairs)), "graph")
        narrow = singles.mapInArrow(_singles, "u long, unit binary")
        groups = arrays.spread(singles, 8 << 20) * 4
        held = {"block_links": _links(graph).count()}
        graph = _settled(graph, narrow, groups, workspace)
        held["joined_links"] = _links(graph).count()
        graph = _widened(graph, narrow, groups, workspace)
        held["widened_links"] = _links(graph).count()
        place = _components(nodes, members, sure, graph, workspace)
        recall = _recall(nodes, place, n)
        if recall is None or recall >= TARGET:
            break
    return rows.select("vec_id").join(_counted(nodes, members, place), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
        *[F.lit(n).cast("long").alias(name) for name, n in held.items()],
    )
