"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document is the set of its distinct shingles of ``width`` words, two unless the caller
says otherwise (a shorter sequence counts as one shingle).
Two fixed permutations give all signature coordinates: the first scatters the shingles
over a ring of 2^32 places, and coordinate k is the smallest value that the second takes
on the set after the ring has been turned by k.

1. Equal sets are one class, found by a 160-bit digest; the rest works on one document of
   each class, so copies are never paired with each other.
2. Classes that agree on a band share a bucket. Every class is compared exactly with the
   smallest of its bucket, and links give first components.
3. In buckets that still hold several components, members are compared block by block: a
   pair of different components that first meets in this bucket, whose sizes allow the
   similarity and whose signatures agree in enough places, is verified on full sets. A
   block pair returns at most the links that join components, never its pairs.

With 30 bands of 5, a pair at a similarity of exactly 0.8 escapes all bands with a chance
of 7e-6; the signature filter in step 3 lies six standard deviations below 0.8.

Cases: NULL and blank texts have the empty set and are linked with nothing; rows with a
NULL id are linked with nothing and have a NULL component; rows that repeat an id are one
node, linked if any of them is; only the two named columns are read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays
from tallybridge.llm.columns import opened, sealed
from tallybridge.llm.components import connected_components
from tallybridge.workspace import Workspace

BANDS, ROWS = 30, 5
WIDTH = BANDS * ROWS
# Of WIDTH equal coordinates: 0.8 * 150 less six standard deviations.
AGREE = 90
BLOCK = 1024
# Elements that are hashed at a time, so that they stay in the cache.
_TILE = 1 << 15

SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
_VERIFIED = "a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    sets, sizes = [], []
    for i, j, part, cuts in arrays.each(arrays.lowered(data), offsets):
        starts, ends, first = arrays.words(part, cuts)
        h = arrays.span_hashes(part, starts, ends)
        run = h.copy()
        for k in range(1, width):
            run[:-k] = arrays.mix(run[:-k] ^ (h[k:] * np.uint64(2 * k + 1)), k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                own = np.unique(run[a : b - width + 1])
            elif b > a:
                own = arrays.mix(np.array([np.bitwise_xor.reduce(arrays.mix(h[a:b], 40 + b - a) * np.arange(1, 2 * (b - a), 2, dtype=np.uint64))]), 99)
            else:
                own = h[:0]
            sets.append(own)
            sizes.append(len(own))
    cuts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=cuts[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), cuts


def _mix32(x: np.ndarray, spare: np.ndarray) -> None:
    """A permutation of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of WIDTH coordinates per text; texts without shingles have the largest value."""
    n = len(cuts) - 1
    out = np.full((n, WIDTH), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    ring = (sets >> np.uint64(32)).astype(np.uint32)
    _mix32(ring, np.empty_like(ring))  # the first permutation
    i = 0
    while i < len(filled):
        j = max(i + 1, int(np.searchsorted(cuts[filled], cuts[filled[i]] + _TILE)))
        own = filled[i:j]
        part = ring[cuts[own[0]] : cuts[own[-1] + 1]]
        at = cuts[own] - cuts[own[0]]
        turned, spare = np.empty_like(part), np.empty_like(part)
        for k in range(WIDTH):
            np.add(part, np.uint32(k), out=turned)
            _mix32(turned, spare)
            out[own, k] = np.minimum.reduceat(turned, at)
        i = j
    return out


def band_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros((len(rows), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = arrays.mix(h ^ rows[:, k::ROWS].astype(np.uint64), k)
    return h


def _sign(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrays.utf8(batch.column(1))
        sets, cuts = shingle_sets(data, offsets, width)
        rows = signatures(sets, cuts)
        hashes = band_hashes(rows)
        bands = arrays.signed(hashes).ravel()
        # A byte of every coordinate and of every band.
        sketch = np.concatenate([rows & 0xFF, hashes & np.uint64(0xFF)], axis=1).astype(np.uint8)
        sums = []
        for seed in (7, 8):
            total = np.zeros(len(sets) + 1, np.uint64)
            np.cumsum(arrays.mix(sets, seed), out=total[1:])
            sums.append(pa.array(arrays.signed(total[cuts[1:]] - total[cuts[:-1]])))
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array(np.diff(cuts)),
                *sums,
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands)),
                arrays.binaries(sketch.tobytes(), np.arange(n + 1) * sketch.shape[1]),
            ],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
        )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def _check(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts: those that are similar."""
    for batch in batches:
        sets = [shingle_sets(*arrays.utf8(batch.column(c)), width) for c in (2, 3)]
        keep = [
            similar(*(own[cuts[r] : cuts[r + 1]] for own, cuts in sets)) for r in range(batch.num_rows)
        ]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _partners(sketches: np.ndarray, sizes: np.ndarray, parts: np.ndarray, blocks: np.ndarray, same: bool, band: int, i: int) -> np.ndarray:
    """Which later members must be compared with member ``i``."""
    rest = sketches[i + 1 :]
    equal = rest == sketches[i]
    ok = (parts[i + 1 :] != parts[i]) & (equal[:, :WIDTH].sum(1) >= AGREE)
    ok &= 5 * np.minimum(sizes[i + 1 :], sizes[i]) >= 4 * np.maximum(sizes[i + 1 :], sizes[i])
    if not same:
        ok &= blocks[i + 1 :] != blocks[i]
    if band:  # an earlier band's bucket has this pair
        met = equal[:, : band * ROWS].reshape(len(rest), band, ROWS).all(2) & equal[:, WIDTH : WIDTH + band]
        ok &= ~met.any(1)
    return np.flatnonzero(ok) + i + 1


def _members(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool, int]:
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, WIDTH + BANDS)
    same = group["x"][0].as_py() == group["y"][0].as_py()
    sizes, parts, blocks = (group[c].to_numpy() for c in ("n_shingles", "component", "block"))
    return sketch, sizes, parts, blocks, same, group["band"][0].as_py()


def _survivors(group: pa.Table) -> pa.Table:
    """Members of a block pair that have someone to be compared with."""
    group = group.sort_by("doc_id")
    members = _members(group)
    needed = np.zeros(group.num_rows, bool)
    for i in range(group.num_rows - 1):
        hits = _partners(*members, i)
        if len(hits):
            needed[i] = True
            needed[hits] = True
    return group.filter(pa.array(needed))


def _joined(width: int, group: pa.Table) -> pa.Table:
    """Links that join components inside a block pair."""
    group = group.sort_by("doc_id")
    ids = group["doc_id"].to_numpy()
    members = _members(group)
    sets, cuts = shingle_sets(*arrays.utf8(group["text"]), width)
    values, codes = np.unique(sets, return_inverse=True)
    sizes = np.diff(cuts)
    parent = {c: c for c in members[2].tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    here = np.zeros(len(values), bool)
    of = members[2].tolist()
    for i in range(len(ids) - 1):
        hits = [j for j in _partners(*members, i).tolist() if root(of[j]) != root(of[i])]
        if not hits:
            continue
        own = codes[cuts[i] : cuts[i + 1]]
        here[own] = True
        for j in hits:
            if root(of[j]) == root(of[i]):
                continue
            both = int(here[codes[cuts[j] : cuts[j + 1]]].sum())
            if both and 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                links.append((int(ids[i]), int(ids[j])))
                parent[root(of[j])] = root(of[i])
        here[own] = False
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = workspace.store(texts.mapInArrow(lambda b: _sign(width, b), SIGNATURES), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = workspace.store(classes, "classes")
    heads = filled.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = heads.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    leaders = buckets.groupBy("band", "bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z")
    pairs = workspace.store(
        buckets.join(leaders.drop("z"), ["band", "bucket"])
        .where("doc_id <> a")
        .select("a", F.col("doc_id").alias("b"))
        .distinct(),
        "pairs",
    )
    # Texts of all that share a bucket with another class, once.
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # The hint keeps one plan at every size.
    shared = workspace.store(texts.join(named.hint("merge"), "doc_id", "left_semi"), "texts")
    compared = (
        pairs.join(shared.toDF("b", "text_b"), "b")
        .join(shared.toDF("a", "text_a"), "a")
        .select("a", "b", "text_a", "text_b")
    )
    links = workspace.store(compared.mapInArrow(lambda b: _check(width, b), _VERIFIED), "links")
    first = workspace.store(connected_components(links, workspace), "components")

    placed = (
        heads.join(named, "doc_id", "left_semi")
        .join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
    )
    placed = workspace.store(placed.select("doc_id", "n_shingles", "component", "bands", "sketch"), "placed")
    spots = placed.select("doc_id", "component", F.posexplode("bands").alias("band", "bucket"))
    mixed = spots.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi")
    crowd = (
        spots.join(mixed.select("band", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["band", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component", "doc_id")
        .join(placed.select("doc_id", "n_shingles", "sketch"), "doc_id")
        .select("band", "bucket", "x", "y", "block", "doc_id", "n_shingles", "component", "sketch")
    )
    key = ["band", "bucket", "x", "y"]
    close = workspace.store(crowd.groupBy(*key).applyInArrow(_survivors, crowd.schema), "close")
    again = close.join(shared, "doc_id").groupBy(*key).applyInArrow(lambda g: _joined(width, g), _VERIFIED)
    more = workspace.store(again, "links")
    final = connected_components(links.unionByName(more), workspace)

    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    found = (
        filled.select("doc_id", "n_shingles", "d1", "d2")
        .join(of_class, ["n_shingles", "d1", "d2"])
        .select("doc_id", "n_shingles", "component_id")
    )
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, width: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of every group of near-duplicates, that of the smallest id, with all its columns.

    Rows are grouped by their texts, with or without an id; NULL ids come last. Texts
    without words are in no group and stay; of equal rows one stays.
    """
    workspace = Workspace(docs.sparkSession)
    rows, names = sealed(docs)
    key, text = names[id_column], names[text_column]
    marked = rows.withColumns({"_text": F.xxhash64(text), "_row": F.xxhash64(*names.values())})
    narrow = marked.groupBy("_text", "_row").agg(F.min(key).alias("_id"), F.count("*").alias("_n"))
    narrow = workspace.store(narrow, "rows")
    # A text of its own takes part as it is; of others one copy does.
    often = narrow.groupBy("_text").agg(F.sum("_n").alias("n")).where("n > 1").select("_text")
    texts = marked.select("_text", F.col(text).alias("text"))
    once = texts.join(often, "_text", "left_anti").unionByName(
        texts.join(often, "_text", "left_semi").groupBy("_text").agg(F.first("text").alias("text"))
    )
    groups = near_duplicates(once, width, "_text", "text").where("n_shingles > 0")
    groups = workspace.store(groups.select(F.col("doc_id").alias("_text"), F.col("component_id").alias("_group")), "groups")
    first = narrow.join(groups, "_text").groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "_row")).alias("f"))
    kept = workspace.store(first.select("f._text", "f._row").join(narrow.select("_text", "_row", "_n"), ["_text", "_row"]), "kept")
    single = marked.join(kept.where("_n = 1"), ["_text", "_row"], "left_semi")
    copied = marked.join(kept.where("_n > 1"), ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"])
    blank = marked.join(groups.select("_text"), "_text", "left_anti")
    return opened(single.unionByName(copied).unionByName(blank), names)
