"""Byte-level BPE by two-tier lookup.

The text is cut into pre-tokens and each distinct pre-token of a few
megabytes is encoded once.
Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself an
entry costs one probe. Tier two merges the bytes of the others: a doubly linked list of
parts and a heap of adjacent pairs ordered by rank, then position.

Cases: a NULL text counts as empty; an empty text has no ids, and its digests are those
of the empty string; repeated rows and NULL document ids give a row each; only the two
named columns are read, so other columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybridge.llm import arrays

_BUCKET_KEYS = 4
_SEED_BLOCK = 1024
# Distinct pre-tokens a Python worker remembers between batches.
MEMO_ENTRIES = 100_000
# Bytes of whole texts whose pre-tokens are in memory at a time.
_GROUP = 4 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass(frozen=True)
class PerfectHash:
    """Hash and displace: ``n`` keys fill ``n`` slots, one probe each.

    A key's bucket gives a displacement; negative ones name the slot itself, which is
    how the last buckets of one key are placed.
    """

    displacement: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // _BUCKET_KEYS)
        owner = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(buckets + 1))
        displacement = np.zeros(buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        by_size = np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable")
        for b in by_size:
            members = order[cuts[b] : cuts[b + 1]]
            if len(members) < 2:
                break
            seed = 1
            while True:
                tries = np.arange(seed, seed + _SEED_BLOCK, dtype=np.uint64)[:, None]
                slots = _slots(keys[members][None, :], tries, n)
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    hit = int(np.argmax(good))
                    break
                seed += _SEED_BLOCK
            displacement[b] = seed + hit
            slot_of[members] = slots[hit]
            taken[slots[hit]] = True
        free = iter(np.flatnonzero(~taken))
        for b in by_size:
            if cuts[b + 1] - cuts[b] == 1:
                slot = next(free)
                displacement[b] = -slot - 1
                slot_of[order[cuts[b]]] = slot
        at = np.empty(n, np.int64)
        at[slot_of] = np.arange(n)
        return cls(displacement, keys[at], values[at])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 for those that are not in the set."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        d = self.displacement[(keys % np.uint64(len(self.displacement))).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, _slots(keys, np.maximum(d, 0).astype(np.uint64), len(self.keys)))
        return np.where(self.keys[slots] == keys, self.values[slots], -1)


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (arrays.mix(keys ^ (seeds * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(n)).astype(np.int64)


def merge(piece: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the adjacent pair of lowest rank, leftmost first.

    A heap entry is one number: rank, begin and end of the merged part, in that order.
    """
    n = len(piece)
    shift = 20 if n < 1 << 20 else 40
    two, low = 2 * shift, (1 << shift) - 1
    end = list(range(1, n + 2))  # of the part that begins here; 0 once it is merged away
    before = list(range(-1, n))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append(rank << two | i << shift | i + 2)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, stop = entry >> shift & low, entry & low
        j = end[i]
        if not j or j == n or end[j] != stop:
            continue  # one of its parts has changed meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            far = end[stop]
            rank = get(piece[i:far])
            if rank is not None:
                heappush(heap, rank << two | i << shift | far)
        h = before[i]
        if h >= 0:
            rank = get(piece[h:stop])
            if rank is not None:
                heappush(heap, rank << two | h << shift | stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Ranks, the perfect hash over them, and the bytes of every id."""

    def __init__(self, ranks: Mapping[bytes, int], hashed: PerfectHash) -> None:
        self.ranks, self.hashed = ranks, hashed
        self.token = {rank: token for token, rank in ranks.items()}
        self.shown = {rank: b"%d" % rank for rank in self.token}
        self.memo: dict[bytes, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = merge(piece, self.ranks)
            if len(piece) <= 16:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of every distinct pre-token, which one stands where, and each text's first."""
        hashes, sizes, firsts, places, counts = [], [], [], [], [np.zeros(1, np.int64)]
        done = 0
        for i, _, part, cuts in arrays.each(data, offsets):
            starts, ends, first = arrays.pretokens(part, cuts)
            hashes.append(arrays.span_hashes(part, starts, ends))
            sizes.append(ends - starts)
            places.append(starts + offsets[i])
            counts.append(first[1:] + done)
            done += len(starts)
        if not done:
            return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        hashes, sizes, places = map(np.concatenate, (hashes, sizes, places))
        codes, distinct = pd.factorize(hashes)
        firsts = np.empty(len(distinct), np.int64)
        firsts[codes[::-1]] = np.arange(done - 1, -1, -1)
        blob = data.tobytes()
        pieces = [blob[s : s + k] for s, k in zip(places[firsts].tolist(), sizes[firsts].tolist())]
        token = self.token
        ids = [
            [v] if v >= 0 and token[v] == p else self.piece(p)
            for p, v in zip(pieces, self.hashed.find(distinct).tolist())
        ]
        return ids, codes, np.concatenate(counts)


_codecs: dict[str, Codec] = {}


def perfect_hash(ranks: Mapping[bytes, int]) -> PerfectHash:
    tokens = list(ranks)
    data, offsets = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
    keys = arrays.span_hashes(data, offsets[:-1], offsets[1:])
    return PerfectHash.build(keys, np.array([ranks[t] for t in tokens], np.int64))


@lru_cache(4)
def _built(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    ranks = read_ranks(path)
    return ranks, perfect_hash(ranks)


def digests(codec: Codec, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str]]:
    """For each text: number of ids, digest of the ids, digest of what they decode to."""
    ids, codes, first = codec.encode(data, offsets)
    shown = [b" ".join(map(codec.shown.__getitem__, own)) for own in ids]
    decoded = [b"".join(map(codec.token.__getitem__, own)) for own in ids]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    totals = np.zeros(len(codes) + 1, np.int64)
    if len(codes):
        np.cumsum(size[codes], out=totals[1:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = codes[a:b].tolist()
        yield (
            int(totals[b] - totals[a]),
            hashlib.sha256(b" ".join(map(shown.__getitem__, own))).hexdigest(),
            hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest(),
        )


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text by the ranks at ``path``, decode the ids, and digest both.

    The vocabulary is read once, on the driver, and broadcast: its size is that of the
    rank file, whatever the size of the corpus.
    """
    spark = docs.sparkSession
    arrays.ship(spark)
    ranks, hashed = _built(path)
    shared = spark.sparkContext.broadcast((ranks, hashed.displacement, hashed.keys, hashed.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(path)
        if codec is None:
            words, *parts = shared.value
            codec = _codecs[path] = Codec(words, PerfectHash(*parts))
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for i, j, part, cuts in arrays.each(*arrays.utf8(batch.column(1)), _GROUP):
                n, ids, text = zip(*digests(codec, part, cuts))
                yield pa.RecordBatch.from_arrays(
                    [keys[i:j], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(id_column, text_column).mapInArrow(run, SCHEMA)
