"""Texts as byte arrays: words, pre-tokens and span hashes for whole Arrow batches.

Everything here works on the UTF-8 bytes of one batch at a time, in slices of whole
texts. NULL texts count as empty. Spark moves the rows; these helpers only replace
per-word Python loops inside a task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Space, and tab to carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def spread(df: DataFrame, bytes_per_part: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: by its estimated size, and the session's number at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # a plan without statistics
        size = 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_per_part)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def each(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of each text's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers with good diffusion (the SplitMix64 finaliser)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 1) | _U(1)


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << _U(56)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binaries(blob: bytes, cuts: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive pieces of ``blob``."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(blob)]
    ).cast(pa.binary())


# --- pre-tokens ---------------------------------------------------------------------

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, space or other, for every code point, as the pattern's classes see it."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    return table


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte (continuation bytes: that of their character), and which bytes begin one."""
    table = _classes()
    kind = table[:256][data]
    head = (data & 0xC0) != 0x80
    if not head.all() or (data >= 0x80).any():
        at = np.flatnonzero(head & (data >= 0xC0))
        lead = data[at].astype(np.int64)
        size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
        code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
        kind[at] = table[np.minimum(code, 0x10FFFF)]
        for k in (1, 2, 3):
            more = size > k
            kind[at[more] + k] = kind[at[more]]
    return kind, head


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, and each text's first number, of the byte-level pattern's matches.

    The pattern takes contractions, then runs of letters, of numbers or of other
    characters, each with one space before it, then runs of white space without their
    last character if something follows.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind, head = _kinds(data)
    opens = np.zeros(n + 1, bool)  # where a text begins or ends
    opens[offsets] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= opens[:n]
    # A space directly before a run joins it; what is left of its white space stays alone.
    blank = kind == _SPACE
    run = np.flatnonzero(start & ~blank)  # runs that white space may precede
    run = run[(run > 0)]
    run = run[blank[run - 1] & ~opens[run]]
    before = run - 1  # last byte of the white space
    while True:  # back to the first byte of that character
        inner = ~head[before]
        if not inner.any():
            break
        before[inner] -= 1
    start[before] = True
    joins = data[run - 1] == 32
    start[run[joins]] = False
    # Contractions: an apostrophe that begins a run and has one of the endings after it.
    apostrophe = np.flatnonzero((data == 39) & start)
    if len(apostrophe):
        padded = np.zeros(n + 3, np.uint8)
        padded[:n] = data
        # The ending must lie in the same text.
        room = offsets[np.searchsorted(offsets, apostrophe, "right")] - apostrophe
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        # The pattern's contractions.
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room > 1)
        long = np.zeros(len(apostrophe), bool)
        for ending in (b"re", b"ve", b"ll"):
            long |= (one == ending[0]) & (two == ending[1])
        long &= room > 2
        for which, size in ((short, 2), (long & ~short, 3)):
            at = apostrophe[which]
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)
