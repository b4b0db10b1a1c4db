"""Key multiplicity: profiling, duplicate detection and row ordinals.

Rows that share a key are numbered 1, 2, 3, ... inside the key, separately on
each side, so that duplicates can be paired one to one instead of multiplied.
Numbering a key is a window over its rows, which is fine until one key holds a
large part of the table. Such *hot* keys are found first, from counts that are
combined on the map side, and numbered by a range-partitioned sort instead:
every range covers a bounded slice of the key, and per-range counts give each
slice its starting number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tallybridge.functions.comparators import is_instant, is_number, is_text, nan_to_null
from tallybridge.functions.nested import as_text, is_nested
from tallybridge.functions.sqltext import both, expr, ident, listed, query
from tallybridge.operators.schema import key_value, normalise_names
from tallybridge.workspace import Workspace

SOURCE, TARGET = 0, 1

# A key with more rows than this is hot.
HOT_KEY_ROWS = 250_000
# There are at most (rows / HOT_KEY_ROWS) hot keys. Up to so many their hashes are
# broadcast (512 KB); a longer list is left to Spark's own choice of join.
BROADCAST_KEYS = 65_536
# Starting numbers of ranges, by their number and the mean width of the sort keys.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows per task of a shuffle by key.
ROWS_PER_TASK = 500_000
# Rows per range of a hot key, and bytes of their sort keys by the mean width of those.
ROWS_PER_RANGE = 1_000_000
RANGE_BYTES = 1024 * 1024 * 1024
# The range sort samples 100 sort keys per range, up to three times over, on the driver:
# MAX_SAMPLE_BYTES bounds the sample of one sort by the measured width of the sort keys.
# Where it allows fewer ranges than there should be, each of them is split again.
MAX_SAMPLE_BYTES = 128 * 1024 * 1024
SAMPLES_PER_RANGE = 300


@dataclass(frozen=True)
class KeyProfile:
    """How many rows the sides have and how they spread over the keys."""

    source_rows: int
    target_rows: int
    source_largest: int
    target_largest: int
    hot_hashes: tuple[int, ...] = field(default=(), repr=False)
    hot_rows: int = 0

    @property
    def ordinary_rows(self) -> int:
        return self.source_rows + self.target_rows - self.hot_rows

    @property
    def source_unique(self) -> bool:
        return self.source_largest <= 1

    @property
    def target_unique(self) -> bool:
        return self.target_largest <= 1

    @property
    def unique(self) -> bool:
        return self.source_unique and self.target_unique


def _hash_inputs(keys: Sequence[str]) -> str:
    # The hash functions skip NULLs, so (NULL, 1) and (1, NULL) need the flags.
    flags = [f"{k} IS NULL" for k in keys] if len(keys) > 1 else []
    return listed([*keys, *flags])


def key_hash(keys: Sequence[str]) -> str:
    return f"xxhash64({_hash_inputs(keys)})"


def profile_keys(
    rows: DataFrame, keys: Sequence[str], hot_key_rows: int = HOT_KEY_ROWS
) -> KeyProfile:
    """Count rows per key from ``rows`` (key columns and ``_side``).

    Keys are represented by 96 bits of hash, so the shuffle moves a few bytes
    per key however wide the key is. A collision can only make unique keys look
    duplicated, or a small key look hot; both lead to a slower plan with the
    same result. One job tells the totals and the hot keys, of which there are
    at most a row for every ``hot_key_rows``.
    """
    counts = query(
        f"""
        SELECT {key_hash(keys)} AS _h, hash({_hash_inputs(keys)}) AS _h2,
               count_if(_side = {SOURCE}) AS _n0, count_if(_side = {TARGET}) AS _n1
        FROM {{rows}} GROUP BY 1, 2
        """,
        rows=rows,
    )
    (totals,) = query(
        """
        SELECT coalesce(sum(_n0), 0) AS sum0, coalesce(sum(_n1), 0) AS sum1,
               coalesce(max(_n0), 0) AS max0, coalesce(max(_n1), 0) AS max1,
               collect_list(IF(greatest(_n0, _n1) > {hot}, struct(_h, _n0 + _n1 AS _n), NULL)) AS hot
        FROM {counts}
        """.replace("{hot}", str(int(hot_key_rows))),
        counts=counts,
    ).collect()
    hot = totals["hot"]
    return KeyProfile(
        source_rows=totals["sum0"],
        target_rows=totals["sum1"],
        source_largest=totals["max0"],
        target_largest=totals["max1"],
        hot_hashes=tuple({row["_h"] for row in hot}),
        hot_rows=sum(row["_n"] for row in hot),
    )


def split_hot(
    rows: DataFrame, keys: Sequence[str], profile: KeyProfile
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, and those of hot keys if there are any."""
    if not profile.hot_hashes:
        return rows, None
    hint = "/*+ BROADCAST(h) */" if len(profile.hot_hashes) <= BROADCAST_KEYS else ""
    hot = rows.sparkSession.createDataFrame([(h,) for h in profile.hot_hashes], "_hot long")
    ordinary, listed_hot = (
        query(
            f"""
            SELECT {hint} r.* FROM {{rows}} AS r
            LEFT {how} JOIN {{hot}} AS h ON {key_hash(keys)} = h._hot
            """,
            rows=rows,
            hot=hot,
        )
        for how in ("ANTI", "SEMI")
    )
    return ordinary, listed_hot


@dataclass(frozen=True)
class Ordering:
    """Sort expressions, whole values all of them, and those whose width varies."""

    columns: tuple[str, ...]
    texts: tuple[str, ...] = ()

    def __add__(self, other: Ordering) -> Ordering:
        return Ordering(self.columns + other.columns, self.texts + other.texts)


def ordering(columns: Sequence[Sequence[tuple[str, T.DataType]]]) -> Ordering:
    """How rows sort by their value columns, in the given order, NULLs first.

    Each entry holds one value, or one per side for a shared column; on any row
    at most one of them is filled. Columns whose types differ between the sides
    sort by their common type, and only values that have no place in it by
    their text, so values that are equal sort alike on both sides.
    """
    sort: list[str] = []
    texts: list[str] = []
    for variants in columns:
        if len({dtype.simpleString() for _, dtype in variants}) > 1:
            common = _common_order(variants)
            shown = _either([as_text(v, t) for v, t in variants])
            if common is not None:
                sort.append(common)
                shown = f"IF({common} IS NULL, {shown}, NULL)"
            if common is None or any(is_text(t) for _, t in variants):
                sort.append(shown)
                texts.append(shown)
            continue
        dtype = variants[0][1]
        value = _either([_plain(v, t) for v, t in variants])
        sort.append(value)
        if is_text(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
            texts.append(value)
    return Ordering(tuple(sort), tuple(texts))


def _either(values: Sequence[str]) -> str:
    return values[0] if len(values) == 1 else f"coalesce({listed(values)})"


def _plain(value: str, dtype: T.DataType) -> str:
    """The value without NaN, and nested values as text with their NULLs shown."""
    return as_text(value, dtype) if is_nested(dtype) else nan_to_null(value, dtype)


def _common_order(variants: Sequence[tuple[str, T.DataType]]) -> str | None:
    types = [dtype for _, dtype in variants]
    numbers = [is_number(t) or isinstance(t, T.BooleanType) for t in types]
    instants = [is_instant(t) for t in types]
    for wanted, fits in (("DOUBLE", numbers), ("TIMESTAMP_NTZ", instants)):
        if any(fits) and all(fit or is_text(t) for fit, t in zip(fits, types)):
            return _either([_to(v, t, wanted) for v, t in variants])
    return None


def _to(value: str, dtype: T.DataType, wanted: str) -> str:
    if is_text(dtype):
        return f"TRY_CAST({value} AS {wanted})"
    if isinstance(dtype, T.BooleanType):
        return f"CAST(CAST({value} AS INT) AS {wanted})"
    return f"CAST({value} AS {wanted})"


def spread(rows: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """``rows``, so many in total, shuffled by ``keys``.

    Beyond a task's rows the number of tasks is given: Spark would merge them by their
    compressed bytes, and of copies millions of rows take next to none.
    """
    if total <= ROWS_PER_TASK:
        return query(f"SELECT * FROM {{rows}} DISTRIBUTE BY {listed(keys)}", rows=rows)
    conf = rows.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")
    usual = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", usual)
    tasks = max(int(usual), ceil(total / ROWS_PER_TASK))
    return query(f"SELECT /*+ REPARTITION({tasks}, {listed(keys)}) */ * FROM {{rows}}", rows=rows)


def number_ordinary(rows: DataFrame, keys: Sequence[str], order: Ordering, total: int) -> DataFrame:
    """Add ``_ord`` with one shuffle on the key, which later grouping can reuse."""
    return query(
        f"""
        SELECT *, CAST(row_number() OVER (
                      PARTITION BY {listed(keys)}, _side
                      ORDER BY {listed(order.columns) or "_side"}) AS BIGINT) AS _ord
        FROM {{rows}}
        """,
        rows=spread(rows, keys, total),
    )


def range_count(rows: int, rows_per_range: int, width: int, fewest: int = 2) -> int:
    """Ranges of one sort of so many rows; at least ``fewest``, unless their sample is too big."""
    affordable = MAX_SAMPLE_BYTES // (SAMPLES_PER_RANGE * max(width, 1))
    return max(2, min(max(ceil(rows / rows_per_range), fewest), affordable))


def sorted_ranges(
    rows: DataFrame,
    total: int,
    columns: Sequence[str],
    width: int,
    rows_per_range: int,
    fewest: int,
    workspace: Workspace,
) -> tuple[DataFrame, int]:
    """``rows`` on disk with ``_range`` and ``_pos``, their place in the order of ``columns``.

    A sort has as many ranges as its sample may have. Ranges that are still too large are
    written apart and sorted one by one into ranges of their own, and so on, so that none
    grows with the width of the sort keys. Returns the number of ranges too.
    """
    order = [expr(c) for c in columns]
    rows_per_range = max(1, min(rows_per_range, RANGE_BYTES // max(width, 1)))
    path, ranges = workspace.place("hot-sorted"), 0
    # The last entry comes next, so that ranges are numbered in their order.
    waiting = [(rows, total, fewest)]
    while waiting:
        part, held, fewest = waiting.pop()
        count = range_count(held, rows_per_range, width, fewest)
        ranged = part.repartitionByRange(count, *order)
        if count < ceil(held / rows_per_range):
            parts = workspace.store(
                query("SELECT *, spark_partition_id() AS _part FROM {rows}", rows=ranged), "hot-parts", "_part"
            )
            sizes = parts.groupBy("_part").count().orderBy(F.desc("_part")).collect()
            waiting += [(parts.where(F.col("_part") == p).drop("_part"), n, 1) for p, n in sizes]
            continue
        placed = query(
            f"""
            SELECT *, {ranges} + spark_partition_id() AS _range, monotonically_increasing_id() AS _pos
            FROM (SELECT * FROM {{rows}} SORT BY {listed(columns)})
            """,
            rows=ranged,
        )
        placed.write.mode("append").parquet(path)
        ranges += count
    return workspace.read(path, placed), ranges


def text_width(order: Ordering) -> Column:
    """Mean bytes of a sort key's texts."""
    sizes = [f"coalesce(octet_length({t}), 0)" for t in order.texts] or ["0"]
    return expr(f"avg({' + '.join(sizes)})").alias("width")


def number_hot(
    rows: DataFrame,
    keys: Sequence[str],
    key_types: Sequence[T.DataType],
    order: Ordering,
    workspace: Workspace,
    profile: KeyProfile,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``_ord`` without ever bringing one key together.

    ``_tie`` lets exact copies of a row fall into different ranges. It is not
    reproducible, so it is written out before anything depends on it, and so are
    the ranges, whose boundaries come from a sample.

    A range holds consecutive rows of the sort, so there is a (key, side) more than there
    are ranges for every further key and side at most. That bounds the table of starting
    numbers, which is broadcast as long as its bound is small: the rows themselves are
    shuffled for the sort alone.
    """
    by_key = ordering([[(k, t)] for k, t in zip(keys, key_types)])
    full = by_key + Ordering(("_side",)) + order + Ordering(("_tie",))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    tied = query("SELECT *, monotonically_increasing_id() AS _tie FROM {rows}", rows=rows)
    tied = workspace.store(tied.observe(seen, text_width(full)), "hot")
    width = int(seen.get["width"] or 0) + 16 * len(full.columns)
    placed, ranges = sorted_ranges(
        tied, profile.hot_rows, full.columns, width, rows_per_range, tasks, workspace
    )
    group = listed([*keys, "_side"])
    starts = ranges + 2 * len(profile.hot_hashes)
    hint = "/*+ BROADCAST(o) */" if starts * width <= BROADCAST_BYTES else ""
    return query(
        f"""
        SELECT {hint} p.* EXCEPT (_tie, _pos, _range), o._before + p._pos - o._first + 1 AS _ord
        FROM {{placed}} AS p
        JOIN (SELECT *, coalesce(sum(_n) OVER (
                         PARTITION BY {group} ORDER BY _range
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before
              FROM (SELECT {group}, _range, min(_pos) AS _first, count(*) AS _n
                    FROM {{placed}} GROUP BY {group}, _range)) AS o
        ON {both(f"p.{k} <=> o.{k}" for k in keys)}
           AND p._side = o._side AND p._range = o._range
        """,
        placed=placed,
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    df = normalise_names(df)
    names = [key.lower() for key in keys]
    types = {f.name: f.dataType for f in df.schema}
    shown = listed(f"{key_value(k, types[k], types[k])} AS {ident(k)}" for k in names)
    return query(
        f"""
        SELECT *, count(*) AS copies FROM (SELECT {shown} FROM {{rows}})
        GROUP BY {listed(ident(k) for k in names)} HAVING count(*) > 1
        """,
        rows=df,
    )


def key_ordinals(
    df: DataFrame,
    keys: Sequence[str],
    hot_key_rows: int = HOT_KEY_ROWS,
    rows_per_range: int = ROWS_PER_RANGE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """The relation plus ``ordinal``, its row's number inside the key."""
    df = normalise_names(df)
    names = [key.lower() for key in keys]
    types = {f.name: f.dataType for f in df.schema}
    inner = {name: f"_k{i}" for i, name in enumerate(names)}
    values = [name for name in types if name not in inner]
    inner |= {name: f"_s{i}" for i, name in enumerate(values)}
    shown = listed(
        f"{key_value(n, types[n], types[n]) if n in names else ident(n)} AS {i}"
        for n, i in inner.items()
    )
    rows = query(f"SELECT {SOURCE} AS _side, {shown} FROM {{rows}}", rows=df)
    matched_on = [inner[name] for name in names]
    order = ordering([[(inner[name], types[name])] for name in values])
    profile = profile_keys(rows, matched_on, hot_key_rows)
    ordinary, hot = split_hot(rows, matched_on, profile)
    numbered = number_ordinary(ordinary, matched_on, order, profile.ordinary_rows)
    if hot is not None:
        workspace = workspace or Workspace(df.sparkSession)
        key_types = [types[name] for name in names]
        numbered = numbered.unionByName(
            number_hot(
                hot, matched_on, key_types, order, workspace, profile, rows_per_range
            )
        )
    shown = listed(f"{inner[name]} AS {ident(name)}" for name in types)
    return query(f"SELECT {shown}, _ord AS ordinal FROM {{rows}}", rows=numbered)
