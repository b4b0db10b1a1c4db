"""Compare two relations: the public entry point and the bundle it returns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, types as T

from tallybridge.errors import SchemaError
from tallybridge.functions.comparators import Comparison, Tolerance
from tallybridge.functions.nested import sql_type
from tallybridge.functions.sqltext import expr, ident, listed, query
from tallybridge.operators import match, samples, stats
from tallybridge.operators.keys import (
    HOT_KEY_ROWS,
    ROWS_PER_RANGE,
    SOURCE,
    TARGET,
    KeyProfile,
    ordering,
)
from tallybridge.operators.schema import Layout, describe, normalise_names
from tallybridge.workspace import Workspace


def reconcile(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    *,
    abs_tol: float = 0.0001,
    rel_tol: float = 0.0,
    source_name: str = "original",
    target_name: str = "new",
    key_profile: KeyProfile | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
    rows_per_range: int = ROWS_PER_RANGE,
    workspace: Workspace | None = None,
) -> Reconciliation:
    """Match ``source`` and ``target`` on ``keys`` and describe the differences.

    One small job runs here, to learn whether keys repeat and whether any of
    them is hot; pass the ``key_profile`` of an earlier call over the same data
    to skip it. Everything on the result is lazy.
    """
    tolerance = Tolerance(abs_tol, rel_tol)
    source, target = _typed(normalise_names(source)), _typed(normalise_names(target))
    layout = describe(source, target, keys)
    known = key_profile or match.profile(source, target, layout, hot_key_rows)
    space = workspace or Workspace(source.sparkSession)
    if known.unique:
        classified = match.classify_unique(source, target, layout)
    else:
        classified = match.classify_duplicates(
            source, target, layout, known, space, rows_per_range
        )
    return Reconciliation(
        layout=layout,
        tolerance=tolerance,
        key_profile=known,
        source_name=source_name,
        target_name=target_name,
        classified=classified,
        workspace=space,
        _inputs=(source, target),
    )


def count_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows per side, one-sided and matched, from the key columns alone.

    The same numbers as ``reconcile(...).row_summary()`` has, without a key profile.
    """
    source, target = _typed(normalise_names(source)), _typed(normalise_names(target))
    return match.row_counts(source, target, describe(source, target, keys))


def _typed(df: DataFrame) -> DataFrame:
    """An untyped NULL column has no storage type; make it text."""
    if not any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return df
    shown = listed(
        f"CAST({ident(f.name)} AS STRING) AS {ident(f.name)}"
        if isinstance(f.dataType, T.NullType)
        else ident(f.name)
        for f in df.schema
    )
    return query(f"SELECT {shown} FROM {{rows}}", rows=df)


@dataclass(frozen=True)
class Reconciliation:
    layout: Layout
    tolerance: Tolerance
    key_profile: KeyProfile
    source_name: str
    target_name: str
    classified: DataFrame = field(repr=False)
    workspace: Workspace = field(repr=False)
    _inputs: tuple[DataFrame, DataFrame] = field(repr=False)
    _stored: bool = False
    _row_summary: DataFrame | None = field(default=None, repr=False)
    _column_stats: DataFrame | None = field(default=None, repr=False)

    # -- rows ---------------------------------------------------------------

    def stored(self) -> Reconciliation:
        """Write the classified rows once, so that several outputs can share them.

        The table is partitioned by status: one-sided outputs do not read the
        matched rows, and the other way round. A target value that is the source's too is
        kept once. Row and column measures are observed
        while the rows are written, so they need no scan of their own.
        """
        if self._stored:
            return self
        rules = self.rules()
        wanted = [
            *stats.row_measures(rules),
            *stats.column_measures(self.layout, rules, self.layout.compared, stats.MATCHED),
        ]
        seen = Observation()
        labelled = query(f"SELECT *, {stats.STATUS} AS _status FROM {{rows}}", rows=self.classified)
        watched = labelled.observe(seen, *map(expr, wanted))
        table = self.workspace.store(
            match.kept_once(watched, self.layout), "classified", "_status", codec="zstd"
        )
        return replace(self, classified=match.kept_twice(table, self.layout), _stored=True)._measured(seen.get)

    def _measured(self, measures: dict[str, object]) -> Reconciliation:
        """Keep the measures that were observed while the rows were written: one row."""
        spark = self.classified.sparkSession
        counts = ", ".join(f"{name} long" for name in stats.ROW_FIELDS)
        rows = stats.measured_columns(self.layout, self.rules(), measures)
        columns = spark.createDataFrame(rows, stats.STAT_TYPES)
        return replace(
            self,
            _row_summary=spark.createDataFrame([tuple(measures[n] for n in stats.ROW_FIELDS)], counts),
            _column_stats=self._stat_fields(columns, f"{measures['matched']}L"),
        )

    @staticmethod
    def _stat_fields(columns: DataFrame, total: str) -> DataFrame:
        return query(
            f"""
            SELECT position, `column`, source_type, target_type, matches,
                   total - matches AS unequal, total, {stats.percent("matches", "total")} AS percent,
                   max_diff, null_diff
            FROM (SELECT *, {total} AS total FROM {{columns}})
            """,
            columns=columns,
        )

    def close(self) -> None:
        """Drop the intermediate tables; lazy results no longer work afterwards."""
        self.workspace.release()

    def _status_is(self, status: str) -> str:
        if self._stored:
            return f"_status = '{status}'"
        return {
            "matched": stats.MATCHED,
            "source_only": "_in_s IS NOT NULL AND _in_t IS NULL",
            "target_only": "_in_t IS NOT NULL AND _in_s IS NULL",
        }[status]

    def _rows(self, status: str, select: str = "*", tail: str = "") -> DataFrame:
        return query(
            f"SELECT {select} FROM {{rows}} WHERE {self._status_is(status)} {tail}",
            rows=self.classified,
        )

    def row_status(self) -> DataFrame:
        """Every key and ordinal with its status."""
        return query(
            f"""
            SELECT {listed(self._keys())}, _ord AS ordinal, {stats.STATUS} AS status
            FROM {{rows}}
            """,
            rows=self.classified,
        )

    def source_only_rows(self) -> DataFrame:
        return self._one_sided(SOURCE)

    def target_only_rows(self) -> DataFrame:
        return self._one_sided(TARGET)

    def _one_sided(self, side: int) -> DataFrame:
        if self.key_profile.unique and not self._stored:
            return match.only_in(*self._inputs, self.layout, side)
        types = self.layout.source if side == SOURCE else self.layout.target
        inner = match.value_names(self.layout, side) | dict(
            zip(self.layout.keys, match.key_names(self.layout))
        )
        shown = listed(
            f"CAST({inner[name]} AS {sql_type(dtype)}) AS {ident(name)}"
            if name in self.layout.keys
            else f"{inner[name]} AS {ident(name)}"
            for name, dtype in types.items()
        )
        return self._rows("source_only" if side == SOURCE else "target_only", shown)

    def matched_rows(self) -> DataFrame:
        """Keys once, shared columns from both sides with a match flag each."""
        return self._rows("matched", self._wide())

    def _wide(self) -> str:
        layout, rules = self.layout, self.rules()
        columns = dict(zip(layout.keys, match.key_names(layout)))
        shown = list(columns.items())
        for side, suffix in ((SOURCE, "original"), (TARGET, "new")):
            for name, inner in match.value_names(layout, side).items():
                shown.append((f"{name}_{suffix}" if name in rules else name, inner))
        shown += [(f"{name}_match", rule.match) for name, rule in rules.items()]
        names = [name for name, _ in shown]
        clash = sorted({name for name in names if names.count(name) > 1})
        if clash:
            raise SchemaError(f"matched rows would repeat the column {', '.join(clash)}")
        return listed(f"{value} AS {ident(name)}" for name, value in shown)

    def _keys(self) -> list[str]:
        inner = match.key_names(self.layout)
        return [f"{k} AS {ident(name)}" for k, name in zip(inner, self.layout.keys)]

    def rules(self) -> dict[str, Comparison]:
        return stats.comparisons(self.layout, self.tolerance)

    # -- measures -----------------------------------------------------------

    def column_stats(self) -> DataFrame:
        """One row per shared column: matches, unequal, percent, differences.

        Only matched rows are read, once, so the join narrows to an inner join. The
        aggregate has a row for every ``stats.COLUMNS_A_ROW`` columns.
        """
        if self._column_stats is not None:
            return self._column_stats
        rules = self.rules()
        spark = self.classified.sparkSession
        found = query(
            f"""
            SELECT /*+ BROADCAST(f) */ c.position, c.`column`, c.source_type, c.target_type,
                   coalesce(f.matches[c.slot], 0L) AS matches,
                   coalesce(f.gaps[c.slot], 0L) AS null_diff,
                   IF(f.total IS NULL, c.none, f.largest[c.slot]) AS max_diff,
                   coalesce(f.total, 0L) AS _total
            FROM (SELECT {stats.column_list(self.layout, rules)} FROM {{one}}) AS c
            LEFT JOIN (
                SELECT g, {listed(stats.grouped_measures(self.layout))}
                FROM (SELECT {stats.grouped_columns(self.layout, rules)}
                      FROM {{rows}} WHERE {self._status_is("matched")})
                GROUP BY g) AS f
            ON c.g = f.g
            """,
            one=spark.range(1),
            rows=self.classified,
        )
        return self._stat_fields(found, "_total")

    def row_summary(self) -> DataFrame:
        """Row counts per side and status, and matched rows that agree or differ."""
        if self._row_summary is not None:
            return self._row_summary
        return query(
            f"SELECT {listed(stats.row_measures(self.rules()))} FROM {{rows}}",
            rows=self.classified,
        )

    def column_summary(self) -> DataFrame:
        """Columns with some, and with all, values equal; unequal values in total."""
        return query(
            """
            SELECT count_if(unequal > 0) AS columns_some_unequal,
                   count_if(unequal = 0) AS columns_all_equal,
                   coalesce(sum(unequal), 0) AS unequal_values
            FROM {stats}
            """,
            stats=self.column_stats(),
        )

    def verdict(self) -> DataFrame:
        return query(
            f"SELECT {stats.verdict(self.layout)} AS identical FROM {{counts}}",
            counts=self.row_summary(),
        )

    # -- samples ------------------------------------------------------------

    def matched_sample(self, n: int = samples.SAMPLE_ROWS) -> DataFrame:
        """The first matched rows in key order: a top-n per task, then a merge."""
        order = listed([*match.key_names(self.layout), "_ord"])
        return self._rows("matched", self._wide(), f"ORDER BY {order} LIMIT {int(n)}")

    def mismatch_samples(self, n: int = samples.SAMPLE_ROWS) -> DataFrame:
        return samples.mismatch_samples(self._rows("matched"), self.layout, self.rules(), n)

    def source_only_sample(
        self, n: int = samples.SAMPLE_ROWS, columns: int = samples.SAMPLE_COLUMNS
    ) -> DataFrame:
        return self._one_sided_sample(SOURCE, n, columns)

    def target_only_sample(
        self, n: int = samples.SAMPLE_ROWS, columns: int = samples.SAMPLE_COLUMNS
    ) -> DataFrame:
        return self._one_sided_sample(TARGET, n, columns)

    def _one_sided_sample(self, side: int, n: int, columns: int) -> DataFrame:
        types = self.layout.source if side == SOURCE else self.layout.target
        order = [ident(name) for name in self.layout.keys]
        if not self.key_profile.unique:
            # Copies of a key need their other columns to come out in a fixed order.
            rest = [[(ident(c), t)] for c, t in types.items() if c not in self.layout.keys]
            order += ordering(rest).columns
        shown = listed(ident(name) for name in list(types)[:columns])
        return query(
            f"SELECT {shown} FROM {{rows}} ORDER BY {listed(order)} LIMIT {int(n)}",
            rows=self._one_sided(side),
        )
