"""How far the sources of a language stray from one another, by the counts of their terms.

1. Every document becomes an exact sparse count vector over its terms.
2. Vectors are summed by (language, source), first inside an Arrow batch, then by Spark.
   The vocabulary of a language holds all terms in at least ``MIN_DF`` of its documents,
   without a limit on its size: what ``CountVectorizer(minDF=10, vocabSize=2**31 - 1)`` fits
   for the language. That class collects its vocabulary to the driver and broadcasts it;
   here vocabularies are rows of a table, so they may grow with the corpus, and all
   languages are fitted in the same pass.
3. Sources are compared in pairs on the terms that either of them has. All terms that both
   lack contribute the same amount, which is added once. A language's terms are dealt by
   hash to parts, and its sources to blocks; a task compares one block of sources with all
   sources on one part of the terms.
4. Each source is compared with its whole language term by term for the report's terms.

All arithmetic is on integers: counts and shares in decimals or 64 bits, sums of shares'
divergences in 64 bits.

Cases: NULL texts, languages and sources read as ''; a group without terms is compared like
any other; with an empty vocabulary all values are 0; a language of one source has no pairs;
rows that repeat an id are documents of their own; ties rank by the item's bytes; an empty
table gives no rows; only the three named columns are read. A very long text is one vector.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybridge.llm import arrays
from tallybridge.workspace import Workspace

MIN_DF = 10
SCALE = 1_000_000_000
PRIOR = 2
TOP_TERMS = 10
# Sparse entries of a part of the terms, and sources of a block.
PART_ENTRIES, BLOCK_SOURCES = 250_000, 256
# Distinct (group, term) sums that a worker holds before it hands them to Spark.
HELD_SUMS = 300_000

# Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

# Letters, and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_SUMS = "lang string, source string, term string, n long, docs long"
_PARTIAL = "lang string, a long, b long, value long"


def vector(text: bytes) -> Counter[bytes]:
    """The sparse count vector of a text."""
    text = text.lower()
    counts, begin = Counter(), 0
    while begin < len(text):
        gap = _GAP.search(text, begin + PIECE)
        end = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text, begin, end))
        begin = end
    return counts


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the batches' vectors, and in how many documents each term is, by group."""

    def rows() -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source), own in held.items():
            seen = found[lang, source]
            columns[0] += [lang] * len(own)
            columns[1] += [source] * len(own)
            columns[2] += own
            columns[3] += own.values()
            columns[4] += map(seen.__getitem__, own)
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        filled = [pa.array(c, k) for c, k in zip(columns, kinds)]
        filled[2] = filled[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(filled, ["lang", "source", "term", "n", "docs"])

    held, found = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3))):
            own = vector(text.as_buffer().to_pybytes())
            key = lang.as_py(), source.as_py()
            held[key].update(own)
            found[key].update(own.keys())
        if sum(map(len, held.values())) > HELD_SUMS:
            yield rows()
            held.clear()
            found.clear()
    if held:
        yield rows()


def _share(count: str, total: str) -> Column:
    """A term's share in integer billionths, one at least; decimals hold what longs can't."""
    return F.expr(
        f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(20, 0)) "
        f"div cast({total} + {PRIOR} * v as decimal(20, 0))"
    )


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _distance_sql(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _compare(group: pa.Table) -> pa.Table:
    """What one part of a language's terms adds to the distances of one block of sources.

    Rows without a term say the share of all terms that a source lacks. For a source ``a``
    and every ``b``: the terms of ``a`` against what ``b`` lacks, and, on the terms of
    ``b``, the difference that its own share makes. Terms that both lack are left out.
    """
    lang = group["lang"][0].as_py()
    block = group["block"][0].as_py()
    lacking = group.filter(pc.is_null(group["term"])).sort_by("source_id")
    ids, base = lacking["source_id"].to_numpy(), lacking["p"].to_numpy()
    asked = np.flatnonzero(lacking["own_block"].to_numpy() == block)
    entries = group.filter(pc.is_valid(group["term"])).sort_by("source_id")
    owner = np.searchsorted(ids, entries["source_id"].to_numpy())
    term = entries["term"].combine_chunks().dictionary_encode() if len(entries) else pa.array([], pa.string()).dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    n_terms, term = len(term.dictionary), term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p = entries["p"].to_numpy()
    cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    values = np.zeros((len(asked), len(ids)), np.int64)
    for k, a in enumerate(asked):
        at = slice(cuts[a], cuts[a + 1])
        both = _distance(base[a], base)
        # Distinct shares stand for all their terms.
        shares, times = np.unique(p[at], return_counts=True)
        for some in range(0, len(shares), 4096):
            own, often = shares[some : some + 4096], times[some : some + 4096]
            values[k] += ((_distance(own[:, None], base[None, :]) - both) * often[:, None]).sum(0)
        mine = np.full(n_terms, base[a], np.int64)
        mine[term[at]] = p[at]
        if len(p):
            change = _distance(mine[term], p) - _distance(mine[term], base[owner])
            values[k, filled] += np.add.reduceat(change, cuts[filled])
    a, b = np.repeat(ids[asked], len(ids)), np.tile(ids, len(asked))
    apart = a != b
    values = values.ravel()[apart]
    return pa.table(
        {
            "lang": pa.array([lang] * len(values), pa.string()), "a": pa.array(a[apart], pa.int64()),
            "b": pa.array(b[apart], pa.int64()), "value": pa.array(values, pa.int64()),
        }
    )


def group_sums(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: the summed count vectors of every group."""
    spark = docs.sparkSession
    arrays.ship(spark)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"))
    sums = texts.mapInArrow(_group_sums, _SUMS)
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: the pairs of sources and their telling terms."""
    spark = docs.sparkSession
    workspace = Workspace(spark)
    per_term = Window.partitionBy("lang", "term")
    kept = workspace.store(
        group_sums(docs)
        .select("lang", "source", "term", "n", F.sum("docs").over(per_term).alias("df"), F.sum("n").over(per_term).alias("total"))
        .where(f"df >= {MIN_DF}").drop("df"),
        "kept",
    )
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("total").alias("n_lang")
    )
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("entries"))
    groups = workspace.store(
        seen.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["n_source", "entries", "v", "n_lang"])
        .withColumn("source_id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        # Without a vocabulary nothing is divided.
        .withColumn("lacking", F.when(F.col("v") > 0, _share("0", "n_source")).otherwise(1)),
        "groups",
    )
    entries = workspace.store(
        kept.join(groups.select("lang", "source", "source_id", "n_source", "v", "n_lang"), ["lang", "source"])
        .select("lang", "source", "source_id", "term", _share("n", "n_source").alias("p"), _share("total", "n_lang").alias("q")),
        "entries",
    )

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance_sql("p", "q").alias("value")
    )
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {TOP_TERMS}")

    sizes = groups.groupBy("lang").agg(
        F.ceil(F.greatest(F.sum("entries"), F.lit(1)) / PART_ENTRIES).alias("parts"),
        F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"),
    )
    own_block = F.floor(F.col("source_id") / BLOCK_SOURCES).alias("own_block")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    dealt = (
        entries.join(sizes, "lang")
        .select("lang", F.pmod(F.xxhash64("term"), "parts").alias("slice"), every_block, "source_id", own_block, "term", "p")
    )
    bases = (
        groups.join(sizes, "lang")
        .select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "blocks", "source_id", "lacking")
        .select("lang", "slice", every_block, "source_id", own_block, F.lit(None).cast("string").alias("term"), F.col("lacking").alias("p"))
    )
    partial = dealt.unionByName(bases).groupBy("lang", "slice", "block").applyInArrow(_compare, _PARTIAL)
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = groups.select("lang", "source", "source_id", "lacking", "v")
    left = side.toDF("lang", "source", "a", "pa", "v")
    right = side.drop("v").toDF("lang", "item", "b", "pb")
    pairs = sums.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        # What all terms would add if both sources lacked them.
        F.when(F.col("v") > 0, F.col("value") + F.col("v") * _distance_sql("pa", "pb")).otherwise(0).alias("value"),
    )
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return terms.unionByName(pairs).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_lang FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
sizes AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n_source
  FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
dense AS (
  SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.n_source + 2 * l.v) AS p,
         1 + 1000000000 * (t.total + 2) // (l.n_lang + 2 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN vocabulary t USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
report AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pair
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM term),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM report)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
