"""Language identification by Bayesian fusion of independent evidence.

For every document the posterior of a language is proportional to

    text likelihood ** temper * P(declared | language) * P(suffix | language) * host prior

* text: byte trigrams (lower case, hashed to ``CELLS`` cells) under a multinomial model
  trained on a bounded sample of labelled rows (``SAMPLE`` rows of every language, by a
  hash), over the whole text; ``SMOOTHING`` of every language is what all have in common;
* declared language and address suffix: how often a language is declared, or seen, among
  documents whose text speaks for it, by grouped aggregation over all documents;
* host prior: the host's soft counts, smoothed by its domain's, smoothed by all documents'.
  A document's own evidence is taken out of its host's and domain's counts.

A document is rejected (language ``und``) if it has no letters or no language reaches
``LEAST_POSTERIOR``.

Cases: NULL and empty texts are rejected; NULL declared languages, suffixes and hosts give
no evidence; rows that repeat an id give a row each; without any labelled text all rows are
rejected; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybridge.llm import arrays
from tallybridge.workspace import Workspace

# Labelled rows of a language that training may use.
SAMPLE = 300
# Share of the common background in every language, the same for all so that languages
# with little text neither attract nor repel what no language has seen.
SMOOTHING, UNIFORM = 0.2, 0.1
CELLS = 1 << 15
# Bytes whose trigrams are in memory at a time.
_SLICE = 1 << 19
# Trigrams of a text are no independent witnesses: their mean counts so many times at most.
WITNESSES = 60.0
LEAST_POSTERIOR = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
# How many documents' worth of trust the level above has.
HOST_TRUST, DOMAIN_TRUST = 5.0, 20.0
VALUE_TRUST = 2.0


class TextModel:
    """Languages and the log-probability of every trigram cell in each."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihood of every text in every language, and which texts have letters."""
        n = len(offsets) - 1
        out, letters = np.zeros((n, len(self.langs))), np.zeros(n, bool)
        for i, j, part, cuts in arrays.each(data, offsets, _SLICE):
            # A slice at a time: running sums over a whole batch take 16 bytes a byte.
            at = np.flatnonzero(_LETTER[part])
            letters[i:j] = np.searchsorted(at, cuts[1:]) > np.searchsorted(at, cuts[:-1])
            cells, owner = _trigrams(part, cuts)
            if len(cells):
                counts = np.bincount(owner, minlength=j - i)
                scale = np.minimum(counts, WITNESSES) / np.maximum(counts, 1)
                for k in range(len(self.langs)):
                    out[i:j, k] = np.bincount(owner, self.logs[k][cells], j - i) * scale
        return out, letters


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams inside texts, and whose they are."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = arrays.lowered(data).astype(np.uint32)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)
    cells = (code >> np.uint32(17)).astype(np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[2:] == owner[:-2]
    return cells[inside], owner[2:][inside]


def fit(texts: list[bytes], langs: list[str]) -> TextModel:
    names = sorted(set(langs))
    counts = np.zeros((len(names), CELLS))
    index = {lang: k for k, lang in enumerate(names)}
    for text, lang in zip(texts, langs):
        cells, _ = _trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        counts[index[lang]] += np.bincount(cells, minlength=CELLS)
    own = (counts + 0.1 / CELLS) / (counts.sum(1, keepdims=True) + 0.1)
    common = (1 - UNIFORM) * own.sum(0) / max(len(names), 1) + UNIFORM / CELLS
    return TextModel(names, np.log((1 - SMOOTHING) * own + SMOOTHING * common))


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> TextModel:
    """A text model from at most ``SAMPLE`` distinct labelled rows of every language, by a hash of id and text."""
    known = labelled.select(
        F.col(lang_column).cast("string").alias("l"), F.xxhash64(id_column, text_column).alias("h"), F.col(text_column).alias("t")
    ).where("l IS NOT NULL AND t IS NOT NULL")
    keys = known.select("l", "h").distinct()
    # Twice as many by their hash alone, so that no language is sorted whole.
    share = keys.groupBy("l").agg(F.least(F.lit(1.0), 2 * SAMPLE / F.count("*")).alias("share"))
    place = F.xxhash64("h", F.lit(1))
    some = keys.join(F.broadcast(share), "l").where(F.pmod(place, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    chosen = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(place, "h"))).where(F.col("k") <= SAMPLE)
    rows = known.join(F.broadcast(chosen.select("l", "h")), ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t")).collect()
    return fit([r["t"].encode() for r in rows], [r["l"] for r in rows])


def _soft(logs: np.ndarray) -> np.ndarray:
    """Shares of every row's languages, from log-likelihoods."""
    shares = np.exp(logs - logs.max(1, keepdims=True))
    return shares / shares.sum(1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    """A row of the matrix a list."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(values.ravel()))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """Lists of ``k`` numbers; zeros where there is none."""
    out = np.zeros((len(column), k))
    filled = np.asarray(column.is_valid())
    if filled.any():
        out[filled] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def _fuse(logs: np.ndarray, soft: np.ndarray, voted: np.ndarray, prior: np.ndarray, found: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Posteriors; ``found`` has each evidence's soft counts and which rows have a value.

    A row's own vote is taken out of every count it is in.
    """
    def less_own(key: str) -> tuple[np.ndarray, np.ndarray]:
        if key not in found:
            return np.zeros_like(soft), np.zeros(len(soft), bool)
        counts, filled = found[key]
        return np.maximum(counts - np.where((voted & filled)[:, None], soft, 0.0), 0.0), filled

    def smoothed(counts: np.ndarray, above: np.ndarray, trust: float) -> np.ndarray:
        return (counts + trust * above) / (counts.sum(1, keepdims=True) + trust)

    at_domain = smoothed(less_own("_domain")[0], prior[None, :], DOMAIN_TRUST)
    out = logs + np.log(smoothed(less_own("_host")[0], at_domain, HOST_TRUST))
    for key in ("_declared", "_suffix"):
        counts, filled = less_own(key)
        # P(value | language) over P(value): its share among the language's documents.
        share = smoothed(counts, prior[None, :], VALUE_TRUST)
        out += np.where(filled[:, None], np.log(share / prior[None, :]), 0.0)
    return _soft(out)


def identify(
    docs: DataFrame,
    model: TextModel,
    text: Column,
    declared: Column | None,
    suffix: Column | None,
    host: Column | None,
    domain: Column | None,
    keep: list[str],
) -> DataFrame:
    """``docs``' columns ``keep`` with ``lang_id, posterior, text_posterior, accepted``.

    Evidence that a table doesn't have is None and costs no join.
    """
    spark = docs.sparkSession
    arrays.ship(spark)
    if not model.langs:
        return docs.select(
            *[F.col(f"`{c}`").alias(c) for c in keep], F.lit("und").alias("lang_id"), F.lit(0.0).alias("posterior"),
            F.lit(0.0).alias("text_posterior"), F.lit(False).alias("accepted"),
        )
    shared = spark.sparkContext.broadcast((model.langs, model.logs))
    names = [f"_v{i}" for i in range(len(keep))]
    given = {"_declared": declared, "_suffix": suffix, "_host": host, "_domain": domain}
    given = {key: column for key, column in given.items() if column is not None}
    source = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
        *[c.cast("string").alias(key) for key, c in given.items()], text.alias("_text"),
    )
    kept = source.drop("_text").schema
    k = len(model.langs)

    def ddl(fields: list) -> str:
        return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel(*shared.value)
        for batch in batches:
            data, offsets = arrays.utf8(batch.column(batch.num_columns - 1))
            logs, letters = own.likelihoods(data, offsets)
            columns = [*batch.columns[:-1], _lists(logs), _lists(_soft(logs)), pa.array(letters)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "_log", "_soft", "_letters"])

    workspace = Workspace(spark)
    scored = workspace.store(
        source.mapInArrow(score, f"{ddl(kept.fields)}_log array<double>, _soft array<double>, _letters boolean"), "evidence"
    )
    voters = scored.where("_letters")
    # The plan grows with the number of languages, not with its square.
    votes = F.array(*[F.sum(F.col("_soft")[i]) for i in range(k)])
    totals = np.array(voters.agg(votes.alias("n")).head()["n"], float)
    totals = np.where(np.isnan(totals), 0.0, totals)
    prior = (totals + 0.5) / (totals.sum() + 0.5 * k)
    out = scored
    for key in given:
        out = out.join(voters.where(F.col(key).isNotNull()).groupBy(key).agg(votes.alias(f"_n{key}")), key, "left")
    out = out.select(*names, "_letters", "_log", "_soft", *given, *[f"_n{key}" for key in given])
    result, used = [kept[n] for n in names], list(given)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*shared.value[0], "und"], object)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            letters = np.asarray(column["_letters"].fill_null(False))
            logs, soft = _matrix(column["_log"], k), _matrix(column["_soft"], k)
            found = {key: (_matrix(column[f"_n{key}"], k), np.asarray(column[key].is_valid())) for key in used}
            fused = _fuse(logs, soft, letters, prior, found)
            best = fused.max(1, initial=0.0)
            sure = letters & (best >= LEAST_POSTERIOR)
            yield pa.RecordBatch.from_arrays(
                [
                    *[column[n] for n in names], pa.array(langs[np.where(sure, fused.argmax(1), k)].tolist(), pa.string()),
                    pa.array(np.where(letters, best, 0.0)), pa.array(np.where(letters, soft.max(1, initial=0.0), 0.0)), pa.array(sure),
                ],
                [*names, "lang_id", "posterior", "text_posterior", "accepted"],
            )

    done = out.mapInArrow(fuse, f"{ddl(result)}lang_id string, posterior double, text_posterior double, accepted boolean")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_id", "posterior", "text_posterior", "accepted")


# --- pages ---------------------------------------------------------------------------


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments, tags or entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.regexp_replace(out, r"&[#\w]+;", " ")


def declared_language(html: Column) -> Column:
    """The language that the page's root element declares, without its region."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    host = host_of(F.col("url"))
    return identify(
        pages, model, page_text(F.col("html")), declared_language(F.col("html")),
        F.nullif(F.element_at(F.split(host, r"\."), -1), F.lit("")), host,
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), ["page_id"],
    )


# What a document's verdict depends on, besides the corpus.
_SAME = (
    "doc_id <=> _langid_doc AND xxhash64(text) = _langid_text AND lang <=> _langid_lang AND source <=> _langid_source"
)


def _verdicts(docs: DataFrame, model: TextModel) -> DataFrame:
    """A row per distinct document: the label is the declaration and the source the host.

    Texts go to the workers, but neither come back nor take part in the joins of evidence.
    """
    narrow = docs.select(
        F.col("doc_id").alias("_langid_doc"), F.xxhash64("text").alias("_langid_text"),
        F.col("lang").alias("_langid_lang"), F.col("source").alias("_langid_source"), F.col("text").alias("_langid_whole"),
    )
    keys = narrow.columns[:-1]
    found = identify(
        narrow, model, F.col("_langid_whole"), F.col("_langid_lang"), None, F.col("_langid_source"), None, keys
    )
    return found.dropDuplicates(keys)


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """``docs`` with ``lang_id, posterior, text_posterior, accepted``."""
    found = _verdicts(docs, model)
    return docs.join(found, F.expr(_SAME)).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[found[c] for c in ("lang_id", "posterior", "text_posterior", "accepted")]
    )


def accepted_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns only."""
    known = _verdicts(docs, model).where("accepted").select("_langid_doc", "_langid_text", "_langid_lang", "_langid_source")
    # Columns under names of their own, so that none of the input's can clash.
    read = ["doc_id", "text", "lang", "source"]
    inner = {c: c if c in read else f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*inner.values()).join(known, F.expr(_SAME), "left_semi").toDF(*inner)
