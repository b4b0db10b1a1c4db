"""Quality rules from distributions: Jensen-Shannon distance to language references.

References are learnt from all documents by grouped aggregation: for every language the
share of each character class, and of each common word (those that make up at least
``COMMON_SHARE`` of its words; so there are at most ``1 / COMMON_SHARE`` of them). Every
language of ``LANGUAGE_WORDS`` words has one, whatever else is in the corpus. A text fails
if it is far from every language in either histogram and long enough for that histogram to
say so; texts in a language without a reference are left to the base rule.

Cases: a NULL text has no words and fails the base rule; documents without a language
count for no reference and are measured against all; with no reference at all (an empty table, no language) only the
base rule decides; rows that repeat an id give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays

COMMON_SHARE = 0.001
# Words from which shares of COMMON_SHARE can be told.
LANGUAGE_WORDS = round(1 / COMMON_SHARE)
# Shortest text for each histogram, and the largest distance that passes.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.25
MIN_WORDS, MAX_WORD_DISTANCE = 100, 0.5

# Character classes: lower case, upper case, digit, white space, sentence marks, other
# ASCII marks, control characters, and beyond ASCII.
CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 5
_CLASS[:32] = 6
_CLASS[127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

COUNTS = "lang string, kind int, item long, n long"
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of every class in every text."""
    heads = (data & 0xC0) != 0x80
    kinds = _CLASS[data]
    return np.stack([_per_text(heads & (kinds == c), offsets) for c in range(CLASSES)], 1)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = arrays.lowered(data)
    starts, ends, first = arrays.words(low, offsets)
    return arrays.span_hashes(low, starts, ends), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and word counts of a batch by language."""
    for batch in batches:
        langs, names = pd.factorize(batch.column(1).to_pandas(), use_na_sentinel=True)
        data, offsets = arrays.utf8(batch.column(0))
        chars = np.zeros((len(names), CLASSES), np.int64)
        hashes, owners = [], []
        for i, j, part, cuts in arrays.each(data, offsets):
            own = langs[i:j]
            known = own >= 0
            np.add.at(chars, own[known], _class_counts(part, cuts)[known])
            h, first = _word_hashes(part, cuts)
            of = np.repeat(own, np.diff(first))
            hashes.append(h[of >= 0])
            owners.append(of[of >= 0])
        if not len(names):
            continue
        frame = pd.DataFrame({"l": np.concatenate(owners), "h": np.concatenate(hashes)})
        sizes = frame.groupby(["l", "h"], sort=False).size().reset_index(name="n")
        grid_l, grid_c = np.divmod(np.arange(chars.size), CLASSES)
        lang = np.concatenate([grid_l, sizes["l"].to_numpy()])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(names, object)[lang], pa.string()),
                pa.array(np.repeat([0, 1], [chars.size, len(sizes)]), pa.int32()),
                pa.array(np.concatenate([grid_c, arrays.signed(sizes["h"].to_numpy())]), pa.int64()),
                pa.array(np.concatenate([chars.ravel(), sizes["n"].to_numpy()]), pa.int64()),
            ],
            ["lang", "kind", "item", "n"],
        )


class References:
    """Per language: shares of character classes, and hashes and shares of common words."""

    def __init__(self, langs: list[str], chars: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs, self.chars, self.words = langs, chars, words


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> References:
    """References from every document; at most 1/COMMON_SHARE rows a language come back."""
    arrays.ship(docs.sparkSession)
    counted = docs.select(text_column, F.col(lang_column).cast("string").alias("lang")).mapInArrow(_count, COUNTS)
    sums = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    totals = sums.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LANGUAGE_WORDS)
    rows = (
        sums.join(totals, "lang")
        .where((F.col("kind") == 0) | (F.col("n") >= COMMON_SHARE * F.col("total")))
        .collect()
    )
    total = {r["lang"]: r["total"] for r in rows}
    langs = sorted(total)
    by_lang: dict[str, list] = {lang: [] for lang in langs}
    for r in rows:
        by_lang[r["lang"]].append(r)
    chars = np.zeros((len(langs), CLASSES))
    words: list[tuple[np.ndarray, np.ndarray]] = []
    for k, lang in enumerate(langs):
        own = by_lang[lang]
        for r in own:
            if r["kind"] == 0:
                chars[k, r["item"]] = r["n"]
        pairs = sorted((r["item"], r["n"] / total[lang]) for r in own if r["kind"] == 1)
        items = np.array([p[0] for p in pairs], np.int64)
        words.append((items, np.array([p[1] for p in pairs], float)))
    chars /= np.maximum(chars.sum(1, keepdims=True), 1)
    return References(langs, chars, words)


def _plogp(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0.0)


def char_distances(counts: np.ndarray, references: References) -> np.ndarray:
    """Smallest Jensen-Shannon distance of every text to a language, by character class."""
    p = (counts / np.maximum(counts.sum(1, keepdims=True), 1))[:, None, :]
    q = references.chars[None, :, :]
    m = (p + q) / 2
    square = (_plogp(p, m) + _plogp(q, m)).sum(2) / 2
    return np.sqrt(np.clip(square, 0, 1)).min(1)


def word_distances(hashes: np.ndarray, first: np.ndarray, references: References) -> np.ndarray:
    """The same by common words, all other words being one more item."""
    n = len(first) - 1
    sizes = np.diff(first)
    owner = np.repeat(np.arange(n), sizes)
    signed = arrays.signed(hashes)
    best = np.ones(n)
    for items, shares in references.words:
        k = len(items)
        q_all = np.append(shares, max(0.0, 1 - shares.sum()))
        at = np.minimum(np.searchsorted(items, signed), max(k - 1, 0))
        item = np.where(items[at] == signed, at, k) if k else np.zeros(len(signed), np.int64)
        cells, n_cell = np.unique(owner * (k + 1) + item, return_counts=True)
        doc, item = np.divmod(cells, k + 1)
        p, q = n_cell / sizes[doc], q_all[item]
        m = (p + q) / 2
        # Items that the text lacks add half their share each.
        term = (_plogp(p, m) + _plogp(q, m)) / 2 - q / 2
        square = np.bincount(doc, term, n) + 0.5
        best = np.minimum(best, np.sqrt(np.clip(square, 0, 1)))
    return best


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    filled = offsets[1:] > offsets[:-1]
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][filled], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    # A line ends before its line break.
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~arrays._BLANK[data], out=word[1:])
    has = word[ends] > word[starts]
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(doc, minlength=n)
    keys = arrays.mix(arrays.span_hashes(data, starts, ends) ^ arrays.mix(doc.astype(np.uint64), 5), 6)
    codes, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return lines - np.bincount(doc[first], minlength=n)


def _repeated_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if len(starts) < 3:
        return np.zeros(n, np.int64)
    h = arrays.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    window = arrays.mix(arrays.mix(h[:-2], 1) ^ arrays.mix(h[1:-1], 2) ^ arrays.mix(h[2:], 3) ^ arrays.mix(owner[2:].astype(np.uint64), 4))
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    codes, distinct = pd.factorize(window[at])
    again = at[np.bincount(codes, minlength=len(distinct))[codes] > 1]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(owner[covered], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray, references: References | None, spared: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of every text; those ``spared`` are decided by the base rule only."""
    out: dict[str, list] = {}
    for i, j, part, cuts in arrays.each(data, offsets):
        starts, ends, first = arrays.words(part, cuts)
        n_words = np.diff(first)
        inside = ~arrays._BLANK[part]
        heads = (part & 0xC0) != 0x80
        repeated = _repeated_words(part, cuts, starts, ends, first)
        base = (n_words < 50) | (100 * repeated > 50 * n_words)
        counts = _class_counts(part, cuts)
        far_c = far_w = np.zeros(len(n_words))
        if references is not None and references.langs:
            far_c = char_distances(counts, references)
            far_w = word_distances(*_word_hashes(part, cuts), references)
        good = (counts.sum(1) < MIN_CHARS) | (far_c <= MAX_CHAR_DISTANCE)
        good &= (n_words < MIN_WORDS) | (far_w <= MAX_WORD_DISTANCE)
        good |= spared[i:j]
        for name, value in (
            ("n_words", n_words),
            ("word_chars", _per_text(inside & heads, cuts)),
            ("n_symbols", _per_text(_SYMBOL[part], cuts)),
            ("n_dup_lines", _duplicate_lines(part, cuts)),
            ("n_repeat_words", repeated),
            ("base_failed", base),
            ("kept", ~base & good),
            ("char_distance", far_c),
            ("word_distance", far_w),
        ):
            out.setdefault(name, []).append(value)
    return {name: np.concatenate(values) for name, values in out.items()}


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Base figures, distances and the verdict for every row of ``docs``."""
    spark = docs.sparkSession
    references = learn(docs, text_column, lang_column)
    shared = spark.sparkContext.broadcast((references.langs, references.chars, references.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = {None, *shared.value[0]}
                spared = np.array([lang not in known for lang in batch.column(2).to_pylist()])
                columns = measure(*arrays.utf8(batch.column(1)), References(*shared.value), spared)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "char_distance": pa.float64(), "word_distance": pa.float64()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items())],
                    ["doc_id", *columns],
                )

    return docs.select(F.col(id_column).cast("long"), text_column, F.col(lang_column).cast("string")).mapInArrow(run, RESULT)
