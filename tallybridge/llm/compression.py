"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A window of a text
is compressed with each; where the toxic dictionary saves bytes, the window is evidence.
A document's largest saving and its number of windows above the calibrated saving go into
a logistic model whose output is the score.

Training uses a bounded sample of labelled rows (``SAMPLE`` of each label, the first by a
hash of the id), one half for the dictionaries and one for the calibration, so that words
which are rare in either cannot flatter the calibration. Both dictionaries hold the same
common text; each adds the words that its label has far more often than the other, by the
z-score of the log odds. Everything else covers every window of every text.

Cases: a NULL or empty text has one empty window, no evidence and the score of an ordinary
text; with no labelled rows of one label the score is 0 for all; rows that repeat an id
give a row each; unlabelled rows and extra columns change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays
from tallybridge.llm.columns import opened, sealed
from tallybridge.llm.minhash import shingle_sets

# Labelled rows of each label that training may use.
SAMPLE = 2000
WINDOW_WORDS = 8
THRESHOLD = 0.7
FOLDS, TEST_FOLD = 3, 1
COMMON_WORDS, OWN_WORDS = 2000, 400
LEAST_Z, LEAST_COUNT = (6.0, 4.0, 2.5), 2
# And its odds must be so many times (as a logarithm) those in the other label.
LEAST_ODDS = 3.0
# A false alarm weighs as much as so many misses when the saving is chosen.
_ALARM = 4
_SKETCH = 16
_LEVEL, _MIN_MATCH = 5, 6
# Begins every window and stands in both dictionaries: it pays a block's fixed costs, so
# that a single match further on already shows in the length.
_PRIMER = b"\1window of one text, as long as it takes\2"

RESULT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the saving that counts, and the logistic weights."""

    toxic: bytes
    ordinary: bytes
    saving: int
    weights: tuple[float, ...]

    @property
    def usable(self) -> bool:
        return bool(self.weights)


# ASCII marks separate words, so that those around a word don't hide it.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def windows(text: bytes) -> list[bytes]:
    own = text.translate(_PLAIN).split()
    return [_PRIMER + b" " + b" ".join(own[i : i + WINDOW_WORDS]) + b" " for i in range(0, max(len(own), 1), WINDOW_WORDS)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL, min_match=_MIN_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters)


def _lengths(compressor: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    if not parts:
        return np.zeros(0, np.int64)
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(parts, threads=1)), np.int64, len(parts))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)

    def savings(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves in each window, and each text's first window."""
        parts: list[bytes] = []
        first = [0]
        for text in texts:
            parts += windows(text)
            first.append(len(parts))
        return _lengths(self.ordinary, parts) - _lengths(self.toxic, parts), np.array(first)

    def features(self, texts: list[bytes]) -> np.ndarray:
        saved, first = self.savings(texts)
        if not texts:
            return np.zeros((0, 4))
        most = np.maximum.reduceat(saved, first[:-1])
        hits = np.add.reduceat((saved >= self.model.saving).astype(float), first[:-1])
        return _features(most, hits, np.diff(first))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.model.usable:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.model.weights), -30, 30)))


def _features(most: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.maximum(most, 0) / 4.0, np.log1p(hits), np.log1p(100.0 * hits / n)], 1)


def _document_words(text: bytes) -> set[bytes]:
    return set(text.translate(_PLAIN).split())


def distinct_texts(texts: list[bytes]) -> list[bytes]:
    """One text of each group of near copies, whose words would else count many times.

    A text goes if it shares two of ``_SKETCH`` minima over its shingles with one before.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sets, cuts = shingle_sets(data, np.cumsum([0, *map(len, texts)]))
    minima = [arrays.mix(sets, 60 + k) for k in range(_SKETCH)]
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, (text, a, b) in enumerate(zip(texts, cuts[:-1], cuts[1:])):
        own = [(k, int(h[a:b].min())) for k, h in enumerate(minima)] if b > a else []
        shared = Counter(j for key in own for j in seen.get(key, ()))
        if max(shared.values(), default=0) < 2:
            out.append(text)
        for key in own:
            seen.setdefault(key, []).append(i)
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes], least_z: float) -> tuple[bytes, bytes]:
    """Raw dictionary content of both labels; what matters most stands last, nearest to the text."""
    sides = [distinct_texts(texts) for texts in (toxic, ordinary)]
    seen = [Counter(w for t in texts for w in _document_words(t)) for texts in sides]
    sizes = [max(len(texts), 1) for texts in sides]
    both = seen[0] + seen[1]
    common = [w for w, _ in sorted(both.items(), key=lambda x: (-x[1], x[0])) if min(seen[0][w], seen[1][w])][:COMMON_WORDS]
    out = []
    for k in (0, 1):
        ranked = []
        for w, a in seen[k].items():
            b = seen[1 - k][w]
            odds = np.log((a + 0.5) / (sizes[k] - a + 0.5)) - np.log((b + 0.5) / (sizes[1 - k] - b + 0.5))
            z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if a >= LEAST_COUNT and odds >= LEAST_ODDS and z >= least_z:
                ranked.append((z, w))
        out.append(b" ".join([w for _, w in sorted(ranked)[-OWN_WORDS:]]))
    # The common text has the same distance from the window in both, and so the same cost.
    size = max(map(len, out))
    base = b" " + b" ".join(common[::-1]) + b" "
    toxic_content, ordinary_content = (base + own.rjust(size, b"\0") + b" " + _PRIMER for own in out)
    return toxic_content, ordinary_content


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.05 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[tuple[int, bytes]], ordinary: list[tuple[int, bytes]]) -> Model:
    """Train on texts with their ids; even places make the dictionaries, odd ones calibrate.

    Calibration chooses how distinctive a word must be to enter a dictionary and which
    saving counts, by hits less false alarms, and then fits the logistic weights.
    """
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", 1, ())
    toxic, ordinary = ([t for _, t in sorted(rows)] for rows in (toxic, ordinary))
    texts = toxic[1::2] + ordinary[1::2]
    y = np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])])
    best: tuple = (-np.inf,)
    for least_z in LEAST_Z:
        content = dictionaries(toxic[::2], ordinary[::2], least_z)
        saved, first = Scorer(Model(*content, saving=1, weights=())).savings(texts)
        most = np.maximum.reduceat(saved, first[:-1])
        for saving in range(1, 13):
            gain = (most[y == 1] >= saving).mean() - _ALARM * (most[y == 0] >= saving).mean()
            if gain > best[0]:
                best = (gain, content, saving, most, saved, first)
    _, content, saving, most, saved, first = best
    hits = np.add.reduceat((saved >= saving).astype(float), first[:-1])
    weights = _logistic(_features(most, hits, np.diff(first)), y)
    return Model(*content, saving=saving, weights=tuple(weights.tolist()))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most ``SAMPLE`` rows of each label outside the test fold."""
    known = labels.select(F.col(id_column).alias("_id"), F.col("toxic").alias("_toxic")).where(
        f"_id IS NOT NULL AND _toxic IN (0, 1) AND crc32(CAST(_id AS STRING)) % {FOLDS} <> {TEST_FOLD}"
    )
    chosen = None
    for label in (0, 1):
        some = known.where(f"_toxic = {label}").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.union(some)
    # The sample is at most 2 * SAMPLE ids.
    rows = (
        docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .collect()
    )
    sides: tuple[list, list] = ([], [])
    for r in rows:
        sides[r["_toxic"]].append((r["_id"], (r["_text"] or "").encode()))
    return fit(sides[1], sides[0])


def _scores(scorer: Scorer, column: pa.Array) -> np.ndarray:
    data, offsets = arrays.utf8(column)
    score = [np.zeros(0)]
    for _, _, part, cuts in arrays.each(data, offsets):
        blob = part.tobytes()
        score.append(scorer.scores([blob[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
    return np.concatenate(score)


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic, with all their columns."""
    spark = docs.sparkSession
    arrays.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, batch.column(at)) < THRESHOLD))

    rows, names = sealed(docs)
    return opened(rows.mapInArrow(run, rows.schema), names)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    spark = docs.sparkSession
    arrays.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            score = _scores(scorer, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1),
                    pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == TEST_FOLD, F.lit(False))
    return docs.select(F.col(id_column).cast("long"), held_out.alias("held_out"), text_column).mapInArrow(run, RESULT)
