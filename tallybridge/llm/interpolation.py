"""Language-model scoring by deleted interpolation.

A word's probability mixes three estimates: its share after the word before it, its share
of all words, and a uniform one over the vocabulary and one unknown word:

    p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

The weights depend on the bucket ``b`` of the context's count (powers of two) and are
learnt by expectation-maximisation on training text that was deleted from the counts: one
part of the training documents in ``DELETED`` is held out for that, and its counts are
added back for scoring. The first word's context is the end of a text.

How it runs: texts are dealt into chunks by id. Each chunk sends its distinct n-grams with
their training counts to the task that owns that range of hashes, which adds up the counts
of all chunks and sends every chunk the totals of what it asked for. What moves is n-grams
per chunk, so frequent ones cost no more than others and no key can be hot. The chunk then
turns its texts into counts per word, which are written once to the shared folder and read
by the weights' job and by the scores'.

Cases: a NULL text is empty and scores its end alone; a NULL id belongs to the training
part; rows that repeat an id are separate documents; only the two named columns are read;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays
from tallybridge.workspace import Workspace

FOLDS, TEST_FOLD = 5, 1
# One in so many training documents teaches the weights.
DELETED = 5
BUCKETS = 33
# EM sees held-out words grouped by quarter powers of two of both estimates.
_STEPS = 4
_LEVELS = 40 * _STEPS
EM_ROUNDS = 50

_END = np.uint64(0x0E0D0E0D0E0D0E0D)

MESSAGE = "chunk int, owner int, grams binary, kept binary, lent binary, known long"
EVENTS = (
    "doc_id long, held_out boolean, deleted boolean, n_tokens long, n_known long, log_sum double, "
    "word binary, pair binary, part_word binary, part_pair binary, known long, sentinel boolean"
)
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every token and of every pair with the token before, and each text's first token."""
    tokens, pairs, counts = [], [], []
    for _, _, part, cuts in arrays.each(arrays.lowered(data), offsets):
        starts, ends, first = arrays.words(part, cuts)
        h = arrays.span_hashes(part, starts, ends)
        n = len(first) - 1
        own = np.full(len(h) + n, _END, np.uint64)
        own[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
        before = np.empty_like(own)
        if len(own):
            before[0] = _END
            before[1:] = own[:-1]  # a text's last token is its end, the next one's context
        tokens.append(arrays.mix(own, 11))
        pairs.append(arrays.mix(arrays.mix(before, 12) ^ own * np.uint64(0x9FB21C651E98DF25), 13))
        counts.append(np.diff(first) + 1)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return join(tokens), join(pairs), np.concatenate([[0], np.cumsum(sizes)])


def pack(counts: np.ndarray) -> bytes:
    """Counts byte by byte place, lowest first: the high places are runs of zeros."""
    return np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(counts: np.ndarray) -> bytes:
    return _zstd()[0].compress(pack(counts))


def unsqueeze(squeezed: bytes) -> np.ndarray:
    return unpack(_zstd()[1].decompress(squeezed))


def pack_grams(grams: np.ndarray) -> bytes:
    """Sorted hashes in six bytes each: how many begin with each 16 bits, then the rest."""
    heads, sizes = np.unique((grams >> np.uint64(48)).astype("<u2"), return_counts=True)
    low = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([np.array([len(heads)], "<u4").tobytes(), heads.tobytes(), sizes.astype("<u4").tobytes(), low.tobytes()])


def unpack_grams(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    heads = np.frombuffer(packed, "<u2", n, 4)
    sizes = np.frombuffer(packed, "<u4", n, 4 + 2 * n)
    low = np.frombuffer(packed, np.uint8, -1, 4 + 6 * n).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel() | np.repeat(heads.astype(np.uint64) << np.uint64(48), sizes)


def _distinct(tokens: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, codes = np.unique(np.concatenate([tokens, pairs]), return_inverse=True)
    return grams, codes.astype(np.int32)


def _cuts(grams: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range of the sorted hashes begins."""
    bounds = [(k << 64) // owners for k in range(1, owners)]
    return np.concatenate([[0], np.searchsorted(grams, np.array(bounds, np.uint64)), [len(grams)]]).astype(np.int64)


def _folds(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are held out from training, and which training rows teach the weights."""
    fold = group["fold"].to_numpy()
    test = fold % FOLDS == TEST_FOLD
    return test, ~test & (fold // FOLDS % DELETED == 0)


def _request(owners: int, group: pa.Table) -> pa.Table:
    """A chunk's distinct n-grams with their counts in the kept and in the lent training part."""
    test, lent = _folds(group)
    tokens, pairs, first = _grams(*arrays.utf8(group["text"]))
    sizes = np.diff(first)
    weigh = [np.repeat(w, sizes) for w in (~test & ~lent, lent)]
    grams, codes = _distinct(tokens, pairs)
    n = len(tokens)
    del tokens, pairs
    kept, counts_lent = (np.bincount(codes, np.concatenate([w, w]), len(grams)).astype("<u4") for w in weigh)
    single = np.zeros(len(grams), bool)
    single[codes[:n]] = True
    cuts = _cuts(grams, owners)
    flagged = (grams & ~np.uint64(1)) | single
    chunk = group["chunk"][0].as_py()
    return _messages(
        [
            (chunk, o, pack_grams(flagged[a:b]), squeeze(kept[a:b]), squeeze(counts_lent[a:b]), 0)
            for o, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            if b > a
        ]
    )


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "owner", "grams", "kept", "lent", "known"])


def _answer(group: pa.Table) -> pa.Table:
    """Totals over all chunks, for each chunk in the order in which it asked."""
    asked = [unpack_grams(b) for b in group["grams"].to_pylist()]
    grams, codes = np.unique(np.concatenate(asked), return_inverse=True)
    totals = []
    for name in ("kept", "lent"):
        given = np.concatenate([unsqueeze(b) for b in group[name].to_pylist()])
        totals.append(np.bincount(codes, given, len(grams)).astype("<u4"))
    known = int(((grams & np.uint64(1)).astype(bool) & (totals[0] + totals[1] > 0)).sum())
    owner = group["owner"][0].as_py()
    cuts = np.cumsum([0, *map(len, asked)])
    rows = [(-1, owner, b"", b"", b"", known)]
    for chunk, a, b in zip(group["chunk"].to_pylist(), cuts[:-1], cuts[1:]):
        own = codes[a:b]
        rows.append((chunk, owner, b"", squeeze(totals[0][own]), squeeze(totals[1][own]), 0))
    return _messages(rows)


def _events(owners: int, group: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of every token and pair of every text, from the answers to this chunk."""
    n = group.num_rows
    if not n:
        return _event_table([], known=sum(answers["known"].to_pylist()))
    test, lent = _folds(group)
    tokens, pairs, first = _grams(*arrays.utf8(group["text"]))
    grams, codes = _distinct(tokens, pairs)
    size = len(tokens)
    del tokens, pairs
    cuts = _cuts(grams, owners)
    kept, out = np.zeros(len(grams), "<u4"), np.zeros(len(grams), "<u4")
    del grams
    for owner, a, b in zip(*(answers[c].to_pylist() for c in ("owner", "kept", "lent"))):
        kept[cuts[owner] : cuts[owner + 1]] = unsqueeze(a)
        out[cuts[owner] : cuts[owner + 1]] = unsqueeze(b)
    total = kept + out
    word, pair = total[codes[:size]], total[codes[size:]]
    part_word, part_pair = kept[codes[:size]], kept[codes[size:]]
    del codes
    sums = np.concatenate([[0.0], np.cumsum(np.log10(word + 0.5))])
    hits = np.concatenate([[0], np.cumsum(word > 0)])
    cut = lambda values, which: [
        squeeze(values[a:b]) if w else None for a, b, w in zip(first[:-1], first[1:], which)
    ]
    every = np.ones(n, bool)
    return _event_table(
        [
            group["doc_id"].to_pylist(), test.tolist(), lent.tolist(), np.diff(first).tolist(),
            (hits[first[1:]] - hits[first[:-1]]).tolist(), (sums[first[1:]] - sums[first[:-1]]).tolist(),
            cut(word, every), cut(pair, every), cut(part_word, lent), cut(part_pair, lent), [0] * n, [False] * n,
        ]
    )


def _event_table(columns: list, known: int | None = None) -> pa.Table:
    if known is not None:
        columns = [[None]] * 10 + [[known], [True]]
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4, pa.int64(), pa.bool_()]
    names = [field.split()[0] for field in EVENTS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _contexts(word: np.ndarray, ends: int) -> np.ndarray:
    """Count of the token before each one; before the first stands an end."""
    return np.concatenate([[ends], word[:-1]])


def _buckets(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def _level(p: np.ndarray) -> np.ndarray:
    """Quarter powers of two below one, from 1; 0 stands for an estimate of zero."""
    return np.where(p > 0, np.clip(np.floor(-np.log2(np.where(p > 0, p, 1)) * _STEPS), 0, _LEVELS - 2) + 1, 0).astype(np.int64)


def _summary(total: int, ends: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Held-out words by context bucket and size of both estimates, with the estimates' sums."""
    cells = BUCKETS * _LEVELS * _LEVELS
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            word, pair = unsqueeze(word).astype(float), unsqueeze(pair)
            context = _contexts(word, ends)
            p1 = word / max(total, 1)
            p2 = pair / np.maximum(context, 1)
            cell = (_buckets(context) * _LEVELS + _level(p2)) * _LEVELS + _level(p1)
            assert cell.max(initial=0) < cells
            found, code = np.unique(cell, return_inverse=True)
            sums = np.stack([np.bincount(code), np.bincount(code, p2), np.bincount(code, p1)], 1)
            for c, s in zip(found.tolist(), sums):
                seen[c] = seen[c] + s if c in seen else s
    if seen:
        table = np.stack(list(seen.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), *(pa.array(table[:, k]) for k in range(3))], ["cell", "n", "p2", "p1"]
        )


def learn_weights(cells: np.ndarray, counts: np.ndarray, p2: np.ndarray, p1: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) per context bucket, by EM on held-out counts."""
    bucket = cells // (_LEVELS * _LEVELS)
    estimates = np.stack([p2, p1, np.full(len(p1), uniform)], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * estimates
        share *= (counts / share.sum(1))[:, None]
        # A tenth of a word for each keeps unseen cases possible; buckets without any stay even.
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1) + 0.1
        weights = sums / sums.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # no context, no pairs
    return weights


def _scores(total: int, ends: int, vocabulary: int, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for word, pair in zip(batch["word"].to_pylist(), batch["pair"].to_pylist()):
            word, pair = unsqueeze(word).astype(float), unsqueeze(pair)
            context = _contexts(word, ends)
            w = weights[_buckets(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (vocabulary + 1)
            scores.append(float(np.log10(p).sum()))
        n = batch["n_tokens"].to_numpy()
        base = batch["log_sum"].to_numpy() - n * np.log10(total + 0.5 * (vocabulary + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["held_out"], batch["n_tokens"], batch["n_known"],
                pa.array(np.full(len(n), total), pa.int64()), pa.array(base), pa.array(scores, pa.float64()),
            ],
            [field.split()[0] for field in RESULT.split(", ")],
        )


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base and interpolated log10 probabilities of every whole text."""
    spark = docs.sparkSession
    arrays.ship(spark)
    workspace = Workspace(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chunks = arrays.spread(rows, 16 << 20)
    owners = chunks
    dealt = rows.select(
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int").alias("chunk"),
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)).alias("fold"),
        "text",
    )
    requests = dealt.groupBy("chunk").applyInArrow(lambda g: _request(owners, g), MESSAGE)
    answers = requests.groupBy("owner").applyInArrow(_answer, MESSAGE)
    events = workspace.store(
        dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda g, a: _events(owners, g, a), EVENTS),
        "events",
    )
    texts = events.where("NOT sentinel")
    sums = events.agg(
        F.coalesce(F.sum("known"), F.lit(0)).alias("vocabulary"),
        *(
            F.coalesce(F.sum(F.when(F.expr(f"NOT sentinel AND NOT held_out AND {which}"), F.col(c) if c else F.lit(1))), F.lit(0)).alias(name)
            for name, which, c in (
                ("tokens", "true", "n_tokens"), ("ends", "true", None),
                ("part_tokens", "NOT deleted", "n_tokens"), ("part_ends", "NOT deleted", None),
            )
        ),
    ).head()
    total, ends, vocabulary = sums["tokens"], sums["ends"], sums["vocabulary"]
    part_total, part_ends = sums["part_tokens"], sums["part_ends"]
    lent = texts.where("deleted").select("part_word", "part_pair")
    cells = (
        lent.mapInArrow(lambda b: _summary(part_total, part_ends, b), "cell long, n double, p2 double, p1 double")
        .groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1"))).orderBy("cell").toPandas()
    )  # at most a row per cell of a fixed grid
    n = np.maximum(cells["n"].to_numpy(), 1)
    weights = learn_weights(
        cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(), cells["p2"].to_numpy() / n, cells["p1"].to_numpy() / n, 1 / (vocabulary + 1)
    )
    return texts.select("doc_id", "held_out", "n_tokens", "n_known", "log_sum", "word", "pair").mapInArrow(
        lambda b: _scores(total, ends, vocabulary, weights, b), RESULT
    )
