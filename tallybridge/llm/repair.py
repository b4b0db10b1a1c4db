"""Token ids in grammar-compressed shards, with random access.

Documents are put in ascending id order by a range sort, encoded, and cut into shards.
Each shard is compressed by Re-Pair: the most frequent pairs of neighbouring symbols are
replaced by new symbols (nonterminals), again and again, until no pair repays its rule.

File format: a Parquet dataset with a row per shard.

=============  =========================================================================
part, shard    place of the shard: range partition, then number inside it
docs           little-endian int64 ids of the shard's documents (0 where NULL), in order
nulls          one byte per document: 1 where the id is NULL
lengths        uint32 ids per document, its end id included
rules          uint32 pairs: symbol ``vocabulary + r`` stands for the pair at place ``r``
spans          uint32 per rule: how many ids it expands to
symbols        uint32 start symbols of the shard
n_tokens       ids in the shard
=============  =========================================================================

The expansion lengths place any id: summed over the symbols they say which symbol holds
it, and only that symbol is expanded (``ids_between``).

Cases: a NULL text counts as empty and has its end id alone; NULL ids come first; rows
that repeat an id are ordered by text; a document longer than a shard makes a larger
shard; only the two named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallybridge.llm import arrays
from tallybridge.workspace import Workspace

END_ID = 0
SHARD_TOKENS = 2_000_000
# A rule takes three numbers; from here on its pair's places save more.
LEAST_COUNT = 4

SHARDS = (
    "part long, shard long, docs binary, nulls binary, lengths binary, rules binary, "
    "spans binary, symbols binary, n_tokens long"
)
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _pick(flat: np.ndarray, begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin there and are so wide, one after the other."""
    if not widths.all():
        begins, widths = begins[widths > 0], widths[widths > 0]
    at = np.cumsum(widths, dtype=np.int64)
    index = np.ones(int(at[-1]) if len(at) else 0, np.int64)
    index[:1] = begins[:1]
    index[at[:-1]] = begins[1:] - begins[:-1] - widths[:-1] + 1
    return flat[np.cumsum(index, out=index)]


class Grammar:
    """Rules, what each expands to in length, and the start symbols."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, vocabulary: int) -> None:
        self.symbols, self.rules, self.spans, self.vocabulary = symbols, rules, spans, vocabulary

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.spans):
            return np.ones(len(symbols), np.int64)
        rule = symbols.astype(np.int64) - self.vocabulary
        return np.where(rule < 0, 1, self.spans[np.maximum(rule, 0)].astype(np.int64))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: every distinct symbol is expanded once."""
        used = np.zeros(self.vocabulary + len(self.rules), bool)
        used[symbols] = True
        distinct = np.flatnonzero(used)
        sizes = self.sizes(distinct)
        number = (np.cumsum(used) - 1)[symbols]
        return _pick(self._expand(distinct), (np.cumsum(sizes) - sizes)[number], sizes[number])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion lengths say where each id goes."""
        sizes = self.sizes(symbols)
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        while len(symbols):
            plain = symbols < self.vocabulary
            out[at[plain]] = symbols[plain]
            symbols, at = symbols[~plain], at[~plain]
            pairs = self.rules[symbols - self.vocabulary].astype(np.int64)
            symbols, at = pairs.T.ravel(), np.concatenate([at, at + self.sizes(pairs[:, 0])])
        return out

    def ids_between(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the shard, expanding only the symbols that hold them."""
        stops = np.cumsum(self.sizes(self.symbols))
        first = int(np.searchsorted(stops, begin, "right"))
        last = int(np.searchsorted(stops, end, "left"))
        before = int(stops[first - 1]) if first else 0
        return self.expand(self.symbols[first : last + 1])[begin - before : end - before]


def compress(ids: np.ndarray, vocabulary: int) -> Grammar:
    """Re-Pair: in every round all pairs that repay a rule, the more frequent before those they overlap.

    A pair that loses its places to more frequent ones is counted again in the next round,
    until no pair occurs ``LEAST_COUNT`` times. Only places whose pair can still be frequent
    are looked at again: the count of a pair can't grow, and new pairs hold a new symbol.
    """
    symbols = ids.astype(np.int32)
    live = np.ones(len(symbols), bool)
    live[-1:] = False
    rules: list[np.ndarray] = []
    known = np.ones(vocabulary, np.int64)
    while True:
        at = np.flatnonzero(live)
        if len(at) < LEAST_COUNT:
            break
        codes = symbols.take(at).astype(np.int64)
        codes <<= 32
        codes |= symbols[1:].take(at)
        # In a run of one symbol every other pair overlaps the one before it.
        follows = np.flatnonzero(codes[1:] == codes[:-1]) + 1
        follows = follows[at[follows] == at[follows - 1] + 1]
        if len(follows):
            place = np.arange(len(follows))
            begins = np.ones(len(follows), bool)
            begins[1:] = follows[1:] != follows[:-1] + 1
            odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            alone = np.ones(len(at), bool)
            alone[follows[odd]] = False
            alone = np.flatnonzero(alone)
            at, codes = at.take(alone), codes.take(alone)
        number, distinct = pd.factorize(codes)
        counts = np.bincount(number)
        frequent = counts >= LEAST_COUNT
        stays = frequent.take(number)
        live[at.take(np.flatnonzero(~stays))] = False
        stays = np.flatnonzero(stays)
        at, number = at.take(stays), number.take(stays)
        if not len(at):
            break
        chosen = np.flatnonzero(frequent)
        chosen = chosen[np.lexsort((distinct[chosen], -counts[chosen]))]
        rank = np.empty(len(distinct), np.int64)
        rank[chosen] = np.arange(len(chosen))
        rank = rank[number]
        # A place is taken if its pair is more frequent than those that overlap it.
        wins = np.ones(len(at), bool)
        near = at[1:] == at[:-1] + 1
        wins[1:] &= ~near | (rank[1:] < rank[:-1])
        wins[:-1] &= ~near | (rank[:-1] < rank[1:])
        taken = np.bincount(rank[wins], minlength=len(chosen))
        repays = taken >= LEAST_COUNT  # the most frequent pair takes all its places
        wins = np.flatnonzero(wins & repays.take(rank))
        at, rank = at.take(wins), rank.take(wins)
        pairs = distinct[chosen[repays]]
        pairs = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)
        symbols[at] = len(known) - 1 + np.cumsum(repays)[rank]
        known = np.concatenate([known, known[pairs[:, 0]] + known[pairs[:, 1]]])
        rules.append(pairs)
        live[at] = True
        live[at[at > 0] - 1] = True
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        kept = np.flatnonzero(kept)
        symbols, live = symbols.take(kept), live.take(kept)
        live[-1:] = False
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return Grammar(symbols.astype(np.uint32), table.astype(np.uint32), known[vocabulary:].astype(np.uint32), vocabulary)


def read_tokenizer(path: str) -> bytes:
    """The tokenizer's file, as workers get it: they need not see the driver's folders."""
    with open(path, "rb") as handle:
        return handle.read()


@lru_cache(2)
def _tokenizer(file: bytes):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_buffer(file)


@lru_cache(2)
def _special(file: bytes) -> tuple[bytes, ...]:
    added = _tokenizer(file).get_added_tokens_decoder().values()
    return tuple(token.content.encode() for token in added)


class Memo:
    """Ids of the pre-tokens that a worker has met, by their 64-bit hashes in ascending order.

    Flat arrays take far less than as many lists of ids. Beyond ``MEMO_IDS`` ids it
    begins anew with the last batch's pre-tokens, without those of more than ``MEMO_WIDTH`` ids.
    """

    def __init__(self) -> None:
        self.keys, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.widths, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the ascending keys stands or belongs, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def add(self, at: np.ndarray, keys: np.ndarray, widths: np.ndarray, ids: np.ndarray) -> None:
        self.keys = np.insert(self.keys, at, keys)
        self.begins = np.insert(self.begins, at, len(self.ids) + np.cumsum(widths) - widths)
        self.widths = np.insert(self.widths, at, widths)
        self.ids = np.concatenate([self.ids, ids])

    def bound(self, at: np.ndarray) -> None:
        if len(self.ids) > MEMO_IDS:
            at = at[self.widths[at] <= MEMO_WIDTH]
            ids = _pick(self.ids, self.begins[at], self.widths[at])
            self.keys, self.widths, self.ids = self.keys[at], self.widths[at], ids
            self.begins = np.cumsum(self.widths, dtype=np.int64) - self.widths


MEMO_IDS = 8_000_000
MEMO_WIDTH = 16
_memos: dict[bytes, Memo] = {}


def _library_ids(file: bytes, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids the library gives each pre-token, and all those ids.

    Pre-tokens go to it in lines, 500 to a text: a line feed is a pre-token by itself between
    two that are not white space, and its id stands nowhere else then. White space, and lines
    that don't come back one by one, go to it alone.
    """
    tokenizer = _tokenizer(file)
    words = [piece.decode() for piece in pieces]
    lines = [k for k, word in enumerate(words) if not word.isspace()]
    alone = [k for k, word in enumerate(words) if word.isspace()]
    widths, order, ids = np.zeros(len(words), np.int64), [], [np.zeros(0, np.uint32)]
    feed = tokenizer.encode("\n", add_special_tokens=False).ids
    blocks = [lines[i : i + 500] for i in range(0, len(lines), 500)]
    for block, own in zip(blocks, _library(tokenizer, ["\n".join([words[k] for k in b]) for b in blocks])):
        own = np.array(own, np.uint32)
        cuts = np.flatnonzero(own == feed[0])
        if len(feed) == 1 and len(cuts) == len(block) - 1:
            widths[block] = np.diff(cuts, prepend=-1, append=len(own)) - 1
            order += block
            ids.append(own[own != feed[0]])
        else:
            alone += block
    for k, own in zip(alone, _library(tokenizer, [words[k] for k in alone])):
        widths[k] = len(own)
        order.append(k)
        ids.append(np.array(own, np.uint32))
    order = np.array(order, np.int64)
    begins = np.empty(len(words), np.int64)
    begins[order] = np.cumsum(widths[order]) - widths[order]
    return widths, _pick(np.concatenate(ids), begins, widths)


def _library(tokenizer, texts: list[str]) -> Iterator[list[int]]:
    for begin in range(0, len(texts), 40):
        for found in tokenizer.encode_batch_fast(texts[begin : begin + 40], add_special_tokens=False):
            yield found.ids


def _encode(file: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, an end id after each, and how many each text has.

    The library encodes every distinct pre-token once: its model never merges across
    pre-tokens. Texts that spell a special token go to it whole.
    """
    blob = data.tobytes()
    n = len(offsets) - 1
    hashes, places, sizes, counts = [], [], [], np.zeros(n, np.int64)
    for i, j, part, cuts in arrays.each(data, offsets):
        starts, ends, first = arrays.pretokens(part, cuts)
        hashes.append(arrays.span_hashes(part, starts, ends))
        places.append(starts + offsets[i])
        sizes.append(ends - starts)
        counts[i:j] = np.diff(first)
    total = int(counts.sum())
    if total:
        hashes, places, sizes = map(np.concatenate, (hashes, places, sizes))
        codes, distinct = pd.factorize(hashes)
        firsts = np.empty(len(distinct), np.int64)
        firsts[codes[::-1]] = np.arange(total - 1, -1, -1)
        memo = _memos.setdefault(file, Memo())
        order = np.argsort(distinct)
        keys = distinct[order]
        at, known = memo.find(keys)
        fresh = firsts[order[~known]]
        pieces = [blob[s : s + k] for s, k in zip(places[fresh].tolist(), sizes[fresh].tolist())]
        memo.add(at[~known], keys[~known], *_library_ids(file, pieces))
        at, _ = memo.find(keys)
        own = np.empty(len(at), np.int64)
        own[order] = at
        width = memo.widths[own].astype(np.int64)
        flat = _pick(memo.ids, memo.begins[own], width)
        memo.bound(at)
    else:
        codes, width, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # The end id stands after each text's pre-tokens as one more piece.
    ends = np.cumsum(counts) + np.arange(n)
    inner = np.ones(total + n, bool)
    inner[ends] = False
    piece = np.full(total + n, len(width), np.int64)
    piece[inner] = codes
    width = np.append(width, 1)
    long = width[piece]
    out = _pick(np.append(flat, END_ID).astype(np.uint32), (np.cumsum(width) - width)[piece], long)
    stops = np.cumsum(long)[ends]
    lengths = np.diff(stops, prepend=0)
    whole = [k for k in range(n) if any(s in blob[offsets[k] : offsets[k + 1]] for s in _special(file))] if any(s in blob for s in _special(file)) else []
    if whole:
        texts = np.split(out, np.cumsum(lengths)[:-1])
        for k in whole:
            own = _tokenizer(file).encode(blob[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids
            texts[k] = np.array([*own, END_ID], np.uint32)
        out, lengths = np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
    return out, lengths


def _shards(file: bytes, vocabulary: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, shard = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, lengths = _encode(file, *arrays.utf8(batch.column(1)))
        column = batch.column(0).cast(pa.int64())
        nulls = np.asarray(column.is_null()).astype(np.uint8)
        docs = column.fill_null(0).to_numpy()
        stops = np.concatenate([[0], np.cumsum(lengths)])
        i = 0
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(stops, stops[i] + SHARD_TOKENS, "right")) - 1)
            grammar = compress(ids[stops[i] : stops[j]], vocabulary)
            row = {
                "part": part,
                "shard": shard,
                "docs": docs[i:j].astype("<i8").tobytes(),
                "nulls": nulls[i:j].tobytes(),
                "lengths": lengths[i:j].astype("<u4").tobytes(),
                "rules": grammar.rules.astype("<u4").tobytes(),
                "spans": grammar.spans.astype("<u4").tobytes(),
                "symbols": grammar.symbols.astype("<u4").tobytes(),
                "n_tokens": int(stops[j] - stops[i]),
            }
            yield pa.RecordBatch.from_pylist([row])
            shard += 1
            i = j


def write_shards(docs: DataFrame, path: str, folder: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode with the library's tokenizer at ``path`` and write the shards to ``folder``."""
    arrays.ship(docs.sparkSession)
    file = read_tokenizer(path)
    vocabulary = _tokenizer(file).get_vocab_size()
    shared = docs.sparkSession.sparkContext.broadcast(file)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = rows.repartitionByRange(arrays.spread(rows), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _shards(shared.value, vocabulary, batches), SHARDS).write.option(
        "compression", "zstd"
    ).parquet(folder)


def grammar_of(row: dict, vocabulary: int) -> Grammar:
    rules, spans, symbols = (np.frombuffer(row[c], "<u4") for c in ("rules", "spans", "symbols"))
    return Grammar(symbols, rules.reshape(-1, 2), spans, vocabulary)


def _documents(vocabulary: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            grammar = grammar_of(row, vocabulary)
            blob = memoryview(grammar.expand(grammar.symbols).astype("<u4").tobytes())
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            stops = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            null = np.frombuffer(row["nulls"], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["docs"], "<i8"), pa.int64(), mask=null),
                    pa.array(stops[:-1] + row["start"], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the shards alone.

    Starts are summed over partitions first and over the shards of each then, so no task
    sees more than a partition's shards or one number per partition. They are three numbers
    for two million ids: sent to the shards, which then need no shuffle.
    """
    arrays.ship(shards.sparkSession)
    vocabulary = _tokenizer(read_tokenizer(path)).get_vocab_size()
    sizes = shards.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sizes.join(
        totals.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base"),
        "part",
    ).selectExpr(
        "part", "shard",
        "base + coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )
    return shards.join(F.broadcast(starts), ["part", "shard"]).mapInArrow(lambda b: _documents(vocabulary, b), RESULT)


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Write the shards to the shared folder and return what the files say."""
    spark = docs.sparkSession
    folder = f"{Workspace(spark).root}/shards"
    write_shards(docs, path, folder)
    return read_documents(spark.read.schema(SHARDS).parquet(folder), path)
