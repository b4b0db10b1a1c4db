"""Helpers on byte arrays, and the parts of operators that need no Spark."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import tokenizers

from tallybridge.llm import arrays, bpe, interpolation, minhash, quotes, repair

ALPHABET = list("  \n\t'stmdrevelxAZ09!?é 　中ǅ٣²𝒳😀\r'’\x85")


def texts(seed: int, n: int, longest: int = 40) -> list[str | None]:
    rng = random.Random(seed)
    some = ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]
    return [*some, None, "", "   ", "don't we'll 's ''s '", "x" * 5000]


def spans(values, find):
    data, offsets = arrays.utf8(pa.array(values, pa.string()))
    out = []
    for i, j, part, cuts in arrays.each(data, offsets):
        starts, ends, first = find(part, cuts)
        blob = part.tobytes()
        for k in range(j - i):
            out.append([blob[a:b] for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])])
    return out


def test_words_and_pretokens_equal_the_patterns():
    values = texts(1, 3000)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert spans(values, arrays.words) == [(t or "").encode().split() for t in values]
    assert spans(values, arrays.pretokens) == [[p.encode() for p in pattern.findall(t or "")] for t in values]


def test_slices_hold_whole_texts():
    offsets = np.array([0, 5, 5, 50, 52])
    assert list(arrays.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]


def test_equal_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"ab ab\0 ab", np.uint8)
    h = arrays.span_hashes(data, np.array([0, 3, 7, 3]), np.array([2, 5, 9, 6]))
    assert h[0] == h[1] == h[2] != h[3]


def test_empty_column():
    data, offsets = arrays.utf8(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]


@pytest.fixture(scope="module")
def codec():
    ranks, hashed = bpe._built(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Codec(ranks, hashed)


def test_perfect_hash_is_minimal_and_knows_strangers(codec):
    hashed = codec.hashed
    assert sorted(hashed.find(hashed.keys).tolist()) == sorted(codec.ranks.values())
    assert len(hashed.keys) == len(codec.ranks)
    strangers = arrays.mix(np.arange(1000, dtype=np.uint64), 77)
    assert (hashed.find(strangers) == -1).all()


def test_bpe_equals_the_library(codec):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    values = [*texts(2, 500, 120), "a" * 3000, "ab" * 700, "the quick brown fox’s idea"]
    ids, codes, first = codec.encode(*arrays.utf8(pa.array(values, pa.string())))
    for k, text in enumerate(values):
        own = [i for c in codes[first[k] : first[k + 1]] for i in ids[c]]
        assert own == library.encode_ordinary(text or "")


def test_grammar_round_trip_and_random_access():
    rng = np.random.RandomState(0)
    for _ in range(100):
        ids = rng.randint(0, rng.randint(1, 8), rng.randint(0, 3000)).astype(np.uint32)
        grammar = repair.compress(ids, 10)
        assert (grammar.expand(grammar.symbols) == ids).all()
        assert grammar.sizes(grammar.symbols).sum() == len(ids)
        a, b = sorted(rng.randint(0, len(ids) + 1, 2))
        assert (grammar.ids_between(a, b) == ids[a:b]).all()


def test_repeats_are_replaced():
    rng = np.random.RandomState(1)
    # A few copies of a passage become rules down to a single symbol each.
    passage = rng.randint(0, 50_000, 400)
    for copies in (4, 40):
        ids = np.concatenate([np.append(passage, rng.randint(0, 50_000, 50)) for _ in range(copies)])
        grammar = repair.compress(ids, 50_000)
        assert len(grammar.symbols) == copies * 51 and grammar.spans.max() == 400
        assert (grammar.expand(grammar.symbols) == ids).all()
    # No pair that occurs four times is left.
    ids = rng.randint(0, 40, 5000)
    grammar = repair.compress(ids, 40)
    left = list(zip(grammar.symbols[:-1].tolist(), grammar.symbols[1:].tolist()))
    assert max(left.count(pair) for pair in set(left) if pair[0] != pair[1]) < repair.LEAST_COUNT
    grammar = repair.compress(np.tile([1, 2, 3, 4], 500).astype(np.uint32), 10)
    assert len(grammar.rules) and len(grammar.symbols) < 600


def test_library_ids_piece_by_piece():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    values = [*texts(3, 300, 100), "a<|endoftext|>b", "<|endoftext|>"]
    ids, lengths = repair._encode(repair.read_tokenizer(path), *arrays.utf8(pa.array(values, pa.string())))
    expected = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in values]
    assert lengths.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_known_pretokens_are_not_encoded_again(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    file, library = repair.read_tokenizer(path), tokenizers.Tokenizer.from_file(path)
    given = []
    encode = repair._library
    monkeypatch.setattr(repair, "_memos", {})
    monkeypatch.setattr(repair, "_library", lambda t, texts: given.extend(texts) or encode(t, texts))

    def check(values):
        ids, lengths = repair._encode(file, *arrays.utf8(pa.array(values, pa.string())))
        expected = [library.encode(v or "", add_special_tokens=False).ids + [0] for v in values]
        assert ids.tolist() == [i for e in expected for i in e] and lengths.tolist() == [len(e) for e in expected]

    # More pre-tokens than were ever kept before, and white space of all kinds around and inside.
    many = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 2 + str(i) for i in range(k, k + 1000)) for k in range(0, 330_000, 1000)]
    odd = ["a\n\nb \n c", "\n", "  ", "\u00a0x\u3000\u2028y", None, "it's \r\n''s", "\x1c\x1d z", "a" * 300]
    check(many + odd)
    given.clear()
    check(odd + many[::-1])
    assert not given
    # Beyond its limit only the last batch's pre-tokens are kept, without the long ones.
    monkeypatch.setattr(repair, "MEMO_IDS", 10)
    check(odd)
    kept = repair._memos[file]
    assert 0 < len(kept.keys) < 30 and kept.widths.max() <= repair.MEMO_WIDTH and len(kept.ids) == kept.widths.sum()
    check([*texts(5, 50, 60), *odd])


def test_packed_counts_and_hashes_round_trip():
    rng = np.random.RandomState(1)
    counts = rng.randint(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    assert (interpolation.unsqueeze(interpolation.squeeze(counts)) == counts).all()
    grams = np.unique(rng.randint(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    assert (interpolation.unpack_grams(interpolation.pack_grams(grams)) == grams).all()
    assert len(interpolation.unpack(interpolation.pack(counts[:0]))) == 0


def test_weights_prefer_what_predicts():
    cells = np.array([3 * interpolation._LEVELS**2, 3 * interpolation._LEVELS**2 + 1])
    weights = interpolation.learn_weights(
        cells, np.array([100.0, 1.0]), np.array([0.5, 0.0]), np.array([0.01, 0.01]), 1e-4
    )
    assert weights[3].argmax() == 0 and np.allclose(weights.sum(1), 1) and weights[0, 0] == 0


def test_circulant_coordinates_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" if i % 40 else f"x{i}" for i in range(400))
    sets, cuts = minhash.shingle_sets(*arrays.utf8(pa.array([a, b, "", "one", None])))
    rows = minhash.signatures(sets, cuts)
    own = [set(sets[cuts[k] : cuts[k + 1]].tolist()) for k in (0, 1)]
    exact = len(own[0] & own[1]) / len(own[0] | own[1])
    assert abs((rows[0] == rows[1]).mean() - exact) < 0.12
    assert np.diff(cuts).tolist() == [399, 399, 0, 1, 0]
    assert (rows[2] == 0xFFFFFFFF).all()


def test_quote_levels():
    runs = quotes.levels("Ann wrote:\n> > deep line\n>> more\n> flat\nown")
    assert [level for level, _ in runs] == [0, 2, 1, 0]
    assert quotes.body_of(runs) == "own"
    assert quotes.fingerprint("Hello,  THERE my friend!") == quotes.fingerprint("hello there my friend")
    assert quotes.fingerprint("two words") == quotes.fingerprint("Two  WORDS!") != quotes.fingerprint("two word")

