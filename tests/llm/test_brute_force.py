"""Whole results of operators without SQL, against plain Python."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallybridge.llm import divergence, interpolation, mixing
from tallybridge.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(n, seed):
    """Texts of Zipf-like words with copies, blank and NULL texts, repeated and NULL ids."""
    rng = np.random.RandomState(seed)
    vocabulary = np.array([f"{a}{b}" for a in ("Ka", "lo", "mé", "tu", "中") for b in range(30)])
    share = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(n):
        own = np.roll(vocabulary, 7 * (i % 3))
        rows.append((i, " ".join(rng.choice(own, rng.randint(1, 160), p=share / share.sum()))))
    rows += [(n, None), (n, ""), (n + 1, " \t\n"), (None, rows[0][1]), (3, rows[3][1]), (3, "an other text of id three"), (n + 2, rows[5][1])]
    return rows


# -- deleted interpolation ------------------------------------------------------


def bigrams(tokens):
    return zip([None, *tokens[:-1]], tokens)


def counted(texts):
    singles, doubles = Counter(), Counter()
    for tokens in texts:
        singles.update(tokens)
        doubles.update(bigrams(tokens))
    return singles, doubles


def estimates(tokens, singles, doubles):
    """Bucket of the context's count, and both relative frequencies, of every token."""
    total = max(sum(singles.values()), 1)
    for before, token in bigrams(tokens):
        context = singles[before]
        yield context.bit_length(), doubles[before, token] / max(context, 1), singles[token] / total


def grid(p):
    """Quarter powers of two, the last for all that is smaller."""
    return 0 if p == 0 else 1 + min(math.floor(-math.log2(p) * 4), 158)


def brute_scores(rows):
    parts = []
    for key, text in rows:
        fold = 0 if key is None else zlib.crc32(str(key).encode())
        held_out = fold % 5 == 1
        parts.append((key, [*words(text), None], held_out, not held_out and fold // 5 % 5 == 0))
    kept = counted(tokens for _, tokens, held_out, lent in parts if not held_out and not lent)
    train = counted(tokens for _, tokens, held_out, _ in parts if not held_out)
    uniform = 1 / (len(train[0]) + 1)
    cells = defaultdict(lambda: [0, 0.0, 0.0])
    for _, tokens, _, lent in parts:
        for bucket, pair, single in estimates(tokens, *kept) if lent else ():
            cell = cells[bucket, grid(pair), grid(single)]
            cell[0] += 1
            cell[1] += pair
            cell[2] += single
    weights = defaultdict(lambda: [1 / 3] * 3)
    for _ in range(interpolation.EM_ROUNDS):
        shares = defaultdict(lambda: [0.1] * 3)
        for (bucket, *_), (n, pair, single) in cells.items():
            mixed = [w * p for w, p in zip(weights[bucket], (pair / n, single / n, uniform))]
            for k in range(3):
                shares[bucket][k] += n * mixed[k] / sum(mixed)
        for bucket, own in shares.items():
            weights[bucket] = [s / sum(own) for s in own]
    rest = sum(weights[0][1:])
    weights[0] = [0, weights[0][1] / rest, weights[0][2] / rest]
    out = []
    for key, tokens, held_out, _ in parts:
        score = 0.0
        for bucket, pair, single in estimates(tokens, *train):
            w = weights[bucket]
            score += math.log10(w[0] * pair + w[1] * single + w[2] * uniform)
        out.append((key is None, key or 0, held_out, len(tokens), score))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
def test_interpolated_scores(spark, partitions):
    rows = corpus(60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.score) for r in interpolation.score_documents(df).collect())
    expected = brute_scores(rows)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert [r[4] for r in found] == pytest.approx([r[4] for r in expected], rel=1e-6)


# -- distribution divergence ----------------------------------------------------

KINDS = (string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\n\v\f\r", ".,;:!?'\"()-")


def kind(c):
    for k, members in enumerate(KINDS):
        if c in members:
            return k
    if ord(c) > 127:
        return "beyond"
    return "control" if ord(c) < 32 or ord(c) == 127 else "mark"


def distance(p, q):
    """Jensen-Shannon, to base 2, of two tables of shares."""
    square = 0.0
    for item in {*p, *q}:
        a, b = p.get(item, 0), q.get(item, 0)
        square += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(square, 0))


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()} if total else {}


def brute_verdicts(rows):
    chars, tokens = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None:
            chars[lang].update(map(kind, text or ""))
            tokens[lang].update(words(text))
    references = {}
    for lang, own in tokens.items():
        total = sum(own.values())
        if total >= 1000:
            common = {w: n / total for w, n in own.items() if n >= 0.001 * total}
            common[None] = 1 - sum(common.values())
            references[lang] = shares(chars[lang]), common
    out = []
    for key, text, lang in rows:
        text, own = text or "", words(text)
        # Words as they stand, without lower-casing, for the base rule.
        cased = WORD.findall(text)
        windows = Counter(zip(cased, cased[1:], cased[2:]))
        covered = {i + k for i in range(len(cased) - 2) if windows[tuple(cased[i : i + 3])] > 1 for k in range(3)}
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        far_c = far_w = 0.0
        if references:
            far_c = min(distance(shares(Counter(map(kind, text))), q) for q, _ in references.values())
            far_w = min(1, *(distance(shares(Counter(w if w in q else None for w in own)), q) for _, q in references.values()))
        good = (len(text) < 200 or far_c <= 0.25) and (len(own) < 100 or far_w <= 0.5)
        good = good or not (lang is None or lang in references)
        out.append((key is None, key or 0, len(own), failed, not failed and good, far_c, far_w))
    return sorted(out)


def languages():
    rng = np.random.RandomState(8)
    rows = [(key, text, ["xx", "yy", None][i % 3]) for i, (key, text) in enumerate(corpus(60, 4))]
    marks = " ".join("#$%&"[rng.randint(4)] + str(rng.randint(10**9)) for _ in range(150))
    rows += [
        (900, marks, None), (901, marks, "zz"), (902, "ORDINARY SHOUTING " + " ".join(f"Q{i}Z!" for i in range(120)), "xx"),
        (903, "\x01\x7f é中😀 " * 80, "yy"), (904, "same three words " * 60, "xx"), (905, "short é", "zz"),
        (906, "Kα0 " + "word joined " * 70, None), (907, "1 2 3 " * 5, None),
    ]
    return rows


@pytest.mark.parametrize("rows", [languages(), [r for r in languages() if r[2] in (None, "zz")]], ids=["two", "no reference"])
def test_divergences_and_verdicts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_words, r.base_failed, r.kept, r.char_distance, r.word_distance)
        for r in divergence.quality(df).collect()
    )
    expected = brute_verdicts(rows)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for k in (5, 6):
        assert [r[k] for r in found] == pytest.approx([r[k] for r in expected], abs=1e-7)
    if any(r[2] == "xx" for r in rows):
        assert {r[4] for r in found if not r[3]} == {True, False}


# -- hierarchical budgets -------------------------------------------------------


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_prefixes_end_where_the_tokens_do(spark, tmp_path, most):
    """One leaf holds most rows and one id a third of them; places agree in up to six digits."""
    rng = np.random.RandomState(6)
    rows = []
    for leaf, (n, rest) in {"hot": (900, 2500), "none": (40, 0), "all": (50, 10**6), "edge": (60, 90)}.items():
        places = [f"{['00', '3f3f3f', '3f3f'][rng.randint(3)]}{rng.randint(1 << 30):08x}".ljust(32, "0") for _ in range(n)]
        if leaf == "hot":
            places[:300] = ["3f3f3f".ljust(32, "7")] * 300
        rows += [("d", "l", leaf, rest, place, int(rng.randint(1, 9))) for place in places]
    # A first place that is too much, one without tokens, and one that fits to the token.
    rows += [("d", "l", "much", 5, "a" * 32, 6), ("d", "l", "blank", 0, "b" * 32, 0), ("d", "l", "just", 6, "c" * 32, 6)]
    expected = {}
    for leaf, rest in {r[2]: r[3] for r in rows}.items():
        upto = 0
        own = [r for r in rows if r[2] == leaf]
        for place in sorted({r[4] for r in own}):
            upto += sum(r[5] for r in own if r[4] == place)
            if upto <= rest:
                expected[leaf] = place
    df = spark.createDataFrame(rows, "domain string, lang string, source string, rest long, place string, n_tokens long")
    found = mixing.prefixes(df, Workspace(spark, str(tmp_path)), most)
    assert {r.source: r.cut for r in found.collect()} == expected
    assert mixing.prefixes(df.where("false"), Workspace(spark, str(tmp_path)), most).count() == 0
