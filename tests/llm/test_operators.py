"""Every operator on Spark, against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences
from tallybridge.llm import (
    bpe,
    components,
    compression,
    divergence,
    interpolation,
    langid,
    minhash,
    mixing,
    neighbours,
    queries,
    quotes,
    repair,
)
from tallybridge.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, `count` int, chunk string"


def documents():
    """NULLs, empty and long texts, copies, near copies, repeated rows and ids."""
    rng = np.random.RandomState(5)
    vocabulary = [f"word{i}" for i in range(300)]
    base = " ".join(rng.choice(vocabulary, 400))
    near = base.replace("word7 ", "other ", 1)
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, near, "de", "s2"),
        (4, " ".join(rng.choice(vocabulary, 60)), None, None), (5, None, "en", "s1"), (6, "", "en", ""),
        (7, " \t\n ", "de", "s2"), (8, "One", "en", "s1"), (9, "one", "en", "s3"),
        (None, "nobody's text here", "en", "s1"), (10, "a b c " * 30_000, "fr", "s9"),
        (10, "a b c " * 30_000, "fr", "s9"), (11, "é中😀 #$% | <tag>\nline\nline\n\nline", "es", "s4"),
    ]
    return [(*r, len(r[1] or ""), 1, "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, width):
    sets = {}
    for key, text, *_ in documents():
        if key is not None:
            own = words(text)
            sets.setdefault(key, frozenset(zip(*(own[k:] for k in range(width)))) if len(own) >= width else frozenset(tuple(own) and [tuple(own)]))
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = minhash.near_duplicates(docs, width).collect()
    assert len(found) == len(documents())
    for r in found:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(none, width).count() == 0


def test_components_of_chains_hubs_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 203), 200)}


def test_bpe_and_shards(docs, none):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for key, text, *_ in documents():
        ids = library.encode_ordinary(text or "")
        expected[key, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())] += 1
    assert Counter(map(tuple, bpe.encode_documents(docs, path).collect())) == expected
    assert bpe.encode_documents(none, path).count() == 0

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    start, rows = 0, []
    for key, text, *_ in sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        rows.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, repair.token_files(docs, path).collect()), key=lambda r: r[1]) == rows
    assert repair.token_files(none, path).count() == 0


def test_shards_are_read_without_a_shuffle(docs):
    # However large the files are, only their starts are sent to them.
    spark, path = docs.sparkSession, public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = repair.token_files(docs, path)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "rightHint=(strategy=broadcast)" in join


def test_language_model_scores(docs, none):
    rows = [(k, words(t) + [None], k is not None and zlib.crc32(str(k).encode()) % 5 == 1) for k, t, *_ in documents()]
    counts = Counter(w for _, own, test in rows if not test for w in own)
    total, size = sum(counts.values()), len(counts)
    found = interpolation.score_documents(docs).collect()
    expected = Counter(
        (k, test, len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in own), 3))
        for k, own, test in rows
    )
    assert Counter((*tuple(r)[:5], round(r.base_score, 3)) for r in found) == expected
    assert all(r.score <= 0 for r in found)
    assert interpolation.score_documents(none).count() == 0


def test_mixture_probabilities_add_up(spark, docs):
    """Over all known words and the unknown one, after any context."""
    weights = interpolation.learn_weights(np.zeros(0, np.int64), *(np.zeros(0),) * 3, 0.1)
    counts = {"a": 3, "b": 1}
    pairs = {("a", "a"): 2, ("a", "b"): 1}
    w = weights[2]  # the bucket of a count of 3
    p = [w[0] * pairs.get(("a", x), 0) / 3 + w[1] * counts.get(x, 0) / 4 + w[2] / 3 for x in ("a", "b", "?")]
    assert abs(sum(p) - 1) < 1e-12


def test_quality_base_figures(docs, none):
    expected = Counter()
    for key, text, *_ in documents():
        text = text or ""
        own = WORD.findall(text)
        windows = Counter(zip(own, own[1:], own[2:]))
        covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        expected[key, len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    found = divergence.quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == expected
    assert not any(r.kept for r in found if r.base_failed)
    assert divergence.quality(none).count() == 0


def test_quality_rejects_strange_text(spark):
    rng = np.random.RandomState(1)
    plain = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "walks", "gently"], 120)) for _ in range(40)]
    odd = " ".join("#$%&***" for _ in range(130))
    rows = [(i, t, "en") for i, t in enumerate(plain)] + [(99, odd + " x y z", None)]
    found = {r.doc_id: r for r in divergence.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[99].char_distance > divergence.MAX_CHAR_DISTANCE and not found[99].kept
    assert all(found[i].char_distance < divergence.MAX_CHAR_DISTANCE for i in range(40))


def test_quality_spares_small_languages(spark):
    rng = np.random.RandomState(7)
    vocabulary = {k: [f"{k}{i}" for i in range(60)] for k in ("en", "xx", "yy")}
    texts = [("en", 200_000)] * 6 + [("en", 120)] * 5 + [("xx", 120)] * 9 + [("yy", 120)]
    rows = [(i, " ".join(rng.choice(vocabulary[k], n)), k) for i, (k, n) in enumerate(texts)]
    rows.append((99, rows[-1][1], None))
    found = {r.doc_id: r for r in divergence.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].kept for i in range(6, 21)) and not found[99].kept
    assert max(found[i].word_distance for i in range(11, 20)) < divergence.MAX_WORD_DISTANCE < found[20].word_distance


def test_toxicity_learns_and_spares(spark):
    rng = np.random.RandomState(2)
    vocabulary = [f"{a}{b}" for a in ("lan", "mor", "tel", "vis", "gro") for b in ("an", "ide", "ous", "ent", "ily", "og")]
    vocabulary = [a + b for a in vocabulary for b in vocabulary]
    rows, labels = [], []
    for i in range(600):
        own = list(rng.choice(vocabulary, 80))
        toxic = int(i % 4 == 0)
        if toxic:
            own[rng.randint(80)] = rng.choice(["blitherhead", "nastywart"])
        rows.append((i, " ".join(own), 0))
        labels.append((i, 1, toxic))
    rows += [(1000, None, 0), (1001, "", 0), (None, "blitherhead " * 20, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in compression.score_documents(docs, compression.train(docs, known)).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i in test)
    right = [found[i].predicted == labels[i][2] for i in test]
    assert np.mean(right) > 0.95
    assert found[1000].predicted == found[1001].predicted == 0 and found[None].held_out is False
    empty = compression.train(docs, known.where("false"))
    assert {r.score for r in compression.score_documents(docs, empty).collect()} == {0.0}


def test_languages(spark, docs, none):
    pages = [(1, "http://a.example.de/x", '<html lang="de-AT"><p>der und die das nicht ist ein</p></html>'),
             (2, "http://a.example.de/y", "<html><script>var x='the of and';</script>und der die nicht das</html>"),
             (3, "https://b.example.com", '<html lang=en><body>the of and that with &amp; from</body></html>'),
             (4, None, None), (5, "nonsense", "<p>12 34</p>"), (5, "nonsense", "<p>12 34</p>")]
    model = langid.fit([b"der und die das nicht ist ein eine und der " * 4, b"the of and that with from this the of " * 4] * 5, ["de", "en"] * 5)
    found = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert [found[i].lang_id for i in range(1, 6)] == ["de", "de", "en", "und", "und"]
    assert found[3].accepted and not found[4].accepted and found[4].posterior == 0
    out = langid.identify_documents(docs, model)
    assert out.count() == len(documents()) and out.columns[: len(docs.columns)] == docs.columns
    clashing = docs.selectExpr("*", "1 AS accepted", "2 AS lang_id")
    kept = langid.accepted_documents(clashing, model)
    assert kept.columns == clashing.columns
    assert kept.count() == out.where("accepted").count() > 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out.where("accepted").collect())
    assert langid.identify_documents(none, langid.train(none)).count() == 0
    assert langid.identify_documents(none, model).count() == 0


def test_rare_languages_are_learnt(spark):
    rng = np.random.RandomState(8)
    vocabulary = {
        "en": ["the", "river", "which", "stones", "walking", "through", "house"],
        "fi": ["yksi", "kaksi", "ja", "olemme", "talossa", "joki", "kivet"],
        "hu": ["egy", "vagyunk", "nagyon", "szép", "folyó", "kövek", "házban"],
    }
    langs = ["en"] * 3000 + ["fi"] * 4 + ["hu"]
    rows = [(i, " ".join(rng.choice(vocabulary[k], 60)), k, "host") for i, k in enumerate(langs)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(labelled)
    assert model.langs == ["en", "fi", "hu"]
    found = {r.doc_id: r for r in langid.identify_documents(labelled, model).collect()}
    assert all(r.lang_id == r.lang and r.accepted for r in found.values()) and len(found) == 3005


def test_mixing_equals_its_sql(spark, sf_dir, duckdb_tables):
    result = queries.op6_hierarchical_budgets(spark, sf_dir)
    assert differences(result, duckdb_tables, mixing.ORACLE) == ""


def test_mixing_awkward_rows(docs, none):
    found = mixing.copies(docs).collect()
    assert len(found) == len(documents())
    total = sum(r.n_tokens for r in found)
    assert sum(r.n_tokens * r.copies for r in found) <= total * mixing.BUDGET_PERCENT // 100
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [("p", "a", 10, 1, 100), ("p", "b", 1000, 1, 100), ("q", "c", 50, 1, 40)]
    children = spark.createDataFrame(rows, "parent string, name string, cap long, weight int, budget long")
    got = {r["name"]: int(r["budget"]) for r in mixing.share(children, ["parent"], "name").collect()}
    assert got == {"a": 10, "b": 90, "c": 40}


def test_vectors_against_brute_force(spark):
    rng = np.random.RandomState(3)
    x = rng.standard_normal((300, 16))
    x[50:130] = x[50] + 0.02 * rng.standard_normal((80, 16))
    x[200] = x[201] * 3
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [None, 1.0], 0), (903, [float("nan")] * 16, 0), (904, [], 0), (905, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    found = {r.vec_id: r for r in neighbours.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert [found[i].n_links for i in range(300)] == near.sum(1).tolist()
    assert found[130 - 1].component_id == 50 and found[201].component_id == 200
    assert all(found[i].n_links == 0 and found[i].kept for i in range(900, 906))
    assert found[None].component_id is None and found[None].kept
    # 80 vectors that all link: lists of eight are saturated, lists of 64 hold most links.
    held = found[0]
    assert held.block_links <= held.joined_links < 80 * 8
    assert 3 * held.joined_links < held.widened_links <= near.sum() // 2
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_duplicate_vectors(empty).count() == 0


def test_short_and_unspaced_quotes_link(spark):
    rows = [
        (1, 0, "u", "Really?"), (1, 1, "a", "a turn between"), (1, 2, "u", "> Really?\nyes, really"), (1, 3, "a", "> no such\n>> !?\nwhat"),
        (1, 4, "u", "???"), (1, 5, "a", "one more turn"), (1, 6, "u", "> ???\nindeed"),
        (2, 0, "u", "我昨天在图书馆读完了那本很长的小说。"), (2, 1, "u", "> Really?\nshort quotes stay inside"),
        (3, 0, "u", "> 我昨天在图书馆读完了那本很长的小说。\n是吗"),
        (4, 0, "u", "> the same words here\nthe quote comes first"), (4, 1, "u", "the same words here"), (5, 0, "u", "the same words here"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert (found[1, 2].answers, found[1, 2].by_quote, found[1, 2].n_quotes, found[1, 2].n_linked) == (0, True, 1, 1)
    assert (found[1, 3].n_quotes, found[1, 3].n_linked) == (2, 0) and found[1, 6].answers == 4
    assert (found[2, 1].n_quotes, found[2, 1].n_linked) == (1, 0)
    assert (found[3, 0].outside_conv, found[3, 0].outside_turn) == (2, 0)
    assert (found[4, 0].outside_conv, found[4, 0].outside_turn) == (5, 0)


def _linked_vectors(spark, x):
    """Links, components and audited recall, against brute force."""
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in neighbours.near_duplicate_vectors(rows).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert [found[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert found[0].audit_recall == 1
    return [found[i].component_id for i in range(len(x))]


def test_copy_groups_are_bridged(spark):
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[0], b[1] = 1, 0.96, np.sqrt(1 - 0.96**2)
    assert set(_linked_vectors(spark, np.stack([a] * 1000 + [b] * 1000))) == {0}


def test_dense_clusters_are_bridged(spark):
    rng = np.random.RandomState(4)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[0], b[1] = 1, 0.945, np.sqrt(1 - 0.945**2)
    x = np.stack([a] * 1200 + [b] * 1200) + 0.004 * rng.standard_normal((2400, 16))
    assert set(_linked_vectors(spark, x)) == {0}


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((240, 32))
    x[:200] = x[0] + 0.001 * rng.standard_normal((200, 32))
    x[220:] = x[200:220]
    x[220:, 0] += 0.001
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, i, 32, r.tobytes()) for i, r in enumerate(unit)], "node long, vec_id long, dim int, unit binary")
    large = spark.createDataFrame([(i, 0) for i in range(200)], "vec_id long, component long")
    assert neighbours._recall(nodes, large, 240) == 0
    assert neighbours._recall(nodes.where("node BETWEEN 200 AND 219"), large.where("false"), 20) is None


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "u", "Hello there my dear friend.\nSecond line of the message."),
        (1, 1, "a", "Ann wrote:\n> Hello there my dear friend.\n> Second line of the message.\nI answer you well now."),
        (1, 2, "u", "> > Hello there my dear friend.\n> I answer you well now.\nok fine thanks"),
        (1, 3, "a", "> Second line of the message.\nlate answer to first"),
        (2, 0, "u", None), (2, 5, "u", "> I answer you well now.\nforeign quote here"), (None, 1, "x", "> a b c d"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert [found[1, t].answers for t in range(4)] == [None, 0, 1, 0]
    assert [found[1, t].depth for t in range(4)] == [0, 1, 2, 1]
    assert found[1, 1].body == "I answer you well now." and found[2, 0].body == ""
    assert (found[2, 5].outside_conv, found[2, 5].outside_turn) == (1, 1)
    assert found[None, 1].depth == 0
    assert quotes.link_quotes(df.where("false")).count() == 0


def _reply_order(rows):
    """Parents, depths and positions of messages without quotes inside, by recursion."""
    walk = {}
    for conv in {r[0] for r in rows}:
        parent = {t: p for c, t, p in rows if c == conv}
        below = {t: sorted(x for x in parent if parent[x] == t) for t in parent}
        stack = [(min(parent), 0)]
        place = 0
        while stack:
            turn, depth = stack.pop()
            walk[conv, turn] = (parent[turn], depth, place)
            place += 1
            stack += [(x, depth + 1) for x in reversed(below[turn])]
    return walk


def test_conversations_stand_in_reply_order(spark):
    rng = np.random.RandomState(12)
    messages, expected = [], []
    for conv, n in enumerate([1, 2, 40, 40, 300]):
        turns = np.sort(rng.choice(10 * n, n, replace=False)).tolist()
        for k, turn in enumerate(turns):
            answers = turns[k - 1] if k else None
            text = f"message number {conv} {turn}"
            if k and rng.rand() < 0.6:
                # The last conversation has one message that most others answer.
                answers = turns[0] if conv == 4 and rng.rand() < 0.8 else turns[rng.randint(k)]
                text = f"> message number {conv} {answers}\n{text}"
            messages.append((conv, turn, "u", text))
            expected.append((conv, turn, answers))
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    linked = quotes.link_quotes(df.withColumns({"range": F.lit("x"), "parent": F.lit(1)}))
    found = {(r.conv_id, r.turn): (r.answers, r.depth, r.position) for r in linked.collect()}
    walk = _reply_order(expected)
    assert found == walk
    parts = quotes.assembled(linked, 7).orderBy("conv_id", "part").collect()
    order = [(r.conv_id, m.turn) for r in parts for m in r.messages]
    assert order == sorted(walk, key=lambda node: (node[0], walk[node][2]))
    assert all(len(r.messages) <= 7 for r in parts)
    assert not any(m.body.startswith(">") for r in parts for m in r.messages)


def test_turns_with_gaps_and_repeated_rows_are_one_thread(spark):
    rows = [(1, 0, "u", "a"), (1, 2, "u", "b"), (1, 5, "u", "c"), (1, 5, "u", "c"), (1, 5, "u", "d"), (None, 3, "u", "x"), (2, None, "u", None)]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = Counter((r.conv_id, r.turn, r.answers, r.depth, r.position) for r in linked.collect())
    assert found == Counter({(1, 0, None, 0, 0): 1, (1, 2, 0, 1, 1): 1, (1, 5, 2, 2, 2): 3, (None, 3, None, 0, 0): 1, (2, None, None, 0, 0): 1})
    whole = quotes.assembled(linked).collect()
    assert [(r.conv_id, r.part) for r in whole] == [(1, 0)]
    assert [(m.body, m.copies) for m in whole[0].messages] == [("a", 1), ("b", 1), ("c", 2), ("d", 1)]
    assert quotes.assembled(linked.where("false")).count() == 0



def test_near_duplicate_stage_goes_by_rows(spark):
    rng = np.random.RandomState(9)
    a, b, c = (" ".join(rng.choice([f"word{i}" for i in range(300)], 200)) for _ in range(3))
    rows = [(None, a, "en"), (3, a, "en"), (3, a, "en"), (3, b, "en"), (2, a + " end", "en"), (None, c, "en"), (None, c, "en"),
            (None, None, "en"), (3, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    expected = Counter([(2, a + " end", "en"), (3, b, "en"), (None, c, "en"), (None, None, "en"), (3, "", "en")])
    assert Counter(map(tuple, found.collect())) == expected and found.columns == docs.columns


def test_toxicity_stage_goes_by_rows(spark, tmp_path):
    rng = np.random.RandomState(2)
    vocabulary = [a + b for a in ("lanan", "moride", "telous", "visent", "groily") for b in ("an", "ide", "ous", "ent", "ily", "og")]
    rows = [(i, " ".join(rng.choice(vocabulary, 60)) + (" blitherhead nastywart" if i % 4 == 0 else "")) for i in range(600)]
    odd = [(None, "blitherhead nastywart " * 20), (1, "blitherhead nastywart " * 20), (1, "lananan morideog " * 20), (None, None)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    found = Counter(map(tuple, corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()))
    assert [found[r] for r in odd] == [0, 0, 1, 1] and found[rows[1]] == 1


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, space = docs.columns, Workspace(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = space.store(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            assert out.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves, and names with dots."""
    extra = {"_text": "t", "_row": "r", "_often": "o", "_copy": "c", "_at_lang": "l", "_mix_budget": "b", "_langid_doc": "d", "a.b": "e", "_id": "i"}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    prose = "the quick brown fox jumps over the lazy dog and then it runs away from all of the hunters "
    rows = [(i, f"{prose * 3} number {i} {'x' * (i % 7)} " + " ".join(f"own{i}w{k}" for k in range(40)), "en", f"s{i % 3}", 1) for i in range(30)]
    ddl = ", ".join([*("doc_id long, text string, lang string, source string, n_chars long".split(", ")), *[f"`{c}` string" for c in extra]])
    docs = spark.createDataFrame([(*r, *extra.values()) for r in rows], ddl)
    spark.createDataFrame([(i, 0, int(i % 2)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == [*columns, *extra], name
        found = out.collect()
        assert found or name == "toxicity"
        for row in found:
            assert tuple(row)[5:] == tuple(extra.values()), name
            assert tuple(row)[:5] == rows[row.doc_id], name


def test_many_languages_are_planned_fast(spark):
    import time

    rng = np.random.RandomState(8)
    letters = [chr(0x100 + k) for k in range(400)]
    rows = []
    for lang in range(120):
        own = rng.choice(letters, 6, replace=False)
        rows += [(lang * 4 + i, " ".join("".join(rng.choice(own, 5)) for _ in range(60)), f"l{lang:03}", f"s{lang % 9}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(docs)
    assert len(model.langs) == 120
    begin = time.time()
    out = langid.identify_documents(docs, model)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - begin < 60
    found = {r.doc_id: r.lang_id for r in out.collect()}
    assert np.mean([found[key] == lang for key, _, lang, _ in rows]) > 0.95


def test_posteriors_are_bayes_rule():
    """Against the rule spelled out for one row."""
    rng = np.random.RandomState(9)
    k, n = 3, 6
    logs, prior = rng.standard_normal((n, k)), np.array([0.5, 0.3, 0.2])
    soft = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    voted = np.array([True, True, True, False, True, True])
    found = {key: (rng.rand(n, k) * 5 + soft, np.array([True, True, False, True, True, False])) for key in ("_declared", "_host", "_domain")}
    for counts, filled in found.values():
        counts[~filled] = 0
    out = langid._fuse(logs, soft, voted, prior, found)
    for r in range(n):
        less = {key: counts[r] - (soft[r] if voted[r] and filled[r] else 0) for key, (counts, filled) in found.items()}
        domain = [(max(c, 0) + langid.DOMAIN_TRUST * p) / (sum(max(v, 0) for v in less["_domain"]) + langid.DOMAIN_TRUST) for c, p in zip(less["_domain"], prior)]
        host = [(max(c, 0) + langid.HOST_TRUST * d) / (sum(max(v, 0) for v in less["_host"]) + langid.HOST_TRUST) for c, d in zip(less["_host"], domain)]
        weight = []
        for i in range(k):
            w = math.exp(logs[r, i]) * host[i]
            if found["_declared"][1][r]:
                total = sum(max(v, 0) for v in less["_declared"])
                w *= (max(less["_declared"][i], 0) + langid.VALUE_TRUST * prior[i]) / (total + langid.VALUE_TRUST) / prior[i]
            weight.append(w)
        assert np.allclose(out[r], np.array(weight) / sum(weight))
