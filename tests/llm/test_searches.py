"""Tree searches and the source audit against brute force, with awkward rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybridge.llm import divergent_sources, kmeans_tree, rtree

VECTORS = "vec_id long, embedding array<float>, label int, x string, leaf int, tile int, q int, `a.b` int"


def vectors(n=600, dim=8):
    """Clusters, copies, ties, NULLs, zeros, non-finite components, other lengths, repeated ids."""
    rng = np.random.RandomState(3)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        x = centres[rng.randint(12)] + 0.3 * rng.standard_normal(dim)
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.randint(4))))
    copied = rows[50][1]
    rows += [(n + i, copied, i % 3) for i in range(300)]
    rows += [
        (1000, None, 1), (1050, [], 1), (1100, [0.0] * dim, 2), (1150, [None] + [1.0] * (dim - 1), 1),
        (1200, [float("nan")] + [1.0] * (dim - 1), 1), (1250, [float("inf")] * dim, 1), (1300, [1.0, 2.0], 1), (1301, [1.0, 2.5], 1),
        (1302, [2.0, 1.0], 3), (1350, copied, None), (None, copied, 1), (100, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2]),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)


def brute_nearest(rows, k):
    usable = {}
    for key, x, _ in rows:
        if key is not None and x and None not in x and np.isfinite(x).all() and np.any(x):
            usable[key] = np.array(x)
    out = {}
    for q, x in usable.items():
        if q % 50 == 0:
            scores = [
                (-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), key)
                for key, y in usable.items() if key != q and len(y) == len(x)
            ]
            out[q] = [key for _, key in sorted(scores)[:k]], [-s for s, _ in sorted(scores)[:k]]
    return out


def test_nearest_with_all_leaves_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 32)
    monkeypatch.setattr(kmeans_tree, "LEAST_SAMPLE", 4)
    monkeypatch.setattr(kmeans_tree, "MEMBERS", 50)
    monkeypatch.setattr(kmeans_tree, "ASKED", 3)
    monkeypatch.setattr(kmeans_tree, "TARGET", 1.1)
    rows = vectors()
    expected = brute_nearest(rows, 5)
    found = {}
    for r in kmeans_tree.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [v for _, v, _ in own] for q, own in found.items()} == {q: ids for q, (ids, _) in expected.items()}
    for q, own in found.items():
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert np.allclose([s for _, _, s in own], expected[q][1], rtol=0, atol=1e-14)
    assert len(found[1300]) == 2  # all candidates, where there are fewer


def test_nearest_reaches_the_recall_it_claims(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 32)
    monkeypatch.setattr(kmeans_tree, "LEAST_SAMPLE", 4)
    rows = vectors(3000, 16)
    expected = brute_nearest(rows, 5)
    found, widths = {}, set()
    for r in kmeans_tree.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        widths.add((r.width, r.calibrated_recall >= kmeans_tree.TARGET))
    assert len(widths) == 1 and widths.pop()[1]
    assert np.mean([len(found[q] & set(ids)) / len(ids) for q, (ids, _) in expected.items()]) >= 0.9


def test_best_bin_first_takes_the_nearest_open_node():
    rng = np.random.RandomState(1)
    x = rng.standard_normal((800, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = kmeans_tree.fit(x, 800 * 256)
    order = tree.visits(x[0], 1 << 20)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 16
    assert order[0] == tree.place(x[:1])[0] and tree.visits(x[0], 5) == order[:5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert kmeans_tree.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    assert rtree.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    assert divergent_sources.audit(spark.createDataFrame([], DOCUMENTS)).count() == 0


@pytest.mark.parametrize("page", [4, 128])
def test_hard_negatives(spark, monkeypatch, page):
    monkeypatch.setattr(rtree, "PAGE", page)
    monkeypatch.setattr(rtree, "FANOUT", 3)
    monkeypatch.setattr(rtree, "TILE_ROWS", 100)
    monkeypatch.setattr(rtree, "ASKED", 4)
    rows = vectors()
    usable = {
        key: (label, [int(np.floor(256 * v)) for v in x]) for key, x, label in rows
        if key is not None and label is not None and x and None not in x and np.isfinite(x).all()
    }
    expected = set()
    for anchor, (label, x) in usable.items():
        if anchor % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), key, own) for key, (own, y) in usable.items() if key != anchor and len(y) == len(x))
        for score, positive, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            expected |= {(anchor, positive, rank, key, -score, -s) for rank, (s, key, _) in enumerate(fit, 1)}
    found = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_scores_beyond_doubles_are_exact():
    rng = np.random.RandomState(2)
    for reach in (1 << 10, 1 << 28, 1 << 40):
        x = rng.randint(-reach, reach, (40, 5))
        part = rtree.Part(np.arange(40), np.zeros(40, np.int64), x)
        scores, fits = part.scores(x[3], 0, 40)
        wide = [sum(int(a) * int(b) for a, b in zip(x[3], row)) for row in x]
        fits = np.ones(40, bool) if fits is None else fits
        assert [v for v, ok in zip(wide, fits) if ok] == scores[fits].tolist()
        assert all(abs(v) >= 1 << 63 for v, ok in zip(wide, fits) if not ok)
        least, highest = rtree.intervals(x[3:4], x.min(0)[None, :], x.max(0)[None, :])
        assert least[0, 0] <= min(wide) and max(wide) <= highest[0, 0]


def test_packing_keeps_every_row():
    rng = np.random.RandomState(4)
    x = rng.randint(-50, 50, (1000, 6))
    pages = rtree.pack(x, np.arange(1000), 32, rtree.widest(x, 32))
    assert sorted(np.concatenate(pages)) == list(range(1000)) and max(map(len, pages)) <= 32
    tiles = rtree.Tiles(x, 10)
    assert set(tiles.place(x)) <= set(range(tiles.count)) and len(set(tiles.place(x))) > 5
    equal = rtree.Tiles(np.repeat(x[:1], 100, 0), 10)
    assert set(equal.place(x)) <= set(range(equal.count)) and equal.count < 20


DOCUMENTS = "doc_id long, text string, lang string, source string, n long, term string, `a.b` int"


def corpus():
    rng = np.random.RandomState(6)
    names = ["The", "cat", "SAT", "on", "mat", "Straße", "été", "中文", "x1y2", "don't", "É", "rare"]
    rows = []
    for i in range(400):
        lang = ["en", "en", "de", "fr", None][rng.randint(5)]
        source = ["a", "a", "b", "c", "", None][rng.randint(6)]
        share = np.array([3, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 0.01]) + (np.arange(12) % 3 == (source == "b")) * 2
        rows.append((i, " ".join(rng.choice(names, rng.randint(0, 30), p=share / share.sum())), lang, source))
    rows += [(500, None, "en", "silent"), (501, "", "xx", "alone"), (502, "few words", "yy", "p"), (503, None, "yy", "q")]
    rows += [(504, "the cat " * 200_000, "en", "b"), (3, rows[3][1], *rows[3][2:]), (None, "the cat sat", "en", "a")]
    return rows


@pytest.mark.parametrize("entries, block", [(250_000, 256), (5, 2)])
def test_source_divergence(spark, monkeypatch, entries, block):
    monkeypatch.setattr(divergent_sources, "PART_ENTRIES", entries)
    monkeypatch.setattr(divergent_sources, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergent_sources, "HELD_SUMS", entries)
    monkeypatch.setattr(divergent_sources, "PIECE", 1000)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], DOCUMENTS).repartition(3)
    found = sorted(map(tuple, divergent_sources.audit(docs).collect()))
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows))))))
    assert found == sorted(con.sql(divergent_sources.ORACLE).fetchall())
    assert {("xx", "alone"), ("yy", "p")} & {r[:2] for r in found} == {("yy", "p")}
