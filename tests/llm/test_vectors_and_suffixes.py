"""Whitening, substring deduplication and hard negatives against plain forms on small tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from whygraph.llm import hard_negatives as hn
from whygraph.llm import suffix_dedup as sd
from whygraph.llm import whitening as wh
from whygraph.llm.common import KEY, with_key

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(2, 0.5, d) / math.sqrt(d)
    x[: copies] = x[0]
    return x.astype(np.float32)


# --- whitening


def plain_components(x, k=8):
    values, across = np.linalg.eigh(np.cov((x - x.mean(axis=0)).T, bias=True))
    return values[::-1][:k], across[:, ::-1][:, :k]


@pytest.mark.parametrize(("n", "d"), [(200, 16), (40, 6), (300, 40)])
def test_whitening_equals_plain_eigenvectors(spark, n, d):
    x = vectors(n, d, n)
    odd = [(-1, None, 1), (-2, [None] * d, 1), (-3, [float("nan")] * d, None), (-4, [math.inf] * d, 1), (-5, [1.0], 1), (-6, [], 1)]
    table = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)] + odd, VECTORS)
    white, found, values, trace = wh.whitened(table.withColumn("x", F.lit("clash")).withColumn("id", F.lit(1)))
    got = {r.id: r for r in white.collect()}
    whole = np.floor(1024 * x.astype(float)) + 100_000
    expected, across = plain_components(whole)
    assert found == n and set(got) == set(range(n))
    assert np.allclose(values, expected, rtol=1e-10) and trace == pytest.approx(np.cov(whole.T, bias=True).trace())
    have, want = np.array([got[i].white for i in range(n)]), (whole - whole.mean(axis=0)) @ across / np.sqrt(expected)
    assert np.abs(have - want * np.sign((have * want).sum(axis=0))).max() < 1e-7
    assert wh.identity_error(white, len(values)) < 1e-9
    sums = whole.sum(axis=0)
    for i in (0, n - 1):
        assert got[i].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(whole[i], sums, strict=True))


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(5)], VECTORS)
    assert wh.whitened(same)[0].count() == 0
    assert wh.whitened(same.limit(0))[0].count() == 0
    line = spark.createDataFrame([(i, [0.5 * i, 0.25], 1) for i in range(5)], VECTORS)
    white, n, values, _ = wh.whitened(line)
    assert n == 5 and len(values) == 1 and white.count() == 5
    far = spark.createDataFrame([(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (2, [0.0, 2.0], 1)], VECTORS)
    white, n, values, _ = wh.whitened(far)
    assert n == 3 and white.filter("deviation is null").count() == 2


def test_inertia_and_missed_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 30):
        base, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = np.sort(rng.normal(size=d))
        a = base * values @ base.T
        for shift in (-2.0, 0.0, float(values.mean()), 2.0):
            assert wh.above(a, shift) == (values > shift).sum()
    assert wh.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_tied_and_close_eigenvalues():
    rng = np.random.default_rng(4)
    base, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    for values in (np.r_[np.full(3, 5.0), np.full(17, 1.0)], 1 + 1e-3 * np.arange(20)[::-1], np.r_[9.0, np.full(19, 2.0)]):
        found, across = wh.components(base * values @ base.T)
        assert np.allclose(found, values[:8], rtol=1e-12)
        assert np.abs(across.T @ across - np.eye(8)).max() < 1e-12
        assert np.abs(base * values @ base.T @ across - across * found).max() < 1e-11 * values[0]


# --- hard negatives


def plain_negatives(rows):
    fits = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, l in rows if l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for a, la, va in fits:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, lb == la) for i, lb, v in fits if i != a)
        for s, p, same in [x for x in scored if x[2]][:5]:
            window = [(n, -t) for t, n, alike in scored if not alike and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(window[:10])}
    return out


@pytest.mark.parametrize(("n", "d", "copies"), [(450, 8, 0), (400, 3, 150), (101, 16, 0)])
def test_hard_negatives_equal_plain_search(spark, monkeypatch, n, d, copies):
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hn, "GROUP_ROWS", 90)
    monkeypatch.setattr(hn, "WINDOW", 16)
    rng = random.Random(n)
    rows = [(i, v.tolist(), rng.randrange(4)) for i, v in enumerate(vectors(n, d, d, copies))]
    rows[3] = (3, None, 1)
    rows[4] = (4, rows[4][1], None)
    rows[5] = (5, [math.nan] + rows[5][1][1:], 2)
    rows[6] = (6, [None] + rows[6][1][1:], 2)
    rows[8] = (8, [0.0] * d, 1)
    rows[100] = (100, rows[100][1], None)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = spark.createDataFrame(rows, VECTORS).withColumn("near", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    got = hn.hard_negatives(table, F.col("vec_id") % 100 == 0, label)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)


def test_hard_negatives_of_odd_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (7, [0.5, 0.2], 2), (7, [0.5, 0.2], 2), (9, [1.0], 2)], VECTORS)
    got = hn.hard_negatives(table, F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, None, 1, 7), (0, None, 2, 7)]
    assert hn.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert hn.hard_negatives(table.filter("vec_id = 7"), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def block_of(v, key=0):
    import pandas as pd

    norm = np.sqrt((v * v).sum(axis=1).astype(float))
    references = np.eye(v.shape[1])[:2]
    return hn.Block(pd.DataFrame({KEY: range(key, key + len(v)), "place": range(key, key + len(v)), "label": 1, "v": list(v), "norm": norm, "angles": list(hn.angles_to(v.astype(float), norm, references))}))


def test_bounds_hold_and_windows_are_skipped():
    rng = np.random.default_rng(1)
    for spread in (0.05, 1.0, 300.0):
        centre = rng.normal(size=6) * 200
        anchors, window = block_of(rng.integers(-300, 300, (40, 6))), block_of((centre + spread * rng.normal(size=(30, 6))).astype(int))
        least, greatest = hn.bounds(anchors, window)
        scores = anchors.v @ window.v.T
        assert (scores.min(axis=1) >= least).all() and (scores.max(axis=1) <= greatest).all()
    near, away = block_of(np.array([[200, 1, 0], [210, -3, 2]]), 10), block_of(np.array([[-200, 1, 0], [-190, 4, 0]]), 20)
    anchor, none = block_of(np.array([[250, 0, 0]])), np.iinfo(np.int64)
    best, scored = hn.searched(anchor, np.array([[none.min]]), np.array([[none.max]]), True, 2, iter([near, away]))
    assert sorted(best.key) == [10, 11] and scored == 2


def test_scores_beyond_doubles():
    big = np.full((1, 4), 1 << 26)
    assert hn.integer_scores(big, big)[0, 0] == 4 * (1 << 52)
    assert hn.integer_scores(big, big - 1)[0, 0] == 4 * (1 << 26) * ((1 << 26) - 1)


# --- substring deduplication


def plain_substrings(rows):
    """rows of (order, text): (n_bytes, n_removed, n_spans, digest) of each."""
    seen = {}
    for order, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - sd.STRING + 1):
            w = data[p : p + sd.STRING]
            seen[w] = min(seen.get(w, order), order)
    out = []
    for order, text in rows:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - sd.STRING + 1):
            if seen[data[p : p + sd.STRING]] < order:
                hit[p : p + sd.STRING] = b"\1" * sd.STRING
        keep = bytes(c for c, h in zip(data, hit, strict=True) if not h)
        out.append((len(data), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), hashlib.sha256(keep).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([*passages, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), "x" * rng.randrange(90), "ab" * rng.randrange(70)]) for _ in range(rng.randrange(5))]
        texts.append(" ".join(parts))
    texts[3], texts[4], texts[5], texts[10] = None, "", "z" * 49, "z" * 50
    texts[20] = texts[21] = texts[50] = max((t for t in texts if t), key=len)
    texts[30] = texts[20][1:]
    return texts


@pytest.mark.parametrize("hot", [1 << 16, 2, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_plain_form(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "SLICE", 64)
    monkeypatch.setattr(sd, "PIECE", 500)
    monkeypatch.setattr(sd, "BUCKET_GRAMS", 256)
    monkeypatch.setattr(sd, "BUCKET_SUFFIXES", 40)
    monkeypatch.setattr(sd, "RANGES", 4)
    rows = list(enumerate(corpus(seed)))
    table = with_key(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bytes string").repartition(3), "doc_id")
    got = {r[KEY]: (r.n_bytes, r.n_removed, r.n_spans, r.digest) for r in sd.substring_dedup(table, hot=hot).collect()}
    assert [got[i] for i, _ in rows] == plain_substrings(rows)


def test_substrings_with_odd_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", text), ("a", text), ("b", text + "!"), (None, "q" + text), (None, None)]
    table = with_key(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id")
    got = sorted((r.n_bytes, r.n_removed) for r in sd.substring_dedup(table).collect())
    order = {None: -1, "a": 0, "b": 1}
    assert got == sorted(x[:2] for x in plain_substrings([(order[i], t) for i, t in rows]))
    assert sd.substring_dedup(table.limit(0)).count() == 0


def test_sparse_suffixes_are_in_every_string():
    rng = random.Random(5)
    for data in (bytes(rng.randrange(256) for _ in range(3000)), b"a" * 500, b"abc" * 200, b"x" * 49, b"y" * 50):
        places, hashes = sd.sampled(data, np.array([len(data)]))
        assert len(places) == len(hashes)
        have = set(places.tolist())
        assert all(have & set(range(p, p + sd.SPAN)) for p in range(len(data) - sd.STRING + 1))
        assert not len(places) or places.max() + sd.GRAM <= len(data)


def test_sparse_suffixes_of_joined_texts(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.choice([0, 3, 49, 50, 51, 120, 400]))) for _ in range(40)]
    ends = np.cumsum([len(t) for t in texts])
    for size in (1 << 15, 64, 200):
        monkeypatch.setattr(sd, "SLICE", size)
        places, hashes = sd.sampled(b"".join(texts), ends)
        got, start = {(int(p), int(h)) for p, h in zip(places, hashes, strict=True)}, 0
        for t in texts:
            own, h = sd.sampled(t, np.array([len(t)]))
            assert {(int(p) + start, int(x)) for p, x in zip(own, h, strict=True)} == {g for g in got if start <= g[0] < start + len(t)}
            start += len(t)


def test_multikey_sort():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        rows = rng.integers(0, 3, (n, 16)).astype(np.uint8)
        rows[n // 2 :] = rows[: n - n // 2]
        order, depth = sd.multikey_sorted(rows)
        plain = sorted(r.tobytes() for r in rows)
        assert [rows[i].tobytes() for i in order] == plain
        for i in range(1, n):
            assert depth[i] == next((j for j in range(16) if plain[i][j] != plain[i - 1][j]), 16)
