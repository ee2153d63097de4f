"""Corpus operators against brute force, on rows with every awkward property at once."""

import base64
import hashlib
import json
import math
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from whygraph.llm import chat, decontaminate, exact_dedup, html_extract, lm, mixing, ngram_join, pii, quality, warc
from whygraph.llm import words as words_module
from whygraph.llm.common import KEY, with_key
from whygraph.operators import components

SCHEMA = "doc_id long, text string, source string, n_words long, score double, kept boolean, name string, id long, h long, i int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    texts = [None, None, "", "", " \n\t", "one", "One", "a b c d", "a  b\nc d", "!!! ***", "word " * 400, "word " * 400, "Ünïcode É 😀 ß", "x" * 9000]
    texts += [prose(draw, draw.choice((3, 40, 150))) for _ in range(40)]
    long = prose(draw, 6000)
    base = prose(draw, 120)
    texts += [long, long, long + " tail", long.replace(" ", "\n", 3)]
    texts += [base + " " + prose(draw, k) for k in range(12)]
    for k in range(12):
        w = base.split()
        w[k * 9] = "changed"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    found = [(i, t, draw.choice(["s1", "s2", "s3", None, "Z"])) for i, t in zip(ids, texts, strict=True)]
    found += [found[20], found[20], (found[21][0], "other text", "s1"), (None, texts[22], None), (None, "null id", "s1"), (-5, texts[23], "s2")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = (1, 0.5, True, "clash", 3, 4, 5)
    return with_key(spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3), "doc_id").cache()


@pytest.fixture(scope="module")
def none(spark):
    return with_key(spark.createDataFrame([], SCHEMA), "doc_id")


def collected(df, docs):
    """The rows of df with the id and text of each."""
    keyed = docs.select(KEY, F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    return df.join(keyed, KEY).collect()


def test_keys_differ_in_every_row(docs, rows):
    assert docs.select(KEY).distinct().count() == docs.count() == len(rows)


@pytest.mark.parametrize("block, hashed", [(4096, F.xxhash64), (7, F.xxhash64), (16, lambda c: F.length(c).cast("long"))])
def test_exact_groups(docs, block, hashed):
    found = collected(exact_dedup.exact_groups(docs, block_bytes=block, hash_block=hashed), docs)
    groups = defaultdict(list)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in found:
        groups[normal(r.body)].append(r)
    for text, group in groups.items():
        ids = [r.doc for r in group if r.doc is not None]
        assert {r.keep_id for r in group} == {min(ids, default=None)}
        assert {r.group_size for r in group} == {len(group)}
        assert {r.digest for r in group} == {hashlib.sha256(text.encode()).hexdigest()}
        assert sum(r.kept for r in group) == 1
        assert next(r.doc for r in group if r.kept) == min(ids, default=None)


def test_exact_dedup_keeps_columns(docs):
    kept = exact_dedup.exact_dedup(docs.drop(KEY))
    assert kept.columns == docs.drop(KEY).columns
    assert kept.select(exact_dedup.normalised(F.col("text"))).distinct().count() == kept.count()


@pytest.mark.parametrize("block, grams", [(4, 10**6), (256, 10**6), (256, 500)])
def test_near_classes(docs, block, grams):
    found = collected(ngram_join.near_classes(docs, block=block, block_grams=grams), docs)
    grams = []
    for r in found:
        w = words(r.body)
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for x in range(len(found)):
        for y in range(x):
            both = len(grams[x] & grams[y])
            if both and both >= 0.8 * (len(grams[x]) + len(grams[y]) - both) - 1e-9:
                links[x] += 1
                links[y] += 1
                root[top(x)] = top(y)
    members = defaultdict(list)
    for x, r in enumerate(found):
        assert r.n_links == links[x]
        members[top(x)].append(r)
    assert sum(links.values()) > 100
    for group in members.values():
        ids = [r.doc for r in group if r.doc is not None]
        assert {r.class_id for r in group} == {min(ids, default=None)}
        assert sum(r.kept for r in group) == 1


def test_banding_reaches_its_recall():
    bands, per = ngram_join.banding(0.8, 0.9999, 192)
    assert bands * per <= 192 and 1 - (1 - 0.8**per) ** bands >= 0.9999


def test_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert found == {x: top(x) for x in list(root)}


def hits(text, items, window):
    w, covered, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(window, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                covered |= set(range(k, k + n))
                found |= {str(item)} if item is not None else set()
    return len(w), len(covered), sorted(found)


@pytest.mark.parametrize("chars", [10**9, 300])
def test_decontamination(spark, docs, rows, chars):
    long = rows[-10][1].split()
    items = [(1, " ".join(long[5:40])), (2, "A, B c"), (3, None), (4, ""), (10, " ".join(long[10:23])), (10, "word word"), (None, "one"), (5, "😀"), (5, "😀"), (6, "word " * 14)]
    items += [(20 + k, " ".join(words(rows[k][1])[2:20])) for k in range(14, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in collected(decontaminate.contamination(decontaminate.scan(docs, bench, window=5, block_chars=chars)), docs):
        n, hit, found = hits(r.body, items, 5)
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)


def test_mixing(spark, docs):
    sizes = mixing.sized(docs).cache()
    targets = mixing.source_targets(sizes)
    found = mixing.mix(sizes, targets, leaf=8).collect()
    assert len(found) == docs.count()
    size, names = Counter(), sorted({r.source for r in found if r.source is not None}) + [None]
    for r in collected(sizes, docs):
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.body or ""))
        size[r.source] += r.size
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, total = {}, set(names), sum(size.values())
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken, longest = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(sizes.repartition(5), targets, leaf=8)
    assert sorted((r[KEY], r.copies) for r in found) == sorted((r[KEY], r.copies) for r in again.collect())


def test_pivot_keeps_expectations_and_mass():
    rows = pd.DataFrame({KEY: range(200), "source": "s", "size": [1 + k % 17 for k in range(200)], "copies": 0, "p": [0.3] * 200})
    means = np.zeros(200)
    for seed in range(300):
        out = mixing.pivot(rows, seed)
        assert (out["size"] * out["p"]).sum() == pytest.approx((rows["size"] * 0.3).sum())
        assert ((out["p"] > 0) & (out["p"] < 1)).sum() <= 1
        means += out["p"].to_numpy() / 300
    assert abs(means - 0.3).max() < 0.15 and abs(means.mean() - 0.3) < 0.01


def strict(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_strict_spans_equal_the_patterns():
    draw = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "-", " ", "é", "00", "7", "a_b%c@d-e.f.g.", "@@", "(", ")", "😀", "\n", "+49 30 1234567890"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 14)))
        assert pii.strict_spans(text) == strict(text), text


def test_personal_data(spark):
    texts = [None, "", "mail joe@example.com now", "call tel (743) 555-3824 or joe [at] example [dot] com", "+1 (743) 555-3824 " * 40, "é 😀 10.0.0.1", "9" * 20000, "@" * 20000, "token = 4111111111111111"]
    texts += ["0" * 5000 + "1.2.3.4", "1." + "0" * 9000 + "2.3.4", "1.2.3." + "9" * 6000, "10.2." + "0" * 5000 + "255.0", "1.2.3.256", "+1" + "0" * 9000, "+1 " * 5000 + "2", "4111-" * 6000 + "1"]
    texts += [f"write mail u{k}@mail{k}.com, tel +1 (743) 555-38{k:02d} and ip 10.2.3.{k}" for k in range(30)]
    docs = with_key(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    found = {r[KEY]: r for r in pii.personal_data(docs).collect()}
    for k, t in enumerate(texts):
        spans = strict(t or "")
        base = ",".join(f"{pii.KINDS[x]}:{s}:{e}" for s, x, e in spans)
        assert found[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(found[k].spans.split(","))
        assert [found[k][f"n_{x}"] for x in pii.KINDS] == [sum(y == i for _, y, _ in spans) for i in range(4)]
        assert found[k].n_spans == len(list(filter(None, found[k].spans.split(","))))
    assert "phone:9:23" in found[3].spans and "email" in found[3].spans


def test_reliabilities_find_the_good_labelers():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.6
    right = (0.95, 0.9, 0.85, 0.8, 0.55, 0.5)
    votes = np.stack([np.where(draw.random(4000) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    rows = Counter(map(tuple, np.column_stack((np.zeros(4000, int), votes, np.ones(4000, int)))))
    patterns, n = np.array(list(rows)), np.array(list(rows.values()), float)
    found = pii.Reliabilities(patterns, n)
    true, _ = found.tables["email"]
    assert all(abs(true[k, 2] - r) < 0.06 for k, r in enumerate(right))
    by = dict(zip(map(tuple, patterns), pii.SpanClassifier(patterns, found.truth, n).probability(patterns), strict=True))
    guess = np.array([by[(0, *v, 1)] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.94


def test_quality(spark, docs):
    draw = random.Random(2)
    rows = [(k, prose(draw, 80) + ".") if k % 2 else (k, "BUY!!! NOW!!! " * draw.randint(5, 40)) for k in range(300)]
    train = with_key(spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string"), "doc_id")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] * 2 + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    found = quality.quality_scores(train, labels).collect()
    assert len(found) == 302
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.id >= 900 or r.predicted == r.id % 2
    everything = quality.quality_scores(docs, labels)
    assert everything.count() == docs.count()
    untrained = quality.quality_scores(docs, labels.filter("false")).select("score").distinct().collect()
    assert [r.score for r in untrained] == [0.5]


def form(word):
    """The bin of a word: its kind of letters, then its length in bytes, two lengths a class."""
    kind = 3 if any(48 <= c <= 57 for c in word) else 2 if any(c < 128 and not 97 <= c <= 122 for c in word) else 1 if any(c >= 128 for c in word) else 0
    return kind * 8 + min((len(word) - 1) // 2, 7)


def plain_log10(model, vocab, symbol, before):
    """The log10 probability of one symbol, by sums over all classes and all words of its class."""
    width = model.width
    guess = [1.0 * sum(float(model.r[v][k]) * float(model.a[i * width + k][j]) for i, v in enumerate(before) for k in range(width)) for j in range(width)] + [1.0]
    score = lambda row: math.exp(sum(float(x) * g for x, g in zip(row, guess, strict=True)))
    rank = symbol - 33
    c = symbol if rank < 0 else 33 + math.isqrt(rank)
    out = math.log10(score(model.t[c]) / sum(map(score, model.t)))
    if rank >= 0:
        k = math.isqrt(rank)
        out += math.log10(score(model.q[rank]) / sum(score(model.q[x]) for x in range(k * k, min((k + 1) ** 2, vocab.words))))
    return out


def test_lm_scores(spark, docs, monkeypatch):
    kept = []
    train = lm.trained
    monkeypatch.setattr(lm, "trained", lambda symbols, vocab: kept.append((train(symbols, vocab), vocab)) or kept[0][0])
    found = collected(lm.lm_scores(docs, frequent=20, least=2, counted=50), docs)
    model, vocab = kept[0]
    split = lambda t: [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in found if not out(r.doc) for w in split(r.body))
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == docs.count()
    hashes = {w: int(lm.tokens([w])[0][0]) for w in counts if w is not None}
    own = sorted((-c, hashes[w] - (1 << 64 if hashes[w] >> 63 else 0), w) for w, c in counts.items() if w is not None and c >= 2)[:20]
    symbol = {w: 33 + k for k, (_, _, w) in enumerate(own)} | {None: 0}
    assert vocab.words == 20 and 0 < len(vocab.more) <= 30 and any(form(w) != form(b"abc") for w in counts if w is not None)
    in_bin = defaultdict(list)
    for w, c in counts.items():
        if w not in symbol:
            in_bin[form(w)].append(c)
    for r in found:
        w = split(r.body)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc), len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert math.isfinite(r.score) and r.score < 0
        if len(w) < 60:
            s = [0, 0] + [symbol.get(x, 1 + form(x) if x else 0) for x in w]
            plain = sum(plain_log10(model, vocab, s[k], (s[k - 1], s[k - 2])) for k in range(2, len(s)))
            plain += sum(math.log10((counts[x] + 1) / (sum(in_bin[form(x)]) + len(in_bin[form(x)]) + 1)) for x in w if x not in symbol)
            assert r.score == pytest.approx(plain, rel=1e-4, abs=1e-3)


def vocabulary_of(counts):
    """A Vocabulary of words with the given counts, most frequent first, in hash order."""
    return lm.Vocabulary(np.arange(len(counts)).astype(np.uint64), 33 + np.arange(len(counts)), np.concatenate((np.ones(33, int), counts)), 33 + sum(counts), 33 + len(counts), np.ones(32, int), np.zeros(0, np.uint64), np.zeros(0, int))


def test_log_bilinear_is_normalised_and_learns():
    draw = np.random.default_rng(1)
    w = np.zeros(60000, np.int64)
    for k in range(1, len(w)):
        w[k] = (w[k - 1] * 3 + 1) % 20 if draw.random() < 0.8 else draw.integers(0, 20)
    w += 33
    vocab = vocabulary_of(np.full(20, 3000))
    model = lm.LogBilinear(vocab)
    before = lm.contexts(w, np.array([0, len(w)]))
    model.prepared()
    untrained = model.log_probability(w, before).mean()
    model.start(0)
    for k in range(0, len(w) * 4, 1000):
        at = slice(k % len(w), k % len(w) + 1000)
        model.learn(w[at], [v[at] for v in before])
    model.prepared()
    every = np.stack([model.log_probability(np.full(50, x), [v[:50] for v in before]) for x in range(53)])
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(50), abs=1e-4)
    assert model.log_probability(w, before).mean() > untrained + 0.5


def test_large_scores_are_normalised_too():
    model = lm.LogBilinear(vocabulary_of([5, 5]))
    model.prepared()
    out = np.zeros(2, np.float32)
    model.normalise(out, np.array([[200.0], [0.5]], np.float32), np.array([[1.0], [0.9]], np.float32))
    assert -out == pytest.approx([200.0, math.log(math.exp(0.5) + math.exp(0.45))])


def test_every_training_token_is_a_target_once(monkeypatch):
    targets = []
    monkeypatch.setattr(lm.LogBilinear, "learn", lambda self, w, before: targets.extend(zip(w.tolist(), *[v.tolist() for v in before])))
    draw = random.Random(3)
    texts = [[draw.randrange(33, 80) for _ in range(n)] + [0] for n in (300, 1, 0, 40)] * 30
    vocab = vocabulary_of(np.full(50, 9))
    given = {n: getattr(lm.LogBilinear(vocab), n) for n in lm.LogBilinear.NAMES}
    for turn in range(lm.ROUNDS):
        batches = [pa.RecordBatch.from_arrays([pa.array([j // 70 for j in range(i, min(i + 50, len(texts)))], pa.int32()), pa.array(texts[i : i + 50], pa.list_(pa.int32()))], ["shard", "symbols"]) for i in range(0, len(texts), 50)]
        list(lm.train_batches(types.SimpleNamespace(value=vocab), types.SimpleNamespace(value=given), turn)(iter(batches)))
    expected = Counter()
    for t in texts:
        expected.update(zip(t, [0, *t[:-1]], [0, 0, *t[:-2]][: len(t)]))
    assert Counter(targets) == expected


def test_what_is_learned_does_not_hang_on_tasks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 64)
    draw = random.Random(8)
    vocab = vocabulary_of(np.full(40, 9))
    rows = [(k, [draw.choice([0, *range(33, 73)]) for _ in range(draw.choice([1, 5, 90, 400]))]) for k in range(120)]
    rows = [(k, [*t[:-1], 0]) for k, t in rows]
    table = spark.createDataFrame(rows, f"{KEY} long, symbols array<int>")
    found = []
    for tasks, batch in ((1, 10_000), (3, 7), (8, 31)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(lm.trained(table.repartition(tasks, F.rand(tasks)), vocab, 60))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in lm.LogBilinear.NAMES:
        for other in found[1:]:
            assert np.array_equal(getattr(found[0], name), getattr(other, name)), name


def test_the_level_that_overflows_is_filled(spark):
    """Six words occur equally often and four have room: those with the smallest hashes are taken."""
    counts = spark.createDataFrame([(h, 1, 5) for h in (9, 3, 7, -2, 4, 8)] + [(1, 1, 2)], "h long, form int, c long")
    vocab = lm.vocabulary(counts, frequent=4, least=1, counted=4)
    assert vocab.words == 4 and {int(h) for h in vocab.hashes.view(np.int64)} == {-2, 3, 4, 7}


def test_moves_are_means_weighted_by_learning():
    frames = pd.DataFrame([{"part": "q", "block": 0, "task": k, "rows": np.array(rows), "weights": np.array(weights), "sums": np.array(sums, float).ravel()} for k, (rows, weights, sums) in enumerate([([1, 4], [2.0, 1.0], [[2, 4], [1, 1]]), ([4], [3.0], [[5, 7]])])])
    out = lm.summed(frames).iloc[0]
    assert (out["task"], out["rows"].tolist(), out["weights"].tolist(), out["sums"].tolist()) == (0, [1, 4], [2.0, 4.0], [2.0, 4.0, 6.0, 8.0])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [b"one two " * 40, None, b"", b"x" * 500, b" ".join(b"w%d" % k for k in range(200)), b"y" * 90 + b" tail"]
    whole = [words_module.word_hashes(texts, words_module.NOT_SPACE), lm.tokens(texts)]
    monkeypatch.setattr(words_module, "PIECE", 64)
    for a, b in zip(whole, [words_module.word_hashes(texts, words_module.NOT_SPACE), lm.tokens(texts)], strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
    <div id="cookie-notice">We use cookies</div><header><a href="/">Home</a></header><nav><ul><li>a<li>b</ul></nav><!-- x > y -->
    <div class="ad">buy</div><article class="post"><h1>A &amp; B&#33;</h1><p><b>bold.<br><p>sp<i>lit</i> &lt;tag&gt;
    &eacute;</p><form><input>search</form><table><tr><td>1<td>2</table><pre> x
       y </pre></article><section class="comments"><article class="comment">nice</article></section><aside>more</aside><footer>&copy;</footer></body></html>"""
    assert html_extract.Page(page).text() == "A & B! bold. split <tag> é 1 2 x y"
    assert html_extract.Page("plain <p>text <di").text() == "plain text"
    assert html_extract.Page("<div>" * 5000 + "deep" + "</p>" * 5000).text() == "deep"
    assert html_extract.Page("<article>kept</article><div hidden>no</div>").text() == "kept"


def test_site_templates_are_removed(spark):
    box = "<div><p>Read our newest posts</p><p>About us</p></div>"
    page = lambda k: f"<html><body>{box}<p>own text {k}</p><p>shared line</p></body></html>"
    rows = [(k, "http://A.example.org/x", page(k)) for k in range(8)] + [(50 + k, "http://b.example.org/", page(k)) for k in range(3)]
    rows += [(90, None, "<p>x"), (91, "http://[bad", None), (92, "http://a.example.org/", ""), (92, "http://c.org", "<p>same id")]
    pages = with_key(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id")
    found = collected_pages = {(r.page_id, r.text) for r in html_extract.main_text(pages).join(pages.select(KEY, "page_id"), KEY).collect()}
    assert {(k, f"own text {k}") for k in range(8)} <= found
    assert (50, "Read our newest posts About us own text 0 shared line") in collected_pages
    assert {(90, "x"), (91, ""), (92, ""), (92, "same id")} <= found


def test_templates_of_hosts_with_many_copies(spark):
    page = lambda k, ad: f"<html><body><div class=ad>{ad}</div><article><div>Read our newest posts</div><p>own text {k}</p></article></body></html>"
    rows = [(k, "http://a.org/", page(k, k)) for k in range(10)] + [(100 + k, "http://a.org/", page(0, 100 + k)) for k in range(30)]
    # Here most pages differ, and the box is on 5 of 30: not a template, however often one of them was copied.
    rows += [(200 + k, "http://b.org/", page(k, k) if k < 5 else f"<article><p>own text {k}</p></article>") for k in range(30)] + [(300 + k, "http://b.org/", page(0, 0)) for k in range(90)]
    pages = with_key(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id")
    found = {r.page_id: r.text for r in html_extract.main_text(pages, keep=("page_id",)).collect()}
    assert all(found[k] == f"own text {k}" for k in range(10)) and all(found[100 + k] == "own text 0" for k in range(30))
    assert found[200] == found[300] == "Read our newest posts own text 0" and found[229] == "own text 29"


def test_templates_are_counted_over_whole_pages(spark):
    nav, foot = "<nav><a>Home</a><a>News</a></nav>", "<footer>All rights reserved</footer>"
    rows = [(k, "http://a.org/", f"<html><body>{nav}<div class=ad>once {k}</div><article><p>own text {k}</p></article>{foot}</body></html>") for k in range(8)]
    pages = with_key(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id")
    page = html_extract.Page(rows[0][2])
    by_tag = dict(zip(page.tags, page.hashes))
    [(host, templates)] = [tuple(r) for r in html_extract.site_templates(pages).collect()]
    beside = {page.tags[e]: h for e, h in page.beside().items()}
    assert host == "a.org" and set(beside) == {"nav", "div", "footer"} and by_tag["div"] not in templates
    assert {bytes(t) for t in templates} == {by_tag["nav"], by_tag["footer"], *beside.values()}
    assert {r.text for r in html_extract.main_text(pages).collect()} == {f"own text {k}" for k in range(8)}


@pytest.mark.parametrize("rules", [True, False])
def test_menus_and_footers_go_by_their_structure(spark, rules):
    """Their text differs from page to page; with no rule on, recurrence has to find them alone."""
    draw = random.Random(8)
    rows, main = [], {}
    for k in range(40):
        menu = "".join(f"<li><a href='/{k}{j}'>{prose(draw, 1)}</a></li>" for j in range(draw.randint(2, 6)))
        article = [prose(draw, draw.randint(20, 60)) for _ in range(draw.randint(1, 4))]
        main[k] = " ".join(article)
        body = f"<div class='m{k % 3}'><ul>{menu}</ul></div><div id=c>{''.join(f'<p>{a}</p>' for a in article)}</div><div class=end>{prose(draw, 4)} <b>{k}</b></div>"
        rows.append((k, f"http://h{k // 35}.org/{k}", f"<html><body>{body}</body></html>"))
    rows += [(100, "http://h0.org/", None), (101, None, "<p>alone</p>")]
    pages = with_key(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id")
    found = {r.page_id: r.text for r in html_extract.main_text(pages, keep=("page_id",), rules=rules).collect()}
    assert all(found[k] == main[k] for k in range(40))
    assert found[100] == "" and found[101] == "alone"
    # The same counts, plainly.
    places, on, of_host = defaultdict(set), defaultdict(set), defaultdict(set)
    for _, url, source in rows:
        page, host = html_extract.Page(source or "", rules), html_extract.host_of(url)
        of_host[host].add(page.identity())
        for h, place in page.subtrees():
            places[host, h].add(place)
            on[host, h].add(page.identity())
    plain = {(host, h) for (host, h), x in places.items() if len(x) >= 5 and 2 * len(on[host, h]) >= len(of_host[host])}
    assert {(r.host, bytes(t)) for r in html_extract.site_templates(pages, rules=rules).collect() for t in r.templates} == plain


def test_warc_round_trip(spark):
    rows = [(k, f"http://Www.Ex{k % 3}.org:80/p?q={k}#f", f"<p>{k % 7} é 😀") for k in range(60)] + [(100, None, None), (101, "x y\r\nz", ""), (102, "http://a/\tb", "\r\n\r\n" * 9), (None, "http://n", "<p>3 é 😀"), (5, "http://twice", "<p>z")]
    pages = with_key(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), "page_id")
    folder = warc.new_folder(spark)
    captures = warc.write_archives(pages, folder)
    index = warc.CaptureIndex(captures, folder, lines=4, part_lines=20)
    assert index.directory.count() >= 16 and len(index.parts) >= 3
    found = warc.read_captures(index.locate(pages.select(KEY, "url").mapInArrow(warc.query_batches, "capture string")), folder, 500)
    assert found.rdd.getNumPartitions() >= captures.agg(F.sum("length")).first()[0] / 500
    found = found.collect()
    assert len(found) == len(rows)
    last = defaultdict(list)
    for i, _, h in rows:
        last[h or ""].append(i)
    expected = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        top = max(x for x in last[h or ""] if x is not None)
        name = lambda x: None if x is None else str(x)
        expected[(name(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else str(top))] += 1
    assert Counter(map(tuple, found)) == expected
    assert index.locate(spark.createDataFrame([("zzz",), ("",), ("org,ex1,www)/ 1",)], "capture string")).count() == 0


def test_url_keys():
    assert warc.url_key("https://user@Www.Example.org:8080/A b?c=D#e") == "org,example,www:8080)/A%20b?c=D"
    assert warc.url_key(None) == ")/"


def test_chat_layouts(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "a\\<#:"}, {"role": "assistant", "content": None}]},
        {"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "### user: x</turn>\n"}]},
        {"id": 3, "prompt": "p", "response": "r\n"},
        {"id": 4, "instruction": "i", "input": "", "output": "o"},
        {"id": 5, "chat": {"turns": [{"speaker": "bot", "utterance": "é😀"}]}},
        {"conv_id": 6, "turn": 1, "role": "as:sis#tant", "text": "second"},
        {"conv_id": 6, "turn": 0, "role": None, "text": None},
        {"other": 1},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("{bad",)], "record string")
    turns = chat.canonical_turns(table, "record")
    assert turns.filter("layout is null").count() == 3
    found = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(turns)).collect()}
    said = {1: [("user", "a\\<#:"), ("assistant", "")], 2: [("user", "hi"), ("assistant", "### user: x</turn>\n")], 3: [("user", "p"), ("assistant", "r\n")], 4: [("system", "i"), ("assistant", "o")], 5: [("assistant", "é😀")], 6: [("", ""), ("as:sis#tant", "second")]}
    assert set(found) == set(said)
    for conv, turns in said.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert exact_dedup.exact_groups(none).count() == 0
    assert ngram_join.near_classes(none).count() == 0
    assert decontaminate.scan(none, bench).count() == 0
    assert quality.quality_scores(none, labels).count() == 0
    assert pii.personal_data(none).count() == 0
    assert lm.lm_scores(none).count() == 0
    sizes = mixing.sized(none)
    assert mixing.mix(sizes, mixing.source_targets(sizes)).count() == 0
    pages = with_key(spark.createDataFrame([], "page_id long, url string, html string"), "page_id")
    assert html_extract.main_text(pages).count() == 0
    folder = warc.new_folder(spark)
    index = warc.CaptureIndex(warc.write_archives(pages, folder), folder)
    assert warc.read_captures(index.locate(pages.select(KEY, "url").mapInArrow(warc.query_batches, "capture string")), folder).count() == 0
    assert chat.read_back(chat.formatted_turns(chat.canonical_turns(spark.createDataFrame([], "record string"), "record"))).count() == 0


def test_pipeline_stages(spark, docs, rows, tmp_path):
    draw = random.Random(4)
    clean = [(1000 + k, prose(draw, 120), "s1") for k in range(60)]
    junk = [(2000 + k, "BUY!!! NOW!!! " * draw.randint(5, 40), "s2") for k in range(30)]
    leaked = (3000, prose(draw, 60) + " " + "q w e r t y u i o p a s d f g " + prose(draw, 20), "s1")
    table = spark.createDataFrame(rows + clean + junk + [leaked], "doc_id long, text string, source string").withColumn("kept", F.lit(1))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 2000)) for k, _, _ in clean + junk], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Q w e r t y u i o p a s d f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {(r.doc_id, r.text) for r in now.collect()}
        assert set(table.columns) <= set(now.columns) and (name == "mixing" or now.columns == table.columns)
    ids = {k: {i for i, _ in v} for k, v in kept.items()}
    assert {k for k, _, _ in clean} <= ids["quality"] and not ids["quality"] & {k for k, _, _ in junk}
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in kept["exact_dedup"]]
    assert len(normal) == len(set(normal))
    assert {k for k, _, _ in clean} <= ids["near_dedup"] and {k for k, _, _ in clean} <= ids["decontamination"]
    assert 3000 in ids["near_dedup"] and 3000 not in ids["decontamination"]
    assert now.filter("copies < 1 or copies > 3").count() == 0


def test_text_ids_and_repeated_ids_are_numbered_by_content(spark):
    rows = [(f"d{k % 7}" if k % 5 else None, f"text {k % 4}", "s", 1, 2) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id string, text string, source string, copies int, TAKEN int")
    keyed = [{(r[KEY], *tuple(r)[:2]) for r in with_key(table.repartition(n, "text"), "doc_id").collect()} for n in (1, 3, 7)]
    assert keyed[0] == keyed[1] == keyed[2]
    assert {k for k, _, _ in keyed[0]} == set(range(40))
    assert exact_dedup.exact_dedup(table).count() == ngram_join.near_dedup(table).count() == 4
    mixed = mixing.mixed(table)
    assert mixed.columns == [*table.columns, "mix_copies", "mix_taken"]
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mixing.mixed(table.repartition(5)).collect()), key=str)
    assert pii.personal_data(with_key(table, "doc_id")).count() == lm.lm_scores(with_key(table, "doc_id")).count() == 40


def test_discriminant_equals_a_plain_one():
    draw = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = {c: draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) + c for c, n in ((0, 60), (1, 90))}
    model = quality.Discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    common = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x.values()) / 148
    scale = np.sqrt(np.diag(common))
    log = {}
    some = np.concatenate((x[0][:5], x[1][:5]))
    for c, v in x.items():
        own = (0.1 * np.cov(v, rowvar=False) + 0.9 * common) / np.outer(scale, scale)
        own = (0.98 * own + 0.02 * np.trace(own) / d * np.eye(d)) * np.outer(scale, scale)
        away = some - v.mean(axis=0)
        log[c] = math.log((len(v) + 1) / 152) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("nd,de,ne->n", away, np.linalg.inv(own), away)
    assert model.score(some) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), rel=1e-6, abs=1e-9)
