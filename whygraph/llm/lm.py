"""Language-model scoring: a log-bilinear neural model, trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable as written
from .common import KEY, spread, table, with_key
from .words import NOT_SPACE, U, by_pieces, slices, span_hashes, word_spans

#: Words with a vector and a probability of their own: those that occur LEAST times, the most frequent first.
FREQUENT, LEAST = 1 << 16, 5
#: Words whose counts are broadcast, most frequent first; those of other words are joined in the cluster.
COUNTED = 1 << 18
#: Words without a vector are in bins by their form: kinds of letters, and classes of length.
KINDS, LENGTHS = 4, 8
BINS = KINDS * LENGTHS
#: Size of a vector, and words of context.
WIDTH, CONTEXT = 16, 2
#: Noise classes a step, noise words a step and class, tokens a step, step size.
NOISE, CLASS_NOISE, STEP, RATE = 32, 16, 1 << 16, 0.15
#: Rounds of training; each one learns from every ROUNDS-th token of all training texts, all rounds from every token once.
ROUNDS = 2
#: Tokens of a shard, which is learned from in one piece; the number of shards follows from the table alone.
SHARD = 1 << 21
#: Tokens that are scored at a time.
RUN = 1 << 17
#: Trained parameters come in blocks of this many rows, and of so many tasks at a time.
ROWS, FAN_IN = 2048, 64

END = np.uint64(0x5851F42D4C957F2D)


def token_batch(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): hash `h` and `form` of the words of texts between ASCII white space, A-Z lowered."""
    buf, starts, ends, bounds = word_spans(texts, NOT_SPACE)
    out = np.empty(len(starts), [("h", U), ("form", np.int32)])
    out["h"] = span_hashes(buf, starts, ends)
    size = ends - starts
    held = lambda inside: np.diff(np.concatenate(([0], np.cumsum(inside)))[np.stack((starts, ends))], axis=0)[0] > 0
    letters, digits, high = (buf >= 0x61) & (buf <= 0x7A), (buf >= 0x30) & (buf <= 0x39), buf >= 0x80
    kind = np.where(held(digits), 3, np.where(held(~(letters | high)), 2, np.where(held(high), 1, 0)))
    out["form"] = kind * LENGTHS + np.minimum((size - 1) // 2, LENGTHS - 1)
    return out, bounds


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, forms, bounds) of the tokens of texts: their words, then an end, whose form is -1."""
    words, bounds = by_pieces(texts, NOT_SPACE, token_batch)
    ends = bounds[1:] + np.arange(len(texts))
    h, form = np.full(len(words) + len(texts), END, U), np.full(len(words) + len(texts), -1, np.int32)
    inside = np.ones(len(h), bool)
    inside[ends] = False
    h[inside], form[inside] = words["h"], words["form"]
    return h, form, bounds + np.arange(len(texts) + 1)


def count_batches(batches):
    """A mapInArrow function over (text as bytes) that gives (h, form, c): counts of its tokens."""
    held, n = [], 0

    def merged():
        h, form, c = (np.concatenate(x) for x in zip(*held))
        found, first, at = np.unique(h, return_index=True, return_inverse=True)
        held.clear()
        return found, form[first], np.bincount(at, c).astype(np.int64)

    def batch(h, form, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(form), pa.array(c)], ["h", "form", "c"])

    for b in batches:
        for _, _, texts in slices(b.column(0)):
            h, form, _ = tokens(texts)
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((h, form[first], c))
            n += len(h)
            if n > 3_000_000:
                found = merged()
                n = 0
                if len(found[0]) > 1_000_000:
                    yield batch(*found)
                else:
                    held.append(found)
                    n = len(found[0])
    if held:
        yield batch(*merged())


@dataclass
class Vocabulary:
    """The model's symbols: 0 is the end, 1 to BINS the bins, then the words of their own by frequency.

    `more` are the sorted hashes of words without a symbol whose counts are known, too.

    `hashes` are those words' in order, with their `symbols`; `counts` has a count for each symbol. The
    symbols are leaves of a tree: the end and each bin are a class of one, the word of rank r is in class
    floor(sqrt(r)) of the others, so frequent words are in small classes and the classes grow with the
    vocabulary as its square root.
    """

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    bin_distinct: np.ndarray
    more: np.ndarray
    more_counts: np.ndarray

    def __post_init__(self):
        self.words = len(self.hashes)
        self.classes = 1 + BINS + math.ceil(math.sqrt(self.words))

    def find(self, h: np.ndarray, form: np.ndarray) -> np.ndarray:
        """The symbol of each token."""
        other = form + 1
        if not self.words:
            return other
        at = np.minimum(np.searchsorted(self.hashes, h), self.words - 1)
        return np.where(self.hashes[at] == h, self.symbols[at], other)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Add-one shares of the classes, and of the words in their class, for noise and to start from."""
        by_class = np.bincount(class_of(np.arange(len(self.counts))), self.counts, minlength=self.classes)
        words, of = self.counts[1 + BINS :] + 1.0, class_of(np.arange(1 + BINS, len(self.counts)))
        return (by_class + 1) / (by_class + 1).sum(), words / np.bincount(of, words, minlength=self.classes)[of]


def class_of(symbols: np.ndarray) -> np.ndarray:
    """The class of each symbol."""
    return np.where(symbols <= BINS, symbols, 1 + BINS + np.sqrt(np.maximum(symbols - 1 - BINS, 0)).astype(np.int64))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, least: int = LEAST, counted: int = COUNTED) -> Vocabulary:
    """The Vocabulary of `counts` (h, form, c).

    The words are those above a least count, or level of counts beyond 4,096, that at most `counted` words
    reach, and as many of the next level as there is room for, in the order of count and hash; no task has
    to sort them all. The driver gets these, one row a level and one row a bin.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.filter(F.col("form") >= 0).withColumn("level", F.when(F.col("c") < 4096, F.col("c")).otherwise(4000 + F.floor(8 * F.log2("c"))))
    room, lowest, parted = max(frequent, counted), 1 << 40, None
    for level, n in sorted(words.groupBy("level").count().collect(), reverse=True):
        if n > room:
            parted = level
            break
        room, lowest = room - n, level
    top = words.filter(F.col("level") >= lowest)
    if parted is not None and room:
        top = top.unionByName(words.filter(F.col("level") == parted).orderBy(F.desc("c"), "h").limit(room))
    top = top.select("h", "c", "form").toArrow()
    h, c, form = top.column("h").to_numpy().view(U), top.column("c").to_numpy(), top.column("form").to_numpy()
    order = np.lexsort((h.view(np.int64), -c))
    h, c, form = h[order], c[order], form[order]
    n = min(frequent, int((c >= least).sum()))
    (h, more), (c, more_counts), form = np.split(h, [n]), np.split(c, [n]), form[:n]
    held, kinds = np.zeros(1 + BINS, np.int64), np.zeros(1 + BINS, np.int64)
    for r in counts.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        held[r.form + 1], kinds[r.form + 1] = r.c, r.n
    held[1:] -= np.bincount(form, c, minlength=BINS).astype(np.int64)
    kinds[1:] -= np.bincount(form, minlength=BINS)
    order, others = np.argsort(h), np.argsort(more)
    return Vocabulary(h[order], (1 + BINS + order).astype(np.int64), np.concatenate((held, c)), total, distinct, kinds[1:], more[others], more_counts[others])


class Rooms:
    """Memory that is used again for the large intermediate results of each step."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, width: int) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows * width:
            self.held[name] = np.empty(rows * width, np.float32)
        return self.held[name][: rows * width].reshape(rows, width)


def added(rows: np.ndarray, values: np.ndarray, room: Rooms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values, how often each occurs)."""
    order = np.argsort(rows)
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    values = np.take(values, order, axis=0, out=room("ordered", *values.shape), mode="clip")
    return ordered[first], np.add.reduceat(values, first, axis=0), np.diff(np.append(first, len(rows)))


def told_apart(scores: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(scores)), in place."""
    with np.errstate(over="ignore"):
        np.exp(scores, out=scores)
        scores += 1
        return np.divide(np.float32(1), scores, out=scores)


class LogBilinear:
    """P(w | v1, v2) = P(class of w | v1, v2) P(w | its class, v1, v2), v1 being the symbol before w.

    Each factor is a softmax over scores that are linear in the guess g = (r_v1 A1 + r_v2 A2, 1): t_c . g
    for the classes, q_w . g for the words of a class. A symbol alone in its class has the second factor 1.
    Both factors are trained by noise-contrastive estimation with Adagrad.
    """

    NAMES = ("r", "q", "t", "a")

    def __init__(self, vocab: Vocabulary, width: int = WIDTH, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.words, self.classes, self.width = vocab.words, vocab.classes, width
        self.class_share, self.word_share = vocab.shares()
        self.log_class, self.log_word = np.log(self.class_share).astype(np.float32), np.log(self.word_share).astype(np.float32)
        normal = lambda n, scale: (draw.standard_normal((n, width)) * scale).astype(np.float32)
        self.r = normal(1 + BINS + self.words, 0.3)
        self.q = np.column_stack((normal(self.words, 0.05), self.log_word))
        self.t = np.column_stack((normal(self.classes, 0.05), self.log_class))
        self.a = np.concatenate([np.eye(width, dtype=np.float32) / (i + 1) for i in range(CONTEXT)])

    def ranks(self, ordered: np.ndarray):
        """(first rank, last rank, first place, last place) of the classes of words in `ordered` symbols."""
        edges = np.square(np.arange(self.classes - BINS))
        places = np.searchsorted(ordered, 1 + BINS + edges)
        for k in np.flatnonzero(np.diff(places)):
            yield int(edges[k]), min(int(edges[k + 1]), self.words), int(places[k]), int(places[k + 1])

    def start(self, seed: int, rate: float = RATE) -> None:
        """Begins a task's training: `touched` counts how often each row of each part has learned."""
        self.squares = {n: np.ones_like(getattr(self, n)) for n in self.NAMES}
        self.touched = {n: np.zeros(len(getattr(self, n)), np.float32) for n in self.NAMES}
        self.draw, self.rate, self.room = np.random.default_rng(seed), rate, Rooms()
        self.class_sums, self.word_sums = np.cumsum(self.class_share), np.cumsum(self.word_share)

    def move(self, name: str, rows, slope: np.ndarray, times) -> None:
        """One Adagrad step of some rows (or all) of a part."""
        squares = self.squares[name][rows] + slope * slope
        self.squares[name][rows] = squares
        getattr(self, name)[rows] += self.rate * slope / np.sqrt(squares)
        self.touched[name][rows] += times

    def learn(self, w: np.ndarray, before: list[np.ndarray]) -> None:
        """One step of noise-contrastive estimation, with noise shared by the step's tokens of a class.

        Its slopes are of the log odds by which a real symbol or class is told from the noise; the logarithm
        of the expected noise is taken off the last column of the vectors, which meets the guess's 1.
        """
        order = np.argsort(w)
        w, before, width, room, n = w[order], [v[order] for v in before], self.width, self.room, len(w)
        wide, places = width + 1, [slice(i * width, (i + 1) * width) for i in range(CONTEXT)]
        vectors = [np.take(self.r, v, axis=0, out=room(f"vectors {i}", n, width), mode="clip") for i, v in enumerate(before)]
        guess, back = room("guess", n, wide), room("back", n, wide)
        guess[:, width] = 1
        np.matmul(vectors[0], self.a[places[0]], out=guess[:, :width])
        for x, a in zip(vectors[1:], places[1:], strict=True):
            guess[:, :width] += np.matmul(x, self.a[a], out=room("turned", n, width))

        c = class_of(w)
        noise = np.minimum(np.searchsorted(self.class_sums, self.draw.random(NOISE) * self.class_sums[-1]), self.classes - 1)
        own, other = np.take(self.t, c, axis=0, out=room("own", n, wide), mode="clip"), self.t[noise]
        up = told_apart(np.einsum("td,td->t", guess, own) - (self.log_class[c] + math.log(NOISE)))[:, None]
        less = other.copy()
        less[:, width] -= self.log_class[noise] + math.log(NOISE)
        down = told_apart(np.matmul(guess, -less.T, out=room("down", n, NOISE)))
        slopes = room("slopes", n + NOISE, wide)
        np.multiply(up, guess, out=slopes[:n])
        np.matmul(-down.T, guess, out=slopes[n:])
        np.multiply(up, own, out=back)
        back -= np.matmul(down, other, out=room("own", n, wide))
        self.move("t", *added(np.concatenate((c, noise)), slopes, room))

        groups = list(self.ranks(w))
        if groups:
            begin = groups[0][2]
            ranks, g, n_own, some = w[begin:] - (1 + BINS), guess[begin:], n - begin, len(groups)
            # `word_sums` grows by 1 from class to class.
            draws = np.array([math.isqrt(first) for first, *_ in groups])[:, None] + self.draw.random((some, CLASS_NOISE))
            firsts, lasts = (np.array([x[i] for x in groups])[:, None] for i in (0, 1))
            noise = np.clip(np.searchsorted(self.word_sums, draws), firsts, lasts - 1)
            own, other = np.take(self.q, ranks, axis=0, out=room("own", n_own, wide), mode="clip"), self.q[noise]
            up = told_apart(np.einsum("td,td->t", g, own) - (self.log_word[ranks] + math.log(CLASS_NOISE)))[:, None]
            less = -other
            less[:, :, width] += self.log_word[noise] + math.log(CLASS_NOISE)
            down, slopes = room("down", n_own, CLASS_NOISE), room("slopes", n_own + noise.size, wide)
            for k, (_, _, lo, hi) in enumerate(groups):
                np.matmul(guess[lo:hi], less[k].T, out=down[lo - begin : hi - begin])
            down = told_apart(down)
            np.multiply(up, g, out=slopes[:n_own])
            for k, (_, _, lo, hi) in enumerate(groups):
                mine = down[lo - begin : hi - begin]
                np.matmul(mine.T, guess[lo:hi], out=slopes[n_own + k * CLASS_NOISE : n_own + (k + 1) * CLASS_NOISE])
                back[lo:hi] -= mine @ other[k]
            np.negative(slopes[n_own:], out=slopes[n_own:])
            own *= up
            back[begin:] += own
            self.move("q", *added(np.concatenate((ranks, noise.ravel())), slopes, room))

        slope, slopes = np.empty_like(self.a), room("slopes", n * CONTEXT, width)
        back = np.ascontiguousarray(back[:, :width])
        for i, (x, a) in enumerate(zip(vectors, places, strict=True)):
            np.matmul(x.T, back, out=slope[a])
            np.matmul(back, self.a[a].T, out=slopes[i * n : (i + 1) * n])
        self.move("r", *added(np.concatenate(before), slopes, room))
        self.move("a", slice(None), slope, 1.0)

    def prepared(self) -> None:
        """Makes what scoring uses: the vectors of all symbols in each place of the context."""
        self.by_place, self.room = [], Rooms()
        for i in range(CONTEXT):
            moved = np.full((len(self.r), self.width + 1), 1.0 / CONTEXT, np.float32)
            moved[:, :-1] = self.r @ self.a[i * self.width : (i + 1) * self.width]
            self.by_place.append(moved)

    def log_probability(self, w: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of symbols, by products of matrices."""
        out = np.empty(len(w), np.float32)
        for i in range(0, len(w), RUN):
            part = slice(i, i + RUN)
            out[part] = self._log_probability(w[part], [v[part] for v in before])
        return out

    def _log_probability(self, w: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        order, wide = np.argsort(w), self.width + 1
        ordered, room = w[order], self.room
        guess = np.take(self.by_place[0], before[0][order], axis=0, out=room("guess", len(w), wide), mode="clip")
        for x, v in zip(self.by_place[1:], before[1:], strict=True):
            guess += np.take(x, v[order], axis=0, out=room("own", len(w), wide), mode="clip")
        own = np.take(self.t, class_of(ordered), axis=0, out=room("own", len(w), wide), mode="clip")
        out = np.einsum("td,td->t", guess, own)
        # The sum over classes hangs on the context alone, and contexts recur.
        context = before[0][order].astype(np.int64)
        for v in before[1:]:
            context = context * len(self.r) + v[order]
        _, first, same = np.unique(context, return_index=True, return_inverse=True)
        whole = np.zeros(len(first), np.float32)
        self.normalise(whole, np.take(guess, first, axis=0, out=room("contexts", len(first), wide), mode="clip"), self.t)
        out += whole[same]
        groups = list(self.ranks(ordered))
        if groups:
            begin = groups[0][2]
            own = np.take(self.q, ordered[begin:] - (1 + BINS), axis=0, out=room("own", len(w) - begin, wide), mode="clip")
            out[begin:] += np.einsum("td,td->t", guess[begin:], own)
        for first, last, begin, end in groups:
            self.normalise(out[begin:end], guess[begin:end], self.q[first:last])
        back = np.empty_like(out)
        back[order] = out
        return back

    def normalise(self, out: np.ndarray, guess: np.ndarray, vectors: np.ndarray, rows: int = 512) -> None:
        """Takes from `out` the logarithm of the sum over `vectors` of the exponential of their product with each guess."""
        ones, turned = np.ones(len(vectors), np.float32), np.ascontiguousarray(vectors.T)
        for lo in range(0, len(guess), rows):
            g = guess[lo : lo + rows]
            scores = np.matmul(g, turned, out=self.room("scores", len(g), len(vectors)))
            with np.errstate(over="ignore", divide="ignore"):
                total = np.log(np.exp(scores, out=scores) @ ones)
            if not np.isfinite(total).all():
                scores = np.matmul(g, turned, out=scores)
                top = scores.max(axis=1)
                total = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
            out[lo : lo + rows] -= total


def contexts(symbols: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The last and the last but one symbol before each; before a text stands an end."""
    place = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for back in range(1, CONTEXT + 1):
        shifted = np.zeros(len(symbols), symbols.dtype)
        shifted[back:] = symbols[:-back] if len(symbols) > back else symbols[:0]
        out.append(np.where(place >= back, shifted, 0))
    return out


def runs(column: pa.Array, most: int = RUN):
    """(first, end, symbols, bounds) of runs of about `most` symbols of an Arrow list column, at least one row each."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, end, values[offsets[begin] : offsets[end]].astype(np.int64), offsets[begin : end + 1] - offsets[begin]
        begin = end


LEARNED = "part string, block int, task int, rows array<int>, weights array<float>, sums array<float>"


def learned_batch(part: str, block: int, task: int, rows: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([block], pa.int32()), pa.array([task], pa.int32()), one(rows, pa.int32()), one(weights, pa.float32()), one(sums.ravel(), pa.float32())],
        ["part", "block", "task", "rows", "weights", "sums"],
    )


def train_batches(shared, given, turn: int):
    """A mapInArrow function over (shard, symbols), sorted by shard, that gives LEARNED: what moved in each shard, weighted.

    What a shard learns, and in which steps, depends on its texts and their order only, not on how rows are
    dealt to tasks and batches: a text's tokens of the round are those at every ROUNDS-th place in it.
    """

    def train(batches):
        model, shard = LogBilinear(shared.value), None
        pool: list[list[np.ndarray]] = []
        held = 0

        def ended():
            if pool:
                learn_from(model, pool)
            for n in model.NAMES:
                for first in range(0, len(model.touched[n]), ROWS):
                    rows = first + np.flatnonzero(model.touched[n][first : first + ROWS])
                    if len(rows):
                        weights = model.touched[n][rows]
                        yield learned_batch(n, first // ROWS, shard, rows, weights, (getattr(model, n)[rows] - given.value[n][rows]) * weights[:, None])

        for batch in batches:
            of, texts = batch.column(0).to_numpy(), batch.column(1)
            offsets, values = texts.offsets.to_numpy(), texts.values.to_numpy()
            begin = 0
            while begin < len(of):
                if of[begin] != shard:
                    if shard is not None:
                        yield from ended()
                    shard, held = int(of[begin]), 0
                    for n, x in given.value.items():
                        getattr(model, n)[...] = x
                    model.start(turn * 1_000_003 + shard, RATE / (1 + turn))
                last = int(np.searchsorted(of, shard, side="right"))
                end = min(last, max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 2 * STEP * ROUNDS - held))))
                w, bounds = values[offsets[begin] : offsets[end]].astype(np.int64), offsets[begin : end + 1] - offsets[begin]
                some = (np.arange(len(w)) - np.repeat(bounds[:-1], np.diff(bounds))) % ROUNDS == turn
                pool.append([x[some] for x in (w, *contexts(w, bounds))])
                held += len(w)
                if held >= 2 * STEP * ROUNDS:
                    learn_from(model, pool)
                    held = 0
                begin = end
        if shard is not None:
            yield from ended()

    return train


def learn_from(model: LogBilinear, pool: list[list[np.ndarray]]) -> int:
    """Learns from the pooled tokens in steps, mixed; empties the pool and returns their number."""
    w, *before = map(np.concatenate, zip(*pool))
    pool.clear()
    order = model.draw.permutation(len(w))
    for i in range(0, len(w), STEP):
        pick = order[i : i + STEP]
        model.learn(w[pick], [v[pick] for v in before])
    return len(w)


def summed(frames: pd.DataFrame) -> pd.DataFrame:
    """The LEARNED row that is the sum of some shards' rows of one block, in their order."""
    frames = frames.sort_values("task", ignore_index=True)
    rows = np.concatenate(frames["rows"].tolist())
    weights, sums = np.concatenate(frames["weights"].tolist()), np.concatenate(frames["sums"].tolist()).reshape(len(rows), -1)
    rows, both, _ = added(rows, np.column_stack((weights, sums)).astype(np.float32), Rooms())
    one = frames.iloc[0]
    return pd.DataFrame([{"part": one["part"], "block": one["block"], "task": one["task"] // FAN_IN, "rows": rows, "weights": both[:, 0], "sums": both[:, 1:].ravel()}])


def trained(texts: DataFrame, vocab: Vocabulary, shard_tokens: int = SHARD) -> LogBilinear:
    """A model learned from `texts` (KEY, symbols).

    Texts are dealt to shards of about `shard_tokens` tokens by a hash of their key; a task learns from one
    or more shards. In each round every shard starts from the same parameters and learns from its texts in
    the order of their keys, in half as long steps in the second round as in the first. Each row of
    parameters then moves by the mean of its moves, weighted by how often it learned, so that a rare word,
    seen by few shards, learns in full. The means are summed in a tree of FAN_IN shards a node; the driver
    gets one set of parameters a round.
    """
    context, model = texts.sparkSession.sparkContext, LogBilinear(vocab)
    shared = context.broadcast(vocab)
    shards = max(1, math.ceil(vocab.total / shard_tokens))
    dealt = texts.select(F.pmod(F.xxhash64(KEY), F.lit(shards)).cast("int").alias("shard"), "symbols", KEY).repartition(shards, "shard").sortWithinPartitions("shard", KEY)
    for turn in range(ROUNDS):
        given = context.broadcast({n: getattr(model, n) for n in model.NAMES})
        moves, left = dealt.select("shard", "symbols").mapInArrow(train_batches(shared, given, turn), LEARNED), shards
        while left:
            moves = moves.groupBy("part", "block", F.floor(F.col("task") / FAN_IN)).applyInPandas(summed, LEARNED)
            left = (left - 1) // FAN_IN
        for r in moves.select("part", "rows", "weights", "sums").toArrow().to_pylist():
            rows = np.array(r["rows"])
            getattr(model, r["part"])[rows] += np.array(r["sums"], np.float32).reshape(len(rows), -1) / np.array(r["weights"], np.float32)[:, None]
        given.unpersist()
    return model


ENCODED = f"{KEY} long, symbols array<int>, more long, more_log double, rare array<bigint>, times array<int>"


def encode_batches(shared):
    """A mapInArrow function over (KEY, text as bytes, others) that gives ENCODED and the others.

    Of the words in bins, `more` have a known count, and `more_log` is the sum of the log10 of these plus
    one; `rare` are the hashes of the others, `times` how often each occurs.
    """

    def encode(batches):
        vocab = shared.value
        log = np.log10(vocab.more_counts + 1.0)
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                h, form, bounds = tokens(texts)
                w = vocab.find(h, form)
                binned = (w > 0) & (w <= BINS)
                rare, of = h[binned], np.repeat(np.arange(hi - lo), np.diff(bounds))[binned]
                at = np.minimum(np.searchsorted(vocab.more, rare), max(0, len(vocab.more) - 1))
                known = vocab.more[at] == rare if len(vocab.more) else np.zeros(len(rare), bool)
                more, more_log = np.bincount(of[known], minlength=hi - lo), np.bincount(of[known], log[at[known]], minlength=hi - lo)
                rare, of = rare[~known], of[~known]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])))) if len(rare) else np.zeros(0, np.int64)
                at = np.searchsorted(of[first], np.arange(hi - lo + 1))
                lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                rows = [lists(bounds, w.astype(np.int32)), pa.array(more), pa.array(more_log.astype(float)), lists(at, rare[first].view(np.int64)), lists(at, np.diff(np.append(first, len(rare))).astype(np.int32))]
                some = [c.slice(lo, hi - lo) for c in (batch.column(0), *batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([some[0], *rows, *some[1:]], [KEY, "symbols", "more", "more_log", "rare", "times", *batch.schema.names[2:]])

    return encode


SCORED = f"{KEY} long, n_tokens long, frequent long, log_counts double, log_model double"


def score_batches(shared, model):
    """A mapInArrow function over (KEY, symbols, others) that gives SCORED and the others.

    `frequent` and `log_counts` are the number of tokens with a symbol of their own and the sum of the
    log10 of their counts plus one; `log_model` is the log10 probability of the symbols, less, for each
    word in a bin, the log10 of the bin's add-one total.
    """

    def score(batches):
        vocab, lm = shared.value, model.value
        lm.prepared()
        own = np.concatenate(([1], np.zeros(BINS, np.int64), np.ones(vocab.words, np.int64)))
        log = own * np.log10(vocab.counts + 1.0)
        within = np.zeros(len(own))
        within[1 : 1 + BINS] = np.log10(vocab.counts[1 : 1 + BINS] + vocab.bin_distinct + 1)
        for batch in batches:
            for lo, hi, w, bounds in runs(batch.column(1)):
                total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: B023, E731
                found = lm.log_probability(w, contexts(w, bounds)).astype(float) / math.log(10) - within[w]
                rows = [np.diff(bounds).astype(np.int64), total(own[w]), total(log[w]), total(found)]
                some = [c.slice(lo, hi - lo) for c in (batch.column(0), *batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([some[0], *map(pa.array, rows), *some[1:]], [KEY, "n_tokens", "frequent", "log_counts", "log_model", *batch.schema.names[2:]])

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, least: int = LEAST, counted: int = COUNTED) -> DataFrame:
    """KEY, id, held_out, n_tokens, n_known, train_tokens, base_score, score of `docs` (with KEY).

    A text's tokens are its words (null: none) and one end. Held out are the rows whose id as text has a
    CRC-32 that leaves 2 when divided by 7; all others, null ids too, are learned from. With no training
    rows every token is unknown, and the model is the one it starts from.

    base_score is the log10 probability under add-one counts. score is that of the log-bilinear model, to
    which all tokens go: those of their own words as such, all others as the bin of their form, in which a
    word has its own add-one probability. Both are sums over all tokens. Texts are cut into words twice, to
    count and to encode; training and scoring read the encoded texts. Counts of the frequent words are
    broadcast; those of other words are joined by hash.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    text = F.col(text_col).cast("binary").alias("text")
    counts = docs.filter(~held).select(text).mapInArrow(count_batches, "h bigint, form int, c bigint")
    counts = written(counts.groupBy("h").agg(F.first("form").alias("form"), F.sum("c").alias("c")))
    vocab = vocabulary(counts, frequent, least, counted)
    shared = spark.sparkContext.broadcast(vocab)
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = docs.select(KEY, text, F.col(id_col).alias("id"), held.alias("held_out")).mapInArrow(encode_batches(shared), f"{ENCODED}, id {kind}, held_out boolean")
    encoded = written(encoded)
    model = spark.sparkContext.broadcast(trained(encoded.filter("not held_out").select(KEY, "symbols"), vocab))
    rare = encoded.select(KEY, F.explode(F.arrays_zip("rare", "times")).alias("word")).select(KEY, F.col("word.rare").alias("h"), F.col("word.times").alias("n"))
    seen = rare.join(counts.select("h", "c"), "h").groupBy(KEY).agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    scored = encoded.select(KEY, "symbols", "more", "more_log", "id", "held_out").mapInArrow(score_batches(shared, model), f"{SCORED}, more long, more_log double, id {kind}, held_out boolean")
    rows = scored.join(seen, KEY, "left")
    rare_log = F.col("more_log") + F.coalesce("rare_log", F.lit(0.0))
    base = F.col("log_counts") + rare_log - F.col("n_tokens") * F.lit(math.log10(vocab.total + vocab.distinct + 1))
    known = (F.col("frequent") + F.col("more") + F.coalesce("rare_known", F.lit(0))).alias("n_known")
    return rows.select(KEY, "id", "held_out", "n_tokens", known, F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_model") + rare_log).alias("score"))


def op10_lm_scoring(spark, sf_dir):
    """Every document's base and model score, learned from the documents that are not held out."""
    docs = spread(with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    return lm_scores(docs).select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
