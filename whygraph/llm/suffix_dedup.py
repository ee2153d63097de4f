"""Substring deduplication by a distributed sort of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Suffixes are
kept sparse: of every 35 adjacent 16-byte grams, those with the smallest hash start a suffix, so each
50-byte string has one at the same place wherever it occurs. A suffix goes with the 34 bytes before it,
so that all strings with it inside can be compared at its side. Suffixes whose gram no other document has
can't be part of a repeated string and are left at home.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import KEY, durable, small, table, with_key

#: Bytes of a repeated string, and of the gram that a suffix starts with.
STRING, GRAM = 50, 16
#: Grams of a string, and bytes that go along before a suffix.
SPAN = STRING - GRAM + 1
LEFT = SPAN - 1
WIDE = LEFT + STRING
#: Positions that are hashed at a time, bytes of texts that are taken together, contexts that are compared at once.
SLICE, PIECE, TOGETHER = 1 << 15, 1 << 23, 1 << 16
#: Bits of a gram's hash that go along beside its bucket's; equal ones only cost a comparison.
KEPT_BITS = 40
#: Grams of a bucket; buckets at least, so that small tables keep the cores busy, and at most (as bits).
BUCKET_GRAMS, LEAST_BITS, MOST_BITS = 1 << 19, 7, 17
#: Suffixes of a sorted bucket, ranges that are cut by sampled splitters at most, documents of the sample.
BUCKET_SUFFIXES, RANGES, SAMPLED = 1 << 16, 4096, 4096
#: Documents that share a gram from which on its strings are compared by grouping instead of in one bucket.
HOT = 1 << 16

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: bytes, start: int, end: int) -> np.ndarray:
    """64-bit hashes of the grams that start in [start, end)."""
    words = np.ndarray((end - start + 8,), dtype="<u8", buffer=data, offset=start, strides=(1,)).astype(np.uint64)
    return mixed(words[:-8] * A + words[8:] * B)


def sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """The `best` (minimum or maximum) of every `width` adjacent values."""
    have = 1
    while 2 * have <= width:
        values, have = best(values[:-have], values[have:]), 2 * have
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def sampled(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that have the smallest hash of some SPAN adjacent ones.

    `data` is one document after another, each up to one of `ends`; no gram of a string is in two of them.
    """
    grams = len(data) - GRAM + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(0, grams if grams >= SPAN else 0, SLICE):
        first, last = max(0, start - LEFT), min(grams, start + SLICE + LEFT)
        h = gram_hashes(data, first, last)
        if len(h) < SPAN:
            first, h = max(0, last - SPAN - LEFT), gram_hashes(data, max(0, last - SPAN - LEFT), last)
        smallest = np.zeros(len(h) + LEFT, np.uint64)
        smallest[LEFT : len(h)] = sliding(np.minimum, h, SPAN)
        for e in ends[np.searchsorted(ends, first, side="right") : np.searchsorted(ends, last + STRING)] - first:
            smallest[max(LEFT, e - STRING + 1 + LEFT) : e + LEFT] = 0
        chosen = np.flatnonzero(sliding(np.maximum, smallest, SPAN) == h)
        chosen = chosen[(chosen + first >= start) & (chosen + first < start + SLICE)]
        places.append(chosen + first)
        hashes.append(h[chosen])
    return np.concatenate(places), np.concatenate(hashes)


def first_of(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def ends_of(begun: np.ndarray, n: int) -> np.ndarray:
    """Where runs that begin at `begun` end, of `n` values."""
    return np.append(begun[1:], n)[: len(begun)]


def short(values: np.ndarray) -> bytes:
    """Integers of KEPT_BITS bits, five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // KEPT_BITS, 8), np.uint8)
    out[:, : KEPT_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BITS // 8)
    return out.view("<u8").ravel().astype(np.uint64)


def gram_entries(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Which documents have which grams: packed rows, one a chunk of documents and bucket of hashes.

    `h` and `i` (a place in `keys`) have one document a gram, `mh` and `mi` all documents of the grams that
    several documents of the chunk share, so a gram in very many documents is passed on once a chunk.
    """
    for rows in batches:
        texts, keys = rows["bytes"].tolist(), rows[KEY].to_numpy(np.int64)
        for part in pieces(texts, PIECE):
            ends = np.cumsum([len(t) for t in texts[part]], dtype=np.int64)
            place, hashes = sampled(b"".join(texts[part]), ends)
            yield packed(hashes, np.searchsorted(ends, place, side="right"), keys[part], bits)


def pieces(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of adjacent texts of about `most` bytes or a single longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, size = i + 1, 0


def packed(hashes: np.ndarray, docs: np.ndarray, keys: np.ndarray, bits: int) -> pd.DataFrame:
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order] >> np.uint64(64 - KEPT_BITS - bits), docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[fresh], docs[fresh]
    begun = first_of(hashes)
    size = ends_of(begun, len(hashes)) - begun
    alone = np.zeros(len(hashes), bool)
    alone[begun] = True
    several = np.repeat(size > 1, size)
    bucket = (hashes >> np.uint64(KEPT_BITS)).astype(np.int64)
    cuts, mask = np.searchsorted(bucket, np.arange((1 << bits) + 1)), np.uint64((1 << KEPT_BITS) - 1)
    rows = []
    for b in np.unique(bucket):
        part = slice(cuts[b], cuts[b + 1])
        used, index = np.unique(docs[part], return_inverse=True)
        index = index.astype("<u2" if len(used) <= 1 << 16 else "<u4")
        h, one, more = hashes[part] & mask, alone[part], several[part]
        rows.append((b, keys[used].tobytes(), short(h[one]), index[one].tobytes(), short(h[more]), index[more].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "keys", "h", "i", "mh", "mi"])


def shared_grams(rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """(KEY, grams, hot): the grams of a bucket that a document shares with another one, and those of them
    that at least `hot` documents share."""
    hashes, docs, asked = [], [], []
    for keys, h, i, mh, mi in zip(rows["keys"], rows["h"], rows["i"], rows["mh"], rows["mi"], strict=True):
        keys = np.frombuffer(keys, np.int64)
        kind = "<u2" if len(keys) <= 1 << 16 else "<u4"
        for values, index, known in ((h, i, False), (mh, mi, True)):
            hashes.append(unshort(values))
            docs.append(keys[np.frombuffer(index, kind)])
            asked.append(np.full(len(hashes[-1]), not known))
    t, key, one = np.concatenate(hashes), np.concatenate(docs), np.concatenate(asked)
    order = np.lexsort((key, t))
    t, key, one = t[order], key[order], one[order]
    begun = first_of(t)
    size = ends_of(begun, len(t)) - begun
    chunks = np.add.reduceat(one.astype(np.int64), begun) if len(t) else size
    several = np.repeat((chunks > 1) | (size > chunks), size)
    many = np.repeat(size >= hot, size)
    t = t | (np.uint64(rows["bucket"].iloc[0]) << np.uint64(KEPT_BITS))
    t, key, many = t[several], key[several], many[several]
    order = np.lexsort((t, key))
    t, key, many = t[order], key[order], many[order]
    fresh = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])] if len(t) else np.zeros(0, bool)
    t, key, many = t[fresh], key[fresh], many[fresh]
    begun = first_of(key)
    ends = ends_of(begun, len(key))
    grams = [t[a:b].tobytes() for a, b in zip(begun, ends, strict=True)]
    hot_ones = [t[a:b][many[a:b]].tobytes() for a, b in zip(begun, ends, strict=True)]
    return pd.DataFrame({KEY: key[begun], "grams": grams, "hot": hot_ones})


def suffixes(batches: Iterator[pd.DataFrame], bits: int, want_hot: bool, splitters: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """Suffixes with shared grams, packed: one row a bucket and run of texts, and matches that are clear at once.

    A suffix has a context (LEFT bytes before, STRING bytes from the place on, and how many of either the
    document has), order, key, and `n` places in `data`. Equal contexts of a run of texts are compared
    here: those of the document with the smallest order stand for all, the others' strings are repeats.
    Rows without contexts hold these: `n` spans a key, their starts, then ends.
    """
    for rows in batches:
        texts = rows["bytes"].tolist()
        for part in pieces(texts, PIECE):
            some = rows.iloc[part]
            ends = np.cumsum([len(t) for t in texts[part]], dtype=np.int64)
            data = b"".join(texts[part])
            at, h = sampled(data, ends)
            doc = np.searchsorted(ends, at, side="right")
            marked = lambda t, i: mixed(t ^ mixed(i.astype(np.uint64) + A))
            lists = lambda name: [np.frombuffer(b"".join(x), np.uint64) for x in some[name]]  # noqa: B023, E731
            known = lambda found: marked(np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found]))
            own, many = marked(h >> np.uint64(64 - KEPT_BITS - bits), doc), known(lists("hot"))
            wanted = np.isin(own, many) if want_hot else np.isin(own, known(lists("grams"))) & ~np.isin(own, many)
            at, doc = at[wanted], doc[wanted]
            padded = np.zeros(len(data) + WIDE, np.uint8)
            padded[LEFT : LEFT + len(data)] = np.frombuffer(data, np.uint8)
            for start in range(0, len(at), TOGETHER):
                q, d = at[start : start + TOGETHER], doc[start : start + TOGETHER]
                begin = ends[d] - np.array([len(t) for t in texts[part]], np.int64)[d]
                context = np.empty((len(q), WIDE + 2), np.uint8)
                context[:, :WIDE] = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[q]
                before, after = np.minimum(q - begin, LEFT), np.minimum(ends[d] - q, STRING)
                edge = np.flatnonzero((before < LEFT) | (after < STRING))
                column = np.arange(WIDE)
                outside = (column < (LEFT - before[edge])[:, None]) | (column >= (LEFT + after[edge])[:, None])
                context[edge, :WIDE] = np.where(outside, 0, context[edge, :WIDE])
                context[:, WIDE], context[:, WIDE + 1] = before, after
                yield collapsed(context, some[KEY].to_numpy(np.int64)[d], some["ord"].to_numpy(np.int64)[d], q - begin, splitters, parts)


def leading(context: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffixes, as integers of the same order."""
    return np.ascontiguousarray(context[:, LEFT : LEFT + 8]).view(">u8").ravel().astype(np.uint64)


def collapsed(context: np.ndarray, key: np.ndarray, ord_: np.ndarray, place: np.ndarray, splitters: np.ndarray, parts: int) -> pd.DataFrame:
    words = np.zeros((len(context), -(-context.shape[1] // 8) * 8), np.uint8)
    words[:, : context.shape[1]] = context
    sort, depth = multikey_sorted(words)
    kind = np.empty(len(context), np.int64)
    kind[sort] = np.cumsum(depth < words.shape[1])
    order = np.lexsort((place, key, ord_, kind))
    context, key, ord_, place, kind = context[order], key[order], ord_[order], place[order], kind[order]
    begun = first_of(kind)
    repeat = ord_ > np.repeat(ord_[begun], ends_of(begun, len(kind)) - begun)
    far, near = np.maximum(0, STRING - context[:, WIDE + 1].astype(np.int64)), context[:, WIDE].astype(np.int64)
    clear = np.flatnonzero(repeat & (far <= near))
    clear = clear[np.argsort(key[clear], kind="stable")]
    heads = first_of(key[clear])
    ends = ends_of(heads, len(clear))
    groups = max(1, (len(splitters) + 1) * parts)
    rows = []
    if len(clear):
        spans = [np.stack((place[at] - near[at], place[at] + STRING - far[at])).tobytes() for at in (clear[a:b] for a, b in zip(heads, ends, strict=True))]
        owner = key[clear][heads]
        rows.append((-1 - int(owner[0]) % groups, None, None, owner.tobytes(), (ends - heads).tobytes(), b"".join(spans)))
    kept = np.flatnonzero(~repeat)
    first = first_of(np.stack((kind[kept], key[kept]), axis=1).view([("k", np.int64), ("d", np.int64)]).ravel())
    count = ends_of(first, len(kept)) - first
    one = kept[first]
    lead = leading(context[one])
    sub = mixed(mixed(lead) + np.ascontiguousarray(context[one, LEFT + 8 : LEFT + GRAM]).view("<u8").ravel()) % np.uint64(max(1, parts))
    bucket = np.searchsorted(splitters, lead, side="right") * max(1, parts) + sub.astype(np.int64)
    order = np.lexsort((lead, bucket))
    one, first, count, bucket = one[order], first[order], count[order], bucket[order]
    begun = first_of(bucket)
    for a, b in zip(begun, ends_of(begun, len(bucket)), strict=True):
        i = one[a:b]
        where = kept[gathered(first[a:b], count[a:b])]
        rows.append((int(bucket[a]), context[i].tobytes(), ord_[i].tobytes(), key[i].tobytes(), count[a:b].tobytes(), place[where].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "context", "ord", "key", "n", "data"])


def gathered(begun: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs of `count` values that begin at `begun`, one run after another."""
    return np.repeat(begun - np.cumsum(count) + count, count) + np.arange(count.sum())


def numbers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64)


def multikey_sorted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth) of rows of bytes: their sorted order, and the bytes each has in common with the one before.

    Multikey quicksort on words of eight bytes: rows are parted by one word, and only those that are still
    equal go on to the next one.
    """
    n, width = text.shape
    words = text.view(">u8").astype(np.uint64)
    order, group, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for column in range(width // 8):
        if not len(open_):
            break
        rows = order[open_]
        inner = np.lexsort((words[rows, column], group[open_]))
        order[open_] = rows = rows[inner]
        word = words[rows, column]
        parted = np.r_[True, (word[1:] != word[:-1]) | (group[open_][1:] != group[open_][:-1])]
        group[open_] = open_[parted][np.cumsum(parted) - 1]
        tied = ~parted
        tied[:-1] |= ~parted[1:]
        open_ = open_[tied]
    depth = np.zeros(n, np.int64)
    for start in range(1, n, 1 << 16):
        end = min(n, start + (1 << 16))
        unlike = text[order[start:end]] != text[order[start - 1 : end - 1]]
        depth[start:end] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return order, depth


def grown(part: np.ndarray) -> np.ndarray:
    """For each row of bytes and each length, a number that rows with equal first bytes of that length share."""
    n, width = part.shape
    text = np.zeros((n, -(-width // 8) * 8), np.uint8)
    text[:, :width] = part
    order, depth = multikey_sorted(text)
    out = np.empty((width + 1, n), np.int32)
    for length in range(width + 1):
        out[length, order] = np.cumsum(depth < length)
    return out


def compared(rows: pd.DataFrame) -> pd.DataFrame:
    """(KEY, spans): which strings of a bucket's documents also occur in one with a smaller order.

    Suffixes are sorted, and so are the bytes before them, read backwards. A string that begins `o` bytes
    before its suffix is equal to another one where both agree on `o` bytes to the left and on the rest to
    the right; of equal ones, all but those of the smallest order are repeats. Buckets part suffixes by
    whole grams, so no equal strings lie on two sides of a boundary.
    """
    if rows["bucket"].iloc[0] < 0:
        return known_spans(rows)
    ord_ = numbers(rows["ord"])
    order = np.argsort(ord_, kind="stable")
    ord_, keys = ord_[order], numbers(rows["key"])[order]
    context = np.frombuffer(b"".join(rows["context"]), np.uint8).reshape(-1, WIDE + 2)[order]
    count, data = numbers(rows["n"]), numbers(rows["data"])
    offset, count = (np.cumsum(count) - count)[order], count[order]
    before, after = context[:, WIDE], context[:, WIDE + 1]
    right, left = grown(context[:, LEFT:WIDE]), grown(context[:, LEFT - 1 :: -1])
    most, least = np.full(len(ord_), -1), np.full(len(ord_), STRING)
    for o in range(LEFT + 1):
        at = np.flatnonzero((before >= o) & (after >= STRING - o))
        if len(at) < 2:
            continue
        kind = right[STRING - o][at].astype(np.int64) * (len(ord_) + 1) + left[o][at]
        order = np.argsort(kind, kind="stable")
        at, kind = at[order], kind[order]
        begun = first_of(kind)
        repeat = at[ord_[at] > np.repeat(ord_[at[begun]], ends_of(begun, len(at)) - begun)]
        most[repeat] = o
        least[repeat] = np.minimum(least[repeat], o)
    hit = np.flatnonzero(most >= 0)
    hit = hit[np.argsort(keys[hit], kind="stable")]
    place, which = data[gathered(offset[hit], count[hit])], np.repeat(hit, count[hit])
    starts, ends, key = place - most[which], place + STRING - least[which], keys[which]
    heads = first_of(key)
    joined = [np.stack((starts[a:b], ends[a:b])).tobytes() for a, b in zip(heads, ends_of(heads, len(key)), strict=True)]
    return pd.DataFrame({KEY: key[heads], "spans": joined})


def known_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """(KEY, spans) of packed rows without contexts."""
    keys, count, data = numbers(rows["key"]), numbers(rows["n"]), b"".join(rows["data"])
    ends = 16 * np.cumsum(count)
    return pd.DataFrame({KEY: keys, "spans": [data[e - 16 * n : e] for e, n in zip(ends, count, strict=True)]})


def without_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents without the union of their spans: numbers of bytes and of maximal runs removed, digest of the rest."""
    for rows in batches:
        out = []
        for key, data, spans in zip(rows[KEY], rows["bytes"], rows["spans"], strict=True):
            starts, ends = np.concatenate([np.frombuffer(s, np.int64).reshape(2, -1) for s in spans], axis=1)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order])
            fresh = np.r_[True, starts[1:] > ends[:-1]]
            begin, stop = starts[fresh], ends[np.r_[np.flatnonzero(fresh)[1:] - 1, len(ends) - 1]]
            keep = [data[a:b] for a, b in zip(np.r_[0, stop], np.r_[begin, len(data)], strict=True)]
            out.append((key, int((stop - begin).sum()), len(begin), b"".join(keep)))
        yield pd.DataFrame(out, columns=[KEY, "n_removed", "n_spans", "kept"])


def order_of(docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` (with KEY) with `ord`, a long that compares as the ids do; null comes first."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs.withColumn("ord", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    firsts = docs.groupBy(F.col(id_col).alias("of")).agg(F.min(KEY).alias("ord"))
    return docs.join(firsts, F.col(id_col).eqNullSafe(F.col("of"))).drop("of")


def repeated_spans(docs: DataFrame, total_bytes: int, n_docs: int, hot: int = HOT) -> DataFrame:
    """(KEY, spans): stretches of each of `docs` (KEY, ord, bytes) that repeat a smaller document's, as packed starts, then ends."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total_bytes / (SPAN / 2) / BUCKET_GRAMS)))))
    entries = docs.select(KEY, "bytes").mapInPandas(lambda rows: gram_entries(rows, bits), "bucket int, keys binary, h binary, i binary, mh binary, mi binary")
    reply = entries.groupBy("bucket").applyInPandas(lambda rows: shared_grams(rows, hot), f"{KEY} long, grams binary, hot binary")
    lists = durable(reply.groupBy(KEY).agg(F.collect_list("grams").alias("grams"), F.collect_list("hot").alias("hot")))
    known = docs.join(lists, KEY).sortWithinPartitions(KEY)  # a task that is run again sees the same batches
    kind = "bucket long, context binary, ord binary, key binary, n binary, data binary"
    share = max(1, n_docs // SAMPLED)
    sample = docs.filter(F.pmod(F.xxhash64(KEY), F.lit(share)) == 0).join(lists.filter(F.pmod(F.xxhash64(KEY), F.lit(share)) == 0), KEY)
    none = np.zeros(0, np.uint64)
    heads = sample.mapInPandas(lambda rows: sampled_heads(suffixes(rows, bits, False, none, 1)), "head decimal(20,0), n long").groupBy("head").agg(F.sum("n").alias("n")).collect()
    splitters, parts = splitting({int(r["head"]): r["n"] for r in heads}, share)
    cold = known.mapInPandas(lambda rows: suffixes(rows, bits, False, splitters, parts), kind)
    found = cold.groupBy("bucket").applyInPandas(compared, f"{KEY} long, spans binary")
    if not lists.filter(F.exists("hot", lambda h: F.length(h) > 0)).isEmpty():
        strings = known.mapInPandas(lambda rows: hot_strings(suffixes(rows, bits, True, none, 1)), f"{KEY} long, ord long, o int, string binary, data binary")
        found = found.unionByName(hot_spans(durable(strings)))
    return found.groupBy(KEY).agg(F.collect_list("spans").alias("spans"))


def splitting(heads: dict[int, int], share: int) -> tuple[np.ndarray, int]:
    """(splitters, parts): first bytes that part the suffixes in ranges of about equal size, by the sample's
    counts, and the parts by gram that each range is cut in where even RANGES ranges would be too large."""
    buckets = max(1, math.ceil(sum(heads.values()) * share / BUCKET_SUFFIXES))
    values = np.array(sorted(heads), np.uint64)
    weight = np.cumsum([heads[int(v)] for v in values])
    ranges = min(buckets, RANGES)
    if len(values) < 2 or ranges < 2:
        return np.zeros(0, np.uint64), -(-buckets // max(1, ranges))
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return np.unique(values[np.minimum(cuts + 1, len(values) - 1)]), -(-buckets // ranges)


def sampled_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First bytes of suffixes, and how many have them."""
    for rows in batches:
        for context in rows["context"].dropna():
            head, n = np.unique(leading(np.frombuffer(context, np.uint8).reshape(-1, WIDE + 2)), return_counts=True)
            yield pd.DataFrame({"head": [Decimal(int(h)) for h in head], "n": n})


def hot_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All strings around suffixes: (KEY, ord, o, string, data), `o` bytes before the places; spans that are clear without a string."""
    for rows in batches:
        clear = known_spans(rows[rows["context"].isna()])
        if len(clear):
            yield pd.DataFrame({KEY: clear[KEY], "ord": None, "o": None, "string": None, "data": clear["spans"]})
        for _, row in rows[rows["context"].notna()].iterrows():
            context = np.frombuffer(row["context"], np.uint8).reshape(-1, WIDE + 2)
            key, ord_, count = (np.frombuffer(row[c], np.int64) for c in ("key", "ord", "n"))
            ends = 8 * np.cumsum(count)
            for o in range(LEFT + 1):
                at = np.flatnonzero((context[:, WIDE] >= o) & (context[:, WIDE + 1] >= STRING - o))
                string = [x.tobytes() for x in context[at, LEFT - o : LEFT - o + STRING]]
                yield pd.DataFrame({KEY: key[at], "ord": ord_[at], "o": o, "string": string, "data": [row["data"][ends[i] - 8 * count[i] : ends[i]] for i in at]})


def hot_spans(rows: DataFrame) -> DataFrame:
    """(KEY, spans) of repeats among suffixes whose gram very many documents share, by grouping their strings.

    Smallest orders are combined before the shuffle, and the strings of one suffix lie in as many groups as
    they have contents, so no task holds all suffixes of a gram.
    """
    strings = rows.filter("string is not null")
    first = strings.groupBy("string").agg(F.min("ord").alias("first"))
    hits = strings.join(first, "string").filter("ord > first")
    clear = rows.filter("string is null").select(KEY, F.col("data").alias("spans"))
    return hits.select(KEY, "o", "data").mapInPandas(string_spans, f"{KEY} long, spans binary").unionByName(clear)


def string_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        starts = [np.frombuffer(p, np.int64) - o for p, o in zip(rows["data"], rows["o"], strict=True)]
        yield pd.DataFrame({KEY: rows[KEY], "spans": [np.stack((p, p + STRING)).tobytes() for p in starts]})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row a row of `docs` (with KEY): KEY, n_bytes, n_removed, n_spans, digest (SHA-256 of the bytes that stay,
    lowercase hex), and `with_text` also `kept`, these bytes, for the documents that lose some of theirs.

    A null text is empty. Texts under STRING bytes lose nothing. Rows with equal ids repeat nothing of each
    other, as neither id is smaller; a null id is smaller than all others. Of equal texts only those with the
    smallest id are searched; the others go whole. An empty table gives an empty result; other columns
    are not read.
    """
    texts = order_of(docs.select(KEY, id_col, text_col), id_col).select(KEY, "ord", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    heads = durable(texts.select(KEY, "ord", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("whole")))
    long_ = heads.filter(F.col("n_bytes") >= STRING)
    firsts = long_.groupBy("whole").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = durable(long_.join(firsts, "whole").filter("ord > first").select(KEY))
    total, n = long_.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    searched = texts.filter(F.length("bytes") >= STRING).join(small(copies), KEY, "left_anti")
    cut = searched.join(repeated_spans(searched, total, n, hot), KEY)
    cut = cut.select(KEY, "ord", "bytes", "spans").mapInPandas(without_spans, f"{KEY} long, n_removed long, n_spans long, kept binary")
    kept = [F.col("kept")] if with_text else []
    cut = cut.select(KEY, "n_removed", "n_spans", F.sha2("kept", 256).alias("digest"), *kept)
    none = F.lit(b"")
    gone = copies.select(KEY).join(heads.select(KEY, "n_bytes"), KEY)
    gone = gone.select(KEY, F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(none, 256).alias("digest"), *([none.alias("kept")] if with_text else []))
    changed = durable(cut.unionByName(gone))
    rows = heads.join(changed, KEY, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    return rows.select(KEY, "n_bytes", *counts, F.coalesce("digest", "whole").alias("digest"), *kept)


def op12_suffix_dedup(spark, sf_dir):
    """What each document loses to smaller ones."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = substring_dedup(docs).join(docs.select(KEY, "doc_id"), KEY)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("digest").alias("kept_sha256"))
