"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, table, with_key, without

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Characters of benchmark text that are compiled and sent to the executors at once; more goes in blocks.
#: Compiled, 2 M characters take about 250 MB in each worker.
BLOCK_CHARS = 2_000_000

#: A-Z to a-z; letters, digits and bytes above 0x7F stay; all else ends a word.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCAN = f"{KEY} long, n_words long, spans array<int>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Words:
    """Numbers of the words that occur in benchmark windows; all other words have number 0."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}

    def learn(self, found: list[bytes]) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]

    def of(self, found: list[bytes]) -> array:
        get = self.numbers.get
        return array("i", [get(w, 0) for w in found])


class WuManber:
    """Finds windows of one length in texts of word numbers.

    `texts` are the benchmark texts as word numbers, one after the other, and `starts` the first place of
    each distinct window in them. `shift` has, for a block of two adjacent words of any window, how far the
    search may move on when a text block is equal to it; a block in no window allows the longest move.
    Where shift is 0, the block is the suffix of at least one window, and its bucket has the windows that
    end in it. A bucket is a range of `hashes`, in which the hashes of its whole windows are in order; those
    of the text's own hash are found by bisection and compared with it word by word. So however many
    windows share a suffix, only those of equal hash are compared.
    """

    def __init__(self, texts: array, starts: dict[bytes, int], length: int):
        self.length, self.block = length, min(2, length)
        self.longest = length - self.block + 1
        self.texts, self.shift, self.buckets = texts, {}, {}
        for at in starts.values():
            for end in range(self.block, length + 1):
                b = self.blocked(texts, at + end)
                self.shift[b] = min(self.shift.get(b, self.longest), length - end)
        ends = sorted((self.blocked(texts, at + length), crc32(window), at, n) for n, (window, at) in enumerate(starts.items()))
        self.hashes, self.places, self.numbers = (array(kind, (e[i] for e in ends)) for kind, i in (("L", 1), ("i", 2), ("i", 3)))
        first = 0
        for suffix, bucket in groupby(e[0] for e in ends):
            last = first + sum(1 for _ in bucket)
            self.buckets[suffix] = (first, last)
            first = last

    def blocked(self, text: array, end: int) -> int:
        """The block before place `end`, as one number."""
        return text[end - 1] if self.block == 1 else text[end - 2] << 32 | text[end - 1]

    def find(self, text: array) -> Iterator[tuple[int, int]]:
        """Start and number of each window that occurs, in order."""
        shift, longest, length, at, n, pair = self.shift.get, self.longest, self.length, self.length, len(text), self.block == 2
        hashes = self.hashes
        while at <= n:
            suffix = text[at - 2] << 32 | text[at - 1] if pair else text[at - 1]
            move = shift(suffix, longest)
            if move:
                at += move
                continue
            start = at - length
            window = text[start:at].tobytes()
            first, last = self.buckets[suffix]
            own = crc32(window)
            for i in range(bisect_left(hashes, own, first, last), last):
                if hashes[i] != own:
                    break
                if self.texts[self.places[i] : self.places[i] + length].tobytes() == window:
                    yield start, self.numbers[i]
            at += 1


class Compiled:
    """Matchers of all lengths of window of the (id, text) `items`, and the ids of each window's items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.words, self.names = Words(), sorted({item for item, _ in items if item is not None})
        name = {n: i for i, n in enumerate(self.names)}
        texts, starts, of = defaultdict(lambda: array("i")), defaultdict(dict), defaultdict(lambda: array("i"))
        for item, text in items:
            found = self.words.learn(words(text))
            length = min(window, len(found))
            if not found:
                continue
            held, base = texts[length], len(texts[length])
            held.extend(found)
            for i in range(len(found) - length + 1):
                w = held[base + i : base + i + length].tobytes()
                starts[length].setdefault(w, base + i)
                if item is not None:
                    of[length, w].append(name[item])
        # Items by number of window; an array of numbers each, as most windows have one item.
        self.matchers = [(WuManber(texts[n], starts[n], n), [of.get((n, w)) for w in starts[n]]) for n in sorted(starts)]

    def scan(self, text: bytes | None) -> tuple[int, list[int], list[str]]:
        """(number of words, united spans of hit words, items found) of a text."""
        found = words(text)
        numbers = self.words.of(found)
        hit, items = [], set()
        for matcher, of in self.matchers:
            for start, number in matcher.find(numbers):
                hit += (start, start + matcher.length)
                if of[number] is not None:
                    items.update(of[number])
        return len(found), united(hit), [self.names[i] for i in sorted(items)]


def united(spans: list[int]) -> list[int]:
    """Disjoint spans in order that cover what `spans` (start, end, start, end, ...) cover."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def scan_batches(matchers) -> callable:
    """A mapInArrow function over (KEY, text as bytes) that gives SCAN rows."""

    def scan(batches):
        for batch in batches:
            keys, n_words, spans, items = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                n, hit, found = matchers.value.scan(text)
                n_words.append(n)
                spans.append(hit)
                items.append(found)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [KEY, "n_words", "spans", "items"])

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """KEY, n_words, spans of hit words (start, end, ...) and ids of the items found, of each of `docs`.

    The items are measured first. Up to `block_chars` of them are compiled once and broadcast; a larger
    set goes in blocks of about that size, each searched for in all documents, whose hits are united. Items
    are dealt to blocks by id and text, so one text under many ids is in several.
    """
    spark = docs.sparkSession
    texts = docs.select(KEY, F.col(text_col).cast("binary").alias("text"))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).distinct()
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        matchers = spark.sparkContext.broadcast(Compiled([(r.item, r.text) for r in part.collect()], window))
        one = texts.mapInArrow(scan_batches(matchers), SCAN)
        if blocks == 1:
            return one
        one = durable(one.filter(F.lit(b == 0) | (F.size("spans") > 0)))
        matchers.destroy()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy(KEY).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", F.udf(united, "array<int>", useArrow=True)("spans"))


def contamination(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (hit words are at least a twentieth of all) to `scan`'s rows."""
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = scanned.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns.

    Null and empty texts have no words and stay; an item without words is never found; an item without
    an id hits words but is not listed; items that share an id are one item. Other columns are not read.
    """
    keyed = with_key(docs, id_col)
    return without(keyed, contamination(scan(keyed, benchmark, text_col)).filter("contaminated")).select(*docs.columns)


def op1_decontamination(spark, sf_dir):
    """Hit words and items of every document; contaminated where they are at least a twentieth of its words."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = contamination(scan(docs, table(spark, sf_dir, "benchmark")))
    rows = found.join(docs.select(KEY, "doc_id"), KEY)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT n FROM item_window
), doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM doc, lengths WHERE len(w) >= n)
), hit AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_window d JOIN item_window t ON d.n = t.n AND d.g = t.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
