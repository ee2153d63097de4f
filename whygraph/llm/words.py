"""Word and n-gram hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
GRAM = 0xD6E8FEB86659FD93

#: A-Z to a-z, other bytes as they are.
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
#: Bytes of a word where words are letters, digits and all bytes above 0x7F.
ALNUM = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
#: Bytes of a word where ASCII white space separates words.
NOT_SPACE = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


#: Bytes of texts that are hashed at a time; a longer text is cut between words.
PIECE = 4_000_000


def cut(text: bytes, word_bytes: np.ndarray, most: int) -> list[bytes]:
    """`text` in pieces of at most `most` bytes, cut where no word is; one longer word stays in one piece."""
    pieces, begin = [], 0
    while len(text) - begin > most:
        end = 0
        for at in range(begin, len(text), most):
            gaps = np.flatnonzero(~word_bytes[LOWER[np.frombuffer(text, np.uint8, min(most, len(text) - at), at)]])
            if len(gaps):
                end = at + int(gaps[-1] if at == begin else gaps[0]) + 1
                break
        if not end:
            break
        pieces.append(text[begin:end])
        begin = end
    return [*pieces, text[begin:]]


def word_spans(texts: list[bytes | None], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, bounds): the joined bytes of texts, A-Z lowered, and where their words are."""
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lengths)))
    buf = LOWER[np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)]
    edges = np.flatnonzero(np.diff(word_bytes[buf], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    return buf, starts, ends, np.searchsorted(starts, at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span of bytes.

    It is a difference of prefix sums of a polynomial in the bytes, so its cost does not depend on how
    many words there are.
    """
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(BASE, len(buf)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(INVERSE, len(buf) + 1)[starts])


def by_pieces(texts: list[bytes | None], word_bytes: np.ndarray, of):
    """(values, bounds): what `of` (texts) gives for texts, no more than PIECE bytes of a long one at a time."""
    if sum(len(t) for t in texts if t) <= PIECE:
        return of(texts)
    values, bounds = [], [0]
    for t in texts:
        parts = [of([x])[0] for x in (cut(t, word_bytes, PIECE) if t else [t])]
        values += parts
        bounds.append(bounds[-1] + sum(map(len, parts)))
    return np.concatenate(values), np.array(bounds)


def word_hashes(texts: list[bytes | None], word_bytes: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the 64-bit hash of each word of all texts; text i has bounds[i]:bounds[i + 1]."""

    def of(some):
        buf, starts, ends, bounds = word_spans(some, word_bytes)
        return span_hashes(buf, starts, ends), bounds

    return by_pieces(texts, word_bytes, of)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the n-grams of words; a text of fewer words, but not none, is one gram."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(sizes)))
    length = max(0, len(hashes) - n + 1)
    rolled = np.zeros(length, U)
    for k in range(n):
        rolled += hashes[k : k + length] * U(pow(GRAM, k + 1, 1 << 64))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    source = bounds[:-1][owner] + (np.arange(len(owner)) - out_bounds[:-1][owner])
    short = (counts < n)[owner] if len(owner) else np.zeros(0, bool)
    out = np.zeros(len(owner), U)
    out[~short] = rolled[source[~short]]
    for i in np.flatnonzero(short):
        own = hashes[bounds[owner[i]] : bounds[owner[i] + 1]]
        out[i] = U(sum(int(x) * pow(GRAM, k + 1, 1 << 64) for k, x in enumerate(own)) + len(own) & MASK)
    return mixed(out), out_bounds


def slices(texts: pa.Array, most: int = 1_000_000):
    """(first, end, texts as bytes) of runs of about `most` bytes of an Arrow column, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield begin, i, texts.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += size + 1
    if begin < len(sizes):
        yield begin, len(sizes), texts.slice(begin).to_pylist()
