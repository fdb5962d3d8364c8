"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

Words are the runs of characters other than white space (space, U+0009 to U+000D), in lower case. A
text of five words or more has a shingle for each five words in a row; a text of one to four words
has one shingle, all its words; an empty text has none. A shingle is known by a 64-bit hash of its
words, so that two different ones are taken for one with a chance of 2 ** -64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from failscope.llm.common import SPACE_BYTES

WORDS = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
#: Bytes that are hashed at a time; bounds the temporary arrays, not the texts.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``data`` (bytes), and for each the place of its first byte.

    ``first``: places at which a text begins; a word never goes across one.
    """
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    begin = first[first < len(data)]
    starts[begin] = ~space[begin]
    ends = ~space
    ends[:-1] &= space[1:]
    closing = begin[begin > 0] - 1
    ends[closing] = ~space[closing]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(s), dtype=np.uint64)
    i = 0
    while i < len(s):
        # as many words as fit into a chunk, one at least
        j = max(i + 1, int(np.searchsorted(e, s[i] + CHUNK, side="right")))
        a, b = int(s[i]), int(e[j - 1])
        terms = _powers(_BASE, b - a) * (data[a:b].astype(np.uint64) + np.uint64(1))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        rs, re = s[i:j] - a, e[i:j] - a
        out[i:j] = mix((total[re] - total[rs]) * _powers(_INVERSE, b - a)[rs] + (re - rs).astype(np.uint64) * _LENGTH)
        i = j
    return out, s


def shingle_batch(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch of texts in order, repeats included, and where each text's begin.

    Null texts count as empty. Returns (hashes, offsets of length n + 1).
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    n = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + n + 1]
    if n == 0 or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(lowered.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashed, at = word_hashes(data, offsets[:-1])
    first = np.searchsorted(at, offsets)  # first word of each text
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    # the sum of words in a row, each times the factor of its place; words beyond the text's end don't count
    m = len(hashed)
    rolled = np.zeros(m, dtype=np.uint64)
    for k in range(min(words, m)):
        rolled[: m - k] += hashed[k:] * _PLACE[k]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    for t in short:
        w = hashed[first[t] : first[t + 1]]
        rolled[first[t]] = (w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    keep = np.arange(m) - np.repeat(first[:-1], n_words) < np.repeat(n_shingles, n_words)
    return mix(rolled[keep]), np.concatenate([[0], np.cumsum(n_shingles)])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_batch(pa.array([text], pa.string()), words)[0])


def factors(n: int, seed: int) -> np.ndarray:
    """``n`` odd factors for the permutations x -> x * factor of the 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """(begin, end) of runs of ``texts`` of about ``most_bytes`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)
