"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of q shingles that stands in a document of many more has a tiny Jaccard similarity with the
whole document, so MinHash of whole documents can't find it. Items are therefore partitioned by
size: partition g (a power of two) holds the items of more than g and up to 2 g shingles, and for
it a document is the sequence of its windows of 3 g shingles in a row, one beginning at every g-th.
An occurrence of an item lies in one of these windows, whose similarity with the item is at least
about a quarter however long the document is. The windows' minima under a permutation are built
from the minima of blocks of g shingles, and those of 2 g from those of g: one pass serves all
partitions. The number of permutations follows from the least similarity and the target recall; a
window that agrees with an item in any of them makes (document, item) a candidate. Containment of
each candidate is then counted over the sets of all shingles of the document and the item.

An item whose parts are strewn over a document is a candidate if any window with a part agrees. Parts
with a share c of the item's shingles are about a quarter of c similar to their windows altogether,
however many they are, so that with the 40 or more permutations the chance to miss all of them is
less than exp(-40 c / 4): below 0.0004 at the threshold.

Items of fewer words than a shingle has are one shingle of their own length. They are partitions of
their own, for which documents are sequences of shingles of that length; equality is exact there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from failscope.llm.common import table
from failscope.llm.shingles import WORDS, factors, shingle_batch, shingle_set, text_slices

THRESHOLD = 0.8
#: Chance that a contained item has no window that agrees with it, at most.
MISS = 1e-5
#: Shingles of the items that are searched for in one pass over the documents (16 MB of hashes).
BLOCK_SHINGLES = 1 << 21


class ItemIndex:
    """Search index of a block of items: (item_id, words of a shingle, sorted shingle set)."""

    def __init__(self, items: list[tuple], words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 5):
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.words, self.threshold = words, threshold
        of_size: dict[int, list[int]] = {}
        of_words: dict[int, list[int]] = {}
        for n, (_, k, s) in enumerate(items):
            if k < words:
                of_words.setdefault(k, []).append(n)
            else:
                of_size.setdefault(1 << max(0, (len(s) - 1).bit_length() - 1), []).append(n)
        # items of few words, by their number: sorted hashes and the items
        self.short = {}
        for k, members in of_words.items():
            hashes = np.concatenate([self.sets[n] for n in members])
            order = np.argsort(hashes, kind="stable")
            self.short[k] = (hashes[order], np.array(members)[order])
        self.sizes = sorted(of_size)
        needed = 1
        for g, members in of_size.items():
            q = min(len(self.sets[n]) for n in members)
            shared = math.ceil(threshold * q - 1e-9)
            least = shared / (3 * g + q - shared) if q > 1 else 1 / (3 * g)
            needed = max(needed, math.ceil(math.log(miss) / math.log(1 - least)))
        self.factors = factors(needed, seed)
        # per partition and permutation: sorted minima, the items they belong to, and which first 16 bits occur
        self.minima: dict[int, list[tuple]] = {}
        for g, members in of_size.items():
            flat = np.concatenate([self.sets[n] for n in members])
            begin = np.concatenate([[0], np.cumsum([len(self.sets[n]) for n in members])])[:-1]
            self.minima[g] = []
            for f in self.factors:
                least = np.minimum.reduceat(flat * f, begin)
                order = np.argsort(least, kind="stable")
                head = np.zeros(1 << 16, dtype=bool)
                head[(least >> np.uint64(48)).astype(np.int64)] = True
                self.minima[g].append((least[order], np.array(members)[order], head))

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window agrees with the item in a permutation."""
        found: set[tuple[int, int]] = set()
        lengths = np.diff(offsets)
        if not len(hashes) or not self.sizes:
            return found
        levels = []  # per partition: (g, block begins in the level below, text of a block)
        g, below, n_below = 1, None, lengths
        while g <= self.sizes[-1]:
            if g >= self.sizes[0]:
                if below is None:
                    n_blocks = -(-lengths // g)
                    begin = np.repeat(offsets[:-1], n_blocks) + g * _ranks(n_blocks)
                else:
                    n_blocks = -(-n_below // 2)
                    first = np.concatenate([[0], np.cumsum(n_below)])[:-1]
                    begin = np.repeat(first, n_blocks) + 2 * _ranks(n_blocks)
                of = np.repeat(np.arange(len(lengths)), n_blocks)
                levels.append((g, begin, of, of[1:] == of[:-1], of[2:] == of[:-2]))
                below, n_below = True, n_blocks
            g *= 2
        values = np.empty_like(hashes)
        for p, f in enumerate(self.factors):
            np.multiply(hashes, f, out=values)
            least = values
            for g, begin, of, next_one, next_two in levels:
                least = np.minimum.reduceat(least, begin)
                if g not in self.minima:
                    continue
                window = least.copy()
                np.minimum(window[:-1], least[1:], out=window[:-1], where=next_one)
                np.minimum(window[:-2], least[2:], out=window[:-2], where=next_two)
                known, items, head = self.minima[g][p]
                at = np.flatnonzero(head[(window >> np.uint64(48)).astype(np.int64)])
                if not len(at):
                    continue
                left = np.searchsorted(known, window[at], side="left")
                right = np.searchsorted(known, window[at], side="right")
                for w, a, b in zip(at[right > left], left[right > left], right[right > left], strict=True):
                    text = int(of[w])
                    found.update((text, int(items[k])) for k in range(a, b))
        return found

    def found(self, texts: pa.Array):
        """(text, item, shared shingles) of the items that texts contain."""
        for k, (known, items) in self.short.items():
            hashes, offsets = shingle_batch(texts, k)
            left, right = (np.searchsorted(known, hashes, side=side) for side in ("left", "right"))
            at = np.flatnonzero(right > left)
            of = np.searchsorted(offsets, at, side="right") - 1
            for text, a, b in sorted({(int(t), int(left[x]), int(right[x])) for t, x in zip(of, at, strict=True)}):
                yield from ((text, int(items[n]), 1) for n in range(a, b))
        hashes, offsets = shingle_batch(texts, self.words)
        by_text: dict[int, list[int]] = {}
        for text, item in sorted(self.candidates(hashes, offsets)):
            by_text.setdefault(text, []).append(item)
        for text, items in by_text.items():
            own = np.unique(hashes[offsets[text] : offsets[text + 1]])
            for item in items:
                wanted = self.sets[item]
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                shared = int((own[at] == wanted).sum())
                if shared >= self.threshold * len(wanted) - 1e-9:
                    yield text, item, shared


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _item_sets(batches, words: int):
    """Rows (item_id, text) -> (item_id, words of a shingle, shingle set as bytes) of items with words."""
    for batch in batches:
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n = len(shingle_batch(pa.array([text], pa.string()), 1)[0])
            if n:
                rows.append((item_id, min(n, words), shingle_set(text, min(n, words)).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field("item_id").type, pa.int32(), pa.binary()), strict=True)], names=["item_id", "words", "shingles"])


def item_blocks(items: DataFrame, words: int = WORDS, block_shingles: int = BLOCK_SHINGLES):
    """The items in blocks of about ``block_shingles`` shingles, hashed by tasks and read one
    partition at a time."""
    kind = items.schema["item_id"].dataType.simpleString()
    sets = items.select("item_id", "text").mapInArrow(lambda it: _item_sets(it, words), f"item_id {kind}, words int, shingles binary")
    block, held = [], 0
    for row in sets.toLocalIterator():
        block.append((row.item_id, row.words, np.frombuffer(row.shingles, dtype=np.uint64)))
        held += len(block[-1][2])
        if held >= block_shingles:
            yield block
            block, held = [], 0
    if block:
        yield block


_COUNTS = "item_shingles long, shared_shingles long, containment double"


def _search(batches, index: ItemIndex, kind: pa.DataType):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        found = [(a + t, i, n) for a, b in text_slices(texts) for t, i, n in index.found(texts.slice(a, b - a))]
        sizes = [len(index.sets[i]) for _, i, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array([t for t, _, _ in found], pa.int64())), pa.array([index.ids[i] for _, i, _ in found], kind), pa.array(sizes, pa.int64()),
                pa.array([n for _, _, n in found], pa.int64()), pa.array([n / q for (_, _, n), q in zip(found, sizes, strict=True)], pa.float64()),
            ],
            names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
        )


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment): every item of which a share of
    ``threshold`` of the distinct shingles occurs in a document.

    ``items``: item_id, text. Items of fewer than ``words`` words are one shingle, all their words, and
    are in a document that has these words in a row. Null and empty items have no shingle and are in
    no document. ids may be of any type. Repeated rows of documents and of items are each
    reported; a null doc_id or item_id is reported as null. Without items or documents there are no
    rows. Columns other than the ids and texts are ignored. The items are the query set; they are
    searched for in blocks of ``BLOCK_SHINGLES`` shingles against all documents.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, {_COUNTS}"
    kind = to_arrow_type(items.schema["item_id"].dataType)
    plain = docs.select("doc_id", "text")
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, words):
        shipped = spark.sparkContext.broadcast(ItemIndex(block, words, threshold))
        found = found.unionAll(plain.mapInArrow(lambda it, s=shipped: _search(it, s.value, kind), schema))
    return found


def _clean(batches, index: ItemIndex):
    for batch in batches:
        texts = batch.column("text")
        clean = np.ones(len(texts), dtype=bool)
        for a, b in text_slices(texts):
            for t, _, _ in index.found(texts.slice(a, b - a)):
                clean[a + t] = False
        yield batch.filter(pa.array(clean))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which :func:`contaminations` finds no item."""
    for block in item_blocks(items, words):
        shipped = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, words, threshold))
        docs = docs.mapInArrow(lambda it, s=shipped: _clean(it, s.value), docs.schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a row for each contaminated pair."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ks AS (SELECT DISTINCT least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[b : b + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS b FROM d JOIN ks ON len(w) >= k)),
si AS (SELECT DISTINCT r, item_id, k, array_to_string(w[b : b + k - 1], ' ') AS s FROM (SELECT r, item_id, w, least(5, len(w)) AS k, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS b FROM i WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS q FROM si GROUP BY r),
found AS (SELECT ds.r, any_value(ds.doc_id) AS doc_id, any_value(si.item_id) AS item_id, any_value(q) AS item_shingles, count(*) AS shared_shingles FROM ds JOIN si ON ds.s = si.s AND ds.k = si.k JOIN sizes ON sizes.r = si.r GROUP BY ds.r, si.r)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / CAST(item_shingles AS DOUBLE) AS containment FROM found WHERE shared_shingles >= 0.8::DOUBLE * item_shingles - 1e-9
"""
