"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

*Sets.* Texts with the same set of word shingles are one class; a class is known by a 128-bit digest
of its sorted set and joined to itself nowhere. The operator links classes whose sets have a Jaccard
similarity of the threshold or more.

*Forest.* Each of ``TREES`` trees labels a set with ``FULL_DEPTH`` MinHash values of 16 bits, most
significant first, so that the sorted labels of a tree are its prefix trie. A set's neighbours have
the longest common prefixes with it; its prefixes are shortened, from the deepest match on, until a
neighbour agrees in some tree with the chance of the target recall. How short that is depends on the
set (:func:`stop_depths`): the least similarity above the threshold that a set of its size can have
at all is high for short texts, and sets of one to three shingles have no other neighbour than
copies. Where the shortest prefix that any set needs joins several sets, there is a node.

*Candidates.* A node's members, sorted by label, first meet with their labels alone: a pair whose
longest common prefix reaches its stop depth, and whose ``TREES * FULL_DEPTH`` values agree as often
as those of similar sets all but surely do, is a candidate. Only members of candidates are kept.

*Verification.* Nodes with the same members in several trees are kept once. A node of many members
is cut into blocks by hash, and each pair of blocks is a task of its own, so that no node is
gathered in one place and no list of pairs is ever made: a task reads the texts of at most two
blocks, rebuilds their sets, compares those candidates that share a node in no earlier tree, and
returns one row a member with its number of links and its least linked neighbour group. Each link
between different sets is thereby found, and counted, once.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import by_size, fresh, materialise, partitions, table
from failscope.llm.components import components
from failscope.llm.shingles import WORDS, factors, mix, shingle_batch, text_slices

THRESHOLD = 0.8
TREES = 16
#: Values of 16 bits in a tree's label.
FULL_DEPTH = 8
#: Chance that a pair at the threshold agrees in some tree, at least.
RECALL = 0.999
#: Chance that the labels of a pair at the threshold agree too seldom, at most.
MISSED = 1e-7
#: Nodes are cut into blocks of about ``BLOCK`` members, up to ``BLOCKS`` blocks; then blocks grow, to
#: ``BLOCK_MOST`` members and ``BLOCK_BYTES`` of shingles. A member is copied once for each block.
BLOCK, BLOCKS, BLOCK_MOST, BLOCK_BYTES = 256, 32, 1024, 16 << 20


def stop_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, full: int = FULL_DEPTH) -> int:
    """The longest prefix with which the expected recall at a similarity reaches the target."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@lru_cache(64)
def stop_depths(threshold: float, trees: int, recall: float, up_to: int = 64) -> tuple[int, ...]:
    """For sets of 0 to ``up_to`` shingles, how far prefixes are shortened; larger sets as the last.

    It is :func:`stop_depth` of the least similarity, of the threshold or more, that a set of n
    shingles can have with a different one. ``FULL_DEPTH + 1``: with none.
    """
    out = []
    for n in range(up_to):
        reached = (shared / (n + m - shared) for m in range(1, math.ceil(n / threshold) + 2) for shared in range(1, min(n, m) + 1) if not n == m == shared)
        least = min((s for s in reached if s >= threshold - 1e-9), default=None)
        out.append(FULL_DEPTH + 1 if least is None else stop_depth(least, trees, recall))
    return (*out, stop_depth(threshold, trees, recall))


@lru_cache(64)
def least_agreeing(threshold: float, values: int, missed: float = MISSED) -> int:
    """The most of ``values`` MinHash values in which a pair at the threshold agrees but for a chance
    of ``missed``."""
    upto, k = 0.0, 0
    while True:
        upto += math.comb(values, k) * threshold**k * (1 - threshold) ** (values - k)
        if upto > missed:
            return k
        k += 1


def set_key(own: np.ndarray) -> bytes:
    """Digest of a sorted set of shingles."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def labels(hashes: np.ndarray, offsets: np.ndarray, trees: int, seed: int = 3) -> np.ndarray:
    """Labels of texts with shingles: for each text and tree two 64-bit numbers of four values each."""
    begin = offsets[:-1]
    out = np.zeros((len(begin), trees, 2), dtype=np.uint64)
    values = np.empty_like(hashes)
    for i, f in enumerate(factors(trees * FULL_DEPTH, seed)):
        np.multiply(hashes, f, out=values)
        least = np.minimum.reduceat(values, begin)
        half = out[:, i // FULL_DEPTH, i % FULL_DEPTH // 4]
        half[:] = (half << np.uint64(16)) | (mix(least) >> np.uint64(48))
    return out


def common_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values from the first on two labels (last axis: their two numbers) have in common."""
    differ = a ^ b
    depth = np.zeros(differ.shape[:-1], dtype=np.int8)
    same = np.ones(differ.shape[:-1], dtype=bool)
    for half in (0, 1):
        for shift in (48, 32, 16, 0):
            same &= (differ[..., half] >> np.uint64(shift)) == 0
            depth += same
    return depth


SKETCH = "key binary, n_shingles long, labels array<long>"


def _sketch(batches, words: int, trees: int):
    for batch in batches:
        texts = batch.column("text")
        keys, sizes, rows = [], [], []
        for a, b in text_slices(texts):
            hashes, offsets = shingle_batch(texts.slice(a, b - a), words)
            filled = np.flatnonzero(np.diff(offsets))
            marks = np.zeros((b - a, 2 * trees), dtype=np.int64)
            if len(filled):
                marks[filled] = labels(hashes, np.concatenate([offsets[filled], offsets[-1:]]), trees).reshape(-1, 2 * trees).view(np.int64)
            for i in range(b - a):
                own = np.unique(hashes[offsets[i] : offsets[i + 1]])
                keys.append(set_key(own))
                sizes.append(len(own))
            rows.append(marks)
        flat = np.concatenate(rows).reshape(-1) if rows else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * 2 * trees, pa.int32()), pa.array(flat))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=[*kept, "key", "n_shingles", "labels"])


def shared_sizes(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (rows of two places) of sorted sets."""
    if len(pairs) <= 96:
        out = np.empty(len(pairs), dtype=np.int64)
        for n, (i, j) in enumerate(pairs):
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            out[n] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
        return out
    codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = counts > 1
    number = np.cumsum(common) - 1
    rows, codes = rows[common[codes]], number[codes[common[codes]]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 8192
    for begin in range(0, int(common.sum()), width):
        a, b = np.searchsorted(codes, [begin, begin + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[rows[a:b], codes[a:b] - begin] = 1
        total += part @ part.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _blocked(a: slice, b: slice, blocks: np.ndarray) -> np.ndarray:
    """Of the pairs of two runs of members, those that are compared here: each once, and across the
    two blocks if there are two."""
    first, second = np.arange(a.start, a.stop)[:, None], np.arange(b.start, b.stop)[None, :]
    out = first < second
    if blocks.min() != blocks.max():
        out &= blocks[a][:, None] != blocks[b][None, :]
    return out


def open_pairs(a: slice, b: slice, tree: int, stop: int, blocks: np.ndarray, marks: np.ndarray, sizes: np.ndarray, stops: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of two runs of members (rows, columns) are to be compared below a node of ``tree``:
    their sizes allow the threshold, no earlier tree has both in one node, and their deepest common
    prefix reaches the stop depth of both. ``marks``: labels by member and tree."""
    out = _blocked(a, b, blocks)
    out &= np.minimum(sizes[a][:, None], sizes[b][None, :]) >= threshold * np.maximum(sizes[a][:, None], sizes[b][None, :]) - 1e-9
    need = np.maximum(stops[a][:, None], stops[b][None, :])
    reached = np.zeros(out.shape, dtype=np.int8)
    deeper = need.max(initial=0) > stop
    for t in range(marks.shape[1]):
        if t >= tree and not deeper or not out.any():
            break
        depth = common_depth(marks[a, t][:, None], marks[b, t][None, :])
        if t < tree:
            out &= depth < stop
        np.maximum(reached, depth, out=reached)
    return out & (reached >= need) if deeper else out


def _runs(n: int, size: int = 256):
    return [slice(x, min(n, x + size)) for x in range(0, n, size)]


def plausible(tree: int, stop: int, blocks: np.ndarray, marks: np.ndarray, sizes: np.ndarray, stops: np.ndarray, threshold: float) -> np.ndarray:
    """Which members of a node are in some candidate; see the module's docstring."""
    values = np.ascontiguousarray(marks.reshape(len(marks), -1)).view(np.uint16)
    least = least_agreeing(threshold, values.shape[1])
    found = np.zeros(len(marks), dtype=bool)
    runs = _runs(len(marks))
    for x, a in enumerate(runs):
        for b in runs[x:]:
            if found[a].all() and found[b].all():
                continue
            open_ = open_pairs(a, b, tree, stop, blocks, marks, sizes, stops, threshold)
            i, j = np.nonzero(open_)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                agree = (values[a][p] == values[b][q]).sum(axis=1) >= least
                found[a.start + p[agree]] = True
                found[b.start + q[agree]] = True
    return found


def link_group(tree: int, stop: int, keys: list[bytes], blocks: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], stops: np.ndarray, threshold: float):
    """(key, least key that it is connected to here, links) of the members with a link."""
    m = len(keys)
    sizes = np.array([len(s) for s in sets])
    first, second = [], []
    runs = _runs(m)
    for x, a in enumerate(runs):
        for b in runs[x:]:
            p, q = np.nonzero(open_pairs(a, b, tree, stop, blocks, marks, sizes, stops, threshold))
            first.append(p + a.start)
            second.append(q + b.start)
    i, j = np.concatenate(first), np.concatenate(second)
    if not len(i):
        return []
    used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    shared = shared_sizes([sets[x] for x in used], np.stack([places[: len(i)], places[len(i) :]], axis=1))
    linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    i, j = i[linked], j[linked]
    links = np.bincount(np.concatenate([i, j]), minlength=m)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b, key=keys.__getitem__)] = min(a, b, key=keys.__getitem__)
    return [(keys[x], keys[root(x)], int(links[x])) for x in range(m) if links[x]]


LINKS = "child binary, parent binary, links long"
GROUP = ["tree", "label", "low", "high"]
_MEMBER = "key binary, rep_id {id}, labels array<long>, n_shingles long, tree int, label long, block int, low int, high int"


def _stops(sizes: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    return np.array(depths)[np.minimum(sizes, len(depths) - 1)]


def _marks(column) -> np.ndarray:
    """Labels of a list column, by row, tree and half."""
    return np.array(column, dtype=np.int64).view(np.uint64).reshape(len(column), -1, 2)


def _candidates(batches, stop: int, depths: tuple[int, ...], threshold: float):
    """Members sorted by node and label -> those in some candidate."""
    held: list[pa.RecordBatch] = []
    at = None

    def close():
        table_ = pa.Table.from_batches(held)
        if table_.num_rows < 2:
            return []
        sizes = table_["n_shingles"].to_numpy()
        found = plausible(at[0], stop, table_["block"].to_numpy(), _marks(table_["labels"].to_pylist()), sizes, _stops(sizes, depths), threshold)
        return table_.filter(pa.array(found)).to_batches() if found.any() else []

    for batch in batches:
        group = list(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True))
        begin = 0
        for i in range(len(group) + 1):
            if i == len(group) or group[i] != at:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if i == len(group):
                    break
                if held:
                    yield from close()
                at, held, begin = group[i], [], i
    if held:
        yield from close()


def _verify(batches, words: int, stop: int, depths: tuple[int, ...], threshold: float):
    at, members = None, {}

    def close():
        if len(members) < 2:
            return None
        keys = sorted(members)
        sets = [members[k][2] for k in keys]
        found = link_group(at[0], stop, keys, np.array([members[k][0] for k in keys]), _marks([members[k][1] for k in keys]), sets, _stops(np.array([len(s) for s in sets]), depths), threshold)
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["child", "parent", "links"])

    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            part = batch.slice(a, b - a)
            hashes, offsets = shingle_batch(texts.slice(a, b - a), words)
            rows = [part.column(c).to_pylist() for c in (*GROUP, "block", "key", "labels")]
            for i, (tree, label, low, high, block, key, marks) in enumerate(zip(*rows, strict=True)):
                if (tree, label, low, high) != at:
                    if (out := close()) is not None:
                        yield out
                    at, members = (tree, label, low, high), {}
                own = np.unique(hashes[offsets[i] : offsets[i + 1]])
                # rows that share the representative's doc_id may have other texts
                if key not in members and set_key(own) == key:
                    members[key] = (block, marks, own)
    if (out := close()) is not None:
        yield out


def _prefix(stop: int):
    """A 64-bit number for the first ``stop`` values of a label (hi, lo)."""
    if stop <= 4:
        return F.shiftrightunsigned("hi", 64 - 16 * stop) if stop < 4 else F.col("hi")
    return F.xxhash64("hi", F.shiftrightunsigned("lo", 64 - 16 * (stop - 4)) if stop < 8 else F.col("lo"))


def _links(docs: DataFrame, classes: DataFrame, words: int, threshold: float, trees: int, recall: float, block: int) -> DataFrame:
    """(child, parent, links) by task: see :func:`link_group`."""
    depths = stop_depths(threshold, trees, recall)
    stop, alone = min(depths), next((n for n, d in enumerate(depths) if 0 < n and d <= FULL_DEPTH), 1)
    parts = partitions(docs.sparkSession)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    hi, lo = (F.get("labels", F.col("tree") * 2 + half) for half in (0, 1))
    placed = classes.where(F.col("n_shingles") >= alone).select("key", "labels", "n_shingles", tree.alias("tree"))
    placed = placed.select("key", "n_shingles", "tree", hi.alias("hi"), lo.alias("lo")).select("key", "n_shingles", "tree", _prefix(stop).alias("label"))
    nodes = placed.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("m > 1")
    # the same members below nodes of several trees: the first tree's node is kept
    nodes = nodes.groupBy("m", "s", "x", "y").agg(F.min(F.struct("tree", "label")).alias("node")).select("m", "s", F.col("node.tree").alias("in_tree"), F.col("node.label").alias("in_label"))
    nodes = by_size(materialise(nodes, "near-nodes"), 64)
    hits = materialise(placed.join(nodes, (F.col("tree") == F.col("in_tree")) & (F.col("label") == F.col("in_label"))).select("key", "tree", "label", "m", "s"), "near-hits")
    # labels meet their nodes only now, and only those of sets in some node
    some = materialise(hits.select(F.col("key").alias("hit")).distinct(), "near-hit")
    labelled = classes.join(by_size(some, 64), F.col("key") == F.col("hit"), "left_semi").select(F.col("key").alias("of_key"), "rep_id", "labels", "n_shingles")
    members = hits.join(labelled, F.col("key") == F.col("of_key")).withColumn("hi", hi).withColumn("lo", lo)
    n_blocks = F.greatest(F.least(F.ceil(F.col("m") / block), F.lit(BLOCKS)), F.ceil(F.col("m") / max(block, BLOCK_MOST)), F.ceil(F.col("s") * 8 / BLOCK_BYTES)).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    members = members.select("key", "rep_id", "labels", "n_shingles", "tree", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "hi", "lo")
    trie = members.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "hi", "lo").drop("hi", "lo")
    kind = docs.schema["doc_id"].dataType.simpleString()
    candidates = materialise(trie.mapInArrow(lambda it: _candidates(it, stop, depths, threshold), _MEMBER.format(id=kind)), "near-candidates")

    wanted = materialise(candidates.select(F.col("rep_id").alias("of_id")).distinct(), "near-wanted")
    texts = docs.select("doc_id", "text").join(by_size(wanted, 64), F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    with_text = candidates.join(texts, F.col("rep_id").eqNullSafe(F.col("doc_id"))).select(*GROUP, "block", "key", "labels", "text")
    grouped = with_text.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
    return materialise(grouped.mapInArrow(lambda it: _verify(it, words, stop, depths, threshold), LINKS), "near-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, rep_id, n_copies, n_links.

    Texts with the same shingle set are copies; ``rep_id`` is the smallest doc_id and ``n_copies``
    the number of rows of the document's copies, itself included. ``n_links`` is the number of other
    sets whose Jaccard similarity with its own is ``threshold`` or more. ``class_id`` is the smallest
    doc_id of all rows that links and copies connect.

    Null and empty texts have no shingle: each is a class of its own (class_id and rep_id are its
    doc_id, n_copies 1, n_links 0). Null doc_ids are ignored in smallest ones; a class of null
    doc_ids has null ids and isn't compared with others if other rows have null doc_ids and other
    texts. No rows give no rows. Columns other than doc_id and text are ignored.
    """
    return _classed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), threshold, words, trees, recall, block)


def _classed(plain: DataFrame, threshold: float, words: int, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """:func:`near_duplicates` of rows (doc_id, text without null); further columns are kept."""
    kept = [c for c in plain.columns if c != "text"]
    kinds = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in kept)
    sketches = materialise(plain.mapInArrow(lambda it: _sketch(it, words, trees), f"{kinds}, {SKETCH}"), "near-sketches")
    classes = sketches.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    classes = materialise(classes, "near-classes")
    found = _links(plain, classes, words, threshold, trees, recall, block)

    linked = found.groupBy(F.col("child").alias("of_key")).agg(F.sum("links").alias("links"))
    roots = components(found.select("child", "parent")).select(F.col("child").alias("root_of"), F.col("parent").alias("root"))
    placed = classes.select("key", "rep_id", "n_copies").join(linked, F.col("key") == F.col("of_key"), "left").join(roots, F.col("key") == F.col("root_of"), "left")
    placed = materialise(placed.select("key", "rep_id", "n_copies", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "key").alias("root")), "near-placed")
    # both sides written: a plain join, in which Spark can split the members of a hot group
    least = materialise(placed.groupBy(F.col("root").alias("least_of")).agg(F.min("rep_id").alias("class_id")), "near-least")
    placed = materialise(placed.join(least, F.col("root") == F.col("least_of")).select(F.col("key").alias("class_key"), "class_id", "rep_id", "n_copies", "n_links"), "near-classes")
    return sketches.join(placed, (F.col("key") == F.col("class_key")) & (F.col("n_shingles") > 0), "left").select(
        *kept,
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n_shingles") > 0, F.col("rep_id")).otherwise(F.col("doc_id")).alias("rep_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its class.

    Rows of null doc_id stay. A doc_id may stand on rows with different texts; each row goes or
    stays by its own text.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(text))
    gone = _classed(docs.select("doc_id", digest.alias("digest"), text.alias("text")), threshold, words)
    of_id, of_digest = fresh(docs.columns, "of_id", "of_digest")
    gone = gone.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_digest)).distinct()
    gone = by_size(materialise(gone, "near-gone"), 128)
    return docs.join(gone, (docs["doc_id"] == F.col(of_id)) & (digest == F.col(of_digest)), "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, rep_id, n_copies, n_links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
keyed AS (SELECT r, md5(string_agg(s, chr(1) ORDER BY s)) AS key, count(*) AS n FROM sh GROUP BY r),
classes AS (SELECT key, min(doc_id) AS rep_id, count(*) AS n_copies, any_value(n) AS n, min(keyed.r) AS one FROM keyed JOIN d ON d.r = keyed.r GROUP BY key),
members AS (SELECT key, n, s FROM classes JOIN sh ON sh.r = one),
pairs AS (SELECT a.key AS ka, b.key AS kb, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM members a JOIN members b ON a.s = b.s AND a.key < b.key GROUP BY a.key, b.key),
linked AS (SELECT ka, kb FROM pairs WHERE m >= 0.8::DOUBLE * (na + nb - m) - 1e-9),
both_ways AS (SELECT ka, kb FROM linked UNION ALL SELECT kb, ka FROM linked),
reach AS (SELECT key, key AS other FROM classes UNION SELECT r.key, b.kb FROM reach r JOIN both_ways b ON r.other = b.ka),
grouped AS (SELECT r.key, min(c.rep_id) AS class_id FROM reach r JOIN classes c ON c.key = r.other GROUP BY r.key),
counted AS (SELECT ka AS key, count(*) AS n_links FROM both_ways GROUP BY ka)
SELECT d.doc_id, CASE WHEN k.key IS NULL THEN d.doc_id ELSE g.class_id END AS class_id, CASE WHEN k.key IS NULL THEN d.doc_id ELSE c.rep_id END AS rep_id, coalesce(c.n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN keyed k ON k.r = d.r LEFT JOIN classes c ON c.key = k.key LEFT JOIN grouped g ON g.key = k.key LEFT JOIN counted ON counted.key = k.key
"""
