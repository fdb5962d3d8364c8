"""Exact duplicates by an extendible-hash index on shared files.

1. *Keys.* One native scan writes (doc_id, 64-bit hash, SHA-256, bytes) of every normalised text
   into the shared folder.
2. *Directory.* It begins with one bucket and depth 0. As long as a bucket is overfull, it is split
   by its next bit; if its depth is the directory's, the directory doubles first. Buckets of low
   depth are pointed at by many entries. The buckets, in the order of their keys, are dealt to owner
   tasks by bytes, so that each task owns a range of keys.
3. *Entries.* A second scan combines equal texts inside each task and sends the entries to the owner
   of their bucket. A text that a task meets again and again leaves its body once, and its entry
   goes to another owner for each task, so that the bodies of a hot text never meet in one place.
4. *Owners.* Entries come sorted by hash; those of one hash form a chain whose texts are compared
   byte by byte. Each link is one narrow record.
5. *Index.* Records of one digest, of which only hot texts have several, are added up; the index is
   written to the shared folder and the keys are joined with it by digest; both sides are narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import SPACES, by_size, fresh, materialise, partitions, table, whole_text

#: A bucket is overfull beyond so many bytes of distinct texts, and beyond a quarter of an owner's share.
BUCKET_BYTES = 4 << 20
#: The directory has 2 ** MAX_DEPTH entries at most; beyond it buckets grow, their chains stay exact.
MAX_DEPTH = 16
#: A task that combines equal texts holds so many bytes of them at a time.
HELD_BYTES = 16 << 20


def normalised(col: str = "text") -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(whole_text(col), SPACES, " ")


@dataclass
class Directory:
    """``pointers``: the bucket of each of the 2 ** depth prefixes; ``owners``: the task of each prefix."""

    depth: int
    pointers: np.ndarray
    local_depths: list[int]
    owners: np.ndarray

    def owner(self, h: np.ndarray) -> np.ndarray:
        """Owner tasks of hashes: looked up by their first ``depth`` bits."""
        if not self.depth:
            return np.zeros(len(h), dtype=np.int32)
        return self.owners[(h.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def grow_directory(weights: dict[int, int], max_depth: int, capacity: int, tasks: int) -> Directory:
    """The directory of an extendible hash that holds ``weights[p]`` bytes below each ``max_depth``-bit
    prefix p, and its buckets dealt to ``tasks`` owners as ranges of keys of about equal bytes."""
    held = np.zeros((1 << max_depth) + 1, dtype=np.int64)
    for prefix, n in weights.items():
        held[prefix + 1] = n
    upto = np.cumsum(held)

    def load(prefix: int, local: int) -> int:
        return int(upto[(prefix + 1) << (max_depth - local)] - upto[prefix << (max_depth - local)])

    depth, pointers, buckets, todo = 0, np.zeros(1, dtype=np.int32), [(0, 0)], [0]
    while todo:
        b = todo.pop()
        prefix, local = buckets[b]
        if local == max_depth or load(prefix, local) <= capacity:
            continue
        if local == depth:
            pointers, depth = np.repeat(pointers, 2), depth + 1
        buckets[b] = (2 * prefix, local + 1)
        buckets.append((2 * prefix + 1, local + 1))
        width = 1 << (depth - local - 1)
        pointers[(2 * prefix + 1) * width : (2 * prefix + 2) * width] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    # the middle of a bucket's bytes says which of the equal shares it belongs to
    middle = np.array([(upto[p << (max_depth - d)] + upto[(p + 1) << (max_depth - d)]) / 2 for p, d in buckets])
    owner = np.minimum(middle * tasks / max(1, upto[-1]), tasks - 1).astype(np.int32)
    return Directory(depth, pointers, [d for _, d in buckets], owner[pointers])


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def combine_entries(batches, directory: Directory, tasks: int, held_bytes: int = HELD_BYTES):
    """Rows (doc_id, body, h, sha) -> entries (task, h, sha, body, least_id, n), equal texts of a task
    combined. ``body`` is null in later entries of a text that the task found repeated before."""
    held: dict[bytes, list] = {}
    sent: set[bytes] = set()
    size, shift = 0, TaskContext.get().partitionId() if TaskContext.get() else 0
    kind = None

    def flush():
        rows = list(held.items())
        h = np.array([r[1][0] for r in rows], dtype=np.int64)
        counts = np.array([r[1][3] for r in rows])
        again = np.array([r[1][1] is None for r in rows])
        task = np.where((counts > 1) | again, (directory.owner(h) + shift) % tasks, directory.owner(h))
        sent.update(r[0] for r in rows if r[1][3] > 1)
        columns = [pa.array(task, pa.int32()), pa.array(h), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][1] for r in rows], pa.binary()), pa.array([r[1][2] for r in rows], kind), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["task", "h", "sha", "body", "least_id", "n"])

    for batch in batches:
        bodies, kind = batch.column("body"), batch.schema.field("doc_id").type
        for i, (doc_id, h, sha) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("sha").to_pylist(), strict=True)):
            if (entry := held.get(sha)) is not None:
                entry[2] = _least(entry[2], doc_id)
                entry[3] += 1
                continue
            body = None if sha in sent else bodies[i].as_py()
            held[sha] = [h, body, doc_id, 1]
            size += len(body or b"") + 200
            if size > held_bytes:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def own_buckets(batches):
    """Entries of an owner, sorted by hash, digest and null bodies last -> records (sha, least_id, n).
    Entries of one hash are chained and their bytes compared; an entry without body has the digest
    of one whose body its task has sent."""
    chain: list[list] = []
    at, kind = None, None
    out: list[tuple] = []

    def record():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), kind, pa.int64()), strict=True)], names=["sha", "least_id", "n"])

    for batch in batches:
        hashes, shas, least, counts, bodies = (batch.column(c) for c in ("h", "sha", "least_id", "n", "body"))
        kind = least.type
        for i, h in enumerate(hashes.to_pylist()):
            if h != at:
                out.extend(tuple(link[1:]) for link in chain)
                chain, at = [], h
            body, sha = bodies[i].as_py(), shas[i].as_py()
            for link in chain:
                if link[1] == sha if body is None else link[0] == body:
                    link[2] = _least(link[2], least[i].as_py())
                    link[3] += counts[i].as_py()
                    break
            else:
                chain.append([body, sha, least[i].as_py(), counts[i].as_py()])
        if len(out) >= 5000:
            yield record()
            out.clear()
    out.extend(tuple(link[1:]) for link in chain)
    if out:
        yield record()


def text_keys(docs: DataFrame) -> DataFrame:
    body = normalised()
    return docs.select("doc_id", F.xxhash64(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))


def build_index(docs: DataFrame, keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The index of ``docs``: of_sha, keep_id, group_size."""
    tasks = partitions(docs.sparkSession)
    prefix = F.shiftrightunsigned(F.col("h"), 64 - max_depth)
    weights = keys.groupBy("h").agg(F.max("n_bytes").alias("b")).groupBy(prefix.alias("prefix")).agg(F.sum("b").alias("b"))
    held = {r.prefix: r.b for r in weights.collect()}  # 2 ** max_depth rows at most
    directory = grow_directory(held, max_depth, min(bucket_bytes, sum(held.values()) // (4 * tasks)), tasks)

    body = normalised()
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select("doc_id", body.cast("binary").alias("body"), F.xxhash64(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("sha"))
    entries = scanned.mapInArrow(lambda it: combine_entries(it, directory, tasks, held_bytes), f"task int, h long, sha binary, body binary, least_id {kind}, n long")
    owned = entries.repartitionById(tasks, F.col("task")).sortWithinPartitions("h", "sha", F.col("body").isNull()).drop("task")
    records = owned.mapInArrow(own_buckets, f"sha binary, least_id {kind}, n long")
    index = records.groupBy(F.col("sha").alias("of_sha")).agg(F.min("least_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return materialise(index, "dedup-index")


def _answered(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, sha, keep_id, group_size of each row."""
    keys = materialise(text_keys(docs), "dedup-keys")
    index = build_index(docs, keys, **sizes)
    return keys.join(index, F.col("sha") == F.col("of_sha"), "left").select("doc_id", "sha", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. Null doc_ids lose against any
    other; a group of null doc_ids alone keeps them (keep_id null). Rows that repeat the smallest
    doc_id of their group are the same document and all are kept; group_size counts rows. No rows
    give no rows. doc_ids may be of any type that has an order. Columns other than doc_id and text
    are ignored. ``sizes``: those of :func:`build_index`.
    """
    return _answered(docs, **sizes).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    What goes is a narrow table, by doc_id and digest; texts are shuffled to meet it only where it
    is too large to broadcast.
    """
    of_id, of_sha = fresh(docs.columns, "of_id", "of_sha")
    gone = _answered(docs.select("doc_id", "text"), **sizes).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # repeated rows do no harm here; to remove them would keep Spark from splitting a hot text's rows in the join above
    gone = materialise(gone.select(F.col("doc_id").alias(of_id), F.col("sha").alias(of_sha)), "dedup-gone")
    own = F.unhex(F.sha2(normalised(), 256))
    return docs.join(by_size(gone, 128), docs["doc_id"].eqNullSafe(F.col(of_id)) & (own == F.col(of_sha)), "left_anti")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH keyed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
"""
