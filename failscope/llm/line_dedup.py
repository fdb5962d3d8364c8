"""Repeated lines, with DataFrame functions only.

The lines whose key is long enough become postings (hash, document, position). They are
range-partitioned by hash and document, with a secondary sort by position, so that a line which a
third of all documents hold is spread over many ranges by its documents. A window streams over the
sorted ranges and marks the first occurrence of a line in a document; the first occurrences alone
are counted, a range leaves one row a hash, and the few rows of a hash are merged into how many
documents hold it and which is the last. The postings that lose are gathered per document as a
compressed bitmap: only words of 64 lines with a dropped one are kept. Bitmaps travel, and no text
does as long as all bitmaps together are known to fit into ``common.BROADCAST_BYTES``; beyond it
texts and bitmaps meet in a join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import BROADCAST_BYTES, SPACE_CHARS, fresh, materialise, partitions, table, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(col: str = "text") -> Column:
    """The lines of a text, split at line feeds; null and empty texts have one empty line."""
    return F.split(whole_text(col), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _UPPER.lower())


def row_key() -> Column:
    """Rows of one doc_id and text are the same document; rows of one doc_id and other texts are not."""
    return F.xxhash64(whole_text())


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, pos, h): the lines whose key has ``min_chars`` code points at least."""
    # the key below the generator: beside it, it would be worked out again for every line
    each = docs.select("doc_id", row_key().alias("row_key"), lines_of().alias("lines")).select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    # a line shorter than the limit can't have a key that reaches it: most lines go before any work
    keyed = each.where(F.char_length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    return keyed.select("doc_id", "row_key", "pos", F.unhex(F.md5("line")).alias("h"))


def frequent_lines(postings: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(of_h, last_id): the lines that ``min_docs`` documents hold, and the largest doc_id of them."""
    ranged = postings.repartitionByRange(partitions(postings.sparkSession), "h", "doc_id")
    # the range partitions already hold a line's postings of one document together: sorted there, streamed, no exchange
    stream = Window.partitionBy("h", "doc_id").orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(stream)).where("nth = 1")
    held = first.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))
    return held.where(F.col("n_docs") >= min_docs).select(F.col("h").alias("of_h"), "last_id")


def dropped_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_key, words): the lines that go, as array of words of 64 bits.

    Line ``pos`` goes if bit ``pos % 64`` of word ``pos div 64`` is set. The array ends with the last
    word that has a set bit; documents that lose nothing are left out. The result is written.
    """
    postings = materialise(line_postings(docs, min_chars), "line-postings")
    # written, so that Spark knows its size, and else can split the postings of a hot line in the join
    frequent = materialise(frequent_lines(postings, min_docs), "frequent-lines")
    lost = postings.join(frequent, F.col("h") == F.col("of_h")).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    words = lost.groupBy("doc_id", "row_key", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    sparse = words.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("s"))
    gap = lambda e, i: e["word"] - F.coalesce(F.get("s", i - 1)["word"], F.lit(-1)) - 1  # noqa: E731  empty words before this one
    dense = F.flatten(F.transform("s", lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(e, i)), F.array(e["bits"]))))
    return materialise(sparse.select("doc_id", "row_key", dense.alias("words")), "line-bitmaps")


def _goes(pos: Column, words: Column) -> Column:
    """Whether the bit of line ``pos`` is set; null bitmaps and words beyond the last have no set bit."""
    bits = F.coalesce(F.get(words, F.floor(pos / 64).cast("int")), F.lit(0).cast("long"))
    return F.getbit(bits, (pos % 64).cast("int")) == 1


def with_bitmaps(docs: DataFrame, name: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, and ``name``: the bitmap of the lines that go, null if none.

    Lines whose key (see :func:`line_key`) has ``min_chars`` code points and is held by ``min_docs``
    doc_ids go from all documents but those of the largest doc_id that holds it; there all
    occurrences stay. Null texts have one empty line. A null doc_id counts as a document that any
    other exceeds. Rows of the same doc_id and text are one document. No rows give no rows. Other
    columns, whatever their names, stay as they are.
    """
    bitmaps = dropped_bitmaps(docs, min_chars, min_docs)
    size = bitmaps.agg(F.coalesce(F.sum(F.size("words") * 8 + 64), F.lit(0))).first()[0]
    of_id, of_key, _ = fresh(docs.columns, "of_id", "of_key", name)
    bitmaps = bitmaps.select(F.col("doc_id").alias(of_id), F.col("row_key").alias(of_key), F.col("words").alias(name))
    if size <= broadcast_bytes:
        bitmaps = F.broadcast(bitmaps)
    return docs.join(bitmaps, docs["doc_id"].eqNullSafe(F.col(of_id)) & (row_key() == F.col(of_key)), "left").drop(of_id, of_key)


def kept(lines: Column, words: Column) -> Column:
    """The lines whose bit isn't set."""
    return F.when(words.isNull(), lines).otherwise(F.filter(lines, lambda line, i: ~_goes(i, words)))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text; see :func:`with_bitmaps`."""
    (name,) = fresh(docs.columns, "dropped")
    marked = with_bitmaps(docs, name)
    return marked.withColumn("text", F.array_join(kept(lines_of(), F.col(name)), "\n")).select(*docs.columns)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of ``docs``; see :func:`with_bitmaps`."""
    marked = with_bitmaps(docs.select("doc_id", "text"), "dropped", min_chars, min_docs, broadcast_bytes)
    split = marked.select("doc_id", lines_of().alias("lines"), "dropped").select("doc_id", "lines", kept(F.col("lines"), F.col("dropped")).alias("kept"))
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_dropped, kept_sha256."""
    return line_digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, row_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)),
keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
frequent AS (SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_no
"""
