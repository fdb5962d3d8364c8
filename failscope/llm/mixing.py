"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source's keys are cut into ranges of equal width, so that
each range holds about ``rows_per_range`` documents however large its source is; documents are
sorted inside their range only. The prefix sum of a document is the sum of the ranges before its
own (a running sum over the small table of ranges) plus the running sum inside its range. The mix
takes whole epochs of a source and then cuts the next epoch at the exact word of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import by_size, fresh, materialise, table, whole_text

#: Keys have this many bits.
KEY_BITS = 60
#: A document is repeated so many times at most.
MAX_EPOCHS = 3


def word_count(col: str = "text") -> Column:
    """Runs of characters other than white space; null counts as empty."""
    return F.regexp_count(whole_text(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mixing_key(seed: int, col: str = "doc_id") -> Column:
    """Hash-random key of a document: the first 60 bits of an MD5 digest, as a long."""
    digest = F.md5(F.concat(F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row a source (source, source_size, n_docs) -> also sid, weight, target.

    Sources in order of code points, null last, weigh 1, 2, 3 and so on again. The sum of all sizes
    is dealt out by weight; a source takes ``max_epochs`` times its size at most, and what it can't
    take goes to the others by weight. The fixed point of that resharing is the least level L at
    which the sum of ``least(cap, L * weight)`` is the total; it is found with one running sum over
    the sources in order of cap/weight. One row a source is all that these windows see.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left_size", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level"))).over(everything))
        .withColumn("target", F.when(F.struct("ratio", "sid") < F.struct("final.ratio", "final.sid"), F.col("cap")).otherwise(F.col("final.level") * F.col("weight")))
        .select("source", "source_size", "n_docs", "sid", "weight", "target")
    )


def mix_sources(docs: DataFrame, seed: int = 17, max_epochs: int = MAX_EPOCHS, rows_per_range: int = 2048) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, epochs, key.

    ``taken`` is the number of words that the mix takes of the document, repeats counted: the
    words of all whole epochs of its source, and in the cut epoch all words before the budget's
    end, so that a source's documents sum to ``floor(target)`` exactly. ``epochs`` is the number of
    whole epochs of its source.

    Null texts have size 0; null sources are a source of their own, the last; a null doc_id has the
    key of an empty string. Equal keys are ordered by doc_id and size; rows equal in those are
    interchangeable. No rows give no rows. Other columns, whatever their names, are ignored.
    """
    sized = materialise(docs.select("doc_id", "source", word_count().alias("size"), mixing_key(seed).alias("key")), "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row a source; written, so that the plan below knows its size and every run sees the same numbers
    targets = materialise(source_targets(sizes, max_epochs), "mix-targets")

    n_ranges = F.ceil(F.col("n_docs") / F.lit(rows_per_range))
    at = F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * n_ranges)
    ranged = (
        sized.alias("d")
        .join(targets.withColumnRenamed("source", "of_source").alias("t"), F.col("source").eqNullSafe(F.col("of_source")))
        .select("doc_id", "source", "size", "key", "sid", "source_size", "target", F.least(at, n_ranges - 1).cast("long").alias("range_no"))
    )
    sums = ranged.groupBy("sid", "range_no").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("sid").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "range_no", F.coalesce(F.sum("range_size").over(ahead), F.lit(0).cast("long")).alias("range_before"))

    inside = Window.partitionBy("sid", "range_no").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["sid", "range_no"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        summed.withColumn("epochs", whole)
        .withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("before", F.col("range_before") + F.col("upto") - F.col("size"))
        .withColumn("cut", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - F.col("before"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "key")
    )


def mixed_documents(docs: DataFrame, seed: int = 17, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents that the mix takes words of, with all columns of ``docs`` and ``size``,
    ``target`` and ``taken`` of :func:`mix_sources` (columns of ``docs`` of these names go).

    Rows that share a doc_id, a source and a size are one document that the mix takes as often as
    it has rows; each of the rows has the largest ``taken`` of them.
    """
    mixed = mix_sources(docs, seed, max_epochs).groupBy("doc_id", "source", "size").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("taken").alias("taken"))
    of_id, of_source, of_size = fresh([*docs.columns, "size"], "of_id", "of_source", "of_size")
    mixed = mixed.where("taken > 0").select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size), "source_size", "target", "taken")
    # written, so that its size is known: texts are shuffled to meet it only where it is too large to broadcast
    mixed = by_size(materialise(mixed, "mix-taken"), 128)
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    sized = docs.select(*keep, word_count().alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col("size") == F.col(of_size))
    return sized.join(mixed, same).select(*keep, "size", "source_size", "target", "taken")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 15) AS BIGINT) AS key
    FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes),
weighed AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM ranked),
ordered AS (
    SELECT *, cap / weight AS ratio,
           sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
           sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
    FROM weighed),
numbered AS (SELECT *, left_size / left_weight AS level, row_number() OVER (ORDER BY ratio, sid) AS nth FROM ordered),
final AS (SELECT nth AS final_nth, level AS final_level FROM numbered WHERE ratio >= level ORDER BY nth LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN nth < final_nth THEN cap ELSE final_level * weight END AS target FROM numbered, final),
summed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM summed
"""
