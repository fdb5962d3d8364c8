"""Native operators and exact duplicates against their SQL and against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from failscope.llm import exact_dedup, line_dedup, mixing

LONG = "this line is long enough to be counted as a key"
ODD = "id long, doc_id long, text string, lang string, source string, n_chars long, size int, key string, h long, words string, pos int"


def docs_of(spark, rows):
    """Rows (doc_id, text, source), with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(7, d, t, "en", s, len(t or ""), 1, "k", 2, "w", 3) for d, t, s in rows], ODD)


ROWS = [
    (1, "a  b\tc", "s1"), (2, "a b c", "s2"), (3, None, None), (4, "", "s1"), (5, " ", "s3"), (None, "a b c", "s2"), (6, "x" * 20000 + " y", "s1"),
    (7, "\n".join([LONG, "short", LONG]), "s2"), (8, LONG.upper() + "\n", "s2"), (9, "  " + LONG, "s2"), (10, LONG + "\r\nother", "s1"), (11, LONG, None), (2, "a b c", "s2"), (12, "only\x0bhere", "s4"), (None, None, None),
]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(docs_of(spark, ROWS)).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    wanted = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        wanted += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_exact_duplicates_with_splitting_directory(spark):
    rows = [(i, f"text {i % 40} " + "z" * (i % 40), "s") for i in range(200)]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows), bucket_bytes=64, max_depth=5).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 40, 5) for i in range(200)}


def test_directory_doubles_only_for_overfull_buckets():
    one = exact_dedup.grow_directory({0: 10, 15: 1}, 4, 12, 3)
    assert one.depth == 0 and one.local_depths == [0]
    some = exact_dedup.grow_directory({0: 10, 1: 10, 8: 3, 9: 5}, 4, 12, 2)
    assert some.depth == 4 and sorted(some.local_depths) == [1, 2, 3, 4, 4]  # the upper half stays one bucket
    assert len(set(some.pointers[8:])) == 1 and some.pointers[0] != some.pointers[1]
    assert (np.diff(some.owners) >= 0).all() and set(some.owners) == {0, 1}  # ranges of keys
    full = exact_dedup.grow_directory({0: 10**9}, 3, 1, 4)
    assert full.depth == 3 and full.local_depths.count(3) == 2


def entries_of(rows, **kw):
    batch = pa.RecordBatch.from_pylist(rows)
    return pa.Table.from_batches(list(exact_dedup.combine_entries(iter([batch]), exact_dedup.grow_directory({}, 2, 1, 4), 4, **kw))).to_pylist()


def test_a_repeated_text_leaves_its_body_once_a_task():
    row = {"doc_id": 3, "body": b"x" * 100, "h": 7, "sha": b"s"}
    others = [{"doc_id": i, "body": b"%d" % i * 50, "h": i, "sha": b"%d" % i} for i in range(10, 40)]
    out = entries_of([row, row, *others, {**row, "doc_id": 1}, *others], held_bytes=3000)
    mine = [e for e in out if e["sha"] == b"s"]
    assert [e["body"] is None for e in mine] == [False, True] and sum(e["n"] for e in mine) == 3


def test_colliding_hashes_are_told_apart_by_bytes():
    batch = pa.RecordBatch.from_pydict({"h": [5, 5, 5, 5, 6], "sha": [b"1", b"2", b"1", b"1", b"3"], "body": [b"x", b"y", b"x", None, b"x"], "least_id": [4, 2, 3, None, 9], "n": [1, 1, 2, 4, 1]})
    out = pa.Table.from_batches(list(exact_dedup.own_buckets(iter([batch])))).to_pylist()
    assert out == [{"sha": b"1", "least_id": 3, "n": 7}, {"sha": b"2", "least_id": 2, "n": 1}, {"sha": b"3", "least_id": 9, "n": 1}]


def test_hot_text_and_text_ids(spark):
    rows = [(f"d{i:04}", "hot" if i % 3 else f"own {i} {'z' * 200}", None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, own binary").repartition(7).withColumnsRenamed({"own": "of_sha"})
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, bucket_bytes=2000, max_depth=6, held_bytes=4000).collect()}
    assert got == {d: ("d0001", 600) if t == "hot" else (d, 1) for d, t, _ in rows}
    kept = exact_dedup.without_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 301 and kept.where("of_sha is not null").count() == 0


def test_without_exact_duplicates_keeps_columns(spark):
    docs = docs_of(spark, ROWS)
    kept = exact_dedup.without_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12]


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len([d for d in v if d is not None]) + (None in v) >= min_docs}
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_lines(spark, broadcast_bytes):
    assert rows_of(line_dedup.line_digests(docs_of(spark, ROWS), broadcast_bytes=broadcast_bytes)) == brute_lines(ROWS)
    many = [(i, "\n".join(f"{LONG} {j}" if (i + j) % 3 else f"own {i} {j}" for j in range(17 * i)), "s") for i in range(30)]
    assert rows_of(line_dedup.line_digests(docs_of(spark, many), broadcast_bytes=broadcast_bytes)) == brute_lines(many)


def test_postings_are_sorted_and_streamed_without_another_exchange(spark):
    postings = line_dedup.line_postings(docs_of(spark, ROWS))
    plan = line_dedup.frequent_lines(postings)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h" in plan and "Window" in plan and "Sort [h" in plan and "pos" in plan[plan.index("Sort [h") :].split("\n")[0]
    assert plan.count("Exchange") == 2  # the ranges, and one row a line and range


def test_lines_of_a_long_text(spark):
    text = "\n".join(f"{LONG} {i % 50_000}" for i in range(200_000))
    rows = [(i, text, "s") for i in range(4)] + [(4, text + "\nmore", "s")]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_digests(docs_of(spark, rows)).collect()}
    assert got == {**{i: (200_000, 200_000) for i in range(4)}, 4: (200_001, 0)}


def test_clashing_names(spark):
    docs = docs_of(spark, ROWS).withColumnsRenamed({"id": "__id", "lang": "of_id", "key": "dropped", "size": "__rk", "h": "OF_SHA", "words": "of_source"})
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert exact_dedup.without_exact_duplicates(docs).columns == docs.columns
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken"] and mixed.where("__id = 7").count() == mixed.count() > 0


def test_text_ids(spark):
    docs = docs_of(spark, ROWS).withColumn("doc_id", __import__("pyspark").sql.functions.expr("'d' || doc_id"))
    assert mixing.mixed_documents(docs).count() > 0 and line_dedup.line_digests(docs).count() == len(ROWS)


def test_lines_text_is_replaced(spark):
    rows = [(i, f"{LONG}\nown {i}", "s") for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs_of(spark, rows)).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "own 2", 3: "own 3", 4: f"{LONG}\nown 4"}


def test_mix_matches_sql(spark):
    docs = docs_of(spark, ROWS)
    got = mixing.mix_sources(docs, rows_per_range=2).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    wanted = con.sql(mixing.ORACLE).fetchall()
    assert rows_of(got) == sorted(map(repr, wanted))


def test_mix_properties(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 11, 4)}" if i % 13 else None) for i in range(400)]
    got = mixing.mix_sources(docs_of(spark, rows), rows_per_range=8).collect()
    total, taken, target = sum(r.size for r in got), defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == int(target[s]) for s in target)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    again = mixing.mix_sources(docs_of(spark, rows[::-1]).repartition(5), rows_per_range=8)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_mixed_documents(spark):
    docs = docs_of(spark, ROWS)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"]
    assert all(r.taken > 0 for r in mixed.collect())


@pytest.mark.parametrize("make", [exact_dedup.exact_duplicates, line_dedup.line_digests, mixing.mix_sources, mixing.mixed_documents, exact_dedup.without_exact_duplicates])
def test_empty_tables(spark, make):
    assert make(docs_of(spark, ROWS).where("false")).collect() == []
