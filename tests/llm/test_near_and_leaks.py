"""Jaccard join and containment search against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from failscope.llm import components, decontamination, near_dedup, shingles

SCHEMA = "key string, doc_id long, text string, labels string, block int"


def docs_of(spark, rows):
    return spark.createDataFrame([("k", d, t, "l", 1) for d, t in rows], SCHEMA)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    rows, rng = [], random.Random(3)
    for i in range(25):
        base = words(rng.randrange(20, 400), i)
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(6)):
            near = list(base)
            for _ in range(max(1, len(near) // rng.choice([20, 60, 120]))):
                near[rng.randrange(len(near))] = f"new{rng.randrange(99)}"
            rows.append((len(rows), " ".join(near).upper() if rng.random() < 0.3 else "  ".join(near)))
    return [*rows, (900, ""), (901, None), (902, "one two"), (903, "ONE two"), (904, "one two three"), (None, rows[0][1]), (5, rows[5][1]), (905, "")]


def shingle_sets(rows):
    out = []
    for _, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        out.append(frozenset(zip(*[own[i:] for i in range(5)], strict=False)) if len(own) >= 5 else frozenset([tuple(own)] if own else []))
    return out


def brute(rows, threshold=0.8):
    sets = shingle_sets(rows)
    members = defaultdict(list)
    for (doc_id, _), own in zip(rows, sets, strict=True):
        members[own].append(doc_id)
    keys = [k for k in members if k]
    parent, links = {k: k for k in keys}, Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    group = defaultdict(list)
    for k in keys:
        group[root(k)] += members[k]
    out = []
    for (doc_id, _), own in zip(rows, sets, strict=True):
        out.append((doc_id, least(group[root(own)]), least(members[own]), len(members[own]), links[own]) if own else (doc_id, doc_id, doc_id, 1, 0))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, block):
    rows = corpus()
    got = near_dedup.near_duplicates(docs_of(spark, rows), block=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_one_hot_group(spark):
    """Hundreds of near copies of one text: every link counted, no pair listed."""
    base, rows = words(300, 1), []
    for i in range(150):
        near = list(base)
        near[i] = "changed"
        rows.append((i, " ".join(near)))
    got = near_dedup.near_duplicates(docs_of(spark, rows), block=16).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 149)}


def test_one_of_each_class(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    kept = near_dedup.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {eval(x)[1] for x in brute(rows) if eval(x)[1] is not None}


def test_rows_of_one_doc_id_are_judged_by_their_text(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (5, " ".join([*words, "more"])), (5, "another clean text of its own words"), (5, None)]
    kept = near_dedup.one_of_each_class(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((i, t or "") for i, t in (rows[0], *rows[2:]))


def test_stop_depth_reaches_recall():
    depth = near_dedup.stop_depth()
    assert 1 - (1 - 0.8**depth) ** near_dedup.TREES >= near_dedup.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** near_dedup.TREES


def test_stop_depths_follow_what_a_size_allows():
    depths = near_dedup.stop_depths(0.8, near_dedup.TREES, near_dedup.RECALL)
    assert depths[1:4] == (9, 9, 9)  # sets of one to three shingles have no other neighbour than copies
    assert depths[4] == near_dedup.stop_depth(0.8) and depths[6] == near_dedup.stop_depth(5 / 6) > depths[-1]


def test_labels_are_tries_of_minhashes():
    values = np.random.default_rng(2).integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = [values, values[3:]]
    marks = near_dedup.labels(np.concatenate(sets), np.array([0, 100, 197]), 16)
    depth = near_dedup.common_depth(marks[0], marks[1])
    by_hand = []
    for a, b in zip(marks[0], marks[1], strict=True):
        each = lambda x: [int(h) >> s & 0xFFFF for h in x for s in (48, 32, 16, 0)]
        by_hand.append(next((i for i, (v, w) in enumerate(zip(each(a), each(b), strict=True)) if v != w), 8))
    assert depth.tolist() == by_hand and max(by_hand) == 8


def test_recall_at_the_threshold():
    """Pairs whose similarity is just the threshold: nearly all agree in a prefix and in enough values."""
    rng, found, n = np.random.default_rng(1), 0, 300
    for _ in range(n):
        common, own = rng.integers(0, 1 << 62, 80, dtype=np.uint64), rng.integers(0, 1 << 62, 20, dtype=np.uint64)
        a, b = np.concatenate([common, own[:10]]), np.concatenate([common, own[10:]])
        marks = near_dedup.labels(np.concatenate([a, b]), np.array([0, 90, 180]), near_dedup.TREES)
        deep = near_dedup.common_depth(marks[0], marks[1]).max() >= near_dedup.stop_depth()
        sizes, stops = np.array([90, 90]), np.full(2, near_dedup.stop_depth())
        found += deep and near_dedup.plausible(0, near_dedup.stop_depth(), np.zeros(2), marks, sizes, stops, 0.8).all() or deep and (near_dedup.common_depth(marks[0], marks[1])[:1] == 0).all()
    assert found >= 0.99 * n
    assert 60 < near_dedup.least_agreeing(0.8, 128) < 102


def test_clashing_columns(spark):
    docs = docs_of(spark, corpus()[:40]).withColumnsRenamed({"key": "__gone", "labels": "of_id", "block": "of_digest"})
    assert near_dedup.one_of_each_class(docs).columns == docs.columns


def test_shared_sizes_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(20)]
    pairs = np.array([(i, j) for i in range(20) for j in range(i)])
    wanted = [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    assert near_dedup.shared_sizes(sets, pairs).tolist() == wanted
    assert near_dedup.shared_sizes(sets, pairs[:50]).tolist() == wanted[:50]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100)], "child long, parent long")
    assert {(r.child, r.parent) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
    assert components.components(edges.where("false")).collect() == []


def leak_rows():
    items = [(0, " ".join(words(20, 500))), (1, " ".join(words(59, 501))), (2, " ".join(words(6, 502))), (3, "two words"), (4, None), (5, ""), (8, "a\u00a0b\u00a0c\u00a0d\u00a0e"), (6, " ".join(words(14, 503))), (7, " ".join(words(200, 504)))]
    rng, docs = random.Random(9), []
    for i in range(60):
        body = words(rng.choice([0, 3, 50, 3000]), 1000 + i)
        for _, item in rng.sample(items, 2):
            own = (item or "").split()
            if own and rng.random() < 0.4:
                own[rng.randrange(len(own))] = "altered"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((i, " ".join(body)))
    return [*docs, (70, None), (None, items[0][1]), (71, items[0][1]), (71, items[0][1])], items


def test_contaminations(spark):
    rows, items = leak_rows()
    got = decontamination.contaminations(docs_of(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")).collect()
    wanted = []
    item_sets = {i: s for (i, _), s in zip(items, shingle_sets(items), strict=True) if s}
    for (doc_id, text), every in zip(rows, shingle_sets(rows), strict=True):
        for i, s in item_sets.items():
            k = len(next(iter(s)))
            own = every
            if k < 5:
                w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
                own = set(zip(*[w[n:] for n in range(k)], strict=False))
            if len(own & s) >= 0.8 * len(s) - 1e-9:
                wanted.append((doc_id, i, len(s), len(own & s), len(own & s) / len(s)))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, wanted)) and wanted


def test_contaminations_match_sql(spark):
    import duckdb

    rows, items = leak_rows()
    rows = [*rows, (200, "here Two  words here"), (201, "two"), (202, "one word"), (203, "words two")]
    items = [*items, (20, "word"), (21, "one two three"), (22, "two  WORDS")]
    con = duckdb.connect()
    documents, benchmark = docs_of(spark, rows).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminations(documents, benchmark).collect()
    con.register("documents", documents.toArrow())
    con.register("benchmark", benchmark.toArrow())
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.sql(decontamination.ORACLE).fetchall()))
    assert {(200, 3), (200, 22), (202, 20)} <= {(r.doc_id, r.item_id) for r in got} and not {201, 203} & {r.doc_id for r in got}


@pytest.mark.parametrize("parts", [2, 4, 8])
def test_recall_of_strewn_items(spark, parts):
    """Items cut into parts that stand far from each other: all of them are found."""
    items = [(i, " ".join(words(150 + 7 * i, 9000 + i))) for i in range(40)]
    docs = []
    for i, text in items:
        own, body = text.split(), words(6000, 20_000 + i)
        for n in range(parts):
            at = n * len(body) // parts + 100
            body[at:at] = own[n * len(own) // parts : (n + 1) * len(own) // parts]
        docs.append((i, " ".join(body)))
    sets = {i: s for (i, _), s in zip(items, shingle_sets(items), strict=True)}
    wanted = {i for (i, _), s in zip(docs, shingle_sets(docs), strict=True) if len(s & sets[i]) >= 0.8 * len(sets[i]) - 1e-9}
    got = {r.doc_id for r in decontamination.contaminations(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(wanted) >= 35 and got == wanted


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d1", "a b c d e f g"), ("d2", None)], "doc_id string, text string")
    items = spark.createDataFrame([("x", "B c d e f"), (None, "f g")], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id or "", r.containment) for r in decontamination.contaminations(docs, items).collect()) == [("d1", "", 1.0), ("d1", "x", 1.0)]


def test_contaminations_in_blocks(spark, monkeypatch):
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = decontamination.contaminations(docs_of(spark, rows), table).collect()
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (5, 20))
    assert len(list(decontamination.item_blocks(table))) >= 2
    assert sorted(map(repr, decontamination.contaminations(docs_of(spark, rows), table).collect())) == sorted(map(repr, whole))


def test_without_contaminated(spark):
    rows, items = leak_rows()
    docs, table = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    dirty = {r.doc_id for r in decontamination.contaminations(docs, table).collect()}
    kept = decontamination.without_contaminated(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - dirty
    assert decontamination.without_contaminated(docs, table.where("false")).count() == len(rows)
    assert decontamination.contaminations(docs.where("false"), table).count() == decontamination.contaminations(docs, table.where("false")).count() == 0


def test_empty_documents(spark):
    assert near_dedup.near_duplicates(docs_of(spark, corpus()).where("false")).collect() == []


def test_shingles_match_words():
    texts = ["a b c d e f g", "A b  C\td e\nf\x0bg ", "x y", "x Y z", "", "   ", None, "é È foo bar baz qux " * 3, "z" * 3_000_000 + " a b c d e", "w " * 700_000]
    hashes, offsets = shingles.shingle_batch(pa.array(texts))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [len(s) for s in sets] == [len(s) for s in shingle_sets([(0, t) for t in texts])]
    assert sets[0] == sets[1] and len(sets[0] & sets[8]) == 1 and not sets[0] & sets[7]
    alone = [set(shingles.shingle_set(t).tolist()) for t in texts]
    assert alone == sets
