"""The corpus pipeline against its parts stated plainly."""

import hashlib
import re

import pytest

import corpus_pipeline
from failscope.llm import decontamination, quality
from failscope.llm.common import table
from tests.llm.test_near_and_leaks import brute, shingle_sets

SF = "/root/testdata/sf0.01"


def test_stage_by_stage(spark):
    docs = table(spark, SF, "documents").cache()
    columns = docs.columns
    model = quality.train(docs, table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = table(spark, SF, "benchmark").collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    wanted = {d for d in rows if scores[d] >= quality.ACCEPT}
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if k == 1:
            first = {}
            for d in sorted(wanted):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d] or ""), d)
            wanted = set(first.values())
        elif k == 2:
            kept = [(d, rows[d]) for d in sorted(wanted)]
            wanted = {c for _, c, *_ in map(eval, brute(kept))}
        elif k == 3:
            sets = {r.item_id: s for r, s in zip(items, shingle_sets([(r.item_id, r.text) for r in items]), strict=True)}
            own = dict(zip(sorted(wanted), shingle_sets([(d, rows[d]) for d in sorted(wanted)]), strict=True))
            wanted = {d for d in wanted if not any(len(own[d] & s) >= decontamination.THRESHOLD * len(s) for s in sets.values())}
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        assert {r.doc_id for r in now.collect()} == wanted, names[k]
    mixed = {r.doc_id: r.taken for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert mixed == {d: n for d, n in brute_mix([r for r in docs.collect() if r.doc_id in wanted]).items() if n}


def brute_mix(rows, seed=17, most=3):
    """Words that the mix takes of each document: sources filled by weight, keys in order, cut at the word."""
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        open_ -= full
    out = {}
    for s in sources:
        key = lambda r: (int(hashlib.md5(f"{r.doc_id}:{seed}".encode()).hexdigest()[:15], 16), r.doc_id)
        own = sorted((r for r in rows if r.source == s), key=key)
        epochs, budget = divmod(int(target[s] + 1e-6), size[s]) if size[s] else (0, 0)
        for r in own:
            more = min(words[r.doc_id], budget)
            budget -= more
            out[r.doc_id] = epochs * words[r.doc_id] + more
    return out


EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some text of a few words", None, "b", None), (3, "one word " * 40_000, "en", "a", 1), (4, "one word " * 40_000, "en", "b", 1), (None, None, None, None, None),
    (5, "a clean text of some length that repeats nothing and is read by someone", "en", "a", 5), (5, "another text under the same number, also clean", "en", "a", 5),
]


def edge_tables(spark, tmp_path, rows):
    at = str(tmp_path / f"t{len(rows)}")
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __id string, of_sha string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "under the same number, also")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs


@pytest.mark.parametrize("rows", [EDGES, []])
def test_nulls_ties_repeats_and_empty_tables(spark, tmp_path, rows):
    at, docs = edge_tables(spark, tmp_path, rows)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in now.collect())
    # without two classes of labels all pass the classifier; of equal texts the least doc_id stays, null last
    assert kept == ([(False, 1, ""), (False, 3, "one word "), (False, 5, "a clean t"), (True, 0, "some text")] if rows else [])
    assert corpus_pipeline.run(spark, at).columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert corpus_pipeline.run(spark, at).count() == (3 if rows else 0)


def test_run_is_repeatable(spark, tmp_path):
    first, second = (sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert first == second and first
