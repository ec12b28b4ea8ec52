"""The stages of the pipeline, each against a brute-force version on its own input."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import DOCS, documents
from tests.llm.test_documents import brute_simhash, brute_spans, expected_targets, roots
from tintwalk.llm import mixing, packing, similar, stages
from tintwalk.llm.common import cut, written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_those_that_were_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "mix_to_target_weights", "pack"]


def test_language_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = stages.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() > 0.97 * docs.count()
    assert kept.where("lang is null").count() == 0
    assert kept.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    got = stages.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    have = [(r[0], brute_simhash(r[1])) for r in documents()]
    index = range(len(have))
    group = roots(index, [(i, j) for i in index for j in index if i < j and (have[i][1] ^ have[j][1]).bit_count() <= 3])
    kept = [(r.doc_id, brute_simhash(r.text)) for r in got.collect()]
    assert len(kept) == len(set(group.values()))
    of = {h: group[i] for i, h in enumerate(have)}
    assert sorted(of[k] for k in kept) == sorted(set(group.values()))


def test_personal_data_stage_redacts_and_keeps_all(spark, docs):
    got = stages.personal_data(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in documents())
    for r in got.collect():
        assert r.text is None or not brute_spans(r.text)
        assert r.n_chars == (len(r.text) if r.text is not None else r.n_chars)


def test_mixing_stage_repeats_documents(spark, docs):
    got = stages.target_weights(spark, docs, "")
    assert got.columns == docs.columns
    sizes, target = expected_targets(documents())
    have = rows(docs)
    taken = Counter()
    for row, n in rows(got).items():
        assert n <= 3 * have[row]
        taken[row[3]] += n * len((row[1] or "").split())
    for source in sizes:
        assert abs(taken[source] - target[source]) <= max(len((r[1] or "").split()) for r in documents() if r[3] == source) + 1


def test_packing_stage_is_the_operator(spark, docs):
    assert rows(stages.packed(spark, docs, "").drop("sequence_id")) == rows(packing.pack(docs).drop("sequence_id"))


@pytest.mark.parametrize("schema", [DOCS, PLAIN])
def test_empty_tables_go_through(spark, schema):
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_whole_pipeline_is_its_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows(whole) == rows(docs)
    assert whole.count() > 200


def test_marks_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 300, 5000, 40_000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        for kept in (1.0, 0.9, 0.5, 0.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < kept], rng.integers(-(2**63), 2**63, round(n * (1 - kept) * 1.3))]))
            shared = len(np.intersect1d(a, b))
            bound = similar.most_shared(len(a), len(b), similar.marks(a), similar.marks(b))
            assert shared <= bound <= shared + 0.3 * len(a) + 2


def test_no_pair_is_lost_by_rounding():
    k = np.arange(1, 4_000_000)
    assert similar.enough(4 * k, 9 * k, 0.8).all() and not similar.enough(4 * k - 1, 9 * k, 0.8).any()


def test_near_duplicate_stage_links_by_similarity(spark):
    """Near copies at a five-word similarity of 0.8 or more go, however many bits their fingerprints differ in; those below stay."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    common, texts = words(30), []
    for i in range(60):  # a passage that all share, and copies with one to nine words changed
        base = words(rng.randint(100, 300)) + common
        texts.append(base)
        for _ in range(12 if i < 3 else rng.randint(0, 2)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, 9)):
                copy[at] = f"x{rng.randrange(100_000)}"
            texts.append(copy)
    texts += [words(n) for n in (0, 1, 2, 4, 5, 6)] + [[], ["a"], ["A"], ["a", "b"]]
    rng.shuffle(texts)
    sets = [{tuple(x.lower() for x in t[i : i + 5]) for i in range(max(len(t) - 4, min(len(t), 1)))} for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    index = range(len(texts))
    pairs = [(i, j) for i in index for j in index if i < j and alike(sets[i], sets[j])]
    assert sum((brute_simhash(" ".join(texts[i])) ^ brute_simhash(" ".join(texts[j]))).bit_count() > 3 for i, j in pairs) > 20
    group = roots(index, pairs)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "web", 0) for i, t in enumerate(texts)], PLAIN)
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()) == sorted(set(group.values()))
    found = similar.near_duplicates(docs.repartition(3), least=0.6).collect()
    assert {r.doc_id: r.component_id for r in found} == roots(index, [(i, j) for i in index for j in index if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])])


def test_near_duplicate_stage_takes_candidates_of_simhash_first(spark, monkeypatch):
    """Copies are linked by these alone; texts that repeat one passage and end apart share a fingerprint but few shingles, and stay."""
    texts = ["alpha beta gamma " * 500 + " ".join(f"{end}{i}" for i in range(12)) for end in "xyz"]
    base = [f"w{i}" for i in range(3000)]
    texts += [" ".join(base), " ".join([*base[:-1], "end"])]
    prints = [brute_simhash(t) for t in texts]
    assert all((a ^ b).bit_count() <= 3 for part in (prints[:3], prints[3:]) for a in part for b in part)
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], PLAIN)
    monkeypatch.setattr(similar, "_first", lambda found, *_: found[:0])  # shingles give no candidates
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3]


def test_exploded_tables_are_not_broadcast(spark, docs, monkeypatch):
    """Spark sizes an explode, and what a task makes of its rows, too low: shingles, candidates and decided documents would go to the driver."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(similar, "written", lambda df, name: written(seen(df), name))
    monkeypatch.setattr(similar, "cut", lambda df, name: cut(seen(df), name))
    similar.near_duplicates(docs).collect()
    shingled = [p for p in plans if "Join" in p and "Generate posexplode" in p]
    marked = [p for p in plans if "MapInArrow run(a#" in p]
    assert shingled and not any("Broadcast" in p for p in shingled)
    assert len(marked) == 2 and all("SortMergeJoin [a#" in p for p in marked)
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in mixed and "Broadcast" not in mixed
