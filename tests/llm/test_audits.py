"""The audits of filters and sources, and removal of repeated passages, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.llm.tables import DOCS, documents, prose
from tintwalk.llm import divergence, interactions, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- interactions of filters


def brute_interactions(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    failing = defaultdict(list)
    for i, text, _, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "A" if len(words) < 200 else ""
        fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
        fails += "D" if set(text) & set("#$%&*|") else ""
        fails += "E" if i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == text for r in rows) else ""
        failing[source or ""].append((fails, i in good, i in toxic))
    found = {}
    for part, docs in failing.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in docs)
                found[part, order, step] = (len(left), len(gone), fails - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        for key in [k for k in found if k[0] == part]:
            found[key] += (shapley[key[1][key[2] - 1]],)
    return found


def test_filter_interactions(spark, none):
    rows = documents()
    long = " ".join(f"word{i}" for i in range(250))
    rows += [(i, text, "en", "books", *rows[0][4:]) for i, text in enumerate([long, long + " $", long + " WWWW" * 20, long, long.upper()], 500)]
    rows += [(None, long, "en", "", *rows[0][4:]), (503, long, "en", "books", *rows[0][4:]), (499, "", None, "x", *rows[0][4:])]
    labels = [(i * 3 + 1, (0, 1, None)[i % 3], (1, 0, None)[i % 5 % 3]) for i in range(60)] + [(503, 0, 0), (503, 1, None), (None, 1, 1), (7, None, 1)]
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    found = interactions.audit(docs, labelled).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found)
    assert got == brute_interactions(rows, labels)
    assert interactions.audit(none, labelled).count() == 0
    unlabelled = interactions.audit(docs, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0 or part is null")
    assert unlabelled.count() == 0


def test_parts_are_given_out_as_they_are_counted(spark, monkeypatch):
    """More sources than a task holds at once."""
    rows = [(i, "some words", "en", f"source {i % 40}", *[None] * 8) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(1), spark.createDataFrame([], LABELS)
    whole = interactions.audit(docs, labels).groupBy("part").sum("removed").collect()
    monkeypatch.setattr(interactions, "HELD", 7)
    assert sorted(interactions.audit(docs, labels).groupBy("part").sum("removed").collect()) == sorted(whole)


# -- divergence of sources


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    found = set()
    for lang in in_docs:
        kept = {t for t, n in in_docs[lang].items() if n >= 3}
        groups = {source: {t: c for t, c in found_terms.items() if t in kept} for (of, source), found_terms in counts.items() if of == lang}
        whole = Counter()
        for group in groups.values():
            whole.update(group)
        share = lambda group, t: 1 + 10**9 * (group.get(t, 0) + 1) // (sum(group.values()) + len(kept))
        apart = lambda p, q: (p - q) ** 2 // q
        for source, group in groups.items():
            pairs = [(-sum(apart(share(group, t), share(other, t)) for t in kept), name.encode()) for name, other in groups.items() if name != source]
            terms = [(-apart(share(group, t), share(whole, t)), t.encode()) for t in group if share(group, t) > share(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                found |= {(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return found


def told(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_divergence_of_sources(spark, none, monkeypatch):
    rows = documents(160)
    rows += [(900 + i, f"Été ÉTÉ été {'Ünïque' * (i % 2)} w{i % 3} tail's", "fr", f"site{i % 5}", *rows[0][4:]) for i in range(30)]
    rows += [(990, "", "fr", "silent", *rows[0][4:]), (991, "alone", "it", "one", *rows[0][4:]), (992, "alone two", "it", "two", *rows[0][4:]), (993, None, None, None, *rows[0][4:])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_divergence(rows)
    assert told(divergence.audit(docs)) == want
    for name, value in (("HELD", 20), ("CELLS", 8), ("SUMS", 6)):  # all that is held is given out over and over
        monkeypatch.setattr(divergence, name, value)
    assert told(divergence.audit(docs)) == want
    assert divergence.audit(none).count() == 0


def test_shares_of_large_counts_are_exact():
    counts, sizes = np.array([10**13, 3, 10**18 // 7]), np.array([10**13 + 7, 10, 10**18])
    assert divergence._shares(counts, sizes).tolist() == [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(counts, sizes, strict=True)]
    shares, repeats = np.array([[10**9, 1, 7], [5, 10**9, 3]]), np.array([7, 2])
    want = [[sum(int(r) * ((int(p[a]) - int(p[b])) ** 2 // int(p[b])) for p, r in zip(shares, repeats, strict=True)) for b in range(3)] for a in range(3)]
    assert [x.tolist() for x in divergence._differences(shares, repeats)] == want
    with pytest.raises(OverflowError):
        list(divergence._differences(shares, repeats * 10))


# -- repeated passages


def brute_passages(rows):
    first = {}
    cut = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, words in cut:
        for at in range(len(words) - 49):
            if i is not None:
                key = tuple(words[at : at + 50])
                first[key] = min(first.get(key, i), i)
    found = []
    for i, words in cut:
        gone = set()
        for at in range(len(words) - 49):
            if i is not None and first[tuple(words[at : at + 50])] < i:
                gone.update(range(at, at + 50))
        kept = " ".join(w for at, w in enumerate(words) if at not in gone)
        found.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


def repeating(seed=5):
    rng = random.Random(seed)
    passage, other, line = prose(rng, 60), prose(rng, 130), prose(rng, 9)
    rows = documents()
    texts = [f"{prose(rng, rng.randint(0, 80))} {passage}\n{prose(rng, rng.randint(0, 80))}" for _ in range(25)]
    texts += [f"{prose(rng, 30)} {other[i * 40:]}\t{passage}" for i in range(6)] + [" ".join([line] * n) for n in (3, 6, 40, 41)]
    texts += [" ".join(passage.split()[:50]), " ".join(passage.split()[:49]), passage.replace(" ", "  \n"), passage.upper(), "x" * 500 + f" {passage} {'y' * 70}", "x" * 500 + f" {passage} {'y' * 71}"]
    texts += [prose(rng, 300) + " " + other] * 2 + ["\u00a0 \u2003 no-break " * 40] * 2
    rows += [(1000 - i if i % 3 else 1000 + i, t, *rows[0][2:]) for i, t in enumerate(texts)]
    rows += [(1001, passage + " " + prose(rng, 4), *rows[0][2:]), (None, passage, *rows[0][2:]), (None, texts[0], *rows[0][2:]), rows[-1], rows[-3], (2000, None, *rows[0][2:])]
    return rows


@pytest.mark.parametrize("bucket", [passages.BUCKET, 5, 0])
def test_repeated_passages(spark, bucket):
    rows = repeating()
    found = passages.without_repeats(spark.createDataFrame(rows, DOCS).repartition(4), bucket).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_passages(rows)
    assert sum(r.n_removed > 0 for r in found) > 30


def test_no_documents_have_no_passages(spark, none):
    assert passages.without_repeats(none).count() == 0


def test_stretches_cover_each_window_once(monkeypatch):
    words = prose(random.Random(1), 3000).encode().split()
    start, windows, minimiser = passages.stretches(words)
    assert start[0] == 0 and (start[1:] == (start + windows)[:-1]).all() and start[-1] + windows[-1] == len(words) - 49
    for at in range(0, 2900, 37):  # a window by itself has the minimiser of its stretch
        assert passages.stretches(words[at : at + 50])[2].tolist() == [minimiser[np.searchsorted(start, at, side="right") - 1]]
    monkeypatch.setattr(passages, "CHUNK", 7)
    assert [x.tolist() for x in passages.stretches(words)] == [x.tolist() for x in (start, windows, minimiser)]
    assert windows.max() <= 43 and len(start) < len(words) / 15
