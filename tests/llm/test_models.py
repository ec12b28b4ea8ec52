"""Toxicity, URLs, preferences and embeddings against brute force or held-out labels."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import DOCS, documents
from tests.llm.test_documents import roots
from tintwalk.llm import embeddings, preferences, toxicity, urls

SF = "/root/testdata/sf0.1"


# -- toxicity


def test_toxicity_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = toxicity.severity_grades(labels.where("doc_id % 3 <> 0"))
    model = toxicity.train(toxicity.sample(docs, seen))
    assert (np.diff(model.thresholds) >= 0).all()
    unseen = labels.where("doc_id % 3 = 0 and toxic is not null").select("doc_id", "toxic")
    got = toxicity.score(docs.join(unseen.select("doc_id"), "doc_id", "left_semi"), model).join(unseen, "doc_id").collect()
    caught = [r for r in got if r[-1] == 1]
    clean = [r for r in got if r[-1] == 0]
    assert sum(r[3] for r in caught) / len(caught) > 0.9  # of the labels, a few call junk toxic that has no toxic word
    assert sum(r[3] for r in clean) / len(clean) < 0.01
    assert np.mean([r.severity for r in caught]) > np.mean([r.severity for r in clean]) + 0.5


def test_likelihood_and_its_gradients():
    """Against the probability of each grade by its definition, and against differences."""
    rng = np.random.default_rng(1)
    s, t, y, weight = rng.normal(size=50) * 3, np.array([-0.5, 1.2]), rng.integers(0, 3, 50), rng.uniform(0.5, 2, 50)

    def brute(s, t):
        total = 0.0
        for x, grade, w in zip(s, y, weight, strict=True):
            above = [1.0, *(1 / (1 + math.exp(-(x - k))) for k in t), 0.0]
            total -= w * math.log(above[grade] - above[grade + 1])
        return total

    value, by_s, by_t = toxicity.likelihood(s, t, y, weight)
    assert value == pytest.approx(brute(s, t))
    for i in range(5):
        e = np.eye(50)[i] * 1e-5
        assert by_s[i] == pytest.approx((brute(s + e, t) - brute(s - e, t)) / 2e-5, rel=1e-4, abs=1e-6)
    for k in range(2):
        e = np.eye(2)[k] * 1e-5
        assert by_t[k] == pytest.approx((brute(s, t + e) - brute(s, t - e)) / 2e-5, rel=1e-4)


def test_scores_are_those_of_a_plain_sum(spark):
    """Severity, grade and verdict against sums over features one by one, by a model as trained."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.sample(docs, toxicity.severity_grades(labels)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        values = [(model.values[x], model.weights[x]) for x in toxicity.features(texts[r.doc_id]).tolist()]
        total = math.fsum(v for v, _ in values)
        s = math.fsum(v * w for v, w in values) * 2 * toxicity.DRAWN / (toxicity.DRAWN + total)
        above = [1 / (1 + math.exp(min(t - s, 700))) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(above), abs=1e-9)
        assert r.grade == sum(p >= 0.5 for p in above) or min(abs(p - 0.5) for p in above) < 1e-9
        assert r.toxic == (above[0] >= model.cut) or abs(above[0] - model.cut) < 1e-9


@pytest.mark.parametrize("grades, severity, toxic", [([], 0, False), ([0] * 9, 0, False), ([1] * 9, 1, True), ([2] * 9, 2, True), ([1, 2] * 5, 1.5, True)])
def test_toxicity_with_one_kind_of_rows(spark, grades, severity, toxic):
    rows = [(grade, 1.0, toxicity.features(f"word{i} other{i % 3}")) for i, grade in enumerate(grades)]
    model = toxicity.train(rows)
    found = toxicity.score(spark.createDataFrame([(1, "word1 other2"), (2, None)], "doc_id long, text string"), model).collect()
    assert [r.severity for r in found] == pytest.approx([severity] * 2) and all(r.toxic == toxic for r in found)


def test_toxicity_sample_is_bounded(spark):
    rows = [(i % 4, f"word{i} other{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    grades = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, grade int")
    found = toxicity.sample(docs, grades)
    assert len(found) == 4 and all(w == 1 for _, w, _ in found)
    assert len(toxicity.sample(docs, grades, per_grade=1)) == 2
    assert sum(len(x) for _, _, x in toxicity.sample(docs, grades, entries=10)) <= 20


def test_toxicity_edge_cases(spark):
    docs, none = spark.createDataFrame(documents(), DOCS), spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, 1, 0), (7, None, None), (None, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    grades = toxicity.severity_grades(labels)
    model = toxicity.train(toxicity.sample(docs, grades))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(documents()) and all(r.severity >= 0 for r in rows)
    assert toxicity.score(none, model).count() == 0
    unlabelled = toxicity.train(toxicity.sample(docs, grades.where("false")))
    assert all(r.severity < 1e-6 and not r.toxic for r in toxicity.score(docs, unlabelled).collect())


# -- urls


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:end], rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        head, _, start = rule.partition("/")
        if (host == head or host.endswith("." + head)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


PAGES = ["http://a.NET/", "https://example.net/en/x?q#f", "x://www.example.net/en", "ftp://example.com/de/1", "http://badexample.com/de/", "http://org/fr/", "http://w.org/fr/a#b", "no scheme", "", None, "://", "http://é.ORG/fr/", "http://h?x/fr/", "http://\nnet/", "http://example.net#/en/", "a://b://net/", "http://sub.example.com:80/de/"]


def test_rules_are_those_of_brute_force(spark):
    extra = [f"http://{h}.example.org/en/{p + 100 * (h == 'a')}" for h in "ab" for p in range(20)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(PAGES + extra)], "page_id long, url string, host string, n long")
    labels = spark.createDataFrame([(p + 100 * (h == "a"), int(h == "b"), int(h == "a")) for h in "ab" for p in range(20)], "doc_id long, quality int, toxic int")
    rows = urls.judge(pages, labels).collect()
    assert len(rows) == len(PAGES) + len(extra)
    for r in rows:
        host, path, rule, verdict = brute_rule((PAGES + extra)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict == ("block" if r.bad_lower > r.bad_limit else "allow")
    by_host = {r.host: r for r in rows}
    assert by_host["a.example.org"].verdict == "block" and by_host["b.example.org"].verdict == "allow"
    assert by_host["a.example.org"].bad_mean < 1 and by_host["b.example.org"].bad_mean > 0


def brute_reputation(hosts):
    """{host: (mean, weight)} from {host: (n, k)}, with priors from the pages of others alone."""
    keys = [{h: h for h in hosts}, {h: ".".join(h.rsplit(".", 2)[-2:]) for h in hosts}, {h: h.rsplit(".", 1)[-1] for h in hosts}, dict.fromkeys(hosts, "")]
    counts = []
    for key in keys:
        counts.append(defaultdict(lambda: np.zeros(2)))
        for h, nk in hosts.items():
            counts[-1][key[h]] += nk
    rhos = []
    for level in range(3):
        seen = chance = pages = 0
        for group, (n, k) in counts[level + 1].items():
            members = [counts[level][m] for m in {keys[level][h] for h in hosts if keys[level + 1][h] == group}]
            members = [m for m in members if m[0]]
            if 0 < k < n:
                seen += sum((b - a * k / n) ** 2 / a for a, b in members) / (k / n * (1 - k / n))
                chance += len(members) - 1
                pages += n - sum(a * a for a, _ in members) / n
        rhos.append(min(max((seen - chance) / (pages - chance), 0), 1))
    found = {}
    for h in hosts:
        of = [counts[i][keys[i][h]] for i in range(4)]
        n, k = of[3] - of[2]
        weight, mean = n + 1, (k + 0.5) / (n + 1)
        for i in (2, 1, 0):
            n, k = of[i] - of[i - 1] if i else of[0]
            prior = max(1 / (1 / (weight + 1) + rhos[i]) - 1, 1)
            mean, weight = (prior * mean + k) / (prior + n), prior + n
        found[h] = mean, weight
    return found


def test_posteriors_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = {}
    for i in range(60):
        n = int(rng.integers(0, 40))
        hosts[f"{'ab'[i % 2]}{i}.d{i % 7}.{['org', 'com', 'net'][i % 3]}"] = (n, int(rng.binomial(n, rng.choice([0.05, 0.2, 0.7]))))
    want = brute_reputation(hosts)
    rows = urls.reputation(spark.createDataFrame([(h, n, k) for h, (n, k) in hosts.items()], "host string, n long, k long")).collect()
    assert len(rows) == len(hosts)
    for r in rows:
        assert (r["mean"], r.weight) == pytest.approx(want[r.host])
        drawn = rng.beta(r["mean"] * r.weight, (1 - r["mean"]) * r.weight, 40_000)
        assert np.mean(drawn <= r.lower) == pytest.approx(urls.BOUND, abs=0.01)


@pytest.mark.parametrize("rate", [0.03, 0.5])
@pytest.mark.parametrize("pages, hosts, spread", [(10, 3, "even"), (86, 18, "even"), (400, 3, "one suffix"), (3000, 900, "skewed"), (100_000, 300, "skewed")])
def test_hosts_that_do_not_differ_are_not_blocked(spark, pages, hosts, spread, rate):
    rng = np.random.default_rng(pages)
    share = 1 / (1 + np.arange(hosts)) if spread == "skewed" else np.ones(hosts)
    n = rng.multinomial(pages, share / share.sum())
    names = [f"h{i}.d{i % 7}.{'org' if spread == 'one suffix' else ['org', 'com', 'co.uk', 'net'][i % 4]}" for i in range(hosts)]
    rows = [(h, int(a), int(rng.binomial(a, rate))) for h, a in zip(names, n, strict=True)]
    found = urls.reputation(spark.createDataFrame(rows, "host string, n long, k long"))
    assert found.where(F.col("lower") > urls.RATIO * F.col("base")).count() <= 0.05 * hosts


def test_hosts_that_differ_are_blocked(spark):
    rng = np.random.default_rng(8)
    rates = {f"h{i}.d{i}.{'org' if i % 2 else 'com'}": 0.8 if i % 10 == 0 else 0.1 for i in range(100)}
    rows = [(h, 30, int(rng.binomial(30, p))) for h, p in rates.items()]
    found = urls.reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()
    assert {r.host for r in found if r.lower > r.base} == {h for h, p in rates.items() if p == 0.8}


@pytest.mark.parametrize("bad", [0, 1])
def test_equal_outcomes_block_no_host(spark, bad):
    rows = [(f"h{i}.org", i, bad * i) for i in range(9)]
    assert urls.reputation(spark.createDataFrame(rows, "host string, n long, k long")).where("lower > base").count() == 0


def test_sites_and_domains(spark):
    hosts = {
        "www.example.com:802": ("com", "example.com"),
        "user:pass@a.b.co.uk:": ("co.uk", "b.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"),
        "[::1]:8080": ("[::1]", "[::1]"),
        "example.org.": ("org", "example.org"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
        "x.city.kawasaki.jp": ("jp", "kawasaki.jp"),
    }
    at = urls.site(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", urls.suffix(at).alias("s"), urls.domain(at).alias("d"), urls.domain(at, ["kawasaki.jp", "city.kawasaki.jp"]).alias("own")).collect()
    assert {r.host: (r.s, r.d) for r in rows} == hosts
    assert {r.host: r.own for r in rows}["x.city.kawasaki.jp"] == "x.city.kawasaki.jp"


def test_page_numbers_are_those_of_documents(spark):
    """Nearly every page of the supplied table shows the document whose number stands in its path, so that its labels are the page's outcome."""
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "<[^>]*>", " ")), r"[^\p{L}]", "")
    shown = pages.select(urls.item(urls.path(F.col("url"))).alias("doc_id"), plain(F.col("html")).alias("page"))
    both = shown.join(docs.select("doc_id", plain(F.col("text")).alias("doc")), "doc_id").where("length(doc) > 60")
    same = both.where(F.contains("page", F.substring("doc", 11, 40))).count()
    assert same > 0.95 * both.count() > 2000


def test_url_edge_cases(spark):
    pages, labels = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/"), (None, None)], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = urls.judge(pages, labels).collect()
    assert sorted(r.verdict for r in rows) == ["allow", "block", "block"]
    assert urls.judge(pages.where("false"), labels).count() == 0


# -- preferences


def escape(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def brute_render(turns):
    return "".join(f"<|{escape(role)}|>\n{escape(text)}<|end|>\n" for role, text in turns)


def brute_pair(x, y):
    """n_common, the three texts, and what is trained on in both completions."""
    n = next((k for k, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))
    trained = [[escape(t) + "<|end|>\n" for role, t in side[n:] if role == "assistant"] for side in (x, y)]
    return n, brute_render(x[:n]), brute_render(x[n:]), brute_render(y[n:]), *trained


def got_pairs(rows):
    out = {}
    for r in preferences.whole(rows).collect():
        masked = [[text[s.start : s.end] for s in mask] for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask))]
        out[r.pair.id] = (r.n_common, r.prompt, r.chosen, r.rejected, *masked)
    return out


def test_preference_pairs(spark):
    rng = random.Random(4)
    a, b = {}, {}
    for i in range(40):
        base = [(rng.choice(["user", "assistant", "<|end|>"]), f"text {rng.randrange(9)} \U0001f600 <|end|>\n<|user|> <\\|x") for _ in range(rng.randrange(6))]
        a[i] = base + [("assistant", f"a{rng.randrange(3)}") for _ in range(rng.randrange(3))]
        b[i] = base + [("assistant", f"a{rng.randrange(3)}") for _ in range(rng.randrange(3))]
    turns = lambda x: spark.createDataFrame([(i, k, *t) for i, ts in x.items() for k, t in enumerate(ts)], "conv_id int, turn int, role string, text string")
    rows = preferences.format_pairs(preferences.placed(turns(a)), preferences.placed(turns(b)))
    want = {i: brute_pair(a[i], b[i]) for i in a if a[i] and b[i]}
    assert got_pairs(rows) == want
    assert all(not re.search(r"<\|(?!user\||assistant\||end\||<)", w) for x in want.values() for w in x[1:4])


def test_preference_query_and_edge_cases(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "later"), (1, 3, "assistant", "two"), (2, 0, "user", "no answer"), (3, 1, "assistant", None), (3, 0, None, "q3"), (5, 0, "assistant", "five"), (5, 0, "assistant", "five"), (None, 0, "assistant", "x"), (None, None, "user", "y")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"long {i}") for i in range(300)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, rank int")
    by_id = defaultdict(list)
    for i, turn, role, text in rows:
        by_id[i].append((-1 if turn is None else turn, role or "", text or ""))
    by_id = {i: [t[1:] for t in sorted(ts)] for i, ts in by_id.items()}
    chosen, rejected = preferences.swapped_answers(turns)
    sides = [defaultdict(dict), defaultdict(dict)]
    for side, df in zip(sides, (chosen, rejected), strict=True):
        for r in df.collect():
            side[r.pair.id][r.place] = r.role, r.text
    listed = [{i: [x for _, x in sorted(ts.items())] for i, ts in side.items()} for side in sides]
    assert listed[0] == by_id
    order = [None, 1, 3, 5, 9]  # those with an answer, by id
    for i, ts in by_id.items():
        changed = [k for k, (x, y) in enumerate(zip(ts, listed[1][i], strict=True)) if x != y]
        assert len(changed) <= 1 and all(ts[k][0] == listed[1][i][k][0] == "assistant" for k in changed)
        if i in order:
            following = by_id[order[(order.index(i) + 1) % len(order)]]
            assert all(listed[1][i][k] in following for k in changed)
    assert listed[1][2] == by_id[2]
    want = {i: brute_pair(ts, listed[1][i]) for i, ts in by_id.items()}
    found = preferences.format_pairs(chosen, rejected)
    assert got_pairs(found) == want and any(0 < w[0] < len(by_id[i]) for i, w in want.items())
    assert found.where("part = 'prompt'").count() == sum(w[0] for w in want.values())
    none = preferences.format_pairs(*preferences.swapped_answers(turns.where("false")))
    assert none.count() == 0


def test_preference_query_is_its_sql(spark):
    con = duckdb.connect()
    rows = [(1, 0, "user", "q <|end|>"), (1, 1, "assistant", "<\\\\|x"), (None, 1, "assistant", None), (2, 0, "user", "\U0001f600"), (3, None, "assistant", "é\U0001f600"), (3, 0, "assistant", "two")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    small, supplied = preferences.swapped_answers(turns), spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for given, table in ((small, turns.toPandas()), (preferences.swapped_answers(supplied), supplied.toPandas())):
        con.register("conversations", table)
        cur = con.execute(preferences.ORACLE)
        columns = [c[0] for c in cur.description]
        got = preferences.format_pairs(*given).withColumn("conv_id", F.col("pair.id")).select(*columns).collect()
        assert Counter(map(tuple, got)) == Counter(cur.fetchall())


# -- embeddings


def brute_links(vectors):
    unit = {}
    for i, (_, v) in enumerate(vectors):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            x = np.array(v, dtype=np.float64)
            x /= np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    return [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9]


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = np.array(out[rng.integers(len(out))])
            near = base / np.linalg.norm(base) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.35, 0.6]) / math.sqrt(dim)
            out.append((near * rng.uniform(0.1, 9)).tolist())
        else:
            out.append(rng.normal(size=dim).tolist())
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_embedding_links(spark, block):
    vectors = [(i * 2, v) for i, v in enumerate(clustered(700, 32, block))]
    vectors += [(5001, None), (5003, []), (5005, [0.0] * 32), (5007, [None] * 32), (5009, [math.nan] * 32), (5011, [math.inf] + [1.0] * 31), (5013, [1e300] * 32), (5015, [1e-300] * 32), (5017, [1.0, 2.0]), (5019, [2.0, 4.0])]
    vectors += [vectors[0], (None, vectors[1][1])]
    links = brute_links(vectors)
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, row long")
    got = embeddings.link(df, block=block).collect()
    assert len(got) == len(vectors)
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    found, true = sum(r.n_links for r in got), sum(n.values())
    assert 0.95 * true <= found <= true
    ids = [v[0] for v in vectors]
    single = {ids[i]: n[i] for i in range(len(vectors)) if ids.count(ids[i]) == 1}
    assert all(r.n_links <= single[r.vec_id] for r in got if r.vec_id in single)
    by_id = {r.vec_id: r for r in got}
    assert by_id[5013].component_id == 5013 and by_id[5015].component_id == 5013 and by_id[5013].kept and not by_id[5015].kept
    assert by_id[5019].component_id == 5017
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept for i in (5001, 5003, 5005, 5007, 5009, 5011))
    want = roots(range(len(ids)), links)
    least = defaultdict(lambda: 10**9)
    for i, c in want.items():
        least[c] = min(least[c], ids[i] if ids[i] is not None else 10**9)
    agree = sum(by_id[ids[i]].component_id == least[want[i]] for i in range(len(ids)) if ids.count(ids[i]) == 1 and ids[i] is not None)
    assert agree >= 0.97 * (len(ids) - 3)


def test_embeddings_without_rows(spark):
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_on_the_supplied_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    unit = np.array([r.embedding for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = sum(int((unit[i : i + 500] @ unit.T >= 0.9).sum()) for i in range(0, len(unit), 500)) - len(unit)
    found = sum(r.n_links for r in embeddings.link(df).collect())
    assert 0.95 * true <= found <= true
