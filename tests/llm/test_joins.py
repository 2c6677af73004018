"""URL rules, licenses, near-duplicates, repeated passages and top-k against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import licenses, near_dup, substrings, topk, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_url_rules(spark, rows):
    rules = url_filter.rule_table(spark, [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "org", "/es/x"), ("allow", "a.org", "/es/x")])
    urls = ["http://EXAMPLE.org/es/1", "https://m.example.org/es/x?q", "x://a.org/es/x", "http://notexample.org/es/", "http://example.org", "no scheme", None, "http://a.com/a?b://c", "http://example.org#x"]
    pages = rows("page_id long, url string, host string, rule int, key string", *[(i, u, "h", 1, "k") for i, u in enumerate(urls)], (None, urls[0], "h", 1, "k"), (0, urls[0], "h", 1, "k"))
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, rules, default="allow").collect()}
    assert url_filter.url_verdicts(pages, rules).count() == len(urls) + 2
    assert [got[i].rule for i in range(9)] == ["example.org/es/", "example.org/es/", "a.org/es/x", "org/", None, None, None, None, None]
    assert got[0].verdict == "block" and got[2].verdict == "allow" and got[6].host == "" and got[4].path == "" and got[None].verdict == "block"
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0
    # equal lengths: the longer host, then block; void rules; a very long URL
    ties = rows("rule_verdict string, rule_host string, rule_path string", ("block", "b.org", "/xy"), ("allow", "a.b.org", "/"), ("allow", "b.org", "/xy"), (None, "b.org", "/xyz"), ("block", None, "/"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(rows("page_id long, url string", (1, "x://a.b.org/xyz"), (2, "x://b.org/xy"), (3, "x://b.org/xy" + "z" * 50_000)), ties).collect()}
    assert got == {1: ("a.b.org/", "allow"), 2: ("b.org/xy", "block"), 3: ("b.org/xy", "block")}
    assert url_filter.url_verdicts(pages, url_filter.rule_table(spark, [])).filter("rule is not null").count() == 0


def windows_with(text, template, least=0.8):
    split = lambda t: [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, t = split(text), split(template)
    own = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    stride, best = max(1, len(t) // 16), None
    for s in range(0, max(1, len(w)), stride):
        found = {tuple(w[i : i + 5]) for i in range(s, min(s + len(t), len(w)) - 4)} & own
        if own and len(found) / len(own) >= least and (best is None or len(found) / len(own) > best[0]):
            best = (len(found) / len(own), s)
    return best


def test_licenses_against_brute_force(rows):
    r = np.random.default_rng(0)
    noise = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "license", "the"], n))
    texts = [None, "", "mit license", noise(50)]
    for text in licenses.TEMPLATES.values():
        w = text.split()
        for _ in range(3):
            cut = list(w)
            for _ in range(len(w) // 25):
                cut[int(r.integers(len(w)))] = "changed"
            texts.append(f"{noise(int(r.integers(0, 60)))} {' '.join(cut)} {noise(int(r.integers(0, 40)))}")
    texts.append(noise(20_000) + " " + licenses.TEMPLATES["mit-grant"].upper())
    documents = rows("doc_id long, text string, license int, start string, words int, p int", *[(i, t, 1, "s", 1, 1) for i, t in enumerate(texts)], (0, texts[-1], 1, "s", 1, 1), (None, texts[-1], 1, "s", 1, 1))
    got = {(x.doc_id, x.license): x for x in licenses.license_matches(documents).filter("doc_id > 0").collect()}
    want = {(i, name): b for i, t in enumerate(texts) for name, template in licenses.TEMPLATES.items() if (b := windows_with(t, template))}
    assert got.keys() == want.keys()
    assert all(got[k].start == want[k][1] and math.isclose(got[k].containment, want[k][0], abs_tol=1e-5) for k in want)
    assert licenses.license_matches(documents.limit(0)).count() == 0


def test_many_templates_in_turn(rows, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES_AT_ONCE", 4)
    documents = rows("doc_id long, text string", *[(i, f"x {t} y") for i, t in enumerate(licenses.TEMPLATES.values())], (None, None))
    got = {(r.doc_id, r.license) for r in licenses.license_matches(documents).collect()}
    assert got >= set(enumerate(licenses.TEMPLATES)) and len(licenses.TEMPLATES) > 8


def sets_of(text, words=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(documents, percent):
    sets = {}
    for i, t in documents:
        sets.setdefault(i, []).append(sets_of(t))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j] if a and b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def copies(seed=4):
    """Texts in groups around the threshold, with a passage that half of all share."""
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(r.choice(words, 30))
    out = []
    for g in range(30):
        base = list(r.choice(words, int(r.integers(30, 120))))
        for _ in range(int(r.integers(1, 25 if g % 10 == 0 else 4))):
            own = list(base)
            for _ in range(int(r.integers(0, 4))):
                own[int(r.integers(len(own)))] = str(r.choice(words))
            out.append(" ".join(own) + (f" {passage}" if g % 2 else ""))
    return out


def test_near_duplicates_against_brute_force(rows):
    texts = copies()
    documents = [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, texts[0]), (905, texts[40])]
    for percent in (80, 85):
        df = rows("doc_id long, text string, node int, rep string, tokens int, kept string", *[(i, t, 1, "r", 1, "k") for i, t in documents], (None, texts[0], 1, "r", 1, "k"))
        got = near_dup.near_duplicates(df, percent=percent).collect()
        want = brute_components(documents, percent)
        assert len(got) == len(documents) + 1
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
        assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None and r.doc_id < 905} == {i: len(sets_of(t)) for i, t in documents if i < 905}
    assert near_dup.near_duplicates(rows("doc_id long, text string")).count() == 0


def test_large_nodes_find_what_all_pairs_find(rows, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE", 4)
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "LEVELS", 2)
    documents = list(enumerate(copies(9)))
    got = near_dup.near_duplicates(rows("doc_id long, text string", *documents), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(documents, 85)


def removed(documents, width):
    first, marks = {}, []
    for at, (_, t) in enumerate(documents):
        w = WORD.findall(t or "")
        marks.append(np.zeros(len(w), bool))
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), (at, k)) != (at, k):
                marks[-1][k : k + width] = True
    return marks


def test_repeats_against_brute_force(rows):
    r = np.random.default_rng(8)
    words = [f"é{i}" for i in range(50)]
    passage = " ".join(r.choice(words, 25))
    texts = [" ".join(r.choice(words, int(r.integers(0, 60)))) + ("\n" + passage if i % 3 == 0 else "") + ("  tail\t" if i % 4 == 0 else "") for i in range(40)]
    texts += [" ".join(["same"] * 50), passage + " " + passage, "", None, "x" * 30_000, texts[0]]
    ids = [int(x) for x in r.permutation(len(texts))]
    documents = sorted(zip(ids, texts, strict=True))
    df = rows("doc_id long, text string, block int, bucket string, n_words string", *[(i, t, 1, "b", "n") for i, t in zip(ids, texts, strict=True)])
    got = {x.doc_id: x for x in substrings.drop_repeats(df, width=7).collect()}
    for (i, t), gone in zip(documents, removed(documents, 7), strict=True):
        w = WORD.findall(t or "")
        assert (got[i].n_words, got[i].n_removed) == (len(w), int(gone.sum()))
        assert got[i].text == " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert sum(b - a for a, b in got[i].removed) == got[i].n_removed
    same = substrings.drop_repeats(rows("doc_id long, text string", (None, passage), (3, passage), (3, passage), (None, None)), width=7, spacing=True).collect()
    assert sorted(x.n_removed for x in same) == [0, 0, 25, 25]
    assert substrings.drop_repeats(df.limit(0)).count() == 0


def test_top_k_against_brute_force(rows, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in r.choice([0.0, 0.5, -0.25, 0.1], 3)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (104, [1.0])]
    df = rows("vec_id long, embedding array<float>, score int, id string, q int", *[(i, v, 1, "x", 1) for i, v in [*vectors, *odd]])
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter(F.col("vec_id") % 10 == 0), k=5).collect())
    cut = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors}
    want = []
    for q in range(0, 60, 10):
        scores = sorted((-sum(a * b for a, b in zip(cut[q], cut[i], strict=True)), i) for i in cut if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == want
    assert topk.top_k(df, df.limit(0)).count() == 0
    # repeated candidates each count, and scores beyond 2 ** 53 are exact
    big = rows("vec_id long, embedding array<double>", (0, [2.0**21, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 2.0]), (2, [2.0**21, 2.0]))
    got = sorted((x.rank, x.vec_id, x.score) for x in topk.top_k(big, big.filter("vec_id = 0"), k=3).collect())
    assert got == [(1, 1, 2**62 + 3 * 2**20), (2, 2, 2**62 + 2 * 2**20), (3, 2, 2**62 + 2 * 2**20)]


def test_blocks_of_ids_rise_with_them(spark, rows, monkeypatch):
    from paperloom.llm import common

    monkeypatch.setattr(common, "BORDERS", 3)
    monkeypatch.setattr(common, "BLOCK_CHARS", 10)
    df = rows("doc_id long, text string", *[(i * i, "x" * 10) for i in range(40)], (None, "y"), (-5, None))
    dealt, count = common.dealt_by_id(df, "doc_id", "text")
    got = [(r.doc_id, r.block) for r in dealt.collect()]
    ordered = [b for _, b in sorted((x for x in got if x[0] is not None))]
    assert ordered == sorted(ordered) and len(set(ordered)) > 15 and max(ordered) < count
    assert [b for i, b in got if i is None] == [count - 1]
