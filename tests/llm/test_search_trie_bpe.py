"""Lexical search, the prefix trie and byte-level BPE against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import byte_bpe, lexical, prefix_trie, queries

# -- lexical search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def ranked(documents, items, k=20):
    """Scores of all documents for all items."""
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked, found = TERM.findall((text or "").translate(LOWER)), []
        for i, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(map(str, out))


def searched(documents, items, k=20):
    return sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in lexical.search(documents, items, k).collect())


def corpus(n, seed=3):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "naïve", "ßx", "THE", "the", "a1b2", "中文"]
    return [(r.choice([i, i, i, i // 2]), " ".join(r.choices(words, k=r.randint(0, 60))) + r.choice(["", ", .", "\x1f"])) for i in range(n)], words


@pytest.mark.parametrize("shard", [1 << 20, 700])
def test_search_against_brute_force(rows, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    documents, words = corpus(300)
    documents += [(None, "w1 w2 the THE"), (None, None), (7, ""), (8, documents[5][1]), (9, documents[5][1]), (9, documents[5][1])]
    r = random.Random(4)
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(25)] + [(3, "the the THE w1"), (None, "naïve éa Éa"), (50, None), (51, " . "), (52, "unheard")]
    docs = rows("doc_id long, text string, id int, n string, terms string, score int", *[(*d, 1, "n", "t", 2) for d in documents])
    asked = rows("item_id long, text string, item int, q string, terms int", *[(*x, 1, "q", 2) for x in items])
    assert searched(docs, asked) == ranked(documents, items)
    assert searched(docs, asked, 3) == ranked(documents, items, 3)


def test_search_in_blocks_of_items(rows, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 4)
    documents, words = corpus(80)
    items = [(i, f"{words[i]} {words[-i]} the") for i in range(13)]
    assert searched(rows("doc_id long, text string", *documents), rows("item_id long, text string", *items)) == ranked(documents, items)


def test_search_of_empty_tables(rows):
    docs, items = rows("doc_id long, text string", (1, "a b")), rows("item_id long, text string", (1, "a"))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (rows("doc_id long, text string", (1, None)), items)):
        found = lexical.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_a_very_long_text_and_ties_at_the_end(rows):
    documents = [(0, "rare " + "w " * 200_000)] + [(i, "rare common") for i in range(60, 0, -1)] + [(100 + i, "common") for i in range(80)]
    items = [(1, "rare common"), (2, "w")]
    assert searched(rows("doc_id long, text string", *documents), rows("item_id long, text string", *items)) == ranked(documents, items)


def test_the_threshold_ends_the_search_early():
    """A few documents of high impact, many of low: most are never looked up."""
    n = 5000
    tf = np.where(np.arange(n) < 40, 30, 1)
    impacts = 1_000_000_000 * tf // (1000 * tf + 1200)
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int32), impacts, 1)
    best = lexical.Best(20, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    looked = shard.search(np.array([0]), np.array([500]), best)
    assert best.ids.tolist() == list(range(20)) and looked < 150 and not shard.seen.any()


# -- prefix trie --------------------------------------------------------------------------------------------------------


def rebuilt(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def nodes_of(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, rep int, node string, level int"


def trie(rows, turns):
    df = rows(SCHEMA, *[(*t, 1, "k", 2, "n", 3) for t in turns])
    found = prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(prefix_trie.numbered_turns(df)))
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in found.collect())


def talks(seed, convs=150, words=3, most=14):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), f"text {r.randrange(words)} " + "é" * r.randrange(2)) for c in [*range(95, 95 + convs), 1000, 1003] for t in range(r.randint(1, most) if c % 7 else 2)]


@pytest.mark.parametrize(("seed", "levels", "small"), [(1, 8, 1 << 16), (2, 2, 1 << 16), (3, 2, 40)])
def test_trie_against_brute_force(rows, monkeypatch, seed, levels, small):
    monkeypatch.setattr(prefix_trie, "LEVELS", levels)
    monkeypatch.setattr(prefix_trie, "SMALL", small)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    turns = talks(seed)
    # one conversation many times, some of them longer, and a deep one twice
    turns += [(200 * 100 + 100 * i, t, "user", f"same {t}") for i in range(40) for t in range(5 + (i % 9 == 0))]
    turns += [(90_000 + 100 * i, t, "user", f"deep {t}") for i in range(2) for t in range(30 + i)]
    turns += [(None, 1, "user", "nobody"), (300, None, None, None), (300, None, "user", "b"), (300, 4, "user", "b"), (300, 4, "user", "b"), (-7, 1, "user", "negative")]
    assert trie(rows, turns) == nodes_of(rebuilt([t for t in turns if t[0] != -7]) | {-7: [("user", "negative")][zlib.crc32(b"-7") % 6 :]})


def test_trie_of_few_conversations(rows):
    assert trie(rows, []) == [] and trie(rows, [(None, 1, "a", "b")]) == []
    for turns in ([(5, 1, "user", "x")], [(100, 1, "user", "x" * 3000), (200, 1, "user", "x" * 3000)], [(7, 1, "a", "bc"), (8, 1, "ab", "c")]):
        assert trie(rows, turns) == nodes_of(rebuilt(turns))


def test_a_long_conversation_is_numbered_over_ranges(spark, rows):
    turns = [(1, (i * 7919) % 5000, "user", str(i)) for i in range(5000)] + [(2, 1, "user", "x")]
    numbered = prefix_trie.numbered_turns(rows("conv_id long, turn long, role string, text string", *turns))
    got = {(r.conv_id, r.pos): r.chars for r in numbered.collect()}
    want = {(1, p + 1): len(t[3]) for p, t in enumerate(sorted((t for t in turns if t[0] == 1), key=lambda t: t[1]))} | {(2, 1): 1}
    assert got == want


# -- byte-level BPE -----------------------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.WordEncoder(RANKS)


def texts_of(seed):
    r = random.Random(seed)
    parts = ["'", "'s", "'re", "'ll", "ve", "s", "t", "m", "d", " ", "  ", "\n", "\t", "a", "É", "ß", "中", "९", "1", "２", "!", "?", ",", "😀", "é", "\r\n", "don't", "L", "Ⅷ", "\x1f", "\x00", "́", "ࡰ", "Ᲊ", "<|endoftext|>", "aa", " ", "　"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return out + ["".join(chr(r.choice([r.randint(1, 0x2FFF), r.randint(0x3000, 0xD7FF), r.randint(0xE000, 0x1FFFF), r.randint(97, 122)])) for _ in range(r.randint(0, 30))) for _ in range(400)]


def test_ids_are_those_of_the_library(rows, plain):
    texts = ["", None, " ", "'tis don't I'll we've '", "a'll'll", " 's", "''s", "aaaa" * 300, "ab" * 700, " " * 3000, "".join(random.Random(0).choices("abcdefgh", k=1500)), "<|endoftext|>", *texts_of(5)]
    df = rows("doc_id long, text string, ids string, decoded int", *[(i, t, "x", 1) for i, t in enumerate(texts)], (None, "no id", "x", 1), (3, "again", "x", 1))
    got = defaultdict(list)
    for r in byte_bpe.encode_documents(df, RANKS).collect():
        got[r.doc_id].append((np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)))
    for i, t in enumerate(texts):
        assert (plain.encode_ordinary(t or ""), (t or "").encode()) in got[i], t
    assert got[None] == [(plain.encode_ordinary("no id"), b"no id")] and len(got[3]) == 2
    assert byte_bpe.encode_documents(df.limit(0), RANKS).count() == 0


def test_classes_cover_all_characters_as_the_library_has_them(encoder, plain):
    """A letter or number goes on in a run, white space does not begin one: told by where single characters are split."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind, expression in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        single = tiktoken.Encoding("x", pat_str=expression, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        assert set(bytes(single.encode_ordinary("".join(every))).decode()) == {c for c in every if encoder.classes[ord(c)] == kind}


def test_what_is_kept_starts_anew(encoder, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "QUERY_WORDS", 7)
    for seed in (1, 2):
        texts = texts_of(seed)[:200]
        data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
        ids, ends, _, _ = encoder.texts(data, offsets)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode_ordinary(t) for t in texts]


def test_leftmost_lowest_pair_where_lower_ranks_follow(tmp_path):
    """A vocabulary in which a pair of a merged token has a lower rank than the token: equal pairs must not be taken together."""
    tokens = [bytes([i]) for i in range(256)] + [b"aba", b"abab", b"ab", b"bb", b"abb"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own, library = byte_bpe.WordEncoder(str(path)), tiktoken.Encoding("v", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choices("ab", k=n)) for n in [*range(1, 40), 70, 90, 200, 300] for _ in range(4)]
    data, offsets = np.frombuffer(" ".join(texts).encode(), np.uint8), np.array([0, len(" ".join(texts))])
    ids, _, decoded, _ = own.texts(data, offsets)
    assert ids.tolist() == library.encode_ordinary(" ".join(texts)) and decoded.tobytes() == data.tobytes()


# -- the queries as registered ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    documents, words = corpus(120, seed=8)
    documents = [(i, t) for i, (_, t) in enumerate(documents)] + [(500, None), (501, ""), (None, "w1 the")]
    items = [(i, " ".join(words[i::40])) for i in range(12)]
    turns = talks(6, convs=60)
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), documents, items, turns


def test_registered_queries(spark, tables, plain):
    at, documents, items, turns = tables
    run = lambda name: queries.queries()[name](spark, at)
    assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in run("op11_lexical_search").collect()) == ranked(documents, items)
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in run("op12_prefix_trie").collect()) == nodes_of(rebuilt(turns))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids := plain.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in documents}
    out = run("op13_byte_bpe")
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == want and dict(out.dtypes)["n_tokens"] == "bigint"


def test_registered_queries_on_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "benchmark", "conversations"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").filter(F.lit(False)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op11_lexical_search", "op12_prefix_trie", "op13_byte_bpe"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0
