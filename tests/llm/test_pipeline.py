"""The corpus pipeline stage by stage, and the queries that have SQL against it, on a small corpus."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import queries

TABLES = ("documents", "labels", "pages", "embeddings", "benchmark", "conversations")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(r.choice(words, 60))
    docs = []
    for i in range(120):
        text = " ".join(r.choice(words, 80))
        if i % 4 == 0:
            text += " vile horrid scum"
        if i % 5 == 1:
            text += " " + passage
        docs.append((i, text, "en", "s", len(text)))
    docs += [(200, docs[1][1], "en", "s", 5), (201, docs[2][1] + " more", "en", "s", 5), (202, "", "en", "s", 0), (203, None, None, None, None)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(["http://a.org/es/", "http://EXAMPLE.org/en/12", None])], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)], 0) for i in range(205)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    items = [(i, " ".join(r.choice(words, 12)) + " vile, VILE") for i in range(9)] + [(9, "none of it"), (10, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"say {(c // 40, t) if c % 3 else (c, t)}") for c in range(0, 240) for t in range(c % 5 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(out.collect(), out.schema)
            kept[name] = {x.doc_id: x.text for x in docs.collect()}
        else:
            packed = out.collect()
    toxic = {i for i in range(120) if i % 4 == 0}
    assert not toxic & kept["toxicity"].keys() and len(kept["toxicity"]) == 124 - len(toxic)
    assert kept["toxicity"].keys() - kept["near_duplicates"].keys() == {200, 201}
    assert kept["near_duplicates"].keys() == kept["repeated_passages"].keys()
    shorter = {i for i, t in kept["repeated_passages"].items() if len(t or "") < len(kept["near_duplicates"][i] or "")}
    holders = sorted(i for i in kept["near_duplicates"] if i < 120 and i % 5 == 1)
    assert shorter == set(holders[1:])
    assert {r.doc_id for r in packed} == kept["repeated_passages"].keys()


def test_run_is_the_stages_in_turn(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert rows and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, corpus, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{corpus}/{t}.parquet/*.parquet')")
    out = queries.queries()[name](spark, corpus)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
