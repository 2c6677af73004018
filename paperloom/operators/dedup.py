"""De-duplication of papers by identifiers, hashes, titles and fuzzy titles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.sources.steps import saved


def duplicate_groups(df: DataFrame, id_column: str, key: Column) -> DataFrame:
    """key_hash, n_rows, keep_id (the least) of every key that more than one row has; null keys equal nothing."""
    rows = df.select(F.col(id_column).alias("id"), key.alias("key_hash")).filter(F.col("key_hash").isNotNull())
    return rows.groupBy("key_hash").agg(F.count("*").alias("n_rows"), F.min("id").alias("keep_id")).filter("n_rows > 1")


def members(df: DataFrame, id_column: str, key: Column) -> DataFrame:
    """id, first_id, n_others of every row whose key others have too: its group by the least id, not all its pairs."""
    rows = df.select(id_column, key.alias("key_hash")).filter(F.col("key_hash").isNotNull())
    groups = rows.groupBy("key_hash").agg(F.min(id_column).alias("first_id"), (F.count("*") - 1).alias("n_others")).filter("n_others > 0")
    return rows.join(groups, "key_hash").select(id_column, "first_id", "n_others")


#: Signals in the order in which they decide.
SIGNALS = ("doi", "arxiv", "source_id", "text", "title")


def identity_keys(papers: DataFrame, stored: bool, normalize: bool = False) -> DataFrame:
    """priority, key, id: what a paper is known by, for each signal that it has. Empty and null values are no keys.

    papers: id, doi, arxiv_id, source, source_id, title, full_text. stored: DOIs and arXiv ids as they are, unless normalize.
    """
    some = lambda c: F.when(c != "", c)
    doi = F.col("doi") if stored and not normalize else T.doi_key(F.col("doi"))
    arxiv = F.col("arxiv_id") if stored and not normalize else T.arxiv_key(F.col("arxiv_id"))
    pair = F.when(F.col("source").isNotNull() & (F.coalesce("source_id", F.lit("")) != ""), F.concat_ws("\x01", "source", "source_id"))
    values = [some(doi), some(arxiv), pair, T.text_hash(F.col("full_text")), some(T.title_key(F.col("title")))]
    each = F.array(*[F.struct(F.lit(i).alias("priority"), v.alias("key")) for i, v in enumerate(values)])
    return papers.select("id", F.inline(each)).filter(F.col("key").isNotNull()).select("priority", "key", "id")


def matched(keys: DataFrame, known: DataFrame) -> DataFrame:
    """id, signal, existing_id of each paper of keys that has a key of another paper of known: by the first signal, and of several papers the least id."""
    first = known.groupBy("priority", "key").agg(F.min("id").alias("existing_id"))
    hits = keys.join(first, ["priority", "key"]).filter("id <> existing_id")
    names = F.array(*[F.lit(s) for s in SIGNALS])
    best = hits.groupBy("id").agg(F.min(F.struct("priority", "existing_id")).alias("best"))
    return best.select("id", F.element_at(names, F.col("best.priority") + 1).alias("signal"), F.col("best.existing_id").alias("existing_id"))


def cascade(new: DataFrame, known: DataFrame, normalize_both: bool = False) -> DataFrame:
    """id, signal and existing_id of each new paper that a known one matches: by DOI, arXiv id, source and source_id, text, then title.

    Of several matches of a signal the least id. Known DOIs and arXiv ids are compared as they are stored unless
    normalize_both. Each signal is an equi-join on a hashed or short key, so no pair of papers without a common key is met.
    """
    return matched(identity_keys(new, False), identity_keys(known, True, normalize_both))


def similar_titles(titles: DataFrame, id_column: str, title: Column, least: float = 0.85, also: Column | None = None) -> DataFrame:
    """a, b (a < b), similarity: pairs of rows whose titles are equal or have trigram sets of a Jaccard likeness of at least `least`.

    also: a key that a pair must have in common, such as the authors; rows where it is null have no pairs. Blank titles
    have none either, and titles of fewer than three characters equal ones only. Equal titles (and keys) are one
    representative. Two sets of that likeness differ in at most (1 - least) / (1 + least) of their sizes' sum, so of one
    part more than that, dealt by a hash of the trigrams, one is the same in both: only titles with a part in common
    are joined, of sizes that allow it, and only those whose parity sketches differ in few enough bits are compared by
    their trigrams. Pairs of equal titles are returned between each id and the least id of its title only.
    """
    rows = titles.select(F.col(id_column).alias("id"), title.alias("t"), (F.lit("") if also is None else also).alias("also")).filter((F.col("t") != "") & F.col("also").isNotNull())
    distinct = saved(rows.groupBy("t", "also").agg(F.min("id").alias("rep")))
    parts = F.arrow_udf(lambda column: trigram_parts(column, least), PARTS)(F.col("t"))
    long_enough = distinct.filter(F.length("t") >= 3)
    signed = saved(long_enough.select("rep", "also", parts.alias("x")).select("rep", "also", "x.n", "x.sketch", F.inline("x.parts")))
    a, b = (signed.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("home").alias(f"h{x}"), "also", "class", "part", "sum") for x in ("a", "b"))
    differing = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)), F.lit(0))
    alike = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (differing <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-9)
    # titles of a size class meet each other and, as those of the next smaller one, each of these once
    once = F.col("ha") & (~F.col("hb") | (F.col("a") < F.col("b")))
    pairs = a.join(b, ["also", "class", "part", "sum"]).filter(once & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = pairs.join(long_enough.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a").join(long_enough.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")
    both = F.arrow_udf(common_trigrams, "both long, every long")(F.col("ta"), F.col("tb"))
    likeness = F.col("x.both") / F.col("x.every")
    found = met.select("a", "b", both.alias("x")).withColumn("similarity", likeness).filter(F.col("similarity") >= least).select("a", "b", F.round("similarity", 6).alias("similarity"))
    equal = rows.join(distinct, ["t", "also"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(equal)


#: Words of 64 bits of a parity sketch.
SKETCH = 4
PARTS = "n int, sketch array<long>, parts array<struct<home: boolean, class: int, part: int, sum: long>>"


def trigram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def size_classes(most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The greatest set size of each class, up to the one after that of `most`, and its parts. Sets of likeness `least` are of one class or of two that follow."""
    ends, low = [], 1
    while len(ends) < 2 or ends[-2] < most:
        ends.append(max(low, int(low / least + 1e-9)))
        low = ends[-1] + 1
    ends = np.array(ends)
    return ends, np.floor(2 * ends * (1 - least) / (1 + least) + 1e-9).astype(np.int64) + 1


def trigram_parts(titles: pa.Array, least: float) -> pa.Array:
    """Of each title the number of its trigrams, the sketch of which of so many bits an odd number of them has, and the sums of the trigrams' hashes in each part, in its own size class (home) and in the next one."""
    sets = [trigram_codes(t) for t in titles.to_pylist()]
    ends, count = size_classes(max(map(len, sets), default=1), least)
    own = np.searchsorted(ends, [len(s) for s in sets])
    sketches, lengths, out = np.zeros((len(sets), SKETCH), np.uint64), np.zeros(len(sets), np.int64), []
    for i, codes in enumerate(sets):
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        np.bitwise_xor.at(sketches[i], (h >> np.uint64(6)) % np.uint64(SKETCH), np.uint64(1) << (h & np.uint64(63)))
        for k in (own[i], own[i] + 1):
            sums = np.zeros(count[k], np.uint64)
            np.add.at(sums, (h >> np.uint64(20)) % np.uint64(count[k]), h)
            out.append((np.full(count[k], k == own[i]), np.full(count[k], k), np.arange(count[k]), sums.view(np.int64)))
            lengths[i] += count[k]
    columns = [np.concatenate([o[j] for o in out] or [np.zeros(0)]).astype(t) for j, t in enumerate((bool, np.int32, np.int32, np.int64))]
    parts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["home", "class", "part", "sum"]))
    sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(sketches.view(np.int64).ravel()))
    return pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int32()), sketch, parts], names=["n", "sketch", "parts"])


def common_trigrams(left: pa.Array, right: pa.Array) -> pa.Array:
    """How many distinct trigrams two titles have in common, and together."""
    sizes = []
    for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
        x, y = trigram_codes(a), trigram_codes(b)
        sizes.append((len(x) + len(y), len(np.intersect1d(x, y, assume_unique=True))))
    total, both = np.array(sizes, np.int64).reshape(-1, 2).T
    return pa.StructArray.from_arrays([pa.array(both), pa.array(total - both)], names=["both", "every"])


def signals(new: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """id, signal, existing_id, auto_merge, candidates of each new paper: doi_match or title_source_match with a known one, which merges, else the known papers of similar titles to be looked at.

    Both sides: id (unique over both), doi, source, title. DOIs are compared normalised; then equal titles of one source; of several known
    papers the least id. candidates: the classes of equal titles, each by its least known id, that are similar.
    """
    some = lambda c: F.when(c != "", c)
    keyed = lambda df: df.select("id", some(T.doi_key(F.col("doi"))).alias("doi"), some(T.fuzzy_title(F.col("title"))).alias("t"), "source")
    mine, theirs = keyed(new), keyed(known)
    by_doi = theirs.filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("id").alias("of_doi"))
    by_title = theirs.filter(F.col("t").isNotNull() & F.col("source").isNotNull()).groupBy("t", "source").agg(F.min("id").alias("of_title"))
    rows = mine.join(by_doi, "doi", "left").join(by_title, ["t", "source"], "left")
    # one row stands for all of a title on each side
    firsts = lambda df: df.filter(F.col("t").isNotNull()).groupBy("t").agg(F.min("id").alias("rep"))
    old, fresh = firsts(theirs), firsts(mine)
    both = old.select("rep", "t").unionByName(fresh.join(old.select("t"), "t", "left_anti").select("rep", "t"))
    near = similar_titles(both, "rep", F.col("t"), least).select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(old.select(F.col("rep").alias("b")), "b", "left_semi").join(both.select(F.col("rep").alias("a"), "t"), "a").select("t", "b")
    listed = near.unionByName(old.select("t", F.col("rep").alias("b"))).groupBy("t").agg(F.array_sort(F.collect_set("b")).alias("candidates"))
    rows = rows.join(listed, "t", "left")
    signal = F.when(F.col("of_doi").isNotNull(), "doi_match").when(F.col("of_title").isNotNull(), "title_source_match")
    none = F.array().cast("array<bigint>")
    return rows.select("id", signal.alias("signal"), F.coalesce("of_doi", "of_title").alias("existing_id"), signal.isNotNull().alias("auto_merge"), F.when(signal.isNull(), F.coalesce("candidates", none)).otherwise(none).alias("candidates"))


def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is not among gone's: deletion as an anti-join."""
    return df.join(gone.select(column).distinct(), column, "left_anti")
