"""Operator 4: near-duplicates by a chosen-path set similarity join over minwise tokens, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import batches, mix, saved, shingle_hashes, word_hashes

#: Minwise tokens of a set, and independent trees. A pair at the threshold shares a node of a tree's first level with a
#: probability of 0.84 or more, so that ten trees miss it once in 10**8 times; in nodes that branch four levels deep, with
#: one of over 0.6, once in 10,000 times.
TOKENS, TREES = 64, 10
#: A node of at most so many rows is small: its rows are compared exhaustively, by their sketches, in one task.
NODE = 4096
#: A large node is done without branching once at most so many of its rows are outside of its largest class: they meet all its rows.
SMALL = 16
#: Levels of branching. Large nodes that remain are compared exhaustively, in so many lists of SMALL rows as it takes.
LEVELS = 8
#: Bits of a parity sketch, in 64-bit words, and shingles that it is made of at most twice: of larger sets a share is sampled.
WORDS, SAMPLED = 8, 256
#: Lists of ids up to this length are broadcast, longer ones are joined by a shuffle.
BROADCAST_IDS = 1 << 21
#: Nodes with their lists of rows are broadcast up to this number.
BROADCAST_NODES = 1 << 13
#: Rows and pairs that a task compares at once, and pairs it keeps before they are brought down to a forest.
ROWS, PAIRS, KEPT = 8192, 1 << 17, 1 << 20

_BITS = 64 * WORDS
_MULTIPLIERS = np.random.default_rng(4).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(batch: pa.RecordBatch, words: int, name: str = "text") -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, a list for each step."""
    for _, _, data, offsets in batches(batch, name):
        hashes, first = shingle_hashes(*word_hashes(data, offsets, lower=True), words)
        yield [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def sampling(sizes: np.ndarray) -> np.ndarray:
    """Of sets of so many shingles: the power of two whose inverse is the share of shingles in the first sketch."""
    return np.maximum(np.frexp(sizes)[1] - SAMPLED.bit_length(), 0)


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two sketches of each set, WORDS words each: bit i tells whether an odd number of its (sampled) shingles has the place i.

    The bits in which two sketches of one sampling differ are at most as many as the sampled shingles that only one of
    the sets has. The second sketch samples half as many as the first.
    """
    out = np.zeros((len(sizes), 2, WORDS), np.uint64)
    power, begins = sampling(sizes), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sizes), 1024):
        own = sizes[i : i + 1024]
        part = flat[begins[i] : begins[i] + own.sum()]
        owner = np.repeat(np.arange(len(own)), own)
        place = owner * _BITS + ((part >> np.uint64(40)) % np.uint64(_BITS)).astype(np.int64)
        for level in (0, 1):
            mask = (np.uint64(1) << (power[i : i + 1024] + level).astype(np.uint64)) - np.uint64(1)
            odd = np.bincount(place[(part & mask[owner]) == 0], minlength=len(own) * _BITS) & 1
            out[i : i + 1024, level] = np.packbits(odd.astype(np.uint8).reshape(-1, _BITS), axis=1).view(np.uint64)
    return out


def most_bits(percent: int) -> np.ndarray:
    """For a number of differing sampled shingles: the bits that differ at most, but for five deviations of the places that meet."""
    d = np.arange(4 * _BITS, dtype=float)
    one, two = (1 - 2 / _BITS) ** d, (1 - 4 / _BITS) ** d
    spread = np.sqrt(np.maximum(_BITS + _BITS * (_BITS - 1) * two - (_BITS * one) ** 2, 0)) / 2
    return np.ceil(np.minimum(d, _BITS / 2 * (1 - one) + 5 * spread)).astype(np.int64)


def sketched(documents: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, n_shingles, two digests of the shingle set, its minwise tokens and its parity sketches."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, one, two, tokens, odd = [], [], [], [], []
            for sets in _sets(batch, words):
                own = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(own)
                d1, d2, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), TOKENS), np.uint64)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                if len(some):
                    starts = np.concatenate([[0], np.cumsum(own)])[some]
                    d1[some] = np.add.reduceat(flat, starts)
                    d2[some] = np.add.reduceat(mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                    for t in range(TOKENS):
                        low[some, t] = np.minimum.reduceat(flat * _MULTIPLIERS[t], starts)
                sizes.append(own)
                one.append(d1)
                two.append(d2)
                tokens.append(low)
                odd.append(parities(flat, own))
            if not sizes:
                continue
            flat = (mix(np.concatenate(tokens)) >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TOKENS)
            raw, width = np.concatenate(odd).tobytes(), 16 * WORDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.concatenate(sizes)), *[pa.array(np.concatenate(d).view(np.int64)) for d in (one, two)],
                    pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "tokens", "odd"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, d1 long, d2 long, tokens array<int>, odd binary")


def with_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose column is (left_anti: is not) among the ids; the list is broadcast if it is counted to be short."""
    short = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if short else ids.hint("shuffle_hash"), column, how)


def branched(rows: DataFrame, level: int, parent: Column, percent: int) -> DataFrame:
    """rows in the children of their nodes. A node chooses one token's place, and at times a second one, so that a pair at the threshold is in one child on average."""
    first = (parent * 5 if level == 1 else F.xxhash64(parent, F.lit(level))).cast("long")
    second = F.xxhash64(parent, F.lit(level), F.lit("second"))
    places = F.when(F.pmod(second, F.lit(percent)) < 100 - percent, F.array(F.pmod(first, F.lit(TOKENS)), F.pmod(F.shiftright(second, 12), F.lit(TOKENS)))).otherwise(F.array(F.pmod(first, F.lit(TOKENS))))
    at = F.transform(F.array_distinct(places), lambda p: F.xxhash64(parent, p, F.element_at("tokens", (p + 1).cast("int"))))
    return rows.withColumn("node", F.explode(at))


# -- comparison by sketches -------------------------------------------------------------------------------------------


class Sketches:
    """Rows of a task: what is known of each, and which pairs can reach the threshold by their sizes and sketches."""

    def __init__(self, rep: np.ndarray, cls: np.ndarray, sizes: np.ndarray, odd: np.ndarray, percent: int) -> None:
        self.rep, self.cls, self.sizes, self.percent = rep, cls, sizes, percent
        self.odd, self.power, self.most = odd.view(np.uint64).reshape(-1, 2, WORDS), sampling(sizes), most_bits(percent)

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, percent: int, ends: str = "") -> Sketches:
        """Of the columns rep, cls, n, odd, whose names end so."""
        rep, label, n = (batch.column(c + ends).to_numpy() for c in ("rep", "cls", "n"))
        return cls(rep, label, n, np.frombuffer(b"".join(batch.column("odd" + ends).to_pylist()), np.uint8), percent)

    def alike(self, u: np.ndarray, v: np.ndarray, other: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (u, v), v among the other's rows: those of different classes that can be links, and their bits that differ as a share of those allowed."""
        other, p = other or self, self.percent
        m, n = self.sizes[u], other.sizes[v]
        fit = (self.cls[u] != other.cls[v]) & (self.rep[u] != other.rep[v]) & (np.minimum(m, n) * 100 >= np.maximum(m, n) * p)
        u, v, m, n = u[fit], v[fit], m[fit], n[fit]
        # of sets that fit, one is at most twice the other, so that one sampling is among the sketches of both
        power = np.maximum(self.power[u], other.power[v])
        bits = np.bitwise_count(self.odd[u, power - self.power[u]] ^ other.odd[v, power - other.power[v]]).sum(axis=1, dtype=np.int64)
        differ = (m + n) * (100 - p) // (100 + p)
        mean = differ / 2.0**power
        sampled = np.where(power > 0, np.ceil(mean + 5 * np.sqrt(mean) + 1).astype(np.int64), differ)
        allowed = self.most[np.minimum(sampled, len(self.most) - 1)]
        fit = bits <= allowed
        return u[fit], v[fit], bits[fit] * 1000 // (allowed[fit] + 1)


def labelled(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of so many rows: the least row that the pairs connect it with."""
    labels = np.arange(count)
    while len(u):
        least = labels.copy()
        np.minimum.at(least, u, labels[v])
        np.minimum.at(least, v, labels[u])
        least = np.minimum(least, least[least])
        if (least == labels).all():
            break
        labels = least
    return labels


def forest(count: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs are a minimum spanning forest of the rows, by Boruvka's rounds; of equal weights the earlier pair."""
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    by_rank = np.argsort(rank)
    labels, chosen, left = np.arange(count), np.zeros(len(u), bool), np.arange(len(u))
    while True:
        a, b = labels[u[left]], labels[v[left]]
        left = left[a != b]
        if not len(left):
            return chosen
        best = np.full(count, len(u), np.int64)
        np.minimum.at(best, labels[u[left]], rank[left])
        np.minimum.at(best, labels[v[left]], rank[left])
        new = by_rank[np.unique(best[best < len(u)])]
        chosen[new] = True
        labels = labelled(count, labels[u[new]], labels[v[new]])[labels]


def compared(rows: Sketches, node: np.ndarray, spanning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (u, v) of one node, sorted by node, that can be links, all pairs compared; spanning: a forest of them. And for each row, the number of pairs that begin with it."""
    count = len(node)
    ends = np.searchsorted(node, node, "right")
    found, kept, degree = [], 0, np.zeros(count, np.int64)
    live, shift = np.arange(count), 1
    none = np.zeros(0, np.int64)

    def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, w = (np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none, none)
        if spanning and len(u):
            chosen = forest(count, u, v, w)
            return u[chosen], v[chosen], w[chosen]
        return u, v, w

    while len(live := live[live + shift < ends[live]]):
        for i in range(0, len(live), PAIRS):
            u = live[i : i + PAIRS]
            u, v, w = rows.alike(u, u + shift)
            if len(u):
                degree += np.bincount(u, minlength=count)
                found.append((u, v, w))
                kept += len(u)
        if spanning and kept > KEPT:
            found = [gathered()]
            kept = len(found[0][0])
        shift += 1
    u, v, _ = gathered()
    return u, v, degree


def meetings(rows: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """What rows (node, rep, cls, n, odd) of small nodes have in common: node, a, b, rest.

    Pairs (a, b, rest false) of different classes that can be links; if spanning, only a forest of them for each node, and
    then also, for each part that the forest connects but has more pairs, its rows (a: its first row, b: a row, rest true).
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            node = table.column("node").to_numpy()
            own = Sketches.of(table, percent)
            u, v, degree = compared(own, node, spanning)
            out = [(node[u], np.minimum(own.rep[u], own.rep[v]), np.maximum(own.rep[u], own.rep[v]), np.zeros(len(u), bool))]
            if spanning and len(u):
                labels = labelled(len(node), u, v)
                more = np.bincount(labels, degree, len(node)) > np.bincount(labels, minlength=len(node)) - 1
                some = np.flatnonzero(more[labels])
                out.append((node[some], own.rep[labels[some]], own.rep[some], np.ones(len(some), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "a", "b", "rest"])

        for batch in it:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            node = table.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            if cut:
                yield from done(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.select("node", "rep", "cls", "n", "odd").repartition("node").sortWithinPartitions("node", "rep")
    return dealt.mapInArrow(work, "node long, a long, b long, rest boolean")


def meetings_with(rows: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of rows (node, rep, cls, n, odd) of large nodes with the members listed for their node (node, members), of different classes, that can be links."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own, members = Sketches.of(batch, percent), batch.column("members")
            u = np.repeat(np.arange(batch.num_rows), np.diff(members.offsets.to_numpy()))
            flat = members.flatten()
            other = Sketches.of(pa.Table.from_arrays([pa.chunked_array([flat.field(c)]) for c in ("rep", "cls", "n", "odd")], names=["rep", "cls", "n", "odd"]), percent)
            u, v, _ = own.alike(u, np.arange(len(u)), other)
            yield pa.RecordBatch.from_arrays([pa.array(f(own.rep[u], other.rep[v])) for f in (np.minimum, np.maximum)], names=["a", "b"])

    short = lists.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    met = rows.select("node", "rep", "cls", "n", "odd").join(F.broadcast(lists) if short else lists, "node").drop("node")
    return met.mapInArrow(work, "a long, b long").distinct()


# -- links ------------------------------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Of an id's several texts each has its set."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                one, two = ([s for own in _sets(part, words, name) for s in own] for name in ("x", "y"))
                both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(one, two, strict=True)], np.int64)
                union = np.array([len(s) + len(t) for s, t in zip(one, two, strict=True)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array(both * 100 >= union * percent))

    def texts(side: str, name: str) -> DataFrame:
        own = documents.select(F.col("doc_id").cast("long").alias(side), F.col("text").alias(name))
        return with_ids(own, pairs.select(side).distinct(), side)

    return pairs.select("a", "b").join(texts("a", "x"), "a").join(texts("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc_id and label, the least id that it reaches, of every id in links (a, b). Least neighbours and pointer jumping, until nothing changes.

    Every step is written to the shared folder, so each join reads two tables and Spark may split a hub's rows.
    """
    sides = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(sides.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("near")).select("doc_id", F.least("doc_id", "near").alias("label")))
    while True:
        jumped = labels.join(labels.select(F.col("doc_id").alias("label"), F.col("label").alias("root")), "label", "left").select("doc_id", F.col("label").alias("was"), F.least("label", F.coalesce("root", "label")).alias("label"))
        told = sides.join(jumped.select(F.col("doc_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        labels = saved(jumped.join(told.withColumnRenamed("a", "doc_id"), "doc_id", "left").select("doc_id", "was", F.least("label", F.coalesce("near", "label")).alias("label")))
        if not labels.filter(F.col("label") != F.col("was")).limit(1).count():
            return labels.select("doc_id", "label")
        labels = labels.drop("was")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: linked are rows of percent / 100 resemblance or more (50 at least).

    Words are runs of non-space bytes, A-Z lower-cased. A set: the distinct shingles of so many words; of a shorter text
    all its words as one; a null, empty or blank text has an empty set and no links. component_id: the least doc_id that
    links reach, the row's own included; kept: doc_id is component_id. Rows of one doc_id count as one document, which
    has the links of each of its texts; a row without doc_id is linked with nothing, its component_id is null and it is
    kept. Further columns are not read, so their names may clash; an empty table gives an empty result.

    Rows of equal sets are one representative. In each of the trees representatives branch by minwise tokens that a node
    chooses. A node of at most NODE rows is small, and all its rows are compared, by sizes and sketches; a larger one
    branches on. What a small node's comparison finds is told in two rounds, so that a group of copies costs its rows and
    not its pairs: first the pairs of a forest that spans it, which are confirmed on full sets and make classes; then all
    further pairs of what is still in different classes. A large node's rows first meet one of them, and its classes
    follow; it ends with one class, or with few rows outside of its largest class, which meet all. Missed links: see TREES.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    sets = saved(sketched(documents, words))
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = saved(known.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("tokens").alias("tokens"), F.min("odd").alias("odd")).withColumnRenamed("n_shingles", "n"))
    of_id = known.select("doc_id", F.col("n_shingles").alias("n"), "d1", "d2").distinct()
    again = saved(of_id.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    # texts of one id: the representatives of its sets are linked
    joined = with_ids(of_id, again, "doc_id").join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    links = joined.join(joined.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    found, tested = [saved(links)], []

    def classes() -> DataFrame:
        return components(reduce(DataFrame.unionByName, found)).withColumnRenamed("doc_id", "rep")

    def test(pairs: DataFrame) -> None:
        """Confirm the pairs that have not been tested before."""
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        tested.append(saved(pairs.distinct()))
        found.append(saved(confirmed(tested[-1], documents, words, percent)))

    def told(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows with the classes that their representatives now have."""
        return rows.drop("cls").join(labels, "rep", "left").withColumn("cls", F.coalesce("label", "rep")).drop("label")

    live = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = branched(live, 1, F.col("tree"), percent).select("node", "rep", F.col("rep").alias("cls"), "n", "odd")
    large = saved(rows.groupBy("node").count().filter(F.col("count") > NODE).select("node"))
    small, level = [rows], 1
    while large.limit(1).count():
        level += 1
        small[-1] = with_ids(rows, large, "node", "left_anti")
        rows = saved(with_ids(rows, large, "node"))
        centre = F.min_by(F.struct("rep", "cls", "n", "odd"), F.xxhash64("node", "rep"))
        test(meetings_with(rows, saved(rows.groupBy("node").agg(F.array(centre).alias("members"))), percent))
        rows = saved(told(rows, classes()))
        own = rows.groupBy("node", "cls").agg(F.count("*").alias("own")).groupBy("node").agg(F.max_by("cls", F.struct("own", "cls")).alias("main"), (F.sum("own") - F.max("own")).alias("others"))
        own = saved(own.filter("others > 0"))
        easy = own.filter(F.col("others") <= SMALL) if level <= LEVELS else own
        short = own.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        outside = rows.join(F.broadcast(easy) if short else easy, "node").filter(F.col("cls") != F.col("main"))
        part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("others") / SMALL)).alias("part")
        lists = outside.groupBy("node", part).agg(F.collect_list(F.struct("rep", "cls", "n", "odd")).alias("members")).drop("part")
        test(meetings_with(rows, saved(lists), percent))
        if level > LEVELS:
            break
        hard = with_ids(rows, own.filter(F.col("others") > SMALL).select("node"), "node")
        deeper = branched(hard.join(reps.select("rep", "n", "tokens"), ["rep", "n"]), level, F.col("node"), percent)
        rows = saved(deeper.select("node", "rep", "cls", "n", "odd"))
        small.append(rows)
        large = saved(rows.groupBy("node").count().filter(F.col("count") > NODE).select("node"))

    met = saved(meetings(reduce(DataFrame.unionByName, small), percent, spanning=True))
    test(met.filter(~F.col("rest")).select("a", "b"))
    labels = classes()
    # parts that have more pairs than their forest, and more than one class
    rest = met.filter("rest").select(F.xxhash64("node", "a").alias("node"), F.col("b").alias("rep")).distinct()
    rest = told(rest, labels)
    mixed = saved(rest.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("node"))
    if mixed.limit(1).count():
        again = with_ids(rest, mixed, "node").join(reps.select("rep", "n", "odd"), "rep")
        test(saved(meetings(again, percent, spanning=False)).select("a", "b"))
        labels = classes()

    least = reps.join(labels, "rep", "left").select(F.col("n").alias("n_shingles"), "d1", "d2", F.coalesce("label", "rep").alias("component"))
    out = sets.select("doc_id", "n_shingles", "d1", "d2").join(saved(least), ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
