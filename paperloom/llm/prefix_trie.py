"""Operator 12: a trie of the prefixes that conversations share, built level by level and rolled up in reverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import saved

#: Levels that Spark builds for every node; below them a node with at most SMALL turns left is finished by one task, level by level too.
LEVELS, SMALL = 8, 1 << 16
#: Turns of a conversation over which one running sum goes, and ids of one piece of a joined list.
RUN, PIECE = 4096, 4096

NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (digest of role and text), chars (code points) of every turn of every conversation.

    Turns are in order of turn, nulls first; turns of one number in order of their digests. A null role or text is an
    empty one. Rows without a conv_id belong to no conversation. Rows are dealt by ranges of (conv_id, turn), so that a
    conversation of any length is spread; each range numbers its own and adds what earlier ranges hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).cast("long").alias("chars")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    own = saved(dealt.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))))
    held = own.groupBy("conv_id", "part").agg(F.max("own").alias("held"))
    before = held.select("conv_id", "part", F.coalesce(F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, ["conv_id", "part"]).select("conv_id", (F.col("own") + F.col("before")).cast("long").alias("pos"), "key", "chars")


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h, for h = crc32 of c's decimal digits modulo most.

    Gives conv_id, depth (from 1), key, chars, and the list of all conversations, turnless ones included.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    opener = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")).filter(F.col("base") % every == 0)
    known = saved(sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(opener, "base", "left").select("conv_id", "base", h.alias("h"), F.least(h, F.coalesce("n_base", F.lit(0))).alias("used")))
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "key", "chars")
    openings = known.join(first, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "key", "chars")
    own = turns.join(known, "conv_id").filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("used") + F.col("pos") - F.col("h")).alias("depth"), "key", "chars")
    return openings.unionByName(own), known.select("conv_id")


def finished(table: pa.Table) -> pa.Table:
    """The nodes below one node: its classes' turns (rep, n, weight, depth, key, chars, node) grouped level by level, then rolled up in reverse."""
    table = table.sort_by([("rep", "ascending"), ("depth", "ascending")])
    keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    rep, depth, n, weight, chars = (table.column(c).to_numpy() for c in ("rep", "depth", "n", "weight", "chars"))
    heads = np.flatnonzero(np.diff(rep, prepend=rep[0] - 1))
    top, low = int(depth.min()), int(n.max())
    rep, n, weight = rep[heads], n[heads], weight[heads]
    place = np.zeros(len(heads), np.int64)  # each class's node in the level above; all begin below one node
    levels = []
    for d in range(top, low + 1):
        live = np.flatnonzero(n >= d)
        at = heads[live] + d - top
        pair, first, of = np.unique(place[live] * (len(keys) + 1) + keys[at], return_index=True, return_inverse=True)
        convs, ended = np.bincount(of, weight[live]).astype(np.int64), np.full(len(pair), -1)
        ended[of[n[live] == d]] = live[n[live] == d]
        # classes are in order of their representatives, so the first of a group is the smallest
        levels.append((d, rep[live[first]], place[live[first]], convs, ended, (convs - 1) * chars[at[first]]))
        place[live] = of
    out, children, leaves, saving = [], None, None, None
    for i in range(len(levels) - 1, -1, -1):
        d, conv, parent, convs, ended, saves = levels[i]
        if children is None:
            children, leaves, saving = (np.zeros(len(conv), np.int64) for _ in range(3))
        leaves = np.where(children > 0, leaves, 1)
        saving = saving + saves
        above = levels[i - 1][1] if i else None
        node = table.column("node")[0].as_py()
        out.append(pa.table({
            "depth": np.full(len(conv), d), "conv_id": conv, "parent_conv_id": above[parent] if i else np.full(len(conv), node), "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saving,
            "ended": pa.array(rep[np.maximum(ended, 0)], mask=ended < 0),
        }))
        if i:
            size = len(above)
            children, leaves, saving = np.bincount(parent, minlength=size), *(_sums(parent, x, size) for x in (leaves, saving))
    return pa.concat_tables(out)


def _sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, place, values)
    return out


def joined_digests(members: DataFrame) -> DataFrame:
    """rep, digest: SHA-256 of each group's (rep) decimal conv_ids, ascending, joined by commas; read in order, piece by piece."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rep, ids = batch.column("rep").to_numpy(), batch.column("conv_id").to_numpy()
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(rep, prepend=rep[:1])), np.arange(0, len(rep), PIECE), [len(rep)]]))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict({"rep": rep[cuts[:-1]], "first": ids[cuts[:-1]], "text": pa.array([",".join(map(str, ids[i:j].tolist())) for i, j in spans], pa.string())})

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in it:
            done = []
            for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if rep == now:
                    state.update(b",")
                else:
                    done += [(now, state.hexdigest())] if state else []
                    now, state = rep, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"rep": pa.array([x[0] for x in done], pa.int64()), "digest": pa.array([x[1] for x in done], pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"rep": pa.array([now], pa.int64()), "digest": pa.array([state.hexdigest()], pa.string())})

    ordered = members.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    return ordered.mapInArrow(pieces, "rep long, first long, text string").repartition(parts, "rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, digest string")


def _tails(heads: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes of single classes (heads: rep, head, parent, weight, n) from the depth head on: a chain for each. top marks the first of a chain."""
    own = heads.join(steps.select("rep", "depth", "chars"), "rep").filter(F.col("depth") >= F.col("head"))
    own = own.withColumn("run", F.floor(F.col("depth") / RUN))
    many = own.filter(F.col("weight") > 1)
    behind = Window.partitionBy("rep").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    later = many.groupBy("rep", "run").agg(F.sum("chars").alias("chars")).select("rep", "run", F.coalesce(F.sum("chars").over(behind), F.lit(0)).alias("later"))
    within = F.sum("chars").over(Window.partitionBy("rep", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    many = many.withColumn("within", within).join(later, ["rep", "run"]).withColumn("saved_tokens", (F.col("weight") - 1) * (F.col("within") + F.col("later")))
    every = own.filter(F.col("weight") == 1).withColumn("saved_tokens", F.lit(0)).unionByName(many.drop("within", "later"))
    return every.select(
        "depth", F.col("rep").alias("conv_id"), F.when(F.col("depth") == F.col("head"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.col("rep")).alias("ended"), (F.col("depth") == F.col("head")).alias("top"),
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations, from the empty one (depth 0) on.

    turns: conv_id, depth (from 1, without gaps), key (what two turns must have in common to be one), chars.
    conversations: the conv_id of every conversation, those without turns included.

    conv_id (the smallest of the members), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the characters of each node's last turn), ends_sha256 (of the
    joined ids of the members that end there). Without conversations there are no rows.

    Conversations of equal turns are one class with a weight, so a conversation repeated any number of times is a row. Per
    depth, the classes still in company are grouped by (node, next turn) with a partial sum before the shuffle; a class
    that stands alone leaves with the rest of its turns as a chain. After LEVELS depths a node with at most SMALL turns
    left is finished in one task, larger ones go on as before. In reverse, each level's nodes sum up their children.
    Every level is written to the shared folder, so a lost executor costs tasks of one level.
    """
    spark = turns.sparkSession
    marks = turns.groupBy("conv_id").agg(F.expr("bit_xor(xxhash64(depth, key))").alias("a"), F.expr("bit_xor(xxhash64(key, depth, 7))").alias("b"), F.count("*").alias("n"))
    whole = saved(conversations.join(marks, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b", "n")]))
    classes = saved(whole.groupBy("a", "b", "n").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    members = whole.join(classes.filter(F.col("weight") > 1), ["a", "b", "n"]).select("rep", "conv_id")
    steps = _by_level(turns.withColumnRenamed("conv_id", "rep").join(classes.select("rep"), "rep", "left_semi"))

    root = classes.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("ended")).first()
    if root["n_convs"] is None:
        return spark.createDataFrame([], NODE).drop("ended").withColumn("ends_sha256", F.lit(""))
    live = classes.select("rep", "weight", "n", F.lit(root["conv_id"]).alias("node"))
    levels = [spark.createDataFrame([(0, None, root["conv_id"], root["n_convs"], root["ended"], 0)], "depth long, parent long, conv_id long, n_convs long, ended long, own long")]
    lone, below = [], {}  # heads of chains, and what tasks have finished below each level
    while True:
        depth = len(levels)
        here = live.filter(F.col("n") >= depth).join(steps.filter((F.col("level") == min(depth, LEVELS + 1)) & (F.col("depth") == depth)).select("rep", "key", "chars"), "rep")
        level = saved(
            here.groupBy("node", "key").agg(
                F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_classes"), F.sum(F.col("n") - depth).alias("left"), F.max(F.when(F.col("n") == depth, F.col("rep"))).alias("ended"),
                F.first("chars").alias("chars"), F.max("n").alias("n"),
            )
        )
        lone.append(level.filter(F.col("n_classes") == 1).select(F.col("conv_id").alias("rep"), F.lit(depth).cast("long").alias("head"), F.col("node").alias("parent"), F.col("n_convs").alias("weight"), "n"))
        shared = level.filter(F.col("n_classes") > 1)
        levels.append(shared.select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "conv_id", "n_convs", "ended", ((F.col("n_convs") - 1) * F.col("chars")).cast("long").alias("own")))
        small = (F.col("left") <= SMALL) & F.lit(depth >= LEVELS)
        next_ = shared.select("node", "key", F.col("conv_id").alias("next"), small.alias("small"))
        live = saved(here.join(next_, ["node", "key"]).filter(F.col("n") > depth).select("rep", "weight", "n", F.col("next").alias("node"), "small"))
        left = {r["small"] for r in live.select("small").distinct().collect()}
        if True in left:
            rest = live.filter("small").join(steps.filter((F.col("level") == LEVELS + 1) & (F.col("depth") > depth)), "rep").select("node", "rep", "n", "weight", "depth", "key", "chars")
            below[depth] = saved(rest.groupBy("node").applyInArrow(finished, NODE))
        if False not in left:
            break
        live = live.filter("not small").drop("small")

    tails = saved(_tails(reduce(DataFrame.unionByName, lone), steps))
    heads = saved(tails.filter("top").select("depth", "parent_conv_id", "n_leaves", "saved_tokens"), by="depth")
    tails, rolled = tails.drop("top"), []
    for depth in range(len(levels) - 1, -1, -1):
        found = [heads, *([below[depth]] if depth in below else []), *rolled[-1:]]
        children = reduce(DataFrame.unionByName, [x.filter(F.col("depth") == depth + 1).select("parent_conv_id", "n_leaves", "saved_tokens") for x in found])
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        rolled.append(saved(
            levels[depth].join(sums, "conv_id", "left").select(
                "depth", "conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.col("own") + F.coalesce("below", F.lit(0))).alias("saved_tokens"), "ended",
            )
        ))
    nodes = [tails, *below.values(), *rolled]
    every = reduce(DataFrame.unionByName, nodes)
    single = classes.filter(F.col("weight") == 1).select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("digest"))
    ends = every.filter(F.col("ended").isNotNull()).join(single.unionByName(joined_digests(members)), F.col("ended") == F.col("rep"), "left").select(*every.columns, F.col("digest").alias("ends_sha256"))
    inner = every.filter(F.col("ended").isNull()).withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return ends.unionByName(inner).drop("ended")


def _by_level(steps: DataFrame) -> DataFrame:
    """The turns, written in a folder for each of the first LEVELS depths and one for the rest, so that a level reads its own."""
    return saved(steps.withColumn("level", F.least("depth", F.lit(LEVELS + 1)).cast("int")), by="level")
