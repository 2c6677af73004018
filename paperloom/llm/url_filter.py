"""Operator 1: allow and block rules for URLs, by an equi-join of host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of rules up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as rows."""
    rows = F.array(*[F.struct(F.lit(v).alias("rule_verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules])
    return spark.range(0 if not rules else 1).select(F.inline(rows if rules else F.array(F.struct(*[F.lit("").alias(c) for c in ("rule_verdict", "rule_host", "rule_path")]))))


def digest_of(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(digest: Column) -> Column:
    """The first 32 bits of a digest: the key of the join."""
    return F.substring(digest, 1, 8)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """For each row: id, host, path, the rule that decides (host and path in one string; null if none) and the verdict.

    A rule fits its host and every subdomain if the path starts with the rule's. The longest rule wins; among rules as
    long, the one with the longer host, then block. Of no rule: the default. rules: rule_verdict, rule_host, rule_path;
    rules with a null in any of the three are void. A URL that is null or has no "://" has an empty host and path and
    no rule. Repeated rows are each judged; ids may be null; further columns of pages are not read, clashing names
    included; an empty table gives an empty result.

    Each distinct host and path is expanded once: the host's suffixes at label borders, times those prefixes of the
    path whose length some rule has. The expressions meet the rules by 32 bits of their digest, and the full digest
    confirms. What is collected: the distinct lengths of the rules' paths. Only a list of rules counted to be at most
    BROADCAST_RULES is broadcast.
    """
    rules = rules.filter(F.col("rule_verdict").isNotNull() & F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    facts = rules.groupBy(F.length("rule_path").alias("n")).count().collect()
    lengths = sorted(r["n"] for r in facts)
    targets = rules.withColumn("rule_digest", digest_of(F.col("rule_host"), F.col("rule_path"))).withColumn("key", short(F.col("rule_digest")))
    if sum(r["count"] for r in facts) <= BROADCAST_RULES:
        targets = F.broadcast(targets)

    judged = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    distinct = judged.filter(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.length("path"))), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
        .withColumn("digest", digest_of(F.col("suffix"), F.col("prefix")))
        .withColumn("key", short(F.col("digest")))
    )
    hits = expressions.join(targets, "key").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    decided = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    # pages without a host have no rule: they go around the join, where they would be one key
    met = judged.filter(F.col("host") != "").join(decided, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    rest = judged.filter(F.col("host") == "").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return met.select("id", "host", "path", "rule", "verdict").unionByName(rest).select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
