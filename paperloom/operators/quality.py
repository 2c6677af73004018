"""Quality of papers: fifteen checks, metrics, and a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicons as L
from paperloom.functions import text as T
from paperloom.functions.lexicons import AUTHOR_YEAR, HEADING, VENUE
from paperloom.functions.vectors import let

def distinct_numbers(c: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))).cast("long")


def references(text: Column, may: Column | None = None) -> Column:
    """has, n and method of a reference section: the greatest [n], else lines that look like entries, else numbered lines. may: false for texts that cannot have its heading, which spares them the search."""
    result = lambda n, method, has=True: F.struct(F.lit(has).alias("has"), n.cast("long").alias("n"), F.lit(method).alias("method"))
    entry = lambda x: x.rlike(r"\b(?:19|20)\d{2}\b") & x.rlike(r"^([A-Z][.\s]|[A-Z][a-z]|\()") & (x.rlike(VENUE) | x.rlike(r"et\s+al|,\s*[A-Z]|and\s+[A-Z]"))

    def of_tail(tail: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(tail, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("long"))
        facts = F.struct(
            F.array_max(numbers).alias("greatest"), F.size(F.filter(F.transform(F.split(tail, "\n"), T.strip), entry)).alias("entries"),
            F.regexp_count(tail, F.lit(r"(?m)^\d+\.\s+")).alias("numbered"),
        )
        return let(facts, lambda x: F.when(x["greatest"].isNotNull(), result(x["greatest"], "bracket_numbering")).when(x["entries"] > 0, result(x["entries"], "heuristic_entry_count")).when(x["numbered"] > 0, result(x["numbered"], "numbered_entries")).otherwise(result(F.lit(0), "unable_to_count")))

    tail = F.regexp_replace(text, "(?s)^.*?" + HEADING, "")
    has = text.rlike(HEADING) if may is None else may & text.rlike(HEADING)
    return F.when(has, let(tail, of_tail)).otherwise(result(F.lit(0), "not_available", False))


def measured(papers: DataFrame) -> DataFrame:
    """papers (id, title, authors, abstract, doi, source, published_date, pdf_url, full_text, n_pages) with what the checks need, one column each.

    The text, its words and its paragraphs are generated columns, so that each is worked out once a paper.
    """
    fields = ("title", "authors", "abstract", "doi", "source", "published_date", "pdf_url")
    has = lambda c: F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")) != ""
    rows = papers.select("id", F.col("n_pages").cast("long").alias("n_pages"), *[has(c).alias(f"has_{c}") for c in fields], F.explode(F.array(F.coalesce("full_text", F.lit("")))).alias("t"))
    # words of each paragraph; those of the text are all of them
    paragraphs = F.filter(F.transform(F.split("t", r"\n\s*\n+"), T.words), lambda w: F.size(w) > 0)
    rows = rows.select("*", F.explode(F.array(F.struct(F.lower("t").alias("low"), paragraphs.alias("ps")))).alias("x")).select("*", "x.low", "x.ps")
    rows = rows.select("*", F.explode(F.array(F.filter("ps", lambda w: F.size(w) >= 20))).alias("long"))
    # a single paragraph repeats none, so only several are joined and lower-cased
    repeated = let(F.transform("long", lambda w: F.lower(F.array_join(w, " "))), lambda lows: F.size(lows) - F.size(F.array_distinct(lows)))
    rows = rows.select("*", F.aggregate("ps", F.lit(0), lambda n, w: n + F.size(w)).alias("n"), F.when(F.size("long") > 1, repeated).otherwise(F.lit(0)).cast("long").alias("repeated"))
    # a word that begins with a to z is never in capitals
    caps = F.size(F.filter(F.flatten("ps"), lambda w: ~((w >= "a") & (w < "{")) & (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))))
    bracket = F.when(F.contains("t", F.lit("[")), F.regexp_count("t", F.lit(r"\[\d+(?:[-–,]\d+)*\]"))).otherwise(0)
    some = lambda words: reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words])
    # a plain search for what a pattern must hold spares most texts the pattern
    counted = lambda words, pattern: F.when(some(words), distinct_numbers(F.col("t"), pattern)).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "id", (F.col("t") != "").alias("has_text"), F.col("n").cast("long").alias("words"), F.length("t").cast("long").alias("chars"), "n_pages",
        sum((F.col(f"has_{c}").cast("int") for c in fields), F.lit(0)).cast("long").alias("metadata"),
        *[f"has_{c}" for c in ("title", "authors", "abstract")],
        sum(((some(L.SECTION_WORDS[k]) & F.col("t").rlike(f"(?i){p}")).cast("int") for k, p in L.SECTIONS.items()), F.lit(0)).cast("long").alias("sections"),
        references(F.col("t"), some(["references", "bibliography", "cited"])).alias("refs"), (bracket + F.when(F.contains("t", F.lit("(")), F.regexp_count("t", F.lit(AUTHOR_YEAR))).otherwise(0)).cast("long").alias("cites"),
        counted(["fig", "diagram", "graph", "plot"], r"(?i)(?:Fig(?:ure|\.?)|Diagram|Graph|Plot)\s*(\d+)").alias("figures"), counted(["tab"], r"(?i)(?:Table|Tab\.?)\s*(\d+)").alias("tables"),
        "repeated", F.size("long").cast("long").alias("paragraphs"),
        (F.contains("t", F.lit("\n" * 5)).cast("int") + F.exists("ps", lambda w: F.size(w) > 800).cast("int") + F.col("t").rlike(r"[\x00-\x1f&&[^\t\n\r]]").cast("int")
         + (caps / F.greatest(F.col("n"), F.lit(1)) > 0.3).cast("int")).cast("long").alias("structure"),
    )


def checks(papers: DataFrame) -> DataFrame:
    """id, check, status, value (a number) of fifteen checks of every paper, one row each. Statuses: pass, warning, fail, not_applicable, not_measured."""
    m = measured(papers)
    m = m.select(F.explode(F.array(F.struct(*m.columns))).alias("m")).select("m.*").withColumn("ratio", F.when(F.col("refs.has") & (F.col("cites") > 0) & (F.col("refs.n") > 0), F.col("cites") / F.col("refs.n")))
    pick = lambda ok, other: F.when(ok, "pass").otherwise(other)
    per_page = F.when(F.col("n_pages") > 0, F.col("chars") / F.col("n_pages"))
    graded = {
        "pdf_readable": (F.when(F.col("n_pages").isNull(), "not_applicable").otherwise(pick(F.col("n_pages") > 0, "fail")), F.col("n_pages")),
        "text_extracted": (pick(F.col("has_text") & (F.col("words") > 0), "fail"), F.col("chars")),
        "ocr_required": (F.when(F.coalesce("n_pages", F.lit(0)) == 0, "not_applicable").otherwise(pick(per_page >= 100, "warning")), per_page),
        "metadata_completeness": (pick(F.col("metadata") == 7, F.when(F.col("metadata") >= 4, "warning").otherwise("fail")), F.col("metadata")),
        "title_present": (pick(F.col("has_title"), "fail"), F.col("has_title")),
        "authors_present": (pick(F.col("has_authors"), "fail"), F.col("has_authors")),
        "abstract_present": (pick(F.col("has_abstract"), "fail"), F.col("has_abstract")),
        "research_sections": (pick(F.col("sections") >= 3, F.when(F.col("sections") >= 1, "warning").otherwise("fail")), F.col("sections")),
        "references_present": (pick(F.col("refs.has"), "warning"), F.col("refs.n")),
        "in_text_citations": (pick(F.col("cites") > 0, "warning"), F.col("cites")),
        "citation_consistency": (F.when(F.col("ratio").isNull(), "not_measured").otherwise(pick(F.col("ratio").between(0.3, 10.0), "warning")), F.col("ratio")),
        "figures_tables": (pick(F.col("figures") + F.col("tables") > 0, "warning"), F.col("figures") + F.col("tables")),
        "empty_short_pages": (F.when(F.coalesce("n_pages", F.lit(0)) == 0, "not_applicable").otherwise(pick(F.col("words") / F.col("n_pages") >= 50, "warning")), F.col("words")),
        "duplicate_text": (pick(F.col("repeated") == 0, "warning"), F.col("repeated")),
        "structural_issues": (pick(F.col("structure") == 0, "warning"), F.col("structure")),
    }
    each = F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status"), F.round(value.cast("double"), 4).alias("value")) for name, (status, value) in graded.items()])
    return m.select("id", F.inline(each))


def verdicts(checked: DataFrame) -> DataFrame:
    """id, verdict, n_fail, n_warning: fail if any check fails, else warning if any warns, else pass."""
    fails, warns = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warning")
    rows = checked.groupBy("id").agg(fails.alias("n_fail"), warns.alias("n_warning"))
    return rows.withColumn("verdict", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warning") > 0, "warning").otherwise("pass"))


def page_coverage(chunks: DataFrame, short: int = 50) -> DataFrame:
    """paper_id, page_number, n_words, state (empty, short, full) of every page from 1 to a paper's last; words are summed over chunks."""
    words = chunks.groupBy("paper_id", "page_number").agg(F.sum(T.word_count(F.col("text"))).alias("n_words"))
    every = words.groupBy("paper_id").agg(F.max("page_number").alias("last")).select("paper_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_number"))
    rows = every.join(words, ["paper_id", "page_number"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long"))
    return rows.withColumn("state", F.when(F.col("n_words") == 0, "empty").when(F.col("n_words") < short, "short").otherwise("full"))


def repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 5) -> DataFrame:
    """id, n_lines, n_repeated: lines of at least so many words that repeat an earlier line of their document."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n"), lambda x: F.lower(T.one_space(x))), lambda x: F.size(T.words(x)) >= least_words)
    rows = documents.select(F.col(id_column), F.explode(F.array(lines)).alias("lines"))
    return rows.select(id_column, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_repeated"))
