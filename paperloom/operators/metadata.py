"""Paper metadata: one shape from many, categories, validation, enrichment, and the outcome of an ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicons as L
from paperloom.functions import text as T
from paperloom.operators import dedup


def first_text(*columns: Column) -> Column:
    """The first of the columns that is not blank, stripped; else null."""
    return F.coalesce(*[F.nullif(T.strip(c), F.lit("")) for c in columns])


def categories(raw: Column, subjects: dict[str, str] = L.SUBJECTS, none: Sequence[str] = tuple(L.NO_CATEGORY)) -> Column:
    """Names of subject codes; words that are no category dropped; distinct without regard to case, first spelling kept."""
    named = F.create_map(*[F.lit(x) for pair in subjects.items() for x in pair])
    clean = F.filter(F.transform(raw, T.strip), lambda c: c.isNotNull() & (c != "") & ~F.lower(c).isin(*none))
    full = F.transform(clean, lambda c: F.coalesce(F.try_element_at(named, c), c))
    lower = F.transform(full, F.lower)
    return F.filter(full, lambda c, i: F.array_position(lower, F.lower(c)) == i + 1)


def unwrapped(raw: DataFrame, column: str = "paper") -> DataFrame:
    """raw with the fields of the struct `column` in the place of its own where that is not null; fields only the struct has are added."""
    if column not in raw.columns:
        return raw
    inner = raw.schema[column].dataType.fieldNames()
    held = F.col(column).isNotNull()
    mine = [F.when(held, F.col(column)[c]).otherwise(F.col(c)).alias(c) if c in inner else F.col(c) for c in raw.columns if c != column]
    return raw.select(*mine, *[F.col(column)[c].alias(c) for c in inner if c not in raw.columns])


def names_of(authorships: Column) -> Column:
    """Names of an array of authorships (author.display_name)."""
    return F.transform(authorships, lambda a: a["author"]["display_name"])


def cards(papers: DataFrame) -> DataFrame:
    """Papers as they are listed: each field there is, without the full text, of which only is told whether there is one."""
    fields = ("id", "title", "abstract", "authors", "doi", "source", "source_id", "arxiv_id", "published_date", "updated_date", "categories", "url", "pdf_url", "pdf_path", "created_at", "n_pages")
    return papers.select(*[c for c in fields if c in papers.columns], (T.strip(F.coalesce("full_text", F.lit(""))) != "").alias("has_full_text"))


def normalized(raw: DataFrame) -> DataFrame:
    """One shape of metadata from raw records: title, abstract, authors, doi, source, source_id, arxiv_id, published_date, categories, url, pdf_url.

    raw: any of title, display_name, name, abstract, description, authors (array), authorships, doi, source, source_id,
    id, arxiv_id, published_date, categories (array), url, landing_page_url, pdf_url, primary_location (with the two), best_pdf_url. Columns that are
    not there count as null; others pass. A record within a record is taken out by unwrapped().
    """
    col = lambda name, kind="string": F.col(name) if name in raw.columns else F.lit(None).cast(kind)
    inner = raw.schema["primary_location"].dataType.fieldNames() if "primary_location" in raw.columns else []
    place = lambda name: F.col("primary_location")[name] if name in inner else F.lit(None).cast("string")
    listed = col("authors", "array<string>")
    if "authorships" in raw.columns:
        listed = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(names_of(F.col("authorships")))
    authors = F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), T.strip), lambda a: a != ""))
    own = {
        "title": first_text(col("title"), col("display_name"), col("name")),
        "abstract": first_text(col("abstract"), col("description")),
        "authors": authors,
        "doi": first_text(col("doi")),
        "source": F.coalesce(first_text(col("source")), F.lit("unknown")),
        "source_id": first_text(col("source_id"), col("id").cast("string")),
        "arxiv_id": first_text(col("arxiv_id")),
        "published_date": T.utc_time(col("published_date")),
        "categories": categories(F.coalesce(col("categories", "array<string>"), F.array().cast("array<string>"))),
        "url": first_text(col("url"), col("landing_page_url"), place("landing_page_url")),
        "pdf_url": first_text(col("pdf_url"), place("pdf_url"), col("best_pdf_url")),
    }
    return raw.select(*[c for c in raw.columns if c not in own], *[v.alias(k) for k, v in own.items()])


def problems() -> Column:
    """What is wrong with normalised metadata; an empty array if nothing is."""
    return F.array_compact(F.array(F.when(F.col("title").isNull(), "title is missing"), F.when(F.col("source").isNull(), "source is missing"), F.when(F.col("authors").isNull(), "authors are no list")))


def enriched(papers: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """papers with authors and titles that were found in their files: authors if there are none; the title of a local file if it is the file's name. found: key, found_title, found_authors."""
    rows = papers.join(found, key, "left")
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("found_authors", "authors"))
    title = F.when((F.col("source") == "local") & F.col("title").rlike(r"(?i)\.pdf$"), F.coalesce("found_title", "title")).otherwise(F.col("title"))
    return rows.withColumn("authors", authors).withColumn("title", title).drop("found_title", "found_authors")


#: What identity keys are made of.
IDENTITY = ("id", "doi", "arxiv_id", "source", "source_id", "title", "full_text")


def ingest_status(new: DataFrame, known: DataFrame) -> DataFrame:
    """id, status (created, duplicate or rejected), reason, existing_id of new papers (normalised, with full_text and n_pages).

    Invalid metadata and texts that need OCR reject; then a known paper, or a new one of a smaller id, makes a duplicate.
    """
    return judged(new, dedup.identity_keys(known.select(*IDENTITY), True))


def judged(new: DataFrame, known_keys: DataFrame) -> DataFrame:
    """The status of new papers as ingest_status gives it, against the identity keys of the known ones."""
    wrong = problems()
    ocr = T.needs_ocr(F.length(F.coalesce("full_text", F.lit(""))), F.col("n_pages"))
    reason = F.when(F.size(wrong) > 0, F.element_at(wrong, 1)).when(ocr, "needs OCR")
    rows = new.withColumn("reason", reason)
    own = dedup.identity_keys(rows.filter(F.col("reason").isNull()).select(*IDENTITY), False)
    old = dedup.matched(own, known_keys)
    # both sides normalised: a row is in its own key's group, so another least id is a smaller one
    twin = dedup.matched(own, own).select("id", F.col("signal").alias("twin_signal"), F.col("existing_id").alias("twin_id"))
    rows = rows.select("id", "reason").join(old, "id", "left").join(twin, "id", "left")
    rows = rows.select("id", "reason", F.coalesce("signal", "twin_signal").alias("signal"), F.coalesce("existing_id", "twin_id").alias("existing_id"))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("signal").isNotNull(), "duplicate").otherwise("created")
    return rows.select("id", status.alias("status"), F.coalesce("reason", "signal").alias("reason"), "existing_id")


def backfilled(papers: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """total, missing, updated, unresolved of a fill of blank authors (text) from found (key, found_authors)."""
    blank = F.coalesce(T.strip(F.col("authors")), F.lit("")) == ""
    rows = papers.withColumn("blank", blank).join(found, key, "left")
    has = F.coalesce(T.strip(F.col("found_authors")), F.lit("")) != ""
    return rows.agg(F.count("*").alias("total"), F.count_if("blank").alias("missing"), F.count_if(F.col("blank") & has).alias("updated"), F.count_if(F.col("blank") & ~has).alias("unresolved"))
