"""Text rules as Column functions. White space is ASCII white space unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import lexicons as L
from paperloom.functions.vectors import let, sliced

STRIP_MARKS = ".,?!:;()[]{}\"'"


SPACE = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    """c without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def one_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """The words between white space; an empty array for a blank or null text."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def clean_page_text(c: Column) -> Column:
    """Text of a page: without tokenizer marks, runs of blanks and blank lines, and space before punctuation."""
    c = F.regexp_replace(c, "(?i)<(EOS|PAD|BOS|UNK)>", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), r"\n\s*\n+", "\n\n")
    return strip(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"))


def clean_chunk_text(c: Column) -> Column:
    """Text to be cut into chunks: in one line, without <EOS> and <pad>."""
    return one_space(F.regexp_replace(F.coalesce(c, F.lit("")), "<EOS>|<pad>", " "))


def sentences(c: Column) -> Column:
    """Sentences of a cleaned text: cut after . ! ? where a capital or a digit follows white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-cased text has any of the phrases: one pass of one alternation."""
    return F.lower(c).rlike("|".join(rf"\Q{p}\E" for p in phrases)) if phrases else F.lit(False)


def count_present(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases the lower-cased text has."""
    return let(F.lower(c), lambda low: F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))))


def low_quality(c: Column) -> Column:
    """Whether a chunk is noise: short, full of marks or of one- and two-letter words, or a bibliography."""
    own = strip(F.coalesce(c, F.lit("")))
    marks = F.regexp_count(own, F.lit("<EOS>|<pad>"))
    of_words = lambda w: (F.size(w) < 15) | ((F.size(w) >= 20) & (F.size(F.filter(w, lambda x: F.length(x) <= 2)) / F.size(w) > 0.45))
    return (F.length(own) < 80) | (marks > 2) | let(words(own), of_words) | (count_present(own, L.BIBLIOGRAPHY_MARKS) >= 2)


def noise(text: str) -> bool:
    """What low_quality() tells, of a stripped text with one space between its words."""
    if len(text) < 80:
        return True
    own = text.split(" ")
    n = len(own)
    if n < 15 or text.count("<EOS>") + text.count("<pad>") > 2 or n >= 20 and sum(len(w) <= 2 for w in own) / n > 0.45:
        return True
    low = text.lower()
    return sum(p in low for p in L.BIBLIOGRAPHY_MARKS) >= 2


def tokens(c: Column) -> Column:
    """Distinct lower-case words of three letters or more, cut at hyphens and underscores, without marks at their ends."""
    cut = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "-_\n\t\r", "     "), " ")
    bare = F.transform(cut, lambda w: F.btrim(w, F.lit(STRIP_MARKS)))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3))


def token_list(text: str) -> list[str]:
    """What tokens() gives, of a string."""
    low = (text or "").lower()
    for mark in "-_\n\t\r":  # translate() looks up each character of a text that is not ASCII
        low = low.replace(mark, " ")
    return list(dict.fromkeys([w for x in low.split(" ") if len(w := x.strip(STRIP_MARKS)) >= 3]))


def keyword_score(text: Column, query: Column, keywords: Sequence[str] = tuple(L.RESEARCH_KEYWORDS)) -> Column:
    """Share of the query's tokens in the text, with a bonus for keywords; at most 0.5. Both sides are token arrays."""
    both = F.array_intersect(text, query)
    bonus = F.size(F.array_intersect(both, F.array(*[F.lit(k) for k in keywords])))
    score = F.least(F.lit(0.5), F.size(both) / F.size(query) * 0.35 + F.least(F.lit(0.15), bonus * 0.05))
    return F.when(F.size(query) > 0, score).otherwise(F.lit(0.0))


def limitation_evidence(c: Column, limitations: Sequence[str] = tuple(L.LIMITATION_PHRASES), positives: Sequence[str] = tuple(L.POSITIVE_PHRASES)) -> Column:
    """Whether limitations are told of, and not outweighed by praise."""
    bad, good = count_present(c, limitations), count_present(c, positives)
    return (bad > 0) & ~((good > 0) & (bad <= good))


def key_terms(c: Column, stopwords: Sequence[str] = tuple(L.STOPWORDS)) -> Column:
    """Distinct runs of four ASCII letters or more, without stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stopwords]))


def grounded(statement: Column, source: Column) -> Column:
    """Whether a statement shares enough key terms with its source: one if either has at most four, else two. Both are key-term arrays; an empty one is grounded."""
    shared = F.size(F.array_intersect(statement, source))
    need = F.when(F.size(statement) <= 4, 1).otherwise(2)
    return F.when((F.size(statement) == 0) | (F.size(source) == 0), True).otherwise(shared >= need)


def starts_with_action(c: Column, verbs: Sequence[str] = tuple(L.ACTION_STARTS)) -> Column:
    return F.lower(strip(c)).rlike("^(" + "|".join(verbs) + ") ")


def title_key(c: Column) -> Column:
    """A title for exact matching: lower case, without file endings, the words paper and research paper, and marks."""
    c = F.lower(strip(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(F.regexp_replace(c, r"\.(pdf|txt)$", ""), r"\b(research\s+paper|paper)\b", "")
    return one_space(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def fuzzy_title(c: Column) -> Column:
    """A title for fuzzy matching: as title_key, with the word paper."""
    c = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"\.(pdf|txt)$", "")
    return one_space(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def plain_title(c: Column) -> Column:
    """A title by the older rule: marks vanish instead of becoming spaces."""
    return one_space(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", ""))


def doi_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^https?://doi\.org/", ""), r"^doi:\s*", "")


def arxiv_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^https?://arxiv\.org/abs/", ""), r"^arxiv:\s*", "")


def author_key(names: Column) -> Column:
    """Surnames of an array of names, sorted, joined by |."""
    last = F.transform(F.filter(F.transform(names, lambda a: F.lower(strip(a))), lambda a: a != ""), lambda a: F.element_at(F.split(a, r"\s+"), -1))
    return F.array_join(F.array_sort(last), "|")


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    n = F.length(c) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def text_hash(c: Column) -> Column:
    """SHA-256 of the stripped text; null for a blank one, so that blank texts equal nothing."""
    return F.when(strip(F.coalesce(c, F.lit(""))) != "", F.sha2(strip(c), 256))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def raw_hash(c: Column) -> Column:
    """SHA-256 of a text as it stands, or of a file's bytes; null if there is none."""
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def question_form(c: Column) -> Column:
    """A question as it counts for a cache: lower case, one space between words."""
    return F.lower(one_space(c))


def search_key(query: Column, source: Column, page: Column | int = 1) -> Column:
    return F.concat(F.lit("search:"), source, F.lit(":"), short_hash(question_form(query)), F.lit(":p"), F.lit(page).cast("string"))


def paper_key(external_id: Column) -> Column:
    return F.concat(F.lit("paper:meta:"), short_hash(external_id))


def embedding_key(text_hash: Column) -> Column:
    return F.concat(F.lit("embed:"), text_hash)


def chat_key(paper_ids: Column, question: Column, model: Column, provider: Column) -> Column:
    ids = F.array_join(F.transform(F.array_sort(paper_ids), lambda i: i.cast("string")), ",")
    return F.concat(F.lit("llm:chat:"), short_hash(F.concat_ws(":", ids, question_form(question), model, provider)))


def analysis_key(paper_id: Column, kind: Column, provider: Column) -> Column:
    return F.concat_ws(":", F.lit("llm"), kind, paper_id.cast("string"), provider)


def related_key(paper_id: Column) -> Column:
    return F.concat(F.lit("related:"), paper_id.cast("string"))


def health_key(service: Column) -> Column:
    return F.concat(F.lit("health:"), service)


def any_like(c: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words, whatever their case, % and _ being wild."""
    return reduce(lambda a, b: a | b, [c.ilike(f"%{w}%") for w in words], F.lit(False))


def injection_flags(c: Column, patterns: Sequence[str] = tuple(L.INJECTION_PATTERNS)) -> Column:
    """injection_pattern_i for each pattern that the text has."""
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(f"injection_pattern_{i}")) for i, p in enumerate(patterns)]))


# How an answer names a source, strictly and loosely.
STRICT_SOURCE, LOOSE_SOURCE = r"\[\s*SOURCE\s+(\d+)\s*\]", r"(?i)[\(\[]?\s*source\s+(\d+)\s*[\)\]]?"


def _numbers(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x: F.length(x) < 10)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def citations(c: Column) -> Column:
    """Numbers of the [SOURCE n] of an answer, sorted, distinct."""
    return _numbers(c, STRICT_SOURCE)


def malformed_citations(c: Column) -> Column:
    """Numbers of mentions of a source that are not of the strict form."""
    loose = F.filter(F.regexp_extract_all(c, F.lit(LOOSE_SOURCE), F.lit(0)), lambda x: ~x.rlike(f"^(?:{STRICT_SOURCE})$"))
    return F.array_sort(F.array_distinct(F.transform(loose, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))))


def without_headings(c: Column) -> Column:
    """An answer without lines that hold capitals, digits, blanks, - and = only."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike("^[A-Z0-9 \\-=]+$")), "\n")


# Fixed value: the whole answer that needs no citation.
NO_ANSWER = "The available research context is insufficient to answer this question."


def citation_verdict(answer: Column, sources: Column) -> Column:
    """valid, citations, invalid_citations, missing_citations of an answer that may cite so many sources."""
    own = without_headings(answer)
    cited = citations(own)
    invalid = F.array_sort(F.array_union(F.filter(cited, lambda n: (n < 1) | (n > sources)), malformed_citations(own)))
    missing = F.size(cited) == 0
    refused = strip(answer) == NO_ANSWER
    none = F.array().cast("array<int>")
    return F.when(refused, F.struct(F.lit(True).alias("valid"), none.alias("citations"), none.alias("invalid_citations"), F.lit(False).alias("missing_citations"))).otherwise(
        F.struct(((F.size(invalid) == 0) & ~missing).alias("valid"), cited.alias("citations"), invalid.alias("invalid_citations"), missing.alias("missing_citations"))
    )


def reference_chunk(c: Column) -> Column:
    """Whether a chunk is of a reference list: a heading at its first line, or many [n]."""
    own = strip(F.coalesce(c, F.lit("")))
    first = strip(F.element_at(F.split(F.lower(own), "\n"), 1))
    marks = F.regexp_count(own, F.lit(r"\[\d{1,3}\]"))
    return (own != "") & (first.rlike("^(" + "|".join(L.REFERENCE_HEADINGS) + ")") | (marks >= 5) | ((marks >= 3) & (marks / F.greatest(F.size(words(own)), F.lit(1)) > 0.05)))


def visual_chunk(c: Column) -> Column:
    """Whether a chunk is the text of a picture: padding marks, or mostly lines of one word."""
    own = strip(F.coalesce(c, F.lit("")))
    lines = F.split(own, "\n")
    single = F.size(F.filter(lines, lambda x: (F.size(words(x)) == 1)))
    return (own != "") & (F.lower(own).rlike("^attention visualizations|<pad>|<eos>") | ((F.size(lines) >= 6) & (single / F.size(lines) > 0.5)))


def metadata_value(c: Column) -> Column:
    """A metadata value in one line, null if blank."""
    return F.nullif(one_space(F.translate(c, "\x00", " ")), F.lit(""))


def needs_ocr(chars: Column, pages: Column) -> Column:
    return F.coalesce((pages == 0) | (chars / pages < 100), F.lit(True))


def author_line(c: Column) -> Column:
    """Whether a line of a first page may name authors."""
    own = strip(c)
    digits = F.length(F.regexp_replace(own, "[^0-9]", ""))
    return (
        F.length(own).between(3, 180)
        & ~F.lower(own).rlike(r"^(abstract|introduction|keywords|contents|references)|https?://|www\.|\b(19|20)\d{2}\b")
        & ~contains_any(own, L.AFFILIATION_MARKS)
        & (digits <= F.greatest(F.lit(2), F.floor(F.length(own) / 8)))
        & (F.regexp_count(own, F.lit(r"\s")) <= 20)
        & own.rlike("[A-Za-z]")
    )


def page_lines(c: Column) -> Column:
    """The lines of a page in one space each, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]"), one_space), lambda x: x != "")


def title_line(lines: Column) -> Column:
    """A page's first line as a title: null if it is longer than 300 characters or a heading."""
    first = F.try_element_at(lines, F.lit(1))
    return F.when((F.length(first) <= 300) & ~F.lower(first).isin("abstract", "introduction"), first)


def author_block(lines: Column, title: Column) -> Column:
    """Authors of a first page: of the 12 lines after the title (sought in the first 30; from the first line, if it is not there) up to a section's begin, the first four that may name authors, distinct, joined by a comma. Null if there are none."""
    wanted = F.lower(one_space(F.coalesce(title, F.lit(""))))
    same = lambda x: (x == wanted) | F.contains(x, wanted) | F.contains(wanted, x)
    at = F.when(wanted != "", F.array_position(F.transform(F.slice(lines, 1, 30), lambda x: same(F.lower(x))), True)).otherwise(F.lit(0)).cast("int")
    near = F.slice(lines, F.coalesce(at, F.lit(0)) + 1, 12)

    def named(own: Column) -> Column:
        end = F.array_position(F.transform(own, lambda x: F.lower(x).isin(*L.BLOCK_ENDS)), True).cast("int")
        before = F.when(end > 0, F.slice(own, F.lit(1), end - 1)).otherwise(own)
        return F.slice(F.filter(before, author_line), 1, 4)

    return F.nullif(F.array_join(F.array_distinct(let(near, named)), ", "), F.lit(""))


def inverted_index(words: Column) -> Column:
    """word to positions (from 0, ascending) of an array of words, made where the words are: nothing is shuffled. Null for null."""

    def index_of(words: list[str] | None) -> list[tuple[str, list[int]]] | None:
        found: dict[str, list[int]] = {}
        for at, word in enumerate(words or []):
            found.setdefault(word, []).append(at)
        return None if words is None else list(found.items())

    def work(column: pa.Array) -> pa.Array:
        return pa.array([index_of(x) for x in column.to_pylist()], pa.map_(pa.string(), pa.list_(pa.int32())))

    return F.arrow_udf(sliced(work), "map<string, array<int>>")(words)


def abstract_of(index: Column) -> Column:
    """The text of an inverted index (word to positions), words of one position in their order."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(flat), lambda x: x["w"]), " ")


def first_categories(primary: Column, topics: Column, most: int = 5) -> Column:
    """The primary topic and then the others, distinct, at most so many."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(primary), topics))), 1, most)


def utc_time(c: Column) -> Column:
    """A time in UTC without zone; null if it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(strip(c), "[Zz]$", "+00:00")).cast("timestamp_ntz")


def extracted_json(c: Column) -> Column:
    """What stands from the first { to the last } of an answer, code fences taken off; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(c, "```(json)?", ""), r"(?s)\{.*\}", 0)
