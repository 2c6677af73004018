"""Checks of generated answers: citations, gaps and strengths against their sources, summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from paperloom.functions import lexicons as L
from paperloom.functions import text as T
from paperloom.sources.steps import saved

SOURCE_NUMBER = r"(?i)^\s*SOURCE\s+(\d{1,9})\s*$"
LIMITATION = "limitations array<struct<statement:string,status:string,source:string>>"
GAP = "possible_gaps array<struct<statement:string,source:string>>"
STRENGTH = "strengths array<struct<statement:string,category:string,source:string,evidence:string>>"


def _jsons(answers: DataFrame) -> DataFrame:
    return answers.select("request_id", T.extracted_json(F.col("answer")).alias("json"))


def _items(jsons: DataFrame, schema: str, field: str) -> DataFrame:
    parsed = jsons.select("request_id", F.from_json("json", schema).alias("j"))
    rows = parsed.select("request_id", F.posexplode(f"j.{field}").alias("at", "x")).filter(F.col("x").isNotNull())
    return rows.select("request_id", "at", "x.*").withColumn("number", F.regexp_extract("source", SOURCE_NUMBER, 1).try_cast("int"))


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy("request_id", *[F.lower(T.strip(F.col(k))) for k in keys]).orderBy("at")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def accepted_gaps(
    answers: DataFrame, sources: DataFrame, statuses: Sequence[str] = tuple(L.GAP_STATUSES), open_statuses: Sequence[str] = ("PARTIALLY ADDRESSED", "EXPLICITLY UNRESOLVED"),
    solutions: Sequence[str] = tuple(L.SOLUTION_PHRASES), absences: Sequence[str] = tuple(L.ABSENCE_PHRASES), novelties: Sequence[str] = tuple(L.NOVELTY_PHRASES),
) -> DataFrame:
    """request_id, kind (limitation or gap), at, statement, status, source of the items of each answer (request_id, answer) that hold.

    sources: request_id, source (number), text. A limitation holds if its three fields are there, its source is one of
    the request's, its status is known, its words are in the source, and it claims neither absence nor novelty. A gap
    holds if a limitation of an open status has its source, it shares key terms with a limitation of that source (or
    one of them has none), and it proposes nothing and claims neither. Of equal items the first counts. A request
    without a limitation of an open status has no items.

    Texts are read once: the answers' JSON and the limitations and gaps, which several steps read, are written.
    """
    some = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    told = sources.filter(some("text")).select("request_id", F.col("source").alias("number"), T.key_terms(F.col("text")).alias("terms"))
    jsons = saved(_jsons(answers))
    claim = T.contains_any(F.col("statement"), absences) | T.contains_any(F.col("statement"), novelties)
    own = T.key_terms(F.col("statement"))
    limitations = _items(jsons, LIMITATION, "limitations").filter(some("statement") & some("status") & some("source") & F.col("status").isin(*statuses) & ~claim).withColumn("own", own)
    limitations = saved(limitations.join(told, ["request_id", "number"]).filter(T.grounded(F.col("own"), F.col("terms"))).drop("terms"))
    gaps = saved(_items(jsons, GAP, "possible_gaps").filter(some("statement") & some("source")).withColumn("own", own))
    open_ = limitations.filter(F.col("status").isin(*open_statuses)).groupBy("request_id", "number").count().drop("count")
    of_source = limitations.select("request_id", "number", F.col("own").alias("theirs"))
    shares = (F.size("own") == 0) | (F.size("theirs") == 0) | F.arrays_overlap("own", "theirs")
    sharing = gaps.select("request_id", "number", "at", "own").join(of_source, ["request_id", "number"]).filter(shares).select("request_id", "number", "at").distinct()
    kept = gaps.join(open_, ["request_id", "number"], "left_semi").join(sharing, ["request_id", "number", "at"], "left_semi")
    kept = kept.filter(~T.contains_any(F.col("statement"), solutions) & ~T.starts_with_action(F.col("statement")) & ~claim)
    columns = ["request_id", "at", "statement", "status", F.format_string("SOURCE %d", F.col("number")).alias("source")]
    one = _first(limitations, "statement", "status", "source").select(F.lit("limitation").alias("kind"), *columns)
    two = _first(kept, "statement", "source").withColumn("status", F.lit(None).cast("string")).select(F.lit("gap").alias("kind"), *columns)
    answered = open_.select("request_id").distinct()
    return one.unionByName(two).join(answered, "request_id", "left_semi").withColumn("at", F.col("at").cast("long"))


def verified(items: DataFrame, sources: DataFrame, verify: Callable[[Column], Column], drop: bool = False) -> DataFrame:
    """The accepted items (accepted_gaps) with valid and evidence: what a verifier replies to each limitation's source text.

    verify: from a source's text to a reply, an expression or a model behind answered(). Each source is asked about once,
    however many limitations name it. A limitation whose source is blank, or whose verifier gives null, and a gap have
    null in both. drop: leave out the limitations that the verifier denies.
    """
    named = saved(items.withColumn("number", F.regexp_extract("source", SOURCE_NUMBER, 1).try_cast("int")))
    asked = named.filter("kind = 'limitation'").select("request_id", "number").distinct()
    texts = sources.select("request_id", F.col("source").alias("number"), "text").filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    replies = asked.join(texts, ["request_id", "number"]).select("request_id", "number", verify(F.col("text")).alias("reply"))
    replies = replies.filter(F.col("reply").isNotNull()).select("request_id", "number", F.lit("limitation").alias("kind"), verifier_reply(F.col("reply")).alias("x"))
    rows = named.join(replies, ["request_id", "number", "kind"], "left").select(*items.columns, "x.valid", "x.evidence")
    return rows.filter(F.coalesce("valid", F.lit(True))) if drop else rows


def gap_answers(items: DataFrame) -> DataFrame:
    """request_id, answer: each request's items as JSON, limitations (with what the verifier said, if it did) and possible gaps in their order."""
    verification = F.when(F.col("valid").isNotNull(), F.struct("valid", "evidence")) if "valid" in items.columns else F.lit(None).cast("struct<valid:boolean,evidence:string>")
    row = F.struct("at", F.col("statement"), F.col("status"), F.col("source"), verification.alias("verification"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))
    both = items.groupBy("request_id").agg(listed("limitation").alias("l"), listed("gap").alias("g"))
    limitations = F.transform("l", lambda x: F.struct(x["statement"].alias("statement"), x["status"].alias("status"), x["source"].alias("source"), x["verification"].alias("verification")))
    gaps = F.transform("g", lambda x: F.struct(x["statement"].alias("statement"), x["source"].alias("source")))
    return both.select("request_id", F.to_json(F.struct(limitations.alias("limitations"), gaps.alias("possible_gaps"))).alias("answer"))


def accepted_strengths(answers: DataFrame, sources: DataFrame, categories: Sequence[str] = tuple(L.STRENGTH_CATEGORIES), praise: Sequence[str] = tuple(L.PRAISE_PHRASES)) -> DataFrame:
    """request_id, at, statement, category, source of the strengths that hold: four fields, a known category and source, statement and evidence both in the source's words, no empty praise."""
    some = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    told = sources.select("request_id", F.col("source").alias("number"), T.key_terms(F.col("text")).alias("terms"))
    rows = _items(_jsons(answers), STRENGTH, "strengths").filter(some("statement") & some("category") & some("source") & some("evidence"))
    rows = rows.withColumn("category", F.lower(T.strip(F.col("category")))).filter(F.col("category").isin(*categories)).join(told, ["request_id", "number"])
    grounded = T.grounded(T.key_terms(F.col("statement")), F.col("terms")) & T.grounded(T.key_terms(F.col("evidence")), F.col("terms"))
    rows = rows.filter(grounded & ~T.contains_any(F.col("statement"), praise))
    return rows.select("request_id", F.col("at").cast("long").alias("at"), "statement", "category", F.format_string("SOURCE %d", F.col("number")).alias("source"))


# Fixed value: what stands for a part of a summary that an answer does not give.
NOT_STATED = "Not stated"


def json_candidates(text: str) -> list[str]:
    """Parts of an answer that may be a JSON object, best first: the whole without code fences, then its balanced {...}, longest first, each with those inside of it, then what begins at the first brace, mended.

    Of each, too, the form in which an object that stands in a string is written out.
    """
    own = re.sub(r"```(?:json)?", "", text).strip()
    opens, found = [], []
    for m in re.finditer(r"[{}]", own):
        if m[0] == "{":
            opens.append(m.start())
        elif opens:
            found.append(own[opens.pop() : m.end()])
    found.sort(key=len, reverse=True)
    first = own.find("{")
    out = [own, *found, *([own[first:], own[first:] + "}"] if first >= 0 else [])]
    out = [re.sub(r",\s*}", "}", x) for x in out if x.startswith("{")]
    return list(dict.fromkeys([*out, *[x.replace('\\"', '"') for x in out if '\\"' in x]]))


def parsed_summaries(answers: DataFrame, aliases: dict[str, list[str]] = L.SUMMARY_KEYS, missing: str = NOT_STATED) -> DataFrame:
    """request_id and the five parts of each summary; null parts if no JSON object in the answer has at least three of them.

    The candidates (json_candidates) are parsed in order, and the first with three parts counts: that mends trailing
    commas and a missing last brace and finds an object in prose, in another object or in a string. Names are compared
    in lower case with _ for blanks. Of a part's names in order the first with a string counts; absent parts are `missing`.
    """

    def work(column: pa.Array) -> pa.Array:
        return pa.array([json_candidates(x) if x else [] for x in column.to_pylist()], pa.list_(pa.string()))

    parse = lambda c: F.from_json(c, "map<string,string>")
    plain = lambda m: F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.translate(F.lower(T.strip(e["key"])), " ", "_").alias("key"), e["value"].alias("value")))))
    hits = lambda m: sum((F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(n) for n in own])).cast("int") for own in aliases.values()), F.lit(0))
    maps = F.filter(F.transform(F.arrow_udf(work, "array<string>")(F.col("answer")), parse), lambda m: m.isNotNull() & (F.size(m) > 0))
    maps = F.filter(F.transform(F.filter(maps, lambda m: F.size(F.array_distinct(F.transform(F.map_keys(m), lambda k: F.translate(F.lower(T.strip(k)), " ", "_")))) == F.size(m)), plain), lambda m: hits(m) >= 3)
    rows = answers.select("request_id", F.explode(F.array(F.try_element_at(maps, F.lit(1)))).alias("m"))
    part = lambda own: F.coalesce(*[F.nullif(T.strip(F.col("m")[n]), F.lit("")) for n in own], F.lit(missing))
    return rows.select("request_id", *[F.when(F.col("m").isNotNull(), part(own)).alias(key) for key, own in aliases.items()])


def answered(prompt: Column, providers: Sequence[tuple[str, Callable[[], Callable[[str], str]]]], strikes: int = 3) -> Column:
    """provider, answer and n_tried of each prompt: the plug point for language models, called in Arrow batches within tasks.

    providers: (name, load) in the order in which they are asked; load() gives the function of a prompt, once in a task,
    and a provider whose load fails is left out. A blank answer or an exception passes on to the next; a provider whose
    calls raised `strikes` times in a row is not asked again in the task. All null if none answers.
    """

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready, failed = [], {}
        for name, load in providers:
            try:
                ready.append((name, load()))
            except Exception:  # noqa: BLE001 - a plug-in may raise anything; the next one is asked
                continue
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                got, tried = None, 0
                for name, ask in ready if text is not None else []:
                    if failed.get(name, 0) >= strikes:
                        continue
                    tried += 1
                    try:
                        said = ask(text)
                        failed[name] = 0
                    except Exception:  # noqa: BLE001
                        failed[name] = failed.get(name, 0) + 1
                        continue
                    if said and said.strip():
                        got = {"provider": name, "answer": said, "n_tried": tried}
                        break
                out.append(got)
            yield pa.array(out, pa.struct([("provider", pa.string()), ("answer", pa.string()), ("n_tried", pa.int64())]))

    return F.arrow_udf(work, "provider string, answer string, n_tried long", ArrowUDFType.SCALAR_ITER)(prompt)


def verifier_reply(reply):
    """valid and evidence of a verifier's reply: VALID: YES at its start, and its first EVIDENCE line unless that is NONE."""
    own = T.strip(reply)
    found = T.strip(F.regexp_extract(own, r"(?im)^\s*EVIDENCE:(.*)$", 1))
    return F.struct(F.upper(own).startswith("VALID: YES").alias("valid"), F.when((found != "") & (F.upper(found) != "NONE"), found).alias("evidence"))


def history(turns: DataFrame, key: str, order: str, most: int = 6) -> DataFrame:
    """key, n_turns, history: each conversation's last turns (role, text), blank ones left out, as lines `Role: text`. Spark keeps `most` rows of a key before it shuffles."""
    last = turns.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("n") <= most).filter(T.strip(F.col("text")) != "")
    line = F.concat(F.initcap("role"), F.lit(": "), T.one_space(F.col("text")))
    gathered = last.select(key, F.struct(F.col(order).alias("o"), line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select(key, F.size("xs").cast("long").alias("n_turns"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("history"))
