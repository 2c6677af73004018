"""Sources: facts of PDF files, feeds as a data source, substring search by an index, verification of limitations."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answers
from paperloom.sources import feeds, pdf, readers, tables, trigrams

# -- PDF files ----------------------------------------------------------------------------------------------------------


def classic(pages=3, more=b"", count=None, old=b""):
    count = pages if count is None else count
    objects = [b"<< /Type /Catalog /Title (a >> b \\) << c) /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Resources << /Count 77 >> /Count %d >>" % count, b"<< /Type /Page /Parent 2 0 R >>"]
    body = b"%PDF-1.4\n" + old + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return body + b"xref\n0 4\ntrailer\n<< /Size 4 /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF" % (more, len(body))


def packed(pages):
    """Objects in a compressed stream, and a cross-reference stream in the place of a trailer."""
    own = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [] >>" % pages]
    head = b"1 0 2 %d " % (len(own[0]) + 1)
    body = zlib.compress(head + own[0] + b" " + own[1])
    first = b"5 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(body), body)
    return b"%PDF-1.5\n" + first + b"6 0 obj\n<< /Type /XRef /Size 7 /Root 1 0 R /W [1 2 1] /Length 0 >>\nstream\n\nendstream\nendobj\nstartxref\n9\n%%EOF"


@pytest.mark.parametrize(
    ("data", "facts"),
    [
        (classic(3), (False, 3)), (classic(201), (False, 201)), (classic(3, b"/Encrypt 9 0 R "), (True, None)), (classic(3, b"/EncryptMetadata false "), (False, 3)), (packed(250), (False, 250)),
        (classic(7, old=b"2 0 obj\n<< /Type /Pages /Count 900 >>\nendobj\n"), (False, 7)), (b"%PDF-1.4 nothing", (False, None)), (b"", (False, None)), (b"%PDF- trailer << /Root 1 0 R", (False, None)), (packed(4).replace(b"x\x9c", b"xx", 1), (False, None)),
    ],
)
def test_facts_of_pdf_files(data, facts):
    assert pdf.facts(data) == facts


def test_problems_of_pdf_files(rows):
    values = [("ok", classic()), ("long", classic(201)), ("locked", classic(3, b"/Encrypt << /V 1 >> ")), ("text", b"hello"), ("none", b""), ("big", classic() + b" " * 3000), ("odd", b"%PDF-x")]
    df = rows("path string, length long, content binary", *[(p, len(c), bytearray(c)) for p, c in values])
    got = {r.path: r.problem for r in readers.with_problems(df, most_bytes=3000).collect()}
    assert got == {"ok": None, "long": "too many pages", "locked": "encrypted", "text": "no PDF", "none": "empty", "big": "too large", "odd": None}


# -- feeds --------------------------------------------------------------------------------------------------------------

ENTRY = '<entry><id>http://arxiv.org/abs/1.{0}v1</id><title> A\n {0} </title><summary> s </summary><published>2024</published><author><name>Ann</name></author><author><name>Bo</name></author><category term="cs.AI"/></entry>'
WORK = {"id": "W1", "display_name": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "authorships": [{"author": {"display_name": "Ann"}}], "primary_topic": {"display_name": "x"}, "topics": [{"display_name": "x"}, {"display_name": "y"}], "doi": "10.1/x", "primary_location": {"pdf_url": "u"}}


def write_atom(folder, *files):
    folder.mkdir(exist_ok=True)
    for i, numbers in files:
        (folder / f"{i}.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(ENTRY.format(n) for n in numbers) + "</feed>")


def test_feeds_in_batch_are_what_the_readers_give(spark, tmp_path):
    spark.dataSource.register(feeds.PaperFeed)
    write_atom(tmp_path / "a", (1, [1, 2]), (2, [3]))
    columns = ["title", "abstract", "authors", "categories", "published_date", "source", "source_id", "arxiv_id", "doi", "pdf_url"]
    read = spark.read.format("paper_feed").option("path", str(tmp_path / "a")).load()
    assert read.rdd.getNumPartitions() == 2
    assert sorted(read.select(columns).collect()) == sorted(readers.atom_feed(spark, str(tmp_path / "a")).select(columns).collect())
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text(json.dumps(WORK) + "\nno json\n" + json.dumps({"id": "W2"}) + "\n")
    own = spark.read.format("paper_feed").option("path", f"file://{tmp_path}/w").option("kind", "works").load()
    got = {r.source_id: r for r in own.collect()}
    want = readers.works(spark, str(tmp_path / "w")).filter("source_id = 'W1'").first()
    assert all(got["W1"][c] == want[c] for c in ("title", "abstract", "authors", "categories", "published_date", "source", "doi", "pdf_url")) and got["W2"].title is None and len(got) == 2


def test_feeds_as_a_stream_take_each_file_once(spark, tmp_path):
    spark.dataSource.register(feeds.PaperFeed)
    write_atom(tmp_path / "a", (1, [1]))
    for files, want in (((2, [2, 3]), 3), ((3, [4]), 4)):
        write_atom(tmp_path / "a", files)
        source = spark.readStream.format("paper_feed").option("path", str(tmp_path / "a")).load()
        source.select("arxiv_id").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start(str(tmp_path / "out"), "parquet", "append").awaitTermination(90)
        got = [r.arxiv_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert sorted(got) == [f"1.{n}v1" for n in range(1, want + 1)]


# -- substring search ---------------------------------------------------------------------------------------------------


def test_indexed_search_is_the_scan(spark, rows, tmp_path):
    at = f"{tmp_path}/chunks"
    words = ["Adam", "learning rate", "optimizer", "50% off", "a_b", "İstanbul", "ÉCOLE", "x"]
    texts = [f"{words[i % 8]} and {words[(i * 3 + 1) % 8]} {i}" for i in range(60)] + [None, "", "ab"]
    df = rows("paper_id long, chunk_id long, text string", *[(i, i % 2, t) for i, t in enumerate(texts)])
    readers.append_chunks(df.filter("paper_id < 40"), at)
    readers.append_chunks(df.filter("paper_id >= 40"), at)
    trigrams.append_index(df, at)
    for patterns in (["optimizer"], ["ADAM", "learning rate"], ["0% o"], ["a_b"], ["école"], ["İstanbul"], ["ab"], ["zzz"], ["and%rate"], ["rate 3"], [], ["50\\% off"]):
        got = {r.paper_id for r in trigrams.search(spark, at, patterns).collect()}
        assert got == ({r.paper_id for r in df.filter(T.any_like(F.col("text"), patterns)).collect()} if patterns else set()), patterns


def test_indexed_search_reads_fewer_files(spark, rows, tmp_path):
    at = f"{tmp_path}/chunks"
    df = rows("paper_id long, chunk_id long, text string", *[(i, 1, f"chunk of number {i:04d} here") for i in range(200)])
    readers.append_chunks(df, at)
    trigrams.append_index(df, at)
    found = trigrams.candidates(spark, at, "number 0042")
    met = tables.met(found, "paper_id")
    assert len(tables.read(spark, at, met).inputFiles()) < len(tables.read(spark, at).inputFiles()) / 4 or len(met) <= 2
    assert [r.paper_id for r in trigrams.search(spark, at, ["number 0042"]).collect()] == [42]


def test_an_index_has_a_row_for_each_trigram_of_a_stretch_of_texts(spark, rows, tmp_path):
    """Not one for each trigram of each text; odd texts among them."""
    at = f"{tmp_path}/chunks"
    odd = [(300, 1, None), (301, 1, ""), (302, 1, "ab"), (303, 1, "a😀Éb"), (303, 2, "😀éB c"), (304, 1, "aaa"), (304, 1, "aaa"), (-5, 7, "x" * 5000 + "AAA")]
    df = rows("paper_id long, chunk_id long, text string", *[(i, 1, f"chunk of number {i % 7} here") for i in range(200)], *odd).repartition(2)
    readers.append_chunks(df, at)
    trigrams.append_index(df, at)
    index = tables.read(spark, trigrams.index_path(at))
    kinds = index.select("gram").distinct().count()
    assert kinds <= index.count() <= 2 * kinds
    for pattern in ("number 3", "😀éb", "aaa", "xaa", "chunk%6 h", "éb c"):
        found = sorted((r.paper_id, r.chunk_id) for r in trigrams.search(spark, at, [pattern]).collect())
        assert found == sorted((r.paper_id, r.chunk_id) for r in df.filter(T.any_like(F.col("text"), [pattern])).collect()) != [], pattern


# -- verification -------------------------------------------------------------------------------------------------------


def test_limitations_are_verified_one_by_one(rows):
    schema = "request_id long, kind string, at long, statement string, status string, source string"
    items = rows(schema, (1, "limitation", 0, "a", "ADDRESSED", "SOURCE 1"), (1, "limitation", 1, "b", "ADDRESSED", "SOURCE 2"), (1, "gap", 0, "g", None, "SOURCE 1"), (2, "limitation", 0, "c", "ADDRESSED", "SOURCE 1"), (3, "limitation", 0, "d", "ADDRESSED", "SOURCE 1"))
    sources = rows("request_id long, source int, text string", (1, 1, "it fails"), (1, 2, "We used deep LSTMs"), (2, 1, " "), (3, 1, "silent"))
    verify = lambda t: F.when(F.contains(t, F.lit("fails")), F.concat(F.lit("VALID: YES\nEVIDENCE: "), t)).when(t != "silent", "VALID: NO\nEVIDENCE: NONE")
    got = {(r.request_id, r.kind, r.at): (r.valid, r.evidence) for r in answers.verified(items, sources, verify).collect()}
    assert got == {(1, "limitation", 0): (True, "it fails"), (1, "limitation", 1): (False, None), (1, "gap", 0): (None, None), (2, "limitation", 0): (None, None), (3, "limitation", 0): (None, None)}
    kept = answers.verified(items, sources, verify, drop=True)
    assert kept.count() == 4 and kept.filter("statement = 'b'").count() == 0
    told = {r.request_id: json.loads(r.answer) for r in answers.gap_answers(kept).collect()}
    assert told[1] == {"limitations": [{"statement": "a", "status": "ADDRESSED", "source": "SOURCE 1", "verification": {"valid": True, "evidence": "it fails"}}], "possible_gaps": [{"statement": "g", "source": "SOURCE 1"}]}
    assert told[2] == {"limitations": [{"statement": "c", "status": "ADDRESSED", "source": "SOURCE 1"}], "possible_gaps": []}
