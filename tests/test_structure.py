import random

import pytest
from lorequarry.functions import tei
from lorequarry.operators import chunking
from pyspark.sql import functions as F

DIVS = "divs array<struct<head:string,text:string>>"


def assign(spark, heads):
    divs = [(h, t) for h, t in ((h if isinstance(h, tuple) else (h, "text")) for h in heads)]
    row = spark.createDataFrame([(divs,)], DIVS).select(tei.assign_sections(F.col("divs")).alias("a")).first()
    return [d.section for d in row.a]


@pytest.mark.parametrize(
    ("heads", "sections"),
    [
        (["Introduction", "II. Related Work", "A. Sub", "III. Refined PE", "IV. Results", "Ethics"], ["introduction", None, None, "method", "results", None]),
        (["Introduction", "Conclusion", "Limitations"], ["introduction", "conclusion", "method"]),
        (["Introduction", "IV. Results", "V. Ethics"], ["introduction", "results", "results"]),
        (["Introduction", "IV. Results", "VI. Ethics"], ["introduction", "results", None]),
        ([("Method", ""), "A. Details"], ["method", "method"]),
        (["Results and Discussion", "Language Model Evaluation", "Background and Method"], ["results", "method", "method"]),
    ],
)
def test_sections(spark, heads, sections):
    assert assign(spark, heads) == sections


def slow_assign(heads):
    import re

    last, seen, out = None, False, []
    for head in heads:
        normal = re.sub(r"(?i)^(?:[IVXLCDM]+|[A-Z]|\d+)(?:\.\d+)*\.?\s+", "", head).strip().lower()
        own = next((n for n, words in tei.SECTION_KEYWORDS if any(w in normal for w in words)), None) if head else None
        sub = bool(re.match(r"[A-Z]\.\s+", head))
        if own is None and last and sub:
            own = last
        elif own is None and head and any(w in normal for w in tei.SKIPPED_KEYWORDS):
            last = None
            out.append(None)
            continue
        elif own is None and not sub and seen and last != "results":
            own = "method"
        if own is None:
            last = last if sub else None
        else:
            last, seen = own, seen or own == "introduction"
        out.append(own)
    return out


def test_sections_by_brute_force(spark):
    rng = random.Random(2)
    pool = ["", "Introduction", "I. Introduction", "Model", "A. Part", "V. Ethics", "VI. More", "Results", "Appendix", "Related Work", "Conclusion", "Odd"]
    runs = [rng.choices(pool, k=rng.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame([(i, [(h, "t") for h in r]) for i, r in enumerate(runs)], "i int, " + DIVS)
    for row in df.select("i", tei.assign_sections(F.col("divs")).alias("a")).collect():
        assert [d.section for d in row.a] == slow_assign(runs[row.i]), runs[row.i]


def test_headings(spark):
    row = spark.range(1).select(tei.normalize_heading(F.lit("III. A Refined X")), tei.normalize_heading(F.lit("Mix models"))).first()
    assert tuple(row) == ("a refined x", "models")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A
 Title</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Ada</forename><surname>Byron</surname></persName>
<affiliation>Lab</affiliation><affiliation>City</affiliation></author><author><persName/></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short  one.</p></abstract></profileDesc></teiHeader><text><body><div><head>1. Introduction</head><p>First.</p><p>Second.</p></div>
<div><head>Ideas</head><p>Third.</p></div></body><back><div><listBibl><biblStruct xml:id="b0"><analytic><title type="main">Old</title>
<author><persName><surname>Li</surname></persName></author></analytic><monogr><imprint><date when="2001-02"/></imprint></monogr>
<note type="raw_reference">Li, Old, 2001</note></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei(spark):
    rows = tei.sections_from_tei(spark.createDataFrame([("p1", TEI), ("p2", "<not xml"), ("p3", None), ("p4", "<a/>")], "arxiv_id string, tei string")).collect()
    (r,) = rows
    assert (r.title, r.abstract, r.sections.introduction, r.sections.method) == ("A Title", "Short one.", "First.\n\nSecond.", "Third.")
    assert [tuple(a) for a in r.authors] == [("Ada Byron", "Lab; City")]
    assert [tuple(x) for x in r.references] == [("b0", "Old", ["Li"], "2001", "Li, Old, 2001")]


def slow_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The stated algorithm, step by step on lists."""
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    raw = list(text) if sep == "" else text.split(sep)
    pieces = [p for p in (raw if sep == "" else [raw[0], *[sep + p for p in raw[1:]]]) if p]
    out, held = [], []

    def merge():
        window, total = [], 0
        for p in held:
            if total + len(p) > size and window:
                if (joined := "".join(window).strip()):
                    out.append(joined)
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if (joined := "".join(window).strip()):
            out.append(joined)
        held.clear()

    for p in pieces:
        if len(p) < size:
            held.append(p)
        else:
            merge()
            out.extend(slow_split(p, size, overlap, rest) if rest else [p])
    merge()
    return out


def test_split_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bb", " ", "\n", "\n\n", "cccccccc"], k=rng.randint(0, 80)))
        got = chunking.split_text(text, 20, 6)
        assert got == slow_split(text, 20, 6) and all(len(c) <= 20 for c in got)


def test_merge(spark):
    assert chunking.merge_to_n(list("abcdefg"), 3) == ["a\n\nb", "c\n\nd", "e\n\nf\n\ng"]
    for n in range(1, 9):
        pieces = F.array(*(F.lit(c) for c in "abcdefg"))
        got = spark.range(1).select(chunking.merge_to_n_column(pieces, n)).first()[0]
        assert got == chunking.merge_to_n(list("abcdefg"), n)


def test_chunk_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("arxiv_id"), "text", F.lit("f").alias("source_file"))
    rows = chunking.naive_chunks(docs).collect()
    want = {(f"{d.arxiv_id}_{i:04d}", c) for d in docs.collect() for i, c in enumerate(slow_split(d.text, 512, 50))}
    assert {(r.chunk_id, r.text) for r in rows} == want


def test_section_plan(spark):
    long = " ".join(f"word{i}" for i in range(900))
    papers = spark.createDataFrame([("p", [("Ada ", "x"), (" ", "y")], "Abs " * 400, ("Short.", long, long, long))], "arxiv_id string, authors array<struct<name:string,affiliation:string>>, abstract string, sections struct<introduction:string,method:string,results:string,conclusion:string>")
    meta = spark.createDataFrame([("p", 2001, 1), ("p", 2002, 2)], "arxiv_id string, year int, seq int")
    rows = chunking.section_chunks(papers, meta).collect()
    count = {s: sum(r.section == s for r in rows) for s in ("abstract", "introduction", "method", "results", "conclusion")}
    assert count == {"abstract": 1, "introduction": 1, "method": 5, "results": 4, "conclusion": 0}
    assert {r.year for r in rows} == {2002} and rows[0].authors == ["Ada"] and "p_method_00" in {r.chunk_id for r in rows}
    assert {r.section: r.n for r in chunking.chunk_stats(chunking.section_chunks(papers, meta)).collect()}[None] == 11
