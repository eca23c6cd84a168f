"""Structure of hand-made circulars against what a reader finds in them, written out by hand."""

import pytest

from lexsieve import flow
from lexsieve.functions.dialect import SPARK
from lexsieve.plans import structure

CIRCULAR = """RBI/2024-25/77
March 5, 2024
Master Direction on Outsourcing
of Services by Lenders
Madam / Dear Sir,
A preamble that belongs to no section.
1. Scope
1.1. Lenders shall keep a register of vendors.
1.1.2. The register shall list each vendor.
(iv) Lenders may share the register.
2024. was a long year
17
2. The rule reads as under:
(i) "Vendors shall be audited."
(ii) "Audits shall be yearly."
3.
Section 4A: Penalties
A fine applies.
Annex II - Forms
Form A is set out here.
Yours faithfully,
(R. Example)
Chief General Manager"""
PLAIN = "Note\n\nAll insurers shall file returns within 15 days, says this text without any number."
ODD = "(iv) roman first\nSchedule 3\n5. Late fee\n12th June 2023"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "RBI", CIRCULAR), (2, "IRDAI", PLAIN), (3, "OTHER", ODD), (4, "OTHER", "")], "doc_id bigint, source string, full_text string")


def rows(docs, plan):
    docs.createOrReplaceTempView("structure_docs")
    return docs.sparkSession.sql(plan(SPARK, "SELECT * FROM structure_docs")).collect()


def test_sections(docs):
    got = {}
    for r in sorted(rows(docs, structure.sections), key=lambda r: (r.doc_id, r.section)):
        got.setdefault(r.doc_id, []).append((r.section_no, r.level, r.heading, r.char_offset, r.section_text))
    one = got[1]
    assert [x[0] for x in one] == ["1", "1.1", "1.1.2", "iv", "2", "i", "ii", "3", "Section 4A", "Annex II"]
    assert [x[1] for x in one] == [1, 2, 3, 3, 1, 3, 3, 1, 1, 1]
    assert one[0][2] == "Scope" and one[7][2] == "The rule reads as under:" and one[8][2] == "Penalties" and one[9][2] == "Annex II Forms"
    assert all(CIRCULAR[x[3] :].startswith(x[4].split("\n")[0]) for x in one)
    assert one[3][4] == "(iv) Lenders may share the register.\n2024. was a long year\n17" and one[8][4] == "Section 4A: Penalties\nA fine applies."
    assert one[9][4].endswith("Chief General Manager") and "preamble" not in "".join(x[4] for x in one)
    assert got[2] == [("S1", 1, "All insurers shall file returns within 15 days, says this text without any number.", 0, PLAIN)]
    assert [x[:3] for x in got[3]] == [("Schedule 3", 1, "Schedule 3"), ("5", 1, "Late fee")] and 4 not in got


def test_headers(docs):
    got = {r.doc_id: r for r in rows(docs, structure.headers)}
    one = got[1]
    assert (one.title, one.issued_by, one.issue_date, one.circular, one.document_key) == ("Master Direction on Outsourcing of Services by Lenders", "R. Example - Chief General Manager", "2024-03-05", "RBI/2024-25/77", "RBI-RBI-2024-25-77")
    assert got[2].title == "All insurers shall file returns within 15 days, says this text without any number." and got[2].issued_by == "" and got[2].issue_date is None
    assert got[2].document_key == "all-insurers-shall-file-returns-within-15-days-says-this-text-without-any-number" and got[3].issue_date is None
    assert got[4].title == "doc-4"


def test_quotations_go_as_deep_as_they_are(docs):
    got = {(r.doc_id, r.section): r.clause_type for r in rows(docs, structure.quotations)}
    assert [got[1, n] for n in (5, 6, 7)] == ["quoted_reference"] * 3 and got[1, 8] != "quoted_reference" and got[1, 3] != "quoted_reference"


def test_annexures_lines_filter_and_analysis(docs):
    assert [(r.doc_id, r.section) for r in sorted(rows(docs, structure.annexures))] == [(1, 10), (3, 1)]
    assert [(r.clause_number, r.clause) for r in sorted(rows(docs, structure.clause_lines)) if r.doc_id == 1] == [
        ("1.1", "1.1. Lenders shall keep a register of vendors."), ("1.1.2", "1.1.2. The register shall list each vendor."), ("2024", "2024. was a long year"), ("2", "2. The rule reads as under:"),
    ]
    skipped = {(r.doc_id, r.section): r.skipped for r in rows(docs, structure.skipped_sections)}
    assert skipped[1, 1] and not skipped[1, 2] and not skipped[2, 1]
    about = {r.doc_id: r for r in rows(docs, structure.analysis)}
    assert (about[1].primary_actor, about[1].domains, about[1].quotes, about[1].enumerates) == ("Bank", "Other", False, True)
    assert about[2].primary_actor == "Insurer" and about[2].core_phrases.startswith("note all insurers shall file returns within 15 days") and not about[2].enumerates


def test_issuers(spark):
    texts = spark.createDataFrame([("/a/SEBI_note.pdf", "x" * 200, 200), ("/a/scan.pdf", "The Reserve Bank of India directs", 30), ("/a/b.pdf", "nothing", 7), ("/a/c.pdf", " " * 4100 + "by the Financial Intelligence Unit", 40)], "path string, full_text string, total_chars int")
    got = {r.path: r.source for r in flow.sourced(texts).collect()}
    assert list(got[p] for p in ("/a/SEBI_note.pdf", "/a/scan.pdf", "/a/b.pdf", "/a/c.pdf")) == ["SEBI", "RBI", "OTHER", "FIU-IND"]
    assert {r.source for r in flow.sourced(texts.limit(1), "NPCI").collect()} == {"NPCI"}
