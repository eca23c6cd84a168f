"""Rules on single texts, by way of DuckDB (test_plans holds Spark against it) and of annotate()."""

import duckdb
import pytest

from lexsieve.functions import rules as R
from lexsieve.functions.dialect import DUCK
from lexsieve.plans.annotate import annotate, obligations


def said(expression: str, x: str, source: str | None = None):
    return duckdb.execute(f"SELECT {expression} FROM (SELECT ? AS x, lower(?) AS low, ? AS source)", [x, x, source]).fetchone()[0]


@pytest.mark.parametrize(
    "text, source, who",
    [
        ("Scheduled commercial banks shall lend", "RBI", "Scheduled Commercial Bank"),
        ("Scheduled commercial banks shall lend", "SEBI", "Regulated Entity"),
        ("FRBs shall file, and the insurer too", "IRDAI", "FRBs/Reinsurers"),
        ("FRBs shall file", "RBI", "Regulated Entity"),
        ("The bank and its Board of Directors", None, "Board of Directors"),
        ("It shall be so", None, "Regulated Entity"),
    ],
)
def test_actor_scope(text, source, who):
    assert said(R.actor(DUCK, "low", "source"), text, source) == who


@pytest.mark.parametrize(
    "text, id_, kind",
    [
        ("Banks shall maintain books", "TV-001", "mandatory"),
        ("Banks shall forthwith tell", "TV-038", "mandatory"),
        ("Banks shall not exceed it", "NEG-001", "prohibition"),
        ("It may at its discretion", "TV-030", "discretionary"),
        ("subject to\n prior approval of all", "TV-031", "approval_required"),
        ("Nothing here", None, None),
    ],
)
def test_trigger(text, id_, kind):
    found = said(R.trigger_id(DUCK, R.one_line(DUCK, "low")), text)
    assert found == id_ and said(R.trigger_field(DUCK, f"'{found}'", "kind"), text) == kind


@pytest.mark.parametrize(
    "value, iso",
    [("29.04.2026", "2026-04-29"), ("31/02/2026", "2026-02-31"), ("April 9, 2026", "2026-04-09"), ("9 april 2026", "2026-04-09"), ("2026-04-09", None), ("Smarch 1, 2026", None), (None, None), ("", None)],
)
def test_iso_date(value, iso):
    assert said(R.iso_date(DUCK, "x"), value) == iso


@pytest.mark.parametrize("value, iso", [("FY 2022-23", "2022-04-01"), ("financial year 2022-2023 onwards", "2022-04-01"), ("2022-23", "2022-04-01"), ("2022-2023", None), ("in 2022-23", None)])
def test_fiscal_year(value, iso):
    assert said(R.fiscal_year(DUCK, "x"), value) == iso


@pytest.mark.parametrize(
    "text, date",
    [
        ("with effect from April 1, 2026", "2026-04-01"),
        ("shall come into force on May 02, 2026", "2026-05-02"),
        ("immediately upon publication", "date_of_circular"),
        ("supersede the circular ABC/12; applicable from FY 2024-25", None),
        ("effective from the financial year 2024-25", "2024-04-01"),
        ("applicable from FY2024-2025", None),
        ("some day", None),
    ],
)
def test_effective_date(text, date):
    assert said(R.effective_date(DUCK, "x"), text) == date


@pytest.mark.parametrize(
    "text, urgency, duration",
    [
        ("report within six hours", "immediate", "6 hours"),
        ("report within  12\nweeks", "medium_term", "12 weeks"),
        ("report within 400 days", "long_term", "400 days"),
        ("for a period not exceeding two months", "medium_term", "two months"),
        ("report quarterly", "ongoing", "quarterly"),
        ("where it applies", "triggered", None),
        ("report", "ongoing", None),
    ],
)
def test_deadline(text, urgency, duration):
    flat = R.deadline_text(DUCK, "x")
    rule = R.deadline_rule(DUCK, flat)
    assert said(R.deadline_urgency(DUCK, f"({rule})", flat, "NULL::VARCHAR"), text) == urgency
    assert said(R.deadline_duration(DUCK, f"({rule})", flat), text) == duration


def test_clause_type_and_overrides():
    assert said(R.clause_type(DUCK, "low"), "The rule reads as under and banks shall comply") == "quoted_reference"
    assert said(R.final_clause_type(DUCK, "'obligation'", "x"), "These directions shall come into force today") == "effective_date"
    assert said(R.final_clause_type(DUCK, "'obligation'", "x"), "These directions shall be called so") == "other"
    assert said(R.final_clause_type(DUCK, "'prohibition'", "x"), "must not") == "obligation"
    assert said(R.is_quoted_block(DUCK, "x"), "(i) “Premium is booked.”") and not said(R.is_quoted_block(DUCK, "x"), "Premium “is” booked.")


def test_annotate_any_clauses(spark):
    rows = [(1, 1, "RBI", "Banks shall report fraud to the Reserve Bank within 15 days."), (1, 2, None, ""), (2, 1, "RBI", None), (2, 2, "RBI", "It provides as under: banks may lend.")]
    df = spark.createDataFrame(rows, "doc_id bigint, section_id bigint, source string, clause_text string")
    got = {(r.doc_id, r.section_id): r for r in annotate(df).collect()}
    one = got[1, 1]
    assert (one.actor, one.urgency, one.duration, one.domain, one.severity, one.kind) == ("Regulated Entity", "short_term", "15 days", "FraudManagement", "high", "mandatory")
    assert len(got) == 4 and got[2, 1].trigger_id is None
    assert [(r.doc_id, r.section_id) for r in obligations(df).collect()] == [(1, 1)]
