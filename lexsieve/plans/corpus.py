"""Clauses made of orders and customers, the same in Spark and DuckDB: the driver's documents hold no legal text.

Every part of a clause is picked by the order key modulo a number prime to the others, so that the parts vary independently.
"""

from __future__ import annotations

from ..functions.dialect import Dialect

ACTORS = ["The bank", "All regulated entities", "Every NBFC", "The insurer", "A payment system operator", "The board of directors", "Scheduled commercial banks", "The Reserve Bank", "The principal officer"]
MODALS = ["shall", "must", "may, at its discretion,", "shall not", "is required to", "should", "shall forthwith", "is, as a rule, free to"]
ACTIONS = [
    "submit a report on suspicious transactions to the Authority",
    "maintain records of customer due diligence and periodic updation of KYC",
    "put in place an information security policy approved by the board",
    "levy any service charges on basic savings accounts held by customers",
    "test the business continuity plan and the disaster recovery plan",
    "review capital adequacy, CRAR and risk weighted assets",
    "refund failed UPI and ATM payments to the affected customer",
]
DEADLINES = [" within {d} days", " within 6 hours", " within thirty days of the quarter", " quarterly", "", " on or before {date}", " not later than 2 months from the event", " with effect from {date}", " immediately", " by March 31, 2027", " within a period of 3 years"]
TAILS = ["", ", subject to prior approval", ", as per the Master Direction on Fraud, 2016", ", failing which a penalty of Rs. {a} shall be levied", ", in terms of section 21 of the Act", ", effective from the financial year 2024-25", " under the Companies Act, 2013", ", where the account is overdue", ". These directions shall come into force on 01.04.2026", ", in accordance with RBI/2024-25/{d}", ". The relevant rule reads as under: records are kept", " and fine of INR 5,000.50 applies", ", (a) in writing; (b) in the prescribed format"]
SUFFIXES = [".", " for all branches.", " through the portal, and the compliance function shall keep an acknowledgement for ten years.", ";", ". Accordingly, banks shall inform their staff."]
SOURCES = {"AUTOMOBILE": "RBI", "BUILDING": "IRDAI", "FURNITURE": "SEBI", "HOUSEHOLD": "NPCI", "MACHINERY": "CERT-In"}


def clauses(D: Dialect, orders: str = "orders", customer: str = "customer") -> str:
    """doc_id, section_id, source, days, ref_date, amount, clause_text: one row for each order of a known customer."""
    days, amount = "(1 + k % 400)", "CAST(floor(o_totalprice) AS BIGINT)"
    parts = [f"{D.pick(ACTORS, 'k % 9')}, ' ', {D.pick(MODALS, 'k % 8')}, ' ', {D.pick(ACTIONS, 'k % 7')}, {D.pick(DEADLINES, 'k % 11')}, {D.pick(TAILS, 'k % 13')}, {D.pick(SUFFIXES, 'k % 5')}"]
    text = f"replace(replace(replace(concat({parts[0]}), '{{d}}', CAST({days} AS VARCHAR(20))), '{{date}}', ref_date), '{{a}}', CAST({amount} AS VARCHAR(20)))"
    source = D.lookup("c_mktsegment", {k: D.text(v) for k, v in SOURCES.items()}, "'OTHER'")
    return f"""
        SELECT o_custkey AS doc_id, k AS section_id, {source} AS source, {days} AS days, ref_date, {amount} AS amount, {text} AS clause_text
        FROM (SELECT {D.spread("o_custkey, k")}o.*, o_orderkey AS k, {D.date_text("o_orderdate")} AS ref_date, c_mktsegment FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey)"""


def clause_documents(D: Dialect, base: str) -> str:
    """doc_id, source, full_text: the clauses of a customer as numbered lines; every fourth is a roman sub-clause."""
    nth = "row_number() OVER (PARTITION BY doc_id ORDER BY section_id)"
    label = f"CASE WHEN nth > 1 AND nth % 4 = 0 THEN '(iv) ' ELSE concat(CAST(nth AS VARCHAR(20)), '. ') END"
    return f"""
        SELECT doc_id, max(source) AS source, {D.concat_lines("item", "section_id")} AS full_text
        FROM (SELECT doc_id, source, section_id, concat({label}, clause_text) AS item FROM (SELECT *, {nth} AS nth FROM ({base})))
        GROUP BY doc_id"""


HEADS = ["Master Direction on Digital Payment Security Controls", "Guidelines for Outsourcing\nof Information Technology Services", "Amendment Directions, 2025", "Annual statement of accounts of insurers", "Note"]
DATES = ["March 5, 2024", "01.04.2025", "12th June 2023", "Date: 7 May 2022", "undated"]
TAILPIECES = ["Yours faithfully,\n\n(A. N. Other)\nChief General Manager", "Jane Doe\nExecutive Director", "17", "(Signed)\nfor the office"]


def circulars(D: Dialect, base: str | None = None) -> str:
    """doc_id, source, full_text: whole circulars with number, date, title, sections of every kind of marker, annexes and signatures; every eleventh has no marker at all."""
    nth = "row_number() OVER (PARTITION BY doc_id ORDER BY section_id)"
    n = "CAST(nth AS VARCHAR(20))"
    label = f"CASE WHEN doc_id % 11 = 0 THEN '' WHEN nth % 9 = 2 THEN concat({n}, '.1. ') WHEN nth % 9 = 3 THEN concat({n}, '.1.2. ') WHEN nth % 9 IN (4, 5) THEN '(iv) ' WHEN nth % 9 = 6 THEN concat('Section ', {n}, ': ') WHEN nth % 9 = 7 THEN concat('Annex ', {n}, ' - ') WHEN nth % 9 = 8 THEN concat({n}, '.', chr(10)) ELSE concat({n}, '. ') END"
    number = "CASE WHEN doc_id % 3 = 0 THEN concat('RBI/2024-25/', CAST(doc_id AS VARCHAR(20)), chr(10)) ELSE '' END"
    head = lambda values, k: D.pick(values, f"doc_id % {k}")
    lines = lambda v: [x.replace("\n", "{n}") for x in v]
    text = f"replace(concat({number}, {head(lines(DATES), 5)}, chr(10), {D.pick(lines(HEADS), 'doc_id % 7 % 5')}, chr(10), chr(10), 'Madam / Dear Sir,', chr(10), body, chr(10), {head(lines(TAILPIECES), 4)}), '{{n}}', chr(10))"
    return f"""
        SELECT doc_id, source, {text} AS full_text FROM (
            SELECT doc_id, max(source) AS source, {D.concat_lines("item", "section_id")} AS body
            FROM (SELECT doc_id, source, section_id, concat({label}, clause_text) AS item FROM (SELECT *, {nth} AS nth FROM ({base or clauses(D)})))
            GROUP BY doc_id)"""
