"""Structure of whole circulars, as SQL in either dialect: header fields, sections by every kind of marker, quotations at any depth, annexures.

Every plan takes SQL for a relation of (doc_id, source, full_text); lines are numbered once and all else is windows over them within a document.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import rule_data as data
from ..functions import rules as R
from ..functions.dialect import Dialect
from . import corpus

_MONTHS = "|".join(m.title() for m in R.MONTHS)
_NUMBER = r"^(\d+(?:\.\d+)*[A-Z]?)\.\s*(.*)$"
_ROMAN = r"(?i)^\(([ivxlcdm]+)\)\s*(.*)$"
_SECTION = r"(?i)^(Section\s+\d+[A-Z]?)[:.\s-]*(.*)$"
_ANNEX = r"(?i)^((?:Annex(?:ure)?|Appendix|Schedule)\s+[A-Z0-9IVX-]+)[:.\s-]*(.*)$"
_NOISE = r"^(?:\d+|[_. -]{5,})$"
_TITLED = "master direction, master circular, direction, amendment directions, guidelines, framework, policy, scheme, circular, regulations, instruction, implementation"
_OFFICES = r"(?i)(?:manager|director|officer|secretary|chief)"


def sources(D: Dialect, base: str | None) -> str:
    return base or corpus.circulars(D)


def text_lines(D: Dialect, base: str | None = None) -> str:
    """doc_id, pos (from 0), line."""
    return D.explode_lines(f"({sources(D, base)})", "doc_id", "full_text")


def _starts(D: Dialect, x: str, words: str) -> str:
    return "(" + " OR ".join(f"left({x}, {len(w.strip())}) = {D.text(w.strip())}" for w in words.split(",")) + ")"


def titles(D: Dialect, base: str | None = None) -> str:
    """of the first 40 lines that aren't empty, the longest that names a kind of document (with the next line, if that goes on), else the first of 20 to 220 characters among 20.

    Of equally long ones the first counts; without any, title is null.
    """
    bare = D.replace("line", r"^[ \t:-]+|[ \t:-]+$", "")
    rows = f"SELECT doc_id, bare, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, pos, line, {bare} AS bare FROM ({text_lines(D, base)})) WHERE trim({D.replace('line', r'\s', '')}) <> ''"
    follow = f"SELECT *, lower(bare) AS low, lead(bare) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM ({rows})"
    joins = f"after IS NOT NULL AND length(after) < 120 AND NOT {D.matches('after', r'^\d')} AND NOT {_starts(D, 'lower(after)', 'please refer, dated, madam, dear')}"
    skipped = f"{_starts(D, 'bare', 'RBI/, SEBI/, CERT-In/, NPCI/, IRDAI/, DPDP/, FIU-IND/, IBA/')} OR {_starts(D, 'low', 'date, dated, tel, fax, www., madam, dear sir, dear madam')}"
    named = f"k <= 40 AND NOT ({skipped}) AND {D.any_of('low', R.words(_TITLED))}"
    other = f"k <= 20 AND length(bare) BETWEEN 20 AND 220 AND {D.matches('bare', '[A-Za-z]')}"
    ranked = f"SELECT doc_id, k, CASE WHEN {named} THEN trim(CASE WHEN {joins} THEN concat(bare, ' ', after) ELSE bare END) ELSE bare END AS title, CASE WHEN {named} THEN 1 ELSE 2 END AS kind FROM ({follow}) WHERE ({named}) OR ({other})"
    return f"""
        SELECT doc_id, title FROM (
            SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY kind, CASE WHEN kind = 1 THEN -length(title) ELSE k END, k) AS place FROM ({ranked}))
        WHERE place = 1"""


def issuers(D: Dialect, base: str | None = None) -> str:
    """among the last 25 lines the first name in brackets, else the first line like a name, that a designation follows."""
    tail = f"SELECT doc_id, trim(line) AS who, pos FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last_pos FROM ({text_lines(D, base)})) WHERE pos > last_pos - 25 AND trim(line) <> ''"
    pairs = f"SELECT *, lead(who) OVER (PARTITION BY doc_id ORDER BY pos) AS office FROM ({tail})"
    bracket, name = D.matches("who", r"^\([^)]+\)$"), D.matches("who", r"^[A-Z][A-Za-z .'-]{3,}$")
    found = f"SELECT doc_id, CASE WHEN {bracket} THEN 1 ELSE 2 END AS kind, pos, concat({D.replace('who', r'^[()]+|[()]+$', '')}, ' - ', office) AS issued_by FROM ({pairs}) WHERE ({bracket} OR {name}) AND {D.matches('coalesce(office, {0})'.format(D.text('')), _OFFICES)}"
    return f"SELECT doc_id, issued_by FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, pos) AS place FROM ({found})) WHERE place = 1"


def header_date(D: Dialect, x: str) -> str:
    """the first notation that occurs in the header decides; a date with an ordinal can't be read and falls to F18."""
    forms = (rf"(?i)(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", rf"(?i)\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS}),?\s+\d{{4}}", r"\d{2}[./-]\d{2}[./-]\d{4}")
    found = "coalesce(" + ", ".join(D.extract(x, f) for f in forms) + ")"
    return f"coalesce({R.iso_date(D, found)}, {R.first_date(D, x)})"


def document_key(D: Dialect, source: str, circular: str, title: str) -> str:
    """issuer and circular number, else the title as a slug of 80 characters without the issuer, else 12 digits of its MD5."""
    slug = f"lower({D.replace(D.replace(title, '[^A-Za-z0-9]+', '-'), '^-+|-+$', '')})"
    return f"CASE WHEN {circular} IS NOT NULL THEN replace(concat({source}, '-', {circular}), '/', '-') WHEN {slug} <> '' THEN substr({slug}, 1, 80) ELSE substr(md5({title}), 1, 12) END"


def headers(D: Dialect, base: str | None = None) -> str:
    """C1's fields of a document: key, title, who issued it, dates, numbers, kind, language."""
    top = f"SELECT doc_id, {D.concat_lines('line', 'pos')} AS head FROM ({text_lines(D, base)}) WHERE pos < 30 GROUP BY doc_id"
    joined = f"""
        SELECT d.doc_id, d.source, d.full_text, h.head, coalesce(t.title, concat('doc-', CAST(d.doc_id AS VARCHAR(20)))) AS title, coalesce(i.issued_by, '') AS issued_by
        FROM ({sources(D, base)}) d JOIN ({top}) h ON d.doc_id = h.doc_id LEFT JOIN ({titles(D, base)}) t ON d.doc_id = t.doc_id LEFT JOIN ({issuers(D, base)}) i ON d.doc_id = i.doc_id"""
    fields = f"""
        SELECT doc_id, source, title, issued_by, {header_date(D, "head")} AS issue_date, {R.effective_date(D, "full_text")} AS effective_date, {R.first_number(D, "full_text", "circular_number")} AS circular,
               {R.first_number(D, "full_text", "reference_number")} AS reference, {R.amends(D, "full_text")} AS amends, coalesce({R.document_type(D, "full_text")}, 'circular') AS document_type, {R.script_language(D, "full_text", False)} AS language
        FROM ({joined})"""
    return f"SELECT *, {document_key(D, 'source', 'circular', 'title')} AS document_key FROM ({fields})"


def marked_lines(D: Dialect, base: str | None = None) -> str:
    """Lines with the marker that each begins with: its number or name, level and rest. Years are no numbers, and a roman number counts only after another marker."""
    x = "trim(line)"
    noise = f"({x} = '' OR {D.matches(x, _NOISE)})"
    one = f"""
        SELECT doc_id, pos, line, CASE WHEN {noise} OR {D.matches(x, r"^\d{4}\.(?:\D|$)")} AND NOT {D.matches(x, r"^\d{4}\.\d")} THEN NULL ELSE {D.extract(x, _NUMBER, 1)} END AS num, CASE WHEN {noise} THEN NULL ELSE lower({D.extract(x, _ROMAN, 1)}) END AS roman,
               {D.extract(x, _SECTION, 1)} AS sec, {D.extract(x, _ANNEX, 1)} AS annex, trim(coalesce({D.extract(x, _NUMBER, 2)}, {D.extract(x, _ROMAN, 2)}, {D.extract(x, _SECTION, 2)}, {D.extract(x, _ANNEX, 2)})) AS body,
               sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead
        FROM ({text_lines(D, base)})"""
    two = f"SELECT *, sum(CASE WHEN num IS NOT NULL OR (roman IS NULL AND coalesce(sec, annex) IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS opened FROM ({one})"
    three = f"""
        SELECT *, CASE WHEN num IS NOT NULL THEN num WHEN roman IS NOT NULL THEN CASE WHEN opened > 0 THEN roman END WHEN sec IS NOT NULL THEN sec ELSE {D.replace('annex', r'\s+', ' ')} END AS marker,
               CASE WHEN num IS NOT NULL THEN length(num) - length(replace(num, '.', '')) + 1 WHEN roman IS NOT NULL THEN 3 WHEN coalesce(sec, annex) IS NOT NULL THEN 1 END AS level
        FROM ({two})"""
    return f"""
        SELECT *, CASE WHEN num IS NOT NULL AND level = 1 THEN body WHEN num IS NULL AND roman IS NULL AND sec IS NOT NULL THEN coalesce(body, sec) WHEN num IS NULL AND roman IS NULL AND annex IS NOT NULL THEN trim(concat(marker, ' ', coalesce(body, ''))) END AS parent,
               CAST(sum(CASE WHEN marker IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS nth
        FROM ({three})"""


def sections(D: Dialect, base: str | None = None) -> str:
    """doc_id, section, section_no, level, heading, char_offset, section_text; a document without any marker is one section S1 under its title.

    A heading is the rest of the marker's line, else the last heading of level 1 before, else the marker. What stands before the first marker is in no section.
    """
    last = D.last_value("parent", "PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    opened = f"SELECT *, {last} AS above FROM ({marked_lines(D, base)})"
    own = "CASE WHEN marker IS NULL THEN NULL WHEN num IS NULL AND roman IS NULL THEN parent ELSE coalesce(body, above, marker) END"
    found = f"""
        SELECT doc_id, nth AS section, max(marker) AS section_no, max(CASE WHEN marker IS NOT NULL THEN level END) AS level, max({own}) AS heading, CAST(coalesce(min(ahead), 0) AS BIGINT) AS char_offset,
               {D.replace(D.concat_lines("line", "pos"), r"^\s+|\s+$", "")} AS section_text
        FROM ({opened}) WHERE nth > 0 GROUP BY doc_id, nth"""
    bare = f"SELECT doc_id FROM ({marked_lines(D, base)}) GROUP BY doc_id HAVING max(nth) = 0"
    whole = f"""
        SELECT d.doc_id, CAST(1 AS BIGINT) AS section, 'S1' AS section_no, 1 AS level, coalesce(t.title, 'Unknown Document') AS heading, CAST(0 AS BIGINT) AS char_offset, {D.replace("d.full_text", r"^\s+|\s+$", "")} AS section_text
        FROM ({sources(D, base)}) d JOIN ({bare}) b ON d.doc_id = b.doc_id LEFT JOIN ({titles(D, base)}) t ON d.doc_id = t.doc_id WHERE trim({D.replace("d.full_text", r"\s+", "")}) <> ''"""
    return f"SELECT * FROM ({found}) UNION ALL SELECT * FROM ({whole})"


def typed(D: Dialect, base: str | None = None) -> str:
    """Sections with their class by the rules and whether they lead in a quotation."""
    low = "lower(section_text)"
    return f"SELECT *, {R.final_clause_type(D, R.clause_type(D, low), 'section_text')} AS own_type, {D.any_of(low, R.words(data.LEAD_INS))} AS leads FROM ({sections(D, base)})"


def quotations(D: Dialect, base: str | None = None) -> str:
    """W2 at any depth: a section that leads in a quotation is quoted unless it obliges or punishes; all deeper ones after it are, up to the first that isn't deeper, and aren't asked themselves."""
    if D.name == "spark":
        # one pass over the sections of a document: the level of the quotation that is open, or none, and the answers so far
        items = "array_sort(collect_list(named_struct('section', section, 'level', level, 'leads', leads, 'own_type', own_type)))"
        start = "named_struct('open', CAST(NULL AS INT), 'inside', CAST(array() AS ARRAY<BOOLEAN>))"
        step = "(s, x) -> CASE WHEN x.level > s.open THEN named_struct('open', s.open, 'inside', array_append(s.inside, true)) ELSE named_struct('open', CASE WHEN x.leads THEN x.level END, 'inside', array_append(s.inside, false)) END"
        walked = f"SELECT doc_id, inline(arrays_zip(items, aggregate(items, {start}, {step}).inside)) AS (x, inside) FROM (SELECT doc_id, {items} AS items FROM ({typed(D, base)}) GROUP BY doc_id)"
        rows = f"SELECT doc_id, x.section, x.level, x.own_type, inside, x.leads FROM ({walked})"
    else:
        rows = f"""
            WITH RECURSIVE t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS place FROM ({typed(D, base)})),
                 w AS (SELECT doc_id, section, level, own_type, leads, place, FALSE AS inside, CASE WHEN leads THEN level END AS open FROM t WHERE place = 1
                       UNION ALL
                       SELECT t.doc_id, t.section, t.level, t.own_type, t.leads, t.place, coalesce(t.level > w.open, FALSE), CASE WHEN t.level > w.open THEN w.open WHEN t.leads THEN t.level END FROM t JOIN w ON t.doc_id = w.doc_id AND t.place = w.place + 1)
            SELECT doc_id, section, level, own_type, inside, leads FROM w"""
    return f"SELECT doc_id, section, level, own_type, CASE WHEN inside OR (leads AND own_type NOT IN ('obligation', 'penalty')) THEN 'quoted_reference' ELSE own_type END AS clause_type FROM ({rows})"


def annexures(D: Dialect, base: str | None = None) -> str:
    """Sections whose heading names an annex, schedule or appendix."""
    return f"SELECT doc_id, section, heading, section_text FROM ({sections(D, base)}) WHERE {D.any_of('lower(heading)', ('annex', 'schedule', 'appendix'))}"


_SKIPPED = ("yours faithfully", "chief general manager", "general manager", "deputy governor", "www.rbi.org.in", "telephone", "tel no", "reserve bank of india")


def skip(D: Dialect, heading: str, text: str) -> str:
    """whether the sentence profile leaves a section out: letter heads, noise of under 50 characters, and under 100 without a word that obliges."""
    odd = D.matches(text, r"(?i)^\s*www\.|^\s*टेलीफोन|^\s*फैक्स|हिंदी|बेटी बचाओ|^\s*\d+\s*$")
    duty = D.any_of(f"lower({text})", ("shall", "must", "required", "prohibited", "mandated", "obligated", "may", "should"))
    return f"({D.one_of(f'lower(trim({heading}))', _SKIPPED)} OR (length(trim({text})) < 50 AND {odd}) OR (NOT {duty} AND length({text}) < 100))"


def skipped_sections(D: Dialect, base: str | None = None) -> str:
    return f"SELECT doc_id, section, length(section_text) AS chars, {skip(D, 'heading', 'section_text')} AS skipped FROM ({sections(D, base)})"


def clause_lines(D: Dialect, base: str | None = None) -> str:
    """Lines of 15 characters or more that begin with a number, or a roman one in brackets, and a full stop, blanks as one: what validation looks for obligations in."""
    flat = f"trim({D.replace('line', r'\s+', ' ')})"
    form = r"(?i)^([a-z]?\d+(?:\.\d+)*[a-z]?|\([ivxlcdm]+\))\.\s*(.+)$"
    return f"SELECT doc_id, pos, {D.extract('flat', form, 1)} AS clause_number, flat AS clause FROM (SELECT doc_id, pos, {flat} AS flat FROM ({text_lines(D, base)})) WHERE length(flat) >= 15 AND {D.matches('flat', form)}"


def analysis(D: Dialect, base: str | None = None) -> str:
    """what a document is about without a language model: actor, domains, quoted and enumerated text, effective date phrase, first five duties."""
    low = "lower(full_text)"
    actor = D.case([(f"contains({low}, 'frbs/reinsurers')", "'FRBs/Reinsurers'"), (f"contains({low}, 'reinsurer')", "'Reinsurer'"), (f"contains({low}, 'insurer')", "'Insurer'"), ("source = 'RBI'", "'Bank'")], "'Regulated Entity'")
    table = {
        "ReportingAudit": ("report", "statement", "disclosure", "annual report", "accounts", "format"),
        "Governance": ("board", "approval", "policy", "framework"),
        "FinancialInclusion": ("financial inclusion",),
        "CapitalAdequacy": ("capital", "crar", "cet1", "buffer"),
        "FEMA": ("foreign exchange", "forex", "fema", "remittance"),
    }
    named = D.ordered_set(D.chain(*(f"CASE WHEN {D.any_of(low, w)} THEN {D.strings([n])} ELSE {D.strings([])} END" for n, w in table.items())))
    quoted = D.any_of(low, ("provides as under", "reads as follows", "is reproduced below", "quoted below"))
    listed = D.matches("full_text", r"(?i)(^|\n)\s*(?:\([a-z]\)|\([ivxlcdm]+\)|\d+\.)\s+")
    when = f"coalesce({D.extract(low, r'financial year\s+\d{4}-\d{2}')}, {D.extract(low, r'with effect from\s+[^.;]+')}, '')"
    duty = D.map_strings(D.extract_all(low, r"[^.]+shall[^.]+"), "duty_", f"trim({D.replace('duty_', r'\s+', ' ')})")
    phrases = D.first_strings(D.map_strings(D.keep_strings(duty, "d_", "length(d_) > 20"), "p_", "substr(p_, 1, 180)"), 5)
    return f"SELECT doc_id, {actor} AS primary_actor, CASE WHEN {named} = '' THEN 'Other' ELSE {named} END AS domains, {quoted} AS quotes, {listed} AS enumerates, {when} AS effective_text, {phrases} AS core_phrases FROM ({sources(D, base)})"


def issuers_named(D: Dialect, base: str | None = None) -> str:
    """the issuer by file name, by the first 4000 characters, by the whole text and by what analysis says, each in its own order."""
    low, name = "lower(full_text)", f"lower(concat(CASE WHEN doc_id % 2 = 0 THEN source ELSE 'scan' END, '-', CAST(doc_id AS VARCHAR(20)), '.pdf'))"
    said = f"concat(CASE WHEN contains({low}, 'insurer') THEN 'insurer' ELSE '' END, ' ', CASE WHEN source = 'RBI' THEN 'bank' ELSE 'regulated entity' END, ' ', substr({low}, 1, 4000))"
    return f"SELECT doc_id, {R.source_from(D, name, 'name')} AS by_name, {R.source_of(D, 'full_text')} AS by_text, {R.source_from(D, low, 'whole')} AS by_whole, {R.source_from(D, said, 'analysis')} AS by_analysis FROM ({sources(D, base)})"


PLANS: dict[str, Callable[[Dialect], str]] = {
    "document_structure": headers,
    "document_sections": sections,
    "quoted_islands": quotations,
    "annexures": annexures,
    "section_filter": skipped_sections,
    "clause_lines": clause_lines,
    "document_analysis": analysis,
    "source_detection": issuers_named,
}
