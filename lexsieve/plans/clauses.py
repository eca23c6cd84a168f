"""The relational plans over clauses, as SQL in either dialect. Each returns scalar columns only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from ..functions import rule_data as data
from ..functions import rules as R
from ..functions.dialect import Dialect
from . import corpus

KEYS = "doc_id, section_id"


def lowered(D: Dialect, base: str | None = None) -> str:
    text = f"SELECT *, lower({R.one_line(D, 'clause_text')}) AS low, {R.deadline_text(D, 'clause_text')} AS flat FROM ({base or corpus.clauses(D)})"
    return f"SELECT *, {D.look_up('low')} AS seen FROM ({text})" if D.sees else text


def _with(D: Dialect, columns: str) -> list[str]:
    """Columns of clauses, with what has been looked up in them."""
    return [*columns.split(), *(["seen"] if D.sees else [])]


def _read(D: Dialect) -> str:
    """The clauses of the corpus, looked up where the dialect wants it."""
    return D.barrier(lowered(D), _with(D, "doc_id section_id source ref_date clause_text low flat")) if D.sees else corpus.clauses(D)


def matched(D: Dialect, base: str | None = None) -> str:
    """One row a clause with what each rule table finds by itself."""
    scores = R.domain_scores(D, "low")
    return f"""
        SELECT *, {R.trigger_id(D, "low")} AS trigger_id, {R.actor(D, "low", "source")} AS raw_actor, {R.deadline_rule(D, "flat")} AS rule,
               {R.sub_type(D, "low")} AS own_sub_type, {R.clause_type(D, "low")} AS raw_clause, {", ".join(f"{s} AS p{i}" for i, (_, s) in enumerate(scores))}
        FROM ({D.barrier(lowered(D, base), _with(D, "doc_id section_id source clause_text low flat"))})"""


#: What resolved() works out, and what of it each needs besides the clause.
_NEEDS = {"deadline": ["when_text"], "confidence": ["found", "penalty", "fine"], "condition": ["found"]}


def resolved(D: Dialect, base: str | None = None, need: str | None = None) -> str:
    """matched() with everything that depends on other findings. need: the columns wanted; without it all."""
    wanted = set(need.split()) if need else None
    for name in list(wanted or ()):
        wanted.update(_NEEDS.get(name, ()))
    drop = lambda name, text: text if wanted is None or name in wanted else ""
    points = [f"p{i}" for i in range(len(R.domain_names()))]
    kept = ", ".join(_with(D, "doc_id section_id source clause_text low flat trigger_id rule own_sub_type"))
    one = f"""
        SELECT {kept}, {R.corrected_actor(D, "raw_actor", "low")} AS actor, greatest({", ".join(points)}) AS points, {R.best_domain(D, points, f"greatest({', '.join(points)})")} AS own_domain,
               {R.trigger_field(D, "trigger_id", "kind")} AS kind, {R.trigger_field(D, "trigger_id", "urgency")} AS override, {R.trigger_field(D, "trigger_id", "weight")} AS weight,
               {drop("found", R.trigger_text(D, "trigger_id", "low") + " AS found, ")}{R.final_clause_type(D, "raw_clause", "clause_text")} AS clause_type
        FROM ({D.barrier(matched(D, base), _with(D, f"doc_id section_id source clause_text low flat trigger_id rule own_sub_type raw_actor raw_clause {' '.join(points)}"))})"""
    two = f"""
        SELECT *, {R.sector_id(D, "low", "actor")} AS sector, {R.obligation_type(D, "kind", "low")} AS obligation_type{drop("when_text", ", " + R.deadline_found(D, "rule", "flat") + " AS when_text")}
        FROM ({one})"""
    extra = [
        ("deadline", f"coalesce({R.sector_field(D, 'sector', 'deadline')}, {R.deadline_label(D, 'rule', 'when_text', 'flat', 'override')})"),
        ("duration", f"coalesce({R.sector_field(D, 'sector', 'duration')}, {R.deadline_duration(D, 'rule', 'flat')})"),
        ("deadline_date", R.deadline_date(D, "rule", "flat")),
        ("penalty", R.penalty(D, "clause_text")),
        ("fine", R.fine(D, "clause_text")),
        ("n_references", D.size(R.cross_references(D, "clause_text"))),
    ]
    held = f"{kept.replace(',', '')} actor points own_domain kind override weight clause_type sector obligation_type {drop('found', 'found')} {drop('when_text', 'when_text')}".split()
    three = f"""
        SELECT *, coalesce({R.sector_field(D, "sector", "domain")}, own_domain) AS domain, coalesce({R.sector_field(D, "sector", "sub_type")}, own_sub_type) AS sub_type,
               coalesce({R.sector_field(D, "sector", "urgency")}, {R.deadline_urgency(D, "rule", "flat", "override")}) AS urgency, {R.has_references(D, "clause_text")} AS refers{"".join(f", {x} AS {n}" for n, x in extra if drop(n, n))}
        FROM ({D.barrier(two, held)})"""
    four = f"SELECT *, {R.severity(D, 'low', 'urgency', 'obligation_type', 'sub_type', 'domain')} AS own_severity, {R.sector_field(D, 'sector', 'severity')} AS least FROM ({three})"
    conf = drop("confidence", ", " + R.confidence(D, "clause_text", "found", "urgency", "refers", "actor", "points", "penalty IS NOT NULL", "coalesce(fine, 0) > 0", "clause_type") + " AS confidence")
    return f"""
        SELECT *, CASE WHEN {R.severity_rank(D, "least")} > {R.severity_rank(D, "own_severity")} THEN least ELSE own_severity END AS severity{conf}
        FROM ({four})"""


def _picked(columns: str, need: str) -> Callable[[Dialect], str]:
    return lambda D: f"SELECT {KEYS}, {columns} FROM ({resolved(D, need=need)})"


def _found(D: Dialect) -> str:
    """Trigger and deadline rule of each clause, and nothing else."""
    text = D.barrier(lowered(D), _with(D, "doc_id section_id low flat"))
    return D.barrier(f"SELECT *, {R.trigger_id(D, 'low')} AS trigger_id, {R.deadline_rule(D, 'flat')} AS rule FROM ({text})", _with(D, "doc_id section_id low flat trigger_id rule"))


def trigger_match(D: Dialect) -> str:
    fields = ", ".join(f"{R.trigger_field(D, 'trigger_id', f)} AS {n}" for f, n in (("kind", "kind"), ("weight", "weight"), ("urgency", "override")))
    return f"SELECT {KEYS}, trigger_id, {fields}, {R.trigger_text(D, 'trigger_id', 'low')} AS found, {R.is_negation(D, 'low')} AS negated FROM ({_found(D)})"


def actor_match(D: Dialect) -> str:
    """With and without the issuer's scope, before and after the correction of issuers."""
    return f"SELECT {KEYS}, raw_actor AS scoped, {R.corrected_actor(D, 'raw_actor', 'low')} AS corrected, {R.actor(D, 'low', D.text(None))} AS unscoped FROM ({matched(D)})"


def sub_types(D: Dialect) -> str:
    return f"SELECT {KEYS}, own_sub_type AS sub_type, {R.severity_floor(D, 'own_sub_type')} AS severity_floor, {D.ordered_set(R._lists(D, 'own_sub_type', R.listed(data.SUB_TYPE_DEPARTMENTS), []))} AS departments FROM ({matched(D)})"


def deadline_extract(D: Dialect) -> str:
    one = f"SELECT *, {R.trigger_field(D, 'trigger_id', 'urgency')} AS override, {R.deadline_found(D, 'rule', 'flat')} AS when_text FROM ({_found(D)})"
    return f"""
        SELECT {KEYS}, rule, {R.deadline_label(D, "rule", "when_text", "flat", "override")} AS deadline, {R.deadline_duration(D, "rule", "flat")} AS duration,
               {R.deadline_date(D, "rule", "flat")} AS absolute_date, {R.deadline_urgency(D, "rule", "flat", "override")} AS urgency, {R.deadline_frequency(D, "rule")} AS frequency
        FROM ({one})"""


def dates(D: Dialect) -> str:
    """F16-F18 over dates in several notations, F26 over clauses."""
    x = f"CASE section_id % 4 WHEN 0 THEN ref_date WHEN 1 THEN replace(ref_date, '.', '/') WHEN 2 THEN concat({D.pick([m.title() for m in R.MONTHS], 'section_id % 12')}, ' ', CAST(1 + section_id % 28 AS VARCHAR(20)), ', 2025') ELSE concat('31 ', {D.pick([m.title() for m in R.MONTHS], 'section_id % 12')}, ' 2026 ') END"
    y = "CASE section_id % 3 WHEN 0 THEN 'FY 2022-23' WHEN 1 THEN '2023-2024' ELSE ' 2021-22 ' END"
    return f"SELECT {KEYS}, {R.iso_date(D, x)} AS iso, {R.fiscal_year(D, y)} AS fiscal, {R.first_date(D, 'clause_text')} AS first_date, {R.effective_date(D, 'clause_text')} AS effective_date FROM ({_read(D)})"


def department_list(D: Dialect) -> str:
    return f"SELECT {KEYS}, {D.ordered_set(R.departments(D, 'domain', 'sub_type', 'actor', 'low'))} AS departments FROM ({resolved(D, need='domain')})"


def sector_match(D: Dialect) -> str:
    return f"SELECT {KEYS}, sector, {', '.join(f'{R.sector_field(D, 'sector', f)} AS {f}' for f in ('name', 'domain', 'sub_type', 'deadline', 'duration', 'urgency', 'severity'))} FROM ({resolved(D, need='domain')})"


def severity_levels(D: Dialect) -> str:
    return f"SELECT {KEYS}, own_severity, severity, {R.severity_rank(D, 'severity')} AS severity_rank, {R.severity_reason(D, 'severity', 'urgency', 'sub_type')} AS reason FROM ({resolved(D, need='severity')})"


def clause_types(D: Dialect) -> str:
    return f"SELECT {KEYS}, raw_clause, {R.final_clause_type(D, 'raw_clause', 'clause_text')} AS clause_type, {R.fallback_clause_type(D, 'clause_text')} AS fallback FROM ({matched(D)})"


def predicates(D: Dialect) -> str:
    """F11, F12, F39, F50, F53 and the word count F15; every other clause is asked in quotes whether it is a quoted block."""
    marks = D.matches("clause_text", r"(?i)(?:^|\s)(?:\(?[a-z]\)|\(?[ivxlcdm]+\))\s+")
    duty = D.matches("low", r"\b(?:shall|must|may)\b|within\s+\d+\s+days")
    return f"""
        SELECT {KEYS}, {R.is_boilerplate(D, "clause_text")} AS boilerplate, {R.is_quoted(D, "clause_text", "clause_type")} AS quoted, {R.is_quoted_block(D, "CASE WHEN section_id % 2 = 0 THEN concat('“', clause_text, '”') ELSE clause_text END")} AS block,
               {marks} AS enumerated, {duty} AS duty, {D.size(D.words("clause_text"))} AS words
        FROM ({resolved(D, need="clause_type")})"""


def reference_list(D: Dialect) -> str:
    return f"SELECT {KEYS}, {D.ordered_set(R.cross_references(D, 'clause_text'), 8)} AS refs, {R.amends(D, 'clause_text')} AS amended, {R.first_number(D, 'clause_text', 'circular_number')} AS circular, {R.first_number(D, 'clause_text', 'reference_number')} AS reference, {R.document_type(D, 'clause_text')} AS document_type FROM ({_read(D)})"


def penalties(D: Dialect) -> str:
    return f"SELECT {KEYS}, penalty, fine, {R.condition_text(D, 'clause_text', 'kind', 'found')} AS condition, {D.ordered_set(R.evidence(D, 'low', 'domain'))} AS evidence FROM ({resolved(D, need='penalty fine condition')})"


LIVE_TRIGGERS = ["shall", "must", "required", "prohibited", "mandated", "obligated", "may", "should"]


def live_profile(D: Dialect) -> str:
    """The sentence profile's trigger, domain, actor, action, deadline and severity."""
    low = "lower(clause_text)"
    trigger = D.case(((f"contains({low}, {D.text(t)})", D.text(t)) for t in LIVE_TRIGGERS), "'always'")
    domain = D.case(
        [
            (D.any_of(low, ("capital adequacy", "free reserves", "owned fund", "quarterly profits", "statutory auditors")), "'CapitalAdequacy'"),
            (D.any_of(low, ("calamity", "financial inclusion", "satellite office")), "'FinancialInclusion'"),
            (D.any_of(low, ("customer compensation", "grievance", "ombudsman")), "'CustomerService'"),
        ],
        "'Other'",
    )
    who = D.case(
        [
            (D.matches("clause_text", r"(?i)\bcommercial\s+banks?\b"), "'Commercial Banks'"),
            (D.matches("clause_text", r"(?i)\bdealer\s+(?:category\s+i+\s+)?banks?\b"), "'Authorised Dealer Banks'"),
            (D.matches("clause_text", r"(?i)\bNBFCs?\b"), "'NBFCs'"),
        ],
        "'Regulated Entity'",
    )
    when = f"coalesce({D.extract('clause_text', r'(?i)within \d+ days|with immediate effect|at the earliest')}, 'ongoing')"
    rest = "trim(substr(clause_text, strpos(lower(clause_text), trigger_word) + length(trigger_word)))" if D.name == "duckdb" else "trim(substr(clause_text, instr(lower(clause_text), trigger_word) + length(trigger_word)))"
    level = f"CASE WHEN {D.any_of(low, ('at the earliest', 'prohibited'))} THEN 'critical' WHEN contains({low}, 'shall') THEN 'high' ELSE 'medium' END"
    return f"""
        SELECT {KEYS}, trigger_word, {domain} AS domain, {who} AS actor, {when} AS deadline, {level} AS severity,
               CASE WHEN trigger_word = 'always' THEN clause_text ELSE concat(upper(substr({rest}, 1, 1)), lower(substr({rest}, 2))) END AS action,
               CASE WHEN trigger_word = 'may' THEN 'discretionary' ELSE 'mandatory' END AS obligation_type
        FROM (SELECT *, {trigger} AS trigger_word FROM ({corpus.clauses(D)}))"""


def votes(D: Dialect) -> str:
    """(unit, seq, field, value, engine, confidence), several votes a clause for type, domain, actor and severity."""
    reporting, approval, ban = (D.any_of("low", R.words(w)) for w in (data.REPORTING_TERMS, data.APPROVAL_TERMS, data.PROHIBITION_TERMS))
    rows = [
        (1, "obligation_type", "obligation_type", "RuleEngine", "CASE WHEN trigger_id IS NULL THEN 0.55 ELSE 0.90 END", "TRUE"),
        (2, "obligation_type", "'mandatory'", "KeywordEngine", f"CASE WHEN {ban} THEN 0.82 WHEN {approval} THEN 0.78 ELSE 0.74 END", f"{ban} OR {approval} OR {reporting}"),
        (3, "obligation_type", "'discretionary'", "KeywordEngine", "0.80", f"NOT ({ban} OR {approval} OR {reporting}) AND {D.matches('low', r'\bmay\b|at its discretion')}"),
        (4, "actor", "actor", "RuleEngine", f"CASE WHEN {D.one_of('actor', ('Regulated Entity', 'Bank'))} THEN 0.62 ELSE 0.90 END", "TRUE"),
        (5, "domain", "domain", "KeywordEngine", "least(0.90, 0.50 + 0.10 * points)", "TRUE"),
        (6, "domain", "'ReportingAudit'", "PatternEngine", "0.72", reporting),
        (7, "domain", "'Governance'", "PatternEngine", "0.68", f"{approval} OR contains(low, 'board')"),
        (8, "severity", "severity", "RuleEngine", "0.82", "TRUE"),
        (9, "deadline", "deadline", "PatternEngine", "CASE WHEN duration IS NOT NULL OR deadline_date IS NOT NULL THEN 0.90 ELSE 0.78 END", "urgency <> 'ongoing'"),
        (10, "penalty", "penalty", "PatternEngine", "0.88", "penalty IS NOT NULL"),
        (11, "fine", "CAST(fine AS VARCHAR(40))", "PatternEngine", "0.90", "coalesce(fine, 0) > 0"),
    ]
    base = resolved(D)
    if D.name == "spark":  # one pass over the clauses
        parts = ", ".join(f"CASE WHEN {c} THEN named_struct('seq', {n}, 'field', '{f}', 'value', {v}, 'engine', '{e}', 'confidence', CAST({w} AS DOUBLE)) END" for n, f, v, e, w, c in rows)
        return f"SELECT {KEYS}, v.* FROM (SELECT {KEYS}, explode(filter(array({parts}), v -> v IS NOT NULL)) AS v FROM ({base}))"
    return "WITH r AS MATERIALIZED (" + base + ") " + " UNION ALL ".join(f"SELECT {KEYS}, {n} AS seq, '{f}' AS field, {v} AS value, '{e}' AS engine, CAST({w} AS DOUBLE) AS confidence FROM r WHERE {c}" for n, f, v, e, w, c in rows)


def vote_results(D: Dialect, source: str) -> str:
    """A2, A3: the winner of each field by weighted votes (of equals the first cast), its lead over the next and whether they conflict."""
    common, money = {"RuleEngine": 0.35, "PatternEngine": 0.25, "SimilarityEngine": 0.20, "KeywordEngine": 0.10, "LLM": 0.10}, {"RuleEngine": 0.50, "PatternEngine": 0.30, "SimilarityEngine": 0.15, "KeywordEngine": 0.0, "LLM": 0.05}
    weigh = lambda t: D.lookup("engine", {k: f"CAST({v} AS DOUBLE)" for k, v in t.items()}, "CAST(0.10 AS DOUBLE)")
    return f"""
        SELECT {KEYS}, field, value AS winner, round(least(0.99, score), 4) AS score, round(score - coalesce(second, 0), 4) AS margin,
               n_values > 1 AND score - coalesce(second, 0) < 0.15 - 1e-9 AS conflict, n_values > 1 AS contradicted
        FROM (
            SELECT *, row_number() OVER (PARTITION BY {KEYS}, field ORDER BY score DESC, first) AS nth, lead(score) OVER (PARTITION BY {KEYS}, field ORDER BY score DESC, first) AS second,
                   count(*) OVER (PARTITION BY {KEYS}, field) AS n_values
            FROM (
                SELECT {KEYS}, field, value, round(sum(confidence * CASE WHEN field IN ('penalty', 'fine') THEN {weigh(money)} ELSE {weigh(common)} END), 9) AS score, min(seq) AS first
                FROM ({source}) GROUP BY {KEYS}, field, value))
        WHERE nth = 1"""


def field_vote(D: Dialect) -> str:
    return vote_results(D, votes(D))


#: All that an obligation has.
WHOLE = "source clause_text low trigger_id weight kind found actor clause_type obligation_type domain sub_type deadline duration deadline_date urgency n_references refers severity confidence penalty fine points"


def flagged(D: Dialect, need: str = WHOLE, base: str | None = None) -> str:
    """Every clause with `kept`: whether it is an obligation, being neither quoted, boilerplate nor without any signal, and of a suitable clause type."""
    test = f"""NOT {D.one_of("clause_type", ("definition", "cross_reference", "effective_date", "quoted_reference"))} AND NOT {R.is_quoted(D, "clause_text", "clause_type")} AND NOT {R.is_boilerplate(D, "clause_text")}
          AND length(trim(clause_text)) >= 20 AND (trigger_id IS NOT NULL OR urgency <> 'ongoing' OR refers)
          AND ({D.one_of("clause_type", ("obligation", "penalty", "permission"))} OR coalesce(weight, 0) >= 0.9)"""
    columns = ["doc_id", "section_id", *_with(D, need)]
    return f"SELECT {', '.join(columns)}, kept FROM ({D.barrier(f'SELECT *, coalesce({test}, FALSE) AS kept FROM ({resolved(D, base, need)})', [*columns, 'kept'])})"


def kept(D: Dialect, base: str | None = None, need: str = WHOLE) -> str:
    """The clauses that are obligations."""
    return f"SELECT * FROM ({flagged(D, need, base)}) WHERE kept"


def by_domain(D: Dialect) -> str:
    return f"SELECT source, domain, severity, count(*) AS n FROM ({kept(D, need='source domain severity')}) GROUP BY GROUPING SETS ((source, domain), (source, severity), (source))"


def obligations_per_source(D: Dialect) -> str:
    return f"SELECT source, severity, count(*) AS n FROM ({kept(D, need='source severity')}) GROUP BY source, severity"


def corpus_totals(D: Dialect) -> str:
    return f"SELECT domain, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, domain) AS place FROM ({kept(D, need='domain')}) GROUP BY domain"


def document_summary(D: Dialect) -> str:
    """A5: totals and status of each document; without obligations it is partial."""
    return f"""
        SELECT doc_id, max(source) AS source, count(*) AS sections, count(CASE WHEN kept THEN 1 END) AS obligations, count(DISTINCT CASE WHEN kept THEN domain END) AS domains,
               count(CASE WHEN kept AND severity = 'critical' THEN 1 END) AS critical, CASE WHEN count(CASE WHEN kept THEN 1 END) = 0 THEN 'partial' ELSE 'success' END AS status
        FROM ({flagged(D, "source domain severity")}) GROUP BY doc_id"""


def numbered(D: Dialect) -> str:
    """O1, O2: obligations by severity and confidence, numbered within their document."""
    order = f"PARTITION BY doc_id ORDER BY {R.severity_rank(D, 'severity')} DESC, confidence DESC, section_id"
    return f"SELECT {KEYS}, severity, confidence, row_number() OVER ({order}) AS seq, concat(CAST(section_id AS VARCHAR(20)), '-OB', CAST(row_number() OVER ({order}) AS VARCHAR(20))) AS obligation_id FROM ({kept(D, need='severity confidence')})"


def rule_checks(D: Dialect) -> str:
    """Findings of the validation rules and the heuristics, one row each; the action is the clause."""
    may = D.matches("low", r"\bmay\b|at its discretion")
    tests = [
        ("deadline.text", "VAL-003", f"{D.matches('low', r'\bwithin\s+\d+\s+(?:days|months)')} AND deadline = 'ongoing'", "deadline present in clause"),
        ("obligation_type", "VAL-004", f"obligation_type = 'mandatory' AND {may}", "discretionary"),
        ("action", "VAL-006", "length(trim(clause_text)) < 20", "Summarized action needed"),
        ("severity", "VAL-015", "obligation_type = 'mandatory' AND contains(low, 'shall not') AND severity IN ('low', 'medium')", "high"),
        ("confidence", "VAL-018", "confidence < 0.65", ">= 0.65"),
        ("deadline.text", "heuristic", "contains(low, 'within') AND deadline = 'ongoing'", "deadline present in clause"),
        ("obligation_type", "heuristic", f"obligation_type = 'mandatory' AND {D.any_of('low', ('at its discretion', 'can', 'may'))}", "discretionary"),
        ("departments", "heuristic", f"{D.sorted_set(R.departments(D, 'domain', 'sub_type', 'actor', 'low'))} <> {D.sorted_set(R.departments(D, 'domain', D.text(None), 'actor', 'low'))}", "mapping of the domain"),
    ]
    base = kept(D)
    if D.name == "spark":
        parts = ", ".join(f"CASE WHEN {c} THEN named_struct('field', {D.text(f)}, 'check_id', '{r}', 'correct_value', {D.text(v)}) END" for f, r, c, v in tests)
        return f"SELECT {KEYS}, f.* FROM (SELECT {KEYS}, explode(filter(array({parts}), f -> f IS NOT NULL)) AS f FROM ({base}))"
    return "WITH k AS MATERIALIZED (" + base + ") " + " UNION ALL ".join(f"SELECT {KEYS}, {D.text(f)} AS field, '{r}' AS check_id, {D.text(v)} AS correct_value FROM k WHERE {c}" for f, r, c, v in tests)


def missed(D: Dialect) -> str:
    """J7, the exact half, and U7: clauses with "shall" that are no obligation, without those about effective dates."""
    return f"""
        SELECT {KEYS}, clause_text FROM ({flagged(D, "clause_text low")})
        WHERE NOT kept AND contains(concat(' ', low, ' '), ' shall ') AND NOT {D.any_of("low", ("come into force", "effect from", "effective from"))}"""


def merged_findings(D: Dialect) -> str:
    """Findings of the validation rules and of the heuristics; of those with one key, the rules' stays."""
    return f"""
        SELECT {KEYS}, field, correct_value, origin, concat('fix ', replace(field, '.', ' '), ' for ', CAST(section_id AS VARCHAR(20))) AS fix
        FROM (SELECT {KEYS}, field, correct_value, min(CASE WHEN check_id = 'heuristic' THEN 2 ELSE 1 END) AS origin FROM ({rule_checks(D)}) GROUP BY {KEYS}, field, correct_value)"""


def new_documents(D: Dialect) -> str:
    """Documents that aren't in the store yet (as if the store held every third), and the cached ones."""
    docs = f"SELECT DISTINCT doc_id FROM ({corpus.clauses(D)})"
    store = f"SELECT doc_id AS stored FROM ({docs}) WHERE doc_id % 3 = 0"
    return f"SELECT d.doc_id, CASE WHEN s.stored IS NULL THEN 'new' ELSE 'cached' END AS state FROM ({docs}) d LEFT JOIN ({store}) s ON d.doc_id = s.stored"


def training_pairs(D: Dialect) -> str:
    """Four pairs for each obligation of enough confidence."""
    kinds = [("obligation_extraction", "clause_text", 1.0), ("domain_classification", "low", 0.9), ("task_generation", "concat(actor, ': ', clause_text)", 0.8), ("severity_assessment", "low", 0.85)]
    base = f"SELECT * FROM ({kept(D)}) WHERE confidence >= 0.60"
    cols = lambda k, x, q: f"{D.text(k)} AS kind, {x} AS input, round(confidence * {q}, 4) AS quality"
    if D.name == "spark":
        parts = ", ".join(f"named_struct('kind', {D.text(k)}, 'input', {x}, 'quality', round(confidence * {q}D, 4))" for k, x, q in kinds)
        return f"SELECT {KEYS}, domain, p.* FROM (SELECT {KEYS}, domain, explode(array({parts})) AS p FROM ({base}))"
    return "WITH k AS MATERIALIZED (" + base + ") " + " UNION ALL ".join(f"SELECT {KEYS}, domain, {cols(*k)} FROM k" for k in kinds)


def section_rows(D: Dialect) -> str:
    """Sections of the numbered documents: id, level, heading, offset and text of each."""
    lines = D.explode_lines(f"({corpus.clause_documents(D, corpus.clauses(D))})", "doc_id", "full_text")
    number, roman = r"^(\d+(?:\.\d+)*[A-Z]?)\.\s*(.*)$", r"(?i)^\(([ivxlcdm]+)\)\s*(.*)$"
    marked = f"""
        SELECT *, CASE WHEN {D.matches("trim(line)", r"^\d{4}\.")} THEN NULL ELSE {D.extract("trim(line)", number, 1)} END AS num, lower({D.extract("trim(line)", roman, 1)}) AS rom,
               coalesce({D.extract("trim(line)", number, 2)}, {D.extract("trim(line)", roman, 2)}) AS body,
               sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM ({lines}) WHERE NOT {D.matches("trim(line)", r"^(?:\d+|[_. -]{5,})$")}"""
    counted = f"SELECT *, CAST(sum(CASE WHEN num IS NOT NULL OR rom IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS nth FROM ({marked})"
    return f"""
        SELECT doc_id, nth AS section, max(coalesce(num, rom)) AS section_no, max(CASE WHEN num IS NOT NULL THEN 1 WHEN rom IS NOT NULL THEN 3 END) AS level,
               max(body) AS heading, CAST(coalesce(min(before), 0) AS BIGINT) AS char_offset, {D.concat_lines("line", "pos")} AS section_text
        FROM ({counted}) WHERE nth > 0 GROUP BY doc_id, nth"""


def page_of_section(D: Dialect) -> str:
    """The page on which a section begins, pages being 500 characters and two more long: the last that begins at or before it."""
    pages = f"SELECT doc_id, page, (page - 1) * 502 AS page_start FROM (SELECT DISTINCT doc_id FROM ({corpus.clauses(D)})), (SELECT r_regionkey + 1 AS page FROM region)"
    if D.name == "duckdb":
        return f"SELECT s.doc_id, s.section, s.char_offset, coalesce(p.page, 1) AS page FROM ({section_rows(D)}) s ASOF LEFT JOIN ({pages}) p ON s.doc_id = p.doc_id AND s.char_offset >= p.page_start"
    return f"""
        SELECT doc_id, section, char_offset, coalesce(last_page, 1) AS page FROM (
            SELECT *, last(page, true) OVER (PARTITION BY doc_id ORDER BY at, is_section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_page FROM (
                SELECT doc_id, section, char_offset, char_offset AS at, 1 AS is_section, CAST(NULL AS INT) AS page FROM ({section_rows(D)})
                UNION ALL SELECT doc_id, NULL, NULL, page_start, 0, page FROM ({pages})))
        WHERE is_section = 1"""


def quoted_sections(D: Dialect) -> str:
    """A section that leads in a quotation, and all deeper ones up to the next of its level, are quoted.

    With two levels, a deeper section belongs to the last one of level 1 before it.
    """
    lead = D.any_of("lower(section_text)", R.words(data.LEAD_INS))
    typed = f"SELECT *, {R.final_clause_type(D, R.clause_type(D, 'lower(section_text)'), 'section_text')} AS own_type, {lead} AS leads FROM ({section_rows(D)})"
    island = f"SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section) AS island FROM ({typed})"
    return f"""
        SELECT doc_id, section, level, own_type,
               CASE WHEN level > 1 AND max(CASE WHEN level = 1 AND leads THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island) = 1 THEN 'quoted_reference'
                    WHEN leads AND own_type NOT IN ('obligation', 'penalty') THEN 'quoted_reference' ELSE own_type END AS clause_type
        FROM ({island})"""


def _cosines(D: Dialect) -> str:
    """cosine_patterns() clause by clause: the library is small, so that its words stand in the text and no word of a clause travels."""
    near = []
    for p in data.PATTERN_LIBRARY:
        counts = Counter(re.findall("[a-z0-9]+", f"{p[6]} {p[4].replace('_', ' ')}".lower()))
        dot = " + ".join(f"{n}L * size(filter(words, x -> {D.one_of('x', sorted(w for w in counts if counts[w] == n))}))" for n in sorted(set(counts.values())))
        near.append(f"named_struct('pattern_id', {D.text(p[0])}, 'dot', {dot}, 'norm', sqrt({sum(n * n for n in counts.values())}L))")
    repeats = "aggregate(array_sort(words), named_struct('word', '', 'n', 0L, 'sum', 0L), (a, x) -> named_struct('word', x, 'n', if(x = a.word, a.n + 1L, 1L), 'sum', a.sum + 2L * if(x = a.word, a.n + 1L, 1L) - 1L), a -> a.sum)"
    words = f"SELECT {KEYS}, flatten(collect_list(regexp_extract_all(lower(clause_text), '[a-z0-9]+', 0))) AS words FROM ({corpus.clauses(D)}) WHERE doc_id IS NOT NULL AND section_id IS NOT NULL GROUP BY {KEYS}"
    cosines = f"SELECT {KEYS}, transform(filter(array({', '.join(near)}), p -> p.dot > 0), p -> named_struct('far', -round(p.dot / (norm * p.norm), 6), 'pattern_id', p.pattern_id)) AS near FROM (SELECT *, sqrt({repeats}) AS norm FROM ({words}))"
    return f"SELECT {KEYS}, p.pattern_id, -p.far AS cosine, pos + 1 AS nth FROM ({cosines}) LATERAL VIEW posexplode(slice(array_sort(near), 1, 2)) e AS pos, p"


def cosine_patterns(D: Dialect) -> str:
    """Cosine of word counts between clauses and the pattern library, the two nearest patterns."""
    if D.name == "spark":
        return _cosines(D)
    library = " UNION ALL ".join(f"SELECT {D.text(p[0])} AS pattern_id, {D.text(p[6] + ' ' + p[4].replace('_', ' '))} AS pattern_text" for p in data.PATTERN_LIBRARY)
    split = (lambda x: f"explode(regexp_extract_all(lower({x}), '[a-z0-9]+', 0))") if D.name == "spark" else (lambda x: f"unnest(regexp_extract_all(lower({x}), '[a-z0-9]+'))")
    return f"""
        WITH w AS (SELECT {KEYS}, word, count(*) AS n FROM (SELECT {KEYS}, {split("clause_text")} AS word FROM ({corpus.clauses(D)})) GROUP BY {KEYS}, word),
             l AS (SELECT pattern_id, word, count(*) AS n FROM (SELECT pattern_id, {split("pattern_text")} AS word FROM ({library})) GROUP BY pattern_id, word),
             wn AS (SELECT {KEYS}, sqrt(sum(n * n)) AS norm FROM w GROUP BY {KEYS}), ln AS (SELECT pattern_id, sqrt(sum(n * n)) AS norm FROM l GROUP BY pattern_id),
             dots AS (SELECT {KEYS}, pattern_id, sum(w.n * l.n) AS dot FROM w JOIN l ON w.word = l.word GROUP BY {KEYS}, pattern_id)
        SELECT doc_id, section_id, pattern_id, cosine, nth FROM (
            SELECT d.doc_id, d.section_id, d.pattern_id, round(dot / (wn.norm * ln.norm), 6) AS cosine,
                   row_number() OVER (PARTITION BY d.doc_id, d.section_id ORDER BY round(dot / (wn.norm * ln.norm), 6) DESC, d.pattern_id) AS nth
            FROM dots d JOIN wn ON d.doc_id = wn.doc_id AND d.section_id = wn.section_id JOIN ln ON d.pattern_id = ln.pattern_id)
        WHERE nth <= 2"""


def duplicate_pairs(D: Dialect) -> str:
    """J8, the part that is exact: obligations of one source, actor and opening, digits aside, each against the first of them. operators.validation has the part by likeness."""
    key = f"substr({D.replace('low', '[0-9]+', '#')}, 1, 48)"
    every = f"SELECT {KEYS}, source, actor, {key} AS opening FROM ({kept(D, need='source actor low')})"
    if D.name == "duckdb":
        return f"SELECT doc_id, section_id, first_section FROM (SELECT {KEYS}, min(section_id) OVER (PARTITION BY source, actor, opening) AS first_section FROM ({every})) WHERE section_id > first_section"
    # The groups are few and large: their firsts are found by partial aggregation and joined to the rows. Both sides read one exchange, so that clauses are worked out once.
    first = "SELECT source, actor, opening, min(section_id) AS first_section, count(doc_id) AS n FROM every_ GROUP BY source, actor, opening"
    return f"""
        WITH every_ AS (SELECT /*+ REPARTITION(section_id) */ * FROM ({every}))
        SELECT e.doc_id, e.section_id, f.first_section FROM every_ e JOIN ({first}) f ON e.source = f.source AND e.actor = f.actor AND e.opening = f.opening
        WHERE f.n > 1 AND e.section_id > f.first_section"""


def text_profile(D: Dialect) -> str:
    """F1, F20, S2, F47, S4 and sizes, over documents."""
    clean = R.normalised(D, "text")
    return f"SELECT doc_id, length({clean}) AS clean_chars, {R.script_language(D, 'text', True)} AS language_of_all, {R.script_language(D, 'text', False)} AS language_of_letters, {R.source_of(D, 'text')} AS issuer, {D.any_of('lower(text)', ('annex', 'schedule'))} AS annexed FROM documents"


def table_runs(D: Dialect) -> str:
    """Runs of three or more lines with at least two bars or tabs each."""
    cells = "(length(line) - length(replace(line, '|', '')) >= 2 OR length(line) - length(replace(line, chr(9), '')) >= 2)"
    runs = f"SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ({D.explode_lines('documents', 'doc_id', 'text')}) WHERE {cells}"
    return f"SELECT doc_id, min(pos) AS first_line, count(*) AS row_count FROM ({runs}) GROUP BY doc_id, island HAVING count(*) >= 3"


PLANS: dict[str, Callable[[Dialect], str]] = {
    "trigger_match": trigger_match,
    "actor_match": actor_match,
    "obligation_type": _picked("obligation_type, kind", "obligation_type"),
    "sub_type": sub_types,
    "deadline_extract": deadline_extract,
    "date_parse": dates,
    "domain_score": _picked("own_domain AS domain, points", "domain"),
    "departments": department_list,
    "sector_match": sector_match,
    "severity": severity_levels,
    "confidence": _picked("confidence, points, n_references", "confidence n_references"),
    "clause_type": clause_types,
    "clause_predicates": predicates,
    "cross_references": reference_list,
    "penalty_evidence": penalties,
    "sentence_profile": live_profile,
    "field_candidates": votes,
    "field_vote": field_vote,
    "obligations_by_domain": by_domain,
    "obligations_by_severity": obligations_per_source,
    "corpus_totals": corpus_totals,
    "document_summary": document_summary,
    "obligation_numbers": numbered,
    "validation_findings": rule_checks,
    "missed_clauses": missed,
    "merged_findings": merged_findings,
    "incremental_documents": new_documents,
    "training_pairs": training_pairs,
    "section_rows": section_rows,
    "section_pages": page_of_section,
    "quoted_sections": quoted_sections,
    "pattern_cosine": cosine_patterns,
    "duplicate_obligations": duplicate_pairs,
    "text_profile": text_profile,
    "table_runs": table_runs,
}


def candidate_clauses(D: Dialect, base: str | None = None) -> str:
    """What the candidate profile needs of each obligation clause."""
    return f"SELECT *, {D.ordered_set(R.departments(D, 'domain', 'sub_type', 'actor', 'low'))} AS departments FROM ({kept(D, base)})"


#: Plans that other operators build on.
INNER: dict[str, Callable[[Dialect], str]] = {"candidate_clauses": candidate_clauses, "kept_obligations": kept, "circular_texts": corpus.circulars}
