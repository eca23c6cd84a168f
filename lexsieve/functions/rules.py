"""Rule tables compiled to SQL expressions.

Each function takes a dialect and SQL text for its arguments and returns SQL text. Where several rules can
match, "heaviest" means the highest weight, the first of equals; "first" means table order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from . import rule_data as data
from .dialect import Dialect

_MONTH_DATE = r"[A-Za-z]+\s+\d{1,2},?\s+\d{4}"
_NUMBER_DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"
_TOKENS = {
    "[": "(?:", "]": ")?", "(": "(?:", ")": ")", "|": "|", "~": ".", "#": r"(\d+)", "@": f"({_MONTH_DATE}|{_NUMBER_DATE})", "%": f"({_MONTH_DATE})",
    "&": f"({_NUMBER_DATE})", "$": r"(\d{4}\s*[-–]\s*\d{2,4})",
}


def compiled(pattern: str, blank: str = " ") -> str:
    """A regular expression out of the notation of rule_data."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        if c == "{":
            end = pattern.index("}", i)
            out, i = out + "(" + pattern[i + 1 : end].replace(" ", blank) + ")", end + 1
            continue
        if c == " ":
            out += r"\s+" if pattern[i + 1 : i + 2] in ("@", "%", "&", "$", "#") else blank
        else:
            out += _TOKENS.get(c) or re.escape(c)
        i += 1
    return out.replace("\\-", "-").replace("\\'", "'").replace("\\/", "/")


def whole(alternatives: str, blank: str = " ") -> str:
    return "|".join(rf"\b{compiled(a, blank)}\b" for a in alternatives.split(" | "))


def cores(alternatives: str) -> list[str]:
    """For each alternative its longest stretch of letters that can't be missing; nothing if one has none of three letters."""
    out = []
    for a in alternatives.split(" | "):
        bare = re.sub(r"\{[^}]*\}|\\.", "\0", a)
        while "[" in bare or "(" in bare:
            less = re.sub(r"\[[^\[\]()]*\]|\([^\[\]()]*\)", "\0", bare)
            if less == bare:
                return []
            bare = less
        best = max(re.findall(r"[a-z]+(?: [a-z]+)*", bare.replace("|", "\0").lower()), key=len, default="")
        if len(best) < 3 or "|" in bare:
            return []
        out.append(best)
    return out


def gated(D: Dialect, low: str, pattern: str, needed: list[str], apart: bool = False) -> str:
    """matches(), asked only where the letters that every match has (cores()) occur, which is far cheaper to tell. apart: blanks may be of any kind."""
    hit = D.matches(low, pattern)
    needed = [max(w.split(" "), key=len) for w in needed] if apart else needed
    return f"({D.any_of(low, dict.fromkeys(needed))} AND {hit})" if D.name == "spark" and needed and min(map(len, needed)) > 2 else hit


def lines(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(";")] for line in block.strip().splitlines()]


def words(text: str) -> list[str]:
    return list(_words(text))


@lru_cache(4096)
def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip().replace("\\,", ",") for w in re.split(r"(?<!\\),", text) if w.strip())


def listed(block: str) -> dict[str, list[str]]:
    return {k.strip(): v.split() for k, v in (line.rsplit(":", 1) for line in block.strip().splitlines())}


@dataclass(frozen=True)
class Trigger:
    id: str
    kind: str
    weight: float
    pattern: str
    urgency: str | None = None
    cores: tuple[str, ...] = ()


@lru_cache
def triggers() -> tuple[list[Trigger], list[Trigger]]:
    """(negations, triggers) in table order."""
    found: list[list[Trigger]] = [[], []]
    for n, (name, block) in enumerate((("NEG", data.NEGATIONS), ("TV", data.TRIGGERS))):
        for weight, kind, phrases in lines(block):
            kind, _, urgency = kind.partition("!")
            for phrase in phrases.split(" / "):
                found[n].append(Trigger(f"{name}-{len(found[n]) + 1:03d}", kind, float(weight), whole(phrase), urgency or None, tuple(cores(phrase))))
    return found[0], found[1]


def one_line(D: Dialect, x: str) -> str:
    return D.replace(x, r"[ \t]*\n[ \t]*", " ")


def trigger_id(D: Dialect, low: str) -> str:
    """The first negation, else the heaviest trigger. low: lower-case text on one line."""
    negations, positive = triggers()
    return D.case((gated(D, low, t.pattern, list(t.cores)), D.text(t.id)) for t in [*negations, *sorted(positive, key=lambda t: -t.weight)])


def trigger_field(D: Dialect, id_: str, field: str) -> str:
    both = [*triggers()[0], *triggers()[1]]
    if field == "weight":
        return D.lookup(id_, {t.id: repr(t.weight) + "D" * (D.name == "spark") for t in both}, "CAST(NULL AS DOUBLE)")
    return D.lookup(id_, {t.id: D.text(getattr(t, field)) for t in both if getattr(t, field)}, D.text(None))


def trigger_text(D: Dialect, id_: str, low: str) -> str:
    """What the trigger's pattern found."""
    return D.lookup(id_, {t.id: D.extract(low, t.pattern) for t in [*triggers()[0], *triggers()[1]]}, D.text(None))


def is_negation(D: Dialect, low: str) -> str:
    if D.sees:
        return "(" + " OR ".join(gated(D, low, t.pattern, list(t.cores)) for t in triggers()[0]) + ")" if triggers()[0] else D.matches(low, "")
    return D.matches(low, "|".join(t.pattern for t in triggers()[0]))


@lru_cache
def actors() -> list[tuple[float, list[str], str, str, list[str]]]:
    return [(float(w), scope.split(), name, whole(p), cores(p)) for w, scope, name, p in lines(data.ACTORS)]


def actor(D: Dialect, low: str, source: str) -> str:
    """The heaviest actor; a rule with a scope needs source in it, unless source is null."""
    pairs = []
    for _, scope, name, pattern, needed in sorted(actors(), key=lambda a: -a[0]):
        hit = gated(D, low, pattern, needed)
        pairs.append((f"({hit} AND ({source} IS NULL OR {D.one_of(source, scope)}))" if scope else hit, D.text(name)))
    return D.case(pairs, D.text("Regulated Entity"))


def corrected_actor(D: Dialect, who: str, low: str) -> str:
    """a regulator that issues, or is addressed, isn't the one who acts."""
    addressed = D.matches(low, r"\bto\s+(?:the\s+authority|rbi|the\s+reserve\s+bank)\b")
    return f"CASE WHEN {D.one_of(who, ('RBI', 'IRDAI'))} AND ({addressed} OR {D.any_of(low, words(data.ISSUER_SIGNALS))}) THEN 'Regulated Entity' ELSE {who} END"


def obligation_type(D: Dialect, kind: str, low: str) -> str:
    """R4. kind: that of the trigger, or null."""
    known = D.one_of(kind, ("mandatory", "prohibition", "approval_required", "recommendation", "reporting", "governance"))
    return D.case(
        [
            (known, "'mandatory'"),
            (D.one_of(kind, ("discretionary", "conditional", "time_bound")), kind),
            (D.any_of(low, ("in case of", "where", "if", "subject to", "provided that")), "'conditional'"),
            (f"{D.matches(low, r'\bmay\b')} AND NOT {D.matches(low, r'\b(?:is obligated|required to|must|shall)\b')}", "'discretionary'"),
            (D.any_of(low, ("at its discretion", "at the discretion")), "'discretionary'"),
        ],
        "'mandatory'",
    )


def sub_type(D: Dialect, low: str) -> str:
    """First type with a phrase in the text."""
    return D.case(((D.any_of(low, words(p)), D.text(name)) for name, _, p in lines(data.SUB_TYPES)), D.text(None))


def severity_floor(D: Dialect, kind: str) -> str:
    return D.lookup(kind, {n: D.text(s) for n, s, _ in lines(data.SUB_TYPES)}, D.text(None))


@lru_cache
def deadlines() -> list[tuple[str, str, str]]:
    return [(u, d, "(?i)" + whole(p, r"\s+")) for u, d, p in lines(data.DEADLINES)]


def deadline_text(D: Dialect, x: str) -> str:
    """Text as the deadline rules want it."""
    return f"trim({D.replace(one_line(D, x), r'\s{2,}', ' ')})"


def deadline_rule(D: Dialect, flat: str) -> str:
    """Number of the first deadline rule, or null."""
    needed = [cores(p) for _, _, p in lines(data.DEADLINES)]
    if D.name != "spark":
        return D.case(((D.matches(flat, p), str(n)) for n, (_, _, p) in enumerate(deadlines())), "CAST(NULL AS INT)")
    return D.let(f"lower({flat})", "small_", D.case(((gated(D, "small_", p, c, apart=True), str(n)) for n, ((_, _, p), c) in enumerate(zip(deadlines(), needed))), "CAST(NULL AS INT)"))


def _by_rule(D: Dialect, rule: str, values: dict[int, str], otherwise: str) -> str:
    return D.case([(f"{rule} = {n}", v) for n, v in values.items()], otherwise)


def deadline_found(D: Dialect, rule: str, flat: str) -> str:
    return _by_rule(D, rule, {n: f"trim({D.extract(flat, p)})" for n, (_, _, p) in enumerate(deadlines())}, D.text(None))


def deadline_duration(D: Dialect, rule: str, flat: str) -> str:
    out = {}
    for n, (_, duration, p) in enumerate(deadlines()):
        if duration == "*":
            out[n] = f"concat({D.extract(flat, p, 1)}, ' ', {D.extract(flat, p, 2)})"
        elif duration and duration != "@":
            out[n] = D.text(duration)
    return _by_rule(D, rule, out, D.text(None))


def deadline_date(D: Dialect, rule: str, flat: str) -> str:
    out = {n: D.extract(flat, p, 1) for n, (_, duration, p) in enumerate(deadlines()) if duration == "@"}
    return iso_date(D, _by_rule(D, rule, out, D.text(None)))


def deadline_frequency(D: Dialect, rule: str) -> str:
    names = {"quarterly": "quarterly", "monthly": "monthly", "annually": "annual", "half-yearly": "bi-annual"}
    out = {n: D.text(names.get(d, "continuous")) for n, (u, d, _) in enumerate(deadlines()) if u == "ongoing"}
    return _by_rule(D, rule, out, D.text(None))


def urgency_of(D: Dialect, number: str, unit: str) -> str:
    """Urgency of a number of days, weeks, months or years; of words instead of a number, medium."""
    per = f"CASE WHEN contains(lower({unit}), 'week') THEN 7 WHEN contains(lower({unit}), 'month') THEN 30 WHEN contains(lower({unit}), 'year') THEN 365 ELSE 1 END"
    body = "CASE WHEN days_ IS NULL THEN 'medium_term' WHEN days_ <= 0 THEN 'immediate' WHEN days_ <= 30 THEN 'short_term' WHEN days_ <= 90 THEN 'medium_term' ELSE 'long_term' END"
    return D.let(f"{D.number(number)} * {per}", "days_", body)


def deadline_urgency(D: Dialect, rule: str, flat: str, override: str) -> str:
    """An override wins unless the rule says immediate; without a rule, conditions are triggered and all else is ongoing."""
    own = _by_rule(D, rule, {n: urgency_of(D, D.extract(flat, p, 1), D.extract(flat, p, 2)) if u == "?" else D.text(u) for n, (u, _, p) in enumerate(deadlines())}, D.text(None))
    conditional = D.matches(flat, r"(?i)\b(?:in case of|where|if|subject to)\b")
    ruled = D.let(own, "own_", f"CASE WHEN own_ = 'immediate' THEN own_ ELSE coalesce({override}, own_) END")
    return f"CASE WHEN {rule} IS NOT NULL THEN {ruled} WHEN {override} IS NOT NULL THEN {override} WHEN {conditional} THEN 'triggered' ELSE 'ongoing' END"


def deadline_label(D: Dialect, rule: str, found: str, flat: str, override: str) -> str:
    conditional = D.matches(flat, r"(?i)\b(?:in case of|where|if|subject to)\b")
    return f"CASE WHEN {rule} IS NOT NULL THEN {found} WHEN {override} IS NOT NULL THEN replace({override}, '_', ' ') WHEN {conditional} THEN 'triggered by condition' ELSE 'ongoing' END"


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month(D: Dialect, x: str) -> str:
    return D.lookup(f"lower({x})", {m: f"'{n:02d}'" for n, m in enumerate(MONTHS, 1)}, D.text(None))


def iso_date(D: Dialect, x: str) -> str:
    """F16: D.M.Y with any of ./-, Month D, Y or D Month Y to Y-M-D, no calendar looked at; null for anything else."""
    names, v = "|".join(MONTHS), "iso_"
    dmy, mdy, dm = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", rf"(?i)^({names})\s+(\d{{1,2}}),?\s+(\d{{4}})$", rf"(?i)^(\d{{1,2}})\s+({names})\s+(\d{{4}})$"
    pad = lambda g: f"lpad({g}, 2, '0')"
    body = D.case(
        [
            (D.matches(v, dmy), f"concat({D.extract(v, dmy, 3)}, '-', {pad(D.extract(v, dmy, 2))}, '-', {pad(D.extract(v, dmy, 1))})"),
            (D.matches(v, mdy), f"concat({D.extract(v, mdy, 3)}, '-', {_month(D, D.extract(v, mdy, 1))}, '-', {pad(D.extract(v, mdy, 2))})"),
            (D.matches(v, dm), f"concat({D.extract(v, dm, 3)}, '-', {_month(D, D.extract(v, dm, 2))}, '-', {pad(D.extract(v, dm, 1))})"),
        ],
        D.text(None),
    )
    return D.let(f"trim({x})", v, body)


def fiscal_year(D: Dialect, x: str) -> str:
    """first of April of an Indian financial year; a bare one counts only as YYYY-YY and nothing else."""
    named, bare = r"(?i)(?:financial\s+year|FY)\s*(\d{4})\s*[-–]\s*\d{2,4}", r"^\s*(\d{4})\s*[-–]\s*\d{2}\s*$"
    return D.case([(D.matches(x, p), f"concat({D.extract(x, p, 1)}, '-04-01')") for p in (named, bare)], D.text(None))


def first_date(D: Dialect, x: str) -> str:
    """first of the notations that occurs at all, its first place."""
    names = "|".join(MONTHS)
    forms = (r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b", rf"(?i)\b(?:{names})\s+\d{{1,2}},?\s+\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+(?:{names})\s+\d{{4}}\b")
    return iso_date(D, "coalesce(" + ", ".join(D.extract(x, f) for f in forms) + ")")


@lru_cache
def effective_rules() -> list[tuple[str, str]]:
    out = []
    for n, (kind, pattern) in enumerate(lines(data.EFFECTIVE_DATES)):
        wide = kind in ("year", "none") or n == 6
        body = "|".join(rf"\b{compiled(a, r'\s+' if wide else ' ')}" for a in pattern.split(" | "))
        out.append((kind, "(?i)" + body + (r"\b" if kind == "date" else "")))
    return out


def effective_date(D: Dialect, x: str) -> str:
    """by the first rule that matches; a rule for amendments gives null, one for issuance the literal date_of_circular, one for years goes on if it can't be read."""
    pairs = []
    for kind, p in effective_rules():
        found = D.extract(x, p, 1)
        if kind == "year":
            pairs.append((D.matches(x, p.replace(r"\d{2,4})", r"\d{2})") + r"(?:\D|$)"), D.extract(found, r"^\d{4}")))
        else:
            pairs.append((D.matches(x, p), {"date": found, "issue": "'date_of_circular'", "none": D.text(None)}[kind]))
    v = "found_"
    return D.let(D.case(pairs, D.text(None)), v, f"CASE WHEN {v} = 'date_of_circular' THEN {v} WHEN {D.matches(v, r'^\d{4}$')} THEN concat({v}, '-04-01') ELSE {iso_date(D, v)} END")


def domain_scores(D: Dialect, low: str) -> list[tuple[str, str]]:
    """(domain, points): a keyword counts one, a phrase two; sector additions are weighed by themselves."""
    base = [(d, f"({D.count_in(low, words(k))} + 2 * {D.count_in(low, words(p))})") for d, k, p in lines(data.DOMAINS)]
    return base + [(d, D.count_in(low, words(k))) for d, k in lines(data.DOMAIN_ADDITIONS)]


def domain_names() -> list[str]:
    return [d for d, *_ in lines(data.DOMAINS)] + [d for d, _ in lines(data.DOMAIN_ADDITIONS)]


def best_domain(D: Dialect, scores: list[str], best: str) -> str:
    """First domain with the best score, Other without any point."""
    return D.case([(f"{best} = 0", "'Other'"), *((f"{s} = {best}", D.text(n)) for s, n in zip(scores, domain_names()))])


def _lists(D: Dialect, x: str, table: dict[str, list[str]], otherwise: list[str]) -> str:
    return D.lookup(x, {k: D.strings(v) for k, v in table.items()}, D.strings(otherwise))


def departments(D: Dialect, domain: str, kind: str, who: str, low: str) -> str:
    """Departments by sub-type, domain, signals of the text and actor, in this order, with repeats."""
    signals = [f"CASE WHEN {D.any_of(low, words(k))} THEN {D.strings(v)} ELSE {D.strings([])} END" for k, v in listed(data.SIGNAL_DEPARTMENTS).items()]
    return D.chain(_lists(D, kind, listed(data.SUB_TYPE_DEPARTMENTS), []), _lists(D, domain, listed(data.DOMAIN_DEPARTMENTS), ["Compliance"]), *signals, _lists(D, who, listed(data.ACTOR_DEPARTMENTS), []))


@dataclass(frozen=True)
class Sector:
    id: str
    name: str
    domain: str
    sub_type: str
    deadline: str
    duration: str
    urgency: str
    severity: str
    phrases: tuple[str, ...]
    actors: tuple[str, ...]


@lru_cache
def sectors() -> list[Sector]:
    out, pack = [], ()
    for line in data.SECTORS.strip().splitlines():
        if line.startswith("="):
            pack = tuple(words(line.split(";")[1]))
            continue
        head, domain, kind, when, severity, phrases = (x.strip() for x in line.split(";"))
        text, duration, urgency = when.split("/") if when else ("", "", "")
        out.append(Sector(*head.split(" ", 1), domain, kind, text, duration, urgency, severity, tuple(words(phrases)), pack))
    return out


def sector_id(D: Dialect, low: str, who: str) -> str:
    """First rule of the first pack, among those that suit the actor, with a phrase in the text.

    A pack suits actors whose name holds, or is held by, one of its own; generic actors suit every pack, and a pack for regulated entities every actor.
    """
    pairs = []
    for s in sectors():
        fits = "TRUE" if "Regulated Entity" in s.actors else "(" + " OR ".join([D.one_of(who, ("Regulated Entity", "Bank")), *(f"contains({D.text(a.lower())}, lower({who})) OR contains(lower({who}), {D.text(a.lower())})" for a in s.actors)]) + ")"
        pairs.append((f"{D.any_of(low, s.phrases)} AND {fits}" if D.sees else f"{fits} AND {D.any_of(low, s.phrases)}", D.text(s.id)))
    return D.case(pairs, D.text(None))


def sector_field(D: Dialect, id_: str, field: str) -> str:
    return D.lookup(id_, {s.id: D.text(getattr(s, field)) for s in sectors() if getattr(s, field)}, D.text(None))


def severity(D: Dialect, low: str, urgency: str, kind: str, sub: str, domain: str) -> str:
    """First rule all of whose conditions hold, else by urgency and type. All keywords of a rule must occur."""
    columns = {"urgency": urgency, "obligation_type": kind, "sub_type": sub, "domain": domain}
    pairs = []
    for level, *conditions in lines(data.SEVERITIES):
        tests = []
        for c in conditions:
            name, values = (x.strip() for x in c.split("="))
            tests += [f"contains({low}, {D.text(v.strip())})" for v in values.split("&")] if name == "has" else [D.one_of(columns[name], words(values))]
        pairs.append((" AND ".join(tests), D.text(level)))
    pairs += [(f"{kind} = 'mandatory' OR {urgency} = 'medium_term'", "'medium'")]
    return D.case(pairs, "'low'")


def severity_rank(D: Dialect, x: str) -> str:
    return f"CASE {x} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def severity_reason(D: Dialect, level: str, urgency: str, sub: str) -> str:
    """the reference's fixed sentences, one for each case."""
    return D.case(
        [
            (f"{level} = 'critical' AND {sub} = 'incident_reporting'", D.text("Cyber/fraud incident reporting is always critical — delay creates systemic risk.")),
            (f"{level} = 'critical' AND {urgency} = 'immediate'", D.text("The clause requires immediate action, creating critical regulatory exposure if missed.")),
            (f"{level} = 'critical'", D.text("The clause references a penalty, systemic risk, or immediate regulatory action.")),
            (f"{level} = 'high' AND {urgency} = 'short_term'", D.text("The obligation has a short-term deadline (within 30 days) requiring prompt action.")),
            (f"{level} = 'high' AND {sub} = 'customer_protection'", D.text("Customer protection obligations carry high regulatory risk if not met.")),
            (f"{level} = 'high'", D.text("The obligation has significant operational or regulatory impact.")),
            (f"{level} = 'medium'", D.text("The obligation requires a process or control update within 90 days.")),
        ],
        D.text("The obligation is discretionary, informational, or has a long/conditional timeline."),
    )


def confidence(D: Dialect, x: str, found: str, urgency: str, has_reference: str, who: str, points: str, penalty: str, fine: str, clause: str, verbatim: str = "0") -> str:
    """Base of one half, plus what is in favour, less what isn't, between 0.30 and 0.98. found: trigger text; clause: clause type."""
    said = f"coalesce({found}, '')"
    shall, strong = f"contains({said}, 'shall')", D.any_of(said, ("shall ensure", "shall submit", "shall report", "shall maintain"))
    generic = D.one_of(who, ("Regulated Entity", "Bank"))
    parts = [
        (f"{shall} AND NOT {strong}", 0.2), (strong, 0.25), (f"{urgency} <> 'ongoing'", 0.1), (f"NOT {D.one_of(urgency, ('ongoing', 'triggered'))}", 0.05), (f"NOT {generic}", 0.08),
        (has_reference, 0.05), (f"{points} > 2", 0.05), (f"length({x}) > 80", 0.05), (f"{who} = ''", -0.15), (f"contains({said}, 'may') AND NOT {shall}", -0.1),
        (f"NOT {generic} AND {who} <> '' AND NOT contains(lower({x}), lower({who}))", -0.2), (penalty, 0.08), (fine, 0.05),
        (f"{verbatim} > 0.80 AND length({x}) >= 150", -0.15), (f"NOT {D.one_of(clause, ('obligation', 'penalty'))} AND NOT {shall}", -0.08),
    ]
    cents = " + ".join(f"(CASE WHEN {c} THEN {round(v * 100)} ELSE 0 END)" for c, v in parts)
    return f"CAST(greatest(30, least(98, 50 + {cents})) AS DOUBLE) / 100"


def clause_type(D: Dialect, low: str) -> str:
    """Heaviest class with a word in the text."""
    return D.case(((D.any_of(low, words(w)), D.text(n)) for n, _, w in sorted(lines(data.CLAUSE_TYPES), key=lambda r: -float(r[1]))), "'other'")


def final_clause_type(D: Dialect, kind: str, x: str) -> str:
    """F52; prohibitions, which sections can't have, count as obligations."""
    low = f"lower({x})"
    naming = f"{D.matches(low, 'shall be (?:titled|cited as|known as|called)')} AND length({x}) < 300"
    return D.case([(D.any_of(low, ("come into effect", "come into force", "with effect from")), "'effective_date'"), (naming, "'other'"), (f"{kind} = 'prohibition'", "'obligation'")], kind)


def fallback_clause_type(D: Dialect, x: str) -> str:
    """without rules. Quote marks are looked at by is_quoted_block."""
    low = f"lower({x})"
    refers = r"please refer|as per|vide|in terms of|dated\s+[a-z]+\s+\d{1,2},\s+\d{4}|circular no\.|directions, \d{4}"
    return D.case(
        [
            (f"{is_quoted_block(D, x)} OR {D.any_of(low, words(data.LEAD_INS))}", "'quoted_reference'"),
            (D.any_of(low, ("come into effect", "come into force", "with effect from")), "'effective_date'"),
            (D.matches(low, refers), "'cross_reference'"),
            (D.any_of(low, ("fine", "penalty", "punishable")), "'penalty'"),
            (D.any_of(low, ("for the purpose of these directions", "means", "shall mean")), "'definition'"),
            (f"contains(concat(' ', {low}, ' '), ' shall ')", "'obligation'"),
            (f"contains(concat(' ', {low}, ' '), ' may ')", "'permission'"),
        ],
        "'other'",
    )


def _unnumbered(D: Dialect, x: str) -> str:
    return D.replace(f"trim({x})", r"^(?:\([a-z]+\)\s*|\d+(?:\.\d+)*[A-Z]?\.\s*)", "")


def is_quoted_block(D: Dialect, x: str) -> str:
    """begins and ends with a double quote, after its number."""
    return D.matches(_unnumbered(D, x), '^[“„"](?s:.*)[”‟"]\\s*$')


def is_boilerplate(D: Dialect, x: str) -> str:
    return f"(trim({x}) = '' OR {D.any_of(f'lower({x})', words(data.BOILERPLATE))})"


def is_quoted(D: Dialect, x: str, clause: str) -> str:
    """a quotation or mere reference rather than a new directive."""
    low = f"lower({x})"
    refers = D.matches(low, r"\b(?:under|vide|as per|in terms of|pursuant to)\s+(?:para|circular|section|regulation)")
    directs = D.matches(low, r"\b(?:must|shall|required to|(?:is|are) advised to)\b")
    return D.case(
        [
            (f"{clause} = 'quoted_reference'", "TRUE"),
            (D.any_of(low, words(data.RESTARTS)), "FALSE"),
            (D.any_of(low, words(data.LEAD_INS)), "TRUE"),
            (D.matches(_unnumbered(D, x), '^"(?s:.*)"\\s*$'), "TRUE"),
        ],
        f"({refers} AND NOT {directs})",
    )


def references() -> list[str]:
    return ["(?i)" + p.format(**data.REFERENCE_PARTS) for p in data.CROSS_REFERENCES]


def cross_references(D: Dialect, x: str) -> str:
    """all that the rules find, rule by rule, with repeats, blanks as one. reference_list() has the first eight distinct ones."""
    return D.map_strings(D.chain(*(D.extract_all(x, p) for p in references())), "ref_", f"trim({D.replace('ref_', r'\s+', ' ')})")


def has_references(D: Dialect, x: str) -> str:
    return "(" + " OR ".join(D.matches(x, p) for p in references()) + ")"


def numbers(field: str) -> list[str]:
    return ["(?i)" + p.format(**data.REFERENCE_PARTS) for f, p in data.NUMBERS if f == field]


def first_number(D: Dialect, x: str, field: str) -> str:
    """what the first rule that matches finds."""
    return "coalesce(" + ", ".join(D.extract(x, p) for p in numbers(field)) + ")"


def document_type(D: Dialect, x: str) -> str:
    return D.case(((D.matches(x, numbers(f)[0]), D.text(f)) for f in ("master_direction", "master_circular")), D.text(None))


def amends(D: Dialect, x: str) -> str:
    """the circular that is amended."""
    number, no = r"([A-Z][-\dA-Z./]+)", r"(?:No\.\s*)?"
    forms = (
        rf"(?i)(?:substitute|replace|modify|amend|supersede)\s+(?:the\s+)?(?:instruction|guideline|notification|direction|circular)\s+{no}{number}",
        rf"(?i)in\s+partial\s+modification\s+of\s+(?:our\s+)?(?:directions?|circular)\s+{no}{number}",
    )
    return "coalesce(" + ", ".join(D.extract(x, f, 1) for f in forms) + ")"


def penalty(D: Dialect, x: str) -> str:
    return f"trim({D.extract(x, r'(?i)(?:late submission fee|penalty|fine)[^.;]*')})"


def fine(D: Dialect, x: str) -> str:
    found = D.extract(x, r"(?i)(?:INR|Rs\.?)\s*([\d,]+(?:\.\d+)?)", 1)
    return D.number(f"replace({found}, ',', '')", "DOUBLE")


def condition_text(D: Dialect, x: str, kind: str, found: str) -> str:
    """F32: the condition that triggers the obligation, else always or the trigger's words."""
    condition = D.extract(x, r"(?i)(?:provided that|subject to|in case of|where|if) [^.,;]+")
    return f"coalesce(trim({condition}), CASE WHEN {kind} IS NULL OR {D.one_of(kind, ('mandatory', 'prohibition', 'approval_required'))} THEN 'always' ELSE coalesce({found}, 'always') END)"


def evidence(D: Dialect, low: str, domain: str) -> str:
    """list of documents to keep; the first two by domain."""
    table = {k.strip(): [v.strip() for v in e.split("+")] for k, e in (line.split(":") for line in data.EVIDENCE.strip().splitlines())}
    extra = [(D.any_of(low, ("approval",)), "Approval or authorization record"), (D.any_of(low, ("intimation", "report", "submit")), "Regulatory communication or submission acknowledgement")]
    return D.chain(_lists(D, domain, table, table["Other"]), *(f"CASE WHEN {c} THEN {D.strings([t])} ELSE {D.strings([])} END" for c, t in extra))


def source_of(D: Dialect, x: str) -> str:
    """issuer named in the first 4000 characters."""
    low = f"lower(substr({x}, 1, 4000))"
    table = [("RBI", "rbi/, reserve bank of india"), ("SEBI", "sebi/, securities and exchange board"), ("CERT-In", "cert-in, cert in"), ("DPDP", "dpdp, digital personal data"), ("FIU-IND", "fiu, financial intelligence unit"), ("NPCI", "npci, national payments corporation"), ("IRDAI", "irda, insurance regulatory and development authority"), ("IBA", "iba, indian banks association")]
    return D.case(((D.any_of(low, words(w)), D.text(n)) for n, w in table), "'OTHER'")


#: What names an issuer where, the first that does being the one. The orders differ on purpose.
SOURCE_WORDS = {
    "name": "RBI: rbi; SEBI: sebi; CERT-In: cert; DPDP: dpdp, meity; FIU-IND: fiu; NPCI: npci; IRDAI: irdai, insurance; IBA: iba",
    "whole": "RBI: reserve bank of india, rbi/; SEBI: securities and exchange board of india, sebi/; CERT-In: cert-in, cert in; NPCI: national payments corporation of india, npci; IRDAI: insurance regulatory and development authority, irda; DPDP: digital personal data protection, dpdp; FIU-IND: financial intelligence unit, fiu; IBA: indian banks' association, indian banks association",
    "analysis": "RBI: reserve bank, rbi; SEBI: sebi, securities and exchange board; CERT-In: cert-in; NPCI: npci, national payments corporation; IRDAI: insurance regulatory, irda, insurer; DPDP: digital personal data, dpdp; FIU-IND: financial intelligence unit, fiu; IBA: indian banks, iba",
}


def source_from(D: Dialect, low: str, where: str) -> str:
    """issuer by a file's name, a whole text or the words of an analysis; low: in lower case."""
    table = [x.split(":") for x in SOURCE_WORDS[where].split(";")]
    return D.case(((D.any_of(low, words(w)), D.text(n.strip())) for n, w in table), "'OTHER'")


def normalised(D: Dialect, x: str) -> str:
    """one kind of line break and blank, no ligatures, no more than one empty line."""
    x = f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ', ' ')"
    x = f"replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return D.replace(D.replace(D.replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def script_language(D: Dialect, x: str, of_all: bool) -> str:
    """S2 (share of all characters) or F20 (share of letters of both scripts) of Devanagari."""
    deva, latin = f"length({D.replace(x, '[^ऀ-ॿ]', '')})", f"length({D.replace(x, '[^A-Za-z]', '')})"
    if of_all:
        share = f"(CAST({deva} AS DOUBLE) / greatest(1, length({x})))"
        return f"CASE WHEN {share} > 0.20 THEN 'hi' WHEN {share} > 0.05 THEN 'mixed' ELSE 'en' END"
    return f"CASE WHEN CAST({deva} AS DOUBLE) / greatest(1, {deva} + {latin}) > 0.70 THEN 'hi' WHEN {deva} > 0 AND {latin} > 0 THEN 'mixed' ELSE 'en' END"
