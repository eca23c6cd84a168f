"""Repair of a document's obligations by the findings of validation."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similar import Rows, covered, dedup_repaired, distinct, noted
from .units import squeezed
from .validation import departments_of, validate

#: What an action is rid of, in this order.
LEADING = (
    r"(?:where under|accordingly|however|therefore|thus)\s*,?",
    r"(?:the\s+)?(?:regulated entit(?:y|ies)|reinsurers?|banks?|nbfcs?|insurance compan(?:y|ies))\s",
    r"(?:shall|must|may|(?:is|are) required to)\s",
)
#: Canonical actors: (what must be said, what must not, name); the first counts.
ACTORS = (("reinsurer", "", "FRBs/Reinsurers"), ("frb", "", "FRBs/Reinsurers"), ("nbfc", "", "NBFC"), ("bank", "commercial", "Bank"), ("commercial bank", "", "Commercial Bank"), ("regulatory authority", "", "IRDAI"), ("irda", "", "IRDAI"), ("regulated entity", "", "Regulated Entity"))
NO_OBLIGATION = ("shall be called", "shall be known as", "shall be titled", "is hereby issued", "come into force", "come into effect", "these directions shall", "these amendment directions shall", "these regulations shall", "this circular shall")
EVIDENCE = {"ReportingAudit": ["Submission acknowledgement", "Audit trail or return copy"], "Governance": ["Board note or approval", "Policy record"]}
_DUTY = re.compile(r"\b(?:shall|must|may)\b|within\s+\d+\s+days", re.I)


def plain_action(text: str) -> str:
    """an action without opening words, actor and modal, with its full stop."""
    out = squeezed(text).strip(" ;.")
    for form in LEADING:
        out = re.sub(rf"^\s*{form}\s*", "", out, flags=re.I)
    return out[:1].upper() + out[1:] + "." if out else ""


def plain_actor(text: str) -> str:
    """the canonical name of who is named."""
    low = text.lower()
    return next((name for has, lacks, name in ACTORS if has in low and not (lacks and lacks in low)), text.strip())


def deadline_text(suggested: str | None, source: str) -> str | None:
    """a suggestion that is short, about time and has a digit, else what the source says."""
    s = (suggested or "").strip()
    if s and s.lower() not in ("null", "none", "ongoing", "n/a") and len(s) < 120 and re.search(r"\d", s) and re.search(r"\b(?:within|by|days|months|weeks|years|before|after|from)\b", s, re.I):
        return squeezed(s).strip(" .;")
    found = re.search(r"within\s+\d+\s+(?:days|months|weeks)(?:\s+(?:from|of|after)\s+[^.;]+)?", source, re.I)
    return squeezed(found[0]).strip(" .;") if found else None


def duration(text: str | None) -> str | None:
    found = re.search(r"\b\d+\s+(?:days|months)\b", text or "", re.I)
    return found[0] if found else None


def trigger(text: str) -> str:
    found = re.search(r"(?:if|where|provided that|subject to|in case of)[^.;]+", text, re.I)
    return squeezed(found[0]).strip(" .;") if found else "always"


def references(text: str) -> list[str]:
    return distinct(squeezed(x) for x in re.findall(r"\bpara\s+\d+(?:\([a-z]\))?|\bsection\s+\d+(?:\s*\(\d+\))?", text, re.I))


def evidence(domain: str, text: str) -> list[str]:
    low = text.lower()
    return distinct([*EVIDENCE.get(domain, ["Supporting source clause"]), *(["Annual report extract"] if "annual report" in low else []), *(["Disclosure record"] if "disclosure" in low else [])])


def domain_of(row: dict, suggested: str | None, reason: str) -> str:
    """F57."""
    said = f"{row.get('action') or ''} {row.get('domain') or ''} {suggested or ''} {reason}".lower()
    for name, terms in (("ReportingAudit", ("audit", "disclosure", "report", "return", "statement")), ("Governance", ("board", "approval", "governance", "policy")), ("ReportingAudit", ("premium", "insurance", "reinsur", "claim"))):
        if any(t in said for t in terms):
            return name
    return row.get("domain") or "Other"


def severity_of(row: dict) -> str:
    """high if it is soon or a report, else medium."""
    said = f"{row.get('action') or ''} {row.get('deadline') or ''}".lower()
    return "high" if any(t in said for t in ("within 7 days", "immediately", "forthwith", "urgent", "within 15 days", "within 30 days", "report")) else "medium"


def next_clause(rows: Rows) -> str:
    """one more than the highest clause number."""
    return str(max((int(n) for r in rows if (n := str(r.get("clause_number") or "")).isdigit()), default=0) + 1)


def next_id(section: str, rows: Rows) -> str:
    taken = [int(m[1]) for r in rows if (m := re.match(rf"{re.escape(section)}-OB(\d+)", str(r.get("id") or "")))]
    return f"{section}-OB{max(taken, default=0) + 1}"


def without_tags(notes: str | None, *tags: str) -> str | None:
    """notes without some of their tags."""
    for tag in tags:
        notes = re.sub(rf"\s*\[{re.escape(tag)}(?::[^\]]+|\s*-\s*needs review)?\]", "", notes or "", flags=re.I)
    return squeezed(notes) or None if notes is not None else None


def corrected(row: dict, f: dict) -> tuple[dict, list[str]]:
    """C17: a row with one finding put right, and the fields that changed."""
    field, now = f["field"].split(".")[0], dict(row)
    value, reason = f.get("correct_value") or f.get("current_value"), (f.get("reason") or "").lower()
    if field == "action":
        now["action"] = plain_action(row["action"]) or row["action"]
        now["notes"] = without_tags(row.get("notes"), "action_quality")
    elif field == "actor":
        now["actor"] = plain_actor(value or row["actor"]) or row["actor"]
    elif field == "deadline" and (text := deadline_text(value, row["action"])):
        now |= {"deadline": text, "duration": row.get("duration") or duration(text)}
        if (row.get("urgency") or "ongoing") == "ongoing":
            now["urgency"] = "short_term" if now["duration"] else "triggered"
    elif field == "domain":
        now["domain"] = domain_of(row, f.get("correct_value"), reason)
        if now["domain"] != row.get("domain"):
            now["departments"] = departments_of(now["domain"], None, row["actor"], row["action"])
    elif field == "departments":
        now["departments"] = departments_of(row.get("domain") or "Other", None, row["actor"], row["action"])
    elif field == "severity":
        now["severity"] = severity_of(row)
    elif field == "confidence":
        lower = round(max(0.50, min(0.94, (row.get("confidence") or 0.0) - 0.05)), 4)
        now["confidence"] = round(min(0.94, max(0.50, lower - 0.07)), 4)
    if field in ("actor", "deadline", "domain", "departments", "severity"):
        now["notes"] = without_tags(row.get("notes"), f"{field}_conflict")
    changed = [k for k in ("action", "actor", "deadline", "domain", "departments", "severity", "confidence") if now.get(k) != row.get(k)]
    if changed:
        now["notes"] = noted(now.get("notes"), f"[repaired:{','.join(changed)}]")
    return now, changed


def from_missed(text: str, clause: str, rows: Rows, analysis: dict) -> dict | None:
    """C17: an obligation out of a clause that was missed."""
    if not _DUTY.search(text):
        return None
    actor = plain_actor(str(analysis.get("primary_actor") or "").strip() or text)
    domain, when = domain_of({"action": text, "domain": "Other"}, None, ""), deadline_text(None, text)
    return {
        "id": next_id(clause, rows), "section_id": clause, "clause_number": clause, "actor": actor, "action": plain_action(text), "obligation_type": "mandatory", "trigger": trigger(text), "deadline": when or "ongoing",
        "duration": duration(when), "urgency": "short_term" if when else "ongoing", "domain": domain, "departments": departments_of(domain, None, actor, text), "severity": severity_of({"action": text, "deadline": when}),
        "evidence": evidence(domain, text), "penalty": None, "cross_references": references(text), "confidence": 0.84, "notes": "[repaired:missed_obligation]",
    }


def is_none(row: dict) -> bool:
    low = (row.get("action") or "").strip().lower()
    return not low or any(t in low for t in NO_OBLIGATION) or ("as under" in low and "shall" not in low and "must" not in low)


def parts_of(row: dict) -> Rows:
    """the obligations that one merged action holds."""
    text = squeezed(row["action"]).strip(" ;.")
    many = re.search(r"\(\s*[a-eivxlcdm]+\s*\)|\b[a-e]\)", text, re.I) or (";" in text and len(re.findall(r"\b(?:shall|must|required to)\b", text, re.I)) > 1)
    parts = [plain_action(p) for x in re.split(r"\s*;\s+", text) if (p := re.sub(r"^\s*(?:\([a-z]+\)|[a-z]\)|[ivxlcdm]+\)|\d+\.)\s*", "", x, flags=re.I).strip(" ;."))]
    if not many or len(parts) < 2:
        return [row]
    return [row | {"id": f"{row['id']}-S{n}", "action": p, "confidence": round(max(0.50, row["confidence"] - 0.04 * (n - 1)), 4), "notes": noted(row.get("notes"), "[split:merged_obligation]")} for n, p in enumerate(parts, 1)]


def repair(rows: Rows, findings: dict, analysis: dict | None = None, effective_date: str | None = None, text: str = "") -> dict:
    """Add what was missed, correct what was found, drop what is none, split what was merged, dedup, validate again.

    Findings speak of the obligations that were there before any was added; each acts on what the one before it left.
    """
    analysis, rows = analysis or {}, [dict(r) for r in rows]
    known = {r["id"]: n for n, r in enumerate(rows) if r.get("id")}
    summary: dict[str, list] = {"added": [], "corrected": [], "removed": []}
    for m in findings.get("missed", []):
        raw, clause = (m.get("raw_text") or "").strip(), str(m.get("clause_number") or "").strip()
        if raw and not covered(raw, rows, clause) and (new := from_missed(raw, clause or next_clause(rows), rows, analysis)):
            rows.append(new)
            summary["added"].append(new["id"])
    for f in findings.get("incorrect", []):
        at = known.get(f.get("obligation_id"))
        if at is not None and f.get("field"):
            rows[at], changed = corrected(rows[at], f)
            summary["corrected"] += changed
    kept = [r for r in rows if not is_none(r)]
    summary["removed"] += [r["id"] for r in rows if is_none(r)]
    split: Rows = []
    for r in kept:
        parts = parts_of(r)
        if len(parts) > 1:
            summary["removed"].append(r["id"])
            summary["added"] += [p["id"] for p in parts]
        split += parts
    out = dedup_repaired(split)
    effective_date = effective_date or str(analysis.get("likely_effective_date_text") or "").strip() or findings.get("missing_effective_date")
    again = validate(text or "\n".join(r["action"] for r in out), out, effective_date)
    return {"obligations": out, "effective_date": effective_date, "summary": summary, "validation": again}


def repair_files(spark: SparkSession, extracted: str, validation: str) -> DataFrame:
    """Documents (JSON lines of doc_id, obligations, analysis, effective_date) repaired by the findings of their ids: doc_id, repaired (JSON).

    A document without findings is validated again all the same; one that isn't JSON has a null result.
    """
    rows = spark.read.text(extracted).select(F.get_json_object("value", "$.doc_id").alias("doc_id"), F.col("value").alias("document"))
    found = spark.read.text(validation).select(F.get_json_object("value", "$.doc_id").alias("doc_id"), F.col("value").alias("findings"))

    def run(batches):
        for b in batches:
            out = []
            for doc, findings in zip(b.document, b.findings):
                try:
                    d = json.loads(doc)
                    out.append(json.dumps(repair(d.get("obligations", []), json.loads(findings) if findings else {}, d.get("analysis"), d.get("effective_date"), d.get("text", "")), ensure_ascii=False))
                except (ValueError, KeyError, TypeError):
                    out.append(None)
            yield b[["doc_id"]].assign(repaired=out)

    return rows.join(found, "doc_id", "left").mapInPandas(run, "doc_id string, repaired string")
