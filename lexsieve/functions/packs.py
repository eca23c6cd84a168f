"""Rule packs in JSON, read at run time and added to the built-in tables.

A folder of packs holds files {"rules": [...]} under common/, actors/, clause_detection/ and validations/, {"applies_to": [...], "obligation_additions": [...]} under sector_rules/,
and pattern_library.json with {"patterns": [...]}. Files are read in order of their paths. A file that isn't there counts as empty; a rule whose pattern can't be compiled
is left out and named in `skipped`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from . import rules as R

#: No look-around and no backreferences, which DuckDB's and other engines' expressions lack.
_FOREIGN = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


@dataclass
class Pack:
    triggers: list[R.Trigger] = field(default_factory=list)
    negations: list[R.Trigger] = field(default_factory=list)
    actors: list[tuple[float, list[str], str, str, list[str]]] = field(default_factory=list)
    sectors: list[R.Sector] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    validations: list[dict] = field(default_factory=list)
    clause_rules: list[dict] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def active_patterns(self, kind: str | None = None, regulator: str | None = None) -> list[dict]:
        """Approved and candidate patterns, of one type and for one regulator (or any) if asked."""
        return [p for p in self.patterns if p.get("status") in ("approved", "candidate") and kind in (None, p.get("pattern_type")) and (regulator is None or p.get("regulator") in (regulator, "ANY"))]


def read_json(path: Path) -> dict:
    """A JSON object; {} if the file is missing or holds none."""
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def usable(pattern: str) -> str | None:
    """Why a pattern can't be used, or None."""
    if not pattern:
        return "no pattern"
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return "look-around or backreference" if _FOREIGN.search(pattern) else None


def _good(rules: list[dict], pack: Pack) -> Iterator[dict]:
    for r in rules:
        why = usable(r.get("pattern", ""))
        if why:
            pack.skipped.append(f"{r.get('id')}: {why}")
        else:
            yield r | {"pattern": r["pattern"].replace("(?P<", "(?<")}


def load(folder: str | Path) -> Pack:
    root, pack = Path(folder), Pack()
    for kind, into, name in (("trigger_verbs", pack.triggers, "obligation_type"), ("negation_patterns", pack.negations, "effect")):
        for r in _good(read_json(root / "common" / f"{kind}.json").get("rules", []), pack):
            into.append(R.Trigger(str(r["id"]), r.get(name, "mandatory"), float(r.get("weight", 1.0)), r["pattern"], r.get("urgency_override")))
    for path in sorted((root / "actors").glob("*actor_patterns.json")):
        for r in _good(read_json(path).get("rules", []), pack):
            pack.actors.append((float(r.get("weight", 1.0)), list(r.get("applicable_sources") or []), r.get("canonical_actor", "Regulated Entity"), r["pattern"], []))
    for path in sorted((root / "sector_rules").rglob("*.json")):
        found = read_json(path)
        for r in found.get("obligation_additions", []):
            when = r.get("deadline") or {}
            pack.sectors.append(R.Sector(str(r["id"]), r.get("name", ""), r.get("domain", ""), r.get("sub_type", ""), when.get("text", ""), when.get("duration") or "", when.get("urgency", ""), r.get("severity", ""), tuple(r.get("trigger_phrases", [])), tuple(found.get("applies_to", []))))
    pack.patterns = read_json(root / "pattern_library.json").get("patterns", [])
    pack.validations = read_json(root / "validations" / "validation_rules.json").get("rules", [])
    pack.clause_rules = read_json(root / "clause_detection" / "clause_segmentation.json").get("rules", [])
    return pack


@contextmanager
def using(pack: Pack, alone: bool = False) -> Iterator[Pack]:
    """Plans made within have the pack's rules after the built-in ones, or instead of them (alone). A plan keeps the rules that it was made with."""
    kept = (R.triggers, R.actors, R.sectors)
    negations, positive = ([], []) if alone else R.triggers()
    both = ([*negations, *pack.negations], [*positive, *pack.triggers])
    actors, sectors = [*([] if alone else R.actors()), *pack.actors], [*([] if alone else R.sectors()), *pack.sectors]
    R.triggers, R.actors, R.sectors = (lambda: both), (lambda: actors), (lambda: sectors)
    try:
        yield pack
    finally:
        R.triggers, R.actors, R.sectors = kept
