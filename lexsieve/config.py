"""Settings with typed defaults, from the environment or a file of NAME=value lines (S18), and log lines as JSON."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, fields
from datetime import UTC, datetime
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    least_confidence: float = 0.60
    least_discretionary_confidence: float = 0.45
    training_pairs: bool = True
    calls_per_minute: float = 28.0
    provider: str = "offline"
    store: str = "data/structured"
    pairs: str = "data/finetune"


def coerced(value: str, kind: str) -> object:
    """A setting's text as its type; what can't be read raises ValueError."""
    return value.strip().lower() in ("1", "true", "yes", "on") if kind == "bool" else int(value) if kind == "int" else float(value) if kind == "float" else value


def settings(file: str | None = None, environ: dict[str, str] | None = None, prefix: str = "LEXSIEVE_") -> Settings:
    """Defaults, over them the file, over that the environment. Lines without "=" and those that begin with "#" don't count; quotes about a value are dropped."""
    found: dict[str, str] = {}
    for line in Path(file).read_text(encoding="utf-8").splitlines() if file and Path(file).exists() else []:
        name, mark, value = line.strip().partition("=")
        if mark and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
    found |= {k.removeprefix(prefix): v for k, v in (os.environ if environ is None else environ).items() if k.startswith(prefix)}
    return Settings(**{f.name: coerced(found[f.name.upper()], str(f.type)) for f in fields(Settings) if f.name.upper() in found})


class JsonLines(logging.Formatter):
    """One JSON object a line: time (UTC), level, logger, message and what `extra={"data": {...}}` holds."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | getattr(record, "data", {})
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)


def logger(name: str) -> logging.Logger:
    """A logger that writes JSON lines to standard error; asked for again it is the same, with one handler."""
    log = logging.getLogger(name)
    if not any(isinstance(h.formatter, JsonLines) for h in log.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.propagate = False
    return log
