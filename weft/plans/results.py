"""Result envelopes and text renderings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 5
SECRET_KEYS = ("token", "password", "secret", "authorization")


def success(command: str, data, warnings: list[str] = ()) -> dict:
    return {"command": command, "schemaVersion": SCHEMA_VERSION, "success": True, "data": data, "warnings": list(warnings)}


def hide(value):
    """Blanks values under secret keys, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in SECRET_KEYS) else hide(v) for k, v in value.items()}
    return [hide(v) for v in value] if isinstance(value, list) else value


def failure(command: str, error: Exception, details: dict | None = None) -> dict:
    return {"command": command, "schemaVersion": SCHEMA_VERSION, "success": False, "error": {"code": type(error).__name__, "message": str(error), "details": hide(details or {})}, "warnings": []}


def as_json(df: DataFrame) -> DataFrame:
    """(json): one document a row, made where the rows are."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_report(envelope: dict, path: str) -> dict:
    """Writes an envelope to a file and gives a receipt."""
    text = json.dumps(envelope, ensure_ascii=False, indent=2)
    Path(path).write_text(text)
    return {"path": path, "bytes": len(text.encode()), "success": envelope["success"], "warnings": envelope["warnings"]}


def human(rows: list[dict], title: str) -> str:
    lines = [title, "=" * len(title)]
    lines += [f"{i}. " + ", ".join(f"{k}: {v}" for k, v in r.items()) for i, r in enumerate(rows, 1)]
    return "\n".join(lines if rows else [*lines, "nothing found"])
