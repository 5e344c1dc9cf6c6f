"""Control of a run on the driver: scopes, source order, receipts and gated state."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any

RECEIPT_VERSION = 1
#: Conditions that must all be true before a state is published (fixed values).
GATES = ("download_complete", "quality_pass", "import_verified", "index_rebuilt", "no_errors", "lease_valid")


def listed_files(value: Any) -> list[str]:
    """Strings of a nested list of files; in objects those under all_files, files and accounts, else under anything."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [x for v in value for x in listed_files(v)]
    if isinstance(value, dict):
        named = [x for k in ("all_files", "files", "accounts") if k in value for x in listed_files(value[k])]
        return named or [x for v in value.values() for x in listed_files(v)]
    return []


def slug(name: str) -> str:
    """Lower case, word characters, CJK and dashes kept, white space and underscores as one dash, 120 characters."""
    kept = re.sub(r"[^\w\s一-鿿-]", "", name.lower())
    return re.sub(r"[\s_]+", "-", kept.strip())[:120]


def subject_filter(body: str) -> set[str]:
    """Lower-case names and slugs of a JSON list, if the text begins as one, or of lines; a list that cannot be read is an error."""
    text = body.strip()
    names = json.loads(text) if text.startswith("[") else text.splitlines()
    named = [str(x or "").strip() for x in names]
    return {form for n in named if n for form in (n.lower(), slug(n))}


def next_source(local_records: int, public_failed: bool) -> dict[str, Any]:
    """What a refresh does after local records are known, or after the public source failed."""
    if not public_failed:
        return {"action": "continue-public-discovery", "records": max(0, local_records), "source": "public_index"}
    return {"action": "finish-local-partial"} if local_records > 0 else {"action": "probe-complete-source", "source": "complete"}


def account_manifest(accounts: list[dict], usefor: str) -> str:
    return json.dumps({"version": 1, "usefor": usefor, "accounts": accounts}, ensure_ascii=False, indent=2)


def receipt(data: str, sha256: str, subjects: dict, digest: str, summary: dict, quality: dict, hours: float, now: datetime | None = None) -> dict[str, Any]:
    at = now or datetime.now(UTC)
    return {"version": RECEIPT_VERSION, "created_at": at.isoformat(), "expires_at": (at + timedelta(hours=hours)).isoformat(), "data": data, "sha256": sha256, "subjects": subjects, "digest": digest, "summary": summary, "quality": quality}


def receipt_errors(held: dict[str, Any], data: str, sha256: str, subjects: dict, digest: str, summary: dict, quality: dict, now: datetime | None = None) -> list[str]:
    """Names of what differs between a receipt and the run that shows it."""
    want = {"version": RECEIPT_VERSION, "data": data, "sha256": sha256, "subjects": subjects, "digest": digest, "summary": summary, "quality": quality}
    errors = [f"{k}_mismatch" for k, v in want.items() if held.get(k) != v]
    try:
        end = datetime.fromisoformat(str(held.get("expires_at")))
        if end.tzinfo is None:
            raise ValueError("no time zone")
        errors += ["receipt_expired"] * ((now or datetime.now(UTC)) >= end)
    except ValueError:
        errors.append("receipt_expiry_invalid")
    return errors


def snapshot(state: Path) -> dict[str, Any]:
    return {"state": str(state), "sha256": hashlib.sha256(state.read_bytes()).hexdigest() if state.exists() else None}


def publish(state: Path, new: dict[str, Any], gate: dict[str, Any], before: dict[str, Any]) -> list[str]:
    """Put the new state in place if every gate is true and the state is as in the snapshot; else the reasons, and not a byte changes."""
    reasons = [f"gate:{g}" for g in GATES if gate.get(g) is not True]
    if before != snapshot(state):
        reasons.append("state-changed")
    if reasons:
        return reasons
    fd, name = tempfile.mkstemp(dir=state.parent, prefix=f".{state.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(new, f, ensure_ascii=False, indent=2, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, state)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return []
