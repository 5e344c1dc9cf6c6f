"""Who may run: leases on files of a shared folder, run folders, and state that is published under a lease."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any

from folioscope.plans import control

LEASE_VERSION = 1


@contextlib.contextmanager
def _alone(path: Path) -> Iterator[None]:
    """One process at a time looks at a lease and changes it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path.with_name(f".{path.name}.guard"), "a") as guard:
        fcntl.flock(guard, fcntl.LOCK_EX)
        yield


def status(path: Path, now: datetime | None = None) -> tuple[str, dict[str, Any]]:
    """(absent, active, expired or invalid, what the file holds)."""
    if not path.exists():
        return "absent", {}
    try:
        held = json.loads(path.read_text(encoding="utf-8"))
        ends = datetime.fromisoformat(held["expires_at"])
        known = held["version"] == LEASE_VERSION and bool(held["owner_token"]) and ends.tzinfo is not None
    except (ValueError, KeyError, TypeError):
        return "invalid", {}
    if not known:
        return "invalid", held
    return ("active" if (now or datetime.now(UTC)) < ends else "expired"), held


def _write(path: Path, held: dict[str, Any]) -> None:
    fresh = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(fresh, "w", encoding="utf-8") as f:
        json.dump(held, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(fresh, path)


def acquire(path: Path, owner: str, seconds: float, workflow: str, now: datetime | None = None) -> str:
    """acquired, reclaimed-stale, already-owned or busy; an active lease of another owner is never touched."""
    if not owner.strip() or seconds <= 0:
        raise ValueError("a lease needs an owner and a time")
    at = now or datetime.now(UTC)
    with _alone(path):
        was, held = status(path, at)
        if was == "active":
            return "already-owned" if held["owner_token"] == owner else "busy"
        _write(path, {"version": LEASE_VERSION, "workflow_id": workflow, "owner_token": owner, "acquired_at": at.isoformat(), "expires_at": (at + timedelta(seconds=seconds)).isoformat()})
        return "acquired" if was == "absent" else "reclaimed-stale"


def renew(path: Path, owner: str, seconds: float, now: datetime | None = None) -> bool:
    """Whether the owner's active lease was extended; an expired one is not, as another may have begun."""
    at = now or datetime.now(UTC)
    with _alone(path):
        was, held = status(path, at)
        if was != "active" or held["owner_token"] != owner:
            return False
        _write(path, held | {"expires_at": (at + timedelta(seconds=seconds)).isoformat()})
        return True


def release(path: Path, owner: str) -> bool:
    """Whether the owner's lease, active or expired, was given up."""
    with _alone(path):
        if status(path)[1].get("owner_token") != owner:
            return False
        path.unlink()
        return True


def acquire_all(paths: list[Path], owner: str, seconds: float, workflow: str, now: datetime | None = None) -> str:
    """acquired, or busy: then those that were taken for this are given up again, the last first; earlier own leases stay."""
    if not paths or len(set(paths)) != len(paths):
        raise ValueError("lease files must be given, each once")
    taken: list[Path] = []
    try:
        for path in paths:
            got = acquire(path, owner, seconds, workflow, now)
            if got == "busy":
                break
            if got != "already-owned":
                taken.append(path)
        else:
            return "acquired"
    except BaseException:
        for path in reversed(taken):
            release(path, owner)
        raise
    for path in reversed(taken):
        release(path, owner)
    return "busy"


def publish(state: Path, new: dict[str, Any], gate: dict[str, Any], before: dict[str, Any], leases: list[Path], owner: str, now: datetime | None = None) -> list[str]:
    """control.publish under leases: every one must be the owner's and active at the moment the state is replaced."""
    with contextlib.ExitStack() as held:
        for path in sorted(leases):
            held.enter_context(_alone(path))
        found = [status(path, now) for path in leases]
        valid = bool(leases) and all(was == "active" and lease["owner_token"] == owner for was, lease in found)
        return control.publish(state, new, gate | {"lease_valid": valid}, before)


def reserve_run(root: Path, workflow: str, owner: str, now: datetime | None = None, attempts: int = 8) -> Path:
    """A folder of this run alone, named by time and owner; the same owner at the same second gets the one it has."""
    if not re.fullmatch(r"[a-z0-9-]+", workflow) or attempts < 1:
        raise ValueError("a workflow is named by lower-case letters, digits and dashes")
    at = (now or datetime.now(UTC)).astimezone(UTC)
    facts = {"version": 1, "workflow_id": workflow, "owner_token": owner}
    for attempt in range(attempts):
        name = f"{at:%Y%m%dT%H%M%SZ}-{owner}" + (f"-{uuid.uuid4()}" if attempt else "")
        folder = root / workflow / name
        about = folder / "run.json"
        try:
            folder.mkdir(parents=True)
        except FileExistsError:
            if about.exists() and facts.items() <= json.loads(about.read_text(encoding="utf-8")).items():
                return folder
            continue
        _write(about, facts | {"run_id": name, "created_at": at.isoformat()})
        return folder
    raise FileExistsError("no free run folder")
