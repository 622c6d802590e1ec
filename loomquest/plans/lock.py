"""One campaign at a time on a machine: the politeness of hosts holds per run, so two runs must not share them."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager
from pathlib import Path

TTL_SECONDS = 45 * 60


def _alive(pid) -> bool:
    try:
        os.kill(int(pid), 0)
    except (ProcessLookupError, TypeError, ValueError):
        return False
    except OSError:
        pass
    return True


def holder(folder: str, ttl: float = TTL_SECONDS) -> dict | None:
    """slug, pid and started of the running campaign. A lock that is too old, unreadable or whose process is gone is removed."""
    p = Path(folder) / ".campaign.lock"
    try:
        held = json.loads(p.read_text(encoding="utf-8"))
    except FileNotFoundError:
        return None
    except (OSError, ValueError):
        held = {}
    if held and time.time() - held.get("started", 0) <= ttl and _alive(held.get("pid")):
        return held
    p.unlink(missing_ok=True)
    return None


class Busy(RuntimeError):
    pass


@contextmanager
def held(folder: str, slug: str):
    """Holds the lock, or raises Busy with the slug that has it."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    if other := holder(folder):
        raise Busy(other.get("slug"))
    p = Path(folder) / ".campaign.lock"
    try:
        with p.open("x", encoding="utf-8") as f:
            json.dump({"slug": slug, "pid": os.getpid(), "started": time.time()}, f)
    except FileExistsError:
        raise Busy(slug) from None
    try:
        yield
    finally:
        p.unlink(missing_ok=True)
