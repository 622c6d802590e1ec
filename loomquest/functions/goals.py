"""What a goal asks for. A goal is one string on the driver, so these are plain Python."""

from __future__ import annotations

import re

from loomquest.functions import patterns as P

SCOPES = ("quick", "broad", "exhaustive")


def tokens(goal: str | None) -> list[str]:
    """As text.goal_tokens()."""
    return [t for t in dict.fromkeys(re.findall(r"[a-z0-9]{3,}", (goal or "").lower())) if t not in P.STOP_WORDS]


def is_enumerable(goal: str | None) -> bool:
    """Whether the goal asks for a list, word by word."""
    return re.search(P.ENUMERABLE, goal or "") is not None


def entity(goal: str | None) -> str:
    """What the list is of: the goal without its preamble, quantifier and trailer; the whole goal if nothing is left."""
    whole = (goal or "").strip()
    core = whole
    for p in (P.LEAD, P.QUANTIFIER, P.TRAIL):
        core = re.sub(p, "", core)
    return core.strip(" .,-") or whole


def suits_census(goal: str | None) -> bool:
    """Whether a census of mentions answers the goal: a list of some entity of one to eight words, no question and no shopping."""
    if not is_enumerable(goal) or re.search(P.NOT_CENSUS, goal or ""):
        return False
    e = entity(goal)
    return 1 <= len(e.split()) <= 8 and "?" not in e


def scope(goal: str | None, chosen: str | None = None) -> str:
    if chosen in SCOPES:
        return chosen
    return "exhaustive" if suits_census(goal) and re.search(P.EXHAUSTIVE, goal or "") else "quick"


def slug(text: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", "-", (text or "").lower())[:48].strip("-") or "search"


def minutes(queries: int) -> int:
    """Estimate for a quick campaign."""
    return max(1, round(queries * 8 / 60))


def facet_queries(seed: str, n: int = 20, given: list[str] = ()) -> list[str]:
    """Distinct queries (without regard to case), at most n: those given, and the seed's facets where fewer than max(3, n // 2) are given."""

    def clean(q: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"""^[\s\d.)\-*"']+""", "", q).strip().strip("\"'"))

    seed = seed.strip()
    wanted = [clean(q) for q in given]
    if len(wanted) < max(3, n // 2):
        wanted += [clean(f"{seed} {f}") if f else seed for f in P.FACETS]
    first = {}
    for q in wanted:
        if q:
            first.setdefault(q.lower(), q)
    return list(first.values())[:n]
