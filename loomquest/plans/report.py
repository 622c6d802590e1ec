"""Reports and files of a campaign. Long sections go from the tasks to the files (sources/sink.py); short, ranked tables come to the driver."""

from __future__ import annotations

import json
import textwrap
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.sources import sink
from loomquest.sources.sink import mark

# The files of a campaign, by what they hold.
FILES = {"log": ".jsonl", "json": ".json", "results": ".md", "report": ".report.md", "rounds": ".rounds.jsonl", "done": ".done", "trace": ".log"}
SOURCES_SHOWN, HITS_SHOWN = 12, 8


def paths(folder: str, slug: str) -> dict[str, Path]:
    return {k: Path(folder) / f"{slug}{s}" for k, s in FILES.items()}


def manners(safety: dict) -> str:
    """How hosts were treated, and which of them asked to be left alone."""
    sent, off = safety.get("requests") or {}, safety.get("tripped") or []
    rest = f"stopped asking {', '.join(off)}" if off else "no host had to be dropped"
    return f"Hosts: {len(sent)} asked, {sum(sent.values())} requests, {rest}."


def _table(rows: dict[str, str]) -> list[str]:
    return ["| | |", "|-|-|", *[f"| {k} | {v} |" for k, v in rows.items() if v], ""]


def _numbered(title: str, lines: list[str]) -> list[str]:
    return [f"## {title}", "", *[f"{i}. {x}" for i, x in enumerate(lines, 1)], ""] if lines else []


def _source(s: dict) -> str:
    by = f" ({s['source']})" if s.get("source") else ""
    return f"[{s.get('title') or s.get('url') or 'no title'}]({s.get('url') or ''}){by}"


def report_markdown(c: dict, top: list[dict], n_found: int | None = None) -> str:
    """What was asked, on what the answer rests, the answer, its findings and its best sources. n_found: how many findings there are where the mark of their section stands for
    them."""
    r = c["report"]
    pages = f"{c['n_deep_read']} pages, {c.get('n_discovered') or 0} of them by links" if c.get("n_deep_read") else ""
    facts = _table({"Campaign": c["slug"], "Model": c["engine"], "Rests on": f"{c['n_facts']} facts of {c['n_queries']} queries", "Read": pages, "Confidence": f"{round(100 * r.get('confidence', 0))} of 100"})
    found = r.get("key_findings") or []
    if n_found:
        found_lines = [f"## Items: {n_found}", "", mark("found")]
    else:
        found_lines = _numbered(f"Items: {len(found)}" if r.get("enumerated") else "Findings", found)
    body = [*found_lines, *_numbered("Still open", r.get("open_questions") or []), *_numbered("Best sources", [_source(s) for s in top[:SOURCES_SHOWN]])]
    return "\n".join([f"# {c['goal'] or c['slug']}", "", r.get("answer", ""), "", *facts, *body, manners(c.get("safety") or {}), ""])


def results_markdown(c: dict) -> str:
    """The frame of the page of results: query by query digest, facts and first hits, then facts that pages gave, where the marks of their sections stand."""
    lines = [f"# Harvest of {c['slug']}", "", *_table({"Goal": c["goal"], "Model": c["engine"], "Backends": ", ".join(c["backends"]), "Queries": str(c["n_queries"]), "Sources": str(c["n_sources"]), "Facts": str(c["n_facts"])})]
    return "\n".join([*lines, mark("records"), *(["## Facts", "", mark("facts"), ""] if c["n_facts"] else [])])


def lines_of(section: str, n: int, value) -> str:
    """How a value of a section is shown in Markdown."""
    if section == "records":
        r = value
        head = [f"## {r['query']}", "", f"Hits: {r.get('n_results') or 0}. " + (f"Failed: {r['error']}" if r.get("error") else (r.get("digest") or {}).get("summary") or ""), ""]
        return "\n".join([*head, *[f"* {_source(h)}" for h in (r.get("results") or [])[:HITS_SHOWN]], "", ""])
    return f"{n}. {value['fact']} <{value['query']}>\n" if section == "facts" else f"{n}. {value}\n"


class Written(dict):
    """A corpus as its file has it: what is at hand, and the rest of the file when it is asked for."""

    def __init__(self, head: dict, path: Path):
        super().__init__(head)
        self.path = path

    def __missing__(self, key):
        for k, v in json.loads(self.path.read_text(encoding="utf-8")).items():
            self.setdefault(k, v)
        return self[key] if key in self else None


def add_round(folder: str, slug: str, record: dict) -> None:
    """One line per round of a census, as soon as it is over; apart from the log of queries, which only quick campaigns resume from."""
    p = paths(folder, slug)["rounds"]
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")


def values(section: str, rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """A section's rows for write(): value, any type, in the order of up to three numbers."""
    keys = [F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(order)] + [F.lit(0).cast("long").alias(f"k{i}") for i in range(len(order), 3)]
    kind = rows.select(value.alias("v")).schema["v"].dataType.typeName()
    shown = F.to_json(value, {"ignoreNullFields": "false"}) if kind in ("struct", "array", "map") else F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', "$1")
    return rows.select(F.lit(section).alias("section"), *keys, shown.alias("value"))


def write(folder: str, c: dict, sections: list[DataFrame], top: list[dict], n_found: int | None = None) -> Written:
    """Writes corpus, results and report. c is the corpus with marks where sections, made by values(), stand; they go from the tasks to the files, by ranges of their order. n_found:
    how many findings the report's section found holds, where it has one."""
    p = paths(folder, c["slug"])
    p["json"].parent.mkdir(parents=True, exist_ok=True)
    targets = [{"path": str(p["json"].absolute()), "text": json.dumps(c, ensure_ascii=False, indent=2), "form": "json"}, {"path": str(p["results"].absolute()), "text": results_markdown(c), "form": "lines_of"}]
    if c.get("report"):
        targets.append({"path": str(p["report"].absolute()), "text": report_markdown(c, top, n_found), "form": "lines_of"})
    sink.write(reduce(DataFrame.unionByName, sections), ["k0", "k1", "k2"], targets, str(Path(folder).absolute()), __name__)
    return Written({k: v for k, v in c.items() if not (isinstance(v, str) and v == mark(k))}, p["json"])


def mark_done(folder: str, slug: str, error: BaseException | None = None) -> None:
    """The marker that a campaign is over, however it ended."""
    p = paths(folder, slug)["done"]
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("done\n" if error is None else f"failed: {type(error).__name__}: {error}\n", encoding="utf-8")


def spoken(c: dict, top: list[dict]) -> str:
    """What the command line prints."""
    fill = lambda t, n=0: textwrap.fill(t or "", 90, subsequent_indent=" " * n)
    out = [f"{c['slug']}: {c['n_facts']} facts and {c['n_sources']} sources from {c['n_queries']} queries. {manners(c.get('safety') or {})}"]
    if r := c.get("report"):
        out += ["", fill(r.get("answer")), f"(confidence {round(100 * r.get('confidence', 0))} of 100)"]
        for title, values in (("Found", (r.get("key_findings") or [])[:8]), ("Still open", (r.get("open_questions") or [])[:5])):
            out += ["", title, *[f"  * {fill(v, 4)}" for v in values]] if values else []
        out += ["", "Sources", *[f"  {s.get('url') or ''}" for s in top[:8]]]
    return "\n".join(out)
