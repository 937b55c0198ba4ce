"""JSON, tabular text, XML, Markdown and HTML documents of a report.

Each writer takes a ``Report`` and an open text file and streams the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html import escape
from itertools import islice
from typing import TextIO
from xml.sax.saxutils import XMLGenerator

from corpusloom.sinks import payload
from corpusloom.sinks.payload import Report

_BARE = re.compile(r"^[A-Za-z_][A-Za-z0-9_./\-]*$")
_RESERVED = {"true", "false", "null"}
TOON_COLUMNS = "f ft_v ft_c d_v d_c sd l c ep cl cs ps fi fo pr re br".split()


def scalar(x) -> str:
    """One value of the tabular text: bare words as they are, other text quoted, floats to six digits."""
    match x:
        case None:
            return "null"
        case bool():
            return str(x).lower()
        case int():
            return str(x)
        case float():
            return format(x, ".6g")
    s = str(x)
    if _BARE.match(s) and s not in _RESERVED:
        return s
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def nested(x, depth: int = 0) -> str:
    """Indented mapping and list form of small objects."""
    pad = "  " * depth
    if isinstance(x, dict):
        entries = [(scalar(str(k)) + ":", v) for k, v in x.items()]
    elif isinstance(x, (list, tuple)):
        entries = [("-", v) for v in x]
    else:
        return pad + scalar(x)
    if not entries:
        return pad + ("{}" if isinstance(x, dict) else "[]")
    deep = lambda v: isinstance(v, (dict, list, tuple)) and len(v) > 0
    return "\n".join(
        f"{pad}{head}\n{nested(v, depth + 1)}" if deep(v) else f"{pad}{head} {nested(v, 0)}" for head, v in entries
    )


def toon_row(f: dict) -> str:
    values = [
        f["file"], f["file_type"]["value"], f["file_type"]["confidence"], f["domain"]["value"], f["domain"]["confidence"],
        f["secondary_domain"] or "", f["layer"][:1], f["criticality"], f["entrypoint"], f["complexity_label"][:1],
        f["complexity_score"], f["priority_score"], f["fan_in"], f["fan_out"], f["pagerank"], f["refactor_effort"], f["blast_radius"],
    ]
    return " ".join(map(scalar, values))


def toon_detail(f: dict) -> list[str]:
    out = []
    if f["hints"]["description"]:
        out.append("hint: " + scalar(f["hints"]["description"]))
    out += ["warn: " + scalar(w) for w in f["warnings"][:3]]
    out += [f"{k}: " + " ".join(map(scalar, v[:5])) for k, v in f["capabilities"].items() if v]
    return out + [f"score_{k}: {scalar(v)}" for k, v in sorted(f["priority_breakdown"].items())]


def write_toon(r: Report, out: TextIO) -> None:
    for k in ("version", "project", "generated_at"):
        out.write(f"{k}: {scalar(getattr(r, k))}\n")
    out.write("stats:\n" + nested(r.stats, 1) + "\n")
    out.write("files:\n  @columns: " + " ".join(TOON_COLUMNS) + "\n  @rows:\n")
    for f in r.files():
        out.write("    " + toon_row(f) + "\n")
    out.write("  @detail:\n")
    for f in r.files():
        if lines := toon_detail(f):
            out.write(f"  {scalar(f['file'])}:\n" + "".join(f"    {x}\n" for x in lines))
    for k in ("hotspots", "modules", "diagnostics"):
        if getattr(r, k):
            out.write(f"{k}:\n{nested(getattr(r, k), 1)}\n")


def write_json(r: Report, out: TextIO) -> None:
    """One minified object; ``files`` maps paths to records."""
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    head = {k: getattr(r, k) for k in "version project generated_at stats hotspots modules diagnostics instruction git".split()}
    out.write(dump(head)[:-1] + ',"files":{')
    for i, f in enumerate(r.files()):
        out.write("," * bool(i) + dump(f["file"]) + ":" + dump(f))
    out.write('},"dependency_graph":{')
    last = None
    for src, dst in r.edges():
        out.write("," + dump(dst) if src == last else ("]," if last is not None else "") + dump(src) + ":[" + dump(dst))
        last = src
    out.write("]" * (last is not None) + "}}")


class _Xml:
    #: What XML 1.0 cannot hold.
    BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")

    def __init__(self, out: TextIO):
        self.out = XMLGenerator(out, "utf-8", short_empty_elements=True)

    def tag(self, name: str, body: str | Callable[[], None] | None = None, /, **attrs) -> None:
        self.out.startElement(name, {k: self.BAD.sub("", str(v)) for k, v in attrs.items()})
        if callable(body):
            body()
        elif body:
            self.out.characters(self.BAD.sub("", body))
        self.out.endElement(name)
        self.out.ignorableWhitespace("\n")


def write_xml(r: Report, out: TextIO) -> None:
    x = _Xml(out)

    def signals(parts: dict) -> Callable[[], None]:
        return lambda: [x.tag("signal", name=k, value=v) for k, v in sorted(parts.items())]

    def listed(name: str, items) -> Callable[[], None]:
        return lambda: [x.tag(name, str(i)) for i in items]

    def hotspot(h: dict) -> None:
        x.tag(
            "file", lambda: h["score_explanation"] and x.tag("score_explanation", signals(h["score_explanation"])),
            path=h["file"], priority=h["priority_score"], pagerank=f"{h['pagerank']:.4f}", fan_in=h["fan_in"],
            refactor_effort=f"{h['refactor_effort']:.2f}", blast_radius=h["blast_radius"],
        )

    def inner(f: dict) -> None:
        if f["module_doc"]:
            x.tag("module_doc", f["module_doc"])
        if caps := {k: v for k, v in f["capabilities"].items() if v}:
            x.tag("capabilities", lambda: [x.tag(k, ", ".join(v[:20])) for k, v in caps.items()])
        if f["internal_dependencies"]:
            x.tag("dependencies", listed("dep", f["internal_dependencies"][:20]))
        if f["warnings"]:
            x.tag("warnings", listed("warning", f["warnings"][:5]))
        x.tag("score_explanation", signals(f["priority_breakdown"]))
        x.tag("analysis_hints", lambda: (x.tag("description", f["hints"]["description"]), x.tag("keywords", listed("item", f["hints"]["keywords"][:10]))))

    def file(f: dict) -> None:
        x.tag(
            "file", lambda: inner(f), path=f["file"], criticality=f["criticality"], domain=f["domain"]["value"],
            entrypoint=str(f["entrypoint"]).lower(), priority=f["priority_score"], fan_in=f["fan_in"],
        )

    def git() -> None:
        if r.git.get("recent_commits"):
            x.tag("recent_commits", lambda: [x.tag("commit", **{k: c[k] for k in ("hash", "author", "date", "message")}) for c in r.git["recent_commits"]])
        if r.git.get("diff_stat"):
            x.tag("diff_stat", r.git["diff_stat"])
        if changes := r.git.get("change_frequency"):
            top = sorted(changes.items(), key=lambda e: (-e[1], e[0]))[:30]
            x.tag("change_frequency", lambda: [x.tag("file", path=p, changes=n) for p, n in top])

    def root() -> None:
        if r.instruction:
            x.tag("instruction", r.instruction)
        s = r.stats
        x.tag("file_summary", total_files=s["total_files"], critical=s["critical_files"], domains=s["domains"], entrypoints=s["entrypoints"])
        x.tag("hotspots", lambda: [hotspot(h) for h in r.hotspots])
        x.tag("files", lambda: [file(f) and None for f in r.files()] and None)
        if r.git:
            x.tag("git_context", git)
        x.tag("diagnostics", lambda: [x.tag(k, str(v)) for k, v in sorted(r.diagnostics.items())])

    x.out.startDocument()
    x.tag("corpus_report", root, version=r.version, project=r.project, generated_at=r.generated_at)


def top_parts(parts: dict, k: int = 3) -> str:
    best = sorted(parts.items(), key=lambda e: (-abs(e[1]), e[0]))[:k]
    return ", ".join(f"{n}:{v:.1f}" for n, v in best) or "-"


def _classification(f: dict) -> dict:
    return (f["hints"] or {}).get("classification") or {}


def write_markdown(r: Report, out: TextIO) -> None:
    s = r.stats
    lines = [f"# Corpus report: `{r.project}`", f"> {r.generated_at}, version {r.version}", "", "## Overview"]
    lines += [f"- {label}: {s[k]}" for label, k in (("Files", "total_files"), ("Critical", "critical_files"), ("Domains", "domains"), ("Entrypoints", "entrypoints"))]
    lines += ["", "## Hotspots", "| File | Priority | Effort | Blast radius | Domain | Signals |", "|---|---|---|---|---|---|"]
    for h in r.hotspots[:10]:
        lines.append(
            f"| `{h['file']}` | {h['priority_score']} | {h['refactor_effort']:.1f} | {h['blast_radius']} | {h['domain']} | {top_parts(h['score_explanation'])} |"
        )
    lines += ["", "## Warnings"]
    warned = list(islice((f for f in r.files() if f["warnings"]), 20))
    for f in warned:
        lines += [f"### `{f['file']}`", *(f"- {w}" for w in f["warnings"][:3])]
        if evidence := _classification(f).get("domain_evidence"):
            lines.append("- Evidence: " + ", ".join(f"{k}:{v:.1f}" for k, v in list(evidence.items())[:3]))
    out.write("\n".join(lines if warned else [*lines, "None."]) + "\n")


_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px system-ui;margin:2em}}table{{border-collapse:collapse}}td,th{{padding:.2em .7em;border-bottom:1px solid #ccc;text-align:left}}</style>
<h1>{title}</h1><p>{summary}</p><h2>Hotspots</h2>{hot}<h2>Modules</h2>{mods}<h2>Files</h2>
<input id="q" placeholder="filter"><select id="c"><option value="">all<option>critical<option>infra<option>config<option>supporting</select>
<table id="t"><tr><th>File<th>Role<th>Domain<th>Criticality<th>Entrypoint<th>Priority<th>Score<th>Fan-in<th>Blast radius<th>Effort<th>Evidence<th>Warnings</tr>
"""
_SCRIPT = """</table><script>
const q=document.getElementById("q"),c=document.getElementById("c"),go=()=>{for(const r of document.querySelectorAll("#t tr[data-c]"))
r.hidden=!(r.textContent.toLowerCase().includes(q.value.toLowerCase())&&(!c.value||r.dataset.c===c.value))};q.oninput=c.onchange=go;
</script></html>
"""


def _table(rows: list[list]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(str(x))}" for x in r) + "</tr>" for r in rows) + "</table>"


def write_html(r: Report, out: TextIO) -> None:
    s = ", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in r.stats.items())
    hot = _table([[h["file"], h["priority_score"], h["domain"], h["criticality"]] for h in r.dashboard or r.hotspots])
    mods = _table([[m["module"], m["n_files"], m["sample"]] for m in r.module_summary])
    summary = escape(f"{s}; health {r.health.get('health', 1.0):.2f}")
    out.write(_PAGE.format(title=escape(r.project), summary=summary, hot=hot, mods=mods))
    for f in r.files():
        evidence = ", ".join(f"{k}: {v:.1f}" for k, v in list((_classification(f).get("domain_evidence") or {}).items())[:3])
        cells = [
            f["file"], f["role_hint"], f["domain"]["value"], f["criticality"], "yes" if f["entrypoint"] else "", f["priority_score"],
            top_parts(f["priority_breakdown"]), f["fan_in"], f["blast_radius"], f"{f['refactor_effort']:.1f}", evidence, "; ".join(f["warnings"][:3]),
        ]
        out.write(f'<tr data-c="{escape(f["criticality"])}">' + "".join(f"<td>{escape(str(x))}" for x in cells) + "</tr>\n")
    out.write(_SCRIPT)


WRITERS: dict[str, Callable[[Report, TextIO], None]] = {
    "json": write_json, "toon": write_toon, "xml": write_xml, "md": write_markdown, "html": write_html,
}


def write(r: Report, folder: str, formats: list[str], name: str = "corpus_report") -> list[str]:
    """Writes the documents into ``folder`` and returns their paths."""
    out = []
    for fmt in formats:
        payload.validate(payload.sections(r), fmt)
        path = f"{folder}/{name}.{fmt}"
        with open(path, "w", encoding="utf-8") as f:
            WRITERS[fmt](r, f)
        out.append(path)
    return out
