"""Reports of an audit: text, JSON, SARIF 2.1.0, HTML, the viewer's payload and the rule documents.

A report is for people and holds one batch of documents; rows are fetched document by document in the
order of the report, so the driver holds one document's rows at a time (JSON lines and Parquet stay distributed).
"""

from __future__ import annotations

import html
import json
from collections import defaultdict
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .catalogue import BY_ID, CRITERIA, RULES
from .plans.rollup import STATUSES, tally

MARKS = {"pass": "ok", "review": "??", "fail": "!!", "unreadable": "--"}
LEVEL = {"error": "error", "warning": "warning", "info": "note"}
TREE_NODES = 6000
SCHEMAS = "https://json.schemastore.org"


def _documents(r, doc_id: int | None = None):
    """(result, findings, runs, criteria) of each document, by path: one job for all, one document at a time on the driver."""
    rows = r.results if doc_id is None else r.results.where(F.col("doc_id") == doc_id)
    for df, name in ((r.findings, "own_findings"), (r.runs, "own_runs"), (r.criteria, "own_criteria")):
        rows = rows.join(df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns)).alias(name)), "doc_id", "left")
    severities = list(LEVEL)
    for d in rows.orderBy("path").toLocalIterator():
        found, runs, criteria = ([x.asDict(True) for x in d[name] or []] for name in ("own_findings", "own_runs", "own_criteria"))
        found.sort(key=lambda f: (severities.index(f["severity"]), f["page"] or 0, f["rule"], f["message"]))
        yield d, found, sorted(runs, key=lambda x: x["pos"]), sorted(criteria, key=lambda x: (x["framework"], x["cpos"]))


def one_line(d) -> str:
    tail = d["error"] or f"{d['errors']} error(s), {d['warnings']} warning(s)"
    return f"{MARKS[d['verdict']]} {d['verdict']:<10} {d['path']}: {tail}"


def text_report(r, quiet: bool = False, info: bool = True, criteria: bool = False) -> str:
    docs = list(_documents(r)) if not quiet else [(d, [], [], []) for d in r.results.orderBy("path").toLocalIterator()]
    out = []
    for d, found, runs, rows in docs:
        out.append(one_line(d))
        if quiet or len(docs) > 1 and not criteria:
            continue
        for f in found:
            if f["severity"] == "info" and not info:
                continue
            rule = BY_ID[f["rule"]]
            out.append(f"  {f['severity']:<7} {f['rule']}{f' p.{f['page']}' if f['page'] else ''}: {f['message']}" + (f" [{f['evidence']}]" if f["evidence"] else ""))
            std = ", ".join([f"PDF/UA {rule.clause}"] * bool(rule.clause) + [f"WCAG {c}" for c in rule.criteria])
            out.append(f"          {rule.fix}" + (f" ({std})" if std else ""))
        out += [f"  crashed {x['rule']}: {x['reason']}" for x in runs if x["status"] == "crashed"]
        if criteria:
            out += _criteria_lines(rows)
    if len(docs) > 1:
        out += [f"{t['verdict'] or 'all':<10} {t['documents']}" for t in sorted(r.totals.collect(), key=lambda t: (t["verdict"] is None, t["verdict"]))]
    return "\n".join(out) + "\n"


def _criteria_lines(rows: list[dict]) -> list[str]:
    out = []
    for framework in ("pdfua1", "wcag22"):
        mine = [x for x in rows if x["framework"] == framework]
        n = defaultdict(int)
        for x in mine:
            n[x["status"]] += 1
            failing = x["failing"] if len(x["failing"]) <= 6 else [*x["failing"][:6], f"and {len(x['failing']) - 6} more"]
            out.append(f"  {framework} {x['id']:<7} {x['status']:<15} {x['name']}" + (f": {', '.join(failing)}" if failing else "") + (f" ({x['note']})" if x["note"] else ""))
        out.append(f"  {framework}: " + ", ".join(f"{n[s]} {s}" for s in STATUSES if n[s]))
    return out


def as_dict(d, found, runs, rows) -> dict:
    return {
        "path": d["path"], "verdict": d["verdict"], "error": d["error"], "counts": {"error": d["errors"], "warning": d["warnings"], "info": d["info"]},
        "stats": {"pages": d["n_pages"], "tagged": d["has_struct"], "features": d["features"] or {}},
        "findings": [{k: v for k, v in f.items() if k != "doc_id"} for f in found],
        "runs": [{k: v for k, v in x.items() if k not in ("doc_id", "pos")} for x in runs],
        "criteria": {fw: [{k: v for k, v in x.items() if k not in ("doc_id", "framework", "cpos")} for x in rows if x["framework"] == fw] for fw in ("pdfua1", "wcag22")},
    }


def json_report(r) -> str:
    return json.dumps({"tool": {"name": "lectern", "version": __version__}, "generated": datetime.now(timezone.utc).isoformat(), "results": [as_dict(*x) for x in _documents(r)]}, ensure_ascii=False, indent=1)


def write_json_lines(r, path: str) -> None:
    """One JSON document a line, built and written by the executors: for batches of any size."""
    found = r.findings.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in r.findings.columns if c != "doc_id"])).alias("findings"))
    runs = r.runs.groupBy("doc_id").agg(F.collect_list(F.struct("rule", "status", "reason", "findings", "outcome")).alias("runs"))
    r.results.join(found, "doc_id", "left").join(runs, "doc_id", "left").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def sarif_report(r) -> str:
    """SARIF 2.1.0 with the criteria as a taxonomy."""
    wcag = [c for c in CRITERIA if c.framework == "wcag22"]
    rules = [
        {
            "id": x.id, "name": x.title, "shortDescription": {"text": x.title}, "help": {"text": x.fix}, "defaultConfiguration": {"level": LEVEL[x.severity]}, "properties": {"layer": x.layer, "clause": x.clause, "checkpoint": x.checkpoint},
            "relationships": [{"target": {"id": c, "toolComponent": {"name": "WCAG"}}, "kinds": ["relevant"]} for c in x.criteria],
        }
        for x in RULES
    ] + [{"id": "unreadable", "name": "unreadable", "shortDescription": {"text": "The file can be read"}, "defaultConfiguration": {"level": "error"}}]
    place = {x["id"]: i for i, x in enumerate(rules)}
    results = []
    for d, found, _, _ in _documents(r):
        at = {"artifactLocation": {"uri": quote(d["path"])}}
        if d["error"]:
            results.append({"ruleId": "unreadable", "ruleIndex": place["unreadable"], "message": {"text": d["error"]}, "level": "error", "locations": [{"physicalLocation": at}]})
        for f in found:
            logical = [{"fullyQualifiedName": v} for k, v in (f["location"] or {}).items() if k in ("element", "first")]
            where = {"physicalLocation": at} | ({"logicalLocations": logical} if logical else {})
            results.append({"ruleId": f["rule"], "ruleIndex": place[f["rule"]], "kind": "fail", "level": LEVEL[f["severity"]], "message": {"text": f["message"] + (f" ({f['evidence']})" if f["evidence"] else "")}, "locations": [where], "properties": {"page": f["page"], "count": f["count"], "boxes": f["boxes"]}})
    taxa = [{"id": c.id, "name": c.name, "properties": {"level": c.level}} for c in wcag]
    run = {
        "results": results,
        "taxonomies": [{"organization": "W3C", "name": "WCAG", "taxa": taxa, "version": "2.2"}],
        "tool": {"driver": {"rules": rules, "supportedTaxonomies": [{"name": "WCAG"}], "version": __version__, "name": "lectern"}},
    }
    return json.dumps({"runs": [run], "version": "2.1.0", "$schema": f"{SCHEMAS}/sarif-2.1.0.json"}, indent=1, ensure_ascii=False)


def html_report(r) -> str:
    e = lambda x: html.escape("" if x is None else str(x))
    out = ["<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Audit</title><style>body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left;vertical-align:top}.error{color:#a00}.warning{color:#850}</style></head><body><h1>Audit</h1>"]
    for d, found, runs, rows in _documents(r):
        out.append(f"<section><h2>{e(d['path'])}: {e(d['verdict'])}</h2><p>{e(d['error'] or '')} {d['errors']} error(s), {d['warnings']} warning(s), {d['info']} note(s)</p>")
        if found:
            out.append("<table><tr><th>Rule<th>Severity<th>Page<th>Finding<th>Evidence<th>What to do</tr>")
            out += [f"<tr class='{f['severity']}'><td>{f['rule']}<td>{f['severity']}<td>{e(f['page'])}<td>{e(f['message'])}<td>{e(f['evidence'])}<td>{e(BY_ID[f['rule']].fix)}</tr>" for f in found]
            out.append("</table>")
        for fw, title in (("pdfua1", "PDF/UA checkpoints"), ("wcag22", "WCAG 2.2 criteria")):
            mine = [x for x in rows if x["framework"] == fw]
            if mine:
                out.append(f"<h3>{title}</h3><table><tr><th>Id<th>Name<th>Status<th>Rules<th>Note</tr>")
                out += [f"<tr><td>{x['id']}<td>{e(x['name'])}<td>{x['status']}<td>{e(', '.join(x['failing']))}<td>{e(x['note'])}</tr>" for x in mine]
                out.append("</table>")
        out.append("</section>")
    return "\n".join(out) + "</body></html>\n"


def reading_order(facts) -> DataFrame:
    """What a reader announces on each page: alternatives and texts in tree order, then artifacts."""
    from .functions import text as tx

    e = facts.told
    first = F.coalesce(F.col("page"), F.col("box")["page"] - 1)
    alt = F.when(F.col("type").isin("Figure", "Formula", "Link") & ~tx.blank(F.col("alt")), F.col("alt"))
    said = e.select("doc_id", first.alias("page"), "ord", "type", F.coalesce(alt, F.nullif("actual_text", F.lit("")), F.col("own_text")).alias("text"), F.lit(False).alias("artifact"))
    art = facts.runs.where("artifact").select("doc_id", "page", (F.col("run_seq") + (1 << 30)).alias("ord"), F.lit("Artifact").alias("type"), "text", F.lit(True).alias("artifact"))
    return said.unionByName(art).where(~tx.blank(F.col("text")) & F.col("page").isNotNull())


def structure_tree(facts, doc_id: int) -> list[dict]:
    """The tree of one document, nested, at most TREE_NODES nodes of it."""
    rows = facts.el.where(F.col("doc_id") == doc_id).orderBy("ord").limit(TREE_NODES).select("ord", "parent_ord", "type", "type_raw", "alt", "actual_text", "find_page").collect()
    nodes = {x["ord"]: {**x.asDict(), "children": []} for x in rows}
    for n in nodes.values():
        if n["parent_ord"] in nodes:
            nodes[n["parent_ord"]]["children"].append(n)
    return [n for n in nodes.values() if n["parent_ord"] not in nodes]


def viewer_payload(r, doc_id: int) -> dict:
    """Everything a viewer of one document shows."""
    d, found, runs, rows = next(_documents(r, doc_id))
    pages = [x.asDict() for x in r.facts.pages.where(F.col("doc_id") == doc_id).orderBy("page").collect()]
    order = [x.asDict() for x in reading_order(r.facts).where(F.col("doc_id") == doc_id).orderBy("page", "ord").collect()]
    for f in found:
        m = BY_ID[f["rule"]]
        f |= {"title": m.title, "layer": m.layer, "fix": m.fix, "criteria": list(m.criteria), "checkpoint": m.checkpoint}
    return {**as_dict(d, found, runs, rows), "pages": pages, "tree": structure_tree(r.facts, doc_id), "reading_order": order}


def filter_findings(findings: DataFrame, severities=None, located: bool = False, criterion: str | None = None, criteria: DataFrame | None = None) -> DataFrame:
    """The viewer's filters: severities, findings with a place, findings of one criterion's rules."""
    if severities:
        findings = findings.where(F.col("severity").isin(list(severities)))
    if located:
        findings = findings.where(F.size("boxes") > 0)
    if criterion and criteria is not None:
        findings = findings.join(criteria.where(F.col("id") == criterion).select("doc_id", F.explode("rules").alias("rule")).distinct(), ["doc_id", "rule"], "left_semi")
    return findings


def rule_list() -> str:
    return "\n".join(f"{r.id:<9} {r.layer:<11} {r.severity:<7} {r.status:<7} {r.title}" for r in RULES) + "\n"


def rules_document() -> str:
    """Markdown of the catalogue, with indexes by checkpoint and criterion."""
    out, group = ["# Rules", ""], None
    for r in RULES:
        if r.group != group:
            group = r.group
            out += ["", f"## {group}", ""]
        out.append(f"- **{r.id}** ({r.layer}, {r.severity}{', planned' if r.status == 'planned' else ''}): {r.title}. {r.fix}." + (f" PDF/UA {r.clause}." if r.clause else "") + (f" WCAG {', '.join(r.criteria)}." if r.criteria else ""))
    for fw, title in (("pdfua1", "Checkpoints"), ("wcag22", "Criteria")):
        out += ["", f"## {title}", ""]
        for c in (c for c in CRITERIA if c.framework == fw):
            mine = [r.id for r in RULES if (r.checkpoint == c.id if fw == "pdfua1" else c.id in r.criteria)]
            out.append(f"- {c.id} {c.name}: {', '.join(mine) or 'no rule'}")
    return "\n".join(out) + "\n"


__all__ = ["filter_findings", "html_report", "json_report", "reading_order", "rule_list", "rules_document", "sarif_report", "structure_tree", "tally", "text_report", "viewer_payload", "write_json_lines"]
