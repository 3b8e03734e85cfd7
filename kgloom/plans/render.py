"""Texts made from graph results: contexts, their summaries, trees, charts, documents. Each is one report, so it is put together on the driver
from rows that a stated limit bounds."""

from __future__ import annotations

import json

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import catalogs, graph, paths

#: Characters of a context, and lines of a list in a report.
MOST_CHARS, MOST_LINES = 256_000, 500
#: Sections of a context.
SUBJECT, USED_BY, USES, NEARBY = "Subject", "Used by", "Uses", "Nearby"


@dataclass
class Context:
    text: str
    citations: list[str] = field(default_factory=list)


def peers(edges: DataFrame, nodes: DataFrame, origin: str) -> DataFrame:
    """side (in, out), id, canonical_name, type, confidence of the origin's own edges, by the peer's score: nodes are id, canonical_name,
    score. Peers that aren't among nodes have no name."""
    near = edges.where((F.col("from_id") == origin) != (F.col("to_id") == origin))
    side = F.when(F.col("to_id") == origin, "in").otherwise("out")
    peer = F.when(F.col("to_id") == origin, F.col("from_id")).otherwise(F.col("to_id"))
    rows = near.select(side.alias("side"), peer.alias("id"), "type", "confidence").join(nodes.select("id", "canonical_name", "score"), "id",
        "left")
    return rows.orderBy("side", F.desc_nulls_last("score"), "id", "type")


def context(entities: DataFrame, edges: DataFrame, nodes: DataFrame, origin: str, limit: int = MOST_CHARS) -> Context:
    """What is known of the origin, as sections of lines: the entity with its sub-type, stage and properties, who uses it, what it uses
    (by the peer's score), and the other relevant nodes (nodes: node, score). At most so many characters, cut at a line; all
    nodes named are cited."""
    me = entities.where(F.col("id") == origin).first()
    if me is None:
        raise LookupError(origin)
    own = me.asDict()
    named = nodes.select(F.col("node").alias("id"), "score").join(entities, "id", "left").select("id", "canonical_name", "namespace", "type",
        "score")
    stage = own.get("lifecycle_stage") or ("ACTIVE" if own["is_active"] else "DELETED")
    kind = f"{own['type']}/{own['sub_type']}" if own.get("sub_type") else own["type"]
    lines = [f"### {SUBJECT}", f"{own['canonical_name']} = {origin}", f"{kind}, {stage}, namespace {own['namespace']}, sure {own['confidence']:.2f}"]
    lines += [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(json.loads(own.get("properties") or "{}").items())]
    direct = peers(edges, named, origin).limit(limit // 20).collect()  # a line has more characters than that
    for side, header in (("in", USED_BY), ("out", USES)):
        rows = [f"{r['canonical_name'] or 'unknown'} = {r['id']}, {r['type']} {r['confidence']:.2f}" for r in direct if r["side"] == side]
        lines += ["", f"### {header}", *rows] if rows else []
    scored = named.orderBy(F.desc("score"), "id").limit(catalogs.RELEVANCE_NODES).collect()
    known = {r["id"] for r in direct}
    rest = [f"{r['canonical_name']} = {r['id']}, {r['type']} in {r['namespace']}, {r['score']:.2f}" for r in scored if r["id"] not in known]
    lines += ["", f"### {NEARBY}", *rest] if rest else []
    text = "\n".join(lines)
    if len(text) > limit:
        text = text[:limit].rpartition("\n")[0] + "\n(cut)"
    return Context(text, [origin, *(r["id"] for r in scored)])


def summaries(contexts: DataFrame) -> DataFrame:
    """contexts (a column context) with subject (its first line), and how many lines the other sections have: used_by, uses, nearby."""
    c = F.col("context")
    lines = lambda header: F.coalesce(F.size(F.split(fn.section(c, header), "\n")), F.lit(0))
    return contexts.withColumns({"subject": F.split(fn.section(c, SUBJECT), "\n")[0], "used_by": lines(USED_BY), "uses": lines(USES), "nearby": lines(
        NEARBY)})


def mermaid(edges: DataFrame, limit: int = MOST_LINES) -> str:
    """A flow chart of the edges (a report: at most limit lines)."""
    safe = lambda c: fn.diagram_id(F.col(c))
    rows = edges.orderBy("from_id", "to_id", "type").limit(limit).select(
        F.concat(F.lit("  "), safe("from_id"), F.lit(" -->|"), "type", F.lit("| "), safe("to_id")).alias("t")).collect()
    return "\n".join(["graph LR", *(r["t"] for r in rows)])


def tree_text(entities: DataFrame, edges: DataFrame, depth: int = 4, limit: int = MOST_LINES) -> str:
    """The trees below all roots, indented, a node that meets itself marked as a cycle (at most limit lines)."""
    found = paths.trees(edges, graph.roots(entities, edges), depth)
    names = entities.select(F.col("id").alias("node"), "canonical_name", "type")
    rows = found.join(names, "node").orderBy(F.array_join("path", "\x01"), "via").limit(limit).select("level", "via", "canonical_name",
        "type", "cycle").collect()
    return "\n".join(
        "    " * r["level"] + (f"({r['via']}) → " if r["level"] else "") + f"[{r['canonical_name']}] ({r['type']})" + (
            " [CYCLE]" if r["cycle"] else "") for r in rows)


def blueprint(entities: DataFrame, edges: DataFrame, accesses: DataFrame, namespace: str) -> str:
    """A document of one namespace: numbers, entry points, orphans, the central nodes, tables with who uses them, a chart."""
    own = entities.where(F.col("namespace") == namespace)
    inside = graph.within(entities, edges, namespace)
    lines = lambda df, form: [form(r) for r in df.limit(MOST_LINES).collect()]
    n = own.agg(F.count_if(F.col("type") == "SERVICE").alias("s"), F.count_if(F.col("type") == "DATABASE_TABLE").alias("t"),
        F.count("*").alias("n")).first()
    used = graph.readers_writers(accesses.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi"))
    return "\n".join([
        f"# {namespace}", "", f"{n['s']} services, {n['t']} tables, {n['n']} entities.", "", "## Entry points", "", *lines(graph.entry_points(own, inside).orderBy("id"), lambda r: f"- {r['id']}"),
        "", "## Orphans", "", *lines(graph.orphans(own, inside).orderBy("id"), lambda r: f"- {r['id']}"), "", "## Central", "", "| Node | Degree |", "|---|---|", *lines(graph.central(inside, own), lambda r: f"| {r['id']} | {r['degree']} |"),
        "", "## Tables", "", "| Table | Readers | Writers |", "|---|---|---|", *lines(used.orderBy("table_id"), lambda r: f"| {r['table_id']} | {', '.join(r['readers'])} | {', '.join(r['writers'])} |"), "", "```mermaid", mermaid(inside), "```",
    ])


def change_comment(files: DataFrame, entities: DataFrame, edges: DataFrame, smells: DataFrame, depth: int = 3) -> str:
    """A comment on a change: of each file (path) the entity it holds, whom it affects and the risk, and the smells that it touches.

    entities: id, type, name, canonical_name, file, start_line, end_line."""
    places = files.select("path", F.lit(None).cast("int").alias("line"))
    found = graph.resolve_locations(places, entities)
    hit = graph.blast_radius(edges, found.select(F.col("entity_id").alias("origin")).distinct(), depth)
    counts = hit.groupBy("origin").agg(F.count("*").alias("n"))
    names = graph.affected_names(hit, entities)
    n = F.coalesce("n", F.lit(0))
    shown = found.join(entities.select(F.col("id").alias("entity_id"), "canonical_name", "type"), "entity_id").withColumnRenamed("entity_id",
        "origin")
    rows = shown.join(counts, "origin", "left").join(names, "origin", "left").select("path", "canonical_name", "type",
        F.coalesce("names", F.lit("None")).alias("names"), graph.change_risk(n).alias("risk")).orderBy("path").limit(MOST_LINES).collect()
    touched = graph.smells_of(smells, shown.select(F.col("canonical_name").alias("name"))).orderBy("smell", "subject").limit(
        MOST_LINES).collect() if rows else []
    out = ["## Change impact", ""]
    out += ["| File | Entity | Affected | Risk |", "|---|---|---|---|",
        *(f"| `{r['path']}` | `{r['canonical_name']}` ({r['type']}) | {r['names']} | {r['risk']} |" for r in rows)] if rows else [
        "No entity affected."]
    out += ["", "### Smells", *(f"- {r['severity']} **{r['smell']}**: {r['subject']}" for r in touched)] if touched else ["",
        "No smells in what changed."]
    return "\n".join(out)
