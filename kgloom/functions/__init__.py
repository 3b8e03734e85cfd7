"""Column functions: names, ids, JSON properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """Lower-case kebab form: blanks and underscores become hyphens, camel humps are split, runs of hyphens collapse."""
    dashed = F.regexp_replace(F.translate(name, "_ ", "--"), "([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(dashed), "-+", "-"), "^-+|-+$", "")


def _digest(prefix: str, glue: str, length: int, *parts: Column) -> Column:
    text = F.concat_ws(glue, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.coalesce(F.sha2(text, 256), F.lit("")), 1, length))  # never null, as can be seen now


def observed_entity_id(source_type: Column, source_id: Column, kind: Column, name: Column, namespace: Column) -> Column:
    return _digest("ent_", "\x1f", 32, source_type, source_id, kind, name, namespace)


def observed_relationship_id(kind: Column, from_id: Column, to_id: Column, source_type: Column) -> Column:
    return _digest("rel_", "\x1f", 32, kind, from_id, to_id, source_type)


def stored_entity_id(kind: Column, name: Column, namespace: Column) -> Column:
    return _digest("ent_", "|", 24, kind, name, namespace)


def stored_relationship_id(kind: Column, from_id: Column, to_id: Column) -> Column:
    return _digest("rel_", "|", 24, kind, from_id, to_id)


def pipeline_relationship_id(kind: Column, from_id: Column, to_id: Column, source_type: Column) -> Column:
    source = F.when(F.coalesce(source_type, F.lit("")) == "", "inferred").otherwise(source_type)
    return _digest("rel_", "|", 24, kind, from_id, to_id, source)


def json_string(text: Column) -> Column:
    """A text as a JSON string, quoted and escaped."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def json_text(properties: Column, key: str) -> Column:
    """A property as text; null and empty are null."""
    return F.nullif(F.get_json_object(properties, f"$.{key}"), F.lit(""))


def owner_team(properties: Column) -> Column:
    """The owning team, or else the owner."""
    return F.coalesce(json_text(properties, "owner_team"), json_text(properties, "owner"))


def json_list(properties: Column, key: str) -> Column:
    """A property that is a list of texts, joined by blanks; of another kind, its text."""
    raw = F.get_json_object(properties, f"$.{key}")
    return F.coalesce(F.array_join(F.from_json(raw, "array<string>"), " "), F.nullif(raw, F.lit("")))


def json_true(properties: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(properties, f"$.{key}") == "true", F.lit(False))


def diagram_id(name: Column) -> Column:
    """A node id that a diagram accepts."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def quoted_hint(question: Column) -> Column:
    """The first non-empty text between backquotes, else between double quotes."""
    back = F.nullif(F.trim(F.regexp_extract(question, "`([^`]*)`", 1)), F.lit(""))
    return F.coalesce(back, F.nullif(F.trim(F.regexp_extract(question, '"([^"]*)"', 1)), F.lit("")))


def json_canonical(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    """JSON in one form for equal values: keys sorted at every level, 1.0 as 1; null, empty and {} are equal. Top keys in ignored don't
    count."""
    made = F.to_json(F.try_parse_json(text))
    if ignored:
        own = F.from_json(text, "map<string,variant>")
        kept = F.transform_values(F.map_filter(own, lambda k, v: ~k.isin(*ignored)), lambda k, v: F.to_json(v))
        made = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))
    return F.nullif(F.coalesce(made, text), F.lit("{}"))


def append_absent(known: Column, new: Column) -> Column:
    """The known elements, and behind them the new ones that are not among them, each once and in their order."""
    return F.concat(known, F.array_distinct(F.filter(new, lambda x: ~F.array_contains(known, x))))


def fenced(text: Column, kind: str) -> Column:
    """What stands in the first fenced block of that kind; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s)```{kind}\\s(.*?)```", 1), F.lit(" \n\t\r")), F.lit(""))


def section(text: Column, header: str) -> Column:
    """The text below a header line of ### up to the next such header; null without it."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in header)
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s)### {quoted}\n(.*?)(?=\n### |\\z)", 1), F.lit(" \n\t\r")), F.lit(""))


def clean_path(path: Column) -> Column:
    """A slash path without empty, dot and dot-dot parts; leading dot-dots stay."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a: (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != "..")
    step = lambda a, x: F.when((x == "..") & up(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
