"""Source-file scans with the text reader and SQL functions: files become lines, lines become records.

All scans give (entities, relationships): entities (type, sub_type, name, path, line, confidence), relationships
(type, from_name, to_name, confidence). Imports keep only targets that the same scan has seen.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import clean_path

# Directories that no scan enters.
IGNORED = [".git", "vendor", "node_modules", ".idea", ".vscode"]

ENTITY = ["type", "sub_type", "name", "path", "line", "confidence"]


def files(spark: SparkSession, root: str, pattern: str, ignored: list[str] | None = None) -> DataFrame:
    """path (relative) and text of the files whose name matches the glob."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    path = lambda c: F.substring_index(c, base, -1).alias("path")
    full = raw.select(path("path"), F.col("content").cast("string").alias("text"))
    # readers leave out empty files, which still are modules; the listing has them
    listed = spark.createDataFrame([(unquote(x),) for x in raw.inputFiles()], "full string").select(path("full"))
    full = listed.join(full, "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"))
    inside = "(^|/)(" + "|".join(x.replace(".", "\\.") for x in (ignored or IGNORED)) + ")/"
    return full.where(~F.col("path").rlike(inside))


def lines(found: DataFrame) -> DataFrame:
    return found.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"),
        "text")


def _entity(df: DataFrame, kind: str, sub: str, name: Column, confidence: float, line: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.lit(sub).alias("sub_type"), name.alias("name"), "path",
        (line if line is not None else F.lit(None).cast("int")).alias("line"), F.lit(confidence).alias("confidence"))


def _edges(df: DataFrame, kind: str, source: Column, target: Column, confidence: float) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), source.alias("from_name"), target.alias("to_name"), F.lit(confidence).alias("confidence"))


def python_module(path: Column) -> Column:
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def scan_python(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return python_records(files(spark, root, "*.py"))


def python_records(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules, top-level functions and classes of files (path, text); imports among them, and each member's module."""
    module = python_module(F.col("path"))
    rows = lines(found).withColumn("module", python_module(F.col("path")))
    define = F.regexp_extract("text", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", 1)
    klass = F.regexp_extract("text", r"^class\s+([A-Za-z_]\w*)", 1)
    own = lambda x: F.concat_ws(".", "module", x)
    entities = _entity(found, "MODULE", "python_module", module, 0.95).unionByName(
        _entity(rows.where(define != ""), "FUNCTION", "python_function", own(define), 0.95, F.col("line"))).unionByName(
        _entity(rows.where(klass != ""), "CLASS", "python_class", own(klass), 0.95, F.col("line")))
    plain, origin, names = F.regexp_extract("text", r"^\s*import\s+([\w., ]+)", 1), F.regexp_extract("text",
        r"^\s*from\s+([\w.]+)\s+import\s+", 1), F.regexp_extract("text", r"^\s*from\s+[\w.]+\s+import\s+\(?([\w*, ]+)", 1)
    first = lambda x: F.transform(F.split(x, ","), lambda n: F.split_part(F.trim(n), F.lit(" "), F.lit(1)))
    targets = F.when(plain != "", first(plain)).when(origin != "",
        F.array_union(F.transform(first(names), lambda n: F.concat_ws(".", origin, n)), F.array(origin)))
    wanted = rows.select("module", F.explode(targets).alias("target")).distinct()
    known = found.select(module.alias("target")).distinct()
    imports = _edges(wanted.join(known, "target").where("module <> target"), "IMPORTS", F.col("module"), F.col("target"), 0.99)
    members = entities.where("type <> 'MODULE'").select("name", python_module(F.col("path")).alias("module"))
    return entities, imports.unionByName(_edges(members, "DEPENDS_ON", F.col("name"), F.col("module"), 0.99))


def scan_typescript(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return typescript_records(files(spark, root, "*.{ts,tsx,js,jsx}"))


def typescript_records(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules and functions of files (path, text) that are neither declarations nor tests; imports by relative paths, and each function's
    module."""
    found = every.where(~F.col("path").rlike(r"\.d\.ts$|\.test\.|\.spec\."))
    module = F.regexp_replace("path", r"\.(tsx?|jsx?)$", "")
    rows = lines(found).withColumn("module", module)
    named = F.regexp_extract("text", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", 1)
    arrow = F.regexp_extract("text", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>",
        1)
    name = F.when(named != "", named).otherwise(arrow)
    entities = _entity(found, "MODULE", "ts_module", module, 0.95).unionByName(
        _entity(rows.where(name != ""), "FUNCTION", "ts_function", F.concat("module", F.lit("."), name), 0.95, F.col("line")))
    asked = F.coalesce(
        *[
            F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")])
    folder = F.when(F.instr("module", "/") > 0, F.regexp_replace("module", "/[^/]*$", "")).otherwise(F.lit(""))
    joined = F.when(folder == "", asked).otherwise(F.concat(folder, F.lit("/"), asked))
    target = F.regexp_replace(clean_path(joined), r"\.(tsx?|jsx?)$", "")
    wanted = rows.where(asked.startswith(".")).select("module", target.alias("target")).distinct()
    known = found.select(module.alias("file")).distinct().select("file", F.regexp_replace("file", "/index$", "").alias("folder"))
    names = known.select("file", F.col("file").alias("target")).unionByName(known.select("file", F.col("folder").alias("target"))).distinct()
    hits = wanted.join(names, "target").where("module <> file")
    members = entities.where("type = 'FUNCTION'").select("name", F.regexp_replace("path", r"\.(tsx?|jsx?)$", "").alias("module")).distinct()
    imports = _edges(hits, "IMPORTS", F.col("module"), F.col("file"), 0.99).distinct()
    return entities, imports.unionByName(_edges(members, "DEPENDS_ON", F.col("name"), F.col("module"), 0.99))


def scan_go(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A package per directory, named by the nearest module file above it; top-level functions; imports of seen packages."""
    return go_records(files(spark, root, "*.go"), files(spark, root, "go.mod"))


def go_records(every: DataFrame, module_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = every.where(~F.col("path").endswith("_test.go"))
    folder = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    mods = module_files.select(folder("path").alias("base"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module")).where(
        "module <> ''")
    dirs = found.select(folder("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir",
        F.explode(
            F.concat(F.array(F.lit("")),
                F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias(
            "base")).distinct()
    near = above.join(mods, "base").groupBy("dir").agg(F.max_by(F.struct("base", "module"), F.length("base")).alias("m"))
    rest = F.regexp_replace(F.expr("substring(dir, length(m.base) + 1)"), "^/", "")
    named = dirs.join(near, "dir", "left").select("dir",
        F.coalesce(F.when(rest == "", F.col("m.module")).otherwise(F.concat("m.module", F.lit("/"), rest)), F.col("dir")).alias("package"))
    rows = lines(found).withColumn("dir", folder("path")).join(named, "dir")
    fname = F.regexp_extract("text", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", 1)
    functions = rows.where(fname != "")
    entities = _entity(named.withColumn("path", F.col("dir")), "MODULE", "go_package", F.col("package"), 0.95).unionByName(
        _entity(functions, "FUNCTION", "go_function", F.concat("package", F.lit("."), fname), 0.95, F.col("line")))
    target = F.regexp_extract("text", r'^\s*(?:import\s+)?(?:[A-Za-z_.]\w*\s+)?"([^"]+)"\s*$', 1)
    wanted = rows.select("package", target.alias("target")).where("target <> ''").distinct()
    imports = wanted.join(named.select(F.col("package").alias("target")), "target").where("package <> target")
    depends = _edges(functions, "DEPENDS_ON", F.concat("package", F.lit("."), fname), F.col("package"), 0.99).distinct()
    return entities, _edges(imports, "IMPORTS", F.col("package"), F.col("target"), 0.99).unionByName(depends)


# Fixed values.
VERBS = ["get", "put", "post", "delete", "options", "head", "patch"]


def scan_openapi(spark: SparkSession, root: str) -> DataFrame:
    """Endpoints (METHOD path) of JSON and YAML interface descriptions."""
    return openapi_records(files(spark, root, "*.{json,yaml,yml}"))


def openapi_records(found: DataFrame) -> DataFrame:
    is_spec = F.col("path").rlike(r"(^|/)openapi\.(json|ya?ml)$|\.openapi\.(json|ya?ml)$")
    as_json = found.where(is_spec & F.col("path").endswith(".json"))
    paths = as_json.select("path", F.from_json(F.get_json_object("text", "$.paths"), "map<string, map<string, string>>").alias("m"))
    one = paths.select("path", F.explode("m").alias("route", "verbs")).select("path", "route", F.explode(F.map_keys("verbs")).alias("verb"))
    as_yaml = lines(found.where(is_spec & ~F.col("path").endswith(".json")))
    indent = F.length(F.regexp_extract("text", "^( *)", 1))
    marked = as_yaml.where("trim(text) <> '' AND NOT text RLIKE '^ *#'").select("path", "line", indent.alias("i"),
        F.rtrim("text").alias("text"))
    seq = F.array_sort(F.collect_list(F.struct("line", "i", "text")))
    # one description is one row: its lines are walked in order with the state (in paths, route, routes' depth)
    start = "named_struct('on', false, 'route', '', 'deep', -1, 'out', array(''))"
    step = (
        "(a, x) -> CASE WHEN x.i = 0 THEN named_struct('on', x.text RLIKE '^paths *:', 'route', '', 'deep', -1, 'out', a.out) "
        "WHEN a.on AND (a.deep < 0 OR x.i <= a.deep) THEN named_struct('on', true, 'route', regexp_extract(x.text, '^ *[\"\\']?([^\"\\':]+)[\"\\']? *:', 1), 'deep', x.i, 'out', a.out) "
        "WHEN a.on AND x.text RLIKE '^ *(get|put|post|delete|options|head|patch) *:' THEN named_struct('on', true, 'route', a.route, 'deep', a.deep, 'out', concat(a.out, array(concat(regexp_extract(x.text, '^ *([a-z]+)', 1), ' ', a.route)))) ELSE a END"
    )
    walked = marked.groupBy("path").agg(seq.alias("rows")).select("path",
        F.expr(f"aggregate(rows, {start}, {step}, a -> slice(a.out, 2, greatest(size(a.out) - 1, 0)))").alias("found"))
    two = walked.select("path", F.explode("found").alias("x")).select("path", F.regexp_replace("x", "^[a-z]+ ", "").alias("route"),
        F.split_part("x", F.lit(" "), F.lit(1)).alias("verb"))
    every = one.unionByName(two).where(F.col("verb").isin(VERBS))
    return every.select(F.lit("API_ENDPOINT").alias("type"), F.concat_ws(" ", F.upper("verb"), "route").alias("name"), "path",
        F.lit(0.95).alias("confidence")).distinct()
