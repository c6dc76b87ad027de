"""Functions paired with their documentation.

Files are parsed where they lie (one pass, no shuffle of their text beyond
picking the current version of each path).  Every function yields its code,
signature and own documentation, every class its bases by full dotted name.
Methods without documentation then look it up among their bases' methods of the
same name, one level of the class hierarchy per round of joins on
(class, method), until nothing is left to look up; methods that find none are
dropped, as are functions whose documentation says nothing.

Defined results: rows without path are ignored; a path's current row has the
greatest (mtime, file_id), a null mtime being least; null content and content
that does not parse yield nothing.  A null module is derived from the path.  A
name defined twice yields a row per definition.  Of several bases the nearest
level wins, then the leftmost base; cycles among bases end the search.  Other
columns are not read.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoweave.plans.tables import drop, keep
from topoweave.sources.files import spread

#: Lines that end a description (fixed values).
SECTIONS = {"Args:", "Arguments:", "Parameters", "Parameters:", "Returns", "Returns:", "Raises", "Raises:", "Yields:", "Examples:"}
TAGS = (":param", ":return", ":raises", ">>>")
#: Openings of a documentation that says nothing yet (fixed values).
PLACEHOLDERS = ("todo", "fixme", "tbd", "xxx")
MIN_WORDS = 4

_WORD = re.compile("[A-Za-z]{2,}")
_SCHEMA = (
    "kind string, module string, path string, qualified_name string, owner string, name string, line int, "
    "signature string, code string, description string, doc_origin string, telling boolean, tags array<string>, bases array<string>"
)


def cut(documentation: str) -> tuple[str, list[str]]:
    """The text before the first tag or section, and the tags and sections from there on."""
    lines = documentation.splitlines()
    marks = [i for i, line in enumerate(lines) if (s := line.strip()) in SECTIONS or s.startswith(TAGS)]
    tags = [lines[i].split()[0].strip(":") for i in marks if not lines[i].strip().startswith(">>>")]
    return "\n".join(lines[: marks[0]] if marks else lines), tags


def tells(description: str, name: str) -> bool:
    """Whether a description says more than the name does."""
    words = {w.lower() for w in _WORD.findall(description)} - set(name.lower().split("_"))
    return len(words) >= MIN_WORDS and not description.strip().lower().startswith(PLACEHOLDERS)


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return node.id if isinstance(node, ast.Name) else None


def _comment_above(lines: list[str], first: int) -> str | None:
    """The unbroken # lines directly above line ``first`` (from 1)."""
    k = first - 1
    while k > 0 and lines[k - 1].lstrip().startswith("#"):
        k -= 1
    above = [x.lstrip()[1:] for x in lines[k : first - 1]]
    return "\n".join(above) if above else None


def definitions(module: str, content: str) -> list[dict]:
    """Functions and classes of one file, in no special order; [] if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    package = module.rpartition(".")[0]
    found, imported, classes = [], {}, {}
    stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
    while stack:
        node, scope, in_class = stack.pop()
        for child in [x for field in ("body", "orelse", "finalbody", "handlers", "cases") for x in _list(node, field)]:
            inner, of_class = scope, in_class
            if isinstance(child, ast.Import):
                imported.update({a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in child.names})
            elif isinstance(child, ast.ImportFrom):
                parts = package.split(".") if package else []
                base = ".".join(parts[: len(parts) - child.level + 1]) if child.level else ""
                base = ".".join(x for x in (base, child.module) if x)
                imported.update({a.asname or a.name: f"{base}.{a.name}" for a in child.names})
            elif isinstance(child, ast.ClassDef):
                inner, of_class = (*scope, child.name), True
                classes[inner] = child
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner, of_class = (*scope, child.name), False
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                doc, origin = ast.get_docstring(child), "docstring"
                if doc is None:
                    doc, origin = _comment_above(lines, first), "comment"
                text, tags = cut(doc) if doc is not None else (None, [])
                ret = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                found.append(
                    {
                        "kind": "function", "qualified_name": ".".join((module, *inner)), "owner": ".".join((module, *scope)) if in_class else None,
                        "name": child.name, "line": child.lineno, "code": "\n".join(lines[first - 1 : child.end_lineno]),
                        "signature": f"{'async ' * isinstance(child, ast.AsyncFunctionDef)}def {child.name}({ast.unparse(child.args)}){ret}",
                        "description": text, "doc_origin": origin if doc is not None else None, "telling": tells(text, child.name) if doc is not None else None, "tags": tags,
                    }
                )
            stack.append((child, inner, of_class))
    for scope, node in classes.items():
        bases = []
        for name in filter(None, map(_dotted, node.bases)):
            head, _, rest = name.partition(".")
            near = next((s for k in range(len(scope) - 1, -1, -1) if (s := (*scope[:k], *name.split("."))) in classes and s != scope), None)
            known = imported.get(head)
            bases.append(".".join((module, *near)) if near else f"{known}.{rest}".rstrip(".") if known else name)
        found.append({"kind": "class", "qualified_name": ".".join((module, *scope)), "name": node.name, "line": node.lineno, "bases": bases})
    return found


def _list(node: ast.AST, field: str) -> list:
    value = getattr(node, field, None)
    return value if isinstance(value, list) else []


def _parse(batches):
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.int32() if n == "line" else pa.bool_() if n == "telling" else pa.list_(pa.string()) if n in ("tags", "bases") else pa.string()) for n in names])
    for batch in batches:
        rows: list[dict] = []
        for path, module, content in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [r | {"module": module, "path": path} for r in definitions(module, content)]
            if len(rows) > 2_000:
                yield pa.RecordBatch.from_pylist([{n: _clean(r.get(n)) for n in names} for r in rows], kinds)
                rows = []
        yield pa.RecordBatch.from_pylist([{n: _clean(r.get(n)) for n in names} for r in rows], kinds)


def _clean(v):
    """Escapes in sources can make lone surrogates, which no table holds."""
    return v.encode("utf-8", "replace").decode() if isinstance(v, str) else v


def current_files(files: DataFrame) -> DataFrame:
    """path, module, content of the current row of each path."""
    last = files.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "file_id")).alias("m")).select(F.col("m.file_id").alias("file_id"))
    derived = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "[/\\\\]+", ".")
    return files.join(last, "file_id", "left_semi").where("path is not null and content is not null").select("path", F.coalesce("module", derived).alias("module"), "content")


def parsed(files: DataFrame) -> DataFrame:
    """Functions and classes of the current files."""
    return spread(current_files(files), "path").mapInArrow(_parse, _SCHEMA)


def documented_functions(files: DataFrame) -> DataFrame:
    """qualified_name, path, line, signature, code, description, doc_origin, doc_from, tags of functions whose documentation tells something."""
    spark = files.sparkSession
    rows, _ = keep(parsed(files), "doc-definitions")
    functions = rows.where("kind = 'function'")
    shown = ["qualified_name", "path", "line", "signature", "code"]
    own = functions.where("telling").select(*shown, "description", "doc_origin", F.col("qualified_name").alias("doc_from"), "tags")
    inherited = _inherited(spark, rows)
    w = Window.partitionBy("qualified_name").orderBy("line", "path")
    source = functions.where("telling").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("qualified_name").alias("doc_from"), "description", "tags")
    filled = (
        functions.where("doc_origin is null").select(*shown).join(inherited, "qualified_name").join(source, "doc_from")
        .select(*shown, "description", F.lit("inherited").alias("doc_origin"), "doc_from", "tags")
    )
    return own.unionByName(filled)


def _inherited(spark, rows: DataFrame) -> DataFrame:
    """qualified_name of undocumented methods and the method, doc_from, whose documentation they inherit."""
    links, p1 = keep(
        rows.where("kind = 'class'").select(F.col("qualified_name").alias("owner"), F.posexplode("bases").alias("nth", "base")).groupBy("owner", "base").agg(F.min("nth").alias("nth")),
        "doc-bases",
    )
    methods = rows.where("kind = 'function' and owner is not null").select("owner", "name", "qualified_name", "doc_origin", "telling")
    # What a base has to offer under a name: documentation that tells something, or one that stops the search.
    offers = methods.where("doc_origin is not null").groupBy(F.col("owner").alias("base"), "name").agg(F.max("telling").alias("telling"), F.min("qualified_name").alias("doc_from"))
    start = methods.where("doc_origin is null").select("qualified_name", F.col("owner").alias("at"), "name").distinct()
    frontier, path = keep(start.withColumn("route", F.array().cast("array<int>")), "doc-frontier")
    seen, used, found = frontier.select("qualified_name", "at"), [p1, path], None
    while not frontier.isEmpty():
        step = frontier.join(links.withColumnRenamed("owner", "at"), "at").select(
            "qualified_name", "name", F.col("base").alias("at"), F.concat("route", F.array("nth")).alias("route")
        )
        step = step.groupBy("qualified_name", "name", "at").agg(F.min("route").alias("route"))
        step = step.join(seen, ["qualified_name", "at"], "left_anti").join(offers.withColumnRenamed("base", "at"), ["at", "name"], "left")
        step, path = keep(step, "doc-frontier")
        used.append(path)
        hits = step.where("doc_from is not null").groupBy("qualified_name").agg(F.min_by(F.struct("doc_from", "telling"), "route").alias("hit"))
        hits, path = keep(hits.select("qualified_name", "hit.doc_from", "hit.telling"), "doc-found")
        found = hits if found is None else found.unionByName(hits)
        frontier = step.join(hits, "qualified_name", "left_anti").select("qualified_name", "at", "name", "route")
        seen = seen.unionByName(step.select("qualified_name", "at"))
    done = found.where("telling").select("qualified_name", "doc_from") if found is not None else start.select("qualified_name", F.col("name").alias("doc_from")).limit(0)
    done, _ = keep(done, "doc-inherited")
    for p in used:
        drop(spark, p)
    return done
