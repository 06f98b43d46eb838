"""Identifiers, symbols and imports of Python sources, one row per find."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = ["file_path", "ordinal", "raw_identifier", "identifier_type", "function_name", "class_name", "line_number", "code_snippet", "block_type"]
SCHEMA = "file_path string, ordinal int, raw_identifier string, identifier_type string, function_name string, class_name string, line_number int, code_snippet string, block_type string"


def _targets(node: ast.AST):
    """Names that an assignment target binds; of an attribute its last part, of an element what holds it."""
    match node:
        case ast.Name(id=name):
            yield name
        case ast.Attribute(attr=name):
            yield name
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            for part in parts:
                yield from _targets(part)
        case ast.Starred(value=inner) | ast.Subscript(value=inner):
            yield from _targets(inner)


def identifiers(path: str, source: str, around: int = 3) -> list[tuple]:
    """Occurrences in the order of a depth-first walk; a file that doesn't parse has none.

    A function's name and parameters belong to its own scope, a class's name and
    bases to the outer one; a class inside a function drops the function's name.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = source.splitlines(keepends=True), []

    def tell(name, kind, first, scope, own, last=None):
        if not name or not name.isascii():
            return
        cls, fn = scope
        block = ("method" if cls else "function") if fn else "class" if cls or own == "class" else own
        snippet = "".join(lines[max(0, first - 1 - around) : min(len(lines), (last or first) + around)]).rstrip()
        out.append((path, len(out), name, kind, fn, cls, first, snippet, block))

    todo: list[tuple[ast.AST, tuple]] = [(tree, (None, None))]
    while todo:
        node, scope = todo.pop()
        inner = scope
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                inner = (scope[0], node.name)
                tell(node.name, "function_name", node.lineno, inner, "function", node.end_lineno)
                a = node.args
                for arg in [*a.args, *a.posonlyargs, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
                    tell(arg.arg, "parameter", arg.lineno, inner, "function")
            case ast.ClassDef():
                tell(node.name, "class_name", node.lineno, scope, "class", node.end_lineno)
                for base in node.bases:
                    if isinstance(base, ast.Name | ast.Attribute):
                        tell(getattr(base, "id", None) or base.attr, "class_name", base.lineno, scope, "class")
                inner = (node.name, None)
            case ast.Assign(targets=targets):
                for target in targets:
                    for name in _targets(target):
                        tell(name, "variable", target.lineno, scope, "module")
            case ast.AnnAssign(target=target):
                for name in _targets(target):
                    tell(name, "variable", target.lineno, scope, "module")
            case ast.Import(names=names):
                for alias in names:
                    tell(alias.asname or alias.name.partition(".")[0], "import", node.lineno, scope, "module")
            case ast.ImportFrom(names=names):
                for alias in names:
                    if alias.name != "*":
                        tell(alias.asname or alias.name, "import", node.lineno, scope, "module")
            case ast.Attribute(attr=name):
                tell(name, "attribute", node.lineno, scope, "module")
        if not isinstance(node, ast.Import | ast.ImportFrom):
            todo += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def dealt(files: DataFrame) -> DataFrame:
    """``(file_path, text)`` in several tasks a core: a table of few bytes, which is read by one task, may hold many sources to parse."""
    return files.select("file_path", "text").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file_path")


def occurrences(files: DataFrame, around: int = 3) -> DataFrame:
    """All identifiers of ``files(file_path, text)``, with the file's first directory as subdomain."""

    def run(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in identifiers(p, t or "", around)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
            kinds = [pa.int32() if n in ("ordinal", "line_number") else pa.string() for n in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)

    found = dealt(files).mapInArrow(run, SCHEMA)
    return found.withColumn("subdomain", F.regexp_replace(F.split_part("file_path", F.lit("/"), F.lit(1)), r"\.py$", ""))


def unparsable(files: DataFrame) -> DataFrame:
    """``(file_path, error)`` of sources that don't parse."""

    def run(batches):
        for batch in batches:
            bad = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    ast.parse(t or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    bad.append((p, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in bad], pa.string()) for k in (0, 1)], ["file_path", "error"])

    return dealt(files).mapInArrow(run, "file_path string, error string")


def symbols(files: DataFrame, most: int = 15, imports: int = 10) -> DataFrame:
    """``(file_path, symbols, imports, symbol_count)``: public definitions and imported modules, the first of each, and the number of all definitions."""

    def run(batches):
        for batch in batches:
            names, modules, counts = [], [], []
            for text in batch.column(1).to_pylist():
                try:
                    nodes = list(ast.walk(ast.parse(text or "")))
                except (SyntaxError, ValueError, RecursionError):
                    nodes = []
                public = [n.name for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not n.name.startswith("_")]
                names.append(public[:most])
                counts.append(len(public))
                found = [m for n in nodes for m in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module] if isinstance(n, ast.ImportFrom) and n.module else [])]
                modules.append(list(dict.fromkeys(found))[:imports])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(modules, pa.list_(pa.string())), pa.array(counts, pa.int32())], ["file_path", "symbols", "imports", "symbol_count"])

    return dealt(files).mapInArrow(run, "file_path string, symbols array<string>, imports array<string>, symbol_count int")


def import_graph(found: DataFrame) -> DataFrame:
    """``(file_path, module, target)``: the file that an import names, by the dotted path's end; null for outside modules."""
    each = found.select("file_path", F.explode("imports").alias("module")).withColumn("tail", F.element_at(F.split("module", r"\."), -1))
    files = found.select(F.col("file_path").alias("target")).withColumn("dotted", F.regexp_replace(F.regexp_replace("target", r"(/__init__)?\.py$", ""), "/", ".")).withColumn("tail", F.element_at(F.split("dotted", r"\."), -1))
    hits = each.join(files, "tail").where(F.endswith("dotted", F.col("module"))).groupBy("file_path", "module").agg(F.min_by("target", F.struct(F.length("dotted"), "target")).alias("target"))
    return each.drop("tail").join(hits, ["file_path", "module"], "left")


def module_cards(found: DataFrame, described: DataFrame) -> DataFrame:
    """Cards of files: what they are for, their layer, key concepts, and import counts both ways; ``described(file_path, responsibility, layer, key_concepts)``."""
    links = import_graph(found)
    out = links.groupBy("file_path").agg(F.count("*").alias("imports_from_count"))
    into = links.where("target is not null").groupBy(F.col("target").alias("file_path")).agg(F.countDistinct("file_path").alias("imported_by_count"))
    rows = found.join(described, "file_path", "left").join(out, "file_path", "left").join(into, "file_path", "left")
    return rows.select("file_path", "responsibility", "layer", "key_concepts", "symbol_count", F.coalesce("imports_from_count", F.lit(0)).alias("imports_from_count"), F.coalesce("imported_by_count", F.lit(0)).alias("imported_by_count"))
