"""Rules and structures of Python code: an Arrow-batched pass over files."""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

RULE = "type string, name string, condition string, parameters array<string>, bases array<string>, file_path string, line_start int, line_end int, code string, docstring string, description string"
STRUCTURE = "file_path string, functions array<struct<name: string, line: int, params: array<string>>>, classes array<struct<name: string, line: int, bases: array<string>>>, imports array<string>"
_COMMENT = re.compile("rule|todo|note|fixme|hack", re.IGNORECASE)


def rules_of(code: str, path: str) -> list[dict]:
    """Conditions, functions and classes in the order of a breadth-first walk; comment lines where the code can't be parsed."""
    text = code.split("\n")

    def rule(node: ast.AST | None, kind: str, **more) -> dict:
        return {"type": kind, "file_path": path, "line_start": node.lineno, "line_end": node.end_lineno, "code": "\n".join(text[node.lineno - 1 : node.end_lineno])} | more

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return [{"type": "comment_rule", "file_path": path, "line_start": k, "line_end": k, "code": x, "description": f"Comment rule at line {k}"} for k, x in enumerate(text, 1) if _COMMENT.search(x)]
    out = []
    for node in ast.walk(tree):
        match node:
            case ast.If(test=test):
                out.append(rule(node, "conditional_rule", condition=(c := ast.unparse(test)), description=f"Conditional rule: {c}"))
            case ast.FunctionDef(name=name, args=args):
                names = [a.arg for a in args.args]
                out.append(rule(node, "function_rule", name=name, parameters=names, docstring=ast.get_docstring(node) or "", description=f"Function: {name}({', '.join(names)})"))
            case ast.ClassDef(name=name, bases=bases):
                out.append(rule(node, "class_rule", name=name, bases=[ast.unparse(b) for b in bases], docstring=ast.get_docstring(node) or "", description=f"Class: {name}"))
    return out


def structure_of(code: str, path: str) -> dict | None:
    """Functions, classes (bases that are names) and imports; nothing for code that can't be parsed."""
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError):
        return None
    imports = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    return {
        "file_path": path,
        "functions": [{"name": n.name, "line": n.lineno, "params": [a.arg for a in n.args.args]} for n in nodes if isinstance(n, ast.FunctionDef)],
        "classes": [{"name": n.name, "line": n.lineno, "bases": [b.id for b in n.bases if isinstance(b, ast.Name)]} for n in nodes if isinstance(n, ast.ClassDef)],
        "imports": imports,
    }


def _each(files: DataFrame, of, schema: str) -> DataFrame:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, code in zip(b["path"], b["code"], strict=True):
                try:
                    rows += of(code or "", path)
                except RecursionError:  # code nested too deeply: the file has no rules
                    continue
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    return files.select("path", "code").mapInPandas(work, schema)


def rules(files: DataFrame) -> DataFrame:
    """The rules of files (path, code)."""
    return _each(files, rules_of, RULE)


def structures(files: DataFrame) -> DataFrame:
    return _each(files, lambda code, path: [s] if (s := structure_of(code, path)) else [], STRUCTURE)
