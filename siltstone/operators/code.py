"""Symbols and overviews of Python and JavaScript/TypeScript files, in Arrow batches."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines that an overview lists of comments and of imports.
LISTED = 40
_SCHEMA = "path string, ord int, text string, type string, language string, symbol string, start_line int, end_line int"
#: What counts as a declaration, an import line and a global of a script.
_FUNCTION = re.compile(r"\bfunction\s+([A-Za-z0-9_]+)\s*\(")
_CLASS = re.compile(r"\bclass\s+([A-Za-z0-9_]+)\b")
_IMPORT = re.compile(r"import\b|export\s+\{?|export\s+\*\s+from|const\s+\w+\s*=\s*require\(")
_GLOBAL = re.compile(r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*=")
_LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx"}


def python_symbols(tree: ast.AST) -> list[tuple[str, str, int, int]]:
    """(kind, dotted name, first line, last line) of functions and classes, outer first."""
    found: list[tuple[str, str, int, int]] = []
    waiting: list[tuple[ast.AST, str]] = [(tree, "")]
    while waiting:
        node, scope = waiting.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            scope = f"{scope}.{node.name}" if scope else node.name
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            found.append((kind, scope, node.lineno, node.end_lineno or node.lineno))
        waiting.extend((child, scope) for child in reversed(list(ast.iter_child_nodes(node))))
    return found


def _assigned(node: ast.Assign | ast.AnnAssign) -> Iterator[str]:
    for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
        for name in target.elts if isinstance(target, ast.Tuple | ast.List) else [target]:
            if isinstance(name, ast.Name):
                yield name.id


def _overview(path: str, language: str, parts: list[tuple[str, list[str] | str, bool]]) -> str:
    """Parts: heading, content, and whether the content is one comma-separated line."""
    out = [f"Module: {path}", f"Language: {language}"]
    for heading, content, inline in parts:
        if content and inline:
            out.append(f"{heading}: {content if isinstance(content, str) else ', '.join(content)}")
        elif content:
            out += [f"{heading}:", *content[:LISTED]]
    return "\n".join(out)


def python_overview(path: str, source: str, tree: ast.Module) -> str:
    top = tree.body
    comments = [x for x in map(str.strip, source.splitlines()) if x.startswith("#")]
    imports = [ast.get_source_segment(source, n) or "" for n in top if isinstance(n, ast.Import | ast.ImportFrom)]
    names = list(dict.fromkeys(x for n in top if isinstance(n, ast.Assign | ast.AnnAssign) for x in _assigned(n)))
    classes = [n.name for n in top if isinstance(n, ast.ClassDef)]
    functions = [n.name for n in top if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    return _overview(path, "python", [
        ("ModuleDoc", ast.get_docstring(tree) or "", True), ("Comments", comments, False), ("Imports", imports, False),
        ("Globals", names, True), ("Classes", classes, True), ("Functions", functions, True),
    ])


def script_symbols(lines: list[str]) -> list[tuple[str, str, int, int]]:
    """Declared functions and classes, each to the line that closes its first brace."""
    braces = Braces(lines)
    found = []
    for i, line in enumerate(lines):
        for kind, pattern in (("function", _FUNCTION), ("class", _CLASS)):
            if m := pattern.search(line):
                found.append((kind, m.group(1), i + 1, braces.end(i)))
    return found


class Braces:
    """Brace levels of a file, read once for all of its declarations.

    A block that begins on or after a line ends where the level falls back to what it was before
    that line; closing braces are kept by the level they leave, in order.
    """

    def __init__(self, lines: list[str]) -> None:
        self.before: list[int] = []
        self.closing: dict[int, list[int]] = {}
        level = 0
        for i, line in enumerate(lines):
            self.before.append(level)
            for c in line:
                if c == "{":
                    level += 1
                elif c == "}":
                    level -= 1
                    self.closing.setdefault(level, []).append(i)

    def end(self, line: int) -> int:
        """Number of the line, from 1, that closes the block; the line's own without one."""
        ends = self.closing.get(self.before[line], [])
        at = bisect_left(ends, line)
        return ends[at] + 1 if at < len(ends) else line + 1


def script_overview(path: str, lines: list[str]) -> str:
    bare = [x.strip() for x in lines]
    once = lambda pattern, among: list(dict.fromkeys(m.group(1) for x in among if (m := pattern(x))))
    return _overview(path, "javascript/typescript", [
        ("Imports", [x for x in bare if _IMPORT.match(x)], False),
        ("Comments", [x for x in bare if x.startswith(("//", "/*", "*"))], False),
        ("Globals", once(_GLOBAL.match, [x for x in bare if "=>" not in x]), True),
        ("Classes", once(_CLASS.search, bare), True), ("Functions", once(_FUNCTION.search, bare), True),
    ])


def chunks_of(path: str, source: str) -> list[tuple]:
    """(text, type, language, symbol, start, end): an overview, then symbols or the file."""
    ending = PurePosixPath(path).suffix.lower()
    language, lines = _LANGUAGE[ending], source.splitlines()
    if ending == ".py":
        try:
            tree = ast.parse(source)
            overview, symbols = python_overview(path, source, tree), python_symbols(tree)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            overview, symbols = f"Module {path}\nLanguage: python", []
    else:
        overview, symbols = script_overview(path, lines), script_symbols(lines)
    out: list[tuple] = [(overview, "module", language, None, None, None)]
    for kind, name, start, end in symbols:
        out.append(("\n".join(lines[start - 1 : end]), kind, language, name, start, end))
    if not symbols:
        out.append((source, "file", language, None, None, None))
    return out


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of code ``files`` (path, content); a file that does not parse is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in _SCHEMA.split(", ")]
        for b in batches:
            rows = [
                (path, i, *chunk)
                for path, source in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)
                for i, chunk in enumerate(chunks_of(path, source or ""))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def code_errors(files: DataFrame) -> DataFrame:
    """(path, stage, exc_type, message) of Python ``files`` (path, content) that do not parse:
    the quarantine beside :func:`code_chunks`, which keeps them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, source in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append((path, "parse", type(e).__name__, str(e)[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["path", "stage", "exc_type", "message"])

    python = files.where("lower(path) LIKE '%.py'").select("path", "content")
    return python.mapInArrow(run, "path string, stage string, exc_type string, message string")
