"""Files to chunks: Markdown, text, YAML/JSON and dotenv by expressions, code by parsers.

Sections are cut inside one row: boundaries are positions in the array of lines, and each
section is the slice up to the next boundary, so a file is never exploded into lines and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Language by suffix; any other suffix is its own language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx",
    ".json": "json", ".md": "markdown", ".html": "html", ".css": "css",
}
#: Names taken as dotenv files, and parts of a key whose value is hidden.
ENV_NAMES = [".env", ".env.example", ".env.sample", ".env.template"]
SECRET = "key|token|secret|password|passwd"
CODE = [".py", ".js", ".ts", ".tsx"]

CHUNK = "struct<text:string,type:string,language:string,symbol:string,start_line:int,end_line:int>"
_S = r"[\s\x1c-\x1f]"
_HEADING = rf"(?U)^{_S}{{0,3}}#{{1,6}}{_S}+"
_KEY = rf"(?U)^[A-Za-z0-9_.-]+{_S}*:"
_QUOTED = rf'(?U)^{_S}*"[^"]+"{_S}*:'


def _chunk(text: Column, kind: Column | str, language: Column | str, symbol: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        text.alias("text"), lit(kind).alias("type"), lit(language).alias("language"),
        (none if symbol is None else symbol).cast("string").alias("symbol"),
        (none if start is None else start).cast("int").alias("start_line"), (none if end is None else end).cast("int").alias("end_line"),
    )


def _sections(path: Column, lines: Column, boundary: Callable[[Column], Column], title: Callable[[Column], Column], preamble: str, kind: str, language: Column | str) -> Column:
    """Sections from each boundary line to the next; what precedes the first is a preamble."""

    def cut(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.when((i == 0) | boundary(line), i))
        return T.let(F.filter(marked, lambda i: i.isNotNull()), lambda at: F.filter(F.transform(at, one(lines, at)), lambda x: x.isNotNull()))

    def one(lines: Column, at: Column) -> Callable[[Column, Column], Column]:
        def section(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(lines))
            first = F.get(lines, start)
            name = F.when(boundary(first), title(first)).otherwise(F.lit(preamble))
            body = T.strip(F.array_join(F.slice(lines, start + 1, end - start), "\n"))
            return T.let(F.struct(name.alias("name"), body.alias("body")), lambda x: F.when(x["body"] != "", _chunk(
                F.concat(F.lit("Document: "), path, F.lit("\nSection: "), x["name"], F.lit("\n\n"), x["body"]),
                kind, language, x["name"], start + 1, end,
            )))

        return section

    return T.let(lines, cut)


def markdown_sections(path: Column, text: Column) -> Column:
    """A section for each heading, titled without its leading ``#`` marks."""
    title = lambda line: T.strip(F.regexp_replace(line, "^#+", ""))
    return _sections(path, T.splitlines(text), lambda line: line.rlike(_HEADING), title, "Document", "doc_section", "markdown")


def kv_sections(path: Column, text: Column, language: Column | str) -> Column:
    """A section for each top-level key of YAML or JSON; the key may be quoted and indented
    by two spaces."""

    def boundary(line: Column) -> Column:
        indent = F.length(line) - F.length(F.ltrim(line))
        return (line.rlike(_KEY) & (indent == 0)) | (line.rlike(_QUOTED) & (indent <= 2))

    title = lambda line: F.regexp_replace(T.strip(F.element_at(F.split(T.strip(line), ":", 2), 1)), '^"+|"+$', "")
    return _sections(path, T.splitlines(text), boundary, title, "root", "config_section", language)


def text_blocks(path: Column, text: Column) -> Column:
    """Blocks of lines between blank ones, named by 80 characters of their first line."""

    def cut(lines: Column) -> Column:
        return T.let(F.transform(lines, T.is_blank), lambda blank: blocks(lines, blank))

    def blocks(lines: Column, blank: Column) -> Column:
        edge = F.lit(True)  # outside the file counts as blank
        at = lambda i: F.coalesce(F.get(blank, i), edge)
        starts = F.filter(F.transform(blank, lambda x, i: F.when(~x & ((i == 0) | at(i - 1)), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(blank, lambda x, i: F.when(~x & at(i + 1), i + 1)), lambda i: i.isNotNull())
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: one(lines, x["a"], x["b"]))

    def one(lines: Column, start: Column, end: Column) -> Column:
        body = T.strip(F.array_join(F.slice(lines, start + 1, end - start), "\n"))
        named = T.let(body, lambda x: F.struct(x.alias("body"), F.substring(F.element_at(T.splitlines(x), 1), 1, 80).alias("name")))
        return T.let(named, lambda x: _chunk(
            F.concat(F.lit("Document: "), path, F.lit("\nBlock: "), x["name"], F.lit("\n\n"), x["body"]), "doc_block", "text", x["name"], start + 1, end
        ))

    return T.let(T.splitlines(text), cut)


def redact(text: Column) -> Column:
    """dotenv lines, with the values of secret-looking keys hidden."""

    def one(line: Column) -> Column:
        return T.let(T.strip(line), lambda bare: shown(line, bare))

    def shown(line: Column, bare: Column) -> Column:
        parts = F.split(bare, "=", 2)
        key, value = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
        plain = (bare == "") | F.startswith(bare, F.lit("#")) | ~F.contains(bare, F.lit("="))
        hidden = F.when(F.lower(key).rlike(SECRET), F.lit("<redacted>")).otherwise(value)
        return F.when(plain, line).otherwise(F.concat(key, F.lit("="), hidden))

    return T.strip(F.array_join(F.transform(T.splitlines(text), one), "\n"))


def env_chunks(path: Column, text: Column) -> Column:
    chunk = lambda safe: _chunk(F.concat(F.lit("Env file: "), path, F.lit("\n\n"), safe), "env", "dotenv")
    return T.let(redact(text), lambda safe: F.when(safe != "", F.array(chunk(safe))).otherwise(F.array().cast(f"array<{CHUNK}>")))


def language_of(path: Column) -> Column:
    ending = T.suffix(path)
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, ending), F.regexp_replace(ending, r"^\.+", ""))


def _native(path: Column, text: Column) -> Column:
    ending, name = T.suffix(path), F.lower(T.basename(path))
    is_env = name.isin(ENV_NAMES) | F.startswith(name, F.lit(".env."))
    return (
        F.when(ending == ".md", markdown_sections(path, text))
        .when(ending == ".txt", text_blocks(path, text))
        .when(ending.isin(".yaml", ".yml"), kv_sections(path, text, "yaml"))
        .when(ending == ".json", kv_sections(path, text, "json"))
        .when(is_env, env_chunks(path, text))
        .otherwise(F.array(_chunk(text, "file", language_of(path))))
    )


def chunk_id(collection: Column, path: Column, kind: Column, symbol: Column, start: Column, end: Column) -> Column:
    """Deterministic primary key; missing parts count as empty, a missing type as ``file``."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.sha1(F.concat_ws(":", collection, path, F.coalesce(kind, F.lit("file")), blank(symbol), blank(start), blank(end)))


def chunk_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) -> (path, ord, text, type, language, symbol, start_line,
    end_line), ``ord`` numbering a file's chunks from 0."""
    from .code import code_chunks

    ending = T.suffix(F.col("path"))
    # The outer form keeps the optimizer from testing, and so making, the chunks beforehand.
    made = F.posexplode_outer(_native(F.col("path"), F.col("content"))).alias("ord", "c")
    plain = files.where(~ending.isin(CODE)).select("path", made).where("c IS NOT NULL")
    code = code_chunks(files.where(ending.isin(CODE)).select("path", "content"))
    return plain.select("path", "ord", "c.*").unionByName(code)
