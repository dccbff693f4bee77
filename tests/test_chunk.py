"""Chunkers on cases worked out by hand."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators.chunk import chunk_files
from siltstone.operators.code import chunks_of

FILES = [
    ("d.md", "intro\n\n# A\ntext\n  ## B ##\nmore"),
    ("t.txt", "a\nb\n\n\nc"),
    ("c.yml", '# c\na: 1\nb:\n  x: 2\n"q": 3'),
    ("c.json", '{\n  "a": 1,\n    "b": 2,\n  "c": {\n  }\n}'),
    ("x/.env", "A=1\nAPI_KEY = x=y\n# t=1\n\nNOEQ\nmonkey=2"),
    ("e.md", " \n "), ("e.txt", ""), ("e.html", ""), ("n.css", None), ("f/.env", " \n"),
    ("p.py", '"""doc"""\nimport os\nX = 1\n@dec\ndef f():\n    def g(): pass\nclass C:\n    async def m(self): pass'),
    ("bad.py", "x = ("),
    ("m.js", "export function a() {\n  return 1;\n}\nclass B { }\nconst h = () => 1;\nlet z = 2;"),
    ("none.tsx", "// only\nlet a;"),
]


def made(spark, files):
    out = {}
    for r in chunk_files(spark.createDataFrame(files, "path string, content string")).orderBy("path", "ord").collect():
        out.setdefault(r.path, []).append(r)
    return out


def test_worked_cases(spark):
    got = made(spark, FILES)
    spans = lambda p: [(r.symbol, r.start_line, r.end_line) for r in got[p]]
    assert spans("d.md") == [("Document", 1, 2), ("A", 3, 4), ("## B ##", 5, 6)]
    assert [r.text for r in got["d.md"]] == [
        "Document: d.md\nSection: Document\n\nintro", "Document: d.md\nSection: A\n\n# A\ntext", "Document: d.md\nSection: ## B ##\n\n## B ##\nmore",
    ]
    assert spans("t.txt") == [("a", 1, 2), ("c", 5, 5)]
    assert got["t.txt"][0].text == "Document: t.txt\nBlock: a\n\na\nb"
    assert spans("c.yml") == [("root", 1, 1), ("a", 2, 2), ("b", 3, 4), ("q", 5, 5)]
    assert spans("c.json") == [("root", 1, 1), ("a", 2, 3), ("c", 4, 6)]
    assert got["x/.env"][0].text == "Env file: x/.env\n\nA=1\nAPI_KEY =<redacted>\n# t=1\n\nNOEQ\nmonkey=<redacted>"
    assert "e.md" not in got and "e.txt" not in got and "f/.env" not in got
    assert [(r.type, r.text, r.language) for r in got["e.html"]] == [("file", "", "html")]
    assert [(r.type, r.symbol, r.start_line, r.end_line) for r in got["p.py"]] == [
        ("module", None, None, None), ("function", "f", 5, 6), ("function", "f.g", 6, 6), ("class", "C", 7, 8), ("function", "C.m", 8, 8),
    ]
    assert got["p.py"][0].text == "Module: p.py\nLanguage: python\nModuleDoc: doc\nImports:\nimport os\nGlobals: X\nClasses: C\nFunctions: f"
    assert [(r.type, r.text) for r in got["bad.py"]] == [("module", "Module bad.py\nLanguage: python"), ("file", "x = (")]
    assert [(r.type, r.symbol, r.start_line, r.end_line) for r in got["m.js"]][1:] == [("function", "a", 1, 3), ("class", "B", 4, 4)]
    assert got["m.js"][0].text == (
        "Module: m.js\nLanguage: javascript/typescript\nImports:\nexport function a() {\nGlobals: z\nClasses: B\nFunctions: a"
    )
    assert [r.type for r in got["none.tsx"]] == ["module", "file"]


def test_unclosed_brace_falls_back():
    assert chunks_of("a.js", "function f() {\n{\n}")[1][4:] == (1, 1)
    assert chunks_of("a.js", "class A\n\n{ {} }\n")[1][4:] == (1, 3)


def markdown(content):
    lines, at = content.splitlines(), []
    for i, line in enumerate(lines):
        if i == 0 or re.match(r"^\s{0,3}#{1,6}\s+", line):
            at.append(i)
    out = []
    for a, b in zip(at, [*at[1:], len(lines)], strict=False):
        body = "\n".join(lines[a:b]).strip()
        title = lines[a].lstrip("#").strip() if re.match(r"^\s{0,3}#{1,6}\s+", lines[a]) else "Document"
        if body:
            out.append((title, a + 1, b, body))
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="# \n\rab\t\x85", max_size=40), min_size=60, max_size=60))
def test_markdown_property(spark, texts):
    got = made(spark, [(f"{i}.md", x) for i, x in enumerate(texts)])
    for i, x in enumerate(texts):
        rows = [(r.symbol, r.start_line, r.end_line, r.text.split("\n\n", 1)[1]) for r in got.get(f"{i}.md", [])]
        assert [(r[0], r[1], r[2]) for r in rows] == [w[:3] for w in markdown(x)]
        assert [r[3] for r in rows] == [w[3] for w in markdown(x)]
