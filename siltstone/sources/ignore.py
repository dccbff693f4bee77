"""gitwildmatch patterns as regular expressions, last match wins."""

from __future__ import annotations

import re


def translate(pattern: str) -> tuple[re.Pattern[str], bool] | None:
    """(expression over a relative path, whether it re-includes); None for blanks and comments."""
    line = pattern.rstrip("\n\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    include = line.startswith("!")
    line = line[1:] if include else line
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    only_dir = line.endswith("/")
    line = line.rstrip("/") if only_dir else line
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif line.startswith("**", i) and i + 2 == len(line) and i and line[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(line):
            out.append(re.escape(line[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    head = "^" if anchored else "^(?:.*/)?"
    # A pattern that matches a directory covers all that is in it.
    return re.compile(head + "".join(out) + ("/.*$" if only_dir else "(?:/.*)?$"), re.S), include


class IgnoreRules:
    """The rules of one ignore file, applied to files' paths relative to its folder."""

    def __init__(self, text: str) -> None:
        self.rules = [r for line in text.splitlines() if (r := translate(line)) is not None]

    def ignored(self, path: str) -> bool:
        out = False
        for expression, include in self.rules:
            if expression.match(path):
                out = not include
        return out
