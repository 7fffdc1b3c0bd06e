"""Where definitions begin and end in source code: quotes and brackets, or indents. A small helper, one file at a time."""

from __future__ import annotations

import re
from typing import NamedTuple

# File name extensions of the languages whose definitions are found.
LANGUAGES = {
    "rust": "rs", "python": "py pyi", "script": "js mjs cjs jsx ts mts cts tsx", "go": "go", "java": "java",
    "c": "c h cc cpp cxx hpp hh hxx", "ruby": "rb", "shell": "sh bash", "json": "json",
}
LANGUAGE_OF = {extension: name for name, extensions in LANGUAGES.items() for extension in extensions.split()}


class Grammar(NamedTuple):
    """Comments, strings, and what the text in front of a block (or a line) looks like if it is a definition."""

    comment: str
    string: str
    definition: str
    #: Whether ``name(...)`` in front of a block is one too, whether one can end without a block, and whether a line ends a statement.
    callable: bool = False
    bodiless: bool = False
    by_line: bool = False


_SLASHES, _HASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
GRAMMARS = {
    "rust": Grammar(_SLASHES, r'b?r(?P<hashes>#*)".*?"(?P=hashes)' r'|"(?:\\.|[^"\\])*"' r"|b?'(?:\\[^\n]|[^'\\\n])[^'\n]{0,8}?'", r"\b(?:fn\s+\w|(?:struct|enum|trait)\s+\w|impl\b)", bodiless=True),
    "script": Grammar(_SLASHES, rf"{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`", r"\b(?:function\b|class\b|(?:interface|enum|namespace|module)\s+[\w$\"])|=>\s*$", callable=True, by_line=True),
    "go": Grammar(_SLASHES, rf"`[^`]*`|{_DOUBLE}|{_SINGLE}", r"(?m)^[ \t]*func\b\s*(?:\(|\w)", by_line=True),
    "java": Grammar(_SLASHES, rf'""".*?"""|{_DOUBLE}|{_SINGLE}', r"\b(?:class|interface|enum)\s+\w", callable=True),
    "c": Grammar(_SLASHES, rf"{_DOUBLE}|{_SINGLE}|(?P<directive>(?m:^)[ \t]*#(?:\\\n|[^\n])*)", r"\b(?:class|struct|enum|namespace)\b[^()=]*$", callable=True),
    "shell": Grammar(_HASH, r'"(?:\\.|[^"\\])*"' r"|'[^']*'", r"\bfunction\s+\w|[\w-]+\s*\(\s*\)\s*$", by_line=True),
    "python": Grammar(_HASH, rf'(?:"""|\'\'\').*?(?:"""|\'\'\'|\Z)|{_DOUBLE}|{_SINGLE}', r"^\s*(?:async\s+)?(?:def|class)\b"),
    "ruby": Grammar(_HASH, rf"{_DOUBLE}|{_SINGLE}", r"^\s*(?:def|class|module)\b"),
}
# Words that are followed by brackets and a block without defining anything.
CONTROL = frozenset("catch do else for foreach if match return switch synchronized throw try until when while with".split())
CALLABLE = re.compile(r"(?:^|[\s*&~])([A-Za-z_$~][\w$]*)\s*(?:<[^<>()]*>)?\s*\((?:[^()]|\([^()]*\))*\)[^()=]*$", re.S)
MARK = '"'


def blanked(source: str, grammar: Grammar) -> str:
    """``source`` with comments as spaces, strings as marks and directives as ends of statements, every character in its place."""

    def fill(found: re.Match) -> str:
        return re.sub(r"[^\n]", " " if found["comment"] else ";" if found.groupdict().get("directive") else MARK, found[0])

    return re.sub(f"(?P<comment>{grammar.comment})|{grammar.string}", fill, source, flags=re.S)


def definition_spans(path: str, source: str) -> list[tuple[int, int]]:
    """First and last line (from 1) of every definition in order, with the comments and decorators right above it.

    Empty where the extension names no known language. Nested definitions are spans of their own.
    """
    grammar = GRAMMARS.get(LANGUAGE_OF.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower(), ""))
    if grammar is None:
        return []
    code = blanked(source, grammar)
    raw, lines = source.split("\n"), code.split("\n")
    indented = grammar in (GRAMMARS["python"], GRAMMARS["ruby"])
    found = by_indent(lines, grammar, grammar is GRAMMARS["ruby"]) if indented else by_bracket(code, grammar)
    return sorted({(climbed(first, raw, lines) + 1, last + 1) for first, last in found})


def climbed(first: int, raw: list[str], lines: list[str]) -> int:
    """The line where the unbroken run of comments and decorators above ``first`` begins."""
    while first > 0 and raw[first - 1].strip() and (not lines[first - 1].strip() or lines[first - 1].lstrip().startswith(("@", "#["))):
        first -= 1
    return first


def by_bracket(code: str, grammar: Grammar) -> list[tuple[int, int]]:
    """Spans by a stack of braces; the text from the last boundary to a brace says whether it opens a definition."""
    spans, opened, start, row, rounds = [], [], 0, 0, 0
    for found in re.finditer(r"[{};()\n]", code):
        at, mark = found.start(), found[0]
        if mark == "\n":
            row += 1
            continue
        if mark in "()":
            rounds = max(0, rounds + (1 if mark == "(" else -1))
            continue
        if mark == ";" and rounds:
            continue  # in a loop's head
        head = code[start:at]
        if mark == "{":
            opened.append((defined(head, grammar), row - head.count("\n"), head, rounds))
            rounds = 0
        elif mark == ";" and grammar.bodiless and defined(head, grammar) is not None:
            spans.append((row - head.lstrip().count("\n"), row))
        elif mark == "}" and opened:
            offset, begin, text, rounds = opened.pop()
            if offset is not None:
                spans.append((begin + text[:offset].count("\n"), row))
        start = at + 1
    return spans


def defined(head: str, grammar: Grammar) -> int | None:
    """Where in ``head`` a definition begins; None if it is none."""
    found = re.search(grammar.definition, head)
    if found is None and grammar.callable:
        named = CALLABLE.search(head)
        found = named if named and named[1] not in CONTROL and not re.search(r"\b(?:new|return|else)\b[^;]*$", head[: named.start(1)]) else None
    if found is None:
        return None
    if head[: found.start()].count("(") > head[: found.start()].count(")"):
        return found.start()  # an argument of a call
    if grammar.by_line:
        return head.rfind("\n", 0, found.end() - len(found[0].lstrip())) + 1
    return len(head) - len(head.lstrip())


def by_indent(lines: list[str], grammar: Grammar, closes: bool) -> list[tuple[int, int]]:
    """Spans by a stack of indents over statements, which go on while brackets or strings are open."""
    spans: list[tuple[int, int]] = []
    opened: list[tuple[int, int]] = []  # indent and first line
    depth, last, continued, decorated = 0, -1, False, None
    for number, line in enumerate(lines):
        if not line.strip():
            continue
        bare = line.lstrip()
        if not continued:
            indent = len(line) - len(bare)
            while opened and indent <= opened[-1][0]:
                own = closes and indent == opened[-1][0] and re.match(r"end\b", bare) is not None
                spans.append((opened.pop()[1], number if own else last))
            if re.match(grammar.definition, line):
                opened.append((indent, number if decorated is None else decorated))
            decorated = (number if decorated is None else decorated) if bare.startswith("@") and not closes else None
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        continued = depth > 0 or line.rstrip().endswith("\\") or bool(not closes and line.endswith(MARK) and number + 1 < len(lines) and lines[number + 1].startswith(MARK))
        last = number
    return spans + [(first, last) for _, first in opened]
