"""Chunks of source files along their declarations.

A language gives a tree of declarations (kind, name, range, body, members): Python from its own
parser, brace languages from one scanner that knows strings, comments and nesting. A declaration
that fits is one chunk; an oversized container becomes a header and its members, with qualified names;
any other is cut into line windows. Small nameless neighbours merge. Text without declarations,
and files of other kinds, are cut into line windows.
"""

from __future__ import annotations

import ast
import re
import tokenize
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.line_chunks import MAX_LINES, MERGE_LINES, OVERLAP, window_options
from tessera.runtime import ship

#: Chunks that are passed on at once; a batch of files may hold many times more.
PIECE = 20_000
#: Part of an index's identity: other chunks make all its files count as changed.
CHUNKER_VERSION = "1"
LANGUAGES = {".go": "go", ".py": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "ts", ".tsx": "ts", ".cs": "csharp"}
CONTAINERS = {"python": {"class"}, "js": {"class"}, "ts": {"class"}, "go": set(), "csharp": {"namespace", "class", "struct", "interface", "record", "#if"}}


@dataclass
class Chunk:
    start_line: int
    end_line: int
    symbol: str
    content: str


@dataclass
class Decl:
    kind: str
    name: str
    start: int
    end: int
    body: int = -1
    members: list[Decl] = field(default_factory=list)


def line_chunks(text: str, start_line: int = 1, symbol: str = "", max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[Chunk]:
    size, step = window_options(max_lines, overlap)
    text = text.rstrip("\n")
    lines, out = text.split("\n"), []
    for at in range(0, len(lines), step):
        part = lines[at : at + size]
        if "".join(part).strip():
            out.append(Chunk(start_line + at, start_line + at + len(part) - 1, symbol, "\n".join(part)))
        if at + size >= len(lines):
            break
    return out


def merge_small(chunks: list[Chunk], max_lines: int = MAX_LINES, merge_lines: int = MERGE_LINES) -> list[Chunk]:
    out: list[Chunk] = []
    for c in chunks:
        p = out[-1] if out else None
        if p and not c.symbol and not p.symbol and c.end_line - c.start_line < merge_lines and p.end_line - p.start_line + 1 < max_lines:
            out[-1] = Chunk(p.start_line, c.end_line, "", f"{p.content}\n{c.content}")
        else:
            out.append(c)
    return out


# Python

_ROWS = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _python(text: str) -> list[Decl]:
    tree = ast.parse(text)
    rows = _ROWS.findall(text)  # where Python ends lines; str.splitlines knows more ends
    starts = [0, *accumulate(map(len, rows))]
    at = lambda row, col: starts[row - 1] + len(rows[row - 1].encode()[:col].decode("utf-8", "ignore"))

    def decl(n: ast.stmt) -> Decl:
        decorated = getattr(n, "decorator_list", None)
        first = min([n.lineno, *(d.lineno for d in decorated or [])])
        start = at(n.lineno, n.col_offset) if not decorated else text.rfind("@", 0, at(decorated[0].lineno, decorated[0].col_offset))
        d = Decl("other", getattr(n, "name", "") if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else "", start, at(n.end_lineno, n.end_col_offset))
        if isinstance(n, (ast.Import, ast.ImportFrom)) and n.names[0].name != "*":
            d.name = n.names[0].name + (f" as {n.names[0].asname}" if n.names[0].asname else "")
        if isinstance(n, ast.ClassDef) and not decorated:
            d.kind, d.members = "class", [decl(x) for x in n.body]
            d.body = d.members[0].start
        assert first <= n.end_lineno
        return d

    out = [decl(n) for n in tree.body]
    begins, comments, lines = [d.start for d in out], [], iter(rows)
    for t in tokenize.generate_tokens(lambda: next(lines, "")) if "#" in text else ():
        if t.type == tokenize.COMMENT:
            p = starts[t.start[0] - 1] + t.start[1]
            i = bisect_right(begins, p) - 1
            if i < 0 or p >= out[i].end:
                comments.append(Decl("comment", "", p, p + len(t.string)))
    return sorted(out + comments, key=lambda d: d.start)


# Brace languages

_SKIP = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.DOTALL
)
_GO_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`""", re.DOTALL)
_OPEN, _CLOSE = "([{", ")]}"
_GOES_ON = re.compile(r"\s*(?:else|catch|finally|while|[.,;=)?:&|+*/%-])")
_NAMES = {
    "csharp": [
        ("using", re.compile(r"\b(?:using|extern\s+alias)\b"), None),
        ("namespace", re.compile(r"\bnamespace\s+([\w.]+)"), 1),
        ("enum", re.compile(r"\benum\s+(\w+)"), 1),
        ("record", re.compile(r"\brecord\s+(?:class\s+|struct\s+)?(\w+)"), 1),
        ("class", re.compile(r"\bclass\s+(\w+)"), 1),
        ("struct", re.compile(r"\bstruct\s+(\w+)"), 1),
        ("interface", re.compile(r"\binterface\s+(\w+)"), 1),
        ("delegate", re.compile(r"\bdelegate\b.*?(\w+)\s*(?:<[^>]*>)?\s*\("), 1),
        ("field", re.compile(r"^[^({]*=(?!>)"), None),
        ("method", re.compile(r"([~\w]+)\s*(?:<[^>()]*>)?\s*\("), 1),
        ("property", re.compile(r"(\w+)\s*(?:\{|=>)"), 1),
    ],
    "go": [
        ("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), 1),
        ("type", re.compile(r"^type\s*\((?:.*\n)?\s*(\w+)[^\n]*\n\s*\)\Z", re.DOTALL), 1),
        ("type", re.compile(r"^type\s+(\w+)"), 1),
    ],
}
_NAMES["js"] = _NAMES["ts"] = [
    ("class", re.compile(r"^(?:abstract\s+)?class\s+(\w+)"), 1),
    ("other", re.compile(r"^(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function\s*\*?|interface|type|enum|namespace|module)\s+([\w.$]+)"), 1),
    ("statement", re.compile(r"^(?:export\b|import\b|const\b|let\b|var\b|if\b|for\b|while\b|return\b|try\b|switch\b)"), None),
]
_MEMBER = re.compile(r"^(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|get|set|\*)\s+)*(#?[\w$]+)\s*[(<=:;?!]")


def _label(head: str, lang: str, inside: bool) -> tuple[str, str]:
    bare = re.sub(r"^\s*(?:\[[^\]]*\]\s*)+", "", head) if lang == "csharp" else re.sub(r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", head)
    for kind, pattern, group in _NAMES[lang]:
        if m := pattern.search(bare):
            return kind, m.group(group) if group else ""
    if inside and lang in ("js", "ts") and (m := _MEMBER.search(bare)):
        return "member", m.group(1)
    return "other", ""


class _Scanner:
    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        self.skip = _GO_SKIP if lang == "go" else _SKIP

    def items(self, at: int, end: int, inside: bool) -> Iterator[Decl]:
        text = self.text
        while True:
            while at < end and (text[at].isspace() or text[at] == ";"):
                at += 1
            if at >= end:
                return
            if text.startswith(("//", "/*"), at):
                stop = self.skip.match(text, at).end()
                yield Decl("comment", "", at, stop)
            elif text[at] == "#" and self.lang == "csharp":
                yield (d := self.directive(at, end, inside))
                stop = d.end
            else:
                yield (d := self.item(at, end, inside))
                stop = d.end
            at = max(stop, at + 1)

    def directive(self, at: int, end: int, inside: bool) -> Decl:
        """A line beginning with #; an #if with all to its #endif as members."""
        text = self.text
        line_end = lambda p: end if (e := text.find("\n", p, end)) < 0 else e
        if not text.startswith("#if", at):
            return Decl("directive", "", at, line_end(at))
        depth, p = 0, at
        for m in re.compile(r"^[ \t]*#(if|endif)\b", re.MULTILINE).finditer(text, text.rfind("\n", 0, at) + 1, end):
            depth += 1 if m[1] == "if" else -1
            p = m.start() + m[0].index("#")
            if depth == 0:
                break
        stop = line_end(p) if depth == 0 else end
        return Decl("#if", "", at, stop, -1, list(self.items(line_end(at), p if depth == 0 else end, inside)))

    def item(self, at: int, end: int, inside: bool) -> Decl:
        text, p, depth, body, opened = self.text, at, 0, -1, -1
        while p < end:
            c = text[p]
            if c in "\"'`/@$" and (m := self.skip.match(text, p)) and not (c == "'" and self.lang == "go" and m.end() - p > 12):
                p = m.end()
                continue
            if c in _OPEN:
                if c == "{" and depth == 0 and body < 0:
                    body = opened = p
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if depth < 0:
                    break
                if depth == 0 and c == "}" and not (m := _GOES_ON.match(text, p + 1, end)):
                    p += 1
                    break
                if depth == 0 and c == "}" and text[m.end() - 1] == ";":
                    p = m.end()
                    break
            elif depth == 0 and c == ";":
                p += 1
                break
            elif depth == 0 and c == "\n" and self.lang in ("go", "js", "ts") and self._ends(at, p, end):
                break
            p += 1
        stop = p
        head = text[at : body if body >= 0 else stop]
        kind, name = _label(head + ("{" if body >= 0 else ""), self.lang, inside)
        d = Decl(kind, name, at, stop)
        if kind in CONTAINERS[self.lang] and opened >= 0:
            d.body = opened
            d.members = list(self.items(opened + 1, stop - 1, True))
        elif self.lang == "go" and kind == "other":
            d.name = ""
        return d

    def _ends(self, at: int, p: int, end: int) -> bool:
        """Whether a line end at nesting 0 ends a statement."""
        before = self.text[at:p].rstrip()
        after = self.text[p:end].lstrip()
        return bool(before) and before[-1] not in "=,+-*/&|<>?:(.{" and not (self.lang != "go" and (after[:1] in ("{", ".", "?", ":", "=", "&", "|", ")") or before.startswith("@") and "\n" not in before and " " not in before)) and not before.endswith(" extends")


def declarations(text: str, lang: str) -> list[Decl]:
    if lang == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
            return []
    return list(_Scanner(text, lang).items(0, len(text), False))


def chunk_source(path: str, content: bytes | str | None, max_lines: int = MAX_LINES, overlap: int = OVERLAP, merge_lines: int = MERGE_LINES) -> list[Chunk]:
    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
    if not text:
        return []
    name = path.rsplit("/", 1)[-1]
    lang = LANGUAGES.get(name[name.rfind(".") :].lower() if "." in name else "")
    if lang is None:
        return line_chunks(text, 1, "", max_lines, overlap)
    size = window_options(max_lines, overlap)[0]
    ends = [m.start() for m in re.finditer("\n", text)]
    row = lambda p: bisect_left(ends, p) + 1

    def chunks(d: Decl, prefix: str) -> list[Chunk]:
        symbol = f"{prefix}.{d.name}" if prefix and d.name else d.name
        first, last, content = row(d.start), row(max(d.start, d.end - 1)), text[d.start : d.end]
        if last - first + 1 <= size:
            return [Chunk(first, last, symbol, content)]
        if d.kind in CONTAINERS[lang] and d.members:
            out = []
            if d.body >= 0:
                head, until = text[d.start : d.body].rstrip(" \t\r\n"), row(d.body)
                if head.strip():
                    out = [Chunk(first, until, symbol, head)] if until - first + 1 <= size else line_chunks(head, first, symbol, max_lines, overlap)
            return out + [c for m in d.members for c in chunks(m, symbol or prefix)]
        return line_chunks(content, first, symbol, max_lines, overlap)

    found = merge_small([c for d in declarations(text, lang) for c in chunks(d, "")], size, merge_lines)
    return found or line_chunks(text, 1, "", max_lines, overlap)


def code_chunks(files: DataFrame, key: str = "path", max_lines: int = MAX_LINES, overlap: int = OVERLAP, done: Accumulator | None = None) -> DataFrame:
    """key, ordinal, start_line, end_line, symbol, content, error of (key, path, content); a file that fails has its error in one row.

    ``done`` counts files as tasks finish them (those of a task that is run again, again).
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.operators.code_chunks import PIECE, chunk_source

        table = lambda rows: pd.DataFrame(rows, columns=["key", "ordinal", "start_line", "end_line", "symbol", "content", "error"])
        for pdf in batches:
            out = []
            for k, path, content in zip(pdf["_key"], pdf["path"], pdf["content"], strict=True):
                try:
                    for i, c in enumerate(chunk_source(path, content, max_lines, overlap)):
                        out.append((k, i, c.start_line, c.end_line, c.symbol, c.content, None))
                except Exception as e:  # one file's failure is reported and leaves the others alone
                    out.append((k, -1, 0, 0, "", "", f"{path}: {e}"))
                if len(out) >= PIECE:
                    yield table(out)
                    out = []
            if done is not None:
                done.add(len(pdf))
            yield table(out)

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("_key"), "path", "content").mapInPandas(run, f"key {kind}, ordinal int, start_line int, end_line int, symbol string, content string, error string")
    return rows.withColumnRenamed("key", key)
