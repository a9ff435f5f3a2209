"""Comments of source files: one Arrow pass per file finds and groups them.

A language's syntax becomes one regular expression whose alternatives are its blocks,
line comments and whole strings, so the scan jumps from match to match.  A file that
can't be scanned gives a row with ``error`` and the job goes on.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrade.functions import licenses
from lexigrade.operators.syntaxes import SYNTAXES, Syntax

#: Languages whose rules here follow a grammar closely enough to not be called approximate.
EXACT = frozenset({"html", "xml"})


@dataclass
class Span:
    start: int
    end: int
    block: bool
    after_code: bool
    raw: str
    row: int
    end_row: int


def _string_pattern(open_: str, close: str, escape: str, doubled: bool, multiline: bool) -> str:
    parts = [f"{re.escape(escape)}[\\s\\S]"] if escape else []
    if doubled:
        parts.append(re.escape(close * 2))
    parts.append(f"(?!{re.escape(close)})" + ("[\\s\\S]" if multiline else "[^\\n]"))
    return f"{re.escape(open_)}(?:{'|'.join(parts)})*(?:{re.escape(close)})?"


@lru_cache(maxsize=None)
def scanner(language: str) -> tuple[re.Pattern, Syntax]:
    syntax = SYNTAXES[language]
    blocks = "|".join(re.escape(b[0]) for b in sorted(syntax.block, key=lambda b: -len(b[0])))
    before = r"(?:(?<=\s)|\A)" if syntax.after_space else ""
    lines = "|".join(before + re.escape(p) + r"[^\n]*" for p in sorted(syntax.line, key=len, reverse=True))
    strings = "|".join(_string_pattern(*s) for s in sorted(syntax.strings, key=lambda s: -len(s[0])))
    parts = [f"(?P<{name}>{p})" for name, p in (("block", blocks), ("line", lines), ("string", strings)) if p]
    return re.compile("|".join(parts) if parts else r"(?!)"), syntax


def _block_end(text: str, at: int, open_: str, close: str, nested: bool) -> int:
    depth, at = 1, at + len(open_)
    edge = re.compile(re.escape(close) + (f"|{re.escape(open_)}" if nested else ""))
    while depth:
        found = edge.search(text, at)
        if not found:
            return len(text)
        depth += -1 if found.group() == close else 1
        at = found.end()
    return at


def spans(text: str, language: str) -> list[Span]:
    """Every comment of the text, in order; unterminated blocks end with it."""
    pattern, syntax = scanner(language)
    out: list[Span] = []
    at, code, row, counted = 0, False, 0, 0
    while found := pattern.search(text, at):
        start, end = found.span()
        code = code or text[at:start].strip() != ""
        if found.lastgroup == "string":
            code, at = True, max(end, start + 1)
            continue
        if found.lastgroup == "block":
            kind = max((b for b in syntax.block if text.startswith(b[0], start)), key=lambda b: len(b[0]))
            end = _block_end(text, start, *kind)
        elif text[start:end].endswith("\r"):
            end -= 1
        row += text.count("\n", counted, start)
        counted = start
        out.append(Span(start, end, found.lastgroup == "block", code, text[start:end], row, row + text.count("\n", start, end)))
        at = end
    return out


def opener_of(span: Span, syntax: Syntax) -> str:
    found = [p for p in (*syntax.doc, *(b[0] for b in syntax.block if span.block), *(() if span.block else syntax.line)) if span.raw.startswith(p)]
    return max(found, key=len) if found else ""


def body_of(span: Span, syntax: Syntax) -> str:
    """The comment without its markers and gutter."""
    opener = opener_of(span, syntax)
    text = span.raw[len(opener) :]
    if not span.block:
        mark = opener[-1:] or " "
        return text.lstrip(mark if mark in "/#-;%!" else "").strip()
    close = next((b[1] for b in syntax.block if span.raw.startswith(b[0])), "")
    text = text[: -len(close)] if close and text.endswith(close) else text
    return "\n".join(re.sub(r"^[ \t]*\*+(?!/) ?", "", line) for line in text.lstrip("*!").split("\n")).strip()


def _target(text: str, end: int, syntax: Syntax) -> str | None:
    """Name of the declaration on the lines after a comment, past decorators and attributes."""
    if not syntax.declaration:
        return None
    at = text.find("\n", end)
    while at >= 0:
        stop = text.find("\n", at + 1)
        line, at = text[at + 1 : stop if stop >= 0 else len(text)], stop
        if not line.strip():
            return None
        if re.match(r"\s*(?:@\w|#\[|\[[A-Z])", line):
            continue
        found = re.match(syntax.declaration, line)
        return next((g for g in found.groups() if g), None) if found else None
    return None


@lru_cache(maxsize=1)
def _known() -> tuple[frozenset, frozenset]:
    return frozenset(licenses.WORDS), frozenset(licenses.TRIGRAMS)


def _has(pattern: str, text: str) -> bool:
    return re.search(pattern, text, re.ASCII) is not None


def is_license_text(body: str) -> bool:
    return _has(licenses.BOILERPLATE, body) or (_has(licenses.NOTICE, body) and _has(licenses.NAME, body))


def is_license_line(line: str) -> bool:
    if any(_has(p, line) for p in (licenses.NOTICE, licenses.BOILERPLATE, licenses.NAME)):
        return True
    known, triples = _known()
    words = re.findall("[a-z0-9]+", line.lower())
    if len(words) < 3:
        return bool(words) and all(w in known for w in words)
    hits = "".join("x" if " ".join(words[k : k + 3]) in triples else "." for k in range(len(words) - 2))
    return hits.count("x") / len(hits) >= 0.6 or "xxxx" in hits


def code(text: str, language: str) -> str:
    """The text without its comments and strings."""
    pattern, syntax = scanner(language)
    out, at = [], 0
    while found := pattern.search(text, at):
        start, end = found.span()
        if found.lastgroup == "block":
            kind = max((b for b in syntax.block if text.startswith(b[0], start)), key=lambda b: len(b[0]))
            end = _block_end(text, start, *kind)
        out.append(text[at:start])
        at = max(end, start + 1)
    return " ".join([*out, text[at:]])


def _lines(body: str) -> list[str]:
    return [s for s in (re.sub(r"^[\s*]*", "", line).rstrip() for line in body.split("\n")) if s]


def is_data_line(line: str) -> bool:
    return bool(re.search(licenses.MARKER.replace(r"\z", r"\Z"), line) or re.search(licenses.DATA_LINE.replace(r"\z", r"\Z"), line))


def is_structured(body: str) -> bool:
    lines = _lines(body)
    data = sum(bool(re.search(licenses.DATA_LINE.replace(r"\z", r"\Z"), s)) for s in lines)
    return bool(lines and re.search(licenses.MARKER.replace(r"\z", r"\Z"), lines[0])) or (len(lines) >= 3 and data / len(lines) >= 0.6)


def _cut(bodies: list[str], in_part, drop) -> list[list[int]]:
    """Indices that are left when parts go, in stretches."""
    flags, last = [], False
    for body in bodies:
        lines = _lines(body)
        last = all(map(in_part, lines)) if lines else last
        flags.append(last)
    edges = [k for k in range(len(flags)) if k == 0 or flags[k] != flags[k - 1]] + [len(flags)]
    out: list[list[int]] = [[]]
    for a, z in zip(edges, edges[1:], strict=False):
        if drop("\n".join(bodies[a:z])):
            out.append([])
        else:
            out[-1] += range(a, z)
    return [part for part in out if part]


def cut_groups(bodies: list[str]) -> list[list[int]]:
    """Parts of a run of comments without structured data, then without license text."""
    if len(bodies) == 1:
        return [] if is_structured(bodies[0]) else [[0]]
    out = []
    for part in _cut(bodies, is_data_line, is_structured):
        if is_structured("\n".join(bodies[k] for k in part)):
            continue
        if len(part) == 1:
            out.append(part)
        else:
            out += [[part[k] for k in some] for some in _cut([bodies[k] for k in part], is_license_line, is_license_text)]
    return out


def _looks_like_code(body: str, language: str) -> bool:
    if not re.search(r"[;{}()=<>\[\]]", body):
        return False
    if language == "python":
        try:
            return not all(isinstance(s, ast.Expr) and isinstance(s.value, (ast.Name, ast.Constant)) for s in ast.parse(body).body)
        except (SyntaxError, ValueError):
            return False
    if language in ("ruby", "shellscript") or language not in ("javascript", "javascriptreact", "typescript", "typescriptreact", "go", "rust", "java", "c", "cpp", "csharp", "php", "css"):
        return False
    lines = [s.strip() for s in body.split("\n") if s.strip()]
    return all(re.search(r"[;{}]\s*$|^\s*[})\]]|^(?:if|for|while|return|else)\b.*[({]", s) for s in lines)


Place = tuple[int, int]


def docstrings(text: str) -> list[tuple[Place, Place, str, str | None]]:
    """(start, end, raw text, owner's name) of Python docstrings; a place is a row and a column."""
    out = []
    lines = text.split("\n")

    def place(line: int, offset: int) -> Place:  # the parser counts bytes
        return line - 1, len(lines[line - 1].encode(errors="surrogatepass")[:offset].decode(errors="ignore")) if line <= len(lines) else offset

    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                raw = ast.get_source_segment(text, first.value) or "\n".join(lines[first.lineno - 1 : first.end_lineno])
                out.append((place(first.lineno, first.col_offset), place(first.end_lineno or first.lineno, first.end_col_offset or 0), raw, getattr(node, "name", None)))
    return out


def loose_docstrings(text: str) -> list[tuple[Place, Place, str, str | None]]:
    """Docstrings of a file that doesn't parse: strings alone on their lines below a file's start, def or class."""
    pattern, _ = scanner("python")
    out, at = [], 0
    while found := pattern.search(text, at):
        start, end = found.span()
        at = max(end, start + 1)
        line = text.rfind("\n", 0, start) + 1
        if found.lastgroup != "string" or text[line:start].strip() or text[end : (text + "\n").index("\n", end)].strip():
            continue
        above = [s for s in text[:line].split("\n") if s.strip() and not s.lstrip().startswith("#")]
        owner = re.match(r"\s*(?:async\s+)?(?:def|class)\s+(\w+).*:\s*$", above[-1]) if above else None
        if owner or not above:
            row = text.count("\n", 0, start)
            last = row + text.count("\n", start, end), end - text.rfind("\n", 0, end) - 1
            out.append(((row, start - line), last, text[start:end], owner.group(1) if owner else None))
    return out


class Enclosing:
    """Names of the declarations whose braces enclose places of a text."""

    _NAMED = re.compile(r"\b(?:fn|struct|enum|trait|mod|union|impl(?:\s*<[^>]*>)?(?:\s+[\w:<>, ]+\s+for)?)\s+(\w+)")

    def __init__(self, text: str, language: str):
        pattern, syntax = scanner(language)
        self.places, self.names = [0], [None]
        stack: list[str | None] = []
        at = head = 0
        while at < len(text):
            found = pattern.search(text, at)
            stop = found.start() if found else len(text)
            for edge in re.finditer(r"[{};]", text[at:stop]):
                place = at + edge.start()
                if edge.group() == "{":
                    named = self._NAMED.search(text, head, place)
                    stack.append(named.group(1) if named else stack[-1] if stack else None)
                elif edge.group() == "}" and stack:
                    stack.pop()
                head = place + 1
                self.places.append(place)
                self.names.append(stack[-1] if stack else None)
            if not found:
                break
            end = found.end()
            if found.lastgroup == "block":
                kind = max((b for b in syntax.block if text.startswith(b[0], stop)), key=lambda b: len(b[0]))
                end = _block_end(text, stop, *kind)
            at = max(end, stop + 1)

    def __call__(self, place: int) -> str | None:
        return self.names[bisect_right(self.places, place) - 1]


def comments(text: str, language: str, errors: list[str] | None = None) -> list[dict]:
    """Grouped comments of a file, in document order, without directives, licenses and code.

    What kept a part of the file from being read exactly goes to ``errors``.
    """
    _, syntax = scanner(language)
    groups: list[list[Span]] = []
    line_start = lambda s: text.rfind("\n", 0, s.start) + 1
    trailing = lambda s: text[line_start(s) : s.start].strip() != ""
    for span in spans(text, language):
        if (span.start == 0 and span.raw.startswith("#!")) or (syntax.directive and re.match(syntax.directive, body_of(span, syntax), re.ASCII)):
            continue
        last = groups[-1][-1] if groups else None
        joins = last and not last.block and not span.block and opener_of(last, syntax) == opener_of(span, syntax) and not trailing(last) and not trailing(span) and span.row == last.end_row + 1
        if joins:
            groups[-1].append(span)
        else:
            groups.append([span])
    out: list[dict] = []
    inside: Enclosing | None = None
    for group in groups:
        bodies = [body_of(s, syntax) for s in group]
        for part in cut_groups(bodies):
            some, body = [group[k] for k in part], "\n".join(bodies[k] for k in part)
            first = some[0]
            if body.strip() == "" or is_license_text(body) or (not first.after_code and _has(licenses.LICENSE, body)):
                continue
            doc = any(first.raw.startswith(p) for p in syntax.doc)
            if not doc and _looks_like_code(body, language):
                continue
            kind = "doc" if doc else "block" if first.block else "line"
            if language == "rust" and first.raw.startswith(("//!", "/*!")):  # inner docs belong to what encloses them
                inside = inside or Enclosing(text, language)
                target = inside(first.start)
            else:
                target = None if trailing(first) else _target(text, some[-1].end, syntax)
            out.append(dict(start_row=first.row, start_column=first.start - line_start(first), end_row=some[-1].end_row, end_column=some[-1].end - text.rfind("\n", 0, some[-1].end) - 1, kind=kind, raw_text="\n".join(s.raw for s in some), target_symbol=target, approx=language not in EXACT))
    if language == "python":
        exact = True
        try:
            found = docstrings(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            exact, found = False, loose_docstrings(text)
            if errors is not None:
                errors.append(f"{type(e).__name__}: {e}"[:500])
        for (row, column), (last_row, last_column), raw, name in found:
            out.append(dict(start_row=row, start_column=column, end_row=last_row, end_column=last_column, kind="doc", raw_text=raw, target_symbol=name, approx=not exact))
        out.sort(key=lambda c: (c["start_row"], c["start_column"]))
    return out


_FIELDS = [("start_row", pa.int32()), ("start_column", pa.int32()), ("end_row", pa.int32()), ("end_column", pa.int32()), ("kind", pa.string()), ("raw_text", pa.string()), ("target_symbol", pa.string()), ("approx", pa.bool_())]
SCHEMA = "path string, language_id string, start_row int, start_column int, end_row int, end_column int, kind string, raw_text string, target_symbol string, approx boolean, error string"


def comments_of(files: DataFrame, errors: bool = False) -> DataFrame:
    """Comments of ``files(path, language_id, text)``; with errors, a row for each file that failed."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if language not in SYNTAXES or not text:
                    continue
                try:
                    errors_: list[str] = []
                    rows += [dict(path=path, language_id=language, error=None, **c) for c in comments(text, language, errors_)]
                    rows += [dict(path=path, language_id=language, error=e) for e in errors_]
                except Exception as e:  # noqa: BLE001  the file's failure is its result
                    rows.append(dict(path=path, language_id=language, error=f"{type(e).__name__}: {e}"[:500]))
            names = [("path", pa.string()), ("language_id", pa.string()), *_FIELDS, ("error", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in names], names=[n for n, _ in names])

    out = files.select("path", "language_id", "text").mapInArrow(mapped, SCHEMA)
    return out if errors else out.where("error is null").drop("error")


def code_of(files: DataFrame) -> DataFrame:
    """(path, text) of ``files(path, language_id, text)`` without comments and strings."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [code(text or "", language) if language in SYNTAXES else None for language, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "language_id", "text").mapInArrow(mapped, "path string, text string")


def html_comments(html: Column) -> Column:
    """Bodies of the comments of a page, by expression alone."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)<!--.*?(?:-->|\z)"), F.lit(0))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "^<!--", ""), r"-->\z", "")))
