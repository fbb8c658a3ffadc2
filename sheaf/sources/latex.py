"""LaTeX sources: files of a project as one text, macros, tables, bibliographies.  What can't be read is a row or a mark, not an error."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_DEPTH, MOST_CHARACTERS, MOST_COLUMNS, MOST_CELLS = 32, 1 << 26, 512, 1 << 18

_COMMENT = re.compile(r"((?<!\\)(?:\\\\)*)%[^\n]*\n?")
_INPUT = re.compile(r"\\(?:input|include|subfile)\s*\{([^{}]*)\}")


def _closing(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """The place of the bracket that closes the one before ``at``; -1 if there is none."""
    depth = 1
    for m in re.compile(r"\\.|[" + re.escape(opening + closing) + "]", re.S).finditer(text, at):
        depth += {opening: 1, closing: -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return -1


def _argument(text: str, at: int) -> tuple[str, int]:
    """What a macro takes at ``at``: a group, a command or one character."""
    while at < len(text) and text[at].isspace():
        at += 1
    if text[at : at + 1] == "{":
        end = _closing(text, at + 1)
        return (text[at + 1 : end], end + 1) if end >= 0 else (text[at + 1 :], len(text))
    m = re.compile(r"\\(?:[A-Za-z]+|.)|.", re.S).match(text, at)
    return (m[0], m.end()) if m else ("", at)


def _optional(text: str, at: int) -> tuple[str | None, int]:
    m = re.compile(r"\s*\[").match(text, at)
    end = text.find("]", m.end()) if m else -1
    return (text[m.end() : end], end + 1) if end >= 0 else (None, at)


def included(entry: str, files: dict[str, str]) -> tuple[str, list[str]]:
    """The text of ``entry`` with the files it names in their places, and the names that weren't found or go round."""
    missing: list[str] = []

    def read(name: str, within: tuple[str, ...]) -> str:
        text, out, at = _COMMENT.sub(r"\1", files[name]), [], 0
        for m in _INPUT.finditer(text):
            told = posixpath.normpath(posixpath.join(posixpath.dirname(entry), m[1].strip()))
            found = next((f for f in (told, told + ".tex") if f in files), None)
            out.append(text[at : m.start()])
            at = m.end()
            if found is None or found in within or len(within) >= MOST_DEPTH:
                missing.append(m[1].strip())
            else:
                out.append(read(found, (*within, found)))
        return "".join([*out, text[at:]])

    return (read(entry, (entry,)), missing) if entry in files else ("", [entry])


def projects(sources: DataFrame, entry: str = "main.tex") -> DataFrame:
    """(project, text, missing) of sources (project, name, text); a task holds one project's files."""

    def one(files: pd.DataFrame) -> pd.DataFrame:
        text, missing = included(entry, {posixpath.normpath(n): t or "" for n, t in zip(files["name"], files["text"], strict=True)})
        return pd.DataFrame([(files["project"].iloc[0], text, missing)], columns=["project", "text", "missing"])

    return sources.select("project", "name", "text").groupBy("project").applyInPandas(one, "project string, text string, missing array<string>")


def substituted(body: str, args: list[str]) -> str:
    """``#n`` by the n-th argument, ``##`` by ``#``; what is inserted isn't searched again."""
    return re.sub(r"#([1-9]|#)", lambda m: "#" if m[1] == "#" else args[int(m[1]) - 1] if int(m[1]) <= len(args) else m[0], body)


_DEFINES = re.compile(r"\\(newcommand|renewcommand|providecommand|DeclareRobustCommand)\*?\s*(?:\{\s*\\([A-Za-z]+)\s*\}|\\([A-Za-z]+))|\\def\s*\\([A-Za-z]+)((?:#[1-9])*)\s*(?=\{)")
_COMMAND = re.compile(r"\\([A-Za-z]+|.)", re.S)


def expanded(text: str) -> str:
    """``text`` with its own macros carried out and their definitions gone; arguments lie where a macro is called.

    Beyond 32 levels or 64 MB of result, macros stay as written.
    """
    known: dict[str, tuple[int, str | None, str]] = {}
    made = 0

    def walk(text: str, depth: int) -> str:
        nonlocal made
        out, at = [], 0
        while m := _COMMAND.search(text, at):
            out.append(text[at : m.start()])
            at = m.end()
            if d := _DEFINES.match(text, m.start()):
                at = d.end()
                name, count, default = d[2] or d[3] or d[4], (d[5] or "").count("#"), None
                if d[1]:
                    told, at = _optional(text, at)
                    count = int(told) if told and told.strip().isdigit() else 0
                    default, at = _optional(text, at)
                body, at = _argument(text, at)
                if not (d[1] == "providecommand" and name in known):
                    known[name] = (count, default, body)
                continue
            if m[1] not in known or depth >= MOST_DEPTH or made > MOST_CHARACTERS:
                out.append(m[0])
                continue
            count, default, body = known[m[1]]
            args = []
            if default is not None and count:
                given, at = _optional(text, at)
                args.append(default if given is None else given)
            while len(args) < count:
                value, at = _argument(text, at)
                args.append(value)
            inner = substituted(body, args)
            made += len(inner)
            out.append(walk(inner, depth + 1))
        return "".join([*out, text[at:]])

    return walk(_COMMENT.sub(r"\1", text), 0)


def columns_of(spec: str) -> list[str]:
    """Alignments (l, c, r, p, X) of a table's column specification, repeats written out."""
    out, at = [], 0
    while at < len(spec) and len(out) <= MOST_COLUMNS:
        c, at = spec[at], at + 1
        if c in "lcrX":
            out.append(c)
        elif c in "pmb":
            _, at = _argument(spec, at)
            out.append("p")
        elif c in "@!><":
            _, at = _argument(spec, at)
        elif c == "*":
            times, at = _argument(spec, at)
            part, at = _argument(spec, at)
            inner = columns_of(part)
            out += inner * min(int(times) if times.strip().isdigit() else 0, MOST_COLUMNS // max(len(inner), 1) + 1)
    return out


_TABLE = re.compile(r"\\(begin|end)\s*\{(tabular\*?|tabularx|longtable|array)\}")
_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|endlastfoot)\b|\\(?:cline|cmidrule)\s*(?:\([^)]*\))?\s*\{[^{}]*\}")
_PARTS = re.compile(r"\\\\\*?(?:\s*\[[^\]]*\])?|\\tabularnewline\b|\\begin\s*\{|\\end\s*\{|\\.|[{}&]", re.S)


def _grid(body: str) -> list[list[str]]:
    """Rows of cells, parted where no group and no environment is open."""
    rows, start, groups, inner = [[]], 0, 0, 0
    for m in _PARTS.finditer(body):
        said = m[0]
        groups += {"{": 1, "}": -1}.get(said, 0)
        if said.startswith(("\\begin", "\\end")):
            inner += 1 if said.startswith("\\begin") else -1
            groups += 1
        elif not groups and not inner and (said == "&" or said.startswith("\\\\") or said == "\\tabularnewline"):
            rows[-1].append(body[start : m.start()])
            start = m.end()
            if said != "&":
                rows.append([])
    rows[-1].append(body[start:])
    return rows


def tables(text: str) -> Iterator[tuple]:
    """(table, row, column, colspan, rowspan, align, text, problem) of every outermost table's cells; rows of rules alone
    are none."""
    depth, begin, number = 0, None, 0
    text = _COMMENT.sub(r"\1", text)
    for m in _TABLE.finditer(text):
        depth = max(depth + (1 if m[1] == "begin" else -1), 0)
        if m[1] == "begin" and depth == 1:
            begin = m
        if m[1] == "begin" or depth or begin is None:
            continue
        at = begin.end()
        if begin[2] in ("tabular*", "tabularx"):
            _, at = _argument(text, at)
        _, at = _optional(text, at)
        spec, at = _argument(text, at)
        aligns, rows = columns_of(spec), _grid(text[at : m.start()])
        if len(aligns) > MOST_COLUMNS or sum(map(len, rows)) > MOST_CELLS:
            yield number, None, None, None, None, None, None, "beyond the limits"
            rows = []
        row = 0
        for cells in rows:
            cells = [_RULES.sub("", c).strip() for c in cells]
            if cells == [""]:
                continue
            column = 0
            for cell in cells:
                across, down, align = 1, 1, aligns[column] if column < len(aligns) else None
                if cell.startswith("\\multicolumn"):
                    count, after = _argument(cell, len("\\multicolumn"))
                    own, after = _argument(cell, after)
                    across, align = max(int(count) if count.strip().isdigit() else 1, 1), next(iter(columns_of(own)), align)
                    cell = _argument(cell, after)[0].strip()
                if cell.startswith("\\multirow"):
                    _, after = _optional(cell, len("\\multirow"))
                    count, after = _argument(cell, after)
                    _, after = _argument(cell, after)
                    down = max(int(count) if count.strip().isdigit() else 1, 1)
                    cell = _argument(cell, after)[0].strip()
                yield number, row, column, across, down, align, cell, None
                column += across
            row += 1
        number += 1
        begin = None


TABLES = {"table": "int", "row": "int", "column": "int", "colspan": "int", "rowspan": "int", "align": "string", "text": "string", "problem": "string"}


def _entry_end(text: str, at: int, bracket: str) -> int:
    braces, rounds, quoted = 0, 0, False
    for m in re.compile(r'\\.|["{}()]', re.S).finditer(text, at):
        c = m[0]
        if c == '"':
            quoted ^= not braces
        elif c == "{":
            braces += 1
        elif c == "}" and braces:
            braces -= 1
        elif not quoted and not braces and (c == "}" if bracket == "{" else c == ")" and not rounds):
            return m.start()
        elif bracket == "(" and not quoted and not braces and c in "()":
            rounds += 1 if c == "(" else -1
    return -1


_FIELD = re.compile(r"[\s,]*(?:([\w]*)\s*(=?)\s*)")


def _fields(text: str, problems: list[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    at = 0
    while text[at:].strip(", \t\r\n"):
        m = _FIELD.match(text, at)
        if not m[2]:
            problems.append("field-syntax")
            break
        at = m.end()
        if text[at : at + 1] == "{":
            end = _closing(text, at + 1)
        elif text[at : at + 1] == '"':
            end, braces = -1, 0
            for q in re.compile(r'\\.|["{}]', re.S).finditer(text, at + 1):
                if q[0] == '"' and not braces:
                    end = q.start()
                    break
                braces = max(braces + {"{": 1, "}": -1}.get(q[0], 0), 0)
        else:
            comma = text.find(",", at)
            comma = len(text) if comma < 0 else comma
            value, at = text[at:comma].strip(), comma
            if not re.fullmatch("[0-9]*", value):
                problems.append("string-expression")
                value = ""
            found[m[1].lower()] = value
            continue
        if end < 0:
            problems.append("unterminated-field")
        found[m[1].lower()] = (text[at + 1 : end] if end >= 0 else text[at + 1 :]).strip()
        at = end + 1 if end >= 0 else len(text)
    return found


#: What is said of entries that hold no reference.
_NO_ENTRY = {"preamble": "preamble", "string": "string-definition"}


def bibliography(text: str) -> Iterator[tuple]:
    """(ord, kind, key, fields, problem) of every entry, and of everything that couldn't be read."""
    at, number = 0, 0
    while (at := text.find("@", at)) >= 0:
        m = re.compile(r"@([^\W\d_]*)\s*([{(]?)").match(text, at)
        at, kind, problems = m.end(), m[1].lower(), []
        if not m[2]:
            yield number, kind, None, None, "entry-header"
            number += 1
            continue
        end = _entry_end(text, at, m[2])
        body = text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text)
        if end < 0:
            problems.append("unterminated-entry")
        key, comma, rest = body.partition(",")
        entry = None
        if kind in _NO_ENTRY:
            problems.append(_NO_ENTRY[kind])
        elif kind != "comment" and not comma:
            problems.append("entry-key")
        elif kind != "comment" and (not key.strip() or re.search(r"[{}\\%]", key)):
            problems.append("invalid-key")
        elif kind != "comment":
            entry = _fields(rest, problems)
        for problem in problems:
            yield number, kind, None, None, problem
            number += 1
        if entry is not None:
            yield number, kind, key.strip(), entry, None
            number += 1


BIBLIOGRAPHY = {"ord": "int", "kind": "string", "key": "string", "fields": "map<string,string>", "problem": "string"}
