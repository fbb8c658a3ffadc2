"""Notations as trees and parts: MathML, reactions.  What can't be read is one row with ``problem``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers.expat import ExpatError

from sheaf.sources.formats import xml_events

#: What the arguments of an element stand for, in their order.
_ROLES = {
    "mfrac": ("fraction", "numerator", "denominator"), "mroot": ("radical", "base", "degree"), "msup": ("superscript", "base", "upper"),
    "msub": ("subscript", "base", "lower"), "msubsup": ("scripts", "base", "lower", "upper"), "mover": ("over", "base", "upper"),
    "munder": ("under", "base", "lower"), "munderover": ("limits", "base", "lower", "upper"),
}
#: Elements that only hold others, and those that hold text.
_HOLDERS = frozenset("math mrow mstyle mpadded mphantom semantics merror maction menclose".split())
_RUNS = {"mi": "identifier", "mn": "number", "mo": "operator", "mtext": "text", "ms": "text"}
_FENCES = {"(": ")", "[": "]", "{": "}", "⟨": "⟩", "⌈": "⌉", "⌊": "⌋"}
_INVISIBLE = dict.fromkeys(range(0x2061, 0x2065))


def _tree(source: str) -> tuple:
    """(name, attributes, children) of the formula; a child is such a tuple or text."""
    start, end = source.find("<math"), source.rfind("</math>")
    if start < 0:
        raise ValueError("no formula")
    stack: list[tuple] = [("", {}, [])]
    for _, _, kind, name, attrs, text, _, _ in xml_events((source[start : end + 7] if end >= 0 else source[start : source.rfind("/>") + 2]).encode()):
        if kind == "start":
            stack.append((name.rpartition("}")[2].rpartition(":")[2], attrs, []))
        elif kind == "end":
            done = stack.pop()
            stack[-1][2].append(done)
        else:
            stack[-1][2].append(text)
    found = stack[0][2]
    if not found or found[0][0] != "math":
        raise ValueError("no formula")
    return found[0]


def _said(element: tuple) -> str:
    return "".join(c if isinstance(c, str) else _said(c) for c in element[2])


def _token(element: tuple) -> str:
    return " ".join(_said(element).split()).translate(_INVISIBLE)


def math_nodes(source: str) -> Iterator[tuple]:
    """(ord, parent, role, kind, text, problem) of a formula's expression tree, parents first; fences are delimiters."""
    rows: list[tuple] = []

    def put(parent: int, role: str, kind: str, text: str | None = None) -> int:
        rows.append((len(rows), parent, role, kind, text, None))
        return len(rows) - 1

    def fence(element: tuple) -> str | None:
        return _token(element) if element[0] == "mo" and element[1].get("fence") != "false" else None

    def row(children: list, parent: int, role: str) -> None:
        at = 0
        while at < len(children):
            opens = fence(children[at])
            if opens in _FENCES:
                depth, end = 0, None
                for k in range(at, len(children)):
                    said = fence(children[k])
                    depth += (said == opens) - (said == _FENCES[opens])
                    if not depth:
                        end = k
                        break
                if end is not None:
                    row(children[at + 1 : end], put(parent, role, "delimiter", opens + _FENCES[opens]), "element")
                    at = end + 1
                    continue
            one(children[at], parent, role)
            at += 1

    def one(element: tuple, parent: int, role: str) -> None:
        name, attrs, _ = element
        inner = [c for c in element[2] if not isinstance(c, str)]
        if name in _RUNS:
            put(parent, role, _RUNS[name], _token(element))
        elif name in _HOLDERS:
            row(inner, parent, role)
        elif name in _ROLES:
            kind, *roles = _ROLES[name]
            own = put(parent, role, kind)
            for part, told in zip(inner, roles, strict=False):
                one(part, own, told)
        elif name == "msqrt":
            row(inner, put(parent, role, "radical"), "base")
        elif name == "mfenced":
            own = put(parent, role, "delimiter", attrs.get("open", "(") + attrs.get("close", ")"))
            for part in inner:
                one(part, own, "element")
        elif name == "mtable":
            own = put(parent, role, "matrix")
            for k, line in enumerate(i for i in inner if i[0] in ("mtr", "mlabeledtr")):
                for j, cell in enumerate(c for c in line[2] if not isinstance(c, str)):
                    row([c for c in cell[2] if not isinstance(c, str)], own, f"{k},{j}")
        elif name not in ("annotation", "annotation-xml", "mspace"):
            row(inner, parent, role)

    try:
        one(_tree(source), -1, "root")
    except (ValueError, ExpatError) as e:
        rows = [(0, -1, "root", None, None, str(e))]
    yield from rows


MATH = {"ord": "int", "parent": "int", "role": "string", "kind": "string", "text": "string", "problem": "string"}

#: Arrows of reactions, longer ones first.
ARROWS = {"<=>": "equilibrium", "<->": "left-right", "->": "right", "<-": "left", "=>": "double", "<=": "reverse equilibrium"}
_ARROW = re.compile("|".join(map(re.escape, ARROWS)))
_STATE, _MARKER = re.compile(r"\s*\((s|l|g|aq)\)$"), re.compile(r"\s+(\^|v)$")
_CHARGE = re.compile(r"\^\{([0-9]*[+-])\}$|\^([0-9]*[+-])$|([+-])$")
_COUNT = re.compile(r"([0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?)\s*(?=[A-Z(\[])")
_ATOM = re.compile(r"([A-Z][a-z]?)|([(\[])|([)\]])|(\*|\.|·)([0-9]*)")
_TIMES = re.compile(r"_?\{?([0-9]+)\}?")


def atoms(formula: str) -> dict[str, int]:
    """Elements and how often they occur, through groups and hydrate dots."""
    if len(formula) > 4096:
        raise ValueError("a formula beyond the limits")
    stack: list[dict[str, int]] = [{}]
    whole, at = {}, 0
    factor = 1

    def add(to: dict[str, int], what: dict[str, int], times: int) -> None:
        for element, n in what.items():
            to[element] = to.get(element, 0) + n * times

    while at < len(formula):
        m = _ATOM.match(formula, at)
        if not m:
            raise ValueError(f"unreadable at {formula[at:]}")
        at = m.end()
        if m[2]:
            stack.append({})
            continue
        if m[4]:
            if len(stack) > 1:
                raise ValueError("an open group")
            add(whole, stack[0], factor)
            stack[0], factor = {}, int(m[5] or 1)
            continue
        if m[3] and len(stack) == 1:
            raise ValueError("a group that never opened")
        what = {m[1]: 1} if m[1] else stack.pop()
        times = _TIMES.match(formula, at)
        at = times.end() if times else at
        add(stack[-1], what, int(times[1]) if times else 1)
    if len(stack) > 1:
        raise ValueError("an open group")
    add(whole, stack[0], factor)
    return whole


def _conditions(text: str) -> tuple[list[str], str]:
    found = []
    while len(found) < 2 and text.startswith("[") and "]" in text:
        inner, _, text = text[1:].partition("]")
        found.append(inner.strip())
    return found, text


def reaction(source: str) -> Iterator[tuple]:
    """(side, ord, coefficient, formula, charge, state, marker, atoms, arrow, above, below, problem) of a reaction's species."""
    body = source.strip()
    if body.startswith("\\ce{"):
        depth, end = 0, len(body)
        for m in re.finditer("[{}]", body):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                end = m.start()
                break
        body = body[4:end].strip()
    try:
        m = _ARROW.search(body)
        if not m:
            raise ValueError("no arrow")
        conditions, right = _conditions(body[m.end() :])
        above, below = (*conditions, None, None)[:2]
        out = []
        for side, text in (("reactant", body[: m.start()]), ("product", right)):
            if not text.strip():
                raise ValueError(f"no {side}")
            for k, part in enumerate(re.split(r"\s+\+\s+|(?<=\))\+(?=\S)", text.strip())):
                part, marker, state, charge = part.strip(), None, None, None
                if found := _MARKER.search(part):
                    marker, part = {"^": "gas", "v": "precipitate"}[found[1]], part[: found.start()]
                if found := _STATE.search(part):
                    state, part = found[1], part[: found.start()]
                count = _COUNT.match(part)
                part = part[count.end() :] if count else part
                if found := _CHARGE.search(part):
                    charge, part = found[1] or found[2] or found[3], part[: found.start()]
                if not part:
                    raise ValueError("an empty species")
                size = int(re.sub("[+-]", "", charge) or 1) * (-1 if charge[-1] == "-" else 1) if charge else 0
                out.append((side, k, count[1] if count else "1", part, size, state, marker, atoms(part), ARROWS[m[0]], above, below, None))
        yield from out
    except ValueError as e:
        yield (None,) * 11 + (str(e),)


REACTION = {"side": "string", "ord": "int", "coefficient": "string", "formula": "string", "charge": "int", "state": "string", "marker": "string", "atoms": "map<string,int>", "arrow": "string", "above": "string", "below": "string", "problem": "string"}
