"""Methods cut out of Java source text."""

from __future__ import annotations

import re

TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|[{}();@=,<>\[\].?&]|\S', re.S)
TYPES = {"class", "interface", "enum", "record"}


def tokens(source: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(source)]


def _closing(ts: list, at: int, opens: str, closes: str) -> int:
    depth = 0
    for k in range(at, len(ts)):
        depth += (ts[k][0] == opens) - (ts[k][0] == closes)
        if not depth:
            return k
    return len(ts) - 1


def _body(ts: list, lo: int, hi: int, name: str) -> tuple[int, int] | None:
    """Token range of the body of the type ``name`` that is declared directly within [lo, hi)."""
    k = lo
    while k < hi:
        if ts[k][0] in TYPES and k + 1 < hi and ts[k + 1][0] == name:
            start = next((j for j in range(k + 2, hi) if ts[j][0] == "{"), None)
            return None if start is None else (start + 1, _closing(ts, start, "{", "}"))
        k = _closing(ts, k, "{", "}") + 1 if ts[k][0] == "{" else k + 1
    return None


def slice_methods(source: str, type_name: str, method: str) -> list[str]:
    """The text of every overload of ``method`` in ``Outer$Inner``, with the comment before it.
    A constructor goes by the type's name or <init>; bodies of enum constants count."""
    ts = tokens(source)
    code = [t for t in ts if not t[0].startswith(("//", "/*"))]
    lo, hi = 0, len(code)
    names = type_name.rsplit(".", 1)[-1].split("$")
    for n in names:
        found = _body(code, lo, hi, n)
        if not found:
            return []
        lo, hi = found
    wanted = names[-1] if method in ("<init>", names[-1]) else method
    out: list[str] = []
    _members(source, ts, code, lo, hi, wanted, names[-1], out)
    return out


def _members(source, ts, code, lo, hi, wanted, owner, out) -> None:
    k = start = lo
    while k < hi:
        t = code[k][0]
        if t == "@" and k + 1 < hi and code[k + 1][0] != "interface":  # an annotation belongs to what follows
            k += 2
            while k + 1 < hi and code[k][0] == ".":
                k += 2
            k = _closing(code, k, "(", ")") + 1 if k < hi and code[k][0] == "(" else k
            continue
        if t == "=":  # an initialiser reaches to its semicolon
            while k < hi and code[k][0] != ";":
                k = _closing(code, k, code[k][0], {"{": "}", "(": ")"}[code[k][0]]) + 1 if code[k][0] in "{(" else k + 1
            continue
        if t == "(":
            name, end = code[k - 1][0], _closing(code, k, "(", ")")
            j = end + 1
            while j < hi and code[j][0] not in ("{", ";", ",", "="):
                j += 1
            if j < hi and code[j][0] == "{":
                stop = _closing(code, j, "{", "}")
                constant = k - 1 == start and name != owner  # an enum constant with a body
                if name == wanted and not constant:
                    out.append(_text(source, ts, code[start][1], code[stop][2]))
                elif constant:
                    _members(source, ts, code, j + 1, stop, wanted, owner, out)
                k = start = stop + 1
            elif j < hi and code[j][0] == ";" and name == wanted:
                out.append(_text(source, ts, code[start][1], code[j][2]))
                k = start = j + 1
            else:
                k = end + 1
            continue
        if t == "{":
            stop = _closing(code, k, "{", "}")
            if k - 1 == start or (k and code[k - 1][0] == owner and wanted == owner):
                if code[k - 1][0] == wanted == owner:  # a compact constructor of a record
                    out.append(_text(source, ts, code[start][1], code[stop][2]))
                else:
                    _members(source, ts, code, k + 1, stop, wanted, owner, out)
            k = start = stop + 1
            continue
        if t in (";", ","):
            start = k + 1
        k += 1


def _text(source: str, ts: list, start: int, end: int) -> str:
    before = [t for t in ts if t[2] <= start]
    while before and before[-1][0].startswith(("/*", "//")) and not source[before[-1][2] : start].strip():
        start = before.pop()[1]
    return source[start:end]
