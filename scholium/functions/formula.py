"""Users' score formulas as Spark expressions: numbers, names, + - * / ( ), comparisons, ?:, max and min."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|((?:Math\.)?[A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||[-+*/()<>?:,]))")
_CALLS = {"max": "greatest", "min": "least", "Math.max": "greatest", "Math.min": "least"}
_MARKS = {"==": "=", "!=": "<>", "&&": "and", "||": "or"}


def tokens(text: str, names: set[str]) -> list[str]:
    """The formula's tokens in Spark's spelling; anything that is not allowed is an error."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a formula: {text[at:]!r}")
        at = m.end()
        number, name, mark = m.groups()
        if name and text[at:].lstrip().startswith("("):
            if name not in _CALLS:
                raise ValueError(f"unknown function: {name}")
            out.append(_CALLS[name])
        elif name and name not in names:
            raise ValueError(f"unknown name: {name}")
        else:
            out.append(f"{number}D" if number else f"`{name}`" if name else _MARKS.get(mark, mark))
    if not out:
        raise ValueError("an empty formula")
    return out


def _conditions(parts: list[str]) -> str:
    """`a ? b : c` as `if(a, b, c)`, in brackets first."""
    out, starts = [], []
    for t in parts:
        if t == "(":
            starts.append(len(out))
        out.append(t)
        if t == ")":
            if not starts:
                raise ValueError("brackets don't match")
            at = starts.pop()
            out[at:] = [f"({_list(out[at + 1 : -1])})"]
    if starts:
        raise ValueError("brackets don't match")
    return _list(out)


def _list(parts: list[str]) -> str:
    items, item = [], []
    for t in [*parts, ","]:
        if t == ",":
            items.append(_ternary(item))
            item = []
        else:
            item.append(t)
    return ", ".join(items)


def _ternary(parts: list[str]) -> str:
    if "?" not in parts:
        return " ".join(parts)
    at, depth = parts.index("?"), 0
    for i in range(at + 1, len(parts)):
        depth += {"?": 1, ":": -1}.get(parts[i], 0)
        if depth < 0:
            return f"if({' '.join(parts[:at])}, {_ternary(parts[at + 1 : i])}, {_ternary(parts[i + 1 :])})"
    raise ValueError("? without :")


def compiled(text: str, names: dict[str, Column] | set[str]) -> Column:
    """The formula over columns of the given names, as a double; division by zero gives null."""
    return F.expr(f"cast({_conditions(tokens(text, set(names)))} as double)")
