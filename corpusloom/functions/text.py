"""Column functions over paths, tokens and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: What Python's ``splitlines`` splits on, besides CR LF.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def parts(path: str | Column) -> Column:
    return F.split(path, "/")


def name(path: str | Column) -> Column:
    return F.element_at(parts(path), -1)


def dirs(path: str | Column) -> Column:
    """Directory segments of a path."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def suffix(path: str | Column) -> Column:
    """Last suffix of the name with its dot; '' without one or for a leading dot only."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9]+"), lambda x: x != "")


def lines(text: str | Column) -> Column:
    """As ``splitlines``: no empty last line."""
    ls = F.split(text, LINE_BREAK, -1)
    last = F.when(F.element_at(ls, -1) == "", 1).otherwise(0)
    return F.slice(ls, F.lit(1), F.size(ls) - last)


def camel_words(symbol: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(symbol, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")), "_")


def glob_regex(pattern: str, within: bool = False) -> str:
    """Java regex of an fnmatch pattern; ``*`` crosses ``/`` unless ``within``."""
    any_ = "[^/]" if within else "."
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += any_ + "*"
        elif c == "?":
            out += any_
        elif c == "\\" and within and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "]"))
            while j < len(pattern) and pattern[j] != "]":
                j += 1
            if j >= len(pattern):
                out += "\\["
            else:
                body = pattern[i:j].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = j + 1
        else:
            out += re.escape(c)
    return out


def any_glob(text: Column, patterns: list[str]) -> Column:
    """Whether a whole string matches one of the patterns."""
    if not patterns:
        return F.lit(False)
    return text.rlike("(?s)^(?:" + "|".join(map(glob_regex, patterns)) + ")$")


def quoted(x: str) -> str:
    """SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(xs: list[str]) -> str:
    return "array(" + ", ".join(map(quoted, xs)) + ")" if xs else "cast(array() as array<string>)"


def sql_map(pairs: list[tuple]) -> str:
    """First-wins literal map of strings to strings or numbers; built as SQL, as a call for each entry is slow."""
    seen: dict = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    return "map(" + ", ".join(f"{quoted(k)}, {quoted(v) if isinstance(v, str) else repr(v)}" for k, v in seen.items()) + ")"


def sql_dirs(path: str = "path") -> str:
    return f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)"


def sql_tokens(text: str) -> str:
    return f"filter(split(lower({text}), '[^a-zA-Z0-9]+'), t -> t != '')"


def map_literal(pairs: list[tuple]) -> Column:
    """First-wins literal map."""
    return F.expr(sql_map(pairs))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
