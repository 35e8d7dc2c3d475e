"""Regex and glob dialects, translated to the regex dialect of Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"


def bugfix_regex(pattern: str) -> str:
    """A case-insensitive pattern with ASCII word boundaries. Look-around and back-references, which a linear-time
    engine doesn't have, are rejected, and so is what doesn't compile."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append(two if inside else {"\\b": _BOUNDARY, "\\B": _NO_BOUNDARY}.get(two, two))
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    body = "".join(out)
    return body.replace("(?i)", "(?iu)", 1) if body.startswith("(?i)") else f"(?iu){body}"


def matches_any(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether any pattern is found; blank ones are skipped, and none matches nothing."""
    found = F.lit(False)
    for p in patterns:
        if p.strip():
            found = found | text.rlike(bugfix_regex(p.strip()))
    return found


def glob_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't; ``{a,b}`` are alternatives, ``[a-z]`` and ``[^a-z]`` classes."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            if glob[i : i + 2] == "**":
                whole = (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/")
                if whole and i + 2 < n:
                    out.append("(?:.*/)?")
                    i += 3
                    continue
                if whole and i > 0:
                    out[-1:] = ["(?:/.*)?"] if out and out[-1] == "/" else [*out[-1:], ".*"]
                else:
                    out.append(".*" if whole else "[^/]*")
                i += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid glob: {glob}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == n:
                raise ValueError(f"invalid glob: {glob}")
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if c != "/" else "/")
        i += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return "(?s)^" + "".join(out) + "$"


def glob_filter(path: Column, include: list[str] | tuple[str, ...], exclude: list[str] | tuple[str, ...]) -> Column:
    """Exclusion wins; nothing to include means all."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    wanted, unwanted = F.lit(not include), F.lit(False)
    for g in include:
        wanted = wanted | p.rlike(glob_regex(g))
    for g in exclude:
        unwanted = unwanted | p.rlike(glob_regex(g))
    return wanted & ~unwanted
