"""Building blocks of the column functions: replacement, binding, lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.chars import WB, WS


def rx(t: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(t, F.lit(pattern), F.lit(replacement))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` mentions it."""
    return F.transform(F.array(value), f)[0]


def python(f=None, *, when: Callable[[dict], bool] = lambda params: True):
    """Mark a column function that runs Python over Arrow batches, or does so for some parameters; pipelines plan those apart."""

    def mark(f):
        f.runs_python = when
        return f

    return mark(f) if f else mark


def runs_python(f, params: dict) -> bool:
    """By its mark; a bare pandas UDF needs none."""
    marked = getattr(f, "runs_python", None)
    return marked(params) if marked else hasattr(f, "evalType")


def fenced(df: DataFrame, column: str) -> DataFrame:
    """``column`` behind a one-row generator.

    Neighbouring projections are otherwise merged, and a Python function whose argument or user holds lambdas may then be
    copied and not taken out of the projection again. Filters on other columns still pass through.
    """
    return df.withColumn(column, F.explode(F.array(F.col(column))))


def applied(df: DataFrame, column: str, f: Callable[..., Column], **params) -> DataFrame:
    """``df`` with ``f`` of ``column``, as a projection of its own."""
    if not runs_python(f, params):
        return df.withColumn(column, f(F.col(column), **params))
    new = f(F.col(column), **params)
    return fenced(fenced(df, column).withColumn(column, new), column)


def lines(t: Column) -> Column:
    return F.split(t, "\n", -1)


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def each_line(t: Column, f: Callable[[Column], Column]) -> Column:
    return unlines(F.transform(lines(t), f))


def keep_lines(t: Column, f: Callable[[Column], Column]) -> Column:
    return unlines(F.filter(lines(t), f))


def trim(t: Column) -> Column:
    return rx(t, f"^{WS}+|{WS}+\\z")


def matches(t: Column, pattern: str) -> Column:
    return t.rlike(pattern)


def replace_all(t: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for find, to in pairs:
        t = F.replace(t, F.lit(find), F.lit(to))
    return t


def utf16_length(t: Column) -> Column:
    """Length in UTF-16 units is only emulated where results need it; elsewhere lengths are code points."""
    return F.length(t) + F.regexp_count(t, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def first_upper(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def quoted(text: str) -> str:
    """``text`` as a literal replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def literal(text: str) -> str:
    """``text`` as a literal pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_pattern(pattern: str) -> str:
    """A pattern in browser syntax for Java: ASCII word edges, wide white space, ends that mean the end, named groups alike."""
    out, in_class, i = [], False, 0
    from textloom.functions.chars import WS_BODY

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n == "s":
                out.append(WS_BODY if in_class else f"[{WS_BODY}]")
            elif n == "S" and not in_class:
                out.append(f"[^{WS_BODY}]")
            elif n == "b" and not in_class:
                out.append(WB)
            elif n == "/":
                out.append("/")
            elif n == "u" and (m := re.match(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})", pattern[i:])):
                out.append("\\x{" + (m[1] or m[2]) + "}")
                i += m.end()
            else:
                out.append("\\" + n)
            continue
        if in_class and c == "[":
            out.append("\\[")
        elif in_class and c == "&" and pattern[i : i + 2] == "&&":
            out.append("\\&")
        else:
            out.append(c)
        if c == "[" and not in_class:
            in_class = True
            if pattern[i + 1 : i + 2] == "]":  # an empty class matches nothing
                out[-1], in_class, i = "(?!)", False, i + 1
        elif c == "]" and in_class:
            in_class = False
        i += 1
    return "".join(out)


def java_replacement(replacement: str, groups: int, names: Iterable[str] = ()) -> str:
    """Browser replacement syntax for Java: ``$&``, ``$$``, ``$n``, ``$<name>`` and ``$'`` (see ``with_rest``); anything else is literal."""
    out, i = [], 0
    while i < len(replacement):
        c, n = replacement[i], replacement[i + 1 : i + 2]
        if c == "$" and n == "$":
            out.append("\\$")
            i += 2
        elif c == "$" and n == "&":
            out.append("$0")
            i += 2
        elif c == "$" and n == "'":
            out.append("${textloomrest}")
            i += 2
        elif c == "$" and n == "<" and (m := re.match(r"<([A-Za-z][A-Za-z0-9]*)>", replacement[i + 1 :])) and m[1] in names:
            out.append("${" + m[1] + "}")
            i += 1 + m.end()
        elif c == "$" and n.isdigit() and 1 <= int(n) <= groups:
            out.append(f"$\\{n}"[:1] + n)
            i += 2
        else:
            out.append(quoted(c))
            i += 1
    return "".join(out)


def with_rest(pattern: str) -> str:
    """``pattern`` with what follows the match in the group that ``java_replacement`` names for ``$'``."""
    return f"(?:{pattern})(?=(?<textloomrest>(?s:.*)))"


def group_names(pattern: str) -> list[str]:
    return re.findall(r"(?<!\\)\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)


def valid_pattern(pattern: str) -> bool:
    """Whether Java's engine takes the pattern (asked of the running JVM; with none, of Python)."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    try:
        if context is not None and context._jvm is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:
        return False
    return True


def group_count(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<(?![=!])", pattern))
