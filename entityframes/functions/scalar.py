"""The scalar functions that expressions may use, with the semantics of the declared dialect.

``REGISTRY`` is the closed list that backfill expressions are built from.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import SpecError

# Patterns of to_char and what they are here
_TO_CHAR = (("YYYY", "yyyy"), ("HH24", "HH"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"))


def concat(*parts: Column) -> Column:
    """Null arguments are skipped; all null gives an empty text."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def left(c: Column, n: int) -> Column:
    if n < 0:
        raise SpecError("left with a negative length")
    return F.left(c, F.lit(n))


def right(c: Column, n: int) -> Column:
    if n < 0:
        raise SpecError("right with a negative length")
    return F.right(c, F.lit(n))


def substring(c: Column, start: int, length: int | None = None) -> Column:
    if start < 1:
        raise SpecError("substring starts at 1")
    return F.substring(c, start, length if length is not None else (1 << 31) - 1 - start)


def to_char(c: Column, pattern: str) -> Column:
    """YYYY, MM, DD, HH24, MI and SS with punctuation between; anything else is an error."""
    out, at = "", 0
    while at < len(pattern):
        for name, ours in _TO_CHAR:
            if pattern.startswith(name, at):
                out, at = out + ours, at + len(name)
                break
        else:
            if pattern[at].isalpha():
                raise SpecError(f"to_char pattern {pattern!r}")
            out, at = out + pattern[at], at + 1
    return F.date_format(c, out)


def now(as_of: datetime) -> Column:
    return F.lit(as_of)


def json_tree(c: Column, *path: str) -> Column:
    """The subtree at a path, as JSON text."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def json_text(c: Column, *path: str) -> Column:
    """The value at a path as text; a missing key and JSON null are null, booleans are true and false."""
    return json_tree(c, *path)


def ci_equal(a: Column, b: Column | str) -> Column:
    """Case-insensitive equality."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b if isinstance(b, Column) else F.lit(b), "UTF8_LCASE")


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


REGISTRY: dict[str, Callable[..., Column]] = {
    "coalesce": F.coalesce,
    "nullif": F.nullif,
    "lower": F.lower,
    "upper": F.upper,
    "length": F.char_length,
    "char_length": F.char_length,
    "trim": lambda c: F.trim(c),
    "ltrim": lambda c: F.ltrim(c),
    "rtrim": lambda c: F.rtrim(c),
    "abs": F.abs,
    "concat": concat,
    "concat_ws": lambda separator, *parts: F.concat_ws(separator, *parts),
    "substring": substring,
    "substr": substring,
    "replace": F.replace,
    "left": left,
    "right": right,
    "to_char": to_char,
}


def call(name: str, *args) -> Column:
    """A function of the closed list; any other name is an error."""
    if name not in REGISTRY:
        raise SpecError(f"function {name!r} is not allowed here")
    return REGISTRY[name](*args)
