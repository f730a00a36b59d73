"""String functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(s: Column) -> Column:
    """Whether anything but spaces, tabs and NULs is in s; null: false."""
    return F.coalesce(s.rlike("[^ \\t\\x00]"), F.lit(False))


def split(s: Column, token: str) -> Column:
    """Parts between occurrences of the character `token` or spaces; empty parts are dropped."""
    return F.filter(F.split(s, f"[ {_escaped(token)}]"), lambda x: x != "")


def _escaped(token: str) -> str:
    return "".join("\\" + c if c in "\\]^[-&" else c for c in token)


def join(parts: Column, token: str) -> Column:
    return F.array_join(parts, token)


def to_ints(s: Column, token: str = ",") -> Column:
    """Parts as numbers; a part that is none: null."""
    return F.transform(split(s, token), lambda x: x.try_cast("int"))


def to_number(s: Column, kind: str = "double") -> Column:
    return F.trim(s).try_cast(kind)
