"""Regex, white space and rounding rules that hold in any engine.

Word boundaries are ASCII, white space includes the no-break space, and numbers
are rounded half up on their binary value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary.
B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: One white-space character.
WS = r"[\s\x{00A0}]"


def squash(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def half_up(number: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(number * scale + F.lit(0.5)).cast("double") / F.lit(scale)


#: Alternatives in one group that begin and end with word characters.
_PLAIN = re.compile(r"(\\b|\^)\(((?:[a-z0-9]|(?<=[a-z0-9])[' -](?=[a-z0-9])|(?<=[a-z0-9])\|(?=[a-z0-9]))+)\)\\b")


def words_bounded(pattern: str) -> str:
    """A pattern with every \\b made an ASCII boundary.

    A group of plain words needs half a boundary on either side.
    """
    plain = _PLAIN.fullmatch(pattern)
    if plain:
        start = "^" if plain[1] == "^" else "(?<![A-Za-z0-9_])"
        return f"{start}({plain[2]})(?![A-Za-z0-9_])"
    return pattern.replace(r"\b", B)


def let(value: Column, body) -> Column:
    """body(value), with value computed once and not once for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
