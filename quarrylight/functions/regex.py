"""One pattern source for two regex engines.

Patterns are written once with \\b, \\w and \\s meant in the Unicode sense. `java` switches Java's engine to that sense;
`re2` spells it out for engines whose classes are ASCII, which is right for tests of presence.
"""

from __future__ import annotations

import re

_WORD = r"[\p{L}\p{N}_]"
_EDGE_BEFORE = r"(?:^|[^\p{L}\p{N}_])"
_EDGE_AFTER = r"(?:$|[^\p{L}\p{N}_])"


def java(pattern: str) -> str:
    """For Spark: case-insensitive, Unicode classes and boundaries."""
    return f"(?iU){pattern}"


def re2(pattern: str) -> str:
    """For RE2: the same presence test; a boundary becomes the neighbouring character."""
    out = re.sub(r"\\b(?=$|[|)\[\]\\.?,;:! ])(?!\\w|\[\\w)", lambda m: _EDGE_AFTER, pattern)
    out = out.replace(r"\b", _EDGE_BEFORE).replace(r"\w", _WORD)
    return f"(?i){out}"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"
