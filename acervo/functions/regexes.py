"""Patterns with Unicode classes, rendered for Java (Spark) and for RE2 (the SQL twins).

Patterns are written with \\s and \\d for the Unicode classes of white space and decimal digits. W stands for a
word character; \\b at word borders is rendered by `bounded` for Java only, as RE2 has no lookaround.
"""

from __future__ import annotations

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
S = f"[{SPACE}]"
W = r"[\p{L}\p{N}_]"
WORDS = W + "+"
STRIP = rf"^{S}+|{S}+$"


def render(pattern: str, ignore_case: bool = False, java: bool = True) -> str:
    """pattern with \\s and \\d spelled out, inside classes and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out.append({r"\s": SPACE if inside else S, r"\d": r"\p{Nd}"}.get(pair, pair))
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(c)
        i += 1
    flags = ("(?iu)" if java else "(?i)") if ignore_case else ""
    return flags + "".join(out)


def bounded(pattern: str) -> str:
    """The pattern with word borders on both sides, for Java."""
    return f"(?<!{W})(?:{pattern})(?!{W})"


def literal(text: str) -> str:
    """text with every sign escaped, in a form that both engines read."""
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in text)


def sql(text: str) -> str:
    """A SQL string literal of DuckDB."""
    return "'" + text.replace("'", "''") + "'"
