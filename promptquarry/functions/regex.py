"""Patterns written once, rendered for Java (Spark) and for RE2 (DuckDB).

In the source form \\b is a boundary of ASCII word characters and \\s is white space in the wide sense (no-break blanks
and the byte-order mark included). Java's \\b looks at Unicode letters and its \\s is ASCII, so both are spelt out.
"""

from __future__ import annotations

_SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JAVA_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _spaced(pattern: str) -> str:
    """Spells \\s and \\S out, inside and outside of character classes."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACES if inside else f"[{_SPACES}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{_SPACES}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            if two[0] == "[" and not inside:
                inside = True
                if pattern[i + 1] == "^":
                    out.append("[^")
                    i += 2
                    if two and pattern[i : i + 2] == r"\s":
                        continue
                    continue
            elif two[0] == "]" and inside:
                inside = False
            out.append(two[0])
            i += 1
    return "".join(out)


def java(pattern: str) -> str:
    return _spaced(pattern).replace(r"\b", _JAVA_BOUNDARY)


def java_ascii(pattern: str) -> str:
    """For ASCII texts, in which Java's own boundary is that of ASCII word characters and takes much less time."""
    return _spaced(pattern)


def re2(pattern: str) -> str:
    return _spaced(pattern)


def sql(pattern: str) -> str:
    """A DuckDB string literal of the pattern."""
    return "'" + re2(pattern).replace("'", "''") + "'"


def any_of(*patterns: str) -> str:
    """One pattern that matches where any of these does; each may have flags of its own."""
    return "|".join(f"(?:{p})" for p in patterns)
