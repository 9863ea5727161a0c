"""Regular expressions for literal, wildcard and gapped patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

_META = re.compile(r"([\\.^$|?*+()\[\]{}&\-~#])")
UNBOUNDED = 2_147_483_647


def quote(literal: str) -> str:
    """A literal as a Java expression; every sign that could mean something is escaped."""
    return _META.sub(r"\\\1", literal)


def fixed(pattern: str, wild: str | None = "?") -> str:
    """A pattern of fixed length: the wildcard stands for any one character."""
    if wild is not None and len(wild) != 1:
        raise ValueError("a wildcard is one character")
    return "".join("." if c == wild else quote(c) for c in pattern)


@dataclass(frozen=True)
class WildcardOptions:
    """Which signs are wildcards, how wide a gap may be, and what ends it."""

    asterisk: str = "*"
    question: str = "?"
    asterisk_min_length: int = 0
    asterisk_max_length: int = UNBOUNDED
    stop_characters: str = ""

    def __post_init__(self) -> None:
        if len(self.asterisk) != 1 or len(self.question) != 1 or self.asterisk == self.question:
            raise ValueError("the two wildcards must be different single characters")
        if self.asterisk_min_length < 0 or self.asterisk_max_length < self.asterisk_min_length:
            raise ValueError("gap lengths must satisfy 0 <= min <= max")


def wildcard(pattern: str, options: WildcardOptions | None = None) -> str | None:
    """The expression of a wildcard pattern, or None if it has no literal part.

    Each gap takes the nearest next part and never gives way again, which atomic
    groups express.  Stop characters end gaps and cannot stand for ``?``; a first
    part that is all literal, or all ``?``, is exempt from them.
    """
    o = options or WildcardOptions()
    parts = [p for p in pattern.strip(o.asterisk).split(o.asterisk) if p]
    if not parts:
        return None
    any_one = f"[^{quote(o.stop_characters)}]" if o.stop_characters else "."

    def part(text: str, free: bool) -> str:
        out = []
        for c in text:
            if c == o.question:
                out.append("." if free else any_one)
            else:
                out.append("(?!)" if not free and c in o.stop_characters else quote(c))
        return "".join(out)

    first = parts[0]
    mixed = o.question in first and any(c != o.question for c in first)
    most = "" if o.asterisk_max_length >= UNBOUNDED else str(o.asterisk_max_length)
    gap = f"{any_one}{{{o.asterisk_min_length},{most}}}?"
    return part(first, not mixed) + "".join(f"(?>{gap}{part(p, False)})" for p in parts[1:])
