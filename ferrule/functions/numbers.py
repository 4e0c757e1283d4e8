"""Numbers in running text: where they stand, what they say, and how C would write them."""

from __future__ import annotations

import re
from math import isfinite
from typing import NamedTuple

_DIGITS = r"\d+(?:\.\d+)?"
#: A power of ten after the mantissa: e-8, E-8, or times ten to the power, with or without the caret.
_POWER = r"\s*(?:[eE](?P<e>[-+−]?\d+)|[x×X*]\s*10\^?(?P<t>[-+−]?\d+))"
_ERROR = rf"\s*(?:±|\+/?-)\s*{_DIGITS}"
_NUMBER = re.compile(rf"(?P<mantissa>[-−]?{_DIGITS})(?:{_POWER})?")
_UNCERTAIN = re.compile(_ERROR)
_MINUS = {ord(c): "-" for c in "−–—"}


class Number(NamedTuple):
    """A number as written, where it begins and ends, and where an uncertainty behind it ends."""

    text: str
    start: int
    end: int
    past: int


def numbers(text: str) -> list[Number]:
    """The numbers of a text from left to right. None begins inside another, behind a decimal point or right behind ±; a
    minus sign belongs to a number unless it follows a digit."""
    out: list[Number] = []
    at = 0
    while m := _NUMBER.search(text, at):
        start = m.start()
        if start and (text[start - 1].isdigit() or text[start - 1] in ".±"):
            at = start + 1  # the minus of a range, or the tail of a longer number
            if text[start] not in "-−":
                while at < len(text) and text[at].isdigit():
                    at += 1
            continue
        error = _UNCERTAIN.match(text, m.end())
        out.append(Number(m[0], start, m.end(), error.end() if error else m.end()))
        at = m.end()
    return out


def parse(text: str | None) -> float | None:
    """A number as read: decimal (".5" too), with e or with times ten to a power; None if it is none."""
    t = re.sub(r"\s+", "", (text or "").translate(_MINUS))
    power = re.search(r"(?:[eE]|[x×X*]10\^?)(?P<n>[-+]?\d+)$", t)
    head = t[: power.start()] if power else t
    if not re.fullmatch(r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)", head):
        return None
    try:
        return float(f"{head}e{power['n'] if power else 0}")
    except (ValueError, OverflowError):
        return None


def short(x: float, digits: int = 4) -> str:
    """At most ``digits`` significant digits, as C's ``%g`` writes them."""
    return f"{x:.{digits}g}"


__all__ = ["Number", "isfinite", "numbers", "parse", "short"]
