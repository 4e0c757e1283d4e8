"""Wordings written as plain text, turned into expressions by one rule, so that word lists stay readable.

In a wording a blank is any white space, ``-`` white space or a hyphen, ``~`` white space or nothing, ``(x)`` an optional
x, ``+`` singular or plural of the word before, ``!c`` the character c itself. In a unit a blank may be missing.
"""

from __future__ import annotations

import re


def expression(text: str) -> str:
    """The expression of one wording; it suits both Python and Java."""
    out: list[str] = []
    plain = False
    for c in text:
        if plain:
            out.append(re.escape(c))
            plain = False
        elif c == "!":
            plain = True
        elif c == "+":
            out[-1:] = ["(?:y|ies)"] if out[-1] == "y" else [out[-1], "s?"]
        else:
            out.append({" ": r"\s+", "-": r"[-\s]", "~": r"\s*", "(": "(?:", ")": ")?"}.get(c) or re.escape(c))
    return "".join(out)


def any_of(wordings: str | tuple[str, ...]) -> str:
    """One group of all wordings (given one by one, or parted by ``|``), in their order."""
    each = wordings.split("|") if isinstance(wordings, str) else wordings
    return "(?:" + "|".join(map(expression, each)) + ")"


def must_have(wordings: str | tuple[str, ...]) -> tuple[str, ...]:
    """For each wording the longest lower-case text without which it can't occur: a cheap test before the expression."""
    out = []
    for w in wordings.split("|") if isinstance(wordings, str) else wordings:
        w = re.sub(r"\([^()]*\)", "\0", re.sub(r"!(.)", lambda m: "\0" if m[1] in "()" else m[1], w))
        w = re.sub(r"(\w)\+", lambda m: "\0" if m[1] == "y" else m[1] + "\0", w)
        out.append(max(re.split(r"[\0 ~()-]+", w), key=len).lower())
    return tuple(dict.fromkeys(out))
