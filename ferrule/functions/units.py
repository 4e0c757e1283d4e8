"""Unit expressions as a factor and a dimension, read by a small grammar rather than from a list of spellings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from math import pi

#: Symbol: (factor to SI, dimension as powers of m, kg, s, A, K). Particles and moles are pure numbers, so that energies per mole count as per particle.
AVOGADRO = 6.02214076e23
BASE = {
    "m": (1.0, (1, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0)), "s": (1.0, (0, 0, 1, 0, 0)), "A": (1.0, (0, 0, 0, 1, 0)), "K": (1.0, (0, 0, 0, 0, 1)),
    "mol": (AVOGADRO, (0, 0, 0, 0, 0)), "J": (1.0, (2, 1, -2, 0, 0)), "eV": (1.602176634e-19, (2, 1, -2, 0, 0)), "cal": (4.184, (2, 1, -2, 0, 0)), "erg": (1e-7, (2, 1, -2, 0, 0)),
    "Ry": (2.1798723611e-18, (2, 1, -2, 0, 0)), "Ha": (4.3597447222e-18, (2, 1, -2, 0, 0)), "W": (1.0, (2, 1, -3, 0, 0)), "h": (3600.0, (0, 0, 1, 0, 0)), "min": (60.0, (0, 0, 1, 0, 0)),
    "V": (1.0, (2, 1, -3, -1, 0)), "C": (1.0, (0, 0, 1, 1, 0)), "S": (1.0, (-2, -1, 3, 2, 0)), "ohm": (1.0, (2, 1, -3, -2, 0)), "N": (1.0, (1, 1, -2, 0, 0)), "Pa": (1.0, (-1, 1, -2, 0, 0)),
    "bar": (1e5, (-1, 1, -2, 0, 0)), "atm": (101325.0, (-1, 1, -2, 0, 0)), "angstrom": (1e-10, (1, 0, 0, 0, 0)), "L": (1e-3, (3, 0, 0, 0, 0)), "cc": (1e-6, (3, 0, 0, 0, 0)), "micron": (1e-6, (1, 0, 0, 0, 0)),
    "Hz": (1.0, (0, 0, -1, 0, 0)), "deg": (pi / 180, (0, 0, 0, 0, 0)), "atom": (1.0, (0, 0, 0, 0, 0)), "fu": (1.0, (0, 0, 0, 0, 0)),
}
PREFIX = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "k": 1e3, "M": 1e6, "G": 1e9}
PREFIXED = {"m", "g", "s", "A", "J", "eV", "cal", "W", "V", "C", "S", "ohm", "N", "Pa", "bar", "L", "Hz"}
LONG = {"metre": "m", "meter": "m", "gram": "g", "second": "s", "ampere": "A", "kelvin": "K", "mole": "mol", "joule": "J", "electronvolt": "eV", "calorie": "cal", "watt": "W", "hour": "h", "minute": "min", "volt": "V", "coulomb": "C", "siemens": "S", "newton": "N", "pascal": "Pa", "litre": "L", "liter": "L", "angstrom": "angstrom", "angström": "angstrom", "micron": "micron", "rydberg": "Ry", "hartree": "Ha", "atom": "atom", "ohm": "ohm", "degree": "deg", "bar": "bar", "atmosphere": "atm"}
LONG_PREFIX = {"femto": "f", "pico": "p", "nano": "n", "micro": "u", "milli": "m", "centi": "c", "deci": "d", "kilo": "k", "mega": "M", "giga": "G"}
POWER_WORDS = {"square": 2, "squared": 2, "cubic": 3, "cubed": 3}
CELSIUS = re.compile(r"(?:°|º|˚|deg(?:rees?)?\.?)?\s?(?:C|Celsius|centigrade)", re.IGNORECASE)
FAHRENHEIT = re.compile(r"(?:°|º|˚|deg(?:rees?)?\.?)?\s?(?:F|Fahrenheit)", re.IGNORECASE)
_DASHES = {ord(c): "-" for c in "‐‑‒–—−－⁻"} | {ord("₋"): "-"}
_POWER = re.compile(r"^(?:[x×·*]\s?)?10(?:\^|\*\*)?\{?([-+]?\d{1,3})\}?(?=\s|$|[A-Za-zμΩ])")
_TOKEN = re.compile(r"(\*\*|\^)?\{?([-+]?\d+)\}?|([A-Za-zÅåöΩμ]+)\.?|([/()])|(per\b)")


def plain(text: str) -> str:
    """Composed, with ASCII minus signs, superscripts as digits and one form of each symbol."""
    t = unicodedata.normalize("NFKC", text.replace("º", "°").replace("˚", "°")).translate(_DASHES)
    return t.replace("µ", "μ").replace("Ω", "Ω").replace("Å", "Å")


def _symbol(word: str) -> tuple[float, tuple[int, ...]] | None:
    """Factor and dimension of one unit symbol or name."""
    w = word.replace("μ", "u").replace("Ω", "ohm").replace("Å", "angstrom")
    if w in BASE:
        return BASE[w]
    if w[:1] in PREFIX and w[1:] in PREFIXED:
        f, d = BASE[w[1:]]
        return PREFIX[w[0]] * f, d
    if w.endswith("Ah") or w.endswith("Wh"):
        inner = _symbol(w[:-1])
        return inner and (inner[0] * 3600, tuple(a + b for a, b in zip(inner[1], BASE["h"][1])))
    low = w.lower()
    for name in (low, low[:-1] if low.endswith("s") else low):
        if name in LONG:
            return BASE[LONG[name]]
        for long, short in LONG_PREFIX.items():
            if name.startswith(long) and name[len(long) :] in LONG:
                f, d = BASE[LONG[name[len(long) :]]]
                return PREFIX[short] * f, d
    if low in ("angstroms", "ang"):
        return BASE["angstrom"]
    return None


@lru_cache(maxsize=65536)
def unit(text: str | None) -> tuple[float, float, tuple[int, ...], float] | None:
    """(factor, offset, dimension, power of ten in front) so that SI = (value * power) * factor + offset; None if it is no unit."""
    if text is None:
        return None
    t = plain(text).strip().strip(".,;:").strip()
    t = re.sub(r"\s*(?:vs\.?|versus)\s.*$", "", t)
    power = 1.0
    if m := _POWER.match(t):
        power = 10.0 ** int(m[1])
        t = t[m.end() :].strip()
    if not t:
        return None
    kelvin = BASE["K"][1]
    if CELSIUS.fullmatch(t):
        return 1.0, 273.15, kelvin, power
    if FAHRENHEIT.fullmatch(t):
        return 5 / 9, 273.15 - 32 * 5 / 9, kelvin, power
    if t == "%":
        return 0.01, 0.0, (0, 0, 0, 0, 0), power
    t = re.sub(r"[·⋅∙•*](?!\*)", " ", t.replace("**", "^"))
    t = re.sub(r"\bf\.?u\.?(?![a-z])|\bformula units?\b", "fu", t)
    factor, dim, sign, at, word_power, depth = 1.0, [0] * 5, 1, 0, 1, 0
    last: tuple[float, tuple[int, ...]] | None = None
    seen = False
    while at < len(t):
        if t[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(t, at)
        if not m:
            return None
        at = m.end()
        if m[2]:
            if last is None or abs(int(m[2])) > 9:
                return None
            n = int(m[2]) - 1  # one power is already counted
            factor *= last[0] ** (n * last[2])
            dim = [a + b * n * last[2] for a, b in zip(dim, last[1])]
            last = None
        elif m[3] and m[3].lower() == "per":
            sign, last = -1, None
        elif m[3] and m[3].lower() in POWER_WORDS:
            if m[3].lower().endswith("d") and last:
                n = POWER_WORDS[m[3].lower()] - 1
                factor *= last[0] ** (n * last[2])
                dim = [a + b * n * last[2] for a, b in zip(dim, last[1])]
            else:
                word_power = POWER_WORDS[m[3].lower()]
        elif m[3]:
            s = _symbol(m[3])
            if s is None and len(m[3]) == 2 and (a := _symbol(m[3][0])) and (b := _symbol(m[3][1])):  # run together, as in mK for m K
                s = a[0] * b[0], tuple(x + y for x, y in zip(a[1], b[1]))
            if s is None:
                return None
            if m[3] == "mK" and sign < 0:
                s = BASE["m"][0] * BASE["K"][0], tuple(x + y for x, y in zip(BASE["m"][1], BASE["K"][1]))
            s = (s[0] ** word_power, tuple(x * word_power for x in s[1]))
            word_power, seen = 1, True
            factor *= s[0] ** sign
            dim = [a + b * sign for a, b in zip(dim, s[1])]
            last = (s[0], s[1], sign)
        elif m[4] == "/":
            sign, last = -1, None
        elif m[4] == "(":
            depth, last = depth + 1, None
        else:
            depth = max(0, depth - 1)
            if not depth:
                sign = 1
    return (factor, 0.0, tuple(dim), power) if seen else None
