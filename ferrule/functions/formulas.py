"""Chemical formulas in text: finding, checking and writing them in one form. Pure Python, run in Arrow batches.

A small reader goes over the characters and builds amounts as it goes; there is no expression for a whole formula.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from math import gcd
from typing import NamedTuple

# Symbols in order of atomic number up to uranium, with Pauling electronegativities (0: none given).
SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U".split()
PAULING = "2.20 0 0.98 1.57 2.04 2.55 3.04 3.44 3.98 0 0.93 1.31 1.61 1.90 2.19 2.58 3.16 0 0.82 1.00 1.36 1.54 1.63 1.66 1.55 1.83 1.88 1.91 1.90 1.65 1.81 2.01 2.18 2.55 2.96 3.00 0.82 0.95 1.22 1.33 1.6 2.16 1.9 2.2 2.28 2.20 1.93 1.69 1.78 1.96 2.05 2.1 2.66 2.6 0.79 0.89 1.10 1.12 1.13 1.14 1.13 1.17 1.2 1.2 1.1 1.22 1.23 1.24 1.25 1.1 1.27 1.3 1.5 2.36 1.9 2.2 2.20 2.28 2.54 2.00 1.62 2.33 2.02 2.0 2.2 2.2 0.7 0.9 1.1 1.3 1.5 1.38".split()
NEGATIVITY = {s: float(x) for s, x in zip(SYMBOLS, PAULING)}
#: Reduced formulas whose halves don't exist, and how they are written (peroxides and diatomic gases).
UNHALVED = {"LiO": "Li2O2", "NaO": "Na2O2", "KO": "K2O2", "HO": "H2O2", "CsO": "Cs2O2", "RbO": "Rb2O2", "O": "O2", "N": "N2", "F": "F2", "Cl": "Cl2", "H": "H2"}
#: Fixed value: the last two elements are written as one group if they are nearer in electronegativity than this.
GROUP_BELOW = 1.65
# Shorthand for materials, and letters that spell elements but mean something else.
ALIASES = {
    "lfp": "LiFePO4", "lithium iron phosphate": "LiFePO4", "lco": "LiCoO2", "lithium cobalt oxide": "LiCoO2", "lmo": "LiMn2O4", "lithium manganese oxide": "LiMn2O4", "nca": "LiNi0.8Co0.15Al0.05O2",
    "llzo": "Li7La3Zr2O12", "lgps": "Li10GeP2S12", "lpscl": "Li6PS5Cl", "lpsbr": "Li6PS5Br", "lpsi": "Li6PS5I", "lto": "Li4Ti5O12", "lisicon": "Li14ZnGe4O16", "nasicon": "Na3Zr2Si2PO12", "na3ps4": "Na3PS4",
    "graphite": "C", "hard carbon": "C", "soft carbon": "C", "silicon": "Si", "lithium metal": "Li", "sodium metal": "Na",
}
ACRONYMS = frozenset(
    "DFT XRD SEM TEM EDS EDX XPS FTIR EIS GITT CV PBE PBE0 GGA LDA SCAN HSE NVT NPT NVE SOC PAW NEB VASP MSD RMSE MAE ROC AUC SHAP LIME CIF ICSD DOS PDOS COHP ESI ESW BET TGA DSC SAXS NMR SVM GNN PLD CVD SI IR UV AI ML NO IN AS IS AT OF OR ON BY TO PO SE BE PC CO".split()
)
#: Formulas of capitals only that aren't taken for acronyms.
CAPITALS = ("BN", "CO")
Amounts = dict[str, float]


class Found(NamedTuple):
    """A material in a text."""

    raw: str
    formula: str
    elements: Amounts
    alias: bool
    start: int
    end: int


class _Reader:
    """Reads formulas off a text, one character after the other; every method moves ``at`` only past what it accepts."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.text[i] if i < len(self.text) else ""

    def digits(self) -> str:
        start = self.at
        while self.peek().isdecimal():
            self.at += 1
        return self.text[start : self.at]

    def amount(self) -> float:
        """A count with or without decimals, and what a variable adds to it or takes off ("7−x"), which is dropped."""
        whole = self.digits()
        if not whole:
            return 1.0
        if self.peek() == "." and self.peek(1).isdecimal():
            self.at += 1
            whole += "." + self.digits()
        gap = 1 if self.peek().isspace() else 0
        if self.peek(gap) and self.peek(gap) in "−+":
            after = gap + 1 + (1 if self.peek(gap + 1).isspace() else 0)
            if "a" <= self.peek(after) <= "z":
                self.at += after + 1
        return float(whole)

    def symbol(self) -> str:
        if not "A" <= self.peek() <= "Z":
            return ""
        n = 2 if "a" <= self.peek(1) <= "z" else 1
        self.at += n
        return self.text[self.at - n : self.at]

    def unit(self) -> Amounts | None:
        """An element or a bracketed group of elements, with its count."""
        start = self.at
        if s := self.symbol():
            return {s: self.amount()}
        if self.peek() != "(":
            return None
        self.at += 1
        inner: Amounts = {}
        while s := self.symbol():
            _add(inner, {s: self.amount()})
        if not inner or self.peek() != ")":
            self.at = start
            return None
        self.at += 1
        times = self.amount()
        return {s: x * times for s, x in inner.items()}

    def run(self, least: int) -> Amounts | None:
        """Units in a row, ``least`` of them or more."""
        start, total, n = self.at, {}, 0
        while (u := self.unit()) is not None:
            _add(total, u)
            n += 1
        if n >= least:
            return total
        self.at = start
        return None

    def token(self) -> str:
        """What may be a formula from here on: a run, a second one behind a dash, crystal water behind a dot."""
        start = self.at
        if self.run(2) is None:
            return ""
        for mark in "-–", "·":
            if self.peek() and self.peek() in mark:
                before = self.at
                self.at += 1
                if mark == "·":
                    self.digits()
                if self.run(2) is None:
                    self.at = before
        return self.text[start : self.at]


def _add(a: Amounts, b: Amounts, times: float = 1) -> Amounts:
    for s, x in b.items():
        a[s] = a.get(s, 0.0) + x * times
    return a


@lru_cache(maxsize=65536)
def elements_of(formula: str) -> tuple[tuple[str, float], ...] | None:
    """Amounts by element in order of writing; None if it isn't a formula of real, stable elements."""
    if not formula or formula.upper() in ACRONYMS:
        return None
    r = _Reader(formula)
    total = r.run(1)
    if total is None or r.at < len(formula) or any(s not in NEGATIVITY for s in total):
        return None
    return tuple((s, x) for s, x in total.items() if x)  or None


def _order(symbol: str) -> tuple[float, str]:
    return NEGATIVITY[symbol] or 9.0, symbol


def _count(x: float) -> str:
    return f"{round(x)}" if abs(x - round(x)) < 1e-8 else f"{round(x, 8):.8f}".rstrip("0")


def _one(s: str, x: float) -> str:
    return s if abs(x - 1) < 1e-8 else s + _count(x)


def _whole(amounts: dict[str, int]) -> tuple[str, int]:
    """(formula, divisor) of whole amounts: divided by their common divisor, the least electronegative element first. If
    the last two are close in electronegativity and have a divisor of their own, they are written as a group."""
    d = gcd(*amounts.values())
    symbols = sorted(amounts, key=_order)
    tail = ""
    if len(symbols) > 2 and NEGATIVITY[symbols[-1]] - NEGATIVITY[symbols[-2]] < GROUP_BELOW:
        group, times = _whole({s: amounts[s] // d for s in symbols[-2:]})
        if times != 1:
            tail, symbols = f"({group}){times}", symbols[:-2]
    return "".join(_one(s, amounts[s] // d) for s in symbols) + tail, d


@lru_cache(maxsize=65536)
def reduced(amounts: tuple[tuple[str, float], ...]) -> str:
    """One spelling. Amounts that aren't whole stay as they are, and then a count of one is written too."""
    if all(abs(x - round(x)) < 1e-8 for _, x in amounts):
        formula, _ = _whole({s: round(x) for s, x in amounts})
        return UNHALVED.get(formula, formula)
    return "".join(s + _count(x) for s, x in sorted(amounts, key=lambda a: _order(a[0])))


@lru_cache(maxsize=65536)
def resolve(token: str) -> tuple[str, str, tuple[tuple[str, float], ...]] | None:
    """(raw, one spelling, amounts) of a token: plain, joined by a dash, or with crystal water. All parts must hold."""
    raw = token.strip(".,;:)( ")
    body, dot, water = raw.partition("·")
    n = re.match(r"\d*", water)[0]
    parts = [body, water[len(n) :]] if dot else re.split("[-–]", raw)
    if len(raw) < 2 or (len(parts) == 1 and raw.isalpha() and raw.isupper() and raw not in CAPITALS):
        return None
    total: Amounts = {}
    spelled = []
    for i, p in enumerate(parts):
        if (amounts := elements_of(p)) is None:
            return None
        _add(total, dict(amounts), int(n or 1) if dot and i else 1)
        spelled.append(reduced(amounts))
    return raw, f"{spelled[0]}·{n}{spelled[1]}" if dot else "-".join(spelled), tuple(total.items())


_START = re.compile(r"\b(?=[A-Z(])")
_SHORTHAND = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(ALIASES, key=len, reverse=True))) + r"|NMC\s?-?\d{3})\b", re.IGNORECASE)


def _shorthand(text: str) -> tuple[str, Amounts]:
    """Formula and amounts of an alias, or of a nickel-manganese-cobalt oxide named by its three tenths."""
    known = ALIASES.get(text.lower())
    if known is None:
        known = "Li" + "".join(f"{s}{int(d) / 10:g}" for s, d in zip(("Ni", "Mn", "Co"), text[-3:])) + "O2"
    amounts = elements_of(known)
    return reduced(amounts), dict(amounts)


def find_materials(text: str | None) -> list[Found]:
    """The materials of a text: formulas, then aliases, then shorthand such as NMC811, which mustn't begin inside a formula."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    out: list[Found] = []
    past = 0
    for m in _START.finditer(text):
        if m.start() < past:
            continue
        r = _Reader(text, m.start())
        token = r.token()
        past = max(past, r.at)
        if token and (x := resolve(token)):
            out.append(Found(x[0], x[1], dict(x[2]), False, m.start(), r.at))
    names: list[Found] = []
    for m in _SHORTHAND.finditer(text):
        if not any(f.start <= m.start() < f.end for f in out):
            names.append(Found(m[0], *_shorthand(m[0]), True, m.start(), m.end()))
    return out + sorted(names, key=lambda f: f.raw[-1:].isdecimal() and f.raw.lower() not in ALIASES)
