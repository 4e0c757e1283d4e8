"""Quantities recorded in different units, brought to the common unit of their property.

Each row is read in this order: the number and, where it is there, the unit of ``raw_value``; the unit column; the
sentence (after the number, or in a table's head), freed from page furniture. Only what no field states is predicted: a
calibrated ensemble of trees, fitted on rows whose unit is stated, gives a unit from magnitude, property, category,
source and the ratio to a value that was normalised before. Sure predictions are converted, the rest goes to review.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import isfinite, log10
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.forest import Forest
from ferrule.functions.pages import body_lines
from ferrule.functions.text import MISSING
from ferrule.functions.units import plain, unit

_TUPLE = re.compile(r"^\s*[(\[]\s*(['\"])(.*?)\1\s*(?:,\s*(?:(['\"])(.*?)\3|None)\s*)?,?\s*[)\]]\s*$", re.DOTALL)
_SIGN = "-+−–‐"
_NUMBER = re.compile(
    rf"\s*(?:(?:ca|approx|c)\.?|about|around|roughly|[~≈∼≃<>≤≥]|\s)*\s*"
    rf"([{_SIGN}]?(?:\d{{1,3}}(?:[    ']\d{{3}})+(?!\d)(?:[.,]\d+)?|\d[\d.,]*\d|\d|[.,]\d+))"  # mantissa
    r"(?:\s*\(\d+\))?(?:\s*(?:±|\+/-|\+-)\s*\d[\d.,]*)?\)?"  # uncertainty
    rf"(?:\s*(?:[x×X·⋅∙*]\s*10\s*(?:\^|\*\*)?\s*\{{?\s*([{_SIGN}⁻⁺]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+)\}}?|[eE]([{_SIGN}]?\d{{1,3}}))(?![\d.]))?"
    r"(?:\s*(?:±|\+/-|\+-)\s*\d[\d.,]*)?",
    re.DOTALL,
)
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−–‐", "0123456789-+---")
_GROUPED = re.compile(r"[-+]?[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?")
_HEADS = re.compile(r"\(((?:[^()]|\([^()]*\))*)\)|\bin\s+([^;|:]{1,40})[;|:]|,\s*([^|;,]{1,40}?)\s*\|")
_UNIT_WORDS = {"per", "square", "cubic", "vs", "vs.", "versus", "li/li+", "na/na+", "mole", "degrees", "degree", "deg", "10", "x", "×", "·", "/", "formula", "unit"}
_WORDS = re.compile(r"\S+")
_POWER_WORD = re.compile(r"[x×·*]?10(?:\^|\*\*)?[-−–⁻+]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]*")
#: About so many rows are read to fit the ensemble (never more than twice as many); the share taken follows from the count of rows.
FIT_ROWS = 12_000
#: A prediction is converted from this calibrated confidence on.
SURE = 0.95


def number(text: str) -> tuple[float, int | None, int] | None:
    """(mantissa, power of ten or None, end) of the quantity that a text begins with; the main value, not its uncertainty."""
    m = _NUMBER.match(text)
    if not m:
        return None
    digits = re.sub(r"[    ']", "", m[1]).translate(_SUPER)
    if digits.count(",") == 1 and "." not in digits:
        digits = digits.replace(",", "") if _GROUPED.fullmatch(digits) else digits.replace(",", ".")
    elif "," in digits and "." in digits:
        digits = digits.replace(",", "") if digits.rindex(".") > digits.rindex(",") else digits.replace(".", "").replace(",", ".")
    else:
        digits = digits.replace(",", "")
    power = m[2] or m[3]
    try:
        return float(digits), int(power.translate(_SUPER)) if power else None, m.end()
    except (ValueError, OverflowError):
        return None


def _missing(s: str | None) -> bool:
    return s is None or s != s or s.strip().lower() in MISSING


@lru_cache(maxsize=65536)
def _may_be_unit(word: str) -> bool:
    """Whether a word can be part of a unit's spelling."""
    w = word.strip(".,;:()")
    return w.lower() in _UNIT_WORDS or bool(_POWER_WORD.fullmatch(w)) or unit(w) is not None or unit("m " + w) is not None


def _leading_unit(text: str, dim: tuple[int, ...]) -> tuple | None:
    """The longest unit that a text begins with, one of the dimension wanted before any other."""
    best, so_far = None, ""
    for m in _WORDS.finditer(text):
        word = m[0]
        if not _may_be_unit(word):
            break
        so_far = f"{so_far} {word}" if so_far else word
        u = unit(so_far)
        if u and (best is None or u[2] == dim or best[2] != dim):
            best = u
        if word[-1] in ",;:":
            break
    return best


def _cell(raw: str) -> tuple[str, str]:
    """Number text and unit text of a raw value, which may be the print of a pair."""
    m = _TUPLE.match(raw)
    return (m[2], m[4] or "") if m else (raw, "")


def _from_sentence(sentence: str, written: str, dim: tuple[int, ...]) -> tuple | None:
    """The unit that a sentence states for a number as written, after it or in a table's head."""
    flat = " ".join(" ".join(body_lines(sentence)).split()) if "\n" in sentence else sentence
    written = " ".join(written.split())
    best: tuple | None = None
    at = flat.find(written) if written else -1
    while at >= 0:
        end = at + len(written)
        if not (at and (flat[at - 1].isalnum() or flat[at - 1] in ".,_")) and not flat[end : end + 1].isdigit():
            u = _leading_unit(flat[end:], dim)
            if u and (best is None or (u[2] == dim and best[2] != dim)):
                best = u
        at = flat.find(written, at + 1)
    if best is not None:
        return best
    for h in _HEADS.finditer(flat):
        u = unit(h[1] or h[2] or h[3])
        if u and (best is None or (u[2] == dim and best[2] != dim)):
            best = u
    return best


class Reading(NamedTuple):
    """What the fields of one row state."""

    bare: float | None  #: the number with its own power of ten, in the recorded unit
    own: tuple | None  #: the unit stated by the raw value or the unit column
    told: tuple | None  #: the unit that the sentence states, looked for where the fields have none
    before: float | None  #: the number of the value normalised before


def read(raw: str | None, unit_text: str | None, numeric: float | None, sentence: str | None, normal: str | None, dim: tuple[int, ...], always: bool = False) -> Reading:
    """Read one row. ``always``: search the sentence also where the fields state the unit (for fitting)."""
    value: float | None = None
    power: int | None = None
    written = rest = ""
    if not _missing(raw):
        written, rest = _cell(raw)
        if n := number(written):
            value, power, end = n
            rest = written[end:].strip() or rest
            written = written[:end]
    if power is not None and abs(power) > 300:
        return Reading(None, None, None, None)
    known = numeric is not None and numeric == numeric and isfinite(numeric)
    before = None if _missing(normal) else number(normal)
    if value is None:
        if known:
            value = numeric
        elif before:
            value, power, _ = before
            unit_text, rest = normal[before[2] :], ""
        else:
            return Reading(None, None, None, None)
    u = unit(rest) if rest else None
    if rest and u is None:
        u = _leading_unit(rest, dim)
    if u is None and not _missing(unit_text):
        u = unit(unit_text)
        if u and power is not None and u[3] == 10.0**power and known and abs(numeric - value) <= 1e-9 * abs(value):
            power = None  # the power that was read belongs to the unit and counts once
    told = None
    if (u is None or always) and not _missing(sentence):
        told = _from_sentence(sentence, written or f"{value:g}", dim)
    try:
        return Reading(value * 10.0 ** (power or 0), u, told, before[0] * 10.0 ** (before[1] or 0) if before else None)
    except OverflowError:
        return Reading(None, None, None, None)


def convert(bare: float, u: tuple, target: tuple) -> float | None:
    """The value in the target unit, None for another dimension."""
    return ((bare * u[3]) * u[0] + u[1] - target[1]) / target[0] if u[2] == target[2] else None


def common_units(kinds: DataFrame) -> dict[str, str]:
    """The common unit of each property; a table of fixed size, so it is held by the driver."""
    return {r["property_name"]: r["common_unit"] for r in kinds.select("property_name", "common_unit").distinct().collect() if r["property_name"] and not _missing(r["common_unit"])}


_FIELDS = ("mention_id", "property_name", "raw_value", "value_numeric", "normalized_value", "unit", "sentence", "source_type")
_OUT = T.StructType([T.StructField("mention_id", T.LongType()), T.StructField("val", T.StringType()), T.StructField("common_unit", T.StringType()), T.StructField("state", T.StringType())])


def quantities(mentions: DataFrame, kinds: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(mention_id, val, common_unit, state) of each mention of a property that has a common unit.

    state is ``stated`` (a field has the unit), ``predicted`` (the ensemble gives it and the sentence, where it states a
    unit, agrees), ``corrected`` (the sentence states another than predicted and holds), ``review`` (nothing states it
    and the prediction is unsure; val is null), ``other`` (a quantity of another dimension; val is null) or ``none``
    (no number). Extra columns don't matter; an empty table gives no rows.
    """
    units = common_units(kinds)
    targets = {p: unit(u) for p, u in units.items()}
    units = {p: u for p, u in units.items() if targets[p]}
    wanted = mentions.where(F.col("property_name").isin(*units) & F.col("mention_id").isNotNull()).select(*_FIELDS)
    model = UnitModel.fit(wanted, targets, fit_rows)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[list] = []
            open_: list[tuple[int, str, Reading, str]] = []
            for i, prop, raw, num, norm, unit_text, sentence, source in b.itertuples(index=False, name=None):
                r, target = read(raw, unit_text, num, sentence, norm, targets[prop][2]), targets[prop]
                if r.bare is None:
                    continue
                if r.own is None:
                    open_.append((len(rows), prop, r, source))
                val = convert(r.bare, r.own, target) if r.own else None
                rows.append([i, val, units[prop], "stated" if val is not None else "other"])
            for (at, prop, r, _), u, sure in zip(open_, *model.predict([(p, r, s) for _, p, r, s in open_])):
                told = r.told
                if told is not None:  # the exact check
                    state = "predicted" if u is not None and _same(u, told) else "corrected"
                    val = convert(r.bare, told, targets[prop])
                    rows[at][1], rows[at][3] = val, state if val is not None else "other"
                elif u is not None and sure >= SURE and u[2] == targets[prop][2]:
                    rows[at][1], rows[at][3] = convert(r.bare, u, targets[prop]), "predicted"
                else:
                    rows[at][3] = "other" if u is not None and sure >= SURE else "review"
            for row in rows:
                row[1] = f"{row[1]:.2e}" if row[1] is not None and isfinite(row[1]) else None
            yield pd.DataFrame(rows, columns=_OUT.names)

    return wanted.mapInPandas(apply, _OUT)


def in_common_units(mentions: DataFrame, kinds: DataFrame) -> DataFrame:
    """(mention_id, val, common_unit): the main value of each mention in its property's common unit, as C's ``%.2e``.

    Properties without a common unit, quantities of another dimension and rows without any number give no row, nor do
    rows left to review. A repeated row counts once (ids that repeat with unlike content keep the smallest value).
    """
    return quantities(mentions, kinds).where("val is not null").groupBy("mention_id").agg(F.min(F.struct("val", "common_unit")).alias("x")).select("mention_id", "x.val", "x.common_unit")


def masked_score(mentions: DataFrame, kinds: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """How well the ensemble does where nothing states the unit: fitted on rows of even id, it predicts the unit of rows of odd
    id (about ``fit_rows`` of them) whose fields state it, with the fields' unit and the sentence masked.

    rows, right (share of them), sure (share with a confidence of ``SURE`` or more), sure_right (share of those), value_right
    (share of the sure ones whose converted value is right), confidence (mean of the sure ones), review (share left over).
    """
    units = {p: u for p, u in common_units(kinds).items() if unit(u)}
    targets = {p: unit(u) for p, u in units.items()}
    wanted = mentions.where(F.col("property_name").isin(*units) & F.col("mention_id").isNotNull()).select(*_FIELDS)
    model = UnitModel.fit(wanted.where("mention_id % 2 = 0"), targets, fit_rows)
    held = wanted.where("mention_id % 2 <> 0")
    share = min(1.0, fit_rows / max(1, held.count()))
    rows = held.where(F.pmod(F.xxhash64("mention_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * fit_rows).toPandas()
    seen = []
    for _, prop, raw, num, norm, unit_text, sentence, source in rows.itertuples(index=False, name=None):
        r = read(raw, unit_text, num, None, norm, targets[prop][2])
        if r.bare is not None and r.own is not None:
            seen.append((prop, r, source))
    said, sure = model.predict([(p, r._replace(told=None), s) for p, r, s in seen])
    right = np.array([u is not None and _same(u, r.own) for u, (_, r, _) in zip(said, seen)], dtype=bool)
    value = np.array([u is not None and convert(r.bare, u, targets[p]) == convert(r.bare, r.own, targets[p]) for u, (p, r, _) in zip(said, seen)], dtype=bool)
    known = np.array(sure) >= SURE
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    return {"rows": len(seen), "right": mean(right), "sure": mean(known), "sure_right": mean(right[known]), "value_right": mean((right | value)[known]), "confidence": mean(np.array(sure)[known]), "review": mean(~known)}


def for_review(mentions: DataFrame, kinds: DataFrame) -> DataFrame:
    """The mentions whose unit nothing states and whose prediction is unsure."""
    return quantities(mentions, kinds).where("state = 'review'").select("mention_id", "common_unit").distinct()


def _same(a: tuple, b: tuple) -> bool:
    return a[2] == b[2] and a[1] == b[1] and abs(a[0] * a[3] - b[0] * b[3]) <= 1e-9 * abs(b[0] * b[3])


class UnitModel:
    """An ensemble per property that gives the unit a number was recorded in.

    Features: magnitude, source, ratio to the value normalised before, whether that ratio fits each unit, and the unit
    that the sentence seems to state; each fitted row is used with and without the last, so that the model also knows
    what to say without it. Fitted on at most ``fit_rows`` rows whose own fields state the unit, chosen by a hash of
    their id.
    """

    def __init__(self) -> None:
        self.classes: dict[str, list[tuple]] = {}
        self.forests: dict[str, Forest] = {}
        self.sources: dict[str, int] = {}

    @classmethod
    def fit(cls, wanted: DataFrame, targets: dict[str, tuple], fit_rows: int) -> UnitModel:
        total = wanted.count()
        share = min(1.0, fit_rows / max(1, total))
        some = wanted.where(F.pmod(F.xxhash64("mention_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * fit_rows)
        rows = some.toPandas()
        model = cls()
        by: dict[str, list] = {}
        for _, prop, raw, num, norm, unit_text, sentence, source in rows.itertuples(index=False, name=None):
            r = read(raw, unit_text, num, sentence, norm, targets[prop][2], always=True)
            if r.bare is not None and r.own is not None:
                by.setdefault(prop, []).append((r, source))
                model.sources.setdefault(source, len(model.sources))
        for prop, seen in by.items():
            units: list[tuple] = []
            y = []
            for r, _ in seen:
                k = next((i for i, u in enumerate(units) if _same(u, r.own)), -1)
                if k < 0:
                    k = len(units)
                    units.append(r.own)
                y.append(k)
            model.classes[prop] = units
            x = np.array([model.features(prop, r, s) for r, s in seen] + [model.features(prop, r._replace(told=None), s) for r, s in seen])
            model.forests[prop] = Forest().fit(x, np.array(y + y), len(units))
        return model

    def features(self, prop: str, r: Reading, source: str | None) -> list[float]:
        units = self.classes.get(prop, [])
        size = log10(abs(r.bare)) if r.bare else -30.0
        ratio = log10(abs(r.before / r.bare)) if r.before and r.bare and isfinite(r.before / r.bare) and r.before / r.bare else 99.0
        hint = next((float(i) for i, u in enumerate(units) if _same(u, r.told)), -1.0) if r.told else -2.0
        return [size, ratio, hint, float(self.sources.get(source, -1))]

    def predict(self, rows: list[tuple[str, Reading, str | None]]) -> tuple[list[tuple | None], list[float]]:
        out: list[tuple | None] = [None] * len(rows)
        sure = [0.0] * len(rows)
        by: dict[str, list[int]] = {}
        for i, (prop, _, _) in enumerate(rows):
            by.setdefault(prop, []).append(i)
        for prop, at in by.items():
            if prop in self.forests:
                which, conf = self.forests[prop].predict(np.array([self.features(prop, rows[i][1], rows[i][2]) for i in at]))
                for i, k, c in zip(at, which, conf):
                    out[i], sure[i] = self.classes[prop][int(k)], float(c)
        return out, sure
