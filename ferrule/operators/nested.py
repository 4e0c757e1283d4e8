"""Deeply nested records as related flat tables, linked by interval labels.

Every node of a payload's tree gets two numbers by one depth-first walk: ``pre`` when it is entered and ``post`` when it
is left. A node lies under another exactly if its pre is larger and its post smaller. :func:`nodes` emits one row per
node of a kind of interest with both numbers; :func:`children` finds each node's owner by containment. As owners of one
kind don't nest, the only one that can contain a node is the last that was entered before it, so containment is one
window over the record's nodes in order of ``pre``, not a join of ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "NONE"
NODE = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()),
    T.StructField("place", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("val", T.StringType()), T.StructField("link", T.StringType()),
])


def read_payload(text: str | None) -> Any:
    """The JSON value of a payload, however often it was encoded again as a string, with or without a byte order mark; None
    if it is unreadable (that includes nesting beyond what the JSON parser itself can take)."""
    while isinstance(text, str):
        try:
            text = json.loads(text.lstrip("\ufeff").strip())
        except (ValueError, RecursionError):
            return None
    return text


def _text(v: Any) -> str:
    """A label or value as text; what is missing is NONE."""
    if v is None or isinstance(v, (dict, list)):
        return NONE
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v).strip() or NONE


def _inner(v: Any) -> Any:
    """An object or list that was encoded as a string inside the payload, however often; other values as they are."""
    x = v
    while isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"'):
        try:
            x = json.loads(x)
        except (ValueError, RecursionError):
            return v
    return x if isinstance(x, (dict, list)) else v


def _thousandths(v: Any) -> str:
    try:
        return str(int((Decimal(str(v).strip()) * 1000).to_integral_value(ROUND_HALF_EVEN)))
    except (InvalidOperation, ValueError, OverflowError):
        return NONE


class _Walk:
    """One depth-first walk over a payload, numbering every node."""

    def __init__(self) -> None:
        self.pre = self.post = self.materials = self.relations = 0
        self.out: list[tuple] = []

    def enter(self) -> int:
        self.pre += 1
        return self.pre

    def leave(self) -> int:
        self.post += 1
        return self.post

    def skip(self, v: Any) -> None:
        """Number a subtree of no interest."""
        stack: list[Any] = [v]
        while stack:
            x = stack.pop()
            if isinstance(x, _Leave):
                self.leave()
                continue
            self.enter()
            stack.append(_LEAVE)
            stack.extend(reversed([*(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]))

    def emit(self, kind: str, place: int, label: str, val: str, link: str | None, at: int) -> None:
        self.out.append((kind, at, self.leave(), place, label, val, link))

    def paper(self, v: Any) -> None:
        """A paper, or what wraps one or more, to any depth: a stack holds what is still to be entered or left."""
        stack: list[tuple[Any, Any]] = [(None, v)]
        while stack:
            k, x = stack.pop()
            if isinstance(x, _Leave):
                self.leave()
            elif k == "materials":
                self.each(x, self.material)
            elif k == "relations":
                self.each(x, self.relation)
            elif k == "skip" or not isinstance(x, (dict, list)):
                self.skip(x)
            else:
                self.enter()
                stack.append((None, _LEAVE))
                if isinstance(x, list):
                    stack.extend((None, _inner(y)) for y in reversed(x))
                else:
                    known = "materials" in x or "relations" in x
                    stack.extend((n if n in ("materials", "relations") else "skip" if known else None, _inner(y)) for n, y in reversed(x.items()))

    def each(self, v: Any, child: Any) -> None:
        """The children of a list; a lone object counts as a list of one."""
        self.enter()
        for x in v if isinstance(v, list) else [v] if isinstance(v, dict) and v else []:
            child(_inner(x))
        self.leave()

    def material(self, m: Any) -> None:
        at = self.enter()
        self.materials += 1
        place = self.materials
        if not isinstance(m, dict):
            self.leave()
            return
        for k, x in m.items():
            x = _inner(x)
            if k == "elements":
                self.elements(x)
            elif k == "properties":
                self.enter()
                for n, p in enumerate(x if isinstance(x, list) else [x] if isinstance(x, dict) else [], 1):
                    self.leafy("property", n, _inner(p), "raw_value")
                self.leave()
            else:
                self.skip(x)
        self.emit("material", place, _text(m.get("normalized_formula")), _text(m.get("material_id")), None, at)

    def elements(self, v: Any) -> None:
        self.enter()
        items = [*v.items()] if isinstance(v, dict) else v if isinstance(v, list) else []
        if isinstance(v, dict) and "amount" in v and ("symbol" in v or "el" in v):
            items = [v]
        for e in items:
            at = self.enter()
            if isinstance(e, dict):
                symbol = e.get("symbol", e.get("el", e.get("element")))
                symbol = symbol.get("symbol") if isinstance(symbol, dict) else symbol
                amount = e.get("amount")
            elif isinstance(e, (list, tuple)) and e:
                symbol, amount = e[0], e[1] if len(e) > 1 else None
            else:
                self.leave()
                continue
            amount = amount.get("amount", amount.get("value")) if isinstance(amount, dict) else amount
            self.emit("element", 0, _text(symbol), _thousandths(amount), None, at)
        self.leave()

    def leafy(self, kind: str, place: int, p: Any, key: str) -> None:
        at = self.enter()
        if not isinstance(p, dict):
            self.leave()
            return
        for x in p.values():
            self.skip(x)
        self.emit(kind, place, _text(p.get("property_name")), _text(p.get(key)), None, at)

    def relation(self, r: Any) -> None:
        at = self.enter()
        self.relations += 1
        place = self.relations
        if not isinstance(r, dict):
            self.leave()
            return
        for x in r.values():
            self.skip(x)
        v = _inner(r.get("property_value"))
        while isinstance(v, dict) and "raw_value" not in v and isinstance(_inner(v.get("field")), dict):
            v = _inner(v["field"])
        self.emit("relation", place, _text(r.get("property_name")), _text(v.get("raw_value") if isinstance(v, dict) else v), _text(r.get("material_id")), at)


class _Leave:
    pass


_LEAVE = _Leave()


def payload_nodes(text: str | None) -> list[tuple]:
    """(kind, pre, post, place, label, val, link) of each material, element, property and relation of a payload."""
    v = read_payload(text)
    if not isinstance(v, (dict, list)):
        return []
    walk = _Walk()
    walk.paper(v)
    return walk.out


def nodes(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """The node table of all records. Empty, cut off or otherwise unreadable payloads give no nodes."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *n) for i, p in zip(b["i"], b["p"]) for n in payload_nodes(p)]
            yield pd.DataFrame(rows, columns=NODE.names)

    return records.select(F.col(record_id).cast("long").alias("i"), F.col(payload).alias("p")).where("i is not null and p is not null").dropDuplicates(["i"]).mapInPandas(walk, NODE)


def children(node_table: DataFrame) -> DataFrame:
    """All nodes as rows (record_id, child, mat_no, child_no, label, val), each linked to its material.

    Elements and properties belong to the material whose interval contains theirs; relations to the first material with
    the same material_id, 0 where there is none (or where the id is missing). Repeated records count once.
    """
    is_material = F.col("kind") == "material"
    order = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(is_material, F.struct("place", "post")), ignorenulls=True).over(order)
    inside = node_table.where("kind <> 'relation'").withColumn("own", own)
    inside = inside.where(F.col("post") <= F.col("own.post")).select("record_id", F.col("kind").alias("child"), F.col("own.place").alias("mat_no"), F.when(F.col("kind") == "property", F.col("place")).otherwise(0).alias("child_no"), "label", "val")
    first = node_table.where(is_material & (F.col("val") != NONE)).groupBy("record_id", F.col("val").alias("link")).agg(F.min("place").alias("mat_no"))
    linked = node_table.where("kind = 'relation'").join(first, ["record_id", "link"], "left").select("record_id", F.col("kind").alias("child"), F.coalesce("mat_no", F.lit(0)).alias("mat_no"), F.col("place").alias("child_no"), "label", "val")
    return inside.unionByName(linked)
