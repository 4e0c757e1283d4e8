"""Several values packed in one field: one row per value, with its place.

A field is cut into tokens: quoted groups, runs of ordinary text, and delimiters. Each token is masked by one sign that
says what it can be (a full name, a lone surname, given names, a suffix, a phrase for unnamed others, a delimiter), and
the signs in order are the field's *delimiter skeleton*. Fields of the same form share a skeleton however the names read,
so the question which tokens make up which value is answered once per distinct skeleton, in Python, and the answer (the
positions of each value's tokens) is joined back and applied by position inside the JVM. The table of rules is measured:
up to ``RULE_BYTES`` it is broadcast, so that the fields aren't shuffled; beyond that both sides are joined by skeleton and
salt, as a few skeletons (one author, two authors) hold most of the fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import BLANK, squeeze, stated
from ferrule.session import stored

#: The rules are broadcast if they take no more bytes than this, and are copied to so many salts otherwise.
RULE_BYTES, SALTS = 64 << 20, 16

#: Affiliation marks: digits, superscripts and signs at the end of a word.
_MARKS = r"(?<=[\p{L}\p{M}.'’])(?:[0-9\u00b9\u00b2\u00b3\u2070-\u2079*†‡§¶#]+|\^\{?[0-9,*]+\}?)(?:\s*,\s*(?:[0-9\u00b9\u00b2\u00b3\u2070-\u2079]{1,2}(?![\p{L}0-9])|[*†‡§¶#])+)*"
_OTHERS = r"(?:(?:\b(?:[Aa]nd|[Uu]nd)\s+|&\s*)?(?:\(?\b[Ee][Tt]\s+[Aa][Ll]\b\.?\)?|\b(?:\d+\s+)?(?:[Oo]thers|[Cc]o-?workers|[Cc]olleagues|[Aa]ndere|[Ww]eitere)\b)|\b[Uu]\.\s?[Aa]\.)"
_AND = r"(?:\b(?:and|und|And|Und|AND|UND)\b|&)"
# possessive runs rather than a loop over alternatives, which would take a stack frame for each character
_QUOTED = r'"[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"(?!")'
_LISTED = r"(?<=[\[,]\s?)'[^'\\]*+(?:\\.[^'\\]*+)*+'(?=\s?[\],])"
#: Order matters: quoted groups, unnamed others, delimiters, then text up to the next of these (looked for at the start of each word).
_WORD = rf"(?!{_OTHERS}|{_AND})[^;|/•·,\s\[\]\"]++"
TOKEN = rf"{_QUOTED}|{_LISTED}|{_OTHERS}|{_AND}|[;|/•·,\t\n\r\[\]\"]|{_WORD}(?: {_WORD})*+|\s"

_P = r"(?:[\p{Ll}’']+\s+)*"  # particles such as "van" or "de la"
_W = r"(?:[\p{Ll}]{1,3}[-’'])?\p{Lu}[\p{L}\p{M}]*[\p{Ll}\p{M}][\p{L}\p{M}]*(?:[-’'][\p{L}\p{M}]+)*\.?|\p{Lu}[’']\p{Lu}[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*"
_I = r"(?:\p{Lu}\.(?:\s?-?\s?\p{Lu}\.)*|\p{Lu}(?:\s\p{Lu})*)"
#: What a run of text can be, by the first pattern that fits; the sign stands in the skeleton.
CLASSES = (
    ("j", r"^(?i:jr|sr)\.?$|^(?:II|III|IV)\.?$"),
    ("g", rf"^(?:{_I}|(?:{_W})(?:\s{_I})+)$"),
    ("s", rf"^{_P}(?:{_W})$"),
    ("n", rf"^{_P}(?:{_W})\s\p{{Lu}}{{1,3}}(?:\s(?i:jr|sr)\.?)?$"),
)


def _sign(t: Column) -> Column:
    """The sign of one token in the skeleton."""
    c = F.when(t == " ", F.lit("_")).when(t.isin(",", "[", "]", '"'), t).when(t.isin(*";|/•·\t\n\r"), F.lit(";"))
    c = c.when(t.rlike(f"^{_OTHERS}$"), F.lit("e")).when(t.rlike(f"^{_AND}$"), F.lit("&"))
    c = c.when(t.rlike(r"^[\"'].*[\"']$") & (F.length(t) > 1), F.when(F.length(t) > 2, F.lit("q")).otherwise(F.lit("_")))
    c = c.when(~t.rlike(r"[\p{L}\p{N}]"), F.lit("_"))
    for sign, pattern in CLASSES:
        c = c.when(t.rlike(pattern), F.lit(sign))
    return c.otherwise(F.lit("d"))


def resolve(skeleton: str) -> list[list[int]]:
    """The token positions (from 0) of each value of a field with this skeleton.

    ``s`` (a lone surname or a lone given name) followed by ``,`` and given names is one inverted name; a suffix stays
    with the name before it; full names, quoted groups and lone names stand by themselves.
    """
    values: list[list[int]] = []
    piece: list[int] = []  # the value being built
    kind = ""  # its sign, "" if there is none
    comma = -1  # the comma since its last token

    def close() -> None:
        nonlocal piece, kind, comma
        if piece:
            values.append(piece)
        piece, kind, comma = [], "", -1

    for i, c in enumerate(skeleton):
        if c == "," and kind:
            if comma >= 0:  # two commas in a row part two values
                close()
            else:
                comma = i
        elif c in ";&[]e\"":
            close()
        elif c in "_,":
            continue
        elif c == "j" and kind:
            piece += range(comma, i + 1) if comma >= 0 else [i]
            comma = -1
            kind = "d" if kind != "s" else "s"
        elif c in "gs" and kind == "s" and comma >= 0:
            piece += range(comma, i + 1)
            comma, kind = -1, "d"
        else:
            close()
            piece, kind = [i], c
    close()
    return values


def split_names(rows: DataFrame, row_id: str, field: str, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """One row per name of a packed field: (``row_id``, pos_no from 1, author as written).

    Quotes, escapes, delimiters and affiliation marks are gone, inner white space is one space. Null, blank and
    "nothing here" fields give no row, nor do phrases for unnamed others. A repeated row counts once. Fields of any
    length are treated whole; what can't be told to be a name (no letter or digit) is left out.
    """
    text = F.regexp_replace(F.regexp_replace(stated(F.col(field)), r"[\u00a0\u2000-\u200a\u202f\u3000]", " "), "[\u200b\ufeff]", "")
    text = F.when(text.rlike(r"[0-9\u00b9\u00b2\u00b3\u2070-\u2079*†‡§¶#]"), F.regexp_replace(text, _MARKS, "")).otherwise(text)
    text = F.regexp_replace(text, r"[ \f\u000b]+", " ")
    fields = rows.select(F.col(row_id).alias("_id"), F.col(field)).where(F.col(field).isNotNull()).dropDuplicates(["_id"]).select("_id", text.alias("_t")).where("_t is not null")
    fields = fields.select("_id", F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0)).alias("_tok"))
    fields = stored(fields.select("_id", "_tok", F.array_join(F.transform("_tok", _sign), "").alias("_sk")), "split-tokens")  # tokenised once, read twice

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_sk": b["_sk"], "_rule": [resolve(s) for s in b["_sk"]]})

    schema = T.StructType([T.StructField("_sk", T.StringType()), T.StructField("_rule", T.ArrayType(T.ArrayType(T.IntegerType())))])
    rule = stored(fields.select("_sk").distinct().mapInPandas(rules, schema), "split-rules")
    # a position takes four bytes, a value's list some more, and the skeleton a byte a token
    held = rule.agg(F.sum(64 + F.length("_sk") + 4 * F.size(F.flatten("_rule")) + 24 * F.size("_rule"))).first()[0] or 0
    if held <= rule_bytes:
        out = fields.join(F.broadcast(rule), "_sk")
    else:
        salted = rule.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = fields.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_sk", "_salt"])
    out = out.select("_id", "_tok", F.posexplode("_rule").alias("_pos", "_at"))
    value = F.array_join(F.transform("_at", lambda i: F.element_at("_tok", i + 1)), "")
    value = squeeze(F.regexp_replace(value, r"\\([\"'\\])", "$1"))
    # the quotes around a whole group go, doubled quotes inside it are one
    value = F.when(value.rlike(r'^".*"$'), F.regexp_replace(F.regexp_replace(value, r'^"|"$', ""), '""', '"')).when(value.rlike("^'.*'$"), F.regexp_replace(value, "^'|'$", "")).otherwise(value)
    return out.select(F.col("_id").alias(row_id), (F.col("_pos") + 1).cast("int").alias("pos_no"), F.regexp_replace(squeeze(value), f"{BLANK}+,", ",").alias("author"))
