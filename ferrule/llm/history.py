"""Each new batch against everything accepted before: bit fingerprints in rotated block tables.

A record's title is normalised (marks of layout, labels and journals off, relation and part kept apart) and gets a
fingerprint of four 32-bit blocks, each the SimHash of the letters' trigrams in one quarter of its words. Damage in one
place changes the bits of one block only, so two forms of a title agree exactly in two blocks as long as no more than
two quarters are damaged. The index holds each form of a title once for each rotation that puts another pair of blocks
in front; a look-up is an equality join on that pair, and what it finds is verified by the bits that differ and then by
text. DOI, file name and the first words of cut-off titles are further keys of the same table; what they find is held to
the same text check, as each of them can be wrong.

:class:`HistoryIndex` takes batches. A batch reads only the buckets of its own keys, writes the links it found and
appends its new keys; titles of the past are read only for the candidates found. Exact copies of a title are one form,
named by a hash of its text, so they need no look-up. Works are the components of the links.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import MISSING, stated
from ferrule.operators.ledger import file_key
from ferrule.session import discard, exists, stored, tidy, work_dir

BLOCKS = 4
#: Differing bits (of 128) that a pair may have at most before its text is looked at. Blocks of unlike texts differ in 16
#: bits each; of the pairs of forms that share two blocks and are one title, 99.6 % differ in no more than this.
MAX_BITS = 26
#: Forms that may share a key before they are compared by way of centers and of the rarest grams of their letters instead
#: of each with each; what is found is the same.
CROWD = 200
#: Letters of a gram, and longs of 64 bits that the grams of a form are marked in.
GRAM, MARKS = 3, 4
#: Deliveries of fewer rows than this are taken in together with the next, as a batch has its fixed costs (some nine jobs).
LEAST_ROWS = 10_000
#: Keys or forms of a batch are broadcast up to so many, so that the tables of the past are read but not shuffled.
BROADCAST_ROWS = 1_000_000
#: Edges up to so many go to one task to find their components; more are joined round by round.
TASK_EDGES = 250_000
#: Keys of a batch that one task takes, so that files get no smaller than need be: without Hadoop's native code each file
#: costs three processes that set modes, and until such a process runs its own program it shares an executor's memory.
TASK_KEYS = 100_000
#: Folders that the keys of one batch are spread over.
BUCKETS = 8
#: Edits between two forms of one title: at most this share of the shorter one, and at least this many are allowed.
EDIT_SHARE, EDITS = 0.045, 3
#: Letters that a cut-off title must have at least to be known as one.
LEAST_CUT = 30
_LABEL = re.compile(r"^\s*(?:\[\s*(?:article|paper|review|preprint)\s*\]|(?:full|research|original|regular|review)\s+(?:paper|article|communication)\b|title\s*:)\s*[:–—-]*\s*", re.IGNORECASE)
_RELATION = ((re.compile(r"^\s*(?:author\s+)?corr\w{3,7}n?\s+to\b\s*[:–—-]*\s*", re.IGNORECASE), "correction"), (re.compile(r"^\s*err\w{2,4}m\b\s*[:–—-]*\s*", re.IGNORECASE), "erratum"), (re.compile(r"^\s*corrig\w+\b\s*[:–—-]*\s*", re.IGNORECASE), "corrigendum"), (re.compile(r"^\s*re\w{2,3}y\s+to\b(?:.{0,20}?\bcom\w+\s+on\b)?\s*[:–—-]*\s*", re.IGNORECASE), "reply"), (re.compile(r"^\s*com+ents?\s+on\b\s*[:–—-]*\s*", re.IGNORECASE), "comment"), (re.compile(r"^\s*retraction\b\s*[:–—-]*\s*", re.IGNORECASE), "retraction"))
_SERIAL = r"(?:annals|letters|quarterly|reports|communications|proceedings|journal|transactions|review)"
_JOURNAL = re.compile(rf"\s+(?:\||//)\s.*$|\s+[-–—]\s+(?:[^\W\d_]+\s+){{1,4}}{_SERIAL}\s*$|\s{{3,}}(?:[^\W\d_]+\s+){{1,4}}{_SERIAL}\s*$", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"[\s.,:(–—-]+(?:\(?part\s+(\d+|[ivx]+)\)?|[-–—]\s*([ivx]+))\s*$", re.IGNORECASE)
_NO_TITLE = re.compile(r"^\s*(?:microsoft word\b.*|untitled.*|document\s*\d*|title|paper)\s*$", re.IGNORECASE)
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}


def read_title(title: str | None) -> tuple[str, str, str, str, bool] | None:
    """(relation, part, words, formula, cut off) of a title; None where there is none."""
    if title is None or title.strip().lower() in MISSING or _NO_TITLE.match(title):
        return None
    t = re.sub(r"</?[a-zA-Z]+>", "", title)
    t = unicodedata.normalize("NFKC", re.sub(r"[$\\]|[_^]?\{|\}", "", t))
    t = _JOURNAL.sub("", " " + t.strip()).strip()
    t = _LABEL.sub("", t)
    relation = ""
    for pattern, name in _RELATION:
        if m := pattern.match(t):
            relation, t = name, t[m.end() :]
            break
    t = _LABEL.sub("", t)
    t = re.sub(r"[\s†‡*]+$", "", t)
    short = bool(re.search(r"(?:…|\.\.\.)$", t))
    t = re.sub(r"[\s.…]+$", "", t)
    part = ""
    if m := _PART.search(t):
        n = (m[1] or m[2]).lower()
        part, t = _ROMAN.get(n, n), t[: m.start()]
    t = re.sub(r"(?<=\d)\.(?=\d)", "p", t.lower()).replace("&", " and ")
    words = [w for w in re.findall(r"[^\W_]+", t) if w != "the"]
    if not words:
        return None
    formula = " ".join(w for w in re.findall(r"[^\W_(]*\d[^\W_]*(?:\([^\W_]+\)\d*[^\W_]*)*", t))
    return relation, part, " ".join(words), formula, short


@lru_cache(maxsize=200_000)
def _simhash(text: str) -> int:
    """32 bits: the signs of the summed hash bits of a text's trigrams."""
    if not text:
        return 0
    text = f"  {text} "
    h = np.fromiter((xxhash.xxh32_intdigest(text[i : i + 3]) for i in range(len(text) - 2)), dtype=np.uint32)
    bits = np.unpackbits(h[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    return int(np.packbits(2 * bits.sum(0) > len(h), bitorder="little").view(np.uint32)[0])


def fingerprint(words: str) -> list[int]:
    """Four blocks, one for each quarter of the words; of the letters where there are fewer words than blocks."""
    w = words.split()
    if len(w) < BLOCKS:
        t = "".join(w)
        return [_simhash(t[round(i * len(t) / BLOCKS) : round((i + 1) * len(t) / BLOCKS)]) for i in range(BLOCKS)]
    return [_simhash(" ".join(w[round(i * len(w) / BLOCKS) : round((i + 1) * len(w) / BLOCKS)])) for i in range(BLOCKS)]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                now[j] = min(now[j], before[j - 2] + 1)
        before, last = last, now
        if min(now) > most:
            return most + 1
    return min(last[-1], most + 1)


def most_edits(chars: int) -> int:
    """How many edits a title of so many letters may be away from a longer one."""
    return max(EDITS, int(EDIT_SHARE * chars))


def same_title(a: str, b: str, short_a: bool, short_b: bool) -> bool:
    """Whether two normalised titles are forms of one: few edits, or one is the other cut off."""
    x, y = a.replace(" ", ""), b.replace(" ", "")
    most = most_edits(min(len(x), len(y)))
    if edits(x, y, most) <= most:
        return True
    if len(x) > len(y):
        x, y, short_a = y, x, short_b
    if len(x) < LEAST_CUT or not (short_a or len(x) < 0.93 * len(y)):
        return False
    return any(edits(x, y[: len(x) + d], 2) <= 2 for d in (0, 1, -1))


def doi_key(doi: Column) -> Column:
    """What identifies a DOI however it is written: the last piece of its suffix without version, as publisher and preprint share it."""
    d = F.lower(F.regexp_replace(F.regexp_replace(stated(doi), "(?i)%2f", "/"), r"[\s ​]+", ""))
    d = F.regexp_extract(d, r"10\.\d{4,6}/(\S+)$", 1)
    d = F.regexp_replace(F.regexp_replace(d, r"[?#].*$", ""), r"[.,;:)\]>\"']+$", "")
    d = F.regexp_replace(F.regexp_replace(d, r"/(?:pdf|abstract|full|epdf|html)$", ""), r"[.,;:)\]>\"']+$", "")
    pre = F.regexp_extract(d, r"^pre\.([a-z0-9]{6})(?:v\d+)?$", 1)
    published = F.regexp_extract(d, r"^[a-z]+\.\d{4}\.([a-z0-9]+)$", 1)
    return F.when(pre != "", pre).when(published != "", published).when(d != "", d)


def base_file(name: Column) -> Column:
    """A file's name without location, ending and marks of copies and versions."""
    n = F.regexp_replace(file_key(name), r"\.[a-z0-9]{1,4}$", "")
    return F.regexp_replace(n, r"(?:\s\((?!1\)$)\d+\)|_copy\d*|-v\d+|\s-\skopie(?:\s\d+)?|\s-\scopy(?:\s\d+)?)$", "")


_READ = T.StructType([T.StructField(c, T.StringType()) for c in ("relation", "part", "words", "formula")] + [T.StructField("short", T.BooleanType()), T.StructField("blocks", T.ArrayType(T.LongType()))])


@F.pandas_udf(_READ)
def _read(title: pd.Series) -> pd.DataFrame:
    rows = [(*r, fingerprint(r[2])) if (r := read_title(t)) else (None, None, None, None, None, None) for t in title]
    return pd.DataFrame(rows, columns=_READ.names)


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series, short_a: pd.Series, short_b: pd.Series) -> pd.Series:
    return pd.Series([same_title(*x) for x in zip(a, b, short_a, short_b)], dtype=bool)


def prepare(rows: DataFrame, row_id: str = "paper_id") -> DataFrame:
    """Rows with their keys: id, title parts, form (a hash of relation, part and words; null without a title), doi, file, base."""
    r = rows.select(F.col(row_id).alias("id"), _read(F.col("title")).alias("t"), doi_key(F.col("doi")).alias("doi"), file_key(F.col("filename")).alias("file"), base_file(F.col("filename")).alias("base"))
    form = F.when(F.col("words").isNotNull(), F.md5(F.concat_ws("\u0001", "relation", "part", "words"))).alias("form")
    return r.select("id", "t.*", "doi", "file", "base").select("*", form)


_FORM = ("form", "relation", "part", "words", "formula", "short", "blocks")
#: What a key is made of: two blocks (its candidates must agree in part and formula and hold to the bits), DOI or file with
#: something of the title, or the beginning of a title that may be cut off.
BLOCK, SHARED, BEGINNING = "block", "shared", "beginning"


def all_keys(rows: DataFrame) -> DataFrame:
    """The keys of prepared rows, one row for each row and key: (bucket, key, kind, form, blocks, part, short, n_words, n_chars).

    A key with nothing in it (an empty block, no DOI, no file, no formula) isn't made, as all rows without would meet there.
    """
    lone, pair = F.col("blocks"), list(combinations(range(BLOCKS), 2))

    def head(n: int) -> Column:
        return F.array_join(F.slice(F.split("words", " "), 1, n), " ")

    def key(kind: str, name: str, where: Column, *parts: Column) -> Column:
        return F.when(where, F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(name), F.col("relation"), *parts).alias("key")))

    made = [key(BLOCK, f"b{k}", (lone[i] != 0) & (lone[j] != 0), lone[i], lone[j], F.col("part"), F.col("formula")) for k, (i, j) in enumerate(pair)]
    made.append(key(BEGINNING, "h", F.col("formula") != "", F.col("formula"), head(4)))
    for c in ("doi", "base"):
        there = F.col(c).isNotNull()
        made += [key(SHARED, f"{c}f", there & (F.col("formula") != ""), F.col(c), F.col("formula")), key(SHARED, f"{c}h", there, F.col(c), head(2))]
        made += [key(SHARED, f"{c}{i}", there & (lone[i] != 0), F.col(c), lone[i]) for i in range(BLOCKS)]
    k = rows.where("form is not null").select(*_FORM, F.explode(F.array_compact(F.array(*made))).alias("k"))
    size = (F.size(F.split("words", " ")).alias("n_words"), F.length("words").alias("n_chars"))
    return k.select(F.pmod("k.key", F.lit(BUCKETS)).cast("int").alias("bucket"), "k.key", "k.kind", "form", "blocks", "part", "short", *size)


def keys_of(rows: DataFrame) -> DataFrame:
    """The distinct keys of prepared rows, as :func:`all_keys` has them."""
    return all_keys(rows).dropDuplicates(["key", "form"])


def _bits() -> Column:
    return sum((F.bit_count(F.col("a.blocks")[i].bitwiseXOR(F.col("b.blocks")[i])) for i in range(BLOCKS)), F.lit(0))


def _may_match() -> Column:
    """What two forms under one key must have before their texts are compared."""
    lost = lambda x, y: (F.col(f"{x}.short") | (F.col(f"{x}.n_words") < 12)) & ~F.col(f"{y}.short") & (F.col(f"{x}.n_chars") < 0.93 * F.col(f"{y}.n_chars"))
    one_part = (F.col("a.part") == F.col("b.part")) | (F.col("a.part") == "") | (F.col("b.part") == "")
    kind = F.col("a.kind")
    return ((kind == BLOCK) & (_bits() <= MAX_BITS)) | ((kind == SHARED) & one_part) | ((kind == BEGINNING) & (lost("a", "b") | lost("b", "a")))


def pairs_of(keyed: DataFrame) -> DataFrame:
    """(form, other, kind): forms under one key that may be one title; at least one of the two is new."""
    a, b = keyed.where("new").alias("a"), keyed.alias("b")
    once = ~F.col("b.new") | (F.col("a.form") > F.col("b.form"))
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.form") != F.col("b.form")) & once & _may_match())
    return found.select(F.col("a.form").alias("form"), F.col("b.form").alias("other"), F.col("a.kind").alias("kind")).distinct()


def links_of(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, other, tail): the pairs whose texts are forms of one title.

    ``tail`` is null for a firm link. A title found by its beginning only, or one without a part under a DOI or file whose
    titles have one, counts as cut off: its link has as tail what tells the whole titles that begin alike apart.
    """
    f = forms.select("form", "part", "words", "short")
    p = pairs.join(f.select("form", *(F.col(c).alias(f"{c}_a") for c in ("part", "words", "short"))), "form")
    p = p.join(f.select(F.col("form").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("part", "words", "short"))), "other")
    shorter = F.length("words_a") < F.length("words_b")
    far = F.least(F.length("words_a"), F.length("words_b")) < 0.93 * F.greatest(F.length("words_a"), F.length("words_b"))
    lesser_part = F.when(shorter, F.col("part_a")).otherwise(F.col("part_b"))
    p = p.where((F.col("part_a") == F.col("part_b")) | ((lesser_part == "") & far)).where(_same("words_a", "words_b", "short_a", "short_b"))
    end = lambda x: F.concat_ws("|", f"part_{x}", F.substring(F.array_join(F.slice(F.split(f"words_{x}", " "), -2, 2), " "), 1, 3))
    cut_off = F.col("kind") == BEGINNING
    whole = F.struct(F.col("other").alias("x"), end("b").alias("e"))
    mine = F.struct(F.col("form").alias("x"), end("a").alias("e"))
    p = p.select("form", "other", cut_off.alias("c"), F.when(shorter, F.col("form")).otherwise(F.col("other")).alias("lost"), F.when(shorter, whole).otherwise(mine).alias("whole"))
    return p.select(F.when(F.col("c"), F.col("lost")).otherwise(F.col("form")).alias("form"), F.when(F.col("c"), F.col("whole.x")).otherwise(F.col("other")).alias("other"), F.when(F.col("c"), F.col("whole.e")).alias("tail")).distinct()


_GRAMS = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("lone", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("chars", T.IntegerType()), T.StructField("spare", T.IntegerType())])


def grams_of(words: str) -> tuple[list[int], list[int], list[int], int, int]:
    """(grams, lone, marks, chars, spare) of a form: the hashes of its grams, also as bits, and its number of letters.

    An edit takes away GRAM + 1 grams at most, so a form that :func:`same_title` holds to be a longer (or as long) one
    has all but ``spare`` of its grams in it. A form that has no more than those is looked for by ``lone`` instead: by the
    lengths that it may be edited to, or, where it may be a cut-off one, by 0, which all forms have.
    """
    t = words.replace(" ", "")
    grams = {xxhash.xxh32_intdigest(t[i : i + GRAM]) for i in range(len(t) - GRAM + 1)}
    most = most_edits(len(t))
    spare = (GRAM + 1) * most
    bits = np.zeros(64 * MARKS, dtype=np.uint8)
    bits[[g % (64 * MARKS) for g in grams]] = 1
    lone = [] if len(grams) > spare else list(range(len(t), len(t) + most + 1)) if len(t) < LEAST_CUT else [0]
    return sorted(g + 2**32 for g in grams), lone, np.packbits(bits).view(np.int64).tolist(), len(t), spare


@F.pandas_udf(_GRAMS)
def _grams(words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([grams_of(w) for w in words], columns=_GRAMS.names)


def _near() -> Column:
    """Whether the shorter of two forms has enough of its grams in the longer one, by their marks; true of all that are one title."""
    lost = lambda x, y: sum((F.bit_count(F.col(f"{x}.marks")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.marks")[i]))) for i in range(MARKS)), F.lit(0)) <= F.col(f"{x}.spare")
    return F.when(F.col("a.chars") <= F.col("b.chars"), lost("a", "b")).otherwise(lost("b", "a"))


def center_links(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Links of forms under crowded keys to centers: the longest whole form of a key is its center, all forms that match it
    are linked to it, and one of those that have none yet is the next center, as long as a round leaves no more than three
    quarters of them. This joins most of a large work; what else forms match is left to :func:`crowd_pairs`."""
    size, left, out = rows.count(), rows, []
    center = F.max(F.struct((~F.col("short")).alias("w"), "n_chars", "form", *(c for c in rows.columns if c not in ("key", "n_chars", "form")))).alias("b")
    while size:
        tried = rows.alias("a").join(left.groupBy("key").agg(center, F.count("*").alias("n")).where("n > 1"), "key").where("a.form <> b.form")
        found = stored(links_of(tried.where(_may_match() & _near()).select(F.col("a.form").alias("form"), F.col("b.form").alias("other"), F.col("a.kind").alias("kind")).distinct(), forms), "history-centers")
        out.append(found)
        met = found.select("form", F.col("other").alias("center")).distinct()
        rest = tried.select("key", F.col("a.form").alias("form"), F.col("b.form").alias("center")).join(met, ["form", "center"], "left_anti").select("key", "form")
        left = stored(left.join(rest, ["key", "form"], "left_semi"), "history-left")
        before, size = size, left.count()
        if size > 0.75 * before:
            break
    return reduce(DataFrame.union, out) if out else rows.sparkSession.createDataFrame([], HistoryIndex.SCHEMAS["links"])


def crowd_pairs(rows: DataFrame) -> DataFrame:
    """(form, other, kind): as :func:`pairs_of`, for crowded keys; without the pairs of one ``work``, which are linked already.

    Of two forms that are one title the shorter has all but ``spare`` of its grams in the longer. So one of its
    ``spare`` + 1 grams that are rarest under the key is there, and an equality join on these finds each such pair.
    """
    row = ("key", "form", "new", "work", "chars", "spare", "marks")
    known = rows.select(*row, F.explode(F.concat("grams", F.array(F.col("chars").cast("bigint"), F.lit(0).cast("bigint")))).alias("token"))
    common = rows.select("key", F.explode("grams").alias("token")).groupBy("key", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key", "form").orderBy("n", "token"))
    rare = rows.where(F.size("lone") == 0).select(*row, F.explode("grams").alias("token")).join(common, ["key", "token"])
    rare = rare.withColumn("rank", rank).where((F.col("rank") <= F.col("spare") + 1) & (F.col("n") > 1)).select(*row, "token")
    sought = rare.unionByName(rows.select(*row, F.explode("lone").alias("token"))).alias("a")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.work") != F.col("b.work")) & (F.col("a.new") | F.col("b.new")) & (F.col("a.chars") <= F.col("b.chars"))
    met = sought.join(known.alias("b"), on & _near()).select("a.key", F.col("a.form").alias("form"), F.col("b.form").alias("other")).distinct()
    a, b = rows.drop("grams", "lone").alias("a"), rows.drop("grams", "lone").alias("b")
    both = met.alias("m").join(a, (F.col("m.key") == F.col("a.key")) & (F.col("m.form") == F.col("a.form"))).join(b, (F.col("m.key") == F.col("b.key")) & (F.col("m.other") == F.col("b.form")))
    return both.where(_may_match()).select(F.greatest("m.form", "m.other").alias("form"), F.least("m.form", "m.other").alias("other"), F.col("a.kind").alias("kind")).distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of all edges of a task, by union-find."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]  # a shorter way for the next
            x = y
        return x

    for edges in batches:
        for a, b in zip(edges["form"], edges["other"]):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    yield pd.DataFrame({"form": list(up), "comp": [top(x) for x in up]}, dtype=str)


def components(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """(form, comp): each linked node's smallest reachable node. Up to ``most`` edges by union-find in one task, else by
    hooking to the smallest neighbour and pointer jumping."""
    one = stored(edges.select(F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other")).where("form <> other").distinct(), "history-edges")
    if one.count() <= most:
        label = stored(one.coalesce(1).mapInPandas(_joined, "form string, comp string"), "history-label")
        discard(one)
        return label
    both = stored(one.union(one.select("other", "form")), "history-edges")
    discard(one)
    label = stored(both.groupBy("form").agg(F.least(F.min("other"), F.col("form")).alias("comp")), "history-label")
    while True:
        near = both.join(label.withColumnRenamed("form", "other"), "other").groupBy("form").agg(F.min("comp").alias("m"))
        step = label.join(near, "form").select("form", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        up = label.select(F.col("form").alias("comp"), F.col("comp").alias("up"))
        fresh = stored(step.join(up, "comp", "left").select("form", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"), "history-label")
        changed = fresh.where("comp <> old").limit(1).count()
        discard(label)
        label = fresh.select("form", "comp")
        if not changed:
            discard(both)
            return label


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast what was counted and found to be small; the rest is joined by shuffling."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class HistoryIndex:
    """Everything accepted so far, in a folder that all executors share: rows, keys (by bucket) and links, each by batch.

    What a batch writes lies in folders named after its number, so a retry with the same number replaces its own output
    and nothing else. ``keys`` hold a form's fingerprint but not its text.
    """

    SCHEMAS = {
        "rows": "id string, relation string, part string, words string, formula string, short boolean, blocks array<bigint>, doi string, file string, base string, form string",
        "keys": "key bigint, kind string, form string, blocks array<bigint>, part string, short boolean, n_words int, n_chars int, bucket int",
        "links": "form string, other string, tail string",
    }

    def __init__(self, spark: SparkSession, folder: str, crowd: int = CROWD):
        self.spark, self.folder, self.crowd = spark, folder.rstrip("/"), crowd

    def _table(self, what: str, batch: int | None = None, but: int | None = None) -> DataFrame:
        """One table of all batches, of one, or of all ``but`` one."""
        schema, path = f"{self.SCHEMAS[what]}, batch int", f"{self.folder}/{what}"
        df = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        df = df if batch is None else df.where(F.col("batch") == batch)
        return (df if but is None else df.where(F.col("batch") != but)).drop("batch")

    def _write(self, df: DataFrame, what: str, number: int, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.folder}/{what}/batch={number}")

    def accept(self, batch: DataFrame, number: int, row_id: str = "paper_id") -> None:
        """Take in a batch of rows (``row_id``, title, doi, filename): link its titles to those accepted and to each other."""
        self._write(prepare(batch, row_id), "rows", number)
        rows = self._table("rows", number)
        n, buckets = all_keys(rows).agg(F.count("*"), F.collect_set("bucket")).first()  # buckets: at most BUCKETS
        tasks = -(-n // TASK_KEYS) or 1
        keyed = keys_of(rows).withColumn("new", F.lit(True))
        if exists(self.spark, f"{self.folder}/keys"):
            past = self._table("keys", but=number)
            past = past.where(F.col("bucket").isin(*buckets)) if len(buckets) < BUCKETS else past
            met = past.join(_small(all_keys(rows).select("key").distinct(), n), "key", "left_semi")
            keyed = met.withColumn("new", F.lit(False)).unionByName(keyed)
        known = F.bool_or(~F.col("new")).over(Window.partitionBy("key", "form"))
        keyed = keyed.repartition(tasks, "key").withColumn("known", known).withColumn("n", F.count("*").over(Window.partitionBy("key")))
        keyed = stored(keyed, "history-keyed")
        # what is known under its key isn't appended again; this and the links write different folders, so they go side by side
        fresh = keyed.where("new and not known").drop("new", "known", "n").repartition(min(tasks, BUCKETS), "bucket")
        with ThreadPoolExecutor(1) as beside:
            kept = beside.submit(self._write, fresh, "keys", number, "bucket")
            forms = self._table("rows").select(*_FORM).where("form is not null")
            pairs = stored(pairs_of(keyed.where(F.col("n").between(2, self.crowd))), "history-pairs")
            named = pairs.select("form").union(pairs.select("other")).distinct()
            links = links_of(pairs, forms.join(_small(named, 2 * pairs.count()), "form", "left_semi").dropDuplicates(["form"]))
            if (keyed.agg(F.max("n")).first()[0] or 0) > self.crowd:
                links = links.union(self._crowded(keyed.where(F.col("n") > self.crowd).drop("known", "n"), forms))
            self._write(links, "links", number)
            kept.result()
        for done in (keyed, pairs):
            discard(done)
        tidy(self.spark)

    def _crowded(self, keyed: DataFrame, forms: DataFrame) -> DataFrame:
        """Links under keys that many forms share. What centers link needs no other links, so pairs are sought between
        their works only; a title found by its beginning is held to all whole titles, as each of them counts."""
        own = forms.join(keyed.select("form").distinct(), "form", "left_semi").dropDuplicates(["form"])
        own = stored(own.withColumn("g", _grams("words")), "history-crowd")
        one = keyed.groupBy("key", "form").agg(F.min("new").alias("new"), *(F.first(c).alias(c) for c in ("kind", "blocks", "part", "short", "n_words", "n_chars")))
        rows = stored(one.join(own.select("form", "g.*"), "form"), "history-crowded")
        near = center_links(rows.drop("grams", "lone").where(F.col("kind") != BEGINNING), own)
        work = F.when(F.col("kind") == BEGINNING, F.col("form")).otherwise(F.coalesce("comp", "form"))
        rows = rows.join(components(near), "form", "left").withColumn("work", work).drop("comp")
        return near.union(links_of(crowd_pairs(stored(rows, "history-crowded")), own))

    def links(self) -> DataFrame:
        """(form, other): the links that hold. A cut-off title's link holds if all whole titles that it could be end alike."""
        links = self._table("links")
        cut_off = links.where("tail is not null").groupBy("form").agg(F.min(F.struct("tail", "other")).alias("o"), F.count_distinct("tail").alias("n")).where("n = 1")
        return links.where("tail is null").select("form", "other").unionByName(cut_off.select("form", "o.other"))

    def works(self) -> DataFrame:
        """(id, comp): the work of each row accepted.

        Titles that are forms of one are one work; corrections, replies and other numbered parts are works of their own. A
        row without a title belongs to the work that most rows with its DOI have; without a DOI too, to the work its file
        held last before it, or else first after it. A row with nothing stands alone. Repeated rows count once; an empty
        table gives no rows.
        """
        comp = components(self.links())
        rows = self._table("rows").select("id", "form", "doi", "file").distinct()
        named = rows.where("form is not null").join(comp, "form", "left").select("id", "doi", "file", F.coalesce("comp", "form").alias("comp"))
        lone = stored(rows.where("form is null").select("id", "doi", "file"), "history-bare")
        # only DOIs and files that hold a row without a title are looked at
        at_doi = named.join(lone.where("doi is not null").select("doi").distinct(), "doi", "left_semi")
        owner = at_doi.groupBy("doi", "comp").agg(F.count("*").alias("n"), F.min("id").alias("i")).groupBy("doi").agg(F.max_by("comp", F.struct(F.col("n"), F.col("i"))).alias("owner"))
        alone = lone.where("doi is not null").groupBy("doi").agg(F.min("id").alias("first"))
        bare = lone.join(owner, "doi", "left").join(alone, "doi", "left").select("id", "file", F.coalesce("owner", "first").alias("comp"))
        settled = bare.where("comp is not null")
        open_ = bare.where("comp is null and file is not null")
        here = named.select("id", "file", "comp").unionByName(settled)
        around = here.join(open_.select("file").distinct(), "file", "left_semi").select("id", "file", "comp").unionByName(open_.select("id", "file", "comp"))
        back = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy("file").orderBy("id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        found = around.withColumn("c", F.coalesce(F.last("comp", True).over(back), F.first("comp", True).over(ahead), F.min("id").over(Window.partitionBy("file")))).where("comp is null").select("id", F.col("c").alias("comp"))
        rest = bare.where("comp is null and file is null").select("id", F.col("id").alias("comp"))
        return here.select("id", "comp").unionByName(found).unionByName(rest)

    def repeats(self, number: int | None = None) -> DataFrame:
        """(paper_id_a, paper_id_b): each row (of one batch, or of all) whose work occurs in a row of smaller id, with the
        work's smallest id as known now."""
        w = stored(self.works(), "history-works")
        mine = w if number is None else w.join(self._table("rows", number).select("id").distinct(), "id", "left_semi")
        first = w.groupBy("comp").agg(F.min("id").alias("paper_id_a"))
        return mine.join(first, "comp").where("id > paper_id_a").select("paper_id_a", F.col("id").alias("paper_id_b"))


def deliveries(rows: DataFrame, batch: str, least: int = LEAST_ROWS) -> list[list]:
    """The batch numbers in order (nulls last), small ones taken together until they hold ``least`` rows."""
    sizes = [(r[0], r[1]) for r in rows.groupBy(batch).count().collect()]  # one row a delivery
    out: list[list] = []
    room = 0
    for number, n in sorted(sizes, key=lambda x: (x[0] is None, x[0])):
        if room <= 0:
            out.append([])
            room = least
        out[-1].append(number)
        room -= n
    return out


def repeats(rows: DataFrame, row_id: str = "paper_id", batch: str | None = None, least: int = LEAST_ROWS, crowd: int = CROWD) -> DataFrame:
    """(paper_id_a, paper_id_b): the rows taken in batch by batch (see :func:`deliveries`; without ``batch`` all at once),
    and then each row whose work occurs in a row of smaller id, with the work's smallest id. How rows are parted into
    batches doesn't change the result."""
    spark = rows.sparkSession
    folder = f"{work_dir(spark)}/history-{uuid.uuid4().hex}"
    index = HistoryIndex(spark, folder, crowd)
    if batch is None:
        index.accept(rows, 0, row_id)
        return index.repeats()
    # each delivery as a folder of its own, as deliveries come
    of = {n: k for k, numbers in enumerate(deliveries(rows, batch, least)) for n in numbers}
    place = F.create_map(*(F.lit(x) for n, k in of.items() if n is not None for x in (str(n), k))) if set(of) - {None} else F.lit(None)
    k = F.when(F.col(batch).isNull(), F.lit(of.get(None))).otherwise(F.element_at(place, F.col(batch).cast("string"))) if of else F.lit(0)
    rows.select(row_id, "title", "doi", "filename", k.cast("int").alias("delivery")).write.partitionBy("delivery").parquet(f"{folder}/in")
    schema = rows.select(row_id, "title", "doi", "filename").schema
    for n in range(max(of.values(), default=-1) + 1):
        index.accept(spark.read.schema(schema).parquet(f"{folder}/in/delivery={n}"), n, row_id)
    return index.repeats()
