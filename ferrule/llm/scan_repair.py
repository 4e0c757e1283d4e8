"""Repair of text from scanned pages: page furniture, words broken over lines, misread characters.

A first pass over all texts counts words and word pairs of the bodies (furniture off, broken words joined). Words that
make up at least one in ``RARE`` of all words, and aren't themselves a common misreading of a far more frequent word, are
the vocabulary; by that share there are never more than ``RARE`` of them, so the vocabulary has a proven bound. It is
broadcast once, and each worker process makes one trie of it. A second pass repairs: for each word that isn't in the
vocabulary, the Levenshtein automaton of the word (bit-parallel, at most two edits) is run along the trie, which yields
every candidate; candidates are ranked by how well known confusions of characters explain them, then by the words next to
them. What no confusion explains is repaired only if one letter is replaced and a letter doesn't belong in a word or the
words next to it are known to stand by the candidate: rare words, such as a plural seen seldom, stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.pages import furniture
from ferrule.session import written

#: A word belongs to the vocabulary if it makes up at least one in so many of all words.
RARE = 1_000_000
#: Fewest occurrences of a vocabulary word, whatever the size of the corpus.
LEAST = 3
#: A frequent word counts as misread if a word it can be a misreading of is so many times as frequent.
RATIO = 20
#: What is read, and what stands there.
CONFUSIONS = (
    ("rn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("im", "nn"), ("m", "rn"), ("nn", "m"), ("in", "m"), ("m", "in"), ("ri", "n"), ("h", "b"), ("b", "h"),
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("5", "s"), ("5", "S"), ("6", "b"), ("8", "B"), ("9", "g"), ("2", "z"), ("l", "i"), ("i", "l"), ("I", "l"), ("l", "I"), ("|", "l"), ("|", "i"), ("|", "I"),
    ("!", "l"), ("e", "c"), ("c", "e"), ("c", "o"), ("o", "c"), ("í", "i"), ("ì", "i"), ("ï", "i"), ("α", "a"), ("¢", "c"), ("†", "t"), ("€", "e"), ("$", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "B"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("q", "g"), ("g", "q"), ("v", "y"), ("y", "v"), ("ł", "l"), ("ο", "o"), ("е", "e"),
)
BREAKS = "-­‐‑¬"
_OUTER = ".,;:()[]{}\"“”'’‘?"
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]{2,}(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*")
_FORMULA = re.compile(r"(?:\d*\(?(?:[A-Z][a-z]?|[αβγδ]-)[\d.]*(?:[+-]?[δx]\b)?\)?[\d.]*[·*]?)+")
_NEVER = re.compile(r"[=/^−⁻×*<>~≈±(){}\[\]·]|^[-+\d.,]+$")


def lines_of(text: str) -> tuple[list[str], list[tuple[str, str]], set[int]]:
    """(lines of the body, [(kind, line)] of page furniture, which lines begin a paragraph). A text of one line is all body.

    Blank lines part paragraphs where the line before them ends a sentence; those around page furniture belong to the page.
    """
    if "\n" not in text and "\r" not in text:
        return [text], [], set()
    body, off, begins = [], [], set()
    blank = page = False
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw.strip()
        if not line:
            blank = True
            continue
        kind = furniture(line)
        if kind:
            off.append((kind, " ".join(line.split())))
            page = True
            continue
        if blank and not page and body and body[-1].rstrip("\"”')]")[-1:] in tuple(".!?:"):
            begins.add(len(body))
        body.append(line)
        blank = page = False
    return body, off, begins


def tokens_of(text: str, begins: set[int] | None = None) -> tuple[list[tuple[str, str | None]], list[tuple[str, str]]]:
    """([(token, first part)], furniture): the tokens of the body in order; a word broken over lines is one token, written
    with a hyphen at the break, and comes with the part before it. ``begins`` gets the tokens that begin a paragraph."""
    body, off, starts = lines_of(text)
    if len(body) == 1:
        return [(w, None) for w in body[0].split()], off
    out: list[tuple[str, str | None]] = []
    pending = ""
    for n, line in enumerate(body):
        words = line.split()
        if begins is not None and n in starts and not pending:
            begins.add(len(out))
        if pending and words:
            words[0], part = f"{pending}\u0000{words[0]}", pending
            out.append((words[0], part))
            words = words[1:]
            pending = ""
            if not words and out[-1][0][-1] in BREAKS:
                pending = out.pop()[0].rstrip(BREAKS).replace("\u0000", "")
        if words and len(words[-1]) > 1 and words[-1][-1] in BREAKS and words[-1][-2].isalpha():
            pending = words.pop()[:-1]
        out.extend((w, None) for w in words)
    if pending:
        out.append((pending, None))
    return out, off


class Trie:
    """Vocabulary trie that Levenshtein automata are run along."""

    def __init__(self, words: dict[str, int]):
        self.counts = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every vocabulary word within ``most`` edits: (edits, word).

        The automaton's state is one bit set per number of edits; a branch ends as soon as all sets are empty.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (1 << i)
        full, end = (1 << (n + 1)) - 1, 1 << n
        start, s = [], 1
        for _ in range(most + 1):
            start.append(s)
            s |= (s << 1) & full
        found: list[tuple[int, str]] = []
        stack = [(self.root, tuple(start), 0)]
        while stack:
            node, state, depth = stack.pop()
            for c, child in node.items():
                if not c:
                    for k, bits in enumerate(state):
                        if bits & end:
                            found.append((k, child))
                            break
                    continue
                m = masks.get(c, 0)
                prev = state[0]
                now = [((prev & m) << 1) & full]
                for k in range(1, most + 1):
                    cur = state[k]
                    # match, insertion into the vocabulary word, substitution, deletion from the word read
                    x = (((cur & m) << 1) | state[k - 1] | (state[k - 1] << 1) | (now[k - 1] << 1)) & full
                    now.append(x)
                if any(now):
                    stack.append((child, tuple(now), depth + 1))
        return found


def explained(read: str, true: str) -> int:
    """How many known confusions turn ``true`` into ``read`` (1 or 2), 0 if they don't."""
    for r, t in CONFUSIONS:
        at = read.find(r)
        while at >= 0:
            if read[:at] + t + read[at + len(r) :] == true:
                return 1
            at = read.find(r, at + 1)
    if len(read) < 6:
        return 0
    for r, t in CONFUSIONS:
        at = read.find(r)
        while at >= 0:
            half = read[:at] + t + read[at + len(r) :]
            if half[: at + len(t)] == true[: at + len(t)]:
                for r2, t2 in CONFUSIONS:
                    b = half.find(r2, at + len(t))
                    while b >= 0:
                        if half[:b] + t2 + half[b + len(r2) :] == true:
                            return 2
                        b = half.find(r2, b + 1)
            at = read.find(r, at + 1)
    return 0


class Repairer:
    """Vocabulary, context and answers already found (bounded)."""

    KEEP = 200_000

    def __init__(self, words: dict[str, int], pairs: set[tuple[str, str]]):
        self.words, self.pairs, self.trie = words, pairs, Trie(words)
        self.seen: dict[str, list[str]] = {}

    def candidates(self, word: str) -> list[tuple[str, bool]]:
        """The best vocabulary words for a word that isn't one, most frequent first, and whether a known confusion or a
        letter that doesn't belong in a word explains them; none if there is nothing of the kind."""
        if word in self.seen:
            return self.seen[word]
        odd = any(not (c.isascii() and c.isalpha()) and c != "-" for c in word)
        ranked: list[tuple[float, int, str, bool]] = []
        for k, w in self.trie.near(word, 2 if len(word) > 3 else 1 if len(word) > 2 or odd else 0) if len(word) > 1 else []:
            n = explained(word, w)
            if n:
                ranked.append((0.4 * n, -self.words[w], w, True))
            elif k == 1 and len(word) >= 6 and len(w) == len(word) and (odd or word[0] == w[0]):
                ranked.append((1.0, -self.words[w], w, odd))
        if len(self.seen) >= self.KEEP:
            self.seen = {}
        ranked.sort()
        self.seen[word] = out = [(w, sure) for c, _, w, sure in ranked if c == ranked[0][0]]
        return out

    def fix(self, word: str, before: str | None, after: str | None, opens: bool = False) -> str | None:
        """What a misread word should read, None if it can't be told or is right. ``opens``: it begins a sentence."""
        if word in self.words or len(word) < 2 or _NEVER.search(word) or not any(c.isalpha() for c in word):
            return None
        if any(c.isdigit() for c in word) and (_FORMULA.fullmatch(word) or sum(c.isalpha() for c in word) < 2):
            return None
        by = lambda w: ((before, w) in self.pairs) + ((w, after) in self.pairs)
        found = [w for w, sure in self.candidates(word) if sure or by(w)]
        if len(found) > 1:
            found = sorted(found, key=lambda w: (w[0].isupper() != opens, -by(w), -self.words[w], w))
        return found[0] if found else None

    def joined(self, token: str) -> str:
        """A word broken at NUL as it should read: without the hyphen, or with it where it is a compound's own."""
        a, b = token.split("\u0000", 1)
        whole, compound = a + b, f"{a}-{b}"
        if whole in self.words:
            return whole
        if compound in self.words:
            return compound
        w, c = self.fix(whole, None, None), self.fix(compound, None, None)
        if w or c:
            return min((x for x in (w, c) if x), key=lambda x: (0 if explained(whole, x) or explained(compound, x) else 1, -self.words[x]))
        if a.rpartition("-")[2] in self.words and b.partition("-")[0] in self.words and len(b) > 2:
            return compound
        return whole

    def repairs(self, text: str) -> list[tuple[str, str]]:
        """[(kind, fixed)] of one text."""
        if "\n" not in text and "\r" not in text:
            words = text.split()
            known = self.words
            if all(w in known or w.strip(_OUTER) in known for w in words):
                return []
        tokens, out = tokens_of(text)
        clean = [t.strip(_OUTER) for t, _ in tokens]
        for i, w in enumerate(clean):
            broken = "\u0000" in w
            if w in self.words or not w:
                continue
            if broken:
                a, b = w.split("\u0000", 1)
                if not (a[-1:].isalpha() and b[:1] and not b[:1].isdigit()):
                    continue
                fixed = self.joined(w)
                out.append(("hyphen", fixed))
                if fixed not in (a + b, f"{a}-{b}"):
                    out.append(("char", fixed))
                continue
            before = clean[i - 1] if i else None
            after = clean[i + 1] if i + 1 < len(clean) else None
            if fixed := self.fix(w, before, after, not i or tokens[i - 1][0][-1:] in ".:?!"):
                out.append(("char", fixed))
        return out

    def text(self, text: str) -> str:
        """The continuous text that the page carried: a blank between words, an empty line between paragraphs."""
        begins: set[int] = set()
        tokens, _ = tokens_of(text, begins)
        clean = [t.strip(_OUTER) for t, _ in tokens]
        out: list[str] = []
        for i, (t, _) in enumerate(tokens):
            w = clean[i]
            if "\u0000" in t:
                right = self.joined(w) if w and "\u0000" in w else w
            else:
                right = (self.fix(w, clean[i - 1] if i else None, clean[i + 1] if i + 1 < len(clean) else None, not i or tokens[i - 1][0][-1:] in ".:?!") if w else None) or w
            out.append(("\n\n" if i in begins and i else " " if i else "") + (t.replace(w, right, 1) if w else t))
        return "".join(out)


_MADE: dict[str, Repairer] = {}


def repairer(name: str, words: dict[str, int], pairs: set[tuple[str, str]]) -> Repairer:
    """One repairer, with its trie, for each worker process; ``name`` tells vocabularies apart."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Repairer(words, pairs)
    return _MADE[name]


def count_words(texts: DataFrame) -> DataFrame:
    """(a, b, n): how often each word (b null) and each pair of adjacent words occurs in the bodies of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(w, None, n) for w, n in words.items()] + [(a, b, n) for (a, b), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for batch in batches:
            for text in batch["text"]:
                run = [t.strip(_OUTER) for t, _ in tokens_of(text)[0]]
                words.update(w for w in run if "\u0000" not in w)  # how a broken word reads is what the counts decide
                pairs.update(zip(run, run[1:]))
            if len(words) + len(pairs) > 400_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, rare: int = RARE, least: int = LEAST) -> tuple[dict[str, int], set[tuple[str, str]]]:
    """(words with counts, frequent pairs); at most ``rare`` of each."""
    counts = written(counts, "scan-counts")  # read three times
    total = counts.where("b is null").agg(F.sum("n")).first()[0] or 0
    floor = max(least, total / rare)
    frequent = counts.where(F.col("n") >= floor)
    rows = frequent.where(F.col("b").isNull() & F.col("a").rlike("^" + _PLAIN.pattern + "$")).select("a", "n").collect()  # at most `rare` by the floor
    order = sorted(((r["a"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    whole = dict(order)
    good: dict[str, int] = {}
    for w, n in order:
        if not any(whole.get(true, 0) >= RATIO * n for true in misread_of(w)):
            good[w] = n
    pairs = {(r["a"], r["b"]) for r in frequent.where("b is not null").select("a", "b").collect() if r["a"] in good and r["b"] in good}
    return good, pairs


def misread_of(word: str) -> Iterator[str]:
    """The words that one known confusion, or one other letter in its place, makes of a word."""
    for r, t in CONFUSIONS:
        at = word.find(r)
        while at >= 0:
            yield word[:at] + t + word[at + len(r) :]
            at = word.find(r, at + 1)


SOURCES = (("mentions", "mention_id", "sentence"), ("equations", "equation_id", "equation_text"), ("table_records", "table_id", "raw_text"))


def scanned_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """(src, rec_id, text) of the columns that may come from scans; rows without text or id are left out."""
    parts = [tables[t].select(F.lit(t).alias("src"), F.col(i).cast("long").alias("rec_id"), F.col(c).alias("text")) for t, i, c in SOURCES if t in tables]
    return reduce(DataFrame.unionByName, parts).where("text is not null and rec_id is not null and text <> ''")


_FOUND = T.StructType([T.StructField("src", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("fixed", T.StringType())])


def find_repairs(texts: DataFrame, rare: int = RARE, least: int = LEAST) -> DataFrame:
    """(src, rec_id, kind, fixed), distinct: each repair of each text.

    kind is 'hyphen', 'char', 'header' or 'pageno'. Texts of any length are treated whole. Repeated rows count once.
    """
    known, name = texts.sparkSession.sparkContext.broadcast(vocabulary(count_words(texts), rare, least)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = repairer(name, *known.value)
        for b in batches:
            rows = [(s, i, k, f) for s, i, t in zip(b["src"], b["rec_id"], b["text"]) for k, f in set(r.repairs(t))]
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return texts.mapInPandas(run, _FOUND).distinct()


def repaired(texts: DataFrame, rare: int = RARE, least: int = LEAST) -> DataFrame:
    """(src, rec_id, text): each text as the page carried it, without furniture, broken words joined, misread words put right."""
    known, name = texts.sparkSession.sparkContext.broadcast(vocabulary(count_words(texts), rare, least)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = repairer(name, *known.value)
        for b in batches:
            yield b.assign(text=[r.text(t) for t in b["text"]])

    return texts.mapInPandas(run, texts.schema)
