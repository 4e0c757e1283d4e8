"""Subject mixtures of documents by a seeded non-negative factorization of the text-term matrix.

Rows of the matrix are the sentences of labelled documents, columns their words and word pairs. Each subject is one
*anchored component*: its terms start from the subject's summary, and a sentence's weights start from the labels of its
document, so that alternating multiplicative updates (for the Kullback-Leibler divergence) sharpen the components without
their changing places; further components take up what belongs to no subject. As components are anchored they give
subject mixtures directly. The factorization is fitted on a bounded sample of labelled documents; every document is then
folded in whole: the term side ``h`` stays fixed and gives each sentence its likelihood under each component, and the
document's row of ``w`` is updated against it by the same multiplicative rule. Mixtures are read off ``w``; a sentence
belongs to the component that has the largest part in it, and a document has the subjects that enough sentences belong to.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import get_close_matches

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many labelled documents, chosen by a hash of their id, are used to fit the components.
FIT_DOCUMENTS = 4_000
#: And at most so many characters of their texts, in the order of the hash.
FIT_CHARS = 100_000_000
#: Sentences kept per worker.
KEEP = 300_000
#: Components that belong to no subject.
FREE = 2
#: A document has a subject that takes up at least this share of its sentences.
SHARE = 0.2
ROUNDS = 10
#: Sentences' worth of common shares mixed into each term.
SMOOTH = 1.0
#: The same for each sentence outside subjects that has the term.
LOOSE = 0.1
#: Evidence below which a sentence is about no subject, and the scale of evidence.
NOTHING, SCALE = 1.0, 0.5
#: How firmly a sentence's weights are held to its documents' labels in each round.
HOLD = 0.7
_FORMULA = re.compile(r"\b(?=[^\s\d]{0,12}\d)(?:[A-Z][A-Za-z]?\d*(?:\.\d+)?|\([A-Z][A-Za-z0-9]*\)\d*){2,}(?![a-z])")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
#: Entries of reference lists.
_ENTRY = re.compile(r"\(\d{4}\)\s\d+[\d–-]*\.?$|^\[\d+\]")
#: What a sentence names only to set it apart from its subject.
_ASIDE = re.compile(r"\b(?:unlike|in contrast to|contrary to|rather than|instead of|anders als|im gegensatz zu|contrairement à)\b[^,;.]*[,;]?|^[^,;]*\b(?:(?:is|are) left aside|bleib(?:t|en) (?:hier )?außer betracht|(?:est|sont) laissée?s? de côté)\b[^,;]*[,;]?", re.IGNORECASE)
#: Sentences' worth that one document counts for at most in the fit.
MOST = 30
_DIGIT, _COUNTED = re.compile(r"\d"), re.compile(r"[A-Za-z)]\d")
#: A sentence without one of these sets nothing aside.
_APART = ("unlike", "aside", "contra", "rather than", "instead of", "anders", "gegensatz", "betracht", "côté")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[\u0001\u0002]")


def sentences(text: str) -> list[str]:
    """The sentences of a text, inner white space as one space each; headings, equations, numbers of figures and entries
    of reference lists don't count."""
    out = []
    for line in text.splitlines():
        flat = " ".join(line.split())
        if not flat:
            continue
        for s in flat.replace(". ", ".\0").replace("! ", "!\0").replace("? ", "?\0").split("\0"):
            if s and s.count(" ") >= (2 if s[-1] in ".!?" else 4) and " = " not in s and not (("[" == s[0] or "(" in s) and _ENTRY.search(s)):
                out.append(s)
    return out


def masked(sentence: str) -> str:
    """A sentence with its formulas and numbers masked."""
    if not _DIGIT.search(sentence):
        return sentence
    return _NUMBER.sub("\u0001", _FORMULA.sub("\u0002", sentence) if _COUNTED.search(sentence) else sentence)


def terms(sentence: str) -> list[str]:
    """Words and pairs of adjacent words of a masked sentence, without what it only sets aside."""
    low = sentence.lower()
    words = _WORD.findall(_ASIDE.sub(" ", low) if any(map(low.__contains__, _APART)) else low)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def subject_key(label: str | None) -> str:
    """One spelling of a subject's name."""
    return re.sub(r"[\s_-]+", "_", (label or "").strip().lower())


class Components:
    """Fitted components: log weights of terms by component, the last ``FREE`` belonging to no subject."""

    def __init__(self, subjects: list[str]):
        self.subjects, self.k = subjects, len(subjects) + FREE
        self.index: dict[str, int] = {}
        self.cache: dict[str, np.ndarray] = {}

    def fit(self, documents: list[tuple[str, list[int]]], summaries: list[str], rounds: int = ROUNDS) -> Components:
        """documents: (text, labelled subjects); summaries: one seed text for each subject."""
        rows: dict[tuple[str, ...], int] = {}
        times: list[float] = []
        priors: list[np.ndarray] = []
        for text, labels in documents:  # equal sentences are one row, with the mean of their documents' labels
            mark = np.full(self.k, 0.01, dtype=np.float32)
            mark[labels] = 1.0
            mark[-FREE:] = 0.3
            cut = sentences(text)
            worth = min(1.0, MOST / max(1, len(cut)))
            for s in cut:
                r = rows.setdefault(tuple(terms(masked(s))), len(rows))
                if r == len(times):
                    times.append(0.0)
                    priors.append(np.zeros(self.k, dtype=np.float32))
                times[r] += worth
                priors[r] += mark * worth
        n = np.array(times, dtype=np.float32)
        prior = np.stack(priors) / n[:, None] if priors else np.zeros((0, self.k), dtype=np.float32)
        count: Counter = Counter()
        for ts, c in zip(rows, times):
            for t in ts:
                count[t] += c
        seeds = [Counter(terms(masked(s))) for s in summaries]
        common = Counter(t for c in seeds for t in c)
        kept = [t for t, c in count.most_common() if c > 1.2 or t in common]
        self.index = {t: i for i, t in enumerate(dict.fromkeys([*kept, *common]))}
        m = len(self.index)
        i = np.array([r for r, ts in enumerate(rows) for t in ts if t in self.index], dtype=np.int64)
        j = np.array([self.index[t] for ts in rows for t in ts if t in self.index], dtype=np.int64)
        v = n[i]
        w = prior.copy()
        own = range(len(self.subjects))
        base = np.bincount(j, weights=v, minlength=m) + 0.1
        h = np.full((self.k, m), 0.01, dtype=np.float32)
        for k, c in enumerate(seeds):
            for t, times_ in c.items():
                if common[t] == 1:  # what all summaries say seeds nothing
                    h[k, self.index[t]] += 20.0 * times_
        for k in own:  # terms of labelled documents against those of all
            h[k] += np.bincount(j, weights=v * (prior[i, k] - 0.01), minlength=m) ** 2 / base
        rng = np.random.default_rng(11)
        h[-FREE:] += base / len(self.subjects) * rng.uniform(0.5, 1.5, (FREE, m))
        h /= h.sum(1, keepdims=True)
        for _ in range(rounds):
            for side in "wh":
                whole = np.zeros(len(i), dtype=np.float32)
                for k in range(self.k):
                    whole += w[i, k] * h[k, j]
                ratio = 1.0 / np.maximum(whole, 1e-12)
                if side == "w":
                    w = w * np.stack([np.bincount(i, weights=h[k, j] * ratio, minlength=len(rows)) for k in range(self.k)], axis=1).astype(np.float32) * prior**HOLD
                    w /= np.maximum(w.sum(1, keepdims=True), 1e-12)
                else:
                    h = h * np.stack([np.bincount(j, weights=v * w[i, k] * ratio, minlength=m) for k in range(self.k)]).astype(np.float32) + 1e-9
                    h /= h.sum(1, keepdims=True)
        # a last update of h, without norming: how much of each term is each component's
        seen = np.stack([np.bincount(j, weights=v * w[i, k], minlength=m) for k in range(self.k)])
        for k, c in enumerate(seeds):
            for t in c:
                if common[t] == 1:
                    seen[k, self.index[t]] += 3.0
        # smoothed: terms seen seldom, or mostly in no subject, are drawn to the subjects' usual shares
        mine, free = seen[: len(self.subjects)], seen[len(self.subjects) :].sum(0)
        usual = mine.sum(1) / max(1e-9, mine.sum()) + 1e-3
        usual = (usual / usual.sum())[:, None]
        self.h = mine + (SMOOTH + LOOSE * free) * usual
        # the likelihood of a term under a component against its mean over components; terms that tell components apart
        # (by the divergence of their shares from the usual ones) have the larger say
        ratio = np.log(self.h / usual / self.h.sum(0))
        say = (self.h / self.h.sum(0) * ratio).sum(0)
        self.logs = np.concatenate([say * ratio, np.zeros((FREE, m))]).T.astype(np.float32)
        return self

    def evidence(self, sentence: str) -> np.ndarray:
        """The logarithm of a sentence's likelihood under each component of h; the free ones have what little says nothing."""
        sentence = masked(sentence)
        found = self.cache.get(sentence)
        if found is None:
            known = [i for i in map(self.index.get, terms(sentence)) if i is not None]
            found = np.add.reduce(self.logs[known], 0) * SCALE if known else np.zeros(self.k, dtype=np.float32)
            found[-FREE:] = NOTHING * SCALE
            if len(self.cache) >= KEEP:
                self.cache = {}
            self.cache[sentence] = found
        return found

    def fold_in(self, texts: list[str | None], rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w, share of each component's sentences, number of sentences) of each text."""
        cut = [sentences(t) if t else [] for t in texts]
        n = np.array([len(c) for c in cut])
        w, shares = np.zeros((len(texts), self.k)), np.zeros((len(texts), self.k))
        if not n.sum():
            return w, shares, n
        e = np.stack([self.evidence(s) for c in cut for s in c])
        like = np.exp(e - e.max(1, keepdims=True))
        owner = np.repeat(np.arange(len(texts)), n)
        starts = np.concatenate(([0], np.cumsum(n[n > 0])))[:-1]
        some = n > 0
        w[some] = 1.0 / self.k
        for _ in range(rounds):
            # w times (likelihood over what w and likelihood make of the sentence), the update that norms itself
            part = like * (w[owner] + 0.004)
            part /= part.sum(1, keepdims=True)
            w[some] = np.add.reduceat(part, starts, axis=0) / n[some][:, None]
        best = np.zeros_like(part)
        best[np.arange(len(part)), part.argmax(1)] = 1.0
        shares[some] = np.add.reduceat(best, starts, axis=0) / n[some][:, None]
        return w, shares, n


def fit_components(documents: DataFrame, labels: DataFrame, subjects: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_chars: int = FIT_CHARS) -> Components:
    """Components fitted on at most ``fit_documents`` labelled documents of ``fit_chars`` characters in all, those of smallest
    hash of their id; a text is taken whole or not at all.

    Labels are matched to subjects without regard to case, separators and small slips of spelling; others are left out.
    """
    names = sorted({(r["subject"], r["summary"] or "") for r in subjects.select("subject", "summary").collect() if r["subject"]})  # a table of fixed size
    keys = [subject_key(n) for n, _ in names]
    marked = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    # the bound is taken on the labels, so that only the chosen documents' texts leave their partitions
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    some = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    known: dict[str, int | None] = {}

    def place(label: str) -> int | None:
        if label not in known:
            near = get_close_matches(subject_key(label), keys, 1, 0.85)
            known[label] = keys.index(near[0]) if near else None
        return known[label]

    # the lengths of at most `fit_documents` texts are summed up in one task
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = some.select("doc_id", F.length("text").alias("n")).withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= fit_chars)
    rows = some.join(F.broadcast(fits.select("doc_id")), "doc_id").select("text", "labels").collect()
    fit = [(r["text"], sorted({k for x in r["labels"] if (k := place(x)) is not None})) for r in rows]
    return Components([n for n, _ in names]).fit([x for x in fit if x[1]], [x for _, x in names])


_MIX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("mixture", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("n_sentences", T.IntegerType())])


def mixtures(documents: DataFrame, labels: DataFrame, subjects: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, subject, mixture, share, n_sentences): how much of a document is a subject's by its row of w, and the share of
    its sentences that belong to the subject; one row for each subject that has a sentence.

    Texts of any length are taken whole; null and empty texts and texts without sentences give no rows, nor do rows
    without an id. A repeated row counts once.
    """
    model = fit_components(documents, labels, subjects, fit_documents)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 256):
                part = b.iloc[start : start + 256]
                w, shares, n = model.fold_in(part["text"].tolist())
                r, k = np.nonzero(shares[:, : len(model.subjects)])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[r], "subject": np.array(model.subjects, dtype=object)[k], "mixture": w[r, k], "share": shares[r, k], "n_sentences": n[r].astype("int32")})

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(apply, _MIX).groupBy("doc_id", "subject").agg(F.max("mixture").alias("mixture"), F.max("share").alias("share"), F.max("n_sentences").alias("n_sentences"))


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, subject): the subjects that take up at least ``share`` of a document's sentences."""
    return mixtures(documents, labels, subjects, fit_documents).where(F.col("share") >= share - 1e-9).select("doc_id", "subject")
