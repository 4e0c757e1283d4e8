"""Subject mixtures."""

import pandas as pd
import pytest

from ferrule.llm import subjects as s


def test_sentences_and_terms():
    assert s.sentences("Abstract\nOne two three.  Four five six!\n\n1. Introduction\nFigure 3. A heading of five words here") == ["One two three.", "Four five six!", "A heading of five words here"]
    assert s.sentences("[2] Smith, J. Solid Ion Letters 16 (2005) 104.\nD = MSD(t) / (6 t)   (4)") == []
    assert "prior" not in s.terms("the prior art is left aside here, and the supercell is treated instead.")
    assert s.terms(s.masked("Powder of Li7La3Zr2O12 at 12 h")) == s.terms(s.masked("Powder of LiFePO4 at 3.5 h"))
    assert s.sentences("") == [] and s.terms("") == []


def test_held_out_accuracy(sf):
    """On labelled documents left out of the fit. The labels hold slips, and few of the fitted ones are German or French."""
    folder = sf.replace("sf0.001", "sf0.1")
    docs = pd.read_parquet(f"{folder}/documents.parquet").dropna(subset=["text"]).set_index("doc_id").text
    names = pd.read_parquet(f"{folder}/subjects.parquet")
    keys = {s.subject_key(n): i for i, n in enumerate(names.subject)}
    labels = {}
    for d, x in pd.read_parquet(f"{folder}/subject_labels.parquet")[["doc_id", "subject"]].itertuples(index=False):
        if s.subject_key(x) in keys and d in docs.index:
            labels.setdefault(d, set()).add(keys[s.subject_key(x)])
    ids = sorted(labels)
    fit, held = [d for i, d in enumerate(ids) if i % 4], ids[::4]
    model = s.Components(list(names.subject)).fit([(docs[d], sorted(labels[d])) for d in fit], list(names.summary))
    _, shares, _ = model.fold_in([docs[d] for d in held])
    found = {(d, k) for d, row in zip(held, shares) for k in range(len(names)) if row[k] >= s.SHARE - 1e-9}
    want = {(d, k) for d in held for k in labels[d]}
    assert len(found & want) / len(found) > 0.85 and len(found & want) / len(want) > 0.85


@pytest.fixture(scope="module")
def tables(spark):
    law, cells = "The prior art reads on the dependent claim of the licence grant.", "The discharge capacity of the coin cell fell after each cycle."
    docs = [(i, (law if i % 2 else cells) + " " + (law if i % 2 else cells), "en") for i in range(60)] + [(100, law + " " + cells, "en"), (101, None, "en"), (102, "", "en"), (103, " \n ", None), (104, "Heading", "de"), (105, " ".join([law] * 3000), "en"), (0, cells + " " + cells, "en")]
    labels = [(i, "Patent Law" if i % 2 else "ELECTROCHEMISTRY", "a") for i in range(40)] + [(41, "patnt_law", "b"), (50, None, "b"), (51, "nonsense", "c"), (None, "patent_law", "c")]
    return spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([("electrochemistry", "Texts on discharge capacity and the like."), ("patent_law", "Texts on prior art and the like.")], "subject string, summary string")


def test_frame(tables):
    got = {}
    for r in s.subjects_of(*tables).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert all(got[i] == ["patent_law" if i % 2 else "electrochemistry"] for i in range(60))
    assert sorted(got[100]) == ["electrochemistry", "patent_law"] and got[105] == ["patent_law"]
    assert not {101, 102, 103, 104} & set(got)


def test_bound_and_empty(tables):
    docs, labels, subjects = tables
    assert s.subjects_of(docs, labels, subjects, fit_documents=10).count() > 50
    assert s.subjects_of(docs.limit(0), labels, subjects).count() == 0
    assert s.subjects_of(docs, labels.limit(0), subjects).count() >= 0
