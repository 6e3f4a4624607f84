"""Scores of the classifier recomputed from the definition, with dense vectors and without the module's code."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import queries, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return set(WORD.findall((text or "").translate(LOWER)))


def places(word):
    text = f"<{word}>"
    grams = {text} | {text[k : k + 4] for k in range(len(text) - 3)}
    return {zlib.crc32(g.encode()) % 2**18 for g in grams}


def vector(found):
    out = {}
    for w in found:
        for p in places(w):
            out[p] = out.get(p, 0) + 1 / math.sqrt(len(found))
    return out


def brute(docs, labels):
    """docs: id -> text; labels: id -> 0 or 1. id -> score."""
    next_term = {a: b for kind in toxicity.IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1])}
    fitted = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5]
    x = [vector(words(docs[i])) for i in fitted]
    changes = []
    for i in fitted:
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", docs[i] or ""):
            own = words(sentence)
            if own & next_term.keys():
                change = vector({next_term.get(w, w) for w in own})
                for p, v in vector(own).items():
                    change[p] = change.get(p, 0) - v
                changes.append(change)
    names = sorted({p for v in [*x, *changes] for p in v})
    dense = lambda rows: np.array([[v.get(p, 0.0) for p in names] for v in rows]).reshape(len(rows), len(names))
    a, c, y = dense(x), dense(changes), np.array([labels[i] for i in fitted], float)
    odds = [((a[y == k] > 0).sum(0) + 1) / ((y == k).sum() + 2) for k in (0, 1)]
    scale = abs(np.log(odds[1] / odds[0]))
    a, c = a * scale, c * scale
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, first, second = np.zeros(len(names) + 1), 0, 0
    for step in range(1, toxicity.STEPS + 1):
        error = share * (1 / (1 + np.exp(-(a @ w[:-1] + w[-1]))) - y)
        g = a.T @ error + 2 * toxicity.L2 * w[:-1]
        if len(changes):
            g = g + 2 * toxicity.FAIRNESS / len(changes) * c.T @ (c @ w[:-1])
        g = np.append(g, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - toxicity.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (toxicity.STEPS + 1))
    weight = dict(zip(names, w[:-1] * scale))
    return {i: 1 / (1 + math.exp(-(sum(weight.get(p, 0.0) * v for p, v in vector(words(t)).items()) + w[-1]))) for i, t in docs.items()}


def test_scores_of_a_fixture(spark):
    r = random.Random(6)
    good, bad = "calm kind river stone garden walk".split(), "vile scum idiot moron trash hate".split()
    group = ["muslims", "christians", "frauen", "musulmans", "jews"]
    docs, labels = {}, {}
    for k in range(120):
        label = k % 3 == 0
        text = " ".join(r.choices(good + bad * (1 + 3 * label), k=r.randint(3, 14)))
        if r.random() < 0.5:
            text += f". {r.choice(group).title()} live here! and more"
        docs[k], labels[k] = text, int(label)
    docs |= {200: None, 201: "", 202: "Öl über alles", 203: "word " * 200_000 + "idiot"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(k, y) for k, y in labels.items() if k % 7] + [(999, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(frame, toxicity.train(frame, known)).collect()
    want = brute(docs, {k: y for k, y in labels.items() if k % 7})
    assert {x.doc_id for x in got} == set(docs)
    for x in got:
        assert x.score == pytest.approx(want[x.doc_id], abs=1e-4)
        assert x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)


def test_scores_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute(docs, labels)
    got = queries.op9_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4)
