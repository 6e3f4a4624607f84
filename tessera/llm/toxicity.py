"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their character 4-grams (with word ends), hashed to 2 ** BITS
places; a feature counts the distinct words that have it, over the square root of the number of distinct words.
The loss is class-balanced logistic loss with an L2 term and, for each labelled sentence that names a group, the
squared change of its score when the identity term is swapped for another of its kind. That holds the weight of
a neutral mention near that of its counterparts, so that mentions alone do not raise a score.

Each feature is scaled by its log-odds between the two classes (presence in texts, with one added), so that a
few hundred labelled rows are enough to favour words of one class over long texts' own words.

The features of labelled rows are made in parallel. The classifier is fitted on them in one task: on at most
SAMPLE_ROWS labelled ids, those with the smallest hash, and of these on the first whose features fit in
SAMPLE_BYTES. Both bounds are parameters; the fitted weights (2 ** BITS floats) travel with the scoring tasks, which read
every row and whole texts. Labels, language, source and id are no inputs of a score.

Edge cases: null text counts as empty; a text without words scores sigmoid(bias), as an empty text does. Labels
that are null or not 0 or 1, that name no document, or whose id is null are not used; an id that is labelled more than
once counts once for each label, and of documents that share it the one with the smallest text hash is used. Without
any labelled rows of both classes (such as empty tables) every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import drop, materialise, released, rows_out, words

BITS = 18
GRAM = 4
SAMPLE_ROWS = 12_000
#: Bytes of features (8 for each place of a row) that the fit holds.
SAMPLE_BYTES = 256 << 20
STEPS = 60
RATE = 0.1
L2 = 1e-4
FAIRNESS = 1.0
#: Words whose features, and words whose scores, a task keeps.
CACHE_WORDS, SCORE_WORDS = 100_000, 300_000
#: Features that one step of the fit multiplies.
PART = 1 << 20
#: Kinds of group mentions in English, German, French and Spanish; within a kind, each term is swapped for the next.
#: A word that languages share stands in the first of them only.
IDENTITY_TERMS = (
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("young", "old"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("weiblich", "männlich"),
    ("weibliche", "männliche"),
    ("muslimin", "christin", "jüdin", "buddhistin", "atheistin"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische", "atheistische"),
    ("schwarze", "weiße", "asiatische"),
    ("schwul", "heterosexuell", "lesbisch", "bisexuell"),
    ("schwule", "heterosexuelle", "lesbische", "bisexuelle"),
    ("einwanderer", "einheimische"),
    ("jung", "alt"),
    ("junge", "alte"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("féminin", "masculin"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmane", "chrétienne", "juive", "hindoue"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noir", "blanc", "asiatique"),
    ("noirs", "blancs", "asiatiques"),
    ("homosexuel", "hétérosexuel", "bisexuel"),
    ("lesbienne", "hétérosexuelle"),
    ("immigré", "autochtone"),
    ("immigrés", "autochtones"),
    ("jeune", "vieux"),
    ("jeunes", "vieilles"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("femenino", "masculino"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmana", "cristiana", "judía", "atea"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático"),
    ("negros", "blancos", "asiáticos"),
    ("homosexual", "heterosexual", "lesbiana"),
    ("inmigrante", "nativo"),
    ("inmigrantes", "nativos"),
    ("joven", "viejo"),
    ("jóvenes", "viejos"),
)


def features(word: bytes) -> np.ndarray:
    """Places of a word: itself and its character 4-grams with word ends."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    grams = {text} | {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    return np.array(sorted({zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in grams}), np.int64)


class Features(dict):
    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = features(word)
        return out


def vector(distinct: set[bytes], table: Features) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's distinct words."""
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    places, counts = np.unique(np.concatenate([table[w] for w in distinct]), return_counts=True)
    return places, (counts / np.sqrt(len(distinct))).astype(np.float32)


def swaps(terms: Sequence[Sequence[str]]) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for kind in terms for a, b in zip(kind, (*kind[1:], kind[0]))}


def sentences(text: str) -> list[str]:
    out, start = [], 0
    for i, c in enumerate(text):
        if c in ".!?\n":
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]]


class Rows:
    """Sparse rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(p) for p, _ in rows], np.int64)
        self.places = np.concatenate([p for p, _ in rows] or [np.zeros(0, np.int64)]).astype(np.int32)
        self.values = np.concatenate([v for _, v in rows] or [np.zeros(0, np.float32)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), self.n)
        self.size = len(rows)

    def parts(self) -> Iterator[slice]:
        return (slice(at, at + PART) for at in range(0, len(self.places), PART))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        for k in self.parts():
            first = int(self.row[k.start])
            found = np.bincount(self.row[k] - first, self.values[k] * w[self.places[k]])
            out[first : first + len(found)] += found
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS)
        for k in self.parts():
            out += np.bincount(self.places[k], self.values[k] * r[self.row[k]], 1 << BITS)
        return out


def featurise(text: str, table: Features, swap: dict[bytes, bytes]) -> tuple[tuple, list[tuple]]:
    """Features of a text, and their changes where an identity term of a sentence is swapped."""
    found = words(text)
    changes = []
    if swap.keys() & set(found):
        for sentence in sentences(text):
            own = words(sentence)
            if swap.keys() & set(own):
                (p, v), (q, u) = (vector({w if k else swap.get(w, w) for w in own}, table) for k in (1, 0))
                changes.append((np.concatenate([p, q]), np.concatenate([-v, u])))
    return vector(set(found), table), changes


def log_odds(x: Rows, y: np.ndarray) -> np.ndarray:
    """How far each place tells the classes apart: |log-odds| of its presence, with one text of each class added."""
    with_it = [sum((np.bincount(x.places[k][y[x.row[k]] == label], minlength=1 << BITS) for k in x.parts()), np.ones(1 << BITS)) for label in (0, 1)]
    n = [len(y) - y.sum() + 2, y.sum() + 2]
    return np.abs(np.log(with_it[1] / n[1]) - np.log(with_it[0] / n[0]))


def fit_rows(x: Rows, change: Rows, y: np.ndarray, fairness: float = FAIRNESS) -> np.ndarray:
    """2 ** BITS weights and the bias. Without both classes there is nothing to learn: bias minus infinity."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(1 << BITS), -np.inf)
    scale = log_odds(x, y)
    for rows in (x, change):
        for k in rows.parts():
            rows.values[k] *= scale[rows.places[k]]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(1 << BITS), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        r = weight * (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y)
        g = x.back(r) + 2 * L2 * w
        if change.size:
            g += 2 * fairness / change.size * change.back(change.dot(w))
        g = np.append(g, r.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, bias = w - move[:-1], bias - move[-1]
    return np.append(w * scale, bias)


def fit(texts: list[str], labels: list[int], terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> np.ndarray:
    """fit_rows of texts and labels."""
    table, swap = Features(), swaps(terms)
    made = [featurise(t, table, swap) for t in texts]
    return fit_rows(Rows([x for x, _ in made]), Rows([c for _, own in made for c in own]), np.array(labels, float), fairness)


class WordScores(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= SCORE_WORDS:
            self.clear()
        self[word] = out = float(self.weights[features(word)].sum())
        return out


def score_text(text: str, table: WordScores, bias: float) -> float:
    distinct = set(words(text))
    total = math.fsum(map(table.__getitem__, distinct)) / math.sqrt(len(distinct)) if distinct else 0.0
    return float(1 / (1 + np.exp(-np.clip(total + bias, -700, 700)))) if bias > -np.inf else 0.0


def in_holdout(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights fitted on a bounded sample of the labelled rows outside the holdout."""
    key = F.col(id_col).cast("long").alias("id")
    known = labels.select(key, F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~in_holdout(F.col("id"))).distinct()
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)  # at most sample_rows rows of 12 bytes
    texts = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    @released
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, swap = Features(), swaps(IDENTITY_TERMS)
        for batch in batches:
            rows = [featurise(t.as_py(), table, swap) for t in batch.column("text")]
            packed = [Rows([x, *changes]) for x, changes in rows]
            columns = {"n": ([p.n.tobytes() for p in packed], pa.binary()), "places": ([p.places.tobytes() for p in packed], pa.binary()), "weights": ([p.values.tobytes() for p in packed], pa.binary())}
            made = rows_out(columns)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *made.columns], ["id", "label", *columns])

    rows = materialise(texts.mapInArrow(featured, "id long, label int, n binary, places binary, weights binary"))
    sizes = rows.select(F.xxhash64("id").alias("hash"), "id", (2 * F.octet_length("places")).cast("long").alias("size")).collect()  # at most sample_rows
    ids, size = [], 0
    for _, i, own in sorted(sizes):
        size += own
        if size > sample_bytes:
            break
        ids.append(i)
    if not ids:
        return fit([], [])
    last = F.struct(F.xxhash64("id"), "id") <= F.struct(F.xxhash64(F.lit(ids[-1]).cast("long")), F.lit(ids[-1]).cast("long"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        y = np.array([label for _, label, *_ in held], float)
        docs_, changes = [], []
        for _, _, n, places, weights in held:
            cuts = np.cumsum(np.frombuffer(n, np.int64))[:-1]
            own = list(zip(np.split(np.frombuffer(places, np.int32), cuts), np.split(np.frombuffer(weights, np.float32), cuts)))
            docs_.append(own[0])
            changes += own[1:]
        x, change = Rows(docs_), Rows(changes)
        del held, docs_, changes
        yield rows_out({"weights": ([fit_rows(x, change, y).tobytes()], pa.binary())})

    found = np.frombuffer(rows.where(last).repartition(1).mapInArrow(run, "weights binary").first()[0])
    drop(rows)
    return found


def score_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, held_out, score, predicted), and the carried columns, of every row."""
    packed, bias = weights[:-1].astype(np.float32), float(weights[-1])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(packed.astype(float))
        for batch in batches:
            scores = pa.array([score_text(t.as_py() or "", table, bias) for t in batch.column("scored_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "scored_text"), scores], [*(c for c in batch.schema.names if c != "scored_text"), "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("scored_id"), *carry, F.col(text_col).alias("scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "scored_text") + ", score double"
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("scored_id").alias(id_col) if id_col not in carry else F.col("scored_id"), *carry, in_holdout(F.col("scored_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
