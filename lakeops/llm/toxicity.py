"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word (letters and digits, lower case) has three hashed features: itself and its first four and
first five characters, each in one of 2^24 buckets; its vector is the sum of their embeddings.
Buckets that the training texts do not use, or hardly use, have no embedding.  Filters of widths
1, 2 and 3 run over the word vectors, each filter keeps its largest response over the whole text
(max pooling), and a logistic layer scores the pooled responses.  All of it is trained in numpy
by Adam; the first coordinate of an embedding starts as the feature's log odds.

The fit uses a bounded sample of labelled rows (``fit_rows`` and ``fit_chars``), of which the tasks
send the features of the words, never texts; one fifth of it only calibrates.  At most
``most_rows`` features have embeddings and ``most`` languages are told apart.  For each language the sample shows often enough, the threshold is put where
errors on that part are fewest, and scores are shifted so that it lies at 0.5.  At scoring, the
language is told from the text by its frequent words; no column but the text is read.

Defined results: null or empty texts are scored as texts without words.  Without labels of both
kinds every score is 0.  Texts are read whole.  Rows are scored one by one, so repeated rows stay.
Texts of equal scores have the same fate; equal rows of the sample are in the
order of a hash.  An empty table gives no rows.  ``clean`` keeps all columns, ``score`` the id alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import Memo, fold, map_batches, utf8

DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
BUCKETS = 1 << 24
#: ASCII other than letters and digits, as spaces.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode(errors="replace").lower().encode().translate(PLAIN).split()


def features(word: bytes) -> tuple[int, int, int]:
    text = word.decode(errors="replace")
    return tuple(
        xxhash.xxh3_64_intdigest(part.encode(), seed=seed) & (BUCKETS - 1) for seed, part in enumerate((text, text[:4], text[:5]))
    )


#: Features of a word, shared by all tasks of a Python worker.
FEATURES = Memo(features, 100_000)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Trained parameters; ``rows`` maps used buckets to embedding rows (row 0: none)."""

    rows: dict[int, int] = field(default_factory=dict)
    embeddings: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # per width: (width * DIM, FILTERS)
    filter_bias: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = -40.0
    languages: list[str] = field(default_factory=list)
    language_logs: dict[int, np.ndarray] = field(default_factory=dict)  # word bucket -> log probabilities
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0


class Scorer:
    """Filter responses per word, kept in a table that is emptied at ``most`` words."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.parts = [model.embeddings @ f[k * DIM : (k + 1) * DIM] for w, f in zip(WIDTHS, model.filters) for k in range(w)]
        self.columns = sum(WIDTHS) * FILTERS
        self.width = self.columns + len(model.languages)
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def learn(self, words: set[bytes]) -> None:
        model, new = self.model, sorted(words)
        found = [features(w) for w in new]
        rows = np.array([[model.rows.get(f, 0) for f in fs] for fs in found], np.int64)
        at = len(self.index)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i, part in enumerate(self.parts):
            self.table[at : at + len(new), i * FILTERS : (i + 1) * FILTERS] = part[rows].sum(axis=1)
        for k, fs in enumerate(found):
            logs = model.language_logs.get(fs[0])
            self.table[at + k, self.columns :] = 0 if logs is None else logs
        self.index.update(zip(new, range(at, at + len(new))))

    def logit(self, text: bytes) -> float:
        """Distance of the text's score from its language's threshold, on the logit scale."""
        model, words = self.model, words_of(text)
        pooled, language = np.zeros(len(WIDTHS) * FILTERS, np.float32), None
        if words and model.filters:
            if len(self.index) > self.most:
                self.index.clear()
            got = list(map(self.index.get, words))
            if None in got:
                self.learn({w for w, g in zip(words, got) if g is None})
                got = list(map(self.index.__getitem__, words))
            found, at = self.table[np.array(got, np.int64)], 0
            for i, width in enumerate(WIDTHS):
                if len(words) >= width:
                    response = sum(found[k : len(words) - width + 1 + k, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(width))
                    pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum(response.max(axis=0) + model.filter_bias[i], 0)
                at += width * FILTERS
            if model.languages:
                language = model.languages[int(found[:, self.columns :].sum(axis=0).argmax())]
        return float(pooled @ model.weights + model.bias - model.thresholds.get(language, model.threshold))


def text_features(text: bytes) -> np.ndarray:
    """(words, 3): the hashed features of each word."""
    return np.array(list(map(FEATURES.__getitem__, words_of(text))), np.int32).reshape(-1, 3)


def document_counts(found: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts, and in how many texts of each label they are."""
    both = []
    for label in (0, 1):
        own = [np.unique(f) for f, y in zip(found, labels) if y == label]
        both.append(np.unique(np.concatenate([np.zeros(0, np.int32), *own]), return_counts=True))
    every = np.union1d(both[0][0], both[1][0])
    counts = np.zeros((len(every), 2), np.int64)
    for label, (features_of, n) in enumerate(both):
        counts[np.searchsorted(every, features_of), label] = n
    return every, counts


def train(found: list[np.ndarray], labels: np.ndarray, languages: list, epochs: int, seed: int = 7, least_df: int = 3, most_rows: int = 100_000) -> Model:
    """Fit on the word features of texts, which are replaced by their embedding rows; every fifth text only calibrates."""
    model = Model()
    if not len(found) or labels.min() == labels.max():
        return model
    fits = np.arange(len(found)) % 5 != 0
    every, counts = document_counts([found[i] for i in np.flatnonzero(fits)], labels[fits])
    tell_languages(model, found, languages)
    often = np.flatnonzero(counts.sum(axis=1) >= least_df)
    often = often[np.lexsort((every[often], -counts[often].sum(axis=1)))][:most_rows]
    used, seen = every[often], counts[often] + 0.5
    model.rows = {int(f): i + 1 for i, f in enumerate(used)}
    total = np.array([(labels[fits] == 0).sum(), (labels[fits] == 1).sum()]) + 1.0
    dice = np.random.default_rng(seed)
    table = dice.normal(0, 0.05, (len(used) + 1, DIM))
    table[1:, 0] = np.clip(np.log(seen[:, 1] / total[1]) - np.log(seen[:, 0] / total[0]), -4, 4) / 4
    table[0] = 0
    model.embeddings = table.astype(np.float32)
    order = np.argsort(used)
    by_feature, row_of = used[order], (order + 1).astype(np.int32)
    told = [language_of(model, f) for f in found]
    rows = found
    for i, f in enumerate(found):
        at = np.minimum(np.searchsorted(by_feature, f), max(0, len(used) - 1))
        rows[i] = np.where(by_feature[at] == f, row_of[at], 0).astype(np.int32) if len(used) else np.zeros_like(f)
    state = {"E": model.embeddings, "v": dice.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
    for i, w in enumerate(WIDTHS):
        state[f"W{i}"] = dice.normal(0, 0.3 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32)
        state[f"b{i}"] = np.zeros(FILTERS, np.float32)
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in state.items()}
    balance = np.where(labels == 1, total[0] / total.sum(), total[1] / total.sum()) * 2
    step = 0
    train_on = [i for i in np.flatnonzero(fits) if len(rows[i])]
    for _ in range(epochs):
        for batch in np.array_split(dice.permutation(train_on), max(1, len(train_on) // 32)):
            step += 1
            grads = {k: np.zeros_like(p) for k, p in state.items() if k != "E"}
            touched: list[np.ndarray] = []
            pulls: list[np.ndarray] = []
            for i in batch:
                x = state["E"][rows[i]].sum(axis=1)
                pooled, at = [], []
                for j, w in enumerate(WIDTHS):
                    n = len(x) - w + 1
                    if n < 1:
                        pooled.append(np.zeros(FILTERS, np.float32))
                        at.append(None)
                        continue
                    r = sum(x[k : n + k] @ state[f"W{j}"][k * DIM : (k + 1) * DIM] for k in range(w))
                    top = r.argmax(axis=0)
                    pooled.append(np.maximum(r[top, np.arange(FILTERS)] + state[f"b{j}"], 0))
                    at.append(top)
                h = np.concatenate(pooled)
                p = sigmoid(h @ state["v"] + state["c"][0])
                miss = np.float32((p - labels[i]) * balance[i] / len(batch))
                grads["v"] += miss * h
                grads["c"] += miss
                back = miss * state["v"] * (h > 0)
                for j, w in enumerate(WIDTHS):
                    if at[j] is None:
                        continue
                    g = back[j * FILTERS : (j + 1) * FILTERS]
                    grads[f"b{j}"] += g
                    for k in range(w):
                        here = at[j] + k
                        grads[f"W{j}"][k * DIM : (k + 1) * DIM] += x[here].T * g
                        touched.append(np.repeat(rows[i][here], 1, axis=0).reshape(-1))
                        pulls.append(np.repeat((state[f"W{j}"][k * DIM : (k + 1) * DIM] * g).T, 3, axis=0))
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                m, v = moments[k]
                g = g + 1e-4 * state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                state[k] -= 0.01 * scale * m / (np.sqrt(v) + 1e-8)
            if touched:
                ids, where = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(ids), DIM), np.float32)
                np.add.at(g, where, np.concatenate(pulls))
                g[ids == 0] = 0
                m, v = moments["E"]
                m[ids] += 0.1 * (g - m[ids])
                v[ids] += 0.001 * (g * g - v[ids])
                state["E"][ids] -= 0.01 * scale * m[ids] / (np.sqrt(v[ids]) + 1e-8)
    model.embeddings = state["E"]
    model.filters, model.filter_bias = [state[f"W{i}"] for i in range(len(WIDTHS))], [state[f"b{i}"] for i in range(len(WIDTHS))]
    model.weights, model.bias = state["v"], float(state["c"][0])
    del moments, state
    calibrate(model, rows, told, labels, fits)
    return model


def tell_languages(model: Model, found: list[np.ndarray], languages: list, most: int = 64, top: int = 500) -> None:
    """Log probabilities of each language's ``top`` frequent words, for telling the language of a text."""
    counts: dict[str, dict[int, int]] = {}
    for language in sorted({g for g in languages if g is not None}):
        words, n = np.unique(np.concatenate([f[:, 0] for f, g in zip(found, languages) if g == language]), return_counts=True)
        if len(words):
            counts[language] = dict(zip(words.tolist(), n.tolist()))
    model.languages = sorted(counts, key=lambda g: (-sum(counts[g].values()), g))[:most]
    frequent = {b for g in model.languages for b in sorted(counts[g], key=lambda b: (-counts[g][b], b))[:top]}
    totals = np.array([sum(counts[g].values()) for g in model.languages], np.float64)
    for b in frequent:
        share = (np.array([counts[g].get(b, 0) for g in model.languages]) + 0.5) / (totals + 1)
        model.language_logs[b] = np.log(share / share.max()).astype(np.float32)


def language_of(model: Model, found: np.ndarray) -> str | None:
    """The language whose frequent words fit best."""
    if not len(found) or not model.languages:
        return None
    total = np.zeros(len(model.languages), np.float32)
    for word, n in zip(*np.unique(found[:, 0], return_counts=True)):
        logs = model.language_logs.get(int(word))
        if logs is not None:
            total += logs * n
    return model.languages[int(total.argmax())]


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with fewest errors, a clean text rejected counting twice; the middle of equals."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(y == 1)])
    wrong = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    cost = missed + 2 * wrong
    best = cuts[cost == cost.min()]
    return float((best[0] + best[-1]) / 2)


def raw_logit(model: Model, rows: np.ndarray) -> float:
    """The score of a text of embedding rows on the logit scale, no threshold taken off."""
    x = model.embeddings[rows].sum(axis=1)
    pooled = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    for i, width in enumerate(WIDTHS):
        n = len(x) - width + 1
        if n > 0:
            response = sum(x[k : n + k] @ model.filters[i][k * DIM : (k + 1) * DIM] for k in range(width))
            pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum(response.max(axis=0) + model.filter_bias[i], 0)
    return float(pooled @ model.weights + model.bias)


def calibrate(model: Model, rows: list[np.ndarray], told: list, labels: np.ndarray, fits: np.ndarray, least: int = 8) -> None:
    """Thresholds over the part of the sample that was not fitted, whole and by language."""
    held = np.flatnonzero(~fits)
    if not len(held) or labels[held].min() == labels[held].max():
        return
    scores = np.array([raw_logit(model, rows[i]) for i in held])
    told_held = np.array([told[i] for i in held], object)
    model.threshold = best_cut(scores, labels[held])
    for language in model.languages:
        own = told_held == language
        if (labels[held][own] == 1).sum() >= least and (labels[held][own] == 0).sum() >= least:
            model.thresholds[language] = best_cut(scores[own], labels[held][own])


def fit(documents: DataFrame, labels: DataFrame, where=None, fit_rows: int = 6000, fit_chars: int = 50_000, epochs: int = 4) -> Model:
    """Train on about ``fit_rows`` labelled rows, a third of them toxic where there are as many.

    ``where`` limits the rows to learn from.  Texts of more than ``fit_chars`` characters are
    not learnt from, so that the sample's size is bounded; they are scored like all others.
    """
    known = labels.where("toxic IN (0, 1)" if where is None else F.col("toxic").isin(0, 1) & where).select("doc_id", "toxic")
    many = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rates = {1: min(1.0, fit_rows / 3 / max(1, many.get(1, 0))), 0: min(1.0, fit_rows * 2 / 3 / max(1, many.get(0, 0)))}
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) / 1_000_000
    sample = known.where(F.when(F.col("toxic") == 1, dice < rates[1]).otherwise(dice < rates[0]))
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars).select("doc_id", utf8().alias("text"), lang.alias("lang"))
    drawn = texts.join(F.broadcast(sample), "doc_id")  # fit_rows rows

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = batch["text"].to_pylist()
            keys = zip(batch["doc_id"].to_pylist(), text, batch["toxic"].to_pylist())
            order = [xxhash.xxh3_64_digest(str(d)) + xxhash.xxh3_128_digest(t) + bytes([y]) for d, t, y in keys]
            found = pa.array([text_features(t).tobytes() for t in text], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(order, pa.binary()), found, batch["lang"], batch["toxic"]], names=["at", "found", "lang", "toxic"])

        return run

    # The tasks send word features, 12 bytes a word of a sample that fit_rows and fit_chars bound.
    rows = map_batches(drawn.select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic")), build, "at binary, found binary, lang string, toxic int").toArrow()
    rows = rows.take(pc.sort_indices(rows, [("at", "ascending")]))
    found = [np.frombuffer(f.as_buffer(), np.int32).reshape(-1, 3) for f in rows["found"]]
    return train(found, np.array(rows["toxic"].to_pylist(), np.int64), rows["lang"].to_pylist(), epochs)


def scored(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` under stand-in names, which no input can clash with, score and prediction."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most most_rows embeddings
    kept = documents.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], utf8().alias("_t"))

    def build():
        scorer = Scorer(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = sigmoid(np.array([scorer.logit(t) for t in batch["_t"].to_pylist()]))
            columns = [batch[f"_k{i}"] for i in range(len(keep))]
            names = [f"_k{i}" for i in range(len(keep))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*names, "_s", "_p"])

        return run

    types = ", ".join(f"_k{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return map_batches(kept, build, f"{types}, _s double, _p int")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row, from the text alone."""
    return scored(documents, model, ["doc_id"]).toDF("doc_id", "score", "predicted")


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic."""
    names = documents.columns
    found = scored(documents, model, names).where("_p = 0")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)])


def held_out(folds: int = 5):
    return fold("doc_id", folds) == 0
