"""Document quality by co-training of two views.

The content view sees which words and word shapes a text is made of and how often they repeat;
the metadata view sees the page around the words: language and source, lengths, lines, the shares
of upper case, digits, marks and spaces, and how well the text compresses.  Each view is a
logistic regression in numpy.  Both start from labelled rows; in every round each view labels
the unlabelled rows that it is most sure of, and the other view learns from them.  At the end
the views' scores are calibrated and combined by a logistic regression on labelled rows that
neither view has learnt from, and the threshold is the one of least cost on these rows: a good
one rejected costs ``good_cost`` and a bad one kept 1, each kind counted at its share of all labels.

The fit uses bounded samples: ``fit_rows`` labelled and ``pool_rows`` unlabelled rows of at most
``fit_chars`` characters; every document is scored whole.

Defined results: a null or empty text has the features of an empty text; a null source or language
is a value of its own.  Documents of equal scores have the same fate; of equally sure rows the first
in the order of the sample is taken.  Without labels of both kinds every document is kept with score 1.  Rows
are scored one by one, so repeated rows stay.  An empty table gives no rows.  ``lang`` and
``source`` may be missing; ``good`` keeps all columns, ``score`` the id alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import Memo, map_batches, utf8

WORDS, SHAPES, STATS = 1024, 256, 6
CONTENT = WORDS + SHAPES + STATS
LANGS, SOURCES, LAYOUT = 16, 32, 16
METADATA = LANGS + SOURCES + LAYOUT
#: Letters of either case and digits each become one sign; marks stay.
SHAPE = bytes(
    ord("A") if chr(b).isupper() and b < 128 else ord("0") if 48 <= b < 58 else ord("a") if chr(b).isalpha() and b < 128 or b >= 128 else b
    for b in range(256)
)


def shape_of(word: bytes) -> bytes:
    """The word's signs without their repetitions: ``Word,`` is ``Aa,``."""
    signs = word.translate(SHAPE)
    return bytes(b for i, b in enumerate(signs) if i == 0 or signs[i - 1] != b)


def bucket(text: bytes, n: int) -> int:
    return xxhash.xxh3_64_intdigest(text) % n


PLACES = Memo(lambda word: bucket(word.lower(), WORDS) * SHAPES + bucket(shape_of(word), SHAPES), 200_000)


def content(text: bytes) -> np.ndarray:
    """Square roots of the shares of words and shapes, and shares of repetition."""
    out = np.zeros(CONTENT, np.float32)
    words = text.split()
    if not words:
        return out
    places = np.fromiter(map(PLACES.__getitem__, words), np.int64, len(words))
    n = len(words)
    out[:WORDS] = np.sqrt(np.bincount(places // SHAPES, minlength=WORDS) / n)
    out[WORDS : WORDS + SHAPES] = np.sqrt(np.bincount(places % SHAPES, minlength=SHAPES) / n)
    pairs = places[1:] * 1_000_003 + places[:-1]
    triples = pairs[1:] * 1_000_003 + places[:-2]
    repeated = [1 - len(np.unique(p)) / len(p) if len(p) else 0 for p in (pairs, triples)]
    out[WORDS + SHAPES :] = [1, (places[1:] == places[:-1]).mean() if n > 1 else 0, 1 - len(set(words)) / n, *repeated, min(1, n / 50)]
    return out


def share(text: bytes, dropped: bytes) -> float:
    return 1 - len(text.translate(None, dropped)) / max(1, len(text))


UPPERS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SPACES, HIGH = b" \t\n\v\f\r", bytes(range(128, 256))


def metadata(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """One-hot language and source, and the layout of the page."""
    out = np.zeros(METADATA, np.float32)
    out[bucket(repr(lang).encode(), LANGS)] = 1
    out[LANGS + bucket(repr(source).encode(), SOURCES)] = 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_words = len(text.split())
    packed = sum(len(zlib.compress(text[k : k + 65536], 1)) for k in range(0, len(text), 65536))
    out[LANGS + SOURCES :] = [
        1,
        np.log1p(len(text)) / 10,
        np.log1p(n_words) / 8,
        np.log1p(len(lines)) / 5,
        np.log1p(len(text) / max(1, len(lines))) / 8,
        min(4, len(text) / max(1, n_words) / 10),
        share(text, UPPERS),
        share(text, DIGITS),
        share(text, MARKS) * 4,
        share(text, SPACES),
        share(text, HIGH),
        1 - len(set(lines)) / max(1, len(lines)),
        min(2, packed / max(1, len(text))),
        min(2, packed / max(1, len(text))) ** 2,
        float(n_words < 20),
        float(not text),
    ]
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights by Adam on the whole sample; the last one is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False)
    w, m, v = (np.zeros(x.shape[1], np.float64) for _ in range(3))
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        miss = (sigmoid((x @ w.astype(np.float32)).astype(np.float64)) - y) * weight
        g = (miss.astype(np.float32) @ x).astype(np.float64) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


@dataclass
class Model:
    """Weights of both views (each with a constant), of their combination, and the threshold."""

    views: list[np.ndarray] = field(default_factory=list)
    combine: np.ndarray = field(default_factory=lambda: np.zeros(3))
    threshold: float = 0.0

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits by view, and the combined probability of good quality."""
        n = len(views[0])
        if not self.views:
            return np.zeros((n, 2)), np.ones(n)
        each = np.stack([np.clip(x @ w[:-1] + w[-1], -30, 30) for x, w in zip(views, self.views)], axis=1)
        return each, sigmoid(each @ self.combine[:2] + self.combine[2])


def best_threshold(scores: np.ndarray, y: np.ndarray, good_weight: float, bad_weight: float) -> float:
    """The threshold of least cost, the middle one of equals: good rows under it and bad rows from it on."""
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], y[order] == 1
    cuts = np.concatenate([s[:1] / 2, (s[1:] + s[:-1]) / 2, (s[-1:] + 1) / 2])
    lost = np.concatenate([[0], np.cumsum(good)])
    kept = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    cost = good_weight * lost + bad_weight * kept
    apart = np.concatenate([[True], s[1:] > s[:-1], [True]])  # rows of the same score share their fate
    best = cuts[apart & (cost <= cost[apart].min() * (1 + 1e-9))]
    return float(best[len(best) // 2])


def train(
    views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int, sure: float, good_cost: float, many: dict[int, int] | None = None
) -> Model:
    """Co-training on labelled ``views`` and the unlabelled ``pool``; every fourth row only calibrates.

    ``many`` are the rows of each label before sampling; without it the sample's shares count.
    """
    held = np.arange(len(y)) % 4 == 0
    if not len(y) or len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return Model()
    own = [[x[~held]] for x in views]
    marks = [[y[~held]] for _ in views]
    free = [np.ones(len(pool[0]), bool) for _ in views]  # rows of the pool a view has not been given yet

    def fitted(v: int) -> np.ndarray:
        labels = np.concatenate(marks[v])
        return logistic(np.concatenate(own[v]), labels, balanced(labels))

    weights = [fitted(v) for v in range(2)]
    for _ in range(rounds):
        for v in range(2):
            other = 1 - v
            p = sigmoid(pool[v] @ weights[v][:-1] + weights[v][-1])
            # As many of each kind as a tenth of the labelled rows has, the surest first.
            for label, belief in ((1, p), (0, 1 - p)):
                most = max(1, int((y[~held] == label).sum() * 0.1))
                order = np.argsort(-belief, kind="stable")
                chosen = order[(belief[order] >= sure) & free[other][order]][:most]
                free[other][chosen] = False
                own[other].append(pool[other][chosen])
                marks[other].append(np.full(len(chosen), label))
        weights = [fitted(v) for v in range(2)]
    model = Model(weights)
    each, _ = model.scores([x[held] for x in views])
    model.combine = logistic(each / 10, y[held], np.ones(held.sum()), 1e-4, 600) / np.array([10, 10, 1])
    known = y[held]
    each_good, each_bad = ((many or {}).get(k, (y == k).sum()) / (known == k).sum() for k in (1, 0))
    model.threshold = best_threshold(model.scores([x[held] for x in views])[1], known, good_cost * each_good, each_bad)
    return model


def features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` beside what the views read."""
    lang, source = ((F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")) for c in ("lang", "source"))
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    return documents.select(*kept, utf8().alias("_t"), lang.alias("_l"), source.alias("_o"))


def of_batch(batch) -> list[np.ndarray]:
    texts = batch["_t"].to_pylist()
    if not texts:
        return [np.zeros((0, CONTENT), np.float32), np.zeros((0, METADATA), np.float32)]
    sides = zip(texts, batch["_l"].to_pylist(), batch["_o"].to_pylist())
    return [np.stack([content(t) for t in texts]), np.stack([metadata(*s) for s in sides])]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    fit_rows: int = 6000,
    pool_rows: int = 3000,
    fit_chars: int = 50_000,
    rounds: int = 3,
    sure: float = 0.95,
    good_cost: float = 2.0,
) -> Model:
    """Train on about ``fit_rows`` labelled rows, a third of them of low quality where there are as many."""
    known = labels.where("quality IN (0, 1)").select("doc_id", "quality")
    many = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    rates = {0: min(1.0, fit_rows / 3 / max(1, many.get(0, 0))), 1: min(1.0, fit_rows * 2 / 3 / max(1, many.get(1, 0)))}
    dice = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) / 1_000_000
    sample = known.where(F.when(F.col("quality") == 0, dice < rates[0]).otherwise(dice < rates[1]))
    short = documents.where(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars)
    rate = min(1.0, pool_rows / max(1, documents.count()))
    other = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    drawn = features(short.where(other < rate), ["doc_id"])
    taken = features(short, ["doc_id"]).join(F.broadcast(sample.withColumnRenamed("doc_id", "_k0")), "_k0")
    # Both samples are bounded by the parameters above.
    found, pool = taken.toArrow(), drawn.toArrow()
    labelled = set(found["_k0"].to_pylist())
    rows = sorted(found.to_pylist(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["_k0"])), r["_t"]))
    free = sorted((r for r in pool.to_pylist() if r["_k0"] not in labelled), key=lambda r: (str(r["_k0"]), r["_t"]))
    table = [pa.Table.from_pylist(some, schema=pool.schema) for some in ([{k: r[k] for k in pool.schema.names} for r in rows], free)]
    return train(of_batch(table[0]), np.array([r["quality"] for r in rows], np.int64), of_batch(table[1]), rounds, sure, good_cost, many)


def scored(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` under stand-in names, which no input can clash with, the scores and the verdict."""

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            each, p = model.scores(of_batch(batch))
            columns = [batch[f"_k{i}"] for i in range(len(keep))]
            made = [pa.array(sigmoid(each[:, 0])), pa.array(sigmoid(each[:, 1])), pa.array(p), pa.array(p >= model.threshold)]
            return pa.RecordBatch.from_arrays([*columns, *made], names=[*[f"_k{i}" for i in range(len(keep))], "_a", "_b", "_s", "_g"])

        return run

    types = ", ".join(f"_k{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return map_batches(features(documents, keep), build, f"{types}, _a double, _b double, _s double, _g boolean")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every row."""
    return scored(documents, model, ["doc_id"]).toDF("doc_id", "text_score", "meta_score", "score", "kept")


def good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that are kept."""
    names = documents.columns
    found = scored(documents, model, names).where("_g")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)])
