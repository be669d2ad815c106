"""Language identification by compression.

Each language has a zstandard dictionary of raw content: texts of that language, a bounded hash
sample of the rows to learn from, taken from hashed places of the texts; a language of few rows
takes more of each.  Texts are reduced to their letters in lower case, with single
spaces for all else, so that marks, numbers and case decide nothing.  A text is compressed with every dictionary, in blocks so that
the dictionary and not the text's own past does the work; all blocks of a text are read.  A larger
dictionary makes any text smaller, so each sum is divided by the dictionary's baseline, which is
what it makes of texts of the other languages, and the language with the smallest quotient wins.  The score is the margin to the second smallest quotient, scaled
so that ``clear`` gives 1; margins under ``narrow`` are rejected: the best guess stays in
``lang_pred`` and ``rejected`` is true.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text
when no row has a language; equal quotients go to the smaller language code.  Rows are judged one by
one, so repeated rows stay.  An empty table gives no rows.  Only text is read at prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import map_batches, utf8

UNKNOWN = "und"


@dataclass
class Model:
    dictionaries: dict[str, bytes] = field(default_factory=dict)
    block: int = 1024
    level: int = 3
    baselines: dict[str, float] = field(default_factory=dict)


#: ASCII other than letters, as spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    return b" ".join(text.decode(errors="replace").lower().encode().translate(LETTERS).split())


def baselines(model: Model, foreign_blocks: int = 200) -> dict[str, float]:
    """How large each dictionary leaves text of the other languages, of about ``foreign_blocks`` blocks, against the mean."""
    names = sorted(model.dictionaries)
    if len(names) < 2:
        return {name: 1.0 for name in names}
    tool, each = Classifier(model), -(-foreign_blocks // len(names))
    ratios: dict[str, list[float]] = {name: [] for name in names}
    for name in names:
        words = model.dictionaries[name]
        # Blocks spread over the dictionary; every language counts the same.
        starts = sorted({i * max(0, len(words) - model.block) // each for i in range(each)})
        blocks = [words[at : at + model.block] for at in starts]
        whole = [tool.sizes(b) for b in blocks]
        for k, other in enumerate(names):
            if other != name:
                ratios[other].append(sum(s[k] for s in whole) / sum(map(len, blocks)))
    found = {name: float(np.mean(r)) for name, r in ratios.items()}
    mean = float(np.mean(list(found.values())))
    return {name: r / mean for name, r in found.items()}


def fit(documents: DataFrame, where=None, docs_per_language: int = 200, piece: int = 1024, most_languages: int = 500, block: int = 1024) -> Model:
    """Dictionaries of about ``docs_per_language`` pieces of ``piece`` characters each, one or more a text.

    The sample is bounded by the parameters; of more than ``most_languages`` values the commonest are learnt.
    """
    learn = documents.where("text IS NOT NULL AND lang IS NOT NULL")
    learn = (learn if where is None else learn.where(where)).where(F.length("text") > 0)
    counts = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()
    if not counts:
        return Model(block=block)
    rates = documents.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, docs_per_language / r["n"]), piece * max(1, docs_per_language // r["n"])) for r in counts],
        "lang string, _rate double, _most int",
    )
    dice = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) / 1_000_000
    drawn = learn.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where(dice < F.col("_rate"))
    spare = F.greatest(F.lit(1), F.length("text") - F.col("_most") + 1)
    part = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(29)), spare) + 1).cast("int"), F.col("_most"))
    rows = drawn.select("doc_id", "lang", part.cast("binary").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["text"]))
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(folded(r["text"]))
    whole = {lang: b" ".join(p) for lang, p in sorted(parts.items())}
    model = Model({lang: words for lang, words in whole.items() if words.strip()}, block)
    model.baselines = baselines(model)
    return model


class Classifier:
    def __init__(self, model: Model):
        self.names, self.block = sorted(model.dictionaries), model.block
        self.baselines = [model.baselines.get(name, 1.0) for name in self.names]
        self.tools = []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=model.level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False, write_checksum=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[k : k + self.block] for k in range(0, len(text), self.block)]
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self.tools]

    def judge(self, text: bytes) -> tuple[str, float]:
        """Best language and its margin: the share by which the second best quotient is larger."""
        if not self.tools:
            return UNKNOWN, 0.0
        found = [size / base for size, base in zip(self.sizes(folded(text)), self.baselines)]
        order = np.argsort(found, kind="stable")
        best = found[order[0]]
        second = found[order[1]] if len(order) > 1 else best * 2
        return self.names[order[0]], (second - best) / max(1, second)


def predict(documents: DataFrame, model: Model, key: str = "doc_id", narrow: float = 0.005, clear: float = 0.1) -> DataFrame:
    """(key, lang_pred, score, rejected) of every row."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.col(key).alias("_k"), utf8().alias("_t"), letters.alias("_a"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def build():
        tool = Classifier(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [tool.judge(t) if a else (UNKNOWN, 0.0) for t, a in zip(batch["_t"].to_pylist(), batch["_a"].to_pylist())]
            margin = np.array([m for _, m in found])
            columns = [batch["_k"], pa.array([n for n, _ in found], pa.string()), pa.array(np.clip(margin / clear, 0, 1)), pa.array(margin < narrow)]
            return pa.RecordBatch.from_arrays(columns, names=["_k", "lang_pred", "score", "rejected"])

        return run

    kind = documents.schema[key].dataType.simpleString()
    return map_batches(rows, build, f"_k {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_k", key)
