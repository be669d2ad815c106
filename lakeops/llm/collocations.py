"""Collocations: phrases of 2 to 4 words that occur together more than their parts do apart.

A text is cut into pieces at ``. , ; : ! ?`` and U+000A to U+000D, a piece into words at space and
U+0009, A-Z lower-cased.  Everything is counted per language.  Phrases with ``least`` occurrences or
more are scored at their worst cut, floor(2 * 10^6 * a / (l + r)) for a occurrences of the phrase and
l and r of its two parts.  Those that a longer one explains (``cover`` percent of their occurrences)
are dropped, and the first ``top`` of each language are returned.

1. Texts become chunks of about ``CHUNK`` words: a list of their words with counts, and codes into it.
2. A word below ``least`` is in no phrase, so it becomes a gap.  The others get a number each, per
   language, which a chunk learns by a join of its word list: no word list is broadcast.
3. Runs of n numbers are packed into one key of 4 b bits, b for a number.  An invertible permutation
   (a Feistel network on its halves) spreads the keys evenly; its first bits are the quotient, the rest
   the remainder.  A counting quotient filter is the sorted list of remainders and counts of each
   quotient.  Nothing of the key is lost, so counts are exact.
4. Every task builds the filters of its chunks.  Filters of the same quotient meet in one place, in
   order, and are merged there one after another; keys below ``least`` go.  The number of quotients
   grows with the number of words, so a merge holds about ``MERGE`` keys.  A frequent key is one entry
   of each filter, whatever its count.
5. Lengths are counted in turn, 2 to 4.  A run can only reach ``least`` if both runs it is made of do,
   which a Bloom filter of fixed size (``BLOOM`` bits) tells in the tasks; keys it lets through by
   mistake are counted and go with the rest.

Defined results: null texts are empty, a null language is ``und``, together with rows that say so.
Rows without an id count like all others, repeated rows each time.  Texts are read whole, longer than
a chunk or not; a run never ends at the end of a chunk.  Ties are in the order of the result, so it
has no other order to choose.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import BATCH_ROWS, mixed, utf8
from lakeops.operators.ordered import row_numbers, top_k
from lakeops.session import settle

MOST_WORDS = 4
#: Words of a chunk, keys that a task sorts at a time, and keys that a merge is planned for.
CHUNK, SORT, MERGE = 1 << 18, 1 << 20, 1 << 17
#: Chunks or filters handed to a Python worker at a time.
FEW = "8"
#: Bits of the filter of frequent runs: 4 MB, whatever the input.
BLOOM = 1 << 25
#: Separators become 0xFF, which UTF-8 never has; a tab is a space.
CUTS = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


class Codes(dict):
    """word -> code, in the order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class Chunk:
    """Words of one language in a task: their codes, 0 between pieces."""

    def __init__(self):
        self.codes = Codes()
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.lower().translate(CUTS).replace(b"\xff", b" \xff ").split()
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words)

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        found = np.concatenate(self.parts)
        counts = np.bincount(found, minlength=len(self.codes))[1:]
        return list(self.codes)[1:], counts, found.astype(np.uint32 if len(self.codes) >= 1 << 16 else np.uint16).tobytes()


def chunks_of(documents: DataFrame) -> DataFrame:
    """(chunk, lang, words, counts, wide, codes): the chunks of all tasks."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("wide", pa.bool_()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[str, Chunk] = {}
        number = TaskContext.get().partitionId() << 32

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            chunk = open_chunks.pop(lang)
            words, counts, codes = chunk.row()
            row = [[number], [lang], [words], [counts.tolist()], [len(chunk.codes) >= 1 << 16], [codes]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                chunk = open_chunks.setdefault(lang, Chunk())
                chunk.add(text)
                if chunk.size >= CHUNK:
                    yield closed(lang)
            # However many languages there are, no more than a few chunks' words are held.
            while sum(c.size for c in open_chunks.values()) > 4 * CHUNK:
                yield closed(max(open_chunks, key=lambda g: open_chunks[g].size))
        for lang in list(open_chunks):
            yield closed(lang)

    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8().alias("text"))
    return rows.mapInArrow(run, "chunk long, lang string, words array<binary>, counts array<long>, wide boolean, codes binary")


class Keys:
    """Packed runs of word numbers of ``bits`` bits, and the permutation of their keys.

    A key has two halves of 2 * bits bits: numbers 1 and 2, numbers 3 and 4; 0 is no word.
    """

    def __init__(self, bits: int, quotient: int):
        if bits > 32:
            raise ValueError("more than 2^32 frequent words")
        self.bits, self.quotient = np.uint64(bits), max(1, min(quotient, 2 * bits))
        self.half = np.uint64(2 * bits)
        self.mask = np.uint64((1 << 2 * bits) - 1)
        self.shift = np.uint64(2 * bits - self.quotient)
        self.one = 4 * bits <= 64  # both halves fit into one word

    def pack(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        padded = [*numbers, *[np.zeros_like(numbers[0])] * (MOST_WORDS - len(numbers))]
        return (padded[0] << self.bits) | padded[1], (padded[2] << self.bits) | padded[3]

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << int(self.bits)) - 1)
        return [left >> self.bits, left & low, right >> self.bits, right & low]

    def rounds(self, half: np.ndarray, step: int) -> np.ndarray:
        return mixed(half * np.uint64(2) + np.uint64(1) + (np.uint64(step) << np.uint64(60))) & self.mask

    def permuted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for step in (1, 2):
            left = left ^ self.rounds(right, 2 * step)
            right = right ^ self.rounds(left, 2 * step + 1)
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for step in (2, 1):
            right = right ^ self.rounds(left, 2 * step + 1)
            left = left ^ self.rounds(right, 2 * step)
        return left, right


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: np.uint64, one: bool):
    """Sorted distinct keys and their summed counts."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    if one:
        key = (left << half) | right
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        left, right = key[new] >> half, key[new] & ((np.uint64(1) << half) - np.uint64(1))
        total = len(key)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        total = len(left)
        left, right = left[new], right[new]
    sums = np.diff(new, append=total) if counts is None else np.add.reduceat(counts, new)
    return left, right, sums.astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Values in the fewest whole bytes that hold them all; the first byte says how many."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


FILTERS = pa.schema([("quotient", pa.int64()), ("lefts", pa.binary()), ("rights", pa.binary()), ("counts", pa.binary())])


def filters(keys: Keys, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of a counting quotient filter: for each quotient its remainders, sorted, and their counts.

    ``left`` and ``right`` are halves of permuted keys in order; the first bits of the left one are
    the quotient and not stored.
    """
    quotient = left >> keys.shift
    starts = np.flatnonzero(np.concatenate([[True], quotient[1:] != quotient[:-1]]))
    ends = np.append(starts[1:], len(quotient))
    rest = left & ((np.uint64(1) << keys.shift) - np.uint64(1))
    rows = [quotient[starts].astype(np.int64), *[[packed(v[a:b]) for a, b in zip(starts, ends)] for v in (rest, right, counts)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, FILTERS)], schema=FILTERS)


def runs_of(numbers: np.ndarray, n: int) -> list[np.ndarray]:
    """The n columns of all runs of ``n`` numbers without a 0."""
    size = len(numbers) - n + 1
    if size < 1:
        return [numbers[:0]] * n
    parts = [numbers[i : size + i] for i in range(n)]
    whole = parts[0] > 0
    for p in parts[1:]:
        whole = whole & (p > 0)
    at = np.flatnonzero(whole)
    return [p[at] for p in parts]


def bloom_places(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the Bloom filter for each run."""
    h = np.full(len(parts[0]), np.uint64(len(parts)))
    for p in parts:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h & np.uint64(BLOOM - 1), (h >> np.uint64(32)) & np.uint64(BLOOM - 1)


def passes(bloom: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(parts[0]), bool)
    for place in bloom_places(parts):
        found &= (bloom[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def numbered_chunks(chunks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(numbers): the chunks' words as 4-byte numbers, 0 for gaps.  ``frequent`` has (lang, word, number)."""
    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    known = listed.join(frequent, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "number")).alias("known"))  # one chunk's words
    both = chunks.select("chunk", "wide", "codes", F.size("words").alias("n_words")).join(known, "chunk")
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                places = np.zeros(batch["n_words"][i].as_py() + 1, np.uint32)
                known = batch["known"][i].values
                places[known.field("at").to_numpy() + 1] = known.field("number").to_numpy()
                codes = np.frombuffer(batch["codes"][i].as_py(), np.uint32 if batch["wide"][i].as_py() else np.uint16)
                numbers = places[codes]
                # Gaps in a row are one gap.
                stay = numbers > 0
                stay[1:] |= numbers[:-1] > 0
                out.append(numbers[stay].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["numbers"])

    return both.mapInArrow(run, "numbers binary")


def frequent_runs(chunks: DataFrame, n: int, bits: int, quotient: int, least: int, bloom: np.ndarray | None) -> DataFrame:
    """(w1..w4, f) of the runs of n numbers with ``least`` occurrences or more, w being 0 behind them."""
    spark = chunks.sparkSession
    shared = None if bloom is None else spark.sparkContext.broadcast(bloom)  # BLOOM bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(bits, quotient)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sorted_filters() -> pa.RecordBatch:
            left, right = (np.concatenate(h) for h in zip(*held))
            return filters(keys, *counted(left, right, None, keys.half, keys.one))

        for batch in batches:
            for data in batch["numbers"].to_pylist():
                parts = runs_of(np.frombuffer(data, np.uint32).astype(np.uint64), n)
                if shared is not None and len(parts[0]):
                    both = passes(shared.value, parts[:-1]) & passes(shared.value, parts[1:])
                    parts = [p[both] for p in parts]
                if len(parts[0]):
                    held.append(keys.permuted(*keys.pack(parts)))
                    size += len(parts[0])
                if size >= SORT:
                    yield sorted_filters()
                    held, size = [], 0
        if size:
            yield sorted_filters()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(bits, quotient)
        # The filters of the quotient at hand, merged whenever they pass twice the size after the last merge.
        at, held, size, limit = None, [], 0, SORT

        def merged():
            return counted(*(np.concatenate(h) for h in zip(*held)), keys.half, keys.one)

        def finished() -> pa.RecordBatch:
            left, right, counts = merged()
            often = counts >= least
            words = keys.unpack(*keys.restored(left[often], right[often]))
            return pa.RecordBatch.from_arrays([*[pa.array(w.astype(np.int64)) for w in words], pa.array(counts[often])], names=["w1", "w2", "w3", "w4", "f"])

        for batch in batches:
            for q, *data in zip(*[batch[c].to_pylist() for c in FILTERS.names]):
                if q != at:
                    if held:
                        yield finished()
                    at, held, size, limit = q, [], 0, SORT
                left, right, counts = (unpacked(d) for d in data)
                held.append((left.astype(np.uint64) | (np.uint64(q) << keys.shift), right.astype(np.uint64), counts.astype(np.int64)))
                size += len(left)
                if size >= limit:
                    held = [merged()]
                    size = len(held[0][0])
                    limit = max(SORT, 2 * size)
        if held:
            yield finished()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FEW)
    made = chunks.mapInArrow(build, "quotient long, lefts binary, rights binary, counts binary")
    dealt = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "quotient").sortWithinPartitions("quotient")
    return dealt.mapInArrow(merge, "w1 long, w2 long, w3 long, w4 long, f long")


def bloom_of(runs: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of the runs of ``n`` words: bits set in the tasks, 64 of them a row."""
    runs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(bloom_places([batch[f"w{i + 1}"].to_numpy().astype(np.uint64) for i in range(n)])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found // 64), pa.array(np.left_shift(np.int64(1), found % 64))], names=["word", "bit"])

    rows = runs.select(*[f"w{i + 1}" for i in range(n)]).mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.toArrow()  # at most BLOOM / 64 rows
    out = np.zeros(BLOOM // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def phrase_counts(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, number, f), runs (n, w1..w4, f) and words per language (lang, n)."""
    chunks = settle(chunks_of(documents), "collocation-chunks")
    counts = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    counts = settle(counts, "collocation-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    often = settle(row_numbers(counts.where(F.col("f") >= least), [], ["lang", "word"], "number"), "collocation-numbers")
    size = often.agg(F.count("*").alias("words"), F.sum("f").alias("f")).first()
    bits = max(1, int(size["words"]).bit_length())
    quotient = max(0, int((size["f"] or 0) // MERGE).bit_length())
    numbers = settle(numbered_chunks(chunks, often.select("lang", "word", "number")), "collocation-chunk-numbers")
    found, bloom = [], None
    for n in range(2, MOST_WORDS + 1):
        runs = settle(frequent_runs(numbers, n, bits, quotient, least, bloom), f"collocation-runs-{n}")
        bloom = bloom_of(runs, n) if n < MOST_WORDS else None
        found.append(runs.withColumn("n", F.lit(n)))
    return often, found[0].unionByName(found[1]).unionByName(found[2]), totals


def collocations(documents: DataFrame, least: int = 30, cover: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    words, runs, totals = phrase_counts(documents, least)
    single = words.select(F.lit(1).alias("n"), F.col("number").alias("w1"), *[F.lit(0).cast("long").alias(f"w{i}") for i in (2, 3, 4)], "f")
    counts = settle(runs.unionByName(single), "collocation-counts")
    run = [f"w{i}" for i in range(1, MOST_WORDS + 1)]
    phrases = counts.where("n > 1")

    def part(of: str, start: str, size: str):
        """Words start .. start + size - 1 of the run, with 0 behind them."""
        return [F.expr(f"CASE WHEN {i} < {size} THEN get(array({', '.join(f'{of}{w}' for w in run)}), {start} + {i}) ELSE 0L END") for i in range(MOST_WORDS)]

    cut = phrases.select("n", *run, F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cut = cut.select("*", *[c.alias(f"l_{w}") for c, w in zip(part("", "0", "k"), run)], *[c.alias(f"r_{w}") for c, w in zip(part("", "k", "(n - k)"), run)])
    for side in ("l", "r"):
        of = counts.select(*[F.col(w).alias(f"of_{w}") for w in run], F.col("f").alias(side))
        on = F.lit(True)
        for w in run:
            on &= F.col(f"{side}_{w}") == F.col(f"of_{w}")
        cut = cut.join(of, on).drop(*[f"of_{w}" for w in run])
    # The product may pass 64 bits: it is taken in decimals.
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) AS DECIMAL(30,0)) DIV CAST(CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)) AS DECIMAL(20,0))")
    scored = cut.withColumn("score", score.cast("long"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = scored.groupBy("n", *run, "a").agg(worst).select("n", *run, "a", "cut.score", "cut.l", "cut.r")

    spans = F.expr("filter(flatten(transform(sequence(2, n - 1), m -> transform(sequence(0, n - m), s -> struct(m AS m, s AS s)))), x -> x.m >= 2)")
    longer = phrases.where("n > 2").select(*run, F.col("f").alias("longer"), F.explode(spans).alias("x")).select(
        *run, "longer", F.col("x.s").alias("s"), F.col("x.m").alias("m")
    )
    held = longer.select("longer", *[c.alias(f"of_{w}") for c, w in zip(part("", "s", "m"), run)]).groupBy(*[f"of_{w}" for w in run]).agg(F.max("longer").alias("longer"))
    on = F.lit(True)
    for w in run:
        on &= F.col(w) == F.col(f"of_{w}")
    kept = scored.join(held, on, "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {cover}")

    named = kept.select(F.monotonically_increasing_id().alias("row"), *run, "a", "l", "r", "score")
    named = settle(named, "collocation-kept")
    spelt = named.select("row", F.posexplode(F.array(*run)).alias("at", "number")).where("number > 0").join(words.select("number", "lang", "word"), "number")
    spelt = spelt.groupBy("row").agg(F.first("lang").alias("lang"), F.array_join(F.expr("transform(array_sort(collect_list(struct(at, word))), x -> CAST(x.word AS STRING))"), " ").alias("phrase"))
    ranked = top_k(named.join(spelt, "row"), ["lang"], ["-score", "-a", "phrase"], top, "rank").join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
