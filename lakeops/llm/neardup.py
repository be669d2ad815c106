"""Near-duplicate groups by one-permutation MinHash.

A document is the set of its distinct word shingles (A-Z lower-cased); a text with fewer words
than a shingle is one shingle.  Two documents are linked when their sets' Jaccard similarity is
``percent`` / 100 or more, and groups are the connected components of the links.

1. Each set is hashed once into ``bins`` bins, the least hash of each bin is kept, and empty bins
   borrow from the first filled bin in a random order of their own (optimal densification).
   ``rows`` bins make a band key.  Pairs at the similarity bound share no band with a
   probability of (1 - s^rows)^(bins/rows): 3e-6 for the defaults.
2. Documents with equal sets form a class, named by its smallest id; only classes go on.
3. In each bucket of a band one class is the hub and the candidates are a star around it: n
   classes give n - 1 pairs.  Every pair is measured on the full sets, which are made once,
   for the classes that share a bucket with another one.
4. The first stars are around the smallest class of each bucket.  Two members that are not like
   that hub can still be linked, so the buckets that hold different components form stars
   anew, around the first member in an order by hash that changes from round to round and is the
   same in all buckets, and pairs across components are measured until a round finds no link.
   Stars only join what is joined easily.
5. The classes of all buckets that still hold different components are then compared exactly, by
   a prefix filter.  Shingles are put in one order, rare ones first; a set of n shingles can only
   be linked with one of its size or more when they share a shingle among its first
   n - ceil(2s / (1 + s) n) + 1 and the other's first n - ceil(s n) + 1, when their sizes are in
   the same band or neighbouring ones, and when what follows that shingle is enough.  Every such
   pair of different components is measured.

Defined results: null or empty texts have no shingles and are linked with nothing, as are rows
without an id (their component is null, and they are kept).  Rows with the same id count as one
document.  Texts of any length are read whole.  An empty table gives no rows.  Other columns of
the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import map_batches, mixed, shingle_hashes, utf8, word_hashes
from lakeops.operators.graph import component_stars
from lakeops.session import settle

#: Slots in which shingles are counted to put rare ones first: 8 MB on every executor.
SLOTS = 1 << 20


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), width))


class Sketch:
    """One-permutation MinHash of sorted sets, and its band keys."""

    def __init__(self, bins: int, rows: int):
        if bins & (bins - 1):
            raise ValueError("bins must be a power of two")
        self.bins, self.rows, self.used = bins, rows, bins // rows * rows
        self.shift = np.uint64(65 - bins.bit_length())
        order = np.random.default_rng(20240229)
        self.probes = np.stack([order.permutation(bins) for _ in range(bins)])
        self.salts = mixed(np.arange(1, self.used + 1, dtype=np.uint64)).reshape(-1, rows) | np.uint64(1)

    def keys(self, found: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; none for the empty set."""
        if not len(found):
            return np.zeros(0, np.int64)
        place = (found >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        least = np.zeros(self.bins, np.uint64)
        least[place[first]] = found[first]
        if len(first) < self.bins:
            filled = np.zeros(self.bins, bool)
            filled[place[first]] = True
            empty = np.flatnonzero(~filled)
            donors = self.probes[empty]
            least[empty] = least[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
        return mixed((mixed(least[: self.used]).reshape(-1, self.rows) * self.salts).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(documents: DataFrame, width: int, bins: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, keys): the set's size, 128-bit name and band keys."""

    def build():
        sketch = Sketch(bins, rows)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, width) for t in batch["text"].to_pylist()]
            keys = [sketch.keys(s) for s in sets]
            ends = np.cumsum([0, *map(len, keys)])
            return pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "keys"],
            )

        return run

    rows_in = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return map_batches(rows_in, build, "doc_id long, n_shingles long, set_id binary, keys array<long>")


def sets_of(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, n, items): the full sets of the documents whose id is in ``wanted`` (rep)."""

    def build():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, width).view(np.int64) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            return pa.RecordBatch.from_arrays([batch["rep"], sizes, found], names=["rep", "n", "items"])

        return run

    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), utf8().alias("text"))
    return map_batches(texts.join(wanted, "rep", "left_semi"), build, "rep long, n long, items array<long>")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs (a, b), from their full sets; sizes alone settle many."""
    sizes = sets.select("rep", "n").distinct()
    sized = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    of_a, of_b = (sets.select(F.col("rep").alias(k), F.col("items").alias(f"of_{k}")) for k in ("a", "b"))
    both = sized.where(near).select("a", "b").distinct().join(of_b, "b").join(of_a, "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    similar = 100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)
    # Rows of the same id can have several texts: one that is similar links them.
    return both.select("a", "b", similar.alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def group(documents: DataFrame, width: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``."""
    spark = documents.sparkSession
    marked = settle(signatures(documents, width, bins, rows), "neardup-signatures")
    whole = marked.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(whole.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "neardup-classes")
    # The class's row of its smallest id; what repeated rows add is made one by the aggregates below.
    reps = whole.join(classes.withColumnRenamed("rep", "doc_id"), ["set_id", "doc_id"], "left_semi")
    keyed = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    met = keyed.join(shared, "key", "left_semi").groupBy("rep").agg(F.collect_list("key").alias("keys"))  # a key a band
    crowd = settle(met, "neardup-buckets")
    sets = settle(sets_of(documents, crowd.select("rep"), width), "neardup-sets")
    labels = spark.createDataFrame([], "id long, component long")
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    turn, more = 0, True
    while more:
        pairs = stars(crowd, labels, turn).join(tested, ["a", "b"], "left_anti")
        new = settle(measured(pairs, sets, percent), "neardup-pairs")
        tested = tested.unionByName(new)
        links = new.where("linked").select("a", "b")
        more = not links.isEmpty()
        labels = merged(labels, links)
        turn += 1
    pairs = settle(rest(crowd, labels, sets, percent).join(tested, ["a", "b"], "left_anti"), "neardup-rest")
    labels = merged(labels, settle(measured(pairs, sets, percent).where("linked").select("a", "b"), "neardup-links"))
    named = marked.join(classes, "set_id", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linked, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def stars(crowd: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a < b) of different components, each bucket's around its hub.

    In turn 0 the hub is the smallest id.  In later turns it is the first member in an order by
    hash that all buckets share, so buckets of like members have the same hub and the same pairs.
    The hub's component comes along with it.
    """
    known = labels.withColumnRenamed("id", "rep")
    rows = crowd.join(known, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), F.explode("keys").alias("key"))
    place = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
    first = F.min(F.struct(place.alias("place"), F.col("rep").alias("hub"), F.col("component").alias("of_hub"))).alias("first")
    picked = rows.groupBy("key").agg(first, F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
    both = rows.join(picked.select("key", "first.hub", "first.of_hub"), "key").where("component <> of_hub")
    return both.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, near, first): the first shingles of each set in one order, as many as a link can need.

    The first ``near`` of them are enough towards sets of the same size or more.  Rare shingles
    come first, as counted in ``SLOTS`` hashed slots; any order gives the same links.
    """
    slot = F.col("item").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    found = sets.select(F.explode("items").alias("item")).groupBy(slot).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def build():
        counts = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, near, first = batch["n"].to_numpy(), [], []
            items = batch["items"]
            flat, ends = items.values.to_numpy(), items.offsets.to_numpy()
            for n, at in zip(sizes.tolist(), ends):
                own = flat[at : at + n]
                order = np.lexsort((own, counts[own & (SLOTS - 1)]))
                first.append(own[order[: n - -(-percent * n // 100) + 1]])
                near.append(n - -(-2 * percent * n // (100 + percent)) + 1)
            ends = np.cumsum([0, *map(len, first)])
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first), pa.int64()))
            return pa.RecordBatch.from_arrays([batch["rep"], batch["n"], pa.array(near, pa.int64()), packed], names=["rep", "n", "near", "first"])

        return run

    return map_batches(sets.select("rep", "n", "items").where("n > 0"), build, "rep long, n long, near long, first array<long>")


def rest(crowd: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different components that can be linked, of all buckets that hold some."""
    known = labels.withColumnRenamed("id", "rep")
    rows = crowd.join(known, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), F.explode("keys").alias("key"))
    mixed_keys = rows.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    left = settle(rows.join(mixed_keys, "key", "left_semi").select("rep", "component").distinct(), "neardup-open")
    if left.isEmpty():
        return left.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    open_sets = settle(sets.join(left, "rep", "left_semi"), "neardup-open-sets")
    marks = prefixes(open_sets, percent).join(left, "rep").select("rep", "component", "n", "near", F.posexplode("first").alias("at", "item"))
    # Sets that can be linked have sizes in the same band or the next one; the base is a little over
    # 100 / percent, so that rounding cannot put them further apart.
    band = F.floor(F.log(F.col("n")) / math.log(100.0 / percent * 1.001)).cast("int")
    marks = settle(marks.withColumn("band", band), "neardup-prefixes")
    small = marks.where("at < near").select("item", "band", *[F.col(c).alias(f"{c}_s") for c in ("rep", "component", "n", "at")])
    large = marks.select("item", F.explode(F.expr("array(band, band - 1)")).alias("band"), *[F.col(c).alias(f"{c}_l") for c in ("rep", "component", "n", "at")])
    shared = F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l"))  # this shingle and those behind it
    can = (F.col("component_s") != F.col("component_l")) & (F.col("n_s") <= F.col("n_l")) & (F.col("n_s") * 100 >= F.col("n_l") * percent)
    can &= shared * (100 + percent) >= (F.col("n_s") + F.col("n_l")) * percent
    both = small.join(large, (small["item"] == large["item"]) & (small["band"] == large["band"]) & can)
    return both.select(F.least("rep_s", "rep_l").alias("a"), F.greatest("rep_s", "rep_l").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after adding links (a, b); only components that meet are labelled anew."""
    if links.isEmpty():
        return labels
    of_a = labels.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
    of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    tops = links.join(of_a, "a", "left").join(of_b, "b", "left")
    found = component_stars(tops.select(F.coalesce("of_a", "a").alias("src"), F.coalesce("of_b", "b").alias("dst")))
    moved = found.select(F.col("id").alias("component"), F.col("component").alias("to"))
    kept = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return settle(kept.unionByName(found).groupBy("id").agg(F.min("component").alias("component")), "neardup-labels")
