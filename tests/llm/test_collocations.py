"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lakeops.llm import collocations

DOCS = "doc_id long, text string, lang string, n int, f string, word string, a long, `a.b` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "f", "w", 2, 3) for i, (t, g) in enumerate(rows)], DOCS)


def by_hand(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    key = (lang or "und", *words[i : i + size])
                    f[key] = f.get(key, 0) + 1
    often = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for k, a in often.items():
        words = k[1:]
        inside = [f[o] for o in often if o[0] == k[0] and len(o) > len(k) and any(o[i : i + len(words)] == words for i in range(1, len(o)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2_000_000 * a // (f[k[: i + 1]] + f[(k[0], *words[i:])]), i, f[k[: i + 1]], f[(k[0], *words[i:])]) for i in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(k[0], []).append((-score, -a, " ".join(words).encode(), left, right))
    return [
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    ]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_up(dice, size):
    words = [w + e for w in "alpha Beta gamma DELTA épsilon zeta ñu eta theta Ünï iota \x1cx kappa".split(" ") for e in ("", "n", "x'")]
    phrases = ["in the New York", "as well as", "New York stock", "one two three four"]
    return [
        (" ".join(dice.choice(phrases) if dice.random() < 0.2 else dice.choice(words) + dice.choice(["", "", "", ",", ". ", "\n", "\t", "!?"]) for _ in range(dice.randint(0, 60))), dice.choice(["en", "en", "de", None, "und"]))
        for _ in range(size)
    ]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_like_by_hand(spark, monkeypatch, small):
    if small:  # many chunks, filters, quotients and merges
        for name, value in (("CHUNK", 200), ("SORT", 300), ("MERGE", 64)):
            monkeypatch.setattr(collocations, name, value)
    rows = made_up(random.Random(5), 400) + [(None, "en"), ("", "fr"), (" \t.,;\n", None), ("rare words only", "it"), ("again and " * 3000, "la")]
    found = collocations.collocations(docs_of(spark, rows).repartition(7), least=8, top=60)
    assert got(found) == sorted(by_hand(rows, 8, 60))


def test_no_rows(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [("one two", "en"), (None, None)])).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_keys_come_back_and_counts_are_exact(bits):
    keys = collocations.Keys(bits, 9)
    dice = np.random.default_rng(bits)
    words = [dice.integers(0, min(2**bits, 6 if bits > 1 else 2), 5000).astype(np.uint64) * np.uint64(2**bits // 8 or 1) for _ in range(4)]
    left, right = keys.permuted(*keys.pack(words))
    assert left.max() <= keys.mask and right.max() <= keys.mask
    assert all((a == b).all() for a, b in zip(keys.unpack(*keys.restored(left, right)), words))
    one, two, counts = collocations.counted(left, right, None, keys.half, keys.one)
    want = Counter(zip(*[w.tolist() for w in words]))
    back = zip(*[w.tolist() for w in keys.unpack(*keys.restored(one, two))])
    assert dict(zip(back, counts.tolist())) == want
    batch = collocations.filters(keys, one, two, counts)
    merged = []
    for q, *data in zip(*[batch[c].to_pylist() for c in collocations.FILTERS.names]):
        rest, other, often = (collocations.unpacked(d).astype(np.uint64) for d in data)
        merged.append((rest | (np.uint64(q) << keys.shift), other, often))
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*merged), (one, two, counts.astype(np.uint64))))
    twice = collocations.counted(np.tile(one, 2), np.tile(two, 2), np.tile(counts, 2), keys.half, keys.one)
    assert (twice[2] == 2 * counts).all() and (twice[0] == one).all()


def test_bloom_filter_has_no_misses(spark):
    runs = spark.createDataFrame([(i, i * 7 % 1000 + 1) for i in range(1, 3000)], "w1 long, w2 long")
    bloom = collocations.bloom_of(runs, 2)
    own = [np.arange(1, 3000, dtype=np.uint64), np.arange(1, 3000, dtype=np.uint64) * np.uint64(7) % np.uint64(1000) + np.uint64(1)]
    assert collocations.passes(bloom, own).all()
    other = [own[0] + np.uint64(10_000), own[1]]
    assert collocations.passes(bloom, other).mean() < 0.01
