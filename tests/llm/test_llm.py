"""Operators of the llm subpackage against brute force, round trips and held-out rows."""

import hashlib
import os
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeops.llm import captures, cotraining, imatch, language, ledger, mixing, neardup, packing, toxicity, urlglobs
from lakeops.llm.queries import QUERIES, TOKENIZER, URL_RULES
from lakeops.session import scratch_path

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, _size int, key string, `a.b` int"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
ODD = [None, "", " \t\n", "one", "One", "one two", "two one", "<|endoftext|> it's x<|y|>", "Ünïcödé  straße\u0301 ŉ", "12 34 !!", LONG]


def docs_of(spark, rows):
    """(doc_id, text[, source]) rows as documents with columns of clashing names."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, len(r[1] or ""), "s", "k", 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD)]
    return docs_of(spark, [*rows, (None, "no id at all here", "s0"), (5, "one two", "s2"), (5, "one two", "s2")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "pages")}


# Packing


def tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER)).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_keeps_every_token(spark, odd, none):
    found = packing.pack_documents(odd, public_tokenizers.path(TOKENIZER), keep_ids=True).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tokens(r["text"])) for r in odd.collect())
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and 1 <= r["length"] <= 4096
        if r["doc_id"] != 5:
            assert r["start"] == sum(map(len, got.get(r["doc_id"], [])))
            got.setdefault(r["doc_id"], []).append(ids)
    for (has, doc), ids in want:
        if doc != 5:
            assert sum(got[doc if has else None], []) == ids
    assert sum(r["doc_id"] == 5 for r in found) == 3
    ends: dict = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert packing.pack_documents(none, public_tokenizers.path(TOKENIZER)).count() == 0


def test_words_that_end_in_signs_and_marks():
    words = packing.WordIds(public_tokenizers.path(TOKENIZER))
    ends = ["<", ">", "\u201d", "\u00bb", "\u2026", "\u20ac", "\U0001f600", "\u0947", "\u0301", "\u0958", "\u0130", "'", "\u00b2", "e\u0301", "x", "7", "\u3042"]
    texts = [f"{head}{end}{marks}" for head in ("", "foo", "\u0928\u092e\u0938\u094d\u0924") for end in ends for marks in (".", ",", "!", ")", ".)", "")]
    # Every letter and number before a mark, one text each.
    texts += [f"a{c}." for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LN"]
    got = words.ids([t.encode() for t in texts])
    wrong = [t for t, ids in zip(texts, got) if np.frombuffer(ids, "<u4").tolist() != words.tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_best_fit_takes_the_tightest_open_bin():
    assert list(packing.best_fit([6, 7, 3, 2, 2], 10, 8)) == [(0, 0), (1, 0), (1, 7), (0, 6), (0, 8)]
    # One open bin: the fullest closes when a second one would stay open.
    assert list(packing.best_fit([6, 7, 3, 4], 10, 1)) == [(0, 0), (1, 0), (0, 6), (2, 0)]
    dice = random.Random(3)
    lengths = [dice.randint(1, 100) for _ in range(20_000)]
    bins = 1 + max(b for b, _ in packing.best_fit(lengths, 100, 64))
    assert bins < 1.02 * sum(lengths) / 100


# Near copies


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_groups(rows, width, percent=80):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def test_near_copies_match_brute_force(spark, odd, none):
    dice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [dice.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [dice.choice(vocabulary) for _ in range(dice.choice([3, 12, 60, 200]))]
        for _ in range(dice.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(int(len(copy) * dice.choice([0, 0.02, 0.05, 0.1, 0.3]))):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            rows.append(" ".join(common + copy if dice.random() < 0.3 else copy))
    rows = [(i + 100, t) for i, t in enumerate(rows)]
    rows += [(i, t) for i, t in enumerate(ODD)]
    dice.shuffle(rows)
    for width in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.group(docs_of(spark, rows), width).collect()}
        assert got == brute_groups(rows, width)
    again = neardup.group(odd, 2).collect()
    assert len(again) == odd.count()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in again if r["doc_id"] in (None, 0, 5)} == {(None, None, True), (0, 0, True), (5, 5, True)}
    assert neardup.group(none).count() == 0


def test_large_group_of_copies(spark):
    base = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(base[:i] + [f"y{i}"] + base[i + 1 :])) for i in range(120)]
    rows += [(2000 + i, " ".join(base[:40] + [f"z{i}_{j}" for j in range(80)])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.group(docs_of(spark, rows), 2).collect()}
    assert all(got[d] == (0 if d < 2000 else d) for d, _ in rows)


def test_links_within_a_loosely_similar_family(spark):
    # 300 members are 0.72 alike, less than a link; every second one is 0.802 like the one before.
    common, rows = [f"c{i}" for i in range(84)], []
    for i in range(0, 300, 2):
        twins = [f"t{i}_{j}" for j in range(5)]
        for d in (i, i + 1):
            rows.append((d, " ".join(common + twins + [f"o{d}_{j}" for j in range(11)])))
    # And a chain in which each member is like the next one only.
    chain = [f"k{i}" for i in range(160)]
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 40])) for i in range(31)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.group(docs_of(spark, rows), 1).collect()}
    assert got == brute_groups(rows, 1)
    assert all(got[d][1] == d // 2 * 2 for d in range(300))


# URL rules


def test_globs():
    globs = ["*.example.net/en/**", "**.zip", "*.a?c.org/*/x", "**", "*.y" * 40 + "/**"]
    urls = [b"", b".example.net/en/", b".m.example.net/en/a.zip", b".xexample.net/en/", b".example.net/en", b".abc.org/q/x", b".abc.org/q/r/x", b".a/c.org/q/x", b".y" * 41 + b"/z"]
    got = urlglobs.Automaton(globs).hits(urls)
    want = [[0, 0, 0, 1, 0], [1, 0, 0, 1, 0], [1, 1, 0, 1, 0], [0, 0, 0, 1, 0], [0, 0, 0, 1, 0], [0, 0, 1, 1, 0], [0, 0, 0, 1, 0], [0, 0, 0, 1, 0], [0, 0, 0, 1, 1]]
    assert got.astype(int).tolist() == want
    assert urlglobs.Automaton(["**x"]).hits([b"a" * 300_000 + b"x"]).tolist() == [[True]]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET", "http://net/", "https://A.Example.NET/en/x?q", "http://example.net/enx", "x://org/fr/#a", "a://b://net/", "http://example.com/de/1", "http://xnet/a", "http://net:80/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    rules = [urlglobs.domain_rule(r, v) for r, v in URL_RULES]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlglobs.judge(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "", None, "allow") and got[4] == ("net", "/", "net/", "block")
    assert got[5] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[6] == ("example.net", "/enx", "net/", "block")
    assert got[7] == ("org", "/fr/", "org/fr/", "allow") and got[8] == ("b:", "//net/", None, "allow")
    assert got[9][2:] == ("example.com/de/", "block") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert {r["verdict"] for r in urlglobs.judge(pages, []).collect()} == {"allow"}
    assert urlglobs.judge(pages.limit(0), rules).count() == 0


# Rule ledger


def brute_measure(text):
    text = text or ""
    words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    lines = [x for x in text.split("\n") if any(w for w in x.translate({c: " " for c in range(9, 14)}).split(" "))]
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def test_ledger_matches_brute_force(spark, odd, none):
    texts = [*ODD, "a b c d e f g h " * 3, "x y\nx y\n\nx y \n#$ <>", "p q r s t u v w x p q r s t u v w"]
    rows = [(i, t) for i, t in enumerate(texts)]
    book = ledger.ledger(docs_of(spark, rows))
    got = {r["doc_id"]: tuple(r[m] for m in ledger.MEASURES) for r in book.collect()}
    assert got == {i: brute_measure(t) for i, t in rows}
    found = {(r["policy"], r["rule"]): r for r in ledger.ablations(book).collect()}
    failed = [r["failed"] for r in book.collect()]
    for policy, names in ledger.POLICIES.items():
        mask = ledger.policy_mask(names)
        for name in names:
            bit, r = ledger.policy_mask([name]), found[policy, name]
            assert r["n_failed"] == sum(f & bit != 0 for f in failed) and r["n_rejected"] == sum(f & mask != 0 for f in failed)
            assert r["n_rejected_without"] == sum(f & mask & ~bit != 0 for f in failed) and r["n_only"] == sum(f & mask == bit for f in failed)
    assert ledger.ledger(odd).count() == odd.count() and ledger.ledger(none).count() == 0


# Fingerprints


def test_fingerprints_and_edited_texts(spark, odd, none):
    dice = random.Random(7)
    words = [f"t{i}" for i in range(60)]
    rows = [(i * 3, " ".join(dice.choice(words) for _ in range(dice.randint(1, 80)))) for i in range(80)]
    rows[40] = (rows[40][0], rows[10][1])
    rows += [(-1, None), (-2, ""), (1000, "ä" * 7)]
    got = {r["doc_id"]: r for r in imatch.with_neighbours(docs_of(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (after or "")[:half]
        assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc]["near_next"] <= 1 and (edited != text or got[doc]["near_edited"] == 1)
    assert got[rows[40][0]]["fingerprint"] == got[rows[10][0]]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])
    plain = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs_of(spark, rows)).collect()}
    assert all(plain[d] == r["fingerprint"] for d, r in got.items())
    assert imatch.with_neighbours(odd).count() == odd.count() and imatch.with_neighbours(none).count() == 0


# Mixing


def test_mixture_fills_targets(spark, odd, none):
    dice = random.Random(9)
    rows = [(i, "w " * dice.randint(0, 40) + dice.choice(["", "#$%"]), dice.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    source = {d: s for d, _, s in rows}
    sizes: dict = {}
    for r in got:
        sizes.setdefault(source[r["doc_id"]], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for some in sizes.values():
        assert sum(r["taken"] for r in some) == int(some[0]["target"]) and some[0]["source_size"] == sum(r["size"] for r in some)
    goal = 1.5 * sum(r["size"] for r in got)
    assert abs(sum(some[0]["target"] for some in sizes.values()) - goal) < 1e-6 * goal
    assert sorted(mixing.mix(docs).collect()) == sorted(got)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    counts = {r["doc_id"]: r["w"] for r in made.groupBy("doc_id").agg(F.sum(mixing.word_count()).alias("w")).collect()}
    assert counts == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mix(odd).count() == odd.count() and mixing.mixed(odd).count() > 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# Classifiers


@needs_data
def test_toxicity_on_held_out_rows(spark, odd, none, tables):
    found = QUERIES["op8_text_cnn"](spark, SF).where("held_out").join(tables["labels"], "doc_id").collect()
    toxic = [r["score"] for r in found if r["toxic"] == 1]
    clean = [r["score"] for r in found if r["toxic"] == 0]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.93
    model = toxicity.fit(tables["documents"], tables["labels"], epochs=1)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.clean(odd, model).columns == odd.columns
    blank = toxicity.fit(tables["documents"], tables["labels"].limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, blank).collect()} == {0}
    assert toxicity.fit(none, tables["labels"]).filters == []


@needs_data
def test_quality_on_rows_not_learnt(spark, odd, none, tables):
    learn = tables["labels"].where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0)
    model = cotraining.fit(tables["documents"], learn)
    rest = cotraining.score(tables["documents"], model).join(tables["labels"].join(learn, "doc_id", "left_anti"), "doc_id").collect()
    good = [r["kept"] for r in rest if r["quality"] == 1]
    bad = [r["kept"] for r in rest if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert cotraining.good(odd, model).columns == odd.columns and cotraining.score(none, model).count() == 0
    assert cotraining.score(odd.drop("lang", "source"), model).count() == odd.count()
    blank = cotraining.fit(tables["documents"], tables["labels"].limit(0))
    assert {r["kept"] for r in cotraining.score(odd, blank).collect()} == {True}


@needs_data
def test_quality_rejects_low_quality_in_spite_of_mislabelled_rows(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    # Every fortieth of the low-quality rows learnt from is labelled good.
    odd = (F.col("quality") == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(40)) == 0)
    learn = labels.where(fold != 0).withColumn("quality", F.when(odd, 1).otherwise(F.col("quality")))
    model = cotraining.fit(docs, learn)
    rest = cotraining.score(docs, model).join(labels.where(fold == 0), "doc_id").collect()
    assert np.mean([r["kept"] for r in rest if r["quality"] == 0]) < 0.1
    assert np.mean([r["kept"] for r in rest if r["quality"] == 1]) > 0.95


def test_quality_threshold_weighs_both_errors():
    scores = np.concatenate([np.linspace(0.6, 0.99, 1000), [0.001, 0.002, 0.003], np.linspace(0.01, 0.4, 300)])
    y = np.concatenate([np.ones(1003), np.zeros(300)])
    assert 0.4 < cotraining.best_threshold(scores, y, 2.0, 1.0) < 0.6


@needs_data
def test_language_on_held_out_rows(spark, odd, none, tables):
    found = QUERIES["op10_zstd_language"](spark, SF).where("held_out").join(tables["documents"], "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in found)
    model = language.fit(tables["documents"])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[9] == "und" and got[3] != "und" and got[10] != "und"
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


@needs_data
def test_language_with_a_label_of_a_single_row(spark, tables):
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    docs = tables["documents"]
    even = language.fit(docs, where=~held)
    short = docs.where(~held & F.col("lang").isNotNull()).orderBy(F.length("text"), "doc_id").limit(1).withColumn("lang", F.lit("mistyped"))
    model = language.fit(docs.where(~held).unionByName(short))
    sizes = {lang: len(words) for lang, words in model.dictionaries.items()}
    assert all(sizes[lang] >= 0.9 * len(words) > 8192 for lang, words in even.dictionaries.items()), sizes
    found = language.predict(docs.where(held & F.col("lang").isNotNull()), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    # A true language of one long row is found, too.
    dice = random.Random(13)
    words = ["".join(dice.choice("qxzwkvyj") for _ in range(dice.randint(3, 9))) for _ in range(150)]
    texts = [" ".join(dice.choice(words) for _ in range(200)) for _ in range(20)]
    own = docs.limit(1).select(F.lit(-1).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(texts[0]).alias("text"), F.lit("rare").alias("lang"))
    model = language.fit(docs.where(~held).select("doc_id", "text", "lang").unionByName(own))
    rare = language.predict(docs_of(spark, list(enumerate(texts[1:]))), model).collect()
    assert np.mean([r["lang_pred"] == "rare" for r in rare]) > 0.95
    found = language.predict(docs.where(held & F.col("lang").isNotNull()), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95


# Archives


def test_archives_round_trip(spark):
    big, other = "<p>ä</p>" * 200 + "\r\n\r\nWARC/1.1\r\n", "x" * 1000
    rows = [(0, "http://b.org/x", big), (1, None, None), (2, "http://a.org/y?z#f", big), (3, "HTTP://B.org/x", "small"), (4, "u\r\nX: y", "small"), (5, "http://b.org/x", big), (5, "http://b.org/x", big), (6, "", other), (7, "http://a.org/", other), (None, "n", other), (8, "http://c.org", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = scratch_path(spark, "warc-test")
    captures.write(pages, path, archive_bytes=4000)
    runs = captures.read(spark, path)
    found = captures.resolved(captures.history(runs, range_rows=3)).collect()
    assert len(found) == len(rows) and len({r["archive"] for r in found}) > 1
    html = {d: h or "" for d, _, h in rows}
    for r in found:
        data = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
    refers = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found}
    assert refers[0] == refers[2] == ("revisit", 5) and refers[5] == ("response", None) and refers[6] == ("revisit", 7)
    assert all(refers[d] == ("response", None) for d in (1, 3, 4, 7, 8, None))
    order = [(r["url_key"].encode(), r["captured"]) for r in sorted(found, key=lambda r: r["place"])]
    assert order == sorted(order) and len({r["place"] for r in found}) == len(rows)
    assert captures.archive_history(pages.limit(0)).count() == 0


def test_archives_of_repeated_and_missing_ids(spark):
    a, b = "a" * 1500, "b" * 1500
    pages = spark.createDataFrame([(1, "http://x/1", a), (1, "http://x/1", b), (7, "http://x/7", a), (8, "http://x/8", b)], "page_id long, url string, html string")
    found = {(r["page_id"], r["payload_digest"]): (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in captures.archive_history(pages).collect()}
    of = {t: hashlib.sha1(t.encode()).hexdigest() for t in (a, b)}
    assert found == {(1, of[a]): ("revisit", 7, 1500), (1, of[b]): ("revisit", 8, 1500), (7, of[a]): ("response", None, 1500), (8, of[b]): ("response", None, 1500)}
    (own,) = captures.archive_history(pages.where(F.col("page_id") == 1).where(F.col("html") == b)).collect()
    assert own["record_type"] == "response" and own["payload_bytes"] == 1500
    path = scratch_path(spark, "warc-null")
    captures.write(spark.range(4000).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://x/").alias("url"), F.lit("y" * 400).alias("html")), path, archive_bytes=400_000)
    sizes = [r["count"] for r in captures.read(spark, path).groupBy("archive").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1200


def test_loser_tree():
    dice = random.Random(11)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(((dice.randint(0, 9), i, j), (i, j)) for j in range(dice.randint(0, 20))) for i in range(k)]
        assert list(captures.merge(runs)) == [v for _, v in sorted(x for r in runs for x in r)]


# Pipeline


@needs_data
def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(0)).withColumn("kept", F.lit(False))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0.6 * counts[0]
