"""Registered queries of the operators, with SQL where it can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lakeops.llm import captures, collocations, cotraining, imatch, language, ledger, linededup, mixing, neardup, packing, toxicity, turntrie, urlglobs
from lakeops.llm.common import fold
from lakeops.plans.registry import Query

QUERIES: dict[str, Query] = {}
TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = Query(name, (), build, sql)
        return build

    return register


@query("op1_best_fit_packing")
def best_fit_packing(t):
    return packing.pack_documents(t.documents, public_tokenizers.path(TOKENIZER))


@query("op2_minhash_near_dedup")
def minhash_near_dedup(t):
    return neardup.group(t.documents, width=2)


def url_case(value: str) -> str:
    cases = " ".join(
        f"WHEN ends_with('.' || host, '.{host}') AND starts_with(path, '/{path}') THEN {value.format(rule=rule, verdict=verdict)}"
        for rule, verdict in sorted(URL_RULES, key=lambda r: -len(r[0]))
        for host, _, path in [rule.partition("/")]
    )
    return f"CASE {cases} END"


@query(
    "op3_url_globs",
    f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlglobs.UPPER}', '{urlglobs.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
      SELECT page_id, host, path, {url_case("'{rule}'")} AS rule, coalesce({url_case("'{verdict}'")}, 'allow') AS verdict FROM p""",
)
def url_globs(t):
    return urlglobs.judge(t.pages, [urlglobs.domain_rule(r, v) for r, v in URL_RULES])


@query("op4_cotraining")
def cotraining_quality(t):
    return cotraining.score(t.documents, cotraining.fit(t.documents, t.labels))


@query("op5_capture_index")
def capture_index(t):
    found = captures.archive_history(t.pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


LEDGER_SQL = (
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      w AS (SELECT r, regexp_extract_all(text, {WORD_SQL}) AS words FROM d),
      g AS (SELECT r, i, list_slice(words, i, i + 7) AS run FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
      twice AS (SELECT r, run FROM g GROUP BY r, run HAVING count(*) > 1),
      covered AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT g.r, unnest(range(i, i + 8)) AS pos FROM g JOIN twice ON g.r = twice.r AND g.run = twice.run) GROUP BY r),
      m AS (SELECT d.r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {WORD_SQL})) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM d JOIN w ON d.r = w.r LEFT JOIN covered c ON c.r = d.r),
      f AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
      v AS (SELECT *, {" + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(ledger.RULES))} AS failed FROM f)
      SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed::BIGINT AS failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM v"""
)


@query("op6_rule_ledger", LEDGER_SQL)
def rule_ledger(t):
    book = ledger.ledger(t.documents)
    base, full = (ledger.policy_mask(ledger.POLICIES[p]) for p in ("base", "full"))
    return book.withColumns({"base_failed": ledger.fails(base), "kept": ~ledger.fails(full)})


@query("op7_imatch")
def imatch_fingerprints(t):
    return imatch.with_neighbours(t.documents)


@query("op8_text_cnn")
def text_cnn(t):
    held = fold("doc_id", 5) == 0
    model = toxicity.fit(t.documents, t.labels, where=~held)
    return toxicity.score(t.documents, model).withColumn("held_out", held)


@query(
    "op9_weighted_mix",
    f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD_SQL}))::BIGINT AS size, length(coalesce(text, '')) AS chars,
        length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{mixing.SYMBOLS}', '')) AS symbols FROM documents),
      k AS (SELECT *, -ln((('0x' || substr(md5('20240229:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE)
        / (1000 - least(900, floor(4000 * symbols / greatest(chars, 1)))) AS key FROM d),
      s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
      p AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
      c AS (SELECT *, 2 * source_size / w AS ratio, sum(2 * source_size) OVER u - 2 * source_size AS stopped, sum(w) OVER () - sum(w) OVER u + w AS open,
        sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM p WINDOW u AS (ORDER BY 2 * source_size / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
      level AS (SELECT (goal - stopped)::DOUBLE / open AS level FROM c WHERE (goal - stopped)::DOUBLE / open <= ratio ORDER BY ratio LIMIT 1),
      g AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, level * w) AS target FROM c, level),
      x AS (SELECT k.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
      e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM x)
      SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - (upto - size))))::BIGINT AS taken FROM e""",
)
def weighted_mix(t):
    return mixing.mix(t.documents).drop("text_hash")


@query("op10_zstd_language")
def zstd_language(t):
    held = fold("doc_id", 3) == 1
    model = language.fit(t.documents, where=~held)
    return language.predict(t.documents, model).withColumn("held_out", held)


@query(
    "op11_line_dedup",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
      k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{urlglobs.UPPER}', '{urlglobs.LOWER}') AS key FROM l),
      f AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key),
      g AS (SELECT k.*, holder IS NOT NULL AND (doc_id IS NULL OR doc_id > holder) AS gone FROM k LEFT JOIN f ON k.key = f.key)
      SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r""",
)
def line_dedup(t):
    return linededup.digest(t.documents)


@query(
    "op12_turn_trie",
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      bytes AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS step),
      ids AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), bytes),
      lent AS (SELECT i.conv_id, pos, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 100 AND pos < h),
      m AS (SELECT conv_id, count(*) AS m FROM lent GROUP BY conv_id),
      r AS (SELECT * FROM lent UNION ALL SELECT t.conv_id, pos - h + coalesce(m, 0), role, text FROM t JOIN ids i ON t.conv_id = i.conv_id LEFT JOIN m ON m.conv_id = t.conv_id WHERE pos >= h),
      p AS (SELECT i.conv_id, list(md5(role) || md5(text) ORDER BY pos) FILTER (pos IS NOT NULL) AS path, list(length(text) ORDER BY pos) FILTER (pos IS NOT NULL) AS chars FROM ids i LEFT JOIN r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
      x AS (SELECT conv_id, d, coalesce(len(path), 0) AS n, md5(array_to_string(path[1:d], ',')) AS node, md5(array_to_string(path[1:d - 1], ',')) AS parent, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS last
        FROM (SELECT *, unnest(range(coalesce(len(path), 0) + 1)) AS d FROM p)),
      n AS (SELECT d, node, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(last) AS last,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM x GROUP BY d, node),
      c AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
      w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.d = c.d AND n.node = c.node),
      s AS (SELECT x.d, x.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.last) AS saved FROM w JOIN x ON x.conv_id = w.conv_id AND x.d <= w.d GROUP BY ALL)
      SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved::BIGINT AS saved_tokens, w.ends_sha256
      FROM w JOIN s ON w.d = s.d AND w.node = s.node LEFT JOIN n u ON w.d = u.d + 1 AND w.parent = u.node""",
)
def turn_trie(t):
    return turntrie.rebuilt_tree(t.conversations)


@query(
    "op13_collocations",
    f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{urlglobs.UPPER}', '{urlglobs.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, piece, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
      x AS (SELECT lang, word AS w1, lead(word, 1) OVER u AS w2, lead(word, 2) OVER u AS w3, lead(word, 3) OVER u AS w4 FROM w WINDOW u AS (PARTITION BY piece ORDER BY pos)),
      g AS (SELECT lang, 1 AS n, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
      f AS (SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL),
      c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE n > 1 AND f >= 30),
      k AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, n)) AS k FROM c) c
        JOIN f l ON l.lang = c.lang AND l.n = k AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.n = c.n - k AND r.phrase = array_to_string(ws[k + 1:], ' ')),
      b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM k),
      s AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, n - m + 2)) AS s FROM c, (VALUES (2), (3)) t(m) WHERE m < n) GROUP BY ALL),
      t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
      o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN s ON b.lang = s.lang AND b.phrase = s.phrase
        WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a))
      SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000""",
)
def phrase_collocations(t):
    return collocations.collocations(t.documents)


CASES = ", ".join(f"('{p}', '{r.name}', {ledger.policy_mask(names)}, {1 << i})" for p, names in ledger.POLICIES.items() for i, r in enumerate(ledger.RULES) if r.name in names)


@query(
    "ledger_ablations",
    f"""WITH book AS ({LEDGER_SQL}), c AS (SELECT * FROM (VALUES {CASES}) v(policy, rule, mask, bit))
      SELECT policy, rule, count(*) FILTER (failed & mask & bit <> 0) AS n_failed, count(*) FILTER (failed & mask <> 0) AS n_rejected,
        count(*) FILTER (failed & mask & ~bit <> 0) AS n_rejected_without, count(*) FILTER (failed & mask = bit) AS n_only FROM book, c GROUP BY policy, rule""",
)
def ledger_ablations(t):
    return ledger.ablations(ledger.ledger(t.documents))
