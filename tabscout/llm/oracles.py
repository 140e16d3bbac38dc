"""DuckDB twins of the corpus queries, where SQL can express them."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_HASHES = """list_transform(
    CASE WHEN len({words}) = 0 THEN []
         WHEN len({words}) < 5 THEN [array_to_string({words}, ' ')]
         ELSE list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' ')) END,
    lambda s: substr(md5(s), 1, 16))"""
_SKETCH = """CASE WHEN len(list_filter({h}, lambda x: x < '200000000000')) > 0
         THEN list_sort(list_distinct(list_filter({h}, lambda x: x < '200000000000')))
         WHEN len({h}) > 0 THEN [list_min({h})] ELSE [] END"""
_NEAR = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0
         ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"""
_PART = "CASE WHEN len({a}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len({a}) END"

_FINGERPRINTS = f"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
    SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM plain
),
edits AS (
    SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM following
),
split AS (SELECT *, {_WORDS.format(text="text")} AS w, {_WORDS.format(text="edited")} AS ew FROM edits),
hashed AS (SELECT doc_id, text, edited, {_HASHES.format(words="w")} AS h, {_HASHES.format(words="ew")} AS eh FROM split),
sketched AS (SELECT doc_id, text, edited, {_SKETCH.format(h="h")} AS s, {_SKETCH.format(h="eh")} AS es FROM hashed),
paired AS (
    SELECT *, coalesce(lead(s) OVER (ORDER BY doc_id, text), first_value(s) OVER (ORDER BY doc_id, text)) AS ns FROM sketched
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '.') AS fingerprint,
    array_to_string(es, '.') AS edited_fingerprint, {_NEAR.format(a="s", b="es")} AS near_edited, {_NEAR.format(a="s", b="ns")} AS near_next,
    {_PART.format(a="s", b="es")} AS contained_edited, {_PART.format(a="s", b="ns")} AS contained_next
FROM paired
"""

# The twin states its own notices, and two licences by the digest of their canonical text.
_NOTICES = (
    ("licensed under the apache license version 2 0", "Apache-2.0"),
    ("licensed under the apache license version 2 0 the license", "Apache-2.0"),
    ("released under the mit license", "MIT"),
    ("licensed under the mit license", "MIT"),
    ("this work is licensed under the gnu general public license version 3", "GPL-3.0-only"),
    ("this work is licensed under the gnu general public license version 2", "GPL-2.0-only"),
    ("licensed under cc by 4 0", "CC-BY-4.0"),
    ("licensed under cc by sa 4 0", "CC-BY-SA-4.0"),
    ("licensed under cc by nc 4 0", "CC-BY-NC-4.0"),
    ("released under cc0 1 0", "CC0-1.0"),
    ("spdx license identifier apache 2 0", "Apache-2.0"),
    ("spdx license identifier mit", "MIT"),
    ("spdx license identifier gpl 3 0 only", "GPL-3.0-only"),
)
_PLAIN = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
for _found, _put in (
    ("©", "(c)"),
    ("&", " and "),
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
):
    _PLAIN = f"replace({_PLAIN}, '{_found}', '{_put}')"
_OWNER = (
    r"^(portions )?(copyright (c|[0-9]{4}|year|yyyy|by|the regents)|c (copyright )?([0-9]{4}|year|yyyy))( .*)?$|^all rights reserved( .*)?$"
)
_PLAIN = (
    f"trim(regexp_replace(translate({_PLAIN}, '“”‘’«»‐–—', '         '), "
    + r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')"
)
_CASES = " ".join(f"WHEN '{line}' THEN '{name}'" for line, name in _NOTICES)
_LICENSES = (
    "WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), "
    + f"lambda l: regexp_replace({_PLAIN}, '{_OWNER}', '')), lambda l: l <> '') AS ls FROM documents), "
    + f"found AS (SELECT doc_id, array_to_string(ls, ' ') AS whole, "
    + f"list_filter(list_transform(ls, lambda l: CASE l {_CASES} END), lambda n: n IS NOT NULL) AS n FROM lines) "
    + "SELECT doc_id, CASE WHEN whole <> '' THEN md5(whole) END AS canonical_digest, length(whole)::BIGINT AS canonical_chars, "
    + "CASE md5(whole) WHEN '90a17991c3ba7b04d183a6467fbe3449' THEN 'MIT' WHEN '11126b2fe3260ba89f3cc1853190e911' THEN 'Apache-2.0' END AS license, "
    + "array_to_string(list_sort(list_distinct(n)), ',') AS notices, len(n)::BIGINT AS n_notice_lines FROM found"
)

_ROUND = """,
{new} AS MATERIALIZED (
    SELECT c.* REPLACE (weight * coalesce(t_{d} * total / nullif(sum(tokens * weight) OVER (PARTITION BY {d}), 0), 1.0) AS weight)
    FROM {old} c
)"""


def _mixing(source: str = "documents", rounds: int = 5) -> str:
    """The fitting written out: one table per step."""
    dims = ("source", "lang", "topic")
    steps, old = "", "c0"
    for i in range(rounds):
        for d in dims:
            steps += _ROUND.format(new=f"c{i}_{d}", old=old, d=d)
            old = f"c{i}_{d}"
    wanted = ", ".join(f"({d}_p / sum({d}_p / {d}_n) OVER ()) AS t_{d}" for d in dims)
    temper = {"source": 0.7, "lang": 0.7, "topic": 1.0}
    powers = ", ".join(
        f"pow(sum(tokens) OVER (PARTITION BY {d})::DOUBLE, {temper[d]}) AS {d}_p, count(*) OVER (PARTITION BY {d}) AS {d}_n" for d in dims
    )
    return f"""
WITH r AS MATERIALIZED (
    SELECT doc_id, source, lang,
        CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'notice' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
             WHEN length(coalesce(text, '')) < 1000 THEN 'short' WHEN length(text) < 4000 THEN 'article' ELSE 'long' END AS topic,
        len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS n_tokens
    FROM {source}
),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
p AS MATERIALIZED (SELECT *, {powers} FROM cells),
c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, 1.0::DOUBLE AS weight, sum(tokens) OVER ()::DOUBLE AS total, {wanted} FROM p){steps}
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(c.weight, 9) AS weight, round(least(c.weight / m.most, 1.0), 9) AS probability,
    ('0x' || substr(md5('0|' || r.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < least(c.weight / m.most, 1.0) AS kept
FROM r JOIN {old} c ON r.source IS NOT DISTINCT FROM c.source AND r.lang IS NOT DISTINCT FROM c.lang AND r.topic = c.topic
CROSS JOIN (SELECT max(weight) AS most FROM {old} WHERE tokens > 0) m
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31)::BIGINT, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
_WARC = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM kept
"""

_NEAREST = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

_PLAIN_WORDS = _WORDS.format(text="coalesce(text, '')")
_LOWER_WORDS = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_SUBSTRING = """
WITH split AS (SELECT doc_id, @words AS w FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM windows) WHERE first < doc_id),
marked AS (
    SELECT doc_id, i, word, coalesce(max(CASE WHEN r.i IS NOT NULL THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM word LEFT JOIN repeats r USING (doc_id, i)
),
summed AS (
    SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
        sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN summed USING (doc_id)
""".replace("@words", _PLAIN_WORDS)
_NEAR_DUPLICATES = """
WITH RECURSIVE split AS (SELECT doc_id, @lower AS w FROM documents),
runs AS (
    SELECT DISTINCT doc_id, run FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS run
        FROM split WHERE len(w) > 0
    )
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
numbered AS MATERIALIZED (SELECT doc_id, n, dense_rank() OVER (ORDER BY run) AS run FROM runs JOIN sizes USING (doc_id)),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.run = b.run AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
    SELECT b AS doc_id, a AS other FROM links UNION SELECT a, b FROM links
    UNION
    SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a AS doc_id, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.doc_id
),
least_id AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_id l USING (doc_id)
""".replace("@lower", _LOWER_WORDS)
# CRC-32 by bytes, from the table that its polynomial gives.
_SHARDING = """
WITH crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
    SELECT doc_id, (len(h) // 2 + 16)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
    FROM bytes, crc
),
placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized
),
dealt AS (SELECT *, least((2 * upto - size) * 40 // (2 * total), 39)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""

# The twin states its own rules and rates: votes are 1, -1 or 0, rates a pair per vote, on good and on bad documents.
_VOTES = ", ".join(
    f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    for good, bad in (
        ("n_words BETWEEN 50 AND 100000", "n_words < 20 OR n_words > 1000000"),
        ("word_chars / n_words BETWEEN 3 AND 10", "word_chars / n_words < 2 OR word_chars / n_words > 15"),
        ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
        ("10 * n_dup_lines <= n_lines", "n_lines >= 8 AND 10 * n_dup_lines > 3 * n_lines"),
        ("10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
        ("20 * n_bare_words <= n_words", "5 * n_bare_words > n_words"),
        ("4 * n_distinct_words >= least(n_words, 400)", "10 * n_distinct_words < least(n_words, 400)"),
        ("2 * n_ended_lines >= n_lines", "20 * n_ended_lines < n_lines"),
    )
)
_TERM = """CASE {v} WHEN 1 THEN greatest(ln(r[{j}].gg / r[{j}].gb), 0) WHEN -1 THEN least(ln(r[{j}].bg / r[{j}].bb), 0) ELSE 0 END"""
_ODDS = "ln(prior / (1 - prior)) + " + " + ".join(_TERM.format(v=f"v[{j}]", j=j) for j in range(1, 9))
_RULES = f"""
WITH RECURSIVE split AS MATERIALIZED (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_PLAIN_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents
),
windows AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, run) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT k, count(DISTINCT word)::BIGINT AS n FROM (SELECT k, unnest(range(i, i + 8)) AS word FROM twice) GROUP BY k),
measured AS MATERIALIZED (
    SELECT k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_bare_words,
        len(list_distinct(w)) AS n_distinct_words,
        len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;"''”»)][\x20\x09-\x0D]*$'))) AS n_ended_lines
    FROM split LEFT JOIN repeats USING (k)
),
voted AS MATERIALIZED (SELECT *, [{_VOTES}] AS v FROM measured),
patterns AS MATERIALIZED (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
fit AS (
    SELECT 0 AS step, 0.9::DOUBLE AS prior, list_transform(range(8), lambda j: {{'gg': 0.8::DOUBLE, 'bg': 0.01::DOUBLE, 'gb': 0.6::DOUBLE, 'bb': 0.25::DOUBLE}}) AS r
    UNION ALL
    SELECT any_value(step) + 1, greatest(0.01, least(0.99, sum(good) / sum(good + bad))),
        [{", ".join(f"{{'gg': (coalesce(sum(good) FILTER (WHERE v[{j}] = 1), 0) + 1) / (sum(good) + 3), 'bg': (coalesce(sum(good) FILTER (WHERE v[{j}] = -1), 0) + 1) / (sum(good) + 3), 'gb': (coalesce(sum(bad) FILTER (WHERE v[{j}] = 1), 0) + 1) / (sum(bad) + 3), 'bb': (coalesce(sum(bad) FILTER (WHERE v[{j}] = -1), 0) + 1) / (sum(bad) + 3)}}" for j in range(1, 9))}]
    FROM (SELECT step, v, n * q AS good, n * (1 - q) AS bad FROM (SELECT step, v, n, 1 / (1 + exp(-({_ODDS}))) AS q FROM fit, patterns WHERE step < 50))
    HAVING count(*) > 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept,
    array_to_string(v, ',') AS votes, round(q, 6) AS quality
FROM (
    SELECT *, n_words < 20 OR 10 * n_repeat_words > 3 * n_words AS base_failed, 1 / (1 + exp(-({_ODDS}))) AS q
    FROM voted, (SELECT prior, r FROM fit WHERE step = 50)
)
"""

_LEXICAL = """
WITH found AS (
    SELECT k, doc_id, unnest(@terms) AS term FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)
),
counted AS MATERIALIZED (SELECT k, doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
sizes AS MATERIALIZED (SELECT k, sum(tf)::BIGINT AS n FROM counted GROUP BY k),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, corpus GROUP BY term),
asked AS (SELECT DISTINCT r, item_id, term FROM (SELECT row_number() OVER () AS r, item_id, unnest(@terms) AS term FROM benchmark)),
scored AS (
    SELECT r, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (k), corpus
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""".replace(
    "@terms",
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')",
)

ORACLES: dict[str, str] = {
    "op1_substring": _SUBSTRING,
    "op2_mixing": _mixing(),
    "op4_warc": _WARC,
    "op5_nearest": _NEAREST,
    "op6_licenses": _LICENSES,
    "op7_fingerprints": _FINGERPRINTS,
    "op8_near_duplicates": _NEAR_DUPLICATES,
    "op10_sharding": _SHARDING,
    "op11_rules": _RULES,
    "op13_lexical": _LEXICAL,
}
