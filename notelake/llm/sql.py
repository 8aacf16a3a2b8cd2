"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

_W = r"[^\x20\x09-\x0D]+"
_WHITE = r"[\x20\x09-\x0D]+"

RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
s AS (SELECT doc_id, text, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '{_WHITE}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(lines)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 6
            OR word_chars < n_words * 2 OR word_chars > n_words * 25
            OR n_dup_lines * 2 > n_lines OR n_repeat_words * 10 > n_words * 4
            OR length(regexp_replace(text, '[^A-Z]+', '', 'g')) * 2 > word_chars
            OR length(regexp_replace(text, '[^!]+', '', 'g')) * 2 > n_words) AS kept
FROM b
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
      regexp_extract(host, '^(.*[.\-])?(ads-track|adult|bets|casino|pills|spam)([.\-].*)?$', 2) AS word FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(word, '') <> '' THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL AND coalesce(word, '') <> '' THEN 'host:' || word END AS pattern
FROM r
"""

EXACT = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': '
             || replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')
             || '</turn>' || chr(10) AS shown,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS following FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(shown))::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                          WHEN 'assistant' THEN coalesce(before = 'user', false)
                          ELSE before IS NULL END AND (following IS NOT NULL OR role = 'assistant')) AS valid
FROM f GROUP BY conv_id
"""

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, regexp_replace(regexp_replace(line, '^{_WHITE}', ''), '{_WHITE}$', '') AS bare FROM l),
n AS (SELECT r, source, line, i, regexp_replace(bare, '[\x09-\x0D]', ' ', 'g') AS bare FROM k),
b AS (SELECT bare FROM n WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '')) >= 10),
m AS (SELECT n.*, b.bare IS NOT NULL AS gone FROM n LEFT JOIN b USING (bare)),
g AS (SELECT r, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '') AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN g USING (r)
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and floored means, unrolled."""
    steps = [
        rf"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(coalesce(x, 'nan'::FLOAT)))) = len(embedding)),
c AS MATERIALIZED (SELECT r, part, i, v[part * w + i] AS x FROM (SELECT r, v, len(v) // {parts} AS w, unnest(range({parts})) AS part FROM k),
        LATERAL (SELECT unnest(range(1, w + 1)) AS i)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, i, x AS y FROM c WHERE r <= {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT r, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM c JOIN e{n} USING (part, i) GROUP BY r, part, entry),
a{n} AS MATERIALIZED (SELECT r, part, d, entry FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if n < rounds:
            # DuckDB's // is floored by hand: it truncates
            steps.append(f"""s{n} AS (SELECT part, entry, i, sum(x)::BIGINT AS t, count(*) AS n FROM a{n} JOIN c USING (r, part) GROUP BY part, entry, i),
e{n + 1} AS MATERIALIZED (SELECT part, entry, i, CASE WHEN n IS NULL THEN y ELSE t // n - (t % n < 0)::BIGINT END AS y FROM e{n} LEFT JOIN s{n} USING (part, entry, i))""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM e{rounds}),
o AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS terms, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
c AS (SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::BIGINT AS total, lang_n, lang_total, terms
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (total + 5 * terms) AS p, 1 + 1000000000 * (lang_n + 5) // (lang_total + 5 * terms) AS q FROM c),
w AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


ORACLES = {
    "op4_quality_rules": RULES,
    "op5_url_filters": URLS,
    "op6_exact_dedup": EXACT,
    "op8_chat_formatting": CHAT,
    "op9_line_dedup": LINES,
    "op11_vector_codes": _codes_sql(),
    "op13_source_divergence": DIVERGENCE,
}
