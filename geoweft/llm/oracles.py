"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from geoweft.llm import licenses, quality

SPACE = r"[\x20\x09-\x0D]"
MASK = quality.POLICIES[quality.CURRENT]
RULES_SQL = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "n_upper > n_lower",
    "exclaiming": "10 * n_bangs > 3 * n_words",
    "few_letters": "2 * n_letters < word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_words": "n_words > 1000000",
}


def _only(characters: str) -> str:
    """The number of a text's characters of a class."""
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS lines FROM d),
    places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
    g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM places),
    again AS (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again USING (doc_id, k)) GROUP BY 1),
    m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, {_only('#*$%&|<>')} AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, {_only(r'\p{L}')} AS n_letters,
      {_only('A-Z')} AS n_upper, {_only('a-z')} AS n_lower, {_only('!')} AS n_bangs FROM w LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, {' + '.join(f'(CASE WHEN {RULES_SQL[r.name]} THEN {1 << r.bit} ELSE 0 END)' for r in quality.RULES)} AS bits FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
      n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & {MASK | 3}) = 0 AS kept, bits::BIGINT AS fail_bits,
      (CASE WHEN bit_count(bits & {MASK}) = 1 THEN bits & {MASK} ELSE 0 END)::BIGINT AS sole_bits FROM f"""

ABLATION = f"""WITH ledger AS ({OP2}), rules(rule, bit) AS (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in quality.RULES if MASK >> r.bit & 1)})
    SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & {MASK} = bit) AS n_sole, count(*) FILTER (fail_bits & {MASK} & ~bit = 0) AS n_kept_without
    FROM ledger, rules GROUP BY 1"""

#: Links by the number of shared shingles over all documents, then the smallest id reachable.
OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') AS words FROM documents),
    places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0),
    sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS k FROM places),
    size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
    reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    least AS (SELECT a, min(b) AS b FROM reached GROUP BY 1)
    SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
    FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""

#: Every window of 50 bytes of every text; places as numbers, so that runs are what consecutive ones have in common.
OP9 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    windows AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, h FROM d WHERE n >= 50),
    grams AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS g FROM windows),
    least AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    again AS (SELECT doc_id, i FROM grams JOIN least USING (g) WHERE m < doc_id),
    steps AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM again),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM steps) GROUP BY doc_id, r),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
      UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY 1),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * gaps.a + 1, 2 * (coalesce(gaps.b, n) - gaps.a)), '' ORDER BY gaps.a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY 1),
    gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY 1)
    SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _crc_step(v: str) -> str:
    return f"xor(({v}) >> 1, 3988292384 * (({v}) & 1))"


#: The checksum (crc32) of a string ``s`` of ASCII characters, bit by bit.
CRC = f"xor(list_reduce(range(8 * length(s)), lambda v, k: CASE WHEN k % 8 = 0 THEN {_crc_step('xor(v, ascii(substr(s, k // 8 + 1, 1)))')} ELSE {_crc_step('v')} END, 4294967295::BIGINT), 4294967295)"

#: A prefix is the string of its turns' digests, so those of its ancestors are its own beginnings.
OP13 = f"""WITH t AS (SELECT conv_id AS c, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 100 AS b, {CRC} % 6 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)),
    taken AS (SELECT convs.*, least(h, coalesce(m, 0)) AS k FROM convs LEFT JOIN (SELECT c AS b, max(i) AS m FROM t GROUP BY 1) USING (b)),
    full_ AS (SELECT taken.c, i AS d, g, x FROM taken JOIN t ON t.c = taken.b AND i <= h UNION ALL SELECT t.c, i - h + k, g, x FROM taken JOIN t ON t.c = taken.c AND i > h),
    members AS (SELECT c, d, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS key, length(x) AS size FROM full_ UNION ALL SELECT c, 0, '', 0 FROM convs),
    whole AS (SELECT c, max_by(key, d) AS key FROM members GROUP BY 1),
    ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM whole GROUP BY 1),
    nodes AS (SELECT key, any_value(d) AS d, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, CASE WHEN any_value(d) > 0 THEN left(key, 32 * (any_value(d) - 1)) END AS up FROM members GROUP BY 1),
    kids AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY 1),
    below AS (SELECT left(nodes.key, 32 * j) AS key, sum((n - 1) * size) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM nodes LEFT JOIN kids USING (key), LATERAL (SELECT unnest(range(0, d + 1)) AS j) GROUP BY 1)
    SELECT nodes.conv_id, nodes.d::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
    FROM nodes JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON p.key = nodes.up"""


def _op1() -> str:
    """Cosines of units and templates as sums over terms, then the nearest licence file above."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cue = quote("|".join(licenses.CUES))
    rows = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    terms = lambda x: f"list_filter(list_transform(string_split_regex(lower({x}), '[^a-z0-9.+-]+'), lambda w: trim(w, '.+-')), lambda w: w <> '')"
    files = ", ".join(map(quote, licenses.LICENCE_FILES))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, 'unknown'), (doc_id // 1024)::VARCHAR, (doc_id // 64)::VARCHAR,
        CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id::VARCHAR || '.txt' END) END AS path FROM documents),
    templates(k, name, t) AS (VALUES {rows}),
    words AS (SELECT k, unnest({terms('t')}) AS w FROM templates),
    vocabulary AS (SELECT DISTINCT w FROM words),
    total AS (SELECT count(*) AS n FROM docs),
    holds AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT rowid_, w FROM (SELECT row_number() OVER () AS rowid_, t FROM docs) x, LATERAL (SELECT unnest({terms('x.t')}) AS w) y) JOIN vocabulary USING (w) GROUP BY 1),
    idf AS (SELECT w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS v FROM vocabulary LEFT JOIN holds USING (w), total),
    vectors AS (SELECT k, w, count(*) * any_value(v) AS x FROM words JOIN idf USING (w) GROUP BY 1, 2),
    norms AS (SELECT k, sqrt(sum(x * x)) AS x FROM vectors GROUP BY 1),
    cued AS (SELECT DISTINCT t FROM docs WHERE regexp_matches(lower(t), {cue})),
    units AS (SELECT DISTINCT t, u FROM cued, LATERAL (SELECT unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n[\\x20\\t\\r]*\\n'))) AS u) WHERE regexp_matches(lower(u), {cue})),
    counts AS (SELECT t, u, w, count(*) AS tf FROM units, LATERAL (SELECT unnest({terms('u')}) AS w) GROUP BY ALL),
    weighed AS (SELECT t, u, counts.w, tf * coalesce(v, ln(n + 1) + 1) AS x FROM counts LEFT JOIN idf USING (w), total),
    lengths AS (SELECT t, u, sqrt(sum(x * x)) AS x FROM weighed GROUP BY 1, 2),
    cosines AS (SELECT w.t, w.u, k, round(sum(w.x * v.x) / (any_value(l.x) * any_value(norms.x)), 9) AS c FROM weighed w JOIN vectors v USING (w) JOIN norms USING (k) JOIN lengths l ON l.t = w.t AND l.u = w.u GROUP BY 1, 2, 3),
    own AS (SELECT t, name, c FROM (SELECT t, c, k, row_number() OVER (PARTITION BY t ORDER BY c DESC, k) AS r FROM cosines) JOIN templates USING (k) WHERE r = 1 AND c >= {licenses.LEAST}),
    """.replace("templates USING (k) WHERE r", "(SELECT k, name FROM templates) USING (k) WHERE r") + f"""placed AS (SELECT docs.*, name, c, regexp_replace(path, '/[^/]*$', '') AS dir FROM docs LEFT JOIN own USING (t)),
    files AS (SELECT dir AS above, path, name, row_number() OVER (PARTITION BY dir ORDER BY c DESC, path) AS r FROM placed
      WHERE name IS NOT NULL AND regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '\\.[a-z]+$', '') IN ({files})),
    dirs AS (SELECT dir, string_split(dir, '/') AS parts FROM (SELECT DISTINCT dir FROM placed WHERE dir IS NOT NULL)),
    up AS (SELECT dir, depth, array_to_string(parts[1:depth], '/') AS above FROM dirs, LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS depth)),
    nearest AS (SELECT dir, arg_max(name, depth) AS from_name, arg_max(path, depth) AS from_path FROM up JOIN files USING (above) WHERE r = 1 GROUP BY 1)
    SELECT doc_id, path, name AS own_licence, c AS cosine, coalesce(name, from_name) AS licence, CASE WHEN name IS NOT NULL THEN path ELSE from_path END AS licence_from
    FROM placed LEFT JOIN nearest USING (dir)"""


ORACLES: dict[str, str] = {"op1_licenses": _op1(), "op2_quality_rules": OP2, "quality_ablation": ABLATION, "op6_near_duplicates": OP6, "op9_repeated_passages": OP9, "op13_prefix_trie": OP13}
