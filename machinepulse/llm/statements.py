"""SQL twins of the queries that SQL can express, for the second engine."""

from __future__ import annotations

from machinepulse.llm import secrets

OP3 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1
           AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP5 = """
WITH pages_ AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
),
bits AS (
    SELECT hex, array_to_string(list_transform(string_split(hex, ''), lambda c:
        substr('0000000100100011010001010110011110001001101010111100110111101111',
               (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') AS bits
    FROM (SELECT DISTINCT hex FROM pages_)
),
digests AS (
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
            + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT)
            + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
            + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT)
            + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
            + CAST(substr(bits, i * 5 + 5, 1) AS INT), 1)), '') AS digest
    FROM bits
),
placed AS (
    SELECT page_id, payload, hex, row_number() OVER (PARTITION BY payload ORDER BY page_id) AS place,
           min(page_id) OVER (PARTITION BY payload) AS first
    FROM pages_
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM placed JOIN digests USING (hex)
"""


def _op6() -> str:
    """Places from splitting by the pattern; every window's entropy counted anew."""

    def matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
        SELECT doc_id, text, {order} AS kind_order, '{kind}' AS kind, value,
               begins AS start, begins + length(whole) AS "end"
        FROM (
            SELECT doc_id, text, wholes[i] AS whole, vals[i] AS value,
                   list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                   + coalesce(list_sum(list_transform(wholes[1:i-1], lambda g: length(g))), 0)
                       AS begins
            FROM (
                SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS wholes,
                       regexp_extract_all(text, '{quoted}', {group}) AS vals,
                       string_split_regex(text, '{quoted}') AS gaps
                FROM docs
                WHERE regexp_matches(text, '{quoted}')
            ), unnest(generate_series(1, len(wholes))) AS t(i)
        )
        WHERE length(value) >= {least}"""

    table = ", ".join(map(str, secrets.weights()))
    window = secrets.WINDOW
    limit = " ".join(
        f"WHEN regexp_matches(value, '{c.pattern}') THEN {secrets.most_weight(c.bits)}"
        for c in secrets.CLASSES
    )
    allowed = " OR ".join(f"regexp_matches(value, '{a}')" for a in secrets.ALLOWED)
    base = " UNION ALL ".join(
        matches(kind, order, pattern, group, least)
        for order, (kind, pattern, group, least) in enumerate(
            [
                ("assign", secrets.ASSIGN, 2, 6),
                ("access", secrets.ACCESS, 0, 20),
                ("hex", secrets.HEX, 0, 24),
            ]
        )
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
candidates AS (
    SELECT doc_id, value, start, CASE {limit} END AS most
    FROM ({matches("entropy", 3, secrets.CANDIDATE, 0, window)}) WHERE NOT ({allowed})
),
characters AS (
    SELECT doc_id, start, most, w, substr(value, CAST(w + k AS BIGINT), 1) AS ch
    FROM candidates, unnest(generate_series(1, length(value) - {window - 1})) AS a(w),
         unnest(generate_series(0, {window - 1})) AS b(k)
),
windows AS (
    SELECT doc_id, start, w
    FROM (SELECT doc_id, start, most, w, ch, count(*) AS n
          FROM characters GROUP BY doc_id, start, most, w, ch)
    GROUP BY doc_id, start, most, w
    HAVING sum(([{table}])[n + 1]) <= most
),
spans AS (
    SELECT doc_id, kind_order, kind, start, "end" FROM base
    UNION ALL
    SELECT doc_id, 3, 'entropy', start + min(w) - 1, start + max(w) + {window - 1}
    FROM windows GROUP BY doc_id, start
),
listed AS (
    SELECT doc_id,
           count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_order)
               FILTER (kind <> 'entropy') AS base,
           string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_order)
               AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""


def _op9() -> str:
    """The verdict of urls no rule fits is that of their aliases, by a recursive walk."""
    rest = "CASE WHEN contains({0}, '://') THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def parts(url: str) -> str:
        after = rest.format(url)
        return (
            f"coalesce(translate(regexp_extract({after}, '^([^/?#]*)', 1), '{upper}', '{lower}'), '')"
            f" AS host, coalesce(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '') AS path"
        )

    rules = """(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
        ('block', 'net', '/fr/')) AS r(ruled, rule_host, rule_path)"""
    target = r"""regexp_extract(regexp_extract(coalesce(html, ''), '{0}'), '{1}', 1)"""
    link = target.format(
        r"""(?is)<link\b[^>]*\brel\s*=\s*[""'']?canonical\b[^>]*>""",
        r"""(?is)\bhref\s*=\s*[""'']?([^""''\s>]+)""",
    ).replace('""', '"')
    meta = target.format(
        r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[""'']?refresh\b[^>]*>""",
        r"""(?is)\burl\s*=\s*[""'']?([^""''\s>;]+)""",
    ).replace('""', '"')
    return f"""
WITH RECURSIVE targets AS (
    SELECT split_part(url, '#', 1) AS a, replace(t, '&amp;', '&') AS t
    FROM (SELECT url, unnest([{link}, {meta}]) AS t FROM pages WHERE url IS NOT NULL)
    WHERE t <> ''
),
links AS (
    SELECT a, split_part(CASE
        WHEN contains(t, '://') THEN t
        WHEN starts_with(t, '//') THEN split_part(a, '//', 1) || t
        WHEN starts_with(t, '/') THEN regexp_extract(a, '^([^/?#]*://[^/?#]*)', 1) || t
        ELSE regexp_extract(a, '^([^?#]*://[^/?#]*(?:[^?#]*/)?)', 1) || t END, '#', 1) AS b
    FROM targets
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
ruled AS (
    SELECT node, arg_max(ruled, length(rule_host || rule_path)) AS ruled
    FROM (SELECT a AS node, {parts("a")} FROM (SELECT DISTINCT a FROM edges)) AS n, {rules}
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY node
),
reached AS (
    SELECT node FROM ruled WHERE ruled = 'block'
    UNION
    SELECT b FROM reached JOIN edges ON reached.node = edges.a
),
urls AS (
    SELECT page_id, url, split_part(url, '#', 1) AS address, {parts("url")} FROM pages
),
best AS (
    SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(ruled, length(rule_host || rule_path)) AS ruled
    FROM (SELECT DISTINCT host, path FROM urls), {rules}
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN address IN (SELECT node FROM reached) THEN 'block' END, 'allow')
           AS verdict
FROM urls LEFT JOIN best USING (host, path)
"""


OP10 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, words, len(words) AS n_words
    FROM (SELECT doc_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM documents)
),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, words, least(len(words), 10) AS size
    FROM (SELECT item_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM benchmark)
    WHERE len(words) > 0
),
windows AS (
    SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
    FROM items, unnest(generate_series(1, len(words) - size + 1)) AS t(i)
),
places AS (
    SELECT row, i, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
    FROM docs, (SELECT DISTINCT size FROM windows) AS s,
         unnest(generate_series(1, n_words - size + 1)) AS t(i)
),
found AS (
    SELECT row, i, windows.size AS size, item FROM places JOIN windows USING (size, phrase)
),
hit AS (
    SELECT row, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT row, i, size FROM found), unnest(generate_series(i, i + size - 1)) AS t(p)
    GROUP BY row
),
listed AS (
    SELECT row, count(DISTINCT item) AS n_items,
           string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM found GROUP BY row
)
SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN listed USING (row)
"""


OP12 = r"""
WITH pieces AS (
    SELECT row, doc_id, term, count(*) AS tf
    FROM (
        SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    )
    GROUP BY row, doc_id, term
),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM pieces GROUP BY row),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
wanted AS (
    SELECT item, item_id, term, count(*) AS times
    FROM (
        SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    )
    GROUP BY item, item_id, term
),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM pieces, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs
),
scores AS (
    SELECT item, item_id, row, doc_id,
           sum(times * w * ((1000000000 * tf)
               // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN pieces USING (term) JOIN sizes USING (row), whole
    GROUP BY item, item_id, row, doc_id
),
ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (
        PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def all_statements() -> dict[str, str]:
    return {
        "op3_content_sort": OP3,
        "op5_warc": OP5,
        "op6_secrets": _op6(),
        "op9_url_filter": _op9(),
        "op10_decontaminate": OP10,
        "op12_lexical_search": OP12,
    }
