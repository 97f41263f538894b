"""What the registered queries must return, as DuckDB statements over the given tables."""

from __future__ import annotations

from bazaarlens.llm.secrets import ACCESS, ALLOWED, ASSIGN, CLASSES, HEX, LEAST_ACCESS, LEAST_ASSIGN, LEAST_HEX
from bazaarlens.llm.spotsigs import ANCHORS


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


_CRC = """
bits(n, v, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(v ORDER BY n) AS entries FROM bits WHERE k = 8)"""


def _rendezvous(shards: int) -> str:
    scores = ", ".join(
        f"{{'score': -1.0 / ln((('0x' || substr(md5(concat(doc_id::VARCHAR, ':{s}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), 'shard': {s}}}"
        for s in range(shards)
    )
    return f"list_max([{scores}]).shard"


OP1 = f"""
WITH RECURSIVE {_CRC},
sized AS (
    SELECT doc_id, coalesce(text, '') AS body FROM documents
),
bytes AS (
    SELECT doc_id, octet_length(encode(body)) + 1 AS size,
        list_transform(range(0, octet_length(encode(body))), lambda i: ('0x' || substr(hex(encode(body)), 2 * i::INT + 1, 2))::BIGINT) AS codes
    FROM sized
),
placed AS (
    SELECT doc_id, size,
        xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
        {_rendezvous(8)} AS shard, {_rendezvous(9)} AS grown_shard
    FROM bytes, crc
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
    grown_shard::INT AS grown_shard
FROM placed
"""

#: Words as the operators see them: lower-case runs of letters and digits.
def _words(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    return f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"


def _signatures(table: str, text: str) -> str:
    """``doc_id, found`` of a table with ``doc_id`` and a text."""
    anchors = ", ".join(quoted(a) for a in ANCHORS)
    return f"""
    SELECT doc_id, list_sort(list_distinct(list_transform(
        CASE WHEN len(chains) > 0 THEN chains WHEN tagged = '' THEN []::VARCHAR[] ELSE [tagged] END,
        lambda c: substr(md5(c), 1, 10)))) AS found
    FROM (
        SELECT doc_id, tagged, list_filter(
            list_transform(range(1, len(spots)), lambda i: spots[i] || ' ' || string_split(spots[i + 1], chr(1))[-1]),
            lambda c: contains(c, chr(1))) AS chains
        FROM (
            SELECT doc_id, tagged,
                string_split(regexp_replace(tagged, ' ?(?:[^ \x01]+\x01)*$', ''), ' ') AS spots
            FROM (
                SELECT doc_id, coalesce(array_to_string(list_transform({_words(text)},
                    lambda w: w || CASE WHEN w IN ({anchors}) THEN chr(1) ELSE ' ' END), ''), '') AS tagged
                FROM {table}
            )
        )
    )"""


def _likeness(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    either = f"(len({a}) + len({b}) - {common})"
    return f"CASE WHEN {either} = 0 THEN 1.0::DOUBLE ELSE {common}::DOUBLE / {either} END"


OP3 = f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
),
linked AS (
    SELECT doc_id, text, length(text) // 3 AS k,
        coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
    FROM docs WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
edits AS (
    SELECT doc_id, next_id, length(text) AS n_chars,
        CASE WHEN k = 0 THEN text ELSE substr(text, 1, length(text) - k) || substr(next_text, 1, k) END AS edited
    FROM linked
),
own AS ({_signatures("docs", "text")}),
changed AS ({_signatures("edits", "edited")})
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    array_to_string(own.found, '') AS fingerprint, array_to_string(changed.found, '') AS edited_fingerprint,
    {_likeness("own.found", "changed.found")} AS near_edited, {_likeness("own.found", "after.found")} AS near_next
FROM edits JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN own AS after ON after.doc_id = next_id
"""


def _located(pattern: str, extra: str = "") -> str:
    """``doc_id, start, value`` of all matches of a pattern, in code points from 0."""
    literal = quoted(pattern)
    return f"""
    SELECT doc_id, value, (list_sum(list_transform(gaps[:i], lambda g: length(g))) +
        coalesce(list_sum(list_transform(found[:i - 1], lambda f: length(f))), 0))::BIGINT AS start
    FROM (
        SELECT doc_id, gaps, found, unnest(found) AS value, generate_subscripts(found, 1) AS i
        FROM (
            SELECT doc_id, regexp_split_to_array(text, {literal}) AS gaps, regexp_extract_all(text, {literal}) AS found
            FROM docs WHERE regexp_matches(text, {literal})
        )
    ) {extra}"""


def _stretches(rank: int, kind: str, inside: str, window: int, bits: float) -> str:
    """``doc_id, start, rank, "end", kind`` of the entropy scan of one class, with no state from step to step."""
    open_run = " AND ".join(f"NOT regexp_matches(value, {quoted(p)})" for p in ALLOWED if "\\1" not in p)
    repeats = "len(list_filter(range(1, length(value) - 6), lambda i: substr(value, i, 8) = repeat(substr(value, i, 1), 8))) = 0"
    return f"""
    SELECT doc_id, start + min(place) - {window} AS start, {rank} AS rank, start + max(place) AS "end", '{kind}' AS kind
    FROM (
        SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id, start ORDER BY place) AS part
        FROM (
            SELECT *, coalesce(place - lag(place) OVER (PARTITION BY doc_id, start ORDER BY place) > {window}, true) AS fresh
            FROM (
                SELECT doc_id, start, place, list_aggregate(string_split(substr(value, place - {window} + 1, {window}), ''), 'entropy') AS bits
                FROM (
                    SELECT doc_id, start, value, unnest(range({window}, length(value) + 1)) AS place
                    FROM ({_located(f"[{inside}]{{{window},}}")}) WHERE {open_run} AND {repeats}
                )
            ) WHERE round({window} * ({_log2(window)} - bits), 6) < {_log2(window)} * {window} - {bits} * {window}
        )
    ) GROUP BY doc_id, start, part"""


def _log2(n: int) -> str:
    return f"log2({n}::DOUBLE)"


_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_SPAN = "kind || ':' || start || ':' || \"end\""

OP4 = f"""
WITH docs AS ({_TEXTS}),
base AS (
    SELECT doc_id, start, 0 AS rank, start + length(value) AS "end", 'assign' AS kind FROM ({_located(ASSIGN)})
    WHERE length(regexp_extract(value, {quoted(ASSIGN)}, 1)) >= {LEAST_ASSIGN}
    UNION ALL
    SELECT doc_id, start, 1, start + length(value), 'access' FROM ({_located(ACCESS)}) WHERE length(value) >= {LEAST_ACCESS}
    UNION ALL
    SELECT doc_id, start, 2, start + length(value), 'hex' FROM ({_located(HEX)}) WHERE length(value) >= {LEAST_HEX}
),
added AS (
    {" UNION ALL ".join(_stretches(rank, g.kind, g.inside, g.window, g.bits) for rank, g in enumerate(CLASSES, start=3))}
),
everything AS (
    SELECT * FROM base
    UNION ALL
    SELECT * FROM added AS a WHERE NOT EXISTS (
        SELECT 1 FROM base AS b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end")
)
SELECT doc_id,
    coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg({_SPAN}, ',' ORDER BY start, rank, "end") FILTER (rank < 3) AS base_spans,
        string_agg({_SPAN}, ',' ORDER BY start, rank, "end") AS spans
    FROM everything GROUP BY doc_id
) USING (doc_id)
"""

#: The text in lines, cut twice; DuckDB counts and cuts strings by code points.
OP12 = """
WITH lined AS (
    SELECT doc_id, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
        sha256(concat('7:', doc_id::VARCHAR)) AS digest
    FROM documents
),
drawn AS (
    SELECT *, len(units) AS n,
        ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS cut_a,
        ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS cut_b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
             WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM lined
),
parts AS (
    SELECT doc_id, body, n, form,
        array_to_string(units[1:least(cut_a, cut_b)], '') AS prefix,
        array_to_string(units[least(cut_a, cut_b) + 1:greatest(cut_a, cut_b)], '') AS middle,
        array_to_string(units[greatest(cut_a, cut_b) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN body ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM parts
"""

STATEMENTS: dict[str, str] = {"op1_sharding": OP1, "op3_spotsigs": OP3, "op4_secrets": OP4, "op12_infill": OP12}
