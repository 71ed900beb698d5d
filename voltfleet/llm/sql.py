"""The queries of this folder in SQL, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

# CRC-32 of an ASCII string, bit by bit.
_CRC = """
    xor(4294967295, list_reduce(
        [4294967295] || flatten([[(ord(c) >> b) & 1 for b in range(8)] for c in string_split(k, '')]),
        lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))))
"""

# States: nothing yet, after system, after user, after assistant.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _edit(extra: str, letter: str, line: str, after: str) -> str:
    """One more edit before what follows: cost, audit and the lines left."""
    lines = f"list_prepend({line}, {after}.t)" if line else f"{after}.t"
    return f"{{'c': {after}.c + {extra}, 'a': '{letter}' || {after}.a, 't': {lines}}}"


def _row_edits(state: int) -> str:
    """The cheapest and then least of keep, rerole and delete."""
    after = f"b{_NEXT[state]}"
    reroled = _edit("3 + cut", "R", f"'{_ROLE[state]}:' || text", after)
    found = [_edit("4", "D", "", f"b{state}"), f"CASE WHEN whole THEN {reroled} END"]
    for initial, kept in _KEPT[state].items():
        keep = _edit("cut", "K", "role || ':' || text", f"b{kept}")
        found.append(f"CASE WHEN whole AND left(role, 1) = '{initial}' THEN {keep} END")
    return f"list_min([{', '.join(found)}]) AS b{state}"


def _inserts(state: int) -> str:
    return f"list_min([b{state}, {_edit('3', 'I', repr(_ROLE[state] + ':'), f'b{_NEXT[state]}')}]) AS b{state}"


def _four(function) -> str:
    return ", ".join(function(state) for state in range(4))


def _at_end(audit: str, *lines: str) -> str:
    given = ", ".join(map(repr, lines))
    return f"{{'c': {3 * len(audit)}, 'a': '{audit}', 't': CAST([{given}] AS VARCHAR[])}}"


_REPAIR = f"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations
    ), faults AS (SELECT *, {_CRC} % 20 AS fault FROM keyed),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM faults WHERE fault <> 0
    ), placed AS (
        SELECT *, row_number() OVER w AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
               lag(left(role, 1)) OVER w || left(role, 1) AS pair,
               regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last
        FROM damaged
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
    ), judged AS (
        SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS same,
               last <> '' AND nth = 1 AS whole,
               CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut
        FROM placed
    ), counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count_if(blank) AS blank, count_if(same) AS duplicate,
               count_if(whole AND cut > 0) AS truncated,
               count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    ), back AS (
        SELECT conv_id, n AS i, {_at_end("")} AS b0, {_at_end("II", "user:", "assistant:")} AS b1,
               {_at_end("I", "assistant:")} AS b2, {_at_end("")} AS b3
        FROM counted
        UNION ALL
        SELECT conv_id, i, b0, b1, b2, b3 FROM (
            SELECT conv_id, i, {_four(_inserts)} FROM (
                SELECT conv_id, i, {_four(_inserts)} FROM (
                    SELECT conv_id, i, {_four(_inserts)} FROM (
                        SELECT back.conv_id, back.i - 1 AS i, {_four(_row_edits)}
                        FROM back JOIN judged
                          ON judged.conv_id IS NOT DISTINCT FROM back.conv_id AND judged.i = back.i
                    )
                )
            )
        )
    ), repaired AS (SELECT conv_id, b0 FROM back WHERE i = 0)
    SELECT every.conv_id AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps,
           CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
           CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
           CAST(coalesce(b0.c, 0) AS BIGINT) AS cost, coalesce(b0.a, '') AS audit,
           sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS every
    LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM every.conv_id
    LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM every.conv_id
"""

SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
    """,
    "op7_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
            FROM documents
        ), placed AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM sized
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY source
        ), ordered AS (
            SELECT *, 3 * source_size AS cap,
                   row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source) AS k
            FROM sources
        ), left_over AS (
            SELECT *,
                   CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
                   CAST(sum(weight) OVER (ORDER BY k
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
            FROM ordered
        ), level AS (
            SELECT k AS first_free, remaining AS level_words, weights AS level_weights
            FROM left_over WHERE remaining * weight <= cap * weights ORDER BY k LIMIT 1
        ), goals AS (
            SELECT source, source_size,
                   CASE WHEN k < first_free THEN CAST(cap AS DOUBLE)
                        ELSE CAST(level_words * weight AS DOUBLE) / level_weights END AS target
            FROM left_over, level
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(CASE WHEN size = 0 THEN 0
                    ELSE size * (CAST(round(target) AS BIGINT) // source_size)
                         + least(size, greatest(0, CAST(round(target) AS BIGINT) % source_size - start))
                    END AS BIGINT) AS taken
        FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source
    """,
    "op11_conversations": _REPAIR,
    # Bytes as pairs of hexadecimal digits.
    "op12_passages": """
        WITH texts AS (
            SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS h
            FROM documents
        ), pages AS (
            SELECT r, doc_id, base, substr(h, 2 * base + 1, 2 * 549) AS page
            FROM (SELECT *, unnest(range(0, length(h) // 2 - 49, 500)) AS base FROM texts)
        ), windows AS (
            SELECT r, doc_id, base + k AS k, substr(page, 2 * k + 1, 100) AS w
            FROM (SELECT *, unnest(range(length(page) // 2 - 49)) AS k FROM pages)
        ), firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
        hits AS (
            SELECT r, k FROM windows JOIN firsts USING (w)
            WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)
        ), starts AS (
            SELECT r, k, k - lag(k, 1, -1000) OVER (PARTITION BY r ORDER BY k) > 50 AS is_new FROM hits
        ), spans AS (
            SELECT r, min(k) AS a, max(k) + 50 AS b FROM (
                SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY r ORDER BY k) AS span FROM starts
            ) GROUP BY r, span
        ), gaps AS (
            SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans
        ), pieces AS (
            SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
            FROM gaps JOIN texts USING (r) GROUP BY r
        )
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
               CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM texts LEFT JOIN pieces USING (r)
    """,
    "op13_ranking": f"""
        WITH texts AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, {_TERM}) AS terms
            FROM documents
        ), sums AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM texts WHERE len(terms) > 0),
        counts AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) GROUP BY r, term
        ), asked AS (
            SELECT DISTINCT q, item_id, term FROM (
                SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term
                FROM benchmark
            )
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM counts, sums WHERE term IN (SELECT term FROM asked) GROUP BY term
        ), lengths AS (
            SELECT r, doc_id, CAST(10 + (90 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM texts, sums
        ), scores AS (
            SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r)
            GROUP BY q, item_id, doc_id, r
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
            FROM scores WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
