"""DuckDB SQL of the pipeline queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Characters that the chat template adds to a text: one per backslash and per control string.
_ESCAPED = "length(regexp_replace(replace({0}, chr(92), chr(92) || chr(92)), '(<|\\[)(/?(?:s>|INST\\]))', '\\1' || chr(1) || '\\2', 'g'))"

#: Words of a text by the two contracts, as lists.
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PLAIN = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item, w[s:s + least(13, len(w)) - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
        own AS (SELECT r, s, n, w[s:s + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)),
        hits AS (SELECT r, s, n, item FROM own JOIN windows USING (win)),
        places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
        items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
    """,
    "op7_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(_LOWER)} AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, w[s:s + least(5, len(w)) - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_one AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, m) AS component_id FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_one ON a = doc_id
    """,
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM documents),
        windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
        again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
    """,
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY body)
    """,
    "op10_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(17 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
}
