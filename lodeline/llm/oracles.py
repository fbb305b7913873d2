"""DuckDB SQL for the operators that SQL can express in reasonable time over whole tables."""

# Base32 of a SHA-1 in hex: eight letters from each ten hex digits.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WINDOWS = "[array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]"

ORACLES: dict[str, str] = {
    "op1_warc_revisits": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
    """,
    "op6_size_tiered_compaction": """
        SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes
        FROM documents
    """,
    # Sizes of windows are those of the items; documents have every window of these sizes.
    "op8_benchmark_decontamination": f"""
        WITH b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
        theirs AS (SELECT DISTINCT item_id, size, unnest({_WINDOWS}) AS win FROM b),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT size FROM b),
        ours AS (SELECT doc_id, size, unnest({_WINDOWS}) AS win, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
        hits AS (SELECT doc_id, pos, o.size, item_id FROM ours o JOIN theirs t ON t.size = o.size AND t.win = o.win),
        words AS (SELECT doc_id, count(DISTINCT nth) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS nth FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS nth, doc_id, {_WORDS} AS t FROM documents),
        stats AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
        post AS (SELECT nth, doc_id, n, term, count(*) AS tf FROM (SELECT nth, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
        terms AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, stats GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
        scored AS (
            SELECT item_id, nth, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM q JOIN post USING (term) JOIN terms USING (term), stats GROUP BY ALL
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
    """,
}
