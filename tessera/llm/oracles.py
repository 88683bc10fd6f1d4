"""DuckDB SQL of the llm queries that SQL can express."""

ORACLES = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_bm25": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
        w AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
            FROM d),
        tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
        len AS (SELECT r, sum(tf) AS dl FROM tf GROUP BY r),
        s AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM d) AS mean),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT doc_id AS query_id, term, df FROM tf JOIN df USING (term) WHERE doc_id % 20 = 0),
        scored AS (
            SELECT query_id, r, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
            FROM q JOIN tf USING (term) JOIN len USING (r), s GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score
        FROM scored QUALIFY rank <= 10""",
    "op1_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        j AS (SELECT a, b, k, x.n AS na, y.n AS nb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
        links AS (SELECT a, b FROM j WHERE 100 * k >= 85 * (na + nb - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        e AS (SELECT a AS doc_id, count(*) AS m FROM j WHERE k = na AND k = nb GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, 1 + coalesce(m, 0) AS n_copies FROM c LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op10_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        i AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS pos FROM h WHERE n >= 50),
        w AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS g FROM i),
        f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
        hit AS (SELECT w.doc_id, pos FROM w JOIN f USING (g) WHERE least < doc_id),
        s AS (SELECT doc_id, pos, sum(CASE WHEN pos - prev > 50 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
              FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM hit)),
        r AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM s GROUP BY doc_id, run),
        k AS (SELECT r.*, x, n, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS upto FROM r JOIN h USING (doc_id)),
        d AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM k GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN d USING (doc_id)""",
}
