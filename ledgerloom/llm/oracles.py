"""DuckDB SQL of the operators' queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP4 = f"""
WITH sizes AS (
    SELECT doc_id, source, {WORDS} AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sizes GROUP BY source
), weighed AS (
    SELECT *, [3, 1, 2][source_rank % 3 + 1] AS weight FROM totals
), leveled AS (
    SELECT *, source_size * 2 / weight AS full_level, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (
            ORDER BY source_size * 2 / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
        / (sum(weight) OVER (ORDER BY source_size * 2 / weight, source_rank
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed
), water AS (
    SELECT level FROM leveled WHERE level <= full_level ORDER BY full_level, source_rank LIMIT 1
), targets AS (
    SELECT *, least(source_size * 2::DOUBLE, (SELECT level FROM water) * weight) AS target FROM leveled
), copies AS (
    SELECT doc_id, place, size, target, source_rank, budget, pass, (pass * source_size + sum(size) OVER (
            PARTITION BY source_rank, pass ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)) / target AS finish
    FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source, (VALUES (0), (1)) AS passes(pass)
    WHERE size > 0 AND target > 0
), served AS (
    SELECT doc_id, size, budget, sum(size) OVER (
        ORDER BY finish, source_rank, pass, place, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM copies
), taken AS (
    SELECT doc_id, sum(size) AS taken FROM served WHERE total <= budget GROUP BY doc_id
)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.doc_id = s.doc_id
"""


OP3 = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), roots AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

OP5 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, payload_bytes >= 100 AS long_enough FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN long_enough AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN long_enough AND first <> page_id THEN first END AS refers_to FROM firsts
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), f1 AS (
    SELECT lang, w[i] AS w1, count(*) AS f FROM places GROUP BY ALL
), f2 AS (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL
), f3 AS (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10
), longest AS (
    SELECT lang, w1, w2, max(f) AS longest FROM (
        SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3
    ) GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, a.f AS l, b.f AS r, 1 AS k
    FROM f2 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f1 b ON b.lang = c.lang AND b.w1 = c.w2
    LEFT JOIN longest g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2
    WHERE c.f >= 10 AND (g.longest IS NULL OR 100 * g.longest < 50 * c.f)
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, a.f, b.f, 1
    FROM f3 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f2 b ON b.lang = c.lang AND b.w1 = c.w2 AND b.w2 = c.w3
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, a.f, b.f, 2
    FROM f3 c JOIN f2 a ON a.lang = c.lang AND a.w1 = c.w1 AND a.w2 = c.w2 JOIN f1 b ON b.lang = c.lang AND b.w1 = c.w3
), scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest QUALIFY rank <= 2000
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang)
"""

OP13 = rf"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS d, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS gram FROM (
        SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), grams AS (
    SELECT DISTINCT gram, len(gram) AS n FROM windows
), hits AS (
    SELECT d, i, n, gram FROM (
        SELECT d, w, i, n, list_slice(w, i, i + n - 1) AS own FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM docs),
            (SELECT DISTINCT n FROM grams) WHERE i + n - 1 <= len(w)
    ) JOIN grams g USING (n) WHERE own = g.gram
), covered AS (
    SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM hits) GROUP BY d
), held AS (
    SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said
    FROM (SELECT DISTINCT d, item_id::VARCHAR AS item FROM hits JOIN windows USING (gram)) GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (d) LEFT JOIN held USING (d)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op3_embedding_dedup": OP3,
        "op4_fair_mix": OP4,
        "op5_warc": OP5,
        "op12_phrase_mining": OP12,
        "op13_decontamination": OP13,
    }
