"""SQL of the operators that SQL can express, for DuckDB."""

SQL: dict[str, str] = {
    "op1_url_decisions": r"""
        WITH RECURSIVE
        link AS (
            SELECT url, unnest([
                regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
                regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)]) AS to_url
            FROM pages WHERE url IS NOT NULL AND html IS NOT NULL AND trim(url) <> ''
        ),
        near AS (SELECT url, to_url, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS bare FROM link WHERE to_url <> ''),
        target AS (
            SELECT url, CASE
                WHEN regexp_matches(to_url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN to_url
                WHEN to_url LIKE '/%' THEN regexp_extract(bare, '^[^/]*') || to_url
                WHEN to_url LIKE '?%' OR to_url LIKE '#%' THEN bare || to_url
                WHEN contains(bare, '/') THEN regexp_replace(bare, '[^/]*$', '') || to_url
                ELSE bare || '/' || to_url END AS to_url
            FROM near
        ),
        address AS (SELECT DISTINCT coalesce(url, '') AS u FROM pages UNION SELECT to_url FROM target),
        bare AS (SELECT u, regexp_replace(regexp_replace(trim(u), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS b FROM address),
        keyed AS (
            SELECT u, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_replace(
                regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1), '[?&](utm_[A-Za-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^([^?&]*)&', '\1?'), '/+$', '') AS key
            FROM bare
        ),
        edge AS (
            SELECT DISTINCT x.key AS a, y.key AS b FROM target t JOIN keyed x ON x.u = t.url JOIN keyed y ON y.u = t.to_url WHERE x.key <> '' AND y.key <> ''
        ),
        both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
        reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
        rooted AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY a),
        named AS (
            SELECT key, coalesce(root, key) AS root,
                regexp_matches(regexp_extract(key, '^[^/?]*'), '(^|\.)(m\.ads-track\.example\.com)$') AS allowed,
                regexp_matches(regexp_extract(key, '^[^/?]*'), '(^|\.)(ads-track|casino-win|cheap-pills|free-bets)\.example\.com$') AS blocked
            FROM (SELECT DISTINCT key FROM keyed) LEFT JOIN rooted USING (key)
        ),
        bad AS (SELECT DISTINCT root FROM named WHERE blocked AND NOT allowed AND key IN (SELECT key FROM rooted))
        SELECT page_id, url, n.root AS alias_of,
            CASE WHEN n.allowed THEN 'allow' WHEN n.blocked OR bad.root IS NOT NULL THEN 'block' ELSE 'pass' END AS decision
        FROM pages JOIN keyed k ON k.u = coalesce(url, '') JOIN named n ON n.key = k.key LEFT JOIN bad ON bad.root = n.root
    """,
    "op2_mixture": """
        WITH RECURSIVE
        tok AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS n FROM documents),
        src AS (SELECT source AS s, sum(n)::BIGINT AS n FROM tok GROUP BY source HAVING sum(n) > 0),
        tot AS (SELECT sum(n)::BIGINT AS t, count(*) AS c FROM src),
        top AS (SELECT -sum(n / t::DOUBLE * ln(n / t::DOUBLE)) >= 0.97 * ln(max(c)) - 1e-12 AS even FROM src, tot),
        spread AS (
            SELECT CASE WHEN even THEN 1048576 ELSE 0 END AS low, 1048576 AS high FROM top
            UNION ALL
            SELECT CASE WHEN good THEN mid ELSE low END, CASE WHEN good THEN high ELSE mid END
            FROM (
                SELECT low, high, mid, ln(sum(r)) - sum(r * ln(r)) / sum(r) >= 0.97 * ln(max(c)) - 1e-12 AS good
                FROM (SELECT low, high, (low + high) // 2 AS mid, pow(n / t::DOUBLE, ((low + high) // 2) / 1048576.0) AS r, c FROM spread, src, tot WHERE high - low > 1)
                GROUP BY low, high, mid
            )
        ),
        first AS (SELECT max(low) AS k FROM spread),
        limits AS (
            SELECT CASE WHEN max(r / n * t) / sum(r) <= 4.0 + 1e-9 THEN k ELSE -k - 1 END AS k
            FROM (SELECT k, n, t, pow(n / t::DOUBLE, k / 1048576.0) AS r FROM first, src, tot) GROUP BY k
        ),
        repeats AS (
            SELECT CASE WHEN k >= 0 THEN k ELSE -k - 1 END AS lack, CASE WHEN k >= 0 THEN k ELSE 1048576 END AS fits FROM limits
            UNION ALL
            SELECT CASE WHEN good THEN lack ELSE mid END, CASE WHEN good THEN mid ELSE fits END
            FROM (
                SELECT lack, fits, mid, max(r / n * t) / sum(r) <= 4.0 + 1e-9 AS good
                FROM (SELECT lack, fits, (lack + fits) // 2 AS mid, n, t, pow(n / t::DOUBLE, ((lack + fits) // 2) / 1048576.0) AS r FROM repeats, src, tot WHERE fits - lack > 1)
                GROUP BY lack, fits, mid
            )
        ),
        alpha AS (SELECT min(fits) / 1048576.0 AS a FROM repeats),
        raw AS (SELECT s, n, t, pow(n / t::DOUBLE, a) AS r FROM src, tot, alpha),
        plan AS (SELECT s, n, greatest(1, (n + 99999) // 100000) AS blocks, floor(r / (SELECT sum(r) FROM raw) * t + 0.5)::BIGINT AS part FROM raw),
        placed AS (
            SELECT doc_id, text, s, tok.n AS tokens, plan.n AS total, part, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT) % blocks AS b
            FROM tok JOIN plan ON source IS NOT DISTINCT FROM s WHERE tok.n > 0
        ),
        sizes AS (SELECT s, b, any_value(total) AS total, any_value(part) AS part, sum(tokens)::BIGINT AS size FROM placed GROUP BY s, b),
        passes AS (SELECT *, unnest(range(0, (part - 1) // total + 1)) AS e FROM sizes WHERE part > 0),
        turned AS (SELECT *, md5(concat_ws('|', e::VARCHAR, coalesce(s, ''), b::VARCHAR)) AS turn FROM passes),
        ordered AS (
            SELECT *, row_number() OVER w - 1 AS place, e * total + sum(size) OVER w - size AS before
            FROM turned WINDOW w AS (PARTITION BY s, e ORDER BY turn, b)
        ),
        blocks AS (SELECT s, b, e, place, size, part - before AS room FROM ordered WHERE before < part),
        taken AS (SELECT p.doc_id, p.text, p.tokens, k.* FROM placed p JOIN blocks k ON p.s IS NOT DISTINCT FROM k.s AND p.b = k.b),
        cut AS (
            SELECT *, row_number() OVER w - 1 AS spot, sum(tokens) OVER w - tokens AS ahead
            FROM taken WHERE room < size
            WINDOW w AS (PARTITION BY s, b, e ORDER BY md5(concat_ws('|', 'd', e::VARCHAR, doc_id::VARCHAR)), doc_id, md5(text) ROWS UNBOUNDED PRECEDING)
        )
        SELECT doc_id, s AS source, e::INT AS mix_epoch, place::INT AS mix_block, 0::INT AS mix_place FROM taken WHERE room >= size
        UNION ALL
        SELECT doc_id, s, e::INT, place::INT, spot::INT FROM cut WHERE ahead < room
    """,
    "op3_exact_duplicates": """
        SELECT DISTINCT doc_id, first AS duplicate_of
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        WHERE doc_id > first
    """,
}
