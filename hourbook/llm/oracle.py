"""DuckDB SQL of the URL filters, the vector codes and the filter audit, written
from their definitions (every rule, entry and order against every row)."""

from __future__ import annotations

from itertools import permutations


def url_filters_sql(rules: list[tuple[str, str, str]], default: str) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
urls AS (
    SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), fits AS (
    SELECT n, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
    FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{default}') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE place = 1) AS best USING (n)
"""


def vector_codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Assignment and floored means, written out round by round.  Ids are taken to be unique."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT vec_id, label, p, k, d FROM (
        SELECT vec_id, any_value(label) AS label, p, k, sum((c.v - e.v) * (c.v - e.v))::BIGINT AS d
        FROM components c JOIN e{i} e USING (p, i) GROUP BY vec_id, p, k
    ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
    SELECT p, k, i, sum(v)::BIGINT AS s, count(*) AS n FROM components JOIN a{i} USING (vec_id, p) GROUP BY p, k, i
), e{i + 1} AS MATERIALIZED (
    SELECT p, k, i, CASE WHEN n IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v FROM e{i} LEFT JOIN m{i} USING (p, k, i)
)"""
            )
    return f"""
WITH kept AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS MATERIALIZED (
    SELECT vec_id, label, pos // w AS p, pos % w AS i, v FROM (
        SELECT vec_id, label, len(embedding) // {parts} AS w, unnest(range(len(embedding))) AS pos, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept
    )
), e0 AS MATERIALIZED (
    SELECT p, k, i, v FROM components JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {entries}) USING (vec_id)
), {", ".join(steps)}, book AS (
    SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM e{rounds}
), coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(k), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


def filter_audit_sql(filters: str) -> str:
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(filters))
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
    SELECT body, min(doc_id) AS first_id FROM texts GROUP BY body
), marks AS (
    SELECT doc_id, part, [
        len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
        100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 10 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first_id, false)
    ] AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
    FROM texts JOIN firsts USING (body) LEFT JOIN labels USING (doc_id)
), cells AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marks GROUP BY part, fails
), orders(filter_order) AS (VALUES {orders}),
steps AS (
    SELECT filter_order, step, strpos('{filters}', filter_order[step]) AS own, [strpos('{filters}', x) FOR x IN string_split(filter_order[:step - 1], '') IF x <> ''] AS earlier
    FROM orders, (SELECT unnest(range(1, {len(filters)} + 1)) AS step)
), judged AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, len([x FOR x IN earlier IF fails[x]]) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single
    FROM cells, steps
), figures AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND single), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""
