"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from skysieve.llm import bm25, pii, secret_scan

_WORD = r"(?:^|[^a-z0-9_])(?:{})(?:$|[^a-z0-9_])"


def _places(kinds: list[tuple[str, str, int]], keep: str, score: str) -> str:
    """CTEs ending in ``spans(rid, kind, rank, s, e, score)``; ``kinds`` are (kind, expression, value's group)."""
    found = " UNION ALL ".join(
        f"""SELECT rid, t, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{r}', 0) AS ms,
               regexp_extract_all(t, '{r}', {g}) AS vs, string_split_regex(t, '{r}') AS gs
            FROM d WHERE regexp_matches(t, '{r}')"""
        for i, (k, r, g) in enumerate((k, r.replace("'", "''"), g) for k, r, g in kinds))
    return f"""
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({found}),
        pieces AS (SELECT rid, t, kind, rank, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
            'm': ms[i], 'v': vs[i],
            's': list_sum(list_transform(gs[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)}})) AS p FROM found),
        placed AS (SELECT rid, t, kind, rank, p.m AS m, p.v AS v, CAST(p.s AS BIGINT) AS s,
            CAST(p.s + length(p.m) AS BIGINT) AS e FROM pieces),
        near AS (SELECT *, lower(substr(t, greatest(s - 40, 0) + 1, e - s + 40 + least(s, 40))) AS near FROM placed
            WHERE {keep}),
        spans AS (SELECT rid, kind, rank, s, e, {score} AS score FROM near)"""


def _digest(spans: str, base: tuple[str, ...], extra: str = "", where: str = "") -> str:
    kinds = ", ".join(f"'{k}'" for k in base)
    one = "kind || ':' || s || ':' || e"
    return f"""WITH {spans},
        per AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)},
            string_agg({one}, ',' ORDER BY s, rank) FILTER (kind IN ({kinds})) AS base,
            string_agg({one}, ',' ORDER BY s, rank) AS spans{extra} FROM spans {where} GROUP BY rid)
        SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in base)},
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
            {", coalesce(scores, '') AS scores" if extra else ""}
        FROM d LEFT JOIN per USING (rid)"""


def secrets() -> str:
    kinds = [(r.kind, r.pattern, r.group) for r in secret_scan.RULES]
    return _digest(_places(kinds, "(kind <> 'assign' OR length(v) >= 12)", "100"), secret_scan.BASE)


def personal_data() -> str:
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0),
        ("iban", r"[A-Z0-9]+", 0),
        ("ssn", r"[0-9-]+", 0),
    ]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE
        WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INT)
        WHEN CAST(substr(reverse({digits}), i, 1) AS INT) > 4 THEN CAST(substr(reverse({digits}), i, 1) AS INT) * 2 - 9
        ELSE CAST(substr(reverse({digits}), i, 1) AS INT) * 2 END)) % 10 = 0"""
    mod = """list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ord(c) - 48 AS INT) ELSE CAST(ord(c) - 55 AS INT) END)),
        lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"""
    keep = f"""CASE kind WHEN 'email' THEN true
        WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3
            AND CAST('0' || right(ltrim(x, '0'), 3) AS INT) <= 255))
        WHEN 'card' THEN length({digits}) BETWEEN 14 AND 19 AND {luhn}
        WHEN 'phone' THEN length({digits}) BETWEEN 10 AND 15
        WHEN 'iban' THEN regexp_full_match(m, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {mod}
        ELSE regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') END"""

    def near(words: str, gain: int) -> str:
        return f"CASE WHEN regexp_matches(near, '{_WORD.format(words)}') THEN {gain} ELSE 0 END"

    score = f"""greatest(0, least(100, CASE kind
        WHEN 'email' THEN 90 + {near("mail|e-mail|email|contact|write", 10)}
        WHEN 'ip' THEN 60 + {near("ip|address|host|server|login", 30)} - {near(pii.NOT, 30)}
        WHEN 'card' THEN 80 + {near("card|visa|credit|debit|pay|payment", 20)} - {near(pii.NOT, 30)}
        WHEN 'phone' THEN 70 + {near("phone|tel|call|mobile|fax", 30)}
        WHEN 'iban' THEN 80 + {near("iban|account|bank|transfer", 20)}
        ELSE 40 + {near("ssn|social security|national id|tax id", 40)} - {near(pii.NOT, 20)} END))"""
    return _digest(_places(kinds, keep, score), pii.BASE, ", string_agg(score, ',' ORDER BY s, rank) AS scores",
                   "WHERE kind <> 'ssn' OR score >= 60")


def search(k: int = 10) -> str:
    marks = bm25.MARKS.replace("'", "''")
    return f"""WITH
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, unnest(list_transform(regexp_extract_all(
            translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'),
            lambda x: trim(x, '{marks}'))) AS term FROM d),
        tf AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS c FROM w WHERE term <> '' GROUP BY rid, term),
        len AS (SELECT d.rid, CAST(coalesce(sum(c), 0) AS DOUBLE) AS dl FROM d LEFT JOIN tf ON d.rid = tf.rid GROUP BY d.rid),
        st AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM len),
        idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
        q AS (SELECT DISTINCT doc_id AS query_id, term FROM tf WHERE doc_id % 100 = 0),
        ranked AS (SELECT query_id, term, idf FROM q JOIN idf USING (term)),
        sc AS (SELECT query_id, tf.rid, tf.doc_id, round(sum(idf * c * {bm25.K1 + 1} / (c + {bm25.K1} * ({1 - bm25.B} + {bm25.B} * dl / mean))), 9)
            AS score FROM ranked JOIN tf USING (term) JOIN len ON tf.rid = len.rid, st GROUP BY 1, 2, 3),
        top AS (SELECT query_id, doc_id, score, row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc)
        SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM top WHERE rank <= {k}"""


def ranked() -> str:
    """The 50 best documents of each benchmark item."""
    found = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
            "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {found} AS ts FROM documents),
        stat AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
        tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tf, stat GROUP BY term, n),
        q AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
        s AS (SELECT item_id, tf.rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (
                50 + (50 * len(ts) * n) // l)))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.rid = tf.rid CROSS JOIN stat
            GROUP BY item_id, tf.rid, doc_id),
        r AS (SELECT item_id, doc_id, score, row_number() OVER (
            PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""
