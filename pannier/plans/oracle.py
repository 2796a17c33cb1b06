"""The registered queries as plain SQL over the given tables, for DuckDB.

Written independently of the DataFrame code: straight joins and windows, without
its block numbering, shared lists or histograms. Doubles are rounded to six
places after adding 1e-9: a value on a rounding limit then falls to the same side
whatever the order of summation.
"""

from __future__ import annotations

from pannier.functions.scalar import STOPWORDS

K = 10
TOP = 20


class _Sql:
    """Named steps; ``q`` puts those a query needs before its final select."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str]] = []

    def step(self, name: str, body: str) -> None:
        self.steps.append((name, body))

    def q(self, last: str, final: str) -> str:
        """All steps up to and including ``last``, then ``final`` (more steps start with a comma)."""
        names = [n for n, _ in self.steps]
        upto = self.steps[: names.index(last) + 1]
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in upto) + "\n" + final


def _split(test_days: int) -> str:
    return f"""
    SELECT order_id, profile_id, order_ts, size,
           order_ts < train_end AS in_train,
           order_ts >= train_end AND order_ts < test_end AS in_test,
           order_ts >= oot_start AS in_oot
    FROM headers, (
        SELECT min(order_ts) + INTERVAL 1825 DAY AS train_end,
               min(order_ts) + INTERVAL {1825 + test_days} DAY AS test_end,
               max(order_ts) - INTERVAL 210 DAY AS oot_start
        FROM headers)
    WHERE size >= 2"""


def _pair_score(metric: str) -> str:
    lift = "(c / n) / ((fa / n) * (fb / n))"
    return {
        "lift": lift,
        "pmi": f"log2({lift})",
        "npmi": f"CASE WHEN -log2(c / n) > 0 THEN log2({lift}) / -log2(c / n) ELSE 0 END",
    }[metric]


def _assoc(metric: str, support: int) -> str:
    return f"""
    SELECT unnest([item_a, item_b]) AS item_id, unnest([item_b, item_a]) AS other_id,
           pair_count, score
    FROM (
        SELECT item_a, item_b, pair_count, {_pair_score(metric)} AS score
        FROM (
            SELECT item_a, item_b, pair_count, pair_count::DOUBLE AS c,
                   x.freq::DOUBLE AS fa, y.freq::DOUBLE AS fb,
                   (SELECT count(DISTINCT order_id) FROM train)::DOUBLE AS n
            FROM pairs JOIN counts x ON x.item_id = item_a JOIN counts y ON y.item_id = item_b
            WHERE pair_count >= {support}))
    WHERE score > 0"""


def _held(split: str) -> str:
    return f"""
    SELECT order_id AS query_id,
           arg_min(item_id, md5(concat_ws(':', order_id::VARCHAR, item_id::VARCHAR, '42')))
               AS held_out,
           max(profile_id) AS profile_id
    FROM items WHERE in_{split} GROUP BY 1"""


def _query_items(split: str, cases: str) -> str:
    return f"""
    SELECT order_id AS query_id, item_id
    FROM items JOIN {cases} ON order_id = query_id
    WHERE in_{split} AND item_id <> held_out"""


def _ranked(source: str, k: int, owned: str | None = "qi") -> str:
    free = (
        f"""WHERE NOT EXISTS (SELECT 1 FROM {owned} o
            WHERE o.query_id = s.query_id AND o.item_id = s.item_id)"""
        if owned
        else ""
    )
    return f"""
    SELECT query_id, row_number() OVER (
               PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank,
           item_id, score
    FROM {source} s {free}
    QUALIFY rank <= {k}"""


def _cooc_sum(assoc: str, queries: str = "qi") -> str:
    return f"""
    SELECT query_id, other_id AS item_id, sum(score) AS score
    FROM {queries} JOIN {assoc} USING (item_id) GROUP BY 1, 2"""


def _popular(queries: str, cases: str, k: int) -> str:
    return f"""
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS rank,
           r.item_id, freq::DOUBLE AS score
    FROM {cases} JOIN ranks r ON r.rank <= {k} + (SELECT max(c) FROM (
        SELECT count(*) AS c FROM {queries} GROUP BY query_id))
    WHERE NOT EXISTS (SELECT 1 FROM {queries} o
        WHERE o.query_id = {cases}.query_id AND o.item_id = r.item_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r.rank) <= {k}"""


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tfidf(texts: str, max_features: int) -> list[tuple[str, str]]:
    p = texts
    return [
        (
            f"{p}_words",
            f"""SELECT item_id, list_filter(
                    regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                    lambda w: NOT list_contains({_STOP}, w)) AS w
                FROM {p} WHERE length(description) > 0""",
        ),
        (
            f"{p}_terms",
            f"""SELECT item_id, term, count(*) AS n FROM (
                    SELECT item_id, unnest(w) AS term FROM {p}_words
                    UNION ALL
                    SELECT item_id,
                           unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                    FROM {p}_words)
                GROUP BY 1, 2""",
        ),
        (
            f"{p}_vocab",
            f"""SELECT term, count(*) AS df, sum(n) AS corpus_n FROM {p}_terms GROUP BY 1
                ORDER BY corpus_n DESC, term LIMIT {max_features}""",
        ),
        (
            f"{p}_raw",
            f"""SELECT item_id, term,
                       (1 + ln(n::DOUBLE)) * (ln((1 + (SELECT count(*) FROM {p}_words))::DOUBLE
                                                 / (1 + df)) + 1) AS w
                FROM {p}_terms JOIN {p}_vocab USING (term)""",
        ),
        (
            f"{p}_tfidf",
            f"""SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight
                FROM {p}_raw""",
        ),
    ]


def _norm_part(name: str) -> str:
    return f"""CASE WHEN max({name}) OVER g > 0
        THEN coalesce({name}, 0) / max({name}) OVER g ELSE 0 END AS {name}"""


def _parts(pool: str, text: str) -> str:
    """Pool with its three parts scaled by their maximum; text comes from a step."""
    return f"""
    SELECT query_id, item_id, {_norm_part('cooc')}, {_norm_part('category')}, {_norm_part('text')}
    FROM (
        SELECT p.query_id, p.item_id, p.score AS cooc, c.category, t.text
        FROM {pool} p
        LEFT JOIN {pool}_category c USING (query_id, item_id)
        LEFT JOIN {text} t USING (query_id, item_id))
    WINDOW g AS (PARTITION BY query_id)"""


def _category(pool: str) -> str:
    return f"""
    SELECT p.query_id, p.item_id,
           greatest(0, coalesce(max(affinity), 0)) AS category
    FROM {pool} p JOIN cat pc ON pc.item_id = p.item_id
    JOIN qi ON qi.query_id = p.query_id JOIN cat qc ON qc.item_id = qi.item_id
    LEFT JOIN affinity ON cat_a = qc.category AND cat_b = pc.category
    GROUP BY 1, 2"""


def _text(pool: str) -> str:
    return f"""
    WITH mine AS (SELECT query_id, term, sum(weight) AS q
                  FROM qi JOIN names_tfidf USING (item_id) GROUP BY 1, 2),
         long AS (SELECT query_id, sqrt(sum(q * q)) AS len FROM mine GROUP BY 1)
    SELECT p.query_id, p.item_id, sum(weight * q) / any_value(len) AS text
    FROM {pool} p JOIN names_tfidf t ON t.item_id = p.item_id
    JOIN mine m ON m.query_id = p.query_id AND m.term = t.term
    JOIN long l ON l.query_id = p.query_id
    GROUP BY 1, 2"""


def _dense(pool: str) -> str:
    return f"""
    WITH mine AS (SELECT query_id, dim, sum(value) AS q
                  FROM qi JOIN dims USING (item_id) GROUP BY 1, 2),
         long AS (SELECT query_id, sqrt(sum(q * q)) AS len FROM mine GROUP BY 1)
    SELECT p.query_id, p.item_id, sum(value * q) / (any_value(len) * sqrt(sum(value * value)))
               AS text
    FROM {pool} p JOIN dims t ON t.item_id = p.item_id
    JOIN mine m ON m.query_id = p.query_id AND m.dim = t.dim
    JOIN long l ON l.query_id = p.query_id
    GROUP BY 1, 2"""


def _metrics_of(recs: str, cases: str) -> str:
    hits = ", ".join(
        f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS hit{k}" for k in (5, 10, 20)
    )
    return f"""
    SELECT {hits}, avg(CASE WHEN rank <= {TOP} THEN 1.0 / rank ELSE 0.0 END) AS mrr
    FROM {cases} c LEFT JOIN {recs} r
        ON r.query_id = c.query_id AND r.item_id = c.held_out"""


def _blend(parts: str, a: float, b: float, c: float) -> str:
    return f"(SELECT query_id, item_id, {a!r} * cooc + {b!r} * category + {c!r} * text AS score FROM {parts})"


def _steps() -> _Sql:
    s = _Sql()
    s.step(
        "lines",
        """SELECT l_orderkey AS order_id, o_custkey AS profile_id, o_orderdate AS created_at,
                  l_partkey AS item_id, o_orderstatus AS status,
                  l_linenumber::BIGINT * 1099511627776 + l_partkey AS pos
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    )
    s.step("good", "SELECT * FROM lines WHERE status IN ('F', 'O')")
    s.step(
        "oi", "SELECT order_id, item_id, min(pos) AS pos FROM good GROUP BY 1, 2"
    )
    s.step(
        "headers",
        """SELECT order_id, arg_min(profile_id, pos) AS profile_id, min(created_at) AS order_ts,
                  count(DISTINCT item_id) AS size
           FROM good GROUP BY 1""",
    )
    s.step("split", _split(210))
    s.step("items", "SELECT * FROM oi JOIN split USING (order_id)")
    s.step("train", "SELECT * FROM items WHERE in_train")
    s.step("titles", "SELECT DISTINCT item_id, p_name AS title FROM good JOIN part ON p_partkey = item_id")
    s.step(
        "history",
        """SELECT profile_id, item_id,
                  arg_min({'t': order_ts, 'o': order_id, 'p': pos},
                          {'t': order_ts, 'o': order_id, 'p': pos}) AS f
           FROM train GROUP BY 1, 2""",
    )
    s.step("counts", "SELECT item_id, count(*) AS freq FROM train GROUP BY 1")
    s.step(
        "ranks",
        "SELECT item_id, freq, row_number() OVER (ORDER BY freq DESC, item_id) AS rank FROM counts",
    )
    s.step(
        "pairs",
        """SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS pair_count
           FROM train a JOIN train b ON a.order_id = b.order_id AND a.item_id < b.item_id
           GROUP BY 1, 2""",
    )
    s.step("cat", "SELECT p_partkey AS item_id, p_type AS category FROM part")
    s.step("bc", "SELECT DISTINCT order_id, category FROM train JOIN cat USING (item_id)")
    s.step("cc", "SELECT category, count(*)::DOUBLE AS f FROM bc GROUP BY 1")
    s.step(
        "cp",
        """SELECT ca, cb, (c / n) / ((x.f / n) * (y.f / n)) AS affinity
           FROM (SELECT a.category AS ca, b.category AS cb, count(*)::DOUBLE AS c,
                        (SELECT count(DISTINCT order_id) FROM train)::DOUBLE AS n
                 FROM bc a JOIN bc b ON a.order_id = b.order_id AND a.category < b.category
                 GROUP BY 1, 2)
           JOIN cc x ON x.category = ca JOIN cc y ON y.category = cb""",
    )
    s.step(
        "affinity",
        """SELECT ca AS cat_a, cb AS cat_b, affinity FROM cp
           UNION ALL SELECT cb, ca, affinity FROM cp
           UNION ALL SELECT category, category, 1.5 FROM cc""",
    )
    s.step("cases", _held("test"))
    s.step("qi", _query_items("test", "cases"))
    s.step(
        "thresholds",
        "SELECT quantile_cont(freq, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS t FROM counts",
    )
    s.step(
        "buckets",
        """SELECT item_id, freq, CASE WHEN freq <= t[2] THEN 0 WHEN freq <= t[3] THEN 1
                  WHEN freq <= t[4] THEN 2 WHEN freq <= t[5] THEN 3 ELSE 4 END::BIGINT AS bucket
           FROM counts, thresholds""",
    )
    s.step("assoc", _assoc("npmi", 1))
    s.step("cooc", _cooc_sum("assoc"))
    s.step("cooc_recs", _ranked("cooc", TOP))
    s.step("popular_recs", _popular("qi", "cases", TOP))
    s.step("cooc_recs_category", _category("cooc_recs"))
    s.step("names", "SELECT p_partkey AS item_id, p_name AS description FROM part")
    for name, body in _tfidf("names", 10_000):
        s.step(name, body)
    s.step(
        "dims",
        """SELECT vec_id AS item_id, unnest(range(len(embedding))) AS dim,
                  unnest(embedding)::DOUBLE AS value FROM embeddings""",
    )
    s.step("cases_oot", _held("oot"))
    s.step("qi_oot", _query_items("oot", "cases_oot"))
    s.step("cooc_oot", _cooc_sum("assoc", "qi_oot"))
    s.step("cooc_recs_oot", _ranked("cooc_oot", TOP, "qi_oot"))
    s.step("popular_recs_oot", _popular("qi_oot", "cases_oot", TOP))
    s.step(
        "wide",
        " UNION ALL ".join(
            f"""SELECT '{model}' AS model,
                t.hit5 AS test_hit5, t.hit10 AS test_hit10, t.hit20 AS test_hit20,
                t.mrr AS test_mrr,
                o.hit5 AS oot_hit5, o.hit10 AS oot_hit10, o.hit20 AS oot_hit20, o.mrr AS oot_mrr
            FROM ({_metrics_of(recs, 'cases')}) t, ({_metrics_of(recs + '_oot', 'cases_oot')}) o"""
            for model, recs in (("TopPopular", "popular_recs"), ("CooccurrenceLift", "cooc_recs"))
        ),
    )
    return s


_RECS = "SELECT query_id, rank, item_id, round(score + 1e-9, 6) AS score FROM "


def oracle_sql() -> dict[str, str]:
    s = _steps()
    out: dict[str, str] = {}
    split_cols = "order_id, profile_id, order_ts, size, in_train, in_test, in_oot"
    out["status_filter"] = s.q("good", "SELECT order_id, item_id, pos, status FROM good")
    out["basket_assembly"] = s.q("good", "SELECT order_id, pos, item_id FROM good")
    out["basket_dedup"] = s.q("oi", "SELECT order_id, item_id, pos FROM oi")
    out["order_headers"] = s.q("headers", "SELECT order_id, profile_id, order_ts, size FROM headers")
    out["item_titles"] = s.q("titles", "SELECT item_id, title FROM titles")
    out["split_bounds"] = s.q(
        "headers",
        """SELECT min(order_ts) AS data_start, min(order_ts) + INTERVAL 1825 DAY AS train_end,
                  min(order_ts) + INTERVAL 2035 DAY AS test_end,
                  max(order_ts) - INTERVAL 210 DAY AS oot_start, max(order_ts) AS data_end
           FROM headers""",
    )
    out["temporal_split"] = s.q("split", f"SELECT {split_cols} FROM split")
    out["temporal_split_overlap"] = s.q("headers", f"SELECT {split_cols} FROM ({_split(600)})")
    out["split_counts"] = s.q(
        "split",
        """SELECT count(*) FILTER (in_train) AS n_train, count(*) FILTER (in_test) AS n_test,
                  count(*) FILTER (in_oot) AS n_oot, min(order_ts) AS first_order,
                  max(order_ts) AS last_order FROM split""",
    )
    out["user_histories"] = s.q(
        "history",
        """SELECT profile_id, item_id, f.t AS first_ts, f.o AS first_order, f.p AS first_pos
           FROM history""",
    )
    out["profile_baskets"] = s.q(
        "history",
        """SELECT profile_id, item_id, size FROM history JOIN (
               SELECT profile_id, count(*) AS size FROM history GROUP BY 1 HAVING count(*) >= 2)
           USING (profile_id)""",
    )
    out["csv_baskets"] = out["order_headers"]
    out["csv_rejects"] = """
        WITH l AS (SELECT l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'created_at' AS "column", 'soon' AS value, count(*) AS n FROM l WHERE i % 11 = 1
        UNION ALL SELECT 'profile_id', '12.7', count(*) FROM l WHERE i % 7 = 1
        UNION ALL SELECT 'order_item_oms_id', 'x3', count(*) FROM l WHERE i % 13 = 1
        UNION ALL SELECT 'kept', '', count(*) FROM l WHERE i % 11 <> 1 AND i % 7 <> 1 AND i % 13 <> 1"""
    out["mixed_timestamps"] = (
        "SELECT o_orderkey AS order_id, o_orderdate AS created_at FROM orders"
    )
    out["stream_baskets"] = s.q(
        "headers",
        """SELECT order_id, item_id, min(pos) AS pos, arg_min(profile_id, pos) AS profile_id
           FROM good GROUP BY 1, 2""",
    )
    out["stream_pairs"] = s.q(
        "oi",
        """SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS pair_count
           FROM oi a JOIN oi b ON a.order_id = b.order_id AND a.item_id < b.item_id GROUP BY 1, 2""",
    )
    out["item_frequency"] = s.q("counts", "SELECT item_id, freq FROM counts")
    out["popularity_rank"] = s.q("ranks", "SELECT item_id, freq, rank FROM ranks")
    out["pair_counts"] = s.q("pairs", "SELECT item_a, item_b, pair_count FROM pairs")
    out["pair_counts_supported"] = s.q(
        "pairs", "SELECT item_a, item_b, pair_count FROM pairs WHERE pair_count >= 2"
    )
    for metric in ("lift", "pmi", "npmi"):
        out[f"assoc_{metric}"] = s.q(
            "pairs",
            f"""SELECT item_id, other_id, pair_count, round(score + 1e-9, 6) AS score
                FROM ({_assoc(metric, 2)})""",
        )
    out["category_lift"] = s.q(
        "affinity", "SELECT cat_a, cat_b, round(affinity + 1e-9, 6) AS affinity FROM affinity"
    )
    out["item_graph_edges"] = s.q(
        "pairs",
        """SELECT unnest([item_a, item_b]) AS src, unnest([item_b, item_a]) AS dst,
                  pair_count AS weight FROM pairs WHERE pair_count >= 2""",
    )
    out["graph_walks"] = s.q(
        "pairs",
        """, e AS (
            SELECT unnest([item_a, item_b]) AS src, unnest([item_b, item_a]) AS dst, pair_count AS weight
            FROM pairs WHERE pair_count >= 2
        ), shares AS (
            SELECT src, dst, sum(weight) OVER (PARTITION BY src ORDER BY dst)::BIGINT AS upto, weight,
                   sum(weight) OVER (PARTITION BY src)::BIGINT AS total FROM e
        ), walks AS (
            SELECT src AS start, w::BIGINT AS walk, 0::BIGINT AS step, src AS node
            FROM (SELECT DISTINCT src FROM e), range(1, 11) AS r(w)
            UNION ALL
            SELECT start, walk, step + 1, dst
            FROM walks JOIN shares ON src = node AND
                ('0x' || substr(md5(concat_ws(':', start::VARCHAR, walk::VARCHAR, (step + 1)::VARCHAR, '42')), 1, 15))::BIGINT
                    % total BETWEEN upto - weight AND upto - 1
            WHERE step < 19
        )
        SELECT start, walk, step, node FROM walks""",
    )
    out["context_pairs"] = s.q(
        "counts",
        """, w AS (
            SELECT order_id, item_id, row_number() OVER (PARTITION BY order_id ORDER BY pos, item_id) AS at
            FROM train JOIN counts USING (item_id) WHERE freq >= 2)
        SELECT a.item_id AS u, b.item_id AS i, count(*) AS weight
        FROM w a JOIN w b ON a.order_id = b.order_id AND abs(a.at - b.at) BETWEEN 1 AND 5
        WHERE a.item_id <> b.item_id GROUP BY 1, 2""",
    )
    out["l1o"] = s.q("cases", "SELECT query_id, held_out, profile_id FROM cases")
    out["l1o_items"] = s.q("qi", "SELECT query_id, item_id FROM qi")
    out["stratified_l1o"] = s.q(
        "buckets",
        """SELECT query_id, held_out, bucket FROM (
               SELECT query_id, held_out, coalesce(bucket, -1) AS bucket,
                      row_number() OVER (PARTITION BY bucket ORDER BY
                          md5(concat_ws(':', query_id::VARCHAR, '42:strata')), query_id) AS r
               FROM cases LEFT JOIN buckets ON item_id = held_out)
           WHERE bucket < 0 OR r <= (
               SELECT min(c) FROM (SELECT count(*) AS c FROM cases JOIN buckets
                                   ON item_id = held_out GROUP BY bucket))""",
    )
    out["tune_subset"] = s.q(
        "cases",
        """SELECT query_id, held_out FROM cases
           ORDER BY md5(concat_ws(':', query_id::VARCHAR, '42')), query_id LIMIT 300""",
    )
    out["rank_train_val_split"] = s.q(
        "cases",
        """SELECT query_id, row_number() OVER (ORDER BY
                  md5(concat_ws(':', query_id::VARCHAR, '42:val')), query_id)
                  <= (SELECT greatest(1, floor(count(*) * 0.3::DOUBLE)) FROM cases) AS is_val
           FROM cases""",
    )
    out["example_basket"] = s.q(
        "train",
        """SELECT order_id, pos, item_id FROM train WHERE order_id = (
               SELECT order_id FROM train GROUP BY 1
               ORDER BY md5(concat_ws(':', order_id::VARCHAR, '42:example')), order_id LIMIT 1)
           ORDER BY pos LIMIT 3""",
    )
    out["top_popular_recs"] = s.q("qi", _RECS + f"({_popular('qi', 'cases', K)})")
    out["cooc_recs"] = s.q("cooc", _RECS + f"({_ranked('cooc', K)})")
    out["session_recs"] = s.q(
        "qi",
        f""", lift AS ({_assoc('lift', 1)}),
        weighted AS (
            SELECT query_id, item_id, 1.0 AS w FROM qi
            UNION ALL
            SELECT query_id, h.item_id, 0.3 FROM cases JOIN history h USING (profile_id)
            WHERE NOT EXISTS (SELECT 1 FROM qi o
                WHERE o.query_id = cases.query_id AND o.item_id = h.item_id)),
        sums AS (SELECT query_id, other_id AS item_id, sum(score * w::DOUBLE) AS score
                 FROM weighted JOIN lift USING (item_id) GROUP BY 1, 2)
        {_RECS} ({_ranked('sums', K)})""",
    )
    boosted = f""", boost_assoc AS ({_assoc('npmi', 1)}),
        boost_cooc AS ({_cooc_sum('boost_assoc')}),
        pool AS ({_ranked('boost_cooc', 5 * K)}),
        pool_category AS ({_category('pool')}),
        pool_text AS (%s),
        parts AS ({_parts('pool', 'pool_text')})
        {_RECS} (%s)"""
    out["content_boost_recs"] = s.q(
        "names_tfidf",
        boosted % (_text("pool"), _ranked(_blend("parts", 0.6, 0.25, 0.15), K, None)),
    )
    out["dense_boost_recs"] = s.q(
        "dims", boosted % (_dense("pool"), _ranked(_blend("parts", 0.5, 0.2, 0.3), K, None))
    )
    out["popularity_rerank"] = s.q(
        "cooc",
        f""", pool AS ({_ranked('cooc', 5 * K)}),
        scored AS (SELECT query_id, item_id,
                          1.0::DOUBLE / rank + 0.2::DOUBLE * ln(1 + coalesce(freq, 0)) AS score
                   FROM pool LEFT JOIN counts USING (item_id))
        {_RECS} ({_ranked('scored', K, None)})""",
    )
    out["rrf_ensemble"] = s.q(
        "cooc",
        f""", pop AS ({_popular('qi', 'cases', 30)}), co AS ({_ranked('cooc', 30)}),
        fused AS (SELECT query_id, item_id, sum(s) AS score FROM (
                      SELECT query_id, item_id, 1.0::DOUBLE / rank AS s FROM pop
                      UNION ALL SELECT query_id, item_id, 1.2::DOUBLE / rank FROM co)
                  GROUP BY 1, 2)
        {_RECS} ({_ranked('fused', K, None)})""",
    )
    edge = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
    out["html_strip"] = f"""
        SELECT page_id, regexp_replace(
                   regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
                   '^{edge}|{edge}$', '', 'g') AS description
        FROM pages"""
    out["tfidf_weights"] = s.q(
        "names_tfidf", "SELECT item_id, term, round(weight + 1e-9, 6) AS weight FROM names_tfidf"
    )
    docs = _Sql()
    docs.step("docs", "SELECT doc_id AS item_id, text AS description FROM documents")
    for name, body in _tfidf("docs", 10_000):
        docs.step(name, body)
    out["tfidf_documents"] = docs.q(
        "docs_tfidf", "SELECT item_id, term, round(weight + 1e-9, 6) AS weight FROM docs_tfidf"
    )
    out["category_scores"] = s.q(
        "cooc_recs_category",
        "SELECT query_id, item_id, round(category + 1e-9, 6) AS category FROM cooc_recs_category",
    )
    out["text_similarity"] = s.q(
        "names_tfidf",
        f"SELECT query_id, item_id, round(text + 1e-9, 6) AS text FROM ({_text('cooc_recs')})",
    )
    out["dense_similarity"] = s.q(
        "dims", f"SELECT query_id, item_id, round(text + 1e-9, 6) AS text FROM ({_dense('cooc_recs')})"
    )
    out["unit_vectors"] = """
        SELECT vec_id AS item_id, unnest(range(len(embedding))) AS dim,
               round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(
                   embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9, 6) AS value
        FROM embeddings"""
    out["dense_cosine_topk"] = f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
                   FROM embeddings),
        sims AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
                        list_cosine_similarity(a.e, b.e) AS score
                 FROM v a JOIN v b ON a.vec_id <> b.vec_id)
        {_RECS} ({_ranked('sims', K, None)})"""
    out["eval_hit_mrr"] = s.q(
        "cooc_recs",
        f""", w AS ({_metrics_of('cooc_recs', 'cases')})
        SELECT 'hit@5' AS metric, round(hit5 + 1e-9, 6) AS value FROM w
        UNION ALL SELECT 'hit@10', round(hit10 + 1e-9, 6) FROM w
        UNION ALL SELECT 'hit@20', round(hit20 + 1e-9, 6) FROM w
        UNION ALL SELECT 'mrr', round(mrr + 1e-9, 6) FROM w""",
    )
    out["eval_coverage"] = s.q(
        "cooc_recs",
        """SELECT 'coverage' AS metric, round(count(DISTINCT item_id)::DOUBLE
               / (SELECT count(*) FROM titles) + 1e-9, 6) AS value FROM cooc_recs""",
    )
    out["popularity_buckets"] = s.q("buckets", "SELECT item_id, freq, bucket FROM buckets")
    ranges = """SELECT b::BIGINT AS bucket, t[b + 1] AS lo, t[b + 2] AS hi
                FROM thresholds, range(5) r(b)"""
    out["bucket_ranges"] = s.q("thresholds", ranges)
    rates = ", ".join(
        f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS hit{k}" for k in (5, 10, 20)
    )
    debiased = f""", ranked AS (
            SELECT c.query_id, coalesce(bucket, -1) AS bucket, rank FROM cases c
            LEFT JOIN cooc_recs r ON r.query_id = c.query_id AND r.item_id = c.held_out
            LEFT JOIN buckets b ON b.item_id = c.held_out),
        per AS (SELECT 'bucket' AS scope, bucket, {rates},
                       avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / rank END) AS mrr
                FROM ranked WHERE bucket >= 0 GROUP BY bucket),
        rows AS (SELECT * FROM per
            UNION ALL
            SELECT 'micro', NULL, {rates},
                   avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / rank END) FROM ranked
            UNION ALL
            SELECT 'debiased', NULL, avg(hit5), avg(hit10), avg(hit20), avg(mrr) FROM per)"""
    out["debiased_metrics"] = s.q(
        "cooc_recs",
        debiased
        + "\n UNION ALL ".join(
            f" SELECT scope, bucket, '{m}' AS metric, round({c} + 1e-9, 6) AS value FROM rows"
            for m, c in (("hit@5", "hit5"), ("hit@10", "hit10"), ("hit@20", "hit20"), ("mrr", "mrr"))
        ),
    )
    out["bucket_summary"] = s.q(
        "cooc_recs",
        debiased
        + f""" SELECT scope, rows.bucket, lo, hi, round(hit5, 4) AS hit5,
                      round(hit10, 4) AS hit10, round(mrr, 4) AS mrr
               FROM rows LEFT JOIN ({ranges}) g ON g.bucket = rows.bucket""",
    )
    out["debiased_summary"] = s.q(
        "cooc_recs",
        debiased
        + """ SELECT 'CooccurrenceLift' AS model, round(hit5 + 1e-9, 6) AS debiased_hit5,
                     round(mrr + 1e-9, 6) AS debiased_mrr
              FROM rows WHERE scope = 'debiased' AND (hit5 > 0 OR mrr > 0)""",
    )
    out["ensemble_members"] = s.q(
        "wide",
        """SELECT model, weight FROM wide JOIN (VALUES ('TopPopular', 1.0::DOUBLE),
               ('CooccurrenceLift', 1.2), ('ContentBoost', 1.0)) w(model, weight) USING (model)
           WHERE test_hit5 > 0 AND test_mrr > 0 AND test_hit5 >= 0.002""",
    )
    out["ranker_members"] = s.q("wide", "SELECT model FROM wide WHERE test_hit5 > 0")
    grid = [
        (c, a, 1.0 - c - a)
        for c in (0.5, 0.6, 0.7)
        for a in (0.15, 0.25, 0.35)
        if 1.0 - c - a >= 0
    ]
    values = ", ".join(f"({i}, {c!r}::DOUBLE, {a!r}::DOUBLE, {t!r}::DOUBLE)" for i, (c, a, t) in enumerate(grid))
    out["weight_grid"] = s.q(
        "names_tfidf",
        f""", pool AS ({_ranked('cooc', 25)}),
        pool_category AS ({_category('pool')}), pool_text AS ({_text('pool')}),
        parts AS ({_parts('pool', 'pool_text')}),
        grid(grid_idx, cooc_w, category_w, text_w) AS (VALUES {values}),
        ranked AS (SELECT grid_idx, query_id, item_id, row_number() OVER (
                       PARTITION BY grid_idx, query_id ORDER BY
                       round(cooc_w * cooc + category_w * category + text_w * text, 9) DESC,
                       item_id) AS rank
                   FROM parts, grid)
        SELECT grid_idx::BIGINT AS grid_idx, round(cooc_w + 1e-9, 6) AS cooc_w,
               round(category_w + 1e-9, 6) AS category_w, round(text_w + 1e-9, 6) AS text_w,
               round((SELECT count(*) FROM ranked r JOIN cases c
                      ON c.query_id = r.query_id AND c.held_out = r.item_id
                      WHERE r.grid_idx = g.grid_idx AND rank <= 5)::DOUBLE
                     / (SELECT count(*) FROM cases) + 1e-9, 6) AS hit
        FROM grid g""",
    )
    out["basket_stats"] = s.q(
        "split",
        " UNION ALL ".join(
            f"""SELECT '{x}' AS split, count(*) AS n_baskets, round(avg(size), 3) AS mean_size,
                  list_sort(list(size))[(count(*) // 2 + 1)] AS p50,
                  list_sort(list(size))[floor(count(*) * 0.9::DOUBLE)::BIGINT + 1] AS p90,
                  (SELECT count(DISTINCT item_id) FROM oi JOIN split USING (order_id)
                   WHERE in_{x}) AS uniq_items
               FROM split WHERE in_{x}"""
            for x in ("train", "test", "oot")
        ),
    )
    out["top_mass_share"] = s.q(
        "ranks",
        """SELECT k, round(sum(freq)::DOUBLE / (SELECT sum(freq) FROM ranks), 4) AS share
           FROM (SELECT unnest([1, 5, 10, 20, 50, 100, 200])::BIGINT AS k) JOIN ranks ON rank <= k
           GROUP BY k""",
    )
    out["cold_items"] = s.q(
        "train",
        " UNION ALL ".join(
            f"""SELECT '{x}' AS split, count(*) FILTER (NOT known) AS n_cold,
                       round(count(*) FILTER (NOT known) / count(*)::DOUBLE, 4) AS cold_frac
                FROM (SELECT DISTINCT item_id,
                             item_id IN (SELECT item_id FROM train) AS known
                      FROM items WHERE in_{x})"""
            for x in ("test", "oot")
        ),
    )
    out["heldout_mean_rank"] = s.q(
        "cases",
        """SELECT round(avg(coalesce(rank, (SELECT count(*) + 1 FROM ranks))), 2) AS mean_rank
           FROM cases LEFT JOIN ranks ON item_id = held_out""",
    )
    out["popularity_oracle_metrics"] = s.q(
        "qi",
        """, placed AS (
            SELECT c.query_id, h.rank - (SELECT count(*) FROM qi JOIN ranks USING (item_id)
                WHERE qi.query_id = c.query_id AND ranks.rank < h.rank) AS rank
            FROM cases c LEFT JOIN ranks h ON h.item_id = c.held_out)
        SELECT 'test' AS split, count(*) AS n,
               round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS hit5,
               round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS hit10,
               round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS hit20,
               round(avg(coalesce(1.0 / rank, 0.0)) + 1e-9, 6) AS mrr FROM placed""",
    )
    out["random_baseline"] = s.q(
        "titles",
        "SELECT count(*) AS n_items, round(5.0::DOUBLE / count(*) + 1e-9, 6) AS random_hit5 FROM titles",
    )
    out["catalog_summary"] = (
        "SELECT count(*) AS n_items, count(DISTINCT p_type) AS n_categories FROM part"
    )
    out["item_features"] = s.q(
        "cat",
        """, stats AS (SELECT item_id, count(*) AS freq, avg(size) AS avg_size FROM train GROUP BY 1),
        partners AS (SELECT item_id, count(*) AS n FROM (
            SELECT unnest([item_a, item_b]) AS item_id FROM pairs) GROUP BY 1)
        SELECT p_partkey AS item_id, coalesce(freq, 0)::DOUBLE AS item_popularity,
               round(ln(1 + coalesce(freq, 0)) + 1e-9, 6) AS item_popularity_log,
               coalesce(rank - 1, (SELECT count(*) FROM ranks))::DOUBLE AS item_popularity_rank,
               length(p_name)::DOUBLE AS description_length,
               (length(p_name) > 0)::INT::DOUBLE AS has_description,
               (count(*) OVER (PARTITION BY p_type))::DOUBLE AS category_size,
               round(coalesce(avg_size, 0) + 1e-9, 6) AS avg_basket_size,
               coalesce(n, 0)::DOUBLE AS cooccurrence_diversity
        FROM part LEFT JOIN stats s ON s.item_id = p_partkey
        LEFT JOIN (SELECT item_id, rank FROM ranks) r ON r.item_id = p_partkey
        LEFT JOIN partners x ON x.item_id = p_partkey""",
    )
    out["user_features"] = s.q(
        "qi",
        """, known AS (
            SELECT query_id, item_id, coalesce(freq, 0) AS freq,
                   coalesce(category, 'unknown') AS category
            FROM qi LEFT JOIN counts USING (item_id) LEFT JOIN cat USING (item_id)),
        dominant AS (SELECT query_id, max(n) AS n FROM (
            SELECT query_id, category, count(*) AS n FROM known GROUP BY 1, 2) GROUP BY 1),
        past AS (SELECT query_id, h.item_id, coalesce(category, 'unknown') AS category
                 FROM cases JOIN history h USING (profile_id) LEFT JOIN cat USING (item_id)),
        b AS (SELECT query_id, count(*)::DOUBLE AS size, avg(freq) AS mean, max(freq) AS top,
                     min(freq) AS low, count(DISTINCT category)::DOUBLE AS cats FROM known GROUP BY 1),
        h AS (SELECT query_id, count(*)::DOUBLE AS n FROM past GROUP BY 1),
        rep AS (SELECT query_id, count(*) AS n FROM known WHERE EXISTS (
            SELECT 1 FROM past p WHERE p.query_id = known.query_id AND p.item_id = known.item_id)
            GROUP BY 1),
        ov AS (SELECT query_id, count(*)::DOUBLE AS n FROM (
            SELECT DISTINCT query_id, category FROM known
            INTERSECT SELECT DISTINCT query_id, category FROM past) GROUP BY 1)
        SELECT query_id, size AS basket_size, round(mean + 1e-9, 6) AS avg_item_popularity,
               top::DOUBLE AS max_item_popularity, low::DOUBLE AS min_item_popularity,
               cats AS n_unique_categories, round(dominant.n / size + 1e-9, 6) AS dominant_category_ratio,
               coalesce(h.n, 0) AS history_length, coalesce(h.n, 0) AS history_unique_items,
               round(coalesce(rep.n, 0) / size + 1e-9, 6) AS repeat_ratio,
               coalesce(ov.n, 0) AS category_overlap,
               round(coalesce(ov.n, 0) / cats + 1e-9, 6) AS category_overlap_ratio
        FROM b JOIN dominant USING (query_id) LEFT JOIN h USING (query_id)
        LEFT JOIN rep USING (query_id) LEFT JOIN ov USING (query_id)""",
    )
    out["candidate_features"] = s.q(
        "popular_recs",
        """, both_lists AS (
            SELECT query_id, item_id, p.rank AS rp, c.rank AS rc
            FROM popular_recs p FULL JOIN cooc_recs c USING (query_id, item_id)),
        held AS (SELECT query_id, held_out AS item_id, NULL AS rp, NULL AS rc FROM cases
                 WHERE query_id IN (SELECT query_id FROM both_lists)
                 AND NOT EXISTS (SELECT 1 FROM both_lists b
                     WHERE b.query_id = cases.query_id AND b.item_id = held_out))
        SELECT b.query_id, b.item_id,
               round(coalesce(1.0 / rp, 0) + 1e-9, 6)::DOUBLE AS score_pop,
               coalesce(rp - 1, 20)::DOUBLE AS rank_pop,
               round(coalesce(1.0 / rc, 0) + 1e-9, 6)::DOUBLE AS score_cooc,
               coalesce(rc - 1, 20)::DOUBLE AS rank_cooc,
               (c.held_out = b.item_id)::BIGINT AS label
        FROM (SELECT * FROM both_lists UNION ALL SELECT * FROM held) b
        JOIN cases c ON c.query_id = b.query_id""",
    )
    measured = [f"{x}_{m}" for x in ("test", "oot") for m in ("hit5", "hit10", "hit20", "mrr")]
    out["summary_pivot"] = s.q(
        "wide",
        "SELECT model, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in measured)
        + ", 0.0::DOUBLE AS train_time_s FROM wide",
    )
    out["test_vs_oot"] = s.q(
        "wide", "SELECT model, round(test_mrr + 1e-9, 6) AS test, round(oot_mrr + 1e-9, 6) AS oot FROM wide"
    )
    out["hits_by_model"] = s.q(
        "wide",
        "SELECT model, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in measured[:3]) + " FROM wide",
    )
    out["improvement_pct"] = s.q(
        "wide",
        "SELECT w.model, "
        + ", ".join(
            f"round(CASE WHEN b.{c} > 0 THEN (w.{c} - b.{c}) / b.{c} * 100 ELSE 0 END + 1e-9, 6) AS {c}"
            for c in measured[:4]
        )
        + """ FROM wide w, wide b WHERE b.model = 'TopPopular' AND w.model <> 'TopPopular'""",
    )
    out["degradation_pct"] = s.q(
        "wide",
        "SELECT model, "
        + ", ".join(
            f"round(CASE WHEN test_{c} > 0 THEN (test_{c} - oot_{c}) / test_{c} * 100 ELSE 0 END + 1e-9, 6) AS {c}"
            for c in ("hit5", "hit10", "mrr")
        )
        + " FROM wide",
    )
    out["quality_table"] = s.q(
        "wide",
        "SELECT model, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in ("test_hit5", "test_mrr", "oot_hit5", "oot_mrr"))
        + " FROM wide",
    )
    label = "coalesce(title, 'Item #' || {0}.item_id)"
    out["recs_with_titles"] = s.q(
        "cooc_recs",
        f"""SELECT query_id, rank, r.item_id, {label.format('r')} AS title
            FROM cooc_recs r LEFT JOIN titles t ON t.item_id = r.item_id""",
    )
    out["comparison_pivot"] = s.q(
        "popular_recs",
        f""", named AS (
            SELECT 'pop' AS model, query_id, rank, {label.format('r')} AS title
            FROM popular_recs r LEFT JOIN titles t ON t.item_id = r.item_id
            UNION ALL
            SELECT 'cooc', query_id, rank, {label.format('r')}
            FROM cooc_recs r LEFT JOIN titles t ON t.item_id = r.item_id)
        SELECT query_id, rank, max(title) FILTER (model = 'pop') AS pop,
               max(title) FILTER (model = 'cooc') AS cooc
        FROM named GROUP BY 1, 2""",
    )
    return out
