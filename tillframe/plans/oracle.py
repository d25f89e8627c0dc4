"""The same queries as plain SQL over the source tables, written independently.

Marts use the plain joins of sales and reviews where the Spark side uses
weights. Money is summed as decimals; means are rounded half-up on integers.
"""

from __future__ import annotations

import re

from tillframe.functions.rules import (
    ANALYSIS_RULES,
    DEFAULT_QUESTION,
    ERP_CATEGORIES,
    FORCED_QUESTION_WORDS,
    MDM_CATEGORIES,
    OTHER_CATEGORY,
    QUESTION_RULES,
)
from tillframe.operators.analytics import PRODUCT_METRICS
from tillframe.operators.conversation import UNSAFE_WORDS
from tillframe.plans.queries import CHECK_NOW, FULL_NAME_THRESHOLD, HISTORY_AS_OF, HISTORY_FROM, RANGE, RULES_NOW


def case_rules(text: str, rules, default: str | None) -> str:
    """CASE over substring tests in rule order."""
    arms = []
    for label, found in rules:
        tests = " OR ".join(f"contains({text}, '{w}')" for w in found)
        arms.append(f"WHEN {tests} THEN '{label}'")
    tail = f"ELSE '{default}'" if default else ""
    return f"CASE {' '.join(arms)} {tail} END"


def any_word(text: str, found) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in found) + ")"


def mean2(hundredths: str, count: str) -> str:
    """Half-up mean with two decimals of values given in hundredths."""
    s, n = f"CAST({hundredths} AS HUGEINT)", f"CAST({count} AS HUGEINT)"
    return f"CASE WHEN {n} > 0 THEN CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 100 END"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def dec2(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,6)), 2) AS DOUBLE)"


def rounded(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(20,12)), {digits}) AS DOUBLE)"


def cosine_ctes(left: str, right: str, copies: int, prefix: str) -> dict[str, str]:
    """TF-IDF cosines of all (left, right) names: relation {prefix}cos(a, b, c).

    ``left`` and ``right`` are relations (rep, name, members); with ``copies`` = 2
    they are the same list taken twice.
    """
    both = f"SELECT 'l' AS side, * FROM {left}"
    if left != right:
        both += f" UNION ALL SELECT 'r' AS side, * FROM {right}"
    return {
        f"{prefix}docs": both,
        f"{prefix}tok": f"""SELECT side, rep, members,
            ' ' || unnest(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x <> '')) || ' ' AS w
            FROM {prefix}docs""",
        f"{prefix}size": f"SELECT *, unnest([2, 3, 4]) AS n FROM {prefix}tok",
        f"{prefix}start": f"""SELECT *, unnest(range(1, length(w) - n + 2)) AS i
            FROM {prefix}size WHERE length(w) >= n""",
        f"{prefix}gram": f"""SELECT side, rep, members, substr(w, i, n) AS g, count(*) AS tf
            FROM {prefix}start GROUP BY ALL""",
        f"{prefix}df": f"SELECT g, {copies} * sum(members) AS df FROM {prefix}gram GROUP BY g",
        f"{prefix}n": f"SELECT {copies} * sum(members) AS n FROM {prefix}docs",
        f"{prefix}w": f"""SELECT side, rep, g, tf * (ln((1 + n) / (1 + df)) + 1) AS w
            FROM {prefix}gram JOIN {prefix}df USING (g), {prefix}n""",
        f"{prefix}u": f"""SELECT side, rep, g, w / sqrt(sum(w * w) OVER (PARTITION BY side, rep)) AS u
            FROM {prefix}w""",
        f"{prefix}cos": f"""SELECT a.rep AS a, b.rep AS b, sum(a.u * b.u) AS c
            FROM {prefix}u a JOIN {prefix}u b USING (g)
            WHERE a.side = 'l' AND b.side = '{'l' if left == right else 'r'}' GROUP BY ALL""",
    }


def best_cosine(prefix: str, threshold: float, skip_self: bool = False) -> str:
    skip = "AND a <> b" if skip_self else ""
    return f"""SELECT a, b, c FROM {prefix}cos WHERE round(c, 6) >= {threshold} {skip}
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) = 1"""


KPI_COLUMNS = """product_id, product_name, category, revenue, margin, quantity, avg_rating,
    reviews, positive, negative, neutral"""


def kpi_select(joined: str) -> str:
    def reviews_with(label: str) -> str:
        return big(f"coalesce(sum(CASE WHEN sentiment = '{label}' THEN 1 ELSE 0 END), 0)")

    return f"""SELECT product_id, golden_name AS product_name, category,
        {dbl('coalesce(sum(revenue), 0)')} AS revenue, {dbl('coalesce(sum(margin), 0)')} AS margin,
        {big('coalesce(sum(quantity), 0)')} AS quantity,
        {mean2('sum(CAST(rating * 100 AS BIGINT))', 'count(rating)')} AS avg_rating,
        count(review_id) AS reviews, {reviews_with('positive')} AS positive,
        {reviews_with('negative')} AS negative, {reviews_with('neutral')} AS neutral
        FROM {joined} GROUP BY product_id, golden_name, category"""


def holt_ctes() -> dict[str, str]:
    """Every weight pair folded over every series: holt(series, alpha, beta, sse, ...)."""
    zero = "CAST(0 AS DOUBLE)"
    return {
        "arr": """SELECT series, list(value ORDER BY month) AS v, max(month) AS last, count(*) AS n
            FROM series GROUP BY series HAVING count(*) >= 3""",
        "steps": "SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS s",
        "folded": f"""SELECT series, last, n, a.s AS alpha, b.s AS beta, list_reduce(
              list_transform(v[2:], lambda y: {{'y': y, 'level': {zero}, 'trend': {zero}, 'sse': {zero}}}),
              lambda st, x: {{'y': x.y,
                'level': a.s * x.y + (1.0::DOUBLE - a.s) * (st.level + st.trend),
                'trend': b.s * ((a.s * x.y + (1.0::DOUBLE - a.s) * (st.level + st.trend)) - st.level)
                         + (1.0::DOUBLE - b.s) * st.trend,
                'sse': st.sse + (x.y - (st.level + st.trend)) * (x.y - (st.level + st.trend))}},
              {{'y': v[1], 'level': v[1], 'trend': v[2] - v[1], 'sse': {zero}}}) AS st
            FROM arr, steps a, steps b""",
        "holt": """SELECT series, last, n, alpha, beta, st.level AS level, st.trend AS trend, st.sse AS sse
            FROM folded QUALIFY row_number() OVER (PARTITION BY series ORDER BY st.sse, alpha, beta) = 1""",
    }


def season_ctes(prefix: str, multiply: bool, months: str) -> dict[str, str]:
    """A trend and season form over its grid, for series with the given number of months."""
    zero, one = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    times, over = ("*", "/") if multiply else ("+", "-")
    effect, plain = "st.cycle[x.t % 12 + 1]", "(st.level + st.growth)"
    level = f"(a.s * (x.y {over} {effect}) + ({one} - a.s) * {plain})"
    cycle = f"""list_transform(st.cycle, lambda e, i: CASE WHEN i = x.t % 12 + 1
        THEN g.s * (x.y {over} {plain}) + ({one} - g.s) * e ELSE e END)"""
    miss = f"(x.y - ({plain} {times} {effect}))"
    return {
        f"{prefix}_year": f"""SELECT *, list_avg(v[1:12]) AS middle, coalesce(list_avg(list_transform(
            range(1, CAST(least(n, 24) AS BIGINT) - 11), lambda i: v[i + 12] - v[i])) / 12, 0) AS slope
            FROM arr WHERE {months}""",
        f"{prefix}_line": f"""SELECT *, list_transform(range(0, 12), lambda i: middle + slope * (i - 5.5::DOUBLE)) AS line
            FROM {prefix}_year""",
        f"{prefix}_start": f"""SELECT *, list_transform(range(1, 13), lambda i: v[i] {over} line[i]) AS base
            FROM {prefix}_line""",
        f"{prefix}_folded": f"""SELECT series, last, n, a.s AS alpha, b.s AS beta, g.s AS gamma, list_reduce(
              list_transform(v, lambda y, i: {{'y': y, 't': i - 1, 'level': {zero}, 'growth': {zero}, 'sse': {zero},
                'cycle': base}}),
              lambda st, x: {{'y': x.y, 't': x.t, 'level': {level},
                'growth': b.s * ({level} - st.level) + ({one} - b.s) * st.growth,
                'sse': st.sse + {miss} * {miss}, 'cycle': {cycle}}},
              {{'y': {zero}, 't': 0::BIGINT, 'level': line[1] - slope, 'growth': slope, 'sse': {zero}, 'cycle': base}}) AS st
            FROM {prefix}_start, season_steps a, season_steps b, season_steps g""",
        prefix: f"""SELECT series, last, n, step,
            (st.level + step * st.growth) {times} st.cycle[(n + step - 1) % 12 + 1] AS value, st.sse AS sse
            FROM {prefix}_folded, ahead
            QUALIFY row_number() OVER (PARTITION BY series, step ORDER BY st.sse, alpha, beta, gamma) = 1""",
    }


def rules_sql(suite: str, table: str, rules: list[tuple[str, str, str, str]]) -> str:
    """UNION of (label, severity, failed rows, detail) rows of one suite."""
    return " UNION ALL ".join(
        f"""SELECT '{suite}' AS suite, '{label}' AS rule, '{severity}' AS severity, {big(failed)} AS failed_rows,
            {failed} = 0 AS passed, {detail} AS detail FROM {table}"""
        for label, severity, failed, detail in rules
    )


def r_nulls(col: str, severity: str = "error"):
    failed = f"count(*) FILTER ({col} IS NULL)"
    return f"no_nulls({col})", severity, failed, f"{failed} || ' null value(s) in ' || count(*) || ' row(s)'"


def r_min(n: int, severity: str = "error"):
    return f"min_rows({n})", severity, f"greatest({n} - count(*), 0)", f"count(*) || ' row(s), expected at least {n}'"


def r_unique(col: str, severity: str = "error"):
    failed = f"(count(*) - count(DISTINCT {col}) - max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END))"
    return f"unique({col})", severity, failed, f"{failed} || ' duplicate(s)'"


def r_between(col: str, low, high, severity: str = "error"):
    failed = f"count(*) FILTER ({col} < {low} OR {col} > {high})"
    return f"column_between({col}, {low}, {high})", severity, failed, f"{failed} || ' value(s) outside [{low}, {high}]'"


def r_future(col: str, now: str, severity: str = "warning"):
    failed = f"count(*) FILTER ({col} > TIMESTAMP '{now}')"
    return f"no_future_dates({col}, {now})", severity, failed, f"{failed} || ' row(s) with a future date'"


def r_positive(col: str, severity: str = "error"):
    failed = f"count(*) FILTER ({col} <= 0)"
    return f"positive_values({col})", severity, failed, f"{failed} || ' value(s) <= 0'"


def r_set(col: str, values: str, severity: str = "error"):
    bad = f"({col} IS NULL OR {col} NOT IN ({values}))"
    failed = f"count(*) FILTER ({bad})"
    texts = f"list_sort(list(DISTINCT coalesce(CAST({col} AS VARCHAR), 'null')) FILTER ({bad}))"
    sample = f"coalesce(array_to_string({texts}[1:5], ', '), '')"
    return f"values_in_set({col})", severity, failed, f"{failed} || ' value(s) outside the set: [' || {sample} || ']'"


SALES_RULES = [
    r_min(1000), r_nulls("customer_id"), r_nulls("product_id"), r_nulls("invoice_ts"), r_positive("quantity"),
    r_positive("revenue", "warning"), r_future("invoice_ts", CHECK_NOW), r_between("revenue", 0.01, 100000, "warning"),
]
SENTIMENTS = "'positive', 'negative', 'neutral'"
REVIEW_RULES = [
    r_min(100), r_nulls("review_text"), r_nulls("sentiment"), r_set("sentiment", SENTIMENTS), r_between("rating", 1.0, 5.0),
]
PRODUCT_RULES = [r_min(1), r_unique("product_id"), r_nulls("product_name"), r_nulls("category")]

KEYWORDS = """list_filter(string_split_regex(replace(lower({0}), '''', ''), '\\s+'), lambda x: length(x) > 3)[1:3]"""
LATEST = "ORDER BY review_ts DESC, review_id"
IN_RANGE = f"invoice_ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"

CTES: dict[str, str] = {
    "raw_sales": """SELECT l_orderkey * 7 + l_linenumber * 13 AS line_key,
        CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
        CAST(l_partkey // 4 AS VARCHAR) || ['A', 'B', 'C', 'D'][l_partkey % 4 + 1] AS product_id,
        upper(p_name) AS description, CAST(l_quantity AS BIGINT) AS quantity,
        (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
            // (2 * CAST(l_quantity AS BIGINT)) AS unit_cents,
        CAST(o_orderdate AS TIMESTAMP) AS invoice_ts, CAST(o_custkey AS VARCHAR) AS customer_id, n_name AS country
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "priced": """SELECT *, CAST(CAST(quantity * unit_cents AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) AS revenue
        FROM raw_sales
        WHERE invoice_no NOT LIKE 'C%' AND quantity > 0 AND unit_cents > 0
          AND customer_id IS NOT NULL AND trim(customer_id) <> '' AND invoice_ts IS NOT NULL""",
    "sales": """SELECT *, CAST(round(revenue * CAST(0.20 + CAST(line_key % 1001 AS DECIMAL(4,0)) * 0.00025
            AS DECIMAL(6,5)), 2) AS DECIMAL(12,2)) AS margin FROM priced WHERE revenue > 0""",
    "per_name": "SELECT product_id, description, sum(quantity) AS quantity FROM sales GROUP BY ALL",
    "ranked": """SELECT product_id, description AS product_name, CAST(quantity AS BIGINT) AS quantity FROM per_name
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY description) = 1""",
    "products": f"""SELECT row_number() OVER (ORDER BY quantity DESC, product_id) - 1 AS idx, *,
        {case_rules('product_name', ERP_CATEGORIES, OTHER_CATEGORY)} AS category FROM ranked""",
    "customers": """SELECT customer_id, 'Client_' || customer_id AS name,
        first(country ORDER BY invoice_ts, country) AS country FROM sales GROUP BY customer_id""",
    "prod_names": "SELECT min(idx) AS rep, product_name AS name, count(*) AS members FROM products GROUP BY product_name",
    **cosine_ctes("prod_names", "prod_names", 2, "self_"),
    "self_best": best_cosine("self_", 0.25),
    "tfidf": """SELECT p.idx, b AS match_idx, round(c, 4) AS score FROM products p
        JOIN prod_names d ON p.product_name = d.name JOIN self_best ON a = d.rep""",
    "coded": "SELECT idx, regexp_replace(upper(trim(product_id)), '[A-Za-z]+$', '') AS code FROM products",
    "hard": """SELECT c.idx, f.first AS match_idx, CAST(1 AS DOUBLE) AS score FROM coded c
        JOIN (SELECT code, min(idx) AS first FROM coded GROUP BY code) f USING (code) WHERE f.first <> c.idx""",
    "words_mapping": """SELECT p.idx + 1 AS mapping_id, product_id, product_name,
        printf('REV_%04d', coalesce(h.match_idx, t.match_idx, p.idx) % 1000 + 1) AS review_code, category,
        product_name AS golden_name, coalesce(h.score, t.score, CAST(0 AS DOUBLE)) AS match_score,
        CASE WHEN h.idx IS NOT NULL THEN 'hard' WHEN t.idx IS NOT NULL THEN 'tfidf' ELSE 'rank' END AS match_strategy
        FROM products p LEFT JOIN hard h ON h.idx = p.idx LEFT JOIN tfidf t ON t.idx = p.idx""",
    "raw_reviews": """SELECT d.doc_id AS review_key, d.text AS review_text, l.quality AS sentiment_flag
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "clean_reviews": """SELECT review_key, review_text, substr(review_text, 1, 500) AS review_excerpt,
        CASE WHEN coalesce(sentiment_flag, 1) = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
        CAST(CAST(CASE WHEN coalesce(sentiment_flag, 1) = 1 THEN 35 ELSE 10 END + review_key % 16 AS DECIMAL(3,0))
            * 0.1 AS DECIMAL(3,1)) AS rating,
        TIMESTAMP '2024-01-01' + to_days(CAST(review_key * 37 % 549 AS INTEGER)) AS review_ts FROM raw_reviews""",
    "numbered": "SELECT *, row_number() OVER (ORDER BY review_key) AS review_id FROM clean_reviews",
    "linked": """SELECT r.review_key, coalesce(b.product_idx, 0) AS product_idx, coalesce(b.score, 0) AS score, m.review_code
        FROM raw_reviews r LEFT JOIN (SELECT * FROM term_best WHERE score > 0) b USING (review_key)
        JOIN mapping m ON m.mapping_id = coalesce(b.product_idx, 0) + 1""",
    "reviews": "SELECT n.*, l.review_code FROM numbered n JOIN linked l USING (review_key)",
    "dealt": """SELECT n.*, m.review_code FROM numbered n JOIN mapping m
        ON m.mapping_id = (n.review_id - 1) % (SELECT count(*) FROM mapping) + 1""",
    "mapping_poc": """SELECT idx + 1 AS mapping_id, product_id, product_name,
        printf('REV_%04d', idx % 1000 + 1) AS review_code, category, product_name AS golden_name,
        CAST(0 AS DOUBLE) AS match_score, 'rank' AS match_strategy FROM products""",
    "reviews_poc": """SELECT n.*, m.review_code FROM numbered n JOIN mapping_poc m
        ON m.mapping_id = (n.review_id - 1) % (SELECT count(*) FROM mapping_poc) + 1""",
    "fanned_poc": """SELECT m.product_id, m.golden_name, m.category, s.revenue, s.margin, s.quantity,
        r.review_id, r.rating, r.sentiment
        FROM mapping_poc m LEFT JOIN sales s ON s.product_id = m.product_id
        LEFT JOIN reviews_poc r ON r.review_code = m.review_code""",
    "kpi_poc": kpi_select("fanned_poc"),
    "fanned": """SELECT m.product_id, m.golden_name, m.category, s.revenue, s.margin, s.quantity,
        r.review_id, r.rating, r.sentiment
        FROM mapping m LEFT JOIN sales s ON s.product_id = m.product_id
        LEFT JOIN reviews r ON r.review_code = m.review_code""",
    "product_kpi": kpi_select("fanned"),
    "customer_fanned": """SELECT c.customer_id, c.name, c.country, s.invoice_no, s.product_id, s.revenue,
        r.rating, r.review_id
        FROM customers c LEFT JOIN sales s ON s.customer_id = c.customer_id
        LEFT JOIN mapping m ON m.product_id = s.product_id
        LEFT JOIN reviews r ON r.review_code = m.review_code""",
    "customer_kpi": f"""SELECT customer_id, name, country, count(DISTINCT invoice_no) AS orders,
        count(DISTINCT product_id) AS products, {dbl('sum(revenue)')} AS revenue,
        {mean2('sum(CAST(revenue * 100 AS BIGINT))', 'count(revenue)')} AS avg_basket,
        {mean2('sum(CAST(rating * 100 AS BIGINT))', 'count(rating)')} AS avg_rating, count(review_id) AS reviews
        FROM customer_fanned GROUP BY customer_id, name, country""",
    "alerts": """SELECT product_id, product_name, category, revenue, avg_rating, reviews, negative, quantity,
        CASE WHEN avg_rating < 3.0 AND quantity > 50 THEN 'CRITIQUE'
             WHEN avg_rating < 3.5 THEN 'A_SURVEILLER' ELSE 'OK' END AS status
        FROM product_kpi WHERE reviews > 0""",
    "periods": f"""SELECT date_trunc('month', invoice_ts) AS period, {dbl('sum(revenue)')} AS revenue,
        {big('sum(quantity)')} AS quantity, count(DISTINCT invoice_no) AS invoices
        FROM sales WHERE {IN_RANGE} GROUP BY 1""",
    "by_country": f"""SELECT c.country, count(DISTINCT invoice_no) AS invoices, {dbl('sum(revenue)')} AS revenue,
        count(DISTINCT c.customer_id) AS customers FROM sales s JOIN customers c USING (customer_id) GROUP BY c.country""",
    "missing": """SELECT p.product_id, p.product_name FROM products p WHERE NOT EXISTS (
        SELECT 1 FROM mapping m JOIN reviews r USING (review_code) WHERE m.product_id = p.product_id)""",
    "wanted": f"""SELECT product_id, unnest({KEYWORDS.format('product_name')}) AS keyword FROM missing""",
    "word_hits": """SELECT DISTINCT w.product_id, r.review_id, r.rating, r.sentiment
        FROM wanted w JOIN reviews r ON contains(lower(r.review_text), w.keyword)""",
    "rfm": f"""SELECT customer_id, country, count(DISTINCT invoice_no) AS frequency, {dbl('sum(revenue)')} AS monetary,
        min(invoice_ts) AS first_order, max(invoice_ts) AS last_order
        FROM customers JOIN (SELECT * EXCLUDE (country) FROM sales) USING (customer_id) GROUP BY ALL""",
    "rfm_base": """SELECT *, datesub('day', last_order, (SELECT max(last_order) FROM rfm)) AS recency_days,
        greatest(datesub('day', first_order, last_order), 1) AS relation_days FROM rfm""",
    "labels_churn": """SELECT *, CAST(recency_days > threshold_days AS BIGINT) AS churned,
        CASE WHEN threshold_days IS NULL THEN 'too few customers' ELSE 'ok' END AS status FROM (
        SELECT customer_id, country, recency_days, frequency, monetary, relation_days,
        (SELECT CASE WHEN count(*) >= 10
            THEN CAST(greatest(CAST(floor(quantile_cont(recency_days, 0.7)) AS BIGINT), 30) AS BIGINT) END FROM rfm_base)
            AS threshold_days FROM rfm_base)""",
    "segments": """SELECT customer_id, name, revenue, avg_rating, revenue_threshold, rating_threshold,
        CASE WHEN revenue >= revenue_threshold AND avg_rating >= rating_threshold THEN 'Champions'
             WHEN revenue >= revenue_threshold THEN 'Déçus Rentables'
             WHEN avg_rating >= rating_threshold THEN 'Fans Peu Dépensiers' ELSE 'Inactifs' END AS segment
        FROM (SELECT * FROM customer_kpi WHERE revenue IS NOT NULL AND avg_rating IS NOT NULL),
        (SELECT median(revenue) AS revenue_threshold, median(avg_rating) AS rating_threshold FROM customer_kpi
         WHERE revenue IS NOT NULL AND avg_rating IS NOT NULL)""",
    "edges": """SELECT quantile_cont(CAST(orders AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS fe,
        quantile_cont(revenue, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS me
        FROM customer_kpi WHERE orders IS NOT NULL AND revenue IS NOT NULL""",
    "scored": """SELECT customer_id, orders, revenue,
        CAST(1 + len(list_filter(list_distinct(fe[2:5]), lambda e: e > fe[1] AND e < fe[6] AND e < orders)) AS BIGINT)
            AS f_score,
        CAST(1 + len(list_filter(list_distinct(me[2:5]), lambda e: e > me[1] AND e < me[6] AND e < revenue)) AS BIGINT)
            AS m_score
        FROM customer_kpi, edges WHERE orders IS NOT NULL AND revenue IS NOT NULL""",
    "profiles": """SELECT *, (f_score + m_score) / 2.0::DOUBLE AS rfm,
        CASE WHEN f_score + m_score >= 9 THEN 'VIP' WHEN f_score + m_score >= 7 THEN 'Fidèle'
             WHEN f_score + m_score >= 5 THEN 'Actif' ELSE 'À risque' END AS profile FROM scored""",
    "by_month": """SELECT c.country AS series, date_trunc('month', invoice_ts) AS month, sum(revenue) AS r
        FROM sales s JOIN customers c USING (customer_id) GROUP BY ALL""",
    "series": """SELECT series, month, CAST(r AS DOUBLE) AS value FROM by_month UNION ALL
        SELECT 'ALL', month, CAST(sum(r) AS DOUBLE) FROM by_month GROUP BY month""",
    **holt_ctes(),
    "season_steps": "SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS s",
    "ahead": "SELECT unnest([1, 2, 3]) AS step",
    **season_ctes("added", False, "n >= 24"),
    **season_ctes("multiplied", True, "n >= 12 AND n < 24"),
    "messages": """SELECT conv_id AS session_id, turn AS seq, role, text AS content,
        TIMESTAMP '2024-01-01' + to_minutes(conv_id * 7919 % 525600 + turn) AS sent_at FROM conversations""",
    "replies": """SELECT session_id, seq, content AS question, CASE seq % 5
        WHEN 0 THEN '```json' || chr(10) || to_json({'sql': 'SELECT role FROM conversations WHERE text <> ' || chr(39)
            || replace(coalesce(content, ''), chr(39), chr(39) || chr(39)) || chr(39) || ' AND turn = ' || seq,
            'reasoning': 'r'})::VARCHAR || chr(10) || '```'
        WHEN 1 THEN coalesce(content, '') || ' SELECT role FROM conversations LIMIT ' || seq || ' as asked'
        WHEN 2 THEN to_json({'reasoning': coalesce(content, ''), 'sql': 'SELECT ...'})::VARCHAR
        WHEN 3 THEN coalesce(content, '')
        ELSE to_json({'answer': coalesce(content, ''), 'sql': 'DROP TABLE t' || seq || ' FROM x'})::VARCHAR END AS reply FROM messages""",
    "after_key": """SELECT *, substr(reply, strpos(reply, '"sql":"') + 7) AS body, strpos(reply, '"sql":"') > 0 AS has_key,
        strpos(lower(reply), ' select ') AS bare_at FROM replies""",
    "quoted": """SELECT *, split_part(replace(replace(body, repeat(chr(92), 2), repeat(chr(1), 2)), chr(92) || '"', repeat(chr(2), 2)),
        '"', 1) AS masked, substr(reply, bare_at + 1) AS bare FROM after_key""",
    "written": """SELECT *, CASE
        WHEN has_key THEN nullif(trim(json_extract_string('{"v":"' || substr(body, 1, length(masked)) || '"}', '$.v')), '')
        WHEN bare_at > 0 AND contains(bare, ' LIMIT ')
            THEN split_part(bare, ' LIMIT ', 1) || ' LIMIT ' || split_part(split_part(bare, ' LIMIT ', 2), ' ', 1)
        END AS written FROM quoted""",
    "vectors": """SELECT vec_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label
        FROM embeddings""",
    "dims": "SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vectors",
    "centres": """SELECT label AS query_id, list(m ORDER BY i) AS q
        FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i) GROUP BY label""",
    "asked": "SELECT id AS query_id, vec AS q FROM vectors WHERE (id - 1) % 50 = 0",
    "near_centres": """SELECT query_id, id, round(list_cosine_similarity(vec, q), 6) AS score FROM vectors, centres""",
    "near": """SELECT query_id, id, round(list_cosine_similarity(vec, q), 6) AS score FROM vectors, asked""",
    "exact": """SELECT query_id, id FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""",
    "hits": """SELECT query_id, n.id, score, golden_name, mapping_id, r.review_code, review_key, rating, sentiment,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.id, mapping_id) AS rank
        FROM near n JOIN reviews r ON r.review_id = n.id LEFT JOIN mapping m ON m.review_code = r.review_code
        QUALIFY rank <= 5""",
    "found": """SELECT query_id, rank, id AS review_id, review_key, sentiment, CAST(rating AS DOUBLE) AS rating,
        coalesce(golden_name, review_code) AS product_name, score AS similarity FROM hits""",
    "name_docs": "SELECT min(mapping_id) - 1 AS doc, golden_name AS text, count(*) AS members FROM mapping GROUP BY 2",
    "term_docs": """SELECT 'n' AS side, doc, members, text FROM name_docs UNION ALL
        SELECT 'r', review_key, 1, review_text FROM raw_reviews""",
    "term_words": """SELECT side, doc, members, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t
        FROM term_docs""",
    "term_all": """SELECT side, doc, members, unnest(t) AS term FROM term_words UNION ALL
        SELECT side, doc, members, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
        FROM term_words""",
    "term_tf": "SELECT side, doc, members, term, count(*) AS tf FROM term_all GROUP BY ALL",
    "term_idf": """SELECT term, ln((1 + (SELECT sum(members) FROM term_docs)) / (1 + sum(members))) + 1 AS idf
        FROM term_tf GROUP BY term""",
    "term_u": """SELECT side, doc, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY side, doc)) AS u
        FROM term_tf JOIN term_idf USING (term)""",
    "term_best": """SELECT r.doc AS review_key, n.doc AS product_idx, round(sum(r.u * n.u), 6) AS score
        FROM term_u r JOIN term_u n USING (term) WHERE r.side = 'r' AND n.side = 'n' GROUP BY r.doc, n.doc
        QUALIFY row_number() OVER (PARTITION BY r.doc ORDER BY round(sum(r.u * n.u), 6) DESC, n.doc) = 1""",
    "full_names": "SELECT p_partkey AS idx, upper(p_name || ' ' || p_type) AS name FROM part",
    "distinct_names": "SELECT min(idx) AS rep, name, 1 AS members FROM full_names GROUP BY name",
    **cosine_ctes("distinct_names", "distinct_names", 2, "lone_"),
    "lone_best": best_cosine("lone_", FULL_NAME_THRESHOLD, skip_self=True),
    "sorted_names": """SELECT idx, coalesce(array_to_string(list_sort(list_filter(
        string_split_regex(product_name, '\\s+'), lambda x: x <> '')), ' '), '') AS key FROM products""",
    "keys": "SELECT key, min(idx) AS rep, count(*) AS members FROM sorted_names GROUP BY key",
    "ratios": """SELECT a.rep AS a, b.rep AS b, a.members, 200.0::DOUBLE * list_reduce(
          list_transform(range(1, length(b.key) + 1), lambda i: [i]),
          lambda old, i: list_reduce(list_transform(range(1, length(a.key) + 1), lambda j: [j]),
            lambda row, j: list_append(row, CASE WHEN a.key[j[1]] = b.key[i[1]] THEN old[j[1]] + 1
                                                 ELSE greatest(row[len(row)], old[j[1] + 1]) END),
            [0::BIGINT]),
          list_resize([0::BIGINT], length(a.key) + 1, 0::BIGINT))[length(a.key) + 1]
          / (length(a.key) + length(b.key)) AS ratio
        FROM keys a, keys b WHERE a.rep <> b.rep""",
    "fuzzy": """SELECT s.idx, k.rep AS match_idx, CAST(1 AS DOUBLE) AS score
        FROM sorted_names s JOIN keys k USING (key) WHERE s.idx <> k.rep
        UNION ALL
        SELECT a, b, round(ratio / 100, 4) FROM (SELECT * FROM ratios WHERE members = 1
          QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(ratio, 9) DESC, b) = 1)
        WHERE ratio >= 80 - 1e-9 AND b < a""",
    "mapping": """SELECT p.idx + 1 AS mapping_id, product_id, product_name,
        printf('REV_%04d', coalesce(h.match_idx, f.match_idx, t.match_idx, p.idx) % 1000 + 1) AS review_code, category,
        product_name AS golden_name, coalesce(h.score, f.score, t.score, CAST(0 AS DOUBLE)) AS match_score,
        CASE WHEN h.idx IS NOT NULL THEN 'hard' WHEN f.idx IS NOT NULL THEN 'fuzzy'
             WHEN t.idx IS NOT NULL THEN 'tfidf' ELSE 'rank' END AS match_strategy
        FROM products p LEFT JOIN hard h ON h.idx = p.idx LEFT JOIN fuzzy f ON f.idx = p.idx
        LEFT JOIN tfidf t ON t.idx = p.idx""",
    "history": f"""
        SELECT product_id, o.review_code, o.golden_name, o.match_score, o.match_strategy,
          TIMESTAMP '{HISTORY_FROM}' AS valid_from,
          CASE WHEN o.review_code = m.review_code AND o.match_score = m.match_score
               AND o.match_strategy = m.match_strategy THEN NULL ELSE TIMESTAMP '{HISTORY_AS_OF}' END AS valid_to
        FROM (SELECT product_id, product_name AS golden_name, printf('REV_%04d', idx % 1000 + 1) AS review_code,
              CAST(0 AS DOUBLE) AS match_score, 'rank' AS match_strategy FROM products) o JOIN mapping m USING (product_id)
        UNION ALL
        SELECT m.product_id, m.review_code, m.golden_name, m.match_score, m.match_strategy,
          TIMESTAMP '{HISTORY_AS_OF}', NULL
        FROM mapping m JOIN products p USING (product_id)
        WHERE NOT (m.match_strategy = 'rank' AND m.review_code = printf('REV_%04d', p.idx % 1000 + 1))""",
    "report": " UNION ALL ".join(
        [
            rules_sql("sales", "sales", SALES_RULES),
            rules_sql("reviews", "reviews", REVIEW_RULES),
            rules_sql("products", "products", PRODUCT_RULES),
        ]
    ),
}

POC = {"product_kpi": "kpi_poc", "alerts": "alerts_poc", "mapping": "mapping_poc", "reviews": "reviews_poc",
       "missing": "missing_poc", "wanted": "wanted_poc", "word_hits": "word_hits_poc"}
NAMED = {n: f"named_{n}" for n in ("raw_reviews", "term_docs", "term_words", "term_all", "term_tf", "term_idf", "term_u", "term_best", "linked")}
SPREAD = {n: f"spread_{n}" for n in ("reviews", "fanned", "product_kpi", "alerts")}


def swapped(sql: str, names: dict[str, str]) -> str:
    """``sql`` over other relations of the same columns."""
    return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(names)})\b", lambda m: m[1] + m[2] + names[m[3]], sql)


for _name in ("alerts", "missing", "wanted", "word_hits"):
    CTES[POC[_name]] = swapped(CTES[_name], POC)
for _name in list(NAMED)[1:]:
    CTES[NAMED[_name]] = swapped(CTES[_name], NAMED)
for _name in list(SPREAD)[1:]:
    CTES[SPREAD[_name]] = swapped(CTES[_name], SPREAD)
CTES["spread_reviews"] = """SELECT d.* REPLACE (CASE WHEN l.score > 0 THEN l.review_code ELSE d.review_code END AS review_code)
    FROM dealt d JOIN linked l USING (review_key)"""
CTES["named_raw_reviews"] = """SELECT n.review_key, concat_ws(' ', p.product_name, n.review_text) AS review_text FROM numbered n
    JOIN products p ON p.idx = (n.review_id - 1) % (SELECT count(*) FROM products)"""

KPI = "FROM product_kpi"
BEST_FOUR = "(SELECT product_id FROM product_kpi ORDER BY revenue DESC, product_id LIMIT 4)"
ALERT_ROW = "product_id, product_name, avg_rating, negative, status"


def period_sql(unit: str) -> str:
    return f"""SELECT date_trunc('{unit}', invoice_ts) AS period, {dbl('sum(revenue)')} AS revenue,
        {big('sum(quantity)')} AS quantity, count(DISTINCT invoice_no) AS invoices
        FROM sales WHERE {IN_RANGE} GROUP BY 1"""


def summary_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {dec2(f'min({c})')} AS min, {dec2(f'max({c})')} AS max,
            {mean2(f'sum(CAST(round({c} * 100) AS BIGINT))', f'count({c})')} AS mean,
            {dec2(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median FROM product_kpi"""
        for c in PRODUCT_METRICS
    )


def correlation_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
            round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS correlation FROM product_kpi"""
        for a in PRODUCT_METRICS
        for b in PRODUCT_METRICS
    )


def score_sql() -> str:
    def norm(c: str) -> str:
        low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
        return f"CASE WHEN {high} > {low} THEN CAST({c} - {low} AS DOUBLE) / ({high} - {low}) ELSE 0.5::DOUBLE END"

    total = f"""0.40::DOUBLE * {norm('revenue')} + 0.30::DOUBLE * {norm('avg_rating')}
        + 0.20::DOUBLE * {norm('quantity')} + 0.10::DOUBLE * (1 - {norm('negative')})"""
    return f"""SELECT product_id, product_name, category, score,
        CAST(floor(rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS BIGINT) AS rank
        FROM (SELECT product_id, product_name, category, {rounded(total, 3)} AS score FROM product_kpi WHERE reviews > 0)"""


def radar_sql(rows: str) -> str:
    def share(c: str) -> str:
        ratio = rounded(f"CAST({c} AS DOUBLE) / max({c}) OVER ()", 4)
        return f"CASE WHEN max({c}) OVER () > 0 THEN {ratio} ELSE 0 END AS {c}"

    picked = ", ".join(share(c) for c in ("revenue", "margin", "quantity", "avg_rating", "reviews"))
    return f"SELECT product_id, {picked} FROM {rows}"


def transposed_sql() -> str:
    def text(c: str) -> str:
        return c if c == "category" else f"CAST(CAST({c} AS DECIMAL(28,2)) AS VARCHAR)"

    metrics = ("category", "revenue", "margin", "quantity", "avg_rating", "reviews", "positive", "negative")
    chosen = f"""(SELECT *, row_number() OVER (ORDER BY product_id) AS place
        FROM product_kpi WHERE product_id IN {BEST_FOUR})"""
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, "
        + ", ".join(f"max({text(m)}) FILTER (place = {i}) AS product_{i}" for i in range(1, 5))
        + f" FROM {chosen}"
        for m in metrics
    )


def too_short(rows: str) -> str:
    return f"UNION ALL BY NAME SELECT series, 'too few months' AS status FROM {rows} GROUP BY series HAVING count(*) < 3"


def linear_sql(rows: str) -> str:
    return f"""SELECT series, last + to_months(step) AS month,
        {dec2('intercept + slope * (n - 1 + step)')} AS forecast, 'ok' AS status FROM (
          SELECT series, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, count(*) AS n,
            max(month) AS last
          FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS t FROM {rows}) GROUP BY series
        ), (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS step) WHERE n >= 3 {too_short(rows)}"""


def count_row(name: str, table: str, columns: int) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS rows, {columns}::BIGINT AS columns FROM {table}"


def orphan_row(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{name}' AS reference, count(*) AS orphan_rows, count(DISTINCT {key}) AS orphan_keys
        FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent})"""


AHEAD = "FROM holt, (SELECT unnest([1, 2, 3]) AS step)"
RMSE = "sqrt(sse / n)"
MAIN: dict[str, str] = {
    "clean_sales": """SELECT invoice_no, product_id, description, quantity, CAST(unit_cents AS DOUBLE) / 100 AS unit_price,
        CAST(revenue AS DOUBLE) AS revenue, CAST(margin AS DOUBLE) AS margin, invoice_ts, customer_id, country FROM sales""",
    "sample_n": """SELECT line_key, invoice_no, product_id, quantity, CAST(unit_cents AS DOUBLE) / 100 AS unit_price
        FROM raw_sales ORDER BY md5('42|' || line_key || '|' || invoice_no || '|' || product_id || '|' || quantity),
        line_key, invoice_no, product_id, quantity, unit_cents LIMIT 500""",
    "clean_reviews": """SELECT review_key, review_text, review_excerpt, sentiment, CAST(rating AS DOUBLE) AS rating,
        review_ts FROM clean_reviews""",
    "table_profile": " UNION ALL ".join(
        [
            count_row("products", "products", 3),
            count_row("customers", "customers", 3),
            count_row("mapping", "mapping", 8),
            count_row("sales", "sales", 10),
            count_row("reviews", "reviews", 7),
            count_row("conversations", "conversations", 5),
            count_row("embeddings", "embeddings", 3),
        ]
    ),
    "top_products": "SELECT product_id, product_name, quantity, category FROM products",
    "ranked_products": "SELECT product_id, product_name, quantity, category, idx FROM products",
    "distinct_customers": "SELECT * FROM customers",
    "categorize_products": "SELECT product_id, product_name, category FROM products",
    "categorize_products_mdm": f"""SELECT product_id, product_name,
        {case_rules('lower(product_name)', MDM_CATEGORIES, OTHER_CATEGORY)} AS category FROM products""",
    "normalize_codes": "SELECT product_id, code FROM products JOIN coded USING (idx)",
    "category_list": "SELECT DISTINCT category FROM products",
    "fk_orphans": " UNION ALL ".join(
        [
            orphan_row("sales.customer_id", "sales", "customer_id", "customers", "customer_id"),
            orphan_row("sales.product_id", "sales", "product_id", "products", "product_id"),
            orphan_row("mapping.product_id", "mapping", "product_id", "products", "product_id"),
            orphan_row("reviews.review_code", "reviews", "review_code", "mapping", "review_code"),
            orphan_row("mapping.review_code", "mapping", "review_code", "reviews", "review_code"),
            orphan_row("embeddings.id", "vectors", "id", "reviews", "review_id"),
        ]
    ),
    "product_kpi": f"SELECT {KPI_COLUMNS} FROM product_kpi",
    "product_kpi_poc": f"SELECT {KPI_COLUMNS} FROM kpi_poc",
    "product_alerts_poc": """SELECT product_id, product_name, category, revenue, avg_rating, reviews, negative, quantity,
        CASE WHEN avg_rating < 3.0 AND quantity > 50 THEN 'CRITIQUE'
             WHEN avg_rating < 3.5 THEN 'A_SURVEILLER' ELSE 'OK' END AS status FROM kpi_poc WHERE reviews > 0""",
    "product_kpi_exact": f"""SELECT m.product_id, m.golden_name AS product_name, m.category,
        {dbl('coalesce(s.revenue, 0)')} AS revenue, {dbl('coalesce(s.margin, 0)')} AS margin,
        {big('coalesce(s.quantity, 0)')} AS quantity, r.avg_rating, coalesce(r.reviews, 0) AS reviews,
        coalesce(r.positive, 0) AS positive, coalesce(r.negative, 0) AS negative, coalesce(r.neutral, 0) AS neutral
        FROM mapping m
        LEFT JOIN (SELECT product_id, sum(revenue) AS revenue, sum(margin) AS margin, sum(quantity) AS quantity
                   FROM sales GROUP BY 1) s USING (product_id)
        LEFT JOIN (SELECT review_code, {mean2('sum(CAST(rating * 100 AS BIGINT))', 'count(rating)')} AS avg_rating,
                   count(*) AS reviews, count(*) FILTER (sentiment = 'positive') AS positive,
                   count(*) FILTER (sentiment = 'negative') AS negative,
                   count(*) FILTER (sentiment = 'neutral') AS neutral FROM reviews GROUP BY 1) r USING (review_code)""",
    "customer_kpi": "SELECT * FROM customer_kpi",
    "customer_kpi_exact": f"""SELECT c.customer_id, c.name, c.country, s.orders, s.products, s.revenue, s.avg_basket,
        {mean2('r.rating_cents', 'coalesce(r.ratings, 0)')} AS avg_rating, coalesce(r.reviews, 0) AS reviews
        FROM customers c
        JOIN (SELECT customer_id, count(DISTINCT invoice_no) AS orders, count(DISTINCT product_id) AS products,
              {dbl('sum(revenue)')} AS revenue,
              {mean2('sum(CAST(revenue * 100 AS BIGINT))', 'count(*)')} AS avg_basket FROM sales GROUP BY 1) s
          USING (customer_id)
        LEFT JOIN (SELECT b.customer_id, sum(CAST(v.rating * 100 AS BIGINT)) AS rating_cents,
              count(v.rating) AS ratings, count(v.review_id) AS reviews
              FROM (SELECT DISTINCT customer_id, product_id FROM sales) b JOIN mapping m USING (product_id)
              JOIN reviews v USING (review_code) GROUP BY 1) r USING (customer_id)""",
    "product_alerts": "SELECT * FROM alerts",
    "data_quality_summary": """SELECT (SELECT count(*) FROM products) AS erp_products,
        (SELECT count(*) FROM mapping) AS golden_records, (SELECT count(*) FROM mapping) AS mappings,
        (SELECT count(DISTINCT review_code) FROM reviews) AS reviewed_codes, (SELECT count(*) FROM reviews) AS reviews,
        (SELECT count(*) FROM reviews WHERE review_code IS NOT NULL) AS linked_reviews,
        (SELECT count(DISTINCT invoice_no) FROM sales) AS invoices, (SELECT count(*) FROM customers) AS customers,
        round(100.0 * (SELECT count(DISTINCT review_code) FROM reviews
            WHERE review_code IN (SELECT review_code FROM mapping))
            / greatest((SELECT count(*) FROM mapping), 1), 1) AS coverage_pct""",
    "match_strategy_counts": """SELECT count(*) AS mappings,
        count(*) FILTER (match_strategy = 'hard') AS hard_matches,
        count(*) FILTER (match_strategy = 'fuzzy') AS fuzzy_matches,
        count(*) FILTER (match_strategy = 'tfidf') AS tfidf_matches,
        count(*) FILTER (match_strategy = 'sbert') AS sbert_matches FROM mapping""",
    "dashboard_totals": f"""SELECT {dbl('sum(CAST(revenue AS DECIMAL(28,2)))')} AS revenue,
        {mean2('sum(CAST(round(avg_rating * 100) AS BIGINT))', 'count(avg_rating)')} AS avg_rating,
        {big('sum(reviews)')} AS reviews, count(*) AS products {KPI}""",
    "product_listing": """SELECT p.product_id, p.product_name, p.category, p.revenue, p.quantity,
        CAST(round(CAST(p.avg_rating AS DECIMAL(10,2)), 1) AS DOUBLE) AS rating, p.reviews, p.positive, p.negative,
        coalesce(a.status, 'OK') AS status
        FROM product_kpi p LEFT JOIN alerts a USING (product_id) ORDER BY p.revenue DESC, p.product_id LIMIT 25""",
    "product_listing_filtered": """SELECT p.product_id, p.product_name, p.category, p.revenue, p.quantity,
        CAST(round(CAST(p.avg_rating AS DECIMAL(10,2)), 1) AS DOUBLE) AS rating, p.reviews, p.positive, p.negative,
        coalesce(a.status, 'OK') AS status
        FROM product_kpi p LEFT JOIN alerts a USING (product_id)
        WHERE p.category = 'Art de la Table' AND p.product_id IN (SELECT product_id FROM alerts WHERE status = 'OK')
        ORDER BY p.avg_rating DESC NULLS FIRST, p.product_id LIMIT 25""",
    "revenue_by_category": f"SELECT category, {dbl('sum(CAST(revenue AS DECIMAL(28,2)))')} AS revenue {KPI} GROUP BY 1",
    "open_alerts": f"SELECT {ALERT_ROW} FROM alerts WHERE status <> 'OK' ORDER BY avg_rating, product_id LIMIT 10",
    "critical_products": """SELECT product_id, product_name, category, avg_rating, reviews, negative, revenue
        FROM alerts WHERE status = 'CRITIQUE'""",
    "alert_messages": """SELECT product_id, product_name || ' [' || category || '] Note : '
        || CAST(CAST(avg_rating AS DECIMAL(10,2)) AS VARCHAR) || '/5 | ' || negative || ' avis négatifs / ' || reviews
        || ' total | CA : ' || format('{:,}', CAST(round_even(revenue, 0) AS BIGINT)) || ' EUR' AS message
        FROM alerts WHERE status = 'CRITIQUE'""",
    "product_sheet_sales": f"""SELECT product_id, {dbl('sum(revenue)')} AS revenue, {big('sum(quantity)')} AS quantity,
        count(DISTINCT invoice_no) AS invoices, count(*) AS lines FROM sales GROUP BY 1""",
    "product_sheet_reviews": f"""SELECT product_id,
        {mean2('sum(CAST(rating * 100 AS BIGINT))', 'count(rating)')} AS avg_rating, count(*) AS reviews
        FROM mapping JOIN reviews USING (review_code) GROUP BY 1""",
    "product_monthly_revenue": f"""SELECT product_id, date_trunc('month', invoice_ts) AS month,
        {dbl('sum(revenue)')} AS revenue FROM sales GROUP BY ALL""",
    "rating_distribution": """SELECT product_id, CAST(rating AS DOUBLE) AS rating, count(*) AS reviews,
        'mapping' AS source FROM mapping JOIN reviews USING (review_code) GROUP BY ALL UNION ALL
        SELECT product_id, CAST(rating AS DOUBLE), count(*), 'keywords' FROM word_hits GROUP BY ALL""",
    "latest_reviews": f"""
        SELECT product_id, CAST(place AS INTEGER) AS place, review_id, CAST(rating AS DOUBLE) AS rating, sentiment, source FROM (
        SELECT m.product_id, r.review_id, r.rating, r.sentiment, 'mapping' AS source,
            row_number() OVER (PARTITION BY m.product_id {LATEST}) AS place
            FROM mapping m JOIN reviews r USING (review_code)
        UNION ALL
        SELECT product_id, review_id, rating, sentiment, 'keywords',
            row_number() OVER (PARTITION BY product_id ORDER BY rating DESC, review_id) FROM word_hits
        UNION ALL
        SELECT product_id, review_id, rating, sentiment, 'overall', row_number() OVER (PARTITION BY product_id {LATEST})
            FROM (SELECT product_id FROM missing WHERE product_id NOT IN (SELECT product_id FROM word_hits)),
                 (SELECT * FROM reviews {LATEST} LIMIT 3)
        ) WHERE place <= 3""",
    "review_keyword_search": f"""SELECT product_name, count(DISTINCT review_key) AS matching_reviews
        FROM (SELECT product_name, unnest({KEYWORDS.format('product_name')}) AS keyword
              FROM (SELECT DISTINCT product_name FROM products)) k
        JOIN raw_reviews r ON contains(lower(r.review_text), k.keyword) GROUP BY 1""",
    "mapping_extract": """SELECT mapping_id, product_id, product_name, review_code, category, golden_name
        FROM mapping ORDER BY mapping_id LIMIT 20""",
    "coverage_by_category": """SELECT category, count(DISTINCT product_id) AS erp_products,
        count(DISTINCT r.review_code) AS reviewed_products,
        round(100.0 * count(DISTINCT r.review_code) / nullif(count(DISTINCT product_id), 0), 1) AS coverage_pct
        FROM mapping m LEFT JOIN reviews r ON r.review_code = m.review_code GROUP BY category""",
    "revenue_by_period": period_sql("month"),
    "revenue_by_quarter": period_sql("quarter"),
    "revenue_by_year": period_sql("year"),
    "period_totals": f"""SELECT {dbl('sum(CAST(revenue AS DECIMAL(28,2)))')} AS revenue,
        {big('sum(quantity)')} AS quantity, {big('sum(invoices)')} AS invoices FROM periods""",
    "period_top_products": f"""SELECT golden_name, category, {dbl('sum(revenue)')} AS revenue,
        {big('sum(quantity)')} AS quantity FROM sales JOIN mapping USING (product_id) WHERE {IN_RANGE}
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "sales_by_country": "SELECT * FROM by_country",
    "geo_totals": f"""SELECT count(country) AS countries, {dbl('sum(CAST(revenue AS DECIMAL(28,2)))')} AS revenue,
        {big('sum(customers)')} AS customers FROM by_country""",
    "product_comparison": f"""SELECT product_id, product_name, category, revenue, margin, quantity, avg_rating, reviews,
        positive, negative {KPI} WHERE product_id IN {BEST_FOUR}""",
    "comparison_transposed": transposed_sql(),
    "monthly_revenue": f"SELECT date_trunc('month', invoice_ts) AS month, {dbl('sum(revenue)')} AS revenue FROM sales GROUP BY 1",
    "best_sellers": f"""SELECT product_id, product_name, category, revenue, quantity, avg_rating {KPI}
        ORDER BY revenue DESC, product_id LIMIT 10""",
    "top_customers": """SELECT customer_id, name, country, orders, revenue FROM customer_kpi
        ORDER BY revenue DESC NULLS FIRST, customer_id LIMIT 10""",
    "best_rated_products": f"""SELECT product_id, product_name, avg_rating, reviews, positive, negative {KPI}
        ORDER BY avg_rating DESC NULLS FIRST, product_id LIMIT 10""",
    "worst_rated_products": f"""SELECT {ALERT_ROW} FROM alerts WHERE status IN ('CRITIQUE', 'A_SURVEILLER')
        ORDER BY avg_rating, product_id LIMIT 10""",
    "customer_satisfaction": f"""SELECT k.customer_id, k.name, k.country, k.revenue, k.orders, k.avg_basket,
        coalesce({mean2('sum(CAST(r.rating * 100 AS BIGINT))', 'count(r.rating)')}, 0) AS avg_rating
        FROM customer_kpi k JOIN sales s USING (customer_id) JOIN mapping m USING (product_id)
        JOIN reviews r USING (review_code) GROUP BY k.customer_id, k.name, k.country, k.revenue, k.orders, k.avg_basket""",
    "customer_satisfaction_top": f"""SELECT k.customer_id, k.name, k.country, k.revenue, k.orders, k.avg_basket,
        coalesce({mean2('sum(CAST(r.rating * 100 AS BIGINT))', 'count(r.rating)')}, 0) AS avg_rating
        FROM customer_kpi k JOIN sales s USING (customer_id) JOIN mapping m USING (product_id)
        JOIN reviews r USING (review_code) GROUP BY k.customer_id, k.name, k.country, k.revenue, k.orders, k.avg_basket
        ORDER BY k.revenue DESC NULLS FIRST, k.customer_id LIMIT 200""",
    "dq_rules": rules_sql(
        "raw_reviews",
        "raw_reviews",
        [
            r_nulls("sentiment_flag"),
            r_min(1_000_000_000),
            r_unique("sentiment_flag"),
            r_set("sentiment_flag", "0"),
            r_between("review_key", 5, 100),
            r_positive("review_key", "warning"),
        ],
    )
    + " UNION ALL "
    + rules_sql(
        "raw_sales",
        "raw_sales",
        [r_future("invoice_ts", RULES_NOW), r_set("country", "'NATION_0', 'NATION_1'", "warning")],
    ),
    "dq_sales": rules_sql("sales", "sales", SALES_RULES),
    "dq_reviews": rules_sql("reviews", "reviews", REVIEW_RULES),
    "dq_products": rules_sql("products", "products", PRODUCT_RULES),
    "dq_report": """SELECT suite, bool_and(passed OR severity <> 'error') AS passed, count(*) AS rules,
        count(*) FILTER (NOT passed AND severity = 'error') AS errors,
        count(*) FILTER (NOT passed AND severity = 'warning') AS warnings FROM report GROUP BY suite""",
    "dq_constraints": " UNION ALL ".join(
        [
            rules_sql("products", "products", [r_nulls("product_id"), r_unique("product_id"), r_nulls("product_name")]),
            rules_sql("customers", "customers", [r_nulls("customer_id"), r_unique("customer_id")]),
            rules_sql("mapping", "mapping",
                      [r_nulls("product_id"), r_unique("mapping_id"), r_nulls("match_score"), r_nulls("match_strategy")]),
            rules_sql("sales", "sales", [r_nulls(c) for c in ("invoice_no", "product_id", "quantity", "revenue", "margin")]),
            rules_sql("reviews", "reviews", [r_unique("review_id"), r_between("rating", 1.0, 5.0), r_set("sentiment", SENTIMENTS)]),
        ]
    ),
    "hard_match": "SELECT idx, match_idx, score FROM hard",
    "fuzzy_match": "SELECT idx, match_idx, score FROM fuzzy",
    "fuzzy_match_distinct": """SELECT a AS idx, b AS match_idx, round(ratio / 100, 4) AS score FROM (
        SELECT * FROM ratios QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(ratio, 9) DESC, b) = 1)
        WHERE ratio >= 80 - 1e-9 AND b < a""",
    "golden_records_words": "SELECT * FROM words_mapping",
    "tfidf_match": "SELECT idx, match_idx, score FROM tfidf",
    "tfidf_match_other": "SELECT a AS idx, b AS match_idx, round(c, 4) AS score FROM lone_best",
    "rank_match": """SELECT idx, product_id, printf('REV_%04d', idx % 1000 + 1) AS review_code,
        CAST(0 AS DOUBLE) AS score FROM products""",
    "golden_records": "SELECT * FROM mapping",
    "golden_records_poc": "SELECT * FROM mapping_poc",
    "match_quality": """SELECT match_strategy, count(*) AS mappings,
        round(100.0 * count(*) / (SELECT count(*) FROM mapping), 1) AS share_pct,
        round(avg(match_score), 4) AS mean_score FROM mapping GROUP BY 1""",
    "hybrid_match": """SELECT idx, match_idx, cosine, hybrid_score,
        CASE WHEN hybrid_score >= 0.70 THEN 'auto' WHEN hybrid_score >= 0.50 THEN 'manual_review'
             ELSE 'quarantine' END AS route FROM (
        SELECT l.a AS idx, l.b AS match_idx, round(l.c, 4) AS cosine,
          round(0.6::DOUBLE * round(l.c, 4) + 0.4::DOUBLE * (1 - levenshtein(x.name, y.name)::DOUBLE
            / greatest(length(x.name), length(y.name), 1)), 4) AS hybrid_score
        FROM lone_best l JOIN distinct_names x ON x.rep = l.a JOIN distinct_names y ON y.rep = l.b)""",
    "mapping_history": "SELECT * FROM history",
    "sales_mapping_as_of": f"""SELECT s.product_id, h.review_code, h.match_strategy, count(*) AS lines, {dbl('sum(s.revenue)')} AS revenue
        FROM sales s LEFT JOIN history h ON h.product_id = s.product_id AND h.valid_from <= s.invoice_ts
            AND (h.valid_to IS NULL OR s.invoice_ts < h.valid_to) GROUP BY ALL""",
    "attach_reviews_rr": "SELECT review_key, review_code, review_id FROM dealt",
    "attach_reviews_tfidf": "SELECT review_key, product_idx, score, review_code FROM linked",
    "semantic_assign": """WITH best AS (SELECT id, query_id, score FROM near_centres
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) = 1),
        common AS (SELECT query_id FROM best WHERE score >= 0.30 GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1)
        SELECT id AS review_key, CASE WHEN score >= 0.30 THEN query_id ELSE (SELECT query_id FROM common) END
          AS product_idx, score >= 0.30 AS confident, score FROM best""",
    "column_summary": summary_sql(),
    "correlation_matrix": correlation_sql(),
    "monthly_trend": f"""SELECT CAST(last_day(m) AS TIMESTAMP) AS month_end, coalesce(r, 0) AS revenue FROM (
        SELECT unnest(generate_series(min(date_trunc('month', invoice_ts)), max(date_trunc('month', invoice_ts)),
          INTERVAL 1 MONTH)) AS m FROM sales) LEFT JOIN
        (SELECT date_trunc('month', invoice_ts) AS m, {dbl('sum(revenue)')} AS r FROM sales GROUP BY 1) USING (m)""",
    "customer_segments": "SELECT * FROM segments",
    "segment_profile": f"""SELECT l.segment, count(s.customer_id) AS customers,
        coalesce({mean2('sum(CAST(round(revenue * 100) AS BIGINT))', 'count(s.customer_id)')}, 0) AS mean_revenue,
        coalesce({mean2('sum(CAST(round(avg_rating * 100) AS BIGINT))', 'count(s.customer_id)')}, 0) AS mean_rating,
        coalesce(string_agg(name, ', ' ORDER BY place) FILTER (place <= 3), '') AS top_customers,
        (SELECT {dec2('max(revenue_threshold)')} FROM segments) AS revenue_threshold,
        (SELECT {dec2('max(rating_threshold)')} FROM segments) AS rating_threshold
        FROM (SELECT unnest(['Champions', 'Déçus Rentables', 'Fans Peu Dépensiers', 'Inactifs']) AS segment) l
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY revenue DESC, customer_id) AS place
                   FROM segments) s USING (segment) GROUP BY l.segment""",
    "rfm_scores": "SELECT customer_id, orders, revenue, f_score, m_score, rfm, profile FROM profiles",
    "rfm_profile": f"""SELECT profile, count(*) AS customers,
        {mean2('sum(CAST(round(revenue * 100) AS BIGINT))', 'count(*)')} AS mean_revenue FROM profiles GROUP BY 1""",
    "customer_rfm_base": "SELECT * FROM rfm_base",
    "churn_labels": "SELECT * FROM labels_churn",
    "churn_rate": f"""SELECT threshold_days, count(*) AS customers, {big('sum(churned)')} AS churned,
        round(100.0 * sum(churned) / count(*), 1) AS churn_rate_pct FROM labels_churn GROUP BY 1""",
    "recency_histogram": """SELECT CAST(least(CASE WHEN hi > lo THEN floor((recency_days - lo) * 30 / (hi - lo)) ELSE 0 END
          + 1, 30) AS BIGINT) AS bin, count(*) AS customers, min(recency_days) AS min_days, max(recency_days) AS max_days
        FROM rfm_base, (SELECT min(recency_days) AS lo, max(recency_days) AS hi FROM rfm_base) GROUP BY 1""",
    "product_score": score_sql(),
    "radar_metrics": radar_sql(f"(SELECT * FROM product_kpi WHERE product_id IN {BEST_FOUR})"),
    "radar_catalogue": radar_sql("product_kpi"),
    "linear_forecast": linear_sql("series"),
    "category_forecast": linear_sql(f"""(SELECT category AS series, date_trunc('month', invoice_ts) AS month,
        {dbl('sum(revenue)')} AS value FROM sales JOIN products USING (product_id) GROUP BY ALL)"""),
    "product_forecast": linear_sql(f"""(SELECT product_id AS series, date_trunc('month', invoice_ts) AS month,
        {dbl('sum(revenue)')} AS value FROM sales GROUP BY ALL)"""),
    "holt_forecast": f"""SELECT series, last + to_months(CAST(step AS INTEGER)) AS month, alpha, beta,
        {dec2('level + step * trend')} AS forecast,
        {dec2(f'greatest(level + step * trend - 1.96::DOUBLE * {RMSE}, 0)')} AS lower,
        {dec2(f'level + step * trend + 1.96::DOUBLE * {RMSE}')} AS upper, 'ok' AS status {AHEAD} {too_short('series')}""",
    "forecast_interval": f"""SELECT series, n AS months, alpha, beta, {dec2(RMSE)} AS rmse,
        {dec2(f'1.96::DOUBLE * {RMSE}')} AS half_width, 'ok' AS status FROM holt {too_short('series')}""",
    "holt_winters_forecast": f"""SELECT series, last + to_months(CAST(step AS INTEGER)) AS month, model,
        {dec2('value')} AS forecast, {dec2('greatest(value - 1.96::DOUBLE * sqrt(sse / n), 0)')} AS lower,
        {dec2('value + 1.96::DOUBLE * sqrt(sse / n)')} AS upper, 'ok' AS status FROM (
          SELECT series, last, n, step, value, sse, 'trend + additive season' AS model FROM added UNION ALL
          SELECT series, last, n, step, value, sse, 'trend * multiplicative season' FROM multiplied UNION ALL
          SELECT series, last, n, step, level + step * trend, sse, 'trend' FROM holt, ahead WHERE n < 12)
        {too_short('series')}""",
    "vector_search": "SELECT * FROM found",
    "review_snippets": """SELECT query_id, rank, printf('%d. [%s] Note:%s (%s) — similarité %s' || chr(10) || '   %s...',
        rank, product_name, CAST(CAST(rating AS DECIMAL(3,1)) AS VARCHAR), f.sentiment,
        CAST(CAST(round(CAST(similarity AS DECIMAL(10,6)), 2) AS DECIMAL(4,2)) AS VARCHAR),
        substr(review_text, 1, 200)) AS line FROM found f JOIN raw_reviews USING (review_key)""",
    "unindexed_reviews": "SELECT review_id, review_key FROM reviews WHERE review_id NOT IN (SELECT id FROM vectors)",
    "ann_recall": "SELECT query_id, count(*) AS wanted, true AS reached FROM exact GROUP BY query_id",
    "embedding_upsert": "SELECT id, round(unnest(vec), 4) + 0 AS value FROM vectors",
    "embedding_upsert_new": """SELECT review_id AS id, CAST(64 AS BIGINT) AS dims,
        CASE WHEN regexp_matches(coalesce(review_text, ''), '\\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
        FROM reviews WHERE review_id NOT IN (SELECT id FROM vectors)""",
    "name_lookup": f"""SELECT term, product_name, count(*) AS products FROM products
        JOIN (SELECT DISTINCT unnest({KEYWORDS.format('product_name')}) AS term FROM products)
          ON product_name ILIKE '%' || term || '%' GROUP BY ALL""",
    "recent_messages": """SELECT session_id, seq, role, content FROM messages
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3""",
    "session_summary": """SELECT session_id, count(*) AS messages, min(sent_at) AS first_at, max(sent_at) AS last_at
        FROM messages GROUP BY 1""",
    "latest_sessions": """SELECT session_id, count(*) AS messages, min(sent_at) AS first_at, max(sent_at) AS last_at
        FROM messages GROUP BY 1 ORDER BY last_at DESC, session_id LIMIT 50""",
    "route_questions": f"""SELECT session_id, seq,
        {case_rules('lower(content)', QUESTION_RULES, DEFAULT_QUESTION)} AS template,
        {any_word('lower(content)', FORCED_QUESTION_WORDS)} AS forced FROM messages""",
    "route_analysis": f"SELECT session_id, seq, {case_rules('lower(content)', ANALYSIS_RULES, None)} AS analysis FROM messages",
    "extract_sql": f"""SELECT session_id, seq, CASE WHEN usable AND NOT forced THEN written END AS sql,
        CASE WHEN forced THEN 'forced' WHEN usable THEN 'written' ELSE 'rules' END AS source,
        CASE WHEN NOT usable OR forced
          THEN {case_rules('lower(question)', QUESTION_RULES, DEFAULT_QUESTION)} END AS template
        FROM (SELECT *, {any_word('lower(question)', FORCED_QUESTION_WORDS)} AS forced,
            coalesce(written NOT IN ('', '...', 'SELECT ...', 'SELECT…')
                     AND regexp_matches(written, '\\bFROM\\b', 'i'), false) AS usable
          FROM written)""",
    "flag_unsafe_sql": f"""SELECT session_id, seq,
        coalesce(regexp_matches(reply, '\\b({'|'.join(UNSAFE_WORDS)})\\b', 'i'), false) AS unsafe FROM replies""",
}

for _name in ("product_listing_filtered", "open_alerts", "product_sheet_reviews", "worst_rated_products", "product_score"):
    MAIN[_name] = swapped(MAIN[_name], SPREAD)
for _name in ("critical_products", "alert_messages"):  # under both strategies of the mapping
    MAIN[_name] = " UNION ALL ".join(
        f"SELECT *, '{strategy}' AS strategy FROM ({swapped(MAIN[_name], names)})" for strategy, names in (("semantic", SPREAD), ("poc", POC))
    )
for _name in ("rating_distribution", "latest_reviews"):
    MAIN[f"{_name}_poc"] = swapped(MAIN[_name], POC)
MAIN["attach_reviews_named"] = swapped(MAIN["attach_reviews_tfidf"], NAMED)


def needed(sql: str) -> list[str]:
    """The named relations ``sql`` builds on, each after those it builds on itself."""
    order: list[str] = []
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in [n for n in CTES if n in set(re.findall(r"\w+", text))]:
            if name not in begun:
                begun.add(name)
                visit(CTES[name])
                order.append(name)

    visit(sql)
    return order


def oracle(name: str) -> str:
    body = MAIN[name]
    # A source table may share its name with a relation; only relations in use are defined.
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed(body))
    if body.lstrip().startswith("WITH "):
        body = body.lstrip()[5:]
        return f"WITH {parts},\n{body}"
    return f"WITH {parts}\n{body}" if parts else body


def oracle_queries() -> dict[str, str]:
    return {name: oracle(name) for name in MAIN}
