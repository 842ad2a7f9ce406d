"""Fits in DuckDB's SQL: what the queries of fits are held against. Each returns the text of common table expressions."""

from __future__ import annotations

import re


def isotonic(source: str, by: str) -> str:
    """knots (by, x, y) of the non-decreasing fit of `source` (by, x, correct), by its min-max formula.

    y at a score is the largest, over starts at or before it, of the least mean up to any end at or after it. A block begins
    where the fit's running sum meets that of the data.
    """
    return f"""
classes AS (SELECT {by} FROM {source} WHERE x IS NOT NULL AND correct IS NOT NULL GROUP BY {by} HAVING min(correct) < max(correct)),
cells AS (SELECT {by}, x, sum(correct) AS r, count(*) AS n FROM {source} SEMI JOIN classes USING ({by}) WHERE x IS NOT NULL AND correct IS NOT NULL GROUP BY {by}, x),
placed AS (SELECT *, row_number() OVER w AS k, sum(r) OVER w AS s, sum(n) OVER w AS t FROM cells WINDOW w AS (PARTITION BY {by} ORDER BY x)),
spans AS (SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))}, a.k AS a, b.k AS b, (b.s - a.s + a.r) / (b.t - a.t + a.n) AS m FROM placed a JOIN placed b USING ({by}) WHERE b.k >= a.k),
least_ AS (SELECT {by}, a, b AS k, min(m) OVER (PARTITION BY {by}, a ORDER BY b DESC) AS m FROM spans),
fitted AS (SELECT {by}, k, max(m) AS y FROM least_ GROUP BY {by}, k),
summed AS (SELECT p.*, y, sum(n * y) OVER (PARTITION BY {by} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM placed p JOIN fitted USING ({by}, k)),
knots AS (SELECT {by}, x, y FROM summed WHERE k = 1 OR abs(f - (s - r)) < 1e-7)"""


#: stretches (by, low, high, x0, x1, y0, y1) between knots, from below the first to above the last.
STRETCHES = """stretches AS (
    SELECT {by}, CASE WHEN k = 1 THEN '-infinity'::DOUBLE ELSE x END AS low, coalesce(x1, 'infinity'::DOUBLE) AS high, x AS x0, x1, y AS y0, y1
    FROM (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knots WINDOW w AS (PARTITION BY {by} ORDER BY x))
)"""
#: The value at x of the stretch that holds it.
BETWEEN = "least(1.0, greatest(0.0, CASE WHEN x1 IS NULL OR {x} <= x0 THEN y0 ELSE y0 + ({x} - x0) / (x1 - x0) * (y1 - y0) END))"


def tagged(text: str, tag: str) -> str:
    """text with its inner names told apart from another fit's in the same query: tag_cells for cells, and so on."""
    return re.sub(r"\b(classes|cells|walk|totals|last_|weights_)\b", rf"{tag}_\1", text)


def platt(source: str, by: str, steps: int = 200) -> str:
    """lines (by, slope, intercept, n): half Newton steps over `source` (by, x, correct), all groups at once."""
    return f"""
classes AS (
    SELECT {by}, sum(correct) AS right_, count(*) - sum(correct) AS wrong_, count(*) AS all_ FROM {source} WHERE x IS NOT NULL AND correct IS NOT NULL GROUP BY {by} HAVING min(correct) < max(correct)
),
cells AS (SELECT {by}, x, sum(correct) AS r, count(*) AS n FROM {source} SEMI JOIN classes USING ({by}) WHERE x IS NOT NULL AND correct IS NOT NULL GROUP BY {by}, x),
walk AS (
    SELECT {by}, 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, false AS done FROM classes
    UNION ALL
    SELECT {by}, step + 1, CASE WHEN flat THEN a ELSE greatest(0.0, a - 0.5 * da) END, CASE WHEN flat THEN b ELSE b - 0.5 * db END, flat OR (abs(da) < 1e-10 AND abs(db) < 1e-10)
    FROM (
        SELECT *, det <= 1e-12 AS flat, (one * gx - xs * g) / nullif(det, 0) AS da, (xx * g - xs * gx) / nullif(det, 0) AS db
        FROM (
            SELECT *, xx * one - xs * xs AS det
            FROM (
                SELECT {by}, step, a, b, sum(x * e) AS gx, sum(e) AS g, sum(w * x * x) + 1e-9 AS xx, sum(w * x) AS xs, sum(w) + 1e-9 AS one
                FROM (
                    SELECT {by}, step, a, b, x, n * p - (r * (right_ + 1) / (right_ + 2) + (n - r) / (wrong_ + 2)) AS e, n * greatest(p * (1 - p), 1e-9) AS w
                    FROM (SELECT walk.*, x, r, n, right_, wrong_, 1 / (1 + exp(-(x * a + b))) AS p FROM walk JOIN cells USING ({by}) JOIN classes USING ({by}) WHERE NOT done AND step < {steps})
                ) GROUP BY {by}, step, a, b
            )
        )
    )
),
lines AS (SELECT {by}, arg_max(a, step) AS slope, arg_max(b, step) AS intercept, any_value(all_) AS n FROM walk JOIN classes USING ({by}) GROUP BY {by})"""


def monotone(source: str, terms: list[str], l2: float = 0.25, rate: float = 0.05, epochs: int = 2500) -> str:
    """weights_ (term, weight): projected gradient steps over `source` (a column for each term, y), from the log odds."""
    n = len(terms)
    z = " + ".join(["b", *[f"w{i} * {t}" for i, t in enumerate(terms)]])
    return f"""
cells AS (SELECT {", ".join(terms)}, sum(y) AS y, count(*) AS n FROM {source} GROUP BY {", ".join(terms)}),
totals AS (SELECT sum(y) AS y, sum(n) AS n FROM cells),
walk AS (
    SELECT 0 AS step, ln((y / n) / (1 - y / n)) AS b, {", ".join(f"0.0::DOUBLE AS w{i}" for i in range(n))} FROM totals
    UNION ALL
    SELECT step + 1, b - {rate} * sum(e) / (SELECT n FROM totals), {", ".join(f"greatest(0.0, w{i} - {rate} * (sum({t} * e) / (SELECT n FROM totals) + {l2} * w{i}))" for i, t in enumerate(terms))}
    FROM (SELECT walk.*, cells.*, n / (1 + exp(-least(35.0, greatest(-35.0, {z})))) - y AS e FROM walk, cells WHERE step < {epochs})
    GROUP BY step, b, {", ".join(f"w{i}" for i in range(n))}
),
last_ AS (SELECT * FROM walk WHERE step = {epochs}),
weights_ AS (SELECT 0 AS term, b AS weight FROM last_ {" ".join(f"UNION ALL SELECT {i + 1}, w{i} FROM last_" for i in range(n))})"""


def tail(k: str, n: str, p: str) -> str:
    """P(at least k of n), for 0 < p < 1 and k > 0, by the terms on its shorter side."""
    return f"(1 - list_sum(list_transform(range(0, {k}), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


def upper_tail(k: str, n: str, p: str) -> str:
    return f"list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


def exact_low(source: str, by: str, alpha: float = 0.05) -> str:
    """bounds (by, hits, n, exact_low) of `source` (by, hits, n), by bisection."""
    return f"""
walk AS (
    SELECT {by}, hits, n, 0 AS step, 0.0::DOUBLE AS low, hits / n AS high FROM {source}
    UNION ALL
    SELECT {by}, hits, n, step + 1, CASE WHEN under THEN mid ELSE low END, CASE WHEN under THEN high ELSE mid END
    FROM (SELECT *, {upper_tail("hits", "n", "mid")} < {alpha} AS under FROM (SELECT *, (low + high) / 2 AS mid FROM walk WHERE step < 60 AND hits > 0 AND hits < n))
),
bounds AS (SELECT {by}, hits, n, CASE WHEN hits = n THEN 1.0 ELSE max(low) END AS exact_low FROM walk GROUP BY {by}, hits, n)"""


def needed(source: str, by: str, rate: str, wanted: int, confidence: float = 0.95, most: int = 20_000) -> str:
    """needed_ (by, needed): the fewest items with P(at least `wanted` hits) of the confidence, by bisection; null beyond `most`."""
    return f"""
walk AS (
    SELECT {by}, {rate} AS p, 0 AS step, {max(1, wanted)}::BIGINT AS low, {most}::BIGINT AS high FROM {source} WHERE {rate} > 0 AND {tail(str(wanted), str(most), rate)} >= {confidence}
    UNION ALL
    SELECT {by}, p, step + 1, CASE WHEN enough THEN low ELSE mid + 1 END, CASE WHEN enough THEN mid ELSE high END
    FROM (SELECT *, {tail(str(wanted), "mid", "p")} >= {confidence} AS enough FROM (SELECT *, (low + high) // 2 AS mid FROM walk WHERE low < high))
),
needed_ AS (SELECT {by}, arg_max(low, step) AS needed FROM walk GROUP BY {by})"""
