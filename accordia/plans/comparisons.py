"""Queries that compare arms, clusterings and counts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordia.operators import agreement, calibration, cells, relations, risk, strata
from accordia.plans import fit_sql
from accordia.plans import inputs as I
from accordia.plans.inputs import sql
from accordia.plans.queries import R, query, recursive


@query(sql("samples counts", "SELECT item_id, string_agg(key || '=' || c, ',' ORDER BY key) AS counts FROM counts GROUP BY item_id"))
def key_counts(spark, d):
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return agreement.key_counts(I.samples(spark, d)).select("item_id", F.array_join(pairs, ",").alias("counts"))


@query(
    sql(
        "samples",
        """, l AS (SELECT item_id, pos AS i, lead(pos) OVER (PARTITION BY item_id, key ORDER BY pos) AS j FROM samples WHERE key <> 'NONE')
SELECT item_id, i, j, 'SAME_PROVISION' AS label, 1.0::DOUBLE AS score FROM l WHERE j IS NOT NULL""",
    )
)
def identity_pairs(spark, d):
    return relations.identity_pairs(I.samples(spark, d))


@query(sql("scored", ", c AS (SELECT topic, harm, count(*) AS n FROM scored GROUP BY ALL) SELECT topic, arg_min(harm, (-n, harm)) AS harm_class FROM c GROUP BY topic"))
def harm_class_modal(spark, d):
    return calibration.harm_class(I.scored(spark, d), rule="modal")


Z90 = calibration.z_of(0.9)


@query(
    sql(
        "scored",
        f""", a AS (SELECT topic, count(*) AS n, avg(correct) AS p FROM scored GROUP BY topic)
SELECT topic, n, {R("p")} AS p, {R(f"greatest(0, p - {Z90} * sqrt(p * (1 - p) / n))")} AS low, {R(f"least(1, p + {Z90} * sqrt(p * (1 - p) / n))")} AS high FROM a""",
    )
)
def normal_at_confidence(spark, d):
    """Normal intervals of 90 % confidence."""
    a = I.scored(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("p"))
    low, high = calibration.normal_interval(F.col("p"), F.col("n"), Z90)
    return a.select("topic", "n", "p", low.alias("low"), high.alias("high"))


@query(
    sql(
        "scored",
        f""", i AS (SELECT slice, correct, (n_chars % 5 < 3)::INT AS exact_all_same, (n_chars % 5 < 2)::INT AS typed_all_same, (n_chars % 11) / 11 AS e FROM scored),
v AS (SELECT * FROM i UNION ALL SELECT 'pooled', * EXCLUDE slice FROM i),
g AS (SELECT slice, avg(correct) FILTER (WHERE exact_all_same = 1) - avg(correct) FILTER (WHERE exact_all_same = 0) AS x, avg(correct) FILTER (WHERE typed_all_same = 1) - avg(correct) FILTER (WHERE typed_all_same = 0) AS t FROM v GROUP BY slice),
c AS (SELECT slice, e, sum(correct) AS a, sum(1 - correct) AS b FROM v WHERE exact_all_same = 1 GROUP BY slice, e),
w AS (SELECT *, sum(a) OVER (PARTITION BY slice ORDER BY e) AS below FROM c),
z AS (SELECT slice, sum(a + b)::BIGINT AS n_unanimous, CASE WHEN sum(a) * sum(b) > 0 THEN sum(b * (below - a / 2)) / (sum(a) * sum(b)) END AS auroc FROM w GROUP BY slice)
SELECT slice, {R("x")} AS exact_gap, {R("t")} AS typed_gap, {R("abs(x) - abs(t)")} AS narrowed, n_unanimous, {R("auroc")} AS auroc FROM g LEFT JOIN z USING (slice)""",
    )
)
def typed_separation(spark, d):
    n = F.col("n_chars")
    return cells.typed_separation(I.scored(spark, d).select("slice", "correct", (n % 5 < 3).cast("int").alias("exact_all_same"), (n % 5 < 2).cast("int").alias("typed_all_same"), ((n % 11) / 11).alias("typed_entropy")))


_TERMS = ["u", "v", "uv"]
_score = lambda t: f"1 / (1 + exp(-least(35.0, greatest(-35.0, max(weight) FILTER (WHERE term = 0) + {' + '.join(f'max(weight) FILTER (WHERE term = {i + 1}) * any_value({c})' for i, c in enumerate(_TERMS))}))))"


def _fitted(arm: str, where: str) -> str:
    rows = f"{arm}_rows AS (SELECT u, v, uv, 1 - correct AS y FROM i WHERE dev AND {where})"
    return f"{rows}, {fit_sql.tagged(fit_sql.monotone(f'{arm}_rows', _TERMS), arm)}"


@query(
    recursive(
        sql(
            "scored",
            f""", i AS (SELECT item_id, slice, correct, u, (n_chars % 17) / 17 AS v, u * ((n_chars % 17) / 17) AS uv, (('0x' || substr(sha256('7|' || item_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) < 0.6 AS dev FROM scored),
{_fitted("pooled", "true")}, {_fitted("within", "slice = 'en'")},
h AS (
    SELECT 'pooled' AS arm, (SELECT count(*) FROM pooled_rows) AS training_n, item_id, any_value(correct) AS correct, {_score("pooled")} AS s FROM i, pooled_weights_ WHERE NOT dev AND slice = 'en' GROUP BY item_id
    UNION ALL SELECT 'within', (SELECT count(*) FROM within_rows), item_id, any_value(correct), {_score("within")} FROM i, within_weights_ WHERE NOT dev AND slice = 'en' GROUP BY item_id
),
c AS (SELECT arm, training_n, s, sum(correct) AS a, sum(1 - correct) AS b FROM h GROUP BY ALL),
w AS (SELECT *, sum(a) OVER (PARTITION BY arm ORDER BY s) AS below FROM c),
z AS (SELECT arm, training_n, sum(a + b)::BIGINT AS n, sum(a)::BIGINT AS n_correct, CASE WHEN sum(a) * sum(b) > 0 THEN sum(b * (below - a / 2)) / (sum(a) * sum(b)) END AS auroc FROM w GROUP BY ALL),
m AS (SELECT arm, avg((1 - s - correct) * (1 - s - correct)) AS brier FROM h GROUP BY arm)
SELECT arm, training_n, n, n_correct, {R("auroc")} AS auroc, {R("brier")} AS brier FROM z JOIN m USING (arm)""",
        )
    )
)
def within_slice_arms(spark, d):
    """A risk score fitted on all slices against one fitted on English alone, on the same held-out items."""
    items = I.scored(spark, d).select("item_id", "slice", "correct", "u", ((F.col("n_chars") % 17) / 17).alias("v"), risk.in_first_part(7, F.col("item_id"), 0.6).alias("dev"))
    return strata.within_slice_arms(items, "en", [F.col("u"), F.col("v"), F.col("u") * F.col("v")])
