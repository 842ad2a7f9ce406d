"""Queries of exact resampling, with SQL: weights follow from hashes, so that DuckDB draws the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordia.operators import resample
from accordia.plans import inputs as I
from accordia.plans.inputs import sql
from accordia.plans.queries import R, query

REPLICATES = 20
_drawn = lambda units, seed: f"""
t AS (SELECT count(*) AS n FROM {units}),
draws AS (
    SELECT r AS replicate, ('0x' || substr(md5('{seed}|' || r || '|' || j), 1, 13))::BIGINT % n AS unit, count(*) AS weight
    FROM t, range({REPLICATES}) a(r), unnest(range(n)) b(j) GROUP BY ALL
)"""  # noqa: E731


@query(
    sql(
        "scored",
        f""", rows_ AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS unit, u, (n_chars % 13) / 13 AS v, correct FROM scored), {_drawn("rows_", 3)},
m AS (SELECT replicate, 'u' AS method, u AS x, correct, weight FROM rows_ JOIN draws USING (unit) UNION ALL SELECT replicate, 'v', v, correct, weight FROM rows_ JOIN draws USING (unit)),
c AS (SELECT replicate, method, x, sum(weight * correct) AS pos, sum(weight * (1 - correct)) AS neg FROM m GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY replicate, method ORDER BY x) AS below FROM c),
a AS (SELECT replicate, method, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(neg * (below - pos / 2)) / (sum(pos) * sum(neg)) END AS auroc FROM w GROUP BY ALL)
SELECT replicate, {R("max(auroc) FILTER (WHERE method = 'u')")} AS u, {R("max(auroc) FILTER (WHERE method = 'v')")} AS v FROM a GROUP BY replicate""",
    )
)
def exact_resampling(spark, d):
    """AUROC of two scores in each replicate of all rows."""
    rows = I.scored(spark, d).withColumn("v", (F.col("n_chars") % 13) / 13)
    rows = resample.numbered(rows.select("item_id", "u", "v", "correct"), "item_id")
    return resample.auroc_replicates(rows, resample.draws(rows, REPLICATES, 3), ["u", "v"])


@query(
    sql(
        "scored",
        f""", units AS (SELECT topic, row_number() OVER (ORDER BY substr(topic, 4)::BIGINT) - 1 AS unit FROM (SELECT DISTINCT topic FROM scored)), {_drawn("units", 4)}
SELECT replicate, slice, sum(weight)::BIGINT AS n, {R("sum(correct * weight) / sum(weight)")} AS mean
FROM scored JOIN units USING (topic) JOIN draws USING (unit) WHERE correct IS NOT NULL GROUP BY replicate, slice""",
    )
)
def cluster_resampling(spark, d):
    """Accuracy by slice in each replicate of whole topics."""
    rows = I.scored(spark, d)
    units = resample.numbered(rows.select("topic").distinct().withColumn("at", F.substring("topic", 4, 9).cast("long")), "at")
    return resample.mean_replicates(rows.join(units, "topic"), resample.draws(units, REPLICATES, 4), "correct", ["slice"])
