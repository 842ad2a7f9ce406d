"""Queries of evaluation cells, calibration strata, gates and reports, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions import text as T
from accordia.functions.vocabulary import FOREIGN_MARKERS, OPERATIVE_CUES, REPEAL_CUES, UNRESOLVED_LABELS
from accordia.operators import agreement as A
from accordia.operators import bootstrap as B
from accordia.operators import calibration as C
from accordia.operators import cells, fits, lineage, ranking, relations, risk, strata, validity, warrant
from accordia.operators import evaluation as E
from accordia.operators import records as W
from accordia.plans import fit_sql
from accordia.plans import inputs as I
from accordia.plans.inputs import sql
from accordia.plans.queries import FLAGS, HIGH, LOW, ORACLE, PAIRS, QUERIES, R, _ruled, _warrant, query, recursive
from accordia.sources import runs

__all__ = ["ORACLE", "QUERIES"]

SLICES = ["en", "fr", "de", "xx"]
METHODS = ["u", "v", "flat", "wide", "p_true", "none", "lexical"]
OWN, BASELINES = ["v"], ["u", "flat"]

ITEMS = """, items AS (SELECT item_id, ord, slice, topic, toxic, CASE WHEN n_chars % 17 = 0 THEN NULL ELSE correct END AS correct, CASE WHEN slice = 'de' AND n_chars % 5 = 0 THEN NULL ELSE harm END AS harm, w,
    u, (n_chars % 13) / 13 AS v, 0.5 AS flat, CASE WHEN n_chars % 3 = 0 THEN u * 2 ELSE u END AS wide FROM scored)"""


def _items(spark, d) -> DataFrame:
    u, n = F.col("u"), F.col("n_chars")
    return I.scored(spark, d).withColumns({
        "correct": F.when(n % 17 != 0, F.col("correct")), "harm": F.when((F.col("slice") != "de") | (n % 5 != 0), F.col("harm")), "v": (n % 13) / 13, "flat": F.lit(0.5),
        "wide": F.when(n % 3 == 0, u * 2).otherwise(u), "p_true": F.lit(None).cast("double"), "none": F.lit(None).cast("double"),
    })


CELLS = ITEMS + """, l AS (SELECT slice, ord, correct, harm, w, x.m AS method, x.u AS u, 1 - x.u AS p FROM (SELECT slice, ord, correct, harm, w, unnest([{'m': 'u', 'u': u}, {'m': 'v', 'u': v}, {'m': 'flat', 'u': flat}, {'m': 'wide', 'u': wide}]) AS x FROM items) WHERE correct IS NOT NULL),
    base AS (SELECT slice, method, count(*) AS n, sum(correct) AS r, min(u) AS lo, max(u) AS hi, sum((harm IS NULL)::INT) AS nh, bool_and(u BETWEEN 0 AND 1) AS unit, quantile_cont(u, 0.25) AS cut FROM l GROUP BY 1, 2),
    g AS (SELECT slice, method, u, sum(correct) AS a, sum(1 - correct) AS b FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(a) OVER (PARTITION BY slice, method ORDER BY u) AS below FROM g),
    auc AS (SELECT slice, method, sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0) AS auroc FROM c GROUP BY 1, 2),
    up AS (SELECT slice, method, correct, row_number() OVER x AS k, sum(1 - correct) OVER x AS hits FROM l WINDOW x AS (PARTITION BY slice, method ORDER BY u DESC, ord ROWS UNBOUNDED PRECEDING)),
    pr AS (SELECT slice, method, sum(CASE WHEN correct = 0 THEN hits / k END) / nullif(sum(1 - correct), 0) AS auprc FROM up GROUP BY 1, 2),
    rc AS (SELECT slice, method, row_number() OVER x AS k, sum(1 - correct) OVER x / row_number() OVER x AS risk FROM l WINDOW x AS (PARTITION BY slice, method ORDER BY u, ord ROWS UNBOUNDED PRECEDING)),
    au AS (SELECT rc.slice, rc.method, avg(risk) AS aurc, avg(greatest(k - base.r, 0) / k) AS best FROM rc JOIN base USING (slice, method) GROUP BY 1, 2),
    half AS (SELECT base.slice, base.method, x.risk + (y.risk - x.risk) * (h - floor(h)) AS risk FROM (SELECT *, round(greatest(0.5 * n, 1), 9) AS h FROM base) base JOIN rc x ON x.slice = base.slice AND x.method = base.method AND x.k = floor(h) JOIN rc y ON y.slice = base.slice AND y.method = base.method AND y.k = least(ceil(h), n)),
    e5 AS (SELECT slice, method, sum(abs(y - p)) / sum(c) AS e FROM (SELECT slice, method, greatest(ceil(p * 5), 1) AS bin, count(*) AS c, sum(p) AS p, sum(correct) AS y FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2),
    e10 AS (SELECT slice, method, sum(abs(y - p)) / sum(c) AS e FROM (SELECT slice, method, greatest(ceil(p * 10), 1) AS bin, count(*) AS c, sum(p) AS p, sum(correct) AS y FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2),
    br AS (SELECT slice, method, avg((p - correct) * (p - correct)) AS brier FROM l GROUP BY 1, 2),
    hw AS (SELECT slice, method, row_number() OVER x AS k, count(*) OVER (PARTITION BY slice, method) AS n, sum(w * (1 - correct)) OVER x / sum(w) OVER x AS risk FROM l WINDOW x AS (PARTITION BY slice, method ORDER BY p DESC, ord ROWS UNBOUNDED PRECEDING)),
    cw AS (SELECT l.slice, l.method, sum((correct = 0 AND u <= cut)::INT) AS cw FROM l JOIN base USING (slice, method) GROUP BY 1, 2),
    cell0 AS (SELECT s.slice, m.method, coalesce(i.n, 0) AS n_items, coalesce(base.n, 0) AS n, coalesce(base.r, 0) AS r, base.lo, base.hi, base.nh, base.unit, base.cut, auc.auroc, pr.auprc, CASE WHEN (base.n - base.r) / base.n > au.best THEN ((base.n - base.r) / base.n - au.aurc) / ((base.n - base.r) / base.n - au.best) END AS norm,
        half.risk, e5.e AS ace, e10.e AS ece, br.brier, hw.risk AS harm_risk, cw.cw,
        CASE WHEN m.method = 'lexical' THEN 'method_not_implemented' WHEN base.n IS NULL AND m.method = 'p_true' THEN 'logprobs_absent' WHEN base.n IS NULL THEN 'no_items_with_a_score_and_a_label' END AS reason,
        CASE WHEN base.r = 0 OR base.r = base.n THEN 'single_correctness_class' END AS single
        FROM (VALUES ('en'), ('fr'), ('de'), ('xx')) s(slice) CROSS JOIN (VALUES ('u'), ('v'), ('flat'), ('wide'), ('p_true'), ('none'), ('lexical')) m(method) LEFT JOIN (SELECT slice, count(*) AS n FROM items GROUP BY 1) i ON i.slice = s.slice
        LEFT JOIN base ON base.slice = s.slice AND base.method = m.method LEFT JOIN auc ON auc.slice = s.slice AND auc.method = m.method LEFT JOIN pr ON pr.slice = s.slice AND pr.method = m.method LEFT JOIN au ON au.slice = s.slice AND au.method = m.method
        LEFT JOIN half ON half.slice = s.slice AND half.method = m.method LEFT JOIN e5 ON e5.slice = s.slice AND e5.method = m.method LEFT JOIN e10 ON e10.slice = s.slice AND e10.method = m.method LEFT JOIN br ON br.slice = s.slice AND br.method = m.method
        LEFT JOIN hw ON hw.slice = s.slice AND hw.method = m.method AND hw.k = greatest(1, ceil(round(0.5 * hw.n, 9))) LEFT JOIN cw ON cw.slice = s.slice AND cw.method = m.method),
    cell1 AS (SELECT *, coalesce(reason, single, CASE WHEN lo = hi THEN 'constant_score' END) AS rank_reason, coalesce(reason, CASE WHEN NOT unit THEN 'score_outside_unit_interval' END, single) AS unit_reason FROM cell0),
    cell AS (SELECT *, coalesce(unit_reason, CASE WHEN nh > 0 THEN 'harm_class_absent' END) AS harm_reason, coalesce(rank_reason, CASE WHEN norm IS NULL THEN 'degenerate_label_distribution' END) AS aurc_reason FROM cell1)"""


def _when(reason: str, x: str, name: str) -> str:
    return f"CASE WHEN {reason} IS NULL THEN {R(x)} END AS {name}"


RANKED = ", ".join(_when("rank_reason", a, b) for a, b in (("auroc", "auroc"), ("auprc", "auprc"), ("norm", "normalized_aurc"), ("risk", "selective_risk")))
CALIBRATED = ", ".join(_when("unit_reason", a, b) for a, b in (("ace", "ace_5bin"), ("ece", "ece_10bin"), ("brier", "brier")))


@query(sql("scored", CELLS + f""" SELECT slice, method, n_items, n AS n_scored, r::BIGINT AS n_correct, (n - r)::BIGINT AS n_incorrect, {_when('reason', 'lo', 'u_min')}, {_when('reason', 'hi', 'u_max')}, CASE WHEN reason IS NULL AND n >= 4 THEN {R('cut')} END AS cut,
    CASE WHEN reason IS NULL AND n >= 4 THEN cw::BIGINT END AS confident_wrong, {_when('reason', '(n - r) / n', 'base_error_rate')}, {RANKED}, {CALIBRATED}, {_when('harm_reason', 'harm_risk', 'harm_weighted_risk')}, reason, rank_reason, aurc_reason, unit_reason, harm_reason FROM cell"""))
def score_cells(spark, d):
    return cells.score_cells(_items(spark, d), SLICES, METHODS, ("lexical",))


JUDGED = """, said AS (SELECT i.item_id, i.slice, i.correct, t.verdict FROM items i JOIN (SELECT doc_id AS item_id, CASE WHEN k = 1 AND doc_id % 3 = 0 THEN 'unresolved' WHEN k = 2 THEN 'gold' ELSE 'wrong' END AS verdict FROM documents, range(1, 4) r(k)) t USING (item_id)),
    judged AS (SELECT i.slice, count(*) AS n_items, count(correct) AS n_items_resolved, any_value(s.n) AS n_samples, any_value(s.r) AS n_samples_resolved, sum((correct = 1)::INT) AS "right", sum((correct = 0)::INT) AS wrong FROM items i JOIN (SELECT slice, count(*) AS n, sum((verdict <> 'unresolved')::INT) AS r FROM said GROUP BY 1) s ON s.slice = i.slice GROUP BY 1)"""


def _judged(spark, d) -> DataFrame:
    items = _items(spark, d)
    said = I.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.explode(F.array(F.when(F.col("doc_id") % 3 == 0, "unresolved").otherwise("wrong"), F.lit("gold"), F.lit("wrong"))).alias("verdict"))
    return cells.judge_coverage(items, said, ["slice"])


@query(sql("scored", ITEMS + JUDGED + f" SELECT slice, n_items, n_items_resolved, n_samples, n_samples_resolved::BIGINT AS n_samples_resolved, {R('n_items_resolved / n_items')} AS item_coverage, {R('n_samples_resolved / n_samples')} AS sample_coverage FROM judged"))
def judge_coverage(spark, d):
    return _judged(spark, d)


@query(sql("scored", ITEMS + f""", l AS (SELECT ord, correct, x.m AS method, x.u AS u FROM (SELECT ord, correct, unnest([{{'m': 'u', 'u': u}}, {{'m': 'v', 'u': v}}, {{'m': 'flat', 'u': flat}}]) AS x FROM items WHERE slice IN ('en', 'fr')) WHERE correct IS NOT NULL), g AS (SELECT method, u, sum(correct) AS a, sum(1 - correct) AS b FROM l GROUP BY 1, 2),
    c AS (SELECT *, sum(a) OVER (PARTITION BY method ORDER BY u) AS below FROM g), q AS (SELECT method, quantile_cont(u, 0.25) AS cut FROM l GROUP BY 1), w AS (SELECT l.method, sum((correct = 0 AND u <= cut)::INT) AS cw FROM l JOIN q USING (method) GROUP BY 1),
    z AS (SELECT method, sum(a + b)::BIGINT AS n, {R('sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0)')} AS auroc FROM c GROUP BY 1) SELECT m.method, coalesce(n, 0) AS n_scored, auroc, cw::BIGINT AS confident_wrong, CASE WHEN n IS NULL THEN 'no_items_with_a_score_and_a_label' END AS reason FROM (VALUES ('u'), ('v'), ('flat'), ('none')) m(method) LEFT JOIN z USING (method) LEFT JOIN w USING (method)"""))
def pooled_reference(spark, d):
    return cells.pooled_reference(_items(spark, d), ["en", "fr"], ["u", "v", "flat", "none"])


@query(sql("scored", CELLS + JUDGED + """, per AS (SELECT c.slice, max((method = 'v' AND rank_reason IS NULL AND auroc IS NOT NULL)::INT) = 1 AND max((method IN ('u', 'flat') AND rank_reason IS NULL AND auroc IS NOT NULL)::INT) = 1 AS comparable, min(((rank_reason IS NULL AND auroc IS NOT NULL) OR rank_reason IS NOT NULL)::INT) = 1 AS stated FROM cell c WHERE n_items > 0 GROUP BY 1),
    a AS (SELECT count(*) AS n_slices, bool_and("right" > 0 AND wrong > 0) AS both_classes, bool_and(comparable) AS comparison_computable, bool_and(n_items > 0) AS coverage_reported, bool_and(stated) AS undefined_stated FROM per JOIN judged USING (slice)) SELECT *, CASE WHEN both_classes AND comparison_computable AND coverage_reported AND undefined_stated THEN 'MET' ELSE 'NOT_MET' END AS status FROM a"""))
def comparison_gate(spark, d):
    found = cells.score_cells(_items(spark, d), SLICES, METHODS, ("lexical",))
    classes = _items(spark, d).groupBy("slice").agg(F.sum((F.col("correct") == 1).cast("int")).alias("right"), F.sum((F.col("correct") == 0).cast("int")).alias("wrong"))
    return cells.comparison_gate(found, _judged(spark, d).join(classes, "slice"), OWN, BASELINES)


# Calibration strata
DEV = """, parted AS (SELECT item_id, ord, slice AS stratum, topic, correct, harm, w, n_chars, 1 - u AS p, CASE WHEN n_chars % 19 = 0 THEN NULL ELSE u END AS x, (n_chars % 7) / 7 AS s, (('0x' || substr(sha256('7|' || item_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) < 0.6 AS dev FROM scored)"""


def _parted(spark, d) -> DataFrame:
    n = F.col("n_chars")
    rows = I.scored(spark, d).withColumns({"stratum": F.col("slice"), "x": F.when(n % 19 != 0, F.col("u")), "s": (n % 7) / 7, "dev": risk.in_first_part(7, F.col("item_id"), 0.6)})
    return risk.folds(rows, F.concat_ws("|", "slice", "topic"), 5, 5)


@query(sql("scored", DEV + """, a AS (SELECT stratum, count(*) AS n_development, count(x) AS n_scored, coalesce(sum(correct) FILTER (WHERE x IS NOT NULL), 0)::BIGINT AS n_correct FROM parted WHERE dev GROUP BY 1),
    b AS (SELECT *, CASE WHEN n_scored = 0 THEN 'no_scored_records' WHEN n_correct = 0 OR n_correct = n_scored THEN 'single_class_in_development' WHEN n_scored < 10 THEN 'insufficient_development_records' ELSE 'fitted' END AS status FROM a) SELECT *, CASE WHEN status = 'fitted' THEN CASE WHEN n_scored >= 40 THEN 'isotonic' ELSE 'platt' END END AS method FROM b"""))
def fit_status(spark, d):
    return strata.fit_status(_parted(spark, d).where("dev").select("stratum", "x", "correct"))


@query()
def fit_strata(spark, d):
    return strata.fit_strata(_parted(spark, d).where("dev").select("stratum", "fold", "item_id", "x", "correct"))[0]


@query(
    recursive(
        sql(
            "scored",
            DEV
            + f""", rows_ AS (SELECT stratum, x, correct FROM parted WHERE dev AND x IS NOT NULL),
state AS (SELECT stratum, count(*) AS n, sum(correct) AS r FROM rows_ GROUP BY stratum),
fitted_ AS (SELECT stratum, CASE WHEN n >= 40 THEN 'isotonic' ELSE 'platt' END AS method FROM state WHERE r > 0 AND r < n AND n >= 10),
{fit_sql.isotonic("rows_", "stratum")}, {fit_sql.tagged(fit_sql.platt("rows_", "stratum"), "p")}, {fit_sql.STRETCHES.format(by="stratum")}
SELECT item_id, p.stratum, {R("p.x")} AS x, CASE WHEN method IS NULL THEN 'undefined_stratum_not_calibrated' WHEN p.x IS NULL THEN 'no_score' ELSE 'calibrated' END AS calibration_status,
       CASE WHEN p.x IS NOT NULL THEN CASE method WHEN 'isotonic' THEN {R(fit_sql.BETWEEN.format(x="p.x"))} WHEN 'platt' THEN {R("1 / (1 + exp(-(slope * least(1.0, greatest(0.0, p.x)) + intercept)))")} END END AS p
FROM parted p LEFT JOIN fitted_ USING (stratum) LEFT JOIN lines USING (stratum) LEFT JOIN stretches t ON t.stratum = p.stratum AND p.x >= low AND p.x < high""",
        )
    )
)
def attach_probabilities(spark, d):
    rows = _parted(spark, d)
    return strata.attach_probabilities(rows.select("item_id", "stratum", "x"), rows.where("dev").select("stratum", "x", "correct"))


@query(sql("scored", DEV + f""", c AS (SELECT stratum, p, row_number() OVER (PARTITION BY stratum ORDER BY p DESC, ord) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM parted WHERE dev), t AS (SELECT stratum, max(n) AS n_calibration, max(p) FILTER (WHERE k = ceil(round((n + 1) * 0.8, 9))) AS threshold FROM c GROUP BY 1),
    h AS (SELECT p.stratum, any_value(n_calibration) AS n_calibration, any_value(threshold) AS threshold, count(*) AS n, sum((p >= threshold)::INT)::BIGINT AS covered FROM parted p LEFT JOIN t ON t.stratum = p.stratum WHERE NOT dev GROUP BY 1)
    SELECT stratum, n_calibration, {R('threshold')} AS threshold, n, covered, {R('covered / n')} AS coverage, {R('1.96 * sqrt(0.16 / n)')} AS tolerance, CASE WHEN n_calibration IS NULL THEN 'no_development_calibration_set' WHEN threshold IS NULL THEN 'undefined' ELSE 'defined' END AS threshold_status, covered / n >= 0.8 - 1.96 * sqrt(0.16 / n) AS within_tolerance FROM h"""))
def coverage_report(spark, d):
    rows = _parted(spark, d)
    return strata.coverage_report(rows.where("not dev"), rows.where("dev"))


HALF = "SELECT stratum, max(risk) FILTER (WHERE k = greatest(1, ceil(round(0.5 * n, 9)))) AS risk FROM (SELECT stratum, row_number() OVER x AS k, count(*) OVER (PARTITION BY stratum) AS n, sum(w * (1 - correct)) OVER x / sum(w) OVER x AS risk FROM h WINDOW x AS (PARTITION BY stratum ORDER BY {} DESC, ord ROWS UNBOUNDED PRECEDING)) GROUP BY 1"
EVALUATED = DEV + f""", h0 AS (SELECT *, CASE WHEN n_chars % 23 <> 0 THEN p END AS q FROM parted WHERE NOT dev), h AS (SELECT * REPLACE (q AS p) FROM h0 WHERE q IS NOT NULL),
    n AS (SELECT stratum, count(*) AS n_holdout, count(q) AS n_scored, coalesce(sum(correct) FILTER (WHERE q IS NOT NULL), 0) AS r FROM h0 GROUP BY 1),
    e5 AS (SELECT stratum, sum(abs(y - p)) / sum(c) AS e FROM (SELECT stratum, greatest(ceil(p * 5), 1) AS bin, count(*) AS c, sum(p) AS p, sum(correct) AS y FROM h GROUP BY 1, 2) GROUP BY 1),
    e10 AS (SELECT stratum, sum(abs(y - p)) / sum(c) AS e FROM (SELECT stratum, greatest(ceil(p * 10), 1) AS bin, count(*) AS c, sum(p) AS p, sum(correct) AS y FROM h GROUP BY 1, 2) GROUP BY 1),
    br AS (SELECT stratum, avg((p - correct) * (p - correct)) AS brier, avg(-CASE WHEN correct = 1 THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END) AS ll FROM h GROUP BY 1),
    r1 AS ({HALF.format('p')}), r2 AS ({HALF.format('(1 - s)')}), r3 AS ({HALF.format('(1 - u0)')}),
    c AS (SELECT stratum, p, row_number() OVER (PARTITION BY stratum ORDER BY p DESC, ord) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM parted WHERE dev), t AS (SELECT stratum, max(p) FILTER (WHERE k = ceil(round((n + 1) * 0.8, 9))) AS threshold FROM c GROUP BY 1),
    cv AS (SELECT h.stratum, count(*) AS n, sum((p >= threshold)::INT) AS covered, CASE WHEN any_value(t.stratum) IS NULL THEN 'no_development_calibration_set' WHEN any_value(threshold) IS NULL THEN 'undefined' ELSE 'defined' END AS ts FROM h LEFT JOIN t ON t.stratum = h.stratum GROUP BY 1),
    act AS (SELECT stratum, CASE WHEN (1 - p) * w <= 0.15 THEN 'answer' WHEN (1 - p) * w <= 0.35 THEN 'verify' ELSE 'abstain' END AS action FROM h), ac AS (SELECT stratum, sum((action = 'answer')::INT)::BIGINT AS answer, sum((action = 'verify')::INT)::BIGINT AS verify, sum((action = 'abstain')::INT)::BIGINT AS abstain FROM act GROUP BY 1)"""
EVALUATED = EVALUATED.replace("(1 - u0)", "(1 - coalesce(x, 1))")


def _evaluated(spark, d) -> DataFrame:
    rows = _parted(spark, d)
    held = rows.where("not dev").withColumns({"p": F.when(F.col("n_chars") % 23 != 0, F.col("p")), "raw": 1 - F.col("x"), "sample_only": 1 - F.col("s")})
    return strata.evaluate(held, rows.where("dev"))


@query(sql("scored", EVALUATED + f""" SELECT n.stratum, n_holdout, n_scored, r::BIGINT AS n_correct, CASE WHEN n_scored = 0 THEN 'not_evaluable_no_calibrated_scores' WHEN r = 0 OR r = n_scored THEN 'not_evaluable_single_class_holdout' ELSE 'evaluated' END AS status, r > 0 AND r < n_scored AS both_classes, {R('e5.e')} AS ace_5bin, {R('e10.e')} AS ece_10bin, {R('brier')} AS brier, {R('ll')} AS log_loss,
    {R('r1.risk')} AS risk, {R('r3.risk')} AS risk_raw, {R('r2.risk')} AS risk_sample_only, ts AS threshold_status, {R('covered / cv.n')} AS coverage, covered / cv.n >= 0.8 - 1.96 * sqrt(0.16 / cv.n) AS within_tolerance, answer, verify, abstain
    FROM n LEFT JOIN e5 USING (stratum) LEFT JOIN e10 USING (stratum) LEFT JOIN br USING (stratum) LEFT JOIN r1 USING (stratum) LEFT JOIN r2 USING (stratum) LEFT JOIN r3 USING (stratum) LEFT JOIN cv USING (stratum) LEFT JOIN ac USING (stratum)"""))
def evaluate_strata(spark, d):
    return _evaluated(spark, d)


@query()
def calibration_gate(spark, d):
    fitted = strata.fit_strata(_parted(spark, d).where("dev").select("stratum", "fold", "item_id", "x", "correct"))[0]
    scored = _parted(spark, d)
    maps = scored.where("dev").select("stratum", "x", "correct")
    found = lineage.blind(lambda rows: strata.attach_probabilities(rows, maps), scored.where("not dev").drop("p"), ["correct"], ["p", "calibration_status"])
    return strata.gate(fitted, _evaluated(spark, d), found)


@query()
def calibration_candidates(spark, d):
    """The four candidates within each stratum and over all together."""
    rows = _parted(spark, d).withColumn("x", 1 - F.col("x"))
    pooled = strata.candidates(rows, 5, []).withColumn("stratum", F.lit("pooled"))
    own = strata.candidates(rows.withColumnRenamed("stratum", "slice_"), 5, ["slice_"]).withColumnRenamed("slice_", "stratum")
    return own.unionByName(pooled)


# Reports and gates
@query(sql("scored", ITEMS + f""", l AS (SELECT topic, ord, correct, x.m AS method, x.u AS u FROM (SELECT topic, ord, correct, unnest([{{'m': 'u', 'u': u}}, {{'m': 'v', 'u': v}}]) AS x FROM items WHERE toxic = 0) WHERE correct IS NOT NULL), g AS (SELECT topic, method, u, sum(correct) AS a, sum(1 - correct) AS b FROM l GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(a) OVER (PARTITION BY topic, method ORDER BY u) AS below FROM g), auc AS (SELECT topic, method, sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0) AS auroc FROM c GROUP BY 1, 2),
    up AS (SELECT topic, method, correct, row_number() OVER x AS k, sum(1 - correct) OVER x AS hits FROM l WINDOW x AS (PARTITION BY topic, method ORDER BY u DESC, ord ROWS UNBOUNDED PRECEDING)), pr AS (SELECT topic, method, sum(CASE WHEN correct = 0 THEN hits / k END) / nullif(sum(1 - correct), 0) AS auprc FROM up GROUP BY 1, 2),
    base AS (SELECT topic, method, count(*) AS n, sum(correct) AS r, avg(correct) AS accuracy, avg(u) FILTER (WHERE correct = 1) AS mr, avg(u) FILTER (WHERE correct = 0) AS mw FROM l GROUP BY 1, 2),
    rc AS (SELECT topic, method, row_number() OVER x AS k, sum(1 - correct) OVER x / row_number() OVER x AS risk FROM l WINDOW x AS (PARTITION BY topic, method ORDER BY u, ord ROWS UNBOUNDED PRECEDING)), au AS (SELECT rc.topic, rc.method, avg(risk) AS aurc, avg(greatest(k - r, 0) / k) AS best FROM rc JOIN base USING (topic, method) GROUP BY 1, 2)
    SELECT topic, method, n, {R('accuracy')} AS accuracy, {R('auroc')} AS auroc, {R('auprc')} AS auprc, {R('aurc')} AS aurc, CASE WHEN (n - r) / n > best THEN {R('((n - r) / n - aurc) / ((n - r) / n - best)')} END AS norm, {R('mr')} AS mean_right, {R('mw')} AS mean_wrong, {R('mw - mr')} AS gap FROM base JOIN auc USING (topic, method) JOIN pr USING (topic, method) JOIN au USING (topic, method)"""))
def slice_methods(spark, d):
    return cells.slice_methods(_items(spark, d).withColumn("resolved", 1 - F.col("toxic")), "topic", ["u", "v"])


@query(sql("samples statutes counts modal warrant", FLAGS + f" SELECT item_id % 4 AS slice, correct, count(*) AS n, sum((len(flags) > 0)::INT)::BIGINT AS fires, {R('avg((len(flags) > 0)::INT)')} AS fire_rate, {R('avg(a - a * t * j * (1 - k))')} AS cm_mean, sum((a * t * j * (1 - k) IS NULL)::INT)::BIGINT AS cm_undefined FROM fl GROUP BY 1, 2"))
def group_report(spark, d):
    w = _warrant(spark, d)
    return cells.group_report(w.withColumns({"slice": F.col("item_id") % 4, "cm": F.col("a") - F.col("a") * F.col("t") * F.col("j") * (1 - F.col("k"))}), ["slice", "correct"])


@query(sql("samples statutes counts modal warrant", FLAGS + f""", x AS (SELECT *, round(a - a * t * j * (1 - k), 9) AS u FROM fl), y AS (SELECT * FROM x WHERE u IS NOT NULL AND n_clusters <= 8), g AS (SELECT u, sum(correct) AS p, sum(1 - correct) AS q FROM y GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY u) AS b FROM g)
    SELECT (SELECT count(*) FROM x WHERE n_clusters <= 8) AS population, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_correct, {R('sum(q * (b - p / 2)) / nullif(sum(p) * sum(q), 0)')} AS auroc FROM c"""))
def separation(spark, d):
    """Common mode against correctness over the items of few distinct answers, undefined ones counted apart."""
    w = _warrant(spark, d).where("n_clusters <= 8").withColumn("u", F.round(F.col("a") - F.col("a") * F.col("t") * F.col("j") * (1 - F.col("k")), 9))
    one = ranking.auroc(w.withColumn("all", F.lit(1)), ["all"])
    return w.agg(F.count("*").alias("population")).join(F.broadcast(one.drop("all")), F.lit(True), "left")


@query()
def separation_gate(spark, d):
    """The gate over common mode: its AUROC and interval, what pinning validity takes away, and alarms by correctness."""
    w = _warrant(spark, d).withColumn("u", F.round(F.col("a") - F.col("a") * F.col("t") * F.col("j") * (1 - F.col("k")), 9))
    scored = ranking.scored(w).select("u", "correct")
    bounds = B.intervals(B.replicates(scored, B.auroc, ["u", "correct"], 200), []).select("low")
    pins = ranking.auroc(w.select("correct", F.explode(F.array(F.struct(F.lit("none").alias("pin"), F.col("u").alias("c")), F.struct(F.lit("t").alias("pin"), F.round(F.col("a") - F.col("a") * F.col("j") * (1 - F.col("k")), 9).alias("c")))).alias("x")).select("correct", "x.pin", F.col("x.c").alias("u")), ["pin"])
    at = lambda name: F.max(F.when(F.col("pin") == name, F.col("auroc")))
    full = pins.agg(at("none").alias("auroc"), (at("none") - at("t")).alias("drop"))
    fired = (F.size("flags") > 0).cast("double")
    alarms = w.agg(F.avg(F.when(F.col("correct") == 1, fired)).alias("alarm_right"), F.avg(F.when(F.col("correct") == 0, fired)).alias("alarm_wrong"))
    row = full.join(F.broadcast(bounds), F.lit(True), "left").join(F.broadcast(alarms), F.lit(True))
    one, two, three, verdict = cells.separation_gate(F.col("auroc"), F.col("low"), F.col("auroc"), F.col("drop"), F.col("alarm_right"), F.col("alarm_wrong"))
    return row.select("auroc", "low", "drop", "alarm_right", "alarm_wrong", one.alias("separation"), two.alias("attribution"), three.alias("honesty"), verdict.alias("verdict"))


UNANIMOUS = f"""SELECT slice, count(*) AS n, sum(r) AS r, sum(r) / count(*) AS accuracy, 1 - sum(r) / count(*) AS p FROM (SELECT pro.item_id % 2 AS slice, (avg(correct) >= 0.5)::INT AS r FROM pro JOIN samples USING (item_id) WHERE n_keys <= 8 GROUP BY pro.item_id) GROUP BY 1"""


@query(sql("samples counts pro", f""", un AS ({UNANIMOUS}), q AS (SELECT slice, n, accuracy, p, {LOW} AS low, {HIGH} AS high FROM un), z AS (SELECT a.n AS n, a.accuracy AS acc, a.p AS p1, a.low AS l1, a.high AS h1, b.p AS p0, b.low AS l0, b.high AS h0 FROM q a, q b WHERE a.slice = 1 AND b.slice = 0),
    y AS (SELECT *, coalesce(acc < 0.5 AND n >= 10 AND acc < 0.5, false) AS ceiling_ok, coalesce(p1 - p0 >= 0.1 AND (l1 > h0 OR l0 > h1), false) AS contrast_ok FROM z) SELECT n, {R('acc')} AS accuracy, {R('p1 - p0')} AS contrast, ceiling_ok, contrast_ok, ceiling_ok AND contrast_ok AS pass FROM y"""))
def premise_gate(spark, d):
    """The premise's gate for odd items against even ones, where no AUROC is defined."""
    s = I.samples(spark, d)
    few = A.profile(s).where("n_keys <= 8").join(s.groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("r")), "item_id")
    one = few.groupBy((F.col("item_id") % 2).alias("slice")).agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    low, high = A.wilson(F.col("n") - F.col("r"), F.col("n"))
    one = one.select("slice", "n", (F.col("r") / F.col("n")).alias("acc"), (1 - F.col("r") / F.col("n")).alias("p"), low.alias("l"), high.alias("h"))
    at = lambda s, c: F.max(F.when(F.col("slice") == s, F.col(c)))
    z = one.agg(*[at(s, c).alias(f"{c}{s}") for s in (0, 1) for c in ("n", "acc", "p", "l", "h")])
    ceiling, contrast, passed = cells.premise_gate(F.lit(None).cast("double"), F.col("acc1"), F.col("n1"), F.col("acc1"), F.lit(0), (F.col("p1"), F.col("l1"), F.col("h1")), (F.col("p0"), F.col("l0"), F.col("h0")))
    return z.select(F.col("n1").alias("n"), F.col("acc1").alias("accuracy"), (F.col("p1") - F.col("p0")).alias("contrast"), ceiling.alias("ceiling_ok"), contrast.alias("contrast_ok"), passed.alias("pass"))


@query(sql("samples", f""", i AS (SELECT item_id % 2 AS slice, item_id, avg(correct) AS f, sum((verdict <> 'unresolved')::INT) AS r, count(*) AS c FROM samples GROUP BY 1, 2), a AS (SELECT sum(r) / sum(c) AS coverage, avg(f) FILTER (WHERE slice = 1) AS target, avg(f) FILTER (WHERE slice = 0) AS control FROM i)
    SELECT {R('coverage')} AS coverage, {R('target')} AS target, {R('control')} AS control, CASE WHEN coverage < 0.85 OR control < 0.2 THEN 'FAIL' WHEN target > 0.8 OR control - target < 0.1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM a"""))
def pilot_verdict(spark, d):
    s = I.samples(spark, d).withColumn("slice", F.when(F.col("item_id") % 2 == 1, "odd").otherwise("even"))
    return cells.pilot_verdict(s, UNRESOLVED_LABELS, "odd", "even")


@query(sql("samples", f"SELECT {R('avg((verdict <> ' + chr(39) + 'unresolved' + chr(39) + ')::INT)')} AS resolved_share, avg((verdict <> 'unresolved')::INT) < 0.7 AS warn FROM samples"))
def resolved_warning(spark, d):
    return cells.resolved_warning(I.samples(spark, d), UNRESOLVED_LABELS)


@query(sql("scored", ", c AS (SELECT item_id, CASE WHEN toxic = 0 THEN p END AS p FROM scored WHERE n_chars % 4 <> 0)" + f" SELECT slice, count(*) AS n, count(c.item_id) AS joined, count(c.p) AS calibrated, count(*) - count(c.item_id) AS missing, {R('count(c.p) / count(*)')} AS calibrated_share FROM scored LEFT JOIN c ON c.item_id = scored.item_id GROUP BY 1"))
def joined_coverage(spark, d):
    s = I.scored(spark, d)
    return cells.joined_coverage(s.drop("p"), s.where("n_chars % 4 <> 0").select("item_id", F.when(F.col("toxic") == 0, F.col("p")).alias("p")))


@query("""WITH c AS (SELECT doc_id AS item_id, (('0x' || substr(sha256('7|' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) < 0.3 AS part FROM documents), s AS (SELECT item_id, CASE WHEN item_id % 50 = 0 THEN NOT part ELSE part END AS part FROM c WHERE item_id % 30 <> 1)
    (SELECT *, 'stored' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c)) UNION ALL (SELECT *, 'computed' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s))""")
def split_mismatches(spark, d):
    computed = I.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), risk.in_first_part(7, F.col("doc_id"), 0.3).alias("part"))
    stored = computed.where("item_id % 30 <> 1").withColumn("part", F.when(F.col("item_id") % 50 == 0, ~F.col("part")).otherwise(F.col("part")))
    return cells.split_mismatches(stored, computed)


@query(sql("scored", f""", l AS (SELECT x.m AS method, x.u AS u, (slice = 'en')::INT AS c FROM (SELECT slice, unnest([{{'m': 'u', 'u': u}}, {{'m': 'v', 'u': (n_chars % 13) / 13}}]) AS x FROM scored)), g AS (SELECT method, u, sum(c) AS a, sum(1 - c) AS b FROM l GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER (PARTITION BY method ORDER BY u) AS below FROM g)
    SELECT method, sum(a + b)::BIGINT AS n, sum(a)::BIGINT AS n_correct, {R('sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0)')} AS auroc FROM c GROUP BY 1"""))
def confound(spark, d):
    items = I.scored(spark, d).withColumn("v", (F.col("n_chars") % 13) / 13)
    return E.confound(ranking.unpivot(items, ["slice", "ord"], ["u", "v"]), "en")


@query(f"SELECT event_type, {R('avg(value)')} AS mean, CASE WHEN min(value) IS NULL OR max(value) IS NULL THEN 'not_computed' WHEN quantile_cont(value, 0.95) < 150 THEN 'stable_pass' WHEN quantile_cont(value, 0.05) > 150 THEN 'stable_fail' ELSE 'indeterminate' END AS status FROM events GROUP BY 1")
def gate_stability(spark, d):
    e = I.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.05)).alias("low"), F.percentile("value", F.lit(0.95)).alias("high"))
    return e.select("event_type", "mean", C.gate_stability(F.col("low"), F.col("high"), F.lit(150.0)).alias("status"))


@query(sql("scored", f"SELECT item_id, {R('1 / (1 + exp(-(2.5 * p - 0.75)))')} AS p, CASE WHEN count(*) OVER s < 100 OR max(p) OVER s - min(p) OVER s < 0.15 THEN 'platt' ELSE 'isotonic' END AS method FROM scored WINDOW s AS (PARTITION BY slice)"))
def platt_predict(spark, d):
    """A given Platt map, and the kind of map that each stratum's size and spread ask for."""
    s = I.scored(spark, d)
    spread = s.groupBy("slice").agg(F.count("*").alias("n"), (F.max("p") - F.min("p")).alias("spread"))
    return s.join(spread, "slice").select("item_id", C.platt_predict(F.col("p"), F.lit(2.5), F.lit(-0.75)).alias("p"), C.map_method(F.col("n"), F.col("spread")).alias("method"))


@query("SELECT ceil((length(system) + length(question)) / 4)::BIGINT AS tokens, count(*) AS n FROM (SELECT 'Answer with one provision.' AS system, text AS question FROM benchmark) GROUP BY 1")
def prompt_tokens(spark, d):
    return I.table(spark, d, "benchmark").select(E.prompt_tokens(F.lit("Answer with one provision."), F.col("text")).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CUED = "SELECT item_id, 'it was ' || cue || ' in ' || text AS s FROM benchmark, (SELECT unnest(list_concat({}, ['nothing'])) AS cue)"


@query(f"""WITH a AS ({CUED.format(f'list_concat({_quoted(REPEAL_CUES)}, {_quoted(OPERATIVE_CUES)}, {_quoted(FOREIGN_MARKERS)})')}), b AS (SELECT item_id, s, len(list_filter({_quoted(REPEAL_CUES)}, lambda c: contains(lower(s), c))) > 0 AS old, len(list_filter({_quoted(OPERATIVE_CUES)}, lambda c: contains(lower(s), c))) > 0 AS live, list_filter({_quoted(FOREIGN_MARKERS)}, lambda m: contains(lower(s), m))[1] AS marker FROM a)
    SELECT old, live, marker, count(*) AS n FROM b GROUP BY ALL""")
def every_cue(spark, d):
    """All cues of all three lists, each within a benchmark text, by what is found."""
    every = [*REPEAL_CUES, *OPERATIVE_CUES, *FOREIGN_MARKERS, "nothing"]
    rows = I.table(spark, d, "benchmark").withColumn("cue", F.explode(F.array(*map(F.lit, every)))).select(F.concat(F.lit("it was "), "cue", F.lit(" in "), "text").alias("s"))
    return rows.select(T.is_superseded(F.col("s")).alias("old"), T.is_operative(F.col("s")).alias("live"), T.first_marker(F.col("s")).alias("marker")).groupBy("old", "live", "marker").agg(F.count("*").alias("n"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN x IS NULL THEN 'missing' WHEN isnan(x) OR NOT x BETWEEN 0 AND 1 THEN 'invalid' WHEN x = 1 THEN 'silent' WHEN x = 0 THEN 'fired' ELSE 'partial' END AS state FROM (SELECT CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.25 ELSE value END AS x FROM events)) GROUP BY 1")
def detector_states(spark, d):
    k = F.col("event_id") % 6
    x = F.when(k == 0, None).when(k == 1, F.lit(float("nan"))).when(k == 2, 1.0).when(k == 3, 0.0).when(k == 4, 0.25).otherwise(F.col("value"))
    return I.table(spark, d, "events").select(E.detector_state(x).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM events WHERE value > 50) AS errors, count(*) AS n FROM events WHERE value <= 50 OR value IS NULL")
def usable_records(spark, d):
    rows, errors = runs.usable(I.table(spark, d, "events").withColumn("error", F.when(F.col("value") > 50, "too large")))
    return errors.join(F.broadcast(rows.agg(F.count("*").alias("n"))), F.lit(True))


@query(sql("scored", "SELECT item_id, slice FROM scored WHERE slice IN ('en', 'fr') ORDER BY ord LIMIT 50"))
def select_items(spark, d):
    return runs.select_items(I.scored(spark, d), ["en", "fr"], 50).select("item_id", "slice")


@query(sql("samples", """, c AS (SELECT item_id, list(round(logprob, 1) ORDER BY pos) AS v FROM samples WHERE pos < 2 GROUP BY 1) SELECT min(item_id) AS item_id FROM c GROUP BY v"""))
def first_series(spark, d):
    """Of items whose first two values are equal when rounded, the first."""
    curves = I.samples(spark, d).where("pos < 2").groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "logprob"))), lambda x: x["logprob"].cast("double")).alias("values"))
    return runs.first_by_rounded(curves, "item_id", 1).select("item_id")


@query(sql("scored", """, t AS (SELECT round(0.05 * k, 2)::DOUBLE AS tau FROM range(1, 20) r(k)), q AS (SELECT tau, sum((p >= tau AND correct = 1)::INT) AS tp, sum((p >= tau AND correct = 0)::INT) AS fp, sum((p < tau AND correct = 1)::INT) AS fn FROM scored, t GROUP BY 1), z AS (SELECT tau, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) AS f1 FROM q)""" + f" SELECT {R('arg_min(tau, (-f1, tau))')} AS tau, {R('max(f1)')} AS f1 FROM z"))
def chosen_threshold(spark, d):
    rows = I.scored(spark, d).select(F.col("p").alias("score"), F.col("correct").alias("gold"))
    return relations.best_threshold(relations.threshold_sweep(rows, [round(0.05 * k, 2) for k in range(1, 20)]))


DIRECTED = """, dir AS (SELECT item_id, a, b, ((a * 7 + b * 3 + item_id) % 11) / 10 AS score, CASE WHEN (a + 2 * b) % 3 = 0 THEN 'SAME_PROVISION' ELSE 'CONTRADICTORY' END AS label FROM (SELECT item_id, r.x AS a, q.y AS b FROM (SELECT DISTINCT item_id FROM samples) i, range(0, 4) r(x), range(0, 4) q(y)) WHERE a <> b)"""


@query(sql("samples", DIRECTED + f""", g AS (SELECT item_id, least(a, b)::INT AS i, greatest(a, b)::INT AS j, round(score, 12) AS s, label FROM dir), z AS (SELECT item_id, i, j, avg(s) AS m, arg_min(label, (-s, label)) AS label FROM g GROUP BY 1, 2, 3) SELECT item_id, i, j, {R('m')} AS score, label FROM z"""))
def merged_directions(spark, d):
    """Directed scores and labels of pairs, brought to one of each by the mean and by the stronger direction."""
    i = I.samples(spark, d).select("item_id").distinct()
    four = F.array(*[F.lit(x) for x in range(4)])
    both = i.withColumn("i", F.explode(four)).withColumn("j", F.explode(four)).where("i <> j")
    both = both.withColumns({"score": ((F.col("i") * 7 + F.col("j") * 3 + F.col("item_id")) % 11) / 10, "label": F.when((F.col("i") + 2 * F.col("j")) % 3 == 0, "SAME_PROVISION").otherwise("CONTRADICTORY")})
    return relations.symmetric(both).join(relations.stronger_label(both), ["item_id", "i", "j"])


@query(sql("samples", PAIRS + f""", k AS (SELECT item_id, CASE WHEN ki = 'NONE' OR kj = 'NONE' THEN 'AMBIGUOUS' WHEN ki = kj THEN 'SAME_PROVISION' WHEN split_part(ki, ' ', 2) = split_part(kj, ' ', 2) THEN 'LEGALLY_EQUIVALENT' WHEN split_part(ki, ' ', 1) <> split_part(kj, ' ', 1) THEN 'CONTRADICTORY' ELSE 'DIFFERENT_PROVISION' END AS gold,
    CASE WHEN ki = kj AND ki <> 'NONE' THEN 'SAME_PROVISION' WHEN ki <> 'NONE' AND kj <> 'NONE' AND split_part(ki, ' ', 2) = split_part(kj, ' ', 2) THEN 'LEGALLY_EQUIVALENT' WHEN ki = 'NONE' OR kj = 'NONE' THEN 'AMBIGUOUS' ELSE 'DIFFERENT_PROVISION' END AS said FROM lex) SELECT gold, said, count(*) AS n FROM k GROUP BY 1, 2"""))
def exact_key_baseline(spark, d):
    """Confusion of the classifier that merges equal and declared-successor keys only, against the rules."""
    number = lambda c: F.substring_index(c, " ", -1)
    link = F.when((F.col("key_i") != "NONE") & (F.col("key_j") != "NONE") & (number("key_i") == number("key_j")), "successor_of")
    return relations.confusion(_ruled(spark, d).withColumn("said", relations.exact_key_label(F.col("key_i"), F.col("key_j"), link)), "label", "said")


@query(sql("samples counts pro", f""", b AS (SELECT item_id, CASE WHEN key = 'NONE' THEN key ELSE split_part(key, ' ', 2) END AS label, count(*) AS c FROM samples GROUP BY 1, 2), t AS (SELECT item_id, sum(c) AS m, count(*) AS n_clusters, max(c) / sum(c) AS top_share, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy, string_agg(c, ',' ORDER BY c DESC) AS counts FROM b GROUP BY 1)
    SELECT item_id, t.n_clusters, {R('t.top_share')} AS top_share, {R('t.entropy')} AS entropy, (t.n_clusters = 1)::INT AS all_same, t.counts, {R('t.top_share - pro.top_share')} AS d_agreement, {R('t.entropy - pro.entropy')} AS d_entropy, t.n_clusters - pro.n_keys AS d_n_clusters, (pro.n_keys = 1 AND t.n_clusters <> 1)::INT AS collision_lost FROM t JOIN pro USING (item_id)"""))
def merge_effect(spark, d):
    """Statistics of clusters of provisions by number alone, and what they change against exact keys."""
    s = I.samples(spark, d).withColumn("label", F.when(F.col("key") == "NONE", F.col("key")).otherwise(F.split("key", " ")[1]))
    return relations.merge_effect(relations.typed_stats(s), A.profile(s))


@query(sql("part_statutes", 'SELECT count(*) AS n_rows, count(DISTINCT statute) AS n_keys, count(*) FILTER (WHERE "end" IS NULL) AS open_rows, min(statute) AS first_key, max(statute) AS last_key FROM part_statutes'))
def statute_index(spark, d):
    return validity.index_stats(I.part_statutes(spark, d))


@query(sql("samples statutes", """, x AS (SELECT item_id, pos, CASE item_id % 3 WHEN 0 THEN TIMESTAMP '1990-01-01' WHEN 1 THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '1998-01-01' END AS day, key FROM samples WHERE key <> 'NONE') SELECT item_id % 3 AS slice, state, count(*) AS n FROM (SELECT x.item_id, CASE WHEN s.statute IS NULL THEN 'unknown' WHEN s."begin" <= day AND (s."end" IS NULL OR day < s."end") THEN 'in_force' ELSE 'not_in_force' END AS state
    FROM x LEFT JOIN (SELECT split_part(statute, '(', 1) AS b, min(statute) AS statute, min("begin") AS "begin", min("end") AS "end" FROM statutes GROUP BY 1) s ON x.key = s.b) GROUP BY 1, 2"""))
def context_census(spark, d):
    """Assertions by slice and state on the day of the slice's era."""
    eras = {"0": "1990-01-01", "1": "2001-01-01"}
    s = I.samples(spark, d).withColumn("slice", (F.col("item_id") % 3).cast("string"))
    return validity.state_census(s, I.statutes(spark, d), validity.era_day(F.col("slice"), eras, "1998-01-01")).withColumn("slice", F.col("slice").cast("long"))


@query(sql("intervals", """SELECT DISTINCT key, ord, rule FROM (SELECT key, ord, CASE WHEN ord % 9 = 0 THEN 'missing section' END AS a, CASE WHEN ord % 10 = 0 THEN 'unknown act' END AS b, CASE WHEN "end" IS NOT NULL AND "end" <= "begin" THEN 'empty' END AS c FROM intervals), LATERAL (SELECT unnest([a, b, c]) AS rule) WHERE rule IS NOT NULL"""))
def statute_violations(spark, d):
    rows = I.intervals(spark, d).withColumns({"act": F.when(F.col("ord") % 10 == 0, "XYZ").otherwise("IPC"), "section": F.when(F.col("ord") % 9 != 0, "1")})
    return validity.field_violations(rows, ("IPC", "BNS"))


@query(sql("scored", ", m AS (SELECT slice AS mode, CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars > 2000 THEN 'long' ELSE 'none' END AS reason FROM scored)" + f" SELECT mode, reason, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY mode)')} AS share FROM m GROUP BY 1, 2"))
def mode_census(spark, d):
    rows = I.scored(spark, d).select(F.col("slice").alias("mode"), F.when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") > 2000, "long").otherwise("none").alias("reason"))
    return C.census(rows, ["mode"], "reason")


@query(
    recursive(
        sql(
            "samples",
            f""", i AS (SELECT item_id % 6 AS topic, item_id, sum(correct) AS r, count(*) AS c FROM samples GROUP BY 1, 2),
a AS (SELECT topic, count(*) AS n, sum((r * 2 >= c)::INT) AS hits, sum(r) / sum(c) AS sr FROM i GROUP BY 1), q AS (SELECT *, hits / n AS p FROM a),
y AS (SELECT topic, n AS items, hits::BIGINT AS hits, sr, {LOW} AS low, {HIGH} AS high FROM q), {fit_sql.needed("y", "topic", "low", 20)}
SELECT topic, items, hits, {R("sr")} AS sample_rate, {R("low")} AS low, {R("high")} AS high, needed FROM y LEFT JOIN needed_ USING (topic)""",
        )
    )
)
def items_needed(spark, d):
    """Items that each yield's lower bound asks for, so that 20 are right with 95 % confidence."""
    found = E.yields(I.samples(spark, d).withColumn("topic", F.col("item_id") % 6), ["topic"])
    return fits.items_needed_by(found, "low", 20)


@query(sql("scored", f""", q AS (SELECT item_id, slice, u, (n_chars % 13) / 13 AS v, correct FROM scored WHERE n_chars % 17 <> 0), l AS (SELECT slice, correct, x.m AS model, x.u AS u FROM (SELECT slice, correct, unnest([{{'m': 'one', 'u': u}}, {{'m': 'two', 'u': v}}]) AS x FROM q)), a AS (SELECT 'pooled' AS slice, * EXCLUDE (slice) FROM l UNION ALL SELECT * FROM l),
    g AS (SELECT slice, model, u, sum(correct) AS a, sum(1 - correct) AS b FROM a GROUP BY 1, 2, 3), c AS (SELECT *, sum(a) OVER (PARTITION BY slice, model ORDER BY u) AS below FROM g), z AS (SELECT slice, model, sum(a + b)::BIGINT AS n, sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0) AS auroc FROM c GROUP BY 1, 2)
    SELECT x.slice, x.n, {R('x.auroc')} AS first, {R('y.auroc')} AS second, {R('x.auroc - y.auroc')} AS difference FROM z x JOIN z y ON x.slice = y.slice WHERE x.model = 'one' AND y.model = 'two'"""))
def within_slice(spark, d):
    """Two models on the items that both score, within each slice and over all together."""
    s = I.scored(spark, d).withColumns({"v": F.when(F.col("n_chars") % 17 != 0, (F.col("n_chars") % 13) / 13)})
    return ranking.within_slice(s, "u", "v")


# Records, pairs and banks
@query(sql("samples counts pro", f""", t AS (SELECT item_id, lower(text) AS k, count(*) AS c, min(pos) AS first, avg(correct) AS fc, avg(resolved) AS fr, arg_min(verdict, pos) AS v FROM samples GROUP BY 1, 2), a AS (SELECT item_id, sum(c) AS n, count(*) AS nu, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS e, 1 - max(c) / sum(c) AS ag FROM t GROUP BY 1),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, first) AS r FROM t) WHERE r = 1), l AS (SELECT item_id, string_agg(key, '|' ORDER BY pos) AS keys, string_agg(verdict, '|' ORDER BY pos) AS vs, avg(correct) AS fc, avg((resolved = 0)::INT) AS fu, avg(repealed) AS rs, 1 - exp(avg(logprob)) AS pt FROM samples GROUP BY 1)
    SELECT a.item_id, a.n::BIGINT AS n_samples, {R('a.e')} AS disc_se, {R('a.ag')} AS agreement, nu AS n_unique, (nu = 1)::INT AS all_same, {R('pro.entropy')} AS prov_se, {R('1 - pro.top_share')} AS prov_agreement, pro.n_keys AS prov_n_unique, pro.majority AS prov_majority, (pro.n_keys = 1)::INT AS prov_all_same,
    m.c AS majority_cluster_size, {R('m.fc')} AS majority_frac_correct, (m.fc >= 0.5)::INT AS majority_correct, (m.fr >= 0.5)::INT AS majority_resolved, m.v AS majority_verdict, l.keys AS asserted_keys, l.vs AS sample_verdicts, {R('l.fc')} AS frac_correct, {R('l.fu')} AS frac_unresolved, {R('l.rs')} AS repealed_code_share, {R('l.pt')} AS p_true
    FROM a JOIN pro USING (item_id) JOIN m USING (item_id) JOIN l USING (item_id)"""))
def records(spark, d):
    return W.records(I.samples(spark, d))


@query(sql("samples counts", "SELECT item_id, coalesce(arg_min(key, (-c, key)) FILTER (WHERE key <> 'NONE'), 'NONE') AS canonical FROM counts GROUP BY 1"))
def canonical_key(spark, d):
    return W.canonical_key(I.samples(spark, d))


@query("""SELECT k, count(*) AS n FROM (SELECT CASE WHEN a IS NULL AND p IS NULL THEN 'NONE' WHEN a = 'FOREIGN' THEN 'FOREIGN:' || coalesce(p, '?') WHEN p IS NULL THEN coalesce(a, 'UNKNOWN_ACT') || ' (no section)' ELSE coalesce(a, 'UNKNOWN_ACT') || ' ' || p END AS k
    FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'IPC' WHEN 1 THEN 'FOREIGN' END AS a, CASE WHEN event_id % 4 < 2 THEN (event_id % 7)::VARCHAR END AS p FROM events)) GROUP BY 1""")
def assertion_keys(spark, d):
    k = F.col("event_id")
    act, provision = F.when(k % 3 == 0, "IPC").when(k % 3 == 1, "FOREIGN"), F.when(k % 4 < 2, (k % 7).cast("string"))
    return I.table(spark, d, "events").select(W.assertion_key(act, provision).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


OBSERVED = """, q AS (SELECT a.item_id, a.pos AS i, b.pos AS j, a.key AS ki, b.key AS kj, a.text AS ti, b.text AS tj, row_number() OVER (PARTITION BY a.item_id ORDER BY a.pos, b.pos) AS r FROM samples a JOIN samples b ON a.item_id = b.item_id AND a.pos < b.pos WHERE a.key <> 'NONE' AND b.key <> 'NONE'),
    o AS (SELECT *, CASE WHEN ki = kj THEN 'SAME_PROVISION' WHEN split_part(ki, ' ', 2) = split_part(kj, ' ', 2) THEN 'LEGALLY_EQUIVALENT' WHEN (i + j) % 5 = 0 THEN 'SAME_PROVISION' ELSE 'DIFFERENT_PROVISION' END AS label, CASE WHEN ki <> kj AND split_part(ki, ' ', 2) = split_part(kj, ' ', 2) AND i % 2 = 0 THEN 'successor_of' END AS link FROM q WHERE r <= 6),
    x AS (SELECT *, CASE WHEN label = 'SAME_PROVISION' AND ki <> kj THEN 'same of different keys' WHEN label = 'LEGALLY_EQUIVALENT' AND link IS NULL THEN 'equivalent without a link' END AS rule FROM o)"""


def _observed(spark, d):
    number = lambda c: F.substring_index(c, " ", -1)
    near = (F.col("key_i") != F.col("key_j")) & (number("key_i") == number("key_j"))
    label = F.when(F.col("key_i") == F.col("key_j"), "SAME_PROVISION").when(near, "LEGALLY_EQUIVALENT").when((F.col("i") + F.col("j")) % 5 == 0, "SAME_PROVISION").otherwise("DIFFERENT_PROVISION")
    return W.observed_pairs(I.samples(spark, d), label, F.when(near & (F.col("i") % 2 == 0), "successor_of"))


@query(sql("samples", OBSERVED + r""", h AS (SELECT *, substr(sha256(trim(regexp_replace(ti, '\s+', ' ', 'g'))), 1, 16) AS a, substr(sha256(trim(regexp_replace(tj, '\s+', ' ', 'g'))), 1, 16) AS b FROM x WHERE rule IS NULL), p AS (SELECT *, 'pb1-' || substr(sha256(least(a, b) || '|' || greatest(a, b)), 1, 16) AS pair, coalesce(link, '') AS l FROM h)
    SELECT pair, l AS link, label, key_i, key_j, item_id, i, j, hash_i, hash_j FROM (SELECT pair, l, label, ki AS key_i, kj AS key_j, item_id, i, j, a AS hash_i, b AS hash_j, row_number() OVER (PARTITION BY pair, l ORDER BY item_id, i, j) AS r FROM p) WHERE r = 1"""))
def observed_pairs(spark, d):
    return _observed(spark, d)[0].select("pair", "link", "label", "key_i", "key_j", "item_id", "i", "j", "hash_i", "hash_j")


@query(sql("samples", OBSERVED + " SELECT rule, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY 1"))
def pair_rejects(spark, d):
    return _observed(spark, d)[1]


@query(sql("samples", PAIRS + " SELECT item_id, count(*) FILTER (WHERE NOT (ki = kj AND ki <> 'NONE')) AS open, count(*) AS n FROM lex GROUP BY 1"))
def unforced_pairs(spark, d):
    p = relations.pairs(I.samples(spark, d))
    return p.groupBy("item_id").agg(F.count("*").alias("n")).join(W.unforced(p).groupBy("item_id").agg(F.count("*").alias("open")), "item_id", "left").fillna(0, ["open"]).select("item_id", "open", "n")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN '1' ELSE o_orderkey::VARCHAR END AS key, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'L9' ELSE 'L1' END AS slice, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'q' END AS question, CASE WHEN o_orderkey % 7 <> 0 THEN 'IPC' END AS act, CASE WHEN o_orderkey % 8 <> 0 THEN '3' END AS prov, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 10 = 0 END AS verified, CASE WHEN o_orderkey % 11 <> 0 THEN 's' END AS source FROM orders),
    r AS (SELECT key, unnest([CASE WHEN slice IS NULL THEN 'missing slice' END, CASE WHEN trim(question) = '' THEN 'missing question' END, CASE WHEN slice = 'L9' THEN 'unknown slice' END, CASE WHEN act IS NULL THEN 'missing gold.act' END, CASE WHEN prov IS NULL THEN 'missing gold.provision' END, CASE WHEN verified IS NULL THEN 'no verified flag' END, CASE WHEN verified THEN 'verified' END, CASE WHEN source IS NULL THEN 'missing source' END]) AS rule FROM c)
    SELECT key, rule FROM r WHERE rule IS NOT NULL UNION ALL SELECT key, 'duplicate' FROM c GROUP BY 1 HAVING count(*) > 1""")
def candidate_violations(spark, d):
    k = F.col("o_orderkey")
    items = I.table(spark, d, "orders").select(
        F.when(k % 40 == 0, "1").otherwise(k.cast("string")).alias("item_id"), F.when(k % 5 == 1, "L9").when(k % 5 != 0, "L1").alias("slice"), F.when(k % 6 == 0, " ").otherwise("q").alias("question"), F.when(k % 7 != 0, "IPC").alias("gold_act"),
        F.when(k % 8 != 0, "3").alias("gold_provision"), F.when(k % 9 != 0, k % 10 == 0).alias("verified"), F.when(k % 11 != 0, "s").alias("source"),
    )
    return W.candidate_violations(items, ["item_id", "slice", "question"], ("L1", "L7"))


LINKS = """, l AS (
    SELECT 'IPC ' || p_partkey AS f, 'BNS ' || p_partkey || CASE WHEN p_partkey % 50 = 7 THEN '9999' WHEN p_partkey % 2 = 0 THEN '(1)' ELSE '' END AS t FROM part
    UNION ALL SELECT 'BNS ' || p_partkey, 'IPC ' || p_partkey FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 1
),
s AS (SELECT statute AS key, "begin", "end" FROM part_statutes UNION ALL SELECT 'IPC ' || p_partkey, TIMESTAMP '1862-01-01', NULL FROM part WHERE p_partkey % 20 = 2)"""


@query(
    sql(
        "part_statutes",
        LINKS
        + """
SELECT key, 'duplicate' AS rule FROM s GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT f, 'unknown link' FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = t)
UNION ALL SELECT f, 'one-sided link' FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.f = l.t AND m.t = l.f)
UNION ALL SELECT split_part(key, '(', 1), 'different windows' FROM s GROUP BY 1 HAVING count(DISTINCT ("begin", coalesce("end", TIMESTAMP '9999-01-01'))) > 1""",
    )
)
def link_violations(spark, d):
    """A statute a part: a part of them twice, links to unknown ones, and links that few answer."""
    k = F.col("p_partkey")
    parts = I.table(spark, d, "part")
    name = lambda act, more="": F.concat(F.lit(act), k, F.lit(more) if isinstance(more, str) else more)
    end = F.when(k % 50 == 7, "9999").when(k % 2 == 0, "(1)").otherwise("")
    links = parts.select(name("IPC ").alias("from"), name("BNS ", end).alias("to")).unionByName(parts.where((k % 3 == 1) & (k % 2 == 1)).select(name("BNS ").alias("from"), name("IPC ").alias("to")))
    twice = parts.where(k % 20 == 2).select(name("ipc  ").alias("statute"), F.lit("1862-01-01").cast("timestamp").alias("begin"), F.lit(None).cast("timestamp").alias("end"))
    return W.link_violations(I.part_statutes(spark, d).drop("k").unionByName(twice), links)


@query("""WITH p AS (SELECT DISTINCT 'IPC ' || p_size AS o, 'BNS ' || p_size // 2 AS n FROM part) SELECT DISTINCT * FROM (SELECT o AS statute, TIMESTAMP '1862-01-01' AS "begin", TIMESTAMP '2024-07-01' AS "end" FROM p UNION ALL SELECT n, TIMESTAMP '2024-07-01', NULL FROM p)""")
def statute_rows(spark, d):
    size = F.col("p_size")
    cross = I.table(spark, d, "part").select(F.concat(F.lit("IPC "), size.cast("string")).alias("old"), F.concat(F.lit("BNS "), F.floor(size / 2).cast("string")).alias("new"))
    return W.statute_rows(cross, "2024-07-01", "1862-01-01")


@query("""WITH e AS (SELECT n_name AS topic, r_name AS frame, c AS context, sha256('7|' || n_name || '|' || r_name || '|' || c) AS h FROM nation, region, (VALUES ('home'), ('work'), ('road')) v(c)), f AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS k FROM e QUALIFY row_number() OVER (ORDER BY h) <= 120)
    SELECT s || '-' || topic || '-' || lpad(k::VARCHAR, 3, '0') AS item_id, topic || '-' || lpad(k::VARCHAR, 3, '0') AS pair_id, s AS slice, topic, frame, context FROM f, (VALUES ('L7'), ('L1')) v(s)""")
def question_bank(spark, d):
    topics, frames = I.table(spark, d, "nation").select(F.col("n_name").alias("topic")), I.table(spark, d, "region").select(F.col("r_name").alias("frame"))
    return W.question_bank(topics, frames, spark.createDataFrame([("home",), ("work",), ("road",)], "context string"), 120, 7, ("L7", "L1"))


@query(sql("scored", "SELECT item_id, slice FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY sha256('11|' || item_id), item_id) AS r FROM scored) WHERE r <= 12"))
def pilot_selection(spark, d):
    return W.pilot_selection(I.scored(spark, d), 12, 11).select("item_id", "slice")


@query(f"SELECT (count(*) * 10)::BIGINT AS calls, (sum(ceil(length(text) / 4)) * 10)::BIGINT AS prompt_tokens, (count(*) * 10 * 220)::BIGINT AS answer_tokens, {R('(sum(ceil(length(text) / 4)) * 10 * 0.4 + count(*) * 10 * 220 * 1.6) / 1e6')} AS cost FROM benchmark")
def pilot_cost(spark, d):
    tokens = I.table(spark, d, "benchmark").select(E.prompt_tokens(F.lit(""), F.col("text")).alias("t"))
    return W.pilot_cost(tokens, "t", 10, 220, 0.4, 1.6)


@query(sql("scored", """, i AS (SELECT CASE WHEN topic = 'src1' THEN 'none' WHEN toxic = 1 THEN 'wrong' ELSE slice END AS slice, CASE WHEN topic = 'src1' OR n_chars % 17 = 0 THEN NULL WHEN toxic = 1 THEN 0 ELSE correct END AS correct FROM scored), a AS (SELECT slice, count(*) AS n, count(correct) AS resolved, coalesce(sum(correct), 0)::BIGINT AS "right" FROM i GROUP BY 1)
    SELECT *, resolved - "right" AS wrong, CASE WHEN resolved = 0 THEN 'unresolved' WHEN "right" >= 1 AND resolved - "right" >= 1 THEN 'both_classes' WHEN "right" < 1 THEN 'too_few_right' ELSE 'too_few_wrong' END AS state FROM a"""))
def slice_outcomes(spark, d):
    hidden, toxic = F.col("topic") == "src1", F.col("toxic") == 1
    items = I.scored(spark, d).select(F.when(hidden, "none").when(toxic, "wrong").otherwise(F.col("slice")).alias("slice"), F.when(~hidden & (F.col("n_chars") % 17 != 0), F.when(toxic, 0).otherwise(F.col("correct"))).alias("correct"))
    return W.slice_outcomes(items)


@query(sql("part_statutes", " SELECT statute, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE k % 3 = 0 END AS verified FROM part_statutes"))
def applied_checklist(spark, d):
    """Answers to a checklist of all statutes: yes, no, one that is neither, and none; one is of an unknown statute."""
    rows, k = I.part_statutes(spark, d), F.col("k")
    said = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "NO").when(k % 4 == 2, "perhaps")
    answers = rows.select(F.lower("statute").alias("key"), said.alias("verified")).unionByName(spark.createDataFrame([("XYZ 1", "yes")], "key string, verified string"))
    return W.apply_checklist(rows.withColumn("verified", k % 3 == 0), answers).select("statute", "verified")


@query("SELECT md5(text) AS h FROM (SELECT DISTINCT t AS text FROM (SELECT trim(text, ' ') AS t FROM benchmark UNION ALL SELECT trim(text, ' ') FROM documents) WHERE t <> '')")
def training_texts(spark, d):
    return W.training_texts(I.table(spark, d, "benchmark"), I.table(spark, d, "documents")).select(F.md5("text").alias("h"))


@query(sql("samples statutes counts modal warrant", f"SELECT item_id, modal_key, {R('a')} AS a, {R('t')} AS t, {R('j')} AS j, {R('k')} AS k FROM warrant"))
def record_round_trip(spark, d):
    """Warrant factors written as JSON, unknown ones as null, and read again."""
    rows = _warrant(spark, d).select("item_id", "modal_key", "a", "t", "j", "k")
    return W.from_json(W.to_json(rows, ["modal_key", "a", "t", "j", "k"]), "modal_key string, a double, t double, j double, k double")


@query(sql("samples", f""", v AS (SELECT item_id % 4 AS slice, verdict || '-' || (pos % 12) AS label, count(*) AS n FROM samples GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY n DESC, label) AS place, n / sum(n) OVER (PARTITION BY slice) AS share FROM v) SELECT slice, label, n, place, {R('share')} AS share FROM r WHERE place <= 8"""))
def top_labels(spark, d):
    """The eight most frequent verdicts of each slice."""
    s = I.samples(spark, d).select((F.col("item_id") % 4).alias("slice"), F.concat_ws("-", "verdict", (F.col("pos") % 12).cast("string")).alias("verdict"))
    return E.top_labels(E.verdict_census(s, ["slice"], UNRESOLVED_LABELS), ["slice"], 8).select("slice", "label", "n", "place", "share")


# Detection by clusters, contexts and further reports
NUMBERED = "CASE WHEN key = 'NONE' THEN 0 ELSE split_part(key, ' ', 2)::INT END"


def _numbered(spark, d) -> DataFrame:
    """Samples in clusters of one section number, whatever the act."""
    return I.samples(spark, d).withColumn("label", F.when(F.col("key") == "NONE", 0).otherwise(F.split("key", " ")[F.when(F.col("key") == "NONE", 0).otherwise(1)].try_cast("int")))


DETECTED = f""", ks AS (SELECT item_id, {NUMBERED} AS label, key, count(*) AS c, min(pos) AS first FROM samples GROUP BY 1, 2, 3), cl AS (SELECT item_id, label, sum(c) AS size, arg_min(key, (-c, key)) AS kn, arg_min(key, (-c, first)) AS kp FROM ks GROUP BY 1, 2),
    mo AS (SELECT item_id, sum(size) AS m, count(*) AS n_clusters, arg_min(struct_pack(l := label, s := size, k := kn), (-size, label)) AS b FROM cl GROUP BY 1), me AS (SELECT ks.* FROM ks JOIN mo ON ks.item_id = mo.item_id AND ks.label = mo.b.l),
    st AS (SELECT split_part(statute, '(', 1) AS k, min("begin") AS "begin", min("end") AS "end" FROM statutes GROUP BY 1), tt AS (SELECT item_id, sum(c * ("begin" <= TIMESTAMP '1998-01-01' AND ("end" IS NULL OR TIMESTAMP '1998-01-01' < "end"))::INT) / sum(c) AS t FROM me JOIN st ON st.k = me.key GROUP BY 1),
    jj AS (SELECT item_id, 1.0 AS j FROM me WHERE key <> 'NONE' GROUP BY 1), sl AS (SELECT 'IPC ' || i AS x, 'BNS ' || i + 1 AS y FROM range(1, 4) t(i) UNION ALL SELECT 'BNS ' || i + 1, 'IPC ' || i FROM range(1, 4) t(i)),
    kk AS (SELECT cl.item_id, sum(size) AS g FROM cl JOIN mo ON mo.item_id = cl.item_id JOIN sl ON sl.x = mo.b.k AND sl.y = kp WHERE kp <> mo.b.k AND kp <> 'NONE' GROUP BY 1),
    de AS (SELECT mo.item_id, mo.b.k AS modal_key, mo.b.s AS modal_size, n_clusters, mo.b.s / m AS a, t, j, coalesce(g, 0) / m AS k FROM mo LEFT JOIN tt USING (item_id) LEFT JOIN jj USING (item_id) LEFT JOIN kk USING (item_id))"""


def _detected(spark, d) -> DataFrame:
    links = spark.sql("SELECT concat('IPC ', id) AS `from`, concat('BNS ', id + 1) AS `to` FROM range(1, 4)")
    return warrant.detect(_numbered(spark, d), I.statutes(spark, d), links, F.lit("1998-01-01").cast("timestamp"))


@query(sql("samples statutes", DETECTED + f""" SELECT item_id, modal_key, modal_size::BIGINT AS modal_size, n_clusters, {R('a')} AS a, {R('t')} AS t, {R('j')} AS j, {R('k')} AS k, 'rule' AS contradiction_source,
    array_to_string(list_filter([CASE WHEN t IS NULL THEN 'unresolvable' END, CASE WHEN t < 1 THEN 'stale' END, CASE WHEN j < 1 THEN 'foreign' END, CASE WHEN k > 0 THEN 'contradiction' END], lambda x: x IS NOT NULL), ',') AS flags, {R('a * t * j * (1 - k)')} AS w, {R('a - a * t * j * (1 - k)')} AS cm FROM de"""))
def detect_clusters(spark, d):
    return _detected(spark, d).withColumn("flags", F.array_join("flags", ","))


@query(sql("samples statutes", DETECTED + f""", x AS (SELECT de.*, (avg(correct) >= 0.5)::INT AS correct, (t IS NULL OR t < 1 OR j < 1 OR k > 0) AS fired FROM de JOIN samples USING (item_id) GROUP BY ALL) SELECT count(*) AS n, {R('avg(fired::INT)')} AS fire_rate, {R('coalesce(avg(fired::INT) FILTER (WHERE correct = 1), 0)')} AS alarm_right, {R('coalesce(avg(fired::INT) FILTER (WHERE correct = 0), 0)')} AS alarm_wrong FROM x WHERE n_clusters > 8"""))
def base_rates(spark, d):
    right = I.samples(spark, d).groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct"))
    return warrant.base_rates(_detected(spark, d).withColumn("unanimous", (F.col("n_clusters") <= 8).cast("int")).join(right, "item_id"))


@query(r"""SELECT md5('[A] ' || trim(regexp_replace(a.text, '\s+', ' ', 'g')) || ' [/A] [B] ' || trim(regexp_replace(b.text, '\s+', ' ', 'g')) || ' [/B] [CTX] as_of=' || CASE WHEN a.item_id % 3 = 0 THEN 'unknown' ELSE '2024-01-01' END || '; jurisdiction=IN; crosswalk=' || CASE WHEN a.item_id % 2 = 0 THEN 'successor_of' ELSE 'none' END || ' [/CTX]') AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def serialized_pairs(spark, d):
    b = I.table(spark, d, "benchmark").select("item_id", "text")
    met = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    k = F.col("item_id")
    return met.select(F.md5(T.serialized_pair(F.col("text"), F.col("other"), F.when(k % 3 != 0, "2024-01-01"), F.lit(None).cast("string"), F.when(k % 2 == 0, "successor_of").otherwise(""))).alias("h"))


@query(sql("samples statutes", """, f AS (SELECT item_id, key, min(pos) AS first FROM samples GROUP BY 1, 2), i AS (SELECT DISTINCT item_id, 'IPC ' || item_id % 6 + 1 AS gold, CASE WHEN item_id % 2 = 0 THEN 'BNS ' || item_id % 6 + 1 END AS trap FROM samples),
    e AS (SELECT item_id, key, min(first) AS first, max(said) AS said FROM (SELECT item_id, key, first, 1 AS said FROM f WHERE key <> 'NONE' UNION ALL SELECT item_id, gold, 1000000, 0 FROM i UNION ALL SELECT item_id, trap, 1000001, 0 FROM i WHERE trap IS NOT NULL) GROUP BY 1, 2), st AS (SELECT split_part(statute, '(', 1) AS k, min("begin") AS "begin", min("end") AS "end" FROM statutes GROUP BY 1),
    s AS (SELECT e.*, st.k, CASE WHEN st.k IS NULL THEN 'unknown' WHEN "begin" <= TIMESTAMP '1998-01-01' AND ("end" IS NULL OR TIMESTAMP '1998-01-01' < "end") THEN 'true' ELSE 'false' END AS state FROM e LEFT JOIN st ON st.k = e.key),
    l AS (SELECT item_id, string_agg(key || '=' || state, ',' ORDER BY first) AS validity, sum(said)::BIGINT AS assertions, sum(CASE WHEN k IS NOT NULL THEN said ELSE 0 END)::BIGINT AS known FROM s GROUP BY 1), x AS (SELECT item_id, sum((key = 'NONE')::INT)::BIGINT AS excluded FROM f GROUP BY 1)
    SELECT i.item_id, validity, assertions, known, excluded, CASE WHEN trap IS NOT NULL AND item_id % 6 + 1 < 4 THEN 'successor_of' END AS relation FROM i JOIN l USING (item_id) JOIN x USING (item_id)"""))
def item_context(spark, d):
    k = F.col("item_id")
    items = I.samples(spark, d).select("item_id").distinct().select("item_id", F.concat(F.lit("IPC "), (k % 6 + 1).cast("string")).alias("gold"), F.when(k % 2 == 0, F.concat(F.lit("BNS "), (k % 6 + 1).cast("string"))).alias("trap"))
    links = I.statute_links(spark).withColumn("type", F.lit("successor_of"))
    return validity.item_context(items, I.samples(spark, d), I.statutes(spark, d), links, F.lit("1998-01-01").cast("timestamp"))


@query(sql("scored", f""", h AS (SELECT ord, correct, u, (n_chars % 13) / 13 AS v FROM scored WHERE item_id % 3 = 0), l AS (SELECT ord, correct, x.m AS method, x.u AS u FROM (SELECT ord, correct, unnest([{{'m': 'u', 'u': u}}, {{'m': 'v', 'u': v}}]) AS x FROM h)), g AS (SELECT method, u, sum(correct) AS a, sum(1 - correct) AS b FROM l GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER (PARTITION BY method ORDER BY u) AS below FROM g),
    auc AS (SELECT method, sum(a + b)::BIGINT AS n, sum(a)::BIGINT AS r, sum(b * (below - a / 2)) / nullif(sum(a) * sum(b), 0) AS auroc FROM c GROUP BY 1), up AS (SELECT method, correct, row_number() OVER x AS k, sum(1 - correct) OVER x AS hits FROM l WINDOW x AS (PARTITION BY method ORDER BY u DESC, ord ROWS UNBOUNDED PRECEDING)), pr AS (SELECT method, sum(CASE WHEN correct = 0 THEN hits / k END) / nullif(sum(1 - correct), 0) AS auprc FROM up GROUP BY 1),
    rc AS (SELECT method, row_number() OVER x AS k, sum(1 - correct) OVER x / row_number() OVER x AS risk FROM l WINDOW x AS (PARTITION BY method ORDER BY u, ord ROWS UNBOUNDED PRECEDING)), au AS (SELECT rc.method, avg(risk) AS aurc, avg(greatest(k - r, 0) / k) AS best FROM rc JOIN auc USING (method) GROUP BY 1),
    half AS (SELECT q.method, x.risk + (y.risk - x.risk) * (h - floor(h)) AS risk FROM (SELECT *, round(greatest(0.5 * n, 1), 9) AS h FROM auc) q JOIN rc x ON x.method = q.method AND x.k = floor(h) JOIN rc y ON y.method = q.method AND y.k = least(ceil(h), n))
    SELECT method, n, r AS "right", n - r AS wrong, {R('auroc')} AS auroc, {R('auprc')} AS auprc, CASE WHEN (n - r) / n > best THEN {R('((n - r) / n - aurc) / ((n - r) / n - best)')} END AS norm, {R('half.risk')} AS risk_at_half FROM auc JOIN pr USING (method) JOIN au USING (method) JOIN half USING (method)"""))
def holdout_metrics(spark, d):
    rows = I.scored(spark, d).where("item_id % 3 = 0").withColumn("v", (F.col("n_chars") % 13) / 13)
    return cells.holdout_metrics(rows, ["u", "v"])


@query()
def metric_intervals(spark, d):
    """Calibration error and Brier score with intervals by item and by topic, and exact and Wilson bounds of coverage."""
    rows = I.scored(spark, d).select("topic", F.round("p", 3).alias("p"), "correct")
    every = None
    for metric, f in (("ace_5bin", B.calibration_error(5)), ("brier", B.brier)):
        for unit in (None, "topic"):
            one = B.replicates(rows, f, ["p", "correct"], 100, unit=unit).withColumns({"metric": F.lit(metric), "unit": F.lit(unit or "item")})
            every = one if every is None else every.unionByName(one)
    out = C.replicate_summary(every, ["metric", "unit"])
    covered = fits.exact_lower_bounds(rows.agg(F.sum((F.col("p") >= 0.5).cast("long")).alias("hits"), F.count("*").alias("n")), "hits", "n")
    low, high = A.wilson(F.col("hits"), F.col("n"))
    bounds = covered.select(F.lit("coverage").alias("metric"), F.lit("item").alias("unit"), F.col("n").cast("int").alias("n"), (F.col("hits") / F.col("n")).alias("mean"), F.lit(None).cast("double").alias("se"), F.greatest(low, F.lit(0.0)).alias("low"), high.alias("high"))
    return out.unionByName(bounds)


@query(sql("scored", f"SELECT slice, toxic, count(*) AS n, sum((u * 0.5 + (n_chars % 10) / 20 >= 0.4)::INT)::BIGINT AS merged, {R('avg((u * 0.5 + (n_chars % 10) / 20 >= 0.4)::INT)')} AS merge_rate FROM scored GROUP BY 1, 2"))
def merge_rates(spark, d):
    probed = I.scored(spark, d).withColumns({"one": F.col("u") * 0.5, "two": (F.col("n_chars") % 10) / 20})
    return cells.merge_rates(probed, ["one", "two"], 0.4, ["slice", "toxic"])


@query(sql("samples counts pro", f""", b AS (SELECT item_id, count(DISTINCT CASE WHEN key = 'NONE' THEN key ELSE split_part(key, ' ', 2) END) AS nt, (avg(correct) >= 0.5)::INT AS correct FROM samples GROUP BY 1), x AS (SELECT item_id % 3 AS slice, correct, n_keys <= 8 AS e, nt <= 5 AS t FROM b JOIN pro USING (item_id))
    SELECT slice, count(*) AS n, sum(e::INT)::BIGINT AS exact_n, sum(t::INT)::BIGINT AS typed_n, {R('avg(correct) FILTER (WHERE e)')} AS exact_accuracy, {R('avg(correct) FILTER (WHERE t)')} AS typed_accuracy, sum((e AND NOT t)::INT)::BIGINT AS "left", sum((e AND NOT t AND correct = 0)::INT)::BIGINT AS rescued FROM x GROUP BY 1"""))
def cluster_comparison(spark, d):
    s = _numbered(spark, d)
    typed = relations.typed_stats(s).select("item_id", (F.col("n_clusters") <= 5).cast("int").alias("typed_all_same"))
    right = s.groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct"))
    exact = A.profile(s).select("item_id", (F.col("item_id") % 3).alias("slice"), (F.col("n_keys") <= 8).cast("int").alias("exact_all_same"))
    return cells.cluster_comparison(exact.join(typed, "item_id").join(right, "item_id"))


@query(sql("samples", f""", i AS (SELECT item_id, item_id % 5 AS topic, row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id) AS r FROM (SELECT DISTINCT item_id FROM samples WHERE item_id % 2 = 1)), s AS (SELECT topic, item_id, sum(correct) AS r, count(*) AS c FROM samples JOIN (SELECT item_id, topic FROM i WHERE r <= 8) USING (item_id) GROUP BY 1, 2), a AS (SELECT topic, count(*) AS n, sum((r * 2 >= c)::INT) AS hits, sum(r) / sum(c) AS sr FROM s GROUP BY 1), q AS (SELECT *, hits / n AS p FROM a)
    SELECT topic, n AS items, hits::BIGINT AS hits, {R('sr')} AS sample_rate, {R(LOW)} AS low, {R(HIGH)} AS high FROM q"""))
def screen_flow(spark, d):
    s = I.samples(spark, d)
    k = F.col("item_id")
    items = s.select("item_id").distinct().select("item_id", F.when(k % 2 == 1, "L7").otherwise("L1").alias("slice"), (k % 5).alias("topic"), F.lit("q").alias("question"), F.lit("IPC").alias("gold_act"), F.lit("1").alias("gold_provision"), F.lit(False).alias("verified"), F.lit("s").alias("source"))
    return cells.screen(items, s, W.candidate_violations(items, ["item_id", "slice", "question"], ("L1", "L7")), "L7", 40, 5)


@query(sql("samples", f""", i AS (SELECT item_id, item_id % 3 AS slice, CASE WHEN item_id % 4 = 1 THEN NULL ELSE (avg(correct) >= 0.5)::INT END AS correct, CASE WHEN item_id % 10 = 3 THEN 'down' END AS error FROM samples GROUP BY 1), a AS (SELECT slice, count(*) AS n, count(correct) AS resolved, coalesce(sum(correct), 0)::BIGINT AS "right" FROM i WHERE error IS NULL GROUP BY 1),
    e AS (SELECT slice, count(error) AS errors FROM i GROUP BY 1), s AS (SELECT slice, count(*) AS n_samples, sum((verdict <> 'unresolved')::INT)::BIGINT AS n_samples_resolved FROM samples JOIN i USING (item_id) WHERE error IS NULL GROUP BY 1)
    SELECT slice, n, resolved, "right", resolved - "right" AS wrong, CASE WHEN resolved = 0 THEN 'unresolved' WHEN "right" >= 1 AND resolved - "right" >= 1 THEN 'both_classes' WHEN "right" < 1 THEN 'too_few_right' ELSE 'too_few_wrong' END AS state, errors, n_samples, n_samples_resolved, {R('resolved / n')} AS item_coverage, {R('n_samples_resolved / n_samples')} AS sample_coverage FROM a JOIN e USING (slice) JOIN s USING (slice)"""))
def pilot_report(spark, d):
    s = I.samples(spark, d)
    k = F.col("item_id")
    items = s.groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("c")).select("item_id", (k % 3).alias("slice"), F.when(k % 4 != 1, F.col("c")).alias("correct"), F.when(k % 10 == 3, "down").alias("error"))
    return cells.pilot_report(items, s, UNRESOLVED_LABELS)
