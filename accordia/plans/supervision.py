"""Queries of candidate pairs, generated answers and other supervision data, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordia.functions import mentions
from accordia.operators import candidates as K
from accordia.operators import mock, revision
from accordia.plans import inputs as I
from accordia.plans.inputs import sql
from accordia.plans.queries import R, query

QUOTAS = {"S1": 300, "S2": 300, "S3": 200, "S4": 400, "S5": 200, "S6": 200, "S7": 200}


def provisions(spark, d) -> DataFrame:
    """A topic a part: its offence is named after a benchmark item, of which many parts share one, so that wordings repeat."""
    b = I.table(spark, d, "benchmark").select(F.col("item_id").alias("_b"), F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0)).alias("label"))
    p, n, k = I.table(spark, d, "part"), F.col("_n"), F.col("p_partkey")
    even, number = k % 2 == 0, F.floor(k / 2) + 1
    topics = p.crossJoin(F.broadcast(b.agg(F.count("*").alias("_n")))).join(b, k % n == F.col("_b"))
    return topics.select(
        k.alias("topic"), "label", F.lower("p_type").alias("punishment"), F.when(even, "IPC").otherwise("CRPC").alias("act"), number.cast("string").alias("number"),
        F.when(even, "BNS").otherwise("BNSS").alias("new_act"), (number + F.col("p_size")).cast("string").alias("new_number"),
        F.when(even, "IPC").otherwise("CRPC").alias("near_act"), (number + 1).cast("string").alias("near_number"),
    )


PROVISIONS = """
provisions AS (
    SELECT p_partkey AS topic, lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) AS label, lower(p_type) AS punishment,
           CASE WHEN p_partkey % 2 = 0 THEN 'IPC' ELSE 'CRPC' END AS act, (p_partkey // 2 + 1)::VARCHAR AS number,
           CASE WHEN p_partkey % 2 = 0 THEN 'BNS' ELSE 'BNSS' END AS new_act, (p_partkey // 2 + 1 + p_size)::VARCHAR AS new_number,
           CASE WHEN p_partkey % 2 = 0 THEN 'IPC' ELSE 'CRPC' END AS near_act, (p_partkey // 2 + 2)::VARCHAR AS near_number
    FROM part JOIN benchmark ON p_partkey % (SELECT count(*) FROM benchmark) = item_id
)"""
_quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
_values = lambda rows: ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
FORMS = f"""
acts(act, name) AS (VALUES {_values(K.ACT_NAMES.items())}),
forms(vague, form, wording) AS (VALUES {_values([(0, i, x) for i, x in enumerate(K.FULL_FORMS)] + [(1, i, x) for i, x in enumerate(K.AMBIGUOUS_FORMS)])}),
cited AS (
    SELECT topic, label, punishment, 'old' AS role, act, number FROM provisions
    UNION ALL SELECT topic, label, punishment, 'new', new_act, new_number FROM provisions
    UNION ALL SELECT topic, label, punishment, 'near', near_act, near_number FROM provisions
    UNION ALL SELECT topic, label, punishment, 'swapped', new_act, number FROM provisions
    UNION ALL SELECT topic, label, punishment, 'vague', act, number FROM provisions
),
worded AS (
    SELECT topic, role, form, act || ' ' || number AS meant,
           CASE WHEN vague = 1 AND NOT contains(wording, '{{number}}') THEN 'NONE' ELSE act || ' ' || number END AS key,
           replace(replace(replace(replace(replace(replace(wording, '{{name}}', name), '{{number}}', number), '{{act}}', act),
                   '{{Label}}', upper(substr(label, 1, 1)) || lower(substr(label, 2))), '{{label}}', label), '{{punishment}}', punishment) AS text
    FROM cited JOIN acts USING (act) JOIN forms ON (role = 'vague') = (vague = 1)
),
index_ AS (SELECT w.*, n AS stands_for FROM worded w JOIN (SELECT text, count(DISTINCT meant) AS n FROM worded GROUP BY text) USING (text))"""
CANDIDATES = f"""
plan(stratum, label, role_i, form_i, role_j, form_j, as_of, link, condition) AS (VALUES {_values(K.PLAN)}),
hashed AS (SELECT *, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS h FROM index_),
met AS (
    SELECT a.topic, stratum, plan.label, a.text AS text_i, b.text AS text_j, a.key AS key_i, b.key AS key_j, as_of, coalesce(link, '') AS link, condition,
           greatest(a.stands_for, b.stands_for) AS stands_for, 'pb1-' || substr(sha256(least(a.h, b.h) || '|' || greatest(a.h, b.h)), 1, 16) AS pair
    FROM plan JOIN hashed a ON a.role = role_i AND a.form = form_i JOIN hashed b ON b.role = role_j AND b.form = form_j AND b.topic = a.topic
),
candidates AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY pair, stratum, as_of, link ORDER BY topic, text_i) = 1)"""
_columns = ", ".join(["pair", *K.PAIR_COLUMNS])


@query(f"WITH {PROVISIONS}, {FORMS} SELECT topic, role, form, text, key, meant, stands_for FROM index_")
def form_index(spark, d):
    """The inverted index of wordings; ambiguous ones stand for more than one provision."""
    return K.form_index(provisions(spark, d))


@query(f"WITH {PROVISIONS}, {FORMS}, {CANDIDATES} SELECT {_columns} FROM candidates")
def candidate_pairs(spark, d):
    return K.candidate_pairs(provisions(spark, d))


@query(
    f"WITH {PROVISIONS}, {FORMS}, {CANDIDATES}, q(stratum, most) AS (VALUES {_values(QUOTAS.items())}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(pair || '|' || as_of || '|' || link), pair, as_of, link) AS k FROM candidates) "
    f"SELECT {_columns} FROM r JOIN q USING (stratum) WHERE k <= most"
)
def candidate_quotas(spark, d):
    """The quota of each stratum, by ranked hash."""
    return K.quota_pairs(provisions(spark, d), QUOTAS)


# Generated answers
SAMPLES, SEED = 6, 11


def _mock(spark, d) -> DataFrame:
    p = I.table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 2 == 0, "IPC").otherwise("BNS").alias("gold_act"), (F.col("p_size") + 100).cast("string").alias("gold_provision"))
    return mock.answers(items, SAMPLES, SEED)


_pick = lambda what, most, by: f"(('0x' || substr(md5('{SEED}|{what}|' || {by}), 1, 8))::BIGINT % {most})"
_both = "item_id || '|' || pos"
_among = lambda names, what: f"[{', '.join(map(_quoted, names))}][{_pick(what, len(names), _both)} + 1]"
_era = lambda old, new, what: f"CASE WHEN gold_act = 'IPC' THEN {_among(old, what)} ELSE {_among(new, what)} END"
MOCK = f"""
items AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN 'IPC' ELSE 'BNS' END AS gold_act, (p_size + 100)::VARCHAR AS gold_provision FROM part),
posed AS (
    SELECT *, [{', '.join(map(_quoted, mock.REGIMES))}][{_pick('regime', len(mock.REGIMES), 'item_id')} + 1] AS regime
    FROM items, range({SAMPLES}) r(pos)
),
templates(place, wording, if_old, if_new) AS (VALUES {_values([(i, *t) for i, t in enumerate(mock.TEMPLATES)])}),
chosen AS (
    SELECT posed.*, wording, CASE WHEN gold_act = 'IPC' THEN if_old ELSE if_new END AS expected
    FROM posed JOIN templates ON place = CASE regime
        WHEN 'right' THEN {_pick('template', len(mock.RIGHT), _both)}
        WHEN 'wrong' THEN {len(mock.RIGHT) + len(mock.OPEN)} + {_pick('template', len(mock.WRONG), 'item_id')}
        ELSE {_pick('template', len(mock.TEMPLATES), _both)} END
),
mocked AS (
    SELECT item_id, pos, gold_act, gold_provision, regime, expected,
           replace(replace(replace(replace(replace(replace(replace(replace(wording, '{{own}}', {_era(mock.OLD, mock.NEW, 'own')}), '{{other}}', {_era(mock.NEW, mock.OLD, 'other')}),
                   '{{near}}', {_era(mock.NEAR_OLD, mock.NEAR_NEW, 'near')}), '{{n}}', gold_provision), '{{m}}', (gold_provision::INT + 1 + {_pick('number', 50, _both)})::VARCHAR),
                   '{{cue}}', {_among(mock.CUES, 'cue')}), '{{operative}}', {_among(mock.OPERATIVE_CUES, 'operative')}), '{{foreign}}', {_among(mock.FOREIGN, 'foreign')}) AS text
    FROM chosen
)"""
_right, _open = (", ".join(sorted({_quoted(x) for t in group for x in (t.old, t.new)})) for group in (mock.RIGHT, mock.OPEN))


@query(f"WITH {MOCK} SELECT item_id, pos, gold_act, gold_provision, regime, text, expected FROM mocked")
def mock_answers(spark, d):
    return _mock(spark, d)


@query(f"WITH {MOCK} SELECT item_id, pos, expected AS label, CASE WHEN expected IN ({_right}) THEN true WHEN expected IN ({_open}) THEN NULL ELSE false END AS correct FROM mocked")
def mock_verdicts(spark, d):
    """The judge over generated answers: every label of its ladder, by what each template was written to reach."""
    v = mentions.judge_answers("text", "gold_act", "gold_provision")
    return _mock(spark, d).withColumn("v", v).select("item_id", "pos", "v.label", "v.correct")


@query(
    f"WITH {MOCK}, c AS (SELECT item_id, regime, expected, count(*) AS n FROM mocked GROUP BY ALL) "
    "SELECT regime, count(DISTINCT item_id) AS items, count(DISTINCT expected) AS labels, sum(n)::BIGINT AS answers, "
    "(SELECT count(*) FROM (SELECT item_id FROM c k WHERE k.regime = c.regime GROUP BY item_id HAVING count(*) = 1)) AS unanimous FROM c GROUP BY regime"
)
def mock_regimes(spark, d):
    """Per regime: items, labels, answers, and items of which all answers have one label."""
    labelled = _mock(spark, d).withColumn("label", mentions.judge_answers("text", "gold_act", "gold_provision")["label"])
    items = labelled.groupBy("regime", "item_id").agg(F.count_distinct("label").alias("k"), F.count("*").alias("n"))
    labels = labelled.groupBy("regime").agg(F.count_distinct("label").alias("labels"))
    return items.groupBy("regime").agg(F.count("*").alias("items"), F.sum("n").alias("answers"), F.sum((F.col("k") == 1).cast("long")).alias("unanimous")).join(labels, "regime")


# Candidate items, their revision, and manifests
def _planned(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    plan = I.table(spark, d, "part").select(
        k.alias("ord"), F.col("p_brand").alias("topic"), F.when(k % 3 == 0, "L7").otherwise("L1").alias("slice"), F.lit("IPC").alias("old_act"), (k + 100).cast("string").alias("old_number"),
        F.lit("BNS").alias("new_act"), (k + 50).cast("string").alias("new_number"), F.concat(F.lit("Which law is it of "), "p_name").alias("question"),
    )
    return revision.numbered_items(plan)


PLANNED = """
planned AS (
    SELECT CASE WHEN k % 3 = 0 THEN 'L7-' ELSE 'L1-' END || pair_id AS item_id, pair_id, CASE WHEN k % 3 = 0 THEN 'L7' ELSE 'L1' END AS slice, topic,
           CASE WHEN k % 3 = 0 THEN 'current' ELSE 'pre-transition' END AS era, question, CASE WHEN k % 3 = 0 THEN 'BNS' ELSE 'IPC' END AS gold_act,
           (k + CASE WHEN k % 3 = 0 THEN 50 ELSE 100 END)::VARCHAR AS gold_provision, CASE WHEN k % 3 = 0 THEN 'IPC' ELSE 'BNS' END AS trap_act,
           (k + CASE WHEN k % 3 = 0 THEN 100 ELSE 50 END)::VARCHAR AS trap_provision, false AS verified
    FROM (SELECT p_partkey AS k, p_brand AS topic, 'Which law is it of ' || p_name AS question,
                 p_brand || '-c' || lpad(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::VARCHAR, 3, '0') AS pair_id FROM part)
)"""


@query(f"WITH {PLANNED} SELECT * FROM planned")
def candidate_items(spark, d):
    """Items numbered within their topic, wanted and trap provisions by slice."""
    return _planned(spark, d)


def _revised(spark, d) -> tuple[DataFrame, DataFrame]:
    """A tenth of all items changed, a tenth retired, and a new item for each of another tenth."""
    items = _planned(spark, d).select("item_id", "topic", "gold_act", "gold_provision", "verified")
    n = F.substring_index("item_id", "-c", -1).cast("int") % 10
    note = lambda action: [F.lit(action).alias("action"), F.lit("review").alias("reason"), F.lit("editor").alias("decided_by")]
    nothing = F.lit(None).cast("string")
    changed = items.where(n == 1).select("item_id", nothing.alias("topic"), nothing.alias("gold_act"), F.concat("gold_provision", F.lit("(2)")).alias("gold_provision"), *note("change"))
    retired = items.where(n == 2).select("item_id", nothing.alias("topic"), nothing.alias("gold_act"), nothing.alias("gold_provision"), *note("retire"))
    added = items.where(n == 3).select(F.concat("item_id", F.lit("-b")).alias("item_id"), "topic", F.lit("BNS").alias("gold_act"), "gold_provision", *note("insert"))
    return revision.revise(items, changed.unionByName(retired).unionByName(added))


_tenth = "split_part(item_id, '-c', 2)::INT % 10"


@query(
    f"WITH {PLANNED} SELECT item_id, topic, gold_act, CASE WHEN {_tenth} = 1 THEN gold_provision || '(2)' ELSE gold_provision END AS gold_provision, verified, {_tenth} = 2 AS retired FROM planned "
    f"UNION ALL SELECT item_id || '-b', topic, 'BNS', gold_provision, false, false FROM planned WHERE {_tenth} = 3"
)
def revised_items(spark, d):
    """Of an item without an id it is not known whether it is retired."""
    return _revised(spark, d)[0].withColumn("retired", F.when(F.col("item_id").isNotNull(), F.col("retired")))


@query(
    f"""WITH {PLANNED},
a AS (
    SELECT item_id, 'change' AS action, 'gold_provision' AS field, gold_provision AS before, gold_provision || '(2)' AS after FROM planned WHERE {_tenth} = 1
    UNION ALL SELECT item_id, 'retire', 'retired', 'false', 'true' FROM planned WHERE {_tenth} = 2
    UNION ALL SELECT item_id || '-b', 'insert', unnest(['topic', 'gold_act', 'gold_provision', 'verified', 'retired']), NULL, unnest([topic, 'BNS', gold_provision, 'false', 'false']) FROM planned WHERE {_tenth} = 3
)
SELECT *, 'review' AS reason, 'editor' AS decided_by FROM a"""
)
def revision_audit(spark, d):
    return _revised(spark, d)[1]


@query(
    sql(
        "scored",
        f""", {PROVISIONS.strip()}, {FORMS.strip()}, {CANDIDATES.strip()},
p AS (SELECT *, CASE topic % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM candidates),
s AS (SELECT split, count(*) AS n, count(DISTINCT label) AS n_labels, sum(('0x' || substr(md5(pair || '|' || label || '|' || as_of || '|' || link), 1, 12))::BIGINT::HUGEINT) AS content FROM p GROUP BY split),
g AS (SELECT round(0.05 * k, 2)::DOUBLE AS tau FROM range(1, 20) r(k)),
q AS (SELECT tau, sum((p >= tau AND correct = 1)::INT) AS tp, sum((p >= tau AND correct = 0)::INT) AS fp, sum((p < tau AND correct = 1)::INT) AS fn FROM scored, g WHERE item_id % 5 = 0 GROUP BY tau),
f AS (SELECT tau, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM q),
b AS (SELECT arg_min(tau, (-round(f1, 12), tau)) AS tau, max(f1) AS f1 FROM f)
SELECT split, n, n_labels, content::VARCHAR AS content, 'v1' AS version, {R("tau")} AS tau, {R("f1")} AS f1 FROM s, b""",
    )
)
def training_manifest(spark, d):
    """The candidate pairs' splits by topic, their contents, and the threshold chosen on dev."""
    part = lambda c: F.when(c % 5 == 0, "dev").when(c % 5 == 1, "test").otherwise("train").alias("split")
    pairs = K.distinct_pairs(provisions(spark, d)).select("pair", "label", "as_of", "link", part(F.col("topic")))
    scored = I.scored(spark, d).select(part(F.col("item_id")), F.col("p").alias("score"), F.col("correct").alias("gold"))
    grid = [round(0.05 * k, 2) for k in range(1, 20)]
    return revision.manifest(pairs, ["pair", "label", "as_of", "link"], scored, grid, "v1").withColumn("content", F.col("content").cast("string"))


@query(
    sql(
        "scored",
        """, i AS (SELECT item_id, slice, CASE WHEN n_chars % 17 = 0 THEN NULL ELSE correct END AS correct, CASE WHEN n_chars % 19 = 0 THEN NULL WHEN n_chars % 19 = 1 THEN 2.0 ELSE u END AS u,
       item_id % 5 AS part, CASE WHEN item_id % 50 = 3 THEN NULL WHEN item_id % 50 = 4 THEN 9 ELSE item_id % 5 END AS stored FROM scored),
e AS (SELECT slice, * EXCLUDE slice FROM i UNION ALL SELECT 'pooled', * EXCLUDE slice FROM i),
c AS (SELECT slice, count(*) AS n, count(*) FILTER (WHERE u BETWEEN 0 AND 1 AND correct IS NOT NULL) AS scored, count(*) FILTER (WHERE u BETWEEN 0 AND 1 AND correct = 1) AS "right",
       count(*) FILTER (WHERE u BETWEEN 0 AND 1 AND correct = 0) AS wrong, count(*) FILTER (WHERE part IS DISTINCT FROM stored) AS moved FROM e GROUP BY slice)
SELECT *, CASE WHEN scored = 0 THEN 'NO_SCORES' WHEN "right" = 0 OR wrong = 0 THEN 'SINGLE_CLASS' ELSE 'READY' END AS status FROM c""",
    )
)
def feasibility(spark, d):
    """Which slices can be evaluated, and whose items are not in the part that was stored for them."""
    n, k = F.col("n_chars"), F.col("item_id")
    u = F.when(n % 19 == 1, 2.0).when(n % 19 != 0, F.col("u"))
    items = I.scored(spark, d).select("item_id", "slice", (k % 5).alias("part"), u.alias("u"), F.when(n % 17 != 0, F.col("correct")).alias("correct"))
    stored = items.where(k % 50 != 3).select("item_id", F.when(k % 50 == 4, 9).otherwise(F.col("part")).alias("part"))
    return revision.feasibility(items, stored)


@query(
    f"""WITH l AS (SELECT 'stage' || event_id % 3 AS stage, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 97) / 10 END AS seconds FROM events),
w(stage) AS (VALUES ('stage0'), ('stage1'), ('stage2'), ('decide')),
g AS (SELECT stage, count(*) AS n, quantile_cont(seconds, 0.5) AS m, quantile_cont(seconds, 0.95) AS p, avg(seconds) AS a, min(seconds) AS lo, max(seconds) AS hi FROM l WHERE seconds IS NOT NULL GROUP BY stage)
SELECT stage, coalesce(n, 0) AS n, {R("m")} AS median, {R("p")} AS p95, {R("a")} AS mean, {R("lo")} AS least, {R("hi")} AS most, 'seconds' AS unit, CASE WHEN n IS NULL THEN 'not_instrumented' END AS undefined FROM w LEFT JOIN g USING (stage)
UNION ALL SELECT 'memory', 0, NULL, NULL, NULL, NULL, NULL, 'megabytes', 'not_instrumented'"""
)
def deployment_report(spark, d):
    """Latencies of three stages; the fourth, and memory, were not measured."""
    e = F.col("event_id")
    seconds = I.table(spark, d, "events").select(F.concat(F.lit("stage"), e % 3).alias("stage"), F.when(e % 11 != 0, (e % 97) / 10).alias("seconds"))
    return revision.deployment(seconds, ["stage0", "stage1", "stage2", "decide"])
