"""Queries over the driver's tables, each with the same in DuckDB's SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordia.functions import mentions as M
from accordia.functions import text as T
from accordia.functions.vocabulary import UNRESOLVED_LABELS
from accordia.operators import agreement as A
from accordia.operators import bootstrap as B
from accordia.operators import calibration as C
from accordia.operators import evaluation as E
from accordia.operators import fits, maps, ranking, relations, risk, validity, warrant
from accordia.operators.tables import written
from accordia.plans import fit_sql
from accordia.plans import inputs as I
from accordia.plans.inputs import sql
from accordia.sources import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Digits to which doubles are compared.
PLACES = 6


def query(oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c, kind in out.dtypes if kind == "double"})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def R(x: str) -> str:
    return f"round(({x})::DOUBLE, {PLACES}) + 0.0"


def day() -> Column:
    return F.lit("1998-01-01").cast("timestamp")

GRID = [round(0.05 * k, 2) for k in range(1, 20)]
COVERAGES = [round(0.1 * k, 1) for k in range(1, 11)]


# Sources
@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def resume_anti_join(spark, d):
    return runs.pending(I.table(spark, d, "orders").select("o_orderkey"), I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(sql("links", """    , twice AS (SELECT *, "from" + 0 AS ord FROM links UNION ALL SELECT "from", "to", NULL, "from" + 100 FROM links WHERE "to" % 3 = 0)
    SELECT "from", "to", coalesce(arg_max(coalesce(type, 'successor_of'), ord)) AS type FROM twice GROUP BY ALL"""))
def last_wins_links(spark, d):
    links = I.links(spark, d)
    later = links.where(F.col("to") % 3 == 0).select("from", "to", F.lit(None).cast("string").alias("type"), (F.col("from") + 100).alias("ord"))
    return validity.last_wins(links.withColumn("ord", F.col("from")).unionByName(later))


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def id_conflicts(spark, d):
    return runs.conflicts(I.table(spark, d, "events"), "user_id", "event_type")


@query("SELECT p_partkey, coalesce(s.hit, false) AS verified FROM part LEFT JOIN (SELECT DISTINCT ps AS k, true AS hit FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity > 49)) s ON p_partkey = s.k")
def override_apply(spark, d):
    parts = I.table(spark, d, "part").select("p_partkey", F.lit(False).alias("verified"))
    over = I.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("verified"))
    return runs.override(parts, over, "p_partkey", "verified")[0]


# Agreement
@query(sql("samples counts pro", f"SELECT item_id, n::BIGINT AS n, n_keys, {R('top_share')} AS top_share, {R('entropy')} AS entropy, majority FROM pro"))
def agreement_profile(spark, d):
    return A.profile(I.samples(spark, d))


@query(sql("samples", """, f AS (SELECT item_id, pos, min(pos) OVER (PARTITION BY item_id, lower(text)) AS first FROM samples)
    SELECT item_id, pos, dense_rank() OVER (PARTITION BY item_id ORDER BY first) - 1 AS label FROM f"""))
def first_seen_labels(spark, d):
    return A.first_seen(I.samples(spark, d))


@query(sql("samples counts pro", f", e AS (SELECT item_id, 0.1 AS pu, entropy FROM pro) SELECT item_id, {R('(1 - pu) * entropy - (1 - pu) * log2(1 - pu) - pu * log2(pu)')} AS entropy_unobserved FROM e"))
def entropy_unobserved(spark, d):
    return A.entropy_with_unobserved(I.samples(spark, d), F.lit(0.1))


@query(sql("samples", f""", c AS (SELECT item_id, key, count(*) AS size, min(pos) AS first, avg(correct) AS fc, avg(resolved) AS fr, arg_min(verdict, pos) AS verdict FROM samples GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY size DESC, first) AS r FROM c)
    SELECT item_id, key AS majority_label, size, {R('fc')} AS frac_correct, (fc >= 0.5)::INT AS majority_correct, (fr >= 0.5)::INT AS majority_resolved, verdict FROM b WHERE r = 1"""))
def modal_outcome(spark, d):
    return A.modal_outcome(I.samples(spark, d), "key")


WILSON = "(p + {z} * {z} / (2 * n) {s} {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"
Z = "1.959963984540054"
LOW, HIGH = f"greatest({WILSON.format(z=Z, s='-')}, 0)", f"least({WILSON.format(z=Z, s='+')}, 1)"


@query(sql("samples counts pro", f""", i AS (SELECT pro.item_id, n_keys, (avg(correct) >= 0.5)::INT AS correct, pro.item_id % 5 AS grp FROM pro JOIN samples USING (item_id) GROUP BY pro.item_id, n_keys),
    a AS (SELECT grp, count(*) AS items, sum((n_keys <= 8)::INT) AS n, sum((n_keys <= 8 AND correct = 1)::INT) AS n_correct FROM i GROUP BY 1), q AS (SELECT *, n_correct / nullif(n, 0) AS p FROM a)
    SELECT grp, items, n, n_correct, {R('p')} AS accuracy, CASE WHEN n > 0 THEN {R(LOW)} END AS low, CASE WHEN n > 0 THEN {R(HIGH)} END AS high, {R('(n - n_correct) / items')} AS wrong_share FROM q"""))
def unanimous_wilson(spark, d):
    s = I.samples(spark, d)
    items = A.profile(s).join(s.groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct")), "item_id")
    return A.unanimous(items.select((F.col("item_id") % 5).alias("grp"), "correct", F.when(F.col("n_keys") <= 8, 1).otherwise(2).alias("n_keys")), ["grp"])


@query(sql("samples", f"""SELECT item_id, {R('avg(correct)')} AS frac_correct, {R('avg((resolved = 0)::INT)')} AS frac_unresolved, {R('avg(repealed)')} AS repealed_share, 5.0::DOUBLE AS mean_words, {R('1 - exp(avg(logprob))')} AS p_true FROM samples GROUP BY 1"""))
def item_means(spark, d):
    return A.means(I.samples(spark, d))


@query(sql("samples counts pro", """, c AS (SELECT item_id % 7 AS slice, majority AS answer, count(*) AS n, min(item_id) AS first FROM pro GROUP BY 1, 2),
    r AS (SELECT slice, answer, n, row_number() OVER (PARTITION BY slice ORDER BY n DESC, first) AS place FROM c) SELECT * FROM r WHERE place <= 6"""))
def leaderboard(spark, d):
    items = A.profile(I.samples(spark, d)).select((F.col("item_id") % 7).alias("slice"), F.col("majority").alias("answer"), F.col("item_id").alias("ord"))
    return A.leaderboard(items, "slice", "answer")


# Text
NORMAL = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(translate(text, '‘’“”–—' || chr(160), '''''""-- '), ' ' || chr(9) || chr(10) || chr(13)), '^\s*(?:final\s+)?(?:answer|ans|response)\s*[:\-]\s*', '', 'i'), '[*_`>#]+', '', 'g'), '\s+', ' ', 'g'), ' .;:,-'))"""


@query(f"SELECT doc_id, md5({NORMAL}) AS h FROM documents")
def normalize_text(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))


@query(f"SELECT conv_id, turn, md5({NORMAL}) AS h FROM (SELECT conv_id, turn, 'Final Answer: ' || text || ' *.' AS text FROM conversations)")
def normalize_answers(spark, d):
    return I.table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.normalize(F.concat(F.lit("Final Answer: "), "text", F.lit(" *.")))).alias("h"))


@query(sql("samples", "SELECT act, provision, key, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'ipc') THEN 'IPC' WHEN contains(lower(text), 'bns') THEN 'BNS' END AS act, provision, key FROM samples) GROUP BY ALL"))
def alias_key(spark, d):
    return I.samples(spark, d).select(T.first_alias(F.col("text")).alias("act"), "provision", "key").groupBy("act", "provision", "key").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'previously|replaced|used to|prior to|formerly|repeal|supersed') AS old, regexp_matches(lower(text), 'applied|liable|governs') AS live FROM documents""")
def cue_flags(spark, d):
    old, live = ("previously", "replaced", "used to", "prior to", "formerly", "repeal", "supersed"), ("applied", "liable", "governs")
    return I.table(spark, d, "documents").select("doc_id", T.contains_any(F.col("text"), old).alias("old"), T.contains_any(F.col("text"), live).alias("live"))


@query(sql("samples", """SELECT item_id, pos, CASE WHEN act IS NULL AND pos % 3 = 0 THEN 'NONE' WHEN pos % 5 = 4 THEN 'FOREIGN:' || provision WHEN pos % 3 = 0 THEN act || ' (no section)' ELSE coalesce(act, 'UNKNOWN') || ' ' || provision END AS k FROM samples"""))
def provision_key(spark, d):
    s = I.samples(spark, d)
    bare = F.col("pos") % 3 == 0
    foreign = (F.col("pos") % 5 == 4) & ~(F.col("act").isNull() & bare)
    act, provision = F.when(foreign, "FOREIGN").otherwise(F.col("act")), F.when(~bare | foreign, F.col("provision"))
    return s.select("item_id", "pos", T.provision_key(act, provision).alias("k"))


@query(r"""WITH h AS (SELECT a.item_id AS a, b.item_id AS b, substr(sha256(trim(regexp_replace(a.text, '\s+', ' ', 'g'))), 1, 16) AS x, substr(sha256(trim(regexp_replace(b.text, '\s+', ' ', 'g'))), 1, 16) AS y FROM benchmark a JOIN benchmark b ON a.item_id % 4 = b.item_id % 4 AND a.item_id <> b.item_id)
    SELECT a, b, 'pb1-' || substr(sha256(least(x, y) || '|' || greatest(x, y)), 1, 16) AS pair FROM h""")
def pair_hash(spark, d):
    b = I.table(spark, d, "benchmark")
    x, y = b.alias("x"), b.alias("y")
    met = x.join(y, (F.col("x.item_id") % 4 == F.col("y.item_id") % 4) & (F.col("x.item_id") != F.col("y.item_id")))
    return met.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), T.pair_id(F.col("x.text"), F.col("y.text")).alias("pair"))


@query(sql("samples", """SELECT item_id, pos, CASE WHEN provision <> (item_id % 7 + 1)::VARCHAR OR (act IS NOT NULL AND act <> 'IPC') THEN NULL WHEN item_id % 2 = 0 THEN 'base' ELSE 'exact' END AS kind FROM samples"""))
def match_kinds(spark, d):
    wanted = F.concat((F.col("item_id") % 7 + 1).cast("string"), F.when(F.col("item_id") % 2 == 0, "(2)").otherwise(""))
    return I.samples(spark, d).select("item_id", "pos", T.match_kind(F.col("provision"), F.lit(None).cast("string"), F.col("act"), wanted, F.lit("IPC")).alias("kind"))


# Ranking and risk
@query(sql("scored", f""", g AS (SELECT slice, u, sum(correct) AS p, sum(1 - correct) AS q FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY slice ORDER BY u) AS b FROM g)
    SELECT slice, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_correct, {R('sum(q * (b - p / 2)) / nullif(sum(p) * sum(q), 0)')} AS auroc FROM c GROUP BY 1"""))
def auroc_by_slice(spark, d):
    return ranking.auroc(I.scored(spark, d), ["slice"])


@query(sql("scored", f""", c AS (SELECT slice, correct, row_number() OVER w AS k, sum(1 - correct) OVER w AS hits FROM scored WINDOW w AS (PARTITION BY slice ORDER BY u DESC, ord ROWS UNBOUNDED PRECEDING))
    SELECT slice, {R('sum(CASE WHEN correct = 0 THEN hits / k END) / nullif(sum(1 - correct), 0)')} AS auprc FROM c GROUP BY 1"""))
def auprc_by_slice(spark, d):
    return ranking.auprc(I.scored(spark, d), ["slice"])


@query(sql("scored curve", f"SELECT slice, item_id, k, errors::BIGINT AS errors, {R('risk')} AS risk FROM curve"))
def risk_coverage_curve(spark, d):
    return ranking.curve(I.scored(spark, d), ["slice"]).select("slice", "item_id", "k", "errors", "risk")


@query(sql("scored curve", f""", a AS (SELECT slice, avg(risk) AS aurc, count(*) AS n, sum(correct) AS r FROM curve GROUP BY 1), b AS (SELECT slice, avg(greatest(k - a.r, 0) / k) AS best FROM curve JOIN a USING (slice) GROUP BY 1)
    SELECT slice, {R('aurc')} AS aurc, {R('best')} AS best, CASE WHEN (n - r) / n > best THEN {R('((n - r) / n - aurc) / ((n - r) / n - best)')} END AS norm FROM a JOIN b USING (slice)"""))
def aurc_norm(spark, d):
    return ranking.aurc(I.scored(spark, d), ["slice"])


@query(sql("scored curve", f""", n AS (SELECT slice, max(k) AS n FROM curve GROUP BY 1), w AS (SELECT slice, n, c / 10.0::DOUBLE AS coverage, round(greatest(c / 10.0::DOUBLE * n, 1), 9) AS x FROM n, range(1, 11) t(c))
    SELECT w.slice, coverage, {R('a.risk + (b.risk - a.risk) * (x - floor(x))')} AS risk FROM w JOIN curve a ON a.slice = w.slice AND a.k = floor(x) JOIN curve b ON b.slice = w.slice AND b.k = least(ceil(x), n)"""))
def risk_at_coverage(spark, d):
    return ranking.risk_at(I.scored(spark, d), ["slice"], COVERAGES)


@query(sql("scored", f"""SELECT slice, {R('avg(u) FILTER (WHERE correct = 1)')} AS mean_right, {R('avg(u) FILTER (WHERE correct = 0)')} AS mean_wrong, {R('avg(u) FILTER (WHERE correct = 0) - avg(u) FILTER (WHERE correct = 1)')} AS gap FROM scored GROUP BY 1"""))
def class_means(spark, d):
    return ranking.by_class(I.scored(spark, d), ["slice"])


@query(sql("scored", f""", c AS (SELECT slice, correct AS a, 1 - toxic AS b, count(*) AS c FROM scored GROUP BY ALL), t AS (SELECT slice, sum(c) AS n, sum(c) FILTER (WHERE a = b) AS s FROM c GROUP BY 1),
    e AS (SELECT x.slice, sum(x.c * y.c) AS e FROM (SELECT slice, a, sum(c) AS c FROM c GROUP BY 1, 2) x JOIN (SELECT slice, b, sum(c) AS c FROM c GROUP BY 1, 2) y ON x.slice = y.slice AND x.a = y.b GROUP BY 1)
    SELECT slice, n::BIGINT AS n, CASE WHEN e / (n * n) < 1 THEN {R('(s / n - e / (n * n)) / (1 - e / (n * n))')} END AS kappa FROM t JOIN e USING (slice)"""))
def kappa(spark, d):
    return ranking.kappa(I.scored(spark, d).withColumn("clean", 1 - F.col("toxic")), ["slice"], "correct", "clean")


# Calibration metrics
def _bins(n: int) -> str:
    return f"greatest(ceil(p * {n}), 1)::INT"


@query(sql("scored", f""", c AS (SELECT slice, {_bins(10)} AS bin, count(*) AS c, sum(p) AS p, sum(correct) AS y FROM scored GROUP BY 1, 2) SELECT slice, {R('sum(abs(y - p)) / sum(c)')} AS ece FROM c GROUP BY 1"""))
def ece_bins(spark, d):
    return C.calibration_error(I.scored(spark, d), ["slice"], 10)


@query(sql("scored", f""", c AS (SELECT slice, {_bins(5)} AS bin, count(*) AS n, {R('avg(p)')} AS mean_p, {R('avg(correct)')} AS accuracy FROM scored GROUP BY 1, 2), e AS (SELECT DISTINCT slice, b AS bin FROM scored, range(1, 6) t(b))
    SELECT e.slice, e.bin::INT AS bin, coalesce(n, 0) AS n, mean_p, accuracy FROM e LEFT JOIN c ON c.slice = e.slice AND c.bin = e.bin"""))
def reliability_table(spark, d):
    return C.reliability_table(I.scored(spark, d), ["slice"], 5)


@query(sql("scored", f"""SELECT slice, count(*) AS n, {R('avg((p - correct) * (p - correct))')} AS brier, {R('avg(-CASE WHEN correct = 1 THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END)')} AS log_loss FROM scored GROUP BY 1"""))
def brier_logloss(spark, d):
    return C.scores(I.scored(spark, d), ["slice"])


@query(sql("scored", f""", r AS (SELECT *, row_number() OVER v AS k, sum(w) OVER v AS sw, sum(w * (1 - correct)) OVER v AS se FROM scored WINDOW v AS (PARTITION BY slice ORDER BY p DESC, ord ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT slice, count(*) AS n FROM scored GROUP BY 1), q AS (SELECT slice, c / 10.0::DOUBLE AS coverage, greatest(1, ceil(round(c / 10.0::DOUBLE * n, 9)))::BIGINT AS k FROM n, range(1, 11) t(c))
    SELECT q.slice, coverage, q.k AS accepted, {R('se / sw')} AS risk, {R('p')} AS threshold FROM q JOIN r ON r.slice = q.slice AND r.k = q.k"""))
def selective_risk_weighted(spark, d):
    return C.selective_risk(I.scored(spark, d), ["slice"], COVERAGES)


# Validity
@query(sql("intervals probes", """SELECT event_id, p.key, value FROM probes p LEFT JOIN intervals i ON p.key = i.key AND i."begin" <= day AND (i."end" IS NULL OR day < i."end")"""))
def as_of_in_force(spark, d):
    return validity.as_of(I.probes(spark, d), I.intervals(spark, d), "key", "day").select("event_id", "key", "value")


@query(sql("samples statutes resolved", """SELECT item_id % 10 AS grp, count(*) AS assertions, count(statute) AS known, count(DISTINCT CASE WHEN statute IS NULL THEN key END) AS unknown,
    coalesce(string_agg(DISTINCT CASE WHEN statute IS NULL THEN key END, ',' ORDER BY CASE WHEN statute IS NULL THEN key END), '') AS unknown_keys FROM resolved WHERE key <> 'NONE' GROUP BY 1"""))
def validity_coverage(spark, d):
    found = validity.resolve(I.samples(spark, d).select((F.col("item_id") % 10).alias("grp"), "key"), I.statutes(spark, d))
    return validity.coverage(found, ["grp"])


@query(sql("links", """, p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey % 5 = b.n_nationkey % 5)
    SELECT p.a, p.b, CASE WHEN p.a <> p.b THEN coalesce(f.type, r.type) END AS relation FROM p LEFT JOIN links f ON f."from" = p.a AND f."to" = p.b LEFT JOIN links r ON r."to" = p.a AND r."from" = p.b"""))
def symmetric_links(spark, d):
    n = I.table(spark, d, "nation").select("n_nationkey")
    pairs = n.alias("x").join(n.alias("y"), F.col("x.n_nationkey") % 5 == F.col("y.n_nationkey") % 5).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))
    return validity.relation(pairs, I.links(spark, d))


@query(sql("intervals", """, w AS (SELECT key, ord, "begin", CASE WHEN ord % 9 = 0 THEN "begin" WHEN ord % 11 = 0 THEN NULL ELSE "end" END AS "end" FROM intervals), x AS (SELECT *, lead("begin") OVER (PARTITION BY key ORDER BY "begin", ord) AS nx FROM w)
    SELECT key, ord, 'empty' AS rule FROM x WHERE "end" <= "begin" UNION ALL SELECT key, ord, 'overlap' FROM x WHERE nx IS NOT NULL AND ("end" IS NULL OR "end" > nx)"""))
def interval_violations(spark, d):
    end = F.when(F.col("ord") % 9 == 0, F.col("begin")).when(F.col("ord") % 11 != 0, F.col("end"))
    return validity.violations(I.intervals(spark, d).withColumn("end", end))


@query(sql("intervals", """SELECT key, ord, value, lag(value) OVER w AS predecessor, lead(value) OVER w AS successor FROM intervals WINDOW w AS (PARTITION BY key ORDER BY "begin", ord)"""))
def neighbours(spark, d):
    return validity.neighbours(I.intervals(spark, d))


@query(sql("samples statutes resolved", """, f AS (SELECT item_id, key, min(pos) AS first, any_value(CASE WHEN "begin" IS NULL THEN 'unknown' WHEN "begin" <= TIMESTAMP '1998-01-01' AND ("end" IS NULL OR TIMESTAMP '1998-01-01' < "end") THEN 'true' ELSE 'false' END) AS st FROM resolved WHERE key <> 'NONE' GROUP BY 1, 2),
    l AS (SELECT item_id, string_agg(key || '=' || st, ',' ORDER BY first) AS v FROM f GROUP BY 1) SELECT s.item_id, coalesce(any_value(l.v), '') AS validity, sum((key = 'NONE')::INT)::BIGINT AS excluded FROM samples s LEFT JOIN l ON l.item_id = s.item_id GROUP BY 1"""))
def validity_context(spark, d):
    return validity.context(I.samples(spark, d), I.statutes(spark, d), day())


# Warrant
def _warrant(spark, d) -> DataFrame:
    w = warrant.factors(I.samples(spark, d), I.statutes(spark, d), I.statute_links(spark), day())
    right = I.samples(spark, d).groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct"))
    return w.withColumn("flags", warrant.flags(F.col("t"), F.col("j"), F.col("k"))).join(right, "item_id")


FLAGS = """, right_ AS (SELECT item_id, (avg(correct) >= 0.5)::INT AS correct FROM samples GROUP BY 1),
    fl AS (SELECT w.*, r.correct, list_filter([CASE WHEN t IS NULL THEN 'unresolvable' END, CASE WHEN t < 1 THEN 'stale' END, CASE WHEN j < 1 THEN 'foreign' END, CASE WHEN k > 0 THEN 'contradiction' END], lambda x: x IS NOT NULL) AS flags FROM warrant w JOIN right_ r USING (item_id))"""


@query(sql("samples statutes counts modal warrant", f"SELECT item_id, modal_key, {R('a')} AS a, {R('t')} AS t, {R('j')} AS j, {R('k')} AS k, {R('a * t * j * (1 - k)')} AS w, {R('a - a * t * j * (1 - k)')} AS cm FROM warrant"))
def warrant_factors(spark, d):
    f = warrant.factors(I.samples(spark, d), I.statutes(spark, d), I.statute_links(spark), day())
    w, cm = warrant.compose(F.col("a"), F.col("t"), F.col("j"), F.col("k"))
    return f.select("item_id", "modal_key", "a", "t", "j", "k", w.alias("w"), cm.alias("cm"))


@query(sql("samples statutes counts modal warrant", FLAGS + " SELECT correct, flag, count(*) AS n FROM (SELECT correct, unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['none'] END) AS flag FROM fl) GROUP BY ALL"))
def flag_census(spark, d):
    return warrant.flag_census(_warrant(spark, d), ["correct"])


@query(sql("samples statutes counts modal warrant", FLAGS + f""", q AS (SELECT item_id % 3 AS grp, sum((len(flags) > 0 AND correct = 0)::INT) AS tp, sum((len(flags) > 0 AND correct = 1)::INT) AS fp, sum((len(flags) = 0 AND correct = 0)::INT) AS fn, sum((len(flags) = 0 AND correct = 1)::INT) AS tn FROM fl GROUP BY 1)
    SELECT grp, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {R('tp / nullif(tp + fn, 0)')} AS recall, {R('coalesce(fp / nullif(fp + tn, 0), 0)')} AS far FROM q"""))
def confusion(spark, d):
    return warrant.confusion(_warrant(spark, d).withColumn("grp", F.col("item_id") % 3), ["grp"])


@query(sql("samples statutes counts modal warrant", FLAGS + f""", p AS (SELECT item_id, correct, a, unnest([{{'pin': 'none', 't': t, 'j': j, 'k': k}}, {{'pin': 't', 't': 1.0, 'j': j, 'k': k}}, {{'pin': 'j', 't': t, 'j': 1.0, 'k': k}}, {{'pin': 'k', 't': t, 'j': j, 'k': 0.0}}]) AS p FROM fl),
    u AS (SELECT p.pin AS pin, round(a - a * p.t * p.j * (1 - p.k), 9) AS u, correct FROM p), g AS (SELECT pin, u, sum(correct) AS p, sum(1 - correct) AS q FROM u WHERE u IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY pin ORDER BY u) AS b FROM g)
    SELECT pin, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_correct, {R('sum(q * (b - p / 2)) / nullif(sum(p) * sum(q), 0)')} AS auroc FROM c GROUP BY 1"""))
def factor_ablation(spark, d):
    return ranking.auroc(warrant.ablations(_warrant(spark, d)).withColumn("u", F.round("cm", 9)), ["pin"])


# Splits and risk score
@query("SELECT doc_id, (('0x' || substr(sha256('7|' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) < 0.3 AS first FROM documents")
def hash_split(spark, d):
    return I.table(spark, d, "documents").select("doc_id", risk.in_first_part(7, F.col("doc_id"), 0.3).alias("first"))


@query(sql("scored", """, g AS (SELECT DISTINCT slice || '|' || topic AS g FROM scored), f AS (SELECT g, ((row_number() OVER (ORDER BY sha256('5|' || g), g) - 1) % least(4, count(*) OVER ()))::INT AS fold FROM g) SELECT item_id, fold FROM scored JOIN f ON g = slice || '|' || topic"""))
def grouped_folds(spark, d):
    return risk.folds(I.scored(spark, d), F.concat_ws("|", "slice", "topic"), 4, 5).select("item_id", "fold")


@query(sql("scored", """, t AS (SELECT DISTINCT topic FROM scored), r AS (SELECT topic, row_number() OVER (ORDER BY sha256('3|' || topic), topic) AS place, count(*) OVER () AS n FROM t)
    SELECT topic, CASE WHEN place <= greatest(round_even(n * 0.2, 0), 1) THEN 'dev' WHEN place <= 2 * greatest(round_even(n * 0.2, 0), 1) THEN 'test' ELSE 'train' END AS split FROM r"""))
def topic_split(spark, d):
    return risk.topic_split(I.scored(spark, d), "topic", 3)


def _records(spark, d, s: DataFrame | None = None) -> DataFrame:
    s = I.samples(spark, d) if s is None else s
    pro = A.profile(s).select("item_id", F.col("n").alias("n_samples"), F.col("entropy").alias("prov_se"))
    f = warrant.factors(s, I.statutes(spark, d), I.statute_links(spark), day())
    w, cm = warrant.compose(F.col("a"), F.col("t"), F.col("j"), F.col("k"))
    return pro.join(f.select("item_id", w.alias("warranted"), cm.alias("common_mode"), F.col("k").alias("contradiction")), "item_id").withColumn("disc_se", F.col("prov_se") * 0.5)


FEATURES = """, f AS (SELECT pro.item_id, CASE WHEN n >= 2 THEN entropy / log2(n) END AS u_prov, CASE WHEN n >= 2 THEN entropy * 0.5 / log2(n) END AS u_text, 1 - a * t * j * (1 - k) AS u_warrant, a - a * t * j * (1 - k) AS u_cm, k AS u_contra FROM pro JOIN warrant USING (item_id)),
    g AS (SELECT *, u_prov IS NOT NULL AND u_warrant IS NOT NULL AS legal_complete FROM f)"""
WEIGHTS = {("u_prov",): 1.5, ("u_text",): 0.5, ("u_warrant",): 0.8, ("u_cm",): 0.3, ("u_contra",): 0.2, ("u_prov", "u_warrant"): 0.7}


@query(sql("samples statutes counts pro modal warrant", FEATURES + f" SELECT item_id, {R('u_prov')} AS u_prov, {R('u_text')} AS u_text, {R('u_warrant')} AS u_warrant, {R('u_cm')} AS u_cm, {R('u_contra')} AS u_contra, legal_complete FROM g"))
def risk_features(spark, d):
    return risk.features(_records(spark, d)).select("item_id", *risk.MAIN, "legal_complete")


@query(sql("samples statutes counts pro modal warrant", FEATURES + f""" SELECT item_id, CASE WHEN legal_complete THEN 'legal_aware' WHEN u_prov IS NOT NULL THEN 'sample_only_degraded' ELSE 'unscorable' END AS mode,
    {R("CASE WHEN legal_complete THEN 1 / (1 + exp(-(-1 + 1.5 * u_prov + 0.5 * u_text + 0.8 * u_warrant + 0.3 * u_cm + 0.2 * u_contra + 0.7 * u_prov * u_warrant))) WHEN u_prov IS NOT NULL THEN 1 / (1 + exp(-(-1 + 1.5 * u_prov + 0.5 * u_text))) END")} AS score FROM g"""))
def linear_score(spark, d):
    return risk.estimate(risk.features(_records(spark, d)), -1.0, WEIGHTS, degraded=True).select("item_id", "mode", "score")


# Maps, conformal thresholds and policy
KNOTS = [(0.1, 0.2), (0.4, 0.5), (0.8, 0.9)]


@query(sql("scored", f"SELECT item_id, {R('CASE WHEN p <= 0.1 THEN 0.2 WHEN p < 0.4 THEN 0.2 + (p - 0.1) / (0.4 - 0.1) * 0.3 WHEN p < 0.8 THEN 0.5 + (p - 0.4) / (0.8 - 0.4) * 0.4 ELSE 0.9 END')} AS p FROM scored"))
def map_predict(spark, d):
    rows = I.scored(spark, d).select("item_id", F.col("slice").alias("stratum"), F.col("p").alias("x"))
    knots = rows.select("stratum").distinct().withColumn("_k", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in KNOTS]))).select("stratum", "_k.x", "_k.y")
    return C.map_predict(rows, knots).select("item_id", "p")


@query(sql("scored", f""", r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY p DESC, ord) AS k, count(*) OVER (PARTITION BY slice) AS n FROM scored), i AS (SELECT slice, max(n) AS n, CASE WHEN ceil(round((max(n) + 1) * 0.8, 9)) <= max(n) THEN ceil(round((max(n) + 1) * 0.8, 9))::BIGINT END AS ix FROM r GROUP BY 1)
    SELECT i.slice, i.n, ix AS "index", {R('r.p')} AS threshold FROM i LEFT JOIN r ON r.slice = i.slice AND r.k = ix"""))
def conformal_threshold(spark, d):
    return C.conformal_threshold(I.scored(spark, d), ["slice"], 0.8)


@query(sql("scored", """SELECT item_id, CASE WHEN n_chars % 10 = 0 THEN 'verify' WHEN round((1 - p) * w, 9) <= 0.15 AND toxic = 0 THEN 'answer' WHEN round((1 - p) * w, 9) <= 0.35 THEN 'verify' ELSE 'abstain' END AS action FROM scored"""))
def policy_actions(spark, d):
    s = I.scored(spark, d)
    p = F.when(F.col("n_chars") % 10 != 0, F.col("p"))
    return s.select("item_id", C.decide(p, F.col("harm"), F.col("toxic") == 1, 0.15 + 1e-9, 0.35 + 1e-9)[0].alias("action"))


@query(sql("scored", f""", c AS (SELECT slice, CASE WHEN p > 0.7 THEN 'answer' WHEN p > 0.3 THEN 'verify' ELSE 'abstain' END AS action, count(*) AS n FROM scored GROUP BY 1, 2) SELECT slice, action, n, {R('n / sum(n) OVER (PARTITION BY slice)')} AS share FROM c"""))
def action_census(spark, d):
    rows = I.scored(spark, d).withColumn("action", F.when(F.col("p") > 0.7, "answer").when(F.col("p") > 0.3, "verify").otherwise("abstain"))
    return C.census(rows, ["slice"])


@query(sql("scored", "SELECT topic, arg_min(harm, (-w, harm)) AS harm_class FROM scored GROUP BY 1"))
def harm_class(spark, d):
    return C.harm_class(I.scored(spark, d))


@query(sql("scored", f", a AS (SELECT slice, avg(correct) AS p, count(*) AS n FROM scored GROUP BY 1) SELECT slice, {R(LOW)} AS wilson_low, {R(HIGH)} AS wilson_high, {R(f'greatest(p - {Z} * sqrt(p * (1 - p) / n), 0)')} AS low, {R(f'least(p + {Z} * sqrt(p * (1 - p) / n), 1)')} AS high FROM a"))
def wilson_normal(spark, d):
    a = I.scored(spark, d).groupBy("slice").agg(F.avg("correct").alias("p"), F.sum("correct").alias("r"), F.count("*").alias("n"))
    (wl, wh), (low, high) = A.wilson(F.col("r"), F.col("n")), C.normal_interval(F.col("p"), F.col("n"))
    return a.select("slice", wl.alias("wilson_low"), wh.alias("wilson_high"), low.alias("low"), high.alias("high"))


# Evaluation
METHODS = ["u", "v", "flat", "none"]


@query(sql("scored", f""", l AS (SELECT slice, ord, correct, 'u' AS method, u FROM scored UNION ALL SELECT slice, ord, correct, 'v', (n_chars % 13) / 13 FROM scored UNION ALL SELECT slice, ord, correct, 'flat', 0.5 FROM scored),
    g AS (SELECT slice, method, u, sum(correct) AS p, sum(1 - correct) AS q FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(p) OVER (PARTITION BY slice, method ORDER BY u) AS b FROM g), a AS (SELECT slice, method, sum(p + q) AS n, sum(q * (b - p / 2)) / nullif(sum(p) * sum(q), 0) AS auroc, min(u) AS lo, max(u) AS hi FROM c GROUP BY 1, 2),
    k AS (SELECT slice, method, sum(1 - correct) OVER w / row_number() OVER w AS risk FROM l WINDOW w AS (PARTITION BY slice, method ORDER BY u, ord ROWS UNBOUNDED PRECEDING)), z AS (SELECT slice, method, avg(risk) AS aurc FROM k GROUP BY 1, 2)
    SELECT s.slice, m.method, coalesce(a.n, 0)::BIGINT AS n, {R('auroc')} AS auroc, {R('aurc')} AS aurc, CASE WHEN a.n IS NULL THEN 'no scores' WHEN auroc IS NULL THEN 'single class' WHEN lo = hi THEN 'constant score' END AS reason
    FROM (VALUES ('en'), ('fr'), ('de'), ('xx')) s(slice) CROSS JOIN (VALUES ('u'), ('v'), ('flat'), ('none')) m(method) LEFT JOIN a ON a.slice = s.slice AND a.method = m.method LEFT JOIN z ON z.slice = s.slice AND z.method = m.method"""))
def eval_matrix(spark, d):
    items = I.scored(spark, d).withColumns({"v": (F.col("n_chars") % 13) / 13, "flat": F.lit(0.5), "none": F.lit(None).cast("double")})
    return E.matrix(ranking.unpivot(items, ["slice", "ord", "correct"], METHODS), ["en", "fr", "de", "xx"], METHODS)


@query(sql("scored", f""", q AS (SELECT slice, quantile_cont(u, 0.25) AS cut, count(*) AS n FROM scored GROUP BY 1) SELECT slice, any_value(n) AS n, CASE WHEN any_value(n) >= 4 THEN {R('any_value(cut)')} END AS cut, CASE WHEN any_value(n) >= 4 THEN sum((correct = 0 AND u <= cut)::INT)::BIGINT END AS confident_wrong FROM scored JOIN q USING (slice) GROUP BY 1"""))
def confident_wrong(spark, d):
    return E.confident_wrong(I.scored(spark, d), ["slice"])


@query(sql("scored", """, s AS (SELECT slice, correct, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 11 = 0 THEN 1.5 ELSE u END AS u FROM scored), a AS (SELECT slice, count(*) AS n, count(u) AS scored, sum((u IS NOT NULL AND u BETWEEN 0 AND 1)::INT)::BIGINT AS valid, coalesce(sum((u BETWEEN 0 AND 1 AND correct = 1)::INT), 0)::BIGINT AS "right", coalesce(sum((u BETWEEN 0 AND 1 AND correct = 0)::INT), 0)::BIGINT AS wrong FROM s GROUP BY 1)
    SELECT *, "right" > 0 AND wrong > 0 AS ready FROM a"""))
def population_census(spark, d):
    u = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("n_chars") % 11 == 0, 1.5).otherwise(F.col("u"))
    return E.population(I.scored(spark, d).withColumn("u", u), ["slice"])


@query(sql("samples", f""", i AS (SELECT item_id % 6 AS topic, item_id, sum(correct) AS r, count(*) AS c FROM samples GROUP BY 1, 2), a AS (SELECT topic, count(*) AS n, sum((r * 2 >= c)::INT) AS hits, sum(r) / sum(c) AS sr FROM i GROUP BY 1), q AS (SELECT *, hits / n AS p FROM a)
    SELECT topic, n AS items, hits::BIGINT AS hits, {R('sr')} AS sample_rate, {R(LOW)} AS low, {R(HIGH)} AS high FROM q"""))
def yield_by_group(spark, d):
    return E.yields(I.samples(spark, d).withColumn("topic", F.col("item_id") % 6), ["topic"])


@query(sql("scored", "SELECT item_id, slice FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY ord) AS r FROM scored) WHERE r <= 10"))
def stratified_cap(spark, d):
    return E.stratified_cap(I.scored(spark, d), "slice", "ord", 40, 4).select("item_id", "slice")


@query(f"SELECT event_type, count(*) AS n, {R('quantile_cont(value, 0.5)')} AS median, {R('quantile_cont(value, 0.95)')} AS p95, {R('avg(value)')} AS mean, {R('min(value)')} AS low, {R('max(value)')} AS high FROM events WHERE value >= 0 AND isfinite(value) GROUP BY 1")
def latency_summary(spark, d):
    return E.latency(I.table(spark, d, "events"), ["event_type"], "value")


@query(sql("samples", f""", v AS (SELECT item_id % 4 AS slice, verdict AS label, count(*) AS n FROM samples GROUP BY 1, 2) SELECT slice, label, n, {R('n / sum(n) OVER w')} AS share, {R("sum(CASE WHEN label = 'unresolved' THEN 0 ELSE n END) OVER w / sum(n) OVER w")} AS resolved_share FROM v WINDOW w AS (PARTITION BY slice)"""))
def verdict_census(spark, d):
    s = I.samples(spark, d).select((F.col("item_id") % 4).alias("slice"), F.concat(F.lit("provision|"), "verdict").alias("verdict"))
    return E.verdict_census(s, ["slice"], UNRESOLVED_LABELS)


@query(sql("samples", """, l AS (SELECT item_id, pos, logprob, lag(logprob) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM samples) SELECT item_id, string_agg(pos, ',' ORDER BY pos) AS "at", count(*) AS n FROM l WHERE logprob < b GROUP BY 1"""))
def ladder_violations(spark, d):
    return E.ladder_violations(I.samples(spark, d).withColumn("value", F.col("logprob")))


@query("""SELECT user_id::VARCHAR AS key, 'missing props' AS rule FROM events WHERE trim(coalesce(props, '')) = '' UNION ALL SELECT user_id::VARCHAR, 'missing event_type' FROM events WHERE trim(coalesce(event_type, '')) = '' UNION ALL SELECT user_id::VARCHAR, 'duplicate' FROM events GROUP BY 1 HAVING count(*) > 1""")
def contract_violations(spark, d):
    return E.contract(I.table(spark, d, "events"), "user_id", ["event_type", "props"])


@query(sql("scored", f"SELECT {R('avg(correct) FILTER (WHERE slice = ' + chr(39) + 'en' + chr(39) + ')')} AS first, {R('avg(correct) FILTER (WHERE slice = ' + chr(39) + 'fr' + chr(39) + ')')} AS second, {R('avg(correct) FILTER (WHERE slice = ' + chr(39) + 'en' + chr(39) + ') - avg(correct) FILTER (WHERE slice = ' + chr(39) + 'fr' + chr(39) + ')')} AS difference FROM scored"))
def slice_contrast(spark, d):
    return E.contrast(I.scored(spark, d), "en", "fr")


# Pairwise
TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
# Texts are split once each; every pair of an item's samples then looks its texts' overlap up.
PAIRS = f""", words AS (SELECT text, {TOKENS} AS t FROM (SELECT DISTINCT text FROM samples)), alike AS (SELECT x.text AS a, y.text AS b, len(list_intersect(x.t, y.t)) / greatest(len(x.t), len(y.t)) AS score FROM words x, words y),
    lex AS (SELECT a.item_id, a.pos AS i, b.pos AS j, a.key AS ki, b.key AS kj, score FROM samples a JOIN samples b ON a.item_id = b.item_id AND a.pos < b.pos JOIN alike ON alike.a = a.text AND alike.b = b.text)"""


@query(sql("samples", PAIRS + f" SELECT item_id, i, j, {R('score')} AS score FROM lex"))
def lexical_pairs(spark, d):
    return A.pair_scores(I.samples(spark, d))


@query(sql("samples", PAIRS + f""", e AS (SELECT item_id, i AS pos, score FROM lex UNION ALL SELECT item_id, j, score FROM lex), b AS (SELECT item_id, pos, max(score) AS m FROM e GROUP BY 1, 2) SELECT samples.item_id, {R('avg(1 - coalesce(m, 0))')} AS selfcheck FROM samples LEFT JOIN b ON b.item_id = samples.item_id AND b.pos = samples.pos GROUP BY 1"""))
def selfcheck(spark, d):
    return A.selfcheck_of_texts(I.samples(spark, d))


RULE = "CASE WHEN ki = 'NONE' OR kj = 'NONE' THEN 'AMBIGUOUS' WHEN ki = kj THEN 'SAME_PROVISION' WHEN split_part(ki, ' ', 2) = split_part(kj, ' ', 2) THEN 'LEGALLY_EQUIVALENT' WHEN split_part(ki, ' ', 1) <> split_part(kj, ' ', 1) THEN 'CONTRADICTORY' ELSE 'DIFFERENT_PROVISION' END"


def _ruled(spark, d, s: DataFrame | None = None) -> DataFrame:
    p = relations.pairs(I.samples(spark, d) if s is None else s)
    part = lambda c, i: F.split(c, " ")[i]
    known = (F.col("key_i") != "NONE") & (F.col("key_j") != "NONE") & (F.col("key_i") != F.col("key_j"))
    link = F.when(known, F.when(part("key_i", 1) == part("key_j", 1), "successor_of").when(part("key_i", 0) != part("key_j", 0), "different_offence"))
    return p.withColumn("label", relations.rule_relation(F.col("key_i"), F.col("key_j"), link))


@query(sql("samples", PAIRS + f" SELECT {RULE} AS label, count(*) AS n FROM lex GROUP BY 1"))
def rule_relations(spark, d):
    return _ruled(spark, d).groupBy("label").agg(F.count("*").alias("n"))


# Clusters are of equal keys here, so that all pairs of a cluster with the largest are of one relation.
@query(sql("samples counts", f""", z AS (SELECT counts.item_id, counts.key, c, min(pos) AS first FROM counts JOIN samples ON samples.item_id = counts.item_id AND samples.key = counts.key GROUP BY 1, 2, 3),
    m AS (SELECT item_id, sum(c) AS m, arg_min(key, (-c, first)) AS modal FROM z GROUP BY 1), p AS (SELECT item_id, c, m, key <> modal AS other, modal AS ki, key AS kj FROM z JOIN m USING (item_id))
    SELECT item_id, {R("sum(CASE WHEN other AND (" + RULE + ") = 'CONTRADICTORY' THEN c ELSE 0 END) / max(m)")} AS mass FROM p GROUP BY 1"""))
def contradiction_mass(spark, d):
    s = I.samples(spark, d)
    firsts = s.withColumn("first", F.min("pos").over(Window.partitionBy("item_id", "key")))
    clusters = firsts.select("item_id", "pos", (F.dense_rank().over(Window.partitionBy("item_id").orderBy("first")) - 1).alias("label"))
    return relations.contradiction_mass(clusters, _ruled(spark, d).where("label = 'CONTRADICTORY'"))


@query(f"""WITH r AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber % 3 = 0 THEN 'R' WHEN l_linenumber % 3 = 1 THEN 'A' ELSE l_returnflag END AS p FROM lineitem), o AS (SELECT g AS label, count(*) AS support, sum((g = p)::INT) AS tp FROM r GROUP BY 1), s AS (SELECT p AS label, count(*) AS said FROM r GROUP BY 1),
    m AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp / said, 0) AS precision, coalesce(tp / support, 0) AS recall FROM o FULL JOIN s USING (label)) SELECT label, support, {R('precision')} AS precision, {R('recall')} AS recall, {R('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1 FROM m""")
def macro_f1(spark, d):
    rows = I.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(F.col("l_linenumber") % 3 == 0, "R").when(F.col("l_linenumber") % 3 == 1, "A").otherwise(F.col("l_returnflag")).alias("p"))
    return relations.class_report(rows, "g", "p")


@query(sql("scored", f""", t AS (SELECT round(0.05 * k, 2)::DOUBLE AS tau FROM range(1, 20) r(k)), q AS (SELECT tau, sum((p >= tau AND correct = 1)::INT) AS tp, sum((p >= tau AND correct = 0)::INT) AS fp, sum((p < tau AND correct = 1)::INT) AS fn FROM scored, t GROUP BY 1),
    z AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM q) SELECT tau, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {R('pr')} AS precision, {R('re')} AS recall, {R('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} AS f1 FROM z"""))
def threshold_sweep(spark, d):
    return relations.threshold_sweep(I.scored(spark, d).select(F.col("p").alias("score"), F.col("correct").alias("gold")), GRID)


# Grouped algorithms: tested against plain versions
@query()
def find_mentions(spark, d):
    s = I.samples(spark, d).select("item_id", "pos", M.find_mentions("text").alias("m"))
    return s.select("item_id", "pos", F.inline("m")).toDF("item_id", "pos", "num", "sub", "at", "act", "repeal_cue", "operative", "foreign_marker", "raw")


@query(sql("samples", """SELECT item_id, pos, CASE WHEN provision = (item_id % 7 + 1)::VARCHAR AND coalesce(act, 'IPC') = 'IPC' THEN true ELSE false END AS correct,
    CASE WHEN provision = (item_id % 7 + 1)::VARCHAR AND coalesce(act, 'IPC') = 'IPC' THEN 'gold' WHEN act IS NULL THEN 'other_provision' WHEN act = 'BNS' THEN 'premature_law' ELSE 'wrong_section' END AS label FROM samples"""))
def judge_verdicts(spark, d):
    s = I.samples(spark, d)
    v = M.judge_answers(F.col("text"), F.lit("IPC"), (F.col("item_id") % 7 + 1).cast("string"))
    return s.select("item_id", "pos", v.alias("v")).select("item_id", "pos", "v.correct", "v.label")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.lower().split())


def _alike(x: frozenset[str], y: frozenset[str]) -> float:
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


@query()
def greedy_clusters(spark, d):
    return fits.greedy_clusters(I.samples(spark, d), _alike, 0.8, _words)


@query()
def typed_clusters(spark, d):
    s = written(I.samples(spark, d), "samples")
    return fits.typed_clusters(s, A.with_scores(_ruled(spark, d, s), A.text_scores(s)), 0.5)


@query(sql("scored", f""", rows_ AS (SELECT slice, p AS x, correct FROM scored), {fit_sql.isotonic("rows_", "slice")}
SELECT slice, {R("x")} AS x, {R("y")} AS y FROM knots"""))
def isotonic_fit(spark, d):
    return fits.isotonic_maps(I.scored(spark, d).withColumn("x", F.col("p")), ["slice"])


@query(recursive(sql("scored", f""", rows_ AS (SELECT slice, p AS x, correct FROM scored), {fit_sql.platt("rows_", "slice")}
SELECT slice, {R("slope")} AS slope, {R("intercept")} AS intercept, n FROM lines""")))
def platt_fit(spark, d):
    return fits.platt_maps(I.scored(spark, d).withColumn("x", F.col("p")), ["slice"])


@query(
    sql(
        "scored",
        f""", groups_ AS (SELECT g, (row_number() OVER (ORDER BY sha256('5|' || g), g) - 1) % least(4, count(*) OVER ()) AS fold FROM (SELECT DISTINCT slice || '|' || topic AS g FROM scored)),
folded AS (SELECT item_id, slice, fold, p AS x, correct FROM scored JOIN groups_ ON g = slice || '|' || topic),
others AS (SELECT slice || '|' || o AS g, x, correct FROM folded, range(4) r(o) WHERE fold <> o),
enough AS (SELECT g FROM others GROUP BY g HAVING count(*) >= 10),
rows_ AS (SELECT * FROM others SEMI JOIN enough USING (g)), {fit_sql.isotonic("rows_", "g")}, {fit_sql.STRETCHES.format(by="g")}
SELECT item_id, slice, fold, {R(fit_sql.BETWEEN.format(x="f.x"))} AS p FROM folded f JOIN stretches t ON g = slice || '|' || fold AND f.x >= low AND f.x < high""",
    )
)
def cross_fit(spark, d):
    rows = risk.folds(I.scored(spark, d), F.concat_ws("|", "slice", "topic"), 4, 5).withColumn("x", F.col("p")).drop("p")
    return fits.cross_fit(rows, "slice", "fold", 4).select("item_id", "slice", "fold", "p")


@query(recursive(sql("scored", f""", rows_ AS (SELECT u, (n_chars % 17) / 17 AS v, u * ((n_chars % 17) / 17) AS uv, 1 - correct AS y FROM scored), {fit_sql.monotone("rows_", ["u", "v", "uv"])}
SELECT term, {R("weight")} AS weight FROM weights_""")))
def monotone_fit(spark, d):
    rows = I.scored(spark, d).select(F.col("u"), ((F.col("n_chars") % 17) / 17).alias("v"), (1 - F.col("correct")).alias("wrong"))
    bias, w = fits.fit_risk(rows, [F.col("u"), F.col("v"), F.col("u") * F.col("v")], "wrong")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate([bias, *w])], "term int, weight double")


@query()
def bootstrap_ci(spark, d):
    """AUROC by items and by whole topics, the difference of two scores of the same items, and the gaps of two slices."""
    rows = I.scored(spark, d).select("slice", "topic", "u", "correct", (F.round(F.col("n_chars") % 13) / 13).alias("v"))
    drawn = {
        "item": B.replicates(rows, B.auroc, ["u", "correct"], 200),
        "topic": B.replicates(rows, B.auroc, ["u", "correct"], 200, unit="topic"),
        "paired": B.replicates(rows, B.auroc_difference, ["u", "v", "correct"], 200),
        "paired by topic": B.replicates(rows, B.auroc_difference, ["u", "v", "correct"], 200, unit="topic"),
        "slices": B.replicates(rows, B.auroc_gap("en", "fr"), ["slice", "u", "correct"], 200, apart="slice"),
        "accuracy": B.replicates(rows, B.mean_gap("en", "fr"), ["slice", "correct"], 200, apart="slice"),
    }
    every = None
    for name, one in drawn.items():
        one = one.withColumn("what", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return C.replicate_summary(every, ["what"]).join(B.intervals(every, ["what"]).select("what", "p_le_zero", "excludes_zero"), "what")


@query(recursive(sql("scored", f""", hit AS (SELECT slice, sum(correct)::BIGINT AS hits, count(*) AS n FROM scored GROUP BY slice), {fit_sql.exact_low("hit", "slice")}
SELECT slice, hits, n, {R("exact_low")} AS exact_low FROM bounds""")))
def exact_bounds(spark, d):
    rows = I.scored(spark, d).groupBy("slice").agg(F.sum("correct").alias("hits"), F.count("*").alias("n"))
    return fits.exact_lower_bounds(rows, "hits", "n")


# Composition
@query(
    sql(
        "samples statutes counts pro modal warrant",
        FEATURES
        + f""", right_ AS (SELECT item_id, (avg(correct) >= 0.5)::INT AS correct FROM samples GROUP BY item_id),
s AS (SELECT item_id, CASE WHEN legal_complete THEN 1 / (1 + exp(-(-1 + 1.5 * u_prov + 0.5 * u_text + 0.8 * u_warrant + 0.3 * u_cm + 0.2 * u_contra + 0.7 * u_prov * u_warrant))) WHEN u_prov IS NOT NULL THEN 1 / (1 + exp(-(-1 + 1.5 * u_prov + 0.5 * u_text))) END AS score FROM g),
rows_ AS (SELECT item_id, (item_id % 3)::VARCHAR AS stratum, round(1 - score, 6) AS x, correct FROM s JOIN right_ USING (item_id)), {fit_sql.isotonic("rows_", "stratum")}, {fit_sql.STRETCHES.format(by="stratum")},
p AS (SELECT item_id, r.stratum, {fit_sql.BETWEEN.format(x="r.x")} AS p FROM rows_ r LEFT JOIN stretches t ON t.stratum = r.stratum AND r.x >= low AND r.x < high),
q AS (SELECT item_id, stratum, CASE WHEN x IS NULL OR NOT EXISTS (SELECT 1 FROM knots WHERE knots.stratum = rows_.stratum) THEN NULL ELSE p END AS p FROM rows_ JOIN p USING (item_id, stratum)),
l AS (SELECT *, (1 - p) * 3 AS loss, item_id % 7 = 0 AS flagged FROM q)
SELECT item_id, stratum, {R("p")} AS p, CASE WHEN p IS NULL THEN 'verify' WHEN loss <= 0.15 AND NOT flagged THEN 'answer' WHEN loss <= 0.35 THEN 'verify' ELSE 'abstain' END AS action,
       CASE WHEN p IS NULL THEN '{C.TRIGGERS[0]}' WHEN loss <= 0.15 AND flagged THEN '{C.TRIGGERS[1]}' WHEN loss <= 0.15 THEN '{C.TRIGGERS[2]}' WHEN loss <= 0.35 THEN '{C.TRIGGERS[3]}' ELSE '{C.TRIGGERS[4]}' END AS trigger FROM l""",
    )
)
def cascade_end_to_end(spark, d):
    """Samples -> context -> warrant -> risk score -> calibrated reliability -> action, an item a row; a seventh of all items is flagged."""
    s = written(I.samples(spark, d), "samples")
    scored = risk.estimate(risk.features(_records(spark, d, s)), -1.0, WEIGHTS, degraded=True)
    right = s.groupBy("item_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct"))
    rows = scored.join(right, "item_id").select("item_id", (F.col("item_id") % 3).cast("string").alias("stratum"), F.round(1 - F.col("score"), 6).alias("x"), "correct")
    rows = written(rows, "rows")
    fitted = maps.apply_maps(rows, maps.isotonic_registry(fits.isotonic_maps(rows, ["stratum"])), how="left")
    action, trigger = C.decide(F.col("p"), F.lit("both"), F.col("item_id") % 7 == 0)
    return fitted.select("item_id", "stratum", "p", action.alias("action"), trigger.alias("trigger"))


@query(sql("scored", f""", g AS (SELECT slice, count(*) AS n, avg(correct) AS a FROM scored GROUP BY 1) SELECT CASE WHEN min((n >= 30)::INT) = 0 OR min((a >= 0.5)::INT) = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, (sum((n >= 30)::INT) + sum((a >= 0.5)::INT))::BIGINT AS held FROM g"""))
def gate_rows(spark, d):
    g = I.scored(spark, d).groupBy("slice").agg(F.count("*").alias("n"), F.avg("correct").alias("a"))
    return E.gate(g.select(F.explode(F.array(F.struct(F.lit("size").alias("name"), (F.col("n") >= 30).alias("holds")), F.struct(F.lit("accuracy").alias("name"), (F.col("a") >= 0.5).alias("holds")))).alias("c")).select("c.*"))
