"""The engine's inputs made of the driver's tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated answers: a part's line items in order, each citing a section of an act."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    act = F.when(F.col("l_returnflag") == "R", "IPC").when(F.col("l_returnflag") == "A", "BNS")
    number = F.col("l_linenumber").cast("string")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_partkey").alias("item_id"), (F.row_number().over(order) - 1).alias("pos"),
        F.concat(F.lit("Section "), number, F.lit(" of the "), F.coalesce(act, F.lit("Code"))).alias("text"), F.coalesce(F.concat(act, F.lit(" "), number), F.lit("NONE")).alias("key"),
        act.alias("act"), number.alias("provision"), (F.col("l_linestatus") == "O").cast("int").alias("correct"), act.isNotNull().cast("int").alias("resolved"),
        (act == "IPC").cast("int").alias("repealed_flag"), F.coalesce((act == "IPC").cast("int"), F.lit(0)).alias("repealed"), F.coalesce(act, F.lit("unresolved")).alias("verdict"), (-F.col("l_discount")).alias("logprob"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records: labelled documents; u from the length, p = 1 - u, harm class from the source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    u = (F.col("n_chars") % 101) / F.lit(100.0)
    harm = F.element_at(F.array(*map(F.lit, ("custodial", "both", "definition", "procedural"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("slice"), F.col("source").alias("topic"), u.alias("u"), (1 - u).alias("p"), F.col("quality").alias("correct"), "toxic", "n_chars", harm.alias("harm"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals: a customer's orders, each valid until the next."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("begin"), F.lead("o_orderdate").over(w).alias("end"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of probes: an event's user, on a day drawn from its id within the orders' years."""
    day = F.call_function("dateadd", F.lit("1995-01-01").cast("date"), (F.col("event_id") % 1500).cast("int")).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), day.alias("day"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared links: nations of one region, the smaller key first, of one type or the other."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.alias("a"), n.alias("b")
    met = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    kind = F.when((F.col("a.n_nationkey") + F.col("b.n_nationkey")) % 2 == 0, "successor_of").otherwise("different_offence")
    return met.select(F.col("a.n_nationkey").alias("from"), F.col("b.n_nationkey").alias("to"), kind.alias("type"))


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of both acts: a part of them with subsections, none for section 7 of either."""
    old = "SELECT concat('IPC ', id) AS statute, timestamp'1862-01-01' AS begin, timestamp'1997-07-01' AS end FROM range(1, 5)"
    new = "SELECT concat('BNS ', id, if(id % 2 = 0, '(1)', '')) AS statute, timestamp'1997-07-01' AS begin, cast(null AS timestamp) AS end FROM range(1, 7)"
    return spark.sql(f"{old} UNION ALL {new}")


def part_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statutes a part: of the old act until 1997-07-01, of the new one since, the even ones as a subsection."""
    k = F.col("p_partkey")
    old = F.struct(F.concat(F.lit("IPC "), k).alias("statute"), F.lit("1862-01-01").cast("timestamp").alias("begin"), F.lit("1997-07-01").cast("timestamp").alias("end"))
    new = F.struct(F.concat(F.lit("BNS "), k, F.when(k % 2 == 0, "(1)").otherwise("")), F.lit("1997-07-01").cast("timestamp"), F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.inline(F.array(old, new.cast("struct<statute:string,begin:timestamp,end:timestamp>"))))


def statute_links(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT concat('IPC ', id) AS `from`, concat('BNS ', id) AS `to` FROM range(1, 4)")


#: The same in DuckDB.
CTE = {
    "samples": """samples AS (SELECT l_partkey AS item_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
        'Section ' || l_linenumber || ' of the ' || coalesce(a, 'Code') AS text, coalesce(a || ' ' || l_linenumber, 'NONE') AS key, a AS act, l_linenumber::VARCHAR AS provision,
        (l_linestatus = 'O')::INT AS correct, (a IS NOT NULL)::INT AS resolved, coalesce((a = 'IPC')::INT, 0) AS repealed, coalesce(a, 'unresolved') AS verdict, -l_discount AS logprob
        FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'IPC' WHEN 'A' THEN 'BNS' END AS a FROM lineitem))""",
    "scored": """scored AS (SELECT d.doc_id AS item_id, d.doc_id AS ord, lang AS slice, source AS topic, (n_chars % 101) / 100.0::DOUBLE AS u, 1 - (n_chars % 101) / 100.0::DOUBLE AS p, quality AS correct, toxic, n_chars,
        ['custodial', 'both', 'definition', 'procedural'][d.doc_id % 4 + 1] AS harm, [5.0, 3.0, 1.5, 1.0][d.doc_id % 4 + 1]::DOUBLE AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "intervals": """intervals AS (SELECT o_custkey AS key, o_orderkey AS ord, o_orderkey AS value, o_orderdate AS "begin", lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "end" FROM orders)""",
    "probes": """probes AS (SELECT event_id, user_id AS key, (DATE '1995-01-01' + (event_id % 1500)::INT)::TIMESTAMP AS day FROM events)""",
    "links": """links AS (SELECT a.n_nationkey AS "from", b.n_nationkey AS "to", CASE WHEN (a.n_nationkey + b.n_nationkey) % 2 = 0 THEN 'successor_of' ELSE 'different_offence' END AS type
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)""",
    "statutes": """statutes AS (SELECT 'IPC ' || i AS statute, TIMESTAMP '1862-01-01' AS "begin", TIMESTAMP '1997-07-01' AS "end" FROM range(1, 5) t(i)
        UNION ALL SELECT 'BNS ' || i || CASE WHEN i % 2 = 0 THEN '(1)' ELSE '' END, TIMESTAMP '1997-07-01', NULL FROM range(1, 7) t(i))""",
    "part_statutes": """part_statutes AS (SELECT p_partkey AS k, 'IPC ' || p_partkey AS statute, TIMESTAMP '1862-01-01' AS "begin", TIMESTAMP '1997-07-01' AS "end" FROM part
        UNION ALL SELECT p_partkey, 'BNS ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '(1)' ELSE '' END, TIMESTAMP '1997-07-01', NULL FROM part)""",
    "resolved": """resolved AS (SELECT s.*, coalesce(x.statute, y.statute) AS statute, coalesce(x."begin", y."begin") AS "begin", CASE WHEN x.statute IS NULL THEN y."end" ELSE x."end" END AS "end"
        FROM samples s LEFT JOIN statutes x ON s.key = x.statute LEFT JOIN (SELECT split_part(statute, '(', 1) AS b, min(statute) AS statute, min("begin") AS "begin", min("end") AS "end" FROM statutes GROUP BY 1) y ON s.key = y.b)""",
    "counts": "counts AS (SELECT item_id, key, count(*) AS c FROM samples GROUP BY ALL)",
    "pro": """pro AS (SELECT item_id, sum(c) AS n, count(*) AS n_keys, max(c) / sum(c) AS top_share, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy, arg_min(key, (-c, key)) AS majority FROM counts GROUP BY 1)""",
    "curve": """curve AS (SELECT *, row_number() OVER w AS k, sum(1 - correct) OVER w AS errors, sum(1 - correct) OVER w / row_number() OVER w AS risk FROM scored
        WINDOW w AS (PARTITION BY slice ORDER BY u, ord ROWS UNBOUNDED PRECEDING))""",
    "modal": """modal AS (SELECT item_id, sum(c) AS m, count(*) AS n_clusters, arg_min(key, (-c, key)) AS modal_key, max(c) AS c FROM counts GROUP BY 1)""",
    "warrant": """slinks AS (SELECT 'IPC ' || i AS x, 'BNS ' || i AS y FROM range(1, 4) t(i) UNION ALL SELECT 'BNS ' || i, 'IPC ' || i FROM range(1, 4) t(i)),
        st AS (SELECT coalesce(a.statute, b.statute) AS statute, m.item_id, coalesce(a."begin", b."begin") AS "begin", CASE WHEN a.statute IS NULL THEN b."end" ELSE a."end" END AS "end" FROM modal m LEFT JOIN statutes a ON m.modal_key = a.statute
            LEFT JOIN (SELECT split_part(statute, '(', 1) AS k, min(statute) AS statute, min("begin") AS "begin", min("end") AS "end" FROM statutes GROUP BY 1) b ON m.modal_key = b.k),
        warrant AS (SELECT m.item_id, m.modal_key, m.c / m.m AS a, CASE WHEN st."begin" IS NOT NULL THEN (st."begin" <= TIMESTAMP '1998-01-01' AND (st."end" IS NULL OR TIMESTAMP '1998-01-01' < st."end"))::INT::DOUBLE END AS t,
            CASE WHEN m.modal_key <> 'NONE' THEN 1.0::DOUBLE END AS j, coalesce((SELECT sum(c.c) FROM counts c JOIN slinks l ON l.y = c.key WHERE c.item_id = m.item_id AND l.x = m.modal_key), 0) / m.m AS k, m.n_clusters
            FROM modal m JOIN st USING (item_id))""",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
