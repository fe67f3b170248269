"""The query catalogue: each operator on a stand-in among the tables at hand, with the SQL that gives the same rows.

Stand-ins: entity = user_id or o_custkey; role = event_type, o_orderpriority or l_returnflag; score = value or l_extendedprice; the last tie-break =
event_id or (l_orderkey, l_linenumber); labels = labels; bytes = documents.text; fingerprint = embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querncore.functions import ids, pages
from querncore.functions.numbers import clamp, efficiency, half_up, money, rate_pct
from querncore.operators import budgets, dedupe, evaluation, joins, ranking, sampling
from querncore.operators.percentiles import exact_percentiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")




def best_first():
    return [F.desc("value"), F.asc("event_id")]


# --- winners, queues, reserved places


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def top1_per_entity_role(spark, sf):
    return ranking.top(t(spark, sf, "events"), ["user_id", "event_type"], best_first()).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, value, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE value >= 40) WHERE rn <= 8""")
def top_k_with_floor(spark, sf):
    return ranking.top(t(spark, sf, "events"), ["user_id"], best_first(), 8, F.col("value") >= 40).select("user_id", "event_id", "value", "rank")


@query("""
WITH q AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'icon' WHEN 'view' THEN 'wide' WHEN 'purchase' THEN 'favicon' END AS queue, value FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS ord, row_number() OVER (PARTITION BY user_id, queue ORDER BY value DESC, event_id) AS inq FROM q WHERE queue IS NOT NULL),
b AS (SELECT *, inq <= CASE queue WHEN 'icon' THEN 6 WHEN 'wide' THEN 8 ELSE 4 END AS fits FROM a),
c AS (SELECT *, sum(CAST(fits AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS running FROM b),
d AS (SELECT *, CASE WHEN fits AND running <= 16 THEN 1 ELSE 2 END AS phase FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY phase, ord) AS place FROM d)
SELECT user_id, event_id, queue, CAST(phase AS INTEGER) AS phase, CAST(place AS INTEGER) AS place FROM e WHERE place <= 16""")
def capped_role_queue(spark, sf):
    e = t(spark, sf, "events").withColumn("queue", F.when(F.col("event_type") == "click", "icon").when(F.col("event_type") == "view", "wide").when(F.col("event_type") == "purchase", "favicon"))
    return ranking.capped_queues(e, ["user_id"], "queue", {"icon": 6, "wide": 8, "favicon": 4}, 16, best_first()).select("user_id", "event_id", "queue", "phase", "place")


@query("""
WITH a AS (SELECT *, event_type = 'purchase' AND value >= 50 AS el FROM events),
b AS (SELECT *, el AND row_number() OVER (PARTITION BY user_id, el ORDER BY value DESC, event_id) <= 2 AS reserved FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reserved DESC, value DESC, event_id) AS place FROM b)
SELECT user_id, event_id, reserved, CAST(place AS INTEGER) AS place FROM c WHERE place <= 8""")
def reserve_then_fill_top8(spark, sf):
    eligible = (F.col("event_type") == "purchase") & (F.col("value") >= 50)
    return ranking.reserve_then_fill(t(spark, sf, "events"), ["user_id"], eligible, 2, 8, best_first()).select("user_id", "event_id", "reserved", "place")


LINE = "l_orderkey * 10 + l_linenumber"


@query(f"""
WITH a AS (SELECT l_suppkey, l_returnflag, {LINE} AS line, l_extendedprice AS p, CASE WHEN l_discount >= 0.09 THEN 1 WHEN l_quantity >= 45 THEN 2 END AS tier FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY tier, p DESC, line) AS rn FROM a WHERE tier IS NOT NULL),
k AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)
SELECT k.l_suppkey, k.l_returnflag, b.line AS winner, CASE b.tier WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' ELSE 'none' END AS via FROM k LEFT JOIN b ON k.l_suppkey = b.l_suppkey AND k.l_returnflag = b.l_returnflag AND b.rn = 1""")
def winner_with_fallback(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("line", F.expr(LINE))
    return ranking.winner_with_fallback(rows, ["l_suppkey", "l_returnflag"], F.col("l_discount") >= 0.09, F.col("l_quantity") >= 45, [F.desc("l_extendedprice"), F.asc("line")], "line")


@query(f"""
WITH a AS (SELECT l_suppkey, {LINE} AS line, l_returnflag = 'N' AS weak, l_linestatus = 'F' AND l_discount >= 0.08 AS declared, l_tax >= 0.06 AS safe, l_tax = 0 AND l_quantity = 50 AS cor, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {LINE}) AS rn FROM lineitem),
b AS (SELECT l_suppkey, max(CASE WHEN rn = 1 THEN line END) AS w, bool_or(rn = 1 AND weak) AS weak, bool_or(rn = 1 AND safe) AS safe, arg_min(line, rn) FILTER (WHERE declared) AS d, bool_or(declared) AS has, bool_or(cor) AS cor FROM a GROUP BY l_suppkey),
c AS (SELECT *, CASE WHEN NOT weak OR NOT has THEN 'ranked' WHEN NOT safe OR cor THEN 'displaced' ELSE 'abstained' END AS action FROM b)
SELECT l_suppkey, CASE WHEN action = 'displaced' THEN d ELSE w END AS winner, action FROM c""")
def displacement_decision(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("line", F.expr(LINE))
    return ranking.displacement(rows, ["l_suppkey"], F.col("l_returnflag") == "N", (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.08), F.col("l_tax") >= 0.06, (F.col("l_tax") == 0) & (F.col("l_quantity") == 50), [F.desc("l_extendedprice"), F.asc("line")], "line")


#: Additive role scores of parts: m, what all start from; the rest by role.
CARD = """
WITH a AS (SELECT *, CASE p_brand WHEN 'Brand#1' THEN 30 WHEN 'Brand#2' THEN 22 WHEN 'Brand#3' THEN 12 ELSE 5 END + CASE WHEN p_name LIKE '%ring%' THEN 15 ELSE 0 END + CASE WHEN p_size >= 40 THEN 18 ELSE 0 END - CASE WHEN p_type = 'PROMO' THEN 35 ELSE 0 END AS m FROM part),
b AS (SELECT p_partkey, m + CASE WHEN p_size BETWEEN 10 AND 30 THEN 28 ELSE -12 END AS i, m + CASE WHEN p_size > 30 THEN 30 ELSE -18 END AS w, m + CASE WHEN p_size < 10 THEN 28 ELSE -22 END AS f FROM a),
c AS (SELECT p_partkey, CAST(least(greatest(i, 0), 100) AS DOUBLE) AS icon, CAST(least(greatest(w, 0), 100) AS DOUBLE) AS wide, CAST(least(greatest(f, 0), 100) AS DOUBLE) AS favicon FROM b)"""


def _card() -> dict:
    size, points = F.col("p_size"), lambda cond, yes, no=0: F.when(cond, yes).otherwise(no)
    brand = F.coalesce(F.create_map(*[F.lit(x) for kv in {"Brand#1": 30, "Brand#2": 22, "Brand#3": 12}.items() for x in kv])[F.col("p_brand")], F.lit(5))
    base = brand + points(F.col("p_name").contains("ring"), 15) + points(size >= 40, 18) + points(F.col("p_type") == "PROMO", -35)
    shapes = {"icon": points(size.between(10, 30), 28, -12), "wide": points(size > 30, 30, -18), "favicon": points(size < 10, 28, -22)}
    return {role: half_up(clamp((base + shape).cast("double"), 0.0, 100.0), 1) for role, shape in shapes.items()}


@query(f"{CARD} SELECT p_partkey, icon, wide, favicon FROM c")
def role_score_card(spark, sf):
    return t(spark, sf, "part").select("p_partkey", *(v.alias(k) for k, v in _card().items()))


@query(f"{CARD} SELECT p_partkey, 'icon' AS role FROM c WHERE icon >= 35 UNION ALL SELECT p_partkey, 'wide' FROM c WHERE wide >= 35 UNION ALL SELECT p_partkey, 'favicon' FROM c WHERE favicon >= 35")
def predicted_roles(spark, sf):
    roles = F.array_compact(F.array(*[F.when(v >= 35, k) for k, v in _card().items()]))
    return t(spark, sf, "part").select("p_partkey", F.explode(roles).alias("role"))


# --- duplicates, splits, samples


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_keep_priority(spark, sf):
    d = t(spark, sf, "documents").select("source", "doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return dedupe.keep_best(d, ["h"], [F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "n_chars")


@query("""SELECT h AS key, min(doc_id) AS survivor, count(*) AS members, string_agg(DISTINCT source, ',' ORDER BY source) AS "union" FROM (SELECT sha256(coalesce(text, '')) AS h, doc_id, source FROM documents) GROUP BY h""")
def dedupe_merge_sources(spark, sf):
    d = t(spark, sf, "documents")
    return dedupe.merge_into_survivor(d, F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id", F.coalesce(F.col("n_chars"), F.lit(0)), "source")


@query("""SELECT sha256(coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_hash_groups(spark, sf):
    return dedupe.duplicate_groups(t(spark, sf, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@query("""SELECT sha256(coalesce(text, '')) AS key, count(DISTINCT lang || CAST(doc_id % 3 AS VARCHAR)) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang || CAST(doc_id % 3 AS VARCHAR)) > 1""")
def split_leakage(spark, sf):
    d = t(spark, sf, "documents").withColumn("split", F.concat("lang", (F.col("doc_id") % 3).cast("string")))
    return dedupe.leakage(d, F.sha2(F.coalesce("text", F.lit("")), 256), "split")


@query("""
WITH a AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer),
b AS (SELECT *, row_number() OVER (ORDER BY sha256('seed-1' || chr(0) || id), id) - 1 AS ord, row_number() OVER (ORDER BY sha256('seed-1' || chr(0) || 'overlap' || chr(0) || id), id) - 1 AS o, count(*) OVER () AS n FROM a)
SELECT c_custkey, ord AS "at", CASE WHEN ord < floor(n * 0.6 + 0.5) THEN 'development' WHEN ord < floor(n * 0.6 + 0.5) + floor(n * 0.2 + 0.5) THEN 'validation' ELSE 'evaluation' END AS benchmark_split,
CAST(least(9, floor(ord / ceil(n / 10.0))) AS INTEGER) AS capture_shard, o < floor(n * 0.2 + 0.5) AS qa_overlap FROM b""")
def seeded_split_assignment(spark, sf):
    return sampling.assign_splits(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "seed-1")


@query("""SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS bucket, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 7 AS development FROM customer""")
def hash_mod_split(spark, sf):
    b = sampling.hash_bucket(F.col("c_custkey").cast("string"))
    return t(spark, sf, "customer").select("c_custkey", b.alias("bucket"), (b < 7).alias("development"))


@query("""SELECT c_mktsegment, c_custkey, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 100""")
def stratified_round_robin(spark, sf):
    return sampling.stratified_round_robin(t(spark, sf, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 100).select("c_mktsegment", "c_custkey", "turn")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY sha256('holdout' || chr(0) || CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)) <= 100 AS held_out FROM customer""")
def holdout_and_complement(spark, sf):
    return sampling.holdout(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "holdout", 100)


# --- aggregates and score cards


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def nearest_rank_percentiles(spark, sf):
    return evaluation.metrics(t(spark, sf, "events"), ["event_type"], "value").select("event_type", "p50", "p95")


@query("""SELECT event_type, count(value) AS available, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, floor(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) * 10 + 0.5) / 10 AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def metric_aggregate(spark, sf):
    return evaluation.metrics(t(spark, sf, "events"), ["event_type"], "value")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def taxonomy_counts(spark, sf):
    return evaluation.taxonomy(t(spark, sf, "events"), "event_type")


@query("""
WITH x AS (SELECT count(DISTINCT user_id) AS n, count(DISTINCT CASE WHEN value >= 20 THEN user_id END) AS r FROM events),
b AS (SELECT event_type, count(DISTINCT user_id) AS domains, count(*) AS candidates, count(DISTINCT CASE WHEN value >= 20 THEN user_id END) AS rd FROM events GROUP BY event_type)
SELECT event_type, domains, candidates, CASE WHEN n > 0 THEN floor(domains / n * 10000 + 0.5) / 100 END AS all_rate_pct, CASE WHEN r > 0 THEN floor(rd / r * 10000 + 0.5) / 100 END AS reachable_rate_pct FROM b, x""")
def role_coverage(spark, sf):
    return evaluation.role_coverage(t(spark, sf, "events"), "user_id", "event_type", F.col("value") >= 20)


@query("""
WITH s AS (SELECT coalesce(l.quality = 1, false) AS covered, l.quality = 1 AND coalesce(l.toxic, 0) = 0 AS correct, least(coalesce(d.n_chars, 0) / 4000.0, 1.0) AS usability, coalesce(l.toxic = 1, false) AS wrong, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT count(*) AS entities, sum(CASE WHEN covered THEN 1 ELSE 0 END) / count(*) AS coverage, sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) AS top1, CAST(sum(CAST(CASE WHEN correct THEN usability ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS usability, sum(CASE WHEN wrong THEN 1 ELSE 0 END) / count(*) AS wrong_rate, coalesce(bool_and(correct IS NOT NULL), false) AS complete, quantile_disc(n_chars, 0.95) AS p FROM s),
b AS (SELECT *, greatest(0.0, 1 - wrong_rate / 0.1) AS safety, CASE WHEN p <= 5000 THEN 1.0 WHEN p >= 20000 THEN 0.0 ELSE (20000.0 - p) / 15000.0 END AS efficiency FROM a)
SELECT entities, floor(coverage * 10000 + 0.5) / 10000 AS coverage, floor(top1 * 10000 + 0.5) / 10000 AS top1, floor(usability * 10000 + 0.5) / 10000 AS usability, floor(wrong_rate * 10000 + 0.5) / 10000 AS wrong_rate, floor(CAST(safety AS DOUBLE) * 10000 + 0.5) / 10000 AS safety, floor(CAST(efficiency AS DOUBLE) * 10000 + 0.5) / 10000 AS efficiency, complete,
CASE WHEN complete THEN floor((30 * coverage + 30 * top1 + 20 * usability + 10 * CAST(safety AS DOUBLE) + 10 * CAST(efficiency AS DOUBLE)) * 100 + 0.5) / 100 END AS value FROM b""")
def quality_score(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id")
    good = F.col("quality") == 1
    s = d.select(F.coalesce(good, F.lit(False)).alias("covered"), (good & (F.coalesce("toxic", F.lit(0)) == 0)).alias("correct"), F.least(F.coalesce("n_chars", F.lit(0)) / F.lit(4000.0), F.lit(1.0)).alias("usability"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("wrong"), "n_chars")
    p = exact_percentiles(s, [], "n_chars", {"p95": 0.95})
    return evaluation.score_card(s.join(F.broadcast(p), how="left"), efficiency(F.max("p95"), 5000, 20000))  # one row


@query("""SELECT event_type, k, CAST(grouping(event_type) * 2 + grouping(k) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, quantile_disc(value, 0.95) AS p95 FROM (SELECT event_type, user_id % 5 AS k, value FROM events) GROUP BY GROUPING SETS ((), (event_type), (k), (event_type, k))""")
def scores_grouping_sets(spark, sf):
    e = t(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("k"), "value")
    return evaluation.grouping_metrics(e, [[], ["event_type"], ["k"], ["event_type", "k"]], "value")


@query("""
WITH a AS (SELECT c_mktsegment, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,4)) AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, CAST(coalesce(sum(p) FILTER (WHERE o_orderstatus = 'F'), 0) - coalesce(sum(p) FILTER (WHERE o_orderstatus = 'O'), 0) AS DOUBLE) AS delta FROM a GROUP BY c_mktsegment""")
def cohort_delta(spark, sf):
    a = t(spark, sf, "orders").join(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, money(F.col("o_totalprice")))), F.lit(0).cast("decimal(28,4)"))
    return a.groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"), (total("F") - total("O")).cast("double").alias("delta"))


@query("""
WITH p AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b),
m AS (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (SELECT a AS v, n AS na, 0 AS nb FROM c UNION ALL SELECT b, 0, n FROM c) GROUP BY v),
s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(sum(CASE WHEN a = b THEN n END), 0) AS same, (SELECT coalesce(sum(na * nb), 0) FROM m) AS e FROM c)
SELECT n, CASE WHEN n > 0 AND e <> n * n THEN floor((same / n - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)) * 1000000 + 0.5) / 1000000 END AS kappa, CASE WHEN n = 0 THEN 'insufficient_data' WHEN e = n * n THEN 'single_category' ELSE 'computed' END AS status FROM s""")
def cohens_kappa(spark, sf):
    return evaluation.kappa(t(spark, sf, "labels"), "quality", "toxic")


@query("""
WITH a AS (SELECT doc_id, unnest(['lang', 'source']) AS field, unnest([lang, source]) AS v FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, unnest(['lang', 'source']) AS field, unnest([CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END, source]) AS v FROM documents WHERE doc_id % 5 <> 0)
SELECT field, count(*) FILTER (WHERE ha AND hb) AS compared, count(*) FILTER (WHERE ha AND hb AND va IS NOT DISTINCT FROM vb) AS agreements, count(*) FILTER (WHERE ha IS NULL) AS missing_a, count(*) FILTER (WHERE hb IS NULL) AS missing_b
FROM (SELECT coalesce(a.field, b.field) AS field, a.v AS va, b.v AS vb, CASE WHEN a.doc_id IS NOT NULL THEN true END AS ha, CASE WHEN b.doc_id IS NOT NULL THEN true END AS hb FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.field = b.field) GROUP BY field""")
def field_agreement(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "source")
    b = d.filter("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return evaluation.field_agreement(d.filter("doc_id % 3 <> 0"), b, "doc_id", ["lang", "source"])


@query("""SELECT quality AS expected, toxic AS judged, count(*) AS n, floor(count(*) / sum(count(*)) OVER (PARTITION BY toxic) * 10000 + 0.5) / 100 AS share_pct FROM labels GROUP BY quality, toxic""")
def confusion_precision(spark, sf):
    return evaluation.confusion(t(spark, sf, "labels"), "quality", "toxic")


_RUNS = """
WITH e AS (SELECT *, event_id % 2 AS half FROM events),
w AS (SELECT half, user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY half, user_id, event_type ORDER BY value DESC, event_id) AS rn FROM e) WHERE rn = 1),
a AS (SELECT user_id, event_type, event_id // 2 % 7 AS v FROM w WHERE half = 0), b AS (SELECT user_id, event_type, event_id // 2 % 7 AS v FROM w WHERE half = 1),
d AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.v AS before, b.v AS after, CASE WHEN a.user_id IS NULL THEN 'gained' WHEN b.user_id IS NULL THEN 'lost' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'stable' ELSE 'flipped' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)"""


def _runs(spark, sf):
    e = t(spark, sf, "events").withColumn("half", F.col("event_id") % 2)
    w = ranking.top(e, ["half", "user_id", "event_type"], best_first()).withColumn("v", F.expr("event_id div 2 % 7"))
    return evaluation.run_diff(w.filter("half = 0"), w.filter("half = 1"), ["user_id", "event_type"], "v")


@query(_RUNS + " SELECT user_id, event_type, before, after, change FROM d")
def run_diff_full_outer(spark, sf):
    return _runs(spark, sf)


@query(_RUNS + """ SELECT event_type, count(*) FILTER (WHERE change = 'gained') AS gained, count(*) FILTER (WHERE change = 'lost') AS lost, count(*) FILTER (WHERE change = 'gained') - count(*) FILTER (WHERE change = 'lost') AS net, count(*) FILTER (WHERE change = 'flipped') AS flipped, count(*) FILTER (WHERE change = 'stable') AS stable,
CASE WHEN count(*) FILTER (WHERE change IN ('flipped', 'stable')) > 0 THEN floor(count(*) FILTER (WHERE change = 'flipped') / count(*) FILTER (WHERE change IN ('flipped', 'stable')) * 10000 + 0.5) / 100 END AS flip_rate_pct FROM d GROUP BY event_type""")
def gain_loss_net(spark, sf):
    return evaluation.gain_loss(_runs(spark, sf), ["event_type"])


@query("""
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, source AS u, n_chars AS n FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE sha256(coalesce(text, '')) END AS h, CASE WHEN doc_id % 3 = 0 THEN 'moved' ELSE source END AS u, n_chars + doc_id % 5 - 2 AS n FROM documents WHERE doc_id % 13 <> 0),
d AS (SELECT doc_id FROM documents)
SELECT d.doc_id, CASE WHEN b.doc_id IS NULL AND a.doc_id IS NOT NULL THEN 'blocked_or_missing_retained' WHEN b.doc_id IS NULL THEN 'missing_unapproved' WHEN a.doc_id IS NULL THEN 'new_asset' WHEN a.h = b.h AND a.u = b.u THEN 'unchanged' WHEN a.h = b.h THEN 'equivalent_artwork_new_url' WHEN d.doc_id % 8 = 0 AND b.n > a.n THEN 'better_quality_same_artwork' WHEN d.doc_id % 8 = 0 THEN 'equivalent_artwork_new_bytes' ELSE 'possible_rebrand' END AS change
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""")
def change_classification(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "source", "n_chars")
    i = F.col("doc_id")
    before = d.filter(i % 11 != 0).select(i, F.col("h").alias("h0"), F.col("source").alias("u0"), F.col("n_chars").alias("s0"))
    after = d.filter(i % 13 != 0).select(i, F.when(i % 4 == 0, "other").otherwise(F.col("h")).alias("h1"), F.when(i % 3 == 0, "moved").otherwise(F.col("source")).alias("u1"), (F.col("n_chars") + i % 5 - 2).alias("s1"))
    both = d.select("doc_id").join(before, "doc_id", "left").join(after, "doc_id", "left")
    change = evaluation.change_class(F.col("h0").isNotNull(), F.col("h1").isNotNull(), F.col("h0") == F.col("h1"), F.col("u0").eqNullSafe(F.col("u1")), i % 8 == 0, F.col("s1") > F.col("s0"))
    return both.select("doc_id", change.alias("change"))


@query("""
WITH e AS (SELECT user_id, event_type, value >= 5 AS captured, value >= 20 AS eligible, value >= 60 AS selected, event_id % 3 = 0 AS correct FROM events),
f AS (SELECT user_id, event_type, bool_or(captured) AS c, bool_or(selected AND correct) AS hit, bool_or(selected) AS picked, bool_or(eligible AND correct) AS ok, bool_or(captured AND correct) AS there FROM e GROUP BY user_id, event_type)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT c THEN 'capture_failure' WHEN hit THEN 'selected_correct' WHEN ok AND picked THEN 'ranking_miss' WHEN ok THEN 'selection_miss' WHEN there THEN 'eligibility_miss' ELSE 'no_captured_candidate' END AS outcome FROM f) GROUP BY outcome""")
def role_loss_taxonomy(spark, sf):
    v = F.col("value")
    out = evaluation.loss_taxonomy(t(spark, sf, "events"), ["user_id", "event_type"], v >= 5, v >= 5, v >= 20, v >= 60, F.col("event_id") % 3 == 0)
    return evaluation.taxonomy(out, "outcome")


# --- joins and checks


@query("""SELECT doc_id, 'left' AS missing_in FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def exact_cover_violations(spark, sf):
    return joins.cover_violations(t(spark, sf, "documents"), t(spark, sf, "labels"), ["doc_id"])


@query("""
SELECT 'lineitem.order' AS rule, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 17 <> 0) GROUP BY l_orderkey
UNION ALL SELECT 'lineitem.part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY l_partkey
UNION ALL SELECT 'lineitem.supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) GROUP BY l_suppkey""")
def fk_violations(spark, sf):
    line = t(spark, sf, "lineitem")
    out = joins.foreign_key_violations(line, "l_orderkey", t(spark, sf, "orders").filter("o_orderkey % 17 <> 0"), "o_orderkey", "lineitem.order")
    for child, parent, key, rule in (("l_partkey", "part", "p_partkey", "lineitem.part"), ("l_suppkey", "supplier", "s_suppkey", "lineitem.supplier")):
        out = out.unionByName(joins.foreign_key_violations(line, child, t(spark, sf, parent), key, rule))
    return out


HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"


@query(f"""SELECT alias, min(owner) AS owner FROM (SELECT regexp_replace({HOST}, '^www[.]', '') AS alias, regexp_extract(url, '^([A-Za-z]+)://', 1) AS owner FROM pages) GROUP BY alias HAVING count(DISTINCT owner) = 1""")
def alias_index_unambiguous(spark, sf):
    return joins.unambiguous_aliases(t(spark, sf, "pages"), pages.domain(F.col("url")), F.regexp_extract("url", "^([A-Za-z]+)://", 1))


@query(f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace({HOST}, '^www[.]', '') AS domain, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query,
lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || regexp_replace({HOST}, '^www[.]', '') || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS normalized FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return t(spark, sf, "pages").select("page_id", pages.scheme(u).alias("scheme"), pages.domain(u).alias("domain"), pages.path(u).alias("path"), pages.query(u).alias("query"), pages.normalized(u).alias("normalized"))


@query("""SELECT page_id, CAST(place - 1 AS INTEGER) AS place, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) + 1)) AS place FROM pages)""")
def anchor_extract(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("place", "href"))


@query("""SELECT page_id, CAST(CASE WHEN regexp_matches(s, 'press[-_ ]*kit|media[-_ ]*kit|brand[-_ ]*(asset|toolkit)|logo') THEN 4 WHEN regexp_matches(s, 'press|media|brand|newsroom') THEN 3 WHEN regexp_matches(s, '(^|[/_-])news($|[/?#_-])') THEN 2 WHEN regexp_matches(s, 'company|about') THEN 1 ELSE 0 END AS INTEGER) AS priority FROM (SELECT page_id, lower(url || ' ' || coalesce(html, '')) AS s FROM pages)""")
def page_link_priority(spark, sf):
    return t(spark, sf, "pages").select("page_id", pages.link_priority(F.concat("url", F.lit(" "), F.coalesce("html", F.lit("")))).alias("priority"))


@query(r"""
WITH a AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '[.][a-z0-9]{1,8}$', '') AS p FROM pages),
b AS (SELECT *, list_filter(string_split(p, '/'), lambda s: s <> '') AS seg FROM a),
c AS (SELECT *, len(seg) AS n, list_has_any(seg, ['brand', 'branding', 'logo', 'logos']) AS focused, list_filter(seg, lambda s: s IN ('newsroom', 'press', 'media', 'company', 'about', 'corporate'))[1] AS token,
regexp_matches(p, '(^|[-_/])(brand(ing)?[-_/](asset|center|guideline|resource|toolkit)|press[-_/]kit|media[-_/]kit|logo[-_/](asset|download|file|kit)|visual[-_/]identity)s?($|[-_/])') AS named,
len(seg) <= 4 AND len(list_filter(seg, lambda s: regexp_matches(s, '^(brand[-_])?style[-_]guide$'))) > 0 AS guide FROM b),
d AS (SELECT *, named OR focused OR guide AS strong, list_position(seg, token) - 1 AS spot, token IN ('newsroom', 'press', 'media') AS news FROM c)
SELECT page_id, CAST(CASE WHEN strong THEN 100 - CASE WHEN n > 3 AND NOT focused THEN 30 ELSE 0 END WHEN regexp_matches(p, '(^|[-_/])(newsroom|press|media)[-_/](information|resource|asset|download|about|contact)($|[-_/])') THEN 80
WHEN token IS NULL THEN 0 WHEN NOT news THEN 25 WHEN spot > 1 OR n - spot - 1 > 0 THEN 15 ELSE 80 END
- CASE WHEN NOT strong AND len(list_filter(seg, lambda s: regexp_matches(s, '^(article|author|blog|careers?|jobs?|events?|legal|privacy|products?|customers?|partners?|support|store|shop|docs?|documentation|developers?|api)$'))) > 0 THEN 45 ELSE 0 END
- CASE WHEN NOT named AND regexp_matches(p, '/(19|20)\d\d/(0?[1-9]|1[0-2])(/|$)') THEN 30 ELSE 0 END - CASE WHEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) <> '' THEN 5 ELSE 0 END AS INTEGER) AS score FROM d""")
def page_url_score(spark, sf):
    return t(spark, sf, "pages").select("page_id", pages.page_url_score(F.col("url")).alias("score"))


@query("""
WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '[?].*$', ''), '[_-][0-9]{2,4}x[0-9]{2,4}([.][A-Za-z0-9]+)$', '\\1'), '@[23]x([.][A-Za-z0-9]+)$', '\\1') AS base, list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(w|h|width|height|size|s|dpr|q|quality|fit|resize|format|fm)(=|$)')) AS kept FROM a)
SELECT base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS family, count(*) AS n, min(page_id) AS first FROM b GROUP BY 1""")
def family_key_groups(spark, sf):
    return t(spark, sf, "pages").groupBy(pages.family_url(F.col("url")).alias("family")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def title_meta_extract(spark, sf):
    x = lambda p: F.regexp_extract("html", p, 1)
    return t(spark, sf, "pages").select("page_id", x("<title>([^<]*)</title>").alias("title"), x('<html lang="([^"]*)"').alias("lang"), x('<meta charset="([^"]*)"').alias("charset"))


_TXT = ["v=BIMI1; l=https://a.example.com/x.svg; a=", "v=BIMI1; l=", "v=BIMI1", "l=https://a.example.com/x.svg; v=BIMI1", "v=BIMI2; l=https://a.example.com/x.svg", "v=BIMI1; l=http://a.example.com/x.svg", "v=BIMI1; l=x.svg", "v=BIMI1; v=BIMI1; l=https://a.example.com/x.svg", "nonsense", "", "v=BIMI1; l=https://u:p@a.example.com/x.svg", "V=bimi1; L=https://b.example.com/y.svg;"]


def _txt_sql(x: str) -> str:
    key = "lower(regexp_extract(s, '^[ ]*([A-Za-z][A-Za-z0-9_-]*)', 1))"
    return f"""
WITH r AS (SELECT nation.n_nationkey AS k, [{', '.join(repr(v) for v in _TXT)}][nation.n_nationkey % {len(_TXT)} + 1] AS raw FROM nation),
a AS (SELECT *, list_filter(string_split(raw, ';'), lambda s: trim(s) <> '') AS parts FROM r),
b AS (SELECT *, list_transform(parts, lambda s: {key}) AS keys, len(list_filter(parts, lambda s: NOT regexp_matches(s, '^[ ]*[A-Za-z][A-Za-z0-9_-]*[ ]*='))) AS bad,
trim(regexp_extract(coalesce(list_filter(parts, lambda s: {key} = 'l')[1], ''), '=(.*)$', 1)) AS logo, trim(regexp_extract(coalesce(list_filter(parts, lambda s: {key} = 'v')[1], ''), '=(.*)$', 1)) AS v FROM a)
SELECT k, CASE WHEN raw = '' OR bad > 0 THEN 'malformed_record' WHEN len(list_distinct(keys)) < len(keys) THEN 'duplicate_tag' WHEN keys[1] IS DISTINCT FROM 'v' THEN 'version_not_first' WHEN upper(v) <> 'BIMI1' THEN 'not_bimi1' WHEN NOT list_contains(keys, 'l') THEN 'missing_logo_location' WHEN logo = '' THEN 'empty_logo_location' WHEN NOT regexp_matches(logo, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'invalid_logo_url' WHEN NOT regexp_matches(logo, '^[Hh][Tt][Tt][Pp][Ss]://[^/@:?#]+([/?#]|$)') THEN 'unsafe_logo_url' ELSE 'ok' END AS status FROM b"""


@query(_txt_sql(""))
def txt_record_parse(spark, sf):
    raw = F.array(*map(F.lit, _TXT))[(F.col("n_nationkey") % len(_TXT)).cast("int")]
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), pages.txt_record(raw).alias("status"))


_ROBOTS = ["User-agent: *\\nSitemap: https://a.example.com/s.xml\\nsitemap : https://a.example.com/t.xml # x", "Disallow: /", "SITEMAP: https://b.example.com/1.xml\\nSitemap: https://b.example.com/1.xml\\nSitemap: https://b.example.com/2.xml"]


@query(f"""
WITH r AS (SELECT n_nationkey AS k, replace([{', '.join(repr(v).replace(chr(92) * 2, chr(92)) for v in _ROBOTS)}][n_nationkey % 3 + 1], '\\n', chr(10)) AS raw FROM nation),
a AS (SELECT k, list_filter(list_transform(string_split(raw, chr(10)), lambda s: regexp_extract(s, '^[ ]*[Ss][Ii][Tt][Ee][Mm][Aa][Pp][ ]*:[ ]*([^ #]+)', 1)), lambda s: s <> '') AS found FROM r),
b AS (SELECT k, unnest(found) AS url, unnest(range(1, len(found) + 1)) AS ord FROM a), c AS (SELECT k, url, min(ord) AS ord FROM b GROUP BY k, url)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS INTEGER) AS place, url FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) <= 8""")
def robots_sitemaps(spark, sf):
    raw = F.array(*[F.lit(v.replace("\\n", "\n")) for v in _ROBOTS])[(F.col("n_nationkey") % 3).cast("int")]
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(pages.robots_sitemaps(raw)).alias("place", "url"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'invalid' WHEN o_orderstatus = 'F' THEN 'ended' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'future' WHEN o_orderdate + INTERVAL 900 DAY <= TIMESTAMP '1998-01-01' THEN 'ended' ELSE 'current' END AS state FROM orders""")
def validity_asof_now(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "5-LOW", "deprecated").otherwise("normal")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    state = joins.validity(rank, start, start + F.expr("INTERVAL 900 DAYS"), F.col("o_orderstatus") == "F", F.lit(False), F.lit("1998-01-01").cast("timestamp_ntz"))
    return t(spark, sf, "orders").select("o_orderkey", state.alias("state"))


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS pref, o_orderstatus AS v FROM orders), b AS (SELECT *, max(CAST(pref AS INTEGER)) OVER (PARTITION BY o_custkey) AS best FROM a)
SELECT o_custkey, count(DISTINCT v) AS files, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS chosen, count(DISTINCT v) > 1 AS ambiguous FROM b WHERE CAST(pref AS INTEGER) = best GROUP BY o_custkey""")
def preferred_rank_unique(spark, sf):
    return joins.preferred_then_unique(t(spark, sf, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", "o_orderstatus")


@query("""SELECT x.p_brand, x.p_type, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey WHERE abs(x.p_size - y.p_size) <= greatest(4.0, 0.12 * greatest(x.p_size, y.p_size)) AND abs(x.p_retailprice - y.p_retailprice) <= greatest(4.0, 0.12 * greatest(x.p_retailprice, y.p_retailprice))""")
def near_dimension_twin(spark, sf):
    return joins.near_pairs(t(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice", "p_size", "p_partkey")


@query("""
WITH f AS (SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT AS fp FROM embeddings), c AS (SELECT vec_id AS o, fp AS f FROM f WHERE vec_id < 64),
m AS (SELECT f.vec_id, c.o, bit_count(xor(f.fp, c.f)) AS d, row_number() OVER (PARTITION BY f.vec_id ORDER BY c.o) AS rn FROM f JOIN c ON bit_count(xor(f.fp, c.f)) <= 8)
SELECT f.vec_id, m.o AS match, CAST(m.d AS INTEGER) AS distance FROM f LEFT JOIN m ON f.vec_id = m.vec_id AND m.rn = 1""")
def fingerprint_hamming(spark, sf):
    # hashes); every row of the table is matched
    f = t(spark, sf, "embeddings").select("vec_id", joins.sign_bits("embedding").alias("fp"))
    return joins.catalog_match(f, "fp", f.filter("vec_id < 64"), "fp", "vec_id", 8).select("vec_id", "match", "distance")


@query("""SELECT d.doc_id, c.item_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 4 <> 0) d JOIN (SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS item_id FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) c ON d.h = c.h""")
def known_hash_catalog(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    catalog = d.filter("doc_id % 4 = 0").groupBy("h").agg(F.min("doc_id").alias("item_id"))
    return d.filter("doc_id % 4 <> 0").join(catalog, "h").select("doc_id", "item_id")


# --- budgets, windows, ages


@query("""SELECT user_id, event_id, CAST(spent AS DOUBLE) AS spent FROM (SELECT user_id, event_id, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 500""")
def budget_running_cutoff(spark, sf):
    return budgets.within_budget(t(spark, sf, "events"), ["user_id"], F.col("value"), [F.asc("event_id")], 500).select("user_id", "event_id", "spent")


@query("""SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, least(n, 3) AS allowed, greatest(n - 3, 0) AS refused FROM (SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)""")
def fixed_window_limit(spark, sf):
    out = budgets.aligned_limit(t(spark, sf, "events"), "user_id", "ts", "hour", 3)
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT o_orderkey, CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 365 THEN 'stale' ELSE 'miss' END AS state FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS age FROM orders)""")
def freshness_state(spark, sf):
    age = F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t(spark, sf, "orders").select("o_orderkey", budgets.freshness(age, 30, 365).alias("state"))


@query("""SELECT c_custkey, 'target-' || lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, ch: (xor(h, ch) * 16777619) & 4294967295))), 8, '0') AS target FROM customer""")
def fnv1a_ids(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", ids.review_id("target-", F.col("c_name")).alias("target"))


@query("""SELECT event_id, left(sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type || chr(0) || CAST(event_id AS VARCHAR)), 16) AS candidate, 'candidate-' || left(sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type), 24) AS captured FROM events""")
def candidate_ids(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_type")
    return t(spark, sf, "events").select("event_id", ids.candidate_id(u, e, F.col("event_id").cast("string")).alias("candidate"), ids.captured_id(u, e).alias("captured"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_project(spark, sf):
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * 100 AS DECIMAL(20,0)) * CAST(l_quantity AS DECIMAL(10,0))) AS DOUBLE) / 100 AS cost, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def priced_usage(spark, sf):
    cents = (F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.sum(cents * F.col("l_quantity").cast("decimal(10,0)")).cast("double") / 100).alias("cost"), F.count("*").alias("n"))


@query("""SELECT event_type || ':' || CASE WHEN value < 1 THEN 'blocked' WHEN value < 10 THEN 'timeout' ELSE 'other' END AS failure, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1""")
def failure_ledger(spark, sf):
    kind = F.when(F.col("value") < 1, "blocked").when(F.col("value") < 10, "timeout").otherwise("other")
    e = t(spark, sf, "events").filter(F.col("event_type").isin("error", "view"))
    return evaluation.taxonomy(e.withColumn("failure", F.concat("event_type", F.lit(":"), kind)), "failure")


@query("""
SELECT user_id, CASE WHEN bool_or(k = 'blocked') THEN 'blocked' WHEN bool_and(k = 'dns') THEN 'dns' WHEN count(*) FILTER (WHERE k = 'timeout') >= 2 THEN 'timeout' WHEN bool_or(k = 'redirect') THEN 'redirect' ELSE arg_max(k, event_id) END AS outcome
FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN CASE WHEN value < 2 THEN 'blocked' ELSE 'dns' END WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'redirect' ELSE 'other' END AS k FROM events) GROUP BY user_id""")
def failure_aggregation(spark, sf):
    k = F.when(F.col("event_type") == "error", F.when(F.col("value") < 2, "blocked").otherwise("dns")).when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "click", "redirect").otherwise("other")
    e = t(spark, sf, "events").withColumn("k", k)
    outcome = F.when(F.bool_or(F.col("k") == "blocked"), "blocked").when(F.every(F.col("k") == "dns"), "dns").when(F.count_if(F.col("k") == "timeout") >= 2, "timeout").when(F.bool_or(F.col("k") == "redirect"), "redirect").otherwise(F.max_by("k", "event_id"))
    return e.groupBy("user_id").agg(outcome.alias("outcome"))


@query("""
SELECT 'acctbal_negative' AS rule, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'segment_unknown', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
UNION ALL SELECT 'name_not_unique', c_name FROM customer GROUP BY c_name HAVING count(*) > 1
UNION ALL SELECT 'nation_missing', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def validation_rules(spark, sf):
    from querncore.operators.quality import in_set, reference, satisfies, unique, violations

    rules = [satisfies("acctbal_negative", "c_custkey", F.col("c_acctbal") >= 0), in_set("segment_unknown", "c_custkey", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]), unique("name_not_unique", "c_name"), reference("nation_missing", "c_custkey", "c_nationkey", t(spark, sf, "nation"), "n_nationkey")]
    return violations(t(spark, sf, "customer"), rules)


@query("""
WITH s AS (SELECT user_id, bool_or(event_type = 'click') AS icon FROM events GROUP BY user_id), l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT e.event_id, CASE WHEN e.event_type = 'click' THEN 'icon' WHEN e.event_type = 'signup' AND NOT s.icon THEN 'icon' ELSE e.event_type END AS slot, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'wrong' WHEN l.quality = 1 THEN 'correct' ELSE 'ambiguous' END AS verdict
FROM events e JOIN s ON e.user_id = s.user_id LEFT JOIN l ON l.doc_id = e.event_id""")
def slot_adjudication(spark, sf):
    from querncore.operators.labels import adjudicate_slots

    events = t(spark, sf, "events").withColumn("role", F.when(F.col("event_type") == "click", "icon").otherwise(F.col("event_type")))
    verdict = F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 1, "correct").otherwise("ambiguous")
    return adjudicate_slots(events, t(spark, sf, "labels"), "user_id", "event_id", "role", "doc_id", verdict, own="icon", stand_in="signup")


@query("""SELECT d.doc_id, role, coalesce(CASE role WHEN 'quality' THEN l.quality ELSE l.toxic END = 1, false) AS correct, l.doc_id IS NULL AS omitted FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS role FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def omitted_negative_expansion(spark, sf):
    from querncore.operators.labels import expand_omitted

    return expand_omitted(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


# --- set operations, unions, rows only


@query("""SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(list(CASE WHEN event_id % 2 = 1 THEN event_type END)), lambda r: NOT list_contains(list_filter(list(CASE WHEN event_id % 2 = 0 THEN event_type END), lambda z: z IS NOT NULL), r))), ',') AS gained FROM events GROUP BY user_id""")
def paired_role_gain(spark, sf):
    odd = F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type")))
    even = F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return t(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_except(odd, even)), ",").alias("gained"))


@query("""SELECT k AS id, count(*) AS tables, string_agg(t, ',' ORDER BY t) AS found_in FROM (SELECT CAST(r_regionkey AS VARCHAR) AS k, 'region' AS t FROM region UNION SELECT CAST(n_nationkey AS VARCHAR), 'nation' FROM nation UNION SELECT CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier) GROUP BY k""")
def union_of_ids(spark, sf):
    k = lambda name, col: t(spark, sf, name).select(F.col(col).cast("string").alias("id"), F.lit(name).alias("t"))
    u = k("region", "r_regionkey").unionByName(k("nation", "n_nationkey")).unionByName(k("supplier", "s_suppkey")).distinct()
    return u.groupBy("id").agg(F.count("*").alias("tables"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("found_in"))  # three tables at most


@query("""SELECT o_custkey, files AS names FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS files FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) WHERE files >= 2""")
def agreeing_signals(spark, sf):
    return t(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("names")).filter("names >= 2")


@query()
def html_candidates(spark, sf):
    """Rows only: every candidate, link and title of the pages, by a real parser."""
    from querncore.sources.html import parse_pages

    return parse_pages(t(spark, sf, "pages"))


@query()
def first_event_limit(spark, sf):
    """Rows only: windows that open at a user's first event."""
    e = t(spark, sf, "events").select("user_id", "event_id", "ts")
    return budgets.first_event_limit(e, "user_id", "ts", "event_id", 600.0, 3)


@query()
def visual_variant_greedy(spark, sf):
    """Rows only: greedy choice of variants, which depends on what was kept before."""
    e = t(spark, sf, "events").select("user_id", "event_id", F.concat("event_type", F.col("event_id") % 9).alias("asset"), F.floor("value").alias("signature"))
    return dedupe.greedy_variants(e, ["user_id"], "asset", "signature", "event_id")


@query()
def sheet_packing(spark, sf):
    """Rows only: sequential packing."""
    o = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch"), (F.col("o_custkey") % 200).alias("entity"), "o_orderkey")
    return dedupe.pack_sheets(o, "batch", "entity", "o_orderkey")


@query()
def lru_cache_replay(spark, sf):
    """Rows only: a cache with time to live and byte limit over each shard's accesses in order."""
    e = t(spark, sf, "events").select((F.col("user_id") % 16).alias("shard"), F.concat("event_type", F.col("event_id") % 37).alias("key"), F.col("event_id").cast("double").alias("at"), (F.col("value") * 10).cast("long").alias("bytes"))
    return budgets.cache_replay(e, "shard", "key", "at", "bytes", 500.0, 4000)


@query("""
WITH a AS (SELECT user_id, event_id AS s, event_id + CAST(floor(value) AS BIGINT) * 20 AS e FROM events),
b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR s >= p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT user_id, min(s) AS fetch_start, max(e) AS fetch_end, count(*) AS requests FROM c GROUP BY user_id, g""")
def request_coalescing(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + F.floor("value") * 20).alias("e"))
    return budgets.coalesced(e, "user_id", "s", "e")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return quality_score(spark, sf)
