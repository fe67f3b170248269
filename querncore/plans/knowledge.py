"""The lookup in a knowledge base, on stand-ins: a domain for each customer, hits from orders, claims and files from customers. Both engines read the same tables;
the lookup is written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.operators import knowledge
from querncore.plans.catalogue import query, t

C, O = "c_custkey", "o_custkey"
URLS = ["'https://www.d' || c || '.com/'", "'http://d' || c || '.com'", "'https://de.d' || c || '.com/de-at'", "'https://shop.d' || c || '.com/'", "'https://d' || c || '.com/music'", "'https://about.d' || c || '.com/Index.html'", "'https://d' || c || '.com/?q=1'", "'ftp://d' || c || '.com/'", "'https://www.d' || c || '.com/About-Us'", "'https://u@d' || c || '.com/'", "'https://zz.d' || c || '.com/'", "'https://www.d' || c || '.com/company/'"]
URL = "CASE c % 12 " + " ".join(f"WHEN {k} THEN {u}" for k, u in enumerate(URLS)) + " END"
CLAIM = "{e} AS entity, '{p}' AS property, '{s}' || c AS statement, {rank} AS rank, {value} AS value, {start} AS start_time, CAST(9 AS INT) AS start_precision, {end} AS end_time, CAST(11 AS INT) AS end_precision, {point} AS point_in_time, {cause} AS end_cause"
PLAIN = {"rank": "'normal'", "start": "CAST(NULL AS STRING)", "end": "CAST(NULL AS STRING)", "point": "false", "cause": "false"}
FROM_CUSTOMER = "SELECT {} FROM (SELECT c_custkey AS c FROM customer){}"
CLAIMS = " UNION ALL ".join(
    FROM_CUSTOMER.format(CLAIM.format(**(PLAIN | told)), where)
    for told, where in [
        ({"e": "'Q' || c", "p": "P856", "s": "w", "value": URL}, ""),
        ({"e": "'Q' || c", "p": "P856", "s": "x", "value": "'https://www.d' || c || '.com/'", "rank": "CASE WHEN c % 7 = 0 THEN 'preferred' ELSE 'deprecated' END", "end": "CASE WHEN c % 14 = 0 THEN '+2001-05-01T00:00:00Z' END"}, " WHERE c % 3 <> 1"),
        ({"e": "'Q' || (c + 1000000)", "p": "P856", "s": "y", "value": "'https://d' || c || '.com/'"}, " WHERE c % 13 = 0"),
        ({"e": "'Q' || c", "p": "P154", "s": "l", "value": "'Mark ' || c || '.svg'", "start": "CASE WHEN c % 10 = 0 THEN '+2090-00-00T00:00:00Z' END", "cause": "c % 19 = 0"}, " WHERE c % 23 <> 0"),
        ({"e": "'Q' || c", "p": "P154", "s": "m", "value": "'File:mark_' || c || '.SVG '", "point": "c % 5 = 0"}, " WHERE c % 4 = 0"),
        ({"e": "'Q' || c", "p": "P154", "s": "n", "value": "'Other ' || c || '.png'"}, " WHERE c % 17 = 0"),
    ]
)
TABLES = {
    "asked": "SELECT 'd' || c_custkey || '.com' AS domain, CASE c_custkey % 3 WHEN 0 THEN array('icon') WHEN 1 THEN array('icon', 'wide') ELSE array('wide', 'favicon') END AS roles FROM customer",
    "hits": "SELECT 'd' || o_custkey || '.com' AS domain, CASE WHEN o_orderkey % 3 = 0 THEN 'Q' || o_custkey WHEN o_orderkey % 3 = 1 AND o_custkey % 26 = 0 THEN 'Q' || (o_custkey + 1000000) ELSE 'Q' || (o_orderkey + 5000000) END AS entity, CAST(o_orderkey AS BIGINT) AS place FROM orders",
    "site_hits": "SELECT 'd' || c_custkey || '.com' AS domain, 'Q' || (CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END) AS entity FROM customer WHERE c_custkey % 5 <> 0",
    "site_searches": "SELECT 'd' || c_custkey || '.com' AS domain, c_custkey % 11 = 0 AS truncated FROM customer",
    "claims": CLAIMS,
    "files": """SELECT CASE WHEN c_custkey % 6 = 0 THEN 'File:New mark ' || c_custkey || '.svg' ELSE 'File:Mark_' || c_custkey || '.svg' END AS title, CAST(NULL AS STRING) AS redirect_to, CASE WHEN c_custkey % 31 = 0 THEN 'http://upload.wikimedia.org/x.svg' ELSE 'https://upload.wikimedia.org/wikipedia/commons/' || c_custkey || '.svg' END AS url,
  'https://commons.wikimedia.org/wiki/File:' || c_custkey AS description_url, CAST(CASE WHEN c_custkey % 4 = 1 THEN 400 ELSE 100 END AS INT) AS width, CAST(100 AS INT) AS height, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'PD' END AS license_name, CAST(NULL AS STRING) AS license_url, 'public' AS usage_terms FROM customer WHERE c_custkey % 37 <> 0
UNION ALL SELECT 'File:Mark ' || c_custkey || '.svg', 'File:New_mark ' || c_custkey || '.svg', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM customer WHERE c_custkey % 6 = 0""",
}
MOST = 12
LANGUAGES = ["de", "en", "fr"]
SQL_TABLES = ", ".join(f"{n} AS ({q.replace('array(', 'list_value(').replace('STRING', 'VARCHAR')})" for n, q in TABLES.items())


@query(rf"""
WITH {SQL_TABLES},
i AS (SELECT *, try_cast(substr(start_time, 2, 4) || '-01-01' AS DATE) AS s, try_cast(substr(end_time, 2, 10) AS DATE) AS e FROM claims),
cur AS (SELECT * FROM i WHERE rank <> 'deprecated' AND NOT end_cause AND NOT coalesce(s > DATE '2020-06-01', false) AND NOT coalesce(e < DATE '2020-06-01', false) AND NOT (point_in_time AND s IS NULL AND e IS NULL)),
best AS (SELECT * FROM cur QUALIFY (rank = 'preferred') = bool_or(rank = 'preferred') OVER (PARTITION BY entity, property)),
w AS (SELECT DISTINCT entity, regexp_extract(value, '([^./@]+[.]com)', 1) AS domain FROM best WHERE property = 'P856' AND regexp_matches(value, '^https?://((www|corporate|company|about|(de|en|fr)(-[a-z][a-z])?)[.])?d[0-9]+[.]com(/((de|en|fr)(-[a-z][a-z])?|[Aa]bout(-[Uu]s)?|[Cc]ompany|[Cc]orporate|([Ii]ndex|[Dd]efault)[.][a-zA-Z0-9]+)?/?)?$')),
lg AS (SELECT entity, count(*) AS n_files, min(file) AS file, arg_min(st, file) AS statements FROM (SELECT entity, lower(trim(replace(regexp_replace(trim(value), '^[Ff]ile:', ''), '_', ' '))) AS file, list(statement ORDER BY statement) AS st FROM best WHERE property = 'P154' GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT domain, entity, row_number() OVER (PARTITION BY domain ORDER BY min(place), entity) AS rn FROM hits GROUP BY 1, 2),
m1 AS (SELECT domain, count(*) AS n, min(entity) AS e FROM h JOIN w USING (domain, entity) WHERE rn <= {MOST} GROUP BY 1),
m2 AS (SELECT domain, count(*) AS n, min(entity) AS e FROM (SELECT DISTINCT domain, entity FROM site_hits) JOIN w USING (domain, entity) GROUP BY 1),
d AS (SELECT a.domain, a.roles, coalesce((SELECT count(*) FROM h WHERE h.domain = a.domain), 0) AS n_named, CASE WHEN m1.n IS NULL THEN coalesce((SELECT count(*) FROM site_hits s WHERE s.domain = a.domain), 0) ELSE 0 END AS n_wide, coalesce(m1.n, m2.n, 0) AS n, CASE WHEN m1.n IS NOT NULL THEN m1.e ELSE m2.e END AS e, m1.n IS NULL AND ss.truncated AS cut
  FROM asked a LEFT JOIN m1 USING (domain) LEFT JOIN m2 USING (domain) JOIN site_searches ss USING (domain)),
f AS (SELECT lower(replace(substr(x.title, 6), '_', ' ')) AS key, coalesce(y.url, x.url) AS url, coalesce(y.width, x.width) AS width, coalesce(y.height, x.height) AS height, coalesce(y.license_name, x.license_name) AS license_name, x.redirect_to IS NULL OR y.url IS NOT NULL AS there FROM files x LEFT JOIN files y ON lower(replace(x.redirect_to, '_', ' ')) = lower(replace(y.title, '_', ' '))),
g AS (SELECT d.*, lg.n_files, lg.file, lg.statements, f.url, f.there, f.license_name, list_filter(roles, lambda r: r = 'wide' OR (r = 'icon' AND CAST(f.width AS DOUBLE) / f.height BETWEEN 0.72 AND 1.4)) AS good FROM d LEFT JOIN lg ON lg.entity = d.e AND d.n = 1 LEFT JOIN f ON f.key = lg.file),
r AS (SELECT *, CASE WHEN cut THEN 'search_candidates_truncated' WHEN n_named + n_wide = 0 THEN 'no_search_candidates' WHEN n_named > {MOST} AND n = 1 THEN 'search_candidates_truncated' WHEN n > 1 THEN 'ambiguous_entities' WHEN n = 0 THEN 'no_verified_current_logo' WHEN n_files > 1 THEN 'ambiguous_logo_claims' WHEN n_files IS NULL THEN 'no_verified_current_logo'
  WHEN NOT coalesce(there, false) OR url LIKE 'http:%' OR license_name = '' OR len(good) = 0 THEN 'unsafe_or_missing_file' ELSE 'ok' END AS status FROM g)
SELECT domain, status, CASE status WHEN 'ambiguous_entities' THEN 'multiple_domain_matches' WHEN 'no_verified_current_logo' THEN CASE WHEN n = 0 THEN 'no_domain_match' ELSE 'no_current_logo_claim' END WHEN 'unsafe_or_missing_file' THEN CASE WHEN NOT coalesce(there, false) THEN 'missing_page' WHEN url LIKE 'http:%' THEN 'unsafe_url' WHEN license_name = '' THEN 'insufficient_license' ELSE 'incompatible_role' END END AS reason,
CASE WHEN status IN ('ok', 'unsafe_or_missing_file') THEN e END AS entity, CASE WHEN status IN ('ok', 'unsafe_or_missing_file') THEN array_to_string(statements, ',') END AS statements, CASE WHEN status = 'ok' THEN url END AS url, CASE WHEN status = 'ok' THEN array_to_string(list_sort(good), ',') END AS roles FROM r""")
def knowledge_lookup(spark, sf):
    base = {n: t(spark, sf, n) for n in ("customer", "orders")}
    told = {n: spark.sql(q.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), **{k: v for k, v in base.items() if f"FROM {k}" in q}) for n, q in TABLES.items()}
    suffixes = spark.createDataFrame([("com",), ("org",)], "rule string")
    out = knowledge.lookup(**told, suffixes=suffixes, now=F.to_date(F.lit("2020-06-01")), most=MOST, languages=LANGUAGES)
    return out.select("domain", "status", "reason", "entity", F.array_join("statements", ",").alias("statements"), "url", F.array_join("eligible_roles", ",").alias("roles"))
