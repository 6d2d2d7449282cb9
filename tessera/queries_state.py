"""Histories, three-way merges, discovery and table functions, beside SQL that goes step by step."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import mean_segment
from tessera.operators import baseline, discover, history, stats
from tessera.queries_rules import table
from tessera.sources import functions
from tessera.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


_EVENT = "CASE event_type WHEN 'signup' THEN 'propose' WHEN 'view' THEN 'accept' WHEN 'click' THEN 'reject' WHEN 'purchase' THEN 'apply' WHEN 'error' THEN 'fail' END"
_MOVES = ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in history.RECORD_MOVES.items())


@query(f"""
WITH RECURSIVE m(s, e, t) AS (VALUES {_MOVES}),
n AS (SELECT user_id, {_EVENT} AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r(user_id, i, state, refused) AS (
  SELECT DISTINCT user_id, 0::BIGINT, '', 0::BIGINT FROM n
  UNION ALL
  SELECT r.user_id, n.i, coalesce(m.t, r.state), r.refused + (m.t IS NULL)::BIGINT
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1 LEFT JOIN m ON m.s = r.state AND m.e = n.e)
SELECT user_id, arg_max(state, i) AS state, max(i) AS n_events, max(refused) AS n_refused FROM r GROUP BY user_id
""")
def record_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that users' events lead to, taken as moves of a proposed record."""
    return history.fold_events(table(spark, sf_dir, "events").withColumn("e", F.expr(_EVENT)), "user_id", "event_id", "e", bits=8)


_OURS = "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN n > 12 THEN 'BUSY' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, 'ours' FROM supplier WHERE s_suppkey % 3 <> 0"
_THEIRS = "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN n > 20 THEN 'BUSY' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'ours' ELSE 'theirs' END FROM supplier WHERE s_suppkey % 3 <> 1"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers; customers of whom some went, were renamed or became busy, and suppliers; the same with other ones and debts."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    k, name, segment, i = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("s_suppkey")
    c = c.join(n, k == F.col("k"), "left").drop("k")
    shape = lambda df, a, b, d: df.select(a.alias("k"), b.alias("name"), d.alias("segment"))
    base = shape(c, k, name, segment)
    ours = shape(c.filter(k % 7 != 0), k, F.when(k % 5 == 0, F.upper(name)).otherwise(name), F.when(F.col("n") > 12, "BUSY").otherwise(segment))
    theirs = shape(c.filter(k % 11 != 0), k, F.when(k % 4 == 0, F.upper(name)).otherwise(name), F.when(F.col("c_acctbal") < 0, "DEBT").when(F.col("n") > 20, "BUSY").otherwise(segment))
    ours = ours.unionByName(shape(s.filter(i % 3 != 0), i + 1000000, F.col("s_name"), F.lit("ours")))
    theirs = theirs.unionByName(shape(s.filter(i % 3 != 1), i + 1000000, F.col("s_name"), F.when(i % 2 == 0, "ours").otherwise("theirs")))
    return base, ours, theirs


def _field(f: str) -> str:
    return f"""CASE WHEN NOT bp AND NOT op THEN t_{f} WHEN NOT op AND NOT tp THEN b_{f} WHEN NOT op AND t_same THEN b_{f} WHEN NOT op THEN t_{f} WHEN NOT tp AND bp AND o_same THEN b_{f} WHEN NOT tp THEN o_{f}
         WHEN o_{f} = b_{f} THEN t_{f} ELSE o_{f} END"""


_MERGED = f"""
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), o AS ({_OURS}), t AS ({_THEIRS}), b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer),
k AS (SELECT k FROM b UNION SELECT k FROM o UNION SELECT k FROM t),
x AS (
  SELECT k.k, b.k IS NOT NULL AS bp, o.k IS NOT NULL AS op, t.k IS NOT NULL AS tp, b.name AS b_name, o.name AS o_name, t.name AS t_name, b.segment AS b_segment, o.segment AS o_segment, t.segment AS t_segment
  FROM k LEFT JOIN b ON b.k = k.k LEFT JOIN o ON o.k = k.k LEFT JOIN t ON t.k = k.k),
y AS (
  SELECT *, coalesce(bp = op AND (NOT bp OR (o_name = b_name AND o_segment = b_segment)), false) AS o_same, coalesce(bp = tp AND (NOT bp OR (t_name = b_name AND t_segment = b_segment)), false) AS t_same,
         coalesce(op = tp AND (NOT op OR (o_name = t_name AND o_segment = t_segment)), false) AS agreed FROM x),
z AS (
  SELECT *, CASE WHEN o_same OR t_same OR agreed THEN '' WHEN NOT op OR NOT tp THEN 'row'
      ELSE array_to_string(list_filter(['name', 'segment'], lambda f: CASE f WHEN 'name' THEN o_name <> t_name AND (NOT bp OR (o_name <> b_name AND t_name <> b_name))
        ELSE o_segment <> t_segment AND (NOT bp OR (o_segment <> b_segment AND t_segment <> b_segment)) END), ',') END AS conflicts FROM y),
w AS (
  SELECT k, {_field("name")} AS name, {_field("segment")} AS segment, bp AND ((NOT op AND (t_same OR NOT tp)) OR (NOT tp AND o_same)) AS is_gone, conflicts,
         CASE WHEN conflicts <> '' THEN 'conflict' WHEN NOT o_same AND NOT t_same THEN 'both' WHEN NOT o_same THEN 'ours' WHEN NOT t_same THEN 'theirs' ELSE 'unchanged' END AS change, op, o_name, o_segment FROM z)"""


@query(f"WITH {_MERGED} SELECT k, name, segment, is_gone, conflicts, change FROM w")
def versions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of customers, with removed, renamed, added and differently changed rows."""
    return baseline.merge_three(*_versions(spark, sf_dir), "k", ["name", "segment"]).withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"""
WITH {_MERGED}, p AS (SELECT bool_or(l_returnflag NOT IN ('A', 'R')) AS refused FROM lineitem)
SELECT k, CASE WHEN refused AND op THEN o_name ELSE name END AS name, CASE WHEN refused AND op THEN o_segment ELSE segment END AS segment, CASE WHEN refused THEN NOT op ELSE is_gone END AS is_gone,
       CASE WHEN refused THEN '' ELSE conflicts END AS conflicts, CASE WHEN refused AND change IN ('theirs', 'both', 'conflict') THEN 'refused' ELSE change END AS change, refused AS was_refused FROM w, p
""")
def baseline_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while line items wait for review (all but those returned or accepted are settled): nothing moves."""
    status = F.when(F.col("l_returnflag") == "A", "applied").when(F.col("l_returnflag") == "R", "rejected").otherwise("needs_review")
    out = baseline.refreshed(*_versions(spark, sf_dir), table(spark, sf_dir, "lineitem").select(status.alias("status")), "k", ["name", "segment"])
    return out.withColumn("conflicts", F.array_join("conflicts", ","))


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' || p_type ELSE '' END AS e, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' ' WHEN 2 THEN ' ' ELSE p_brand END AS v FROM part)
SELECT p_partkey, coalesce(trim(v), trim(e), 'seed') AS baseline_status, coalesce(nullif(coalesce(trim(v), trim(e), ''), ''), 'http://w.example') AS baseline_source_url,
       coalesce(nullif(trim(e), ''), 'main') AS baseline_branch, coalesce(trim(v), '') AS baseline_commit, '' AS baseline_updated_at, coalesce(trim(e), '') AS baseline_error FROM x
""")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of parts: what is there, what is laid over it, and defaults."""
    k = F.col("p_partkey")
    e = F.when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_type"))).when(k % 3 == 2, "")
    v = F.when(k % 5 == 1, F.concat(F.col("p_name"), F.lit(" "))).when(k % 5 == 2, " ").when(k % 5 != 0, F.col("p_brand"))
    defaults = {f: F.lit("") for f in baseline.MANIFEST} | {"baseline_status": F.lit("seed"), "baseline_source_url": F.lit("http://w.example"), "baseline_branch": F.lit("main")}
    existing = {f: e for f in ("baseline_status", "baseline_source_url", "baseline_branch", "baseline_error")}
    state = baseline.manifest_state(defaults, existing, {f: v for f in ("baseline_status", "baseline_source_url", "baseline_commit")})
    return table(spark, sf_dir, "part").select(k, *[c.alias(f) for f, c in state.items()])


_HEAD = "lower(regexp_extract(regexp_extract(html, '<h1>(.*?)</h1>', 1), '^[^ ]*'))"


@query(f"""
WITH RECURSIVE l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS w FROM pages), h AS (SELECT page_id, {_HEAD} AS w FROM pages),
e AS (SELECT l.page_id AS a, h.page_id AS b FROM l JOIN h USING (w)),
r(page_id, round) AS (
  SELECT min(page_id), 0 FROM pages GROUP BY regexp_extract(html, 'lang="([^"]*)"', 1)
  UNION
  SELECT b, round + 1 FROM r JOIN e ON a = page_id WHERE round < 40)
SELECT page_id, min(round) AS round FROM r GROUP BY page_id
""")
def pages_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that menus lead to from the first page of each language: a menu's word leads to the pages whose heading begins with it."""
    pages = table(spark, sf_dir, "pages")
    words = pages.select(F.col("page_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1))).alias("via"))
    heads = pages.select(F.lower(F.regexp_extract(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), "^[^ ]*", 0)).alias("via"), F.col("page_id").alias("target"))
    seeds = pages.groupBy(F.regexp_extract("html", 'lang="([^"]*)"', 1)).agg(F.min("page_id").alias("page_id"))
    return discover.discovered_through(seeds, words, heads, "page_id")


@query("""
SELECT page_id, (place - 1)::INT AS place, href, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS address
FROM (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS l FROM pages)) x
""")
def links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, by the table function html_links in SQL."""
    functions.register(spark)
    return spark.sql("SELECT page_id, place, href, address FROM {p}, LATERAL html_links(html, url)", p=table(spark, sf_dir, "pages"))


@query("""
WITH o AS (SELECT user_id::VARCHAR AS url, event_type AS lastmod, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS prev FROM events),
k AS (SELECT url, lastmod, ts FROM o WHERE prev IS NULL OR ts > prev),
l AS (SELECT *, lag(ts) OVER w AS last, lag(lastmod) OVER w AS version FROM k WINDOW w AS (PARTITION BY url ORDER BY ts))
SELECT url, lastmod, ts AS seen_at, CASE WHEN last IS NULL OR ts - last > INTERVAL 8 HOURS THEN 'new' ELSE 'modified' END AS change FROM l WHERE last IS NULL OR ts - last > INTERVAL 8 HOURS OR lastmod <> version
""")
def versions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream with keyed state reports of users' events, as versions that are forgotten after eight hours."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("lastmod"), F.col("ts").cast("timestamp").alias("at"))
    return keyed.changes_in_order(rows, timedelta(hours=8)).select("url", "lastmod", F.col("at").cast("timestamp_ntz").alias("seen_at"), "change")


@query("""
SELECT p_partkey AS "Key", p_name AS "Title", p_type AS "Type" FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 100
""")
def works_of_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred parts (the table's limit is the feature) of a facet, in chosen columns under their labels."""
    kind = F.when(F.col("p_type") == "PROMO", "Single channel video").otherwise(F.col("p_type"))
    works = table(spark, sf_dir, "part").withColumn("type", kind)
    labels = {"p_partkey": "Key", "p_name": "Title", "p_type": "Type", "p_none": "None", "type": "Facet"}
    return stats.works_shown(works, labels, "Video (12)", ["p_partkey", "p_name", "p_type", "p_none"], "p_partkey")


@query("""
WITH b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O')
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS batch_id, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'needs_review' ELSE 'ready_for_review' END END AS status
FROM lineitem WHERE l_orderkey IN (SELECT id FROM b) AND l_returnflag <> 'R'
""")
def records_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that wait for review in orders that are not finished."""
    status = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linenumber") % 2 == 0, "needs_review").otherwise("ready_for_review")
    records = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("batch_id"), status.alias("status"))
    done = F.when(F.col("o_orderstatus") == "O", "reviewing").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), done.alias("status"))
    rollup = records.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n"))
    return stats.pending_listed(batches, records, rollup, {"mode": F.lit("manual")})[2]


@query(r"""
SELECT doc_id, list_sum(list_transform(string_split_regex(coalesce(text, ''), '[,，]'), lambda p: length(regexp_replace(p, '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g'))))::DOUBLE / len(string_split_regex(coalesce(text, ''), '[,，]')) AS mean
FROM documents
""".replace("\\\\", "\\"))
def segments_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average length of the parts that commas make of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", mean_segment("text").alias("mean"))
