"""The registered queries over the analytical tables, each beside its SQL.

Every query applies one or a few operators to whole tables. The tables stand in
for a code index: order lines are call sites (order calls part), documents are
files, events are changes, page URLs are paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import scalar as S
from quarrylight.operators import batches, calls, delta, graph, imports, retention, rollup, search, taint
from quarrylight.plans import code_catalog, scale_catalog  # noqa: F401 - they register their queries
from quarrylight.plans.registry import ORACLE, QUERIES, load, query, spread
from quarrylight.scratch import settle
from quarrylight.sources.extract import extract
from quarrylight.streaming import debounce

__all__ = ["ORACLE", "QUERIES"]

# --- graph -----------------------------------------------------------------


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 42)
""")
def callers_of(spark, d):
    out = graph.callers_of(load(spark, d, "lineitem"), load(spark, d, "orders"), 42, "l_orderkey", "l_partkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return out.orderBy("o_orderkey")


@query("SELECT l_partkey, count(*)::BIGINT AS fan_in FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey")
def fan_in_counts(spark, d):
    return graph.fan_in(load(spark, d, "lineitem"), "l_partkey")


@query("""
SELECT p_partkey, p_name, coalesce(n, 0)::BIGINT AS fan_in, coalesce(n, 0) > 40 AS compressed
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
""")
def fan_in_compressed(spark, d):
    counts = graph.fan_in(load(spark, d, "lineitem"), "l_partkey").withColumnRenamed("l_partkey", "p_partkey")
    n = F.coalesce("fan_in", F.lit(0)).cast("long")
    return load(spark, d, "part").select("p_partkey", "p_name").join(counts, "p_partkey", "left").select("p_partkey", "p_name", n.alias("fan_in"), (n > 40).alias("compressed"))


@query("""
SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS used_by, count(*)::BIGINT AS used_by_count
FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey <> l_orderkey) GROUP BY l_partkey
""")
def reverse_edges_sorted(spark, d):
    out = graph.reverse_edges(load(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return out.select("l_partkey", F.array_join(F.col("used_by").cast("array<string>"), ",").alias("used_by"), "used_by_count")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS caller_id, l_suppkey AS callee_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT c_custkey AS node, c_nationkey AS grp FROM customer),
x AS (
  SELECT DISTINCT i.grp, callee_id, caller_id FROM e JOIN m i ON i.node = callee_id LEFT JOIN m h ON h.node = caller_id
  WHERE i.grp IS DISTINCT FROM h.grp
), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY caller_id, callee_id) AS pos FROM x)
SELECT grp, callee_id, caller_id, pos::INT AS pos FROM r WHERE pos <= 8
""")
def external_callers(spark, d):
    edges = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("caller_id"), F.col("l_suppkey").alias("callee_id"))
    members = load(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("grp"))
    return graph.external_callers(edges, members, "caller_id", "callee_id", "node", "grp", 8)


@query("""
WITH x AS (SELECT DISTINCT l_orderkey, p_name, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name NULLS FIRST, p_partkey NULLS FIRST) AS pos FROM x)
SELECT l_orderkey, p_name, p_partkey, pos::INT AS pos FROM r WHERE pos <= 15
""")
def call_targets_limited(spark, d):
    edges = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_name", "p_partkey")
    return graph.call_targets(edges, "l_orderkey", ["p_name", "p_partkey"], 15)


def part_graph(spark, d) -> DataFrame:
    """Consecutive parts of an order: distinct edges without loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = load(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return line.filter("dst IS NOT NULL AND src <> dst").distinct()


def centrality_sql(select: str) -> str:
    steps = "".join(
        f""", s{i} AS (
  SELECT n.node, 0.15 / (SELECT count(*) FROM part) + coalesce(g.given, 0) AS score
  FROM n LEFT JOIN (SELECT e.dst, sum(s.score * 0.85 / e.deg) AS given FROM w e JOIN s{i - 1} s ON s.node = e.src GROUP BY e.dst) g ON g.dst = n.node)"""
        for i in range(1, 6)
    )
    return f"""
WITH l AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem
), e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND src <> dst),
w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM e),
n AS (SELECT p_partkey AS node FROM part),
s0 AS (SELECT node, CASE WHEN node = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM n)
{steps}
{select}
"""


@query(centrality_sql("SELECT node, round(score, 9) AS score FROM s5"))
def seeded_centrality(spark, d):
    nodes = load(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.seeded_centrality(nodes, part_graph(spark, d), 7).select("node", F.round("score", 9).alias("score"))


@query(
    centrality_sql("""
, c AS (SELECT dst AS node FROM e WHERE src = 7 UNION SELECT src FROM e WHERE dst = 7),
f AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst)
SELECT c.node, round(s5.score, 6) AS score, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_in, 0) > 15 AS compressed
FROM c JOIN s5 ON s5.node = c.node LEFT JOIN f ON f.node = c.node ORDER BY round(s5.score, 9) DESC, c.node LIMIT 12
""")
)
def ranked_dependents(spark, d):
    """Flagship: the best-ranked neighbours of a node, with fan-in compression."""
    edges = settle(part_graph(spark, d), "part-graph")
    nodes = load(spark, d, "part").select(F.col("p_partkey").alias("node"))
    near = edges.filter("src = 7").select(F.col("dst").alias("node")).unionByName(edges.filter("dst = 7").select(F.col("src").alias("node"))).distinct()
    fan = graph.fan_in(edges, "dst").withColumnRenamed("dst", "node")
    return graph.ranked_dependents(graph.seeded_centrality(nodes, edges, 7), near, fan)


@query("""
WITH changed AS (SELECT p_partkey AS id FROM part WHERE p_size = 1),
h AS (SELECT l_orderkey AS caller_id, max(l_partkey) AS taint_source FROM lineitem JOIN changed ON id = l_partkey GROUP BY 1),
p AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT caller_id, taint_source, coalesce(n, 0)::BIGINT AS priority FROM h LEFT JOIN p ON l_partkey = caller_id
""")
def one_hop_taint(spark, d):
    edges = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("caller_id"), F.col("l_partkey").alias("callee_id"))
    changed = load(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return taint.one_hop_taint(changed, edges)


@query("""
WITH gone AS (SELECT p_partkey AS id FROM part WHERE p_size = 2),
h AS (SELECT l_suppkey AS caller_id, max(l_partkey) AS taint_source FROM lineitem JOIN gone ON id = l_partkey GROUP BY 1),
p AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT caller_id, taint_source, coalesce(n, 0)::BIGINT AS priority FROM h LEFT JOIN p ON l_partkey = caller_id
WHERE caller_id IN (SELECT p_partkey FROM part WHERE p_size <> 2)
""")
def removed_snapshot_taint(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller_id"), F.col("l_partkey").alias("callee_id"))
    return taint.removed_taint(part, part.filter("p_size <> 2"), edges)


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS a, (c_custkey // 3)::BIGINT AS b FROM customer WHERE c_custkey <> c_custkey // 3),
c(node, ancestor, distance) AS (
  SELECT a, b, 1 FROM p UNION ALL SELECT c.node, p.b, c.distance + 1 FROM c JOIN p ON p.a = c.ancestor
)
SELECT node, ancestor, min(distance)::INT AS distance FROM c GROUP BY 1, 2
""")
def ancestor_closure(spark, d):
    parents = load(spark, d, "customer").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    return graph.ancestor_closure(parents, "child", "parent")


@query("""
WITH r AS (
  SELECT s_suppkey AS k, c_custkey AS v, 1 AS rule FROM supplier JOIN customer ON c_custkey = s_suppkey * 100 AND c_nationkey = s_nationkey
  UNION ALL SELECT s_suppkey, c_custkey, 2 FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'
  UNION ALL SELECT s_suppkey, c_custkey, 3 FROM supplier JOIN customer ON c_custkey = s_suppkey
), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rule, v) AS n FROM r)
SELECT s_suppkey AS k, v, rule::INT AS rule FROM supplier LEFT JOIN x ON k = s_suppkey AND n = 1
""")
def rule_cascade(spark, d):
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    pair = lambda on, c=c: s.join(c, on).select(F.col("s_suppkey").alias("k"), F.col("c_custkey").alias("v"))
    same = F.col("c_nationkey") == F.col("s_nationkey")
    # Within a rule the least value counts, so a nation answers by its least customer.
    least = c.filter(F.col("c_mktsegment") == "BUILDING").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    rules = [pair((F.col("c_custkey") == F.col("s_suppkey") * 100) & same), pair(same, least), pair(F.col("c_custkey") == F.col("s_suppkey"))]
    return s.select(F.col("s_suppkey").alias("k")).join(graph.first_rule(*rules, key=["k"], value="v"), "k", "left")


@query("""
SELECT p_name, count(*)::BIGINT AS n_matches, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS target, count(*) > 1 AS is_ambiguous,
  array_to_string(list_slice(list(DISTINCT p_partkey ORDER BY p_partkey), 1, 5), ',') AS candidates
FROM part GROUP BY p_name
""")
def ambiguous_candidates(spark, d):
    out = graph.by_unique_name(load(spark, d, "part"), "p_partkey", "p_name")
    return out.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("""
WITH k AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS u FROM pages),
c AS (
  SELECT page_id, 0 AS prio, regexp_replace(url, '[?#].*$', '') AS cand FROM pages
  UNION ALL SELECT page_id, 1, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\\.html$', '') FROM pages
  UNION ALL SELECT page_id, 2, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') FROM pages
  UNION ALL SELECT page_id, 3, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*/?$', '') FROM pages
), h AS (SELECT page_id, prio, cand, row_number() OVER (PARTITION BY page_id ORDER BY prio) AS n FROM c JOIN k ON k.u = c.cand)
SELECT p.page_id, h.cand AS resolved, h.prio::INT AS prio FROM pages p LEFT JOIN h ON h.page_id = p.page_id AND n = 1
""".replace("\\\\", "\\"))
def candidate_resolution(spark, d):
    pages = load(spark, d, "pages")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    known = pages.select(F.regexp_replace(bare, "/$", "").alias("u"))
    options = F.array(bare, F.regexp_replace(bare, r"\.html$", ""), F.regexp_replace(bare, "/$", ""), F.regexp_replace(bare, r"/[^/]*/?$", ""))
    return graph.first_candidate(pages, "page_id", options, known, "u")


# --- change detection and merges --------------------------------------------

OLD_DOCS = """
SELECT doc_id, sha256(text || CASE WHEN lang = 'de' THEN ' ' ELSE '' END) AS content_hash,
  sha256(CASE WHEN n_chars > 4000 THEN text || '!' ELSE text END) AS semantic_hash FROM documents WHERE lang <> 'fr'"""
NEW_DOCS = "SELECT doc_id, sha256(text) AS content_hash, sha256(text) AS semantic_hash FROM documents WHERE source <> 'src3'"


def document_states(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two states of documents: the old one lacks French texts and differs in
    the bytes of German and the substance of long ones; the new one lacks a
    source."""
    docs = load(spark, d, "documents")
    old = docs.filter("lang <> 'fr'").select(
        "doc_id",
        S.content_hash(F.concat("text", F.when(F.col("lang") == "de", " ").otherwise(""))).alias("content_hash"),
        S.content_hash(F.when(F.col("n_chars") > 4000, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("semantic_hash"),
    )
    new = docs.filter("source <> 'src3'").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"), S.content_hash(F.col("text")).alias("semantic_hash"))
    return old, new


@query(f"""
WITH a AS ({OLD_DOCS}), b AS ({NEW_DOCS})
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
  CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.content_hash = b.content_hash THEN 'unchanged'
       WHEN a.semantic_hash = b.semantic_hash THEN 'formatting' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def hash_diff_three_way(spark, d):
    old, new = document_states(spark, d)
    return delta.hash_diff(old, new, "doc_id", "content_hash", "semantic_hash").select("doc_id", "status")


@query(f"""
WITH a AS (SELECT x.*, d.source AS purpose, 0.5 + (n_chars % 6) / 12.0 AS confidence, n_chars % 2 = 0 AS is_stale
  FROM ({OLD_DOCS}) x JOIN documents d USING (doc_id)), b AS ({NEW_DOCS})
SELECT b.doc_id, a.purpose,
  round(CASE WHEN a.doc_id IS NULL THEN 1.0::DOUBLE WHEN a.semantic_hash = b.semantic_hash THEN a.confidence::DOUBLE ELSE a.confidence::DOUBLE * 0.85::DOUBLE END, 6) AS confidence,
  CASE WHEN a.semantic_hash = b.semantic_hash THEN a.is_stale ELSE true END AS is_stale
FROM b LEFT JOIN a ON a.doc_id = b.doc_id
""")
def metadata_carry_over(spark, d):
    old, new = document_states(spark, d)
    meta = load(spark, d, "documents").select("doc_id", F.col("source").alias("purpose"), (0.5 + (F.col("n_chars") % 6) / 12.0).alias("confidence"), (F.col("n_chars") % 2 == 0).alias("is_stale"), F.lit("then").alias("updated_at"))
    out = delta.carry_over(old.join(meta, "doc_id"), new, "doc_id", "semantic_hash", ["purpose"], F.lit("now"))
    return out.select("doc_id", "purpose", F.round("confidence", 6).alias("confidence"), "is_stale")


@query("""
SELECT c_custkey, coalesce(n, 0)::BIGINT AS changes, round(greatest(0, power(0.85, coalesce(n, 0))), 6)::DOUBLE AS confidence
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def confidence_decay(spark, d):
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("changes"))
    times = F.coalesce("changes", F.lit(0)).cast("long")
    return load(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", times.alias("changes"), F.round(S.decayed(F.lit(1.0), times), 6).alias("confidence"))


SCALED = "least(1.0, greatest(0.0, c_acctbal / 10000.0))"


@query(f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'STALE' WHEN {SCALED} < 0.2 THEN 'LIKELY STALE' WHEN {SCALED} < 0.5 THEN 'LOW CONFIDENCE' ELSE '' END AS tag
FROM customer
""")
def confidence_tag(spark, d):
    return load(spark, d, "customer").select("c_custkey", S.confidence_tag(F.expr(SCALED), F.col("c_mktsegment") == "MACHINERY").alias("tag"))


@query(f"""
SELECT CASE WHEN c >= 1 THEN 'full' WHEN c >= 0.5 THEN 'high' WHEN c >= 0.2 THEN 'low' ELSE 'stale' END AS bucket, count(*)::BIGINT AS n
FROM (SELECT {SCALED} AS c FROM customer) GROUP BY 1
""")
def confidence_histogram(spark, d):
    return rollup.confidence_histogram(load(spark, d, "customer").select(F.expr(SCALED).alias("confidence")))


@query("SELECT sha256(text) AS content_hash, count(*)::BIGINT AS n, min(doc_id) AS least FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, d):
    return load(spark, d, "documents").groupBy(S.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1")


@query(r"""
WITH v AS (SELECT text FROM documents UNION ALL SELECT replace(text, ' ', '  ') FROM documents WHERE lang = 'de' UNION ALL SELECT text || chr(10) FROM documents WHERE lang = 'fr'),
h AS (
  SELECT sha256(array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ')) AS semantic_hash,
    sha256(coalesce(text, '')) AS content FROM v
)
SELECT semantic_hash, count(*)::BIGINT AS n, count(DISTINCT content)::BIGINT AS n_contents FROM h GROUP BY 1
""".replace("\\\\", "\\"))
def semantic_hash_groups(spark, d):
    """Whole texts, and German and French ones laid out in another way: case and
    white space do not matter."""
    docs = load(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    spaced = docs.filter("lang = 'de'").select(F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    ended = docs.filter("lang = 'fr'").select(F.concat("text", F.lit("\n")).alias("text"))
    rows = docs.select("text").unionByName(spaced).unionByName(ended)
    tokens = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return rows.groupBy(S.token_hash(tokens).alias("semantic_hash")).agg(F.count("*").alias("n"), F.countDistinct(S.content_hash(F.col("text"))).alias("n_contents"))


@query("SELECT n_nationkey, substr(sha256(n_name || n_regionkey::VARCHAR), 1, 12) AS id FROM nation")
def deterministic_ids(spark, d):
    return load(spark, d, "nation").select("n_nationkey", S.short_id(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("id"))


@query("""
SELECT o.o_orderkey, coalesce(abs(o.o_totalprice - i.m) < 0.01 AND o.o_custkey = i.s, false) AS hit
FROM orders o LEFT JOIN (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS m,
    CASE WHEN o_orderpriority LIKE '5%' THEN o_custkey + 1 ELSE o_custkey END AS s FROM orders WHERE o_orderstatus <> 'P'
) i ON i.o_orderkey = o.o_orderkey
""")
def mtime_cache_hits(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("mtime"), F.col("o_custkey").alias("size"), "o_orderstatus", "o_orderpriority")
    index = o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("mtime") + 1).when(F.col("o_orderpriority").startswith("1"), None).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("o_orderpriority").startswith("5"), F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return delta.cache_hits(o.select("o_orderkey", "mtime", "size"), index, "o_orderkey", "mtime", "size")


# --- retention ----------------------------------------------------------------


@query("""
SELECT user_id, event_id, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS pos FROM events) WHERE pos <= 20
""")
def retention_cap_20(spark, d):
    return retention.latest_per_key(load(spark, d, "events"), "user_id", "ts", "event_id", retention.CHANGES).select("user_id", "event_id", "pos")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 10")
def session_retention_10(spark, d):
    return retention.latest(load(spark, d, "events"), "ts", "event_id", retention.SESSIONS).select("event_id", "user_id", "event_type")


@query("""
SELECT event_type, event_id, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS pos FROM events) WHERE pos <= 3
""")
def latest_3_per_key(spark, d):
    return retention.latest_per_key(load(spark, d, "events"), "event_type", "ts", "event_id", 3).select("event_type", "event_id", "pos")


@query("""
WITH t AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) GROUP BY 1, 2),
r AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT * FROM t UNION ALL SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = r.user_id AND t.event_type = r.event_type)
""")
def insert_or_ignore(spark, d):
    e = load(spark, d, "events")
    all_rows = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    least = e.agg(F.min("event_type")).scalar()
    return delta.insert_or_ignore(all_rows.filter(F.col("event_type") == least), all_rows, ["user_id", "event_type"])


@query("""
SELECT c_custkey, coalesce(nullif(CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN 'PATCHED' END, ''), c_mktsegment) AS c_mktsegment FROM customer
""")
def coalesce_patch(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    updates = c.filter("c_nationkey < 10").select("c_custkey", F.when(F.col("c_nationkey") < 5, "").otherwise("PATCHED").alias("c_mktsegment"))
    return delta.patch(c.select("c_custkey", "c_mktsegment"), updates, "c_custkey", ["c_mktsegment"])


# --- paths and roll-ups -----------------------------------------------------

PATHS = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def url_paths(spark, d) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return load(spark, d, "pages").select("page_id", bare.alias("path"))


@query(f"""
WITH p AS (SELECT string_split({PATHS}, '/') AS parts FROM pages),
x AS (SELECT unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS path FROM p UNION ALL SELECT '.' FROM p)
SELECT path, count(*)::BIGINT AS file_count FROM x GROUP BY path
""")
def directory_rollup(spark, d):
    return rollup.directory_rollup(url_paths(spark, d))


@query(f"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/./b/../' || {PATHS} || '/x/..' WHEN 1 THEN '../../' || {PATHS} || '//y/.' WHEN 2 THEN {PATHS} || '/../../../z' ELSE '/' || {PATHS} END AS path FROM pages),
s AS (SELECT page_id, list_concat([['']], list_transform(string_split(path, '/'), lambda x: [x])) AS steps FROM p)
SELECT page_id, array_to_string(list_filter(list_reduce(steps, lambda done, x:
  CASE WHEN x[1] IN ('', '.') THEN done WHEN x[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE list_concat(done, x) END), lambda x: x <> ''), '/') AS path FROM s
""")
def path_normalise(spark, d):
    """Folds of dots inside, above and at the end of paths."""
    p, k = F.col("path"), F.col("page_id") % 4
    odd = F.when(k == 0, F.concat(F.lit("a/./b/../"), p, F.lit("/x/.."))).when(k == 1, F.concat(F.lit("../../"), p, F.lit("//y/."))).when(k == 2, F.concat(p, F.lit("/../../../z"))).otherwise(F.concat(F.lit("/"), p))
    return url_paths(spark, d).select("page_id", S.normal_path(odd).alias("path"))


@query(f"""
WITH p AS (SELECT {PATHS} AS path FROM pages),
t AS (SELECT min(path) AS target FROM p WHERE path LIKE '%/en/%'),
q AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, split_part(path, '/', 1) AS top FROM p)
SELECT 'file' AS kind, path || CASE WHEN path = target THEN ' (TARGET)' ELSE '' END AS entry FROM q, t WHERE parent = regexp_extract(target, '^(.*)/[^/]*$', 1)
UNION ALL
SELECT 'folder', top || '/ [' || count(*)::VARCHAR || ' files]' FROM q, t WHERE path LIKE '%/%' AND top <> split_part(target, '/', 1) GROUP BY top
""")
def folded_tree(spark, d):
    files = url_paths(spark, d)
    target = files.filter(F.col("path").like("%/en/%")).agg(F.min("path")).first()[0]  # one value, as a caller would name it
    return rollup.folded_tree(files, target or "")


@query("SELECT source, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def system_counts(spark, d):
    return rollup.group_counts(load(spark, d, "documents"), "source").orderBy(F.desc("n"), "source")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in TABLES))
def status_summary(spark, d):
    return rollup.table_counts({t: load(spark, d, t) for t in TABLES})


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS pending,
  count(*) FILTER (WHERE o_totalprice IS NULL)::BIGINT AS unpriced, count(*) FILTER (WHERE o_orderpriority LIKE '1%')::BIGINT AS urgent FROM orders
""")
def condition_counts(spark, d):
    return rollup.condition_counts(load(spark, d, "orders"), open=F.col("o_orderstatus") == "O", pending=F.col("o_orderstatus") == "P", unpriced=F.col("o_totalprice").isNull(), urgent=F.col("o_orderpriority").startswith("1"))


@query("""
SELECT greatest(0, a.n_open - b.n_open)::BIGINT AS n_open, greatest(0, a.n_all - b.n_all)::BIGINT AS n_all FROM
 (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) AS n_all FROM orders) a,
 (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) AS n_all FROM orders WHERE o_orderpriority NOT LIKE '1%') b
""")
def delta_clamped(spark, d):
    o = load(spark, d, "orders")
    counts = lambda x: rollup.condition_counts(x, n_open=F.col("o_orderstatus") == "O", n_all=F.lit(True))
    return rollup.delta_counts(counts(o), counts(o.filter(~F.col("o_orderpriority").startswith("1"))), ["n_open", "n_all"])


@query("""
SELECT CASE WHEN d.lang = 'es' THEN 'skipped' WHEN l.doc_id IS NULL THEN 'not_indexed' WHEN l.quality = 0 OR l.toxic = 1 THEN 'stale' ELSE 'checked' END AS status,
  count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
""")
def validate_status(spark, d):
    staged = load(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.lit(1)).alias("hash"))
    index = load(spark, d, "labels").select("doc_id", F.col("quality").alias("hash"), (F.col("toxic") == 1).alias("is_stale"))
    return delta.validation(staged, index, "doc_id", "hash", "is_stale").groupBy("status").agg(F.count("*").alias("n"))


@query("""
SELECT d.doc_id, NOT (l.doc_id IS NOT NULL AND d.n_chars < 5000) AS needs_purpose, (d.n_chars // 4)::BIGINT AS tokens
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1
WHERE d.n_chars >= 5000 OR d.source IS NULL OR l.doc_id IS NOT NULL
""")
def summarise_selection(spark, d):
    from quarrylight.operators import summaries

    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("summary"), (F.col("n_chars") >= 5000).alias("is_stale"), "n_chars")
    tainted = load(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return summaries.needing_summary(docs, tainted, "doc_id").select("doc_id", F.col("purpose_needs_update").alias("needs_purpose"), F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))


# --- packing ----------------------------------------------------------------


@query("""
WITH RECURSIVE o AS (
  SELECT source, doc_id, (n_chars // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents
), b AS (
  SELECT source, doc_id, tokens, i, 0 AS batch, 1 AS n, tokens AS total FROM o WHERE i = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.tokens, o.i,
    CASE WHEN b.n >= 20 OR b.total + o.tokens > 4000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n >= 20 OR b.total + o.tokens > 4000 THEN 1 ELSE b.n + 1 END,
    CASE WHEN b.n >= 20 OR b.total + o.tokens > 4000 THEN o.tokens ELSE b.total + o.tokens END
  FROM b JOIN o ON o.source = b.source AND o.i = b.i + 1
)
SELECT source, doc_id, tokens, batch::INT AS batch FROM b
""")
def greedy_batches(spark, d):
    return batches.greedy_batches(load(spark, d, "documents"), "source", "doc_id", F.floor(F.col("n_chars") / 4), 20, 4000)


@query("""
WITH z AS (
  SELECT source, sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END)::BIGINT AS a, sum(CASE WHEN lang = 'fr' THEN n_chars ELSE 0 END)::BIGINT AS b,
    sum(CASE WHEN lang = 'de' THEN n_chars ELSE 0 END)::BIGINT AS c, sum(CASE WHEN lang = 'es' THEN n_chars ELSE 0 END)::BIGINT AS e FROM documents GROUP BY source
), t AS (
  SELECT source, (a + b + c + e) // 4 AS t0, (a // 2 + b + c + e) // 4 AS t1, (a // 2 + b // 3 + c + e) // 4 AS t2, (a // 2 + b // 3 + e) // 4 AS t3, (a // 2 + b // 3 + e // 2) // 4 AS t4 FROM z
)
SELECT source, (CASE WHEN t0 <= 25000 THEN 0 WHEN t1 <= 25000 THEN 1 WHEN t2 <= 25000 THEN 2 WHEN t3 <= 25000 THEN 3 ELSE 4 END)::INT AS step,
  (CASE WHEN t0 <= 25000 THEN t0 WHEN t1 <= 25000 THEN t1 WHEN t2 <= 25000 THEN t2 WHEN t3 <= 25000 THEN t3 ELSE t4 END)::BIGINT AS tokens,
  (CASE WHEN t0 <= 25000 THEN t0 WHEN t1 <= 25000 THEN t1 WHEN t2 <= 25000 THEN t2 WHEN t3 <= 25000 THEN t3 ELSE t4 END) > 25000 AS over
FROM t
""")
def budget_cascade(spark, d):
    zone = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("n_chars")).otherwise(0))
    z = load(spark, d, "documents").groupBy("source").agg(zone("en").alias("a"), zone("fr").alias("b"), zone("de").alias("c"), zone("es").alias("e"))
    z = z.withColumns({"a2": F.floor(F.col("a") / 2), "b2": F.floor(F.col("b") / 3), "e2": F.floor(F.col("e") / 2)})
    return batches.budget_cascade(z, "source", [("a", "a2"), ("b", "b2"), ("c", None), ("e", "e2")], 25000)


@query("""
WITH c AS (
  SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS total,
    row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey <= 700 AND o_orderkey + 50 >= 700)::INT DESC, o_orderkey) AS pos FROM orders
)
SELECT o_custkey, o_orderkey, total::BIGINT AS total, pos::INT AS pos FROM c WHERE total <= 8 OR pos <= 5
""")
def page_functions(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + 50).alias("last"))
    return batches.page_rows(o, "o_custkey", "o_orderkey", "last", 700, 8, 5).drop("last")


# --- search -----------------------------------------------------------------


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '') || ' ' || coalesce(source, '')), '[\\p{L}\\p{N}]+', 0) AS tk FROM documents),
c AS (SELECT doc_id, len(tk) AS dl, len(list_filter(tk, lambda x: x = 'the')) AS f1, len(list_filter(tk, lambda x: x = 'tion')) AS f2 FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM c)
SELECT doc_id, round(
    greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / av))
  + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / av)), 6)::DOUBLE AS score
FROM c, s WHERE f1 > 0 AND f2 > 0
""".replace("\\\\", "\\"))
def bm25_search(spark, d):
    return search.bm25(load(spark, d, "documents"), "the tion", "doc_id", ["text", "source"], limit=None)


@query("SELECT conv_id, turn, role FROM conversations WHERE text ILIKE '%ING the%' OR role ILIKE '%SYST%'")
def like_search(spark, d):
    return search.contains(load(spark, d, "conversations"), "ING the", ["text"]).unionByName(search.contains(load(spark, d, "conversations"), "SYST", ["role"])).select("conv_id", "turn", "role").distinct()


@query("""
WITH a AS (SELECT 0 AS src, doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT doc_id FROM documents WHERE text ILIKE '%idiot%' ORDER BY doc_id LIMIT 20)),
b AS (SELECT 1 AS src, doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%idiot%' ORDER BY doc_id LIMIT 20)),
m AS (SELECT doc_id, min((src, rank)) AS best FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (ORDER BY best, doc_id))::INT AS pos FROM m ORDER BY best, doc_id LIMIT 20
""")
def merged_search(spark, d):
    docs = load(spark, d, "documents")
    one = search.contains(docs, "idiot", ["text"]).select("doc_id").orderBy("doc_id")
    two = docs.filter(F.col("text").ilike("%license%") | F.col("text").ilike("%idiot%")).select("doc_id").orderBy("doc_id")
    return search.merge_results(one, two, key="doc_id", order=["doc_id"], limit=20)


# --- text and lists ---------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey, p_size < 20 AS tainted, CASE WHEN p_size < 5 THEN NULL ELSE p_partkey % 300 END AS src FROM part)
SELECT p_partkey, CASE WHEN NOT tainted THEN NULL WHEN src IS NULL THEN 'A dependency has changed.'
  WHEN s_name IS NOT NULL THEN 'Depends on ' || s_nationkey::VARCHAR || '.' || s_name || '() in ' || s_suppkey::VARCHAR || ', which has changed.'
  ELSE 'Depends on ' || src::VARCHAR || ', which has changed.' END AS warning
FROM t LEFT JOIN supplier ON s_suppkey = src
""")
def taint_warning_text(spark, d):
    part = load(spark, d, "part").select("p_partkey", (F.col("p_size") < 20).alias("tainted"), F.when(F.col("p_size") >= 5, F.col("p_partkey") % 300).alias("src"))
    joined = part.join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("src"), "left")
    text = S.taint_warning(F.col("tainted"), F.col("src").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    return joined.select("p_partkey", text.alias("warning"))


@query("""
SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, 3::BIGINT AS n_list, array_to_string([event_type, 'view', 'x'], ',') AS raw,
  CASE WHEN event_type = 'view' THEN 'view,x' ELSE event_type || ',view,x' END AS merged FROM events
""")
def json_array_ops(spark, d):
    e = load(spark, d, "events")
    text = F.to_json(F.array("event_type", F.lit("view"), F.lit("x")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), S.json_length(text).cast("long").alias("n_list"), F.array_join(S.json_list(text), ",").alias("raw"), F.array_join(S.ordered_union(F.array("event_type"), F.array(F.lit("view"), F.lit("x"))), ",").alias("merged"))


@query(f"""
SELECT page_id, CASE WHEN p LIKE '%/%' THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent, regexp_extract(p, '[^/]*$', 0) AS name,
  regexp_extract(regexp_extract(p, '[^/]*$', 0), '^.+?(\\.[^.]*)$', 1) AS suffix, (length(p) // 4)::BIGINT AS tokens, substr(sha256(p), 1, 7) AS short
FROM (SELECT page_id, {PATHS} AS p FROM pages)
""".replace("\\\\", "\\"))
def path_functions(spark, d):
    p = F.col("path")
    return url_paths(spark, d).select("page_id", S.path_parent(p).alias("parent"), S.path_name(p).alias("name"), S.path_suffix(p).alias("suffix"), S.token_estimate(p).alias("tokens"), S.short_hash(S.content_hash(p)).alias("short"))


@query("""
SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents
""")
def source_slices(spark, d):
    return load(spark, d, "documents").select("doc_id", S.source_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@query("""
SELECT round(coalesce(count(*) FILTER (WHERE p_size > 25) / nullif(count(*)::DOUBLE, 0) * 100, 0), 6) AS coverage, sum(p_size)::BIGINT AS edges FROM part
""")
def coverage(spark, d):
    return load(spark, d, "part").agg(F.round(S.percent(F.count_if(F.col("p_size") > 25), F.count("*")), 6).alias("coverage"), F.sum("p_size").alias("edges"))


@query("""
SELECT n.n_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS functions, count(s_name)::BIGINT AS n FROM nation n LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
""")
def functions_per_file(spark, d):
    from quarrylight.operators import summaries

    out = summaries.with_members(load(spark, d, "nation").select("n_nationkey"), load(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name"), "n_nationkey", ["s_name"])
    return out.select("n_nationkey", F.when(F.size("members") > 0, F.array_join("members.s_name", ", ")).alias("functions"), F.size("members").cast("long").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate::DATE::VARCHAR AS opened FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
""")
def line_containment(spark, d):
    """Range containment within an equi-join: the range is a join filter."""
    l, o = load(spark, d, "lineitem"), load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return l.join(o, (F.col("o_orderkey") == F.col("l_orderkey")) & inside).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("opened"))


@query("""
SELECT c_custkey, c_mktsegment FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')
""")
def exists_or_filter(spark, d):
    """EXISTS under OR: an existence join, no row multiplied."""
    return spark.sql("SELECT c_custkey, c_mktsegment FROM {c} c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')", c=load(spark, d, "customer"), o=load(spark, d, "orders"))


@query("""
SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
UNION SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
""")
def rebuild_scope(spark, d):
    """Callers in changed files and callers of anything in them, once each."""
    l = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    small = load(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    callers = l.filter("l_returnflag = 'R'").join(small, "l_partkey", "left_semi")
    callees = load(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return graph.rebuild_scope(l, callers, callees, "l_partkey", "l_suppkey")


@query("""
WITH s AS (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_partkey, count(*)::BIGINT AS n FROM (
  SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM s) UNION ALL SELECT l_orderkey, l_partkey FROM s
) GROUP BY 1, 2
""")
def replace_group(spark, d):
    """Delete-and-replace of the edges of some callers."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    fresh = l.filter("l_returnflag = 'A'").select("l_orderkey", "l_partkey")
    return delta.replace_group(l.select("l_orderkey", "l_partkey"), fresh, "l_orderkey", fresh).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query("""
WITH b AS (
  WITH RECURSIVE o AS (SELECT lang, doc_id, (n_chars // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
  r AS (
    SELECT lang, tokens, i, 0 AS batch, 1 AS n, tokens AS total FROM o WHERE i = 1
    UNION ALL SELECT o.lang, o.tokens, o.i, CASE WHEN r.n >= 20 OR r.total + o.tokens > 50000 THEN r.batch + 1 ELSE r.batch END,
      CASE WHEN r.n >= 20 OR r.total + o.tokens > 50000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.total + o.tokens > 50000 THEN o.tokens ELSE r.total + o.tokens END
    FROM r JOIN o ON o.lang = r.lang AND o.i = r.i + 1
  ) SELECT * FROM r
)
SELECT lang, count(DISTINCT batch)::BIGINT AS n_batches, ((sum(tokens * 4) + count(DISTINCT batch) * 800) // 4)::BIGINT AS tokens_in, (count(*) * 500 // 4)::BIGINT AS tokens_out FROM b GROUP BY lang
""")
def cost_estimate(spark, d):
    b = batches.greedy_batches(load(spark, d, "documents"), "lang", "doc_id", F.floor(F.col("n_chars") / 4))
    return batches.cost_estimate(b, "lang", 800)


# --- sources ----------------------------------------------------------------

CLIENT = "import s.nat{n} as nat\n\nclass C:\n    def size(self):\n        self.k = {k}\n        return nat.area(self.k)\n    def twice(self):\n        return self.size() + missing()\n"


def source_files(spark, d) -> DataFrame:
    """A Python file for every customer, which uses that of its nation."""
    text = F.replace(F.replace(F.lit(CLIENT), F.lit("{n}"), F.col("c_nationkey").cast("string")), F.lit("{k}"), F.col("c_custkey").cast("string"))
    clients = spread(load(spark, d, "customer"), "c_custkey").select(F.format_string("s/c%d.py", "c_custkey").alias("path"), text.cast("binary").alias("content"))
    nations = load(spark, d, "nation").select(F.format_string("s/nat%d.py", "n_nationkey").alias("path"), F.lit("def area(x):\n    return x\n").cast("binary").alias("content"))
    return clients.unionByName(nations)


@query("""
SELECT 's/c' || c_custkey || '.py::C.size' AS id, 'def size(self)' AS signature, 4 AS line_start, 6 AS line_end, 'self.k' AS mutates, 'nat.area' AS calls FROM customer
UNION ALL SELECT 's/c' || c_custkey || '.py::C.twice', 'def twice(self)', 7, 8, '', 'self.size,missing' FROM customer
UNION ALL SELECT 's/nat' || n_nationkey || '.py::area', 'def area(x)', 1, 2, '', '' FROM nation
""")
def extract_functions(spark, d):
    rows = calls.function_ids(extract(source_files(spark, d), hashes=False))
    made = F.array_join(F.transform("calls", lambda c: F.concat_ws(".", c["object"], c["name"])), ",")
    return rows.select("id", "signature", "line_start", "line_end", F.array_join("mutates", ",").alias("mutates"), made.alias("calls"))


@query("""
SELECT 's/c' || c_custkey || '.py' AS src, 's/nat' || c_nationkey || '.py' AS dst FROM customer
""")
def import_edges(spark, d):
    return imports.resolve(settle(imports.read_of(extract(source_files(spark, d), hashes=False, functions=False)), "parsed"))


@query("""
SELECT 's/c' || c_custkey || '.py::C.size' AS caller_id, 0 AS pos, 'area' AS callee_name, 's/nat' || c_nationkey || '.py::area' AS callee_id, false AS is_ambiguous FROM customer
UNION ALL SELECT 's/c' || c_custkey || '.py::C.twice', 0, 'size', 's/c' || c_custkey || '.py::C.size', false FROM customer
UNION ALL SELECT 's/c' || c_custkey || '.py::C.twice', 1, 'missing', NULL, false FROM customer
""")
def call_edges(spark, d):
    files = settle(extract(source_files(spark, d), hashes=False), "parsed")
    functions = calls.function_ids(files)
    raw = files.select("path", F.explode("imports_raw").alias("i")).select("path", "i.module", "i.names", "i.alias")
    shown = files.select(F.col("path").alias("file"), F.explode("exports").alias("name"))
    supers = files.select(F.col("path").alias("file"), F.explode("supers").alias("s")).select("file", "s.class_name", "s.super")
    return calls.resolve(functions, raw, imports.resolve(files), shown, supers).select("caller_id", "pos", "callee_name", "callee_id", "is_ambiguous")


# --- streams ----------------------------------------------------------------

ISLANDS = """
WITH g AS (SELECT {cols} event_id, event_type, ts, CASE WHEN ts - lag(ts) OVER ({part} ORDER BY ts, event_id) <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT {cols} strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*)::BIGINT AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths
FROM s GROUP BY {cols} island
"""


@query(ISLANDS.format(cols="user_id,", part="PARTITION BY user_id", gap="60 MINUTE"))
def debounce_sessions(spark, d):
    out = debounce.sessions(load(spark, d, "events"), "ts", "event_type", "60 minutes", ["user_id"])
    return out.select("user_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n_events", F.array_join("paths", ",").alias("paths"))


@query(ISLANDS.format(cols="", part="", gap="10 MINUTE"))
def debounce_global(spark, d):
    """One timer for all: flushes after global quiet."""
    out = debounce.sessions(load(spark, d, "events"), "ts", "event_type", "10 minutes", [])
    return out.select(F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n_events", F.array_join("paths", ",").alias("paths"))


@query(ISLANDS.format(cols="user_id,", part="PARTITION BY user_id", gap="60 MINUTE"))
def stream_debounce(spark, d):
    """The same sessions from a stream over the same files, to the end."""
    out = debounce.stream_once(spark, f"{d}/events.parquet", load(spark, d, "events").schema, "ts", "event_type", "60 minutes", ["user_id"])
    return out.select("user_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n_events", F.array_join("paths", ",").alias("paths"))


@query("""
WITH e AS (SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1)
SELECT e.doc_id, CASE WHEN kind = 'purchase' THEN 'deleted' WHEN d.doc_id IS NULL THEN 'ignored' WHEN kind = 'view' THEN 'unchanged'
  WHEN kind = 'click' THEN 'formatting' ELSE 'reindex' END AS action
FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id
""")
def change_classification(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("c").alias("content_hash"), F.lit("s").alias("semantic_hash"))
    seen = load(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    state = seen.select("path", (F.col("kind") != "purchase").alias("exists"), F.when(F.col("kind") == "view", "c").otherwise("c2").alias("content_hash"), F.when(F.col("kind").isin("view", "click"), "s").otherwise("s2").alias("semantic_hash"))
    return debounce.classify(state, docs).select(F.col("path").alias("doc_id"), "action")
