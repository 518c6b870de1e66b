"""The engine's queries on the star schema, documents, events and conversations, each beside its SQL form.

The data is clean, so queries about faults read a copy broken by a fixed rule (a parent whose key is divisible by 7 is
missing, and so on). Money is in whole cents so that results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .operators import graph, integrity, ordered, ordered_stream, setops
from .plans import execution
from .sources import adapters, store
from .streaming import subscription
from .training import tables as training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 120")
def v1_count_limit(spark, d):
    return integrity.over_limit(Tables(spark, d).documents, ["lang"], 120)


@query("SELECT source, sum(strlen(text)) + 64 * count(*) + 48 * count(lang) AS budget FROM documents GROUP BY source")
def v2_metadata_budget(spark, d):
    weight = F.sum(F.octet_length("text")) + 64 * F.count(F.lit(1)) + 48 * F.count("lang")
    return Tables(spark, d).documents.groupBy("source").agg(weight.cast("long").alias("budget"))


@query("SELECT 'customers' AS family, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def v3_family_limits(spark, d):
    t = Tables(spark, d)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("family"), "n")
    return integrity.report([one(t.customer, "customers"), one(t.orders, "orders"), one(t.part, "parts"), one(t.supplier, "suppliers")])


@query("SELECT doc_id, h FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS occurrence FROM documents) WHERE occurrence > 1")
def v4_duplicate_id(spark, d):
    return integrity.repeated(Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")


@query("SELECT 'V5' AS rule, 'E002' AS code, 'orders.o_custkey' AS path, CAST(o_orderkey AS VARCHAR) AS related FROM orders WHERE o_custkey % 7 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def v5_edge_endpoints(spark, d):
    t = Tables(spark, d)
    return integrity.failure(integrity.dangling(t.orders, "o_custkey", t.customer.where("c_custkey % 7 <> 0"), "c_custkey"), "V5", "E002", "orders.o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1) ON k = l_orderkey WHERE l_linenumber > n")
def v6_member_position(spark, d):
    lines = Tables(spark, d).lineitem
    channels = lines.where("l_linenumber % 3 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return lines.join(channels, F.col("k") == F.col("l_orderkey")).where("l_linenumber > n").select("l_orderkey", "l_linenumber", "n")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)")
def v7_container_member(spark, d):
    t = Tables(spark, d)
    return integrity.dangling(t.nation, "n_regionkey", t.region.where("r_regionkey % 2 = 0"), "r_regionkey").select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_partkey % 11 <> 0)")
def v8_membership_pair(spark, d):
    lines = Tables(spark, d).lineitem
    return integrity.unlisted_pairs(lines.select("l_orderkey", "l_linenumber"), lines.where("l_partkey % 11 <> 0"), ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, 'nation' AS missing FROM supplier WHERE s_nationkey % 5 = 0 UNION ALL SELECT s_suppkey, 'part' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def v9_v11_optional_references(spark, d):
    t = Tables(spark, d)
    nation = integrity.dangling(t.supplier, "s_nationkey", t.nation.where("n_nationkey % 5 <> 0"), "n_nationkey").select("s_suppkey", F.lit("nation").alias("missing"))
    part = integrity.dangling(t.supplier, "s_suppkey", t.lineitem.where("l_quantity >= 50"), "l_suppkey").select("s_suppkey", F.lit("part").alias("missing"))
    return nation.unionByName(part)


@query("SELECT vec_id, len(embedding) * 4 AS bytes, len(embedding) AS extent, len(embedding) * 4 <= 256 AS within FROM embeddings")
def v12_atom_structure(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", F.size("embedding").cast("long").alias("extent"))
    return e.select("vec_id", P.dense_bytes(F.array("extent"), F.lit("f32")).cast("long").alias("bytes"), "extent", (P.dense_bytes(F.array("extent"), F.lit("f32")) <= 256).alias("within"))


@query("SELECT o_orderkey, part FROM (SELECT l_orderkey AS o_orderkey, unnest(list_distinct(list(l_partkey))) AS part FROM lineitem GROUP BY l_orderkey) WHERE part % 13 = 0")
def v14_companion_missing(spark, d):
    t = Tables(spark, d)
    named = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).distinct()
    return integrity.dangling(named, "part", t.part.where("p_partkey % 13 <> 0"), "p_partkey")


@query("SELECT l_partkey, bool_and(l_quantity < 50) AS agrees, count(*) AS descriptors FROM lineitem GROUP BY l_partkey")
def v15_companion_contract(spark, d):
    return integrity.all_agree(Tables(spark, d).lineitem, ["l_partkey"], F.col("l_quantity") < 50)


@query("SELECT 'V16' AS rule, 'E003' AS code, 'customer.c_acctbal' AS path, CAST(c_custkey AS VARCHAR) AS related FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'V16', 'E003', 'supplier.s_acctbal', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0")
def v16_non_positive(spark, d):
    t = Tables(spark, d)
    return integrity.report([integrity.failure(t.customer.where("c_acctbal < 0"), "V16", "E003", "customer.c_acctbal", "c_custkey"), integrity.failure(t.supplier.where("s_acctbal < 0"), "V16", "E003", "supplier.s_acctbal", "s_suppkey")])


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 20 DAY")
def v22_interval_order(spark, d):
    t = Tables(spark, d)
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate + interval 20 days").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, list_contains(list(l_linenumber), 5) AS listed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def v23_output_contains(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.bool_or(F.col("l_linenumber") == 5).alias("listed"))


@query("SELECT l_suppkey, len(list_distinct(list(l_returnflag))) = 3 AS covers FROM lineitem GROUP BY l_suppkey")
def v26_restriction_superset(spark, d):
    lines = Tables(spark, d).lineitem
    sets = lines.groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("child")).withColumn("parent", F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    return sets.select("l_suppkey", integrity.covers("child", "parent").alias("covers"))


@query("SELECT kind, id FROM (SELECT 'customer' AS kind, o_custkey AS id FROM orders UNION SELECT 'part', l_partkey FROM lineitem) WHERE id % 17 = 0")
def v28_ref_universe(spark, d):
    t = Tables(spark, d)
    kind = lambda df, name, c: df.select(F.lit(name).alias("kind"), F.col(c).alias("id"))
    used = kind(t.orders, "customer", "o_custkey").unionByName(kind(t.lineitem, "part", "l_partkey")).distinct()
    known = kind(t.customer.where("c_custkey % 17 <> 0"), "customer", "c_custkey").unionByName(kind(t.part.where("p_partkey % 17 <> 0"), "part", "p_partkey"))
    return used.join(known, ["kind", "id"], "left_anti")


@query("""SELECT doc_id, CASE kind WHEN 'exact' THEN metric IS NULL AND bound IS NULL WHEN 'bounded' THEN metric IS NOT NULL AND bound IS NOT NULL ELSE metric IS NOT NULL END AS fits
FROM (SELECT doc_id, CASE quality + toxic WHEN 0 THEN 'exact' WHEN 1 THEN 'bounded' ELSE 'transformed' END AS kind, CASE WHEN quality = 1 THEN 'm' END AS metric, CASE WHEN toxic = 1 THEN 1 END AS bound FROM labels)""")
def v30_fidelity_shape(spark, d):
    kinds = F.when(F.expr("quality + toxic = 0"), "exact").when(F.expr("quality + toxic = 1"), "bounded").otherwise("transformed")
    rows = Tables(spark, d).labels.select("doc_id", kinds.alias("kind"), F.when(F.col("quality") == 1, "m").alias("metric"), F.when(F.col("toxic") == 1, 1).alias("bound"))
    return rows.select("doc_id", P.fidelity_fits("kind", "metric", "bound").alias("fits"))


@query("""WITH RECURSIVE e(src, dst) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
w(node) AS (SELECT 'o' || o_orderkey FROM orders UNION SELECT dst FROM w JOIN e ON src = node) SELECT node FROM w""")
def r1_closure(spark, d):
    t = Tables(spark, d)
    return graph.reachable(t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node")), _edges(t)).select("node")


def _edges(t: Tables) -> DataFrame:
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return integrity.report([edge(t.customer, "c", "c_custkey", "n", "c_nationkey"), edge(t.supplier, "s", "s_suppkey", "n", "s_nationkey"), edge(t.nation, "n", "n_nationkey", "r", "n_regionkey"), edge(t.orders, "o", "o_orderkey", "c", "o_custkey")])


@query("SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def r3_gc_sweep(spark, d):
    t = Tables(spark, d)
    pins = t.orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.unreachable(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node")), pins, _edges(t))


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey * 3) % 50 + 1 END AS parent FROM customer),
w AS (SELECT node AS start, parent AS up, [node] AS seen FROM p UNION ALL SELECT start, p.parent, list_append(seen, p.node) FROM w JOIN p ON p.node = w.up WHERE NOT list_contains(seen, w.up) AND len(seen) <= 6)
SELECT start AS node, CASE WHEN len(seen) > 6 THEN 'depth' WHEN up IS NULL THEN 'root' ELSE 'cycle' END AS state, len(seen) AS steps FROM w WHERE len(seen) > 6 OR up IS NULL OR list_contains(seen, up)""")
def r4_ancestry_cycle(spark, d):
    parent = F.when(F.col("c_custkey") % 10 != 0, (F.col("c_custkey") * 3) % 50 + 1)
    return graph.ancestry(Tables(spark, d).customer.select(F.col("c_custkey").alias("node"), parent.alias("parent")), 6).select("node", "state", F.col("steps").cast("long").alias("steps"))


@query("SELECT l_partkey, count(DISTINCT refs) AS variants FROM (SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS refs FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT refs) > 1")
def r5_closure_conflict(spark, d):
    sets = Tables(spark, d).lineitem.groupBy("l_partkey", "l_suppkey").agg(F.collect_set("l_returnflag").alias("refs"))
    return setops.conflicting(sets, ["l_partkey"], F.col("refs"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def j3_missing_extra(spark, d):
    t = Tables(spark, d)
    return setops.missing_extra(t.documents.where("doc_id % 2 = 0"), t.labels, "doc_id")


@query("""SELECT k, seq, o, s, bool_and(o IS NOT NULL AND s IS NOT NULL) OVER (PARTITION BY k) AS whole FROM (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders) a
FULL JOIN (SELECT user_id AS k, event_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) b USING (k, seq)""")
def j4_zip_sequence(spark, d):
    t = Tables(spark, d)
    orders, events = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o")), t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("s"))
    return setops.zip_by_sequence(["k"], [(orders, "o", "o"), (events, "s", "s")]).withColumn("seq", F.col("seq").cast("long"))


@query("SELECT 'left' AS side, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT 'right', count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)")
def j5_equivalence(spark, d):
    lines = Tables(spark, d).lineitem
    side = lambda n: lines.where(F.col("l_linenumber") == n).select("l_partkey", "l_suppkey")
    return setops.differences(side(1), side(2))


@query("SELECT event_id, user_id * 1000 + 2 * event_id AS aligned FROM events JOIN (SELECT user_id AS u, min(ts) AS lo, min(ts) + INTERVAL 10 DAY AS hi FROM events GROUP BY 1) ON user_id = u AND ts >= lo AND ts <= hi")
def j8_clock_range(spark, d):
    events = Tables(spark, d).events
    valid = events.groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("lo")).withColumn("hi", F.expr("lo + interval 10 days"))
    return events.join(valid, (F.col("user_id") == F.col("u")) & F.col("ts").between(F.col("lo"), F.col("hi"))).select("event_id", F.expr("user_id * 1000 + 2 * event_id").alias("aligned"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def g1_rollup(spark, d):
    return Tables(spark, d).lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("l_extendedprice")).alias("cents"))


@query("SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT p_partkey FROM part WHERE p_size > 25)")
def g3_payload_closure(spark, d):
    t = Tables(spark, d)
    return t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("id")).unionByName(t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"))).distinct()


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def g6_ordered_digest(spark, d):
    return Tables(spark, d).conversations.groupBy("conv_id").agg(setops.ordered_digest(F.col("text"), F.col("turn")).alias("digest"))


@query("SELECT sha256(text) AS content, count(*) AS objects, count(DISTINCT source) AS variants FROM documents GROUP BY 1")
def g8_variants(spark, d):
    return Tables(spark, d).documents.groupBy(F.sha2("text", 256).alias("content")).agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("source").alias("variants"))


@query("SELECT conv_id, arg_min(violation, turn) AS violation, min(turn) AS turn FROM (SELECT conv_id, turn, CASE WHEN turn <> row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 THEN 'sequence' WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'role' END AS violation FROM conversations WHERE (conv_id + turn) % 5 <> 0) WHERE violation IS NOT NULL GROUP BY conv_id")
def w1_decision_log(spark, d):
    log = Tables(spark, d).conversations.where("(conv_id + turn) % 5 <> 0").withColumn("at", ordered.sequence_position(["conv_id"], ["turn"])).withColumn("was", ordered.previous("role", ["conv_id"], ["turn"]))
    return ordered.first_violation(log, ["conv_id"], "turn", [("sequence", F.col("turn") != F.col("at")), ("role", F.col("role") == F.col("was"))])


@query("SELECT user_id, event_id, row_number() OVER w - 1 AS generation, lag(event_id) OVER w AS prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w2_generation_chain(spark, d):
    chain = ordered.generation_chain(Tables(spark, d).events.select("user_id", "event_id"), "user_id", "event_id")
    return chain.withColumn("generation", F.col("generation").cast("long"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE turn % 3 <> 1) WHERE p IS NOT NULL AND turn <> p + 1")
def w3_strict_order(spark, d):
    turns = Tables(spark, d).conversations.where("turn % 3 <> 1").withColumn("p", ordered.previous("turn", ["conv_id"], ["turn"]))
    return turns.where("p is not null and turn <> p + 1").select("conv_id", "turn")


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
f AS (SELECT o_custkey, o_orderkey, bytes, rn, CAST(0 AS BIGINT) AS pack, bytes AS used FROM r WHERE rn = 1 UNION ALL SELECT r.o_custkey, r.o_orderkey, r.bytes, r.rn, CASE WHEN f.used > 0 AND f.used + r.bytes > 50000000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.used > 0 AND f.used + r.bytes > 50000000 THEN r.bytes ELSE f.used + r.bytes END FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.rn = f.rn + 1)
SELECT o_custkey, o_orderkey, bytes, pack FROM f""")
def w5_greedy_pack(spark, d):
    return ordered_stream.greedy_pack(Tables(spark, d).orders.withColumn("bytes", cents("o_totalprice")), "o_custkey", "o_orderkey", "bytes", 50_000_000)


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS pack FROM conversations")
def w6_fixed_groups(spark, d):
    return ordered.fixed_groups(Tables(spark, d).conversations.select("conv_id", "turn"), "conv_id", "turn", 3).withColumn("pack", F.col("pack").cast("long"))


@query("SELECT conv_id, max(n) AS peak FROM (SELECT conv_id, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n FROM conversations) GROUP BY conv_id")
def w7_lookahead(spark, d):
    return Tables(spark, d).conversations.withColumn("n", ordered.lookahead("conv_id", "turn", 4)).groupBy("conv_id").agg(F.max("n").alias("peak"))


@query("SELECT conv_id, max(b) AS peak, max(b) <= 2000 AS fits FROM (SELECT conv_id, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS BIGINT) AS b FROM conversations) GROUP BY conv_id")
def w8_queue_peak(spark, d):
    held = Tables(spark, d).conversations.withColumn("size", F.octet_length("text")).withColumn("b", ordered.queued_bytes("conv_id", "turn", "size", 2))
    return held.groupBy("conv_id").agg(F.max("b").alias("peak"), (F.max("b") <= 2000).alias("fits"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def w9_sample_offset(spark, d):
    turns = Tables(spark, d).conversations.withColumn("size", F.octet_length("text"))
    return turns.select("conv_id", "turn", ordered.running_offset("conv_id", "turn", "size").cast("long").alias("start"))


@query("SELECT conv_id, off, expected FROM (SELECT conv_id, turn * 10 AS off, coalesce(lag(turn * 10 + CASE WHEN (conv_id + turn) % 9 = 0 THEN 9 ELSE 10 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS expected FROM conversations) WHERE off <> expected")
def w11_extents(spark, d):
    extents = Tables(spark, d).conversations.select("conv_id", (F.col("turn") * 10).alias("off"), F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, 9).otherwise(10).alias("len"))
    return ordered.broken_extents(extents, "conv_id", "off", "len").select("conv_id", "off", "expected")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey) AS ordinal FROM part")
def o1_canonical_sort(spark, d):
    return ordered_stream.ranked(Tables(spark, d).part, "p_brand", ["p_type", "p_size", "p_partkey"]).select("p_partkey", "ordinal")


@query("(SELECT 'both' AS part, c_nationkey AS k FROM customer INTERSECT SELECT 'both', s_nationkey FROM supplier) UNION ALL (SELECT 'left' AS part, c_custkey FROM customer EXCEPT SELECT 'left', o_custkey FROM orders)")
def o7_set_ops(spark, d):
    t = Tables(spark, d)
    both = t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey")).select(F.lit("both").alias("part"), F.col("k").cast("long").alias("k"))
    return both.unionByName(t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey")).select(F.lit("left").alias("part"), "k"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600")
def o8_limit_guard(spark, d):
    return integrity.over_limit(Tables(spark, d).lineitem, ["l_suppkey"], 600)


_MARKED = "url || CASE page_id % 6 WHEN 0 THEN chr(10) WHEN 1 THEN chr(133) WHEN 2 THEN ' ' ELSE '' END"


def _marked(pages: DataFrame) -> DataFrame:
    """Pages with a text that ends in a line break, a control character beyond ASCII, a space or nothing."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("\n", "\x85", " ", "", "", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    return pages.withColumn("t", F.concat("url", mark)).withColumn("mark", mark)


@query(f"""SELECT page_id, regexp_full_match(t, '[a-z][a-z0-9.-]*:[A-Za-z0-9._/-]+') AS concept, regexp_full_match(sha256(url) || substr(t, length(url) + 1), '[0-9a-f]{{64}}') AS content_key,
regexp_full_match('lr.' || page_id || substr(t, length(url) + 1), '[a-z][a-z0-9._-]{{0,127}}') AS knob, regexp_full_match('seg.' || page_id || substr(t, length(url) + 1), '[a-z0-9][a-z0-9._-]*[a-z0-9_-]') AS label FROM (SELECT page_id, url, {_MARKED} AS t FROM pages)""")
def p1_grammar(spark, d):
    pages = _marked(Tables(spark, d).pages)
    made = lambda prefix: F.concat(F.lit(prefix), F.col("page_id").cast("string"), "mark")
    return pages.select("page_id", P.is_concept("t").alias("concept"), P.is_content_key(F.concat(F.sha2("url", 256), "mark")).alias("content_key"), P.is_knob(made("lr.")).alias("knob"), P.is_label_concept(made("seg.")).alias("label"))


@query(f"""SELECT page_id, NOT regexp_matches(t, '[\\x00-\\x1f\\x7f]') AND NOT contains(t, chr(133)) AS source_key, octet_length(encode(t)) <= 256 AND NOT regexp_matches(t, '[\\x00-\\x1f\\x7f]') AND NOT contains(t, chr(133)) AND NOT ends_with(t, ' ') AS purpose
FROM (SELECT page_id, {_MARKED} AS t FROM pages)""")
def p2_source_keys(spark, d):
    return _marked(Tables(spark, d).pages).select("page_id", P.is_source_key("t", "t").alias("source_key"), P.is_purpose("t").alias("purpose"))


_MEDIA = "CASE page_id % 7 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/' WHEN 2 THEN 'text' WHEN 3 THEN 'a/b/c' WHEN 4 THEN 'é/x' WHEN 5 THEN 'text/html' || chr(10) ELSE '~a/b' END"


@query(f"""SELECT page_id, regexp_full_match(m, '[^\\x00-\\x20\\x7f/]+/[^\\x00-\\x20\\x7f]+') AS atom, regexp_full_match(m, '[\\x21-\\x2e\\x30-\\x7e]+/[\\x21-\\x7e]+') AS adapter,
regexp_full_match(m, '[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{{0,126}}/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{{0,126}}') AS blob FROM (SELECT page_id, {_MEDIA} AS m FROM pages)""")
def p3_media_types(spark, d):
    m = F.element_at(F.array(*[F.lit(x) for x in ("text/html", "text/", "text", "a/b/c", "é/x", "text/html\n", "~a/b")]), (F.col("page_id") % 7 + 1).cast("int"))
    return Tables(spark, d).pages.select("page_id", P.is_atom_media(m).alias("atom"), P.is_adapter_media(m).alias("adapter"), P.is_blob_media(m).alias("blob"))


@query("""SELECT vec_id, CASE WHEN f < 0 THEN NULL WHEN CAST(len(embedding) AS HUGEINT) * f * 4 <= 18446744073709551615::HUGEINT THEN CAST(CAST(len(embedding) AS HUGEINT) * f * 4 AS VARCHAR) END AS bytes
FROM (SELECT vec_id, embedding, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 9000000000000000000 WHEN 2 THEN -2 ELSE 72057594037927935 END AS f FROM embeddings)""")
def p4_shape_product(spark, d):
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 9000000000000000000, -2, 72057594037927935)]), (F.col("vec_id") % 4 + 1).cast("int"))
    return Tables(spark, d).embeddings.select("vec_id", P.dense_bytes(F.array(F.size("embedding").cast("long"), factor), F.lit("f32")).cast("string").alias("bytes"))


@query("""SELECT page_id, NOT contains(p, '\\') AND NOT contains(p, chr(10)) AND NOT list_contains(string_split(p, '/'), '') AND NOT list_contains(string_split(p, '/'), '..') AS adapter,
NOT list_contains(string_split(p, '/'), '') AND NOT list_contains(string_split(p, '/'), '..') AND NOT list_contains(string_split(p, '/'), '.') AS forensic
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN './' WHEN 1 THEN '../' WHEN 2 THEN '' WHEN 3 THEN '/' ELSE '' END || 'a' || page_id || CASE page_id % 5 WHEN 4 THEN chr(10) ELSE '' END AS p FROM pages)""")
def p13_paths(spark, d):
    at = (F.col("page_id") % 5 + 1).cast("int")
    part = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), at)
    p = F.concat(part("./", "../", "", "/", ""), F.lit("a"), F.col("page_id").cast("string"), part("", "", "", "", "\n"))
    return Tables(spark, d).pages.select("page_id", P.is_adapter_path(p).alias("adapter"), P.is_forensic_path(p).alias("forensic"))


@query("""SELECT p_partkey, (p_size % 3 = 0 OR p_size * 2000 <= 65536) AND (p_size % 3 <> 0 OR p_size * 500 BETWEEN 4096 AND 1073741824) AND p_size * 100 <= 4096 AND NOT (p_size % 4 = 0 AND p_partkey % 5 = 0) AND NOT (p_partkey % 2 = 0 AND p_partkey % 7 = 0) AS valid FROM part""")
def p17_plan_ranges(spark, d):
    plans = Tables(spark, d).part.selectExpr(
        "p_partkey", "if(p_partkey % 7 = 0, 'compact', 'speed') as profile", "if(p_size % 3 = 0, null, p_size * 2000L) as group_rows", "if(p_size % 3 = 0, p_size * 500L, null) as group_bytes", "p_size * 100L as prefetch",
        "if(p_size % 4 = 0, 'materialize', 'stream') as access", "if(p_partkey % 5 = 0, 0L, 1024L) as cache_bytes", "p_partkey % 2 = 0 as external",
    )
    return plans.select("p_partkey", F.expr(execution.VALID).alias("valid"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'absent-at-source' WHEN l.toxic = 1 THEN 'withheld' ELSE 'present' END AS presence,
(l.doc_id IS NOT NULL AND l.toxic <> 1) = (d.doc_id % 3 <> 0) AS fits FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def t3_label_presence(spark, d):
    t = Tables(spark, d)
    state = F.when(F.col("toxic").isNull(), "absent-at-source").when(F.col("toxic") == 1, "withheld").otherwise("present")
    told = t.documents.join(t.labels, "doc_id", "left").select("doc_id", state.alias("presence"))
    return told.withColumn("fits", P.presence_matches("presence", F.col("doc_id") % 3 != 0))


@query("SELECT lang, sha256(string_agg(g, '' ORDER BY r)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, doc_id // 4096 AS r, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS g, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def t8_window_set_digest(spark, d):
    return training.set_digest(Tables(spark, d).documents, ["lang"], F.sha2("text", 256), "doc_id").select("lang", "digest", "n")


@query("SELECT user_id, max(event_id) AS latest, count(*) - 1 AS generation, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def st1_correction_chain(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.max("event_id").alias("latest"), (F.count(F.lit(1)) - 1).alias("generation"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, ts - CASE WHEN event_id % 50 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS t FROM events)) WHERE t < p")
def st3_watermark_monotonic(spark, d):
    events = Tables(spark, d).events.withColumn("t", F.expr("if(event_id % 50 = 0, ts - interval 20 days, ts)"))
    return events.withColumn("p", ordered.previous("t", ["user_id"], ["event_id"])).where("t < p").select("user_id", "event_id")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(spark, d):
    return Tables(spark, d).events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR GROUP BY user_id")
def st_sessions(spark, d):
    return Tables(spark, d).events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


_RECEIPTS = """SELECT doc_id AS receipt, CASE WHEN doc_id % 10 = 0 THEN 'none' WHEN doc_id % 2 = 0 THEN 'p2' ELSE 'p1' END AS profile, CASE WHEN doc_id % 8 = 0 THEN '2' ELSE '1' END AS edition, CASE WHEN doc_id % 3 = 0 THEN 'reject' ELSE 'accept' END AS expected_outcome,
quality = 1 AS internal_valid, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS observed_outcome, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 <> 0 OR doc_id % 2 = 0 END AS expected_outcome_observed,
CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'advice' ELSE 'conformance' END AS authority, doc_id % 5 <> 0 AS pass, doc_id % 4 = 1 AS promoted FROM labels"""


@query(f"""WITH r AS (SELECT *, CASE profile WHEN 'p1' THEN 'semantic' WHEN 'p2' THEN 'forensic' END AS status, internal_valid = (expected_outcome = 'accept') AS internal, coalesce(observed_outcome = expected_outcome AND expected_outcome_observed AND authority = 'conformance', false) AS independent FROM ({_RECEIPTS}))
SELECT receipt, ord, fault FROM (SELECT receipt, 0 AS ord, 'profile-not-registered' AS fault FROM r WHERE status IS NULL UNION ALL SELECT receipt, 1, 'edition' FROM r WHERE status IS NOT NULL AND edition <> '1' UNION ALL SELECT receipt, 2, 'internal-outcome' FROM r WHERE NOT internal
UNION ALL SELECT receipt, 3, 'observed-outcome' FROM r WHERE expected_outcome_observed <> (observed_outcome = expected_outcome) UNION ALL SELECT receipt, 4, 'pass' FROM r WHERE pass <> (internal AND independent)
UNION ALL SELECT receipt, 5, 'promotion' FROM r WHERE promoted <> (internal AND independent AND coalesce(status = 'semantic', false)))""")
def x1_receipt_logic(spark, d):
    Tables(spark, d).labels.createOrReplaceTempView("labels")
    registered = spark.createDataFrame([("p1", "1", "semantic"), ("p2", "1", "forensic")], "profile string, edition string, status string")
    return adapters.receipt_faults(spark.sql(_RECEIPTS), registered)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS storage_id FROM documents WHERE doc_id % 3 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 2")
def b13_store_insert(spark, d):
    objects = Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("storage_id"))
    return store.new_objects(objects.where("doc_id % 2 = 0"), objects.where("doc_id % 3 = 0"), "storage_id", "doc_id")


_EDGES = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"
_OBJECTS = "SELECT 'o' || o_orderkey AS node FROM orders UNION SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey <> 1"


def _objects(t: Tables) -> DataFrame:
    node = lambda df, kind, c: df.select(F.concat(F.lit(kind), F.col(c).cast("string")).alias("node"))
    kept = [node(t.orders, "o", "o_orderkey"), node(t.customer.where("c_custkey % 7 <> 0"), "c", "c_custkey"), node(t.supplier, "s", "s_suppkey")]
    return integrity.report([*kept, node(t.nation, "n", "n_nationkey"), node(t.region.where("r_regionkey <> 1"), "r", "r_regionkey")])


@query(f"""WITH RECURSIVE e AS ({_EDGES}), have AS ({_OBJECTS}), w(pin, node) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey FROM orders UNION SELECT pin, dst FROM w JOIN e ON src = node)
SELECT pin AS node, bool_and(have.node IS NOT NULL) AS complete FROM w LEFT JOIN have ON have.node = w.node GROUP BY pin""")
def b15_pin_closure(spark, d):
    t = Tables(spark, d)
    return store.pinnable(t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")), _objects(t), _edges(t))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), have AS ({_OBJECTS}), w(node) AS (SELECT 's' || s_suppkey FROM supplier UNION SELECT dst FROM w JOIN e ON src = node) SELECT node FROM have WHERE node IN (SELECT node FROM w)""")
def b14_export_closure(spark, d):
    t = Tables(spark, d)
    return store.export_closure(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")), _objects(t), _edges(t))


_SNAPSHOTS = """SELECT CAST(user_id AS VARCHAR) AS subscription_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS sequence,
event_id, event_id + CASE WHEN event_id % 1009 = 0 THEN -3000 ELSE 0 END AS watermark FROM events"""
_VIOLATIONS = f"""SELECT subscription_id, place AS sequence, CASE WHEN sequence <> place THEN 'sequence' ELSE 'watermark' END AS violation FROM (
SELECT *, row_number() OVER w - 1 AS place, lag(watermark) OVER w AS mark FROM ({_SNAPSHOTS}) WINDOW w AS (PARTITION BY subscription_id ORDER BY sequence, event_id))
WHERE sequence <> place OR watermark < mark QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY place) = 1"""


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).events.selectExpr(
        "cast(user_id as string) as subscription_id", "row_number() over (partition by user_id order by event_id) - 1L + if(event_id % 997 = 0, 1L, 0L) as sequence", "event_type as logical_id",
        "row_number() over (partition by user_id, event_type order by event_id) - 1L as generation", "lpad(event_id, 12, '0') as snapshot_id", "event_id + if(event_id % 1009 = 0, -3000L, 0L) as watermark",
        "nullif(row_number() over (partition by user_id, event_type order by event_id) - 2L, -1L) as prior_generation",
        "lag(lpad(event_id, 12, '0')) over (partition by user_id, event_type order by event_id) as prior_snapshot_id",
    )


@query(_VIOLATIONS)
def st1_first_violations(spark, d):
    return subscription.first_violations(_snapshots(spark, d))


@query(f"SELECT subscription_id, count(*) AS events, max(watermark) AS watermark FROM ({_SNAPSHOTS}) WHERE subscription_id NOT IN (SELECT subscription_id FROM ({_VIOLATIONS})) GROUP BY 1")
def st5_sealed(spark, d):
    return subscription.sealed(_snapshots(spark, d))


@query("SELECT CAST(user_id AS VARCHAR) AS subscription_id, event_type AS logical_id, count(*) - 1 AS generation, lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS snapshot_id FROM events GROUP BY 1, 2")
def st4_latest(spark, d):
    return subscription.latest(_snapshots(spark, d))


@query("SELECT date_trunc('hour', ts) + to_hours(CAST(k AS INTEGER)) AS hour, event_type, count(*) AS n FROM events, (VALUES (0), (-1)) t(k) GROUP BY 1, 2")
def st_sliding(spark, d):
    windows = Tables(spark, d).events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("w.start").alias("hour"), "event_type", "n")


def _report(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    parts = [
        v5_edge_endpoints(spark, d),
        integrity.failure(integrity.dangling(t.lineitem, "l_partkey", t.part.where("p_partkey % 23 <> 0"), "p_partkey").withColumn("at", F.concat_ws("/", "l_orderkey", "l_linenumber")), "V9", "E002", "lineitem.l_partkey", "at"),
        integrity.failure(integrity.dangling(t.customer, "c_nationkey", t.nation.where("n_nationkey <> 3"), "n_nationkey"), "V10", "E006", "customer.c_nationkey", "c_custkey"),
        v16_non_positive(spark, d),
        integrity.failure(v22_interval_order(spark, d).withColumn("at", F.concat_ws("/", "l_orderkey", "l_linenumber")), "V22", "E003", "lineitem.l_shipdate", "at"),
        integrity.failure(v4_duplicate_id(spark, d), "V4", "E001", "documents.text", "doc_id"),
    ]
    return integrity.report(parts)


@query(f"""SELECT * FROM ({ORACLES['v5_edge_endpoints']}) UNION ALL SELECT 'V9', 'E002', 'lineitem.l_partkey', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_partkey % 23 = 0
UNION ALL SELECT 'V10', 'E006', 'customer.c_nationkey', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT * FROM ({ORACLES['v16_non_positive']})
UNION ALL SELECT 'V22', 'E003', 'lineitem.l_shipdate', l_orderkey || '/' || l_linenumber FROM ({ORACLES['v22_interval_order']}) UNION ALL SELECT 'V4', 'E001', 'documents.text', CAST(doc_id AS VARCHAR) FROM ({ORACLES['v4_duplicate_id']})""")
def v_report(spark, d):
    return _report(spark, d)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return v_report(spark, sf_dir)
