"""Queries that run the dataset rules, training catalogs and sources on tables made from the star schema, each beside its SQL form.

Collections are made by rules that break some rows: a part whose key is divisible by 7 is no frame, and so on; the SQL says the same from the base
tables. Queries whose results are BLAKE3 identities have no SQL form; tests hold them against published values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions.ident import Names, blake3_hex, canonical_json, payload_id
from .model import rules
from .model import tables as model
from .model.exact import total_samples
from .operators import graph
from .plans import execution
from .queries import _SNAPSHOTS as _SNAPSHOTS_SQL
from .queries import ORACLES, QUERIES, Tables, _snapshots, query
from .sources import adapters, bundles, container, profiles, store
from .streaming import subscription
from .training import records
from .training import tables as training

FMT = container.Format(b"BRINDLE2", b"BRDLIDX\0", b"BRDLGEN\0")


def _rational(n: str, d: str = "1") -> str:
    return f"struct(cast({n} as string) as n, '{d}' as d)"


def _tables(spark: SparkSession, **filled: DataFrame) -> dict[str, DataFrame]:
    return model.empty(spark) | filled


def _failures(spark: SparkSession, rule: str, limits: rules.Limits = rules.Limits(), **filled: DataFrame) -> DataFrame:
    return rules.RULES[rule](_tables(spark, **filled), limits, Names()).select("dataset", "code", "path", "related")


def _datasets(t: Tables) -> DataFrame:
    return t.nation.selectExpr("concat('n', n_nationkey) as dataset", "concat('n', n_nationkey) as id")


def _recordings(t: Tables) -> DataFrame:
    """Customers; those with a key divisible by 11 list none of their orders."""
    listed = t.orders.where("o_custkey % 11 <> 0").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("o"), "o_orderkey"))).alias("streams"))
    rows = t.customer.join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.selectExpr("concat('n', c_nationkey) as dataset", "c_custkey as idx", "concat('c', c_custkey) as id", "coalesce(streams, cast(array() as array<string>)) as streams", "cast(array() as array<struct<namespace:string,value:string>>) as source_keys")


def _streams(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.selectExpr(
        "concat('n', c_nationkey) as dataset", "o_orderkey as idx", "concat('o', o_orderkey) as id", "concat('c', if(o_orderkey % 13 = 0, -1, o_custkey)) as recording_id", "lower(o_orderpriority) as modality",
        "cast(array() as array<string>) as atoms", "concat('s', o_orderkey % 100 + 1) as clock_id", "cast(null as string) as channel_basis_id", "if(o_orderkey % 10 = 0, 'none', null) as policy_id",
    )


def _clocks(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "concat('n', s_nationkey) as dataset", "cast(s_suppkey as long) as idx", "concat('s', s_suppkey) as id", "'k:clock' as kind", "if(s_suppkey > 25, concat('s', s_suppkey - 25), null) as parent_id",
        f"{_rational('0')} as offset", f"{_rational('cast(round(s_acctbal * 100) as long)', '100')} as rate", f"{_rational('if(s_suppkey % 9 = 0, -1, 0)')} as uncertainty",
    )


def _frames(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 7 <> 0").selectExpr(
        "'x' as dataset", "p_partkey as idx", "concat('p', p_partkey) as id", "'k:frame' as kind", "if(p_partkey % 4 = 0, concat('p', p_partkey - 1), null) as parent_id",
        "cast(null as array<struct<tag:string,n:string,d:string>>) as transform", f"{_rational('p_size - 2')} as uncertainty",
    )


@query("""SELECT d AS dataset, CAST(sum(n) AS BIGINT) AS budget FROM (SELECT 'n' || c_nationkey AS d, 64 + 16 * count(o_orderkey) FILTER (c_custkey % 11 <> 0) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey
UNION ALL SELECT 'n' || c_nationkey, 64 + strlen(o_orderpriority) FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'n' || s_nationkey, 64 + 7 FROM supplier) GROUP BY 1""")
def v2_dataset_budget(spark, d):
    t = Tables(spark, d)
    return rules.metadata_budget(_tables(spark, datasets=_datasets(t), recordings=_recordings(t), streams=_streams(t), clocks=_clocks(t))).select("dataset", F.col("budget").cast("long").alias("budget"))


@query("""SELECT 'n' || n_nationkey AS dataset, c AS collection, CASE c WHEN 'recordings' THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) WHEN 'clocks' THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)
WHEN 'streams' THEN (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) ELSE 0 END AS n FROM nation, (VALUES """ + ", ".join(f"('{c}')" for c in model.SCHEMAS) + ") v(c)")
def g2_family_counts(spark, d):
    t = Tables(spark, d)
    return model.family_counts(_tables(spark, datasets=_datasets(t), recordings=_recordings(t), streams=_streams(t), clocks=_clocks(t)))


@query("""SELECT 'n' || c_nationkey AS dataset, 'E002' AS code, 'streams[' || o_orderkey || '].recording_id' AS path, 'c-1' AS related FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 13 = 0
UNION ALL SELECT 'n' || c_nationkey, 'E002', 'streams[' || o_orderkey || '].recording_membership', 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 13 <> 0 AND o_custkey % 11 = 0""")
def v8_stream_membership(spark, d):
    t = Tables(spark, d)
    return _failures(spark, "v8", recordings=_recordings(t), streams=_streams(t))


@query("""SELECT 'n' || c_nationkey AS dataset, 'E006' AS code, 'streams[' || o_orderkey || '].clock_id' AS path, 's' || (o_orderkey % 100 + 1) AS related FROM orders JOIN customer ON c_custkey = o_custkey
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_orderkey % 100 + 1 AND s_nationkey = c_nationkey)""")
def v10_stream_clock(spark, d):
    t = Tables(spark, d)
    return _failures(spark, "v10", streams=_streams(t), clocks=_clocks(t))


def _lines(t: Tables) -> DataFrame:
    """Orders with their line numbers in order."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def _ragged(t: Tables) -> DataFrame:
    """Each order is a ragged table of its lines and the offsets of them; offsets are one too long for some orders and missing for others."""
    rows = _lines(t)
    payload = lambda content, element, shape, size, layout: f"struct({content} as content_id, cast({size} as decimal(20,0)) as logical_bytes, '{element}' as element, 'little' as byte_order, array({shape}) as shape, {layout} as layout, cast(null as string) as encoding, cast(null as string) as media_type)"
    none = "cast(null as string) as offsets, cast(null as string) as indices, cast(null as string) as indptr, cast(null as string) as scales"
    ragged = "struct('ragged' as tag, cast(n as decimal(20,0)) as rows, cast(null as decimal(20,0)) as nonzero, cast(null as long) as block_len, cast(null as int) as mantissa_bits, concat('f', l_orderkey) as offsets, cast(null as string) as indices, cast(null as string) as indptr, cast(null as string) as scales)"
    dense = f"struct('dense-row-major' as tag, cast(null as decimal(20,0)) as rows, cast(null as decimal(20,0)) as nonzero, cast(null as long) as block_len, cast(null as int) as mantissa_bits, {none})"
    extent = "cast(n + 1 + if(l_orderkey % 6 = 0, 1, 0) as decimal(20,0))"
    common = ["'x' as dataset", "'present' as presence", "cast(null as struct<scale:struct<n:string,d:string>,offset:struct<n:string,d:string>,unit:string>) as calibration",
              f"cast(null as struct<tag:string,segments:{model.SEGMENTS},timestamps:string,count:decimal(20,0)>) as time_axis", "cast(null as string) as clock_id", "cast(null as string) as record_kind"]
    rest = ["cast(null as struct<atom_kind:string,element:string,shape:array<decimal(20,0)>>) as decoded_semantics", "cast(null as string) as media_type", "cast(null as struct<algorithm:string,digest:string>) as integrity"]
    tables = rows.selectExpr(*common, "l_orderkey as idx", "concat('o', l_orderkey) as id", "'table' as kind", f"{payload('concat(chr(114), l_orderkey)', 'bytes', 'cast(n as decimal(20,0)), cast(1 as decimal(20,0))', 'n', ragged)} as payload",
                             "array(struct('k:c' as semantic, 'bytes' as element, false as nullable)) as columns", "cast(null as array<struct<semantic:string,extent:decimal(20,0)>>) as axes", *rest)
    offsets = rows.where("l_orderkey % 5 <> 0").selectExpr(*common, "l_orderkey + 100000000 as idx", "concat('g', l_orderkey) as id", "'tensor' as kind", f"{payload('concat(chr(102), l_orderkey)', 'i32', extent, '4 * (n + 1 + if(l_orderkey % 6 = 0, 1, 0)) + if(l_orderkey % 17 = 0, 1, 0)', dense)} as payload",
                                                           "cast(null as array<struct<semantic:string,element:string,nullable:boolean>>) as columns", f"array(struct('k:a' as semantic, {extent} as extent)) as axes", *rest)
    return tables.unionByName(offsets)


@query("SELECT DISTINCT 'x' AS dataset, 'E005' AS code, 'atoms[' || (l_orderkey + 100000000) || ']' AS path, 'g' || l_orderkey AS related FROM lineitem WHERE l_orderkey % 17 = 0 AND l_orderkey % 5 <> 0")
def v12_atom_rules(spark, d):
    return _failures(spark, "v12", atoms=_ragged(Tables(spark, d)))


@query("SELECT DISTINCT 'x' AS dataset, 'E002' AS code, 'atoms[' || l_orderkey || '].payload.companion' AS path, CAST(NULL AS VARCHAR) AS related FROM lineitem WHERE l_orderkey % 5 = 0")
def v14_missing_companions(spark, d):
    return _failures(spark, "v14", atoms=_ragged(Tables(spark, d)))


@query("SELECT DISTINCT 'x' AS dataset, 'E005' AS code, 'atoms[' || l_orderkey || '].payload.companion' AS path, 'o' || l_orderkey AS related FROM lineitem WHERE l_orderkey % 6 = 0 AND l_orderkey % 5 <> 0")
def v15_companion_rules(spark, d):
    return _failures(spark, "v15", atoms=_ragged(Tables(spark, d)))


@query("""SELECT 'n' || (user_id % 25) AS dataset, 'E006' AS code, 'atoms[' || event_id || '].clock_id' AS path, 's' || user_id AS related FROM events WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id AND s_nationkey = user_id % 25)""")
def v13_table_clock(spark, d):
    t = Tables(spark, d)
    atoms = t.events.selectExpr("concat('n', user_id % 25) as dataset", "event_id as idx", "concat('e', event_id) as id", "'temporal-table' as kind", "concat('s', user_id) as clock_id")
    return _failures(spark, "v13", atoms=atoms, clocks=_clocks(t))


@query("SELECT 'n' || s_nationkey AS dataset, 'E003' AS code, 'clocks[' || s_suppkey || ']' AS path, CAST(NULL AS VARCHAR) AS related FROM supplier WHERE CAST(round(s_acctbal * 100) AS BIGINT) <= 0 OR s_suppkey % 9 = 0")
def v16_clock_numbers(spark, d):
    return _failures(spark, "v16", clocks=_clocks(Tables(spark, d)))


@query("""SELECT 'n' || a.s_nationkey AS dataset, 'E006' AS code, 'clocks[' || a.s_suppkey || '].parent_id' AS path, 's' || (a.s_suppkey - 25) AS related FROM supplier a WHERE a.s_suppkey > 25
AND NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey = a.s_suppkey - 25 AND b.s_nationkey = a.s_nationkey)""")
def v17_clock_parents(spark, d):
    return _failures(spark, "v17", clocks=_clocks(Tables(spark, d)))


@query("""WITH RECURSIVE c AS (SELECT s_nationkey AS g, s_suppkey AS k, CASE WHEN s_suppkey > 25 THEN s_suppkey - 25 END AS p FROM supplier),
w AS (SELECT g, k AS start, k AS at, 1 AS n FROM c UNION ALL SELECT w.g, w.start, c.p, n + 1 FROM w JOIN c ON c.g = w.g AND c.k = w.at WHERE c.p IS NOT NULL AND n <= 1)
SELECT 'n' || g AS dataset, 'E012' AS code, 'clocks[' || start || '].ancestry_depth' AS path, CAST(NULL AS VARCHAR) AS related FROM w WHERE n > 1""")
def v18_clock_ancestry(spark, d):
    return _failures(spark, "v18", rules.Limits(nesting=1), clocks=_clocks(Tables(spark, d)))


@query("""SELECT 'x' AS dataset, 'E003' AS code, 'coordinate_frames[' || p_partkey || '].uncertainty' AS path, CAST(NULL AS VARCHAR) AS related FROM part WHERE p_size < 2 AND p_partkey % 7 <> 0
UNION ALL SELECT 'x', 'E007', 'coordinate_frames[' || p_partkey || '].parent_id', 'p' || (p_partkey - 1) FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 4 = 0 AND (p_partkey - 1) % 7 = 0""")
def v19_frames(spark, d):
    return _failures(spark, "v19", coordinate_frames=_frames(Tables(spark, d)))


@query("""WITH r AS (SELECT 'n' || s_nationkey AS dataset, s_nationkey AS g, l_orderkey * 10 + l_linenumber AS idx, l_suppkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT dataset, 'E006' AS code, 'clock_relations[' || idx || '].to_clock_id' AS path, 's' || (k + 25) AS related FROM r WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k + 25 AND s_nationkey = g)
UNION ALL SELECT dataset, 'E003', 'clock_relations[' || idx || ']', NULL FROM r WHERE q <= 3 UNION ALL SELECT dataset, 'E003', 'clock_relations[' || idx || '].validity', NULL FROM r WHERE n < 3 AND n % 5 <> 0""")
def v20_clock_relations(spark, d):
    t = Tables(spark, d)
    day = "datediff(cast(l_shipdate as date), date'1990-01-01')"
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).selectExpr(
        "concat('n', s_nationkey) as dataset", "l_orderkey * 10 + l_linenumber as idx", "concat('s', l_suppkey) as from_clock_id", "concat('s', l_suppkey + 25) as to_clock_id", f"{_rational('cast(l_quantity as long) - 3')} as rate", f"{_rational('0')} as uncertainty",
        f"{_rational(day, '7')} as validity_start", f"if(l_linenumber % 5 = 0, null, {_rational(f'({day} + l_linenumber - 3) * 3', '21')}) as validity_end",
    )
    return _failures(spark, "v20", clock_relations=rows, clocks=_clocks(t))


@query("""SELECT 'x' AS dataset, 'E007' AS code, 'frame_transforms[' || (l_orderkey * 10 + l_linenumber) || '].from_frame_id' AS path, 'p' || l_partkey AS related FROM lineitem WHERE l_partkey % 7 = 0
UNION ALL SELECT 'x', 'E007', 'frame_transforms[' || (l_orderkey * 10 + l_linenumber) || '].to_frame_id', 'p' || l_suppkey FROM lineitem WHERE l_suppkey % 7 = 0
UNION ALL SELECT 'x', 'E003', 'frame_transforms[' || (l_orderkey * 10 + l_linenumber) || '].uncertainty', NULL FROM lineitem WHERE l_linenumber = 1""")
def v21_frame_transforms(spark, d):
    t = Tables(spark, d)
    rows = t.lineitem.selectExpr("'x' as dataset", "l_orderkey * 10 + l_linenumber as idx", "concat('p', l_partkey) as from_frame_id", "concat('p', l_suppkey) as to_frame_id", f"{_rational('l_linenumber - 2')} as uncertainty")
    return _failures(spark, "v21", frame_transforms=rows, coordinate_frames=_frames(t))


@query("""SELECT 'n' || (user_id % 25) AS dataset, 'E006' AS code, 'events[' || event_id || '].clock_id' AS path, 's' || user_id AS related FROM events WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id AND s_nationkey = user_id % 25)
UNION ALL SELECT 'n' || (user_id % 25), 'E003', 'events[' || event_id || '].interval', NULL FROM events WHERE event_id % 8 < 2 OR event_id % 19 = 0""")
def v22_events(spark, d):
    t = Tables(spark, d)
    rows = t.events.selectExpr("concat('n', user_id % 25) as dataset", "event_id as idx", "concat('s', user_id) as clock_id", f"{_rational('event_id', '3')} as start", f"{_rational('event_id * 5 + 5 * (event_id % 8 - 2)', '15')} as end", f"{_rational('if(event_id % 19 = 0, -1, 0)')} as uncertainty")
    return _failures(spark, "v22", events=rows, clocks=_clocks(t))


def _derivations(t: Tables) -> DataFrame:
    """Orders derive an artifact from the frames of their lines; every fourth puts none out."""
    inputs = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(F.lit("coordinate-frame").alias("kind"), F.concat(F.lit("p"), x["l_partkey"]).alias("id"))).alias("inputs"))
    return inputs.selectExpr("'x' as dataset", "l_orderkey as idx", "concat('o', l_orderkey) as id", "'k:derive' as operation", "inputs", "if(l_orderkey % 4 = 0, cast(array() as array<struct<kind:string,id:string>>), array(struct('derived-artifact' as kind, concat('a', l_orderkey) as id))) as outputs")


def _artifacts(t: Tables) -> DataFrame:
    return t.orders.selectExpr("'x' as dataset", "o_orderkey as idx", "concat('a', o_orderkey) as id", "'-' as content_id", "if(o_orderkey % 9 = 0, 'none', concat('o', o_orderkey)) as derivation_id")


@query("""SELECT 'x' AS dataset, 'E002' AS code, 'derived_artifacts[' || o_orderkey || '].derivation_id' AS path, 'none' AS related FROM orders WHERE o_orderkey % 9 = 0
UNION ALL SELECT 'x', 'E002', 'derived_artifacts[' || o_orderkey || '].derivation_output', 'a' || o_orderkey FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'x', 'E002', 'derived_artifacts[' || o_orderkey || '].derivation_id', 'o' || o_orderkey FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def v23_artifacts(spark, d):
    t = Tables(spark, d)
    return _failures(spark, "v23", derived_artifacts=_artifacts(t), derivations=_derivations(t))


def _bases(t: Tables) -> DataFrame:
    channels = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(F.lit("k:c").alias("concept"), F.concat(F.lit("p"), x["l_partkey"]).alias("coordinate_frame_id"), F.array().cast(model.KEYS).alias("source_keys")))
    return t.lineitem.groupBy("l_orderkey").agg(channels.alias("channels")).selectExpr("'x' as dataset", "l_orderkey as idx", "concat('o', l_orderkey) as id", "'common' as reference", "channels")


@query("SELECT 'x' AS dataset, 'E012' AS code, 'channel_bases[' || l_orderkey || '].channels' AS path, CAST(NULL AS VARCHAR) AS related FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5")
def v24_channel_count(spark, d):
    return _failures(spark, "v24", rules.Limits(channels=5), channel_bases=_bases(Tables(spark, d)))


@query("""SELECT 'x' AS dataset, 'E007' AS code, 'channel_bases[' || l_orderkey || '].channels[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) || '].coordinate_frame_id' AS path, 'p' || l_partkey AS related
FROM lineitem QUALIFY l_partkey % 7 = 0""")
def v25_channel_frames(spark, d):
    t = Tables(spark, d)
    return _failures(spark, "v25", channel_bases=_bases(t), coordinate_frames=_frames(t))


def _policies(t: Tables) -> DataFrame:
    return t.customer.selectExpr("'x' as dataset", "c_custkey as idx", "concat('c', c_custkey) as id", "if(c_custkey % 10 = 0, null, concat('c', if(c_custkey % 41 = 0, -1, c_custkey * 3 % 50 + 1))) as parent_id",
                                 "array_compact(array('z', if(c_custkey % 2 = 0, 'a', null), if(c_custkey % 3 = 0, 'b', null))) as restrictions")


_POLICIES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN -1 ELSE c_custkey * 3 % 50 + 1 END AS p FROM customer"


@query(f"""SELECT 'x' AS dataset, 'E002' AS code, 'policies[' || k || '].parent_id' AS path, 'c-1' AS related FROM ({_POLICIES}) WHERE p = -1
UNION ALL SELECT 'x', 'E010', 'policies[' || k || '].restrictions', NULL FROM ({_POLICIES}) WHERE p >= 0 AND (p % 2 = 0 AND k % 2 <> 0 OR p % 3 = 0 AND k % 3 <> 0)""")
def v26_policies(spark, d):
    return _failures(spark, "v26", policies=_policies(Tables(spark, d)))


@query(f"""WITH RECURSIVE b AS ({_POLICIES}), c AS (SELECT k, CASE WHEN p >= 0 THEN p END AS p FROM b), w AS (SELECT k AS start, p AS up, [k] AS seen FROM c UNION ALL SELECT start, c.p, list_append(seen, c.k) FROM w JOIN c ON c.k = w.up WHERE NOT list_contains(seen, w.up) AND len(seen) <= 5)
SELECT 'x' AS dataset, CASE WHEN len(seen) > 5 THEN 'E012' ELSE 'E010' END AS code, 'policies[' || start || CASE WHEN len(seen) > 5 THEN '].ancestry_depth' ELSE '].ancestry_cycle' END AS path, CAST(NULL AS VARCHAR) AS related
FROM w WHERE (len(seen) > 5 OR list_contains(seen, up)) AND start NOT IN (SELECT k FROM b WHERE p = -1)""")
def v27_policy_ancestry(spark, d):
    return _failures(spark, "v27", rules.Limits(nesting=5), policies=_policies(Tables(spark, d)))


@query("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'derivation' ELSE 'policy-attestation' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'derivation' ELSE 'policy' END AS subject, CASE WHEN c_custkey % 3 = 0 THEN c_custkey IN (SELECT l_orderkey FROM lineitem) ELSE true END AS known FROM customer)
SELECT 'x' AS dataset, 'E002' AS code, 'proofs[' || k || '].subject' AS path, CAST(NULL AS VARCHAR) AS related FROM r WHERE NOT known UNION ALL SELECT 'x', 'E009', 'proofs[' || k || ']', NULL FROM r WHERE known AND (kind = 'derivation') <> (subject = 'derivation')""")
def v28_proofs(spark, d):
    t = Tables(spark, d)
    proofs = t.customer.selectExpr("'x' as dataset", "c_custkey as idx", "concat('q', c_custkey) as id", f"concat('{Names().concept}:proof/', if(c_custkey % 2 = 0, 'derivation', 'policy-attestation')) as kind",
                                   "if(c_custkey % 3 = 0, struct('derivation' as kind, concat('o', c_custkey) as id), struct('policy' as kind, concat('c', c_custkey) as id)) as subject", "'-' as payload")
    return _failures(spark, "v28", proofs=proofs, policies=_policies(t), derivations=_derivations(t))


@query("SELECT 'x' AS dataset, 'E002' AS code, 'derivations[' || l_orderkey || ']' AS path, CAST(NULL AS VARCHAR) AS related FROM lineitem WHERE l_partkey % 7 = 0 UNION ALL SELECT 'x', 'E002', 'derivations[' || o_orderkey || ']', NULL FROM orders WHERE false")
def v29_derivation_references(spark, d):
    t = Tables(spark, d)
    artifacts = t.lineitem.selectExpr("'x' as dataset", "l_orderkey as idx", "concat('a', l_orderkey) as id").distinct()
    return _failures(spark, "v29", derivations=_derivations(t), coordinate_frames=_frames(t), derived_artifacts=artifacts)


@query("""SELECT 'x' AS dataset, 'E002' AS code, 'fidelity[' || doc_id || '].subject' AS path, CAST(NULL AS VARCHAR) AS related FROM labels WHERE doc_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'x', 'E004', 'fidelity[' || doc_id || ']', NULL FROM labels WHERE NOT CASE quality + toxic WHEN 0 THEN quality <> 1 AND toxic <> 1 WHEN 1 THEN quality = 1 AND toxic = 1 ELSE quality = 1 END""")
def v30_fidelity(spark, d):
    t = Tables(spark, d)
    rows = t.labels.selectExpr("'x' as dataset", "doc_id as idx", "struct('policy' as kind, concat('c', doc_id) as id) as subject", "case quality + toxic when 0 then 'exact' when 1 then 'bounded' else 'transformed' end as kind",
                               "if(quality = 1, 'k:m', null) as metric", "if(toxic = 1, struct('integer' as tag, '1' as n, '1' as d), null) as bound")
    return _failures(spark, "v30", fidelity=rows, policies=_policies(t))


_RULES = ("v8_stream_membership", "v10_stream_clock", "v12_atom_rules", "v14_missing_companions", "v15_companion_rules", "v13_table_clock", "v16_clock_numbers", "v17_clock_parents", "v19_frames", "v20_clock_relations", "v21_frame_transforms", "v22_events", "v23_artifacts", "v25_channel_frames", "v26_policies", "v28_proofs", "v30_fidelity")


@query(" UNION ALL ".join(f"SELECT '{name.split('_')[0]}' AS rule, dataset, code, path, related FROM ({ORACLES[name]})" for name in _RULES))
def v_dataset_report(spark, d):
    """The failures of all these rules in one table, as one plan."""
    return rules.union([QUERIES[name](spark, d).select(F.lit(name.split("_")[0]).alias("rule"), "dataset", "code", "path", "related") for name in _RULES])


@query("SELECT DISTINCT 'x' AS dataset, c AS content_id FROM (SELECT 'r' || l_orderkey AS c FROM lineitem UNION ALL SELECT 'f' || l_orderkey FROM lineitem)")
def g3_dataset_closure(spark, d):
    return model.payload_closure(_tables(spark, atoms=_ragged(Tables(spark, d))))


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'wrong-kind' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'found' ELSE 'missing' END AS state FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'g' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'missing' ELSE 'wrong-kind' END FROM orders WHERE o_orderkey % 3 = 0")
def c4_atom_views(spark, d):
    t = Tables(spark, d)
    wanted = t.orders.selectExpr("'x' as dataset", "concat(if(o_orderkey % 3 = 0, 'g', 'o'), o_orderkey) as id")
    return model.atom_view(_tables(spark, atoms=_ragged(t)), wanted, "table").select("id", "state")


@query("SELECT 's' || s_suppkey AS id, s_suppkey AS idx FROM supplier")
def c5_typed_lookup(spark, d):
    t = Tables(spark, d)
    again = _clocks(t).withColumn("idx", F.col("idx") + 1000)
    found = model.lookup(_clocks(t).unionByName(again), _clocks(t).select("dataset", "id"))
    return found.select("id", F.col("record.idx").alias("idx"))


@query("SELECT user_id, CAST(CASE WHEN user_id % 4 = 0 THEN NULL ELSE sum(event_id) END AS BIGINT) AS samples FROM events GROUP BY user_id")
def g4_sample_count(spark, d):
    t = Tables(spark, d)
    big = F.when(F.col("user_id") % 4 == 0, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    per = t.events.groupBy("user_id").agg(F.sum("event_id").alias("n"), F.count(F.lit(1)).alias("k"))
    parts = F.array(F.struct(big.alias("samples")), F.struct((F.col("n") - F.col("k")).cast("decimal(20,0)").alias("samples")), F.struct(F.col("k").cast("decimal(20,0)").alias("samples")))
    return per.select("user_id", total_samples(parts).cast("long").alias("samples"))


# training


def _rows(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "concat('o', l_orderkey) as snapshot", "sha2(cast(l_partkey as string), 256) as logical_id", "sha2('g', 256) as group", "sha2('s', 256) as split", "sha2('l', 256) as label", "sha2(cast(l_linenumber % 5 as string), 256) as payload", "'i16' as element",
        "if(l_orderkey % 8 = 0, 'not-applicable', 'little') as byte_order", "array(cast(l_linenumber % 5 as long)) as shape", "cast(l_linenumber % 5 * 2 + if(l_orderkey % 12 = 1, 1, 0) as long) as logical_bytes",
    )


def _headers(t: Tables) -> DataFrame:
    return t.orders.selectExpr("concat('o', o_orderkey) as snapshot", "sha2('spec', 256) as spec_id", "'balanced' as profile", "sha2('log', 256) as decision_log_id", "if(o_orderkey % 11 = 0, cast(array() as array<string>), array(sha2(cast(o_custkey as string), 256))) as dataset_roots")


_FAULTS = """SELECT 'o' || o_orderkey AS s, 0 AS ord, '' AS key, 'invalid-snapshot' AS code FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'o' || l_orderkey, 2, sha256(CAST(l_partkey AS VARCHAR)), 'duplicate-logical-row' FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 'o' || l_orderkey, 3, sha256(CAST(l_partkey AS VARCHAR)), CASE WHEN l_linenumber % 5 = 0 THEN 'invalid-row-extent' WHEN l_orderkey % 8 = 0 THEN 'invalid-byte-order' ELSE 'invalid-row-extent' END FROM lineitem WHERE l_linenumber % 5 = 0 OR l_orderkey % 8 = 0 OR l_orderkey % 12 = 1"""


@query(f"SELECT s AS snapshot, code, key FROM ({_FAULTS}) QUALIFY row_number() OVER (PARTITION BY s ORDER BY ord, key, code) = 1")
def t2_snapshot_faults(spark, d):
    t = Tables(spark, d)
    return training.first_faults(training.snapshot_faults(_headers(t), _rows(t), spark.createDataFrame([], training.LABELS)))


@query(None)
def t2_snapshot_seals(spark, d):
    """snapshot, its first fault or its identity; the identities are BLAKE3."""
    t = Tables(spark, d)
    return training.seal_snapshots(_headers(t), _rows(t), spark.createDataFrame([], training.LABELS)).select("snapshot", "code", "snapshot_id")


@query(None)
def t1_spec_identity(spark, d):
    """Identities of one specification a part, whose seed is the part's key."""
    keys = {k: F.sha2(F.lit(k), 256).alias(k) for k in records.SPEC_KEYS}
    spec = F.to_json(F.struct(*keys.values(), F.lit("research").alias("authorized_purpose"), F.col("p_partkey").alias("seed"), F.array(F.lit("lr"), F.lit("lr"), F.lit("batch.size")).alias("allowed_adaptive_knobs")))
    return training.spec_identities(Tables(spark, d).part.select(spec.alias("spec")))


@query("""WITH w AS (SELECT DISTINCT 'o' || l_orderkey AS s, sha256(CAST(l_linenumber % 5 AS VARCHAR)) AS k FROM lineitem), f AS (SELECT 'o' || o_orderkey AS s, sha256(CAST(v AS VARCHAR)) AS k FROM orders, (VALUES (1), (2), (3)) t(v))
SELECT s AS snapshot, 'missing-payload' AS code, k AS key FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.s = w.s AND f.k = w.k) UNION ALL SELECT s, 'extra-payload', k FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE f.s = w.s AND f.k = w.k)""")
def t4_payload_closure(spark, d):
    t = Tables(spark, d)
    frames = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("snapshot"), F.explode(F.array(*[F.struct(F.sha2(F.lit(str(v)), 256).alias("content_id"), F.lit("i16").alias("element"), F.lit(bytes(2 * v)).alias("data")) for v in (1, 2, 3)])).alias("f")).select("snapshot", "f.*")
    faults = training.closure_faults(_rows(t), spark.createDataFrame([], training.LABELS), frames)
    return faults.where("ord < 2").select("snapshot", "code", "key")


@query(None)
def t5_plan_identities(spark, d):
    """The compiled plan of each profile and its identity."""
    rows = [(p[0], canonical_json(records.plan_document(execution.compile_plan(p[0]))), records.plan_id(execution.compile_plan(p[0]))) for p in execution.DEFAULT_PLANS]
    return spark.createDataFrame(rows, "profile string, plan string, plan_id string")


_PLANS = (("balanced", 16), ("compact", 4), ("memory", 1), ("speed", 64), ("stream", 2), ("ultra-compact", 0))


@query(" UNION ALL ".join(f"""SELECT k AS snapshot, '{p}' AS profile, count(*) AS row_count, CAST(sum(b) AS BIGINT) AS bytes, max(a) - 1 AS lookahead, CAST(max(h) AS BIGINT) AS peak_bytes, {"max(h) <= 8388608" if p == "stream" else "max(h) <= 16777216" if p == "ultra-compact" else "true"} AS fits FROM
(SELECT user_id AS k, b, sum(b) OVER w AS h, count(*) OVER w AS a FROM (SELECT user_id, event_id AS i, 100000 + event_id * 7919 % 1000003 AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING)) GROUP BY k""" for p, n in _PLANS))
def t6_execution_metrics(spark, d):
    rows = Tables(spark, d).events.selectExpr("user_id as snapshot", "event_id as logical_id", "100000 + event_id * 7919 % 1000003 as logical_bytes")
    out = training.execution_metrics(rows, execution.default_plans(spark))
    return out.select("snapshot", "profile", "row_count", "bytes", F.col("lookahead").cast("long").alias("lookahead"), "peak_bytes", "fits")


_DECISIONS = """SELECT conv_id AS log, turn AS place, turn + CASE WHEN (conv_id + turn) % 37 = 0 THEN 1 ELSE 0 END AS sequence, CASE WHEN conv_id % 29 = 0 AND turn = 2 THEN 1 ELSE 0 END AS rank, (conv_id + turn) % 31 <> 0 AS durable,
CASE WHEN (conv_id + 2 * turn) % 23 = 0 THEN '' ELSE role END AS knob, turn * 10 - CASE WHEN (conv_id + turn) % 17 = 0 THEN 15 ELSE 0 END AS barrier FROM conversations"""


def _decisions(t: Tables) -> DataFrame:
    return t.conversations.selectExpr(
        "conv_id as log", "turn as place", "turn + if((conv_id + turn) % 37 = 0, 1, 0) as sequence", "if(conv_id % 29 = 0 and turn = 2, 1, 0) as rank", "(conv_id + turn) % 31 <> 0 as durable_before_activation", "if((conv_id + 2 * turn) % 23 = 0, '', role) as knob",
        "turn * 10 - if((conv_id + turn) % 17 = 0, 15, 0) as activation_barrier", "sha2(text, 256) as decision",
    )


@query(f"""WITH j AS (SELECT *, lag(barrier) OVER (PARTITION BY log ORDER BY place) AS before FROM ({_DECISIONS})), c AS (SELECT log, place, CASE WHEN sequence <> place THEN 'invalid-decision-sequence' WHEN rank <> 0 THEN 'rank-not-zero' WHEN NOT durable THEN 'decision-was-not-durable'
WHEN knob = '' THEN 'invalid-adaptive-knob' WHEN barrier < before THEN 'activation-barrier-regression' END AS code, knob FROM j)
SELECT log, place, code FROM (SELECT log, 0 AS ord, place, code FROM c WHERE code IS NOT NULL UNION ALL SELECT log, 1, place, 'invalid-adaptive-knob' FROM c WHERE knob = 'user') QUALIFY row_number() OVER (PARTITION BY log ORDER BY ord, place, code) = 1""")
def w1_decision_faults(spark, d):
    decisions = _decisions(Tables(spark, d))
    allowed = decisions.select("log", "knob").where("knob <> 'user'").distinct()
    allowed = allowed.unionByName(decisions.select("log").distinct().withColumn("knob", F.lit("")))
    return training.decision_faults(decisions, allowed)


@query("SELECT conv_id AS log, count(*) AS records, min(turn) FILTER (conv_id % 3 = 0 AND turn % 4 = 3) AS differs_at FROM conversations GROUP BY conv_id")
def t7_decision_replay(spark, d):
    decisions = _decisions(Tables(spark, d))
    again = decisions.withColumn("knob", F.when((F.col("log") % 3 == 0) & (F.col("place") % 4 == 3), "other").otherwise(F.col("knob")))
    return training.replays(decisions, again)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'different' END AS state FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 UNION ALL SELECT -1, 'extra'")
def t8_source_equivalence(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "lang", F.sha2("text", 256).alias("content"))
    other = docs.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    return training.equivalent(docs, other.unionByName(spark.createDataFrame([(-1, "x", "y")], docs.schema)), ["doc_id"])


@query("SELECT 'o' || l_orderkey AS snapshot, sha256(CAST(l_partkey AS VARCHAR)) AS logical_id, CASE WHEN l_linenumber % 5 = 0 THEN 'extent' WHEN l_orderkey % 8 = 0 THEN 'byte-order' WHEN l_orderkey % 12 = 1 THEN 'extent' END AS fault FROM lineitem")
def p6_training_extents(spark, d):
    rows = _rows(Tables(spark, d))
    return rows.select("snapshot", "logical_id", P.training_extent_fault(F.col("shape"), F.col("element"), F.col("byte_order"), F.col("logical_bytes")).alias("fault"))


@query(f"SELECT subscription_id, count(*) AS events, max(CASE violation WHEN 'sequence' THEN 'invalid-subscription-sequence' WHEN 'watermark' THEN 'non-monotonic-watermark' END) AS code FROM (SELECT s.subscription_id, v.violation FROM ({_SNAPSHOTS_SQL}) s LEFT JOIN ({ORACLES['st1_first_violations']}) v USING (subscription_id)) GROUP BY 1")
def st2_closed_subscriptions(spark, d):
    return subscription.closed(_snapshots(spark, d)).select("subscription_id", "events", "code")


# sources


@query("SELECT vec_id, CAST(c AS BIGINT) AS profile, k AS root_kind, CASE c WHEN 65537 THEN k IN (1, 2, 6) WHEN 327682 THEN k IN (5, 6) ELSE false END AS accepted FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 65537 WHEN 1 THEN 327682 ELSE 7 END AS c, vec_id % 6 + 1 AS k FROM embeddings)")
def p16_profile_acceptance(spark, d):
    rows = Tables(spark, d).embeddings.selectExpr("vec_id", "element_at(array(65537L, 327682L, 7L), cast(vec_id % 3 + 1 as int)) as profile", "cast(vec_id % 6 + 1 as int) as root_kind")
    return profiles.with_profile(rows).select("vec_id", "profile", F.col("root_kind").cast("long").alias("root_kind"), "accepted")


@query("""SELECT source AS object, count(*) AS entry_count, CAST(sum(strlen(text)) AS BIGINT) AS logical_bytes, CASE WHEN arg_min(CASE WHEN doc_id % 97 = 0 THEN 'invalid-path' END, 'd/' || doc_id) IS NOT NULL THEN 'invalid-path' WHEN sum(strlen(text)) > 60000 THEN 'source-too-large' END AS fault
FROM documents GROUP BY source""")
def c11_inspect_files(spark, d):
    files = Tables(spark, d).documents.selectExpr("source as object", "concat('d/', doc_id, if(doc_id % 97 = 0, '/..', '')) as path", "encode(text, 'UTF-8') as data")
    return adapters.inspect_files(files, 60_000).select("object", "entry_count", F.col("logical_bytes").cast("long").alias("logical_bytes"), "fault")


@query("SELECT DISTINCT lang AS id, CASE WHEN lang = 'en' THEN 'duplicate' WHEN lang = 'de' THEN 'media-type' ELSE 'capabilities' END AS fault FROM documents WHERE lang IN ('en', 'de', 'fr')")
def a12_adapter_profiles(spark, d):
    once = Tables(spark, d).documents.select("lang").where("lang is not null").distinct()
    twice = once.unionByName(once.where("lang = 'en'"))
    core = F.array(*[F.lit(c) for c in sorted(adapters.CORE)])
    rows = twice.select(F.col("lang").alias("id"), F.lit("s").alias("standard"), F.lit("1").alias("edition"), F.array(F.when(F.col("lang") == "de", "a b/c").otherwise("a/b")).alias("media_types"), F.when(F.col("lang") == "fr", "stream").otherwise("forensic").alias("status"),
                        F.lit("v").alias("required_validator"), core.alias("capabilities"))
    return adapters.registry_faults(rows)


@query("""SELECT DISTINCT sha256(text) AS storage_id FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE doc_id % 100 = 0 AND lang IS NOT NULL) AND lang IS NOT NULL""")
def r3_collect_objects(spark, d):
    docs = Tables(spark, d).documents.where("lang is not null")
    objects = docs.select(F.sha2("text", 256).alias("storage_id"), F.col("lang").alias("content_id")).distinct().withColumn("references", F.array().cast("array<string>"))
    pins = docs.where("doc_id % 100 = 0").select(F.col("lang").alias("node")).distinct()
    return store.collectable(objects, pins).select("storage_id").distinct()


@query("SELECT 'o' || o_orderkey AS node, 0 AS depth, true AS there FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 1, o_custkey % 7 <> 0 FROM orders")
def r1_missing_nodes(spark, d):
    t = Tables(spark, d)
    roots = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    edges = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    nodes = roots.unionByName(t.customer.where("c_custkey % 7 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")))
    return graph.closure_or_missing(roots, nodes, edges)


@query(None)
def ident_payloads(spark, d):
    """BLAKE3 of every document's text; the whole tables' texts are hashed."""
    return Tables(spark, d).documents.select("doc_id", blake3_hex(F.col("text").cast("binary")).alias("content_id"))


def _documents(t: Tables) -> DataFrame:
    """One dataset document a customer: a recording whose streams are the orders."""
    null = F.lit(None).cast("string")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 32, "0")
    streams = t.orders.select(F.col("o_custkey").alias("k"), hexed(F.col("o_orderkey") + (1 << 40)).alias("s")).groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("streams"))
    rows = t.customer.join(streams, F.col("c_custkey") == F.col("k"), "left").withColumn("streams", F.coalesce("streams", F.array().cast("array<string>")))
    recording = F.struct(hexed(F.col("c_custkey")).alias("id"), F.array().cast(model.KEYS).alias("source_keys"), "streams")
    stream = F.transform("streams", lambda s: F.struct(F.array().cast("array<string>").alias("atoms"), null.alias("channel_basis_id"), null.alias("clock_id"), s.alias("id"), F.lit("core:modality/eeg").alias("modality"), null.alias("policy_id"), hexed(F.col("c_custkey")).alias("recording_id")))
    rest = [F.array().cast("array<string>").alias(c) for c in model.SCHEMAS if c not in ("recordings", "streams")]
    body = F.to_json(F.struct(hexed(F.col("c_custkey") + (1 << 41)).alias("dataset_id"), F.lit("1").alias("semantic_version"), F.array(recording).alias("recordings"), stream.alias("streams"), *rest), {"ignoreNullFields": "false"})
    return rows.select(F.concat(F.lit("c"), "c_custkey").alias("path"), body.cast("binary").alias("content"))


@query(None)
def ident_datasets(spark, d):
    """Logical and interchange identity of one dataset document a customer, read and checked."""
    return model.read_documents(_documents(Tables(spark, d))).select("dataset", "dataset_id", "is_canonical", "logical_id", "interchange_id", "error_message")


@query("SELECT 'c' || c_custkey AS dataset, CAST(64 + 64 * count(o_orderkey) + count(o_orderkey) * (16 + strlen('core:modality/eeg')) AS BIGINT) AS budget FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a1_parsed_budget(spark, d):
    """Documents are read into tables, and the budget is summed on those."""
    t = model.collections(graph.cut(model.records(_documents(Tables(spark, d)))))
    return rules.metadata_budget(t).select("dataset", F.col("budget").cast("long").alias("budget"))


@query("SELECT 'c' || c_custkey AS dataset, 'E012' AS code, 'streams' AS path FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 12")
def a1_document_failures(spark, d):
    """Every rule on the parsed documents; customers of more than 12 orders pass the limit on streams, nothing else fails."""
    t = model.collections(graph.cut(model.records(_documents(Tables(spark, d)))))
    return rules.report(t, rules.Limits(streams=12)).select("dataset", "code", "path")


@query("SELECT page_id, octet_length(encode(html)) AS length, 'text/html' AS media_type, sha256(html) AS digest FROM pages")
def a5_blob_round_trip(spark, d):
    """Pages are written as blob files and read back."""
    files = Tables(spark, d).pages.select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("data"))
    found = bundles.read_root(bundles.encode_blobs(files, FMT, "text/html"), FMT, "blob")
    return found.select(F.col("file").cast("long").alias("page_id"), "length", "media_type", F.sha2("data", 256).alias("digest"))


@query(None)
def b2_dataset_files(spark, d):
    """Every customer's dataset as a file, parsed again: storage and root identity."""
    documents = model.read_documents(_documents(Tables(spark, d))).where("error_message is null")
    rows = documents.select(F.unhex("logical_id").alias("root_id"), "document", F.array().cast("array<binary>").alias("references"), F.array().cast("array<binary>").alias("payloads"))
    made = container.encode_containers(rows, FMT)
    return made.select(F.hex("root_id").alias("root_id"), F.octet_length("artifact").cast("long").alias("bytes"), F.sha2("artifact", 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'length' ELSE 'ok' END AS state, CASE WHEN doc_id % 6 > 1 THEN sha256(text) END AS digest FROM documents")
def a15_payload_lease(spark, d):
    """Documents as payloads: some are missing, some have another length than their descriptor says."""
    docs = Tables(spark, d).documents.select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("own", F.concat(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit("|")), "UTF-8"), "data"))
    named = docs.withColumn("content_id", payload_id(F.lit("bytes"), F.col("own")))
    descriptors = named.select("doc_id", "content_id", F.lit("bytes").alias("element"), (F.octet_length("own") + F.when(F.col("doc_id") % 6 == 1, 1).otherwise(0)).cast("long").alias("logical_bytes"))
    payloads = named.where("doc_id % 6 <> 0").select("content_id", F.col("own").alias("data"))
    leased = store.lease(descriptors, payloads)
    text = F.expr("substring(data, length(cast(doc_id as string)) + 2)")
    return leased.select("doc_id", "state", F.sha2(text, 256).alias("digest"))
