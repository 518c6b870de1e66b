"""The validation rules of datasets as failure rows.

A rule takes the tables of tables.collections() (or any with those columns) and returns rows (dataset, section, idx, sub, pos, code, path,
related, evidence), one for each failure; sorted by section, idx, sub and pos they come in the order of the format's own report. Rules are joins and aggregates on
(dataset, id), so a report over any number of datasets is one plan. E001 is a repeated id, E002 a dangling reference, E003 an inexact
or misordered number, E004 a wrong shape of a statement, E005 a payload that does not fit, E006 an unresolved clock, E007 an unresolved frame,
E009 a misused proof, E010 a relaxed policy, E012 a passed limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.ident import Names
from ..operators import graph
from .exact import is_negative, is_positive, rational_order, total_samples

Tables = dict[str, DataFrame]
FAILURE = ["dataset", "section", "idx", "sub", "pos", "code", "path", "related", "evidence"]


@dataclass(frozen=True)
class Limits:
    """The default structural limits."""

    recordings: int = 1_000_000
    streams: int = 4_000_000
    atoms: int = 64_000_000
    catalog_records: int = 16_000_000
    source_relationships: int = 64_000_000
    governance_records: int = 16_000_000
    channels: int = 1_000_000
    rank: int = 32
    nesting: int = 64
    metadata_bytes: int = 256 << 20
    payload_bytes: int = 1 << 60


CATALOG = ("subjects", "patients", "sessions", "acquisitions", "devices", "sensors", "channels", "concept_dictionaries")
GOVERNANCE = ("policies", "proofs", "derivations", "fidelity", "source_capsules")
#: The collections whose ids must differ, in the order of the report.
IDENTIFIED = (
    "recordings", "streams", "atoms", "clocks", "coordinate_frames", "channel_bases", "policies", "proofs", "derivations", "subjects", "patients", "sessions", "acquisitions", "devices",
    "sensors", "channels", "clock_relations", "frame_transforms", "events", "concept_dictionaries", "derived_artifacts",
)
#: The collection of each kind that a reference may name.
KIND_OF = {
    "recordings": "recording", "streams": "stream", "atoms": "atom", "clocks": "clock", "coordinate_frames": "coordinate-frame", "channel_bases": "channel-basis", "policies": "policy", "proofs": "proof",
    "derivations": "derivation", "subjects": "subject", "patients": "patient", "sessions": "session", "acquisitions": "acquisition", "devices": "device", "sensors": "sensor", "channels": "channel",
    "clock_relations": "clock-relation", "frame_transforms": "frame-transform", "events": "event", "concept_dictionaries": "concept-dictionary", "derived_artifacts": "derived-artifact",
}
#: The collections at the two ends of each kind of relationship.
ENDS = {
    "patient-subject": ("patients", "subjects"), "session-subject": ("sessions", "subjects"), "session-patient": ("sessions", "patients"), "acquisition-session": ("acquisitions", "sessions"),
    "acquisition-device": ("acquisitions", "devices"), "device-sensor": ("devices", "sensors"), "sensor-channel": ("sensors", "channels"), "acquisition-recording": ("acquisitions", "recordings"),
}


def fail(rows: DataFrame, section: int, sub: int, code: str, path: Column | str, related: str | None = None, evidence: str | None = None, pos: str | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        "dataset", F.lit(section).alias("section"), F.col("idx").cast("long").alias("idx") if "idx" in rows.columns else F.lit(0).cast("long").alias("idx"), F.lit(sub).alias("sub"),
        F.coalesce(F.col(pos).cast("long"), F.lit(0)).alias("pos") if pos else F.lit(0).cast("long").alias("pos"), F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"),
        (F.col(related) if related else null).alias("related"), (F.col(evidence) if evidence else null).alias("evidence"),
    )


def at(collection: str, rest: str = "") -> Column:
    return F.concat(F.lit(f"{collection}["), F.col("idx").cast("string"), F.lit(f"]{rest}"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def ids(t: Tables, collection: str) -> DataFrame:
    return t[collection].select("dataset", "id").distinct()


def unresolved(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose reference is there but names nothing in their dataset."""
    keys = known.select(F.col("dataset").alias("_d"), F.col("id").alias("_i"))
    return rows.where(F.col(column).isNotNull()).join(keys, (F.col("dataset") == F.col("_d")) & (F.col(column) == F.col("_i")), "left_anti")


def counts(t: Tables, collections: tuple[str, ...]) -> DataFrame:
    """Records of the collections together, by dataset."""
    return union([t[c].groupBy("dataset").agg(F.count(F.lit(1)).alias("n")) for c in collections]).groupBy("dataset").agg(F.sum("n").alias("n"))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _keys(keys: Column | str) -> Column:
    """48 bytes a source key and its text."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + 48 + _text(k["namespace"]) + _text(k["value"]))


def _texts(values: Column | str, each: int, field: str | None = None) -> Column:
    return F.coalesce(F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + each + _text(v[field] if field else v)), F.lit(0))


def _length(values: Column | str, each: int) -> Column:
    return F.when(F.col(values).isNull(), 0).otherwise(F.size(values) * each).cast("long")


#: What a record of each collection adds to the metadata budget beyond its 64 bytes: its text, and fixed widths for what its lists hold.
WEIGHTS = {
    **{c: lambda: _text("kind") + _keys("source_keys") for c in CATALOG},
    "recordings": lambda: _length("streams", 16) + _keys("source_keys"),
    "streams": lambda: _length("atoms", 16) + _text("modality"),
    "atoms": lambda: (
        _length("payload.shape", 8) + _text("payload.encoding") + _text("payload.media_type") + F.when(F.col("time_axis.tag") == "piecewise", _length("time_axis.segments", 48)).otherwise(0)
        + _text("calibration.unit") + _text("record_kind") + _texts("columns", 32, "semantic") + _texts("axes", 32, "semantic") + _length("decoded_semantics.shape", 8)
        + _text("decoded_semantics.atom_kind") + _text("media_type") + _text("integrity.algorithm")
    ),
    "clocks": lambda: _text("kind"),
    "coordinate_frames": lambda: _text("kind") + F.when(F.col("transform").isNotNull(), 16 * 32).otherwise(0),
    "channel_bases": lambda: F.aggregate("channels", F.lit(0).cast("long"), lambda a, c: a + 80 + _text(c["concept"]) + _keys(c["source_keys"])),
    "clock_relations": lambda: _text("method"),
    "frame_transforms": lambda: _text("method") + 16 * 32,
    "events": lambda: _text("kind"),
    "derived_artifacts": lambda: F.lit(0),
    "source_relationships": lambda: F.lit(0),
    "policies": lambda: _texts("restrictions", 24),
    "proofs": lambda: _text("kind"),
    "derivations": lambda: _text("operation") + _length("inputs", 32) + _length("outputs", 32),
    "fidelity": lambda: _text("metric"),
    "source_capsules": lambda: _text("source.namespace") + _text("source.value") + _text("media_type"),
    "observed_execution": lambda: _text("operation") + _text("implementation") + _text("hardware"),
}


def metadata_budget(t: Tables) -> DataFrame:
    """dataset and budget: bytes of metadata text, widths of what lists hold, and 64 bytes a record."""
    parts = [t[c].groupBy("dataset").agg(F.sum((weight() + 64).cast("decimal(38,0)")).alias("n")) for c, weight in WEIGHTS.items()]
    total = union(parts).groupBy("dataset").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    return t["datasets"].select("dataset").join(total, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).cast("decimal(20,0)").alias("budget"))


def _over(numbers: DataFrame, most: int, sub: int, path: str) -> DataFrame:
    return fail(numbers.where(F.col("n") > most), 1, sub, "E012", path)


def v1(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return union([_over(counts(t, (c,)), getattr(limits, c), i, c) for i, c in enumerate(("recordings", "streams", "atoms"))])


def v2(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return _over(metadata_budget(t).withColumnRenamed("budget", "n"), limits.metadata_bytes, 3, "metadata_bytes")


def v3(t: Tables, limits: Limits, names: Names) -> DataFrame:
    families = (("catalog_records", (*CATALOG, "events")), ("source_relationships", ("source_relationships",)), ("governance_records", GOVERNANCE))
    return union([_over(counts(t, members), getattr(limits, name), 4 + i, name) for i, (name, members) in enumerate(families)])


def v4(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Every repeat of an id beyond the first by place."""
    out = []
    for i, c in enumerate(IDENTIFIED):
        again = t[c].groupBy("dataset", "id").agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("dataset").alias("_d"), F.col("id").alias("_i"), "_first")
        rows = t[c].select("dataset", "idx", "id").join(again, (F.col("dataset") == F.col("_d")) & (F.col("id") == F.col("_i"))).where("idx > _first")
        out.append(fail(rows.withColumn("place", F.col("idx")).withColumn("idx", F.lit(0)), 2, i, "E001", c, "id", None, "place"))
    return union(out)


def v5(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Relationships of which an end names nothing."""
    out = []
    for kind, (a, b) in ENDS.items():
        rows = t["source_relationships"].where(F.col("kind") == kind)
        bad = unresolved(rows, "from_id", ids(t, a)).unionAll(unresolved(rows, "to_id", ids(t, b))).select("dataset", "idx").distinct()
        out.append(fail(bad, 3, 0, "E002", at("source_relationships")))
    return union(out)


def v6(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Members of a basis whose channel or basis is missing, or whose position no basis of that id has."""
    rows = t["source_relationships"].where("kind = 'channel-basis-member'")
    widths = t["channel_bases"].groupBy("dataset", "id").agg(F.max(F.size("channels")).alias("_width")).select(F.col("dataset").alias("_d"), F.col("id").alias("_i"), "_width")
    known = ids(t, "channels").select(F.col("dataset").alias("_e"), F.col("id").alias("_j"))
    met = rows.join(widths, (F.col("dataset") == F.col("_d")) & (F.col("to_id") == F.col("_i")), "left").join(known, (F.col("dataset") == F.col("_e")) & (F.col("from_id") == F.col("_j")), "left")
    return fail(met.where("_j is null or _width is null or position >= _width"), 3, 0, "E002", at("source_relationships"))


def v7(t: Tables, limits: Limits, names: Names) -> DataFrame:
    rows = t["recordings"].select("dataset", "idx", F.posexplode("streams").alias("place", "stream"))
    return fail(unresolved(rows, "stream", ids(t, "streams")), 4, 0, "E002", at("recordings", ".streams"), "stream", None, "place")


def v8(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Streams whose recording is missing or does not list them."""
    missing = fail(unresolved(t["streams"], "recording_id", ids(t, "recordings")), 5, 0, "E002", at("streams", ".recording_id"), "recording_id")
    listed = t["recordings"].select(F.col("dataset").alias("_d"), F.col("id").alias("_r"), F.explode("streams").alias("_s")).distinct()
    known = ids(t, "recordings").select(F.col("dataset").alias("_e"), F.col("id").alias("_i"))
    here = t["streams"].join(known, (F.col("dataset") == F.col("_e")) & (F.col("recording_id") == F.col("_i")), "left_semi")
    unlisted = here.join(listed, (F.col("dataset") == F.col("_d")) & (F.col("recording_id") == F.col("_r")) & (F.col("id") == F.col("_s")), "left_anti")
    return missing.unionAll(fail(unlisted, 5, 0, "E002", at("streams", ".recording_membership"), "id"))


def v9(t: Tables, limits: Limits, names: Names) -> DataFrame:
    rows = t["streams"].select("dataset", "idx", F.posexplode("atoms").alias("place", "atom"))
    return fail(unresolved(rows, "atom", ids(t, "atoms")), 5, 1, "E002", at("streams", ".atoms"), "atom", None, "place")


def v10(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(unresolved(t["streams"], "clock_id", ids(t, "clocks")), 5, 2, "E006", at("streams", ".clock_id"), "clock_id")


def v11(t: Tables, limits: Limits, names: Names) -> DataFrame:
    basis = fail(unresolved(t["streams"], "channel_basis_id", ids(t, "channel_bases")), 5, 3, "E002", at("streams", ".channel_basis_id"), "channel_basis_id")
    return basis.unionAll(fail(unresolved(t["streams"], "policy_id", ids(t, "policies")), 5, 4, "E002", at("streams", ".policy_id"), "policy_id"))


def atom_is_valid(limits: Limits) -> Column:
    """Whether an atom agrees with itself: presence with payload, its own contract, then its payload and how both fit."""
    p, shape = F.col("payload"), F.col("payload.shape")
    names_of = F.transform("columns", lambda c: c["semantic"])
    table = (F.size("columns") > 0) & (F.size(F.array_distinct(names_of)) == F.size("columns"))
    decoded = F.col("decoded_semantics.shape")
    contract = (
        F.when(F.col("kind").isin("temporal-table", "table"), table)
        .when(F.col("kind") == "tensor", (F.size("axes") > 0) & F.forall("axes", lambda a: a["extent"] > 0))
        .when(F.col("kind") == "encoded-block", (F.size(decoded) > 0) & (F.size(decoded) <= limits.rank) & F.forall(decoded, lambda n: n > 0) & predicates.extent(decoded).isNotNull())
        .when(F.col("kind") == "blob-ref", predicates.is_atom_media(F.col("media_type"))).otherwise(True)
    )
    axis = F.col("time_axis")
    samples = F.when(axis["tag"] == "explicit", F.when(axis["count"] > 0, axis["count"])).otherwise(total_samples(axis["segments"]))
    extents = F.transform("axes", lambda a: a["extent"])
    fits = (
        F.when(F.col("kind") == "signal-block", F.get(shape, F.size(shape) - 1) == samples)
        .when(F.col("kind").isin("temporal-table", "table"), (F.size(shape) == 2) & (F.get(shape, F.lit(1)) == F.size("columns")))
        .when(F.col("kind") == "tensor", extents == shape).otherwise(True)
    )
    whole = predicates.payload_is_valid(p, limits.rank, limits.payload_bytes) & F.coalesce(fits, F.lit(False))
    return predicates.presence_matches("presence", p.isNotNull()) & F.coalesce(contract, F.lit(False)) & (p.isNull() | F.coalesce(whole, F.lit(False)))


def v12(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(t["atoms"].where(~atom_is_valid(limits)), 6, 0, "E005", at("atoms"), "id")


def v13(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(unresolved(t["atoms"].where("kind = 'temporal-table'"), "clock_id", ids(t, "clocks")), 6, 1, "E006", at("atoms", ".clock_id"), "clock_id")


def companions(t: Tables) -> DataFrame:
    """What each atom expects of each companion: content_id, wanted (an element or a class of elements) and shape, null where it cannot be given."""
    p, layout = F.col("payload"), F.col("payload.layout")
    one = F.lit(1).cast("decimal(20,0)")
    fitting = lambda c: F.when(c <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"), c.cast("decimal(20,0)"))
    wide = lambda c: c.cast("decimal(38,0)")
    expected = lambda place, content, wanted, *shape: F.struct("idx", "id", F.lit(place).alias("place"), content.alias("content_id"), F.lit(wanted).alias("wanted"), F.array(*shape).alias("shape"))
    tag, rank = layout["tag"], F.size(p["shape"]).cast("decimal(20,0)")
    rows = fitting(wide(F.get(p["shape"], F.lit(0))) + one)
    blocks = F.when(layout["block_len"] > 0, F.expr("(cast(_extent as decimal(38,0)) + payload.layout.block_len - 1) div payload.layout.block_len").cast("decimal(20,0)"))
    found = F.array_compact(F.array(
        F.when(tag == "ragged", expected(0, layout["offsets"], "integer", fitting(wide(layout["rows"]) + one))),
        F.when(tag == "sparse-coo", expected(0, layout["indices"], "integer", layout["nonzero"], rank)),
        F.when(tag == "sparse-csr", expected(0, layout["indptr"], "integer", rows)),
        F.when(tag == "sparse-csr", expected(1, layout["indices"], "integer", layout["nonzero"])),
        F.when(tag == "bfp", expected(0, layout["scales"], "float", blocks)),
        F.when((F.col("kind") == "signal-block") & (F.col("time_axis.tag") == "explicit"), expected(2, F.col("time_axis.timestamps"), "i64", F.col("time_axis.count"))),
    ))
    source = t["atoms"].withColumn("_extent", predicates.extent(F.col("payload.shape")))
    return source.select("dataset", F.explode(found).alias("e")).select("dataset", "e.*")


def _payloads(t: Tables) -> DataFrame:
    p = F.col("payload")
    return t["atoms"].where("payload is not null").select(F.col("dataset").alias("_d"), p["content_id"].alias("_c"), p["element"].alias("_e"), p["shape"].alias("_s"), p["layout"]["tag"].startswith("dense").alias("_dense")).distinct()


def v14(t: Tables, limits: Limits, names: Names) -> DataFrame:
    known = _payloads(t).select(F.col("_d").alias("dataset"), F.col("_c").alias("id")).distinct()
    return fail(unresolved(companions(t), "content_id", known), 6, 2, "E002", at("atoms", ".payload.companion"), None, "content_id", "place")


def v15(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Atoms all of whose companions are there, but one is described by some atom as what it must not be."""
    wanted, described = companions(t), _payloads(t)
    met = wanted.join(described, (F.col("dataset") == F.col("_d")) & (F.col("content_id") == F.col("_c")), "left")
    elements = F.when(F.col("wanted") == "integer", F.col("_e").isin(*predicates.INTEGERS)).when(F.col("wanted") == "float", F.col("_e").isin("f16", "f32", "f64")).otherwise(F.col("_e") == F.col("wanted"))
    agrees = F.coalesce(F.col("_dense") & elements & (F.col("_s") == F.col("shape")), F.lit(False))
    judged = met.groupBy("dataset", "idx", "id").agg(F.bool_and(F.col("_c").isNotNull()).alias("there"), F.bool_and(agrees).alias("agree"))
    return fail(judged.where("there and not agree"), 6, 3, "E005", at("atoms", ".payload.companion"), "id")


def v16(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(t["clocks"].where(~is_positive(F.col("rate")) | is_negative(F.col("uncertainty"))), 7, 0, "E003", at("clocks"))


def v17(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(unresolved(t["clocks"], "parent_id", ids(t, "clocks")), 7, 1, "E006", at("clocks", ".parent_id"), "parent_id")


def walks(records: DataFrame, most: int) -> DataFrame:
    """How the way up from each record ends: dataset, idx, id, state (root, cycle or depth) and met, the id met twice. The first record of an id has its parent."""
    key = lambda c: F.concat_ws("\u0001", "dataset", c)
    first = records.groupBy("dataset", "id").agg(F.min_by("parent_id", "idx").alias("parent_id"))
    parents = first.select(key("id").alias("node"), F.when(F.col("parent_id").isNotNull(), key("parent_id")).alias("parent"))
    ended = graph.ancestry(parents, most).where("state <> 'root'").select(F.col("node").alias("_k"), "state", F.element_at(F.split("at", "\u0001"), -1).alias("met"))
    return records.select("dataset", "idx", "id").join(ended, key("id") == F.col("_k"))


def _ancestry(t: Tables, collection: str, section: int, code: str, limits: Limits, related: bool = True, sub: int = 0) -> DataFrame:
    ended = walks(t[collection], limits.nesting)
    cycle = fail(ended.where("state = 'cycle'"), section, sub, code, at(collection, ".ancestry_cycle"), "met" if related else None)
    return cycle.unionAll(fail(ended.where("state = 'depth'"), section, sub, "E012", at(collection, ".ancestry_depth")))


def v18(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return _ancestry(t, "clocks", 8, "E006", limits)


def v19(t: Tables, limits: Limits, names: Names) -> DataFrame:
    frames = t["coordinate_frames"]
    inexact = fail(frames.where(is_negative(F.col("uncertainty"))), 9, 0, "E003", at("coordinate_frames", ".uncertainty"))
    parent = fail(unresolved(frames, "parent_id", ids(t, "coordinate_frames")), 9, 1, "E007", at("coordinate_frames", ".parent_id"), "parent_id")
    return union([inexact, parent, _ancestry(t, "coordinate_frames", 10, "E007", limits)])


def v20(t: Tables, limits: Limits, names: Names) -> DataFrame:
    r, clocks = t["clock_relations"], ids(t, "clocks")
    ends = [fail(unresolved(r, c, clocks), 11, i, "E006", at("clock_relations", f".{c}"), c) for i, c in enumerate(("from_clock_id", "to_clock_id"))]
    inexact = fail(r.where(~is_positive(F.col("rate")) | is_negative(F.col("uncertainty"))), 11, 2, "E003", at("clock_relations"))
    order = rational_order(F.col("validity_end"), F.col("validity_start"))
    return union([*ends, inexact, fail(r.where("validity_end is not null").withColumn("_order", order).where("_order < 0"), 11, 3, "E003", at("clock_relations", ".validity"))])


def v21(t: Tables, limits: Limits, names: Names) -> DataFrame:
    r, frames = t["frame_transforms"], ids(t, "coordinate_frames")
    ends = [fail(unresolved(r, c, frames), 12, i, "E007", at("frame_transforms", f".{c}"), c) for i, c in enumerate(("from_frame_id", "to_frame_id"))]
    return union([*ends, fail(r.where(is_negative(F.col("uncertainty"))), 12, 2, "E003", at("frame_transforms", ".uncertainty"))])


def v22(t: Tables, limits: Limits, names: Names) -> DataFrame:
    clock = fail(unresolved(t["events"], "clock_id", ids(t, "clocks")), 13, 0, "E006", at("events", ".clock_id"), "clock_id")
    bad = t["events"].withColumn("_order", rational_order(F.col("end"), F.col("start"))).where((F.col("_order") < 0) | is_negative(F.col("uncertainty")))
    return clock.unionAll(fail(bad, 13, 1, "E003", at("events", ".interval")))


def v23(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Artifacts whose derivation is missing, or whose derivation (the first of its id) does not put them out."""
    missing = fail(unresolved(t["derived_artifacts"], "derivation_id", ids(t, "derivations")), 14, 0, "E002", at("derived_artifacts", ".derivation_id"), "derivation_id")
    first = t["derivations"].groupBy("dataset", "id").agg(F.min_by("outputs", "idx").alias("outputs"))
    known = first.select(F.col("dataset").alias("_e"), F.col("id").alias("_j"))
    made = first.select(F.col("dataset").alias("_d"), F.col("id").alias("_i"), F.explode("outputs").alias("o")).where("o.kind = 'derived-artifact'").select("_d", "_i", F.col("o.id").alias("_o")).distinct()
    here = t["derived_artifacts"].join(known, (F.col("dataset") == F.col("_e")) & (F.col("derivation_id") == F.col("_j")), "left_semi")
    other = here.join(made, (F.col("dataset") == F.col("_d")) & (F.col("derivation_id") == F.col("_i")) & (F.col("id") == F.col("_o")), "left_anti")
    return missing.unionAll(fail(other, 14, 0, "E002", at("derived_artifacts", ".derivation_output"), "id"))


def v24(t: Tables, limits: Limits, names: Names) -> DataFrame:
    return fail(t["channel_bases"].where(F.size("channels") > limits.channels), 15, 0, "E012", at("channel_bases", ".channels"))


def v25(t: Tables, limits: Limits, names: Names) -> DataFrame:
    rows = t["channel_bases"].select("dataset", "idx", F.posexplode("channels").alias("place", "c")).select("dataset", "idx", "place", F.col("c.coordinate_frame_id").alias("frame"))
    path = F.concat(F.lit("channel_bases["), F.col("idx").cast("string"), F.lit("].channels["), F.col("place").cast("string"), F.lit("].coordinate_frame_id"))
    return fail(unresolved(rows, "frame", ids(t, "coordinate_frames")), 15, 1, "E007", path, "frame", None, "place")


def v26(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Policies whose parent is missing, or that lack a restriction of their parent (the first of its id)."""
    p = t["policies"]
    missing = fail(unresolved(p, "parent_id", ids(t, "policies")), 16, 0, "E002", at("policies", ".parent_id"), "parent_id")
    first = p.groupBy("dataset", "id").agg(F.min_by("restrictions", "idx").alias("_all")).select(F.col("dataset").alias("_d"), F.col("id").alias("_i"), "_all")
    met = p.join(first, (F.col("dataset") == F.col("_d")) & (F.col("parent_id") == F.col("_i")))
    return missing.unionAll(fail(met.where(F.size(F.array_except("_all", "restrictions")) > 0), 16, 0, "E010", at("policies", ".restrictions")))


def v27(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """Policies that walk into a cycle or too deep; one whose own parent is missing is not walked, and a walk ends before a missing parent."""
    p = t["policies"]
    known = ids(t, "policies").select(F.col("dataset").alias("_d"), F.col("id").alias("_i"))
    here = p.join(known, (F.col("dataset") == F.col("_d")) & (F.col("parent_id") == F.col("_i")), "left").withColumn("parent_id", F.col("_i")).drop("_d", "_i")
    broken = unresolved(p, "parent_id", ids(t, "policies")).select(F.col("dataset").alias("_d"), F.col("idx").alias("_x"))
    ended = walks(here, limits.nesting).join(broken, (F.col("dataset") == F.col("_d")) & (F.col("idx") == F.col("_x")), "left_anti")
    cycle = fail(ended.where("state = 'cycle'"), 16, 1, "E010", at("policies", ".ancestry_cycle"))
    return cycle.unionAll(fail(ended.where("state = 'depth'"), 16, 1, "E012", at("policies", ".ancestry_depth")))


def universe(t: Tables) -> DataFrame:
    """dataset, kind and id of everything that a reference may name."""
    parts = [t[c].select("dataset", F.lit(kind).alias("kind"), "id") for c, kind in KIND_OF.items()]
    return union([t["datasets"].select("dataset", F.lit("dataset").alias("kind"), "id"), *parts]).distinct()


def _dangling(rows: DataFrame, reference: str, known: DataFrame) -> DataFrame:
    keys = known.select(F.col("dataset").alias("_d"), F.col("kind").alias("_k"), F.col("id").alias("_i"))
    return rows.join(keys, (F.col("dataset") == F.col("_d")) & (F.col(f"{reference}.kind") == F.col("_k")) & (F.col(f"{reference}.id") == F.col("_i")), "left_anti")


def misused(kind: Column, subject: Column, names: Names) -> Column:
    """A derivation proof must be of a derivation, a policy attestation of a policy; other kinds are free."""
    wrong = ((kind == f"{names.concept}:proof/derivation") & (subject != "derivation")) | ((kind == f"{names.concept}:proof/policy-attestation") & (subject != "policy"))
    return wrong


def satisfies(kind: Column, subject: Column, wanted_kind: Column, wanted_subject: Column) -> Column:
    """Whether a proof is of the wanted kind and subject (both structs of kind and id)."""
    return (kind == wanted_kind) & (subject["kind"] == wanted_subject["kind"]) & (subject["id"] == wanted_subject["id"])


def v28(t: Tables, limits: Limits, names: Names) -> DataFrame:
    known = universe(t)
    dangling = fail(_dangling(t["proofs"], "subject", known), 17, 0, "E002", at("proofs", ".subject"))
    keys = known.select(F.col("dataset").alias("_d"), F.col("kind").alias("_k"), F.col("id").alias("_i"))
    here = t["proofs"].join(keys, (F.col("dataset") == F.col("_d")) & (F.col("subject.kind") == F.col("_k")) & (F.col("subject.id") == F.col("_i")), "left_semi")
    return dangling.unionAll(fail(here.where(misused(F.col("kind"), F.col("subject.kind"), names)), 17, 0, "E009", at("proofs")))


def v29(t: Tables, limits: Limits, names: Names) -> DataFrame:
    """One failure a reference that names nothing: inputs, then outputs."""
    rows = t["derivations"].select("dataset", "idx", F.posexplode(F.concat("inputs", "outputs")).alias("place", "reference"))
    return fail(_dangling(rows, "reference", universe(t)), 18, 0, "E002", at("derivations"), None, None, "place")


def v30(t: Tables, limits: Limits, names: Names) -> DataFrame:
    subject = fail(_dangling(t["fidelity"], "subject", universe(t)), 19, 0, "E002", at("fidelity", ".subject"))
    return subject.unionAll(fail(t["fidelity"].where(~predicates.fidelity_fits("kind", "metric", F.col("bound.tag"))), 19, 1, "E004", at("fidelity")))


RULES = {f.__name__: f for f in (v1, v2, v3, v4, v5, v6, v7, v8, v9, v10, v11, v12, v13, v14, v15, v16, v17, v18, v19, v20, v21, v22, v23, v24, v25, v26, v27, v28, v29, v30)}


def report(t: Tables, limits: Limits = Limits(), names: Names = Names(), only: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """All failures of all datasets, with the rule that found each."""
    return union([RULES[name](t, limits, names).withColumn("rule", F.lit(name)) for name in only])


def ordered(failures: DataFrame) -> DataFrame:
    """The failures with their place (nth, from 0) in the report of their dataset."""
    order = Window.partitionBy("dataset").orderBy("section", "idx", "sub", "pos", "rule", "path")
    return failures.withColumn("nth", F.row_number().over(order) - 1)


def failure_record(failures: DataFrame) -> DataFrame:
    """The failures with the constant members of a failure record."""
    return failures.withColumns({"severity": F.lit("error"), "origin": F.lit("validation"), "retry_class": F.lit("after-correction")})
