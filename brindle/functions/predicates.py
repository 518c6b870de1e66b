"""Grammar and structure predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammars of identifiers and names. \z is the end of the text; $ would let a final line break pass.
CONCEPT = r"\A[a-z][a-z0-9.-]*:[A-Za-z0-9._/-]+\z"
CONTENT_KEY = r"\A[0-9a-f]{64}\z"
KNOB = r"\A[a-z][a-z0-9._-]{0,127}\z"
LABEL = r"\A[a-z0-9][a-z0-9._-]*[a-z0-9_-]\z"
NO_CONTROL = r"\A[^\x00-\x1f\x7f-\x9f]*\z"
ATOM_MEDIA = r"\A[^\x00-\x20\x7f/]+/[^\x00-\x20\x7f]+\z"
ADAPTER_MEDIA = r"\A[\x21-\x2e\x30-\x7e]+/[\x21-\x7e]+\z"
MEDIA_NAME = r"[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{0,126}"
BLOB_MEDIA = rf"\A{MEDIA_NAME}/{MEDIA_NAME}\z"
#: White space that a trimmed text may not begin or end with: that of the Unicode standard.
UNTRIMMED = r"\A[\x09-\x0d\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\x09-\x0d\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\z"
INTEGERS = ("i8", "i16", "i24", "i32", "i64", "u8", "u16", "u32", "u64")
ELEMENT_WIDTHS = {"i8": 1, "i16": 2, "i24": 3, "i32": 4, "i64": 8, "u8": 1, "u16": 2, "u32": 4, "u64": 8, "f16": 2, "f32": 4, "f64": 8, "bool": 1, "bytes": 1}
MOST_BYTES = (1 << 64) - 1


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_concept(c: Column | str) -> Column:
    return _column(c).rlike(CONCEPT)


def is_source_key(namespace: Column | str, value: Column | str) -> Column:
    return (F.length(_column(namespace)) > 0) & _column(namespace).rlike(NO_CONTROL) & _column(value).rlike(NO_CONTROL)


def is_atom_media(c: Column | str) -> Column:
    """Both sides of the first slash are there; no ASCII control or white space."""
    return _column(c).rlike(ATOM_MEDIA)


def is_adapter_media(c: Column | str) -> Column:
    return _column(c).rlike(ADAPTER_MEDIA)


def is_blob_media(c: Column | str) -> Column:
    """One slash between two restricted names."""
    return _column(c).rlike(BLOB_MEDIA)


def is_purpose(c: Column | str) -> Column:
    """1 to 256 bytes, trimmed, without control characters."""
    c = _column(c)
    return F.octet_length(c).between(1, 256) & ~c.rlike(UNTRIMMED) & c.rlike(NO_CONTROL)


def is_content_key(c: Column | str) -> Column:
    return _column(c).rlike(CONTENT_KEY)


def is_knob(c: Column | str) -> Column:
    return _column(c).rlike(KNOB)


def is_label_concept(c: Column | str) -> Column:
    c = _column(c)
    return F.length(c).between(3, 256) & c.contains(".") & c.rlike(LABEL)


def is_adapter_path(c: Column | str) -> Column:
    """Relative, without backslash, control characters, empty parts or '..'; '.' is allowed."""
    c = _column(c)
    parts = F.split(c, "/", -1)
    return c.rlike(NO_CONTROL) & ~c.contains("\\") & ~F.exists(parts, lambda p: (p == "") | (p == ".."))


def is_forensic_path(c: Column | str) -> Column:
    c = _column(c)
    parts = F.split(c, "/", -1)
    return ~c.contains("\x00") & ~F.exists(parts, lambda p: (p == "") | (p == "..") | (p == "."))


def _u64(c: Column) -> Column:
    """The value if it is one of 64 unsigned bits, else null."""
    return F.when(c.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(MOST_BYTES)).cast("decimal(38,0)")), c.cast("decimal(38,0)"))


def extent(shape: Column | str) -> Column:
    """The product of a shape, null if an extent is missing or negative or a product on the way passes 2^64 - 1."""
    one = F.lit(1).cast("decimal(38,0)")
    return F.aggregate(_column(shape), one, lambda a, x: _u64(F.try_multiply(a, _u64(x.try_cast("decimal(38,0)"))).cast("decimal(38,0)")))


def width(element: Column | str) -> Column:
    """Bytes of one value, null for texts."""
    widths = F.create_map(*[F.lit(x) for pair in ELEMENT_WIDTHS.items() for x in pair])
    return F.element_at(widths, _column(element))


def dense_bytes(shape: Column | str, element: Column | str) -> Column:
    """Bytes of a dense payload, null if an extent is missing or negative, a product passes 2^64 - 1 or the element has no width."""
    return _u64(F.try_multiply(extent(shape), width(element).cast("decimal(38,0)")).cast("decimal(38,0)"))


def payload_is_valid(p: Column, rank: int = 32, most_bytes: int = 1 << 60) -> Column:
    """Whether a payload descriptor agrees with itself: rank, size, and what its layout asks for."""
    layout, shape = p["layout"], p["shape"]
    tag, own = layout["tag"], p["content_id"]
    inside = layout["nonzero"] <= extent(shape)
    rule = (
        F.when(tag.startswith("dense"), dense_bytes(shape, p["element"]) == p["logical_bytes"])
        .when(tag == "bfp", (layout["block_len"] > 0) & layout["mantissa_bits"].between(1, 32) & (layout["scales"] != own))
        .when(tag == "ragged", (layout["rows"] > 0) & (layout["offsets"] != own))
        .when(tag == "sparse-coo", (layout["indices"] != own) & inside)
        .when(tag == "sparse-csr", (F.size(shape) == 2) & (layout["indptr"] != layout["indices"]) & (layout["indptr"] != own) & (layout["indices"] != own) & inside)
    )
    return (F.size(shape) <= rank) & (p["logical_bytes"] <= F.lit(str(most_bytes)).cast("decimal(20,0)")) & F.coalesce(rule, F.lit(False))


def training_extent_fault(shape: Column, element: Column, byte_order: Column, logical_bytes: Column) -> Column:
    """extent or byte-order, null where a training row's payload fits: no empty extent, an order exactly for values of several bytes, the product."""
    wide = width(element)
    empty = (F.size(shape) == 0) | F.exists(shape, lambda n: n <= 0) | (logical_bytes <= 0)
    ordered = F.when(wide > 1, byte_order.isin("little", "big")).otherwise(byte_order == "not-applicable")
    product = wide.isNull() | F.coalesce(dense_bytes(shape, element) == logical_bytes, F.lit(False))
    return F.when(empty, "extent").when(~ordered, "byte-order").when(~product, "extent")


def presence_matches(presence: Column | str, has_payload: Column) -> Column:
    """Present exactly when there is a payload."""
    return (_column(presence) == "present") == has_payload


def fidelity_fits(kind: Column | str, metric: Column | str, bound: Column | str) -> Column:
    """Exact has neither metric nor bound, bounded has both, transformed has a metric."""
    m, b = _column(metric).isNotNull(), _column(bound).isNotNull()
    return F.when(_column(kind) == "exact", ~m & ~b).when(_column(kind) == "bounded", m & b).when(_column(kind) == "transformed", m).otherwise(F.lit(False))
