"""Content identities: domains, canonical JSON and the columns that hash them.

An identity is the BLAKE3 hash of a domain, a zero byte and canonical bytes. Domains begin with a namespace that the caller gives, so that one
engine serves every family of identities.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .blake3 import blake3, derived, hash_many


class Names(NamedTuple):
    """The namespace of the identity domains; its last label is the namespace of the core concepts."""

    domain: str = "org.example.core"

    @property
    def concept(self) -> str:
        return self.domain.rsplit(".", 1)[-1]

    def of(self, what: str) -> bytes:
        return f"{self.domain}.{what}".encode() + b"\0"

    def payload(self, element: str) -> bytes:
        return f"{self.concept}.semantic-v1.payload".encode() + b"\0" + element.encode() + b"\0"


def content_id(domain: bytes, data: bytes) -> bytes:
    return blake3(domain + data)


def blake3_hex(c: Column, domain: bytes = b"") -> Column:
    """BLAKE3 of a binary column with the domain in front, all rows of a batch at once; null stays null."""

    def hex_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            there = s.notna()
            hashed = hash_many([domain + bytes(v) for v in s[there]])
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[there] = [h.hex() for h in hashed]
            yield out

    return F.pandas_udf(hex_of, "string", F.PandasUDFType.SCALAR_ITER)(c)


def derived_hex(c: Column, context: str) -> Column:
    """BLAKE3 of a binary column in key derivation mode."""

    def hex_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            there = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[there] = [h.hex() for h in derived(context, [bytes(v) for v in s[there]])]
            yield out

    return F.pandas_udf(hex_of, "string", F.PandasUDFType.SCALAR_ITER)(c)


def payload_id(element: Column, data: Column, names: Names = Names()) -> Column:
    """The identity of payload bytes of an element type."""

    def ids(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, b in values:
            there = e.notna() & b.notna()
            hashed = hash_many([names.payload(x) + bytes(v) for x, v in zip(e[there], b[there], strict=True)])
            out = pd.Series([None] * len(e), index=e.index, dtype=object)
            out[there] = [h.hex() for h in hashed]
            yield out

    return F.pandas_udf(ids, "string", F.PandasUDFType.SCALAR_ITER)(element, data)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
