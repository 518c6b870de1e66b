"""Published vectors, found in the folder that PUBLISHED_VECTORS names; tests that need them are skipped where it is unset."""

import json
import os
import re
from pathlib import Path

import pytest

from brindle.functions.ident import Names


def folder():
    if not os.environ.get("PUBLISHED_VECTORS"):
        pytest.skip("PUBLISHED_VECTORS names no folder")
    return Path(os.environ["PUBLISHED_VECTORS"])


def names():
    """The namespace of the published identities, from the one schema that gives a snapshot's name."""
    pattern = re.compile(r'"const":\s*"([a-z.]+)\.training\.snapshot-v1"')
    return next(Names(m[1]) for f in sorted(folder().rglob("*.schema.json")) if (m := pattern.search(f.read_text())))


def documents():
    """Bytes of the published documents by their identity."""
    return {f.read_text().strip(): f.with_suffix(".json").read_bytes() for f in sorted(folder().rglob("*.content-id"))}


def manifests():
    """The manifests of binary vectors: folder and vectors."""
    found = [(f.parent, json.loads(f.read_text())) for f in sorted(folder().rglob("manifest.json"))]
    return [(at, m["vectors"]) for at, m in found if "wire_major" in m]
