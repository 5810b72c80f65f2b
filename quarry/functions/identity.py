"""Identities: content hashes and embedding-space fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The encoding's number and the fields of a descriptor in order.
ENCODING, CHUNKER_VERSION, LEXICAL_VERSION = 2, 1, 3
DESCRIPTOR = ("model_id", "model_sha256", "pooling", "query_prefix", "document_prefix", "dimensions", "normalized", "max_tokens", "require_trailing_eos")


def content_sha256(content: str | Column) -> Column:
    return F.sha2(content, 256)


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def space_fingerprint(descriptor: Mapping, chunker_version: int = CHUNKER_VERSION) -> str:
    """SHA-256 over length-prefixed fields, so no value can forge a boundary."""
    fields = [("encoding", ENCODING), *((k, descriptor[k]) for k in DESCRIPTOR), ("chunker_version", chunker_version)]
    line = lambda k, v: f"{k}={len(v.encode())}:{v}\n"
    return hashlib.sha256("".join(line(k, _text(v)) for k, v in fields).encode()).hexdigest()


def space_fingerprint_column(chunker_version: int = CHUNKER_VERSION) -> Column:
    """The same over a descriptor's columns."""
    field = lambda k, v: F.concat(F.lit(f"{k}="), F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n"))
    parts = [field("encoding", F.lit(str(ENCODING)))]
    parts += [field(k, F.lower(F.col(k).cast("string")) if k in ("normalized", "require_trailing_eos") else F.col(k).cast("string")) for k in DESCRIPTOR]
    return F.sha2(F.concat(*parts, field("chunker_version", F.lit(str(chunker_version)))), 256)
