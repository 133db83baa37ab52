"""Content keys: plain SHA-1, git blob SHA-1, and the UUID form of a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_sha1(content: Column) -> Column:
    """SHA-1 of the raw UTF-8 bytes, before any trimming."""
    return F.sha1(F.encode(content, "UTF-8"))


def git_blob_sha1(content: Column) -> Column:
    """The object id git gives the same bytes; never equal to :func:`content_sha1`."""
    body = F.encode(content, "UTF-8")
    size = F.octet_length(content).cast("string")
    header = F.encode(F.concat(F.lit("blob "), size), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), body))


def hash_to_uuid(hex_hash: Column) -> Column:
    """First 128 bits of a hex hash, dashed 8-4-4-4-12."""
    groups = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex_hash, start, size) for start, size in groups])
