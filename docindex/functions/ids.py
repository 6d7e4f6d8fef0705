"""Deterministic identities (F1, F2, F5): re-running a job gives the same ids, so retries change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

OID = str(uuid.NAMESPACE_OID)
#: Namespace of memory ids.
MEMORY = "6f9619ff-8b86-d011-b42d-00c04fc964ff"


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_id(content: Column) -> Column:
    """file_id: the first 32 digits of the content's SHA-256."""
    return F.substring(sha256_hex(content), 1, 32)


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name, by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(file_id: Column, chunk_no: Column) -> Column:
    return uuid5(OID, F.concat(file_id, F.lit(":body:"), chunk_no.cast("string")))


def parent_id(file_id: Column, section_no: Column) -> Column:
    return uuid5(OID, F.concat(file_id, F.lit(":section:"), section_no.cast("string")))


def caption_id(file_id: Column) -> Column:
    return uuid5(OID, F.concat(file_id, F.lit(":caption:0")))


def memory_id(user: Column, session: Column, chunk_no: Column) -> Column:
    return uuid5(MEMORY, F.concat_ws(":", user.cast("string"), session.cast("string"), chunk_no.cast("string")))


def note_id(user: Column, note: Column, chunk_no: Column) -> Column:
    return uuid5(MEMORY, F.concat(F.lit("note:"), F.concat_ws(":", user.cast("string"), note.cast("string"), chunk_no.cast("string"))))


def asset_file_id(source: Column, asset_id: Column) -> Column:
    return F.concat_ws(":", source, asset_id.cast("string"))
