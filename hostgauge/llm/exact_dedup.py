"""Exact deduplication through recipes of content-defined chunks.

A text is cut where a rolling hash of its last 16 bytes says so, so equal
passages give equal chunks wherever they stand. Chunks are brought together once,
by identifier and content, which proves that an identifier stands for one
content. After that only the recipes (the chunks' identifiers in order, about
1/60 of the text) are compared; whole documents never move.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import map_texts, window_hashes
from hostgauge.session import materialize

LEAST, MOST = 256, 8192  # bytes of a chunk; the last one may be shorter
_MASK = np.uint64(1023)  # one place in 1024 is a cut
ID_BYTES = 16


def chunks(data: bytes) -> list[bytes]:
    """Consecutive pieces that make up ``data``; where they end depends on the content alone."""
    n = len(data)
    if n <= LEAST:
        return [data] if n else []
    hashes = window_hashes(np.frombuffer(data, np.uint8), 16)
    places = (np.flatnonzero((hashes & _MASK) == 0) + 16).tolist()
    out, start = [], 0
    for at in [*places, n]:
        while at - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if at - start >= LEAST or at == n and at > start:
            out.append(data[start:at])
            start = at
    return out


def _identifier(chunk: bytes, seed: int, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)[:size]


def _ambiguous(docs: DataFrame, text: str, seed: int, size: int) -> bool:
    """Whether some identifier stands for two contents, over all chunks of all texts."""

    def pieces(t):
        found = chunks((t or "").encode().lower())
        return [_identifier(c, seed, size) for c in found], found

    parts = map_texts(docs, [], [text], "id array<binary>, chunk array<binary>", pieces)
    rows = parts.select(F.inline(F.arrays_zip("id", "chunk")))
    # equal chunks meet on the map side first; a very common passage is one row per task
    distinct = rows.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    twice = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > 1)
    return bool(twice.limit(1).count())


def exact_groups(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, doc_id: str = "doc_id", id_bytes: int = ID_BYTES
) -> DataFrame:
    """One row per input row: ``keep`` columns, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if the same after lower-casing A-Z; null counts as empty.
    ``keep_id`` is the largest ``doc_id`` of equal texts, ``kept`` marks its row.
    Null ids never win against another (a group of null ids has keep_id null, all
    kept); rows repeated with one id share their decision and count each. No rows
    in, no rows out; other columns are not read.

    Should two contents share an identifier, identifiers are made anew (longer up
    to 16 bytes, then with another seed) until each stands for one content.
    """
    keep = keep or [doc_id]
    seed = 0
    while _ambiguous(docs, text, seed, id_bytes):
        seed, id_bytes = seed + (id_bytes >= 16), min(16, id_bytes * 2)

    def recipe(t):
        data = (t or "").encode().lower()
        return b"".join(_identifier(c, seed, id_bytes) for c in chunks(data)), hashlib.sha256(data).hexdigest()

    rows = materialize(map_texts(docs, keep, [text], "recipe binary, text_sha256 string", recipe))
    groups = rows.groupBy("recipe").agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups)  # joined as a stored table, a group that holds very many rows can be split
    kept = F.col(doc_id).eqNullSafe(F.col("keep_id"))
    return rows.join(groups, "recipe").select(*keep, "keep_id", "group_size", kept.alias("kept"), "text_sha256")
