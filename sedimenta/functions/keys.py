"""Content-derived SHA-256 keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"


def key(*parts: Column | str, sep: str = "|") -> Column:
    """SHA-256 of the parts joined by ``sep``; null if any part is null, since a skipped part would change the key."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    return F.when(whole, F.sha2(F.concat_ws(sep, *(c.cast("string") for c in columns)), 256))


def checksum(document_id: str = "document_id") -> Column:
    """Stands for the checksum of a document's bytes, which the register does not have."""
    return F.sha2(F.concat(F.lit("register:"), F.col(document_id).cast("string")), 256)


def identity(kind: str, upstream: Column | None, **local: str) -> Column:
    """Artifact identity: length-prefixed components, the upstream identity among them."""
    parts = [F.lit("contract:1"), F.lit(f"{len(kind)}:{kind}")]
    if upstream is not None:
        parts.append(F.concat(F.length(upstream).cast("string"), F.lit(":"), upstream))
    parts += [F.lit(f"{len(k)}:{k}={len(v)}:{v}") for k, v in sorted(local.items())]
    return F.sha2(F.concat(*parts), 256)
