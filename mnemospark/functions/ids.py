"""Identifiers, scopes and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lit_or

LOCAL_DOMAINS = ("agent", "user")
# The closed set of relations.
RELATIONS = (
    "Next", "RelatedTo", "Contradicts", "Supports", "Abstracts", "DerivedFrom",
    "CausedBy", "EvolvedTo", "IsSubTaskOf", "Blocks", "Accomplishes",
)


def valid_id(value: Column | str) -> Column:
    """Not empty, at most 256 bytes, no quote, semicolon, comment or control character."""
    v = lit_or(value)
    bad = F.rlike(v, F.lit(r"['\x{3B}]|--|[\x00-\x08\x0A-\x1F\x7F]"))
    return F.coalesce((F.octet_length(v) > 0) & (F.octet_length(v) <= 256) & ~bad, F.lit(False))


def domain(memory_type: Column | str, agent_id: Column | str) -> Column:
    return F.when((lit_or(memory_type) == "procedural") & lit_or(agent_id).isNotNull(), "agent").otherwise("user")


def namespace_key(dom: Column | str, org: Column | str, user: Column | str, agent: Column | str) -> Column:
    d, o = lit_or(dom), F.coalesce(lit_or(org), F.lit("_global"))
    return (
        F.when(d == "agent", F.concat_ws(":", F.lit("agent"), o, F.coalesce(lit_or(agent), F.lit("_agent"))))
        .when(d == "user", F.concat_ws(":", F.lit("user"), o, F.coalesce(lit_or(user), F.lit("_anonymous"))))
        .otherwise(F.concat_ws(":", F.lit("org"), o))
    )


def shard_of(user: Column | str, shards: int) -> Column:
    """Little-endian first four bytes of SHA-256, modulo the shard count."""
    h = F.sha2(lit_or(user).cast("string"), 256)
    parts = [F.substring(h, p, 2) for p in (7, 5, 3, 1)]
    return F.conv(F.concat(*parts), 16, 10).cast("long") % shards


def relation_name(value: Column | str) -> Column:
    """Unknown relations read as ``RelatedTo``."""
    v = lit_or(value)
    return F.when(v.isin(*RELATIONS), v).otherwise(F.lit("RelatedTo"))


def org_scope(org: Column | str, wanted: str | None) -> Column:
    """Blank: everything; ``default``: rows without an organization too; else equality."""
    o, w = lit_or(org), (wanted or "").strip()
    if not w:
        return F.lit(True)
    return (o.isNull() | (o == "default")) if w == "default" else F.coalesce(o == w, F.lit(False))
