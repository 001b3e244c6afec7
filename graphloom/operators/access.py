"""Filters of governed reads: who, which state, which version, and whether evidence holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    tenant_id: str
    groups: tuple[str, ...]


def authorized(rows: DataFrame, who: Principal) -> DataFrame:
    """Rows of the principal's tenant that one of its groups may read."""
    groups = F.array(*[F.lit(g) for g in who.groups])
    return rows.filter((F.col("tenant_id") == who.tenant_id) & F.arrays_overlap("access_groups", groups))


def active(rows: DataFrame) -> DataFrame:
    """Rows whose lifecycle is ACTIVE or unset."""
    return rows.filter(F.coalesce("lifecycle", F.lit("ACTIVE")) == "ACTIVE")


def in_versions(
    rows: DataFrame, document_ids: list[int] | None = None, version_ids: list[int] | None = None,
    published_until: str | None = None, match_none: bool = False,
) -> DataFrame:
    """Rows of the wanted documents and versions; a cutoff drops rows without a publication time."""
    if match_none:
        return rows.limit(0)
    if document_ids is not None:
        rows = rows.filter(F.col("document_id").isin(document_ids))
    if version_ids is not None:
        rows = rows.filter(F.col("version_id").isin(version_ids))
    if published_until is not None:
        rows = rows.filter(F.col("published_at") <= F.lit(published_until).cast("timestamp"))
    return rows


def stands_at(text: Column, quoted: Column, start: Column) -> Column:
    """Whether ``quoted`` is what the text holds from ``start`` (from 0)."""
    return F.substring(text, start + 1, F.length(quoted)) == quoted


#: The states of a snapshot whose chunks may be read.
READABLE_STATES = ("PUBLISHED", "RETIRED")


def readable_chunks(
    documents: DataFrame, versions: DataFrame, snapshots: DataFrame, chunks: DataFrame, who: Principal,
    document_ids: list | None = None, version_ids: list | None = None, published_until: str | None = None,
) -> DataFrame:
    """The chunks that a principal may read now, by the whole chain from document to chunk.

    documents (document_id, tenant_id, access_groups, policy_id, policy_version, lifecycle, retirement_id), versions (version_id, document_id,
    tenant_id, lifecycle, retirement_id, published_at), snapshots (snapshot_id, document_id, version_id, tenant_id, build_state,
    retirement_id), chunks (chunk_id, snapshot_id, document_id, version_id, tenant_id, access_groups, policy_id, policy_version and
    others). All four are of the principal's tenant; document and chunk each share a group with it; the chunk has the document's policy and
    its version; nothing is retired. Unset groups and unset policies let nobody in. Rows of the result are the chunks' own columns.
    """
    mine = lambda rows: rows.filter(F.col("tenant_id") == who.tenant_id)
    d = active(authorized(documents, who)).filter("retirement_id IS NULL").select(
        F.col("document_id").alias("d_id"), F.col("policy_id").alias("d_policy"), F.col("policy_version").alias("d_policy_version"))
    v = active(mine(in_versions(versions, document_ids, version_ids, published_until))).filter("retirement_id IS NULL").select(
        F.col("version_id").alias("v_id"), F.col("document_id").alias("v_document"))
    s = mine(snapshots).filter(F.col("retirement_id").isNull() & F.col("build_state").isin(*READABLE_STATES)).select(
        F.col("snapshot_id").alias("s_id"), F.col("document_id").alias("s_document"), F.col("version_id").alias("s_version"))
    chain = d.join(v, F.col("d_id") == F.col("v_document")).join(s, (F.col("s_document") == F.col("d_id")) & (F.col("s_version") == F.col("v_id")))
    joined = authorized(chunks, who).join(
        chain, (F.col("snapshot_id") == F.col("s_id")) & (F.col("document_id") == F.col("d_id")) & (F.col("version_id") == F.col("v_id"))
        & (F.col("policy_id") == F.col("d_policy")) & (F.col("policy_version") == F.col("d_policy_version")))
    return joined.select(*[F.col(f"`{c}`") for c in chunks.columns])
