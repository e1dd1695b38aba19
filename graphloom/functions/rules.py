"""Small rules of the data model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.vectors import FLOAT_MAX, clamp

#: The spellings of all enumerations.
NODE_TYPES = ("leaf", "parent", "root")
NODE_STATUSES = ("complete", "incomplete", "pending", "deprecated")
SOURCE_TYPES = ("pdf", "image", "text", "web", "conversation", "synthetic")
EDGE_TYPES = ("parentchild", "semantic", "temporal", "causal", "crossnamespace", "similar")
UPLOAD_STATUSES = ("uploading", "finalizing", "converting", "ready", "failed", "cancelled")
ACTIVE_UPLOADS = ("uploading", "finalizing", "converting")
GLOBAL = "global_knowledge"
#: Patterns in front of a tensor's layer number, in the order they are tried.
LAYER_MARKS = ("blk.", "layers.", "h.", "block.", "layer.")


def edge_weight(similarity: Column) -> Column:
    return F.when(similarity <= 0, FLOAT_MAX).otherwise(1 / similarity)


def edge_valid(weight: Column, similarity: Column, confidence: Column) -> Column:
    finite = ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    return finite & similarity.between(0, 1) & confidence.between(0, 1)


def is_hot(access_count: Column, more_than: int = 10) -> Column:
    return access_count > more_than


def is_expired(expires_at: Column, now: Column) -> Column:
    """A scope without an end doesn't expire; one that ends now hasn't yet."""
    return F.coalesce(now > expires_at, F.lit(False))


def can_write(permissions: Column, expires_at: Column, now: Column) -> Column:
    return permissions["write"] & ~is_expired(expires_at, now)


def can_delete(permissions: Column, expires_at: Column, now: Column) -> Column:
    return permissions["delete"] & ~is_expired(expires_at, now)


def thing_id(thing: Column) -> Column:
    """The part behind the table of "table:id"."""
    return F.split_part(thing, F.lit(":"), F.lit(2))


def thing_pair(thing: Column, default_table: str = "nodes") -> Column:
    """Struct of table and id; without a colon the default table, with two or more null."""
    parts = F.split(thing, ":")
    return F.when(F.size(parts) == 1, F.struct(F.lit(default_table).alias("table"), thing.alias("id"))).when(F.size(parts) == 2, F.struct(parts[0].alias("table"), parts[1].alias("id")))


def is_rem_time(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in [start, end), over midnight too; equal bounds are the whole day."""
    if start == end:
        return F.lit(True)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def format_params(n: Column) -> Column:
    scaled = lambda by, unit: F.format_string(f"%.1f{unit}", n / by)
    return F.when(n >= 1_000_000_000, scaled(1e9, "B")).when(n >= 1_000_000, scaled(1e6, "M")).when(n >= 1000, scaled(1e3, "K")).otherwise(n.cast("string"))


def overall_progress(stage: Column, embedded: Column, persisted: Column, chunks: Column) -> Column:
    share = lambda done: F.when(chunks == 0, 0.0).otherwise(done / chunks * 100)
    return F.when(stage == "extracting", 10.0).when(stage == "chunking", 20.0).when(stage == "embedding", 20 + share(embedded) * 0.5).when(stage == "persisting", 70 + share(persisted) * 0.25).when(stage == "complete", 100.0).otherwise(0.0)


def upload_progress(received: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(clamp(received / total * 100, 0.0, 100.0))


def upload_speed(size: Column, seconds: Column) -> Column:
    """MiB a second, null without time."""
    return F.when(seconds > 0, size / 1048576 / seconds)


def layer_number(name: Column) -> Column:
    """The number between the first mark that has one and the next dot, null if none."""
    found = [F.regexp_extract(name, f"^(?:(?!{mark.replace('.', '[.]')}).)*{mark.replace('.', '[.]')}([0-9]+)[.]", 1) for mark in LAYER_MARKS]
    return F.coalesce(*(F.when(x != "", x.cast("int")) for x in found))


def health(database: Column, model: Column) -> Column:
    return F.when(database & model, "healthy").when(database | model, "degraded").otherwise("unhealthy")


def to_time(text: Column) -> Column:
    """An RFC 3339 text as a timestamp, null if it is none."""
    return F.try_to_timestamp(text)


def rfc3339(at: Column) -> Column:
    """A timestamp as RFC 3339 text; the session's time zone should be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def merge_members(a: Column, b: Column) -> Column:
    """The members of two clusters, each once, the first cluster's first."""
    return F.array_union(a, b)


def split_members(members: Column, parts: Column) -> Column:
    """The parts of a cluster's members along given partitions, without empty ones and without members it doesn't have."""
    return F.filter(F.transform(parts, lambda p: F.array_intersect(p, members)), lambda p: F.size(p) > 0)


def add_member(members: Column, member: Column) -> Column:
    return F.when(F.array_contains(members, member), members).otherwise(F.array_append(members, member))


def remove_member(members: Column, member: Column) -> Column:
    """Without the first such member."""
    at = F.array_position(members, member).cast("int")
    return F.when(at == 0, members).otherwise(F.concat(F.slice(members, F.lit(1), at - 1), F.slice(members, at + 1, F.size(members))))


def is_pdf(content: Column, most_bytes: int = 100 << 20) -> Column:
    return (F.hex(F.substring(content, 1, 4)) == "25504446") & (F.octet_length(content) <= most_bytes)
