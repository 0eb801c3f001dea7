"""Content-addressed identities and the identity rules behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import first_reason, has_control, is_blank, portable, trim

# Limits and formats of the stored identity columns.
MAX_IDENTIFIER_BYTES = 128
MAX_KIND_BYTES = 64
MAX_SOURCE_REF_BYTES = 1024
MAX_HEADING_PATH_BYTES = 1024
MAX_ERROR_BYTES = 2048
MAX_COLLECTION_BYTES = 255
FORMATS = ("markdown", "go")
COLLECTION_PREFIX = "ctx_documents_"

_SEPARATOR = "\x00"


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 over parts separated by NUL."""
    return sha256(F.concat_ws(_SEPARATOR, *[p.cast("string") for p in parts]))


def identifier_reason(value: Column, field: str) -> Column:
    """P02 over an untrimmed identifier."""
    clean = trim(value)
    return first_reason(
        (is_blank(value), f"{field}_required"),
        (F.octet_length(clean) > MAX_IDENTIFIER_BYTES, f"{field}_too_long"),
        (~clean.rlike(r"\A[A-Za-z0-9_][A-Za-z0-9_.:-]*\z"), f"{field}_unsafe"),
    )


def source_ref_reason(value: Column) -> Column:
    """Relative, slash separated, already clean, inside the root."""
    clean = trim(value)
    return first_reason(
        (is_blank(value), "source_ref_required"),
        (F.contains(clean, F.lit("\\")), "source_ref_backslash"),
        (F.octet_length(clean) > MAX_SOURCE_REF_BYTES, "source_ref_too_long"),
        (has_control(clean), "source_ref_control"),
        (F.startswith(clean, F.lit("/")), "source_ref_absolute"),
        (clean.rlike(r"\A\.\.?\z|\A\.\./"), "source_ref_escapes"),
        (clean.rlike(r"//|/\.\.?(/|\z)|\A\./|/\z"), "source_ref_not_clean"),
    )


def normal_format(value: Column) -> Column:
    return F.lower(trim(value))


def format_reason(value: Column) -> Column:
    """P04."""
    return first_reason(
        (is_blank(value), "format_required"),
        (~normal_format(value).isin(*FORMATS), "format_unsupported"),
    )


def heading_segments(path: Column) -> Column:
    return F.transform(F.split(path, "/"), trim)


def normal_heading_path(path: Column) -> Column:
    """Trimmed segments joined by ``" / "``; meaningful only where ``heading_path_reason`` is null."""
    return F.array_join(heading_segments(path), " / ")


def heading_path_reason(path: Column) -> Column:
    return first_reason(
        (F.octet_length(path) > MAX_HEADING_PATH_BYTES, "heading_path_too_long"),
        (has_control(path), "heading_path_control"),
        (F.exists(heading_segments(path), lambda s: s == ""), "heading_path_empty_segment"),
    )


def content_hash(text: Column) -> Column:
    """Hash of the portable text."""
    return sha256(portable(text))


def chunk_id(scope: Column, document: Column, kind: Column, path: Column, text_hash: Column,
             duplicate: Column) -> Column:
    """Neither the version nor a line number takes part, so unchanged text keeps its id."""
    return joined_hash(trim(scope), trim(document), trim(kind), normal_heading_path(path), text_hash, duplicate)


def policy_hash(fmt: Column, parser: Column, max_tokens: Column, overlap_lines: Column, model: Column) -> Column:
    """I03."""
    return joined_hash(normal_format(fmt), trim(parser), max_tokens, overlap_lines, trim(model))


def point_id(scope: Column, chunk: Column) -> Column:
    """Hash bytes in the layout of a version 4 UUID."""
    digest = joined_hash(trim(scope), trim(chunk))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def trimmed_hash(text: Column) -> Column:
    """Hash of the trimmed text, as stored with a retrievable chunk."""
    return sha256(trim(text))


def bounded_error(message: Column, limit: int = MAX_ERROR_BYTES) -> Column:
    """At most ``limit`` bytes, cut on a character boundary and marked as cut."""
    suffix = "...[truncated]"
    text = F.when(is_blank(message), F.lit("document build failed")).otherwise(trim(message))
    head = F.substring(F.encode(text, "UTF-8"), 1, limit - len(suffix)).cast("string")
    # An incomplete last character becomes one or more replacement marks, which are then dropped.
    whole = F.regexp_replace(F.make_valid_utf8(head), "\ufffd+\\z", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(suffix)))


def is_hex64(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def build_reason(prefix: str = COLLECTION_PREFIX) -> Column:
    """P08 over the seven build identity columns."""
    collection = F.col("target_collection")
    return F.coalesce(
        identifier_reason(F.col("knowledge_scope"), "knowledge_scope"),
        identifier_reason(F.col("document_id"), "document_id"),
        source_ref_reason(F.col("source_ref")),
        identifier_reason(F.col("parser_version"), "parser_version"),
        first_reason(
            (~is_hex64(F.col("content_hash")), "content_hash_not_hex"),
            (~is_hex64(F.col("chunk_policy_hash")), "chunk_policy_hash_not_hex"),
            (~F.startswith(trim(collection), F.lit(prefix)), "target_collection_prefix"),
            (F.octet_length(collection) > MAX_COLLECTION_BYTES, "target_collection_too_long"),
        ),
    )
