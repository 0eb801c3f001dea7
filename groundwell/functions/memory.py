"""Column rules of long-term memory: operations, kinds, keys and the stored-item check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.text import first_reason, is_blank, is_finite, trim

# Operations, kinds, statuses, limits and the phrases that ask to forget.
OPERATIONS = ("upsert", "forget")
KINDS = ("identity", "preference", "project_fact", "goal", "constraint")
STATUSES = ("active", "forgotten")
MAX_KEY_BYTES = 128
MAX_VALUE_CHARS = 4096
FORGET_PREFIXES = ("忘掉", "忘记", "forget ")
FORGET_PHRASES = (
    "请忘掉", "请忘记", "不要记住", "删除关于", "删除这条记忆", "清除关于", "清除这条记忆",
    "please forget", "do not remember", "remove this memory", "delete this memory",
)


def normal_word(value: Column) -> Column:
    return F.lower(trim(value))


def normal_key(key: Column) -> Column:
    """Lower case, runs of underscore, hyphen and white space as one underscore, none at the edges."""
    joined = F.regexp_replace(trim(F.lower(key)), r"(?U)[_\-\s]+", "_")
    return F.btrim(joined, F.lit("_"))


def key_reason(key: Column) -> Column:
    normal = normal_key(key)
    return first_reason(
        (is_blank(key), "key_required"),
        (~trim(F.lower(key)).rlike(r"(?U)\A[a-z0-9_\-\s]*\z"), "key_unsupported_character"),
        (normal == "", "key_required"),
        (~normal.rlike(r"\A[a-z]"), "key_must_start_with_letter"),
        (F.octet_length(normal) > MAX_KEY_BYTES, "key_too_long"),
    )


def operation_reason(operation: Column) -> Column:
    return F.when(~F.coalesce(normal_word(operation).isin(*OPERATIONS), F.lit(False)), F.lit("operation_unsupported"))


def kind_reason(kind: Column) -> Column:
    return F.when(~F.coalesce(normal_word(kind).isin(*KINDS), F.lit(False)), F.lit("kind_unsupported"))


def candidate_reason() -> Column:
    """P16 over operation, kind, key, value and confidence; the citation checks need the messages."""
    value, confidence = trim(F.col("value")), F.col("confidence")
    upsert = normal_word(F.col("operation")) == "upsert"
    return F.coalesce(
        F.when(is_blank(F.col("user_id")), F.lit("user_id_required")),
        F.when(is_blank(F.col("session_id")), F.lit("session_id_required")),
        operation_reason(F.col("operation")),
        kind_reason(F.col("kind")),
        key_reason(F.col("key")),
        first_reason(
            (~F.coalesce(is_finite(confidence) & confidence.between(0, 1), F.lit(False)), "confidence_out_of_range"),
            (upsert & is_blank(value), "value_required"),
            (F.char_length(value) > MAX_VALUE_CHARS, "value_too_long"),
        ),
    )


def resolvable_reason() -> Column:
    """What a candidate must satisfy before it can be ordered and resolved."""
    ids = F.col("source_message_ids")
    upsert = normal_word(F.col("operation")) == "upsert"
    return F.coalesce(
        operation_reason(F.col("operation")),
        kind_reason(F.col("kind")),
        key_reason(F.col("key")),
        first_reason(
            (upsert & is_blank(F.col("value")), "value_required"),
            (ids.isNull() | (F.size(ids) == 0), "source_ids_required"),
            (F.exists(ids, lambda i: i <= 0), "source_id_not_positive"),
        ),
    )


def asks_to_forget(content: Column) -> Column:
    """P19 for one message."""
    text = normal_word(content)
    found = F.lit(False)
    for prefix in FORGET_PREFIXES:
        found = found | F.startswith(text, F.lit(prefix))
    for phrase in FORGET_PHRASES:
        found = found | F.contains(text, F.lit(phrase))
    return found


def stored_item_reason() -> Column:
    """P28 without the duplicate check."""
    return first_reason(
        (F.col("id").isNull() | (F.col("id") <= 0), "id_not_positive"),
        (F.col("version").isNull() | (F.col("version") <= 0), "version_not_positive"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status_unsupported"),
    )


def indexable_reason() -> Column:
    """Only active, complete items enter the vector index."""
    return F.coalesce(
        first_reason(
            (F.col("id").isNull() | (F.col("id") <= 0), "id_not_positive"),
            (is_blank(F.col("user_id")), "user_id_required"),
            (~F.col("status").eqNullSafe("active"), "not_active"),
            (F.col("version").isNull() | (F.col("version") <= 0), "version_not_positive"),
        ),
        kind_reason(F.col("kind")),
        key_reason(F.col("memory_key")),
        F.when(is_blank(F.col("value")), F.lit("value_required")),
    )


def memory_point_reason() -> Column:
    """P14 over a point id and its payload; ``requested_kind`` is null when every kind was asked for."""
    asked = F.col("requested_kind")
    return F.coalesce(
        first_reason(
            (~trim(F.col("user_id")).eqNullSafe(F.col("requested_user_id")), "foreign_user"),
            (~F.col("item_id").eqNullSafe(F.col("point_id")) | (F.col("point_id") <= 0), "point_id_mismatch"),
        ),
        kind_reason(F.col("kind")),
        key_reason(F.col("memory_key")),
        first_reason(
            (asked.isNotNull() & (normal_word(F.col("kind")) != asked), "foreign_kind"),
            (is_blank(F.col("value")), "value_required"),
            (F.col("version").isNull() | (F.col("version") <= 0), "version_not_positive"),
            (~F.coalesce(is_finite(F.col("score")), F.lit(False)), "score_not_finite"),
        ),
    )
