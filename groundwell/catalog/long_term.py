"""Long-term memory over the events table: each event is a candidate, and the message it cites."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.registry import query
from groundwell.functions import memory as rules
from groundwell.functions import render
from groundwell.functions.text import value_key
from groundwell.operators import memory, points
from groundwell.operators.stages import empty, materialize
from groundwell.sources import tables

_KIND = """CASE event_type WHEN 'view' THEN 'preference' WHEN 'click' THEN 'goal' WHEN 'signup' THEN 'identity'
  WHEN 'purchase' THEN 'project_fact' ELSE 'constraint' END"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

_CANDIDATES = f"""
candidates AS (SELECT CAST(user_id AS VARCHAR) AS user_id, 'events' AS session_id, event_id AS position,
  CASE WHEN {_K} % 4 = 3 THEN 'forget' ELSE 'upsert' END AS operation, {_KIND} AS kind, 'k' || ({_K} % 5) AS memory_key,
  'Value ' || CAST(floor(value / 20) AS BIGINT) AS value, event_id + 1 AS source_id FROM events),
items AS (SELECT row_number() OVER () * 0 + CAST(user_id AS BIGINT) * 10 + CASE kind WHEN 'preference' THEN 1
    WHEN 'goal' THEN 2 WHEN 'identity' THEN 3 WHEN 'project_fact' THEN 4 ELSE 5 END AS id, user_id, kind,
  'k0' AS memory_key, 'value  0' AS value, CASE WHEN n % 2 = 0 THEN 'forgotten' ELSE 'active' END AS status, n AS version
  FROM (SELECT user_id, kind, count(*) AS n FROM candidates GROUP BY user_id, kind))"""

_RESOLVED = f"""WITH {_CANDIDATES},
chain AS (
  SELECT user_id, kind, memory_key, session_id, source_id, position, operation, value, 0 AS stored_version, false AS is_stored
  FROM candidates UNION ALL
  SELECT user_id, kind, memory_key, NULL, 0, -1, CASE status WHEN 'active' THEN 'upsert' ELSE 'forget' END, value, version,
    true FROM items),
linked AS (SELECT *, lag(operation) OVER w AS before_op, lower({sql.fold('value')}) AS norm,
  lag(lower({sql.fold('value')})) OVER w AS before_norm,
  coalesce(bool_or(operation = 'upsert' OR is_stored) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AS existed
  FROM chain WINDOW w AS (PARTITION BY user_id, kind, memory_key ORDER BY source_id, position)),
acted AS (SELECT *, CASE WHEN NOT existed AND operation = 'forget' THEN 'missing_item_already_forgotten'
    WHEN NOT existed THEN 'new_memory_item' WHEN operation = 'forget' AND before_op = 'forget' THEN 'item_already_forgotten'
    WHEN operation = 'forget' THEN 'explicit_forget_request' WHEN before_op = 'forget' THEN 'restore_forgotten_item'
    WHEN norm = before_norm THEN 'equivalent_active_value' ELSE 'replace_changed_value' END AS reason FROM linked),
stepped AS (SELECT *, CASE WHEN reason IN ('missing_item_already_forgotten', 'item_already_forgotten',
      'equivalent_active_value') THEN 'noop' WHEN reason = 'new_memory_item' THEN 'insert'
    WHEN reason = 'explicit_forget_request' THEN 'forget' ELSE 'update' END AS action FROM acted),
versioned AS (SELECT *, CAST(sum(CASE WHEN is_stored THEN stored_version WHEN action = 'noop' THEN 0 ELSE 1 END) OVER r
    AS BIGINT) AS version,
  coalesce(last_value(CASE WHEN is_stored OR action IN ('insert', 'update') THEN value END IGNORE NULLS) OVER r, '')
    AS next_value
  FROM stepped WINDOW r AS (PARTITION BY user_id, kind, memory_key ORDER BY source_id, position
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
decisions AS (SELECT *, CASE operation WHEN 'upsert' THEN 'active' ELSE 'forgotten' END AS next_status,
  existed OR operation = 'upsert' AS item_exists FROM versioned WHERE NOT is_stored)"""

_APPLIED = f"""{_RESOLVED},
finals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind, memory_key
  ORDER BY source_id DESC, position DESC) AS age FROM decisions WHERE item_exists) WHERE age = 1),
fresh AS (SELECT f.*, row_number() OVER (ORDER BY sha256(f.user_id || chr(0) || f.kind || chr(0) || f.memory_key))
  + (SELECT coalesce(max(id), 0) FROM items) AS new_id FROM finals f ANTI JOIN items i USING (user_id, kind, memory_key)),
after AS (
  SELECT i.id, user_id, kind, memory_key, coalesce(f.next_value, i.value) AS value,
    coalesce(f.next_status, i.status) AS status, coalesce(f.version, i.version) AS version
  FROM items i LEFT JOIN finals f USING (user_id, kind, memory_key)
  UNION ALL SELECT CAST(new_id AS BIGINT), user_id, kind, memory_key, next_value, next_status, version FROM fresh)"""


def candidates(spark, folder):
    return tables.candidates(spark, folder)


def stored_items(spark, folder):
    """Items stored before the events: one per user and kind, every second one forgotten."""
    counted = candidates(spark, folder).groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("version"))
    number = (F.when(F.col("kind") == "preference", 1).when(F.col("kind") == "goal", 2)
              .when(F.col("kind") == "identity", 3).when(F.col("kind") == "project_fact", 4).otherwise(5))
    return counted.select(
        (F.col("user_id").cast("long") * 10 + number).alias("id"), "user_id", "kind", F.lit("k0").alias("memory_key"),
        F.lit("value  0").alias("value"),
        F.when(F.col("version") % 2 == 0, "forgotten").otherwise("active").alias("status"), "version")


def decisions(spark, folder):
    return memory.resolve_batch(candidates(spark, folder), stored_items(spark, folder))


def event_messages(spark, folder):
    """The message behind each event; some come from the assistant, some ask to forget."""
    k = F.get_json_object("props", "$.k").cast("long")
    return tables.read(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("id"), F.lit("events").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(k % 7 == 0, "assistant").otherwise("user").alias("role"),
        F.when(k % 8 == 3, F.concat(F.lit("Please FORGET that I like "), "event_type"))
        .when(k % 8 == 7, F.concat(F.lit(" 忘掉 "), "event_type"))
        .otherwise(F.concat(F.lit("I do not forget "), "event_type")).alias("content"))


_EVENT_MESSAGES = f"""
event_messages AS (SELECT event_id + 1 AS id, 'events' AS session_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN {_K} % 7 = 0 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN {_K} % 8 = 3 THEN 'Please FORGET that I like ' || event_type WHEN {_K} % 8 = 7 THEN ' 忘掉 ' || event_type
    ELSE 'I do not forget ' || event_type END AS content FROM events)"""

_RAW = f"""
raw AS (SELECT event_id AS position, CAST(user_id AS VARCHAR) AS user_id, 'events' AS session_id,
  CASE WHEN {_K} % 9 = 8 THEN 'merge' WHEN {_K} % 4 = 3 THEN ' Forget' ELSE 'UPSERT ' END AS operation,
  CASE WHEN {_K} % 11 = 10 THEN 'mood' ELSE upper({_KIND}) END AS kind,
  (['Teaching Style', 'implementation_language', '9lives', '名字', ' __a - b__ ', ''])[{_K} % 6 + 1] AS key,
  CASE WHEN {_K} % 13 = 5 THEN ' ' ELSE ' v' || {_K} || ' ' END AS value, value / 100 AS confidence,
  event_id + 1 AS first_id, event_id + CASE WHEN {_K} % 10 = 0 THEN 2 ELSE 1 END AS second_id FROM events)"""

_KEY = f"trim(regexp_replace({sql.trim('lower(key)')}, '[_\\-\\s]+', '_', 'g'), '_')"
_KEY_REASON = f"""CASE WHEN {sql.blank('key')} THEN 'key_required'
  WHEN NOT regexp_full_match({sql.trim('lower(key)')}, '[a-z0-9_\\-\\s]*') THEN 'key_unsupported_character'
  WHEN {_KEY} = '' THEN 'key_required' WHEN NOT regexp_matches({_KEY}, '^[a-z]') THEN 'key_must_start_with_letter'
  WHEN octet_length(encode({_KEY})) > 128 THEN 'key_too_long' END"""
_OWN_REASON = f"""CASE WHEN lower({sql.trim('operation')}) NOT IN ('upsert', 'forget') THEN 'operation_unsupported'
  WHEN lower({sql.trim('kind')}) NOT IN ('identity', 'preference', 'project_fact', 'goal', 'constraint')
    THEN 'kind_unsupported' ELSE coalesce({_KEY_REASON},
  CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range'
    WHEN lower({sql.trim('operation')}) = 'upsert' AND {sql.blank('value')} THEN 'value_required'
    WHEN length({sql.trim('value')}) > 4096 THEN 'value_too_long' END) END"""


def raw_candidates(spark, folder):
    """Candidates as a model might propose them: odd spellings, unknown kinds, foreign citations."""
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = F.when(F.col("event_type") == "view", "PREFERENCE").when(F.col("event_type") == "click", "GOAL").when(
        F.col("event_type") == "signup", "IDENTITY").when(F.col("event_type") == "purchase", "PROJECT_FACT").otherwise(
        "CONSTRAINT")
    names = F.array(*[F.lit(n) for n in
                      ("Teaching Style", "implementation_language", "9lives", "名字", " __a - b__ ", "")])
    return tables.read(spark, folder, "events").select(
        F.col("event_id").alias("position"), F.col("user_id").cast("string").alias("user_id"),
        F.lit("events").alias("session_id"),
        F.when(k % 9 == 8, "merge").when(k % 4 == 3, " Forget").otherwise("UPSERT ").alias("operation"),
        F.when(k % 11 == 10, "mood").otherwise(kinds).alias("kind"),
        F.get(names, (k % 6).cast("int")).alias("key"),
        F.when(k % 13 == 5, " ").otherwise(F.concat(F.lit(" v"), k.cast("string"), F.lit(" "))).alias("value"),
        (F.col("value") / 100).alias("confidence"),
        F.array(F.col("event_id") + 1, F.col("event_id") + F.when(k % 10 == 0, 2).otherwise(1)).alias(
            "source_message_ids"))


@query("p16_candidate_rules", f"WITH {_RAW} SELECT position, {_OWN_REASON} AS reject_reason FROM raw")
def _(spark, folder):
    return raw_candidates(spark, folder).select("position", rules.candidate_reason().alias("reject_reason"))


@query("p17_memory_keys", f"""WITH {_RAW}
  SELECT position, {_KEY_REASON} AS reject_reason, CASE WHEN {_KEY_REASON} IS NULL THEN {_KEY} END AS memory_key FROM raw""")
def _(spark, folder):
    return raw_candidates(spark, folder).select("position", rules.key_reason(F.col("key")).alias("reject_reason")).join(
        raw_candidates(spark, folder).select("position", rules.normal_key(F.col("key")).alias("k")), "position").select(
        "position", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("k")).alias("memory_key"))


_SOURCES = f"""WITH {_RAW},{_EVENT_MESSAGES},
cited AS (SELECT position, user_id, session_id, first_id AS cited, 0 AS place FROM raw UNION
  SELECT position, user_id, session_id, second_id, 1 FROM raw WHERE second_id <> first_id),
judged AS (SELECT c.position, c.place, CASE WHEN m.role IS NULL THEN 'source_unknown'
    WHEN m.user_id <> c.user_id THEN 'source_of_another_user' WHEN m.session_id <> c.session_id
    THEN 'source_of_another_session' WHEN m.role <> 'user' THEN 'source_not_from_user' END AS problem,
  lower({sql.trim('content')}) AS said FROM cited c LEFT JOIN event_messages m ON m.id = c.cited),
asked AS (SELECT *, coalesce(starts_with(said, '忘掉') OR starts_with(said, '忘记') OR starts_with(said, 'forget ')
  OR contains(said, '请忘掉') OR contains(said, '请忘记') OR contains(said, '不要记住') OR contains(said, '删除关于')
  OR contains(said, '删除这条记忆') OR contains(said, '清除关于') OR contains(said, '清除这条记忆')
  OR contains(said, 'please forget') OR contains(said, 'do not remember') OR contains(said, 'remove this memory')
  OR contains(said, 'delete this memory'), false) AS asks FROM judged),
sourced AS (SELECT position, arg_min(problem, place) FILTER (problem IS NOT NULL) AS problem, bool_or(asks) AS asks
  FROM asked GROUP BY position)"""


@query("p18_source_citations", f"""{_SOURCES} SELECT position, problem AS reject_reason,
  CASE WHEN first_id = second_id THEN '' || first_id ELSE first_id || ',' || second_id END AS ids
  FROM sourced JOIN raw USING (position)""")
def _(spark, folder):
    checked = memory.check_sources(raw_candidates(spark, folder), event_messages(spark, folder), ["position"])
    return checked.select("position", "reject_reason", F.array_join("source_message_ids", ",").alias("ids"))


@query("p19_forget_requests", f"{_SOURCES} SELECT position, asks AS asks_to_forget FROM sourced")
def _(spark, folder):
    checked = memory.check_sources(raw_candidates(spark, folder), event_messages(spark, folder), ["position"])
    return checked.select("position", "asks_to_forget")


@query("p16_p19_validated_candidates", f"""{_SOURCES}, own AS (SELECT *, {_OWN_REASON} AS own_reason FROM raw)
  SELECT position, coalesce(own_reason, problem,
    CASE WHEN lower({sql.trim('operation')}) = 'forget' AND NOT asks THEN 'forget_not_requested' END) AS reject_reason,
    CASE WHEN lower({sql.trim('operation')}) = 'forget' THEN '' ELSE {sql.trim('value')} END AS value
  FROM own JOIN sourced USING (position)""")
def _(spark, folder):
    checked = memory.validate_candidates(raw_candidates(spark, folder), event_messages(spark, folder), ["position"])
    return checked.select("position", "reject_reason", "value")


@query("p21_decoded_candidates", f"""WITH {_RAW}
  SELECT position, CASE position % 5 WHEN 0 THEN 'not_one_json_object' WHEN 1 THEN 'unknown_candidate_field'
    WHEN 2 THEN 'candidate_field_required' WHEN 3 THEN 'candidates_required' END AS reject_reason,
    CAST(CASE WHEN position % 5 = 4 THEN 1 ELSE 0 END AS BIGINT) AS candidate_count FROM raw""")
def _(spark, folder):
    one = F.concat(F.lit('{"operation":"upsert","kind":"goal","key":"k","value":"'), F.col("position").cast("string"),
                   F.lit('","confidence":0.5,"source_message_ids":[1]'))
    case = F.col("position") % 5
    raw = (F.when(case == 0, F.concat(F.lit('{"candidates":['), one, F.lit("}]} {}")))
           .when(case == 1, F.concat(F.lit('{"candidates":['), one, F.lit(',"mood":1}]}')))
           .when(case == 2, F.lit('{"candidates":[{"operation":"upsert","kind":"goal"}]}'))
           .when(case == 3, F.lit("{}"))
           .otherwise(F.concat(F.lit(' {"candidates":['), one, F.lit("}]} "))))
    decoded = memory.decode_candidates(raw_candidates(spark, folder).select("position", raw.alias("raw")))
    return decoded.select("position", "reject_reason",
                          F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0)).alias("candidate_count"))


@query("p28_stored_items", f"""WITH {_CANDIDATES},
  listed AS (SELECT * FROM items UNION ALL SELECT * REPLACE (CASE WHEN id % 30 = 1 THEN 0 ELSE id END AS id,
    CASE WHEN id % 30 = 2 THEN 'gone' ELSE status END AS status, CASE WHEN id % 30 = 3 THEN 0 ELSE version END AS version,
    CASE WHEN id % 30 < 5 THEN 'k1' ELSE memory_key END AS memory_key) FROM items)
  SELECT id, user_id, kind, memory_key, version, status, CASE WHEN id <= 0 THEN 'id_not_positive'
    WHEN version <= 0 THEN 'version_not_positive' WHEN status NOT IN ('active', 'forgotten') THEN 'status_unsupported'
    WHEN count(*) OVER (PARTITION BY user_id, kind, memory_key) > 1 THEN 'duplicate_identity' END AS reject_reason
  FROM listed""")
def _(spark, folder):
    items = stored_items(spark, folder)
    r = F.col("id") % 30
    odd = items.select(
        F.when(r == 1, 0).otherwise(F.col("id")).alias("id"), "user_id", "kind",
        F.when(r < 5, "k1").otherwise(F.col("memory_key")).alias("memory_key"), "value",
        F.when(r == 2, "gone").otherwise(F.col("status")).alias("status"),
        F.when(r == 3, 0).otherwise(F.col("version")).alias("version"))
    return memory.stored_items_reason(items.unionByName(odd)).drop("value")


@query("k02_candidate_order", f"""WITH {_CANDIDATES}
  SELECT position, source_id, row_number() OVER (PARTITION BY user_id ORDER BY source_id, position) AS place
  FROM candidates""")
def _(spark, folder):
    from pyspark.sql import Window

    ordered = memory.normal_candidates(candidates(spark, folder))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("source_id", "position"))
    return ordered.select("position", "source_id", place.alias("place"))


@query("m01_item_lookup", f"""WITH {_CANDIDATES}
  SELECT position, id, status, version FROM candidates LEFT JOIN items USING (user_id, kind, memory_key)""")
def _(spark, folder):
    asked = candidates(spark, folder).select(
        "position", "user_id", F.upper("kind").alias("kind"), F.upper("key").alias("memory_key"))
    return memory.find_items(asked, stored_items(spark, folder)).select("position", "id", "status", "version")


@query("m02_active_items", f"""WITH {_CANDIDATES}
  SELECT user_id, id, kind, memory_key, version FROM items WHERE status = 'active' ORDER BY user_id, id""")
def _(spark, folder):
    return memory.active_items(stored_items(spark, folder)).select("user_id", "id", "kind", "memory_key", "version")


@query("m04_value_keys", f"""WITH {_CANDIDATES} SELECT position, lower({sql.fold("'  ' || value || chr(9) || ' X '")}) AS value_key
  FROM candidates""")
def _(spark, folder):
    odd = F.concat(F.lit("  "), F.col("value"), F.lit("\t X "))
    return candidates(spark, folder).select("position", value_key(odd).alias("value_key"))


@query("m05_single_resolution", f"""WITH {_CANDIDATES}
  SELECT position, CASE WHEN id IS NULL AND operation = 'forget' THEN 'missing_item_already_forgotten'
      WHEN id IS NULL THEN 'new_memory_item' WHEN operation = 'forget' AND status = 'forgotten' THEN 'item_already_forgotten'
      WHEN operation = 'forget' THEN 'explicit_forget_request' WHEN status = 'forgotten' THEN 'restore_forgotten_item'
      WHEN lower({sql.fold('c.value')}) = lower({sql.fold('i.value')}) THEN 'equivalent_active_value'
      ELSE 'replace_changed_value' END AS reason
  FROM candidates c LEFT JOIN items i USING (user_id, kind, memory_key)""")
def _(spark, folder):
    return memory.resolve_single(candidates(spark, folder), stored_items(spark, folder)).select("position", "reason")


@query("m06_candidate_identity", f"""WITH {_RAW}
  SELECT position, lower({sql.trim('kind')}) || '/' || {_KEY} AS identity, coalesce(
    CASE WHEN lower({sql.trim('operation')}) NOT IN ('upsert', 'forget') THEN 'operation_unsupported'
    WHEN lower({sql.trim('kind')}) NOT IN ('identity', 'preference', 'project_fact', 'goal', 'constraint')
      THEN 'kind_unsupported' END, {_KEY_REASON},
    CASE WHEN lower({sql.trim('operation')}) = 'upsert' AND {sql.blank('value')} THEN 'value_required' END)
      AS reject_reason FROM raw""")
def _(spark, folder):
    normal = memory.normal_candidates(raw_candidates(spark, folder))
    return normal.select("position", F.concat_ws("/", "kind", "memory_key").alias("identity"), "reject_reason")


@query("m07_batch_resolution", f"""{_RESOLVED} SELECT position, user_id, kind, memory_key, operation, action, reason, version,
  next_value, next_status FROM decisions""")
def _(spark, folder):
    return decisions(spark, folder).select("position", "user_id", "kind", "memory_key", "operation", "action", "reason",
                                           "version", "next_value", "next_status")


@query("m08_applied_items", f"{_APPLIED} SELECT id, user_id, kind, memory_key, value, status, version FROM after")
def _(spark, folder):
    return items_after(spark, folder)


_EVIDENCE = f"""{_APPLIED},{_EVENT_MESSAGES},
evidence AS (SELECT a.id AS memory_item_id, d.user_id, d.session_id AS source_session_id, d.source_id AS source_message_id,
  m.role AS source_role, d.operation, m.content AS evidence_text
  FROM decisions d JOIN after a USING (user_id, kind, memory_key) JOIN event_messages m ON m.id = d.source_id
  WHERE d.item_exists),
kept AS (SELECT * FROM evidence WHERE source_role = 'assistant')"""


def applied(spark, folder):
    """Items after the events and the new evidence."""
    stored = empty(spark, "memory_item_id long, source_session_id string, source_message_id long, operation string")
    return memory.apply_candidates(candidates(spark, folder), stored_items(spark, folder),
                                   event_messages(spark, folder), stored)


def items_after(spark, folder):
    return memory.latest_items(decisions(spark, folder), stored_items(spark, folder))


@query("m08_evidence", f"""{_EVIDENCE} SELECT memory_item_id, user_id, source_session_id, source_message_id, source_role,
  operation, evidence_text FROM evidence""")
def _(spark, folder):
    return applied(spark, folder)[1]


@query("k06_insert_ignore", f"""{_EVIDENCE} SELECT memory_item_id, source_message_id, operation FROM evidence
  ANTI JOIN kept USING (memory_item_id, source_session_id, source_message_id, operation)""")
def _(spark, folder):
    made = materialize(applied(spark, folder)[1])
    kept = made.filter(F.col("source_role") == "assistant")
    return memory.insert_ignore(made, kept, memory.EVIDENCE_KEY).select("memory_item_id", "source_message_id", "operation")


@query("m09_version_guard", f"""WITH {_CANDIDATES}
  SELECT id, CASE WHEN id % 3 = 0 THEN 'version_conflict' ELSE 'applied' END AS outcome FROM items""")
def _(spark, folder):
    items = stored_items(spark, folder)
    updates = items.select("id", (F.col("version") + F.when(F.col("id") % 3 == 0, 1).otherwise(0))
                           .alias("expected_version"))
    return memory.guarded_updates(updates, items).select("id", "outcome")


def indexed(spark, folder):
    """What the index still holds: the items as they were before the events."""
    return stored_items(spark, folder).filter(F.col("status") == "active").select("id", "version")


_PLAN = f"""{_APPLIED},
indexed AS (SELECT id, version AS indexed_version FROM items WHERE status = 'active'),
plan AS (SELECT id, CASE WHEN status IS DISTINCT FROM 'active' THEN
    CASE WHEN indexed_version IS NOT NULL THEN 'delete' ELSE 'none' END
  WHEN indexed_version = version THEN 'none' ELSE 'upsert' END AS action
  FROM after FULL JOIN indexed USING (id))"""


@query("j15_sync_plan", f"{_PLAN} SELECT id, action FROM plan")
def _(spark, folder):
    after = items_after(spark, folder)
    return points.sync_plan(after, indexed(spark, folder))


@query("m10_synced_index", f"""{_APPLIED} SELECT id, version FROM after WHERE status = 'active'""")
def _(spark, folder):
    after = items_after(spark, folder)
    after = materialize(after)
    plan = points.sync_plan(after, indexed(spark, folder))
    changed = after.join(plan.filter(F.col("action") == "upsert").select("id"), "id", "left_semi").select("id", "version")
    gone = plan.filter(F.col("action") == "delete").select("id")
    return points.upsert(points.delete(indexed(spark, folder), gone, "id"), changed, "id")


@query("p15_indexable_items", f"""{_APPLIED}
  SELECT id, CASE WHEN status <> 'active' THEN 'not_active' WHEN {sql.blank('value')} THEN 'value_required' END
    AS reject_reason FROM after""")
def _(spark, folder):
    after = items_after(spark, folder)
    return after.select("id", rules.indexable_reason().alias("reject_reason"))


@query("p14_memory_points", f"""WITH {_CANDIDATES}
  SELECT id, CASE WHEN id % 4 = 0 THEN 'foreign_user' WHEN id % 5 = 0 THEN 'point_id_mismatch'
    WHEN kind <> 'goal' AND id % 3 = 0 THEN 'foreign_kind' WHEN id % 7 = 0 THEN 'version_not_positive' END AS reject_reason
  FROM items""")
def _(spark, folder):
    found = stored_items(spark, folder).withColumns({
        "point_id": F.col("id"), "item_id": F.col("id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0),
        "requested_user_id": F.when(F.col("id") % 4 == 0, "nobody").otherwise(F.col("user_id")),
        "requested_kind": F.when(F.col("id") % 3 == 0, "goal"),
        "version": F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("version")),
        "score": F.lit(0.5)})
    return found.select("id", rules.memory_point_reason().alias("reject_reason"))


@query("a07_counts_per_user", f"""{_EVIDENCE},
  a AS (SELECT user_id, count(*) FILTER (status = 'active') AS active_items FROM after GROUP BY user_id),
  e AS (SELECT user_id, count(*) AS evidence_rows FROM evidence GROUP BY user_id)
  SELECT user_id, coalesce(active_items, 0) AS active_items, coalesce(evidence_rows, 0) AS evidence_rows
  FROM a FULL JOIN e USING (user_id)""")
def _(spark, folder):
    return memory.counts_per_user(*applied(spark, folder))


@query("r12_memory_texts", f"WITH {_CANDIDATES} SELECT id, kind || '/' || memory_key || ': ' || value AS text FROM items")
def _(spark, folder):
    text = render.memory_text(F.col("kind"), F.col("memory_key"), F.col("value"))
    return stored_items(spark, folder).select("id", text.alias("text"))
