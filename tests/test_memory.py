"""Memory resolution against a plain loop, golden chains, and hot identities split over many buckets."""

import random
import uuid

from pyspark.sql import functions as F

from groundwell.operators import memory
from groundwell.operators.stages import stage_folder
from groundwell.streaming import streams

ITEMS = "id long, user_id string, kind string, memory_key string, value string, status string, version long"
CANDIDATES = ("user_id string, session_id string, position long, operation string, kind string, key string, value string, "
              "confidence double, source_message_ids array<long>")


def candidate(position, operation, key, value, source, user="u", kind="goal"):
    return (user, "s", position, operation, kind, key, value, 1.0, [source])


def resolve(spark, candidates, items=(), rows=1000):
    rows = memory.resolve_batch(spark.createDataFrame(list(candidates), CANDIDATES),
                                spark.createDataFrame(list(items), ITEMS), rows)
    return rows.orderBy("source_id", "position").collect()


def loop(candidates, items):
    """The chain one event after the other."""
    state = {(i[1], i[2], i[3]): (i[4], i[5], i[6]) for i in items}
    out = []
    for c in sorted(candidates, key=lambda c: (min(c[8]), c[2])):
        key = (c[0], c[4], c[5])
        now = state.get(key)
        same = now is not None and " ".join(now[0].split()).lower() == " ".join(c[6].split()).lower()
        if now is None:
            action = "noop" if c[3] == "forget" else "insert"
            new = None if c[3] == "forget" else (c[6], "active", 1)
        elif c[3] == "forget":
            action = "noop" if now[1] == "forgotten" else "forget"
            new = now if action == "noop" else (now[0], "forgotten", now[2] + 1)
        elif now[1] == "active" and same:
            action, new = "noop", now
        else:
            action, new = "update", (c[6], "active", now[2] + 1)
        if new is not None:
            state[key] = new
        out.append((c[2], action, new))
    return out


def test_chain_of_one_batch(spark):
    got = resolve(spark, [candidate(0, "upsert", "lang", "Go", 20), candidate(1, "upsert", "name", "Huang", 10),
                          candidate(2, "upsert", "lang", "Rust", 30)])
    assert [(r.memory_key, r.action, r.version) for r in got] == [
        ("name", "insert", 1), ("lang", "insert", 1), ("lang", "update", 2)]


def test_forget_keeps_the_value_and_restores_count_on(spark):
    got = resolve(spark, [candidate(0, "upsert", "tool", "Vim", 1), candidate(1, "forget", "tool", "", 2),
                          candidate(2, "forget", "tool", "", 3), candidate(3, "upsert", "tool", "vim", 4)])
    assert [(r.action, r.version, r.next_value) for r in got] == [
        ("insert", 1, "Vim"), ("forget", 2, "Vim"), ("noop", 2, "Vim"), ("update", 3, "vim")]
    missing = resolve(spark, [candidate(0, "forget", "none", "", 1)])[0]
    assert (missing.reason, missing.item_exists) == ("missing_item_already_forgotten", False)


def test_random_chains_match_the_loop_across_bucket_borders(spark):
    random.seed(11)
    items = [(i + 1, f"u{i % 4}", "goal", f"k{i // 4}", "A a", random.choice(["active", "forgotten"]),
              random.randint(1, 5)) for i in range(12)]
    # One identity holds about a third of all events.
    events = [candidate(p, random.choice(["upsert", "upsert", "forget"]), "k0" if random.random() < 0.4 else
                        f"k{random.randint(0, 4)}", random.choice(["a  a", "B", "c"]), random.randint(1, 400),
                        "u0" if random.random() < 0.6 else f"u{random.randint(0, 5)}") for p in range(600)]
    want = loop(events, items)
    for rows in (7, 100_000):
        got = {r.position: r for r in resolve(spark, events, items, rows)}
        for position, action, new in want:
            row = got[position]
            assert row.action == action
            if new is not None:
                assert (row.next_value, row.next_status, row.version) == new


def test_applied_items_and_evidence(spark):
    events = [candidate(0, "upsert", "lang", "Go", 1), candidate(1, "upsert", "lang", "go", 2),
              candidate(2, "upsert", "lang", "Rust", 3), candidate(3, "upsert", "lang", "Go", 4),
              candidate(4, "upsert", "tool", "Vim", 5), candidate(5, "forget", "tool", "", 6),
              candidate(6, "forget", "nothing", "", 6)]
    messages = spark.createDataFrame([(i, "s", "u", "User", f"text {i}") for i in range(1, 7)],
                                     "id long, session_id string, user_id string, role string, content string")
    empty = spark.createDataFrame([], "memory_item_id long, source_session_id string, source_message_id long, "
                                      "operation string")
    items, evidence = memory.apply_candidates(spark.createDataFrame(events, CANDIDATES),
                                              spark.createDataFrame([], ITEMS), messages, empty)
    assert {(r.memory_key, r.value, r.status, r.version) for r in items.collect()} == {
        ("lang", "Go", "active", 3), ("tool", "Vim", "forgotten", 2)}
    assert evidence.count() == 6
    again = memory.new_evidence(memory.resolve_batch(spark.createDataFrame(events, CANDIDATES),
                                                     spark.createDataFrame([], ITEMS)), items, messages, evidence)
    assert again.count() == 0


def test_decoding_refuses_what_a_strict_parser_refuses(spark):
    one = '{"operation":"upsert","kind":"goal","key":"k","value":"v","confidence":0.5,"source_message_ids":[1]}'
    cases = {
        '{"candidates":[%s]}' % one: None,
        '{"candidates":[]}': None,
        '{"candidates":[%s]} {}' % one: "not_one_json_object",
        '{"candidates":[%s],"x":1}' % one: "unknown_field",
        '{"candidates":[{"operation":"upsert"}]}': "candidate_field_required",
        '{}': "candidates_required",
        ' ': "reply_empty",
        '[1]': "not_one_json_object",
        '{"candidates":[%s]}' % one.replace("}", ',"mood":1}'): "unknown_candidate_field",
    }
    rows = memory.decode_candidates(spark.createDataFrame([(c,) for c in cases], "raw string")).collect()
    assert {r.raw: r.reject_reason for r in rows} == cases


def test_memory_stream_equals_the_loop_and_writes_changes_only(spark):
    draw = random.Random(11)
    stored = [(1, "u", "goal", "k0", "Old", "active", 4), (2, "u", "goal", "k1", "Gone", "forgotten", 2), (3, "w", "goal", "far", "Stays", "active", 1)]
    said = [candidate(i % 3, draw.choice(["upsert", "upsert", "forget"]), f"k{draw.randint(0, 4)}", draw.choice(["Go", "go ", "Rust"]), 100 + i)
            for i in range(60)]
    said = [(*c[:6], "" if c[3] == "forget" else c[6], *c[7:]) for c in said]
    path = f"{stage_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.use_rocksdb(spark)
    kept = streams.MemoryTables.of(spark, path, 16)
    kept.start(spark.createDataFrame(stored, ITEMS))
    everything = spark.createDataFrame(said, CANDIDATES).withColumn("at", F.col("source_message_ids")[0])
    arriving = streams.stream_in_order(everything, f"{path}/arriving", "at", 4)
    messages = spark.createDataFrame([(100 + i, "user", f"m{i}") for i in range(60)], "id long, role string, content string")
    streams.memory_stream(arriving.drop("at"), messages, kept, f"{path}/checkpoint").awaitTermination()

    state = {(i[1], i[2], i[3]): (i[4], i[5], i[6]) for i in stored}
    decided = loop(said, stored)
    for c, (_, _, new) in zip(sorted(said, key=lambda c: (min(c[8]), c[2])), decided):
        if new is not None:
            state[c[0], c[4], c[5]] = new
    rows = kept.items.read().collect()
    assert {(r.user_id, r.kind, r.memory_key): (r.value.strip(), r.status, r.version) for r in rows} == {
        k: (v.strip(), s, n) for k, (v, s, n) in state.items()}
    assert len({r.id for r in rows}) == len(rows) and {r.id for r in rows if r.memory_key in ("k0", "k1", "far")} == {1, 2, 3}
    exists = [c[8][0] for c, (_, _, new) in zip(sorted(said, key=lambda c: (min(c[8]), c[2])), decided) if new is not None]
    assert sorted(r.source_message_id for r in kept.evidence.read().collect()) == sorted(exists)

    # A file that came twice and a batch that is repeated leave every bucket where it was.
    before = kept.items.last()
    kept.apply(spark.createDataFrame([], streams.DECISION_SCHEMA), messages, 0)
    assert kept.items.last() == before


def test_late_and_repeated_candidates_do_nothing(spark):
    path = f"{stage_folder(spark)}/late-{uuid.uuid4().hex}"
    streams.use_rocksdb(spark)
    kept = streams.MemoryTables.of(spark, path, 4)
    kept.start(spark.createDataFrame([], ITEMS))
    said = [candidate(0, "upsert", "k", "A", 10), candidate(0, "upsert", "k", "B", 20), candidate(0, "upsert", "k", "A", 10), candidate(0, "upsert", "k", "late", 15)]
    for at, c in enumerate(said):
        spark.createDataFrame([c], CANDIDATES).coalesce(1).write.mode("append").parquet(f"{path}/arriving")
    arriving = spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(f"{path}/arriving")
    messages = spark.createDataFrame([(10, "user", "a"), (20, "user", "b")], "id long, role string, content string")
    streams.memory_stream(arriving, messages, kept, f"{path}/checkpoint").awaitTermination()
    assert [(r.value, r.version) for r in kept.items.read().collect()] == [("B", 2)]
    assert sorted(r.source_message_id for r in kept.evidence.read().collect()) == [10, 20]
