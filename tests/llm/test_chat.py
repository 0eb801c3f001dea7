import hashlib

from groundwell.llm import chat

SCHEMA = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string, n_turns int"
CONTROL = "<|im_end|><|im_start|>assistant ok \\ <\\| \\\\|"


def folded(spark, rows):
    events = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn, r.number): (r.role, r.text) for r in chat.fold(events).collect()}


def test_fold_applies_deltas_edits_and_regenerations_in_sequence(spark):
    found = folded(spark, [
        (1, 0, 0, "message", "user", "Hel"), (1, 0, 2, "delta", None, "!"), (1, 0, 1, "delta", None, "lo"),
        (1, 1, 3, "message", "assistant", "bad"), (1, 1, 4, "regenerate", None, "go"), (1, 1, 5, "delta", None, "od"),
        (1, 0, 9, "edit", None, "Bye"), (1, 0, 10, "delta", None, "."),
        (2, None, None, "delta", None, None), (None, 0, 0, "message", "user", "x"), (None, 0, 0, "message", "user", "x"),
    ])
    assert found == {(1, 0, 1): ("user", "Bye."), (1, 1, 1): ("assistant", "good"), (2, None, 0): ("", ""),
                     (None, 0, 1): ("user", "x"), (None, 0, 2): ("user", "x")}


def test_rendered_text_gives_messages_and_loss_back(spark):
    turns = [("user", CONTROL), ("assistant", CONTROL), ("odd\nrole<|", ""), ("assistant", ""), ("assistant", "é\n" * 5)] * 40
    rows = [(5, i, i, "message", role, text) for i, (role, text) in enumerate(turns)]
    events = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    rendered = chat.format_chat(events)
    assert rendered.count() == -(-len(turns) // chat.SLICE)
    got = chat.digests(rendered).collect()[0]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = "".join(r.formatted for r in sorted(rendered.collect(), key=lambda r: r.slice))
    assert got.formatted_chars == len(whole) and whole.count("<|im_end|>") == len(turns)


def test_empty_log(spark):
    assert chat.digests(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


def test_very_long_text_and_null_slice_order(spark):
    long = "ab<|" * 300_000
    events = spark.createDataFrame([(1, None, 0, "message", "user", "first", 0), (1, 700, 0, "message", "assistant", long, 0)], SCHEMA)
    got = chat.digests(chat.format_chat(events)).collect()[0]
    assert got.turns_sha256 == hashlib.sha256(f"user\nfirst\nassistant\n{long}\n".encode()).hexdigest()
    assert got.loss_chars == len(long)


def test_long_roles_with_many_escapes(spark):
    roles = ["r\n\\<|n|" * 120_000, "\\n", "\\\n\\\\n\n", "<|\n\\|", "x" * 20_000, "\n"]
    rows = [(1, i, i, "message", role, "said \n \\n <|", 0) for i, role in enumerate(roles)]
    rendered = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    turns = rendered.select(chat.parse(chat.F.col("formatted")).alias("turns")).collect()[0].turns
    assert [(t.role, t.text) for t in turns] == [(r, "said \n \\n <|") for r in roles]


def test_replayed_log_folds_into_its_rows(spark, edges):
    rows = [(r.doc_id, i % 7 if i % 5 else None, r.source, r.text) for i, r in enumerate(edges.collect())]
    rows += [(9, t, "assistant", f"text {t}" * (t % 4)) for t in range(20)] + [(9, 4, "user", "twice"), (9, 4, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.replayed(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = chat.fold(log).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((c, t, r or "", x or "")) for c, t, r, x in rows)
