import struct
import zlib

import corpus_pipeline as pipeline
import public_tokenizers
from tokenizers import Tokenizer

from groundwell.llm import mixing, quality
from tests.llm.test_jaccard import brute
from tests.llm.test_scans import brute as contamination

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, against_sql):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    kept = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        rows = after.collect()
        kept[name] = (docs, rows)
        if name != names[-1]:
            assert after.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)

    before, rows = kept[names[0]]
    decided = quality.classify(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("keep")
    assert sorted(r.doc_id for r in rows) == sorted(r.row.doc_id for r in decided.collect())

    before, rows = kept[names[1]]
    found, parts = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert len(rows) == parts and {r.doc_id for r in rows} == {c for _, _, c in found}

    before, rows = kept[names[2]]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before.collect() if not contamination(r.text, items)[3])

    before, rows = kept[names[3]]
    copies = {r.row.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(d for d, n in copies.items() for _ in range(n))

    before, rows = kept[names[4]]
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(expected)

    assert sorted(map(tuple, pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, rows))


def test_stages_take_any_rows(spark, edges, nothing):
    for rows in (edges, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, rows, FOLDER)
            out.count()
            assert name == pipeline.STAGES[-1][0] or out.columns == rows.columns
