"""The pipeline stage by stage against plain versions on the smallest tables."""

import corpus_pipeline
from hedgemark.llm import languages
from hedgemark.sources.tables import stage
from tests.llm.test_native import plain_judge
from tests.llm.test_neardup import plain_least
from tests.llm.test_secrets import plain_base


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, {"start": docs}
    for name, function in corpus_pipeline.STAGES:
        tables[name] = docs = stage(function(spark, docs, sf), f"test-{name}")
    rows = {name: df.collect() for name, df in tables.items()}
    assert all(tables[name].columns == columns for name in list(tables)[:-1])

    filters = languages.fit(tables["start"].select("doc_id", "text", "lang"))
    names, scores = filters.predict([r.text or "" for r in rows["start"]])
    kept = {r.doc_id for r, n, s in zip(rows["start"], names, scores) if n != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert {r.doc_id for r in rows["language_id"]} == kept

    assert sorted(r.doc_id for r in rows["near_dedup"]) == plain_least([(r.doc_id, r.text) for r in rows["language_id"]])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {x[0] for x in plain_judge([(r.doc_id, r.text) for r in rows["near_dedup"]], items) if not x[5]}
    assert {r.doc_id for r in rows["decontamination"]} == clean

    before = {r.doc_id: r.text for r in rows["decontamination"]}
    assert {r.doc_id for r in rows["secret_scan"]} == set(before)
    for r in rows["secret_scan"]:
        assert not plain_base(r.text)
        assert r.text == before[r.doc_id] or r.n_chars == len(r.text)

    packed = {}
    for r in rows["packing"]:
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(packed) == set(before)
    for pieces in packed.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
