"""The pipeline, stage by stage, against plain computations on the small tables."""

import re
from collections import defaultdict

import corpus_pipeline
from tests.conftest import same_rows

from floodgauge.llm import near_dedup, registry, secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, sf_dir)
    assert first.columns == columns and first.count() >= 0.97 * docs.count()
    second = stages["exact_dedup"](spark, docs, sf_dir)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(min(g)[1] for g in groups.values())
    third = stages["near_dedup"](spark, second, sf_dir)
    sets = {r.doc_id: set(near_dedup.shingle_set(r.text, 5).tolist()) for r in second.collect()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in {(a, b) for own in where.values() for a in own for b in own if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(i for i in sets if find(i) == i)
    fourth = stages["secret_scan"](spark, third, sf_dir)
    assert fourth.columns == columns and fourth.count() == third.count()
    assert not any(secrets.base_spans(r.text or "") for r in fourth.collect())
    last = stages["packing"](spark, fourth, sf_dir)
    assert last.select("doc_id").distinct().count() == fourth.count()


def test_run_and_queries(spark, sf_dir, duck):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    for name, sql in registry.SQL.items():
        same_rows(registry.QUERIES[name](spark, sf_dir), duck.sql(sql))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, an empty table and clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, run long, key long, kept boolean, salt long, component long"
    long = "the words of a very long text " * 40_000
    texts = {1: "the cat sat on the mat and the dog ran to it", 2: "the cat sat on  the mat and the dog ran to it", 3: None, 4: "", 5: long, 6: "1 2 3", 7: "password=hunter22secret and the rest of the text"}
    rows = [(i, t, "en", "s", 0, "d", 1, 2, True, 3, 4) for i, t in texts.items()]
    rows += [rows[0], (None, texts[1], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    for name, stage in stages.items():
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    assert ids(stages["language_id"](spark, docs, sf_dir)) == sorted([1, 1, 2, 5, 7, None], key=repr)
    second = stages["exact_dedup"](spark, docs, sf_dir)
    assert second.columns == docs.columns and ids(second) == sorted([2, 3, 5, 6, 7, None, None], key=repr)  # 2 is longer than 1
    third = stages["near_dedup"](spark, docs, sf_dir)
    assert third.columns == docs.columns and ids(third) == sorted([1, 1, 3, 4, 5, 6, 7, None, None], key=repr)
    fourth = stages["secret_scan"](spark, docs, sf_dir)
    masked = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and fourth.count() == len(rows) and masked[3].text is None and masked[5].text == long and masked[5].n_chars == len(long)
    assert masked[7].text == "[REDACTED] and the rest of the text"
    assert secrets.redact_documents(docs.select("doc_id", "text")).count() == len(rows)
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.length == 1 for r in pieces) == 3 and {r.doc_id for r in pieces} == {*texts, None}
