"""The pipeline against its stages by brute force."""

import corpus_pipeline
from faultline.llm import pii, quality
from faultline.llm.common import table
from tests.llm.helpers import EDGE, edge
from tests.llm.test_dedup import slow_groups
from tests.llm.test_text_operators import check_packing, slow_lines

SF = "/root/testdata/sf0.01"


def test_stages_are_the_operators(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    docs, stage = table(spark, SF, "documents"), dict(corpus_pipeline.STAGES)
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = stage["quality"](spark, docs, SF)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and kept == {i for i, t in texts.items() if model.score(__import__("numpy").array([quality.statistics(t)]))[0] >= 0.3}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels[i] == 1 for i in kept if i in labels) >= 0.98 * sum(q == 1 for q in labels.values())
    fewer = stage["line_dedup"](spark, good, SF)
    after = {r.doc_id: r.text for r in fewer.collect()}
    assert fewer.columns == columns and after.keys() == kept
    import hashlib

    slow = {i: sha for i, _, _, sha in slow_lines([(i, texts[i]) for i in kept], 10)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == slow
    alone = stage["near_dedup"](spark, fewer, SF)
    rows = {r.doc_id: r.text for r in alone.collect()}
    expected = {r[0] for r in slow_groups(list(after.items())) if r[5]}
    assert alone.columns == columns and expected <= rows.keys() and len(rows) <= len(expected) * 1.01
    clean = stage["pii"](spark, alone, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and texts == {i: pii.redact(t) for i, t in rows.items()} and any("[EMAIL]" in t for t in texts.values())
    made, total = check_packing(stage["packing"](spark, clean, SF).collect(), list(texts.items()))
    assert made <= 1.02 * total / 1024 + 1
    ran = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in ran.collect()} == texts.keys()


def test_edge_rows_pass_every_stage(spark):
    for rows in (EDGE, []):
        docs = edge(spark, rows)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= len(rows)
                docs = out
        assert out.count() >= docs.count()


def test_written_tables_are_deleted(spark):
    import os

    from faultline.llm.common import shared_dir, unlink
    from faultline.llm.queries import QUERIES

    at, small = shared_dir(spark).removeprefix("file://"), "/root/testdata/sf0.001"
    held = lambda: {x for x in os.listdir(at) if x.startswith("faultline-")}
    before = held()
    for f in (QUERIES["op5_embedding_dedup"], QUERIES["op6_minhash_dedup"], corpus_pipeline.run):
        found = f(spark, small)
        assert found.count() and len(held() - before) == 1
        unlink(found)
        assert held() == before
    assert all(not held() - before for n in ("op2_langid", "op4_line_dedup", "op9_suffix_dedup") if QUERIES[n](spark, small).count())
