import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm.common import table, written
from panelcast.llm.queries import QUERIES
from tests.llm.helpers import docs, prose
from tests.llm.test_jaccard import brute as jaccard_groups
from tests.llm.test_linededup import brute as dedup_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from panelcast.llm.common import written

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "test-stage")
        out.append((name, before, docs))
    return out


def test_the_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "source_mix", "packing"]


def test_all_but_the_last_return_the_columns_of_documents(stages, spark):
    columns = table(spark, SF, "documents").schema
    for _, _, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in columns]


def test_quality_stage_rejects_junk_and_keeps_clean(stages, spark):
    _, before, after = stages[0]
    labels = table(spark, SF, "labels").join(before.select("doc_id"), "doc_id")
    kept = labels.join(after.select("doc_id"), "doc_id")
    good, bad = labels.where("quality = 1").count(), labels.where("quality = 0").count()
    assert kept.where("quality = 1").count() >= 0.95 * good
    assert kept.where("quality = 0").count() <= 0.5 * bad
    assert after.exceptAll(before).count() == 0


def test_line_stage_equals_brute_force(stages):
    _, before, after = stages[1]
    want = dedup_brute([(r.doc_id, r.text) for r in before.collect()])
    for r in after.collect():
        assert r.text == want[True, r.doc_id] and r.n_chars == len(r.text)


def test_near_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = sorted({c for _, n, c in jaccard_groups(rows, 5, 80) if n} | {d for d, n, _ in jaccard_groups(rows, 5, 80) if not n})
    assert sorted(r.doc_id for r in after.collect()) == want


def test_mix_stage_comes_near_its_targets(stages):
    from panelcast.llm.mixing import plan_mix

    _, before, after = stages[3]
    plan = {r.id: r for r in plan_mix(before).collect()}
    reps = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert reps == {i: r.reps for i, r in plan.items() if r.reps}


def test_packing_stage_covers_every_copy(stages):
    _, before, after = stages[4]
    assert after.where("piece = 0").count() == before.count()
    rows = after.orderBy("sequence_id", "offset").collect()
    end = {}
    for r in rows:
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048 and len(end) <= -(-sum(end.values()) // 2048) + 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_have_the_columns_of_their_contract(spark, name):
    want = {
        "op1": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op2": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op3": {"doc_id": "bigint", "text": "string"},
        "op4": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op5": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op6": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op7": {"doc_id": "bigint", "perplexity": "double", "kept": "boolean"},
        "op8": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op9": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }[name.split("_")[0]]
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in want} == want
    assert df.count() > 0


def test_stages_on_edge_rows_and_on_no_rows(spark):
    long = prose(5, 25_000)
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, prose(1, 300)), (4, prose(1, 300)), (5, prose(1, 300)), (None, prose(2, 200)),
            (6, long), (7, prose(3, 3)), (8, "\n".join(["the same line of twenty characters and more"] * 4)), (9, prose(4, 120))]
    base = docs(spark, [(i, t, "en" if (i or 0) % 2 else None, None if i == 4 else "s") for i, t in rows])
    clash = {c: F.lit(c) for c in ("id", "key", "kept", "component", "n_shingles", "reps", "size", "part", "row", "line", "piece", "chunk")}
    current, empty = base.withColumns(clash), base.withColumns(clash).limit(0)
    texts = {t for _, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        current = written(stage(spark, current, SF), f"test-{name}")
        assert set(base.columns) <= set(current.columns)
        kept = current.select("doc_id", "text").collect()
        if name != "line_dedup":
            assert {r.text for r in kept} <= texts
        texts = {r.text for r in kept}
        assert any(r.doc_id == 6 for r in kept)  # clean and very long
    packed = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept}
    assert all(r.length <= 2048 for r in pieces) and sum(r.doc_id == 6 for r in pieces) > 10
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
