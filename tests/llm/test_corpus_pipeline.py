"""The pipeline: planted cases are caught, clean documents stay, every stage by brute force."""

import corpus_pipeline
from curvine.llm import repetition
from tests.llm.conftest import CLASHING, sentence
from tests.llm.test_corpus_operators import brute_leaks
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_text_operators import plain_spans


def test_stages(spark, tmp_path, odd_rows):
    leak = sentence(900, 40)
    clean = [(100 + i, sentence(1000 + i, 90)) for i in range(20)]
    rows = clean + odd_rows + [(200, clean[0][1]), (201, f"{sentence(901, 80)} {leak}"), (202, sentence(902, 70) + " token = 'abcdef123456'"), (203, "la " * 80), (None, clean[3][1])]
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    left, frame = rows, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)
        if name == "quality rules":
            left = [r for r, ok in zip(left, repetition.measure([t or "" for _, t in left])["kept"]) if ok]
            assert got == sorted(left, key=repr)
        elif name == "near-dedup":
            groups = brute_groups([t or "" for _, t in left])
            assert len(got) == len(set(groups)) and set(got) <= set(left)
            for g in set(groups):
                members = [row for row, h in zip(left, groups) if h == g]
                ids = [d for d, _ in members if d is not None]
                stays = [row for row in set(members) if row in got]
                assert len(stays) == 1 and (not ids or stays[0][0] == min(ids))
            left = got
        elif name == "decontamination":
            left = [r for r in left if not brute_leaks([r], [(1, leak)])]
            assert got == sorted(left, key=repr) and 201 not in {d for d, _ in got}
        else:
            assert {d for d, _ in got} == {d for d, _ in left}
            for d, t in got:
                assert not plain_spans(t) or "[secret]" in t
                if not plain_spans(dict(left)[d] or ""):
                    assert t == dict(left)[d]
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids == {d for d, _ in left} and {i for i, _ in clean} <= ids


def test_an_empty_table_passes_through(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_leave_clashing_names_alone(spark, tmp_path, odd):
    folder = f"file://{tmp_path}"
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, sentence(900, 40))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        assert docs.columns == odd.columns and rows and {(r.doc_id, r.text) for r in rows} <= before
        assert all(r[c] == "x" for r in rows for c in CLASHING)
    assert corpus_pipeline.pack(spark, docs, folder).count() >= len(rows)
