"""The pipeline's stages against brute force, each on what the stage before kept."""

from __future__ import annotations

import collections
import pathlib

import corpus_pipeline

from cutloom.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]
    columns, source = docs.columns, [tuple(r) for r in docs.collect()]

    kept = corpus_pipeline.identify_languages(spark, docs, sf).cache()
    assert kept.columns == columns
    got = [tuple(r) for r in kept.collect()]
    assert not collections.Counter(got) - collections.Counter(source)
    assert len(got) == sum(any(c.isalpha() for c in r[1] or "") for r in source)

    cut = corpus_pipeline.dedup_lines(spark, kept, sf).cache()
    assert cut.columns == columns and cut.count() == kept.count()
    from tests.llm.test_llm import brute_lines

    want = brute_lines([(r[0], r[1] or "") for r in got], 10)
    assert collections.Counter((r.doc_id, r.text or "") for r in cut.collect()) == collections.Counter({(i, t): n for (i, _, _, t), n in want.items()})
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = corpus_pipeline.drop_near_duplicates(spark, cut, sf).cache()
    from tests.llm.test_llm import brute_links

    classes = brute_links([(r.doc_id, r.text or "") for r in cut.collect()])
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in classes})

    mixed = corpus_pipeline.mix_sources(spark, single, sf).cache()
    assert mixed.columns == columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {r.doc_id for r in single.collect()} and max(copies.values()) <= 3

    packed = corpus_pipeline.pack_sequences(spark, mixed, sf).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def brute_pipeline_ids(rows):
    """Ids, with repeats, that the stages before mixing keep of labelled rows; brute force throughout."""
    from tests.llm.test_llm import brute_lines, brute_links

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    cut = brute_lines([(r[0], r[1] or "") for r in kept], 10)
    texts = [(i, t) for (i, _, _, t), n in cut.items() for _ in range(n)]
    return {c for _, c, _ in brute_links(texts)}


def test_odd_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows, clashing columns, no labels and no rows go through all stages."""
    from tests.llm.test_llm import DOCS, ODD, clashing

    odd = spark.createDataFrame(ODD, DOCS)
    unlabelled = spark.createDataFrame([(r[0], r[1], None, *r[3:]) for r in ODD], DOCS)
    plain = spark.createDataFrame([(1, "ein kurzer Text ohne Sprache", None, None, 1), (2, "another plain text of some words", None, None, 1), (3, "123 456", None, None, 1)], DOCS)
    for docs, want in ((odd, brute_pipeline_ids(ODD)), (unlabelled, brute_pipeline_ids(ODD)), (clashing(odd), brute_pipeline_ids(ODD)), (plain, {1, 2}), (odd.where("false"), set())):
        single = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            single = stage(spark, single, sf)
            assert single.columns == docs.columns
        assert {r.doc_id for r in single.select("doc_id").collect()} == want
        packed = corpus_pipeline.run_on(spark, docs, sf).collect()
        assert {r.doc_id for r in packed} <= want and (bool(packed) == bool(want))


def test_scratch_removes_what_was_made(spark, sf):
    from cutloom.llm import common, media

    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    with common.scratch(spark):
        docs = table(spark, sf, "documents")
        assert media.media_columns(docs).count() == docs.count()
        made = common._MADE[-1][0][0]
        spark.read.parquet(f"{made}/recipes").count()
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before
    assert not pathlib.Path(made).exists()
