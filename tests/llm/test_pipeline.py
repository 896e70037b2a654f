"""The pipeline by stages, on the smallest tables, and the registration of the queries."""

from __future__ import annotations

import re

import corpus_pipeline
import __spark_entry__ as entry
from basketry.llm import decontaminate, line_dedup
from basketry.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.frames import AWKWARD, documents, prose


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n).group(1)) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns, seen = docs.columns, [docs.count()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        frames.append(docs)
        seen.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
    _, clean, lines, single, safe, coded = frames
    assert seen[0] > seen[1] == seen[2] > seen[3] > seen[4] == seen[5]
    held = {r.doc_id: r for r in line_dedup.line_dedup(clean).collect()}
    assert all(r.n_chars == len(r.text) for r in lines.collect()) and set(held) == {r.doc_id for r in lines.collect()}
    assert decontaminate.contaminated(safe, table(spark, SF_SMALL, "benchmark")).count() == 0
    assert {r.doc_id for r in coded.collect()} == {r.doc_id for r in safe.collect()}


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_awkward_rows_go_through_all_stages(spark):
    """Null ids and texts, repeated ids and rows, very long texts, clashing columns."""
    rows = [*AWKWARD, (50, prose(1)), (50, prose(2)), (50, prose(2)), (51, prose(1)), (None, prose(1)), (None, None)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        if name in ("toxicity", "line_dedup"):
            assert docs.count() == len(rows) and docs.columns == before.columns
        if name == "simhash_near_dedup":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert {t for i, t in kept if i == 50} == {prose(1), prose(2)} and (51, prose(1)) not in kept
            assert sum(i is None for i, _ in kept) == 3
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(50) == 2 and ids.count(None) == 3 and docs.columns[0] == "doc_id"


def test_empty_table_goes_through_all_stages(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert docs.count() == 0
