"""The pipeline's stages, each against its plain version on its own input."""

import numpy as np

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from weftline.llm import line_runs
from weftline.llm.common import spool


def test_stages(spark, docs):
    base, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        now = spool(stage(spark, now, DATA), name)
        rows = now.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert now.columns == base
        after = {r.doc_id: r.text for r in rows}
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_rules":
            assert all(before[k] == v for k, v in after.items())
            assert all(brute.base_counts(v)[0] >= 50 for v in after.values())
        elif name == "line_dedup":
            expected = {k: v[0] for k, v in brute.line_dedup(before, line_runs.MIN_LINES, line_runs.LONG_LINE).items()}
            assert after == {k: v for k, v in expected.items() if v == before[k] or v.strip()}
        elif name == "near_dedup":
            assert set(after) == {k for k, (_, c) in brute.components(before, 5, 80).items() if k == c}
        elif name == "suffix_dedup":
            masks = brute.repeated_bytes(list(before.values()), 200)
            left = {k: np.frombuffer(v.encode(), np.uint8)[~m].tobytes().decode("utf-8", "ignore") for (k, v), m in zip(before.items(), masks, strict=True)}
            assert after == {k: v for k, v in left.items() if v == before[k] or v.strip(" ")}


def test_no_documents(spark, empty):
    now = empty
    for name, stage in corpus_pipeline.STAGES:
        now = spool(stage(spark, now, DATA), name)
    assert now.count() == 0
