import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import test_neardup
import test_packing
import test_suffixes

import corpus_pipeline as cp
from duologue.llm.common import cut

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF))
        outs.append(docs)
    assert all(o.columns == cp.COLUMNS for o in outs[:-1])
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, single, clean = ({r.doc_id: r.text for r in o.collect()} for o in outs[:3])

    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    fine = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0 or r.toxic == 1]
    assert sum(d in good for d in fine) >= 0.97 * len(fine) and sum(d not in good for d in bad) >= 0.95 * len(bad)
    assert all(raw[d] == t for d, t in good.items())

    groups = test_neardup.brute(list(good.items()), 5, 80)
    assert set(single) == {d for d, (_, c) in groups.items() if c == d}

    want = test_suffixes.brute(list(single.items()), 100)
    assert set(clean) == {d for d, (n, gone, _, _) in want.items() if gone < n or not n}
    for d, t in clean.items():  # bytes of characters that were cut through are left out
        assert want[d][0] - want[d][1] - 3 * want[d][2] * 2 <= len(t.encode()) <= want[d][0] - want[d][1]

    rows = outs[3].collect()
    pad = test_packing.hold(rows, list(clean.items()), 2048)
    assert pad < 0.02 * sum(r.length for r in rows)


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 100
