import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from panelfolio.llm import jaccard, secretscan, toxicity
from panelfolio.llm.common import stage, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test-" + name)
        out.append(docs)
    return out


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for df in steps[1:-1]:
        assert df.schema.simpleString() == steps[0].schema.simpleString()


def test_each_stage_decides_on_what_its_predecessor_kept(spark, steps):
    docs, clean, unique, redacted, mixed, packed = steps
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) != 1
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"), learn))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scores.where("score < 0.7").collect()}
    classes = jaccard.near_duplicates(clean)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({r["class_id"] for r in classes.collect()})
    assert secretscan.scan(redacted, [0] * secretscan.SIZE**2, 10**6).where(F.size("base_spans") > 0).count() == 0
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (unique, redacted))
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["text"] == before[i]["text"] or "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    drawn = Counter(r["doc_id"] for r in mixed.collect())
    assert set(drawn) <= set(after)
    whole = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert whole == drawn


def test_run_equals_the_stages(spark, steps):
    rows = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(steps[-1])
