import pytest

import corpus_pipeline as cp
from tremolite.llm import decontamination as dc
from tremolite.llm.common import read

from .test_jaccard import brute
from .test_packing import check
from .test_pii import slow


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = read(spark, sf, "documents"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs, result))
        docs = result
    return out


def test_every_stage_against_its_own_input(spark, sf, stages):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    before, after = (d.collect() for d in stages[0])
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    good = [d for d in labels if labels[d]]
    assert sum(d in gone for d in good) <= 0.03 * len(good) and sum(d in gone for d in labels if not labels[d]) >= 1
    before, after = (d.collect() for d in stages[1])
    assert {r["doc_id"] for r in after} == {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in before]).values()}
    before, after = (d.collect() for d in stages[2])
    items = [dc.plain(r["text"]) for r in read(spark, sf, "benchmark").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not any(i in dc.plain(r["text"]) for i in items)}
    before, after = (d.collect() for d in stages[3])
    texts = {r["doc_id"]: r for r in after}
    for r in before:
        t = texts[r["doc_id"]]["text"]
        assert not slow(t) and (t == r["text"] or slow(r["text"])) and texts[r["doc_id"]]["n_chars"] == len(t)
    before, after = (d.collect() for d in stages[4])
    used, bound = check(after, [(r["doc_id"], r["text"]) for r in before], 2048)
    assert used <= 1.05 * bound
    columns = read(spark, sf, "documents").columns
    assert all(b.columns == columns for _, b in stages[:4])


def test_run_gives_the_last_stages_rows(spark, sf, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(cp.run(spark, sf)) == key(stages[-1][1])
