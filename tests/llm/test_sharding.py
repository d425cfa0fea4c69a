import zlib

from tremolite.llm import sharding as sh
from tremolite.llm.common import read


def check(df, shards):
    rows = df.collect()
    load = [0] * shards
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    for r in rows:
        load[r["shard"]] += r["size"]
    return rows, load


def test_shards_are_even_and_records_right(spark, sf):
    docs = read(spark, sf, "documents")
    rows, load = check(sh.shard_documents(docs), 8)
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert max(load) - min(load) <= 0.02 * sum(load) / 8


def test_edit_moves_little_and_keeps_slots():
    first = sh.even_map(8, 64)
    weight = {s: 10 + s % 7 for s in range(64)}
    second = sh.edit_map(first, weight, 8)
    grown = sh.edit_map(second, weight, 9)
    assert sum(a != b for a, b in zip(second, grown, strict=True)) <= 16 and set(grown) == set(range(9))
    assert sh.edit_map(grown, weight, 9) == grown


def test_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    sh.store_map(spark, [0, 1, 0], 1, path)
    sh.store_map(spark, [1, 1, 0], 2, path)
    assert sorted(map(tuple, sh.load_map(spark, path, 1).collect())) == [(0, 0), (1, 1), (2, 0)]
    assert sorted(map(tuple, sh.load_map(spark, path, 2).collect())) == [(0, 1), (1, 1), (2, 0)]


def test_odd_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "x"), (None, None, "x"), (2, "", None)]
    got, load = check(sh.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 3), 3)
    assert len(got) == 5 and sum(load) == 2 + 2 + 2 + 1 + 1
    assert sh.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_a_second_run_edits_the_stored_map(spark):
    """The stored map is loaded: no row comes twice, slots keep their shard where balance allows, and a further shard only takes."""
    from tremolite.llm.sharding import newest_map, shard_documents
    from tremolite.session import scratch_path

    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(400)], "doc_id long, text string")
    path = scratch_path(spark, "slot-map")
    first = {r["doc_id"]: r["shard"] for r in shard_documents(docs, 3, 64, path).collect()}
    version, owners = newest_map(spark, path)
    again = shard_documents(docs, 3, 64, path).collect()
    assert len(again) == 400 and {r["doc_id"]: r["shard"] for r in again} == first and newest_map(spark, path) == (version, owners)
    more = {r["doc_id"]: r["shard"] for r in shard_documents(docs, 4, 64, path).collect()}
    assert len(more) == 400 and newest_map(spark, path)[0] == version + 1
    assert sum(more[i] == 3 for i in more) > 0 and sum(more[i] == first[i] for i in more) >= 250
    fewer = {r["doc_id"]: r["shard"] for r in shard_documents(docs, 2, 64, path).collect()}
    assert set(fewer.values()) == {0, 1}
