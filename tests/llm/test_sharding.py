import zlib
from collections import Counter

from util import DOC_SCHEMA, clashing, corpus, frame

from claimweave.llm import sharding


def check(rows, got, n=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None and 0 <= r.shard < n for r in got)


def test_contract_and_mixture(spark):
    rows = corpus(n=300)
    source = {r[0]: r[3] for r in rows}
    for size in (20_000, 17):  # one slice, many slices
        got = sharding.interleaved_shards(clashing(frame(spark, rows)), rows_per_bucket=size).collect()
        check(rows, got)
        total = Counter(r[3] for r in rows)
        for shard in range(8):
            mine = Counter(source[r.doc_id] for r in got if r.shard == shard)
            assert all(abs(mine[s] - total[s] / 8) <= 3 for s in total)


def test_order_does_not_depend_on_partitions_or_slices(spark):
    rows = [r for r in corpus() if r[0] is not None]
    a = sharding.interleaved_shards(frame(spark, rows, 2)).collect()
    b = sharding.interleaved_shards(frame(spark, rows[::-1], 5), rows_per_bucket=11).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_few_rows_and_none(spark):
    for n in (1, 3, 9):
        rows = corpus(n=20)[:n]
        check(rows, sharding.interleaved_shards(frame(spark, rows)).collect())
    assert sharding.interleaved_shards(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
