import hashlib

import pytest

from siltstone.llm import sharding
from tests.llm.cases import ODD, clashing, empty, frame, rows_of, sample

SCHEMA = "doc_id long, text string"


def digest_rows(rows):
    out = [(i, None if t is None else len(t.encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_all_rows_come_back(spark, tmp_path):
    docs = sample(spark).select("doc_id", "text")
    got = sharding.shard_documents(docs, f"file://{tmp_path}/s", arrivals=6)
    assert rows_of(got, "doc_id", "n_bytes", "text_sha256") == digest_rows([tuple(r) for r in docs.collect()])
    assert got.select("manifest_version").distinct().collect()[0][0] == 7  # six arrivals, one merge
    assert got.select("shard").distinct().count() == 1  # small runs became one file


def test_odd_rows(spark, tmp_path):
    got = sharding.shard_documents(clashing(spark), f"file://{tmp_path}/s")
    assert rows_of(got, "doc_id", "n_bytes", "text_sha256") == digest_rows(ODD)
    assert sharding.shard_documents(empty(spark), f"file://{tmp_path}/none").count() == 0


def test_tiers(spark, tmp_path):
    assert [sharding.tier(n, 1 << 20) for n in (1 << 20, 1 << 19, (1 << 19) - 1, 1 << 18, (1 << 18) - 1, 1)] == [0, 0, 1, 1, 2, 10]
    root = f"file://{tmp_path}/s"
    for k in range(3):
        sharding.append(frame(spark, [(k, "x")], 1), root)
    version, live = sharding.latest(spark, root)
    assert (version, len(live)) == (3, 3)
    assert sharding.compact(spark, root, SCHEMA) == 3  # too few runs of one size
    sharding.append(frame(spark, [(3, "x")], 1), root)
    old = sharding.read_shards(spark, root, SCHEMA)
    assert sharding.compact(spark, root, SCHEMA) == 5
    assert len(sharding.latest(spark, root)[1]) == 1
    assert old.count() == 4  # a reader of the old version still has its files
    assert sharding.expire(spark, root) == 0  # too young: they might be another writer's
    assert sharding.expire(spark, root, age_s=0) == 4
    assert rows_of(sharding.read_shards(spark, root, SCHEMA), "doc_id") == [(0,), (1,), (2,), (3,)]


def test_files_come_to_target_size(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    docs = sample(spark, "0.01").select("doc_id", "text")
    for k in range(8):
        sharding.append(docs.where(f"doc_id % 8 = {k}").coalesce(1), root)
    sizes = [s["bytes"] for s in sharding.latest(spark, root)[1]]
    target = sum(sizes) // 2
    sharding.compact(spark, root, SCHEMA, target=target)
    merged = [s["bytes"] for s in sharding.latest(spark, root)[1]]
    assert len(merged) < len(sizes) and max(merged) < 2 * target


def test_commits_are_atomic(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    sharding.append(frame(spark, [(1, "x")], 1), root)
    base, live = sharding.latest(spark, root)
    assert sharding.commit(spark, root, base, live) == 2
    with pytest.raises(sharding.Conflict):
        sharding.commit(spark, root, base, [])
    assert sharding.latest(spark, root) == (2, live)


def test_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/s"
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(sharding.append, frame(spark, [(k, "x")], 1), root) for k in range(8)]
        done.append(pool.submit(sharding.compact, spark, root, SCHEMA))
        for d in done:
            d.result()
    assert rows_of(sharding.read_shards(spark, root, SCHEMA), "doc_id") == [(k,) for k in range(8)]
    assert sharding.latest(spark, root)[0] >= 8


def test_a_merge_of_replaced_shards_is_given_up(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for k in range(4):
        sharding.append(frame(spark, [(k, "x")], 1), root)
    before = sharding.latest(spark, root)[1]
    sharding.compact(spark, root, SCHEMA)
    gone = {s["path"] for s in before}
    assert sharding.update(spark, root, lambda now: None if not gone <= {s["path"] for s in now} else []) == 5


def test_expiry_during_an_append(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    sharding.append(frame(spark, [(1, "x")], 1), root)
    frame(spark, [(2, "x")], 1).write.parquet(f"{root}/shards/pending")  # written, not yet committed
    assert sharding.expire(spark, root) == 0
    sharding.update(spark, root, lambda live: live + sharding._files(spark, f"{root}/shards/pending", 0))
    assert rows_of(sharding.read_shards(spark, root, SCHEMA), "doc_id") == [(1,), (2,)]
