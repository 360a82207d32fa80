import zlib
from collections import Counter, defaultdict

from tidewater.llm import sharding


def check(rows, out, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    places, load = defaultdict(list), Counter()
    for r in out:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    for p in places.values():
        assert sorted(p) == list(range(len(p)))
    assert set(load) <= set(range(shards))
    return load


def test_odd_rows(spark, make_documents, odd_rows):
    check(odd_rows, sharding.shard(spark, make_documents(odd_rows), 4).collect(), 4)


def test_near_equal(spark, make_documents):
    rows = [(k, "ab " * (k * k % 97), "s") for k in range(4000)]
    load = check(rows, sharding.shard(spark, make_documents(rows), 16).collect(), 16)
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 16


def test_hot_copies_are_numbered_in_chunks(spark, make_documents, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = [(1, "copy", "s")] * 50 + [(k, "text", "s") for k in range(2, 60)]
    check(rows, sharding.shard(spark, make_documents(rows), 4).collect(), 4)


def test_rebalancing_edits_the_map():
    zero = sharding.first_map(64, 4)
    sizes = [10] * 16 + [1] * 48
    one = sharding.rebalanced(sizes, zero, 4)
    load = Counter()
    for v, s in enumerate(one):
        load[s] += sizes[v]
    assert max(load.values()) - min(load.values()) <= 1
    assert sum(a != b for a, b in zip(zero, one, strict=True)) < 32  # most slots stay


def test_a_stored_map_is_edited(spark, make_documents, tmp_path):
    path = str(tmp_path / "map")
    rows = [(k, "ab " * (k * k % 97), "s") for k in range(3000)]
    first = sharding.shard(spark, make_documents(rows), 8, 256, path).collect()
    assert sharding.map_versions(spark, path) == [0, 1] and {r.map_version for r in first} == {1}
    again = sharding.shard(spark, make_documents(rows), 8, 256, path).collect()
    assert sharding.map_versions(spark, path) == [0, 1]  # nothing to move: no version
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in first}
    more = rows + [(k, "long " * 300, "s") for k in range(3000, 3040)]
    third = sharding.shard(spark, make_documents(more), 8, 256, path).collect()
    assert sharding.map_versions(spark, path) == [0, 1, 2]
    maps = [{r.vslot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2)]
    edited = {v for v in maps[0] if maps[0][v] != maps[1][v]}
    was = {r.doc_id: r.shard for r in first}
    moved = {r.vslot for r in third if r.doc_id in was and r.shard != was[r.doc_id]}
    assert moved <= edited and 0 < len(edited) < 128
    load = check(more, third, 8)
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8
    wider = sharding.shard(spark, make_documents(more), 10, 256, path).collect()
    assert {r.shard for r in wider} == set(range(10)) and sharding.map_versions(spark, path)[-1] == 3
    fewer = sharding.shard(spark, make_documents(more), 5, 256, path).collect()
    assert {r.shard for r in fewer} == set(range(5))
    check(more, fewer, 5)
    try:
        sharding.shard(spark, make_documents(rows), 8, 64, path)
    except ValueError as e:
        assert "256 slots" in str(e)
    else:
        raise AssertionError("a map of other slots was taken")


def test_native(spark, make_documents, odd_rows):
    plan = sharding.shard(spark, make_documents(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty(spark, make_documents):
    assert sharding.shard(spark, make_documents([])).count() == 0
