import hashlib

import duckdb
import pytest

from topicspark.llm import sharding as s

from .conftest import HARD


def rows_of(df):
    return sorted(((r["doc_id"], r["slot"], r["n_bytes"], r["first_shard"], r["shard"], r["version"]) for r in df.collect()), key=str)


def test_like_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql("SELECT doc_id, slot, n_bytes, first_shard, shard, version FROM (" + s.SQL + ")").fetchall(), key=str)
    assert rows_of(s.query(spark, data)) == want


def test_hard_rows(docs):
    got = s.assign_shards(docs(HARD, ["1 AS slot", "2 AS shard", "3 AS version"])).collect()
    assert len(got) == len(HARD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_bytes"] == 0 and by[5]["n_bytes"] == 120_000
    assert by[1]["slot"] == int(hashlib.md5(b"1").hexdigest()[:8], 16) % s.N_SLOTS
    assert by[None]["slot"] == int(hashlib.md5(b"").hexdigest()[:8], 16) % s.N_SLOTS
    assert s.assign_shards(docs([])).count() == 0


@pytest.mark.parametrize("n_shards", [4, 7])
def test_rebalance_evens_out_and_moves_little(spark, n_shards):
    sizes = [(i, 1, 1000 if i < 20 else 10 + i % 3) for i in range(200)]
    slots = spark.createDataFrame(sizes, "slot int, n_rows bigint, n_bytes bigint")
    mapped = s.first_map(slots, 200, n_shards)
    new = s.rebalance(mapped, n_shards).collect()
    load = {k: 0 for k in range(n_shards)}
    for r in new:
        load[r["shard"]] += r["n_bytes"]
    mean = sum(load.values()) / n_shards
    assert max(load.values()) <= mean * 1.02 + 1000
    assert all((r["version"] == 2) == (r["shard"] != r["old_shard"]) for r in new)
    again = s.rebalance(spark.createDataFrame([(r["slot"], r["n_rows"], r["n_bytes"], r["shard"], r["version"]) for r in new], "slot int, n_rows bigint, n_bytes bigint, shard int, version int"), n_shards).collect()
    assert sum(r["version"] > 2 for r in again) <= sum(r["version"] == 2 for r in new)


def test_second_run_goes_on_from_the_stored_map(spark, docs, tmp_path):
    maps, sizes = f"{tmp_path}/maps", {"n_slots": 64, "n_shards": 4, "tolerance": 5}
    old = [(i, "x" * (20 + i % 7 * 30)) for i in range(600)]
    grown = old + [(i, "y" * (400 if i % 5 == 0 else 20)) for i in range(600, 800)]
    first = {r["doc_id"]: r for r in s.assign_shards(docs(old), maps=maps, **sizes).collect()}
    assert first == {r["doc_id"]: r for r in s.assign_shards(docs(old), **sizes).collect()}
    assert s.latest_number(spark, maps) == 1
    kept = {r["slot"]: (r["shard"], r["version"]) for r in s.read_map(spark, maps, 1).collect()}
    assert len(kept) == 64 and all(kept[r["slot"]] == (r["shard"], r["version"]) for r in first.values())
    # another run over the grown table
    second = {r["doc_id"]: r for r in s.assign_shards(docs(grown), maps=maps, **sizes).collect()}
    assert s.latest_number(spark, maps) == 2 and len(second) == 800
    want = s.rebalance(
        s.slot_bytes(spark.createDataFrame([(r["slot"], r["n_bytes"]) for r in second.values()], "slot int, n_bytes bigint"), 64).join(s.read_map(spark, maps, 1), "slot"), 4, 5
    )
    want = {r["slot"]: (r["old_shard"], r["shard"], r["version"]) for r in want.collect()}
    assert all((r["first_shard"], r["shard"], r["version"]) == want[r["slot"]] for r in second.values())
    assert all(r["first_shard"] == kept[r["slot"]][0] for r in second.values())
    load = {k: sum(r["n_bytes"] for r in second.values() if r["shard"] == k) for k in range(4)}
    slots = {}
    for r in second.values():
        slots[r["slot"]] = slots.get(r["slot"], 0) + r["n_bytes"]
    assert max(load.values()) <= sum(load.values()) / 4 * 1.05 + max(slots.values())
    with pytest.raises(ValueError):
        s.assign_shards(docs(old), maps=maps, n_slots=64, n_shards=2)
    with pytest.raises(Exception, match="exist"):
        s.write_map(s.read_map(spark, maps, 1), maps, 2)
    assert not [p for p in (tmp_path / "maps").iterdir() if p.name.startswith("_writing")]
