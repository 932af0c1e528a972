import zlib
from collections import defaultdict

from tarnfold.llm import sharding
from tarnfold.llm.sharding import SlotMap, assign, slot_bytes, virtual_slot


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, slot int")


ROWS = [(i, f"text {i} é") for i in range(300)] + [(5, "text 5 é"), (None, None), (301, ""), (302, None), (303, "x" * 100000)]


def test_assign_against_brute_force(spark):
    base = SlotMap.first(16, 512)
    got = assign(table(spark, ROWS), base, base.grown()).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for i, t in ROWS:
        texts[i].append(t)
    per = defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]][0] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert r["shard"] == base.owner[r["vslot"]] and r["grown_shard"] in (r["shard"], 16)
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    loads = defaultdict(int)
    for r in got:
        loads[r["vslot"]] += r["size"]
    assert all(r["slot_bytes"] == loads[r["vslot"]] for r in got)


def test_a_hot_key(spark, monkeypatch):
    """A third of all rows are one row, another third one id with many texts."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "same")] * 400 + [(2, f"text {k}") for k in range(400)] + [(k, "x") for k in range(10, 410)]
    got = assign(table(spark, rows), SlotMap.first(4, 64)).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert len(got) == 1200 and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 2}) == 1


def test_query_stores_its_map(spark, tmp_path):
    table(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op10_virtual_slots(spark, str(tmp_path)).collect()
    base = SlotMap.first(16)
    assert all((r["shard"], r["grown_shard"]) == (base.owner[r["vslot"]], base.grown().owner[r["vslot"]]) for r in got) and len(got) == len(ROWS)


def test_key_decides_alone(spark):
    base = SlotMap.first(16, 512)
    some = {r["doc_id"]: r["shard"] for r in assign(table(spark, ROWS[:40]), base).collect()}
    every = {r["doc_id"]: r["shard"] for r in assign(table(spark, ROWS), base).collect()}
    assert all(every[k] == v for k, v in some.items())


def test_empty(spark):
    assert assign(table(spark, []), SlotMap.first(16)).count() == 0


def test_growth_moves_only_into_the_new_shard():
    base = SlotMap.first(16)
    grown = base.grown()
    assert all(a == b or b == 16 for a, b in zip(base.owner, grown.owner))
    counts = [grown.owner.count(s) for s in range(17)]
    assert max(counts) - min(counts) <= 1 and grown.version == 2 and len(grown.moves) == counts[16]


def test_rebalance_and_versions(spark):
    base = SlotMap.first(4, 64)
    load = {s: 1000 if s % 4 == 0 else 10 + s for s in range(64)}
    even = base.rebalanced(load)
    loads = [sum(load[s] for s in range(64) if even.owner[s] == k) for k in range(4)]
    assert max(loads) <= 1.1 * sum(loads) / 4
    stored = base.frame(spark).unionByName(even.frame(spark))
    assert SlotMap.read(stored).owner == even.owner and SlotMap.read(stored, 1).owner == base.owner


def test_slot_bytes(spark):
    rows = slot_bytes(table(spark, ROWS), 512).collect()
    assert sum(r["bytes"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ROWS) and sum(r["rows"] for r in rows) == len(ROWS)
    assert table(spark, ROWS).select(virtual_slot().alias("v")).distinct().count() <= 8192
