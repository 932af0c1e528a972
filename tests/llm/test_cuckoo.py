import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tarnfold.llm import cuckoo
from tarnfold.llm.cuckoo import CuckooIndex


def digests(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, (n, 4), np.uint64)


def ones(n):
    return np.arange(n, dtype=np.int64), np.ones(n, np.int64)


def test_filter_inserts_finds_deletes_and_resizes():
    keys = digests(5000)
    index = CuckooIndex(16)
    for a in range(0, 5000, 700):
        part = keys[a : a + 700]
        index.add(part, *ones(len(part)))
    assert len(index) == 5000 and index.resizes > 3
    assert (index.find(keys) >= 0).all() and (index.find(digests(5000, 2)) < 0).all()
    index.delete(keys[:2000])
    assert (index.find(keys[:2000]) < 0).all() and (index.find(keys[2000:]) >= 0).all() and len(index) == 3000
    index.add(keys[:1000], *ones(1000))
    assert len(index) == 4000 and (index.find(keys[:1000]) >= 0).all()
    again = CuckooIndex.loaded(index.table(0, 1))
    assert len(again) == 4000 and (again.find(keys[2000:]) >= 0).all() and (again.find(keys[1000:2000]) < 0).all()


def test_equal_fingerprints_and_buckets_are_told_apart_by_content():
    keys = digests(40)
    keys[:, 1] = 7  # one fingerprint
    keys[:, 0] = np.arange(40, dtype=np.uint64) << np.uint64(40)  # one bucket until the filter has 2^40
    keys[:, 0] |= np.arange(40, dtype=np.uint64) // np.uint64(4)
    index = CuckooIndex(8)
    index.add(keys, *ones(40))
    assert len(index) == 40 and sorted(index.find(keys)) == list(range(40))
    other = keys.copy()
    other[:, 3] += np.uint64(1)
    assert (index.find(other) < 0).all()


ROWS = [(i, f"text {i % 40}" + " \n\t"[i % 3] * (i % 5) + "end") for i in range(300)]
ROWS += [(None, "text 3end"), (None, "only without id"), (None, "only without id"), (7, "text 7 \x0b\x0cend"), (7, "text 7 \x0b\x0cend"), (900, None), (901, ""), (902, " "), (903, "\n\n"), (904, "a " * 200_000), (905, "a\n" * 200_000), (906, "\x00é\x85 x"), (907, " ")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "", flags=re.A) for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out, done = [], set()
    for (i, _), t in zip(rows, norm):
        keep = min((g for g in groups[t] if g is not None), default=None)
        kept = i == keep and (i, t) not in done
        done.add((i, t))
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, copies int, digest binary").repartition(5)


@pytest.mark.parametrize("shards,local", [(1, 3), (7, 200_000)])
def test_against_brute_force(spark, monkeypatch, shards, local):
    monkeypatch.setattr(cuckoo, "LOCAL_ROWS", local)
    held = cuckoo.members(table(spark, ROWS))
    got = cuckoo.decided(held, cuckoo.build(held, shards))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_a_hot_text_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "COPIES", 50)
    rows = [(1, "hot")] * 333 + [(i, "hot") for i in range(2, 400)] + [(i, str(i)) for i in range(400, 700)]
    held = cuckoo.members(table(spark, rows))
    assert sorted((tuple(r) for r in cuckoo.decided(held, cuckoo.build(held)).collect()), key=repr) == brute(rows)
    none = cuckoo.members(table(spark, rows).limit(0))
    assert cuckoo.decided(none, cuckoo.build(none)).collect() == []


def test_updates_equal_a_new_build(spark):
    rows = [r for r in ROWS if r[0] is not None]
    held = cuckoo.members(table(spark, rows))
    index = cuckoo.build(held, 5)
    gone = rows[:120] + [(903, "\n\n"), (12345, "never there")]
    more = [(5000 + i, f"text {i % 45}end") for i in range(90)] + [(0, "text 3end")]
    index, after = cuckoo.update(index, held, cuckoo.members(table(spark, more)), cuckoo.members(table(spark, gone)))
    left = list(rows)
    for r in gone:
        if r in left:
            left.remove(r)
    left += more
    assert sorted((tuple(r) for r in cuckoo.decided(after, index).collect()), key=repr) == brute(left)
    rebuilt = {(r["digest"], r["keep_id"], r["group_size"]) for r in cuckoo.build(after, 5).collect()}
    assert {(r["digest"], r["keep_id"], r["group_size"]) for r in index.collect()} == rebuilt
    index, after = cuckoo.update(index, after, removed=after)
    assert index.count() == 0 and after.count() == 0
    index, after = cuckoo.update(index, after, added=held)
    assert {(r["digest"], r["keep_id"]) for r in index.collect()} == {(r["digest"], r["keep_id"]) for r in cuckoo.build(held, 5).collect()}


def test_whole_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in cuckoo.op11_cuckoo_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)
