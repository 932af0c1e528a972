"""Upserts rewrite the buckets that a batch touches, and no other."""

from tarnfold.streaming import jobs


def files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_untouched_buckets_stay(spark, tmp_path):
    src, out, data = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "out.data"
    want, before = {}, set()
    batches = [[(i, 0) for i in range(200)], [(7, 5), (8, -1), (500, 1)], [(7, 4), (9, 9), (9, 11), (9, 10)]]
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, "id long, version long").coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema("id long, version long").parquet(src)
        jobs.upsert_batches(df, out, "id", "version", str(tmp_path / "progress"), buckets=16)
        for i, v in batch:
            want[i] = max(v, want.get(i, v))
        assert {r["id"]: r["version"] for r in jobs.latest_table(spark, out, number).collect()} == want
        new = {f for f in files(data) if f"batch={number}/" in f}
        assert len({f.split("/")[1] for f in new}) <= min(16, len(batch)) and new.isdisjoint(before)
        before = files(data)
    # what only the first manifest pointed to is gone
    held = jobs._manifest(spark, out, 1)
    assert {f.rsplit("/", 1)[0] for f in before if "batch=0" in f} == {f"batch=0/bucket={b}" for b, n in held.items() if n == 0}
