"""Queries take whole texts and whole tables."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from tarnfold.plans import catalog
from tests.test_queries import SF


def test_merges_take_whole_contents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    longest = {r["g"]: r["n"] for r in docs.groupBy((F.col("doc_id") % 100).alias("g")).agg(F.max(F.length("text")).alias("n")).collect()}
    by_md5 = {r["h"]: r["n"] for r in docs.select(F.md5("text").alias("h"), F.length("text").alias("n")).collect()}
    for r in catalog.queries()["merge_keep_best"](spark, SF).collect():
        assert by_md5[r["content_md5"]] == longest[r["grp"]]


def test_summaries_of_five_messages_by_first_sentences(spark):
    chunks, want = defaultdict(list), {}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        chunks[r["conv_id"], seen[r["conv_id"]] // 5].append(r)
        seen[r["conv_id"]] += 1
    for k, messages in chunks.items():
        firsts = [(m["role"], re.split(r"[.!?]\s+", m["text"] or "")[0].strip()) for m in messages]
        said = [f"{role}: {s[:100]}..." for role, s in firsts if len(s) > 20]
        want[k] = "\n".join(said[:3]) or f"[{len(messages)} messages exchanged]"
    assert {(r["conv_id"], r["chunk"]): r["summary"] for r in catalog.queries()["summarize_chunks"](spark, SF).collect()} == want


def test_rerank_and_metrics_leave_no_ids_out(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.queries()["rerank"](spark, str(tmp_path)).count() == 10
    ids = {r["query_id"] for r in catalog.queries()["ranking_metrics"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert len(ids) == n and max(ids) >= 5


def test_episodes_by_plain_folding(spark):
    per = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        per[r["user_id"]].append(r["ts"])
    want = set()
    for user, stamps in per.items():
        runs = []
        for t in stamps:
            if runs and (t - runs[-1][-1]).total_seconds() <= 1800 and (t - runs[-1][0]).total_seconds() <= 14400:
                runs[-1].append(t)
            else:
                runs.append([t])
        want |= {(user, k + 1, r[0], r[-1], len(r)) for k, r in enumerate(r for r in runs if len(r) >= 2)}
    got = catalog.queries()["episodes_maxdur"](spark, SF).collect()
    assert {(r["user_id"], r["episode"], r["first_at"], r["last_at"], r["items"]) for r in got} == want and len(got) == len(want)


def test_rate_limiter_by_plain_folding(spark):
    state, want = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        begin, n = state.get(r["user_id"], (None, 0))
        if begin is None or (r["ts"] - begin).total_seconds() >= 86400:
            begin, n = r["ts"], 0
        state[r["user_id"]] = begin, n + 1
        want[r["event_id"]] = n + 1 <= 5
    got = {r["event_id"]: r["allowed"] for r in catalog.queries()["rate_limiter"](spark, SF).collect()}
    assert got == want and set(want.values()) == {True, False}


def _talk(spark):
    per = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        per[r["conv_id"]].append(r)
    return per


def _count(text):
    return len(re.findall(r"\w+|[^\s\w]", text or ""))


def test_truncation_by_plain_folding(spark):
    want = set()
    for conv, said in _talk(spark).items():
        always = [m["role"] == "system" or k >= len(said) - 2 for k, m in enumerate(said)]
        used, left, kept = 0, sum(_count(m["text"]) for m, p in zip(said, always) if p), []
        for m, p in zip(said, always):
            left -= _count(m["text"]) if p else 0
            if p or used + _count(m["text"]) + left <= 120:
                used += _count(m["text"])
                kept.append(m["turn"])
        want |= {(conv, t, used) for t in kept}
    assert {(r["conv_id"], r["turn"], r["tokens"]) for r in catalog.queries()["truncate_greedy"](spark, SF).collect()} == want


def _pieces(text):
    return [s for s in (re.sub(r"^\s+|\s+$", "", x) for x in re.split(r"[.!?]+", text or "")) if s]


def _first(text):
    return next((s[:100] for s in _pieces(text) if len(s) > 20), None)


def test_extractive_summaries_by_plain_ranking(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        parts = _pieces(r["text"])
        score = lambda i, s: (1 - 0.5 * i / len(parts)) * (0.8 if len(s.split()) > 50 else 0.5 if len(s.split()) < 4 else 1.0)
        best = sorted(range(len(parts)), key=lambda i: (-score(i, parts[i]), i))[:2]
        want |= {(r["doc_id"], k + 1, parts[i]) for k, i in enumerate(best)}
    assert {(r["doc_id"], r["rank"], r["sentence"]) for r in catalog.queries()["extractive_summary"](spark, SF).collect()} == want


def test_hierarchies_by_plain_chunks(spark):
    per, want = defaultdict(list), set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        per[r["source"]].append(_first(r["text"]) or (r["text"] or "")[:100])
    for source, firsts in per.items():
        leaves = [" ".join(firsts[k : k + 5]) for k in range(0, len(firsts), 5)]
        want |= {(source, k, 1, s) for k, s in enumerate(leaves)} | {(source, -1, 0, " ".join(s[:100] for s in leaves))}
    assert {(r["source"], r["chunk"], r["level"], r["summary"]) for r in catalog.queries()["hierarchical_summary"](spark, SF).collect()} == want


def test_tiers_by_plain_rules(spark):
    from tarnfold.functions import rules as rl

    want = set()
    for conv, said in _talk(spark).items():
        for back, m in enumerate(reversed(said)):
            if m["role"] == "system" or back < 2:
                want.add((conv, m["turn"], "system" if m["role"] == "system" else "recent", m["text"]))
            elif back < 5:
                want |= {(conv, m["turn"], "medium", s) for s in [_first(m["text"])] if s}
            else:
                facts = [f.strip() for p, _ in rl.KEY_FACTS for f in (x.group(1) for x in re.finditer("(?i)" + p, m["text"])) if len(f.strip()) > 5][:3]
                want |= {(conv, m["turn"], "old", "; ".join(sorted(f[:100] for f in facts)))} if facts else set()
    assert {(r["conv_id"], r["turn"], r["tier"], r["content"]) for r in catalog.queries()["tiered_compression"](spark, SF).collect()} == want


def test_diversified_list_by_plain_picks(spark):
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(v[a], v[b]) / (dot(v[a], v[a]) * dot(v[b], v[b])) ** 0.5
    near = sorted(v, key=lambda k: (-cos(0, k), k))[:50]
    rel = {k: cos(0, k) for k in near}
    low, high = min(rel.values()), max(rel.values())
    picked = []
    while len(picked) < 10:
        value = lambda k: 0.7 * (rel[k] - low) / (high - low) - 0.3 * max([0.0, *(cos(k, p) for p in picked)])
        picked.append(min((k for k in near if k not in picked), key=lambda k: (-round(value(k), 12), k)))
    got = sorted((r["rank"], r["doc_id"]) for r in catalog.queries()["mmr_topk"](spark, SF).collect())
    assert [d for _, d in got] == picked


def test_appended_batches_are_written_once(spark, tmp_path):
    from tarnfold.streaming import jobs

    out = str(tmp_path / "out")
    spark.range(5).write.parquet(str(tmp_path / "in" / "a.parquet"))
    for run in ("one", "two"):  # the second run repeats batch 0
        df = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "a.parquet"))
        jobs.run(df, out, str(tmp_path / run), "append")
    assert sorted(r["id"] for r in jobs.appended(spark, out).collect()) == list(range(5))


def test_upserts_keep_one_older_table(spark, tmp_path):
    from tarnfold.streaming import jobs

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame([(1, k), (k + 10, k)], "id long, version long").coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema("id long, version long").parquet(src)
        jobs.upsert_batches(df, out, "id", "version", str(tmp_path / "progress"))
    assert sorted(tuple(r) for r in jobs.latest_table(spark, out, 3).collect()) == [(1, 3), (10, 0), (11, 1), (12, 2), (13, 3)]
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["2", "3"]
