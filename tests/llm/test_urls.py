import itertools
import random

import pytest

from tarnfold.llm import urls


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = None
    for text, says in urls.RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return host, path, best[0] if best else None, best[1] if best else None


URLS = [None, "", "no scheme", "http://ORG", "http://x.org/", "https://É.Example.ORG/es/1?a=b", "http://example.org/en/12#x", "http://example.org?x=/es/", "a://b://c", "ftp://q.com/fr/\n/de", "http://notexample.org/es/", "http://de.com/de/", "x" * 20000 + "://com/de/a", "://org/a"]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        h, p, rule, says = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (h, p, rule, says or "allow"), u
    assert urls.judge(df.limit(0)).count() == 0


def test_mined_rules(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        host = "pills.shop.net" if bad else f"{rng.choice(['news', 'wiki'])}.{rng.choice(['net', 'dev'])}"
        rows.append((f"http://{host}/{rng.choice(['a', 'b', 'c'])}/{i}", bad if i % 20 else not bad))
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://pills.shop.net/a/9"), (2, "http://wiki.dev/a/9"), (3, "http://pills.shop.org/a"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, labelled, min_support=0.01).collect()}
    assert got[1]["verdict"] == "block" and got[1]["mined"] and got[1]["rule"] is None
    assert got[2]["verdict"] == got[4]["verdict"] == "allow" and got[3]["rule"] == "org/" and got[3]["verdict"] == "allow"


def brute_rules(rows, min_support, min_confidence, min_z):
    found, base = {}, sum(bad for _, bad in rows) / len(rows)
    for items in {c for t, _ in rows for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(set(t)), k)}:
        hit = [bad for t, bad in rows if set(items) <= set(t)]
        if sum(hit) >= min_support * len(rows) and sum(hit) >= min_confidence * len(hit):
            found[items] = sum(hit) / len(hit), (sum(hit) - len(hit) * base) / (len(hit) * base * (1 - base)) ** 0.5
    best = {a: c for a, c in found.items() if not any(set(b) < set(a) and found[b][0] >= c[0] for b in found)}
    return {a: c for a, (c, z) in best.items() if z >= min_z}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        t = [x for x in "abcdefg" if rng.random() < 0.5] + (["h", "i"] if rng.random() < 0.3 else [])
        rows.append((t, rng.random() < (0.8 if {"a", "c"} <= set(t) and "g" not in t else 0.45)))
    for support, z in ((0.02, 0.0), (0.1, 0.0), (0.02, 2.0), (0.02, 4.0)):
        got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), support, 0.6, 1, z)
        assert {r[0]: r[1] for r in got.rules} == brute_rules(rows, support, 0.6, z)


@pytest.mark.parametrize("n", [400, 40_000])
def test_chance_makes_no_rule_and_a_planted_one_is_found(spark, n):
    """Labels are chance but for one pair of tokens; as many rules on a small table as on a large one."""
    rng = random.Random(n)
    rows = [([f"p:{i}", f"h:{rng.randrange(10)}", f"q:{rng.randrange(4)}"], rng.random() < 0.3) for i in range(n)]
    rows = [(t, rng.random() < 0.95 if {"h:3", "q:2"} <= set(t) and i % 2 else y) for i, (t, y) in enumerate(rows)]
    rows += [(["h:3", "q:2"], True)] * (n // 10)
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    mined = urls.mine(df)
    # the pair lifts the share of its tokens too
    assert {("h:3", "q:2")} <= {r[0] for r in mined.rules} <= {("h:3",), ("q:2",), ("h:3", "q:2")}
    hits = urls.match(df.where("array_contains(tokens, 'h:3') and array_contains(tokens, 'q:2')").select("tokens"), mined)
    assert hits.where("mined is null").count() == 0
    none = urls.mine(spark.createDataFrame([(t, rng.random() < 0.3) for t, _ in rows if "h:3" not in t], "tokens array<string>, blocked boolean"))
    assert none.rules == ()


def test_long_urls_repeats_and_null_labels(spark):
    long = "http://bad.net/" + "/".join(f"w{k}" for k in range(20_000))
    labelled = spark.createDataFrame([("http://bad.net/a", True)] * 60 + [("http://good.net/a", False)] * 60 + [("http://good.net/a", None), (None, True)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, "http://good.net/b", None)], "page_id long, url string, tokens string")
    got = sorted((r["page_id"], r["verdict"], r["mined"]) for r in urls.judge(pages, labelled).collect())
    assert got == [(1, "block", "h:bad"), (1, "block", "h:bad"), (2, "allow", None)]


def test_tokens_and_rows_have_no_cap(spark):
    """300 tokens that mean block, 2.5 M rows, a set of 40 tokens that a third of the rows share."""
    rows = spark.range(2_500_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN transform(sequence(1, 40), i -> concat('p:x', i)) ELSE array(concat('h:', id % 400), 's:http') END AS tokens",
        "id % 3 > 0 AND id % 400 < 300 AS blocked",
    )
    got = {r[0]: r[1] for r in urls.mine(rows, min_z=0.0).rules}
    assert {k for k, c in got.items() if c == 1.0} == {(f"h:{i}",) for i in range(300)}
    assert set(got) - {(f"h:{i}",) for i in range(300)} == {("s:http",)}


def test_long_urls_keep_all_tokens(spark):
    """The token that decides is the 30th of its URL."""
    rows = [([f"p:{i}" for i in range(30)] + (["p:bad"] if k % 2 else ["p:good"]), k % 2 == 1) for k in range(40)] + [(["p:bad"], False)] * 10
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.6, 1, 0.0)
    assert {len(r[0]) for r in got.rules} == {1, 2} and (("p:bad",), 20 / 30, 0.4) in got.rules
    assert (("p:0", "p:bad"), 1.0, 0.4) in got.rules and len(got.rules) == 31
