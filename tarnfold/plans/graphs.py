"""Graph queries: regions, nations, customers, suppliers and parts as vertices, their keys and line items as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import graph as gr
from tarnfold.operators.graph_query import GraphQuery
from tarnfold.plans.registry import query, table

_E = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type, 1.0 AS weight, 0.9 AS confidence FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', 1.0, 0.8 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', 1.0, 0.7 FROM supplier
UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES', count(*) / 10, 0.6 FROM lineitem GROUP BY l_suppkey, l_partkey)"""
_B = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def edges(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = lambda df, s, t, kind, w, c: df.select(s.alias("src"), t.alias("dst"), F.lit(kind).alias("type"), w.alias("weight"), F.lit(c).alias("confidence"))
    one = F.lit(1.0)
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    parts = max(1, -(-lines.count() // (4 * gr.ROWS)))  # a pair of small numbers is no text
    supplies = lines.repartition(parts, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg((F.count("*") / 10).alias("w"))
    out = made(table(spark, d, "nation"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), "PART_OF", one, 0.9)
    out = out.unionByName(made(table(spark, d, "customer"), tag("c", "c_custkey"), tag("n", "c_nationkey"), "LOCATED_IN", one, 0.8))
    out = out.unionByName(made(table(spark, d, "supplier"), tag("s", "s_suppkey"), tag("n", "s_nationkey"), "LOCATED_IN", one, 0.7))
    return out.unionByName(made(supplies, tag("s", "l_suppkey"), tag("p", "l_partkey"), "SUPPLIES", F.col("w"), 0.6))


def vertices(spark, d):
    kinds = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"))
    parts = [table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(t).alias("type"), F.col(n).alias("name")) for t, p, k, n in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"WITH {_E} SELECT type, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM e GROUP BY type")
def graph_stats(spark, d):
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@query(f"WITH {_E}, {_B} SELECT src AS id, count(DISTINCT dst) AS degree FROM b GROUP BY src ORDER BY degree DESC, id LIMIT 10")
def top_degrees(spark, d):
    return gr.top_degrees(edges(spark, d))


@query(f"""WITH RECURSIVE {_E}, w AS (SELECT src, dst FROM e WHERE type IN ('LOCATED_IN', 'PART_OF')), {_B.replace('FROM e', 'FROM w')},
h AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT b.dst, h.depth + 1 FROM h JOIN b ON b.src = h.node WHERE h.depth < 2)
SELECT 'r1' AS start, node, min(depth) AS depth FROM h GROUP BY node HAVING min(depth) > 0""")
def khop(spark, d):
    return gr.k_hop(edges(spark, d), _ids(spark, "r1"), 2, undirected=True, types=["LOCATED_IN", "PART_OF"])


@query(f"""WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e WHERE type <> 'SUPPLIES' UNION SELECT dst, src FROM e WHERE type <> 'SUPPLIES'),
p AS (SELECT 'r1' AS node, ['r1'] AS path UNION ALL SELECT b.dst, list_append(p.path, b.dst) FROM p JOIN b ON b.src = p.node WHERE len(p.path) <= 3 AND NOT list_contains(p.path, b.dst))
SELECT 'r1' AS start, node, arg_min(array_to_string(path, '>'), (len(path), path)) AS path FROM p GROUP BY node""")
def shortest_path(spark, d):
    return gr.shortest_paths(edges(spark, d).where("type <> 'SUPPLIES'"), _ids(spark, "r1"), 3).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_E} SELECT src AS s, 'SUPPLIES' AS predicate, dst AS o FROM e JOIN part ON dst = 'p' || p_partkey WHERE type = 'SUPPLIES' AND src = 's3' AND p_name LIKE '%a%'")
def triple_match(spark, d):
    return gr.triples(vertices(spark, d), edges(spark, d), F.col("id") == "s3", "SUPPLIES", F.col("name").contains("a"))


@query(f"WITH {_E} SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.src AS n3 FROM e a JOIN e b ON b.src = a.dst AND b.type = 'PART_OF' JOIN e c ON c.dst = b.dst AND c.type = 'PART_OF' WHERE a.type = 'LOCATED_IN'")
def path_pattern(spark, d):
    return gr.path_pattern(edges(spark, d), [("LOCATED_IN", "out"), ("PART_OF", "out"), ("PART_OF", "in")])


@query(f"WITH {_E} SELECT a.src, b.dst, 'LOCATED_IN' AS type, round(max(a.confidence * 0.95 * b.confidence * 0.95), 6) AS confidence FROM e a JOIN e b ON b.src = a.dst AND b.type = 'PART_OF' WHERE a.type = 'LOCATED_IN' GROUP BY a.src, b.dst HAVING max(a.confidence * 0.95 * b.confidence * 0.95) >= 0.6")
def infer_transitive(spark, d):
    return gr.infer_transitive(edges(spark, d), "LOCATED_IN", "PART_OF", "LOCATED_IN", 0.95, 0.6).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_E}, x AS MATERIALIZED (SELECT src, dst, confidence FROM e WHERE type = 'SUPPLIES' UNION ALL SELECT dst, src, confidence FROM e WHERE type = 'SUPPLIES' AND src IN ('s1', 's2')),
k AS MATERIALIZED (SELECT DISTINCT src, dst FROM x) SELECT x.dst AS src, x.src AS dst, 'SUPPLIES' AS type, round(x.confidence * 0.95, 6) AS confidence FROM x LEFT JOIN k ON k.src = x.dst AND k.dst = x.src WHERE k.src IS NULL""")
def infer_symmetric(spark, d):
    e = edges(spark, d).where("type = 'SUPPLIES'").select("src", "dst", "type", "confidence")
    e = e.unionByName(e.where(F.col("src").isin("s1", "s2")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence"))
    return gr.infer_symmetric(e, "SUPPLIES").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_E} SELECT 's1>' || a.dst || '>' || b.dst AS path, round(a.confidence * b.confidence, 6) AS confidence FROM e a JOIN e b ON b.src = a.dst AND b.type = 'PART_OF' WHERE a.src = 's1' AND a.type = 'LOCATED_IN'")
def causal_chains(spark, d):
    got = gr.causal_chains(edges(spark, d), ["LOCATED_IN", "PART_OF"], _ids(spark, "s1"), 4, 0.5)
    return got.select(F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


_S = "s AS (SELECT DISTINCT 's' || l_suppkey AS id, p_brand || p_size % 7 AS feature FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {_S}, o AS (SELECT feature FROM s WHERE id = 's1') SELECT id, round(count(*) FILTER (feature IN (SELECT feature FROM o)) / (count(*) + (SELECT count(*) FROM o) - count(*) FILTER (feature IN (SELECT feature FROM o))), 6) AS similarity
FROM s WHERE id <> 's1' GROUP BY id HAVING count(*) FILTER (feature IN (SELECT feature FROM o)) > 0 ORDER BY count(*) FILTER (feature IN (SELECT feature FROM o)) / (count(*) + (SELECT count(*) FROM o) - count(*) FILTER (feature IN (SELECT feature FROM o))) DESC, id LIMIT 10""")
def analogies(spark, d):
    s = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    s = s.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.concat("p_brand", (F.col("p_size") % 7).cast("string")).alias("feature"))
    return gr.analogies(s, "s1").withColumn("similarity", F.round("similarity", 6))


@query("""WITH k AS (SELECT l_suppkey AS src, l_partkey AS dst, list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'CAUSES' WHEN 'R' THEN 'PREVENTS' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'BEFORE' ELSE 'AFTER' END END) AS kinds FROM lineitem GROUP BY ALL)
SELECT src, dst, a, b FROM k, (VALUES ('CAUSES', 'PREVENTS'), ('BEFORE', 'AFTER')) o(a, b) WHERE list_contains(kinds, a) AND list_contains(kinds, b)""")
def contradictory_edges(spark, d):
    kind = F.expr("CASE l_returnflag WHEN 'A' THEN 'CAUSES' WHEN 'R' THEN 'PREVENTS' ELSE CASE l_linestatus WHEN 'O' THEN 'BEFORE' ELSE 'AFTER' END END")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("type"))
    return gr.contradictions(e, [("CAUSES", "PREVENTS"), ("BEFORE", "AFTER")])


@query(f"WITH {_E} SELECT a.src, b.dst, b.type, round(max(b.confidence * 0.8), 6) AS confidence FROM e a JOIN e b ON b.src = a.dst WHERE a.type = 'LOCATED_IN' AND a.src IN ('c1', 'c2', 's5') AND b.dst <> a.src GROUP BY ALL HAVING max(b.confidence * 0.8) >= 0.5")
def suggest_relationships(spark, d):
    return gr.suggest(edges(spark, d), _ids(spark, "c1", "c2", "s5"), ["LOCATED_IN"]).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_E} SELECT src, dst, type, round(weight - 0.15, 6) AS weight FROM e WHERE weight - 0.15 >= 0.1")
def edge_decay(spark, d):
    return gr.decayed(edges(spark, d), 0.15).select("src", "dst", "type", F.round("weight", 6).alias("weight"))


@query(f"WITH {_E}, m AS (SELECT CASE WHEN src IN ('s2', 's3') THEN 's1' ELSE src END AS src, CASE WHEN dst IN ('n2', 'n4') THEN 'n1' ELSE dst END AS dst, type, weight FROM e) SELECT src, dst, type, round(max(weight), 6) AS weight FROM m WHERE src <> dst GROUP BY src, dst, type")
def merge_entities(spark, d):
    remap = spark.createDataFrame([("s2", "s1"), ("s3", "s1")], "old string, new string")
    other = spark.createDataFrame([("n2", "n1"), ("n4", "n1")], "old string, new string")
    e = edges(spark, d)
    # sources and targets are renamed by their own maps here: nations keep their own outgoing edges
    e = e.join(other.select(F.col("old").alias("dst"), "new"), "dst", "left").select("src", F.coalesce("new", "dst").alias("dst"), "type", "weight", "confidence")
    return gr.merge_entities(e, remap).select("src", "dst", "type", F.round("weight", 6).alias("weight"))


@query("SELECT lower(trim(p_brand)) AS key, p_type AS type, count(*) AS mentions, list_sort(list(DISTINCT p_brand)) AS aliases FROM part GROUP BY ALL")
def upsert_entities(spark, d):
    return gr.upsert_entities(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("type")))


@query("""WITH s AS (SELECT doc_id, (doc_id % 97) / 97 AS score FROM documents), h AS (SELECT doc_id, count(*)::DOUBLE AS graph FROM labels GROUP BY doc_id UNION ALL SELECT doc_id, 2.0 FROM documents WHERE doc_id % 13 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, round(score + coalesce(0.3 * graph / max(graph) OVER (), 0), 6) AS score FROM s LEFT JOIN h USING (doc_id) ORDER BY s.score + coalesce(0.3 * graph / max(graph) OVER (), 0) DESC, doc_id LIMIT 10""")
def graph_augmented_search(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").cast("double").alias("graph"))
    hits = labels.unionByName(docs.where("doc_id % 13 = 0").join(labels, "doc_id", "left_anti").withColumn("graph", F.lit(2.0)))
    return gr.augmented(docs.withColumn("score", (F.col("doc_id") % 97) / 97), hits, "doc_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_E}, {_B} SELECT b1.src AS id, count(DISTINCT b2.dst) AS two_hop FROM b b1 JOIN e b2 ON b2.src = b1.dst WHERE b1.src LIKE 'c%' GROUP BY b1.src")
def two_hop_counts(spark, d):
    e = edges(spark, d)
    first = gr.both_ways(e).select("src", "dst").where("src LIKE 'c%'").distinct()
    return first.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("far").alias("two_hop"))


# ---------------------------------------------------------------- compiled queries with score

_V = """v AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS name, (r_regionkey % 10 + 1) / 10 AS importance FROM region
UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, (n_nationkey % 10 + 1) / 10 FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, (c_custkey % 10 + 1) / 10 FROM customer
UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, (s_suppkey % 10 + 1) / 10 FROM supplier UNION ALL SELECT 'p' || p_partkey, 'part', p_name, (p_partkey % 10 + 1) / 10 FROM part)"""


def _weighed(spark, d):
    return vertices(spark, d).withColumn("importance", (F.regexp_extract("id", r"\d+", 0).cast("long") % 10 + 1) / 10)


def _levels(start: str, fit: str, edge: str, depth: int, direction: str = "out") -> str:
    """Common tables l0 (starts) to l<depth>: a level is the best edge to each vertex that its start hasn't seen."""
    walk = {"out": "SELECT src, dst, weight FROM e", "in": "SELECT dst AS src, src AS dst, weight FROM e"}
    ways = f"{walk['out']} WHERE {edge} UNION ALL {walk['in']} WHERE {edge}" if direction == "both" else f"{walk[direction]} WHERE {edge}"
    out = [f"g AS MATERIALIZED (SELECT src, dst, max(weight) AS weight, any_value(importance) AS importance FROM ({ways}) JOIN v ON v.id = dst WHERE {fit} GROUP BY src, dst)", f"l0 AS MATERIALIZED (SELECT id AS start, id AS node FROM v WHERE {start} AND {fit})"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM l{j}" for j in range(i))
        out.append(f"l{i} AS MATERIALIZED (SELECT start, dst AS node, {i} AS depth, max(weight) * any_value(importance) / {i} AS score FROM l{i - 1} JOIN g ON src = node WHERE (start, dst) NOT IN (SELECT (start, node) FROM ({seen})) GROUP BY start, dst)")
    return ", ".join([*out, "m AS (" + " UNION ALL ".join(f"SELECT start, node AS id, depth, score FROM l{i}" for i in range(1, depth + 1)) + ")"])


def _scored() -> GraphQuery:
    return GraphQuery().start_type("supplier").where(F.col("importance") >= 0.4).where_edges(F.col("weight") >= 0.2).traverse("SUPPLIES", depth=3, direction="both")


_SCORED_SQL = f"WITH {_E}, {_V}, {_levels("type = 'supplier'", 'importance >= 0.4', "type = 'SUPPLIES' AND weight >= 0.2", 3, 'both')}"


@query(f"{_SCORED_SQL} SELECT start, id, depth, round(score, 6) AS score FROM m")
def graph_query_scored(spark, d):
    """Suppliers over shared parts, three steps, the unimportant pruned on the way."""
    return _scored().matches(_weighed(spark, d), edges(spark, d)).withColumn("score", F.round("score", 6))


@query(f"{_SCORED_SQL} SELECT count(score) AS count_score, round(sum(score), 4) AS sum_score, round(avg(depth), 6) AS avg_depth, max(importance) AS max_importance, min(m.score) AS min_score FROM m JOIN v USING (id)")
def graph_query_aggregates(spark, d):
    v = _weighed(spark, d)
    found = _scored().aggregates(_scored().matches(v, edges(spark, d)), v, ("count", "score"), ("sum", "score"), ("avg", "depth"), ("max", "importance"), ("min", "score"))
    return found.withColumns({"sum_score": F.round("sum_score", 4), "avg_depth": F.round("avg_depth", 6)})


@query(f"""WITH {_E}, {_V}, {_levels("id = 'r1'", "importance >= 0.2", "type IN ('PART_OF', 'LOCATED_IN')", 2, 'in')}
SELECT start, id, depth, round(score, 6) AS score, name, type, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 40 AS truncated FROM m JOIN v USING (id) ORDER BY m.score DESC, start, id LIMIT 40""")
def graph_query_text(spark, d):
    """One query string in, one plan out."""
    asked = GraphQuery.parse("from:r1 traverse:PART_OF,LOCATED_IN depth:2 importance:>0.2 limit:40").sort("score", descending=True)
    asked = asked.traverse(*asked.over, depth=asked.depth, direction="in")
    return asked.run(_weighed(spark, d), edges(spark, d)).select("start", "id", "depth", F.round("score", 6).alias("score"), "name", "type", "total", "truncated")


@query(f"WITH {_E}, {_V} SELECT id, round(importance, 6) AS score FROM v WHERE type = 'part' AND importance >= 0.5 AND contains(lower(name), 'a')")
def graph_query_nodes(spark, d):
    """No traversal: the start set is the result."""
    return GraphQuery.parse("type:part importance:>0.5 A").matches(_weighed(spark, d), edges(spark, d)).select("id", F.round("score", 6).alias("score"))
