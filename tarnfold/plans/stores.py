"""SQLite stores: whole tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.plans.consolidate import _folder
from tarnfold.plans.registry import query, table
from tarnfold.sources import sqlite


@query("SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE doc_id >= 10 AND lang <> 'fr'")
def sqlite_roundtrip(spark, d):
    """Documents to a folder of SQLite files and back, the bound on doc_id handed down."""
    path = _folder(spark, "sqlite")
    rows = table(spark, d, "documents")
    sqlite.write_sqlite(rows.repartition(max(4, -(-rows.count() // sqlite.ROWS_A_FILE))), path, "documents")
    got = sqlite.read_sqlite(spark, path, "documents", filters=[("doc_id", ">=", 10)], rows_a_part=200).where("lang <> 'fr'")
    return got.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("SELECT vec_id, label, embedding FROM embeddings")
def sqlite_vectors(spark, d):
    path = _folder(spark, "sqlite")
    rows = table(spark, d, "embeddings")
    sqlite.write_sqlite(rows.repartition(max(3, -(-rows.count() // sqlite.ROWS_A_FILE))), path, "vectors", "overwrite")
    return sqlite.read_sqlite(spark, path, "vectors", ["vec_id", "label", "embedding"], rows_a_part=100)
