import hashlib
import sys
from collections import Counter
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tarnfold.llm import bpe, toxicity
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_toxicity import made


def test_run_against_brute_force(spark, tmp_path):
    rows = made(3, 500)
    texts = [(i, t, t_) for i, t, _, t_ in rows]
    texts += [(600 + i, texts[i][1] + " tail", 0) for i in range(0, 60, 2)] + [(700, texts[3][1], 0), (701, "", 0), (702, None, 0)]
    table = [(i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t or "")) for i, t, _ in texts]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, columns).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1 - q, t) for i, _, q, t in rows[:400]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    links = toxicity.fit(docs, toxicity.label_table(spark, str(tmp_path)))
    kept = [r for r in table if toxicity.probabilities(links, [r[1]])[0, 1] < links[1].threshold]
    assert 0 < len(table) - len(kept) < 0.4 * len(table)
    first = {i: c for i, _, c in jaccard_brute([(r[0], r[1]) for r in kept], 5, 80)}
    alone = [r for r in kept if first[r[0]] == r[0]]
    assert len(alone) < len(kept)
    _, copies = mix_brute([(i, t, s, "") for i, t, _, s, _ in alone], target_entropy=0.95, max_repeats=4.0)
    library = Tokenizer.from_file(bpe.word_vocabulary())
    want = Counter()
    for i, t, *_ in alone:
        ids = library.encode(t or "", add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[row] += copies[i][0]
    assert Counter(tuple(r) for r in got) == +want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(1, "a b c", "en", None, 5, "x"), (1, "a b c", "en", None, 5, "x"), (None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, columns)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
