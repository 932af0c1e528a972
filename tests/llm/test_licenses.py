import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "   ", "!!", "CC BY", "cc by cc by-nc", "cc, BY; cc", "CCé by", "the GNU General\nPublic License, version 3.", "All Rights Reserved. all rights  reserved",
    "K CC BY İ", "x" * 50000 + " cc by", "cc by " * 5000, "a\x00cc\x00by\x7fb", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "license mit released", "general public general public license license",
]


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def same(row, text):
    return (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute(text)


def test_base_places_against_brute_force(spark):
    got = rows_of(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert same(got[i], t), (t and t[:60], got[i])
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_templates(spark):
    got = rows_of(spark, TEXTS)
    assert got[14]["labels"] == "mit" and got[15]["labels"] == "apache-2.0" and got[16]["labels"] == "gpl,gpl-3.0"
    assert got[17]["labels"] == "" and got[17]["score"] == 0


def test_versions_belong_to_their_notice(spark):
    """The digit that counts is the one in its place, whatever other versions the file names."""
    got = rows_of(spark, ["Licensed under the GNU General Public License version 3. It needs Python version 2.", "This work is licensed under the GNU General Public License, version 2. Needs version 3 of make.", "licensed under the GNU General Public License, version 4; versions 2 and 3 do not apply: version 2, version 3"])
    assert [got[i]["labels"] for i in range(3)] == ["gpl,gpl-3.0", "gpl,gpl-2.0", "gpl"]


def test_many_notices_in_one_file(spark):
    """More distinct licence words than any fixed count of anchors: every notice that stands verbatim keeps its label."""
    notices = [t for t in licenses.TEMPLATES if t.label in ("gpl-3.0", "apache-2.0", "mit", "bsd")]
    every = ". ".join(t.text for t in licenses.TEMPLATES)
    got = rows_of(spark, [". ".join(t.text for t in notices), every, "filler " * 300 + every, " ".join(reversed(every.split()))])
    assert {"apache-2.0", "bsd", "gpl", "gpl-3.0", "mit"} <= set(got[0]["labels"].split(","))
    for i in (1, 2):
        assert {t.label for t in licenses.TEMPLATES} <= set(got[i]["labels"].split(",")) and got[i]["score"] == 1
        assert len(got[i]["templates"]) == len(licenses.TEMPLATES)
    assert not got[3]["templates"]


def brute_templates(texts, least=0.75):
    """All labels and scores by the definition, every placement of every template held against every word."""
    vocabulary = set(licenses.licence_words(licenses.PHRASES, licenses.TEMPLATES))
    out = []
    for text in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        labels, score = set(filter(None, brute(text)[4].split(","))), 1.0 if brute(text)[1] else 0.0
        for t in licenses.TEMPLATES:
            own = [(k, x) for k, x in enumerate(t.text.split()) if x in vocabulary]
            there = lambda d, k, x: 0 <= d + k < len(w) and w[d + k] == x
            starts = [(t.text.split().index(p.split()[0], 0 if p.split()[0] != "version" else t.text.split().index("version")), p.split()) for p in t.key_phrases]
            keyed = [d for d in range(-len(t.text.split()), len(w)) if all(there(d, s + k, x) for s, p in starts for k, x in enumerate(p))]
            got = max((sum(there(d, k, x) for k, x in own) for d in keyed), default=0)
            if got >= 1 and got >= least * len(own):
                labels.add(t.label)
                score = max(score, min(1.0, got / max(1, sum(x in w for _, x in own))))
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_all_labels_against_brute_force(spark):
    rng = random.Random(6)
    texts = list(TEXTS[:11]) + list(TEXTS[14:])
    for _ in range(40):
        parts = []
        for t in rng.sample(licenses.TEMPLATES, rng.randrange(1, 5)):
            words = t.text.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(["filler", "license", "the", "software"])
            if rng.random() < 0.2:
                del words[rng.randrange(len(words))]
            parts.append(" ".join(words))
        texts.append((" " + rng.choice(["and ", "x y z ", ""])).join(parts))
    got = rows_of(spark, texts)
    assert [(got[i]["labels"], round(got[i]["score"], 9)) for i in range(len(texts))] == brute_templates(texts)


def test_empty_table(spark):
    assert not rows_of(spark, [])


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(alphabet="ccby CBY,\négeneralpublicicense ", max_size=60), min_size=40, max_size=60))
def test_random_texts(spark, texts):
    texts = [t + " cc by" * (i % 3) for i, t in enumerate(texts)]
    got = rows_of(spark, texts)
    assert all(same(got[i], t) for i, t in enumerate(texts))


@pytest.mark.parametrize("k", range(2))
def test_repeated_rows_stay(spark, k):
    df = spark.createDataFrame([(1, "cc by")] * 3, "doc_id long, text string")
    assert licenses.scan(df).count() == 3
