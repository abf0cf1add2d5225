"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from calspark.llm import substrings


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, window):
    r = random.Random(seed)
    words = [f"w{n}" for n in range(400)] + ["é", "漢字", " x", "a b"]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passages = [make(n) for n in (window - 1, window, window + 1, 2 * window, 3 * window)]
    rows = []
    for n in range(80):
        text = make(r.randint(0, 40))
        for p in r.sample(passages, r.randint(0, 3)):
            text += p + make(r.randint(0, 5))
        rows.append((n, r.choice([" ", "\n", " \t "]).join(text)))
    near = make(4 * window)
    for n in range(60):
        text = list(near)
        text[r.randrange(len(text))] = f"changed{n}"
        rows.append((100 + n, " ".join(text)))
    return rows + [(200 + n, " ".join(near)) for n in range(30)] + [(1, rows[1][1]), (None, " ".join(near)), (300, "a b " * window), (301, None), (302, ""), (303, " \n ")]


@pytest.mark.parametrize("window,held", [(35, substrings.HELD), (35, 1), (35, 300), (5, 100), (2, 50), (64, 1000)])
def test_against_all_windows(spark, monkeypatch, window, held):
    rows = corpus(window, window)
    monkeypatch.setattr(substrings, "HELD", held)  # for what runs here; the workers read the module's own
    docs = spark.createDataFrame([(d, t, 7, "y") for d, t in rows], "doc_id long, text string, number int, k0 string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(docs, window, digest=True).collect()]
    assert sorted(got, key=repr) == brute(rows, window)


def test_parts_of_any_size_settle_the_same(monkeypatch):
    """The two steps on one task, with parts from one document to all."""
    import pyarrow as pa

    rows = [(n, t) for n, (_, t) in enumerate(corpus(4, 35)) if t]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([t for _, t in rows])], ["number", "text"])
    seen = []
    for held in (1, 200, 10**9):
        monkeypatch.setattr(substrings, "HELD", held)
        sent = pa.Table.from_batches(list(substrings._anchors(35)(iter([batch])))).to_pylist()
        times = Counter(r["k0"] for r in sent if r["settled"] is None)
        met = {(r["number"], r["place"]) for r in sent if r["settled"] is None and r["number"] is not None and times[r["k0"]] > 1}
        met |= {(r["number"], p) for r in sent if r["settled"] for p in np.frombuffer(r["settled"], np.int32).tolist()}
        seen.append(met)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 100


@pytest.mark.parametrize("period,residues", substrings.COVERS.items())
def test_covers_meet_at_every_shift(period, residues):
    for i, j in product(range(period), repeat=2):
        assert any((i + d) % period in residues and (j + d) % period in residues for d in range(period))


def test_a_hash_crosses_once_a_part(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{n}" for n in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([text] * 5000)], ["number", "text"])
    (sent,) = substrings._anchors(35)(iter([batch]))
    marks = [r for r in sent.to_pylist() if r["settled"] is None]
    assert len(marks) == len({r["k0"] for r in marks}) < 60 and sent.num_rows == len(marks) + 5000


def test_kept_text_and_empty(spark):
    p = " ".join(f"p{n}" for n in range(40))
    docs = spark.createDataFrame([(1, f"a b {p} c"), (2, f"{p}  d\n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(docs).collect()) == [(1, 43, 40, "a b c"), (2, 41, 40, "d")]
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
