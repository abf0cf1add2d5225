import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from calspark.llm import editprint


def mutated(r, text, share):
    x = list(text)
    for _ in range(max(1, int(len(x) * share))):
        i = r.randrange(len(x))
        how = r.random()
        if how < 0.34:
            x[i] = r.choice("abcdefgh ")
        elif how < 0.67:
            x.insert(i, r.choice("abcdefgh "))
        elif len(x) > 1:
            del x[i]
    return "".join(x)


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzäé", k=r.randint(1, 9))) for _ in range(n))


def test_alone_or_together_is_the_same():
    r = random.Random(0)
    texts = [prose(r, n) for n in (1, 5, 80, 400, 3)] + ["", "a", "🎉é" * 50]
    together = editprint.fingerprint_all(texts)
    assert together == [editprint.fingerprint_all([t])[0] for t in texts]
    assert all(len(p) == editprint.SLOTS for p in together) and together[5] == "0" * editprint.SLOTS


def brute(text):
    """The walk step by step: emitted characters, then the sampled digits."""
    import numpy as np

    bits = (editprint._mix(np.arange(editprint.PERIOD * editprint.CLASSES, dtype=np.uint64) + np.uint64(editprint.SEED << 20)) >> np.uint64(63)).reshape(editprint.PERIOD, -1)
    emitted, i, step = [], 0, 0
    codes = [((ord(c) * 2654435761) % 2**32) >> 24 for c in text]
    while i < len(codes):
        emitted.append(codes[i])
        i += int(bits[step % editprint.PERIOD, codes[i]])
        step += 1
    out = ""
    for slot in range(editprint.SLOTS):
        at = max(int(s) for s in editprint._records()[slot] if s < len(emitted))
        out += "0123456789abcdef"[int(editprint._mix(np.array([at * editprint.CLASSES + emitted[at]], np.uint64))[0] >> np.uint64(60))]
    return out


def test_against_the_walk_step_by_step():
    r = random.Random(4)
    for n in (1, 2, 30, 300):
        t = prose(r, n)
        assert editprint.fingerprint_all([t])[0] == brute(t)


def test_likeness_falls_with_edits_and_is_low_between_strangers():
    r = random.Random(1)
    base = [prose(r, 150) for _ in range(40)]
    own = editprint.fingerprint_all(base)
    means = []
    for share in (0.002, 0.02, 0.2):
        other = editprint.fingerprint_all([mutated(r, t, share) for t in base])
        means.append(sum(map(editprint.likeness, own, other)) / len(own))
    stranger = sum(map(editprint.likeness, own, own[1:] + own[:1])) / len(own)
    assert means[0] > 0.85 and means[0] > means[1] > means[2] > stranger - 0.02 and stranger < 0.25


@pytest.mark.parametrize("size", [1_500, 20_000, 1 << 24])
def test_query_against_brute_force(spark, monkeypatch, size):
    r = random.Random(2)
    rows = [(n * 7 % 101, prose(r, r.choice([0, 1, 10, 200]))) for n in range(90)] + [(3, None), (5, "dup"), (5, "dup"), (None, "first"), (1000, "é" * 33)]
    rows += [(77, "hot " * 9)] * 2_500
    docs = spark.createDataFrame([(d, t, "f", 0) for d, t in rows], "doc_id long, text string, fingerprint string, bucket int").repartition(5)
    monkeypatch.setattr(editprint, "RANGE_BYTES", size)
    got = sorted(((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in editprint.edited_fingerprints(docs).collect()), key=repr)
    hashes = {x.text: x.h for x in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) h").distinct().collect()}
    order = sorted(((d is not None, d or 0, hashes[t or ""], t or "") for d, t in rows))
    want, marks = [], {}
    for known, d, _, t in set(order):
        marks[t] = editprint.fingerprint_all([t])[0]
    for (known, d, _, t), (_, _, _, following) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        if e not in marks:
            marks[e] = editprint.fingerprint_all([e])[0]
        p, q, s = marks[t], marks[e], marks[following]
        want.append((d if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, round(editprint.likeness(p, q), 9), round(editprint.likeness(p, s), 9)))
    assert got == sorted(want, key=repr)


def test_chunks_of_a_stream_make_no_difference(monkeypatch):
    import pyarrow as pa
    import zstandard

    r = random.Random(8)
    rows = []
    for n, (bucket, peek) in enumerate([(0, False)] * 9 + [(0, True), (2, False), (2, True)] + [(5, False)] * 4 + [(5, True)]):
        t = prose(r, r.choice([0, 3, 60]))
        rows.append((bucket, peek, 1, n, 7, 1, editprint.fingerprint_all([t])[0], zstandard.ZstdCompressor().compress(t.encode())))
        if n % 3 == 0:
            rows.append((bucket, peek, 1, n, 7, 2, None, None))
    names = [f.split()[0] for f in editprint.DEALT.split(", ")]
    batches = lambda: iter([pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows[a : a + 4]]) for a in range(0, len(rows), 4)])
    results = []
    for size in (1, 40, 500, 10**9):
        monkeypatch.setattr(editprint, "CHUNK_CHARS", size)
        monkeypatch.setattr(editprint, "HELD_CHARS", 3 * size)
        results.append([x for b in editprint._stream(batches()) for x in b.to_pylist()])
    own = [x for x in rows if not x[1]]
    assert sum(x["copies"] for x in results[0]) == sum(x[5] for x in own) and all(x == results[0] for x in results)


def test_one_row_and_none(spark):
    x = editprint.edited_fingerprints(spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")).first()
    assert x.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and x.near_next == 1.0
    assert editprint.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bits_against_digits(spark):
    r = random.Random(5)
    pairs = [("".join(r.choices("0123456789abcdef", k=editprint.SLOTS)),) * 2 for _ in range(9)]
    pairs = [(a, "".join(x if r.random() < 0.7 else r.choice("0123456789abcdef") for x in b)) for a, b in pairs]
    bits = lambda c: F.array(*[F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long") for k in range(editprint.SLOTS // 16)])
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", bits("a").alias("x"), bits("b").alias("y"), bits("a").alias("bits"))
    for row in df.select("a", "b", editprint._like("x", "y").alias("like"), editprint._keys().alias("keys")).collect():
        assert abs(row["like"] - editprint.likeness(row.a, row.b)) < 1e-12
        for band, (key, slots) in enumerate(zip(row["keys"], editprint.band_slots())):
            assert key == band << 32 | int("".join(row.a[k] for k in slots), 16)


def test_classes_against_comparing_all_pairs(spark):
    """At least 0.9 of the pairs of likeness 0.8 are in one class, and no class joins what no chain of them joins."""
    r = random.Random(3)
    base = [prose(r, 150) for _ in range(30)]
    rows = [(n, b) for n, b in enumerate(base)]
    rows += [(100 + 40 * n + k, mutated(r, b, r.choice([0.0005, 0.002, 0.004]))) for n, b in enumerate(base) for k in range(8)]
    rows += [(5_000 + n, base[0]) for n in range(400)] + [(9_000 + n, mutated(r, base[1], 0.003)) for n in range(200)] + [(None, base[2]), (None, prose(r, 99))]
    found = editprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    prints = {x.doc_id: x.fingerprint for x in found.where("doc_id is not null").collect()}
    classes = {x.fingerprint: x.class_id for x in editprint.linked_classes(found).collect()}
    different, member = sorted(set(prints.values())), {}
    for d, p in sorted(prints.items()):
        member.setdefault(p, d)
    group = {p: p for p in different}

    def top(p):
        while group[p] != p:
            group[p] = group[group[p]]
            p = group[p]
        return p

    linked = together = 0
    for k, p in enumerate(different):
        for q in different[:k]:
            if editprint.likeness(p, q) >= editprint.LIKENESS:
                linked += 1
                together += classes[p] == classes[q]
                group[top(p)] = top(q)
    assert linked > 500 and together >= 0.9 * linked
    for p in different:
        assert top(p) == top(prints[classes[p]]) and classes[p] <= member[p]
    assert classes[prints[0]] == 0 and len({classes[prints[n]] for n in range(30)}) == 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_whole_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = editprint.op8_edit_fingerprint(spark, "/root/testdata/sf0.001").collect()
    texts = sorted((x.doc_id, x.text or "") for x in docs.collect())
    assert len(got) == len(texts)
    rows = {x.doc_id: x for x in got}
    for (d, t), (_, following) in zip(texts, texts[1:] + texts[:1]):
        e = editprint.edited(t, following)
        x = rows[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and [x.fingerprint, x.edited_fingerprint] == editprint.fingerprint_all([t, e]) and x.class_id <= d


def test_classes_of_repeated_ids_follow_the_text(spark):
    """Unlike texts under one doc_id stay apart; a class is named by the smallest id of its texts."""
    r = random.Random(21)
    a, b, c = prose(r, 150), prose(r, 150), prose(r, 150)
    rows = [(5, a), (5, b), (7, mutated(r, a, 0.0008)), (8, mutated(r, b, 0.0008)), (None, c), (None, mutated(r, c, 0.0008)), (4, mutated(r, b, 0.0008))]
    found = editprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    prints = editprint.fingerprint_all([t for _, t in rows])
    assert editprint.likeness(prints[0], prints[1]) < 0.4 and min(editprint.likeness(prints[0], prints[2]), editprint.likeness(prints[1], prints[3]), editprint.likeness(prints[1], prints[6])) >= editprint.LIKENESS
    classes = {x.fingerprint: x.class_id for x in editprint.linked_classes(found).collect()}
    assert [classes[p] for p in prints] == [5, 4, 5, 4, None, None, 4]


def test_few_and_many_texts_walk_alike(monkeypatch):
    r = random.Random(22)
    texts = [prose(r, r.randint(1, 60)) for _ in range(200)]
    whole = editprint.fingerprint_all(texts)
    for few in (0, 1, 7, 10**6):
        monkeypatch.setattr(editprint, "FEW", few)
        assert editprint.fingerprint_all(texts) == whole


def test_a_long_text_by_itself_takes_seconds():
    import time

    r = random.Random(23)
    text = prose(r, 1000) * 350
    began = time.process_time()
    mark, other = editprint.fingerprint_all([text])[0], editprint.fingerprint_all([text + "x"])[0]
    assert len(text) > 1_900_000 and editprint.likeness(mark, other) > 0.95 and time.process_time() - began < 8
