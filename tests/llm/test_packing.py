import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from calspark.llm import packing
from calspark.llm.tokens import encoder


def test_ids_equal_the_tokenizers_library():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(0)
    texts = ["", " ", "a", "It's  two\n\n spaces\t!", "Ärger über Ökö ñandú 东京 🎉 é", "x<|endoftext|>y", "   \n   ", "'s 't don't", "1234567890 ½ ²", "\x00\x01", " " * 3000 + "x", "ab" * 5000]
    texts += ["".join(r.choices("abc ÄÖß\n\t.,;'12", k=200)) for _ in range(50)]
    for t in texts:
        assert encoder().ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:40]


def placed(rows, histogram, capacity):
    n = max((s + c for _, _, c, s, _ in rows), default=0)
    fill, seen = np.zeros(n, int), Counter()
    for length, lo, c, s, offset in sorted(rows, key=lambda r: r[4]):
        assert (fill[s : s + c] == offset).all()
        fill[s : s + c] += length
        assert lo == seen[length] or lo < histogram[length]
        seen[length] += c
    assert seen == Counter(histogram) and (n == 0 or fill.max() <= capacity) and (fill > 0).all()
    return n


def test_plans_place_everything_gaplessly_near_the_lower_bound():
    r = random.Random(1)
    for case in range(30):
        capacity = r.choice([64, 100, 2048])
        histogram = Counter(r.randint(1, capacity) if case % 2 else min(capacity, int(r.lognormvariate(5, 1)) + 1) for _ in range(r.choice([1, 5, 3000])))
        n = placed(packing.plan(dict(histogram), capacity), histogram, capacity)
        lower = -(-sum(k * v for k, v in histogram.items()) // capacity)
        first_fit = best_fit(histogram, capacity)
        assert n <= max(lower + 1, first_fit * 1.02 + 1), (n, lower, first_fit)
    assert packing.plan({}, 100) == []


def test_configurations_against_all_of_them():
    """No linear program over all configurations takes fewer sequences: the prices of the solution allow none."""
    r = random.Random(6)
    for _ in range(40):
        capacity = r.randint(20, 60)
        sizes = sorted(r.sample(range(capacity // 5 + 1, capacity), r.randint(1, 5)), reverse=True)
        demand = [r.randint(1, 500) for _ in sizes]
        found = packing.configurations(sizes, demand, capacity)
        held = Counter()
        for slots, times in found:
            assert sum(sizes[g] for g in slots) <= capacity
            for g in slots:
                held[g] += times
        assert all(abs(held[g] - n) < 1e-6 for g, n in enumerate(demand))
        # every configuration's worth at the best prices, found by trying all: none above one, and the prices pay for the solution
        every = [[]]
        for k in sizes:
            every = [c + [n] for c in every for n in range(capacity // k + 1) if sum(a * b for a, b in zip(c, sizes)) + n * k <= capacity]
        basis = np.zeros((len(sizes), len(sizes)))
        if len(found) == len(sizes):
            for j, (slots, _) in enumerate(found):
                for g in slots:
                    basis[g, j] += 1
            prices = np.linalg.inv(basis).sum(0)
            assert max(float(np.dot(prices, c)) for c in every) <= 1 + 1e-6 and abs(float(np.dot(prices, demand)) - sum(t for _, t in found)) < 1e-6


def test_few_groups_pack_documents_within_a_thousandth_of_the_lower_bound():
    r = random.Random(9)
    for scale in (1, 1_000):
        histogram = Counter()
        for _ in range(40_000):
            n = int(r.lognormvariate(6.2, 1.0)) + 1
            histogram[n % 2048 or 2048] += scale
        rows = packing.plan(dict(histogram), 2048)
        n = placed(rows, histogram, 2048) if scale == 1 else max(s + c for _, _, c, s, _ in rows)
        assert n <= 1.001 * -(-sum(k * v for k, v in histogram.items()) // 2048) and len(rows) < 20_000


def best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram.elements(), reverse=True):
        fits = [x for x in rooms if x >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_packed_documents_hold_their_ids_once(spark):
    r = random.Random(2)
    texts = {n: " ".join(r.choices(["alpha", "be", "c", "Δ", "\n"], k=r.choice([1, 3, 40, 400]))) for n in range(60)}
    texts |= {60: None, 61: "", 62: texts[5], 63: "word " * 6000}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()] + [(5, texts[5], "y", 2), (None, "no id", "z", 0)], "doc_id long, text string, length string, offset int").repartition(3)
    rows = packing.best_fit_packing(docs, capacity=512).collect()
    ids = {k: [*encoder().ids(v or "").tolist(), 0] for k, v in texts.items()} | {None: [*encoder().ids("no id").tolist(), 0]}
    pieces, sequences = Counter(), {}
    for x in rows:
        want = ids[x.doc_id][x.start : x.start + x.length]
        assert len(want) == x.length and zlib.crc32(np.array(want, "<u4").tobytes()) == x.ids_crc32
        assert x.length == 512 or x.piece == 0
        pieces[(x.doc_id, x.piece)] += 1
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for k, v in ids.items():
        assert all(pieces[(k, p)] == (2 if k == 5 else 1) for p in range(-(-len(v) // 512)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(x.length for x in rows)
    assert len(sequences) <= -(-total // 512) + 1


def test_one_length_for_all_documents_and_empty(spark, monkeypatch):
    for bucket_rows in (50_000, 7):
        monkeypatch.setattr(packing, "BUCKET_ROWS", bucket_rows)
        docs = spark.range(5000).selectExpr("if(id < 2000, 7, id) doc_id", "'same words here' text")
        rows = packing.best_fit_packing(docs, capacity=64).collect()
        assert len({(x.sequence_id, x.offset) for x in rows}) == 5000 and len({x.sequence_id for x in rows}) == -(-5000 // (64 // rows[0].length))
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0
