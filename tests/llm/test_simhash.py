import random

import pytest
import xxhash

from calspark.llm import simhash


def brute(rows):
    """doc_id -> (fingerprint, component) by counting bits and comparing every pair."""
    prints = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words, w = [], ""
        for c in low + " ":
            if c in " \t\n\x0b\x0c\r":
                words, w = words + [w] * bool(w), ""
            else:
                w += c
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    parent = list(range(len(rows)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=160):
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeÄßé", k=r.randint(2, 7))) for _ in range(300)]
    rows = [(0, ""), (1, None), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "x y z w v q")]
    for i in range(7, n):
        if i % 3 and i > 20:
            words = rows[r.randrange(7, i)][1].split(" ")
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(r.choices(vocab, k=r.randint(30, 400))).replace("a", "A", 3)))
    return rows + [rows[10], rows[10]]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    texts = [t for _, t in corpus(60)] + ["x" * 500 + " a b c d", " " * 300 + "a b", "a b c", ""]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 7, 64, 333):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [simhash.fingerprint(t) for t in texts] == whole


@pytest.mark.parametrize("level,count,bits", [(0, 30, 26), (1, 100, 32), (2, 420, 39)])
def test_index_loses_no_pair_within_tau(level, count, bits):
    """Some key of a start whose chains stay within their budgets is free of differing bits."""
    r, ring, masks = random.Random(3), simhash._ring(), simhash._masks(level)
    assert len(masks) == count and all(abs(m.bit_count() - bits) <= 3 for _, m in masks)
    for _ in range(3000):
        x = 0
        for b in r.sample(range(64), r.randint(0, 4)):
            x |= 1 << b
        starts = set()
        for i in range(simhash.SEGMENTS):
            held = [(x >> low & (1 << width) - 1).bit_count() for low, width in (ring[(i + k) % simhash.SEGMENTS] for k in range(simhash.SEGMENTS))]
            if all(sum(held[:n]) <= n * simhash.TAU // simhash.SEGMENTS for n in range(1, simhash.SEGMENTS)):
                starts.add(i)
        assert any(x & m == 0 for i, m in masks if i in starts)


def test_longer_keys_for_more_fingerprints(spark, monkeypatch):
    assert [simhash.level_for(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [0, 0, 0, 1, 2]
    rows = corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for level in (1, 2):
        monkeypatch.setattr(simhash, "level_for", lambda n: level)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)


def test_near_copies_in_one_bucket_emit_links_in_proportion(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40, 62) for b in range(40, 62)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.components(df).collect()
    assert len(got) == len(fps) and len({r.label for r in got}) == 1


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_of_each_group(spark):
    t = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(3, t, 1), (1, t, 2), (1, t, 2), (9, "other words entirely here now", 3), (None, t, 4), (None, "no id but words of its own", 5), (None, "no id but words of its own", 5)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or -1, r.n) for r in simhash.keep_representatives(docs).collect()) == [(-1, 5), (1, 2), (9, 3)]
