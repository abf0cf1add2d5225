import random

from calspark.llm import decontaminate as D


def slow_score(item, window):
    """Smith-Waterman by the textbook."""
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best / (D.MATCH * len(item))


def test_alignment_against_the_textbook():
    r = random.Random(0)
    pairs = [(r.choices("abcd", k=r.randint(1, 25)), r.choices("abcde", k=r.randint(1, 50))) for _ in range(300)]
    assert all(abs(s - slow_score(a, b)) < 1e-9 for (s, _), (a, b) in zip(D.align(pairs), pairs))


def vocabulary(r):
    return ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(3000)] + ["the", "of"] * 300


def corpus():
    r = random.Random(1)
    vocab = vocabulary(r)
    items = {n: r.choices(vocab, k=r.randint(15, 50)) for n in range(12)} | {50: ["Short", "item", "here"]}
    docs, leak = [], set()
    for d in range(200):
        words = r.choices(vocab, k=r.randint(0, 400))
        if d % 5 == 0:
            n = r.randrange(12)
            copy = list(items[n])
            for _ in range(int(len(copy) * r.choice([0, 0, 0.08, 0.15]))):
                i = r.randrange(len(copy))
                how = r.random()
                if how < 0.5:
                    copy[i] = r.choice(vocab)
                elif how < 0.75:
                    copy.insert(i, r.choice(vocab))
                else:
                    del copy[i]
            at = r.randint(0, len(words))
            words[at:at] = copy
            leak.add((d, n))
        docs.append((d, " ".join(words).title() if d % 2 else ", ".join(words)))
    docs += [(900, "so SHORT, item: here!"), (901, None), (902, ""), (0, docs[0][1]), (None, " ".join(items[3]))]
    return docs, items, leak | {(900, 50), (None, 3)}


def test_planted_copies_are_found_and_clean_documents_left(spark):
    docs, items, leak = corpus()
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(77, None), (78, ""), (60, " ".join(items[2]))], "item_id int, text string")
    df = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double").repartition(3)
    got = {(x.doc_id, x.item_id) for x in D.contaminated(df, bench).collect()}
    assert got == leak | {(d, 60) for d, n in leak if n == 2}
    # the same by aligning every item with every whole text
    for d, text in docs[:60]:
        words = D.words_of(text)
        for n, item in items.items():
            assert ((d, n) in got) == (slow_score(D.words_of(" ".join(item)), words) >= D.SCORE)
    bad = {d for d, _ in leak}
    kept = D.keep_clean(df, bench).collect()
    assert sorted((x.doc_id, x.text or "") for x in kept) == sorted((d, t or "") for d, t in docs if d not in bad)


def test_a_passage_in_a_third_of_all_documents_is_not_lost(spark):
    r = random.Random(3)
    vocab = vocabulary(r)
    item = r.choices(vocab, k=30)
    docs = spark.createDataFrame([(d, " ".join(r.choices(vocab, k=30) + (item if d % 3 == 0 else []))) for d in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert {x.doc_id for x in D.contaminated(docs, bench).collect()} == set(range(0, 300, 3))


def test_copies_with_one_seed_are_found_however_many_there_are(spark):
    r = random.Random(4)
    vocab = vocabulary(r)
    short, item = r.sample(vocab[:3000], 4), r.sample(vocab[:3000], 14)
    edited = [w if 3 <= i < 8 or i % 3 else "edited" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(d, " ".join(r.choices(vocab, k=30) + (short if d % 2 else edited) + r.choices(vocab, k=30))) for d in range(120)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(item))], "item_id int, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated(docs, bench).collect()} == {(d, 1 if d % 2 else 2) for d in range(120)}


def test_short_and_heavily_edited_copies_against_aligning_all_pairs(spark):
    r = random.Random(5)
    vocab = vocabulary(r)
    items = {n: r.choices(vocab, k=[3, 6, 9, 16, 20, 30][n % 6]) for n in range(18)}
    docs = []
    for d in range(150):
        copy = []
        for i, w in enumerate(items[d % 18]):
            how = d // 18 % 4
            edit = i % 5 == 4 if how == 0 else i % 3 == 2 if how == 1 else r.random() < (0.2, 0.3)[how - 2]
            copy += [r.choice(vocab)] if edit and r.random() < 0.6 else [w, r.choice(vocab)] if edit else [w]
        docs.append((d, " ".join(r.choices(vocab, k=r.randint(0, 80)) + copy + r.choices(vocab, k=r.randint(0, 80)))))
    docs.append((150, " ".join(w + " x" for w in items[5])))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id int, text string")
    got = {(x.doc_id, x.item_id): x.score for x in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(d, n): s for d, text in docs for n, item in items.items() if (s := slow_score(D.words_of(" ".join(item)), D.words_of(text))) >= D.SCORE}
    assert len(want) > 100 and (150, 5) in want
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == 1
