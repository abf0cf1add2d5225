import math
import random

import numpy as np

from calspark.llm import quality as Q


def corpus(n=900):
    r = random.Random(0)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(4000)]
    docs, labels = [], []
    for d in range(n):
        words, kind = r.choices(vocab, k=r.randint(20, 200)), r.random()
        bad = toxic = 0
        if kind < 0.1:
            words, bad = [w.upper() + "!!" for w in words], 1
        elif kind < 0.2:
            words, bad = [w + r.choice(["%%%", "###", "***"]) for w in words], 1
        elif kind < 0.32:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grumpfel", "zackbird", "mudlump"]) + r.choice(["", "s", "ing"]))
            toxic = 1
        docs.append((d, " ".join(words), f"s{min(9, int(r.expovariate(0.5)))}", r.choice("ab")))
        labels.append((d, 1 - bad, toxic))
    return docs, labels


def test_held_out_accuracy_nulls_and_passthrough(spark):
    docs, labels = corpus()
    truth = {d: (q, t) for d, q, t in labels}
    extra = [(5000, None, None, None), (5001, "", "s0", "a"), (0, docs[0][1], docs[0][2], docs[0][3]), (None, docs[1][1], "s1", "b")]
    df = spark.createDataFrame([(*x, 7) for x in docs + extra], "doc_id long, text string, source string, lang string, p_quality int").repartition(3)
    seen = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = Q.classify(df, seen).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= x.p_quality <= 1 for x in rows)
    odd = [x for x in rows if x.doc_id is not None and x.doc_id < 5000 and x.doc_id % 2]
    wrong = sum(x.keep != (truth[x.doc_id] == (1, 0)) for x in odd)
    clean_lost = sum(not x.keep for x in odd if truth[x.doc_id] == (1, 0))
    assert wrong <= 0.03 * len(odd) and clean_lost <= 2
    kept = Q.keep_good(df, seen)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if x.keep}


def test_copies_of_one_toxic_text_do_not_make_a_lexicon(spark):
    docs, labels = corpus(300)
    copy = "rareword anotherrare thirdrare " + docs[3][1] + " grumpfel"
    docs += [(10_000 + n, copy, "s0", "a") for n in range(60)]
    labels += [(10_000 + n, 1, 1) for n in range(60)]
    model = Q.fit(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "=grumpfel" in model.lexicon and "=rareword" not in model.lexicon


def test_sites_shrink_and_leave_out_the_document_itself(spark):
    r = np.random.default_rng(0)
    rows = [((n,), "big", "p", float(v), -30.0) for n, v in enumerate(r.normal(3, 1, 200))] + [((300 + n,), "bad", "p", float(v), -30.0) for n, v in enumerate(r.normal(-3, 1, 50))] + [((900,), "new", "p", 0.0, -30.0)]
    x = {y["row"]["doc_id"]: y for y in Q.with_sites(spark.createDataFrame(rows, "row struct<doc_id:long>, host string, path string, good double, bad double")).collect()}
    p = 1 / (1 + np.exp(-np.array([v[3] for v in rows])))
    assert x[0]["site"] > 0.9 and x[300]["site"] < 0.3
    assert abs(x[900]["site"] - p.mean()) < 1e-6  # a site of one document knows nothing but the prior


def brute(rows, model):
    """doc -> (p_document, p_site, p_quality, p_toxic) from (doc, text, host, path), by loops."""
    squash = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    scored = []
    for doc, text, host, path in rows:
        good, bad = model.score([text or ""])
        scored.append((doc, host or "", path or "", float(good[0]), float(bad[0])))
    p = [squash(x[3]) for x in scored]
    overall = sum(p) / len(p)

    def sums(key):
        out = {}
        for x, v in zip(scored, p):
            s, n = out.get(key(x), (0.0, 0))
            out[key(x)] = (s + v, n + 1)
        return out

    def strength(groups):
        """groups: (sum, count, parent's mean)"""
        if len(groups) < 2:
            return Q.STRENGTH[1]
        total = sum(n for _, n, _ in groups)
        within = sum(n * m * (1 - m) for _, n, m in groups) / total
        between = sum(n * (s / n - m) ** 2 for s, n, m in groups) / total - within * len(groups) / total
        return min(Q.STRENGTH[1], max(Q.STRENGTH[0], within / between - 1 if between > 0 else Q.STRENGTH[1]))

    hosts, paths = sums(lambda x: x[1]), sums(lambda x: (x[1], x[2]))
    a = strength([(s, n, overall) for s, n in hosts.values()])
    b = strength([(s, n, (hosts[h][0] + a * overall) / (hosts[h][1] + a)) for (h, _), (s, n) in paths.items()])
    out = []
    for (doc, host, path, good, bad), own in zip(scored, p):
        (hs, hn), (s, n) = hosts[host], paths[host, path]
        host_mean = (hs - own + a * overall) / (hn - 1 + a)
        site = (s - own + b * host_mean) / (n - 1 + b)
        out.append((doc, own, site, squash(good + Q.SITE_WEIGHT * (logit(site) - logit(overall))), squash(bad)))
    return out


def test_whole_result_against_brute_force(spark):
    docs, labels = corpus(400)
    docs += [(5000, None, None, None), (5001, "", "s0", "a"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    seen = spark.createDataFrame(labels[::2], "doc_id long, quality int, toxic int")
    model = Q.fit(df, seen)
    want = sorted(brute(docs, model))
    got = sorted((x.doc_id, x.p_document, x.p_site, x.p_quality, x.p_toxic, x.keep) for x in Q.classify(df, seen).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:5] for g in got], [w[1:] for w in want], atol=1e-9)
    assert [g[5] for g in got] == [w[3] >= Q.THRESHOLD and w[4] < Q.TOXIC for w in want]


def test_no_labels_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "some words", "s", "l")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.classify(df, labels.limit(0)).first().keep and Q.classify(df, labels).first().keep
    assert Q.classify(df.limit(0), labels).count() == 0
