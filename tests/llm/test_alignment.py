"""Cross-tokenizer alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from calspark.llm import alignment
from calspark.llm.tokens import _byte_of_char

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ranges(tokens):
    at, out = 0, []
    for n, piece in tokens:
        out.append((n, at, at + len(piece)))
        at += len(piece)
    return out


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
    table, found, count = _byte_of_char(), [], Counter()
    for doc, text in rows:
        groups, links = "", []
        n_a = n_b = n_groups = 0
        if text:
            coded = a.encode(" " + text, add_special_tokens=False)
            one = [(n, bytes(table[c] for c in t)) for n, t in zip(coded.ids, coded.tokens)]
            two = [(n, bytes([int(b.id_to_piece(n)[3:-1], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode()) for n in b.encode(text)]
            if all(b"".join(p for _, p in x) == (" " + text).encode() for x in (one, two)):
                x, y = ranges(one), ranges(two)
                both = sorted({e for *_, e in x} & {e for *_, e in y})
                cut = lambda side, e: [n for n, _, end in side if (max([0, *(k for k in both if k < e)]) < end <= e)]
                groups = ";".join(f"{','.join(map(str, cut(x, e)))}|{','.join(map(str, cut(y, e)))}" for e in both)
                links = [(n, m) for n, s, e in x for m, t, f in y if s < f and t < e]
                n_a, n_b, n_groups = len(x), len(y), len(both)
        count.update(set(links))
        found.append((doc, n_a, n_b, n_groups, links, groups))
    most = defaultdict(int)
    for (n, _), c in count.items():
        most[n] = max(most[n], c)
    return [(doc, n_a, n_b, n_groups, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for doc, n_a, n_b, n_groups, links, groups in found]


def corpus():
    r = random.Random(11)
    words = ["the", "token", "alignment", "Überraschung", "naïve", "12345", "don't", "<|endoftext|>", "<s>", "<unk>", "▁", "漢字", "\t", "\n\n", "  ", "😀", "<0x41>", "ﬁ", "x" * 40, ",", "."]
    rows = [(n, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for n in range(60)]
    rows += [(n + 100, "the token, the alignment.") for n in range(40)]
    return rows + [(200, None), (201, ""), (202, " "), (203, "\x00a"), (None, "the token"), (204, "▁x"), (5, "the token"), (5, "the token")]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 30, 0])
def test_against_plain_loops(spark, heavy):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, number string, pairs int").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.token_alignment(docs, heavy=heavy).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_merge_is_a_two_pointer_merge():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 30)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})) for _ in range(2))
        i = j = 0
        links, closed = [], []
        while i < len(a) and j < len(b):
            links.append((i, j))
            x, y = a[i], b[j]
            if x == y:
                closed.append(x)
            i, j = i + (x <= y), j + (y <= x)
        one, two, ends = alignment.merge(a, b)
        assert (list(zip(one.tolist(), two.tolist())), ends.tolist()) == (links, closed)


def test_groups_are_kept_as_text_and_pairs_have_their_maxima(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello there")], "doc_id long, text string")
    aligned = alignment.alignments(docs)
    first = aligned.where("doc_id = 1").first()
    assert all("|" in g for g in first["groups"].split(";")) and sum(first["times"]) == first["n_links"]
    counts = {(r.a, r.b): (r["count"], r.a_most, r.b_most) for r in alignment.pair_counts(aligned).collect()}
    assert max(c for c, *_ in counts.values()) == 2 and all(c <= min(x, y) for c, x, y in counts.values())


def test_empty_and_long(spark):
    assert alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "word, " * 200_000
    r = alignment.token_alignment(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert r.n_a >= 400_000 and r.n_links >= max(r.n_a, r.n_b)
