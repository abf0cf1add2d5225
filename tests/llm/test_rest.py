"""Revisits, licences, token rollups and the pipeline."""

import os
import random
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row

import corpus_pipeline
from calspark.llm import decontaminate, licenses, packing, queries, quality, rollup, secrets, simhash, warc
from calspark.llm.storage import new_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)


# ---- revisits


def brute_revisits(records):
    out = []
    for r in records:
        if r["status"] != 304:
            continue
        earlier = [p for p in records if 200 <= p["status"] <= 299 and p["key"] is not None and p["key"] == r["key"] and p["ts"] is not None and r["ts"] is not None and p["ts"] < r["ts"]]
        hit = max(earlier, key=lambda p: (p["ts"], p["record_id"]), default=None)
        strip = lambda t: t[2:] if t.startswith("W/") else t
        if hit is None:
            verdict = "orphan"
        elif r["etag"] is not None and hit["etag"] is not None:
            verdict = "matched" if strip(r["etag"]) == strip(hit["etag"]) else "mismatch"
        elif r["etag"] is None and r["last_modified"] is not None and hit["last_modified"] is not None:
            verdict = "matched" if r["last_modified"] == hit["last_modified"] else "mismatch"
        else:
            verdict = "no_validator"
        fresh = {k.lower(): v for k, v in (r["headers"] or {}).items()}
        merged = fresh
        if verdict == "matched":
            merged = {k.lower(): v for k, v in (hit["headers"] or {}).items()} | {k: v for k, v in fresh.items() if k not in warc.KEPT_FROM_STORED}
        out.append((r["record_id"], r["key"], hit and hit["record_id"], verdict, tuple(sorted(merged.items()))))
    return sorted(out, key=repr)


def test_revisits_against_brute_force_with_a_hot_url(spark):
    r = random.Random(0)
    urls = [("http://www.A.com:80/x/?utm_source=q&b=2&a=1#f", "a.com/x?a=1&b=2"), ("https://a.com/x?a=1&b=2", "a.com/x?a=1&b=2"), ("http://u@b.org:8080/", "b.org:8080"), ("c.net/no-scheme", None), (None, None), ("HTTP://m.b.org:8080", "m.b.org:8080"), ("http://d.io/?gclid=x", "d.io"), ("http://d.io/?ref=x", "d.io?ref=x"), ("https://a.com/y/../%78/./?%61=1&b=2", "a.com/x?a=1&b=2")]
    rows = []
    for n in range(600):
        url, key = urls[0] if n % 3 == 0 else r.choice(urls)
        rows.append({"record_id": n, "url": url, "ts": r.choice([None, *range(150)]), "status": r.choice([200, 304, 304, 404, 206]), "etag": r.choice([None, '"a"', 'W/"a"', '"b"']), "last_modified": r.choice([None, "mon", "tue"]), "headers": r.choice([None, {}, {"Content-Type": "t1", "X-A": "1"}, {"content-length": "9", "x-a": "2", "Date": "d"}]), "key": key})
    rows.append(dict(rows[0]))
    schema = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, key string"
    df = spark.createDataFrame([Row(**x) for x in rows], schema).repartition(3)
    for slices in (1, 7):
        got = sorted(((x.record_id, x.canonical_url, x.refers_to, x.verdict, tuple(sorted(x.headers.items()))) for x in warc.resolve_revisits(df, slices).collect()), key=repr)
        assert got == brute_revisits(rows)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("url,key", [
    ("http://A.com/%7Euser/%2f%zz%4", "a.com/~user/%2F%zz%4"), ("http://a.com/a/./b/../../c/", "a.com/c"), ("http://a.com/../../x", "a.com/x"), ("http://a.com/.hidden/a..b", "a.com/.hidden/a..b"),
    ("http://a.com/x?sid=1&ref=2&UTM_Source=3", "a.com/x?ref=2&sid=1"), ("http://m.a.com/x", "m.a.com/x"), ("http://www.a.com", "a.com"), ("http://a.com/?q=%e4%B8%ad", "a.com?q=%E4%B8%AD"),
    ("http://a.com/" + "x" * 100_000, "a.com/" + "x" * 100_000), ("", None), (None, None), ("http:///x", None),
])
def test_canonical_urls(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.canonical_url(df.url).alias("k")).first().k == key
    if url is not None:
        con = duckdb.connect()
        con.execute("create table pages as select 0 page_id, $1 url, '' html", [url])
        found = con.execute(queries.oracle_sql()["op1_warc_revisit"]).fetchall()
        assert found[0][1] == key


def test_headers_that_differ_in_case_and_clashing_columns(spark):
    schema = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, key string, payload string, slice int"
    rows = [
        (1, "http://a.b/x", 1, 200, '"a"', None, {"Date": "d1", "date": "d0", "X-Long": "v" * 200_000, "Content-Type": "t"}, "k", "p", 3),
        (2, "http://a.b/x", 2, 304, '"a"', None, {"DATE": "d2", "Date": "d3", "etag": None}, "k", "p", 3),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert [(x.record_id, x.refers_to, x.verdict) for x in got] == [(2, 1, "matched")]
    assert got[0].headers == {"date": "d2, d3", "x-long": "v" * 200_000, "content-type": "t", "etag": None}


# ---- licences


def test_rewritten_licences_are_known_and_mentions_are_not(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, mit.replace(",", " ;").replace("\n", "\r\n\t")), (3, "© 1999 X\n" + mit.replace("sublicense", "sub-licence").replace("copyright notice", "copyright notice")), (4, "My text. " + mit), (5, None), (6, ""), (7, "Copyright 2020 only"),
        (8, licenses.KNOWN["Zlib"].replace("acknowledgment", "Acknowledgement")), (9, "LICENSED under the apache licence - version 2.0"), (9, "LICENSED under the apache licence - version 2.0"),
    ]
    docs = spark.createDataFrame([(*x, "d") for x in rows], "doc_id long, text string, digest string")
    got = [(x.doc_id, x.license_id) for x in licenses.license_scan(docs).collect()]
    assert sorted(got) == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, None), (8, "Zlib"), (9, "notice-Apache-2.0"), (9, "notice-Apache-2.0")]
    own = spark.createDataFrame([("z", "My text. " + mit), ("a", "my TEXT " + mit), ("n", None), ("e", "...")], "license_id string, text string")
    assert {(x.doc_id, x.license_id) for x in licenses.license_scan(docs, own).collect() if x.license_id} == {(4, "a")}
    assert licenses.license_scan(docs.limit(0)).count() == 0
    assert "Python" not in licenses.license_scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_wrapping_and_notices_do_not_matter(spark):
    rows, n = [], 0
    for name, text in licenses.KNOWN.items():
        if not name.startswith("notice"):
            for width in range(20, 100):
                wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))
                rows.append((n, "Copyright (c) 2001-2019, Jo Doe <jo@x.org>\nCopyright 1999 by others\n(C) 2004 a third\n© 2005\nAll rights reserved.\n\n" + wrapped, name))
                n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {x.doc_id: x.license_id for x in licenses.license_scan(docs).collect()}
    assert [(r[2], r[0]) for r in rows if got[r[0]] != r[2]] == []


SYSTEM = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "BSD-3-Clause-UC": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="needs the licence texts of the system")
def test_long_licences_by_their_digests(spark):
    texts = {k: open(f"{SYSTEM}/{f}", encoding="utf-8", errors="replace").read() for k, f in FILES.items() if os.path.exists(f"{SYSTEM}/{f}")}
    rows = [(n, t, k) for n, (k, t) in enumerate(texts.items())] + [(100 + n, t.upper().replace("\n", "\r\n\t"), k) for n, (k, t) in enumerate(texts.items())]
    rows.append((999, "x" + texts["GPL-3.0"] * 40, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {x.doc_id: x.license_id for x in licenses.license_scan(docs).collect()}
    assert set(FILES) == set(licenses.DIGESTS) and all(got[r[0]] == r[2] for r in rows)


# ---- rollups


def test_rollup_against_replay(spark):
    r = random.Random(0)
    store, state = rollup.Rollup(spark, new_path(spark, "t")), {}
    schema = "op string, seq int, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    assert store.totals().count() == 0
    for batch in range(1, 5):
        changes = [(r.choice(["insert", "revise", "delete"]), n, r.randrange(40), r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice(["t1", "t2"]), r.randrange(100)) for n in range(60)]
        df = spark.createDataFrame(changes + [("insert", 99, None, "a", "x", "t1", 5)], schema)
        assert store.commit(batch, df) and not store.commit(batch, df.limit(3))
        for op, _, d, s, lang, t, n in changes:
            state[d, t] = None if op == "delete" else (s, lang, n)
        want = Counter()
        for (_, t), v in state.items():
            if v:
                want[v[0], v[1], t, "docs"] += 1
                want[v[0], v[1], t, "tokens"] += v[2]
        got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in store.totals().collect()}
        assert got == {k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want if k[3] == "docs"}
    assert store.batches() == [1, 2, 3, 4]


def test_the_order_of_arrival_does_not_matter(spark):
    """Batches 1 to 7 in any order, compacted or not, give the totals of a replay in order."""
    r = random.Random(1)
    schema = "op string, seq int, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    batches = {b: [(r.choice(["insert", "revise", "delete"]), n, r.randrange(12), r.choice(["a", "b"]), "x", "t", r.randrange(100)) for n in range(6)] for b in range(1, 8)}
    batches[3], batches[5], batches[6] = [("insert", 0, 99, "a", "x", "t", 3)], [("revise", 0, 99, "b", "x", "t", 5)], [("insert", 0, 99, "a", "x", "t", 7)]
    state = {}
    for b in sorted(batches):
        for op, _, d, s, lang, t, n in batches[b]:
            state[d] = None if op == "delete" else (s, n)
    want = Counter()
    for v in state.values():
        if v:
            want[v[0], "docs"] += 1
            want[v[0], "tokens"] += v[1]
    for order, compact_after in (([5, 3, 6, 1, 7, 2, 4], 99), ([7, 6, 5, 4, 3, 2, 1], 2)):
        store = rollup.Rollup(spark, new_path(spark, "t"), compact_after)
        for b in order:
            assert store.commit(b, spark.createDataFrame(batches[b], schema)) and not store.commit(b, spark.createDataFrame(batches[b], schema))
        if compact_after == 2:
            assert store._base()[1] and store._base()[1] <= set(batches)
            store.vacuum()
        got = {(x.source, k): v for x in store.totals().collect() for k, v in (("docs", x.n_docs), ("tokens", x.n_tokens))}
        assert got == dict(want) and store.batches() == sorted(batches)


def test_a_batch_that_died_is_written_anew(spark):
    store = rollup.Rollup(spark, new_path(spark, "t"))
    docs = spark.createDataFrame([(1, "a b  c", "s", "l", 7, 8), (2, None, "s", "l", 7, 8)], "doc_id long, text string, source string, lang string, n_tokens int, counted int")
    spark.createDataFrame([("s", "l", "words@1", 9, 9)], rollup.LEDGER).write.parquet(store._folder("ledger", 1))
    from calspark.llm.storage import remove

    remove(spark, store._folder("ledger", 1) + "/_SUCCESS")
    counted = rollup.counts(docs, tokenizers={})
    assert store.batches() == [] and store.commit(1, rollup.changes(counted, "insert", 0))
    assert {(x.tokenizer, x.n_docs, x.n_tokens) for x in store.totals().collect()} == {("words@1", 2, 3), ("utf8@1", 2, 6)}
    assert rollup.counts(docs.limit(0)).count() == 0


WORDS_AND_BYTES = r"""
with l as (select doc_id, max(toxic) toxic, min(quality) quality from labels group by doc_id),
d as (select source, lang, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') w, coalesce(text, '') t, coalesce(quality, 1) quality, coalesce(toxic, 0) toxic
      from documents left join l using (doc_id) where doc_id is not null),
c as (select source, lang, 'words@1' tokenizer, case when quality = 0 then len(list_distinct(w)) else len(w) end n from d where toxic <> 1
      union all select source, lang, 'utf8@1', octet_length(encode(t)) from d where toxic <> 1)
select source, lang, tokenizer, count(*) n_docs, cast(sum(n) as bigint) n_tokens from c group by all
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_the_whole_rollup_against_sql_and_the_tokenizer_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = {r[:3]: r[3:] for r in con.execute(WORDS_AND_BYTES).fetchall()}
    library, marks = Tokenizer.from_file(public_tokenizers.path(rollup.TOKENIZER)), {}
    for d, q, t in con.execute("select doc_id, min(quality), max(toxic) from labels group by 1").fetchall():
        marks[d] = (q, t)
    bpe = Counter()
    for d, text, source, lang in con.execute("select doc_id, text, source, lang from documents").fetchall():
        quality_of, toxic = marks.get(d, (1, 0))
        if toxic != 1:
            ids = library.encode(text or "", add_special_tokens=False).ids
            bpe[source, lang, "n"] += 1
            bpe[source, lang, "t"] += len(set(ids)) if quality_of == 0 else len(ids)
    want |= {(s, g, "byte_bpe_50k@1"): (bpe[s, g, "n"], bpe[s, g, "t"]) for s, g, k in bpe if k == "n"}
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in rollup.op5_token_rollup(spark, DATA).collect()}
    assert got == want


# ---- pipeline


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]


def test_stages_take_nulls_repeats_long_texts_clashing_names_and_empty_tables(spark, tmp_path):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))
    texts = {n: prose(80) for n in range(30)}
    rows = [(n, t, "en", f"s{n % 3}", len(t)) for n, t in texts.items()] + [(0, texts[0], "en", "s0", 1), (40, texts[1] + " more", None, None, None), (41, None, "en", "s0", None), (None, prose(60), "en", "s1", 9), (42, "", "en", "s1", 0), (43, prose(30_000), "en", "s1", 0), (44, "key token = " + "0123456789abcdef" * 2 + " " + prose(50), "de", "s1", 5)]
    clashing = ("label", "row", "key", "_key", "_id", "_row", "_base", "_host", "host", "path", "s", "n", "p", "good", "text_key", "base", "number", "none", "first", "spans", "masked", "a.b")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing)
    spark.createDataFrame([(n, 1, 0) for n in range(20)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[2].split()[10:60])), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = tuple(f"user's {c}" for c in clashing)
    docs = spark.createDataFrame([(*x, *extra) for x in rows], schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        empty = stage(spark, empty, str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
        assert all(tuple(x)[5:] == extra for x in docs.collect()), name
        ids = [x.doc_id for x in docs.collect()]
        if name == "quality":
            assert set(range(30)) <= set(ids) and None in ids
        elif name == "near_dedup":
            assert sorted(i for i in ids if i is not None and i < 30) == list(range(30)) and 40 not in ids and None in ids
        elif name == "decontaminate":
            assert set(range(30)) - set(ids) == {2} and None in ids
        else:
            masked = {x.doc_id: x for x in docs.collect()}
            assert masked[3].text == texts[3] and masked[44].text.startswith("key [secret] ") and masked[44].n_chars == len(masked[44].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(ids) and corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_run_against_the_stages_one_by_one(spark):
    """Each stage's effect on the whole table, recomputed from the operators' own, brute-force-tested results on plain rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    keep = {x.doc_id for x in quality.classify(spark.createDataFrame(docs, schema), labels).collect() if x.keep}
    docs = [d for d in docs if d.doc_id in keep]
    prints = {d.doc_id: simhash.fingerprint(d.text) for d in docs}
    group = {d.doc_id: d.doc_id for d in docs}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 4 and group[b] < group[a]:
                    group[a], changed = group[b], True
    docs = [d for d in docs if group[d.doc_id] == d.doc_id]
    items = [decontaminate.words_of(x.text) for x in bench.collect()]
    clean = []
    for d in docs:
        words = decontaminate.words_of(d.text)
        hit = any(set(i) & set(words) and decontaminate.align([(i, words)])[0][0] >= decontaminate.SCORE for i in items)
        if not hit:
            clean.append(d)
    left = spark.createDataFrame(clean, schema)
    masked = secrets.redact(left).collect()
    spans = {x.doc_id: x.spans for x in secrets.secrets(left).collect()}
    for d, m in zip(sorted(clean), sorted(masked)):
        assert d.doc_id == m.doc_id and (d.text == m.text) == (not spans[d.doc_id]) and len(m.text) == m.n_chars
    want = Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packing.pieces(spark.createDataFrame(masked, schema)).collect())
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    assert len({(x.sequence_id, x.offset) for x in got}) == len(got)
