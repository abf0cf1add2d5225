import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from calspark.llm import secrets

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def texts():
    r = random.Random(2)
    parts = [
        "password = hunter2hunter2", "PassWord:'abcdefghijkl'", "token=secret=abcdefghijkl", "api_key  =  short", "APIKEY\"=\"AAAAbbbb1111.2222", "AKIA" + "A" * 13,
        "AKIA" + "B2" * 8, "xAKIAAKIA" + "C" * 14, "deadbeef" * 2, "0123456789abcde", "\x01", "\x02", "ſecret=abcdefghijklmn", "toKen: zzzzzzzzzzzz", "é𝒳ü", "secret\n=abcdefghijklmnop",
        "passwd='" + "f" * 40 + "'", "token", "\r\n", " ",
    ]
    rows = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "ß"]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    return rows + ["", None, "a " * 5000 + "token = " + "0f" * 20]


def test_base_spans_against_python(spark):
    rows = [(n, t) for n, t in enumerate(texts())] + [(3, "deadbeefdeadbeef")]
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, spans string, t int").repartition(3)
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secrets(docs).collect())
    want = sorted((d, *base(t or "")[0], base(t or "")[1]) for d, t in rows)
    assert got == want


def test_random_tokens_are_added_and_prose_is_left(spark):
    r = random.Random(7)
    b64 = string.ascii_letters + string.digits + "+/"
    keys = ["".join(r.choices(b64, k=44)) for _ in range(60)]
    prose = ["Donaudampfschifffahrtsgesellschaft", "http_proxy_configuration_value", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "-" * 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "thisIsAVeryLongCamelCaseIdentifier", "a/b/c/d/e/f/g/h/i/j/k/l/m/n", "2024-01-01-2024-01-02-2024"]
    docs = spark.createDataFrame([(n, f"words before {k} and after") for n, k in enumerate(keys)] + [(1000 + n, p + " words") for n, p in enumerate(prose)], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.secrets(docs).collect()}
    hits = sum(got[n] == f"random:13:{13 + 44}" for n in range(60))
    assert hits >= 54
    assert all(not got[1000 + n] for n in range(len(prose)))


def test_battery_on_uniform_draws_holds_its_level(spark):
    r = random.Random(9)
    tokens = [("".join(r.choices(string.ascii_letters + string.digits, k=r.choice([24, 32, 48, 96]))),) for _ in range(800)]
    x = secrets.scored(spark.createDataFrame(tokens, "token string")).collect()
    assert sum(t.grid > 0 for t in x) > 0.95 * len(x)


ALPHABETS = {
    "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "BASE36": string.ascii_uppercase + string.digits, "HEX": "0123456789ABCDEF",
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters, "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


def test_recall_by_encoding_and_length(spark):
    """Found at evidence of 1 % of tokens being secrets, that is p <= 1e-4."""
    r = random.Random(11)
    rows = [(k, n, "".join(r.choices(a, k=n))) for k, a in ALPHABETS.items() for n in (20, 32, 64) for _ in range(150)]
    x = secrets.scored(spark.createDataFrame(rows, "kind string, n_chars int, token string")).collect()
    found = {(k, n): 0.0 for k in ALPHABETS for n in (20, 32, 64)}
    for t in x:
        found[t.kind, t.n_chars] += (t.grid >= secrets.STEP * 9.22) / 150
    print({k: round(v, 2) for k, v in found.items()})
    assert all(v >= (0.75 if n == 20 else 0.9) for (_, n), v in found.items())


def test_ordinary_tokens_have_no_evidence(spark):
    words = """internationalization INTERNATIONALIZATION_TABLE getElementsByTagNameAndClass HTTPConnectionPoolManager thread_local_storage_v2 usr/local/share/applications
        Geschwindigkeitsbegrenzung desenvolvimentosustentavel anticonstitutionnellement otorrinolaringologia electroencefalografista rechtsanwaltskanzleien
        MAX_CONNECTIONS_PER_HOST 2024-01-31-backup-of-database com/example/project/Main configuration-management-tool AbstractSingletonProxyFactoryBean""".split()
    x = secrets.scored(spark.createDataFrame([(w,) for w in words], "token string")).collect()
    assert not {t.token: t.grid for t in x if t.grid > secrets.STEP * 4.6}


def test_keys_behind_names_and_in_paths_keep_their_offsets(spark):
    r = random.Random(12)
    rows, want = [], {}
    around = [("AWS_ACCESS=", ""), ("export CLIENT_KEY=", " x"), ("GET https://a.example.com/blob/file?sig=", "&v=2"), ("/api/v1-beta/keys/", "/use"), ("name_of_the_configuration_value=", ";"), ("a=b=", "==")]
    for n in range(240):
        before, after = around[n % len(around)]
        key = "".join(r.choices(string.ascii_letters + string.digits, k=[16, 19, 32, 40][n // 6 % 4]))
        rows.append((n, f"é {before}{key}{after}"))
        want[n] = f"random:{len(before) + 2}:{len(before) + 2 + len(key) + len(after) * (after == '==')}"
    rows += [(1000 + n, f"SOME_LONG_SETTING_NAME=an-ordinary-value-of-words src/main/java/com/example/project/Main{n} https://www.example.com/2024/news-of-the-day") for n in range(240)]
    got = {x.doc_id: x.spans for x in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[1000 + n] for n in range(240))
    assert {got[n] for n in range(240)} - set(want.values()) <= {""}
    for k in range(24):
        mine = [n for n in range(240) if n % 24 == k]
        assert sum(got[n] == want[n] for n in mine) >= len(mine) / 2
    assert sum(got[n] == want[n] for n in want) >= 0.9 * 240


def test_empty(spark):
    assert secrets.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghijklmnop")], "doc_id long, text string")
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redaction_masks_spans_and_keeps_rows(spark):
    r = random.Random(7)
    key = "".join(r.choices(string.ascii_letters + string.digits, k=60))
    rows = [(1, "a token = deadbeefdeadbeefdead b", 32, "x"), (2, f"k {key} z", 64, "x"), (3, "plain é", 7, "x"), (3, "plain é", 7, "x"), (None, None, None, "y"), (5, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, random string")
    got = sorted(map(tuple, secrets.redact(docs).collect()), key=str)
    want = sorted([(1, "a [secret] b", 12, "x"), (2, "k [secret] z", 12, "x"), *rows[2:]], key=str)
    assert got == want


def brute_spans(texts):
    """The spans of every text, kinds by name: patterns by re, the battery and the control of false discoveries by loops."""
    tail = lambda z: 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.07056 * z**3)))

    def chi(x, df):
        v = 2 / (9 * df)
        return tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))

    def kind_of(c):
        return 0 if c in secrets.LOWER else 1 if c in secrets.UPPER else 2 if c in secrets.DIGIT else 3

    def grid_of(token):
        body = token.rstrip("=")
        alphabet = next((letters for _, pattern, letters in secrets.ENCODINGS if re.search(pattern, body)), None)
        n = len(body)
        if alphabet is None or n < secrets.MIN_TOKEN:
            return 0
        k, codes = len(alphabet), [alphabet.index(c) for c in body]
        symbols = chi(max(1e-9, k / n * sum(body.count(c) ** 2 for c in alphabet) - n), k - 1)
        x, df = 0.0, -1
        for letters in (secrets.LOWER, secrets.UPPER, secrets.DIGIT, "+/-_"):
            size = sum(c in letters for c in alphabet)
            if size:
                expected = n * size / k
                x, df = x + (sum(c in letters for c in body) - expected) ** 2 / expected, df + 1
        classes = chi(max(1e-9, x), max(1, df)) if df > 0 else 1.0
        high = [c >= k / 2 for c in codes]
        n1 = sum(high)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        expected = 1 + 2 * n1 * (n - n1) / n
        by_runs = 2 * tail(abs(runs - expected) / math.sqrt(max(1e-9, (expected - 1) * (expected - 2) / (n - 1))))
        mean = sum(codes) / n
        spread = max(1e-9, sum((c - mean) ** 2 for c in codes))
        serial = 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread + 1 / n) * math.sqrt(n))
        battery = 4 * min(symbols, classes, by_runs, serial)
        if battery < secrets.BATTERY:
            return 0
        ordinary, kinds, letters = 0.0, [kind_of(c) for c in body], [secrets.LOWER.find(c) for c in body.lower()]
        for i, c in enumerate(letters):
            if c >= 0:
                ordinary += (ord(secrets.BIGRAMS[26 * (letters[i - 1] + 1 if i and letters[i - 1] >= 0 else 0) + c]) - 48) / 10
        ordinary += min(-math.log(1 / 4) - sum(math.log(table[a][b]) for a, b in zip(kinds, kinds[1:])) for table in secrets.CLASSES)
        ordinary += math.log(10) * kinds.count(2) + math.log(4) * kinds.count(3)
        return min(secrets.GRID - 1, math.floor(max(0.0, ordinary - n * math.log(k) + math.log(min(1.0, battery))) * secrets.STEP))

    bases, tokens = [], []
    for row, text in enumerate(texts):
        t = text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= secrets.MIN_ASSIGN]
        base += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= secrets.MIN_ACCESS]
        base += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= secrets.MIN_HEX]
        bases.append(sorted(base))
        for m in re.finditer(secrets.TOKEN, t):
            spans = {(m.start(), m.end())}
            at = m.start()
            for part in re.split(secrets.BREAK, m[0]):
                if len(part.rstrip("=")) >= secrets.MIN_TOKEN and len(part) < len(m[0]):
                    spans.add((at, at + len(part)))
                at += len(part) + 1
            for a, b in spans:
                if not any(x < b and a < y for x, _, y in base):
                    band = max(n for n, least in enumerate(secrets.BANDS) if b - a >= least)
                    tokens.append((row, a, b, band, grid_of(t[a:b])))
    found = [list(b) for b in bases]
    for band in range(len(secrets.BANDS)):
        mine = [x for x in tokens if x[3] == band]
        least = min((g for g in {x[4] for x in mine} if g > 0 and math.exp(-g / secrets.STEP) <= secrets.FDR * sum(x[4] >= g for x in mine) / len(mine)), default=None)
        for row, a, b, _, g in mine:
            if least is not None and g >= least:
                found[row].append((a, 3, b))
    out = []
    for spans in found:
        random_ones = [s for s in spans if s[1] == 3]
        inner = {s for s in random_ones if any(o != s and o[0] <= s[0] and s[2] <= o[2] for o in random_ones)}
        out.append(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans) - inner)))
    return out


def test_whole_result_against_brute_force(spark):
    r = random.Random(11)
    alphabets = [letters for _, _, letters in secrets.ENCODINGS]
    words = ["".join(r.choices("etaoinshrdlucm", k=r.randint(2, 9))) for _ in range(400)]

    def token():
        return "".join(r.choices(r.choice(alphabets), k=r.choice([16, 18, 20, 27, 32, 40, 64, 130]))) + "=" * r.choice([0, 0, 1, 2])

    def text():
        out = r.choices(words, k=r.randint(3, 60))
        for _ in range(r.choice([0, 0, 1, 3])):
            out.insert(r.randrange(len(out)), r.choice(["", "KEY=", "a/b/", "token: ", "secret=", "é=", "https://x.org/", "some-long-name_"]) + token() + r.choice(["", "/tail", "-x", ".", "é"]))
        for _ in range(r.choice([0, 0, 1])):
            out.append(r.choice(["ThisIsALongCamelCaseIdentifier", "another_quite_long_snake_case_name", "aaaaaaaaaaaaaaaaaaaaaaaa", "2024/11/26/some-long-slug-of-a-page", "AKIA" + "A7" * 9, "0123456789abcdef" * 2]))
        return " ".join(out)

    texts = [text() for _ in range(300)] + [None, "", "word " * 30_000 + token(), "x" * 200_000]
    texts += texts[:3]
    docs = spark.createDataFrame([(n, t, "s", 1) for n, t in enumerate(texts)], "doc_id long, text string, spans string, number int").repartition(3)
    got = {x.doc_id: x.spans for x in secrets.secrets(docs).collect()}
    want = brute_spans(texts)
    assert sum("random" in w for w in want) > 60
    assert [(n, got[n], w) for n, w in enumerate(want) if got[n] != w] == []


def test_long_keys_are_found_wherever_they_stand(spark):
    r = random.Random(21)
    rows = [(200 * k + n, before, "".join(r.choices(string.ascii_letters + string.digits, k=40))) for k, before in enumerate(("", "AWS_KEY=", "id=", "https://a.example.com/b/")) for n in range(200)]
    docs = spark.createDataFrame([(d, f"words {before}{key} more") for d, before, key in rows], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.secrets(docs).collect()}
    for k in range(4):
        # behind a path the outermost discovery may begin earlier in the run
        hit = lambda d, n: got[d].endswith(f":{46 + n}") and int(got[d].split(":")[1]) <= 6 + n
        assert sum(hit(d, len(before)) for d, before, _ in rows[200 * k : 200 * k + 200]) >= 190


def test_very_many_matches_in_one_text(spark):
    """200,000 hex tokens, keys with names and paths in one text of 7 million characters: found and masked in time that follows its length."""
    import time

    r = random.Random(31)
    parts = [f"{r.getrandbits(100):026x}" for _ in range(200_000)]
    parts[::1000] = [f"token={p}" for p in parts[::1000]]
    parts[7::1000] = ["/v1-beta/keys_" + "".join(r.choices(string.ascii_letters + string.digits, k=40)) + "/use" for _ in parts[7::1000]]
    text = "é " + " \n".join(parts)
    docs = spark.createDataFrame([(1, text, len(text)), (2, "token = " + "ab" * 9, 26)], "doc_id long, text string, n_chars long")
    began = time.time()
    got = {x.doc_id: x for x in secrets.secrets(docs).collect()}
    masked = {x.doc_id: x for x in secrets.redact(docs).collect()}
    took = time.time() - began
    assert [got[1].n_assign, got[1].n_access, got[1].n_hex] == base(text)[0] and got[1].base_sha256 == base(text)[1]
    spans = [(int(s), int(e)) for _, s, e in (x.split(":") for x in got[1].spans.split(","))]
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    assert masked[1].text == "".join(out) + text[at:] and masked[1].n_chars == len(masked[1].text)
    assert got[1].spans.count("random") >= 150 and took < 60


def test_running_totals_and_halving(spark):
    r = random.Random(32)
    rows = [([r.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 511, 512, 513, 1024, 1500)]
    df = spark.createDataFrame(rows, "v array<int>")
    for x in df.select("v", secrets._before(F.col("v"), lambda a, b: a + b, 0).alias("sums"), secrets._before(F.col("v"), lambda a, b: F.greatest(a, b), -1).alias("most")).collect():
        assert x.sums == [sum(x.v[:k]) for k in range(len(x.v))] and x.most == [max([-1, *x.v[:k]]) for k in range(len(x.v))]
    for x in df.select(F.array_sort("v").alias("v"), *[secrets._below(F.array_sort("v"), F.lit(k), secrets._strides(F.col("v"))).alias(f"b{k}") for k in range(-1, 11)]).collect():
        assert [x[f"b{k}"] for k in range(-1, 11)] == [sum(v < k for v in x.v) for k in range(-1, 11)]
