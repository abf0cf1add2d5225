"""Secret scans: base patterns and a randomness test battery, in DataFrame functions only.

Positions. A pattern's matches are wrapped in a marker by one regexp_replace and the
text is split at the marker; every second part is a match, and a running sum of the
parts' lengths gives code point offsets. The marker in a text is first replaced by
another control character, which no pattern takes.

Battery. Candidate tokens are the maximal runs of MIN_TOKEN or more characters of
[A-Za-z0-9+/_-] with the '=' that follow, and the pieces of MIN_TOKEN or more of a run
between '/', '-' and '_', so that neither a name before '=' nor a path hides a key. A
candidate that a base span touches is none; of discoveries within one another the
outermost stays. The encoding is the smallest alphabet
that holds the token (hex, letters of one case, base32, base36, letters, base62, base64). Against a uniform draw
from it: a chi-squared test of the symbols, one of the character classes, a runs
test about the alphabet's middle and a lag-one serial correlation. A token that any
test rejects (Bonferroni at BATTERY) is no secret.

False discoveries. The other hypothesis is ordinary text: classes (lower, upper, digit,
symbol) follow one another by CLASSES, letters by the bigrams of BIGRAMS. The p-value
is bounded from above (Markov) by the likelihood ratio over the battery's own p-value: likelihood
under ordinary text, in upper case or in mixed, over that of a uniform draw from the alphabet,
over the Bonferroni p-value of the four tests, so that a token counts for less the less it
looks like a draw. Tokens that the battery rejects get p = 1. The Benjamini-Hochberg
procedure at FDR is run over all tokens of the corpus in each band of lengths, on
p-values rounded up to a fixed grid, so that its input is a histogram of at most
BANDS x GRID rows.

Defined cases. Null or empty text: no spans. Repeated rows each give their row.
Very long texts are scanned whole, those with very many matches too: offsets are running totals
in two levels, what touches a base span is found by halving, and masks are joined once. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.storage import documents, materialize

#: The base patterns and least lengths (of group 2, or of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}=*"
BREAK = "[/_-]"
#: Least length of each band in which false discoveries are controlled.
BANDS = (MIN_TOKEN, 20, 28, 40, 64, 128)
BATTERY, FDR = 0.01, 0.01
#: p-values are rounded up to exp(-k / STEP), k = 0 .. GRID - 1.
STEP, GRID = 4.0, 400

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: pattern of the whole token without padding, alphabet in code order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGIT + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGIT + "ABCDEF"),
    ("base26", "^[a-z]+$", LOWER),
    ("BASE26", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", DIGIT + LOWER),
    ("BASE36", "^[A-Z0-9]+$", DIGIT + UPPER),
    ("base52", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGIT + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGIT + "-_"),
)
#: Ordinary text: for the start of a word and then each letter, a character for each next letter,
#: 10 times the negative logarithm of its probability above "0". From words of English documents and code;
#: 15 % is spread evenly, so that letters of other languages cost at most 5.1.
BIGRAMS = (
    r"LTLNMMWVO`\QPMQN`LFIVXT`\a"
    r"[TMOW\U_Pc[FKG\ScFKDWW]ZXc"
    r"G_SXE^_^KHbE\ZKXcNPVFabaOb"
    r"HaY]E]`IPbLJZZA\bQWESaab_c"
    r"I\YP;Z^_DabT]YL]cSOUN```[c"
    r"O^MLQOY_Yc`GSGZT]EHI]Z\OZc"
    r"IaZ[ML__@cbN\XA]bHRQMbab[c"
    r"R_\]=^WPIcbOYKS[cMDUK]aba`"
    r"Ba^]:^`_GcbZ\ZG_cSXRYbbb_c"
    r"TWNSQTS`[c_KM?IUcRIH_VbYbX"
    r"QaW\9^`^VcX[^YC[cXTXGbab_c"
    r"N]XU:\Y_JcbM\PVXbVGWV`Ob`c"
    r"I^\SAD__FcaK_YJZcZLOP``bSb"
    r"CR]Y=^\`Mc`XTZGGcZQVTbab_c"
    r"I`MGEVH_Qc[X^VGYcZKESY`b[c"
    r"WSQKUXZ`Vb\RNATNcCPJLXT`ab"
    r"D`ZYC\`[Nc`I^ZHOcFTIR]_bQc"
    r"W]ZWTY^^XbbQZUWXbRSM6a_a`c"
    r"H_VV?[Q_JcZXTLH\cNNMT]_bTc"
    r"RaT]<]\RJc[W[YQQbYJBP`^bVc"
    r"JaXZC[`AFcbW[ZOYcIOQLa\aRb"
    r"UTUXGVZ`QcbHLGYOcCIG]bb_ac"
    r">`]]9^_^Hcb\YYU^cZZY^a`bac"
    r"D\\VJ\`E@cbV_OH^bGQX_a\`ac"
    r"M]C\IY`]IcbUX[XGcUU>]aaYZb"
    r"YZXZKY^^PcbTRPG@bSED^_Va_`"
    r"R`[]6^`^EcbTUWP\cXVX^aab]`"
)
#: Probabilities of the next class (lower, upper, digit, symbol) after each, in mixed and in upper case.
CLASSES = (
    ((0.85, 0.05, 0.05, 0.05), (0.4, 0.5, 0.05, 0.05), (0.1, 0.1, 0.7, 0.1), (0.4, 0.2, 0.3, 0.1)),
    ((0.4, 0.5, 0.05, 0.05), (0.05, 0.85, 0.05, 0.05), (0.1, 0.1, 0.7, 0.1), (0.1, 0.5, 0.3, 0.1)),
)
MARK = "\x01"

SPAN = "struct<start: int, kind: int, end: int>"
TOKEN_SPAN = f"struct<span: {SPAN}, token: string>"
#: Values of a level of a running total, and code points of a block of a text that is cut at many places.
SCAN, BLOCK = 128, 512


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, op, start: int) -> Column:
    """``op`` over the values before each, from ``start``, in two levels of SCAN values: an array that grows by one is copied at every step."""

    def over(x: Column, first: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(x, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def inner(x: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SCAN).cast("int"))
        return _bound(F.transform(cuts, lambda c: F.slice(x, c * SCAN + 1, SCAN)), outer)

    def outer(parts: Column) -> Column:
        whole = F.transform(parts, lambda part: F.aggregate(part, F.lit(start), op))
        return _bound(over(whole, F.lit(start)), lambda at: F.flatten(F.transform(parts, lambda part, k: over(part, F.get(at, k)))))

    return _bound(values, lambda x: F.when(F.size(x) > 0, inner(x)).otherwise(F.array().cast("array<int>")))


def _lengths_before(parts: Column) -> Column:
    return _before(F.transform(parts, lambda x: F.length(x)), lambda a, b: a + b, 0)


def _matches(text: Column, pattern: str, kind: int, keep, token: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` accepts; with ``token``, structs of span and token."""
    clean = F.translate(text, MARK, "\x02")
    parts = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def found(parts: Column, at: Column) -> Column:
        def match(x: Column, k: Column) -> Column:
            start = F.get(at, k)
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x)).alias("end"))
            return F.when((k % 2 == 1) & keep(x), F.struct(span.alias("span"), x.alias("token")) if token else span)

        return F.filter(F.transform(parts, match), lambda s: s.isNotNull())

    some = _bound(parts, lambda x: _bound(_lengths_before(x), lambda at: found(x, at)))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(f"array<{TOKEN_SPAN if token else SPAN}>"))


def base_spans(text: Column) -> list[Column]:
    """Spans of assign, access and hex."""
    return [
        _matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN),
        # maximal runs of one class: asking for the least length in the pattern drops the same matches
        _matches(text, ACCESS[:-1] + f"{{{MIN_ACCESS - 4},}}", 1, lambda m: F.lit(True)),
        _matches(text, HEX[:-1] + f"{{{MIN_HEX},}}", 2, lambda m: F.lit(True)),
    ]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic approximation (absolute error below 2e-4)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x) by Wilson and Hilferty."""
    v = 2.0 / (9.0 * df)
    return _upper_tail((F.pow(x / df, F.lit(1.0 / 3.0)) - (1.0 - v)) / F.sqrt(v))


def _count(token: Column, characters: str) -> Column:
    return F.length(token) - F.length(F.translate(token, characters, ""))


def _spelling(table) -> Column:
    """Negative logarithm of the probability of the classes in column kinds, the first at 1/4."""
    steps = ",".join(f"{-math.log(p)}D" for row in table for p in row)
    return F.expr(f"aggregate(sequence(1, greatest(1, size(kinds) - 1)), {math.log(4)}D, (s, i) -> s + if(i < size(kinds), array({steps})[4 * kinds[i - 1] + kinds[least(i, size(kinds) - 1)]], 0D))")


def scored(tokens: DataFrame) -> DataFrame:
    """``tokens`` (column token) with band and grid (the p-value is exp(-grid / STEP), rounded up).

    Evaluated as columns on rows of their own, so nothing is computed twice.
    """
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        encoding = F.when(F.col("body").rlike(pattern), name).otherwise(encoding)
    alphabet = F.lit("")
    for name, _, letters in ENCODINGS:
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    x = tokens.withColumn("body", body).withColumn("encoding", encoding).withColumn("alphabet", alphabet)
    x = x.withColumn("n", F.length("body").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    x = x.withColumn("codes", F.expr("transform(split(body, ''), c -> double(instr(alphabet, c) - 1))"))
    x = x.withColumn("squares", F.expr("aggregate(split(alphabet, ''), 0D, (s, c) -> s + pow(length(body) - length(replace(body, c, '')), 2))"))
    classes = [(_count(F.col("body"), s), _count(F.col("alphabet"), s)) for s in (LOWER, UPPER, DIGIT, "+/-_")]
    class_chi, class_df = F.lit(0.0), F.lit(-1.0)
    for seen, size in classes:
        expected = F.col("n") * size / F.col("k")
        class_chi = class_chi + F.when(size > 0, F.pow(seen - expected, F.lit(2.0)) / F.greatest(expected, F.lit(1e-9))).otherwise(0.0)
        class_df = class_df + (size > 0).cast("double")
    x = x.withColumn("class_chi", class_chi).withColumn("class_df", class_df)
    x = x.withColumn("high", F.expr("transform(codes, c -> c >= k / 2)"))
    x = x.withColumn("n1", F.expr("double(size(filter(high, h -> h)))")).withColumn("n0", F.col("n") - F.col("n1"))
    x = x.withColumn("runs", F.expr("1D + size(filter(sequence(1, greatest(1, size(high) - 1)), i -> i < size(high) and high[i] != high[i - 1]))"))
    x = x.withColumn("mean", F.expr("aggregate(codes, 0D, (s, c) -> s + c) / greatest(n, 1D)"))
    x = x.withColumn("spread", F.expr("aggregate(codes, 0D, (s, c) -> s + (c - mean) * (c - mean))"))
    x = x.withColumn("lagged", F.expr("aggregate(sequence(1, greatest(1, size(codes) - 1)), 0D, (s, i) -> s + if(i < size(codes), (codes[i] - mean) * (codes[i - 1] - mean), 0D))"))
    kind = F.expr("transform(split(body, ''), c -> case when c between 'a' and 'z' then 0 when c between 'A' and 'Z' then 1 when c between '0' and '9' then 2 else 3 end)")
    x = x.withColumn("kinds", kind)
    costs = F.expr("array(" + ",".join(f"{(ord(c) - 48) / 10}D" for c in BIGRAMS) + ")")
    # letters by the one before, where that is a letter
    x = x.withColumn("letters", F.expr(f"transform(split(lower(body), ''), c -> instr('{LOWER}', c))")).withColumn("costs", costs)
    x = x.withColumn("spelled", F.expr("aggregate(sequence(0, greatest(0, size(letters) - 1)), 0D, (s, i) -> s + if(letters[i] > 0, costs[26 * if(i > 0, letters[greatest(0, i - 1)], 0) + letters[i] - 1], 0D))")).drop("costs")
    written = [_spelling(table) for table in CLASSES]
    x = x.withColumn("classed", F.least(*written))
    ordinary = F.col("spelled") + F.col("classed") + F.log(F.lit(10.0)) * _count(F.col("body"), DIGIT) + F.log(F.lit(4.0)) * _count(F.col("body"), "+/-_")
    p_symbols = _chi_tail(F.greatest(F.lit(1e-9), F.col("k") / F.col("n") * F.col("squares") - F.col("n")), F.col("k") - 1)
    p_classes = F.when(F.col("class_df") > 0, _chi_tail(F.greatest(F.lit(1e-9), F.col("class_chi")), F.greatest(F.col("class_df"), F.lit(1.0)))).otherwise(1.0)
    expected = 1.0 + 2.0 * F.col("n1") * F.col("n0") / F.col("n")
    variance = F.greatest(F.lit(1e-9), (expected - 1.0) * (expected - 2.0) / (F.col("n") - 1.0))
    p_runs = 2.0 * _upper_tail(F.abs(F.col("runs") - expected) / F.sqrt(variance))
    correlation = F.col("lagged") / F.greatest(F.col("spread"), F.lit(1e-9))
    p_serial = 2.0 * _upper_tail(F.abs(correlation + 1.0 / F.col("n")) * F.sqrt("n"))
    x = x.withColumn("p_random", 4.0 * F.least(p_symbols, p_classes, p_runs, p_serial))
    ratio = ordinary - F.col("n") * F.log(F.greatest(F.col("k"), F.lit(1.0)))
    evidence = F.greatest(F.lit(0.0), ratio + F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), F.col("p_random")))))
    fine = F.col("encoding").isNotNull() & (F.col("n") >= MIN_TOKEN) & (F.col("p_random") >= BATTERY)
    grid = F.when(fine, F.least(F.lit(GRID - 1), F.floor(evidence * STEP))).otherwise(0).cast("int")
    band = F.lit(0)
    for n, least in enumerate(BANDS[1:], 1):
        band = F.when(F.length("token") >= least, n).otherwise(band)
    return x.select(*tokens.columns, band.alias("band"), F.coalesce(grid, F.lit(0)).alias("grid"))


def thresholds(tokens: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """band -> least grid value that is a discovery. Reads a histogram of at most len(BANDS) x GRID rows."""
    seen = tokens.groupBy("band", "grid").agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("band")
    ranked = seen.withColumn("m", F.sum("n").over(band)).withColumn("k", F.sum("n").over(band.orderBy(F.desc("grid"))))
    found = ranked.where((F.col("grid") > 0) & (F.exp(-F.col("grid") / STEP) <= fdr * F.col("k") / F.col("m")))
    return {r["band"]: r["least"] for r in found.groupBy("band").agg(F.min("grid").alias("least")).collect()}


def _pieces(run: Column) -> Column:
    """Structs of span and token: the pieces of MIN_TOKEN or more characters of a run between breaks."""

    def found(parts: Column, at: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            start = run["span"]["start"] + F.get(at, k) + k  # a break is one character
            span = F.struct(start.alias("start"), F.lit(3).alias("kind"), (start + F.length(x)).alias("end"))
            return F.when(F.length(F.rtrim(F.translate(x, "=", " "))) >= MIN_TOKEN, F.struct(span.alias("span"), x.alias("token")))

        return F.filter(F.transform(parts, piece), lambda s: s.isNotNull())

    return _bound(F.split(run["token"], BREAK, -1), lambda x: _bound(_lengths_before(x), lambda at: found(x, at)))


def _outermost(spans: Column) -> Column:
    """Spans without those that lie within another, where spans are apart or one within the other."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def found(x: Column, ends: Column) -> Column:
        span = lambda s, k: F.when(s["start"] >= F.get(ends, k), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end")))
        return F.filter(F.transform(x, span), lambda s: s.isNotNull())

    return _bound(ordered, lambda x: _bound(_before(F.transform(x, lambda s: -s["back"]), lambda a, b: F.greatest(a, b), 0), lambda ends: found(x, ends)))


def _strides(ordered: Column) -> Column:
    """Powers of two below the size, largest first."""
    return F.transform(F.sequence(F.floor(F.log2(F.size(ordered) + 1.0)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def _below(ordered: Column, value: Column, strides: Column) -> Column:
    """How many of increasing values are below ``value``, by strides that halve."""
    return F.aggregate(strides, F.lit(0), lambda at, k: F.when(F.get(ordered, at + k - 1) < value, at + k).otherwise(at))


def _apart(span: Column) -> Column:
    """No base span touches the span: as many begin before its end as end at its start or before."""
    below = lambda ordered, value: _below(F.col(ordered), value, F.col("strides"))
    return F.when(F.size("starts") == 0, True).otherwise(below("starts", span["end"]) == below("ends", span["start"] + 1))


def _scan(docs: DataFrame, row: Column) -> DataFrame:
    """row, assign, access, hex, base and candidates of every row. One pass over the text; ``row`` carries what the caller needs."""
    rows = docs.select(row.alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t"))
    spans = rows.select("row", "t", *[c.alias(k) for c, k in zip(base_spans(F.col("t")), KINDS)])
    spans = spans.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    spans = spans.withColumns({"starts": F.array_sort(F.col("base")["start"]), "ends": F.array_sort(F.col("base")["end"]), "strides": _strides(F.col("base"))})
    spans = spans.withColumn("runs", _matches(F.col("t"), TOKEN, 3, lambda m: F.lit(True), True))
    pieces = F.flatten(F.transform("runs", lambda r: F.when(r["token"].rlike(BREAK), _pieces(r)).otherwise(F.array().cast(f"array<{TOKEN_SPAN}>"))))
    candidates = F.filter(F.concat("runs", pieces), lambda r: _apart(r["span"]))
    return spans.withColumn("candidates", candidates).drop("t", "runs", "starts", "ends", "strides")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base spans and candidate tokens of every row."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return _scan(docs, docs["doc_id"].cast("long")).select(F.col("row").alias("doc_id"), *counts, "base", "candidates")


def random_spans(scanned: DataFrame) -> DataFrame:
    """(number, random): the spans of the tokens that are discoveries, for the rows (number, candidates) that have any."""
    tokens = scanned.select("number", F.explode("candidates").alias("c")).select("number", "c.span", "c.token")
    tokens = materialize(scored(tokens).drop("token"), "secret-tokens")
    hit = F.lit(False)
    for band, grid in thresholds(tokens).items():
        hit = hit | ((F.col("band") == band) & (F.col("grid") >= grid))
    return tokens.where(hit).groupBy("number").agg(F.collect_list("span").alias("found")).select("number", _outermost(F.col("found")).alias("random"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base (array), all_spans (array of start, kind, end)."""
    scanned = materialize(scan(docs).withColumn("number", F.monotonically_increasing_id()), "secrets")
    none = F.array().cast(f"array<{SPAN}>")
    return scanned.join(random_spans(scanned), "number", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", F.coalesce("random", none))).alias("all_spans")
    )


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return found_spans(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans")
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with sorted spans masked, those that touch a masked one with it. The text is cut to blocks once, and each stretch is taken from its own."""

    def found(spans: Column, ends: Column, blocks: Column) -> Column:
        def stretch(start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))

        pieces = F.transform(spans, lambda s, k: F.when(s["start"] >= F.get(ends, k), F.concat(stretch(F.get(ends, k), s["start"]), F.lit(mask))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), stretch(last, F.length(text)))

    ends = _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: _bound(ends, lambda at: found(spans, at, blocks)))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``, overlapping spans once; n_chars, where present, follows.

    Rows without candidate tokens are masked where they are; only the others meet
    the verdicts on their tokens in a join. The caller's row travels as one struct, so
    that no name of its columns can clash.
    """
    wide = materialize(_scan(docs, F.struct("*")).withColumn("number", F.monotonically_increasing_id()), "secrets-wide")
    none = F.array().cast(f"array<{SPAN}>")
    some = wide.where(F.size("candidates") > 0).join(random_spans(wide), "number", "left")
    some = some.select("row", F.array_sort(F.concat("base", F.coalesce("random", none))).alias("spans"))
    both = wide.where(F.size("candidates") == 0).select("row", F.col("base").alias("spans")).unionByName(some)
    hit, text = F.size("spans") > 0, F.col("row")["text"]
    both = both.withColumn("masked", F.when(hit, _masked(text.cast("string"), F.col("spans"), mask)))
    changed = {"text": F.when(hit, F.col("masked")).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("masked").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return both.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
