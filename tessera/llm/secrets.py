"""Secret scanning by patterns and a battery of randomness tests, in SQL functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import store

#: Fixed patterns of the base kinds, in their order, and the least length of what
#: must be that long: the second group, or the match (group 0).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 16 or more is what is left of all maximal runs once short ones are dropped.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets of the encodings that a candidate may be in, by code point order: it is
#: taken to be in the first whose pattern it matches.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower32": "234567abcdefghijklmnopqrstuvwxyz",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
    "mixed": "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Under ordinary text, neighbours differ in kind (lower, upper, digit, other) this often at most.
CHANGE = 0.12
PATTERNS = {"digits": "[0-9]+", "hex": "(?:[0-9a-f]+|[0-9A-F]+)", "lower": "[a-z]+", "upper": "[A-Z]+", "lower32": "[2-7a-z]+", "base32": "[2-7A-Z]+", "lower36": "[0-9a-z]+", "base36": "[0-9A-Z]+", "letters": "[A-Za-z]+", "base62": "[0-9A-Za-z]+", "base64": "[0-9A-Za-z+/]+", "base64url": "[0-9A-Za-z_-]+"}
#: A model of ordinary text. Shares of a to z in words; what follows what among lower,
#: upper, digit and other, the last row at the start; and vowels (first) and
#: consonants after a vowel, a consonant, and what is no letter. An ordinary
#: number is short: a digit follows a digit three times of four.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 30, 40, 125, 15, 20, 35, 72, 4, 9, 45, 28, 70, 70, 22, 4, 64, 66, 72, 34, 11, 13, 4, 14, 6), strict=True))
FOLLOWS = ((0.85, 0.04, 0.03, 0.08), (0.35, 0.5, 0.05, 0.1), (0.05, 0.05, 0.75, 0.15), (0.5, 0.2, 0.2, 0.1), (0.6, 0.2, 0.15, 0.05))
VOWELS = "aeiou"
VOICES = ((0.15, 0.85), (0.55, 0.45), (0.4, 0.6))
#: Bins of -ln p, so that a table of counts has a fixed size: BINS for each length class.
BINS, STEP = 400, 0.25


#: Elements of an array that a fold builds up at a time.
STRIDE = 128


def let(value: Column, body) -> Column:
    """body(value), with `value` evaluated once: Spark evaluates an expression inside a lambda for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built(items: Column, first: Column, item: str, step) -> Column:
    """An array of what `step(state, x)` gives, a struct of `state` and `item`, for
    each x of `items` in turn from the state `first` on. A fold that appends
    copies what it has each time: it is done by strides, so that the time is in
    proportion to the length but for its square over STRIDE^2."""
    empty = F.expr(f"cast(array() as array<{item}>)")

    def fold_one(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("state"), empty.alias("out")), lambda acc, x: let(step(acc["state"], x), lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], F.array(y["item"])).alias("out"))))

    def all_parts(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRIDE).cast("int")), lambda k: F.slice(x, k * STRIDE + 1, STRIDE))
        nested = F.expr(f"cast(array() as array<array<{item}>>)")
        whole = F.aggregate(parts, F.struct(first.alias("state"), nested.alias("out")), lambda acc, part: let(fold_one(acc["state"], part), lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], F.array(y["out"])).alias("out"))))
        return F.flatten(whole["out"])

    return F.when(F.size(items) > 0, let(items, all_parts)).otherwise(empty)


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, match>>: the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "struct<start:int,match:string>"

    # A match stands behind its gap; the last gap has none.
    def step(at: Column, x: Column) -> Column:
        start = at + F.char_length(x["gap"])
        return F.struct((start + F.coalesce(F.char_length(x["match"]), F.lit(0))).alias("state"), F.struct(start.alias("start"), x["match"].alias("match")).alias("item"))

    walk = F.filter(built(F.arrays_zip(gaps.alias("gap"), found.alias("match")), F.lit(0), kind, step), lambda m: m["match"].isNotNull())
    return F.when(text.rlike(pattern), walk).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def spans_of(matches: Column, kind: int) -> Column:
    """array<struct<start, kind, end>>, which sorts by start, then kind."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["match"])).alias("end")))


def two_sided(z: Column) -> Column:
    """The chance of a standard normal beyond |z|, within 2e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def combined(*p: Column) -> Column:
    """Cauchy's combination of p-values."""
    # Near 0, the tangent's pole is 1 / (pi p), and the arctangent's tail likewise.
    score = sum(F.tan((0.5 - F.least(F.greatest(x, F.lit(1e-15)), F.lit(1 - 1e-6))) * math.pi) for x in p) / len(p)
    return F.when(score > 1e6, 1 / (score * math.pi)).otherwise(0.5 - F.atan(score) / math.pi)


def emissions() -> list[float]:
    """ln of the share of a to z, each among the vowels or the consonants."""
    of = {v: sum(n for c, n in LETTERS.items() if (c in VOWELS) == v) for v in (True, False)}
    return [math.log(n / of[c in VOWELS]) for c, n in LETTERS.items()]


def transitions() -> list[float]:
    """ln of the chance of each state after each, by seven: lower, upper (a vowel,
    a consonant each), digit and other; and after the start, the last."""
    states = ((0, 0), (0, 1), (1, 0), (1, 1), (2, None), (3, None))
    return [math.log(FOLLOWS[kind][to] * (1 if voice is None else VOICES[2 if before is None else before][voice])) for kind, before in (*states, (4, None)) for to, voice in states]


def fold(values: Column, step) -> Column:
    return F.aggregate(values, F.lit(0.0), step)


def battery(matches: Column) -> Column:
    """For each candidate: start, end, length class, and two bins of p-values,
    `uneven` and `bin`.

    The battery tests that a candidate is a random string over the alphabet of its
    encoding: chi-squared of the symbol counts with its exact multinomial moments,
    runs above and below the middle of the alphabet, and lag-one serial
    correlation. Cauchy's combination of the three, which holds however they
    depend on each other, is one p-value: `uneven` is its bin.

    `bin` is that of the p-value under ordinary text: twice the less of two, each
    of which tightens with the length. Under ordinary text, the number of changes
    of character kind is binomial with a rate of CHANGE at most, of which
    Chernoff's bound gives one. The other is the chance of the string under the
    model of ordinary text, over its chance as a random string of its encoding,
    all encodings being as likely: by Markov's inequality ordinary text gets
    below p no more often than p. It finds keys of letters or digits alone.
    """

    letters = F.lit("".join(LETTERS))
    shares = F.lit(emissions())
    follows = F.lit(transitions())

    def name(m: Column) -> Column:
        out = F.lit("mixed")
        for kind, pattern in reversed(PATTERNS.items()):
            out = F.when(m.rlike(f"^{pattern}$"), kind).otherwise(out)
        return out

    def coded(m: Column) -> Column:
        body = F.rtrim(m["match"], F.lit("="))
        kind = name(body)
        alphabet = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))[kind]
        plain = F.when(kind == "hex", F.lower(body)).otherwise(body)
        chars = F.filter(F.split(plain, ""), lambda c: c != "")
        raw = F.filter(F.split(body, ""), lambda c: c != "")
        return F.struct(
            m["start"].alias("start"),
            (m["start"] + F.char_length(m["match"])).alias("end"),
            F.char_length(alphabet).cast("double").alias("k"),
            F.transform(chars, lambda c: F.position(c, alphabet).cast("double") - 1).alias("v"),
            F.transform(raw, lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)).alias("kinds"),
            F.transform(raw, lambda c: F.when(c.rlike("[aeiou]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[AEIOU]"), 2).when(c.rlike("[A-Z]"), 3).when(c.rlike("[0-9]"), 4).otherwise(5)).alias("states"),
            fold(raw, lambda a, c: a + F.when(c.rlike("[A-Za-z]"), F.get(shares, F.position(F.lower(c), letters) - 1)).when(c.rlike("[0-9]"), -math.log(10)).otherwise(-math.log(5))).alias("emitted"),
        )

    # Each step's results are fields that the next step's lambdas read: Spark
    # evaluates an expression inside a lambda for every element.
    def summed(x: Column) -> Column:
        v = x["v"]
        n = F.size(v).cast("double")
        return F.struct(
            *(x[c].alias(c) for c in ("start", "end", "k", "v")),
            n.alias("n"),
            (fold(v, lambda a, y: a + y) / n).alias("average"),
            fold(F.array_distinct(v), lambda a, s: a + F.pow(F.size(F.filter(v, lambda y: y == s)).cast("double"), F.lit(2.0))).alias("squares"),
            F.transform(v, lambda y: (y > (x["k"] - 1) / 2).cast("int")).alias("high"),
            neighbours(x["kinds"], lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0)).alias("changes"),
            (x["emitted"] + F.get(follows, 36 + F.get(x["states"], F.lit(0))) + neighbours(x["states"], lambda p: F.get(follows, 6 * p["a"] + p["b"]))).alias("ordinary"),
        )

    def neighbours(a: Column, step) -> Column:
        n = F.size(a) - 1
        return fold(F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(a, 2, n).alias("b")), lambda total, p: total + step(p))

    def measured(x: Column) -> Column:
        return F.struct(
            *(x[c].alias(c) for c in ("start", "end", "k", "n", "squares", "changes", "ordinary")),
            fold(x["high"], lambda a, y: a + y).alias("n1"),
            (1 + neighbours(x["high"], lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0))).alias("runs"),
            fold(x["v"], lambda a, y: a + (y - x["average"]) * (y - x["average"])).alias("power"),
            neighbours(x["v"], lambda p: (p["a"] - x["average"]) * (p["b"] - x["average"])).alias("shared"),
        )

    def tested(x: Column) -> Column:
        n, k, n1 = x["n"], x["k"], x["n1"]
        n0 = n - n1
        chi = k / n * x["squares"] - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mean = 2 * n1 * n0 / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (x["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(40.0))
        z_serial = F.when(x["power"] > 0, (x["shared"] / F.greatest(x["power"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
        rate = x["changes"] / (n - 1)
        clipped = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
        surprise = F.when(rate > CHANGE, (n - 1) * (clipped * F.log(clipped / CHANGE) + (1 - clipped) * F.log((1 - clipped) / (1 - CHANGE)))).otherwise(F.lit(0.0))
        likelier = -n * F.log(k) - math.log(len(ALPHABETS)) - x["ordinary"]
        surprise = F.greatest(F.greatest(surprise, likelier) - math.log(2), F.lit(0.0))
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.floor(F.log2(n)).cast("int").alias("length"),
            F.least(F.floor(surprise / STEP), F.lit(BINS - 1)).cast("int").alias("bin"),
            F.least(F.floor(-F.log(combined(two_sided(z_chi), two_sided(z_runs), two_sided(z_serial))) / STEP), F.lit(BINS - 1)).cast("int").alias("uneven"),
        )

    long_enough = F.filter(F.transform(matches, coded), lambda x: F.size(x["v"]) >= 20)
    return F.transform(F.transform(F.transform(long_enough, summed), measured), tested)


def thresholds(scanned: DataFrame, rate: float) -> dict[str, dict[int, int]]:
    """For `uneven` and `bin`: length class -> the least bin at which its candidates
    are discoveries, by Benjamini and Hochberg's rule at `rate` within the class,
    over all documents. The driver gets a row for each class that has a
    discovery: some 60 at most."""
    from pyspark.sql import Window

    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"c.{k}").alias("bin")) for k in ("uneven", "bin"))))
    counts = scanned.select(F.explode("candidates").alias("c")).select("c.length", kinds.alias("k")).groupBy("length", "k.kind", "k.bin").agg(F.count("*").alias("n"))
    within = Window.partitionBy("length", "kind")
    ranked = counts.select("length", "kind", "bin", F.sum("n").over(within.orderBy(F.col("bin").desc())).alias("rank"), F.sum("n").over(within).alias("m"))
    # A bin's largest p-value is exp(-bin * STEP).
    passing = ranked.where(F.exp(-F.col("bin") * STEP) <= F.lit(rate) * F.col("rank") / F.col("m"))
    out: dict[str, dict[int, int]] = {"uneven": {}, "bin": {}}
    for r in passing.groupBy("length", "kind").agg(F.min("bin").alias("bin")).collect():
        out[r.kind][r.length] = r.bin
    return out


def scan(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, the `keep` columns, and found, an array of
    struct<start, kind, end> sorted by start and kind (an index of KINDS), in code
    points of the whole text.

    Base kinds are pattern matches. The method adds `random` spans, from runs of 20
    or more characters of the usual encodings, by two false-discovery controls at
    `rate` within their length class: the candidates whose randomness the combined
    battery rejects go, and of the p-values under ordinary text those that pass
    are reported. Runs that overlap a base span are not repeated.

    A null text counts as empty and has no spans. Rows without an id and repeated
    rows come out each. An empty table gives no rows. `keep` must not name doc_id
    or found; other columns are ignored.
    """
    if clash := {"doc_id", "found"} & {c.lower() for c in keep}:
        raise ValueError(f"keep: {sorted(clash)} are columns of the result")
    # Names inside, whatever the documents' columns are called.
    kept = {c: f"kept_{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(k) for c, k in kept.items()), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matches = rows.select("doc_id", *kept.values(), *(find(F.col("text"), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("coded", CANDIDATE))))
    base = F.array_sort(
        F.concat(
            spans_of(F.filter("assign", lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 12), 0),
            spans_of(F.filter("access", lambda m: F.char_length(m["match"]) >= 18), 1),
            spans_of(F.col("hex"), 2),
        )
    )
    scanned = store(matches.select("doc_id", *kept.values(), base.alias("base"), battery(F.col("coded")).alias("candidates")), "scanned")
    least = thresholds(scanned, rate)
    passing = F.filter(
        "candidates",
        lambda c: ~F.coalesce(c["uneven"] >= _limit(c["length"], least["uneven"]), F.lit(False)) & F.coalesce(c["bin"] >= _limit(c["length"], least["bin"]), F.lit(False)) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    added = F.transform(passing, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    found = scanned.select("doc_id", *kept.values(), F.array_sort(F.concat("base", added)).alias("spans"))
    return found.select("doc_id", *(F.col(k).alias(c) for c, k in kept.items()), F.col("spans").alias("found"))


def _limit(length: Column, least: dict[int, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in sorted(least.items()):
        out = F.when(length == k, v).otherwise(out)
    return out


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what `scan` found."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), count(3).alias("n_random"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with every span, or run of overlapping spans, replaced by `mask`."""

    # What stands before each span that starts behind all before it, and the mask; null for the others.
    def step(at: Column, s: Column) -> Column:
        out = F.when(s["start"] >= at, F.concat(text.substr(at + 1, s["start"] - at), F.lit(mask)))
        return F.struct(F.greatest(at, s["end"]).alias("state"), out.alias("item"))

    parts = F.filter(built(spans, F.lit(0), "string", step), lambda x: x.isNotNull())
    rest = text.substr(F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
