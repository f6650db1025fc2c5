"""Document fingerprints by SpotSigs, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed anchors: the most common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were what which with you "
    "aber als auch auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von war wie zu "
    "au avec ce dans de du elle en est et il la le les mais ne ou par pas pour que qui se sur un une "
    "al como con del el ella las lo los más no para pero por su sus y"
).split()
#: Sizes of signature sets within one class differ by less than this factor.
CLASS_RATIO = 1.25
FEW = 12


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_anchor(word: Column) -> Column:
    return word.isin(ANCHORS)


def spots(own: Column, flags: Column, content: Column) -> Column:
    """A signature for each anchor among the words `own`: the anchor and the two
    next words that are no anchors, which are those of `content`."""
    at = F.filter(F.transform(flags, lambda f, i: F.when(f, i).otherwise(-1)), lambda i: i >= 0)
    # j anchors stand before the one at i, so i - j other words do.
    found = F.transform(at, lambda i, j: F.when(F.get(content, i - j + 1).isNotNull(), F.xxhash64(F.get(own, i), F.get(content, i - j), F.get(content, i - j + 1))))
    return F.filter(found, lambda x: x.isNotNull())


def chains(own: Column, flags: Column) -> Column:
    """A signature for each word far from anchors, before which none stands within
    three words: the word and the two next. So lists and tables of rare words,
    where no spot starts, are described too, whatever the rest of a text is like."""

    def chain(word: Column, i: Column) -> Column:
        near = F.get(flags, i) | F.coalesce(F.get(flags, i - 1), F.lit(False)) | F.coalesce(F.get(flags, i - 2), F.lit(False)) | F.coalesce(F.get(flags, i - 3), F.lit(False))
        return F.when(~near & F.get(own, i + 2).isNotNull(), F.xxhash64(word, F.get(own, i + 1), F.get(own, i + 2)))

    return F.filter(F.transform(own, chain), lambda x: x.isNotNull())


def without(own: Column, flags: Column) -> Column:
    """The words that aren't flagged."""
    return F.filter(own, lambda w, i: ~F.get(flags, i))


def first_of_runs(ordered: Column) -> Column:
    """Where each run of equal elements of a sorted array begins."""
    return F.filter(F.transform(ordered, lambda h, i: F.when((i > 0) & (F.get(ordered, i - 1) == h), -1).otherwise(i)), lambda i: i >= 0)


def numbered(ordered: Column, first: Column) -> Column:
    """32 bits for each element of a sorted array whose runs begin at `first`: the
    k-th occurrences of a signature are told apart, so that sets of these compare
    as multisets."""

    def run(at: Column, j: Column) -> Column:
        h = F.get(ordered, at)
        last = F.coalesce(F.get(first, j + 1), F.size(ordered)) - at - 1
        return F.when(last == 0, F.array(F.xxhash64(h, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(h, k)))

    return F.transform(F.flatten(F.transform(first, run)), lambda h: F.shiftrightunsigned(h, 32))


def trigrams(text: Column) -> Column:
    last = F.greatest(F.lit(1), F.char_length(text) - 2)
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(text, i, F.lit(3))))


def with_signatures(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`rows` with the texts in `columns` replaced by their sorted 32-bit
    signatures, a multiset: of their spots and of chains far from anchors; with
    fewer than FEW words also of each word; and with fewer than three words, of
    each run of three characters.

    What a lambda reads again and again is a column of its own first: Spark
    evaluates an expression inside a lambda for every element.
    """
    name = lambda c, part: F.col(f"{c}__{part}")
    rows = rows.withColumns({f"{c}__words": words(F.col(c)) for c in columns})
    rows = rows.withColumns({f"{c}__flags": F.transform(name(c, "words"), is_anchor) for c in columns})
    rows = rows.withColumns({f"{c}__content": without(name(c, "words"), name(c, "flags")) for c in columns})
    rows = rows.withColumns({f"{c}__spots": F.concat(spots(name(c, "words"), name(c, "flags"), name(c, "content")), chains(name(c, "words"), name(c, "flags"))) for c in columns})
    none = F.array().cast("array<bigint>")
    few = lambda a, n, more: F.when(F.size(a) < n, more).otherwise(none)
    found = {
        c: F.concat(
            name(c, "spots"),
            few(name(c, "words"), FEW, F.transform(name(c, "words"), lambda w: F.xxhash64(w))),
            few(name(c, "words"), 3, F.when(F.col(c) != "", trigrams(F.col(c))).otherwise(none)),
        )
        for c in columns
    }
    rows = rows.withColumns({f"{c}__sorted": F.array_sort(found[c]) for c in columns})
    rows = rows.withColumns({f"{c}__first": first_of_runs(name(c, "sorted")) for c in columns})
    rows = rows.withColumns({c: F.array_sort(F.array_distinct(numbered(name(c, "sorted"), name(c, "first")))) for c in columns})
    return rows.drop(*(f"{c}__{part}" for c in columns for part in ("words", "flags", "content", "spots", "sorted", "first")))


def length_class(signature_set: Column) -> Column:
    """The class of a set's size: sets whose likeness can reach 1 / CLASS_RATIO are
    in the same or neighbouring classes."""
    n = F.size(signature_set)
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS_RATIO)))).otherwise(-1).cast("int")


def fingerprint(signature_set: Column) -> Column:
    """Length class and the whole set, in hexadecimal: nothing is sampled away."""
    digits = F.transform(signature_set, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0"))
    return F.concat_ws(":", length_class(signature_set).cast("string"), F.array_join(digits, ""))


def likeness(a: Column, b: Column, least: float = 0.05) -> Column:
    """Jaccard likeness of two signature sets; 0 where their classes alone show that
    it is below `least`, without a look at the sets. Two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    bound = F.pow(F.lit(CLASS_RATIO), 1.0 - F.abs(length_class(a) - length_class(b)))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | (bound < least), F.lit(0.0)).otherwise(shared / (n + m - shared))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 500) -> DataFrame:
    """(doc_id, text, own, next_text, next_own): text and signatures of each document
    and of the next in ascending id order, the first's after the last. Rows without an id come first; rows that
    share one are ordered by their text.

    The ids are cut into ranges at percentiles, which are ids of the table; each
    range's first document is also a guest of the range before, and the very
    first of the last, so one shuffle brings every document beside its next.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, first = rows.agg(F.count("*"), F.min("k")).first()
    count = int(min(1 << 14, n // rows_per_range))
    cuts: list[int] = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        cuts = sorted({x for x in rows.agg(F.percentile_approx("k", shares, max(10_000, 20 * count))).first()[0] if x > first})
    step = 128
    coarse, fine = F.array(*map(F.lit, cuts[::step])).cast("array<bigint>"), F.array(*map(F.lit, cuts)).cast("array<bigint>")
    group = F.size(F.filter(coarse, lambda c: c <= F.col("k")))
    within = F.slice(fine, F.greatest(group - 1, F.lit(0)) * step + 1, step)
    bucket = F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(within, lambda c: c <= F.col("k"))))
    signed = with_signatures(rows.withColumn("own", F.col("text")), ("own",))
    placed = signed.withColumn("bucket", bucket.cast("int")).withColumn("cut", F.array_contains(within, F.col("k")))
    none = F.lit(None).cast("struct<bucket:int,guest:int>")
    homes = F.array(
        F.struct(F.col("bucket"), F.lit(0).alias("guest")),
        F.when(F.col("cut") & (F.col("bucket") > 0), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("guest"))).otherwise(none),
        F.when(F.col("k") == F.lit(first), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("guest"))).otherwise(none),
    )
    dealt = placed.select("doc_id", "k", "text", "own", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("home")).select("doc_id", "k", "text", "own", "home.*")
    window = Window.partitionBy("bucket").orderBy("guest", "k", "text")
    beside = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in ("text", "own")})
    return beside.where("guest = 0").select("doc_id", "text", "own", "next_text", "next_own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document's. near_edited and near_next are
    the likeness of the document's fingerprint to that of its edited text and of
    the next document, exact however small. Equal texts have equal fingerprints.

    A null text counts as empty, whose fingerprint is that of the empty set; two
    such are alike. Repeated rows come out each. An empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    texts = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    sets = with_signatures(texts.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), ("edited",))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), 0.0).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), 0.0).alias("near_next"),
    )
