"""Class-based n-gram language model with Brown exchange clustering."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, remove, store
from tessera.llm.tokens import pieces_of

#: Words with LEAST or more occurrences are clustered by themselves; fewer say too
#: little about a word's class. The most frequent of them, HEAD at most and no
#: longer than LONGEST bytes, are known to every worker; the others, in a table of
#: any size, get their symbols by a join. The model is the same either way.
HEAD = 1 << 19
LEAST = 5
#: Symbols, the most frequent ones, whose contexts a task adds up in a table: 32 MB.
DENSE = 1 << 16
#: Partial counts of a block that are added up by one task.
PARTS = 16
#: All other words enter the clustering by the group of their last two bytes.
GROUPS = 1024
LONGEST = 64
CLASSES = 32
#: Sweeps, each over half of the symbols, end when two in turn move less than
#: SETTLED of all tokens, or after SWEEPS.
SWEEPS = 8
SETTLED = 0.05
BLOCK = 2048
#: Weight of the class unigrams in a transition, and a symbol's additive count.
TRANSITION, EMISSION = 10.0, 0.1


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all words of the rows' `text` bytes, A-Z in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(text.lower().split())  # on bytes, both know ASCII alone
                if len(found) > 300_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_TABLES: dict[str, dict[bytes, int]] = {}  # of the last model that this worker encoded for


def encode(rows: DataFrame, head) -> DataFrame:
    """(row, doc_id, fold, symbols, words, counts) of rows (doc_id, fold, text):
    symbols as int32 bytes, 0 for the end; and the document's different words
    that aren't of the head, with their counts. Word k of these has -k - 1 for a
    symbol as yet."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = {w: i + 1 for i, w in enumerate(head.value)}
        of = _TABLES[name].get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces_of(batch):
                symbols, words, counts = [], [], []
                for text in part.column(2).to_pylist():
                    own = text.lower().split()
                    found = np.fromiter(map(of, own, repeat(0)), "i4", len(own))
                    places: dict[bytes, int] = {}
                    other = np.flatnonzero(found == 0)
                    local = np.fromiter((places.setdefault(own[i], len(places)) for i in other.tolist()), "i4", len(other))
                    found[other] = -1 - local
                    symbols.append(np.append(found, np.int32(0)).tobytes())
                    words.append(list(places))
                    counts.append(np.bincount(local, minlength=len(places)).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(symbols))), part.column(0), part.column(1), pa.array(symbols, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))], names=["row", "doc_id", "fold", "symbols", "words", "counts"])
                row += len(symbols)

    return rows.mapInArrow(run, "row long, doc_id long, fold long, symbols binary, words array<binary>, counts array<int>")


def numbered(words: DataFrame, first: int) -> tuple[DataFrame, int]:
    """`words` with a `symbol` each, from `first` on without gaps; and their number."""
    kept = store(words.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "tail")
    # A row for each partition.
    offsets, n = [], 0
    for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect():
        offsets.append((r.part, first + n))
        n += r.n
    table = words.sparkSession.createDataFrame(offsets, "part int, offset long")
    return kept.join(F.broadcast(table), "part").withColumn("symbol", (F.col("at") + F.col("offset")).cast("int")).drop("part", "at", "offset"), n


def resolve(encoded: DataFrame, found: DataFrame) -> DataFrame:
    """`encoded` with the symbols of all words: `found` has, for each row with words
    outside the head, `pairs` of a word's place and its symbol, and sums that stay."""
    sums = [c for c in found.columns if c not in ("row", "pairs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, pairs in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = np.frombuffer(blob, "i4")
                if pairs.is_valid and len(pairs):
                    place, symbol = (c.to_numpy() for c in pairs.values.flatten())
                    table = np.zeros(len(place), "i4")
                    table[place] = symbol
                    x = np.where(x < 0, table[np.where(x < 0, -1 - x, 0)], x)
                out.append(x.astype("i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), *batch.columns[4:]], names=["doc_id", "fold", "symbols", *sums])

    joined = encoded.select("row", "doc_id", "fold", "symbols").join(found, "row", "left").select("doc_id", "fold", "symbols", "pairs", *(F.coalesce(c, F.lit(0)).alias(c) for c in sums))
    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "fold", "symbols", *sums)))


def small(classes: np.ndarray) -> np.ndarray:
    """Classes in as few bytes as hold them, to be sent."""
    return classes.astype(np.min_scalar_type(int(classes.max(initial=0))))


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts: gaps and counts by byte planes, of which all but the lowest are nearly empty."""
    planes = np.stack([np.diff(at, prepend=0).astype("<u8"), counts.astype("<u8")]).view("u1").reshape(-1, 8).T
    return len(at).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 16 * n, "zstd", asbytes=True), "u1").reshape(8, 2 * n)
    gaps, counts = np.ascontiguousarray(planes.T).view("<i8").reshape(2, n)
    return np.cumsum(gaps), counts


def followed(training: DataFrame) -> DataFrame:
    """(bigrams): the different bigrams among some million tokens each of all `training`
    symbols, first * 2^32 + second, with their counts. Sweeps read these, which don't
    change, and not the tokens. A document's first token follows an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held).astype("i8")
            at = np.r_[0, x[:-1]]  # every document ends in symbol 0
            at <<= 32
            at |= x
            return pa.RecordBatch.from_arrays([pa.array([packed(*np.unique(at, return_counts=True))], pa.binary())], names=["bigrams"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, "i4"))
                n += len(held[-1])
                if n > 1_000_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return training.select("symbols").mapInArrow(count, "bigrams binary")


def of_bigrams(training: DataFrame) -> DataFrame:
    """`training`, if it is what `followed` gives, or else that of it."""
    return training if training.columns == ["bigrams"] else followed(training)


def contexts(training: DataFrame, classes: np.ndarray, n_classes: int, dense: int) -> DataFrame:
    """The stored (block, counts), summed over all `training` symbols or bigrams: for each
    block of BLOCK symbols the classes that follow, the classes before, and the
    symbol's own repeats; block -1 holds the class bigrams.

    A task adds up the `dense` first symbols, a multiple of BLOCK, in a table, and
    sends what it finds of others a row of bigrams at a time, all without
    zeros. A block's partial counts are added up one after the other, in two
    levels where there are more than PARTS tasks, so no task meets them all."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast(small(classes))
    width = 2 * n_classes + 1
    names, kinds = ["block", "task", "counts"], "block int, task int, counts binary"

    def rows(task: int, blocks: list[int], counts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array(counts, pa.binary())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cls, task = sent.value, TaskContext.get().partitionId()
        flat = np.zeros(dense * width, "u4")
        pairs = np.zeros(n_classes * n_classes, "i8")

        def add(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
            prev, x = at >> 32, at & 0xFFFFFFFF
            a, b = cls[prev].astype("i8"), cls[x].astype("i8")
            np.add.at(pairs, a * n_classes + b, n)
            same = x == prev
            keys, counts = [], []
            for key, m in ((prev * width + b, n), (x * width + n_classes + a, n), (x[same] * width + 2 * n_classes, n[same])):
                low = key < len(flat)
                np.add.at(flat, key[low], m[low].astype("u4"))
                keys.append(key[~low])
                counts.append(m[~low])
            key, counts = np.concatenate(keys), np.concatenate(counts)
            if not len(key):
                return None
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, counts = key[start], np.add.reduceat(counts, start)
            block, at = np.divmod(key, BLOCK * width)
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            parts = [packed(at[i:j], counts[i:j]) for i, j in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True)]
            return rows(task, block[start].tolist(), parts)

        for batch in batches:
            for blob in batch.column(0):
                out = add(*unpacked(blob.as_py()))
                if out is not None:
                    yield out
        if pairs.any():
            yield rows(task, [-1], [packed(np.arange(len(pairs)), pairs)])
        for k in range(dense // BLOCK):
            own = flat[k * BLOCK * width : (k + 1) * BLOCK * width]
            at = np.flatnonzero(own)
            if len(at):
                yield rows(task, [k], [packed(at, own[at])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, total = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != block:
                    if block is not None:
                        at = np.flatnonzero(total)
                        yield rows(task, [block], [packed(at, total[at])])
                    block, total = k, np.zeros(n_classes * n_classes if k < 0 else BLOCK * width, "i8")
                at, counts = unpacked(blob.as_py())
                total[at] += counts
        if block is not None:
            at = np.flatnonzero(total)
            yield rows(task, [block], [packed(at, total[at])])

    training = of_bigrams(training)
    parts = training.mapInArrow(count, kinds)
    groups = -(-training.rdd.getNumPartitions() // PARTS)
    if groups > 1:
        parts = parts.repartition("block", F.col("task") % groups).sortWithinPartitions("block").mapInArrow(merge, kinds)
    out = store(parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, kinds).select("block", "counts"), "contexts")
    sent.destroy()
    return out


def class_bigrams(training: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """The class bigrams of all `training` symbols or bigrams: a row of n_classes^2 counts from each task, summed by class in SQL."""
    sent = training.sparkSession.sparkContext.broadcast(small(classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, pairs = sent.value, np.zeros(n_classes * n_classes, "i8")
        for batch in batches:
            for blob in batch.column(0):
                at, n = unpacked(blob.as_py())
                np.add.at(pairs, cls[at >> 32].astype("i8") * n_classes + cls[at & 0xFFFFFFFF], n)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["at", "n"])

    out = np.zeros(n_classes * n_classes, "i8")
    for r in of_bigrams(training).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    sent.destroy()
    return out.reshape(n_classes, n_classes)


def bigrams(stored: DataFrame, n_classes: int) -> np.ndarray:
    """The class bigrams among what `contexts` stored."""
    out = np.zeros(n_classes * n_classes, "i8")
    for r in stored.where("block = -1").collect():
        at, counts = unpacked(bytes(r.counts))
        out[at] = counts
    return out.reshape(n_classes, n_classes)


def xlogx(x: np.ndarray) -> np.ndarray:
    """For counts: 0 or from 1 on."""
    return x * np.log(np.maximum(x, 1))


def gains(pairs: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """The log likelihood, up to a constant, with each of some symbols, of classes
    `own`, moved to each class: exact, from the class bigrams and the symbols' class
    contexts, a row each."""
    m, n = after.shape
    k, repeats = np.arange(m), repeats.astype(float)
    after, before = after.astype(float), before.astype(float)
    after[k, own] -= repeats
    before[k, own] -= repeats
    rest = np.repeat(pairs[None].astype(float), m, 0)
    rest[k, own] -= after
    rest[k, :, own] -= before
    rest[k, own, own] -= repeats
    f = np.repeat(xlogx(pairs.astype(float))[None], m, 0)
    f[k, own] = xlogx(rest[k, own])
    f[k, :, own] = xlogx(rest[k, :, own])
    out = np.zeros((m, n))
    for met, axis in ((after, 2), (before, 1)):
        if 2 * np.count_nonzero(met) > met.size:
            rise = xlogx(rest + np.expand_dims(met, 3 - axis)) - f
        else:  # few classes are met; the others add nothing
            rise = np.zeros_like(rest)
            i, j = met.nonzero()
            at = (i, slice(None), j) if axis == 2 else (i, j)
            rise[at] = xlogx(rest[at] + met[i, j][:, None]) - f[at]
        out += rise.sum(axis)
    diagonal = rest.diagonal(0, 1, 2)
    r = repeats[:, None]
    # The symbol's class meets itself: that cell was counted in its row and its column.
    out += xlogx(diagonal + after + before + r) - xlogx(diagonal + after) - xlogx(diagonal + before) + f.diagonal(0, 1, 2)
    # A bigram of two members adds to the totals of the classes of both: those
    # beside the symbol gain `before` in their rows, `after` in their columns.
    rows, columns = rest.sum(2) + before, rest.sum(1) + after
    out -= xlogx(rows + after.sum(1, keepdims=True) + r) - xlogx(rows)
    out -= xlogx(columns + before.sum(1, keepdims=True) + r) - xlogx(columns)
    assert out.shape == (m, n)
    return out


def exchange(stored: DataFrame, classes: np.ndarray, n_classes: int, sweep: int) -> tuple[np.ndarray, int]:
    """Move half of the symbols, alternately, to their best classes; and the tokens that moved."""
    sent = stored.sparkSession.sparkContext.broadcast((bigrams(stored, n_classes), small(classes)))
    width = 2 * n_classes + 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, cls = sent.value
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.zeros(BLOCK * width, "i8")
                at, counts = unpacked(blob.as_py())
                rows[at] = counts
                rows = rows.reshape(BLOCK, width)
                symbols, best, tokens = [], [], []
                there = np.flatnonzero(rows.any(1))
                there = there[(block * BLOCK + there).astype("u8") * 2654435761 % 4294967296 >> 31 == sweep % 2]
                for i in range(0, len(there), 32):
                    part = there[i : i + 32]
                    own = cls[block * BLOCK + part].astype("i8")
                    value = gains(pairs, own, rows[part, :n_classes], rows[part, n_classes:-1], rows[part, -1])
                    b, k = value.argmax(1), np.arange(len(part))
                    moves = value[k, b] > value[k, own] + 1e-6
                    symbols += (block * BLOCK + part[moves]).tolist()
                    best += b[moves].tolist()
                    # A symbol follows as often as it occurs.
                    tokens += rows[part[moves], n_classes:-1].sum(1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), pa.array(best, pa.int8()), pa.array(tokens, pa.int64())], names=["symbol", "class", "tokens"])

    moved = stored.where("block >= 0").repartition("block").mapInArrow(choose, "symbol int, class byte, tokens long").toArrow()
    sent.destroy()
    out = classes.copy()
    out[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
    return out, int(moved.column(2).to_numpy().sum())


def head_of(counted: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """The words known to every worker, their counts, and the least count among
    them: as many whole steps of counts, of a sixteenth of an octave, as hold HEAD
    words."""
    able = counted.where((F.col("n") >= LEAST) & (F.length("word") <= LONGEST))
    step = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    least, held = 1 << 62, 0
    # A row for each step: a thousand at most.
    for r in sorted(able.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        held += r.words
        if held > HEAD:
            break
        least = r.least
    found = able.where(F.col("n") >= least).toArrow()
    words, n = found.column("word").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order], least


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, n_classes: int = CLASSES, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    Training documents are those whose crc32(id as text) mod `folds` isn't
    `held_out`. Tokens: words between ASCII white space, A-Z in lower case, then
    an end. base_score is the add-one unigram log10 probability. score is that of

        P(w | v) = P(c(w) | c(v)) P(symbol(w) | c(w)) [P(w | group)]

    over classes that exchange clustering finds: words with LEAST or more training
    tokens are symbols themselves, in a corpus of any size; the rest, in groups by
    their last two bytes, have P(w | group) = (c + 1) /
    (N_g + V_g + 1), an unknown word the last share, as the base has it. Transitions are smoothed by
    class unigrams, emissions by an added count, so the model is a proper
    distribution over known words and one unknown word a group.

    Counts cover all training documents. Every sweep counts the contexts of all
    bigrams by block of symbols and computes each move's exact gain. Words
    outside the head meet their symbols and counts in an equi-join; what the
    driver and every worker hold of such a word is a byte, its class.

    A null text counts as empty: the end alone. Rows without an id are scored,
    not held out and not trained on. Repeated rows come out each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds).alias("fold"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    trains = F.col("fold") != held_out
    counted = store(word_counts(rows.where(trains)), "words")
    ends = rows.where(trains).count()
    words, types = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, types + (ends > 0)

    head, head_counts, least = head_of(counted)
    is_head = (F.col("n") >= least) & (F.length("word") <= LONGEST)
    sent_head = spark.sparkContext.broadcast(head)
    group = (F.crc32(F.substring("word", -2, 2)) % GROUPS).cast("int")
    # Symbols: 0, the head, the groups; from a whole block on, the other clustered words.
    first = len(head) + 1 + GROUPS
    beyond = -(-first // BLOCK) * BLOCK
    dense = min(beyond, DENSE)
    tail, n_tail = numbered(counted.where(~is_head & (F.col("n") >= LEAST)).select("word", "n"), beyond)
    rare = counted.where(~is_head & (F.col("n") < LEAST)).select("word", "n", group.alias("grp"))
    in_group = np.zeros((GROUPS, 2), "i8")
    for r in rare.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_group[r.grp] = r.n, r.v
    count = np.r_[ends, head_counts, in_group[:, 0]].astype("i8")

    coded = store(encode(rows, sent_head), "symbols")
    sent_head.destroy()
    # GROUPS rows.
    sizes = F.broadcast(spark.createDataFrame([(g, n + v + 1) for g, (n, v) in enumerate(in_group.tolist())], "grp int, size long"))
    tokens = coded.select("row", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "t")).select("row", "place", F.col("t.words").alias("word"), F.col("t.counts").alias("tf"))
    outside = tail.unionByName(rare.select("word", "n", F.lit(None).cast("int").alias("symbol")))
    joined = tokens.join(outside.hint("shuffle_hash"), "word", "left").withColumn("grp", group).join(sizes, "grp")
    seen = F.coalesce("n", F.lit(0))
    # A clustered word's emission lacks the share of its class as yet.
    own = F.when(F.col("symbol").isNotNull(), F.log10(seen + EMISSION)).otherwise(F.log10((seen + 1) / F.col("size")))
    found = joined.groupBy("row").agg(
        F.collect_list(F.struct("place", F.coalesce("symbol", F.col("grp") + len(head) + 1).alias("symbol"))).alias("pairs"),
        F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("out_known"),
        F.sum(F.col("tf") * F.log10((seen + 1) / F.lit(float(total + distinct + 1)))).alias("out_base"),
        F.sum(F.col("tf") * own).alias("out_own"),
    )
    encoded = store(resolve(coded, found), "symbols")
    remove(spark, coded.path)
    training = store(followed(encoded.where(trains)), "bigrams")
    order = np.argsort(-count, kind="stable")
    classes = np.zeros(beyond + n_tail, "i4")
    classes[order] = np.arange(len(count)) % n_classes
    classes[beyond:] = np.arange(n_tail) % n_classes
    before = total + ends
    for sweep in range(sweeps):
        stored = contexts(training, classes, n_classes, dense)
        classes, moved = exchange(stored, classes, n_classes, sweep)
        remove(spark, stored.path)
        if before + moved <= SETTLED * (total + ends):
            break
        before = moved
    pairs = class_bigrams(training, classes, n_classes)
    remove(spark, training.path)
    # Every token, the end too, is the second of one bigram.
    of_class = pairs.sum(0)
    members = np.bincount(classes[:first], minlength=n_classes) + np.bincount(classes[beyond:], minlength=n_classes)
    unigram = (of_class + 1) / (of_class.sum() + n_classes)
    transition = np.log10((pairs + TRANSITION * unigram) / (pairs.sum(1, keepdims=True) + TRANSITION))
    emission = np.log10(count + EMISSION)
    share = np.log10(np.maximum(of_class + EMISSION * members, EMISSION))  # a class without members is never met
    base = np.log10((count + 1) / (total + distinct + 1))
    base[len(head) + 1 :] = 0
    known = count > 0
    known[len(head) + 1 :] = False
    sent = spark.sparkContext.broadcast((small(classes), transition, emission, share, base, known))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, emission, share, base, known = sent.value
        for batch in batches:
            out = []
            for blob in batch.column(2).to_pylist():
                x = np.frombuffer(blob, "i4")
                c = classes[x]
                low = x[x < beyond]
                prev = np.r_[classes[0], c[:-1]]
                out.append((len(x), int(known[low].sum()), float(base[low].sum()), float(transition[prev, c].sum() + emission[low].sum() - share[c].sum())))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True))], names=["doc_id", "fold", *batch.schema.names[3:], "n_tokens", "n_known", "base", "own"])

    scored = encoded.mapInArrow(evaluate, "doc_id long, fold long, out_known long, out_base double, out_own double, n_tokens long, n_known long, base double, own double")
    value = F.col("own") + F.col("out_own")
    return scored.select(
        "doc_id",
        F.coalesce(F.col("fold") == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("out_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("out_base")).alias("base_score"),
        value.alias("score"),
        F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )
