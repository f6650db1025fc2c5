"""Exact Jaccard join of documents on their sets of word shingles.

Set relations let the join skip work at two levels. Within an index list, sets
of one size are a block sorted by the position of the token: one comparison
passes over a block out of reach by size or by the prober's position, and a
binary search over the rest of a block from the first position out of reach on.
Between sets, a member of a group takes over the answers computed for a highly
similar set, its leader, by the sizes of their differences, and only what these
bounds leave open is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, forget, fresh, remove, slices, store

#: Hash buckets, by whose counts shingles are ordered, and what of them is merged at a time.
BITS = 22
CHUNK = 1 << 16
#: A shingle whose bucket is met more often has its list cut into parts of about so many sets.
LIST = 1 << 14
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18
#: Pairs at a time of a list.
PAIRS = 1 << 19
#: Ids up to which a bitmap picks texts; for more, a join does.
MARKED = 1 << 24
#: Rounds in which each list links its sets with one leader, before all pairs of
#: different components that are left in a list are taken.
LEADER_ROUNDS = 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype="u8") * _BASE)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (powers(x, PIECE + 2) for x in (_BASE, _INVERSE))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of `data`, which starts and ends in white space, and
    where it starts: a polynomial over all bytes of the word, taken from prefix
    sums modulo 2^64, and scrambled. Bytes are taken some PIECE at a time, cut at
    white space, so that memory stays bounded but for a single longer word."""
    found, places, at = [], [], 0
    while at < len(data) - 1:
        end = min(at + PIECE, len(data) - 1)
        space = np.flatnonzero(_SPACE[data[at + 1 : end + 1]])
        while not len(space):
            later, end = end, min(end + PIECE, len(data) - 1)
            space = np.flatnonzero(_SPACE[data[later + 1 : end + 1]]) + later - at
        end = at + 1 + int(space[-1])
        piece = data[at : end + 1]
        up, down = (_UP, _DOWN) if len(piece) <= len(_UP) else (powers(_BASE, len(piece)), powers(_INVERSE, len(piece)))
        sums = np.zeros(len(piece) + 1, "u8")
        np.cumsum(_BYTES[piece] * up[: len(piece)], out=sums[1:])
        edge = np.flatnonzero(np.diff(_SPACE[piece].view("i1")))
        first, last = edge[::2] + 1, edge[1::2] + 1
        found.append(mix(mix((sums[last] - sums[first]) * down[first]) + (last - first).astype("u8")))
        places.append(first + at)
        at = end
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, "u8"), np.zeros(0, "i8"))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text (null: empty) the sorted distinct 64-bit hashes of its
    `width`-word shingles; of all its words, where they are fewer; none without
    words. A shingle's hash combines those of its words."""
    raw = [(x or "").encode() for x in texts.to_pylist()]
    starts = np.cumsum([1] + [len(x) + 1 for x in raw])
    words, first = word_hashes(np.frombuffer(b" ".join([b"", *raw, b""]), "u1"))
    bounds = np.searchsorted(first, starts)
    n = max(0, len(words) - width + 1)
    whole = np.zeros(n, "u8")
    for k in range(width):
        whole += words[k : k + n] * _FACTORS[k % len(_FACTORS)] * np.uint64(2 * (k // len(_FACTORS)) + 1)
    whole = mix(whole)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(whole[lo : hi - width + 1]))
        elif hi > lo:
            few = words[lo:hi] * np.arange(3, 3 + 2 * (hi - lo), 2).astype("u8")
            out.append(mix(few.sum(dtype="u8", keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix(found + _BASE), mix(found ^ _INVERSE)
    return int(a.sum(dtype="u8").view("i8")), int(np.bitwise_xor.reduce(b).view("i8"))


def identify(found: list[np.ndarray], clashes: frozenset[int]) -> list[int]:
    """A 64-bit id for each set: the first half of its digest or, for the few
    halves that different sets of all documents share (`clashes`), both."""
    marks = map(digest, found)
    return [a ^ b if a in clashes else a for a, b in marks]


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts without loss, a byte plane after the other: all but the lowest are nearly empty."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), "u1").reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def pack_set(found: np.ndarray) -> bytes:
    """A sorted set without loss: its size, the gaps of the top 16 bits, which are
    small in large sets, compressed, and the other six bytes of each hash as they are."""
    gaps = np.diff(found >> np.uint64(48), prepend=np.uint64(0)).astype("<u2")
    planes = np.ascontiguousarray(gaps.view("u1").reshape(-1, 2).T)
    rest = np.ascontiguousarray(found.astype("<u8").view("u1").reshape(-1, 8)[:, :6])
    return len(found).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) + rest.tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    if not n:
        return np.zeros(0, "u8")
    planes = np.frombuffer(pa.decompress(blob[4 : len(blob) - 6 * n], 2 * n, "zstd", asbytes=True), "u1").reshape(2, n)
    out = np.zeros((n, 8), "u1")
    out[:, :6] = np.frombuffer(blob, "u1", offset=len(blob) - 6 * n).reshape(n, 6)
    gaps = planes[0].astype("u8") | planes[1].astype("u8") << np.uint64(8)
    return out.view("<u8")[:, 0] | np.cumsum(gaps, dtype="u8") << np.uint64(48)


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap with which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def signatures(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, h1, h2) of every row (id, text), and how often the shingles of
    each of 2^BITS hash buckets occur in all rows, at most 2^31 - 1. Any counts
    would do, as long as all sets are ordered by the same ones; the more
    documents share a bucket, the less they tell, but shingles of a notable share
    of all documents stand out from any number of others."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(1 << BITS, "u4")
        for batch in batches:
            for part in slices(batch, PIECE, 1):
                sets = shingle_sets(part.column(1), width)
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - BITS)).astype("i8"), np.uint32(1))
                marks = [digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
        if total.any():
            at = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array([-1 - c // CHUNK for c in at], pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array([pack_counts(total[c : c + CHUNK]) for c in at])], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's rows, one after the other, into a table for each chunk that it meets.
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = totals.setdefault(n, np.zeros(CHUNK, "i8"))
                total += unpack_counts(blob.as_py(), CHUNK)
        for n, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pack_counts(np.minimum(total, (1 << 31) - 1))])], names=["n", "counts"])

    names = ["doc_id", "n", "h1", "h2", "counts"]
    stored = store(rows.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, counts binary"), "signatures")
    counts = np.zeros(1 << BITS, "i4")
    # A fixed number of chunks reaches the driver: 16 MB in all at most.
    for n, blob in stored.where("n < 0").select("n", "counts").repartition("n").mapInArrow(add, "n long, counts binary").collect():
        counts[(-1 - n) * CHUNK : (-n) * CHUNK] = unpack_counts(bytes(blob), CHUNK)
    return stored.where("n >= 0").drop("counts"), counts


def prefixes(rows: DataFrame, width: int, percent: int, sent, clashes: frozenset[int]) -> DataFrame:
    """(token, parts, n, set_id, pos): each set's prefix in the order of bucket
    counts, rarest first, then of hashes. Sets that reach the similarity share a
    token of their prefixes. Equal sets of a partition are indexed once.

    A bucket's count bounds the length of its tokens' lists: a list that could
    hold more than LIST sets is cut into `parts`."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        order, seen = sent.value, set()
        for batch in batches:
            for part in slices(batch, PIECE, 0):
                tokens, parts, ids, sizes, places = [], [], [], [], []
                sets = shingle_sets(part.column(0), width)
                for found, own in zip(sets, identify(sets, clashes), strict=True):
                    n = len(found)
                    if not n or own in seen:
                        continue
                    seen.add(own)
                    length = n - needed_self(n, percent) + 1
                    often = order[(found >> np.uint64(64 - BITS)).astype("i8")]
                    first = np.argsort(often, kind="stable")[:length]
                    tokens.append(found[first])
                    parts.append(often[first] // LIST + 1)
                    ids.append(np.full(length, own, "i8"))
                    sizes.append(np.full(length, n, "i4"))
                    places.append(np.arange(length, dtype="i4"))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view("i8")), *(pa.array(np.concatenate(x)) for x in (parts, sizes, ids, places))], names=["token", "parts", "n", "set_id", "pos"])

    return rows.select("text").mapInArrow(index, "token long, parts int, n int, set_id long, pos int")


def needed_self(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it can link with."""
    return -(-percent * n // 100)


def part_of() -> Column:
    """The part of its token's list that an entry is in."""
    return F.when(F.col("parts") > 1, F.pmod(F.xxhash64("set_id", "token"), F.col("parts"))).otherwise(0).cast("int")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole lists, or parts of lists, of (token, part, ..): rows
    come sorted by them. A list is held, which its parts keep to LIST sets or so,
    beside a batch of rows."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.flatnonzero(np.r_[True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])])[-1])
        if cut:
            yield [c[:cut] for c in now]
        held = [c[cut:].copy() for c in now]
    if held is not None and len(held[0]):
        yield held


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    if not len(columns[0]):
        return np.zeros(0, int)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])])


def shared_lists(prefix: DataFrame, percent: int) -> DataFrame:
    """The rows of `prefix`, one for each set and token, that some other set of the
    token's list could link with: an entry whose rest, from its position on, can't
    reach the overlap needed with even the list's smallest set is passed over.
    In lists that are cut into parts all entries stay."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, part, n, pos, set_id, parts in _lists(batches):
            first = np.zeros(len(token), bool)
            first[_starts(token, part, n, pos, set_id)] = True
            token, n, pos, set_id, parts = (x[first] for x in (token, n, pos, set_id, parts))
            start = _starts(token, part[first])
            smallest = np.repeat(n[start], np.diff(np.r_[start, len(token)])).astype("i8")
            # percent * (n + m) <= (100 + percent) * (n - pos) for a partner of size m
            ok = (parts > 1) | (percent * (n + smallest) <= (100 + percent) * (n.astype("i8") - pos))
            token, n, pos, set_id, parts = (x[ok] for x in (token, n, pos, set_id, parts))
            same = token[1:] == token[:-1]
            many = (parts > 1) | (np.r_[False, same] | np.r_[same, False] if len(token) else ok[:0])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, parts, n, set_id, pos)], names=["token", "parts", "n", "set_id", "pos"])

    dealt = prefix.withColumn("part", part_of()).select("token", "part", "n", "pos", "set_id", "parts").repartition("token", "part").sortWithinPartitions("token", "part", "n", "pos", "set_id")
    return dealt.mapInArrow(keep, "token long, parts int, n int, set_id long, pos int")


def _reach(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs a, b of list entries can reach the similarity, by size and by
    what is left of both sets from the token on."""
    na, nb = n[a].astype("i8"), n[b].astype("i8")
    least = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pos[a], nb - pos[b]) >= least)


def block_pairs(lists: np.ndarray, n: np.ndarray, pos: np.ndarray, probes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i of `probes`, of entries of one of `lists` (numbered from
    0), sorted by (list, n, pos), that sizes and positions leave.

    Entries of one size are a block. A probe skips the blocks out of reach by
    size, the whole of a block in which its own position leaves too little, and
    of any other block what stands behind the last position that leaves enough."""
    if not len(probes):
        return
    n, pos = n.astype("i8"), pos.astype("i8")
    start = _starts(lists, n)
    size = n[start]
    wide, broad = int(pos.max()) + 2, int(n.max()) + 2
    key = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(n)])) * wide + pos
    own, sizes = n[probes], lists[start] * broad + size
    low = np.searchsorted(sizes, lists[probes] * broad + -(-percent * own // 100))
    high = np.searchsorted(sizes, lists[probes] * broad + np.minimum(100 * own // percent, broad - 1), "right")
    for cut in _cuts(high - low):
        count = (high - low)[cut]
        i = np.repeat(probes[cut], count)
        block = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[cut], count)
        least = -(-percent * (n[i] + size[block]) // (100 + percent))
        reached = n[i] - pos[i] >= least
        i, block, least = i[reached], block[reached], least[reached]
        last = np.searchsorted(key, block * wide + np.clip(size[block] - least, -1, wide - 2), "right")
        first = start[block]
        counts = np.maximum(last - first, 0)
        for few in _cuts(counts):
            c = counts[few]
            yield np.repeat(i[few], c), np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[few], c)


def _cuts(counts: np.ndarray) -> Iterator[slice]:
    """Slices of `counts` that add up to some PAIRS each."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, to)
        at = to


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    start = _starts(low, high)
    return pa.RecordBatch.from_arrays([pa.array(low[start]), pa.array(high[start])], names=["a", "b"])


def _commonest(lists: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """The component that most entries of each list have."""
    order = np.lexsort((comp, lists))
    run = _starts(lists[order], comp[order])
    counts = np.diff(np.r_[run, len(comp)])
    of, which = lists[order][run], comp[order][run]
    best = np.lexsort((counts, of))
    return which[best][np.r_[_starts(of[best])[1:], len(of)] - 1]


def with_components(lists: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return lists.withColumn("component", F.col("set_id"))
    joined = lists.join(component.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    return joined.withColumn("component", F.coalesce("component", "set_id"))


def leader_pairs(lists: DataFrame, component: DataFrame | None, percent: int, seed: int) -> DataFrame:
    """Distinct pairs (a, b) of sets in different components that share a part of
    a list: of its blocks by size, every set with the block's leader, the set of
    the earliest position for seed 0, a drawn one for others."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, part, n, pos, set_id, comp in _lists(batches):
            # A block ends where sizes leave the reach of its smallest set.
            span = np.floor(np.log(n) / np.log(100 / percent)).astype("i8") if percent < 100 else n.astype("i8")
            block = _starts(token, part, span)
            number = np.repeat(np.arange(len(block)), np.diff(np.r_[block, len(n)]))
            # A set that few rare tokens of its own stand before is in the middle of
            # its near copies: it leads first. Later rounds draw.
            luck = mix(set_id.view("u8") + np.array([seed], "u8") * _BASE)
            a, b = np.lexsort((luck, pos if seed == 0 else luck, number))[block][number], np.arange(len(n))
            ok = (comp[a] != comp[b]) & _reach(n, pos, a, b, percent)
            if ok.any():
                yield _distinct_pairs(set_id[a[ok]], set_id[b[ok]])

    rows = with_components(lists, component).withColumn("part", part_of())
    dealt = rows.select("token", "part", "n", "pos", "set_id", "component").repartition("token", "part").sortWithinPartitions("token", "part", "n", "pos", "set_id")
    return dealt.mapInArrow(pair, "a long, b long").distinct()


def open_pairs(lists: DataFrame, component: DataFrame | None, percent: int, cut: bool) -> DataFrame:
    """Distinct pairs (a, b) of all sets in different components that share a list
    and that sizes and positions leave. Of each list, the sets outside its largest
    component meet all others. If any list is `cut` into parts, its few sets
    outside are guests of all parts of the list; who is of the largest component
    stays in one."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, part, n, pos, set_id, comp, guest in _lists(batches):
            start = _starts(token, part)
            mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
            lengths = np.diff(np.r_[start, len(token)])
            keep = np.repeat(mixed, lengths)
            if not keep.any():
                continue
            lists = np.repeat(np.arange(int(mixed.sum())), lengths[mixed])
            n, pos, set_id, comp, guest = (x[keep] for x in (n, pos, set_id, comp, guest))
            few = guest | (comp != _commonest(lists, comp)[lists])
            for i, j in block_pairs(lists, n, pos, np.flatnonzero(few), percent):
                # Pairs of two probes come once; two guests meet where one is at home.
                ok = (comp[i] != comp[j]) & ~guest[j] & (~few[j] | guest[i] | (i < j))
                if ok.any():
                    yield _distinct_pairs(set_id[i[ok]], set_id[j[ok]])

    columns = ("token", "part", "n", "pos", "set_id", "component", "guest")
    rows = with_components(lists, component).withColumns({"part": part_of(), "guest": F.lit(False)})
    if cut:
        hot = rows.where("parts > 1")
        sizes = hot.groupBy("token", "component").agg(F.count("*").alias("n"))
        # Lists of one component are done with.
        largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1")
        home = hot.join(largest.select("token", "largest"), "token")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
        guests = home.where("component <> largest").withColumns({"guest": F.lit(True), "other": F.explode(others)}).drop("part").withColumnRenamed("other", "part")
        rows = rows.where("parts = 1").select(*columns).unionByName(home.select(*columns)).unionByName(guests.select(*columns))
    dealt = rows.select(*columns).repartition("token", "part").sortWithinPartitions("token", "part", "n", "pos", "set_id")
    return dealt.mapInArrow(pair, "a long, b long").distinct()


def sets_of(rows: DataFrame, wanted: DataFrame, n: int, width: int, clashes: frozenset[int]) -> DataFrame:
    """The stored (set_id, shingles) of the documents `wanted` (doc_id), n at most,
    and perhaps of a few more. Up to MARKED ids, a bitmap of hashed ids (64 MB at
    most) is broadcast, so the texts are filtered where they are read; more ids
    are joined."""
    if n > MARKED:
        return store(rows.join(wanted.distinct(), "doc_id", "left_semi").select(F.lit(None).cast("long").alias("p"), "text").mapInArrow(_builder(None, width, clashes), "set_id long, shingles binary"), "sets")
    bits = 1 << max(18, (16 * n).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    marked = wanted.select(place("doc_id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    bitmap = np.zeros(bits // 8, "u1")
    for bucket, blob in marked.collect():
        bitmap[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(blob, "u1")
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    known = rows.where("doc_id is not null").select(place("doc_id").alias("p"), "text")
    out = store(known.mapInArrow(_builder(sent, width, clashes), "set_id long, shingles binary"), "sets")
    sent.destroy()
    return out


def _builder(sent, width: int, clashes: frozenset[int]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if sent is not None:
                p = batch.column(0).to_numpy(zero_copy_only=False) - 1
                batch = batch.filter(pa.array((sent.value[p >> 3] >> (p & 7).astype("u1")) & 1 == 1))
            for part in slices(batch, PIECE, 1):
                found = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([pa.array(identify(found, clashes), pa.int64()), pa.array([pack_set(x) for x in found], pa.binary())], names=["set_id", "shingles"])

    return build


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, overlap, linked) of candidate pairs, from the whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 * PIECE, 2, 3):
                na, nb, overlap = [], [], []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = unpack_set(x), unpack_set(y)
                    na.append(len(p))
                    nb.append(len(q))
                    overlap.append(len(np.intersect1d(p, q, assume_unique=True)))
                a, b, o = (np.array(x, "i8") for x in (na, nb, overlap))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a), pa.array(b), pa.array(o), pa.array(100 * o >= percent * (a + b - o))], names=["a", "b", "na", "nb", "overlap", "linked"])

    of = lambda name: sets.select(F.col("set_id").alias(name), F.col("shingles").alias(f"in_{name}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "in_a", "in_b")
    return joined.mapInArrow(compare, "a long, b long, na long, nb long, overlap long, linked boolean")


def derive(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """`pairs` (a, b) with `settled`, true or false where the answers of a's leader
    decide, else null. Pairs that are themselves in `known` are left out.

    For a set a, its leader L and another set b, the overlap of a and b lies
    between |L & b| - |L - a| and |L & b| + |a - L|: a's answer follows from L's
    by the sizes of their differences.
    """
    both = known.select("a", "b", "na", "nb", "overlap", "linked").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "overlap", "linked")).where("overlap is not null")
    # A set's leader: the linked set with the largest overlap.
    leader = both.where("linked").groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("leader"), F.col("overlap").alias("shared"), F.col("na").alias("n_a"), F.col("nb").alias("n_leader")), F.struct("overlap", "b")).alias("l")).select("a", "l.*")
    answers = both.select(F.col("a").alias("leader"), "b", F.col("nb").alias("n_b"), F.col("overlap").alias("with_b"))
    asked = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    bounded = asked.join(leader, "a", "left").join(answers, ["leader", "b"], "left")
    low, high = F.col("with_b") - (F.col("n_leader") - F.col("shared")), F.col("with_b") + (F.col("n_a") - F.col("shared"))
    linked = lambda o: 100 * o >= percent * (F.col("n_a") + F.col("n_b") - o)
    return bounded.select("a", "b", F.when(linked(low), True).when(~linked(high), False).alias("settled"))


def components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", notes: dict | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct `width`-word shingles (words: runs of other than ASCII white space,
    A-Z lower-cased). component_id is the smallest doc_id reachable by links,
    itself included.

    Equal sets are one class, found by size and a 128-bit digest; only classes
    are indexed, so copies cost nothing more. The list of a shingle that many
    documents share is cut into parts of some LIST sets, each a task's at most.
    In `LEADER_ROUNDS` rounds each part links its sets with one leader a block,
    which leaves large groups of near copies in one component after a few
    comparisons a set; pairs of different components that lists then still hold
    are all checked, so no link is lost. Answers that follow from those of a
    set's leader aren't computed. Shingles are told apart by 64-bit hashes.
    `notes` gets the number of pairs met and derived in each round.

    A null text or one without words has no shingles, links with nothing and is
    its own component. Repeated rows come out each. Rows without an id get the
    component of their class's smallest id; a class without any id links with
    nothing, and has none. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, counts = signatures(rows, width)
    classes = store(signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first")), "classes")
    n_classes = classes.count()
    # Different sets that share half of their digests: none, or a few among 10^10.
    clashes = frozenset(r.h1 for r in classes.groupBy("h1").count().where("count > 1").select("h1").take(10_001))
    if len(clashes) > 10_000:
        raise ValueError("digests clash too often")
    set_id = F.when(F.col("h1").isin(*clashes), F.col("h1").bitwiseXOR(F.col("h2"))).otherwise(F.col("h1")) if clashes else F.col("h1")
    classes_by_id = classes.withColumn("set_id", set_id)
    sent = spark.sparkContext.broadcast(counts)
    lists = store(shared_lists(prefixes(rows, width, percent, sent, clashes), percent), "lists")
    sent.destroy()
    cut = bool((counts >= LIST).any()) and bool(lists.where("parts > 1").take(1))
    del counts

    def checked(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        # One document of each class in a pair.
        wanted = classes_by_id.where("first is not null").join(ids, "set_id", "left_semi").select(F.col("first").alias("doc_id"))
        found = sets_of(rows, wanted, min(2 * pairs.count(), n_classes), width, clashes)
        # Repeated rows of a document give its set again.
        out = store(verify(pairs, found.dropDuplicates(["set_id"]), percent), "verified")
        remove(spark, found.path)
        return out

    known = found = None
    for round_ in range(LEADER_ROUNDS + 1):
        pairs = store(leader_pairs(lists, found, percent, round_) if round_ < LEADER_ROUNDS else open_pairs(lists, found, percent, cut), "pairs")
        if not pairs.take(1):
            continue
        if known is None:
            known = new_links = checked(pairs)
        else:
            decided = store(derive(pairs, known, percent), "derived")
            taken = decided.where("settled").select("a", "b", *(F.lit(None).cast("long").alias(c) for c in ("na", "nb", "overlap")), F.lit(True).alias("linked"))
            new_links = checked(decided.where("settled is null").select("a", "b")).unionByName(taken)
            known = known.unionByName(new_links)
            if notes is not None:
                notes[round_] = (pairs.count(), decided.where("settled is not null").count())
        links = new_links.where("linked").select("a", "b")
        if found is not None:
            links = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = connected_components(links)
    if found is None:
        found = spark.createDataFrame([], "id long, component long")
    # Components of sets, by their smallest document; then every document's.
    joined = classes_by_id.join(found.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = joined.join(smallest, "component").select("n", "h1", "h2", "component_id")
    return (
        signed.join(by_class, ["n", "h1", "h2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that link, directly or not, with one of a smaller id.
    Documents without shingles stay, as do rows without an id."""
    name = fresh(docs)
    found = components(docs, percent, width, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(name), "left_anti")
