"""SimHash fingerprints and near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits. The perfect
binary Golay code gives each 23-bit word one codeword within three bits, and the
codewords next to the word and to its one-bit neighbours are at most six; two
words that differ in one or two bits have one of them in common (that of a word
between both). Among at most four differing bits, the segments differ either

* in no bit of one segment and at most two of another: keys are the exact
  segment with each codeword of the other, for the six ordered pairs, or
* in at least one bit each, so in (1, 1), (1, 2) or (2, 1) bits of the first two, and one or two of the third:
  keys are the pairs of their codewords, of 24 bits; or beyond ``WIDE`` distinct fingerprints (or as ``wide`` says)
  the triples of all three, of 36 bits: some 180 keys a fingerprint instead of 60, but meetings by chance, which grow with the
  corpus for each key, are 4,096 times fewer. Both find the same links.

Rows with equal keys are compared, and those at four or fewer bits are linked. ``link`` also takes candidates at up to ``NEAR_BITS`` bits, for
near copies that are verified by their texts (``jaccard``): the keys are then pairs of near codewords of four segments of 16 bits, some 170
a fingerprint. At most eight differing bits leave two segments with at most two, so all such pairs meet, and most of those beyond. Beyond ``WIDE``
the keys are triples, by which all pairs at five bits meet. At so many bits unrelated texts are near by chance, one pair in 26,000, which grows with the square of
the corpus. So these fingerprints travel with ``beside`` them 48 bits of a second one and the size of the set, and only those near by all three are linked.
Fingerprints are made distinct first, so copies meet no one. Rows of one key
are compared in one task up to ``BLOCK`` of them; larger keys are cut into blocks of ``CELL``
and every pair of blocks is compared in a task of its own, a stripe at a time. From each key come
the links of a spanning forest, not all pairs.

Null texts count as empty: fingerprint zero, linked like any other. Null ids
never become a component's id unless it has no other. Repeated rows are kept, each in the group of its text. Texts of any
length are read whole; the bits are counted in blocks of shingles. Ties do not matter, as a component's id is the
smallest. An empty table gives no rows. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, cut, sift, written
from .components import Forest, components

MAX_BITS = 4
#: Width and shift of each segment.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: Fingerprints of one key that are compared where the key is read, and in a block of a larger key.
BLOCK, CELL = 2048, 16_384
_STRIPE = 256
#: Bits, and segments, for candidates that are verified: at a Jaccard similarity of 0.8 sets' fingerprints differ in some ten bits.
NEAR_BITS = 16
NEAR_SEGMENTS = ((16, 48), (16, 32), (16, 16), (16, 0))
#: Bits at which candidates may differ in both fingerprints (64 and 48 bits) together, of which at that similarity some 17 do, give or take four,
#: and of unrelated ones 56; and steps of sizes, by which none so similar are apart: 2,048 to a doubling, of which a quarter more is 660.
NEAR_ALL, LEVELS, NEAR_LEVELS = 26, 2048, 660
#: Distinct fingerprints beyond which keys are triples: there some six meet by chance in a key of 24 bits.
WIDE = 100_000_000
_SHORT = 16
_GENERATOR = 0b110001110101  # of the (23, 12) Golay code

_tables: list[np.ndarray] = []


def codewords() -> np.ndarray:
    """The code's words by their 12-bit index."""
    words = np.arange(4096, dtype=np.uint32)
    out = np.zeros(4096, np.uint32)
    for bit in range(12):
        out ^= np.where(words >> bit & 1, np.uint32(_GENERATOR << bit), np.uint32(0)).astype(np.uint32)
    return out


def decoding() -> np.ndarray:
    """Index of the only codeword within three bits, of every 23-bit word."""
    if not _tables:
        errors = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
        table = np.full(1 << 23, -1, np.int16)
        words = codewords()
        for e in errors:
            table[words ^ np.uint32(e)] = np.arange(4096)
        _tables.append(table)
    return _tables[0]


def near_codewords(x: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) indices of the codewords next to each word and its one-bit neighbours; repeats are -1."""
    table = decoding()
    around = np.stack([table[x], *(table[x ^ np.uint32(1 << b)] for b in range(width))], axis=1)
    around.sort(axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around.sort(axis=1)
    if (around[:, :-6] >= 0).any():
        raise AssertionError("a word has more than six codewords near")
    return around[:, -6:].astype(np.int64)


def fuzzy_keys(fingerprints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of uint64 fingerprints."""
    parts = [((fingerprints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for w, s in SEGMENTS]
    near = [near_codewords(p, w) for p, (w, _) in zip(parts, SEGMENTS, strict=True)]
    rows, keys = [], []
    kind = 0
    for i, exact in enumerate(parts):
        for j, codes in enumerate(near):
            if i != j:
                kind += 1
                r, c = np.nonzero(codes >= 0)
                rows.append(r)
                keys.append(np.int64(kind) << 40 | exact[r].astype(np.int64) << 12 | codes[r, c])
    r, i, j = np.nonzero((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :])
    key = near[0][r, i] << 12 | near[1][r, j]
    if wide:
        at, k = np.nonzero(near[2][r] >= 0)
        r, key = r[at], key[at] << 12 | near[2][r[at], k]
    rows.append(r)
    keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def near_keys(fingerprints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys of uint64 fingerprints by which those at up to ``NEAR_BITS`` bits are looked for."""
    near = [near_codewords(((fingerprints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32), w) for w, s in NEAR_SEGMENTS]
    rows, keys = [], []
    for kind, (first, *others) in enumerate(combinations(near, 3 if wide else 2)):
        r, c = np.nonzero(first >= 0)
        key = np.int64(kind) << 40 | first[r, c]
        for codes in others:
            at, k = np.nonzero(codes[r] >= 0)
            r, key = r[at], key[at] >> 40 << 40 | (key[at] & ((1 << 28) - 1)) << 12 | codes[r[at], k]
        rows.append(r)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of some shingles' hashes: a bit is set if it is in over half of them."""
    values = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 15):
        total += np.unpackbits(values[k : k + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = 2 * total > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def beside(hashes: np.ndarray) -> int:
    """What goes beside the fingerprint of a candidate: 48 bits of one of the hashes mixed anew, and 16 of the logarithm of their number."""
    level = int(np.log2(max(1, len(hashes))) * LEVELS)
    mixed = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return of_hashes(mixed) >> 16 << 16 | min(level, (1 << 16) - 1)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    own = (text or b"").lower().split()  # of bytes: ASCII only
    if not own:
        return 0
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    if len(own) <= words:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return of_hashes(np.array(hashes, np.uint64))


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprints, their 64 bits as a signed long."""
    for batch in batches:
        values = np.array([fingerprint(x) for x in batch.cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.array(values.view(np.int64))


def _keyed(wide: bool, bits: int):
    keys_of = fuzzy_keys if bits <= MAX_BITS else near_keys

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for k in range(0, batch.num_rows, 4096):
                own = [c[k : k + 4096] for c in columns]
                rows, keys = keys_of(own[0].view(np.uint64), wide)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[rows]) for c in own)], names=["key", *batch.schema.names])

    return keyed


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a symmetric matrix of who is near whom, at most one less than there are rows."""
    m = len(near)
    label = np.arange(m)
    while True:
        lower = np.where(near, label[None, :], m).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    at = np.flatnonzero(label != np.arange(m))
    return at, label[at]


def _columns(own: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Fingerprints and what is beside them, of rows of one or both."""
    fps, *more = (np.ascontiguousarray(c) for c in own.T)
    return fps, more[0] if more else None


def _agree(fps: np.ndarray, more: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of fingerprints that are near, those that also agree in what is beside them, if anything is."""
    if more is None:
        return i, j
    differ = np.bitwise_count(fps[i] ^ fps[j]) + np.bitwise_count((more[i] ^ more[j]) >> np.uint64(16))
    levels = [(more[k] & np.uint64(0xFFFF)).astype(np.int64) for k in (i, j)]
    ok = (differ <= NEAR_ALL) & (np.abs(levels[0] - levels[1]) <= NEAR_LEVELS)
    return i[ok], j[ok]


def forest(fps: np.ndarray, bits: int = MAX_BITS, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of uint64 fingerprints (and perhaps ``more``, beside them), at most one less than there are; compared a
    stripe at a time. Each is linked to the least of its group, so that groups that share many keys give few different links."""
    order = np.argsort(fps)
    fps, more, groups = fps[order], None if more is None else more[order], Forest(len(fps))
    for k in range(0, len(fps), _STRIPE):
        r, c = np.nonzero(np.bitwise_count(fps[k : k + _STRIPE, None] ^ fps[None, k:]) <= bits)
        groups.join(*_agree(fps, more, k + r, k + c))
    at = np.flatnonzero(groups.label != np.arange(len(fps)))
    return fps[at], fps[groups.label[at]]


_LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "a", "b", "beside")])


def _link_rows(key, a, b, beside) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b, beside)], names=_LINKS.names)


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(a)
    return _link_rows(none, a.view(np.int64), b.view(np.int64), none)


def _compare(batches: Iterator[pa.RecordBatch], bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp and perhaps beside) in order of key: links (key null), and the rows of keys that are too large (b null)."""
    kept_keys, kept = np.zeros(0, np.int64), None
    overflow: int | None = None

    def too_large(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        fps, more = _columns(own)
        none = [None] * len(keys)
        return _link_rows(keys, fps.view(np.int64), none, none if more is None else more.view(np.int64))

    def links(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
        fps, more = _columns(own)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        a, b = [], []
        live = np.flatnonzero((size > 1) & (size <= _SHORT))
        for d in range(1, _SHORT):
            live = live[live + d < len(keys)]
            live = live[keys[live] == keys[live + d]]
            if not len(live):
                break
            hit = live[np.bitwise_count(fps[live] ^ fps[live + d]) <= bits]
            i, j = _agree(fps, more, hit, hit + d)
            a.append(fps[i])
            b.append(fps[j])
        for s, n in zip(starts[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist(), strict=True):
            x, y = forest(fps[s : s + n], bits, None if more is None else more[s : s + n])
            a.append(x)
            b.append(y)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.uint64)
        return _found(pairs[:, 0].copy(), pairs[:, 1].copy()) if len(pairs) else None

    for batch in batches:
        keys = np.concatenate([kept_keys, batch.column(0).to_numpy()])
        own = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
        own = own if kept is None else np.concatenate([kept, own])
        if overflow is not None:
            n = int(np.searchsorted(keys, overflow, "right"))
            yield too_large(keys[:n], own[:n])
            keys, own = keys[n:], own[n:]
            overflow = None if len(keys) else overflow
        if not len(keys):
            kept_keys, kept = keys, own
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        for s, n in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True):
            yield too_large(keys[s : s + n], own[s : s + n])
            if s == last:
                overflow = int(keys[-1])
        ok = np.repeat(sizes <= BLOCK, sizes)
        head = np.flatnonzero(ok[:last])
        if len(head) and (found := links(keys[head], own[head])) is not None:
            yield found
        tail = np.arange(last, len(keys)) if overflow is None else np.zeros(0, np.int64)
        kept_keys, kept = keys[tail], own[tail]
    if len(kept_keys) > 1 and (found := links(kept_keys, kept)) is not None:
        yield found


def _compare_cells(batches: Iterator[pa.RecordBatch], bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, fp and perhaps beside) in order of cell; a cell holds two blocks at most."""
    def done(own: list[np.ndarray]) -> pa.RecordBatch:
        fps, more = _columns(np.unique(np.concatenate(own), axis=0))
        return _found(*forest(fps, bits, more))

    current, own = None, []
    for batch in batches:
        cells = np.array(batch.column(0).to_pylist())
        if not len(cells):
            continue
        rows = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for part, cell in zip(np.split(rows, cuts), cells[np.concatenate([[0], cuts])], strict=True):
            if cell != current and own:
                yield done(own)
                own = []
            current = cell
            own.append(part)
    if own:
        yield done(own)


def _at(compare, bits: int):
    return compare if bits == MAX_BITS else lambda batches: compare(batches, bits)


def link(distinct: DataFrame, wide: bool | None = None, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct) of each group at up to ``MAX_BITS`` bits; with ``NEAR_BITS``,
    links between those that meet in a key at up to so many bits and agree in the column ``beside``, if there is one (in keys of over
    ``_SHORT`` again by a spanning forest)."""
    if wide is None:
        wide = distinct.count() > WIDE
    columns = [c for c in ("fp", "beside") if c in distinct.columns]
    keyed = distinct.select(*columns).mapInArrow(_keyed(wide, bits), ", ".join(f"{c} long" for c in ("key", *columns)))
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_at(_compare, bits), _LINKS))
    links = found.filter("b IS NOT NULL").select("a", "b")
    large = found.filter("b IS NULL").select("key", F.col("a").alias("fp"), "beside").select("key", *columns)
    sizes = cut(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")))
    if sizes.isEmpty():
        return links
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = (
        large.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.concat_ws("/", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *columns)
    )
    more = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_at(_compare_cells, bits), _LINKS)
    return links.unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", wide: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: id, x (a hash of the text), fp (the fingerprint's bits as a long), root (the
    same for all of a group) and component_id, the smallest id of the group."""
    rows = cut(docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("x"), fingerprints(F.col(text)).alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(link(distinct, wide))
    of = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(of.groupBy("root").agg(F.min("first").alias("component_id")))
    groups = cut(of.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(groups, "fp").select("id", "x", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", wide: bool | None = None, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the smallest id (nulls last), then the smallest hash of text.

    Groups are those of ``near_duplicates``; with a ``similarity`` (0.8 is the one there is) those of texts whose sets of five-word
    shingles are as similar by Jaccard: candidates at up to ``NEAR_BITS`` bits of fingerprints of these, verified by the sets, and what
    fingerprints leave apart is then completed (``jaccard``)."""
    if similarity is not None:
        from . import jaccard

        return keep_least(docs, jaccard.groups(docs, similarity, id=id, text=text), id=id, text=text)
    return keep_least(docs, cut(near_duplicates(docs, id=id, text=text, wide=wide).select("id", "x", "root")), id=id, text=text)


def keep_least(docs: DataFrame, rows: DataFrame, *, id: str, text: str) -> DataFrame:
    """``keep_one`` of groups that are known. ``rows``: id, x (the hash of the text) and root of each row of ``docs``."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "x")
    kept = cut(rows.groupBy("root").agg(F.min(rank).alias("kept")))
    others = rows.join(kept, "root").filter(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("x") == F.col("kept.x"))))
    i, x = apart(docs, "_id", "_x")
    others = written(others.select(F.col("id").alias(i), F.col("x").alias(x)).distinct(), "others")
    some, rest = sift(docs, F.xxhash64(text), others, F.col(x))  # texts of which no row goes are not shuffled
    left = rest.unionByName(some.join(others, F.col(id).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(x)), "left_anti"))
    if not rows.groupBy("id", "x").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        left = left.withColumn(x, F.xxhash64(text)).dropDuplicates([id, x]).drop(x)
    return left
