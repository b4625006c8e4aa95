"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, all of them.

They are found by SimHash. Each set gets a 64-bit fingerprint of its shingles; fingerprints that meet in a key of Golay codewords and differ
in at most ``simhash.NEAR_BITS`` bits, and agree in what is beside them (a second fingerprint and the size: else the pairs that are near by chance would grow
with the square of the corpus), are candidates (``simhash.link``), bitmaps drop most that are not similar (below), and every pair in a group of
those that are left is verified by intersection of the sets. Verified links make the first groups.

Fingerprints of similar sets may differ in more bits, or meet in no key: at 0.8 they differ in nine or ten bits, give or take three. An exact
step finds what is left, the links between sets that are not in one group yet. All sets are put in
one order of shingles; of n shingles, at least ceil(0.8 n) are in any set that is similar enough, so two such sets share
one of their first n - ceil(0.8 n) + 1. These are the keys, about one for five words. No similar pair is missed. Pairs within a group, and keys whose sets are all
in one, are done and not compared again.

Sets that meet in a key are dropped where sizes and places say that they cannot be similar enough, or where bitmaps do:
each shingle flips one of about as many bits as the set has shingles, and two bitmaps differ in no more bits than the sets
have shingles of their own. In keys of up to ``SHORT`` sets each pair is compared so, in larger keys every pair of
blocks in a task of its own. A large group of near copies shares most of its keys, so that its pairs would be compared once for each: where that is much (``PAYS``), for ``ROUNDS``
rounds each set takes part in its largest key alone, and keys whose sets are by then all in one group are done. Whatever may be similar is one candidate group; the hashes of its sets are made again from their texts, every
pair in it is verified by intersection (in blocks as well), and only verified pairs are linked, by a spanning forest.

Any order gives the same pairs. Shingles that are frequent in a sample of texts come last, so that few sets meet by chance.

Shingles are of ``WORDS`` lower-cased (ASCII) words, a shorter text is one shingle; they and whole sets are compared
by 64-bit hashes. Null texts count as empty; empty texts are one group. Texts of any length are read whole. Repeated rows, ties and null ids are
as in ``simhash.keep_one``; an empty table gives no rows. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, cut, sift, written
from .components import components
from .simhash import NEAR_BITS, beside, of_hashes, spanning
from .simhash import link as near_fingerprints

WORDS = 5
#: The least similarity, as a fraction.
UP, DOWN = 4, 5
#: Sets of one key up to which pairs are compared one by one.
SHORT = 16
#: Sets and shingles in one block of a larger key or group.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Texts whose shingles are counted for the order, and the most shingles that are known as frequent.
SAMPLE, FREQUENT = 8192, 1 << 17
#: Rounds in which large keys are compared one for each set, before those that are left are compared all at once, and
#: the comparisons that large keys would take from which on that pays.
ROUNDS, PAYS = 2, 10**10
_COLUMNS = 4096


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    own = (text or b"").lower().split()  # of bytes: ASCII only
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - WORDS + 1)
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(WORDS, len(own)) - 1 :].tolist(), strict=True)], np.uint64))


def set_hash(own: np.ndarray) -> int:
    """A set's name as a signed long; 0 if it is empty."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's keys: its first shingles in the common order, as signed longs."""
    n = len(own)
    if not n:
        return own.view(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        own = own[np.lexsort((own, np.where(frequent[at] == own, counts[at], 0)))]
    return own[: n - -(-UP * n // DOWN) + 1].view(np.int64)


def bitmap(own: np.ndarray) -> bytes:
    """A power of two of bits, of which each shingle flips one."""
    width = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    flips = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (the last axis) made as short as ``size`` words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([shingles(x).view(np.int64) for x in batch.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.StructType([T.StructField("s", T.LongType()), T.StructField("own", T.BinaryType())]))
def shingle_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("s", pa.int64()), ("own", pa.binary())])
    for batch in batches:
        sets = [shingles(x) for x in batch.cast(pa.binary()).to_pylist()]
        yield pa.array([{"s": set_hash(own), "own": own.tobytes()} for own in sets], kind)


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one text of a bounded sample has, and in how many."""
    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit(2), text), F.lit(max(1, n // SAMPLE))) == 0
    some = docs.filter(share & F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct().limit(2 * SAMPLE)
    rows = some.select(F.explode(shingle_lists("t")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    found = rows.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    hashes, counts = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _keys(known) -> object:
    kind = pa.struct([("s", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("beside", pa.int64()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])
    fields = [("s", T.LongType()), ("n", T.IntegerType()), ("fp", T.LongType()), ("beside", T.LongType()), ("bits", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]

    @F.arrow_udf(T.StructType([T.StructField(*f) for f in fields]))
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        order = known.value
        for batch in batches:
            sets = [shingles(x) for x in batch.cast(pa.binary()).to_pylist()]
            fps, more = (np.array([of(own) for own in sets], np.uint64).view(np.int64).tolist() for of in (of_hashes, beside))
            made = zip(sets, fps, more, strict=True)
            yield pa.array([{"s": set_hash(own), "n": len(own), "fp": fp, "beside": b, "bits": bitmap(own), "keys": prefix(own, *order)} for own, fp, b in made], kind)

    return keys


def may_be_similar(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of m and n shingles that share those at places x and y can be similar enough."""
    common = np.minimum(x, y) + 1 + np.minimum(m - x, n - y) - 1
    return common * (UP + DOWN) >= UP * (m + n)


_MET = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, s, n, place) in order of key: candidate pairs (key null), and the sets of larger keys (b null)."""
    kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    overflow: int | None = None

    def rows(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (key, a, b)], names=["key", "a", "b"])

    def pairs(keys, s, n, place) -> pa.RecordBatch:
        a, b = [], []
        live = np.arange(len(keys))
        for d in range(1, SHORT):
            live = live[live + d < len(keys)]
            live = live[keys[live] == keys[live + d]]
            hit = live[may_be_similar(n[live], n[live + d], place[live], place[live + d])]
            a.append(s[hit])
            b.append(s[hit + d])
        both = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
        both = np.unique(np.sort(both, axis=1), axis=0)
        return rows([None] * len(both), both[:, 0], both[:, 1])

    for batch in batches:
        own = [np.concatenate([k, c.to_numpy().astype(np.int64)]) for k, c in zip(kept, batch.columns, strict=True)]
        if overflow is not None:
            m = int(np.searchsorted(own[0], overflow, "right"))
            yield rows(own[0][:m], own[1][:m], [None] * m)
            own = [v[m:] for v in own]
            overflow = None if len(own[0]) else overflow
        keys = own[0]
        if not len(keys):
            kept = own
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        large = np.repeat(sizes > SHORT, sizes)
        if large.any():
            yield rows(keys[large], own[1][large], [None] * int(large.sum()))
        if sizes[-1] > SHORT:
            overflow = int(keys[-1])
        head = ~large
        head[starts[-1] :] = False
        if head.any():
            yield pairs(*(v[head] for v in own))
        kept = [v[starts[-1] :] if overflow is None else v[:0] for v in own]
    if len(kept[0]) > 1:
        yield pairs(*kept)


@F.arrow_udf(T.BooleanType())
def bitmaps_agree(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for m, a, n, b in zip(*(c.to_pylist() for c in batch), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            size = min(len(a), len(b))
            out.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) * (UP + DOWN) <= (DOWN - UP) * (m + n))
        yield pa.array(out, pa.bool_())


def near_bitmaps(n: list[int], bits: list[bytes]) -> np.ndarray:
    """Which sets may be similar to which by their bitmaps, as a matrix. Sets of which one is twice as long never are."""
    words = [np.frombuffer(b, np.uint64) for b in bits]
    sizes, n = np.array([len(w) for w in words]), np.array(n, np.int64)
    near = np.eye(len(words), dtype=bool)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        own = np.stack([folded(words[k], size) for k in at])
        apart = np.zeros((len(at), len(at)), np.int64)
        for k in range(size):
            apart += np.bitwise_count(own[:, k, None] ^ own[None, :, k])
        near[np.ix_(at, at)] |= apart * (UP + DOWN) <= (DOWN - UP) * (n[at][:, None] + n[at][None, :])
    return near


def near_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar to which, as a matrix."""
    n = np.array([len(own) for own in sets], np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [k, k + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        common += (part @ part.T).astype(np.int64)
    near = common * (UP + DOWN) >= UP * (n[:, None] + n[None, :])
    np.fill_diagonal(near, True)
    return near


def _compare_cells(verify: bool):
    """Links of rows (cell, s, n, own) in order of cell, by sets (``verify``) or bitmaps; a cell holds two blocks at most."""

    def done(own: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
        names = np.fromiter(own, np.int64, len(own))
        sizes, raw = zip(*own.values(), strict=True)
        at, to = spanning(near_sets([np.frombuffer(x, np.uint64) for x in raw]) if verify else near_bitmaps(sizes, raw))
        return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[to])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, {}
        for batch in batches:
            for cell, s, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != current and own:
                    yield done(own)
                    own = {}
                current = cell
                own[s] = n, raw
        if own:
            yield done(own)

    return compare


def _linked(members: DataFrame, sets: DataFrame, verify: bool) -> DataFrame:
    """(a, b): links within groups. ``members``: key and s; ``sets``: s, n and own, the set or its bitmap."""
    members = cut(members.join(sets.select("s", "n"), "s"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(members.groupBy("key").agg(blocks.alias("blocks")))
    mine = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    cells = (
        members.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.concat_ws("/", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "s")
    )
    full = cells.join(sets, "s").select("cell", "s", "n", "own").repartition("cell").sortWithinPartitions("cell")
    return full.mapInArrow(_compare_cells(verify), "a long, b long")


def _open_keys(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, s) of keys whose sets are not all in one group yet."""
    of = large.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = of.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    return written(of.join(mixed.select("key"), "key", "left_semi").select("key", "s"), "open")


def _bits_of(some: DataFrame, rows: DataFrame) -> DataFrame:
    """s, n and own (the bitmap) of the sets (column s, distinct) in ``some``."""
    return written(rows.select("s", "n", "bits").join(some, "s").groupBy("s").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("own")), "bits")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s")))


def _agreeing(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and bitmaps agree."""
    a, b = (bits.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}")) for c in ("a", "b"))
    sized = pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") * DOWN >= F.greatest("n_a", "n_b") * UP)  # no Jaccard is over this quotient
    return written(sized.filter(bitmaps_agree("n_a", "own_a", "n_b", "own_b")).select("a", "b"), "links")


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """(a, b): candidates whose fingerprints are near (with what is beside them) or equal, and whose bitmaps agree. ``rows`` as for ``link``."""
    prints = cut(rows.filter("n > 0").select("fp", "beside", "s").distinct())
    first = cut(prints.groupBy("fp").agg(F.min(F.struct("s", "beside")).alias("m")).select("fp", F.col("m.s").alias("first"), "m.beside"))
    found = near_fingerprints(first, bits=NEAR_BITS).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    x, y = (first.select(F.col("fp").alias(f), F.col("first").alias(c)) for f, c in (("x", "a"), ("y", "b")))
    equal = prints.select("fp", "s").join(first.select("fp", "first"), "fp").filter("s != first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    pairs = written(found.join(x, "x").join(y, "y").select("a", "b").unionByName(equal), "pairs")
    return _agreeing(pairs, _bits_of(_ends(pairs).distinct(), rows))


def by_rare_shingles(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links that join all sets which may be similar and are not in one group yet. ``known``: node and root of the groups."""
    distinct = rows.groupBy("s").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    keyed = distinct.select("s", "n", F.posexplode("keys").alias("place", "key")).select("key", "s", "n", "place")
    met = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, _MET))
    pairs = cut(met.filter("b IS NOT NULL").select("a", "b").distinct())
    a, b = (known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    unjoined = F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))
    pairs = written(pairs.join(a, "a", "left").join(b, "b", "left").filter(unjoined).select("a", "b"), "unjoined")
    # Written, not checkpointed: a checkpoint keeps what Catalyst knows of its columns, which grows from round to round.
    large = _open_keys(met.filter("b IS NULL").select("key", F.col("a").alias("s")), known)
    bits = _bits_of(_ends(pairs).unionByName(large.select("s")).distinct(), rows)
    links = _agreeing(pairs, bits)
    work = large.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).agg(F.sum(F.col("sets").cast("double") ** 2)).first()[0]
    for _ in range(ROUNDS if work is not None and work >= PAYS else 0):
        if large.isEmpty():
            break
        sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
        largest = large.join(sizes, "key").groupBy("s").agg(F.max(F.struct("sets", "key")).alias("m")).select("m.key", "s")
        links = written(links.unionByName(_linked(largest, bits, False)), "links")
        large = _open_keys(large, components(links))
    if work is not None and not large.isEmpty():
        links = links.unionByName(_linked(large, bits, False))
    return links


def verified(docs: DataFrame, rows: DataFrame, links: DataFrame, *, id: str, text: str) -> DataFrame:
    """(a, b): links of similar sets that join all of them which the candidates ``links`` join."""
    groups = written(components(links).select(F.col("root").alias("key"), F.col("node").alias("s")), "groups")
    # The sets concerned are made again, each from one text that has it.
    of = rows.select("id", "x", "s").join(groups.select("s"), "s").groupBy("s").agg(F.min(F.struct("x", "id")).alias("of"))
    i, x = apart(docs, "_id", "_x")
    of = written(of.select(F.col("of.id").alias(i), F.col("of.x").alias(x)), "concerned")
    concerned, _ = sift(docs, F.xxhash64(text), of, F.col(x))
    same = F.col(id).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(x))
    made = concerned.join(of, same, "left_semi").select(shingle_sets(F.col(text)).alias("f")).select("f.s", "f.own")
    sets = made.groupBy("s").agg(F.any_value("own").alias("own")).withColumn("n", F.expr("cast(length(own) / 8 as int)"))
    return written(_linked(groups, written(sets, "sets"), True), "verified")


def link(docs: DataFrame, rows: DataFrame, *, id: str, text: str) -> DataFrame:
    """(a, b): links that join all sets of each group. ``rows``: id, x, s, n, fp, beside, bits and keys of each row of ``docs``."""
    near = verified(docs, rows, by_fingerprints(rows), id=id, text=text)
    known = written(components(near), "known")
    return near.unionByName(verified(docs, rows, by_rare_shingles(rows, known), id=id, text=text))


def groups(docs: DataFrame, similarity: float, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, x (a hash of the text) and root (the same for all of a group) of each row of ``docs``."""
    if similarity * DOWN != UP:
        raise ValueError(f"sets are compared at a similarity of {UP}/{DOWN}")
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, text))  # at most FREQUENT hashes and counts
    made = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("x"), _keys(known)(F.col(text)).alias("f"))
    rows = cut(made.select("id", "x", "f.s", "f.n", "f.fp", "f.beside", "f.bits", "f.keys"))
    roots = components(link(docs, rows, id=id, text=text)).withColumnRenamed("node", "s")
    return cut(rows.select("id", "x", "s").join(roots, "s", "left").select("id", "x", F.coalesce("root", "s").alias("root")))
