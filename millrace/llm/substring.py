"""Substring dedup by level-wise doubling.

A window of ``window`` words is removed if its word sequence also starts in a
document with a smaller id. Windows are found by levels whose length doubles up
to ``window`` (for 50: 13, 25, 50; the overlap makes up for odd lengths):

1. At the first length, each document puts forward only the windows that are
   least by hash among those inside some full window. Two equal full windows
   put forward the same, so nothing is missed, and few windows in a hundred move.
2. Those that more than one document has are extended to both sides to twice the
   length; those that only one has are dropped. This goes on while any survive,
   up to half the full length.
3. Full windows around survivors are compared: for each, the smallest id that
   starts it, and the documents above that lose the words it covers.

Documents with equal word sequences share one scan: the smallest id stands for
them, and the others are covered as a whole. Counts of a hash are aggregated before
they are shuffled, within each document too, and joins back to documents read written
tables so that Spark can split a passage that very many documents share. Candidates are found
by 64-bit hashes of random word hashes, which can only make too many of them; full windows are judged equal by such a hash
and 32 bits of another one of a different base (96 bits: among 10^12 windows two different ones are taken for equal with a chance
of 10^-5). They are grouped by the first hash alone, which tells for each whether its windows agree in the second; only those that do not
are grouped again by both.

Null texts have no words. Null ids never count as smaller nor as larger, so
nothing is removed from them. Rows with one id count as one document when windows are
compared; rows that repeat another lose what it loses. Texts of any length are read whole, and one document's windows fit
a task. An empty table gives no rows. Only the columns named are read, so others may have any names. If no candidates survive a level, later levels do not run.

Spark deletes a shuffle's files when the driver's JVM collects the frame that made it, so collections are asked for between levels:
otherwise all levels' files are on disk at once.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, cut, sift, written

WINDOW = 50
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xD1342543DE82EF95  #: base of the second hash
_WORDS = 250_000


def levels(window: int) -> list[int]:
    """Lengths of the levels below ``window``, each at least half the next."""
    out, n = [], window
    while len(out) < 2 and n > 1:
        n = -(-n // 2)
        out.append(n)
    return out[::-1]


class Hasher:
    """Hashes of windows of words; keeps word hashes and powers between documents."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.powers: dict[int, np.ndarray] = {}

    def _powers(self, base: int, n: int) -> np.ndarray:
        """At least ``n`` powers of an odd number."""
        if len(self.powers.get(base, ())) < n:
            n = max(2 * n, 4096)
            with np.errstate(over="ignore"):
                self.powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, np.uint64(base)))])
        return self.powers[base]

    def values(self, own: list[bytes]) -> np.ndarray:
        """The words' hashes."""
        known = self.known
        if len(known) > _WORDS:
            known.clear()
        for w in set(own).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))

    def words(self, own: list[bytes]) -> np.ndarray:
        """Running sums from which the hash of any window follows."""
        return self._sums(self.values(own), _BASE)

    def _sums(self, values: np.ndarray, base: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self._powers(base, len(values) + 1)[: len(values)])])

    def windows(self, sums: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
        """Hash of the window that starts at each word."""
        n = len(sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _spread((sums[length:] - sums[:n]) * self._powers(pow(base, -1, 1 << 64), n)[:n])

    def both(self, own: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes, of 64 and 32 bits, of the window that starts at each word."""
        values = self.values(own)
        second = self.windows(self._sums(_spread(values ^ np.uint64(_SECOND)), _SECOND), length, _SECOND)
        return self.windows(self._sums(values, _BASE), length), (second >> np.uint64(32)).astype(np.uint32)


def _spread(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def distinct_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (h, g)."""
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    stray = np.flatnonzero(g[first][group] != g)  # as good as never: other windows of one hash
    first = np.concatenate([first, stray])
    return h[first], g[first]


def are_among(h: np.ndarray, g: np.ndarray, of_h: np.ndarray, of_g: np.ndarray) -> np.ndarray:
    """Which pairs (h, g) are among others."""
    order = np.lexsort((of_g, of_h))
    of_h, of_g = of_h[order], of_g[order]
    found = np.zeros(len(h), bool)
    live = np.arange(len(h))
    at = np.searchsorted(of_h, h)
    while len(live := live[at[live] < len(of_h)]) and len(live := live[of_h[at[live]] == h[live]]):
        found[live] |= of_g[at[live]] == g[live]
        live = live[~found[live]]
        at[live] += 1
    return found


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values."""
    size = 1
    while size < span:
        step = min(size, span - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


def anchors(hasher: Hasher, sums: np.ndarray, window: int) -> np.ndarray:
    """(n, 3) distinct rows: an anchor's hash at the first level, and its two extensions' at the second.

    An extension that would pass an end of the document repeats the other.
    """
    first, second = levels(window)
    h = hasher.windows(sums, first)
    chosen = np.unique(_least(h, window - first + 1))
    at = np.flatnonzero(np.isin(h, chosen))
    wide = hasher.windows(sums, second)
    left, right = at - (second - first), at
    left, right = np.where(left >= 0, left, right), np.where(right < len(wide), right, left)
    return np.unique(np.stack([h[at], wide[left], wide[right]], axis=1), axis=0)


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = (text or b"").split()
                counts.append(len(own))
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                rows = anchors(hasher, hasher.words(own), window) if len(own) >= window else np.zeros((0, 3), np.uint64)
                found.append(rows)
            sizes = np.cumsum([0] + [len(r) for r in found]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros((0, 3), np.int64)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["h", "l", "r"])
            lists = pa.ListArray.from_arrays(pa.array(sizes), fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), lists],
                names=["id", "x", "n_words", "sha", "anchors"],
            )

    return scan


def _candidates(window: int):
    """Per document: its text, packed, and the hashes of full windows around survivors."""
    _, second = levels(window)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, packer = Hasher(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts, hs, gs = [], [], []
            for raw, survivors in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = zstandard.ZstdDecompressor().decompress(raw).split()
                texts.append(packer.compress(b" ".join(own)))
                wide = hasher.windows(hasher.words(own), second)
                hit = np.concatenate([[0], np.cumsum(np.isin(wide, survivors.values.to_numpy().view(np.uint64)))])
                h, g = hasher.both(own, window)
                starts = np.arange(len(h))  # a start is wanted if a survivor lies inside its window
                near = hit[starts + window - second + 1] > hit[starts]
                h, g = distinct_pairs(h[near], g[near])
                hs.append(h.view(np.int64))
                gs.append(g.view(np.int32))
            sizes = np.cumsum([0] + [len(h) for h in hs]).astype(np.int32)
            flat = [pa.array(np.concatenate([np.zeros(0, kind), *own]).astype(kind)) for own, kind in ((hs, np.int64), (gs, np.int32))]
            pairs = pa.StructArray.from_arrays(flat, ["h", "g"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pairs)],
                names=["id", "x", "words", "windows"],
            )

    return find


_REMOVED = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("x", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def _remove(window: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for raw, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = zstandard.ZstdDecompressor().decompress(raw).split()
                h, g = gone.values.field(0).to_numpy().view(np.uint64), gone.values.field(1).to_numpy().view(np.uint32)
                starts = are_among(*hasher.both(own, window), h, g)
                edge = np.zeros(len(own) + 1, np.int64)
                at = np.flatnonzero(starts)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                mask = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, m in zip(own, mask.tolist(), strict=True) if not m])
                out.append((int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), _spans(mask)))
            n, sha, kept, spans = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(spans, spans_type)],
                names=["id", "x", "n_removed", "kept_sha256", "kept", "spans"],
            )

    return remove


@F.arrow_udf(T.BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts, compressed one by one: they are shuffled once."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.array([packer.compress(x or b"") for x in batch.cast(pa.binary()).to_pylist()], pa.binary())


def _shared(rows: DataFrame, *key: str, **more) -> DataFrame:
    """The hashes that more than one document has, each with the smallest id."""
    found = rows.groupBy(*key).agg(F.min("id").alias("least"), F.max("id").alias("most"), *[c.alias(k) for k, c in more.items()])
    return written(found.filter("least < most").select(*key, "least", *more), "shared")


def _free(spark) -> None:
    """Let Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _partly(rows: DataFrame, scanned: DataFrame, docs_of: DataFrame, window: int) -> DataFrame:
    """(id, x, n_removed, kept_sha256, kept, spans) of documents that lose some of their words to others."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], _REMOVED)
    one = scanned.filter("id IS NOT NULL").select("id", F.explode("anchors").alias("a"))
    some = _shared(one.select("id", F.col("a.h").alias("h")), "h").select("h")
    if some.isEmpty():
        return none
    survivors = one.select("id", "a.h", "a.l", "a.r").join(some, "h").select("id", F.explode(F.array("l", "r")).alias("h")).distinct()
    stand = docs_of.filter("id = first").select("id").distinct()
    survivors = written(survivors.join(stand, "id", "left_semi"), "survivors")
    _free(spark)
    some = _shared(survivors, "h").select("h")
    if some.isEmpty():
        return none
    of = written(survivors.join(some, "h").groupBy("id").agg(F.collect_set("h").alias("survivors")), "candidates")
    _free(spark)

    near, _ = sift(rows, F.col("id"), of, F.col("id"))  # documents without candidates are not shuffled
    near = near.select("id", "x", _packed("text").alias("text")).join(of, "id")
    found = written(near.mapInArrow(_candidates(window), "id long, x long, words binary, windows array<struct<h: long, g: int>>"), "windows")
    _free(spark)
    full = found.select("id", F.explode("windows").alias("w")).select("id", "w.h", "w.g")
    earlier = _shared(full, "h", g=F.min("g"), other=F.max("g"))
    if earlier.isEmpty():
        return none
    unlike = earlier.filter("g != other").select("h")
    earlier = earlier.filter("g = other").select("h", "g", "least")
    if not unlike.isEmpty():
        earlier = earlier.unionByName(_shared(full.join(unlike, "h", "left_semi"), "h", "g").select("h", "g", "least"))
    gone = full.join(earlier, ["h", "g"]).filter("id > least").groupBy("id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    gone = written(gone, "gone")
    _free(spark)
    part = found.select("id", "x", "words").join(gone, "id").mapInArrow(_remove(window), _REMOVED)
    return part.filter("n_removed > 0").dropDuplicates(["id", "x"])


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, x (hash of the text), n_words, n_removed, kept_sha256, kept and spans.

    ``kept`` is the remaining words joined by one space, and ``spans`` the removed ranges of
    words; both are null where nothing is removed. ``id`` must be a long.
    """
    if window < 3:
        raise ValueError("windows of fewer than three words have no two levels below them")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("text"))
    row = "id long, x long, n_words long, sha string, anchors array<struct<h: long, l: long, r: long>>"
    scanned = written(rows.mapInArrow(_scan(window), row), "scanned")
    same = cut(scanned.groupBy("sha").agg(F.min("id").alias("first")))
    docs_of = written(scanned.select("id", "x", "n_words", "sha").join(same, "sha"), "documents")

    part = _partly(rows, scanned, docs_of, window)
    whole = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return docs_of.join(part, ["id", "x"], "left").select(
        "id", "x", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, everything).otherwise(F.col("spans")).alias("spans"),
    )


def drop_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated windows. Texts that lose words become what is left, joined by one space; others stay as
    they are, and documents that lose all words are left out."""
    i, x, kept = apart(docs, "_id", "_x", "_kept")
    found = dedup(docs, id=id, text=text, window=window).filter("n_removed > 0")
    found = found.select(F.col("id").alias(i), F.col("x").alias(x), F.col("kept").alias(kept)).dropDuplicates([i, x])
    found = written(found, "changed")
    some, rest = sift(docs, F.xxhash64(text), found, F.col(x))
    rows = some.join(found, (F.col(id).cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(x)), "left")
    rows = rows.filter(F.col(kept).isNull() | (F.col(kept) != ""))
    return rest.unionByName(rows.withColumn(text, F.coalesce(kept, text)).select(*docs.columns))
