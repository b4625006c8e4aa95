"""Language identification by character language models.

One interpolated Kneser-Ney model per language over runs of lower-cased letters
(anything else counts as one space). Up to ``GROUP`` languages share, for each order, one
sorted array of n-gram hashes with a row of log probabilities (a column per
language), and one sorted array of context hashes with interpolation weights for
n-grams met in no language of the group; so tables grow with the n-grams that there are, not with their product
with the languages. A language's probabilities do not depend on its group. A text goes to the language with the lowest
cross-entropy in bits a character; ``score`` is the softmax of the
length-normalised entropies at a temperature fitted on calibration texts, and a
text is rejected if its entropy lies far above what calibration texts of its
language have (with an allowance for short texts), or if it has no letter. A language with fewer than ``FEW`` calibration
texts of its own has the limit of all languages' calibration texts together; only where those are fewer too is nothing rejected.

The models are fitted on the driver, on a sample of at most ``fit_rows`` and
``calibrate_rows`` whole texts for each language (those with the smallest hashes of
id and text) and of at most ``sample_bytes`` over all languages, which share them equally. The bounds are parameters. A text that would take over
a quarter of its language's bytes is only sampled if the shorter ones leave room; if no text of a language fits its bytes,
the first of them is, up to as many characters. That is for fitting alone: every text is scored, and scored whole.

Null texts and texts without letters get ``und``, score 0 and are rejected, as is
everything if there is nothing to learn from. Rows whose language is null are
never learned from; rows that repeat id and text are learned from once, and each is scored. Ties in entropy go to the smaller language value. Null ids
are ids like others. An empty table gives no rows. The output column is replaced where the input has it; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

UNDETERMINED = "und"
PAD = "\x01"
#: Characters scored at a time.
PIECE = 1 << 18
#: Languages that share tables; calibration texts that a limit of a language's own takes.
GROUP, FEW = 8, 5
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = [pow(_MULTIPLIER, k, 1 << 64) for k in range(16)]

_letters: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point -> lower-cased letter, space, or the pad."""
    if not _letters:
        table = np.arange(0x20000, dtype=np.uint32)
        for c in range(0x20000):
            ch = chr(c)
            table[c] = ord(ch.lower()[0]) if ch.isalpha() else 32
        table[ord(PAD)] = ord(PAD)
        _letters.append(table)
    return _letters[0]


def _symbols(text: str) -> np.ndarray:
    """The symbols of joined texts; runs of what is no letter become one space."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _classes()
    out = table[np.minimum(raw, 0x1FFFF)]
    high = raw > 0x1FFFF
    if high.any():
        out[high] = raw[high]
    return out


def _squeeze(symbols: np.ndarray) -> np.ndarray:
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32)
    return keep


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(order)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(29))


class _Mixed:
    """Hashes that are mixed when they are taken."""

    def __init__(self, raw: np.ndarray, order: int):
        self.raw, self.order = raw, order

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return _mix(self.raw[at], self.order)


def _raw_hashes(symbols: np.ndarray, order: int, last: bool = False) -> list[np.ndarray]:
    """For n from 1 to ``order`` (or the last only): hashes of the n symbols that end at each position."""
    a = symbols.astype(np.uint64)
    out = [a]
    with np.errstate(over="ignore"):
        for n in range(1, order):
            h = out[-1].copy() if n == 1 or not last else out.pop()
            h[n:] += a[:-n] * np.uint64(_POWERS[n])
            out.append(h)
    return out[-1:] if last else out


class Keys:
    """A sorted array of hashes, with an index of where each leading bit pattern starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(np.ceil(np.log2(max(2, 2 * len(keys))))))
        heads = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        head = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[head], self.starts[head + 1]
        live = np.flatnonzero(at < end)
        at, end, w = at[live], end[live], wanted[live]
        while len(live):
            hit = self.keys[at] == w
            out[live[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            live, at, end, w = live[more], at[more] + 1, end[more], w[more]
        return out


@dataclass
class Part:
    """The tables of some languages, from column ``start`` on."""

    start: int
    grams: list[tuple[Keys, np.ndarray]]  #: for n = 1..order: hashes, log2 probability by language
    contexts: list[tuple[Keys, np.ndarray]]  #: for n = 1..order: hashes of n - 1 symbols, log2 weight by language

    def add(self, hashes: list[np.ndarray], at: np.ndarray, owner: np.ndarray, size: int, floor: float) -> np.ndarray:
        """Log probabilities of the symbols at ``at``, summed by owner and language."""
        total = np.zeros((size, self.grams[0][1].shape[1]))
        live = np.arange(len(at))
        for n in range(len(self.grams), 0, -1):
            keys, values = self.grams[n - 1]
            rows = keys.find(hashes[n - 1][at[live]])
            hit = rows >= 0
            _sum(total, owner[live[hit]], values, rows[hit])
            live = live[~hit]
            if not len(live):
                break
            keys, values = self.contexts[n - 1]
            rows = keys.find(hashes[n - 2][at[live] - 1] if n > 1 else np.zeros(len(live), np.uint64))
            hit = rows >= 0
            _sum(total, owner[live[hit]], values, rows[hit])
        return total + np.bincount(owner[live], minlength=size)[:, None] * floor


def _sum(total: np.ndarray, owner: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
    if len(rows):
        for k in range(values.shape[1]):
            total[:, k] += np.bincount(owner, values[:, k][rows], minlength=len(total))


@dataclass
class Model:
    languages: list[str]
    order: int
    parts: list[Part]
    floor: float  #: log2 of the uniform probability
    sharpness: float = 1.0
    middle: np.ndarray | None = None
    limit: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol by text and language, and the number of symbols."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, str]] = []
        chars = 0
        for k, text in enumerate(texts):
            for start in range(0, len(text), PIECE):
                before = text[max(0, start - self.order + 1) : start].rjust(self.order - 1, PAD)
                piece = before + text[start : start + PIECE]
                group.append((k, piece))
                chars += len(piece)
                if chars >= PIECE:
                    self._add(group, sums, counts)
                    group, chars = [], 0
        if group:
            self._add(group, sums, counts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums / np.maximum(counts, 1)[:, None], counts

    def _add(self, group: list[tuple[int, str]], sums: np.ndarray, counts: np.ndarray) -> None:
        symbols = _symbols("".join(p for _, p in group))
        sizes = np.array([len(p) for _, p in group])
        scored = np.ones(len(symbols), bool)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k in range(self.order - 1):  # the context in front of a piece is not scored
            scored[starts + k] = False
        keep = _squeeze(symbols) | ~scored
        owner = np.repeat(np.arange(len(group)), sizes)[keep]
        symbols, scored = symbols[keep], scored[keep]
        at = np.flatnonzero(scored)
        owner = owner[at]
        size = len(group)
        raw = _raw_hashes(symbols, self.order)
        # Mixed where a table is asked first; with one group of languages most are never asked.
        hashes = [_Mixed(h, n) for n, h in enumerate(raw, 1)] if len(self.parts) == 1 else [_mix(h, n) for n, h in enumerate(raw, 1)]
        total = np.concatenate([part.add(hashes, at, owner, size, self.floor) for part in self.parts], axis=1)
        which = np.array([k for k, _ in group])
        np.add.at(sums, which, total)
        np.add.at(counts, which, np.bincount(owner, minlength=size))

    def classify(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """Language, score, entropy and whether it is accepted, of texts that have letters."""
        h, counts = self.entropies(texts)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(texts)), best]
        weight = np.exp2(np.maximum(-self.sharpness * (h - lowest[:, None]), -1000))
        score = 1 / weight.sum(axis=1)
        ok = lowest <= self.limit[best] + 12 / np.sqrt(np.maximum(counts, 1))
        return [(self.languages[b], float(s), float(e), bool(a)) for b, s, e, a in zip(best, score, lowest, ok, strict=True)]


def _distinct(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct n-grams of ``order`` symbols: hashes, those of their suffixes by length, of their contexts by length, and counts."""
    symbols = _symbols("".join(PAD * (order - 1) + t for t in texts if t))
    symbols = symbols[_squeeze(symbols)].astype(np.uint64)
    at = np.flatnonzero(symbols != ord(PAD))  # pads stand in front of each text, so none is near the start
    _, first, counts = np.unique(_raw_hashes(symbols, order, last=True)[0][at], return_index=True, return_counts=True)
    at = at[first]
    suffixes, contexts = [symbols[at]], [np.zeros(len(at), np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, order):
            older = symbols[at - n]
            suffixes.append(suffixes[-1] + older * np.uint64(_POWERS[n]))
            contexts.append(contexts[-1] + older * np.uint64(_POWERS[n - 1]))
    suffixes = [_mix(h, n) for n, h in enumerate(suffixes, 1)]
    contexts = [_mix(h, n) if n else h for n, h in enumerate(contexts)]
    return suffixes.pop(), suffixes, contexts, counts


def fit(texts: dict[str, list[str]], order: int) -> Model:
    """Kneser-Ney models of texts by language."""
    languages = sorted(texts)
    symbols = [np.unique(_symbols("".join(t))) for t in texts.values()]
    vocabulary = len(np.setdiff1d(np.unique(np.concatenate(symbols)), [ord(PAD)])) + 1
    parts = [_fit([texts[name] for name in languages[k : k + GROUP]], order, k, vocabulary) for k in range(0, len(languages), GROUP)]
    return Model(languages, order, parts, -np.log2(vocabulary))


def _fit(texts: list[list[str]], order: int, start: int, vocabulary: int) -> Part:
    L = len(texts)
    # Of each language, only the distinct n-grams of the highest order are kept: key, suffixes, contexts, count.
    grams: list[tuple[Keys, np.ndarray]] = [None] * order
    contexts: list[tuple[Keys, np.ndarray]] = [None] * order
    found = [_distinct(own, order) for own in texts]
    key = np.concatenate([f[0] for f in found])
    suffixes = [np.concatenate([f[1][n] for f in found]) for n in range(order - 1)]
    ctx = [np.concatenate([f[2][n] for f in found]) for n in range(order)]
    counts = np.concatenate([f[3] for f in found]).astype(np.float64)
    column = np.repeat(np.arange(L), [len(f[3]) for f in found])
    del found
    levels = []
    for n in range(order, 0, -1):
        keys, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        table = np.zeros((len(keys), L))
        np.add.at(table, (inverse, column), counts)
        suffix = suffixes[n - 2][index] if n > 1 else np.zeros(len(keys), np.uint64)
        levels.append((keys, ctx[n - 1][index], suffix, table))
        # The order below counts in how many distinct n-grams of a language each suffix ends one.
        r, c = np.nonzero(table)
        at = index[r]
        if n > 1:
            key = suffixes[n - 2][at]
            suffixes = [s[at] for s in suffixes]
            ctx = [x[at] for x in ctx]
            counts, column = np.ones(len(at)), c
    below = np.full((1, L), 1 / vocabulary)
    below_keys = np.zeros(1, np.uint64)
    for n, (keys, context, suffix, table) in zip(range(1, order + 1), reversed(levels), strict=True):
        ctx_keys, ctx_row = np.unique(context, return_inverse=True)
        lower = below[np.searchsorted(below_keys, suffix)]
        probability, weight = np.zeros((len(keys), L)), np.ones((len(ctx_keys), L))
        for k in range(L):
            once, twice = (table[:, k] == 1).sum(), (table[:, k] == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            total = np.bincount(ctx_row, table[:, k], minlength=len(ctx_keys))
            distinct = np.bincount(ctx_row, table[:, k] > 0, minlength=len(ctx_keys))
            seen = total > 0
            weight[seen, k] = np.maximum(discount * distinct[seen] / total[seen], 1e-9)
            share = np.maximum(table[:, k] - discount, 0) / np.maximum(total, 1)[ctx_row]
            probability[:, k] = share + weight[ctx_row, k] * lower[:, k]
        grams[n - 1] = (Keys(keys), np.asfortranarray(np.log2(probability), np.float32))
        contexts[n - 1] = (Keys(ctx_keys), np.asfortranarray(np.log2(weight), np.float32))
        below, below_keys = probability, keys
    return Part(start, grams, contexts)


def calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """Fit the softmax's temperature and the entropy limits on other texts than ``fit`` saw."""
    L = len(model.languages)
    rows, truth = [], []
    for k, language in enumerate(model.languages):
        own = [t for t in texts.get(language, []) if t]
        rows += own
        truth += [k] * len(own)
    model.limit = np.full(L, np.inf)
    model.middle = np.full(L, np.nan)
    if not rows:
        return
    h, _ = model.entropies(rows)
    truth = np.array(truth)
    gap = h - h.min(axis=1)[:, None]
    losses = []
    grid = np.geomspace(0.5, 64, 15)
    for sharpness in grid:
        weight = np.exp2(np.maximum(-sharpness * gap, -1000))
        losses.append(-np.log2(np.maximum(weight[np.arange(len(rows)), truth] / weight.sum(axis=1), 1e-12)).mean())
    model.sharpness = float(grid[int(np.argmin(losses))])
    best = h.argmin(axis=1)
    right = np.flatnonzero(truth == best)
    for k in range(L):
        own = h[right[truth[right] == k], k]
        if len(own) < FEW:
            own = h[right, truth[right]]  # of all languages
        if len(own) >= FEW:
            model.middle[k], high = np.quantile(own, [0.5, 0.995])
            model.limit[k] = model.middle[k] + 3 * (high - model.middle[k]) + 0.5


def sample(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", allowed: Column | None = None,
    rows: int = 800, sample_bytes: int = 24_000_000, seed: int = 4,
) -> dict[str, list[str]]:
    """By language, at most ``rows`` texts in the order of their hashes, of ``sample_bytes`` in all."""
    some = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if allowed is None else allowed))
    counts = {r[0]: r[1] for r in some.groupBy(F.col(lang).alias("lang")).count().collect()}  # one row a language
    if not counts:
        return {}
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id).cast("string"), text), 11) / float(1 << 53)
    most = int(1.2 * rows + 20)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(0.5, n / most)))])
    drawn = some.select(F.col(lang).alias("lang"), (u * F.element_at(share, F.col(lang))).alias("u"), F.col(text).alias("text")).filter("u < 1")
    room = max(1, sample_bytes // len(counts))
    # First without texts: which ones fit. Rows that repeat others are one, so these are few whatever is repeated.
    size = F.octet_length("text")
    sizes = drawn.select("lang", "u", size.alias("size")).groupBy("lang", "u").agg(F.min("size").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > room // 4, "u")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("filled", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = cut(ranked.filter(f"rank = 1 OR (rank <= {rows} AND filled <= {room})").select("lang", "u"))
    texts = drawn.join(F.broadcast(chosen), ["lang", "u"])  # at most ``rows`` a language
    found: dict[str, list[tuple[float, str]]] = {}
    for r in texts.groupBy("lang", "u").agg(F.min(F.substring("text", 1, room)).alias("text")).collect():  # longer ones only as the first
        found.setdefault(r["lang"], []).append((r["u"], r["text"]))
    return {k: [t for _, t in sorted(v)] for k, v in found.items()}


def learn(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", allowed: Column | None = None,
    order: int = 5, fit_rows: int = 600, calibrate_rows: int = 200, sample_bytes: int = 24_000_000, seed: int = 4,
) -> Model | None:
    """Learn from a bounded sample of the rows that ``allowed`` holds for; None if there are none."""
    wanted = fit_rows + calibrate_rows
    train, held = {}, {}
    for language, own in sample(docs, id=id, text=text, lang=lang, allowed=allowed, rows=wanted, sample_bytes=sample_bytes, seed=seed).items():
        n = len(own) * calibrate_rows // wanted
        held[language], train[language] = own[:n], own[n:]
    train = {k: v for k, v in train.items() if any(ch.isalpha() for t in v for ch in t)}
    if not train:
        return None
    model = fit(train, order)
    calibrate(model, held)
    return model


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("accepted", pa.bool_())])


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """Add the struct ``out`` (lang_pred, score, entropy, accepted). A column of that name is replaced."""
    if model is None:
        nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
        return docs.withColumn(out, nothing)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bounds

    @F.arrow_udf(_RESULT)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            rows = [{"lang_pred": UNDETERMINED, "score": 0.0, "entropy": None, "accepted": False}] * len(texts)
            at = [k for k, t in enumerate(texts) if t is not None]
            for k, found in zip(at, known.classify([texts[k] for k in at]), strict=True):
                rows[k] = dict(zip(("lang_pred", "score", "entropy", "accepted"), found, strict=True))
            yield pa.array(rows, _ARROW)

    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))  # a text without letters counts as null
    return docs.withColumn(out, classify(letters))
