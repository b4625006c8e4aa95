"""Properties that hold for any input."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import mpeg as M
from millrace.llm import warc as W
from millrace.llm.html import main_text
from millrace.llm.simhash import forest, fuzzy_keys
from millrace.llm.substring import Hasher, _least, anchors, are_among, distinct_pairs, levels

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), max_size=80)


@given(st.binary(max_size=4000))
@settings(max_examples=80, deadline=None)
def test_mpeg_carries_any_bytes(raw):
    media = M.pack(raw)
    assert M.unpack(media) == M.padded(raw) and len(M.padded(raw)) % 192 == 0
    audio = M.parse(media)
    assert audio.crc_bad == audio.skipped == audio.resyncs == 0 and audio.crc_good == len(audio.offsets)


@given(st.binary(max_size=3000))
@settings(max_examples=80, deadline=None)
def test_mpeg_parser_takes_any_bytes(raw):
    a = M.parse(raw)
    assert a.offsets == sorted(a.offsets)


@given(WORDS, st.sampled_from([1, 3, 5]))
@settings(max_examples=100, deadline=None)
def test_window_hashes_are_equal_as_windows_are(words, length):
    h = Hasher()
    found = h.windows(h.words(words), length)
    windows = [tuple(words[k : k + length]) for k in range(len(words) - length + 1)]
    assert len(found) == len(windows)
    assert len(set(found.tolist())) == len(set(windows))


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=40), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=20))
@settings(max_examples=200, deadline=None)
def test_pairs_of_hashes_are_found_though_one_half_collides(asked, known):
    a, b = (np.array(x, np.uint64).reshape(-1, 2) for x in (asked, known))
    assert are_among(a[:, 0], a[:, 1], b[:, 0], b[:, 1]).tolist() == [x in known for x in asked]
    if asked:
        assert set(zip(*(x.tolist() for x in distinct_pairs(a[:, 0], a[:, 1])), strict=True)) == set(asked)


@given(WORDS, st.sampled_from([1, 3, 5]))
@settings(max_examples=100, deadline=None)
def test_both_hashes_are_equal_as_windows_are(words, length):
    h, g = Hasher().both(words, length)
    windows = [tuple(words[k : k + length]) for k in range(len(words) - length + 1)]
    assert len(set(h.tolist())) == len(set(g.tolist())) == len(set(zip(h.tolist(), g.tolist(), strict=True))) == len(set(windows))
    assert not set(h.tolist()) & set(g.tolist())


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_running_minimum(values, span):
    if span <= len(values):
        got = _least(np.array(values, np.uint64), span).tolist()
        assert got == [min(values[k : k + span]) for k in range(len(values) - span + 1)]


@given(WORDS, WORDS, WORDS)
@settings(max_examples=100, deadline=None)
def test_equal_windows_put_forward_a_common_anchor(before, after, other):
    """Two documents that share a window have an anchor in common, with an extension to one side."""
    window = 12
    shared = [b"w%d" % (k % 7) for k in range(window)]
    h = Hasher()
    one, two = (anchors(h, h.words(w), window) for w in (before + shared + after, other + shared))
    assert set(one[:, 0].tolist()) & set(two[:, 0].tolist())
    assert set(one[:, 1:].ravel().tolist()) & set(two[:, 1:].ravel().tolist())
    assert levels(50) == [13, 25]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 63))
@settings(max_examples=60, deadline=None)
def test_forest_joins_what_links_join(values, bit):
    fps = np.unique(np.array(values + [v ^ (1 << bit) for v in values], np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    a, b = forest(fps)
    assert len(a) < len(fps)
    parent = {int(f): int(f) for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 64
        parent[root(x)] = root(y)
    joined = {(int(x), int(y)) for x in fps for y in fps if root(int(x)) == root(int(y))}
    reach = near.copy()
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert joined == {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(reach), strict=True)}


def test_forest_of_many_alike_takes_little_memory():
    """32,768 fingerprints within four bits of each other."""
    import tracemalloc

    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 200_000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200_000, dtype=np.uint64)))
    fps = np.unique(np.concatenate([fps, rng.integers(0, 2**64, 32768 - len(fps), dtype=np.uint64)]))
    tracemalloc.start()
    a, _ = forest(fps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 1 + 64 * 63 // 2 - 1 and peak < 400 << 20


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_keys_are_distinct_for_each_fingerprint(values):
    fps = np.array(values, np.uint64)
    rows, keys = fuzzy_keys(fps)
    assert len(set(zip(rows.tolist(), keys.tolist(), strict=True))) == len(rows) <= len(fps) * 72


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_html_of_any_text_has_trimmed_blocks(page):
    text = main_text(page)
    for block in text.split("\n\n") if text else []:
        assert block == " ".join(block.split()) and block


@given(st.lists(st.tuples(st.integers(0, 5), st.text(max_size=20), st.binary(max_size=200)), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None)
def test_archives_give_back_what_was_written(pages):
    import hashlib
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        w = W.Writer(folder, "t")
        for i, url, raw in pages:
            w.add(W.page_record(i, url, raw, hashlib.sha1(raw).hexdigest(), i))
        found = []
        for path, _, _ in w.finish():
            with open(path, "rb") as f:
                found += [block.partition(b"\r\n\r\n")[2] for h, block in W.records(W.frames(f)) if h["warc-type"] == "response"]
    assert found == [raw for _, _, raw in pages]


@pytest.mark.parametrize("share,least", [(0, None), (7, None), (1, None), (7, 1 << 10)])
def test_sift_keeps_every_key(spark, monkeypatch, share, least):
    from millrace.llm import common
    from millrace.llm.common import prepare, sift
    from pyspark.sql import functions as F

    prepare(spark)
    if least:  # the sieve grows with its keys
        monkeypatch.setattr(common, "SIEVE_BITS", least)
    df = spark.range(5000).withColumn("_row", F.lit(1))
    keys = df.filter(F.col("id") % share == 0 if share else F.lit(False)).select(F.col("id").alias("k"))
    some, rest = (set(r.id for r in part.collect()) for part in sift(df, F.col("id"), keys, F.col("k")))
    assert not some & rest and some | rest == set(range(5000))
    assert {r.k for r in keys.collect()} <= some and len(some) <= 5000 // share + (20 if least is None else 600) if share else not some


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX", b"ID3\x04\0\0\0\0\0\x05", b"VBRI", b"Xing", b"\xff\xfb\x90\xc0", b"APETAGEX\xd0\x07\0\0\xff\xff\0\0"])
def test_mpeg_payload_may_look_like_any_mark_anywhere(mark):
    """A mark at every offset of texts whose last frame has one to four units, and of those that end close behind it."""
    for at in range(1600):
        for size in {at + len(mark), at + len(mark) + 101, 1600}:
            raw = (b"A" * at + mark).ljust(size, b"C")
            found = M.describe(M.pack(raw), strict=True)
            assert (found["n_bytes"], found["payload_bytes"], found["tags"], found["resyncs"]) == (len(raw), len(M.padded(raw)), "id3v2.4", 0)
            assert found["payload_sha256"] == hashlib.sha256(M.padded(raw)).hexdigest()


def test_mpeg_of_headers_that_are_cut_off_or_foreign():
    head = bytes([0xFF, 0xFB, 0x10, 0xC0])  # 32 kbit/s: a frame of 104 bytes, which a VBRI header fits barely
    size = M.header(head).size
    for cut in (36, 48, 61, size):
        M.parse((head + bytes(32) + b"VBRI" + b"\xff" * 200)[:cut])
    small = bytes([0xFF, 0xF3, 0x14, 0xC0])  # 8 kbit/s at 24 kHz: the frame is 24 bytes, the header would lie behind it
    assert M.header(small).size == 24
    M.parse(small + bytes(32) + b"VBRI" + bytes(8))
    text = b"\x03payload-bytes\0" + b"7"
    tag = b"TXXX" + M._to_syncsafe(len(text)) + b"\0\0" + text
    foreign = b"ID3\x04\0\0" + M._to_syncsafe(len(tag)) + tag + (head + bytes(size - 4)) * 3
    assert M.describe(foreign)["n_bytes"] is None and M.describe(foreign)["frames"] == 3
    media = M.pack(b"x" * 5000)
    for broken in (media[:-700], media[: len(media) - 600] + b"\0\0" + media[len(media) - 598 :]):
        assert M.describe(broken)["n_bytes"] is None
        with pytest.raises(ValueError, match="give back"):
            M.describe(broken, strict=True)


@given(st.binary(max_size=900), st.sampled_from([b"", b"TAG", b"APETAGEX", b"VBRI", b"ID3\x04"]), st.integers(0, 899))
@settings(max_examples=150, deadline=None)
def test_mpeg_parser_counts_every_byte_once(raw, mark, at):
    raw = raw[:at] + mark + raw[at:]
    a = M.parse(raw)
    assert 0 <= a.skipped <= len(raw) and a.resyncs >= 0


def test_mpeg_index_has_exact_durations_and_seek_offsets():
    for n in (0, 1, 192, 193, 768, 769, 5000):
        media = M.pack(b"y" * n)
        found = M.describe(media)
        frames = -(-len(M.padded(b"y" * n)) // 768)
        assert found["frames"] == frames and found["samples"] == 1152 * frames and found["duration_s"] == 1152 * frames / 48000
        for at, nxt in zip(found["seek"], [*found["seek"][1:], len(media)], strict=True):
            assert media[at] == 0xFF and M.header(media[at : at + 4]).size == nxt - at
