"""Operators over conversations, pages and embeddings, and the pipeline, against brute force and on edge cases."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from conftest import DATA
from millrace.llm import queries as Q
from millrace.llm.common import fresh_path, prepare, shared_dir

SF = f"{DATA}/sf0.001"


def table(spark, rows, schema, name, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


# --- Chat

CHAT = "conv_id bigint, turn bigint, role string, text string, message string, conversation string, seq string"
TRICKS = ["</s>", "<\\s>", "<\\\\/s>", "[INST]x[/INST]", "[\\INST]", "<s></s><s>", "<<s>>", "\\", "<", "a\n\nb", "é😀", "[[INST]]", "<\\s", ""]


def chat_brute(rows):
    talks = defaultdict(list)
    for c, t, r, x, *_ in rows:
        talks[c].append(((t is not None, t or 0), r or "", x or ""))
    talks[-1] = [((True, k), r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))] + talks.get(-1, [])
    out = set()
    for c, turns in talks.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out.add((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return out


def test_chat_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r)[:5] for r in Q.op1_chat(spark, SF).collect()} == chat_brute(rows)


def test_chat_edges(spark, tmp_path_factory):
    pick = random.Random(3)
    rows = [(c, k, pick.choice(["user", "assistant", "system", "</s>", "", "tool\nx"]), pick.choice(TRICKS) + pick.choice(TRICKS), "m", "c", "s") for c in range(40) for k in range(pick.randint(1, 6))]
    rows += [(50, None, None, None, "", "", ""), (50, 1, "assistant", None, "", "", ""), (51, 0, "user", "same", "", "", ""), (51, 0, "user", "same", "", "", ""), (None, 0, "user", "x", "", "", "")]
    rows += [(52, k, "assistant", "y" * 200, "", "", "") for k in range(1500)] + [(53, 0, "user", "z" * 300_000, "", "", "")]
    path = table(spark, rows, CHAT, "conversations", tmp_path_factory)
    assert {tuple(r)[:5] for r in Q.op1_chat(spark, path).collect()} == chat_brute(rows)


def test_chat_of_nothing(spark, tmp_path_factory):
    found = Q.op1_chat(spark, table(spark, [], CHAT, "conversations", tmp_path_factory)).collect()
    assert [r.conv_id for r in found] == [-1]


def fold_brute(log):
    """Final (message, role, text) of one conversation's events in order, one by one."""
    alive = {}
    order = ("message", "regenerate", "edit", "delta")
    for _, kind, message, role, text in sorted(log, key=lambda e: (e[0] is None, e[0] or 0, order.index(e[1] or "message"), e[3] or "", e[4] or "")):
        kind, role, text = kind or "message", role or "", text or ""
        if kind == "message":
            alive[message] = [role, text]
        elif message not in alive:
            continue
        elif kind == "delta":
            alive[message][1] += text
        elif kind == "edit":
            alive[message][1] = text
        else:
            alive[message][1] = ""
            alive = {m: v for m, v in alive.items() if m <= message}
    return [(m, *alive[m]) for m in sorted(alive)]


def test_chat_query_folds_deltas_edits_and_regenerations(spark):
    from millrace.llm.chat import as_log, as_stream, fold

    prepare(spark)
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    names = {"conversation": "conv_id", "turn": "turn", "role": "role", "text": "text"}
    log = as_stream(rows, **names)
    kinds = Counter(r.kind for r in log.select("kind").collect())
    n = rows.count()
    assert kinds["edit"] + kinds["regenerate"] == n and kinds["message"] == n + kinds["regenerate"] and kinds["regenerate"] > n // 4
    long = {(r.conv_id, r.turn): len(r.text) for r in rows.collect() if len(r.text or "") > 256}
    assert long and kinds["delta"] > 2 * len(long)
    final = [tuple(r) for r in fold(log).select("conversation", "message", "role", "text").collect()]
    whole = [tuple(r) for r in fold(as_log(rows, **names)).select("conversation", "message", "role", "text").collect()]
    assert Counter(final) == Counter(whole) and len(final) == n
    events = defaultdict(list)
    for r in log.collect():
        events[r.conversation].append((r.seq, r.kind, r.message, r.role, r.text))
    got = defaultdict(list)
    for c, *rest in final:
        got[c].append(tuple(rest))
    assert {c: fold_brute(v) for c, v in events.items()} == {c: sorted(v) for c, v in got.items()}


def test_fold_of_rows_without_numbers_ties_and_other_kinds(spark):
    from millrace.llm.chat import fold

    logs = {
        1: [(None, "message", 0, "user", "a"), (None, "delta", 0, None, "c"), (None, "delta", 0, None, "b")],
        2: [(5, "delta", 0, None, "x"), (5, None, 0, "user", None), (None, "delta", 0, None, "z"), (6, "delta", 0, None, "y"), (6, "delta", 0, None, "y")],
        3: [(1, "message", 0, "user", "a"), (1, "edit", 0, None, "b"), (1, "message", 1, "assistant", "gone"), (1, "regenerate", 0, None, None), (1, "delta", 0, None, "c")],
        4: [(1, "delta", 0, None, "nothing opens this"), (2, "message", 1, None, "q")],
    }
    rows = [(c, *e) for c, log in logs.items() for e in log] + [(1, 0, "other", 0, "user", "no event")]
    got = defaultdict(list)
    for r in fold(spark.createDataFrame(rows, "conversation long, seq long, kind string, message long, role string, text string")).collect():
        got[r.conversation].append((r.message, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == {c: fold_brute(log) for c, log in logs.items()}
    assert got[1] == [(0, "user", "abc")] and got[2] == [(0, "user", "xyyz")]


def test_fold_of_streams_edits_and_regenerations(spark):
    from millrace.llm.chat import fold, format_log, parse

    pick = random.Random(4)
    rows, want = [], {}
    for c in range(60):
        log, opened = [], 0
        for seq in range(pick.randint(1, 25)):
            if not opened or pick.random() < 0.3:
                log.append((seq, "message", opened, pick.choice(["user", "assistant"]), pick.choice(["", "hi "])))
                opened += 1
            else:
                kind = pick.choice(["delta", "delta", "delta", "edit", "regenerate"])
                log.append((seq, kind, opened - 1 if kind != "regenerate" else pick.randrange(opened), None, f"{kind}{seq} "))
                if kind == "regenerate":
                    opened = log[-1][2] + 1
        rows += [(c, *e) for e in log]
        want[c] = fold_brute(log)
    pick.shuffle(rows)
    log = spark.createDataFrame(rows, "conversation long, seq long, kind string, message long, role string, text string")
    got = defaultdict(list)
    for r in fold(log).collect():
        got[r.conversation].append((r.message, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == want
    for r in parse(format_log(log)).collect():
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in want[r.conversation]]
        assert "".join(r.learned) == "".join(text for _, role, text in want[r.conversation] if role == "assistant")
        for s in r.loss_spans:
            assert s.start + s.chars <= len(r.formatted)


def test_escape_is_reversible_and_leaves_no_control_strings(spark):
    from millrace.llm.chat import END, ROLE, ROLE_END, START, escape, unescape
    from pyspark.sql import functions as F

    pick = random.Random(5)
    texts = ["".join(pick.choice(["<", "s>", "/", "\\", "[", "INST]", "x"]) for _ in range(pick.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in (START, END, ROLE, ROLE_END))


def test_chat_runs_no_python(spark):
    text = Q.op1_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


# --- WARC

PAGES = "page_id bigint, url string, html string, id string, sha1 string, first string"
PAGE_ROWS = [
    (3, "http://a/\n1", "<p>x</p>", "", "", ""), (1, "http://b", "<p>x</p>", "", "", ""), (2, None, None, "", "", ""), (5, "u", "", "", "", ""), (4, "é", "é" * 100_000, "", "", ""),
    (7, "v", "one", "", "", ""), (7, "v", "one", "", "", ""), (None, "w", "one", "", "", ""), (None, "w", "alone", "", "", ""),
]


def warc_brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        least = first.get(h or "")
        revisit = least is not None and i != least
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", least if revisit else None] += 1
    return out


@pytest.mark.parametrize("which", ["plain", "edges", "empty"])
def test_warc(spark, tmp_path_factory, which):
    rows = {"plain": None, "edges": PAGE_ROWS, "empty": []}[which]
    path = SF if rows is None else table(spark, rows, PAGES, "pages", tmp_path_factory)
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in Q.op8_warc(spark, path).collect()) == warc_brute(rows)


def test_warc_with_a_sieve_that_everything_passes(spark, tmp_path_factory, monkeypatch):
    from millrace.llm import common as C

    monkeypatch.setattr(C, "SIEVE_BITS", 64)
    monkeypatch.setattr(C, "SIEVE_MOST", 64)
    monkeypatch.setattr(C, "_ROW_BITS", 32)
    rows = [(k, f"u{k}", f"page {k % 70} {k if k % 3 else ''}", "", "", "") for k in range(300)] + PAGE_ROWS
    path = table(spark, rows, PAGES, "pages", tmp_path_factory)
    assert Counter(tuple(r) for r in Q.op8_warc(spark, path).collect()) == warc_brute([r[:3] for r in rows])


def test_archives_begin_with_their_dictionary_and_records_stand_alone(spark, monkeypatch):
    from millrace.llm import warc as W

    prepare(spark)
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    manifest = W.archive(pages, fresh_path(spark, "warc"))
    files = manifest.collect()
    for f in files:
        raw = open(f.archive, "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == W.DICTIONARY_MAGIC and len(raw) > f.bytes
        own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        rest, kinds = raw[8 + size :], Counter()
        while rest:
            one = own.decompressobj()
            record = one.decompress(rest)
            rest = one.unused_data
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            kinds[record.split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode()] += 1
        assert kinds["warcinfo"] == 1 and kinds["response"] + kinds["revisit"] == f.records
    back = W.read_archives(manifest).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(r.digest_holds and r.payload.decode() == html[r.page_id] for r in back if r.record_type == "response")
    assert len(back) == len(html) == sum(f.records for f in files)


def test_new_files_begin_when_one_is_full(tmp_path, monkeypatch):
    from millrace.llm import warc as W

    monkeypatch.setattr(W, "FILE", 20_000)
    monkeypatch.setattr(W, "SAMPLE", 50_000)
    w = W.Writer(str(tmp_path), "t")
    for k in range(300):
        w.add(W.page_record(k, "u", random.Random(k).randbytes(700), hashlib.sha1(b"%d" % k).hexdigest(), k))
    done = w.finish()
    assert len(done) > 3 and sum(n for _, n, _ in done) == 300
    for path, n, _ in done:
        with open(path, "rb") as f:
            assert sum(h["warc-type"] == "response" for h, _ in W.records(W.frames(f))) == n


# --- HTML


def test_html_equals_the_article(spark):
    import html

    for r in Q.op10_html(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        own = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in own if b) and r.n_chars == len(r.text)


HTML_CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain words only", "plain words only"),
    ("<article><p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&nbsp;c</p></article>", "a <b> &amp; éA c"),
    ("<article><p>one<br>two\n three</p><!-- <p>no</p> --><p>fo<b>u</b>r</p><script>var x='</p><p>no';</script></article>", "one two three\n\nfour"),
    ("<article><p>kept</p><aside><p>not this sidebar</p></aside><p>too</p></article><footer>not this</footer>", "kept\n\ntoo"),
    ("<article><p title=\"a > b\">x</p><form><p>Name</p><select><option>one</select></form></article>", "x"),
    ("<article><p>x</p></article><div class='comments'><p>I think so too, and so do all of my friends.</p></div>", "x"),
    ("<ARTICLE><P>loud</P></ARTICLE><style>p{}", "loud"), ("<article><p>cut off in a <b", "cut off in a <b"), ("<article><p>x</p><script>never closed <p>no</p>", "x"),
    ("<article><p>x</p><p class='advert'>Buy it all today</p><p id=intro>y</p><h2 class='share-title'>Tell others</h2>z</article>", "x\n\ny\n\nz"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize("page,text", HTML_CASES)
def test_html_cases(page, text):
    from millrace.llm.html import main_text

    assert main_text(page) == text


def test_html_tree_fits_its_table_and_uses_words_and_neighbours():
    from millrace.llm import html as H

    rows, labels = H.labelled(H.pages())
    assert np.mean([H.keeps(H.tree(), tuple(r)) == bool(y) for r, y in zip(rows, labels, strict=True)]) >= 0.99
    for feature in ("words ", "link_density", "words_around", "words_after"):
        assert feature in H.described(H.tree())
    table, n = H.pages(), len(H.pages()) // 4
    held = []
    for k in range(n):  # leave one layout out, in all languages
        root = H.grow(*H.labelled([p for j, p in enumerate(table) if j % n != k]))
        held += [H.keeps(root, tuple(r)) == bool(y) for r, y in zip(*H.labelled([p for j, p in enumerate(table) if j % n == k]), strict=True)]
    assert np.mean(held) >= 0.93


@pytest.mark.parametrize("page,text", [
    ("<article class='search-page'><p>Para one of the page.</p><p>Two</p></article>", "Para one of the page.\n\nTwo"),
    ("<article><h1>T</h1><div class='alert-news'><p>Para one.</p></div></article>", "T\n\nPara one."),
    ("<article><p class='legal'>Short legal text.</p></article>", "Short legal text."),
    ("<div class='post-search-results'><article><p>Para one.</p></article></div>", "Para one."),
    ("<div class='left-rail-free wide'><article><p>Para one.</p></article></div>", "Para one."),
    ("<form id=page><article><p>Para one.</p><p>Two</p></article></form>", "Para one.\n\nTwo"),
    ("<article><p title=don't>Para one is here.</p><p>He can't do it.</p><p>Third</p></article>", "Para one is here.\n\nHe can't do it.\n\nThird"),
    ("<article><p class=\"x>Para one here.</p><p>Two</p></article>", "Para one here.\n\nTwo"),
    ("<article><p data-x='a > b' title = \"c > d\">One</p><p title=a\"b>Two</p></article>", "One\n\nTwo"),
    ("<article><p>One</p><nav><a href=1>Back</a></nav><div class='share-links'><a href=2>Send it</a></div><div class=notice>We count visits.</div></article>", "One"),
    ("<article><p>One</p><section class='comments'><article><p>I think so too, and so do all of my friends.</p></article></section></article>", "One"),
    ("<header><p>The Paper</p></header><article><header><h1>Title</h1></header><p>One</p><footer><p>By me</p></footer></article>", "Title\n\nOne"),
    ("<article><p>One</p><p>Two <a href=x", "One\n\nTwo <a href=x"), ("a </é b> c <- d <3 e", "a c <- d <3 e"), ("<article><p>One</p><!--> Two", "One\n\nTwo"),
])
def test_html_words_in_class_names_and_quotes_take_no_text(page, text):
    from millrace.llm.html import main_text

    assert main_text(page) == text


S = "The council met on Monday and agreed to repair the old bridge."
L = "Work begins next week and should end in spring, though the engineers warn that heavy rain may delay the plan by a month or more, as it did last year."


@pytest.mark.parametrize("page,blocks", [
    (f"""<body><header class='site-header'><a href=/>Logo</a><form id=find><input type=search><button>Search</button></form></header><div id=content class=page-body role=main>
        <h1>Bridge</h1><div id=text><p>{L} <a href=x>old bridge</a>.</p><div id=toc role=navigation><h2>Contents</h2><ul><li><a href=#a>1 History</a></li><li><a href=#b>2 Design</a></li></ul></div>
        <h2>History</h2><p>{S} {L}</p><ul><li>Stone bridge</li><li>Wooden bridge</li></ul><p>{L}</p></div></div><div id=navigation><h2>Navigation menu</h2><ul><li><a>Log in</a></li></ul></div>
        <footer id=footer><ul><li>This page was last edited on 1 May 2020, at 10:00.</li></ul></footer></body>""",
     ["Bridge", f"{L} old bridge.", "History", f"{S} {L}", "Stone bridge", "Wooden bridge", L]),
    (f"""<body class='single has-sidebar'><div id=page><nav><ul><li><a href=/>Home</a></li></ul></nav><main id=main class=site-main><article class='post has-post-thumbnail category-news tag-menu'>
        <header><h1>Title of post</h1></header><div class=entry><p>{S}</p><p>{L}</p><div class='sharing-enabled'><h3>Share this:</h3><ul><li class=share-twitter><a>Twitter</a></li></ul></div></div></article>
        <div id=comments class=comments-area><h2 class=comments-title>2 thoughts</h2><ol class=comment-list><li class=comment><article class=comment-body><p>{S} I agree.</p></article></li></ol>
        <form class=comment-form><p>Leave a reply</p></form></div></main><aside class=widget-area><section class=widget><h2>Recent</h2><ul><li><a>Other</a></li></ul></section></aside></div>""",
     ["Title of post", S, L]),
    (f"""<main><article><h1>A</h1><p>{S}</p><div class=ad-container><div class=ad>Buy now cheap</div></div><p>{L}</p><div class='newsletter-signup'><h3>Get our newsletter</h3><p>{S}</p></div><p>End.</p></article>
        <section class=related-articles><h2>Related</h2><a href=1>One more</a></section></main>""", ["A", S, L, "End."]),
    (f"<div id=cookie-banner class='cookie-consent'><p>{L}</p></div><article><p>{S}</p></article><div class=modal><p>Subscribe today!</p></div>", [S]),
    ("<nav><a href=/>ホーム</a></nav><article><h1>古い橋</h1><p>市議会は月曜日に古い橋を修理することを決めました。</p></article><footer>著作権</footer>", ["古い橋", "市議会は月曜日に古い橋を修理することを決めました。"]),
])
def test_html_of_pages_as_sites_make_them(page, blocks):
    from millrace.llm.html import main_text

    assert main_text(page).split("\n\n") == blocks


def test_html_tells_text_from_the_rest_where_only_words_and_links_do():
    from millrace.llm.html import main_text

    pick = random.Random(1)
    words = "the of river stone council bridge and a to on when who".split()

    def line(n):
        return " ".join(pick.choice(words) for _ in range(n))

    right = 0
    for _ in range(200):
        own = [line(pick.choice([20, 30, 50, 80])) for _ in range(pick.randint(3, 10))]
        bar = "<div class=x>" + " ".join(f"<a href=1>{pick.choice(words)}</a>" for _ in range(5)) + "</div>"
        page = bar + "<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>" + bar + "<div>copyright me</div>"
        right += main_text(page) == "\n\n".join(own)
    assert right >= 190


def features_brute(page_blocks):
    """The features again, block by block, from their definitions."""
    out = []
    for k, b in enumerate(page_blocks):
        near = [page_blocks[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(page_blocks)]
        before, after = (page_blocks[j] if 0 <= j < len(page_blocks) else None for j in (k - 1, k + 1))
        inside = sum(x.words for x in page_blocks if x.article) / sum(x.words for x in page_blocks)
        out.append((
            b.words, b.density, *((x.words, x.density) if x else (0, 0.0) for x in (before, after)), max((x.words for x in near), default=0), int(b.article),
            4 if b.landmark == 2 or b.readers else {0: 0, 1: 1, 2: 3}[max(b.hint, 0)], 0.0 if b.article else inside, int(b.heading), int(b.item), int(b.text.endswith(tuple(".!?…:;\"'»”)。"))),
        ))
    return [(w, d, *b, *a, *rest) for w, d, b, a, *rest in out]


def test_html_query_equals_blocks_features_and_tree_by_another_reader(spark):
    """Blocks by Python's own parser, features from their definitions, the tree by its printed text."""
    from html.parser import HTMLParser

    from millrace.llm import html as H

    rules = H.described(H.tree()).splitlines()

    def verdict(row, at=0):
        line = rules[at].strip()
        if line in ("keep", "drop"):
            return line == "keep"
        name, sign, cut = line.split()
        depth = len(rules[at]) - len(line)
        if (row[H.FEATURES.index(name)] <= float(cut)) == (sign == "<="):
            return verdict(row, at + 1)
        return verdict(row, next(k for k in range(at + 1, len(rules)) if len(rules[k]) - len(rules[k].strip()) == depth))

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.links, self.stack, self.linked, self.flags = [], "", "", [], False, [False, False]

        def end(self):
            own = " ".join(self.text.split())
            if own:
                names = [n for n, _ in self.stack]
                n = max(len(own.split(" ")), len(own) // 8)
                links = " ".join(self.links.split())
                density = min(1.0, max(len(links.split(" ")), len(links) // 8) / n) if links else 0.0
                landmark = 2 if {"nav", "footer"} & set(names) else 0
                self.out.append(H.Block(own, 0, n, density, "article" in names, landmark, 2 if any(c == "ad" for _, c in self.stack) else 0, False, *self.flags))
            self.text = self.links = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.handle_data(" ")
            elif tag == "a":
                self.linked, self.links = True, self.links + " "
            elif tag in H._BLOCK | {"title", "style", "script"}:
                self.end()
                if tag in H._HEADING:
                    self.flags[0] = True
                elif tag == "li":
                    self.flags[1] = True
                elif tag == "p":
                    self.flags[0] = False
                elif tag in H._OPEN or tag in ("title", "style", "script"):
                    self.flags, self.linked = [False, False], False
                    self.stack.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            if tag == "a":
                self.linked = False
            elif tag in H._BLOCK | {"title", "style", "script"}:
                if tag in ("title", "style", "script"):
                    self.text = ""
                self.end()
                if tag in H._HEADING:
                    self.flags[0] = False
                elif tag == "li":
                    self.flags[1] = False
                elif tag == "p":
                    self.flags[0] = False
                elif any(n == tag for n, _ in self.stack):
                    self.flags, self.linked = [False, False], False
                    while self.stack.pop()[0] != tag:
                        pass

        def handle_data(self, data):
            self.text += data
            if self.linked:
                self.links += data

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    for r in Q.op10_html(spark, f"{DATA}/sf0.01").collect():
        reader = Reader()
        reader.feed(pages[r.page_id] or "")
        reader.close()
        reader.end()
        want = "\n\n".join(b.text for b, row in zip(reader.out, features_brute(reader.out), strict=True) if verdict(row))
        assert r.text == want


@pytest.mark.parametrize("piece", ["<a b ", "<p '", "<a b=\"", "<a b=\">\" ", "<div>x", "<!--", "<script>", "</", "<svg>", "<button><div>", "<p>x</p>", "</section><div>", "<p a=b", "&amp"])
def test_html_takes_time_by_length(piece):
    import time

    from millrace.llm.html import main_text

    began = time.process_time()
    main_text(piece * (5_000_000 // len(piece) // (10 if "<div>" in piece or "<p>" in piece or "svg" in piece else 1)))
    assert time.process_time() - began < 10


def test_html_of_damaged_pages_ends(spark):
    from millrace.llm.html import main_text

    pick = random.Random(6)
    parts = ["<", ">", "<p", "</p>", '"', "'", "<!--", "-->", "<script>", "<a href='x", "&amp", "x ", "<article>", "</", "=", "<![CDATA["]
    for _ in range(300):
        main_text("".join(pick.choice(parts) for _ in range(200)))
    main_text("<p " + "x" * 200_000)
    main_text("<a b=\"" * 20_000)


def test_html_edges(spark, tmp_path_factory):
    rows = [(1, None, None, "", "", ""), (1, None, None, "", "", ""), (None, "u", "<article><p>x</p></article>", "", "", "")]
    found = Q.op10_html(spark, table(spark, rows, PAGES, "pages", tmp_path_factory)).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in found) == Counter({(1, "", 0): 2, (None, "x", 1): 1})
    assert Q.op10_html(spark, table(spark, [], PAGES, "pages", tmp_path_factory)).collect() == []


# --- Embeddings

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, node bigint"


def links_brute(rows, threshold=0.95):
    ids = [r[0] for r in rows]
    unit = []
    for r in rows:
        v = r[1]
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(float) if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return Counter((v, n[i], least.get(root(i)), v is not None and v == least.get(root(i))) for i, v in enumerate(ids))


def clusters(n, groups, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((n, dim))
    for g in range(groups):
        own = rng.integers(0, n, 12)
        out[own] = out[own[0]] + rng.uniform(0.02, 0.25) * rng.standard_normal((12, dim))
    return out.astype(np.float32)


@pytest.fixture()
def small_shards(monkeypatch):
    from millrace.llm import hnsw

    monkeypatch.setattr(hnsw, "SHARD", 150)
    monkeypatch.setattr(hnsw, "BLOCK", 64)


def test_hnsw_finds_the_links(spark, tmp_path_factory, small_shards):
    rows = [(k, v.tolist(), 0, "", 0) for k, v in enumerate(clusters(600, 25))]
    rows += [(600 + k, rows[k % 3][1], 0, "", 0) for k in range(40)]  # copies
    found = Q.op9_hnsw(spark, table(spark, rows, VECTORS, "embeddings", tmp_path_factory)).collect()
    want = links_brute(rows)
    assert sum(r.n_links for r in found) >= 0.97 * sum(n * k for (_, n, *_), k in want.items())
    assert sum(r.n_links for r in found) <= sum(n * k for (_, n, *_), k in want.items())
    assert len(Counter(tuple(r) for r in found) & want) >= 0.95 * len(rows)


def test_hnsw_edges(spark, tmp_path_factory):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, "", 0), (2, [], 0, "", 0), (3, [0.0, 0.0], 0, "", 0), (4, [1.0, None], 0, "", 0), (5, [nan, 1.0], 0, "", 0), (6, [inf, 1.0], 0, "", 0)]
    rows += [(7, [1.0, 0.0], 0, "", 0), (8, [2.0, 0.0], 0, "", 0), (8, [2.0, 0.0], 0, "", 0), (9, [1.0, 0.1, 0.0], 0, "", 0), (None, [1.0, 0.0], 0, "", 0), (10, [-0.0, 1.0], 0, "", 0), (11, [0.0, 1.0], 0, "", 0)]
    found = Q.op9_hnsw(spark, table(spark, rows, VECTORS, "embeddings", tmp_path_factory)).collect()
    assert Counter(tuple(r) for r in found) == links_brute(rows)
    assert Q.op9_hnsw(spark, table(spark, [], VECTORS, "embeddings", tmp_path_factory)).collect() == []


def test_graph_recall_and_dense_groups():
    from millrace.llm import hnsw as H

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((1500, 32)), rng.standard_normal(32) + 0.05 * rng.standard_normal((900, 32))])
    unit = H._unit(x[rng.permutation(len(x))])
    graph = H.Graph(unit.astype(np.float32))
    assert graph.audit(0.95) >= 0.99 or graph.full
    q, to = (np.concatenate(x) for x in zip(*H.links(graph, unit, unit[:300], 0.95), strict=True))
    truth = unit[:300] @ unit.T >= 0.95
    assert truth[q, to].all() and len(q) == len(set(zip(q.tolist(), to.tolist(), strict=True))) >= 0.99 * truth.sum()


@pytest.mark.parametrize("own", [True, False])
def test_answers_equal_brute_force(own):
    from millrace.llm import hnsw as H
    from millrace.llm.components import Forest

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((200, 16)), rng.standard_normal(16) + 0.05 * rng.standard_normal((150, 16)), rng.standard_normal(16) + 0.05 * rng.standard_normal((150, 16))])
    unit = H._unit(x[rng.permutation(len(x))])
    ids, copies = rng.permutation(1000)[: len(unit)], rng.integers(1, 4, len(unit))
    at = np.arange(0, 200) if own else np.arange(300, 500)
    shard = np.arange(0, 300)
    graph = H.Graph(unit[shard].astype(np.float32))
    graph.full = True
    block = {"ids": ids[at], "copies": copies[at], "raw": unit[at]}
    rows = H._answer(graph, unit[shard], ids[shard], copies[shard], block, own, 0.95).to_pylist()
    near = unit[at] @ unit[shard].T >= 0.95
    want = Counter()
    for i, j in zip(*np.nonzero(near), strict=True):
        if ids[at[i]] != ids[shard[j]]:
            want[int(ids[at[i]])] += int(copies[shard[j]])
            if not own:
                want[int(ids[shard[j]])] += int(copies[at[i]])
    assert {r["node"]: r["links"] for r in rows if r["other"] is None} == dict(want)
    groups = Forest(1000)
    groups.join(*(np.array([r[c] for r in rows if r["other"] is not None]) for c in ("node", "other")))
    truth = Forest(1000)
    truth.join(ids[at[np.nonzero(near)[0]]], ids[shard[np.nonzero(near)[1]]])
    assert (groups.label == truth.label).all()


def test_a_dense_shard_takes_little_memory():
    """16,384 vectors that are all near each other, and a block of 2,048 of them: 33 million pairs."""
    import os
    import subprocess
    import sys

    code = """
import numpy as np, resource
from millrace.llm import hnsw as H
rng = np.random.default_rng(0)
unit = H._unit(rng.standard_normal(64) + 0.01 * rng.standard_normal((16384, 64)))
graph = H.Graph.__new__(H.Graph)
graph.x, graph.full, graph.width, graph.layers = unit.astype(np.float32), True, 8, []
ids, ones = np.arange(len(unit)), np.ones(len(unit), np.int64)
for own, names in ((True, ids[:2048]), (False, 100000 + ids[:2048])):
    rows = H._answer(graph, unit, ids, ones, {"ids": names, "copies": ones[:2048], "raw": unit[:2048]}, own, 0.95)
    links = rows.column(2).drop_null().to_numpy()
    assert links.max() == (16383 if own else 16384) and links.sum() == 2048 * (16383 if own else 2 * 16384)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root})
    assert int(done.stdout) < 1000


def test_components(spark):
    from millrace.llm.components import components

    prepare(spark)
    pick = random.Random(7)
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(pick.randint(2000, 2300), pick.randint(2000, 2300)) for _ in range(150)] + [(1, None), (5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: root(i) for i in parent}


# --- The pipeline


def test_pipeline_stage_by_stage(spark, tmp_path_factory):
    import corpus_pipeline as P
    import public_tokenizers
    import sentencepiece
    from test_llm_documents import WORD, jaccard_groups, substring_brute, targets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash", "substring", "mix", "sentencepiece"]
    kept = []
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        path = fresh_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        kept.append(len(after))
        if name != "sentencepiece":
            assert docs.columns == names
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "simhash":
            assert sorted(r.doc_id for r in after) == sorted(jaccard_groups([b[:2] for b in before]))
        elif name == "substring":
            want = {i: (n, gone, sha) for i, n, gone, sha in substring_brute(before)}
            texts = {i: t for i, t, *_ in before}
            assert ids == {i for i, (n, gone, _) in want.items() if gone < n or not n}
            for r in after:
                n, gone, sha = want[r.doc_id]
                assert r.n_chars == len(r.text) and (hashlib.sha256(r.text.encode()).hexdigest() == sha if gone else r.text == texts[r.doc_id])
        elif name == "mix":
            sizes, taken = Counter(), Counter()
            for _, t, _, s in before:
                sizes[s] += len(WORD.findall(t))
            for r in after:
                taken[r.source] += len(WORD.findall(r.text))
            longest = max(len(WORD.findall(t)) for _, t, *_ in before)
            for s, target in targets(sizes).items():
                assert target - 1 <= taken[s] <= target + longest
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.TOKENIZER))
            want = Counter((i, tuple(sp.encode(t))) for i, t, *_ in before)
            assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want
    assert P.run(spark, SF).count() == kept[-1]


def test_pipeline_on_odd_rows(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows, ties, names that clash, no n_chars; and tables of nothing."""
    import corpus_pipeline as P
    from millrace.llm.common import _made
    from pyspark.sql import functions as F
    from test_llm_documents import EDGES, SCHEMA, with_clashes

    plain = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    plain = [(i + 1000, t, g, s) for i, t, g, s in plain]
    rows = [*EDGES, *plain, plain[3], (plain[4][0], plain[5][1], None, None), (None, plain[6][1] + " once more", None, "a"), (None, None, None, None)]
    clashes = ("_language", "_id", "_x", "_n", "_k", "_r", "_mark", "_row", "_kept", "_src", "language", "ids", "sha", "row", "src", "size")
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in clashes})
    for df, some in ((odd, True), (odd.limit(0), False), (odd.filter("doc_id in (1, 2, 3)"), False), (with_clashes(spark, rows), True)):
        docs = df
        for name, stage in P.STAGES:
            path = fresh_path(spark, name)
            stage(spark, docs, "").write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if name != "sentencepiece":
                assert docs.columns == df.columns
                if "_language" in docs.columns:
                    assert docs.filter("_language != '_language' OR _n != '_n'").isEmpty()
            if name == "language_id":
                assert docs.filter("text IS NULL OR text = ''").isEmpty()
                gone = Counter(r.doc_id for r in before.collect()) - Counter(r.doc_id for r in docs.collect())
                assert not some or all(i is None or i < 1000 for i in gone)
            elif name == "simhash":
                assert docs.count() == docs.select("doc_id", "text").distinct().count()
        assert docs.isEmpty() != some
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    made = list(_made(spark))
    P.run(spark, path)
    assert len(set(_made(spark)) - set(made)) == 1  # the last stage's rows


def test_mix_of_rows_that_repeat_others_takes_the_target(spark):
    from millrace.llm.mixing import mixed

    prepare(spark)
    words = " ".join(f"w{k}" for k in range(100))
    rows = [(k, f"{words} {k}", "a") for k in range(100)] + [(7, words, "b")] * 80 + [(None, words, "c")] * 30 + [(8, words, "d"), (8, words, "e")]
    for block in (512, 4096):
        found = mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(5, 2, 1, 1, 1), block=block).collect()
        taken = Counter()
        for r in found:
            taken[r.source] += len(r.text.split())
        from test_llm_documents import targets

        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len(t.split())
        for s, target in targets(sizes, (5, 2, 1, 1, 1)).items():
            assert target - 1 <= taken[s] <= target + 300


def test_release_and_scratch_delete_what_was_made(spark):
    import os

    from millrace.llm.common import _made, cut, release, scratch, written

    prepare(spark)

    def there(path):
        return os.path.exists("/" + path.removeprefix("file:").lstrip("/"))

    kept = written(spark.range(5).toDF("id"), "kept")
    path = _made(spark)[-1]
    with scratch(spark):
        cut(spark.range(10).toDF("id"))
        written(spark.range(3).toDF("id"), "t")
        inside = _made(spark)[-2:]
        assert all(map(there, inside))
    assert not any(map(there, inside)) and there(path) and kept.count() == 5
    release(spark)
    assert not there(path) and not _made(spark)


def test_the_shared_folder_is_the_one_set_and_needs_one_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from millrace.llm import common as C

    def fake(conf, given, master):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)), master=master, setCheckpointDir=lambda x: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf), sparkContext=sc)

    assert C.shared_dir(fake("hdfs:/x/", None, "yarn")) == "hdfs:/x"
    assert C.shared_dir(fake(None, "hdfs:/given/1", "yarn")) == "hdfs:/given/1"
    assert C.shared_dir(fake(None, None, "local[2]")).startswith("file:")
    with pytest.raises(C.NoSharedFolder):
        C.shared_dir(fake(None, None, "spark://host:7077"))


@pytest.mark.parametrize("page,text", [
    ("<article><p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg><text>no</text></svg><p>c</p></article>", "a\n\nb\n\nc"),
    ("<article><p>a <math><mi>x</mi></math> b</p><math/><p>c</p></article>", "a x b\n\nc"),
    ("<article><p>a</p><object/><p>b</p><canvas/><p>c</p></article>", "a\n\nb\n\nc"),
    ("<article><p>a</p><video src=v><p>b</p></article><footer><video>no</video></footer>", "a\n\nb"),
    ("<article><p>a</p><div><select></div><p>b</p><select><option>no</select></article>", "a\n\nb"),
    ("<article><p>a</p><div><button></div><p>b</p><p>c <button>no</button> d</p></article>", "a\n\nb\n\nc d"),
    ("<article><p>a</p><object>no <object>no</object> no</object><noscript><p>no</p></noscript><p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><template><div><p>no</p></div></template><p>b</p><button>", "a\n\nb"),
])
def test_html_hidden_elements_hide_no_more_than_themselves(page, text):
    from millrace.llm.html import main_text

    assert main_text(page) == text
