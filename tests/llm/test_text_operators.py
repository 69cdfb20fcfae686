"""Operators on single documents: quality, tokens, decontamination, extraction, privacy, scores, URLs."""

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, decontaminate, html_extract, lm_score, pii, quality, url_filter

ODD = [None, "", " \n\t ", "a", "é" * 3, "x" * 50_000, "word " * 20_000, "\x00\x01", "🙂 👍🏽", "a\r\nb\x0bc\x85d"]


def documents(spark, texts, extra=True):
    """doc_id and text, with columns that clash with operators' own names."""
    rows = [(i, t, "kept", 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, n_words double")
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- quality


def quality_rows(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(2, 9)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(20, 200))]
        kind = i % 4
        if kind == 0:
            words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
        texts.append(" ".join(words).capitalize() + ".")
        labels.append((i, 0 if kind == 0 else 1))
    return texts, labels


def test_quality_held_out_accuracy(spark):
    texts, labels = quality_rows(240)
    found = quality.classify(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert len(found) == 240
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 20 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_equals_plain_numpy(spark):
    texts, labels = quality_rows(80)
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([quality.statistics(t) for t in texts])
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(80)])
    y = np.array([v for _, v in labels])
    pooled = np.diag(sum((train & (y == c)).sum() / train.sum() * x[train & (y == c)].var(axis=0) for c in (0, 1)).clip(quality.RIDGE**2))
    logs = []
    for c in (0, 1):
        own = x[train & (y == c)]
        cov = (1 - quality.SHRINKAGE) * np.cov(own.T, bias=True) + (quality.SHRINKAGE + quality.RIDGE) * pooled
        d = x - own.mean(axis=0)
        logs.append(np.log(len(own) / train.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert [got[i] for i in range(80)] == pytest.approx(list(want), abs=1e-6)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    docs = documents(spark, ODD)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.unionByName(docs), labels).count() == 2 * len(ODD)
    assert quality.classify(empty(spark), labels).count() == 0
    null_id = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert quality.classify(null_id, labels).first()["held_out"] is False
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_keep_good_keeps_what_the_classifier_accepts(spark):
    texts, labels = quality_rows(80)
    docs, labels = documents(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, quality int")
    docs = docs.unionByName(docs.where("doc_id < 5"))
    accepted = [r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()]
    kept = quality.keep_good(docs, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(accepted) and 0 < len(accepted) < 87
    assert kept.columns == docs.columns and quality.keep_good(empty(spark), labels).count() == 0


# --- tokens


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    r = random.Random(5)
    any_char = lambda: chr(r.choice([r.randrange(1, 128), 32, 10, r.randrange(128, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x110000)]))
    texts = ODD + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "it's 'TWAS we'll 's", "ab" * 4000, " " * 3000 + "x", "ࢗ࢏Ա՘"]
    texts += ["".join(any_char() for _ in range(r.randrange(1, 80))) for _ in range(150)]
    got = {x["doc_id"]: x for x in bpe.encode_digests(documents(spark, texts), vocabulary).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), text
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_bpe_scan_and_heap_agree(vocabulary):
    r, b = random.Random(2), bpe.loaded(vocabulary)
    for _ in range(300):
        word = "".join(r.choice("abinthe er") for _ in range(r.randrange(1, 90))).encode()
        assert b.word_ids(word) == b._by_heap([b.byte_ids[x] for x in word])


def test_bpe_round_trip_and_edges(spark, vocabulary):
    found = bpe.encode_documents(documents(spark, ODD), vocabulary).collect()
    assert [r["decoded"] for r in sorted(found, key=lambda r: r["doc_id"])] == [t or "" for t in ODD]
    assert bpe.encode_digests(empty(spark), vocabulary).count() == 0
    assert bpe.loaded(vocabulary).decode([220, 255, 196]) == b"".join(bpe.loaded(vocabulary).bytes_of[i] for i in (220, 255, 196)).decode("utf-8", "replace")


# --- decontamination


def brute_leaks(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words, hit, found = word.findall(lower(text)), set(), set()
    for item, t in items:
        w = word.findall(lower(t))
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("group", [100_000, 30])
def test_leaks_equal_brute_force(spark, group):
    r = random.Random(4)
    vocabulary = ["the", "of", "Ábc", "x1", "word", "END", "no", "ñ"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (5, items0 := "the of word no")]
    texts = ODD + [" ".join(r.choice(vocabulary + ["zz"]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    texts += [f"before {items[i][1]}, after {items[i][1].upper()}" for i in range(12)] + [items0 * 3]
    found = decontaminate.find_leaks(documents(spark, texts), spark.createDataFrame(items, "item_id int, text string"), group_windows=group).collect()
    got = {x["doc_id"]: (x["n_words"], sum(h["end"] - h["first"] for h in x["hits"]), sorted(x["items"])) for x in found}
    assert got == {i: brute_leaks(t, items) for i, t in enumerate(texts)}


def test_long_items_are_cut_into_pieces(spark):
    r = random.Random(9)
    item = " ".join(f"w{r.randrange(60)}" for _ in range(500))
    pieces = list(decontaminate.pattern_groups(spark.createDataFrame([(1, item), (2, "a b"), (3, None)], "item_id int, text string"), 10, 40))
    assert all(sum(len(t.split()) for _, t in g) <= 49 for g in pieces) and len(pieces) > 10
    windows = {w for g in pieces for w in decontaminate.windows_of(g)[10]} if all(10 in decontaminate.windows_of(g) for g in pieces) else {w for g in pieces for w in decontaminate.windows_of(g).get(10, ())}
    assert windows == set(decontaminate.windows_of([("1", item)])[10])


@pytest.mark.parametrize("group", [100_000, 30])
def test_leaks_leave_columns_and_texts_alone(spark, group):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, "nothing here", 8, "y"), (2, None, 9, None)], "doc_id int, text string, _words int, _hits string")
    items = spark.createDataFrame([(k, f"{k} " + text.replace("ten", f"ten{k}" if k else "ten")) for k in range(6)], "item_id int, text string")
    assert sorted(map(str, decontaminate.remove_leaks(docs, items, group).collect())) == sorted(map(str, docs.where("doc_id = 2").collect()))
    found = decontaminate.find_leaks(docs, items, group_windows=group).where("doc_id = 1").first()
    assert [(h["first"], h["end"]) for h in found["hits"]] == [(0, 11)] and found["items"] == ["0"] and found["n_words"] == 11


def test_leaks_edges(spark):
    docs = documents(spark, ["one two three four five six seven eight nine ten eleven"])
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.find_leaks(docs, none).first()["hits"] == []
    nameless = spark.createDataFrame([(None, docs.first()["text"])], "item_id int, text string")
    row = decontaminate.find_leaks(docs, nameless).first()
    assert row["items"] == [] and row["hits"][0]["end"] == 11
    assert decontaminate.remove_leaks(docs, nameless).count() == 0
    assert decontaminate.remove_leaks(docs.unionByName(docs), none).collect() == docs.unionByName(docs).collect()
    assert decontaminate.find_leaks(empty(spark), nameless).count() == 0


# --- extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<!-- note --><div class="ad">Buy this now, only today.</div><article><h1>Head &amp; shoulders</h1><p><b>One&nbsp;two.<br><p>Three&#33;</p><p> \n</p><p>Caf&eacute; <a href=/x>link</a> text that goes on.</p></article>
<section id="comments"><p>I liked it, thanks for writing this down for all of us here.</p></section><footer>&copy; me &middot; all rights</footer>"""


def test_extract_page():
    assert html_extract.main_text(PAGE) == "Head & shoulders\nOne two.\nThree!\nCafé link text that goes on."


def test_tree_fits_its_table():
    x, y = html_extract.labelled_table(html_extract.labelled_pages())
    tree = html_extract.the_tree()
    assert sum(html_extract.is_main(tree, row) == bool(v) for row, v in zip(x, y)) >= 0.95 * len(y)
    held = "<body><div class=menu><a href=/1>A</a></div><main><p>" + "Some words in a row. " * 12 + "</p><p>Short.</p></main><aside>" + "Other words in a row. " * 12 + "</aside>"
    assert html_extract.main_text(held).endswith("\nShort.") and "Other" not in html_extract.main_text(held)


def test_paragraphs_can_say_that_they_are_furniture():
    page = "<body><main><p>The text of the page goes here and on.</p><p class='cookie-notice'>We use cookies.</p><div hidden><p>Unseen words.</p></div><div style='color:red; display: none'>Nor these.</div><p id=ad-1>Buy now.<p>The end.<h2 class=comments-title>Three comments</h2><div id='comments'><article><p>First!</p></article></div></main>"
    assert html_extract.main_text(page) == "The text of the page goes here and on.\nThe end."


def test_headers_of_articles_stay():
    page = "<body><div class='site-header'><p>The Paper of the whole town</p></div><div class='article-header'><h1>Flood</h1></div><div class=article-body><p>The river rose in the night and was over the road by dawn.</p></div><div class='post-footer'><p>Filed under weather and other news of the day</p></div>"
    assert html_extract.main_text(page) == "Flood\nThe river rose in the night and was over the road by dawn."


def test_extract_edges(spark):
    pages = [None, "", "<", "<<<>>>", "<p", "<script>x", "<!-- never closed", "<p>" * 5000, "a" * 100_000, "<a href='x" * 3000, "</div></div>x", "&am &lt;b&gt; &#x110000; &bogus;"]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(found) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert found[0]["text"] == found[1]["text"] == ""
    assert html_extract.extract(df.limit(0)).count() == 0
    assert html_extract.extract(df.unionByName(df)).count() == 2 * len(pages)


HELD_LONG = "Als der Zug endlich kam, war der Bahnsteig leer, denn alle anderen hatten den Bus genommen oder waren nach Hause gegangen und schliefen schon."
HELD_MID = "Das Haus am See wurde verkauft, und niemand im Dorf sprach darüber."
#: Written by hand, not seen by the tree; * marks main text. The first half says nothing by names or sections.
HELD_OUT = [
    f"<body><div><a href=/1>Start</a></div><div><a href=/2>Archiv</a></div><h1>*Der letzte Zug</h1><div>Gestern um acht</div><p>*{HELD_LONG}</p><p>*{HELD_MID}</p><p>*Wirklich.</p><p>*{HELD_LONG} {HELD_MID}</p><div>Zum Abstimmen anmelden</div><div><a href=/3>Weitere Texte</a></div></body>",
    f"<table><tr><td><a href=/a>A</a> <a href=/b>B</a> <a href=/c>C</a></td></tr></table><h2>*Am See</h2><p>*{HELD_LONG}</p><p>*{HELD_LONG} {HELD_LONG}</p><ul><li>*Ein Boot</li><li>*Zwei Ruder</li></ul><p>*{HELD_MID}</p><div>Drucken</div><div><a href=/d>Kontakt</a> <a href=/e>Hilfe</a></div>",
    f"<div><div><a href=/x>Heim</a></div><div><h1>*Brot</h1><p>*{HELD_MID}</p><p>*{HELD_MID} {HELD_LONG}</p><p>*Ja?</p><p>*{HELD_LONG} {HELD_LONG} {HELD_MID}</p></div><div><a href=/y>Mehr davon hier und dort</a></div><div>Alle Rechte vorbehalten</div></div>",
    f"<p><a href=/1>Eins</a> | <a href=/2>Zwei</a></p><p>*{HELD_LONG}</p><div>Werbung</div><p>*{HELD_LONG}</p><p>*{HELD_MID}</p><div>Anmelden</div><div>Ablehnen</div><p><a href=/3>Impressum</a></p>",
    f"<nav><a href=/1>Eins</a></nav><main><h1>*Der See</h1><div>Von uns</div><p>*{HELD_LONG}</p><p>*Kurz.</p><p>*{HELD_MID}</p><div><a href=/t>Teilen</a></div></main><aside><p>{HELD_MID}</p></aside><footer><p>{HELD_MID}</p></footer>",
    f"<div class='site-nav menu'><a href=/1>Eins</a></div><div class='cookie-bar notice'><p>{HELD_MID}</p></div><div class='blog-post'><h1>*Das Boot</h1><p>*{HELD_MID}</p><p>*{HELD_LONG}</p><p>*{HELD_LONG}</p></div><div class='comments'><div>Ein Leser</div><div>{HELD_MID}</div></div><div class=footer>{HELD_MID}</div>",
    f"<header><a href=/>Blatt</a></header><article><h1>*Nacht</h1><p>*{HELD_LONG}</p><p>*Nein.</p><h2>*Morgen</h2><p>*{HELD_LONG}</p></article><div class=ad>{HELD_MID}</div><footer>Seit 1902</footer>",
    f"<div class='top navbar'><ul><li><a href=/1>Eins</a></li><li><a href=/2>Zwei</a></li></ul></div><article class='entry'><p>*{HELD_MID}</p><p>*{HELD_LONG}</p></article><div class='related'><h3>Auch lesen</h3><ul><li><a href=/9>Das alte Haus und sein Garten</a></li></ul></div>",
]


def test_held_out_pages():
    tree = html_extract.the_tree()
    for pages in (HELD_OUT, HELD_OUT[:4], HELD_OUT[4:]):
        x, y = html_extract.labelled_table(pages)
        found = np.array([html_extract.is_main(tree, row) for row in x])
        assert 2 * (found & (y > 0)).sum() / (found.sum() + y.sum()) >= 0.9
    for seed in range(3):
        r = random.Random(seed)
        for style, least in (("sections", 0.97), ("names", 0.93), ("both", 0.97), ("neither", 0.9), ("misleading", 0.9)):
            x, y = html_extract.labelled_table([html_extract.labelled_page(r, style) for _ in range(60)])
            found = np.array([html_extract.is_main(tree, row) for row in x])
            assert 2 * (found & (y > 0)).sum() / (found.sum() + y.sum()) >= least, style


def test_neighbours_decide():
    """The same block is main text or not by the counts and link densities around it."""
    same = "<div>Ein ganz gewöhnlicher Satz steht hier.</div>"
    among_text = f"<p>{HELD_LONG}</p>{same}<p>{HELD_LONG}</p>"
    among_links = f"<div><a href=/1>Eins</a></div>{same}<div><a href=/2>Zwei</a></div><div><a href=/3>Drei</a></div>"
    assert "gewöhnlicher" in html_extract.main_text(among_text) and "gewöhnlicher" not in html_extract.main_text(among_links)
    tree = html_extract.the_tree()
    x, _ = html_extract.labelled_table([html_extract.labelled_page(random.Random(3), "neither") for _ in range(1)] + html_extract.labelled_pages(5))
    decided = np.array([html_extract.is_main(tree, row) for row in x])
    for columns in ((2, 4), (3, 5), (0,), (1,)):  # words around, links around, own words, own links
        other = x.copy()
        other[:, columns] = np.random.default_rng(1).permutation(other[:, columns])
        assert (np.array([html_extract.is_main(tree, row) for row in other]) != decided).mean() > 0.003, columns


def test_names_do_not_decide_alone():
    for name in ("post-related-content", "content alert", "sidebar-page", "menu"):
        page = f"<body><div><a href=/>Start</a></div><div class='{name}'><h1>Am See</h1><p>{HELD_LONG}</p><p>{HELD_LONG} {HELD_MID}</p><p>{HELD_LONG}</p></div><div>Gemacht in Köln</div></body>"
        assert html_extract.main_text(page).count(HELD_LONG) == 3, name
    page = f"<body><h1>Am See</h1><div>Gestern Abend</div><p>{HELD_LONG}</p><p>{HELD_LONG}</p><div>Zur Wahl anmelden</div><div>Alles annehmen</div></body>"
    assert html_extract.main_text(page) == f"Am See\n{HELD_LONG}\n{HELD_LONG}"


def test_hidden_elements_end_where_they_have_to():
    page = f"<body><p>{HELD_LONG}</p><script src=a />var text = 1;</script><p>{HELD_MID} {HELD_LONG}</p>"
    assert html_extract.main_text(page) == f"{HELD_LONG}\n{HELD_MID} {HELD_LONG}"
    for name in "button select svg object canvas audio video template title iframe noscript textarea".split():
        texts = [b.text for b in html_extract.blocks_of(f"<p>One</p><{name}>Press<div>Press</div></{name}><p>Two</p><{name}>Press<p>Three")]
        assert texts == ["One", "Two", "Three"], name
    assert [b.text for b in html_extract.blocks_of("<button>Press<p>One</p><button>Press</button><p>Two")] == ["One", "Two"]
    assert html_extract.main_text(f"<p>{HELD_LONG} <math><mi>x</mi></math> {HELD_MID}</p>") == f"{HELD_LONG} x {HELD_MID}"
    began = time.perf_counter()
    for page in ("<button>" * 100_000, "<svg><svg>" * 30_000 + "</svg>", "<button></button><select>" * 50_000, "<div>" * 100_000 + "</p>" * 100_000):
        html_extract.blocks_of(page)
    assert time.perf_counter() - began < 20


class SlowBlocks(HTMLParser):
    """The texts of a page's flat blocks by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.now, self.hidden = [], [], None

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.texts.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if self.hidden is None:
            if tag in ("script", "style", "title", "button", "select", "svg"):
                self.hidden = tag
            elif tag in html_extract.BLOCKS or tag in html_extract.CONTAINERS - {"td"}:
                self.cut()
            elif tag == "br":
                self.now.append(" ")

    def handle_endtag(self, tag):
        if self.hidden is None and (tag in html_extract.BLOCKS or tag in html_extract.CONTAINERS - {"td"}):
            self.cut()
        elif tag == self.hidden:
            self.hidden = None

    def handle_data(self, data):
        if self.hidden is None:
            self.now.append(data)


def test_blocks_equal_another_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + html_extract.labelled_pages()[:100] + HELD_OUT[:1] + HELD_OUT[2:] + [PAGE]
    for page in pages:
        slow = SlowBlocks()
        slow.feed(page)
        slow.close()
        slow.cut()
        assert [b.text for b in html_extract.blocks_of(page)] == slow.texts


# --- privacy


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(v if i % 2 == 0 else (v * 2 if v < 5 else v * 2 - 9) for i, v in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(8)
    pieces = ["a@b.c", "@", ".", "-", " ", "x_y%+z", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "0012.1.1.1", "+1 (555) 123-4567", "+", "(", ")", "é", "12", "\n", "a@b", "..", "@c.d", "+49", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "a@" * 50_000):
        assert pii.base_spans(text) is not None


def luhn_ends(n):
    return [f"{i:04d}" for i in range(10_000) if pii.luhn(f"411111111111{i:04d}")][:n]


def test_contexts_discover_what_forms_miss(spark):
    texts = [f"Please call my office phone +1 (555) 010-{1000 + i} soon." for i in range(12)]
    texts += ["Reach my office phone 555-010-7777 today", "The total was 555-010-8888 units sold", None, ""]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    hit = found[12]
    assert [(s["kind"], texts[12][s["start"] : s["end"]]) for s in hit] == [("phone", "555-010-7777")]
    assert found[13] == [] and found[14] == [] and found[15] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[12] == "Reach my office phone [PHONE] today" and clean[0] == "Please call my office phone [PHONE] soon." and clean[14] is None
    # Common words that happen to stand before identifiers announce nothing.
    common = documents(spark, [f"one of the 4111 1111 1111 {i}" for i in luhn_ends(8)] + ["some of the 1234 5678 9012 3456", "the end of the day and of the week", *["all of the rest"] * 3])
    assert [r for r in pii.find_spans(common).collect() if len(r["spans"]) != len(r["base"])] == [] and pii.learn_patterns(common).count() == 0
    # Copies of one document add no weight.
    copies = documents(spark, ["my office phone +1 555 010 1000"] * 30 + ["my office phone 555-010-7777"])
    assert all(s["kind"] == "phone" and s["end"] == 31 for r in pii.find_spans(copies).collect() for s in r["spans"])


def test_many_patterns_take_several_passes(spark, monkeypatch):
    patterns = spark.createDataFrame([("phone", "office phone"), ("email", "write to"), ("card", "card number")], "kind string, pattern string")
    docs = documents(spark, ["my office phone 555-010-7777, please write to me(at)home now, the card number 1234 5678 9012 3456 a@b.cd", None])
    one = pii.redact(docs, patterns).collect()
    monkeypatch.setattr(pii, "PASS_PATTERNS", 1)
    assert pii.redact(docs, patterns).collect() == one
    assert one[0]["text"] == "my office phone [PHONE], please write to [EMAIL] now, the card number [CARD] [EMAIL]"
    assert one[0]["score"] == "kept"


def test_privacy_edges(spark):
    docs = documents(spark, ODD + ["a@b.cd and 1.2.3.4"])
    assert pii.find_spans(docs).count() == len(ODD) + 1
    assert pii.find_spans(empty(spark)).count() == 0 and pii.redact(empty(spark)).columns == ["doc_id", "text", "lang"]
    assert pii.redact(docs).where("doc_id = 10").first()["text"] == "[EMAIL] and [IP]"


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("(" * 1_000_000, "1(" * 300_000, "a@" * 200_000, "a(at)" * 200_000, "(at)" * 200_000, "1 " * 300_000, "ab1" * 200_000, "@" * 500_000, "1:" * 200_000, "-" * 1_000_000):
        pii.marks(text)
    assert time.perf_counter() - began < 20


def test_long_names_and_far_words(spark):
    patterns = spark.createDataFrame([("email", "write to _"), ("phone", "_ is mine"), ("card", "pay _ now"), ("secret", "token = _")], "kind string, pattern string")
    long = "n" * 100
    texts = [f"please write to {long}@host{'x' * 300} today", f"write to {' ' * 5000} {long}(at)home.example", "555-010-7777 is mine", "pay 1234 5678 9012 3456 now", 'token = "Zk91aabbccddeeff00112233" and Zk91aabbccddeeff00112233 alone']
    clean = [r["text"] for r in pii.redact(documents(spark, texts), patterns).orderBy("doc_id").collect()]
    assert clean == ["please write to [EMAIL] today", f"write to {' ' * 5000} [EMAIL]", "[PHONE] is mine", "pay [CARD] now", 'token = "[SECRET]" and Zk91aabbccddeeff00112233 alone']


def test_secrets_are_found_by_their_context(spark):
    r = random.Random(4)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f'some words token = "{key()}" more' for _ in range(12)] + ['the token = "Ab12Cd34Ef56Gh78Ij90" here', f"commit {key()} was made", f"see {key()} there"]
    found = {x["doc_id"]: [(s["kind"], texts[x["doc_id"]][s["start"] : s["end"]]) for s in x["spans"]] for x in pii.find_spans(documents(spark, texts)).collect()}
    assert found[12] == [("secret", "Ab12Cd34Ef56Gh78Ij90")] and found[13] == found[14] == [] and all(len(found[i]) == 1 for i in range(12))


def brute_patterns(texts, confidence):
    """Kind and pattern to score, by plain loops over dicts."""
    edges, seeds, follows, stands = {}, set(), {}, {}
    for text in texts:
        every = pii.marks(text or "")
        for kinds, a, b, base, around in every:
            value = "".join(text[a:b].split()).lower()
            for k in kinds:
                if base or kinds == ("secret",) and re.fullmatch("[0-9A-Fa-f]{32,}", text[a:b]):
                    seeds.add((k, value))
                for p in around:
                    edges.setdefault((k, p), set()).add(value)
                    follows[k, p] = follows.get((k, p), 0) + 1
        items = pii.stream(text or "", pii.merged([(a, b) for _, a, b, _, _ in every]))[0]
        for i in range(len(items) - 1):
            x, y = items[i], items[i + 1]
            for p in (f"{x} {y} _", f"_ {x} {y}") if x and y else ():
                stands[p] = stands.get(p, 0) + 1
            z = items[i + 2] if i + 2 < len(items) else None
            if x and z:
                stands[f"{x} _ {z}"] = stands.get(f"{x} _ {z}", 0) + 1
    # A seed counts only where its pattern is; one that is a seed anywhere is one everywhere.
    score = {(k, v): 1.0 if (k, v) in seeds else 0.0 for (k, _), vs in edges.items() for v in vs}
    for _ in range(200):
        p = {e: sum(score[e[0], v] for v in vs) / (len(vs) + 1) for e, vs in edges.items()}
        for (k, v) in score:
            if (k, v) not in seeds:
                score[k, v] = max([p[e] for e, vs in edges.items() if e[0] == k and v in vs and p[e] >= confidence], default=0.0)
    return {e: p[e] for e in edges if p[e] >= confidence and follows[e] >= confidence * stands[e[1]]}


def test_graph_scores_equal_plain_python(spark):
    r = random.Random(17)
    around = [("call office", "please today"), ("my phone", "if needed"), ("reach me", "at night"), ("one of", "the others"), ("ring desk", "or wait")]
    seeds = [f"+1 555 010 {1000 + i}" for i in range(30)]
    loose = [f"555-010-{2000 + i}" for i in range(30)]
    texts = []
    for k, (before, after) in enumerate(around[:4]):
        texts += [f"{before} {x} {after}" for x in r.sample(seeds, 12 if k < 2 else 1) + r.sample(loose[:12], (1, 2, 12, 4)[k])]
    texts += [f"ring desk {x} or wait" for x in loose[:12]]  # reached over other values only
    texts += ["one of the many", "my phone rang", None, "", "reach me at"] * 2
    got = {(x["kind"], x["pattern"]): x["score"] for x in pii.learn_patterns(documents(spark, texts)).collect()}
    want = brute_patterns(texts, pii.CONFIDENCE)
    assert got.keys() == want.keys() and len(got) > 3
    assert all(got[e] == pytest.approx(want[e], abs=1e-4) for e in got)


def test_redaction_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd", "kept", 5, [1])], "doc_id int, text string, _base string, _spans int, spans array<int>")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail [EMAIL]", "kept", 5, [1])]


# --- scores


def plain_log_probability(network, s, at):
    """By loops over the definition, for one position of a document's tokens s."""
    token = lambda i: s[i] if 0 <= i < len(s) else 0
    near = [token(at + d) for d in (-2, -1, 1, 2)]
    hidden = np.tanh(sum(network.embed[t].astype(float) @ network.place[k].astype(float) for k, t in enumerate(near)) + network.bias)
    c = s[at] // lm_score.CLASS
    own = range(c * lm_score.CLASS, (c + 1) * lm_score.CLASS)
    logits = network.classes.astype(float) @ hidden + network.class_bias
    inner = np.array([network.embed[t].astype(float) @ hidden + network.token_bias[t] for t in own])
    return logits[c] - math.log(np.exp(logits).sum()) + inner[s[at] - own[0]] - math.log(np.exp(inner).sum())


def test_scores_equal_the_network(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["the cat sat on the mat", "a dog ran to the park", "rain fell"]) for _ in range(r.randrange(1, 8))) for _ in range(40)] + ODD
    docs = documents(spark, texts)
    model = lm_score.train(docs)
    vocabulary, network = model.vocabulary, model.network
    found = {x["doc_id"]: x for x in lm_score.score_documents(docs, model).collect()}
    at = {w: i for i, w in enumerate(vocabulary.words)}
    for i in (0, 7, 43):
        ids = [at.get(w, len(at) + lm_score.ending_symbol(w)) for w in lm_score.words_of(texts[i])]
        s = [int(vocabulary.symbol[k]) for k in ids]
        total = sum(plain_log_probability(network, s, k) + vocabulary.within[ids[k]] for k in range(len(s)))
        assert found[i]["n_tokens"] == len(ids) and found[i]["log_prob"] == pytest.approx(total, rel=1e-3)
    assert found[40]["log_prob"] == 0 and found[40]["mean_log_prob"] is None
    assert lm_score.score_documents(empty(spark)).count() == 0
    twice = {}
    for x in lm_score.score_documents(docs.unionByName(docs)).collect():
        twice.setdefault(x["doc_id"], []).append(x["log_prob"])
    assert all(len(v) == 2 and v[0] == pytest.approx(v[1], rel=1e-5, abs=1e-5) for v in twice.values())


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    total = rng.integers(1, 50, lm_score.SYMBOLS).astype(float)
    network = lm_score.Network.of_counts(total)
    values = network.values()
    for v in values:
        v += rng.normal(0, 0.1, v.shape).astype(np.float32)
    network = lm_score.Network(*(v.astype(np.float64) for v in values))
    tokens = rng.integers(1, 300, 40)
    around = rng.integers(0, 300, (40, 2 * lm_score.SIDE))
    loss, gradients = network.gradient(around, tokens)
    assert loss == pytest.approx(-network.log_probabilities(around, tokens).mean(), rel=1e-9)
    for v, g in zip(network.values(), gradients):
        for k in np.argsort(-np.abs(g).ravel())[:6]:
            before = v.flat[k]
            slopes = []
            for step in (1e-5, -1e-5):
                v.flat[k] = before + step
                slopes.append(-network.log_probabilities(around, tokens).mean())
            v.flat[k] = before
            assert g.flat[k] == pytest.approx((slopes[0] - slopes[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_context_helps_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    known, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    model = lm_score.train(known)
    untrained = lm_score.Model(model.vocabulary, lm_score.Network.of_counts(model.vocabulary.total))
    mean = lambda m: lm_score.score_documents(held, m).selectExpr("sum(log_prob) / sum(n_tokens)").first()[0]
    assert mean(model) > mean(untrained) + 0.05


def test_every_position_is_trained_on(spark):
    """What only the seventh word of a document shows is learned, as is what only its last but one shows."""
    r = random.Random(12)
    texts = []
    for _ in range(4000):
        words = [f"f{r.randrange(30)}" for _ in range(16)]
        for at, name in ((5, "key"), (13, "box")):
            m = r.randrange(4)
            words[at : at + 2] = f"{name}{m}", f"{name}lock{m}"
        texts.append(" ".join(words))
    model = lm_score.train(documents(spark, texts).coalesce(1))
    ids = {w: int(s) for w, s in zip(model.vocabulary.words, model.vocabulary.symbol)}
    untrained = lm_score.Network.of_counts(model.vocabulary.total)
    tokens = np.array([[ids[w] for w in t.split()] for t in texts[:200]])
    for at in (6, 14):
        around = np.column_stack([tokens[:, at + d] if at + d < 16 else 0 * tokens[:, 0] for d in (-2, -1, 1, 2)])
        gain = model.network.log_probabilities(around, tokens[:, at]) - untrained.log_probabilities(around, tokens[:, at])
        assert gain.mean() > 1


def test_rounds_take_every_position_once_with_its_neighbours():
    documents, at = [], 1
    for n in (0, 1, 2, 31, 32, 33, 500, 3000, 64, 5):
        documents.append(np.arange(at, at + n, dtype=np.int16))
        at += n
    want = {}
    for tokens in documents:
        around = np.concatenate([[0, 0], tokens, [0, 0]])
        want |= {int(t): [*around[k : k + 2].tolist(), *around[k + 3 : k + 5].tolist()] for k, t in enumerate(tokens)}
    found, rounds = [], [lm_score.in_runs(documents, k) for k in range(lm_score.ROUNDS)]
    for line, places in rounds:
        assert len(places) > len(want) / 3
        assert len(line) < (1 + 5 / lm_score.RUN) * len(places) + 5 * len(documents)  # what is shared is there once
        found += [(int(line[p]), line[p + lm_score.NEAR].tolist()) for p in places]
    assert len(found) == len(want) and dict(found) == want
    assert [len(x) for x in lm_score.in_runs([], 0)] == [lm_score.SIDE, 0]


def test_shared_neighbours_have_the_sum_of_their_slopes():
    rng = np.random.default_rng(4)
    network = lm_score.Network.of_counts(rng.integers(1, 50, lm_score.SYMBOLS).astype(float))
    network = lm_score.Network(*((v + rng.normal(0, 0.1, v.shape)) for v in network.values()))
    line, places = lm_score.in_runs([rng.integers(1, 40, n).astype(np.int16) for n in (200, 3, 1, 90)], 0)
    line = line.astype(np.int64)
    around, tokens = line[places[:, None] + lm_score.NEAR], line[places]
    apart = [network.gradient(around[k : k + 1], tokens[k : k + 1]) for k in range(len(tokens))]
    loss, gradients = network.gradient_at(line, places)
    assert loss == pytest.approx(np.mean([x[0] for x in apart]))
    for k, g in enumerate(gradients):
        assert np.allclose(g, np.mean([x[1][k] for x in apart], axis=0), rtol=1e-9, atol=1e-12)


def test_arrow_splits_and_ends_words_as_python_does():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [*ODD, None, "", " ", " a", "b ", "\u3000c\x1cd\x85", "\u0130 \u03a3\u0391\u03a3 x", " ".join(every), every]
    n, words = lm_score.split_words(pa.array(texts, pa.string()))
    want = [lm_score.words_of(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == sum(want, [])
    assert lm_score.ending_symbols(words).tolist() == [lm_score.ending_symbol(w) for w in words.to_pylist()]


def test_averages_weigh_tasks_by_their_windows(spark, monkeypatch):
    """Without steps every task hands back what it got, however many there are."""
    monkeypatch.setattr(lm_score, "RATE", 0.0)
    docs = documents(spark, ["a b c d e f"] * 30).repartition(7)
    model = lm_score.train(docs)
    assert np.allclose(model.network.packed(), lm_score.Network.of_counts(model.vocabulary.total).packed(), atol=1e-6)


def test_every_word_keeps_its_count(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(f"w{int(r.paretovariate(0.4)) % 400 if r.random() < 0.1 else r.randrange(9000)}" for _ in range(300)) for _ in range(100)]
    docs = documents(spark, texts + texts[:2] + ODD)
    asked = documents(spark, [*texts[:20], "w1 neverseen w399 neverseen", None])
    scores = lambda: [{x["doc_id"]: x["log_prob"] for x in lm_score.score_documents(d, model).collect()} for d in (docs, asked)]
    model = lm_score.train(docs)
    want = scores()
    counts = {x["word"]: x["n"] for x in lm_score.word_counts(docs).collect()}
    for most in (150, 1):  # with 1, not even the first step of the histogram may fit
        monkeypatch.setattr(lm_score, "VOCABULARY", most)
        model = lm_score.train(docs)
        assert len(model.vocabulary.words) <= most + lm_score.OWN < len(counts)
        got = scores()
        for a, b in zip(want, got):
            assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], rel=1e-5, abs=1e-6) for k in a)
        assert got[0][0] == pytest.approx(got[0][100], rel=1e-5) and got[0][1] == pytest.approx(got[0][101], rel=1e-5)


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, ["a b c a b d a", "b c"])
    model = lm_score.train(docs)
    every = np.arange(lm_score.SYMBOLS)
    for near in ([0, 0, 1, 2], [1, 2, 3, 0], [5000, 1, 1, 6000]):
        logs = model.network.log_probabilities(np.tile(near, (lm_score.SYMBOLS, 1)), every)
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    counts = {r["word"]: r["n"] for r in lm_score.word_counts(docs).collect()}
    assert counts == {"a": 3, "b": 3, "c": 2, "d": 1}


# --- URLs


def test_only_a_hosts_own_path_lengths_are_made(spark):
    """A host with many path lengths costs the URLs of other hosts nothing."""
    rules = url_filter.rules_frame(spark, [("block", f"many.org/{'p' * k}") for k in range(1, 200)] + [("block", "few.org/a")])
    df = spark.createDataFrame([(1, "http://x.few.org/a" + "p" * 300), (2, "http://many.org/" + "p" * 150), (3, "http://none.org/ppp")], "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in url_filter.apply_rules(df, rules).collect()}
    assert found == {1: "few.org/a", 2: "many.org/" + "p" * 150, 3: None}


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/es", "http://example.org/en/12", "http://a.b.example.org/en/2", "http://notexample.org/es/", "http://x.com/de/1", "http://x.com/fr/", "http://com/de/", "http://ÉX.org/", "x://y.org?z=/", "x://y.org#/es/", "a://b://c.org/", "http://q.net/", "http://example.org\n/es/", "http://" + "a." * 5000 + "org/" + "p" * 5000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.apply_rules(df, rules).collect()}
    assert found == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.apply_rules(df.unionByName(df), rules).count() == 2 * len(urls)
    assert url_filter.apply_rules(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.apply_rules(df, rules.limit(0), default="block").collect()} == {"block"}
    clash = df.selectExpr("page_id", "url", "'k' as _url", "'l' as _best")
    assert {(r["_url"], r["_best"]) for r in url_filter.apply_rules(clash, rules).collect()} == {("k", "l")}
    both = url_filter.rules_frame(spark, [("allow", "org/"), ("block", "org/"), (None, "org/x"), ("block", None)])
    assert url_filter.apply_rules(df, both).where("page_id = 5").first()["verdict"] == "block"
