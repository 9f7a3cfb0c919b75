"""Media containers, main text of pages, languages."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest

from weftline.llm import html_text, language, media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 64, 192 * 65 + 3, 500_000])
def test_container(n):
    payload = media.padded(bytes(range(256)) * (n // 256) + bytes(n % 256))
    t = media.tracks(media.mux(payload))[0]
    assert media.read(media.mux(payload), t) == payload
    assert len(payload) % 192 == 0 and len(payload) >= 192
    assert (t.codec, t.width, t.height, t.duration) == ("uncv", 16, 12, len(payload) // 192 * media.TICKS)
    assert t.keys.tolist() == list(range(0, len(t.sizes), media.KEY_EVERY))


def test_damaged_containers(spark):
    good = media.mux(media.padded(b"x" * 1000))
    bad = [None, b"", b"\0\0\0\x08free", good[:300], good[:-50], good.replace(b"stsz", b"skip"), b"\xff" * 64]
    rows = media.probe(spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert rows[0].error is None and rows[0].codec == "uncv" and rows[0].keyframes[0].end - rows[0].keyframes[0].first == 192
    assert all(r.error for r in rows[1:])


def test_media_rows(docs, empty, texts):
    for r in media.digests(media.store(docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        p = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(p)), hashlib.sha256(media.mux(p)).hexdigest())
    assert media.digests(media.store(empty)).count() == 0


PAGES = [
    ("<html><body><nav><a href=x>Menu one</a></nav><article><h1>T &amp; x</h1><p><b>One  two\n three.<br><p>Next</p></article><footer>no</footer></body>", "T & x\nOne two three.\nNext"),
    ("<div id=sidebar>side</div><div class='post'><p>Alpha beta gamma delta.</p><p>More text is here, and more.</p></div><div class=comments><p>first!</p></div>", "Alpha beta gamma delta.\nMore text is here, and more."),
    ("plain text without tags", "plain text without tags"),
    ("", ""),
    (None, ""),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><form><input><label>l</label></form>", ""),
    ("<article><header><h1>Head</h1></header><p>a &lt;b&gt; &#233;</p><div class='ad'>buy</div><ul><li>x<li>y</ul></article>", "Head\na <b> é\nx\ny"),
    ("<main><p>Text <a href='#'>link</a> end.</p><!-- <p>no</p> --><aside>no</aside></main><p>outside</p>", "Text link end."),
    ("<p title='a > b'>attr</p>", "attr"),
    ("<p>unclosed <b>bold<p>second</i>", "unclosed bold\nsecond"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


KEPT = [
    ("<article><p>Read <a href='/hidden/path'>this page</a> and <a title='the hidden gem' href=x>that one</a>.</p></article>", "Read this page and that one."),
    ("<article><div data-id='menu' data-class=sidebar><p>Dishes of the day.</p></div></article>", "Dishes of the day."),
    ("<article><a href=/a/class=ad>Bare</a> value</article>", "Bare value"),
    *((f"<article><h2 id='{x}'>Head</h2><section id='{x}'><p>Body text.</p></section></article>", "Head\nBody text.") for x in ("discussion", "related-work", "recommendations", "notices", "related", "share-2")),
    ("<main><div class='share-of-market'><p>Half of it.</p></div><h2 id=comments>Head</h2></main>", "Half of it.\nHead"),
    ("<div class='share-of-market'><p>Half of the market.</p></div>", "Half of the market."),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", "So x=2 holds."),
    ("<article><h3><button>Why?</button></h3><p><label>Term</label> means this.</p></article>", "Why?\nTerm means this."),
    ("<article><header class='entry-header'><h1>Title</h1></header><p>Text.</p></article>", "Title\nText."),
]
LEFT_OUT = ["class='ad'", "class='x ads-300x250'", "id=sidebar-left", "class=share-buttons", "class='related-posts'", "id='comments'", "class=comments-area", "class='social_icons'", "hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display: none'", "role=navigation"]
LEFT_OUT_OUTSIDE = ["class=site-header", "class='main-menu'", "id=footer", "class='cookie-notice'", "class='related'", "id=notices", "class=widget"]


@pytest.mark.parametrize(("page", "text"), KEPT)
def test_text_that_only_looks_like_furniture(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("attributes", LEFT_OUT + LEFT_OUT_OUTSIDE)
def test_furniture_is_left_out(attributes):
    text = "Some sentences of the text, which go on for a while, so that they are the core."
    assert html_text.main_text(f"<body><div {attributes}><p>furniture</p></div><div><p>{text}</p><p>{text}</p></div></body>") == f"{text}\n{text}"
    if attributes in LEFT_OUT:
        assert html_text.main_text(f"<article><p>{text}</p><div {attributes}><p>furniture</p></div></article>") == text


def test_pages(spark):
    rows = spark.createDataFrame([(i, f"u{i}", p, "t") for i, (p, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert len(got) == len(PAGES) + 1
    assert all(r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<a href=/wiki/O'Neill>O'Neill</a> wrote this and it's fine", "O'Neill wrote this and it's fine"),
        ("<p title=it's>Don't lose this</p>", "Don't lose this"),
        ("<p title='a>b' data-x=\"c>d\">kept<br/>on</p><a href=/x/>li\"nk</a> after <b =x y= 'q>r' z>bold</b>", 'kept on\nli"nk after bold'),
        ('<p a"b=1 c\'>one</p><p>two "three"</p>', 'one\ntwo "three"'),
        ("<p title=\"open>one</p><p>two's</p>", "one\ntwo's"),
        ("<p x=a='b>c</p><p>it's</p>", "c\nit's"),
    ],
)
def test_quotes_open_values_after_an_equals_sign_only(page, text):
    assert html_text.main_text(page) == text


def test_any_page_survives():
    r = random.Random(1)
    parts = ["<p>", "</p>", "<div class='x'>", "</div>", "<", ">", "&", "&amp;", "<!--", "-->", "<script>", "</script>", "text ", "<a href=", "'", '"', "<table><tr><td>", "</table>", "<li>", "\n"]
    for _ in range(500):
        html_text.main_text("".join(r.choice(parts) for _ in range(r.randint(0, 40))))


def test_pages_that_never_close_take_linear_time():
    began = time.perf_counter()
    for bad in ("<a " * 30_000, '<a "' * 30_000 + ">", "<i>" * 20_000 + "</section>" * 20_000, "<script " * 30_000, "<i>" * 5000 + "<h1>" * 20_000, "<div>" * 30_000 + "x", "<" * 50_000, "&" * 50_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<a x='" * 20_000 + ">", "<tr><td>" * 20_000, "<ul>" + "<i><li>" * 20_000 + "</b>" * 20_000):
        html_text.main_text(bad)
    assert time.perf_counter() - began < 5
    assert html_text.main_text("<p>" + "long words " * 200_000 + "</p>") == ("long words " * 200_000).strip()
    assert html_text.main_text("a < b <p>c <d") == "a < b\nc <d"
    assert html_text.main_text("<p title='x>one</p><p>two</p>") == "one\ntwo"


def test_densities_are_those_of_plain_sums():
    """Counts below each node by walking up from every node and text, and the core as the greatest sum over children."""
    r = random.Random(8)
    for _ in range(60):
        page = "".join(r.choice(["<div>", "<p>", "<a href=x>", "</a>", "</p>", "</div>", "<span>", "</span>", "words of text ", "more ", "<nav>", "</nav>", "<br>"]) for _ in range(r.randint(1, 60)))
        t = html_text.parse(page)
        n = len(t.parent)
        above = [[] for _ in range(n)]
        for i in range(n):
            j = i
            while j >= 0:
                above[i].append(j)
                j = t.parent[j]
        c, lc, tags, lt = ([0] * n for _ in range(4))
        for node, _, text in t.pieces:
            if not t.out[node]:
                k = len("".join(text.split()))
                for j in above[node]:
                    c[j] += k
                    lc[j] += k * any(t.tag[x] == "a" and x for x in above[node])
        for i in range(1, n):
            if not t.out[i]:
                for j in above[i][1:]:
                    tags[j] += 1
                    lt[j] += t.tag[i] == "a"
        # Characters of a link count for every node above the text, wherever the link starts.
        chars, links, dense, score = html_text.scored(t)
        assert (chars, links) == (c, lc)
        expected = [0.0 if t.out[i] else html_text.density(c[i], tags[i], lc[i], lt[i], lc[0] / max(c[0], 1)) for i in range(n)]
        assert dense == pytest.approx(expected)
        assert score[1:] == pytest.approx([sum(expected[j] for j in range(1, n) if t.parent[j] == i) for i in range(1, n)])


def test_density_formula():
    """Two small pages by hand: c/t times the ratio of logarithms."""
    t = html_text.parse("<div><p>abcdefghij</p><p><a>klmno</a></p></div>")
    chars, links, dense, _ = html_text.scored(t)
    assert (chars, links) == ([15, 15, 10, 5, 5], [5, 5, 0, 5, 5])
    base = math.log(15 / 10 * 5 + 5 / 15 * 15 + math.e)
    assert dense[1] == pytest.approx(15 / 3 * math.log(15 / 5 * 3 / 1) / math.log(base))
    assert dense[2] == pytest.approx(10 * math.log(10) / math.log(math.log(5 / 15 * 10 + math.e)))


def test_hostile_media(spark):
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    good = media.mux(media.padded(b"x" * 1000))
    at = good.index(b"stsz") + 4
    many = good[: at + 8] + b"\xff\xff\xff\xff" + good[at + 12 :]
    runs = good.index(b"stsc") + 4
    far = good[: runs + 8] + b"\xff\xff\xff\xf0" + good[runs + 12 :]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([deep, many, far, good, b"", b"\0" * 40])] + [(9, None)], "doc_id long, media binary")
    got = {x.doc_id: x for x in media.probe(rows).collect()}
    assert all(got[i].error and got[i].codec is None for i in (0, 1, 2, 4, 5, 9))
    assert got[3].error is None and got[3].codec == "uncv" and got[3].n_samples == 6
    assert b"uncC" in good and b"cmpd" in good


def test_key_frames_tracks_and_fragments():
    good = media.mux(media.padded(b"x" * 1000))
    at = good.index(b"stss") + 12
    for bad in (0, 7, 1 << 31):
        with pytest.raises(ValueError, match="key frames"):
            media.tracks(good[:at] + bad.to_bytes(4, "big") + good[at + 4 :])
    start = good.index(b"trak") - 4
    size = int.from_bytes(good[start : start + 4], "big")
    track = good[start : start + size]
    sound = track.replace(b"vide", b"soun").replace(b"uncv", b"twos")
    moov = good.index(b"moov") - 4
    whole = int.from_bytes(good[moov : moov + 4], "big")
    both = good[:moov] + (whole + size).to_bytes(4, "big") + good[moov + 4 : start] + sound + good[start:]
    found = media.tracks(both)
    assert [t.codec for t in found] == ["twos", "uncv"] and media.shown(found).codec == "uncv" and media.shown(found[:1]).codec == "twos"
    with pytest.raises(ValueError, match="fragments"):
        media.tracks(good + (8).to_bytes(4, "big") + b"moof")


def invented(r: random.Random, syllables: str, n: int) -> str:
    s = syllables.split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(n))


LANGS = {"aa": "the ing er tion ou th", "bb": "eau que ion é ais ne", "cc": "sch ung ei ü ge ten"}


def test_languages(spark, empty):
    r = random.Random(4)
    rows = [(i, invented(r, LANGS[k], r.randint(5, 80)), k if i % 7 else None) for i in range(300) for k in [sorted(LANGS)[i % 3]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = language.likelihoods(language.train(train))
    assert langs == sorted(LANGS) and np.allclose(p.sum(0), 1)
    test = [(i, invented(r, LANGS[k], 30)) for i, k in enumerate(sorted(LANGS) * 20)] + [(100, None), (101, ""), (102, "123 !?"), (103, invented(r, LANGS["aa"], 60) + " " + invented(r, LANGS["bb"], 60)), (103, None)]
    got = language.identify(spark.createDataFrame(test, "doc_id long, text string"), langs, p).collect()
    assert sum(x.lang_pred == sorted(LANGS)[x.doc_id % 3] for x in got if x.doc_id < 100) >= 59
    assert [(x.lang_pred, x.score) for x in sorted(got, key=lambda x: x.doc_id) if 100 <= x.doc_id < 103] == [("und", 0.0)] * 3
    mixed = [x for x in got if x.doc_id == 103 and x.score][0]
    assert {m.lang for m in mixed.languages} == {"aa", "bb"} and all(0.3 < m.share < 0.7 for m in mixed.languages)
    assert all(0 <= x.score <= 1 for x in got)
    none, q = language.likelihoods(language.train(empty))
    assert none == [] and {x.lang_pred for x in language.identify(train, none, q).collect()} == {"und"}


def test_texts_in_many_languages():
    r = random.Random(6)
    syllables = {"aa": "the ing er tion ou th", "bb": "eau que ion é ais ne", "cc": "sch ung ei ü ge ten", "dd": "ño ría lla de os ción", "ee": "ský vě př že ou ní"}
    m = np.full((language.BUCKETS, len(syllables)), language.SMOOTHING)
    for i, x in enumerate(syllables.values()):
        np.add.at(m[:, i], language.trigrams([invented(r, x, 4000)])[0], 1)
    p = m / m.sum(0)
    of = lambda k: " ".join(invented(r, x, 150) for x in list(syllables.values())[:k])
    texts = [of(k) for k in range(1, 6)]
    shares, _ = language.mixtures(texts, p)
    assert [(x > 0).sum() for x in shares] == [1, 2, 3, 4, 5]
    assert np.allclose(shares.sum(1), 1) and abs(shares[4] - 0.2).max() < 0.1
    # Each text's shares are a fixed point of EM, whatever it is fitted together with.
    for text, own in zip(texts, shares, strict=True):
        h = language.trigrams([text])[0]
        post = p[h] * own
        assert abs((post / post.sum(1, keepdims=True)).mean(0) - own).max() <= language.TOLERANCE
        assert np.allclose(language.mixtures([text], p)[0][0], own)
