"""Operators on vectors, pages and media, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import jpeg
from cadenza.llm.components import components
from cadenza.llm.lineage import written
from cadenza.llm.media import padded, read_media, store_as_media
from cadenza.llm.near_vectors import near_duplicate_vectors, plan
from cadenza.llm.pages import Block, Flow, Blocks, content_blocks, extract_main_text, main_text

VECTORS = "vec_id long, embedding array<float>, label int, id string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    label = {}

    def find(k):
        while label.setdefault(k, k) != k:
            k = label[k]
        return k

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [c + rng.normal(size=16) * s for c in centres for s in rng.choice([0.0, 0.05, 0.1, 0.2, 0.4], 20)] + list(rng.normal(size=(50, 16)))
    rows += [rows[0], rows[0], rows[1] * 7]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [float("inf")] * 16), (906, [1e-30, 1e-30]), (907, [1.0, 1.0]), (None, None)]
    data = [(k, [float(x) for x in v], 0, "x") for k, v in enumerate(rows)] + [(k, v, 0, "x") for k, v in odd]
    got = {r["vec_id"]: r for r in near_duplicate_vectors(spark.createDataFrame(data, VECTORS)).collect()}
    x = np.array(rows, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    n = np.array([got[k]["n_links"] for k in range(len(rows))])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.99 * linked.sum()
    component = np.arange(len(rows))
    for _ in range(len(rows)):
        component = np.array([min([component[k], *component[linked[k]]]) for k in range(len(rows))])
    assert np.mean([got[k]["component_id"] == component[k] for k in range(len(rows))]) > 0.99
    for k in (900, 901, 902, 903, 904, 905, None):
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
    assert got[906]["n_links"] == 1 and got[907]["component_id"] == 906
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    data = [(1, a, 0, "x"), (1, b, 0, "x"), (2, [1.0, 0.01, 0.0, 0.0], 0, "x"), (3, [0.01, 1.0, 0.0, 0.0], 0, "x"), (None, [0.0, 0.0, 1.0, 0.0], 0, "x"), (None, [0.0, 0.0, 1.0, 0.0], 0, "x"), (None, a, 0, "x")]
    got = sorted((tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(data, VECTORS)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 2, 1, False)]


def test_large_group_is_counted_once(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    data = [(k, [float(v) for v in base + rng.normal(size=32) * 0.02], 0, "x") for k in range(700)]
    got = near_duplicate_vectors(spark.createDataFrame(data, VECTORS)).collect()
    assert {r["n_links"] for r in got} == {699} and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_plan_sharpens_with_size():
    small, large = plan(1_000, 0.95), plan(1_000_000_000, 0.95)
    assert small[0] < large[0] and small[1] < large[1] < 500


# Pages


@pytest.mark.parametrize(
    "page",
    [
        "<body class='with-sidebar'>{}</body>",
        "<html class='header-fixed'><body>{}",
        "<div class='post author-jane'>{}</div>",
        "<article class='post category-x tag-y tags'>{}</article>",
        "<article id='social-policy'>{}</article>",
        "<article><div id='notice-board'>{}</div></article>",
        "<body><form id='aspnetForm'><main>{}</main></form>",
        "<html><head><title>t</title><body><article>{}",
    ],
)
def test_names_and_open_heads_lose_no_article(page):
    text = "A sentence of the article that goes on for a while. " * 6
    menu = "<nav><a href=/>Home</a> <a href=/x>More</a></nav>"
    assert main_text(page.format(f"<p>{text}</p>")) == text.strip()
    assert main_text(page.format(f"{menu}<p>{text}</p><p>{text}</p>")) == f"{text.strip()}\n{text.strip()}"


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>"
        '<div id="cookie-notice">We use cookies to improve everything, please accept them all.</div><article><h1>Title &amp; more</h1><p><b>One\n two.<br><p>Caf&eacute; &lt;b&gt;&nbsp;x</p>'
        '<script>var t="</p>";</script><div class="ad">Buy this wonderful thing today, it is very cheap.</div><table><tr><td>cell one<td>cell two</table></article>'
        '<section class="comments"><p>A reader says that this is a long comment, and goes on.</p></section><aside><p>Sidebar prose that is long enough, really.</p></aside>'
        "<form><label>Name</label><p>Enter your name here, please, and press the button.</p></form><footer>&copy; all</footer>"
    )
    assert main_text(page) == "Title & more\nOne two.\nCafé <b> x\ncell one\ncell two"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "</p></div>", "<!-- never closed", "<script>x", "<a href='x", "&#xZZ; &#99999999; &bogus;", "<p>" * 3000, "\x00<p>퟿"])
def test_broken_markup(html):
    assert isinstance(main_text(html), str)


def test_prose_without_article():
    text = "This paragraph is long enough to be the content of a page, as it has words."
    assert main_text(f"<body><p>{text}</p><p>{text}</p><ul><li><a href=x>Link</a><li><a href=y>Other</a></ul></body>") == f"{text}\n{text}"


@pytest.mark.parametrize("opening", ["<head><title>T</title>", "<head><meta charset=x><body>", "<head><noscript><link href=x><body>", "<svg><path d=x>", "<noscript>", "<object>", "<p>a<select><option>one", "<select><option>one", "<select><svg>", "<video>"])
def test_unclosed_unseen_elements(opening):
    text = "This paragraph is long enough to be the content of a page, as it has words."
    assert main_text(f"<html>{opening}<article><p>{text}</p><svg><title>icon</title></svg></article></html>").endswith(text)


def test_closed_unseen_elements():
    text = "This paragraph is long enough to be the content of a page, as it has words."
    hidden = "<p>This other paragraph is long enough too, but a browser shows nothing of it.</p>"
    unseen = "".join(f"<{t}>{hidden}</{t}>" for t in ("noscript", "object", "select", "svg", "video", "canvas", "template"))
    assert main_text(f"<head><noscript>{hidden}</noscript><title>T</title></head><body><article>{unseen}<p>{text}</p>{unseen}<p>{text}</p></article>") == f"{text}\n{text}"


TEXT = "This paragraph is long enough to be the content of a page, as it has words."


@pytest.mark.parametrize(
    "opening",
    ["<body class='has-sidebar'><article>", "<body class='sidebar'><article>", "<div class='no-ads layout'>", "<div class='layout sidebar-left'>", "<div class='sidebar-left'><article>", "<form id=aspnetForm><div>", "<form><main>"]
    + ["<main><div class='sidebar-left'><article class='post tags'>", "<main><div class='has-sidebar'>"],
)
def test_names_of_layout(opening):
    assert main_text(f"{opening}<p>{TEXT}</p><p>{TEXT}</p>") == f"{TEXT}\n{TEXT}"


def test_names_in_articles():
    assert main_text(f"<article><h1 class='page-header'>Title</h1><p>{TEXT}</p></article>") == f"Title\n{TEXT}"
    assert main_text(f"<article><header class='entry-header'><h1>Title</h1></header><p>{TEXT}</p></article>") == f"Title\n{TEXT}"
    inline = "<span class='author'>Jane</span> <a class='social' href=x>Share</a> <button>Press</button>"
    assert main_text(f"<article><p>{TEXT} {inline} {TEXT}</p><p>{inline}</p></article>") == f"{TEXT} {TEXT}"
    long = " ".join([TEXT] * 20)
    assert main_text(f"<article><p>{TEXT}</p><div class='promo'><p>{long}</p></div><div class='promo'><p>Buy this.</p></div></article>") == f"{TEXT}\n{long}"


def test_comments_stay_apart():
    comments = f"<section class='comments'><article class='comment'><p>{TEXT}</p></article><article><p>{TEXT}</p></article></section>"
    assert main_text(f"<article><p>{TEXT}</p></article>{comments}<form><p>{TEXT}</p></form>") == TEXT


def test_maximum_flow_is_the_minimum_cut():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(2, 7)
        edges = [(a, b, rng.randint(0, 9), rng.randint(0, 9)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        flow = Flow(n + 2)
        for k in range(n):
            flow.join(n, k, source[k])
            flow.join(k, n + 1, sink[k])
        for a, b, there, back in edges:
            flow.join(a, b, there, back)

        def cost(side):
            cut = sum(source[k] for k in range(n) if not side[k]) + sum(sink[k] for k in range(n) if side[k])
            return cut + sum(there * (side[a] and not side[b]) + back * (side[b] and not side[a]) for a, b, there, back in edges)

        level = flow.saturate(n, n + 1)
        assert cost([level[k] >= 0 for k in range(n)]) == min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))


def test_neighbours_pull_a_doubtful_block():
    sure = lambda: Block("p", 1, False, True, text="A long and certain paragraph of the article, with a full stop.")
    doubtful = Block("li", 1, False, False, text="short", linked=0)
    assert content_blocks([sure(), doubtful, sure()])[0] and not content_blocks([doubtful])[0]


def test_page_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", "<article><p>Über</p></article>", "clash"), (1, "u", "<article><p>Über</p></article>", "clash"), (None, None, None, None), (2, "u", "<article>" + "<p>word</p>" * 5000, None)]
    got = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 4), (1, 4), (2, 5 * 5000 - 1)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


# Media


@pytest.mark.parametrize("n", [64, 128, 384, 448, 6400, 64 * 6 * 700, 64 * 6 * 4097, 64 * 6 * 9000])
def test_payload_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    assert jpeg.payload(jpeg.decode(jpeg.encode(raw))) == raw


def test_zigzag():
    assert jpeg.zigzag().tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def huffman(symbols):
    """A table with codes of eight bits for up to 255 symbols."""
    return bytes([*[0] * 7, len(symbols), *[0] * 8, *symbols])


class Writer:
    def __init__(self, symbols):
        self.codes, self.bits = {s: k for k, s in enumerate(symbols)}, []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(self.codes[s], 8)

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def progressive(coefficients, wide, restart=0):
    """A grey picture written symbol by symbol: DC and AC in two bands, each at half precision first and then refined."""
    n = len(coefficients)
    seg = jpeg._segment
    symbols = [(r << 4) | s for r in range(16) for s in range(0, 11) if s or r]
    symbols = [0, *symbols][:200]
    out = [b"\xff\xd8", seg(0xDB, bytes([0]) + bytes([2]) * 64), seg(0xC2, bytes([8]) + (8 * (n // wide)).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))]
    out.append(seg(0xC4, bytes([0]) + huffman(list(range(12))) + bytes([0x10]) + huffman(symbols)))
    if restart:
        out.append(seg(0xDD, restart.to_bytes(2, "big")))
    step = restart or n
    halves = lambda v: abs(v) // 2 * (1 if v > 0 else -1)

    def scan(start, end, high, low, write):
        parts = [write(list(range(k, min(n, k + step)))).data() for k in range(0, n, step)]
        joined = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
        out.append(jpeg._scan([1], start, end, high, low, joined))

    def dc(blocks):
        w, last = Writer(range(12)), 0
        for b in blocks:
            v = int(coefficients[b][0]) >> 1
            w.symbol(abs(v - last).bit_length())
            if v - last:
                w.value(v - last)
            last = v
        return w

    def dc_low(blocks):
        w = Writer([])
        for b in blocks:
            w.put(int(coefficients[b][0]) & 1, 1)
        return w

    def first(start, end):
        def write(blocks):
            w, run = Writer(symbols), 0
            for b in blocks:
                zeros = 0
                values = [halves(int(coefficients[b][k])) for k in range(start, end + 1)]
                last = max([k for k, v in enumerate(values) if v], default=-1)
                if last >= 0 and run:
                    w.symbol((run.bit_length() - 1) << 4)
                    w.put(run - (1 << (run.bit_length() - 1)), run.bit_length() - 1)
                    run = 0
                for v in values[: last + 1]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        w.symbol(0xF0)
                        zeros -= 16
                    w.symbol(zeros << 4 | abs(v).bit_length())
                    w.value(v)
                    zeros = 0
                if last < len(values) - 1:
                    run += 1
            if run:
                w.symbol((run.bit_length() - 1) << 4)
                w.put(run - (1 << (run.bit_length() - 1)), run.bit_length() - 1)
            return w

        return write

    def refine(start, end):
        def write(blocks):
            w = Writer(symbols)
            for b in blocks:
                values = [int(coefficients[b][k]) for k in range(start, end + 1)]
                new = [k for k, v in enumerate(values) if abs(v) == 1]
                zeros, pending = 0, []
                for v in values[: (new[-1] + 1) if new else 0]:
                    if abs(v) >= 2:
                        pending.append(abs(v) & 1)
                        continue
                    if not v:
                        if zeros == 15:  # the sixteenth zero: a run of its own, then the correction bits so far
                            w.symbol(0xF0)
                            for p in pending:
                                w.put(p, 1)
                            zeros, pending = 0, []
                        else:
                            zeros += 1
                        continue
                    w.symbol(zeros << 4 | 1)
                    w.put(int(v > 0), 1)
                    for p in pending:
                        w.put(p, 1)
                    zeros, pending = 0, []
                rest = values[(new[-1] + 1) if new else 0 :]
                if rest:
                    w.symbol(0)
                    for v in rest:
                        if abs(v) >= 2:
                            w.put(abs(v) & 1, 1)
            return w

        return write

    scan(0, 0, 0, 1, dc)
    scan(1, 5, 0, 1, first(1, 5))
    scan(6, 63, 0, 1, first(6, 63))
    scan(0, 0, 1, 0, dc_low)
    scan(1, 5, 1, 0, refine(1, 5))
    scan(6, 63, 1, 0, refine(6, 63))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 3])
def test_scans_of_other_writers(restart):
    rng = np.random.default_rng(6)
    coefficients = rng.integers(-9, 10, (12, 64)) * (rng.random((12, 64)) < 0.3)
    coefficients[:, 0] = rng.integers(-200, 200, 12)
    coefficients[5, 1:] = 0
    image = jpeg.decode(progressive(coefficients, 4, restart))
    assert (image.components[0].coefficients == coefficients).all()
    values = np.zeros((12, 64))
    values[:, jpeg.zigzag()] = coefficients * 2
    m = jpeg.cosines()
    block = np.clip(np.rint(m @ values[0].reshape(8, 8) @ m.T + 128), 0, 255)
    assert (image.planes()[0][:8, :8] == block).all() and image.rgb().shape == (24, 32, 3)


def test_chroma_is_repeated():
    image = jpeg.decode(jpeg.encode(bytes(384)))
    assert [p.shape for p in image.planes()] == [(16, 16), (8, 8), (8, 8)] and image.rgb().shape == (16, 16, 3)


@pytest.mark.parametrize("raw", [b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"not a picture", jpeg.encode(bytes(640))[:400]])
def test_broken_pictures(raw):
    with pytest.raises((ValueError, KeyError, IndexError)):
        jpeg.decode(raw)


def test_media_columns(spark):
    texts = ["", None, "short", "short", "x" * 64, "ÄÖÜ\n" * 4000]
    docs = spark.createDataFrame([(k, t, "l", "s", 1) for k, t in enumerate(texts)] + [(None, "no id", None, None, None)], DOCS)
    stored = {r["doc_id"]: r for r in store_as_media(docs).collect()}
    got = {r["doc_id"]: r for r in read_media(store_as_media(docs)).collect()}
    for k, t in [*enumerate(texts), (None, "no id")]:
        raw = (t or "").encode()
        held, r = padded(raw), got[k]
        assert len(held) % 64 == 0 and len(held) >= 64 and stored[k]["n_bytes"] == len(raw)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        assert r["media_sha256"] == hashlib.sha256(stored[k]["media"]).hexdigest() and len(r["rgb"]) == r["height"] * r["width"] * 3
    assert got[2]["feature"] == got[3]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]
    odd = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["media_bytes"], r["feature"]) for r in read_media(odd).collect()) == [(1, 4, None), (2, None, None)]
    assert read_media(store_as_media(spark.createDataFrame([], DOCS))).count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, bad = line(60), ["vilewordone", "vilewordtwo", "vilewordthree"]
    texts, toxic = [], []
    for k in range(200):
        words = line(80).split()
        toxic.append(int(k % 5 == 0))
        for _ in range(4 * toxic[-1]):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words) + (f"\n{shared}" if k % 7 == 1 else ""))
    near = texts[2].split()
    near.insert(40, "inserted")  # another number of tokens, so another template
    texts += [" ".join(near), "", None]
    path = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path))
        sizes.append(docs.select("doc_id").distinct().count())
        if name != "packing":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.filter(F.contains("text", F.lit(shared))).count() == 1
    clean = {k for k in range(200) if not toxic[k]} | {201, 202}
    assert sizes == [len(clean) + 1, len(clean) + 1, len(clean), len(clean)]
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == clean
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r["doc_id"] for r in out.collect()} == clean
