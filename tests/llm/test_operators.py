"""Operators for training data against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tests import compare
from quillnet.llm import bpe, html_text, jaccard_join, langid, media, packing, pii, queries, repeats, substring_dedup, suffix_dedup, topk

SF = "/root/testdata/sf0.001"
R = np.random.default_rng(1)


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), int(r.integers(2, 8)))) for _ in range(n))


COMMON, LONG = prose(60, 1), prose(6000, 2)
TEXTS = [
    None, "", " ", "word", "word", "one two three four", COMMON, COMMON, prose(30, 3) + " " + COMMON + " " + prose(30, 4),
    prose(20, 5) + "\n" + COMMON, COMMON[:250] + prose(9, 6), COMMON[10:260] + prose(9, 7), "x" * 900, "ab" * 300, "é" * 250 + "ß" * 120,
    LONG, LONG[3000:9000] + " " + prose(50, 8), prose(100, 9), prose(100, 9) + " more", "nul \x00 tab\t\x0b\x0c\r\n end", "日本語 テキスト 😀", "12345 !!!",
]


@pytest.fixture(scope="module")
def docs(spark):
    """The texts, two null ids, a repeated row, and columns whose names clash with results or need quotes."""
    rows = [(k, t, None if k % 5 == 0 else "en", f"s{k % 2}", k, "old", 0.5, b"k", [k]) for k, t in enumerate(TEXTS)]
    rows += [(None, prose(80, 10), "en", None, 1, "old", 0.5, b"k", [1]), (None, COMMON, None, None, 1, None, None, None, None), rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_bytes long, kept string, Score double, `a.b` binary, h array<long>")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def covered(rows, w):
    count = Counter(x[k : k + w] for x in rows for k in range(len(x) - w + 1))
    out = []
    for x in rows:
        m = np.zeros(len(x), bool)
        for k in range(len(x) - w + 1):
            if count[x[k : k + w]] > 1:
                m[k : k + w] = True
        out.append(m)
    return out


def test_language_id_holds_out_and_is_right(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language_id(spark, SF).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == table.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_language_id_gradients():
    net = langid.Net(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = R.integers(97, 123, (langid.SPAN, 4)).astype(np.uint8)[:6], np.array([0, 1, 2, 1])

    def loss():
        out, mem = net.forward(x, keep=True)
        p = langid.softmax(out.astype(float), 1)
        d = p.copy()
        d[:, y, np.arange(4)] -= 1
        return -np.log(p[:, y, np.arange(4)]).sum(), mem, d

    _, mem, d = loss()
    g = net.backward(x, mem, d)
    for k in net.w:
        flat, grad = net.w[k].reshape(-1), g[k].reshape(-1)
        j = int(np.abs(grad).argmax())
        old = flat[j]
        flat[j] = old + 1e-2
        up = loss()[0]
        flat[j] = old - 1e-2
        down = loss()[0]
        flat[j] = old
        assert math.isclose((up - down) / 2e-2, grad[j], rel_tol=0.05, abs_tol=1e-2)


def test_language_id_equals_a_plain_version(spark):
    """The network's probabilities, position by position and gate by gate."""
    net = langid.Net(5)
    texts = [b"", b"Abc def", "Größe und Maß, très élégant".encode(), bytes(R.integers(32, 250, 300).astype(np.uint8))]
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = np.zeros((len(texts), 5))
    for k, t in enumerate(texts):
        total, count = np.zeros(5), 0
        for a in range(0, len(t), langid.SPAN):
            piece = [b + 32 if 65 <= b <= 90 else b for b in t[a : a + langid.SPAN]]
            data = piece + [32] * (langid.SPAN - len(piece))
            outs = np.zeros((langid.SPAN, 5))
            for side, order in ((0, range(langid.SPAN)), (1, reversed(range(langid.SPAN)))):
                h, w = np.zeros(langid.UNITS), net.w
                for p in order:
                    x, r, b = w["x"][side][:, data[p]], w["u"][side] @ h, w["b"][side][:, 0]
                    u = langid.UNITS
                    z, g = sig(x[:u] + r[:u] + b[:u]), sig(x[u : 2 * u] + r[u : 2 * u] + b[u : 2 * u])
                    c = np.tanh(x[2 * u :] + g * (r[2 * u :] + b[2 * u :]))
                    h = z * h + (1 - z) * c
                    outs[p] += w["o"][side] @ h
            for p, b in enumerate(piece):
                if 97 <= b <= 122 or b >= 128:
                    total += langid.softmax(outs[p] + net.w["c"][:, 0], 0)
                    count += 1
        want[k] = total / max(count, 1)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.abs(got - want).max() < 1e-4


def test_language_id_has_no_bound_on_languages(spark):
    """A hundred languages, each of letters of its own."""
    rows = [(k, " ".join(chr(0x4E00 + 40 * (k % 100) + int(x)) * 3 for x in R.integers(0, 3, 30)), f"l{k % 100:02d}") for k in range(1000)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.lang_pred.nunique() > 90


def test_language_id_odd_rows(docs, empty):
    got = langid.identify(docs).toPandas()
    assert len(got) == docs.count() and "Score" not in got.columns
    und = got[got.lang_pred == "und"]
    assert set(und.text.fillna("")) == {"", " ", "12345 !!!"} and (und.score == 0).all()
    assert langid.identify(empty).count() == 0
    assert set(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}


@pytest.mark.parametrize("crowd", [2000, 1])
def test_suffix_dedup(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = suffix_dedup.remove_repeats(docs).toPandas()
    rows = [(t or "").encode() for t in got.text]
    for x, m, r in zip(rows, covered(rows, 200), got.itertuples(), strict=True):
        want = bytes(np.frombuffer(x, np.uint8)[~m])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == (want, len(x), int(m.sum()), spans)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_order_and_extension():
    buf = np.frombuffer(b"".join(bytes(R.choice(list(b"ab"), 60)) for _ in range(40)), np.uint8)
    at = np.arange(0, 2400, 60) + R.integers(0, 20, 40)
    size, group = np.full(40, 30), R.integers(0, 3, 40)
    order = suffix_dedup.suffix_sort(buf, repeats.Prefix(repeats.BYTE_CODES[buf]), at, size, group)
    key = [(group[k], bytes(buf[at[k] : at[k] + 30])) for k in order]
    assert key == sorted(key) and sorted(order) == list(range(40))


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substring_dedup(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = substring_dedup.remove_passages(docs).toPandas()
    rows = [tuple((t or "").encode().split()) for t in got.text]
    for x, m, r in zip(rows, covered(rows, 35), got.itertuples(), strict=True):
        want = b" ".join(w for w, gone in zip(x, m, strict=True) if not gone)
        assert (r.kept.encode(), r.n_words, r.n_removed) == (want, len(x), int(m.sum()))
    assert substring_dedup.remove_passages(empty).count() == 0


def test_html_text(spark):
    net = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = html_text.invented(100, seed=77)
    right = np.concatenate([a == y for a, (_, y) in zip(html_text.label(net, [b for b, _ in pages]), pages, strict=True)])
    assert right.mean() > 0.98
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Top of all</header><nav><ul><li><a href=x>One</a></ul></nav><div class='cookie notice'>We use cookies</div>"
        "<article><h1>Head &amp; tail</h1><p>First\n  <b>bold</b> words &lt;here&gt; of it.<p>Second &eacute;t&eacute; &amp one.<script>var a='<p>no</p>'</script><!-- gone <p>x</p> --></article>"
        "<aside>Side words</aside><div class=comments><p>I liked this a lot.</p></div><footer>&copy; end</footer></body>"
    )
    table = spark.createDataFrame([(1, "u", page, "old"), (2, None, None, None), (3, "u", "", "old"), (4, "u", "<article><p>Cut off in the mid", "x"), (1, "u", page, "old")], "page_id long, url string, html string, text string")
    got = html_text.extract(table, net).orderBy("page_id").toPandas()
    whole = "Head & tail\n\nFirst bold words <here> of it.\n\nSecond été & one."
    assert got.text.tolist() == [whole, whole, "", "", "Cut off in the mid"]
    assert got.n_chars.tolist() == [len(t) for t in got.text]
    assert html_text.extract(table.where("false"), net).count() == 0


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<article><p>One</p><svg-icon name="a"></svg-icon><p>Two</p></article>', ["One", "Two"]),
        ("<title-card><p>One</p></title-card><select-box>Two</select-box><p>Three", ["One", "Two", "Three"]),
        ('<p>One</p><svg viewBox="0 0 1 1" /><p>Two <math/> and</p><p>Three</p>', ["One", "Two and", "Three"]),
        ('<p>One <svg><title>no</title><path d="x"/></svg> and</p><p>Two', ["One and", "Two"]),
        ("<svg><path><p>One</p><svg><text>of <tspan>it</tspan></text></svg><p>Two", ["One", "of it", "Two"]),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=x>instead <b>this</b></object>", ["where x=2 holds", "instead this"]),
        ("<div><canvas>a chart</div>One<div><select><option>no</div>Two", ["a chart", "One", "Two"]),
        ("<div><template><div>no</div>no</template>One</div>Two", ["One", "Two"]),
        ("<p title=it's>Hello world.</p><p>Don't stop.</p>", ["Hello world.", "Don't stop."]),
        ("<p a=\"x>y\" b='>' c = z>One</p><p title=\"never ends>Two</p>Three", ["One", "Two", "Three"]),
        ("a < b <3 <!-- no --> c<!doctype x><?no ?></ no>d <!----><b>e</b> <p>f <a href='x", ["a < b <3 cd e", "f"]),
        ("One<script>no</script >Two<style>no</style x><p>Three", ["OneTwo", "Three"]),
    ],
)
def test_html_elements_left_out_end_where_they_end(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


@pytest.mark.parametrize(
    "page, paths, texts",
    [
        ("<html><head><meta charset=u><title>t</title><body><article><p>One<p>Two", ["html body article p"] * 2, ["One", "Two"]),
        ("<HTML><HEAD><title>t</title><link rel=x><style>p{}</style><article>One</article><p>Two", ["html article", "html p"], ["One", "Two"]),
        ("<head><script>no</script> <b>One</b> and<p>Two", ["", "p"], ["One and", "Two"]),
        ("<head><title>t</title>One<p>Two", ["", "p"], ["One", "Two"]),
        ("<html><head><noscript><p>no</p></noscript><template><p>no</p></template><base href=x></head><body><p>One", ["html body p"], ["One"]),
        ("<head><svg><path/></svg><title>t</title>One", [""], ["One"]),
        ("<head><x-bar>One</x-bar>", ["x-bar"], ["One"]),
    ],
)
def test_html_head_ends_without_its_tag(page, paths, texts):
    got = html_text.blocks_of(page)
    assert [b.text for b in got] == texts and [" ".join(b.path) for b in got] == paths


class Plain(HTMLParser):
    """Text of pages by the library's parser, white space and all block structure left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "textarea", "select", "template", "noscript", "iframe")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "textarea", "select", "template", "noscript", "iframe")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_html_blocks_hold_all_text_of_the_pages(spark):
    """Every page's blocks together against another parser, and the query's rows against the elements that hold the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"])
        assert "".join("".join(plain.text).split()) == "".join("".join(b.text.split()) for b in html_text.blocks_of(r["html"]))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        blocks = html_text.blocks_of(r["html"])
        text = "\n\n".join(b.text for b, y in zip(blocks, html_text.label_by_elements(blocks), strict=True) if y)
        assert got[r["page_id"]] == (text, len(text))


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>x" * 60_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 500_000, "</x>" * 100_000 + "<b " * 100_000 + '">', '<a b="' * 100_000 + ">", "<li><ul>" + "<div>" * 9_000 + "<li></li>" * 30_000])
def test_html_time_grows_with_the_page(page):
    began = time.process_time()
    html_text.blocks_of(page)
    assert time.process_time() - began < 5


def test_html_labels_do_not_rest_on_class_names(spark):
    """Pages whose class names training never met: elements, links and neighbours must do."""
    net = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    right = []
    for blocks, y in html_text.invented(150, seed=78):
        if not any(label.split()[0] in (*html_text.BAD, *html_text.GOOD) for b in blocks for label in b.path):
            continue
        strange = [html_text.Block(tuple(" ".join([n := label.split()[0], *(f"q{w[::-1]}z" for w in label.split()[1:])]) for label in b.path), b.text, b.linked) for b in blocks]
        right.append(html_text.label(net, [strange])[0] == y)
    assert len(right) > 40 and np.concatenate(right).mean() > 0.9


def luhn_ok(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, docs, empty):
    texts = ["pay 4111 1111 1111 1111 or 4111111111111111 (1234567890123456)", "born 1999-02-30 or 1999-02-28", "ip 10.0.0.1, 300.1.1.1, v1.2.3.4.5, Apache 2.0", "ssn 123-45-6789, +49 (030) 555-7713!", "a.b@c.co.uk A.B@c.co.uk", None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Version 3. of 29 June 2007, 100,000 x 3.14"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = pii.pseudonymise(table).orderBy("doc_id").toPandas()
    words = [(t or "").split() for t in got.text]
    assert words[0][1:5] == [words[0][6][k : k + 4] for k in range(0, 16, 4)] and luhn_ok(words[0][6]) and words[0][6] != "4111111111111111" and words[0][7] == "(1234567890123456)"
    assert words[1][1] == "1999-02-30" and words[1][3] != "1999-02-28" and words[1][3][4] == "-"
    assert words[2][1] != "10.0.0.1," and words[2][2:] == ["300.1.1.1,", "v1.2.3.4.5,", "Apache", "2.0"]
    assert words[3][1] != "123-45-6789," and words[3][2] == "+49" and got.text[3].endswith("!") and "555-7713" not in got.text[3]
    assert words[4][0] == words[4][1].replace("U", "u") and "co.uk" not in got.text[4]
    assert got.text[5] is None and got.text[6] == "" and "04dbe" not in got.text[7] and len(got.text[7]) == len(texts[7]) and got.text[8] == texts[8]
    assert got.n_replaced.tolist() == [2, 1, 1, 2, 2, 0, 0, 1, 0]
    assert pii.pseudonymise(docs).columns[: len(docs.columns)] == docs.columns and pii.pseudonymise(empty).count() == 0


def plain_digits(kind, digits, key=pii.KEY):
    """The digits' permutation, written out: a Feistel network over two halves, its noise from a keyed digest."""
    u = len(digits) // 2
    size = (10**u, 10 ** (len(digits) - u))
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(pii.ROUNDS):
        n = size[i % 2]
        noise = int(hashlib.sha256(f"{key}|{kind}|{size[0]}|{size[1]}|{i}|{b}".encode()).hexdigest()[:15], 16) % n
        a, b = b, (a + noise) % n
    return f"{a:0{u}d}{b:0{len(digits) - u}d}"


def test_pii_equals_a_plain_version_and_leaves_what_is_not_valid(spark):
    def luhn_digit(d):
        return next(str(c) for c in range(10) if luhn_ok(d + str(c)))

    cards = {"4111111111111111": 1, "5500005555555559": 2, "378282246310005": 2, "6011000990139424": 1, "30569309025904": 3, "2223003122003222": 4}
    for card, head in cards.items():
        body = card[:head] + plain_digits("number", card[head:-1])
        cards[card] = body + luhn_digit(body)
    same = "5000000000000 20240101123456 7536784127813050 +1 2024 12 31 000-00-0000 666-12-3456 123-00-4567 112-555-0199 DE89370400440532013001 4111111111111112 1.4111111111111111 99/99/1990 30/02/1990"
    moved = "No.4111111111111111 ref-4111111111111111 3782 822463 10005 212.555.0199 212 555 0199 25/12/1990 DE89370400440532013000 GB82 WEST 1234 5698 7654 32"
    rows = [(0, " ; ".join(cards)), (1, same), *[(2 + k, x) for k, x in enumerate(moved.replace("No.", "|No.").replace(" ref", "|ref").replace(" 3782", "|3782").replace(" 212", "|212").replace(" 25/", "|25/").replace(" DE", "|DE").replace(" GB", "|GB").split("|")[1:])]]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == " ; ".join(cards.values()) and got[1].text == same and got[1].n_replaced == 0
    assert all(got[k].n_replaced == 1 and len(got[k].text) == len(t) for k, t in rows[2:])
    for k, t in rows[-2:]:
        x = got[k].text.replace(" ", "")
        assert x[:2] == t[:2] and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert got[rows[-1][0]].text[5:9] == "WEST"
    other = pii.pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string"), key="another").first().text
    assert other != got[0].text and all(luhn_ok(x) for x in other.split(" ; "))


def test_pii_odd_rows(docs, empty):
    """No value that anyone could tell, so all rows stay, whatever their texts and columns."""
    got = pii.pseudonymise(docs).toPandas()
    assert got.drop(columns="n_replaced").map(str).values.tolist() == docs.toPandas().map(str).values.tolist() and (got.n_replaced == 0).all()
    long = docs.sparkSession.createDataFrame([(1, prose(90_000, 50) + " 4111111111111111 " + prose(90_000, 51)), (1, None), (None, "")], "doc_id long, text string")
    assert sorted(r.n_replaced for r in pii.pseudonymise(long).collect()) == [0, 0, 1] and pii.pseudonymise(empty).count() == 0


def test_pii_is_a_permutation(spark):
    three = spark.range(1000).select(pii.permute_digits("t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("x"))
    assert three.distinct().count() == 1000
    day = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    assert spark.range(0, pii.DAYS, 7).select(pii._date(day).alias("x")).distinct().count() == len(range(0, pii.DAYS, 7))


def test_media(docs, empty):
    got = media.media_columns(docs).toPandas()
    assert len(got) == docs.count() and media.media_columns(empty).count() == 0
    for r in got.itertuples():
        assert len(r.payload) % 192 == 0 and len(r.payload) and bytes(r.media)[44:] == bytes(r.payload)
    shown = media.media_digest(media.media_columns(docs)).toPandas()
    assert shown[shown.doc_id == 6].feature.tolist() == shown[shown.doc_id == 7].feature.tolist()
    tone = (128 + 100 * np.sin(2 * np.pi * 10 * np.arange(1920) / 192)).astype(np.uint8).tobytes()
    codes = media.fingerprint(tone)
    assert len(set(zip(codes["time"].tolist(), codes["hash"].tolist(), strict=True))) == len(codes) and (np.diff(codes["time"].astype(int)) >= 0).all()


ODD = ["a  b", " lead", "trail ", "a\n\n b", "don't WE'LL I'm", "<|endoftext|>a <|endoftext|> b", "a\x1cb \x85 c", "^ ^a b ^c", "1234 567", "日本語 😀", "é b  c", "x" * 300, "ab" * 3000, "a b　c"]


def test_media(docs, empty):
    got = media.media_columns(docs).toPandas()
    assert len(got) == docs.count() and media.media_columns(empty).count() == 0
    for r in got.itertuples():
        assert len(r.payload) % 192 == 0 and len(r.payload) and bytes(r.media)[44:] == bytes(r.payload)
    shown = media.media_digest(media.media_columns(docs)).toPandas()
    assert shown[shown.doc_id == 6].feature.tolist() == shown[shown.doc_id == 7].feature.tolist()
    tone = (128 + 100 * np.sin(2 * np.pi * 10 * np.arange(1920) / 192)).astype(np.uint8).tobytes()
    codes = media.fingerprint(tone)
    assert len(set(zip(codes["time"].tolist(), codes["hash"].tolist(), strict=True))) == len(codes) and (np.diff(codes["time"].astype(int)) >= 0).all()


ODD = ["a  b", " lead", "trail ", "a\n\n b", "don't WE'LL I'm", "<|endoftext|>a <|endoftext|> b", "a\x1cb \x85 c", "^ ^a b ^c", "1234 567", "日本語 😀", "é b  c", "x" * 300, "ab" * 3000, "a b　c"]


def test_media_equals_a_plain_version(spark):
    """Every digest of the query from the text itself, the file's header written out, the transform as plain sums."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_media_columns(spark, SF).collect()}
    rows = table.orderBy(F.octet_length("text")).collect()
    for n, r in enumerate(rows):
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192 or (192 if not text else 0))
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(payload).to_bytes(4, "little")
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (x.media_bytes, x.media_sha256) == (44 + len(payload), hashlib.sha256(head + payload).hexdigest())
        if n % 20 == 0 and len(payload) < 20_000:
            t = np.arange(192)
            wave = np.exp(-2j * np.pi * np.outer(np.arange(97), t) / 192)
            window = 0.5 - 0.5 * np.cos(2 * np.pi * t / 191)
            codes, peaks = [], []
            for a in range(0, len(payload), 192):
                f = np.frombuffer(payload[a : a + 192], np.uint8) - 128.0
                power = np.abs(wave @ ((f - f.mean()) * window))
                peaks.append([lo + int(power[lo:hi].argmax()) for lo, hi in media.BANDS])
            for i, early in enumerate(peaks):
                for step in range(1, media.FAN_OUT + 1):
                    if i + step < len(peaks):
                        codes += [(i, (a * 97 + b) * media.FAN_OUT + step - 1) for a, b in zip(early, peaks[i + step], strict=True)]
            assert x.feature.split(":")[0] == str(len(codes)) and x.feature.split(":", 2)[2] == ",".join(f"{a}-{b}" for a, b in sorted(codes)[:8])


def test_bpe_equals_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, library = bpe.ByteBpe(path), Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    for word in (b"hello", b"aaaaaaaaaaaa", b"z" * 100):
        assert coder.merge(word) == coder._merge_long([coder.single[b] for b in word])
    shown = bpe.bpe_digest(docs, path).toPandas()
    assert shown[shown.doc_id == 0].n_tokens.tolist() == [0] and len(shown) == docs.count()


def test_top_k(spark):
    rows = [(k, [float(x) for x in R.integers(-3, 4, 6) / 2]) for k in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, [0.5] * 6), (305, [0.5] * 6), (306, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.top_k(table, table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")).toPandas()
    kept = {r["vec_id"]: r["v"] for r in table.collect()}
    assert not {300, 301, 302, 303} & set(kept)
    for q in (0, 100, 200):
        score = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=False)), k) for k, v in kept.items() if k != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == score and mine["rank"].tolist() == list(range(1, 11))
    assert topk.top_k(table.limit(3), table.where("false").withColumnRenamed("vec_id", "query_id")).count() == 0


def test_top_k_odd_rows(spark):
    """Repeated ids and rows, null ids, an empty vector, ties, clashing columns, empty sides."""
    rows = [(100, [1, 2], 0), (100, [1, 2], 1), (100, [3, 0], 2), (7, [1, 2], 3), (None, [9, 9], 4), (8, [], 5), (5, [1, 2, 4], 6), (200, [0, 0, 1], 7)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<long>, row long, score string")
    asked = table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(r) for r in topk.top_k(table, asked, 4).collect())
    want = []
    for q, v, row in rows:
        if q is not None and q % 100 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c, r) for c, w, r in rows if c is not None and r != row)
            want += [(q, k + 1, c, -s) for k, (s, c, _) in enumerate(all_[:4])]
    assert got == sorted(want)
    plain = topk.top_k(table.drop("row"), asked.drop("row"), 3)
    assert {r.query_id for r in plain.collect()} == {100, 200} and plain.where("query_id = vec_id").count() == 0
    assert topk.top_k(table.where("false"), asked).count() == 0 and topk.top_k(table, asked.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare.rows(queries.queries()[name](spark, sf).toPandas()) == compare.rows(compare.oracle(sf).sql(queries.oracle_sql()[name]).df())


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for table, key in ((docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id"), (spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")):
        got = packing.pack(table, path).toPandas()
        texts = {r[key]: r["text"] for r in table.collect()}
        assert set(got.doc_id) == set(texts)
        for doc, part in got.groupby("doc_id"):
            ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
            part = part.sort_values("start")
            assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
            for r in part.itertuples():
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        for _, seq in got.groupby("sequence_id"):
            seq = seq.sort_values("offset")
            assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.95
    assert packing.pack(docs, path).agg(F.sum("length")).first()[0] > 0 and packing.pack(empty, path).count() == 0


def test_cutting_patterns():
    demand = np.random.default_rng(12).integers(0, 40, 64)
    patterns = packing.cutting_patterns(demand)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
    # the linear program bounds any packing from below; total length alone does not, as long pieces need not fit together
    columns, x = packing.linear_patterns(demand)
    assert ((columns * x[:, None]).sum(axis=0) >= demand - 1e-6).all()
    assert x.sum() - 1e-6 <= sum(n for _, n in patterns) <= x.sum() * 1.02 + 2
    value = R.random(20)
    best, pattern = packing.price(value, 20)
    exact = [0.0]
    for c in range(1, 21):
        exact.append(max([exact[c - 1], *(value[k - 1] + exact[c - k] for k in range(1, c + 1))]))
    assert math.isclose(best, exact[20]) and math.isclose(best, float((pattern * value).sum()))


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("crowd", [256, 3])
def test_jaccard_join(spark, docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    base, r, rows = prose(120, 20).split(), np.random.default_rng(4), []
    for k in range(60):
        words = list(base)
        for at in r.choice(120, int(r.integers(0, 5)), replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((1000 + k, " ".join(words)))
    table = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {r["doc_id"]: grams(r["text"]) for r in table.collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    links = {c: {o for s, o in first.items() if o != c and s and x and len(s & x) / len(s | x) >= 0.8} for x, c in first.items()}
    got = jaccard_join.join(table).toPandas().set_index("doc_id")
    assert len(got) == len(sets)
    for d, s in sets.items():
        c = first[s] if s else d
        assert got.class_id[d] == c and got.n_links[d] == len(links[c] if s else ())
    group = {c: c for c in first.values()}
    for _ in group:
        group = {c: min([group[c], *(group[o] for o in links[c])]) for c in group}
    assert all(got.group_id[d] == (group[first[s]] if s else d) for d, s in sets.items())
    kept = {r["doc_id"] for r in jaccard_join.keep_one(table).collect()}
    assert kept == set(got.group_id) and jaccard_join.join(empty).count() == 0
    assert jaccard_join.join(docs).count() == docs.count()
    one = jaccard_join.keep_one(docs)
    assert one.columns == docs.columns and one.where("doc_id = 8").count() == 1


def test_band_count():
    b = jaccard_join.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_digests(docs):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).toPandas()
    assert got[got.doc_id == 0].kept_sha256.tolist() == [hashlib.sha256(b"").hexdigest()]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in c.STAGES[:-1]:
        new = stage(spark, out, SF)
        assert new.columns == docs.columns, name
        assert new.count() <= out.count()
        out = spark.createDataFrame(new.toPandas(), new.schema)
    texts = [r["text"] for r in out.collect()]
    assert len(texts) > 0.8 * docs.count()
    assert c.run(spark, SF).select("doc_id").distinct().count() == out.count()


def test_pipeline_keeps_replacement_characters_of_the_input(spark):
    import corpus_pipeline as c

    once, twice = prose(30, 31), "é" + prose(80, 32)[:300]
    # the two repeats are preceded by characters that share their last byte, so that both cuts split a character
    texts = [f"a \ufffd{once}\ufffd", f"{prose(9, 33)} \ufffdx \ufffd" + "\u00e9" + twice, f"{prose(9, 34)} \u0129" + twice, None, ""]
    table = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in c.repeated_substrings(spark, table, SF).collect()}
    want = [texts[0], f"{prose(9, 33)} \ufffdx \ufffd", f"{prose(9, 34)} ", None, ""]
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(want))
    assert all(v[1] == len(v[0]) for v in got.values() if v[0] is not None)


def thue_morse(n, letters):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join(letters[x] for x in word[:n])


def test_words_that_polynomials_confuse_are_told_apart(spark):
    start = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{start} {thue_morse(2048, 'ab')}"), (2, f"{start} {thue_morse(2048, 'ba')}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_passages(docs).collect()] == [0, 0]
    blocks = spark.createDataFrame([(1, "z" * 100 + thue_morse(256, "ab")), (2, "z" * 100 + thue_morse(256, "ba"))], "doc_id long, text string")
    rows = [r.text.encode() for r in blocks.collect()]
    want = [int(m.sum()) for m in covered(rows, 200)]
    assert [r.n_removed for r in suffix_dedup.remove_repeats(blocks).collect()] == want


def test_very_long_texts(spark):
    """A row beyond the pieces in which symbols are hashed, with repeats planted far apart and across the edge of a piece."""
    r = np.random.default_rng(5)
    raw = bytearray(r.choice(list(b"abcdefgh   "), 700_000).astype(np.uint8).tobytes())
    raw[repeats.BLOCK - 120 : repeats.BLOCK + 180] = raw[1_000:1_300]
    raw[650_000:650_900] = raw[400_000:400_900]
    rows = [bytes(raw), bytes(raw[100_000:100_450])]
    docs = spark.createDataFrame([(k, x.decode()) for k, x in enumerate(rows)], "doc_id long, text string")
    for x, m, got in zip(rows, covered(rows, 200), suffix_dedup.remove_repeats(docs).orderBy("doc_id").collect(), strict=True):
        assert (bytes(got.kept), got.n_removed) == (bytes(np.frombuffer(x, np.uint8)[~m]), int(m.sum()))
    words = [tuple(x.split()) for x in rows]
    for x, m, got in zip(words, covered(words, 35), substring_dedup.remove_passages(docs).orderBy("doc_id").collect(), strict=True):
        assert (got.kept.encode(), got.n_removed) == (b" ".join(w for w, gone in zip(x, m, strict=True) if not gone), int(m.sum()))


def test_repeats_of_random_words(spark):
    """Few different words: many seeds, chains of partial matches, and groups of many contents."""
    r = np.random.default_rng(8)
    base = [" ".join(r.choice(list("ab"), 90)) for _ in range(4)]
    texts = []
    for _ in range(60):
        b = base[int(r.integers(4))].split()
        a = int(r.integers(0, 50))
        piece = b[a : a + int(r.integers(20, 60))]
        if r.random() < 0.5 and piece:
            piece[int(r.integers(len(piece)))] = "x"
        texts.append(" ".join([*r.choice(list("cd"), 5), *piece, *r.choice(list("cd"), 5)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [tuple(t.encode().split()) for t in texts]
    got = {x.doc_id: x.n_removed for x in substring_dedup.remove_passages(docs).collect()}
    assert got == {k: int(m.sum()) for k, m in enumerate(covered(rows, 35))}
    raw = [t.encode() for t in texts]
    kind = repeats.Kind(window=40, seed=8)
    got = {x.doc_id: x.n_removed for x in suffix_dedup.remove_repeats(docs, kind).collect()}
    assert got == {k: int(m.sum()) for k, m in enumerate(covered(raw, 40))}


def test_jaccard_join_recall_near_the_threshold(spark):
    """Hundreds of pairs around the threshold, against an exact join: bands miss few, verification lets none through."""
    r, texts = np.random.default_rng(12), []
    for k in range(300):
        words = prose(100, 1000 + k).split()
        other = list(words)
        for at in r.choice(100, int(r.integers(1, 4)), replace=False):
            other[at] = f"n{at}"
        texts += [" ".join(words), " ".join(other)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0] + " tail"), (None, texts[2] + " tail")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sets = [grams(t) for t in texts]
    true = {k for k in range(0, 600, 2) if len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) >= 0.8}
    linked = got.dropna().set_index("doc_id").group_id
    found = {k for k in range(0, 600, 2) if linked[k + 1] == linked[k]}
    assert len(true) > 150 and found <= true and len(found) >= 0.99 * len(true)
    # links to classes that have no id count
    n = got.dropna(subset="doc_id").set_index("doc_id").n_links
    assert n[0] == 1 + (0 in true) and n[2] == 1 + (2 in true)
    assert len(got) == 602 and got.n_links[got.doc_id.isna()].min() >= 1


def test_pipeline_stages_on_odd_rows(spark, empty):
    """Every stage against a plain version, with nulls, repeated rows, an empty table, and columns that clash with the operators' own."""
    import corpus_pipeline as c

    near = prose(100, 40).split()
    texts = [prose(60, 41), None, "", "123 !", " ".join(near), " ".join([*near[:50], "other", *near[51:]]), prose(20, 42) + " " + COMMON, prose(20, 43) + " " + COMMON, "Mail jane.doe@example.com or 4111 1111 1111 1111", prose(3000, 44)]
    rows = [(k, t, "en", 0.25, "mine", 7, [k]) for k, t in enumerate(texts)] + [(0, texts[0], "en", 0.25, "mine", 7, [0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, `a.b` string, n_removed long, kept array<long>")
    out = {name: stage(spark, docs, SF) for name, stage in c.STAGES}
    for name, _ in c.STAGES[:-1]:
        assert out[name].columns == docs.columns
        assert {(r["score"], r["a.b"], r["n_removed"], r["kept"][0] == r["doc_id"]) for r in out[name].collect()} == {(0.25, "mine", 7, True)}
        assert dict(c.STAGES)[name](spark, docs.where("false"), SF).count() == 0
    text = {name: {r["doc_id"]: r["text"] for r in out[name].collect()} for name, _ in c.STAGES[:-1]}
    assert set(text["language_id"]) == {k for k, t in enumerate(texts) if t and any(x.isalpha() for x in t)} and out["language_id"].count() == 8
    assert set(text["jaccard_join"]) == {0, 1, 2, 3, 4, 6, 7, 8, 9} and out["jaccard_join"].count() == 9
    raw = [(t or "").encode() for _, t, *_ in rows]
    for (k, t, *_), x, m in zip(rows, raw, covered(raw, 200), strict=True):
        assert text["suffix_dedup"][k] == (t if t is None else bytes(np.frombuffer(x, np.uint8)[~m]).decode())
    assert out["suffix_dedup"].count() == len(rows)
    changed = {k for k, t in text["pii"].items() if t != texts[k]}
    assert changed == {8} and "jane.doe" not in text["pii"][8] and "4111 1111" not in text["pii"][8] and out["pii"].count() == len(rows)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = out["packing"].toPandas()
    want = Counter({k: len(coder.encode(texts[k] or "", add_special_tokens=False).ids) + 1 for k in range(len(texts))})
    want[0] *= 2
    assert Counter(pieces.groupby("doc_id").length.sum().to_dict()) == want
