"""Main text, SentencePiece, quality rules and language-model scores."""

import hashlib
import html as entities
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard

from tidewater.llm import lm, pieces, quality, textkit, wrappers
from tidewater.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_words int, kept string, score double"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\n", "a", "a b c d", "same line\nsame line\n\nsame line", "\u2003x\u00a0y z", "one two three four five " * 30, "é" * 3000, "#*$%&|<> x", "\x0b\x1cq\x85r", "é́日本 😀 " * 50, "tail\n", "w" * 70000 + " end"]


def docs(spark, texts):
    return spark.createDataFrame([(i if i % 5 else None, t, "en", None, 1, "clash", 0.5) for i, t in enumerate(texts)], DOCS)


def slices_of(texts):
    for first, end, data, at in textkit.slices(pa.array(texts, pa.string()), 50):
        yield texts[first:end], textkit.Texts(data, at)


def test_words_and_windows_of_slices():
    random.seed(1)
    texts = ODD + ["".join(random.choice(["a", "b", " ", "\n", "é", "\t"]) for _ in range(random.randrange(60))) for _ in range(200)]
    seen = 0
    for part, t in slices_of(texts):
        hashes = t.word_hash() if len(t.start) else np.zeros(0, np.uint64)
        windows, first = t.windows(hashes, 3)
        for i, text in enumerate(part):
            words = WORD.findall(text or "")
            assert t.n_words[i] == len(words)
            own = hashes[t.first[i] : t.first[i + 1]].tolist()
            assert len(set(own)) == len(set(words)) and [words.index(w) for w in words] == [own.index(h) for h in own]
            runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
            got = windows[first[i] : first[i + 1]].tolist()
            assert [runs.index(r) for r in runs] == [got.index(h) for h in got]
            seen += 1
    assert seen == len(texts)


def base_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if count[r] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_quality_counts_on_odd_texts(spark):
    got = quality.score(docs(spark, ODD)).collect()
    want = Counter(base_counts(t) for t in ODD)
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.score(docs(spark, ODD).limit(0)).count() == 0


def test_quality_counts_on_the_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in quality.score(d).collect()}
    for r in d.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base_counts(r.text)
    kept = quality.keep(d)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}
    packer, verdicts = zstandard.ZstdCompressor(level=3), Counter()
    for r in d.collect():
        want = plain_verdict((r.text or "").encode(), packer)
        assert got[r.doc_id].verdict == want and got[r.doc_id].kept == (want == "fits" and not got[r.doc_id].base_failed)
        verdicts[want] += 1
    assert verdicts["repetitive"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect() if r.doc_id in got and not got[r.doc_id].base_failed}
    kept_of = lambda q: [got[i].kept for i, x in labels.items() if x == q]
    assert np.mean(kept_of(1)) >= 0.98 and np.mean(kept_of(0)) <= 0.5


def plain_verdict(data, packer):
    """The bands by hand: limits from the two knots around the length."""

    def limits(n):
        at = min(max(math.log2(n), quality.Bands().knots[0][0]), quality.Bands().knots[-1][0])
        for (a, *low), (b, *high) in zip(quality.Bands().knots, quality.Bands().knots[1:], strict=False):
            if a <= at <= b:
                return [x + (y - x) * (at - a) / (b - a) for x, y in zip(low, high, strict=True)]

    if not data:
        return "fits"
    ratio = lambda part: len(packer.compress(part)) / len(part)
    low, high = limits(len(data))
    if not low <= ratio(data) <= high:
        return "repetitive" if ratio(data) < low else "incompressible"
    parts = [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) > 4096 else []
    out = sum(len(p) for p in parts if not limits(len(p))[0] <= ratio(p) <= limits(len(p))[1])
    return "chunks" if out > 0.5 * len(data) else "fits"


def test_compression_bands_reject_both_ends(spark):
    random.seed(2)
    vocabulary = ["".join(random.choice("eeetttaaoinshrdlucmfwypvbgkjqxz") for _ in range(random.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(n))
    flat = " ".join(f"buy{i % 4} now{i % 4}" for i in range(2000))
    half = prose(3000) + " " + " ".join(f"spam{i % 9}x" for i in range(9000))
    got = {r.doc_id: r.verdict for r in quality.score(spark.createDataFrame([(1, prose(800)), (2, flat), (3, noise(900)), (4, prose(20)), (5, half)], "doc_id int, text string")).collect()}
    assert got == {1: "fits", 2: "repetitive", 3: "incompressible", 4: "fits", 5: "repetitive"} or got[5] == "chunks" and {k: got[k] for k in (1, 2, 3, 4)} == {1: "fits", 2: "repetitive", 3: "incompressible", 4: "fits"}


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_on_odd_texts(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    random.seed(3)
    bits = ["a", "the", " ", "  ", "▁", "\n", "é", "日", "\t", "\0", "<s>", "</s>", "<unk>", "😀", ".", "x ", "‍", "▁a", " \n", "ing", "\u3000"]
    texts = ODD + ["".join(random.choice(bits) for _ in range(random.randrange(14))) for _ in range(1500)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for ids in (sp.encode(t or "") for t in texts))
    digests = lambda corpus_table=False: Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs(spark, texts), corpus_table=corpus_table).collect())
    assert pieces.Segmenter(MODEL).apart() and digests() == want
    monkeypatch.setattr(pieces, "TABLE_WORDS", 100)
    assert digests() == want == digests(True)
    monkeypatch.setattr(pieces, "HEAD", 40)  # most words are joined by position
    assert digests(True) == want
    monkeypatch.setattr(pieces.Segmenter, "apart", lambda self: False)
    assert digests() == want
    assert pieces.digests(docs(spark, ODD).limit(0)).count() == 0


def test_pieces_segment_each_word_once(spark):
    counts = pieces.word_counts(docs(spark, ["a b  a", "b", None, "x" * 100_000]).withColumnRenamed("text", "_text"))
    table_ = pieces.chunk_table(counts, MODEL).collect()
    assert {(r.word, r.c) for r in table_} == {("a", 1), ("b", 2), ("▁a", 1), ("x" * 100_000, 1)} and len(table_) == 4


def test_pieces_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    assert pieces.decode(pieces.encode(d.limit(0))).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d)).collect()}
    assert back == {r.doc_id: r.text for r in d.collect()}
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).collect()] == [""]


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def texts_of(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


def test_main_text_of_odd_pages(spark):
    rows = [
        (1, None, None), (2, "http://a/", ""), (3, "http://a/", "plain & <b>bold</b>text"), (4, "x", "<p>cut &amp; dry<p>open <i>it</i>em"),
        (5, "http://b/", page('<div id="cookie-notice">C</div><header>H</header><main><article><h1>T</h1><p>One<b>two</b> x<br>y<p>Three &lt; <span hidden>no</span>four<ul><li>a<li>b</ul><section class="comments"><p>bad</p></section><aside>s</aside><script>var t="</p>";1<2</script>tail</article></main><form>f</form><footer>F</footer><p>after')),
        (6, "http://c/", page("<nav>n</nav><p>one</p><div role='complementary'>r</div><div style='display: none'>h</div><p>two</p>")),
        (7, "http://d/", "<div " + "a" * 50 + '="' ), (8, "http://d/", "<p>" * 3000 + "deep"), (9, "http://d/", "<div>" * 3000 + "deep &#233;&nbsp;x"), (10, "http://d/", "a<!-- b -->c<![CDATA[d]]>e < f"),
    ]
    got = texts_of(spark, rows)
    assert got == {1: "", 2: "", 3: "plain & boldtext", 4: "cut & dry open item", 5: "T Onetwo x y Three < four a b tail", 6: "one two", 7: "", 8: "deep", 9: "deep é x", 10: "ace < f"}
    assert texts_of(spark, []) == {}


def test_wrapper_drops_what_a_host_repeats(spark):
    random.seed(4)
    body = lambda i: f"<div>Follow {i % 2} the site</div><div><p>{' '.join(random.choice('abcdefgh') * 3 for _ in range(20))} {i}</p><p>story {i} goes on</p></div><div>All rights kept</div>"
    rows = [(i, "http://host.net/p", page(body(i))) for i in range(12)] + [(99, "http://rare.net/", page(body(99)))]
    got = texts_of(spark, rows)
    for i in range(12):
        assert "story" in got[i] and "Follow" not in got[i] and "rights" not in got[i]
    assert "Follow" in got[99]


def test_slots_decide_inside_and_outside_the_article(spark):
    body = lambda i: f"<section>lead {i} of the tale</section><article><h1>name {i}</h1><div>Send this to a friend</div><p>story {i} goes on</p><p style='display:none'>hid {i}</p></article><div>All rights kept</div>"
    got = texts_of(spark, [(i, "http://host.net/p", page(body(i))) for i in range(12)] + [(99, "http://rare.net/", page(body(99)))])
    assert all(got[i] == f"lead {i} of the tale name {i} story {i} goes on" for i in range(12))
    assert got[99] == "name 99 Send this to a friend story 99 goes on"  # too few pages: elements decide


def test_copies_count_once_and_each_layout_has_a_wrapper(spark):
    story = lambda i: f"<div>Follow the site</div><div><p>story {i} goes on</p><p>and {i} ends</p></div><div>All rights kept</div>"
    # Every page occurs three times, once with another comment; the smallest id is empty.
    rows = [(0, "http://host.net/p", "")] + [(1 + 3 * i + k, f"http://host.net/{k}", page(story(i) + "<!-- x -->" * (k == 2))) for i in range(8) for k in range(3)]
    other = lambda i: f"<table><tr><td>Menu of dishes</td><td>table {i} is set</td></tr></table><section><p>course {i}</p></section><section>Call us</section>"
    rows += [(100 + i, "http://host.net/o", page(other(i))) for i in range(6)]
    got = texts_of(spark, rows)
    assert got[0] == ""
    assert all(got[1 + 3 * i + k] == f"story {i} goes on and {i} ends" for i in range(8) for k in range(3))
    assert all(got[100 + i] == f"table {i} is set course {i}" for i in range(6))


def unnamed_pages():
    """(page, its paragraphs): menu, advert, story and footer all vary, and no element has a name that tells."""
    words = lambda n: " ".join(random.choice(["tal", "mor", "ved", "sil", "kan", "oru"]) for _ in range(n))
    random.seed(8)

    def one(i):
        story = [words(random.randrange(20, 60)) + f" {i}" for _ in range(random.randrange(1, 9))]
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(random.randrange(3, 7)).split())
        body = "".join(f"<p>{x}</p>" for x in story)
        return page(f"<div><ul>{menu}</ul></div><div>{words(5)} {i}</div><div><h1>{words(3)} {i}</h1>{body}</div><div>from {words(6)} {i}</div>"), story

    return [one(i) for i in range(40)]


def test_unnamed_pages_give_the_story_alone(spark):
    made = unnamed_pages()
    assert {m for h, _ in made for m in wrappers.blocks_of(h)[5]} == {0}
    got = texts_of(spark, [(i, "http://host.net/p", h) for i, (h, _) in enumerate(made)])
    for i, (html, story) in enumerate(made):
        heading = html.split("<h1>")[1].split("</h1>")[0]
        assert got[i] == " ".join([heading, *story])


def test_pages_without_names_equal_their_articles(spark, sf_dir):
    """Every page of the table with its names erased, against its article cut out by its tags."""
    rows, want = [], {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h\d|li|ul|ol|div|br|table|tr|td|th)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", re.sub(r"(?s)<(script|style)\b.*?</\1>", " ", article))))
        want[r.page_id] = " ".join(entities.unescape(plain).split())
        rows.append((r.page_id, "http://one.host/p", re.sub(r"(</?)(?:nav|footer|article)>", r"\1div>", r.html).replace('<div class="ad">', "<div>")))
    assert len(rows) >= 20 and texts_of(spark, rows) == want


def test_regions_by_hand():
    turns = wrappers.TURNS
    tags = ",".join(["0 #", "1 div", "2 ul", "3 li", "1 div", "2 h1", "2 p", "1 div"])
    sums = lambda **k: [(int(p[1:]) * turns, n, n > 0) for p, n in k.items()]
    assert wrappers.region_of(tags, sums(p3=5, p5=20, p6=900, p7=40)) == (4, 7, [0])
    assert wrappers.region_of(tags, sums(p3=500, p5=20, p6=900, p7=40)) == (0, 8, [])  # no part holds most
    assert wrappers.region_of(tags, sums(p3=5, p7=900)) == (0, 8, [])  # a block is no container
    assert wrappers.region_of(tags, []) == wrappers.region_of("0 #", []) == (0, 0, [])
    assert wrappers.region_of(tags, [(-1 - 4, 900, False)]) == (4, 7, [0])  # not aligned, below the container
    beside = "0 #,1 p,1 div,2 p"  # a paragraph that varies beside the container
    assert wrappers.region_of(beside, sums(p1=10, p3=900)) == (0, 4, [])
    assert wrappers.region_of(beside, [(turns, 10, False), (3 * turns, 900, True)]) == (2, 4, [0])
    # Dropped: below a slot outside. By names alone: a page with nothing in the region, and blocks beside it.
    texts, marks = ["menu", "story", "more", "beside"], [0, 0, 0, 0]
    assert wrappers.main_text([3 * turns, 6 * turns, -1 - 4, -1], texts, marks, frozenset(), frozenset(), (4, 7, [0])) == ("story more beside", 1, 0)
    assert wrappers.main_text([3 * turns, -1 - 1, None, -1], texts, [-1, 0, 0, 0], frozenset(), frozenset(), (4, 7, [0])) == ("story more beside", 0, 1)
    assert wrappers.main_text([6 * turns] * 4, texts, [0, -1, -2, 0], frozenset(), frozenset(), (4, 7, [0])) == ("menu beside", 0, 2)


def test_longer_comments_than_stories_are_no_region(spark):
    long = lambda i, k: " ".join(f"reply{i}x{k}y{j}" for j in range(60))
    body = lambda i: f"<div><p>story {i} goes on</p><p>and {i} ends</p></div><div class='comments'><p>{long(i, 0)}</p><p>{long(i, 1)}</p></div>"
    got = texts_of(spark, [(i, "http://host.net/p", page(body(i))) for i in range(12)])
    assert all(got[i] == f"story {i} goes on and {i} ends" for i in range(12))


def test_near_copies_of_a_story_are_no_template(spark):
    random.seed(9)
    words = lambda n: " ".join(random.choice("abcdefgh") * 4 + str(random.randrange(99)) for _ in range(n))
    stories = [(words(5), [words(30) for _ in range(8)]) for _ in range(6)]
    rows, want = [], {}
    for i in range(48):  # every story on eight pages, each with another advert and another last word
        head, parts = stories[i % 6]
        rows.append((i, "http://host.net/p", page(f"<div>Follow the site</div><div>buy {words(3)}</div><div><h1>{head}</h1>{''.join(f'<p>{p}</p>' for p in parts)}<p>end {i}</p></div>")))
        want[i] = " ".join([head, *parts, f"end {i}"])
    assert texts_of(spark, rows) == want


def test_pages_of_another_kind_are_not_cut_by_the_region(spark):
    story = lambda i: f"<div>ad {i}</div><div><h1>name {i}</h1><p>{'story goes on ' * 9}{i}</p></div>"
    odd = "<section><p>only a list of things</p></section>"
    got = texts_of(spark, [(i, "http://host.net/p", page(story(i))) for i in range(12)] + [(99, "http://host.net/o", page(odd))])
    assert got[99] == "only a list of things" and all(got[i].startswith(f"name {i} story") for i in range(12))


def test_simple_tree_matching_keeps_order_and_counts(monkeypatch):
    tree = lambda html: wrappers._settle(wrappers.parse(html)[0])

    def brute(a, b):
        if a.tag != b.tag:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute(x, y))
        return 1 + m[-1][-1]

    random.seed(5)

    def size(a, b):
        known = {}
        wrappers._shaped(a, known)
        wrappers._shaped(b, known)
        return wrappers._Matching().size(a, b)

    make = lambda d: "".join(f"<{t}>{make(d - 1) if d else 'x'}</{t}>" for t in random.choices(["div", "ul", "section"], k=random.randrange(4)))
    for _ in range(60):
        a, b = tree(make(3)), tree(make(3))
        pairs = wrappers.aligned(a, b)
        assert size(a, b) == brute(a, b) == len(pairs) and len(set(pairs.values())) == len(pairs)
        monkeypatch.setattr(wrappers, "BY_ARRAYS", 0)
        assert wrappers.aligned(a, b) == pairs
        monkeypatch.undo()


def test_hostile_pages_take_linear_time():
    for part in ("<a ", '<a ">" ', "<!--", "<script>", "<", '<a "'):
        began = time.time()
        wrappers.parse(part * (1_000_000 // len(part)) + "'")
        assert time.time() - began < 3, part
    root, blocks = wrappers.parse("<div>" * 20_000 + "deep" + "</div>" * 20_000 + "</x>" * 20_000 + '<p title="open>after<p>end')
    assert [t for _, t in blocks] == ["deep", "after", "end"]
    assert len(wrappers.aligned(wrappers._settle(root), wrappers._settle(wrappers.parse("<div>" * 20_000)[0]))) == 20_001


def test_the_template_decides_on_unmarked_pages():
    tags = wrappers.blocks_of("<div>Follow us</div><div><p>story</p></div><div>Rights</div>")[1]
    _, own, _, places, texts, marks, *_ = wrappers.blocks_of("<div>Follow us</div><div><p>one</p><p>two</p></div><div>Rights</div>")
    slots = wrappers.slots_of(tags, own, places)
    assert wrappers.main_text(slots, texts, marks, frozenset())[0] == "Follow us one two Rights"
    assert wrappers.main_text(slots, texts, marks, frozenset({slots[0], slots[-1]}))[0] == "one two"


def test_lm_base_and_shape(spark):
    texts = ["The cat sat on the mat the end", None, "", "the CAT é", "unseen words here now", "cat " * 500] * 4
    rows = docs(spark, texts)
    got = lm.score(rows).collect()
    assert len(got) == len(texts)
    low = {c: c + 32 for c in range(65, 91)}
    toks = [(r.doc_id, WORD.findall((r.text or "").translate(low)) + [None]) for r in rows.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter((held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    assert Counter((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(rows.limit(0)).count() == 0


def test_lm_gradients_are_the_losses(spark):
    rng = np.random.default_rng(7)
    lex = lm.make_lexicon(pa.table({"hash": pa.array(rng.integers(1, 2**60, 50)), "form": pa.array(rng.integers(0, 16, 50).astype("int32")), "c": pa.array(rng.integers(1, 99, 50))}), {f: (5000, 60) for f in range(16)})
    p = {k: x.astype(np.float64) for k, x in lm.first_weights(lex, 1).items()}
    p["uc"], p["uw"] = p["uc"] * 20, p["uw"] * 20
    given, target = rng.integers(0, lm.VOCABULARY, (5, 4)), rng.integers(0, lm.VOCABULARY, (5, 4))
    on, h = rng.random((5, 4)) < 0.8, rng.standard_normal((4, lm.HIDDEN))
    g = {k: np.zeros(x) for k, x in lm.SHAPES.items()}
    lm.gradients(p, given, target, on, h, g)
    loss = lambda q: lm.gradients(q, given, target, on, h, {k: np.zeros(x) for k, x in lm.SHAPES.items()})[1]
    for k in lm.SHAPES:
        for at in zip(*(rng.integers(0, n, 4) for n in lm.SHAPES[k]), strict=True):
            if k == "emb":
                at = (int(given[0, 0]), at[1])
            if k in ("uw", "bw"):
                at = (int(target[on][0]) // lm.PER_CLASS, *at[1:])
            e = 1e-5
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += e
            down[k][at] -= e
            want = (loss(up) - loss(down)) / (2 * e)
            assert abs(g[k][at] - want) < 1e-4 * max(1, abs(want)), (k, at)


def test_lm_is_a_distribution_and_lanes_do_not_matter():
    rng = np.random.default_rng(8)
    lex = lm.make_lexicon(pa.table({"hash": pa.array(rng.integers(1, 2**60, 50)), "form": pa.array(rng.integers(0, 16, 50).astype("int32")), "c": pa.array(rng.integers(1, 99, 50))}), {f: (5000, 60) for f in range(16)})
    p = lm.first_weights(lex, 1)
    h = rng.standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.VOCABULARY)
    assert abs(np.exp(lm.log_probability(p, np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4
    sizes = [1, 40, 3, 700, 5, 5, 90]
    ids = rng.integers(0, lm.VOCABULARY, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    together = lm.document_scores(p, ids, first, lex.end_id)
    apart = [lm.document_scores(p, ids[a:b], np.array([0, b - a]), lex.end_id)[0] for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(together, apart, rtol=1e-4)
    plain = [_plain_score(p, ids[a:b].tolist(), lex.end_id) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(together, plain, rtol=1e-4)


def _plain_score(p, ids, end_id):
    """The model token by token, in double precision: a gated unit, then class and word by softmax."""
    p = {k: x.astype(np.float64) for k, x in p.items()}
    soft = lambda x: x / (1 + np.abs(x))
    share = lambda x, i: x[i] - np.log(np.exp(x).sum())
    h, given, out = np.zeros(lm.HIDDEN), end_id, 0.0
    for word in ids:
        x = [p["emb"][given] @ p["wx"][k] + p["b"][k, 0] for k in range(3)]
        reset, update = ((soft(x[k] + h @ p["wh"][k]) + 1) / 2 for k in (0, 1))
        cand = soft(x[2] + reset * (h @ p["wh"][2]))
        h = (1 - update) * cand + update * h
        c, w = divmod(word, lm.PER_CLASS)
        out += share(h @ p["uc"] + p["bc"], c) + share(h @ p["uw"][c] + p["bw"][c], w)
        given = word
    return out


def test_lm_learns_from_whole_texts(spark, monkeypatch):
    seen, steps = [], lm.gradients

    def watched(p, given, target, on, h, g):
        seen.append((given.copy(), target.copy(), on.copy(), h.copy()))
        out = steps(p, given, target, on, h, g)
        seen[-1] += (out[0].copy(),)
        return out

    monkeypatch.setattr(lm, "gradients", watched)
    rng = np.random.default_rng(2)
    lex = lm.make_lexicon(pa.table({"hash": pa.array(rng.integers(1, 2**60, 50)), "form": pa.array(rng.integers(0, 16, 50).astype("int32")), "c": pa.array(rng.integers(1, 99, 50))}), {f: (5000, 900) for f in range(16)})
    texts = [rng.integers(0, lm.VOCABULARY, n).astype(np.int16) for n in (1000, 1, 16, 333)]
    theta = lm.flat(lm.first_weights(lex, 1))
    before = theta.copy()
    assert lm.train(theta, iter(texts), lex.end_id) == 1350 and (theta != before).any()
    lane = np.concatenate([t[:, 0][on[:, 0]] for _, t, on, _, _ in seen])
    assert (lane == texts[0]).all() and (np.concatenate([g[:, 0][on[:, 0]] for g, _, on, _, _ in seen]) == [lex.end_id, *texts[0][:-1]]).all()
    assert all((a[4][0] == b[3][0]).all() for a, b in zip(seen, seen[1:], strict=False)) and seen[1][3][0].any()
    rows = docs(spark, ["word " * 5000 + "last"])
    slim = rows.selectExpr("doc_id as _id", "1L as _key", "false as held_out", "text as _text")
    got = lm.encoded(slim, spark.sparkContext.broadcast(lex)).first()
    assert len(got.ids) == 2 * 5002 and got.n_tokens == 5002


def test_lm_does_not_depend_on_the_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 8192)  # several replicas a round
    whole = table(spark, sf_dir, "documents").select("doc_id", "text")
    one, other = ({r.doc_id: r.score for r in lm.score(d).collect()} for d in (whole.coalesce(1), whole.repartition(7, "text")))
    assert all(abs(one[k] - other[k]) <= 1e-5 * abs(one[k]) for k in one)


def test_lm_deals_repeated_rows_apart():
    assert lm._occurrence(np.array([5, 7, 5, 5, 7, 9])).tolist() == [0, 0, 1, 2, 1, 0] and len(lm._occurrence(np.zeros(0, np.int64))) == 0


def test_lm_beats_the_base_on_held_out_documents(spark, sf_dir):
    got = [r for r in lm.score(table(spark, sf_dir, "documents")).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.05
