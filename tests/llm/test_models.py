"""Quality rules, language-model scores, language identification, HTML and personal data."""

import collections
import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import lm_score, pii
from larkspur.llm.html_text import extract_main_text, main_text
from larkspur.llm.language_id import identify
from larkspur.llm.lm_score import score_texts
from larkspur.llm.quality import score_documents, with_trust

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    inside = {j for i, g in enumerate(tri) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_quality_counts(spark):
    r = random.Random(5)
    texts = ["", None, "  \n\t", "a", "a b c a b c", "a b c d a b c x a b c", "x\nx\n\n \ny\nx", "é#|é <ü> " * 9, " ".join(r.choice("abc") for _ in range(300)), "a a a a a", "\x0b one\x0ctwo "]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = score_documents(df, F.lit(None).cast("boolean")).collect()
    for x in got:
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute_counts(texts[x["doc_id"]]), x
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and x["score"] == 0.0
    assert score_documents(df.limit(0), F.lit(True)).count() == 0


def test_quality_score_parts_junk(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "of", "and", "house", "tree", "water", f"n{r.randint(0, 3000)}"]) for _ in range(80))
    junk = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "WIN!!", f"N{r.randint(0, 3000)}!!"]) for _ in range(80))
    docs = [(i, good() if i % 4 else junk()) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, 200, 3)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    df = with_trust(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert not df.filter("doc_id = 1 and _trusted").count()
    got = {x["doc_id"]: x["kept"] for x in score_documents(df, F.col("_trusted"), buckets=256).filter("not base_failed").collect()}
    assert all(got[i] == bool(i % 4) for i in got)


def test_language_model(spark):
    r = random.Random(7)
    line = "the cat sat on the mat and the dog ran to the house"
    texts = {i: " ".join(r.choice([line, line.upper(), f"x{i} y{r.randint(0, 9)}"]) for _ in range(4)) for i in range(60)} | {100: None, 101: "", 102: " ", 103: "unseen words only"}
    df = spark.createDataFrame([(d, t, 1.0) for d, t in texts.items()], "doc_id long, text string, score double").repartition(4)
    out = {x["doc_id"]: x for x in score_texts(df, F.col("doc_id") % 7 == 2, min_count=2).collect()}
    tokens = lambda t: WORD.findall((t or "").lower()) + [None]
    count = collections.Counter(w for d, t in texts.items() if d % 7 != 2 for w in tokens(t))
    total, v = sum(count.values()), len(count)
    for d, t in texts.items():
        w, x = tokens(t), out[d]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (d % 7 == 2, len(w), sum(count[k] > 0 for k in w), total)
        assert x["base_score"] == pytest.approx(sum(math.log10((count[k] + 1) / (total + v + 1)) for k in w))
        assert x["score"] <= 0
    held = [x for x in out.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    none = score_texts(df, F.lit(True)).collect()
    assert all(x["train_tokens"] == 0 and x["base_score"] == 0.0 for x in none)
    assert score_texts(df.limit(0), F.lit(False)).count() == 0


@pytest.mark.parametrize(("shard_mb", "most_words"), [(256, 2_000_000), (0.0003, 12), (256, 0)])
def test_language_model_by_brute_force(spark, shard_mb, most_words):
    r = random.Random(17)
    word = lambda: f"w{int(r.expovariate(0.15))}"
    texts = {i: " ".join(word() for _ in range(r.randint(0, 80))) for i in range(150)} | {500: "w1 W2 w3", 501: None}
    tokens = {d: [None, *WORD.findall((t or "").lower()), "</s>"] for d, t in texts.items()}
    learned = [w for d, w in tokens.items() if d % 7 != 2]
    count = collections.Counter(x for w in learned for x in w[1:])
    total, v = sum(count.values()), len(count)
    quantised = lambda n: 1.3 ** round(math.log(n) / math.log(1.3)) if n else 0.0
    kept = {w for w, n in count.items() if n >= 3}
    pairs = collections.Counter((a, b) for w in learned for a, b in zip(w, w[1:]) if b in kept and (a is None or a in kept))
    pairs = {p: n for p, n in pairs.items() if n >= 3}
    uses, kinds = collections.Counter(), collections.Counter()
    for (a, _), n in pairs.items():
        uses[a] += n
        kinds[a] += 1

    def score(w):
        out = 0.0
        for a, b in zip(w, w[1:]):
            p = (quantised(count[b] if b in kept else 0) + 1) / (total + v + 1)
            if kinds[a]:
                n, t = quantised(pairs.get((a, b), 0)), quantised(kinds[a])
                p = (n + t * p) / max(max(quantised(uses[a]), n) + t, 1)
            out += math.log10(min(p, 1))
        return out

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {x["doc_id"]: x for x in score_texts(df, F.col("doc_id") % 7 == 2, min_count=3, shard_mb=shard_mb, most_words=most_words).collect()}
    for d, w in tokens.items():
        assert out[d]["n_known"] == sum(count[x] > 0 for x in w[1:])
        assert out[d]["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + v + 1)) for x in w[1:]))
        assert out[d]["score"] == pytest.approx(score(w)), d


def test_repeated_rows_are_scored_each(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b d"), (None, "a b d")], "doc_id long, text string")
    for options in ({}, {"most_words": 0}, {"shard_mb": 1e-4}):
        out = score_texts(df, F.lit(False), min_count=1, **options).collect()
        assert len(out) == 5 and {x["n_known"] for x in out} == {4} and {x["train_tokens"] for x in out} == {20}
        assert len({(x["doc_id"], round(x["score"], 9), round(x["base_score"], 9)) for x in out}) == 2


def test_a_full_filter_ends():
    full = lm_score.CountFilter(b"\xff" * lm_score.SEGMENT, 1, 1.3, 12)
    assert set(full.count(np.arange(1000, dtype=np.uint64))) == {1.3**11}


def test_planes():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 48, 100, dtype=np.uint64)
    assert (lm_score._unpacked(np.frombuffer(lm_score._packed(x, 6), np.uint8).reshape(6, -1)) == x).all()


def test_languages(spark):
    r = random.Random(8)
    words = {"en": "the and with that house water tree from have this".split(), "de": "der und mit dass haus wasser baum von haben dieses für über".split(), "fr": "le et avec que maison eau arbre depuis avoir été où".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(list(words) * 30)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "the house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify(df, F.col("doc_id") % 5 == 0).collect()
    got = {x["doc_id"]: x for x in out}
    assert all(got[d]["lang_pred"] == k for d, _, k in rows[:90])
    assert [got[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in out)
    assert {x["lang_pred"] for x in identify(df, F.lit(True)).collect()} == {"und"}
    assert identify(df.limit(0), F.lit(False)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p>One   two
three.<p><b>Bold</b> &eacute;&#228; text.<br>Next line</p><p>Short.</p></article>
<aside>More</aside><section id="comments"><p>Great post, really, it is one of the best that I have read in all these years.</p></section><form><label>Mail</label></form><footer>&copy; Me</footer></body></html>"""


def test_html():
    assert main_text(PAGE) == "Head & tail\nOne two three.\nBold éä text.\nNext line\nShort."
    assert main_text(None) == "" and main_text("") == "" and main_text("<html><body><nav>x</nav></body></html>") == ""
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    long = plain.replace("One   two\nthree.", "One two three, and so on until there is enough text in it that the curve of the text lengths surges.")
    assert main_text(long).startswith("Head & tail\nOne two three") and "Great post" not in main_text(long) and main_text(long).endswith("Short.")


def test_html_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    out = extract_main_text(df).orderBy("page_id").collect()
    assert [x["n_chars"] for x in out] == [len(main_text(PAGE))] * 2 + [0] and out[2]["text"] == ""
    assert extract_main_text(df.limit(0)).count() == 0


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    r = random.Random(9)
    parts = ["a.b@c-d.example.org", "a@b", "a@@b.c", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1+49 30 123456", "+", "@", "...", " ", "é", "12", "4785380592391139"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice(["", " ", ".", "\n"]) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text)[0] == brute_spans(text), text
    assert pii.base_spans("a" * 100_000 + "1" * 100_000)[0] == []


def test_tagger_on_held_out_lines():
    tagger = pii.train(pii._made_up(700), rounds=160)
    hit = miss = wrong = 0
    for text, spans in pii._made_up(150, seed=77):
        codes = pii._codes(text)
        starts = pii._windows(codes, np.flatnonzero((codes == 6) | (codes == 7)))
        base, refused = pii.base_spans(text)
        got = set(pii.reconcile(text, base, refused, starts, tagger.tags(pii._cut(codes, starts).astype(np.int64)))) if len(starts) else set(base)
        assert set(base) <= got
        hit, miss, wrong = hit + len(got & set(spans)), miss + len(set(spans) - got), wrong + len(got - set(spans))
    assert hit > miss and wrong < 0.1 * hit


def test_every_window_with_a_trigger_is_read():
    name = "firstname.lastname.x @ uni.example"  # its only trigger is the at sign
    for before in range(2 * pii.STRIDE):
        codes = pii._codes("." * before + name + "." * 40)
        starts = pii._windows(codes, np.flatnonzero(codes == 7))
        at = before + name.index("@")
        assert starts.tolist() == [s for s in range(-pii.WIDTH, len(codes), pii.STRIDE) if s <= at < s + pii.WIDTH]
    assert not len(pii._windows(codes, np.zeros(0, np.int64)))


def test_labelled_shapes_are_plausible():
    for text, spans in pii._made_up(1500):
        for kind, lo, hi in spans:
            if kind == 3 and not (lo and text[lo - 1].isalnum()) and not text[hi : hi + 1].isalnum():
                assert pii._plausible(kind, text, lo, hi), text[lo:hi]


def test_personal_data(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", "q"), (2, None, "q"), (3, "", "q"), (4, "ip 10.0.0.1 and 4111 1111 1111 1111", "q"), (4, "ip 10.0.0.1 and 4111 1111 1111 1111", "q")], "doc_id long, text string, spans string")
    out = pii.find_personal_data(df, made_up=60, rounds=10).orderBy("doc_id").collect()
    assert [(x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) for x in out] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 1, 0), (0, 1, 1, 0)]
    assert "email:5:12" in out[0]["spans"].split(",") and html.escape("") == ""
    assert pii.find_personal_data(df.limit(0), made_up=20, rounds=2).count() == 0


def test_html_keeps_paragraphs_of_the_article():
    page = "<article><p>One.</p><p class='search-results-note'>Two.</p><div class='promotion-story'><p>Three.</p></div><figure><img><figcaption>Four.</figcaption></figure><p class=notice>Five.</p><div class='ad-slot'>no</div><div class='comments'><p>no</p></div></article><div>outside</div>"
    assert main_text(page) == "One.\nTwo.\nThree.\nFour.\nFive."
    body = "A paragraph that is long enough for the curve to surge past its threshold, all by itself."
    teasers = f"<article>Teaser</article><div><p>{body}</p><p>{body}</p></div><article>Teaser</article>"
    assert body in main_text(teasers)


def test_html_in_linear_time():
    start = time.perf_counter()
    assert main_text("<article>" + "<b>" * 300_000 + "text" + "</i>" * 300_000 + "</article>") == "text"
    assert main_text("<article><p>text</p>" + "<div>" * 200_000) == "text"
    assert time.perf_counter() - start < 30


def test_letters_beyond_the_first_plane(spark):
    rows = [(1, "𝒳𝒴𝒵 𝒳𝒴𝒵", "x"), (2, "abc abc", "a"), (5, "𝒳𝒴𝒵", None), (10, "😀", None)]
    got = {x["doc_id"]: x["lang_pred"] for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 5 == 0).collect()}
    assert got == {1: "x", 2: "a", 5: "x", 10: "und"}


def test_addresses_with_many_zeros():
    long = "0" * 5000
    assert pii.base_spans(f"{long}1.2.3.4 x")[0] == [(1, 0, 5007)]
    assert pii.base_spans(f"{long}.2.3.0255")[0] == [(1, 0, 5009)] and not pii.base_spans(f"1{long}.2.3.4")[0]
