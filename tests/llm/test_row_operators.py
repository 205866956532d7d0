"""Operators that judge each row by itself: quality rules, token counts, URL filter, HTML extraction."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from ferrule.llm import html_extraction, quality_rules, token_counts, url_filter, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "one two", "x " * 300, "\x00\x01 ​", "a\x85b a\x1cb", "é é ÀB", "word " * 5 + "\n" + "word " * 5 + "\n\n \n", "q" * 20_000 + " z", "a b c d e f a b c d e"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(k, t, 0, "c") for k, t in enumerate(texts)], "doc_id long, text string, key int, n_words string")


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.randint(1, 400)) for _ in range(20)] + ["one two three four five six seven eight nine ten! " * 3, "#a| <b> $$ & % * c"]
    got = {r.doc_id: r for r in quality_rules.quality(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [tuple(found[j : j + 5]) for j in range(len(found) - 4)]
        twice = {x for x, n in Counter(runs).items() if n > 1}
        covered = {j + d for j, x in enumerate(runs) if x in twice for d in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
        if not r.base_failed:
            data = text.encode()
            ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
            low, high = next((lo, hi) for most, lo, hi in quality_rules.BANDS if len(data) < most)
            chunks = [data[j : j + 2048] for j in range(0, len(data) - 2048, 2048)] + [data[-2048:]] if len(data) > 2048 else []
            assert r.kept == (low <= ratio(data) <= high and all(1.5 <= ratio(c) <= 2.3 for c in chunks))


def test_last_bytes_are_judged(spark):
    """A bad stretch at the end, of under half a chunk, sends a text away that is good without it."""
    rng = random.Random(8)
    vowels = "the of and to in is that it was for on are as with his they at be this from".split()
    words_ = vowels + ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    compressed = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    whole = " ".join(rng.choice(words_) for _ in range(3000)).encode()[: 3 * 2048].decode()
    bad = "".join(chr(rng.randint(33, 126)) for _ in range(900))
    texts = [whole, whole + " " + bad]
    chunks = [texts[1].encode()[k : k + 2048] for k in range(0, len(texts[1]), 2048)]
    last = texts[1].encode()[-2048:]
    assert len(chunks[-1]) < 1024 and compressed(last) < 1.5 <= min(map(compressed, chunks[:-1]))
    low, high = next((lo, hi) for most, lo, hi in quality_rules.BANDS if len(texts[1]) < most)
    assert low <= compressed(texts[1].encode()) <= high
    assert [r.kept for r in quality_rules.quality(table(spark, texts)).orderBy("doc_id").collect()] == [True, False]


def test_random_and_repetitive_texts_go(spark):
    rng = random.Random(4)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(30)) for _ in range(100))
    again = " ".join(f"{k % 7} the same words in one more sentence, {k}." for k in range(200))
    df = table(spark, [noise, again])
    assert [r.kept for r in quality_rules.quality(df).orderBy("doc_id").collect()] == [False, False]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 0


@pytest.mark.parametrize("n", [6, 40, 3000])
def test_repeated_words_with_many_kinds(n):
    rng = random.Random(n)
    found = [str(rng.randrange(n)).encode() for _ in range(n)] * 2
    runs = [tuple(found[j : j + 5]) for j in range(len(found) - 4)]
    twice = {x for x, c in Counter(runs).items() if c > 1}
    assert quality_rules.repeated_words(found) == len({j + d for j, x in enumerate(runs) if x in twice for d in range(5)})


def test_token_counts(spark):
    rng = random.Random(5)
    texts = ODD + [prose(rng, 50) for _ in range(20)] + ["<|endoftext|>x <|startoftext|>y<|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ İstanbul don'S 12³ 日本語 🙂👍🏽", "a" * 5000]
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, texts), PATH, 40).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 40)


def test_token_cache_turns_over(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter, library = token_counts.Counter(PATH), Tokenizer.from_file(PATH)
    for k in list(range(60)) + list(range(60)):
        assert counter[f"word{k}ing".encode()] == len(library.encode(f"word{k}ing", add_special_tokens=False).ids)
    assert len(counter) <= 10


def test_url_filter(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("x.org/", "allow"), ("x.org/", "block")]
    urls = [None, "", "http://a.NET/x", "https://Example.net/en/1?q#f", "http://m.example.net/english", "http://example.com/de/", "http://notexample.com/de/", "http://b.org/fr/x", "x.org/", "ftp://x.org", "http://x.org/?a", "http://net/", "http://é.net/ü", "http://a.net#x/y", "http://a.net?x/y"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    for k, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        part = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), part[1]), part[2]
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=None)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best and best[1], best[2] if best else "allow")


def test_url_collisions_are_confirmed(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda _: 7)
    (tmp_path / "index").write_bytes(url_filter.packed([("a.b/", "block"), ("c.d/", "allow"), ("e/f", "block")]))
    index = url_filter.Index(str(tmp_path / "index"))
    assert index.judged([("x.c.d", "/p"), ("b", "/"), ("e", "/f")]) == [("c.d/", False), (None, None), ("e/f", True)]
    (tmp_path / "empty").write_bytes(url_filter.packed([]))
    assert url_filter.Index(str(tmp_path / "empty")).judged([("a", "/")]) == [(None, None)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad-box">Buy</div>
<div id="page"><div class="post-12 entry-content no-sidebar"><h1>Title &amp; more</h1><p>First  <b>bold</b>
paragraph, &eacute;t&#233;.<p>Second<br>one with <a href="#">a link</a> in it.</div><div class="comments"><p>I say a long comment, much longer than all the rest of the page,
so that its length would win if it counted at all, which it does not.</p></div></div>
<aside>Side</aside><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_extraction_by_hand():
    assert html_extraction.main_text(PAGE) == "Title & more\n\nFirst bold paragraph, été.\n\nSecond one with a link in it."
    for page in (None, "", "<p", "</div></p>", "<nav>only a menu</nav>", "<script>", "<!--"):
        assert html_extraction.main_text(page) == ""
    assert html_extraction.main_text("<p>a &am") == "a &am"
    assert html_extraction.main_text("<div><p>x</p>" + "<div>" * 3000 + "y") == "x\n\ny"


def test_doubtful_names_are_judged_by_their_links():
    page = "<body><div class=q><article><p>First.</p><div class=related-work><p>Earlier work, with <a href=#>one link</a> in it.</p></div><div class=related><ul><li><a href=/a>Read this</a><li><a href=/b>And this</a></ul></div></article></div></body>"
    assert html_extraction.main_text(page) == "First.\n\nEarlier work, with one link in it."
    assert html_extraction.main_text('<body><div class="widget-content"><p>All there is.</p></div></body>') == "All there is."
    assert html_extraction.main_text('<body><p>Text.</p><div class="share-this comments"><p>A comment.</p></div></body>') == "Text."
    inside = '<body><div class=widget><p>One text that is kept, with <span class="share"><a href=/s>send</a></span> left out.</p></div></body>'
    assert html_extraction.main_text(inside) == "One text that is kept, with left out."
    assert html_extraction.main_text("<p><span class=share><a href=/s>send</a></span> all of <b class=social>this <a>x</a></b></p>") == "all of this x"
    assert html_extraction.main_text("<span class=share><p>A paragraph.</p> and more") == "A paragraph.\n\nand more"
    assert html_extraction.main_text("<div class=social>" * 3000 + "x") == "x"


def test_hosts_beyond_ascii_keep_their_path(spark):
    usual = "<body><div class=story><p>{}</p></div><div class=more><p>{}</p></div></body>"
    pages = [(k, "http://\u0130\u03a3.x/1", usual.format("Main text. " * 30, "Other.")) for k in range(4)] + [(9, "http://\u0130\u03a3.x/2", usual.format("Short but main.", "Much longer other text, on this one page. " * 9))]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short but main."


def test_host_consensus_wins(spark):
    usual = "<body><div class=story><p>{}</p></div><div class=more><p>{}</p></div></body>"
    pages = [(k, "http://h.x/1", usual.format("Main text. " * 30, "Other.")) for k in range(4)]
    odd = (9, "http://H.x/2", usual.format("Short but main.", "Much longer other text, on this one page. " * 9))
    alone = (10, None, "<body><div class=q><p>Alone.</p></div></body>")
    df = spark.createDataFrame([(*p, "x") for p in [*pages, odd, alone, (11, "http://h.x/3", None)]], "page_id long, url string, html string, path string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(df).collect()}
    assert got[9] == ("Short but main.", 15) and got[10] == ("Alone.", 6) and got[11] == ("", 0)
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["one", "Two", "é" * 3, "x" * 5000, "y" * 300]) for _ in range(400)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends = words.spans(data)
    assert [text[s:e] for s, e in zip(starts, ends, strict=True)] == text.split()
    whole = words.hashes(data, starts, ends)
    monkeypatch.setattr(words, "BLOCK", 64)
    assert (words.hashes(data, starts, ends) == whole).all()
    of = {}
    for w, h in zip(text.lower().split(), whole, strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
