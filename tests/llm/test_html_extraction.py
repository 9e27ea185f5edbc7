import html
import re
import time

import numpy as np

from docweave.llm import html_extraction as H
from docweave.llm import queries


def page(body, article=True):
    nav = "<nav><ul><li><a href='/a'>Home</a></li><li>About</li></ul></nav>"
    foot = "<footer>&copy; site &middot; all rights</footer>"
    middle = f"<article>{body}</article>" if article else f"<div id='x'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{nav}<!-- c --><div class='ad'>Buy now</div>{middle}{foot}"


def test_blocks_and_zones():
    text = page("<h1>A &amp; B</h1><p><b>One\n  two<br><p>Three <i>fo</i>ur&nbsp;five</p><aside>side</aside><form>f</form><div class='comments'>no</div><p>six<script>x</script>seven</p>")
    assert [t for z, t in H.page_blocks(text) if z == H.ARTICLE] == ["A & B", "One two", "Three four five", "six", "seven"]
    assert H.page_blocks("") == [] and H.page_blocks("a < b <p>c") == [(H.OPEN, "a < b"), (H.OPEN, "c")]
    assert H.page_blocks("<script>never closed") == []


def test_repeated_runs_match_brute_force():
    """Suffix order and buckets against windows written out, over the segments that pages are dealt into."""
    r = np.random.default_rng(1)
    for _ in range(60):
        run = int(r.integers(2, 7))
        pages = [[(H.OPEN, " ".join(r.choice(list("abcde"), int(r.integers(1, 30))))) for _ in range(int(r.integers(1, 4)))] for _ in range(int(r.integers(1, 6)))]
        seen, places = {}, {}
        for k, blocks in enumerate(pages):
            entries = [x for i, (_, t) in enumerate(blocks) for x in [("|", None), *((w, (i, j)) for j, w in enumerate(t.split()))]]
            for i in range(len(entries) - run + 1):
                window = tuple(w for w, _ in entries[i : i + run])
                seen.setdefault(window, set()).add(repr(blocks))
                places.setdefault((k, window), []).extend(at for _, at in entries[i : i + run] if at)
        gone = {(k, at) for (k, w), found in places.items() if len(seen[w]) > 1 for at in found}
        want = ["\n".join(filter(None, (" ".join(w for j, w in enumerate(t.split()) if (k, (i, j)) not in gone) for i, (_, t) in enumerate(blocks)))) for k, blocks in enumerate(pages)]
        assert H.main_texts(pages, run) == want
        # the same in segments of one page
        digests = np.array([H._number(repr(p)) for p in pages], np.uint64)
        parts = [H.beginnings([p], np.zeros(1, np.uint64), digests[k : k + 1], run) for k, p in enumerate(pages)]
        keys, least, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = np.unique(keys[H.meet(keys, least, several)])
        assert [H.unique_runs([p], np.zeros(1, np.uint64), found, run)[0] for p in pages] == want


PROMO = "This very site is the best of all the sites you know"
OWN = ["Unique text number one of this page here today", "Another story with quite other words than before", "The third one is about nothing in particular at all"]


def test_pages_without_an_article_lose_what_others_repeat():
    pages = [H.page_blocks(page(f"<p>{PROMO}</p><p>{x}</p>", article=False)) for x in OWN]
    assert H.main_texts(pages) == OWN
    assert H.main_texts([pages[0], pages[0]]) == [H.main_texts([pages[0]])[0]] * 2  # copies aren't boilerplate
    assert H.main_texts([[], []]) == ["", ""] and H.main_texts([]) == []


def test_the_suffix_array_decides(monkeypatch):
    """With no repeats found these pages come out wrong: mixed blocks are cut, and a teaser article isn't the text."""
    mixed = [H.page_blocks(page(f"<p>{PROMO} {x}</p>", article=False)) for x in OWN]
    teasers = [H.page_blocks(page(f"<article>{x[:9]}</article><p>{PROMO}</p><p>{x}</p>", article=False)) for x in OWN]
    short = [H.page_blocks(page(f"<article>{x}</article><p>{PROMO}</p>", article=False)) for x in OWN]
    want = [OWN, [f"{x[:9].strip()}\n{x}" for x in OWN], OWN]
    assert [H.main_texts(p) for p in (mixed, teasers, short)] == want
    monkeypatch.setattr(H, "meet", lambda keys, *_: np.zeros(len(keys), bool))
    assert all(got != w for got, w in zip([H.main_texts(p) for p in (mixed, teasers, short)], want, strict=True))


def test_hostile_pages_are_parsed_in_linear_time():
    for piece in ("<b><div>", "<p><b>", "<a '", "<a ='", '<a href="x>', "<!--", "<script>", "</div ", "<a =   "):
        source = piece * ((1 << 20) // len(piece))
        began = time.process_time()
        H.page_blocks(source)
        assert time.process_time() - began < 5, piece


def test_quotes_scripts_and_headers():
    assert H.page_blocks("<p title='a > b'>x</p><p title=it's>y</p>") == [(H.OPEN, "x"), (H.OPEN, "y")]
    assert H.page_blocks("a<script>if (a<b && c) { '</p>' }</script>b") == [(H.OPEN, "a"), (H.OPEN, "b")]
    assert H.page_blocks("<article><header>by</header><p>x</p></article>") == [(H.NEVER, "by"), (H.ARTICLE, "x")]
    assert H.page_blocks("a <! b") == [(H.OPEN, "a <! b")]


def test_pages_of_one_host_in_many_segments(spark):
    """Whatever the segments, all pages are one host's and lose the same runs; other hosts' pages don't count."""
    rows = [(k, f"http://{'one' if k % 4 else 'two'}.org/{k}", page(f"<p>{PROMO}</p><p>{OWN[k % 3]} {k} {k * k} end of page</p>", article=False)) for k in range(24)]
    rows += [(90, "http://alone.org/", page(f"<p>{PROMO}</p>", article=False)), (91, "http://one.org/a", page("<p>short</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = [{x.page_id: x.text for x in H.extract(df, segment_bytes=n).collect()} for n in (1, 900, 1 << 20)]
    assert texts[0] == texts[1] == texts[2]
    assert texts[0][90] == PROMO and texts[0][91] == "short"
    hosts = [[k for k, u, _ in rows if u.startswith(f"http://{h}.")] for h in ("one", "two")]
    for ids in hosts:
        want = H.main_texts([H.page_blocks(next(h for k, _, h in rows if k == i)) for i in ids])
        assert [texts[0][i] for i in ids] == want and not any(PROMO in t for t in want)


def brute_article(source):
    """The synthetic pages' article, by plain means."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:p|h1|br|article)>", inner[1])
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_query_on_all_pages(spark):
    rows = {x.page_id: x for x in queries.op7_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        x = rows[p.page_id]
        assert x.text == brute_article(p.html) and x.n_chars == len(x.text) and x.url == p.url


def test_edge_rows_and_large_hosts(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", page("<p>a b</p>")), (3, "http://h/y", page("<p>a b</p>")), (None, "nonsense", "plain"), (5, "HTTP://H:80/z", page("<p>é &lt;x&gt;</p>" * 50))]
    df = spark.createDataFrame([(a, b, c, "t", 1) for a, b, c in rows], "page_id long, url string, html string, text string, host int")
    for size in (1 << 20, 100):
        got = sorted(((x.page_id or 0), x.text) for x in H.extract(df, segment_bytes=size).collect())
        assert got == [(0, "plain"), (1, ""), (2, ""), (3, "a b"), (3, "a b"), (5, "\n".join(["é <x>"] * 50))]
    assert H.extract(df.limit(0)).collect() == []
