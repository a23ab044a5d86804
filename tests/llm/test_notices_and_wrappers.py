"""Cases where operators once did less than the whole job."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from bestofk.llm import html, licenses, warc


def scan_templates(text, idf, min_cover=0.6):
    """Labels and best cover by a look at every place of every template."""
    words, labels, best = re.findall(r"[a-z0-9]+", text.lower()), set(), 0.0
    for label, notice, key in licenses.TEMPLATES:
        notice, key = notice.split(), key.split()
        first = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        for k in range(len(words) - len(key) + 1):
            if words[k : k + len(key)] == key:
                weight = [idf[licenses.WORD_ID[w]] for w in notice]
                there = sum(x for p, (w, x) in enumerate(zip(notice, weight)) if 0 <= k - first + p < len(words) and words[k - first + p] == w)
                if (cover := min(1.0, there / max(sum(weight), 1e-9))) >= min_cover:
                    labels, best = labels | {label}, max(best, cover)
    return labels, best


def test_op5_several_notices_and_long_prose(spark):
    rng = random.Random(3)
    notices = [n for _, n, _ in licenses.TEMPLATES]
    prose = lambda n: " ".join(rng.choice([*licenses.VOCABULARY, *(f"x{i}" for i in range(200))]) for _ in range(n))
    texts = [prose(30) for _ in range(40)] + [" text. ".join(notices), f"{notices[2]}. {notices[0]}", f"{notices[0]} {notices[4]}"]
    texts += [f"{prose(3000)} {n} {prose(3000)}" for n in notices] + [f"{n} {prose(400)} {rng.choice(notices)}" for n in notices]
    texts += ["apache license version 2 0", "the mit license " * 50, "cc by nc 4 0", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hits = licenses.find_hits(docs).cache()
    idf = licenses._idf(hits)
    hits.unpersist()
    for r in licenses.scan(docs).collect():
        labels, cover = scan_templates(texts[r.doc_id], idf)
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base, r.doc_id
        assert abs(r.score - max(cover, bool(base))) < 1e-9, r.doc_id


def test_op8_short_articles_and_pages_without_stop_words():
    for box in ('<div class="ad">Buy now</div>', '<aside>Aside</aside>', '<nav><a href=x>Up</a></nav>', '<form><input>Name</form>', '<ul><li><a href=x>Tag</a></ul>'):
        page = f"<nav><a href=a>Home</a></nav><article><h1>Title</h1><p>One line.</p>{box}<p>Two lines.</p></article><footer>Foot</footer>"
        assert html.main_text(page) == "Title\n\nOne line.\n\nTwo lines.", box
    for paragraph in ("Short line.", "Talo seisoi kukkulalla lähellä jokea joka virtasi kohti merta koko pitkän kesän ajan hiljaa. " * 4):
        page = f"<nav><a href=a>Home</a></nav><div>{'<p>' + paragraph.strip() + '</p>'}{'<p>' + paragraph.strip() + '</p>'}</div><ul><li><a href=b>Link</a></ul><footer>Foot</footer>"
        assert html.main_text(page) == "\n\n".join([paragraph.strip()] * 2)
    some = "<div><p>Label</p></div><nav><a href=a>Home</a></nav>" + "<p>Rivi tekstiä vain.</p>" * 9 + "<footer>Foot</footer>"
    assert html.main_text(some) == "\n\n".join(["Rivi tekstiä vain."] * 9)
    assert html.main_text("<nav><a href=a>Home</a></nav><footer>Foot</footer>") == ""


def test_op8_wrappers_with_marks_in_their_names():
    prose = "The house stood on the hill and it was not far from the river that ran to the sea. " * 4
    for wrapper in ('class="has-sidebar"', 'id="page" class="no-comments"', 'class="search-results"', 'class="site with_menu layout-sidebar"'):
        for article in ("<article>", "<main>", '<main class="site-main"><article class="post category-social">'):
            page = f"<div {wrapper}><nav>Menu</nav>{article}<h1>Title</h1><p>{prose}</p><div class=ad>Buy</div></article></main><p>{prose}</p></div>"
            assert html.main_text(page).startswith("Title\n\n" + prose.strip()) and "Menu" not in html.main_text(page) and "Buy" not in html.main_text(page), page
    inner = f'<div class="search-results"><article><p>{prose}</p></article><p>After {prose}</p></div><p>{prose}</p>'
    assert "After" not in html.main_text(inner) and html.main_text(inner).count("The house") == 8
    assert html.main_text(f'<div class="has-sidebar"><p>{prose}</p></div>') == prose.strip()
    for wrapper in ('class="comments"', 'id="comments-area"', 'class="related-posts"', 'class="promo-box"', 'class="sidebar"', "hidden", 'role="navigation"'):
        for outer in ("", '<div class="search-results">'):
            assert html.main_text(f"{outer}<div {wrapper}><article><p>{prose}</p></article></div>") == "", wrapper
    assert html.main_text(f'<article><p>{prose}</p><div class="post-share"><article>Card</article></div></article>') == prose.strip()


def test_op2_one_page_id_with_several_payloads(spark, tmp_path):
    rows = [(1, "u", "a" * 120), (1, "u", "b" * 340), (2, "v", "a" * 120), (3, "w", "b" * 340), (None, "x", "c" * 150), (None, "x", "d" * 160)]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    got = warc.with_full_payload(warc.assemble(warc.read_records(spark, str(tmp_path / "w")))).collect()
    assert sorted((str(r.page_id), r.kind, r.full_bytes, r.refers_page) for r in got) == [
        ("1", "response", 120, None), ("1", "response", 340, None), ("2", "revisit", 120, 1), ("3", "revisit", 340, 1),
        ("None", "response", 150, None), ("None", "response", 160, None)]
    assert len({r.record_id for r in got}) == len(rows)
