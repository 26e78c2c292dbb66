"""Labelled pages for the extraction field: layouts of their own making, filled with invented words.

A layout is a list of lines of HTML; lines that begin with `+` hold one main block, lines that begin with `-` one
boilerplate block, lines that begin with `.` hold no text. `#` stands for a few words, `*` for a sentence, `&` for a
paragraph of several sentences.
"""

from __future__ import annotations

import random

from lutrin.llm.extraction import blocks

SYLLABLES = "ba ko ri ten ula mor sie vat dun ha lo pra chi nes tum ger wi zo fel an".split()
NAVIGATION = [".<nav><ul>", '-<li><a href="/a">#</a></li>', '-<li><a href="/b">#</a></li>', '-<li><a href="/c">#</a></li>', ".</ul></nav>"]
LAYOUTS = [
    [*NAVIGATION, '-<div class="ad">*</div>', ".<article>", "+<h1>#</h1>", "+<p>&</p>", "+<p>*</p>", "+<p>#.</p>", "+<p>&</p>", ".</article>",
     "-<footer>&copy; # &middot; *</footer>"],
    ['.<header class="site-header">', "-<div>#</div>", '-<a href="/">#</a>', ".</header><main><article>", "+<h1>#</h1>", "+<p>*</p>", "+<h2>#</h2>", "+<p>&</p>",
     '.<div class="comments">', "-<h3>#</h3>", "-<p>&</p>", "-<p>*</p>", ".</div></article></main>", '.<aside class="sidebar">', '-<h3>#</h3>', '-<p>*</p>',
     '-<a href="/x">#</a>', ".</aside>", "-<footer>*</footer>"],
    ['-<div class="cookie-notice">& <button>#</button></div>', '.<div id="menu">', '-<a href="/a">#</a>', '.</div><div id="content">', "+<h1>#</h1>", "+<p>&</p>",
     "+<ul><li>*</li>", "+<li>#</li>", "+<li>*</li></ul>", "+<p>&</p>", '.</div><div class="related">', '-<a href="/q">*</a>', ".</div>",
     '-<div id="footer">© # *</div>'],
    [".<header>", "-<p>#</p>", ".</header><nav>", '-<a href="/a"># #</a>', ".</nav><article>", "+<p>&</p>", "+<blockquote>*</blockquote>", '-<div class="advert">&</div>', "+<p>&</p>",
     "+<pre>#</pre>", '.<form action="/s">', "-<label>#</label>", "-<p>*</p>", '.</form><section class="comments" id="comments">', "-<p>&</p>", "-<p>#</p>", "-<p>&</p>",
     ".</section></article>", "-<footer>&copy; #. All rights reserved.</footer>"],
    ['.<div class="banner">', "-<p>*</p>", '.</div><div class="post-body">', "+<h2>#</h2>", "+<p>&</p>", "+<p>*</p>", "+<table><tr><td>#</td>", "+<td>*</td></tr></table>", "+<p>&</p>",
     '.</div><div class="share">', '-<a href="/s">#</a>', '.</div><div class="newsletter">', "-<p>*</p>", '.</div><div class="comment-list">', "-<div>&</div>", "-<div>*</div>", ".</div>",
     '-<div class="footer">*</div>'],
    [*NAVIGATION, ".<article>", "+<h1>#</h1>", "+<p>#</p>", "+<p>#.</p>", "+<p>#</p>", ".</article>", '.<aside>', "-<p>&</p>", '-<ul><li><a href="/z">*</a></li></ul>', ".</aside>",
     "-<footer>© # · *</footer>"],
    ['.<article>', '.<header>', "+<h1>#</h1>", ".</header>", "+<p>&</p>", "+<figure><figcaption>*</figcaption></figure>", "+<p>&</p>", '-<aside class="promo">*</aside>', "+<p>*</p>", ".</article>"],
    [".<article>", "+<h1>#</h1>", "+<p>&</p>", "+<p>&</p>", "+<p>&", ""],
    ['-<div role="alert" class="notice">*</div>', *NAVIGATION, ".<main>", "+<p>&</p>", "+<p>#</p>", "+<div>*</div>", ".</main>", '.<div class="sidebar widget">', "-<h4>#</h4>", "-<p>&</p>", ".</div>",
     '.<footer><nav>', '-<a href="/i">#</a>', ".</nav>", "-<p>&copy; #</p>", ".</footer>"],
    ['.<form id="login">', "-<label>#</label>", "-<p>#</p>", ".</form>", '.<section class="article-text">', "+<h1>#</h1>", "+<p>&</p>", "+<ol><li>*</li>", "+<li>&</li></ol>", ".</section>",
     '.<section id="reader-comments">', "-<h2>#</h2>", "-<p>&</p>", "-<p>&</p>", "-<p>*</p>", ".</section>", "-<footer>#</footer>"],
]


def _filled(line: str, rng: random.Random) -> str:
    def words(n: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(4, 24)).capitalize() + "."

    out = line.replace("&copy;", "©").replace("&middot;", "·")
    out = out.replace("&", " ".join(["*"] * rng.randint(2, 8)))
    while "*" in out:
        out = out.replace("*", sentence(), 1)
    while "#" in out:
        out = out.replace("#", words(rng.randint(1, 4)).capitalize(), 1)
    return out


def pages(copies: int = 6, seed: int = 11) -> list[tuple[str, list[int]]]:
    """HTML and the label of every leaf block (1: main), `copies` pages of every layout."""
    rng, out = random.Random(seed), []
    for layout in LAYOUTS:
        for _ in range(copies):
            html, labels = "<!DOCTYPE html><html><head><title>x</title></head><body>", []
            for line in layout:
                if not line:
                    continue
                if line[0] != "." and rng.random() < 0.1:
                    if "</li></ul>" not in line and "<ul>" not in line and "table" not in line and "<ol>" not in line:
                        continue
                before = len(blocks(html))
                html += _filled(line[1:], rng)
                labels += [int(line[0] == "+")] * (len(blocks(html)) - before)
            out.append((html, labels))
    return [(h, y) for h, y in out if len(y) == len(blocks(h)) and y]
