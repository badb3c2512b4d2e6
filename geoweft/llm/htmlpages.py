"""Labelled pages on which the extraction model is fitted.

The pages are composed from parts as sites build them; ``data-y`` marks an
element, and what it holds until another mark, as m (holds both), c (content)
or b (anything else). Composition is a function of the page's number alone.
"""

from __future__ import annotations

import random

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part".split()

# The parts; {s} a short text, {w} a few words, {l} a long text, {n} a number.
HEADS = (
    '<header data-y="b" class="site-header"><h1>{w}</h1><p>{s}</p></header>',
    '<div data-y="b" id="header"><a href="/">{w}</a><span>{s}</span></div>',
    '<div data-y="b" class="masthead banner"><p>{s}</p></div>',
    '<header data-y="b"><h1>{w}</h1></header>',
    '<header data-y="b"><div class="logo"><a href="/">{w}</a></div><p>{s}</p></header>',
    '<header data-y="b" role="banner"><a href="/">{w}</a></header>',
    "",
)
MENUS = (
    '<nav data-y="b"><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li><li><a href="/c">{w}</a></li></ul></nav>',
    '<div data-y="b" class="menu navbar"><a href="/a">{w}</a> <a href="/b">{w}</a></div>',
    '<ul data-y="b" id="main-menu" class="nav navigation"><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul>',
    '<div data-y="b" class="breadcrumb breadcrumbs"><a href="/">{w}</a> &gt; <a href="/a">{w}</a></div>',
    '<nav data-y="b" class="toc toolbar"><p>{s}</p><ol><li><a href="#1">{w}</a></li></ol></nav>',
)
SIDES = (
    '<aside data-y="b"><h3>{w}</h3><p>{l}</p><p>{s}</p></aside>',
    '<aside data-y="b" class="sidebar"><h2>{w}</h2><ul><li><a href="/r">{s}</a></li></ul></aside>',
    '<div data-y="b" id="sidebar" class="side widget"><p>{s}</p><p>{l}</p></div>',
    '<section data-y="b" class="related recommended more"><h3>{w}</h3><a href="/r">{s}</a><p>{s}</p></section>',
    '<div data-y="b" class="share social"><a href="/f">{w}</a><a href="/t">{w}</a></div>',
    '<div data-y="b" class="tags pagination pager"><a href="/2">{n}</a> <a href="/3">{n}</a></div>',
    '<div data-y="b" class="author-bio byline meta"><p>{s}</p></div>',
)
ADS = (
    '<div data-y="b" class="ad">{s}</div>',
    '<div data-y="b" class="ads advert advertisement"><p>{s}</p><p>{l}</p></div>',
    '<div data-y="b" id="ad-{n}" class="sponsored"><a href="/x">{s}</a></div>',
    '<section data-y="b" class="promo banner"><h4>{w}</h4><p>{s}</p></section>',
    '<ins data-y="b" class="adsbygoogle">{s}</ins>',
    '<aside data-y="b" class="ad promotion"><p>{l}</p></aside>',
)
NOTICES = (
    '<div data-y="b" class="cookie-notice consent">{s} <button>{w}</button></div>',
    '<div data-y="b" id="cookie-banner" class="cookies gdpr"><p>{l}</p><button>{w}</button></div>',
    '<div data-y="b" class="notice alert warning">{s}</div>',
    '<div data-y="b" role="dialog" class="modal popup overlay"><p>{s}</p></div>',
    '<dialog data-y="b" open><p>{s}</p></dialog>',
    '<div data-y="b" class="paywall disclaimer legal"><p>{l}</p></div>',
    '<div data-y="b" role="alert">{s}</div>',
)
FORMS = (
    '<form data-y="b" action="/s"><label>{w}</label><input type="text"><button>{w}</button></form>',
    '<form data-y="b" class="newsletter subscribe signup"><p>{s}</p><p>{l}</p><input><button type="submit">{w}</button></form>',
    '<div data-y="b" class="search login"><form><select><option>{w}</option></select><textarea>{s}</textarea></form></div>',
    '<fieldset data-y="b"><legend>{w}</legend><label>{s}</label></fieldset>',
)
COMMENTS = (
    '<section data-y="b" id="comments" class="comments"><h2>{w}</h2><article class="comment"><p>{l}</p></article><article class="comment"><p>{s}</p></article></section>',
    '<div data-y="b" class="comments"><div class="comment"><p>{l}</p><p>{s}</p></div><div class="comment reply"><p>{s}</p></div></div>',
    '<ol data-y="b" class="comment-list discussion responses"><li><p>{l}</p></li><li><p>{s}</p></li></ol>',
    '<div data-y="b" id="disqus_thread" class="reader-comments"><p>{s}</p><blockquote>{s}</blockquote></div>',
    '<ul data-y="b" class="replies reviews"><li class="comment">{l}</li></ul>',
)
FOOTS = (
    '<footer data-y="b">&copy; {w} &middot; {s}</footer>',
    '<footer data-y="b" class="footer"><p>{l}</p><ul><li><a href="/p">{w}</a></li></ul></footer>',
    '<div data-y="b" id="footer" class="copyright"><p>{s}</p></div>',
    '<div data-y="b" class="site-footer bottom"><a href="/p">{w}</a> {s}</div>',
)
TEXTS = (
    "<p>{l}</p>", "<p>{l}</p>", "<p>{s}</p>", "<p>{w}</p>", "<p><b>{l}<br></p>", "<h2>{w}</h2>", "<h3>{s}</h3>", "<ul><li>{s}</li><li>{l}</li></ul>",
    "<ol><li>{s}</li><li>{w}</li></ol>", "<blockquote><p>{l}</p></blockquote>", "<pre>{l}</pre>", "<table><tr><td>{w}</td><td>{n}</td></tr></table>",
    '<p>{l} <a href="/in">{w}</a> {s}</p>', '<p>{s} <a href="/in">{w}</a> {s}</p>', '<p><a href="/in">{s}</a> {w}.</p>', '<ul><li>{s} <a href="/in">{w}</a></li></ul>',
    '<p>{w} <a href="/in">{w}</a> {w}</p>', "<div>{l}</div>", "<div><p>{s}</p></div>", "<figure><figcaption>{s}</figcaption></figure>", "<p>{s} <em>{w}</em> <i>{w}</i></p>",
    "<section><h2>{w}</h2><p>{l}</p></section>", "<dl><dt>{w}</dt><dd>{s}</dd></dl>", "<p><span>{l}</span></p>", "<p>{w}.</p>", "<p>{n}</p>",
)
BODIES = (
    '<article data-y="c"><h1>{w}</h1>{T}</article>',
    '<article data-y="c">{T}</article>',
    '<article data-y="c" class="post hentry"><header><h1>{s}</h1></header>{T}</article>',
    '<main data-y="m"><article data-y="c"><h1>{s}</h1>{T}</article>{X}</main>',
    '<main data-y="c"><h1>{s}</h1>{T}</main>',
    '<div data-y="m" class="container wrapper"><div data-y="c" class="content"><h1>{w}</h1>{T}</div>{X}</div>',
    '<div data-y="m" id="page"><div data-y="c" id="content" class="entry-content post-content">{T}</div>{X}</div>',
    '<div data-y="m" class="row"><div data-y="c" class="article-body story text"><h1>{w}</h1>{T}</div></div>',
    '<section data-y="c" class="article main body"><h1>{w}</h1>{T}</section>',
    '<div data-y="c"><h1>{w}</h1>{T}</div>',
)


def labelled_pages(n: int = 600) -> list[str]:
    out = []
    for k in range(n):
        rng = random.Random(k)
        text = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))

        def fill(part: str) -> str:
            for mark, make in (("{w}", lambda: text(1, 3)), ("{s}", lambda: text(4, 12) + "."), ("{l}", lambda: text(15, 90) + "."), ("{n}", lambda: str(rng.randint(1, 99)))):
                while mark in part:
                    part = part.replace(mark, make(), 1)
            return part

        some = lambda parts, p=0.5: rng.choice(parts) if rng.random() < p else ""
        inner = "".join(rng.choice(TEXTS) + some(ADS + NOTICES + SIDES[4:6], 0.06) for _ in range(rng.randint(1, 14))) + some(FORMS + COMMENTS, 0.12)
        body = rng.choice(BODIES).replace("{T}", inner).replace("{X}", some(SIDES) + some(COMMENTS))
        if rng.random() < 0.2:  # a page without a wrapper: each part stands in the body
            inner = "".join(rng.choice(TEXTS).replace(">", ' data-y="c">', 1) for _ in range(rng.randint(1, 14)))
            body = rng.choice(("", '<h1 data-y="c">{w}</h1>', '<div data-y="m">@</div>', "<main data-y=\"m\">@</main>"))
            body = body.replace("@", inner) if "@" in body else body + inner
        page = some(NOTICES, 0.3) + some(HEADS) + some(MENUS, 0.8) + some(ADS) + body + some(COMMENTS) + some(SIDES) + some(FORMS, 0.3) + some(ADS, 0.2) + some(NOTICES, 0.2) + some(FOOTS, 0.9)
        whole = rng.random() < 0.8
        out.append('<html data-y="m"><head><title>x</title></head><body>' * whole + fill(page) + "</body></html>" * whole)
    return out
