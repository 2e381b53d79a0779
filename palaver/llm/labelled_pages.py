"""Labelled pages for the extraction model: layouts put together from hand-marked parts.

``data-main="1"`` marks an element whose text is main text, with everything in it up to a ``data-main="0"``. The mark
is taken off before a page is turned into features. Words are made up, so that only the mark-up can be learned.
"""

from __future__ import annotations

import random

SYLLABLES = ("ka", "lo", "mi", "ter", "san", "ver", "ple", "ron", "dis", "ak", "um", "ost", "fi", "gra", "el", "nu")

# Parts of pages by kind. {w} is a few words, {s} a sentence, {l} a link with a few words.
HEADERS = (
    '<header><a href="/">{w}</a><p>{w}</p></header>', '<div id="header"><h1>{w}</h1><span>{w}</span></div>',
    '<div class="site-header"><div class="logo">{w}</div></div>', '<div class="masthead banner"><p>{s}</p></div>', "")
MENUS = (
    "<nav><ul><li>{l}</li><li>{l}</li><li>{l}</li></ul></nav>", '<ul class="menu"><li>{l}<li>{l}<li>{l}<li>{l}</ul>',
    '<div class="nav navbar">{l} | {l} | {l}</div>', '<div id="navigation"><p>{l} {l}</p></div>',
    '<div class="breadcrumb">{l} &gt; {l} &gt; {w}</div>', '<div role="navigation">{l}{l}{l}</div>')
NOTICES = (
    '<div class="cookie-notice"><p>{s} {l}</p><button>{w}</button></div>', '<div id="gdpr-consent">{s}<a href="#">{w}</a></div>',
    '<div class="alert notice">{s}</div>', '<div class="newsletter-popup modal"><p>{s}</p></div>',
    '<div role="alert"><p>{s}</p></div>', '<div class="subscribe promo">{s}</div>', "")
ADVERTS = (
    '<div class="ad">{s}</div>', '<div class="advert"><p>{s} {s}</p></div>', '<aside class="ads banner-ad">{s}</aside>',
    '<div id="ad-top" class="sponsored"><a href="http://x">{s}</a></div>', '<ins class="adsbygoogle">{w}</ins>', "")
SIDEBARS = (
    '<aside><h3>{w}</h3><ul><li>{l}</li><li>{l}</li></ul></aside>', '<div class="sidebar"><h2>{w}</h2><p>{s}</p>{l}</div>',
    '<div id="right-column" class="widget"><p>{s}</p><ul><li>{l}</ul></div>', '<div class="related-posts"><h4>{w}</h4>{l}{l}</div>',
    '<div role="complementary"><p>{s}</p></div>', "")
FORMS = (
    '<form action="/s"><label>{w}</label><input name="q"><button>{w}</button></form>',
    '<form class="login"><p>{s}</p><input><select><option>{w}<option>{w}</select></form>',
    '<div class="search-box"><form>{w}<textarea>{w}</textarea></form></div>', "")
COMMENTS = (
    '<section class="comments"><h2>{w}</h2><div class="comment"><b>{w}</b><p>{s} {s}</p></div><div class="comment"><p>{s}</p></div></section>',
    '<div id="comments"><ol class="comment-list"><li><p>{s}</p></li><li><p>{s} {s}</p></li></ol></div>',
    '<div class="reader-comments discussion"><p>{s}</p><p>{s}</p></div>', '<div id="disqus_thread" class="replies"><p>{s}</p></div>', "")
FOOTERS = (
    "<footer>&copy; {w} &middot; {s}</footer>", '<div id="footer"><p>{s}</p>{l}{l}</div>',
    '<div class="site-footer legal">&copy; {w}. {s} {l}</div>', '<div role="contentinfo"><p>{w}</p></div>')
SHARES = ('<div class="share social">{l}{l}</div>', '<ul class="tags"><li>{l}</li><li>{l}</li></ul>', "", "")
PARAGRAPHS = (
    "<p>{s} {s} {s}</p>", "<p>{s}</p>", "<p>{s} <b>{w}</b> {s}</p>", "<p>{s} {l} {s} {s}</p>", "<p>{w}</p>", "<h2>{w}</h2>",
    "<p><b>{s}<br><p>{s} {s}</p>", "<ul><li>{s}</li><li>{s}</li></ul>", "<blockquote><p>{s}</p></blockquote>",
    "<pre>{s}</pre>", "<table><tr><td>{w}</td><td>{w}</td></tr></table>", "<p><em>{s}</em> <span>{w}</span></p>",
    "<figure><img src=x><figcaption>{s}</figcaption></figure>", "<div>{s} {s}</div>", "<h3>{w}</h3><p>{s}</p>")
MAINS = (
    '<article data-main="1"><h1>{w}</h1>{body}</article>', '<article data-main="1">{body}</article>',
    '<main data-main="1"><h1>{w}</h1>{body}</main>', '<main data-main="1"><article><header><h1>{w}</h1></header>{body}</article></main>',
    '<div id="content" data-main="1"><h1>{w}</h1>{body}</div>', '<div class="post entry-content" data-main="1">{body}</div>',
    '<div class="article-body story" data-main="1"><div class="text">{body}</div></div>',
    '<section data-main="1"><h2>{w}</h2>{body}</section>', '<div role="main" data-main="1">{body}</div>',
    '<div data-main="1"><h1>{w}</h1>{body}</div>', "{marked}")
WRAPPERS = ("{inside}", '<div id="wrapper">{inside}</div>', '<div class="container"><div class="row">{inside}</div></div>')


def filled(chance: random.Random, part: str) -> str:
    def word():
        return "".join(chance.choice(SYLLABLES) for _ in range(chance.randrange(1, 5)))

    def words(low, high):
        return " ".join(word() for _ in range(chance.randrange(low, high)))

    while "{w}" in part:
        part = part.replace("{w}", words(1, 6).capitalize(), 1)
    while "{s}" in part:
        part = part.replace("{s}", words(2, 30).capitalize() + chance.choice([".", ".", ",", "!", ""]), 1)
    while "{l}" in part:
        part = part.replace("{l}", f'<a href="/{word()}">{words(1, 4)}</a>', 1)
    return part


def off(part: str) -> str:
    """Mark the outer element of a part inside the main text as none of it."""
    return part.replace(">", ' data-main="0">', 1)


def labelled_page(chance: random.Random) -> str:
    body = [chance.choice(PARAGRAPHS) for _ in range(chance.choice([1, 2, 3, 5, 8]))]
    main = chance.choice(MAINS)
    if main == "{marked}":
        # Nothing encloses the paragraphs: each is marked by itself.
        main = "<h1 data-main=\"1\">{w}</h1>" + "".join(
            f"<p data-main=\"1\">{chance.choice(['{s} {s} {s}', '{s} {s}', '{s} {l} {s}'])}</p>" for _ in body)
    for extras in (ADVERTS, SHARES, COMMENTS, FORMS, SIDEBARS, NOTICES, MENUS):
        if chance.random() < 0.25:
            extra = chance.choice(extras)
            if extra:
                body.insert(chance.randrange(len(body) + 1), off(extra))
    main = main.replace("{body}", "".join(body))
    before = [chance.choice(kind) for kind in (HEADERS, MENUS, NOTICES, ADVERTS)]
    after = [chance.choice(kind) for kind in (SHARES, SIDEBARS, FORMS, COMMENTS, ADVERTS, FOOTERS)]
    if chance.random() < 0.3:
        before.append(chance.choice(SIDEBARS))
    inside = chance.choice(WRAPPERS).replace("{inside}", "".join(before) + main + "".join(after))
    return filled(chance, f"<!DOCTYPE html><html><head><title>{{w}}</title></head><body>{inside}</body></html>")


def labelled_pages(count: int, seed: int = 0) -> list[str]:
    chance = random.Random(seed)
    return [labelled_page(chance) for _ in range(count)]
