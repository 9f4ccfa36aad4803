"""Labelled pages: web pages drawn from layouts, each with its main text, to train and test extraction on.

A page is put together from a frame, a container of the article, blocks of text inside it and surroundings (menus, headers, footers,
sidebars, notices, adverts, forms, comments) under many tags, classes and depths, in invented words of several scripts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Syllables and sentence ends of invented text.
_SCRIPTS = (
    ("th an in er on re at en es or st nd ti ou ing ea".split(), " ", "."),
    ("le en ré que ion ç è eau pa oi ment".split(), " ", "."),
    ("sch ei un ä ü ge be ver keit ung ö ß".split(), " ", "."),
    ("ción ar ñ ó para os el do qu í".split(), " ", "."),
    ("по ни ра ст ко ть ж во щи".split(), " ", "."),
    ("λο κα στ η ρι ως τε".split(), " ", "."),
    ("漢 字 文 日 本 語 記 事 中 国 大 学".split(), "", "。"),
)
# Containers of an article, from the clearest to none at all.
_ARTICLES = (
    "article", "article", "main", "div.content", "div#content", "div.article-body", "section.post", "div.post-content", "div.entry-content", "div#main-content",
    "div.story", "div.text", "div.body", "div.page-content", "div.mainContent", "div.blog-post", "article.hentry", "div", "section", "td.content", "td", "div.news-item",
    "div.c-article__body", "div[role=main]", "div.readable", "div#article", "div.markdown", "div.wiki-text", "main#primary", "div.single")
# Tags, classes and ids of what surrounds an article.
_NAV = ("nav", "nav", "nav.menu", "div.nav", "div#menu", "ul.menu", "div.navbar", "div.breadcrumbs", "ol.breadcrumb", "div.topnav", "div.main-navigation", "menu", "div.toc-menu", "div.links", "ul#navigation", "div[role=navigation]", "div.pagination", "div.skip-links", "div")
_HEADER = ("header", "header", "div.header", "div#masthead", "div.site-header", "div.top", "div.branding", "div#top-bar", "div.logo", "div[role=banner]", "td.header", "header.page-header")
_FOOTER = ("footer", "footer", "div.footer", "div#footer", "div.site-footer", "div.bottom", "div.copyright", "div.colophon", "div.legal", "div[role=contentinfo]", "td.footer", "div.page-footer")
_SIDE = ("aside", "aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.side", "div.rightcol", "div.right-column", "div.widget-area", "section.related", "div.related-posts", "div.recent", "div.popular", "div.trending", "td.sidebar", "div.side-bar", "div.box", "div[role=complementary]", "div.see-also", "div.recommended")
_NOTICE = ("div.cookie", "div.cookie-notice", "div#cookie-banner", "div.notice", "div.gdpr", "div.consent", "div.alert", "div.banner", "div[role=alert]", "div.notification", "div.warning", "p.notice", "section.notice", "div.privacy-notice", "div.message", "dialog", "div.popup", "div.modal", "div.overlay", "div.announcement", "div.disclaimer", "aside.notice", "div.paywall", "div.subscribe-notice")
_ADVERT = ("div.ad", "div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsor", "div.sponsored", "div.promo", "div.promotion", "div.ad-slot", "div#google-ads", "section.ad", "p.ad", "div.adsbox", "div.banner-ad", "div.ad_unit", "ins.adsbygoogle", "div.commercial")
_FORM = ("form", "form", "form.search", "form#subscribe", "form.newsletter", "div.newsletter", "form.login", "form.contact-form", "div.signup", "form.comment-form", "div.search-form")
_COMMENT = ("div.comments", "div.comments", "section.comments", "section#comments", "div#comments", "ol.comment-list", "ul.comments", "div.comment-thread", "div#disqus_thread", "div.replies", "div.discussion", "div.reader-comments", "aside.comments", "div.responses", "div.user-comments", "div.reviews", "div#respond", "article.comment")
_SHARE = ("div.share", "ul.social", "div.sharing", "div.social-links", "div.share-buttons", "div.tags", "div.post-tags", "div.author-links", "ul.share-list")
_WRAPPERS = ("div", "div.container", "div#page", "div.wrapper", "div.row", "div.col", "section", "div#wrap", "div.layout", "div.inner", "div.l-grid", "form#aspnetForm", "center")


class _Writer:
    """Draws one page."""

    def __init__(self, draw: random.Random):
        self.draw = draw
        self.syllables, self.gap, self.stop = draw.choice(_SCRIPTS[:4] if draw.random() < 0.7 else _SCRIPTS)
        self.main: list[str] = []
        self.sloppy = draw.random() < 0.3  # leaves end tags out
        self.signs = draw.random() < 0.15  # signs after the words
        self.stutter = draw.random() < 0.08  # sentences of one word again and again
        self.terse = draw.random() < 0.07  # many short lines

    def words(self, low: int, high: int) -> str:
        draw = self.draw
        found = ["".join(draw.choices(self.syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        if self.signs:
            found = [word + draw.choice(("", "&&&", "***", "###", "$$$", "%%%")) for word in found]
        return self.gap.join(found).capitalize()

    def sentences(self, low: int, high: int) -> str:
        draw = self.draw
        parts = []
        if self.stutter and draw.random() < 0.5:
            return draw.choice((", ", " ")).join([self.words(1, 2)] * draw.randint(2, 40)) + draw.choice((self.stop, ""))
        for _ in range(draw.randint(low, high)):
            parts.append(self.words(1, 16) + draw.choice(("", ", " + self.words(2, 6).lower())) + (draw.choice("!?") if draw.random() < 0.1 else self.stop))
        return " ".join(parts)

    def open(self, kind: str) -> tuple[str, str]:
        """Start and end tag of ``tag.class``, ``tag#id`` or ``tag[role=value]``."""
        for sign, name in ((".", "class"), ("#", "id")):
            tag, found, value = kind.partition(sign)
            if found and "[" not in tag:
                if self.draw.random() < 0.2:
                    value += self.draw.choice((" clearfix", " mt-2", "-1", " block", "-wrap", " u-pad", " " + self.words(1, 1).lower()))
                return f'<{tag} {name}="{escape(value)}">', f"</{tag}>"
        tag, found, role = kind.partition("[role=")
        return (f'<{tag} role="{role[:-1]}">' if found else f"<{tag}>"), f"</{tag}>"

    def links(self, low: int, high: int, item: str = "li") -> str:
        texts = [self.words(1, 4) for _ in range(self.draw.randint(low, high))]
        body = "".join(f'<{item}><a href="/{i}">{escape(t)}</a>' + ("" if self.sloppy and item == "li" else f"</{item}>") for i, t in enumerate(texts))
        return f"<ul>{body}</ul>" if item == "li" else body

    def surround(self, kinds: tuple[str, ...]) -> str:
        """Something that is not the main text."""
        draw = self.draw
        kind = draw.choice(kinds)
        start, end = self.open(kind)
        if kinds is _NAV:
            body = self.links(2, 9, draw.choice(("li", "li", "span", "div")))
        elif kinds is _HEADER:
            body = draw.choice((f"<h1>{escape(self.words(1, 4))}</h1>", f'<a href="/">{escape(self.words(1, 3))}</a>', f"<h2>{escape(self.words(1, 4))}</h2>", "<div>" + escape(self.words(1, 4)) + "</div>"))
            body += draw.choice(("", f"<p>{escape(self.sentences(1, 2))}</p>", self.surround(_NAV), escape(self.words(2, 8))))
        elif kinds is _FOOTER:
            body = draw.choice(("&copy; ", "© 2024 ", "", "&copy; ")) + escape(draw.choice((self.words(2, 8), self.sentences(1, 3))))
            body = draw.choice((body, f"<p>{body}</p>")) + draw.choice(("", self.links(2, 6), f"<p>{escape(self.sentences(2, 6))}</p>"))
        elif kinds is _COMMENT:
            item = draw.choice(("div.comment", "li", "article.comment", "div", "p", "div.reply"))
            body = draw.choice((f"<h3>{escape(self.words(1, 3))}</h3>", ""))
            for _ in range(draw.randint(1, 6)):
                a, b = self.open(item)
                text = escape(self.sentences(1, 5))
                body += a + draw.choice((f"<b>{escape(self.words(1, 2))}</b> ", f"<span class=author>{escape(self.words(1, 2))}</span>", "")) + (text if item == "p" else draw.choice((text, f"<p>{text}</p>"))) + b
        elif kinds is _FORM:
            body = draw.choice((f"<p>{escape(self.sentences(1, 2))}</p>", f"<h3>{escape(self.words(1, 4))}</h3>", escape(self.words(1, 4)), f"<label>{escape(self.words(1, 2))}</label>"))
            body += f'<input name="q"><button>{escape(self.words(1, 1))}</button>' + draw.choice(("", f"<fieldset><legend>{escape(self.words(1, 3))}</legend>{escape(self.sentences(1, 2))}</fieldset>"))
        elif kinds is _SHARE:
            body = self.links(2, 6, draw.choice(("li", "span")))
        else:
            parts = [lambda: f"<p>{escape(self.sentences(1, 5))}</p>", lambda: escape(self.sentences(1, 3)), lambda: f"<h3>{escape(self.words(1, 5))}</h3>", lambda: self.links(2, 7)]
            body = "".join(draw.choice(parts)() for _ in range(draw.randint(1, 3 if kinds is not _SIDE else 5)))
            if kind.startswith("p"):
                body = escape(self.sentences(1, 3))
        return start + body + end

    def said(self, text: str) -> str:
        """A block of the main text, with some inline markup."""
        self.main.append(" ".join(text.split()))
        words = text.split(" ")
        if len(words) > 3 and self.draw.random() < 0.35:
            k = self.draw.randrange(len(words) - 1)
            a, b = self.draw.choice((("<b>", "</b>"), ("<i>", "</i>"), ('<a href="/x">', "</a>"), ("<em>", "</em>"), ('<span class="x">', "</span>"), ("<b>", "" if self.sloppy else "</b>")))
            return " ".join([*map(escape, words[:k]), a + escape(words[k]) + b, *map(escape, words[k + 1:])])
        return escape(text)

    def block(self) -> str:
        draw = self.draw
        kind = draw.choices(("p", "h", "list", "quote", "pre", "table", "figure", "div", "bare", "dl", "bold"), (60, 8, 7, 4, 2, 4, 2, 6, 2, 1, 4))[0]
        if kind == "p":
            return f"<p>{self.said(self.sentences(1, 9) if draw.random() < 0.9 else self.words(1, 3) + self.stop)}" + ("" if self.sloppy else "</p>")
        if kind == "h":
            level = draw.choice("234")
            return f"<h{level}>{self.said(self.words(1, 9))}</h{level}>"
        if kind == "list":
            tag = draw.choice(("ul", "ol"))
            items = "".join(f"<li>{self.said(draw.choice((self.words(1, 6), self.sentences(1, 3))))}" + ("" if self.sloppy else "</li>") for _ in range(draw.randint(1, 6)))
            return f"<{tag}>{items}</{tag}>"
        if kind == "quote":
            return f"<blockquote>{draw.choice(('<p>', ''))}{self.said(self.sentences(1, 4))}</blockquote>"
        if kind == "pre":
            return f"<pre>{self.said(self.words(4, 20))}</pre>"
        if kind == "table":
            rows = "".join("<tr>" + "".join(f"<td>{self.said(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(draw.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind == "figure":
            return f'<figure><img src="/a.png"><figcaption>{self.said(self.sentences(1, 1))}</figcaption></figure>'
        if kind == "div":
            return f"<div>{self.said(self.sentences(1, 6))}</div>"
        if kind == "dl":
            return f"<dl><dt>{self.said(self.words(1, 3))}<dd>{self.said(self.sentences(1, 2))}</dl>"
        if kind == "bold":
            return f"<p><b>{self.said(self.sentences(1, 3))}<br><p>{self.said(self.sentences(1, 4))}</p>"
        return self.said(self.sentences(1, 3))

    def article(self) -> str:
        draw = self.draw
        start, end = self.open(draw.choice(_ARTICLES))
        if start.startswith("<td"):
            start, end = f"<table><tr>{self.surround(_SIDE[15:16]) if draw.random() < 0.5 else ''}{start}", f"{end}</tr></table>"
        body = ""
        if draw.random() < 0.7:
            level = draw.choice("1112")
            title = f"<h{level}>{self.said(self.words(2, 12))}</h{level}>"
            body += f"<header>{title}</header>" if draw.random() < 0.1 else title
        inner, inner_end = self.open(draw.choice(("div", "div.inner", "section", "div.col-8"))) if draw.random() < 0.2 else ("", "")
        body += inner
        lines = [self.words(1, 3) + draw.choice((self.stop, "")) for _ in range(draw.randint(1, 5))]
        for _ in range(draw.choice((1, 2, 3, 5, 8, 12, 20, 30)) * (4 if self.terse else 1)):
            body += (f"<p>{self.said(draw.choice(lines))}</p>" if self.terse and draw.random() < 0.9 else self.block()) + draw.choice(("", "\n", " "))
            if draw.random() < 0.04:
                body += self.surround(draw.choice((_ADVERT, _ADVERT, _SHARE, _SIDE, _NOTICE, _FORM)))
        return start + body + inner_end + (self.surround(draw.choice((_SHARE, _COMMENT, _FORM, _ADVERT))) if draw.random() < 0.12 else "") + end

    def page(self) -> tuple[str, str]:
        draw = self.draw
        some = lambda kinds, chance: self.surround(kinds) if draw.random() < chance else ""
        before = [some(_NOTICE, 0.35), some(_HEADER, 0.55), some(_NAV, 0.75), some(_ADVERT, 0.45), some(_FORM, 0.2)]
        after = [some(_SIDE, 0.5), some(_COMMENT, 0.45), some(_ADVERT, 0.3), some(_FORM, 0.25), some(_SIDE, 0.2), some(_NOTICE, 0.15), some(_NAV, 0.2)]
        if draw.random() < 0.4:
            draw.shuffle(before)
        if draw.random() < 0.3:
            draw.shuffle(after)
        if draw.random() < 0.2:  # a sidebar ahead of the article
            before.append(self.surround(_SIDE))
        article = self.article() if draw.random() < 0.97 else ""
        wrapped = "".join(before) + article + "".join(after)
        if draw.random() < 0.5:
            a, b = self.open(draw.choice(_WRAPPERS))
            wrapped = "".join(before) + a + article + "".join(after[:2]) + b + "".join(after[2:])
        for _ in range(draw.choice((0, 0, 1, 2, 3))):
            a, b = self.open(draw.choice(_WRAPPERS))
            wrapped = a + wrapped + b
        body = wrapped + some(_FOOTER, 0.8)
        ends = "" if self.sloppy and draw.random() < 0.5 else "</body></html>"
        html = f"<!DOCTYPE html><html><head><title>{escape(self.words(2, 6))}</title><script>var a = '</p>';</script></head><body>{body}{ends}"
        return html, "\n\n".join(self.main)


def draw_page(seed: int) -> tuple[str, str]:
    """(html, main text) of a page; the same for the same seed."""
    return _Writer(random.Random(seed)).page()


def labelled_pages(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    """``html, text`` of the pages number ``first`` to ``first + n - 1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [draw_page(seed) for seed in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in drawn], pa.string()) for k in range(2)], ["html", "text"])

    return spark.range(first, first + n).mapInArrow(run, "html string, text string")
