"""Labelled training pages for the extraction model, made from a seed: page layouts with every region marked.

``data-y="1"`` stands on regions of the article, ``data-y="0"`` on everything else; a region inside another may change the
mark back. Words are drawn at random, so that nothing can be learned from them but their number and punctuation.
"""

from __future__ import annotations

import random

LETTERS = "aeiourstlnmdcbp"
# Names that page authors give to regions (fixed values)
ARTICLE_NAMES = ["content", "post", "post-content", "entry-content", "article", "article-body", "story", "main-content",
                 "main", "text", "body-text", "page-content", "post-body", "entry", "blog-post", "news-article", "copy"]
NAV_NAMES = ["nav", "navbar", "menu", "main-menu", "navigation", "top-nav", "links", "breadcrumb", "breadcrumbs", "pagination",
             "pager", "toc", "tabs", "tags", "categories"]
HEADER_NAMES = ["header", "site-header", "masthead", "top-bar", "banner", "branding", "logo", "page-header", "topbar"]
FOOTER_NAMES = ["footer", "site-footer", "page-footer", "copyright", "legal", "bottom", "colophon", "credits"]
SIDE_NAMES = ["sidebar", "side", "widget", "widgets", "related", "related-posts", "recommended", "popular", "trending",
              "more-stories", "rail", "right-column", "teaser", "promo-box", "about-author"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense", "ad-slot",
            "ad-banner", "commercial", "partner"]
NOTICE_NAMES = ["notice", "cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "overlay",
                "warning", "disclaimer", "announcement", "message", "toast", "paywall"]
FORM_NAMES = ["form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact", "register", "survey"]
COMMENT_NAMES = ["comments", "comment", "comment-list", "discussion", "responses", "replies", "reply", "disqus", "thread",
                 "user-comments", "reviews", "feedback", "guestbook"]
SHARE_NAMES = ["share", "social", "social-links", "share-buttons", "follow", "toolbar", "actions", "meta", "byline"]


class PageMaker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(LETTERS) for _ in range(self.rng.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        return self.words(1, 18).capitalize() + self.rng.choice("....!?")

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def named(self, names: list[str], chance: float = 0.85) -> str:
        """A class or id attribute, or none."""
        if self.rng.random() > chance:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'

    def links(self) -> str:
        n = self.rng.randint(2, 9)
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def region(self, tags: list[str], names: list[str], inner: str, mark: int = 0) -> str:
        tag = self.rng.choice(tags)
        chance = 1.0 if tag in ("div", "section", "ul", "ol", "p") else 0.5  # other tags speak for themselves
        return f'<{tag}{self.named(names, chance)} data-y="{mark}">{inner}</{tag}>'

    def nav(self) -> str:
        return self.region(["nav", "nav", "div", "div"], NAV_NAMES, self.links())

    def header(self) -> str:
        inner = self.rng.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.link()}</div>", f"<p>{self.words(2, 8)}</p>",
                                 f"<h2>{self.words(1, 3)}</h2><p>{self.sentence()}</p>", ""])
        return self.region(["header", "header", "div"], HEADER_NAMES, inner + (self.links() if self.rng.random() < 0.6 else ""))

    def footer(self) -> str:
        inner = self.rng.choice(["&copy; ", "", "&copy; 2020 "]) + self.words(1, 6) + self.rng.choice(["", " &middot; " + self.sentence()])
        inner = self.rng.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p>{self.links()}", self.links()])
        return self.region(["footer", "footer", "div"], FOOTER_NAMES, inner)

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.rng.randint(1, 3)):
            parts.append(self.rng.choice([f"<h3>{self.words(1, 3)}</h3>", ""]) + self.rng.choice(
                [self.links(), f"<p>{self.sentences(1, 3)}</p>", f"<div>{self.sentence()} {self.link()}</div>", self.sentence()]))
        return self.region(["aside", "aside", "div"], SIDE_NAMES, "".join(parts))

    def ad(self) -> str:
        inner = self.rng.choice([self.sentence(), self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.link(2, 5),
                                 f'<a href="/x"><img src="x.png" alt="">{self.words(2, 5)}</a>'])
        return self.region(["div", "div", "section", "aside", "p"], AD_NAMES, inner)

    def notice(self) -> str:
        inner = self.rng.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>"])
        return self.region(["div", "div", "section", "p", "dialog"], NOTICE_NAMES,
                           inner + self.rng.choice(["", "<button>OK</button>", self.link()]))

    def form(self) -> str:
        inner = self.rng.choice(["", f"<p>{self.sentences(1, 2)}</p>", f"<h3>{self.words(1, 4)}</h3>"]) + "".join(
            f"<label>{self.words(1, 3)}</label><input>" for _ in range(self.rng.randint(1, 3))) + "<button>Go</button>"
        form = f'<form{self.named(FORM_NAMES, 0.6)} data-y="0">{inner}</form>'
        return self.region(["div", "section"], FORM_NAMES, form) if self.rng.random() < 0.4 else form

    def comments(self) -> str:
        each = []
        for _ in range(self.rng.randint(1, 5)):
            who = self.rng.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<cite>{self.word()}</cite>", f"<h4>{self.words(1, 2)}</h4>",
                                   f"<header>{self.words(1, 3)}</header>", f"<div>{self.words(1, 4)}</div>",
                                   f"<footer>{self.words(1, 3)}</footer>"])
            text = self.rng.choice([f"<p>{self.sentences(1, 4)}</p>", self.sentences(1, 3)])
            tag = self.rng.choice(["div", "li", "article", "p"])
            if tag == "p":
                who, text = "", self.sentences(1, 3)
            each.append(f"<{tag}{self.named(['comment', 'reply', 'comment-body', 'response'], 0.7)}>{who}{text}</{tag}>")
        title = self.rng.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 2)}</h3>"])
        return self.region(["section", "div", "div", "ol"], COMMENT_NAMES, title + "".join(each))

    def share(self) -> str:
        return self.region(["div", "ul", "p"], SHARE_NAMES, self.rng.choice([self.links(), self.words(2, 6), self.link()]))

    def article_blocks(self) -> str:
        out = [f"<h1>{self.words(1, 12)}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.62:
                text = self.sentences(1, 6)
                if self.rng.random() < 0.2:
                    text = text.replace(" ", f" {self.link()} ", 1)
                out.append(self.rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(text))
            elif kind < 0.72:
                out.append(f"<h{self.rng.randint(2, 4)}>{self.words(1, 8)}</h2>")
            elif kind < 0.80:
                tag = self.rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.rng.choice([self.sentence(), self.words(1, 6)])}</li>"
                                                for _ in range(self.rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.85:
                out.append(f"<blockquote>{self.rng.choice([self.sentences(1, 2), f'<p>{self.sentences(1, 3)}</p>'])}</blockquote>")
            elif kind < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>"
                                               for _ in range(self.rng.randint(1, 4))) + "</table>")
            elif kind < 0.92:
                out.append(f"<figure><img><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif kind < 0.97:
                out.append(f"<section><h2>{self.words(1, 5)}</h2><p>{self.sentences(1, 5)}</p></section>")
            else:
                out.append(self.rng.choice([self.ad, self.share, self.form, self.sidebar, self.nav])())
        return "".join(out)

    def article(self) -> str:
        inner = self.article_blocks()
        if self.rng.random() < 0.25:
            inner += self.rng.choice([self.comments, self.share, self.sidebar, self.notice])()
        if self.rng.random() < 0.1:
            inner = f"<header><h1>{self.words(1, 9)}</h1></header>" + inner
        tag = self.rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = self.named(ARTICLE_NAMES, 0.2 if tag in ("article", "main") else 0.9)
        page = f'<{tag}{name} data-y="1">{inner}</{tag}>'
        for _ in range(self.rng.choice([0, 0, 1, 1, 2])):
            page = f"<{self.rng.choice(['div', 'main', 'section', 'div'])}{self.named(['wrapper', 'container', 'page', 'layout', 'row', 'column', *ARTICLE_NAMES[:3]], 0.6)}>{page}</div>"
        return page

    def page(self) -> str:
        before = [f() for f in (self.header, self.nav, self.ad, self.notice, self.form, self.sidebar) if self.rng.random() < 0.45]
        after = [f() for f in (self.comments, self.sidebar, self.ad, self.share, self.form, self.notice, self.nav)
                 if self.rng.random() < 0.4]
        self.rng.shuffle(after)
        bare = self.rng.random() < 0.08  # the article's blocks stand in the body itself
        article = self.article_blocks() if bare else self.article()
        body = "".join(before) + article + "".join(after) + (self.footer() if self.rng.random() < 0.85 else "")
        if bare:
            return f'<html><head><title>{self.words(2, 6)}</title></head><body data-y="1">{body}</body></html>'
        if self.rng.random() < 0.3:
            body = f"<div{self.named(['wrapper', 'container', 'page', 'site'], 0.8)}>{body}</div>"
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def training_pages(n: int = 1200, seed: int = 3) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
