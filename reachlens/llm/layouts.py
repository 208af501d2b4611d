"""Labelled pages to learn from: layouts of many kinds, filled with given texts. ``data-label`` on an element labels all text below it.

A layout has menus, headers, notices, adverts, sidebars, forms, share bars, related links, reader comments and footers around and inside an
article, in elements with telling names, with telling classes, or (then without prose that only a name could tell apart) with neither.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

# Elements whose names tell their part, and those of them that are never part of an article.
TELLING = frozenset("article aside dialog footer form header main menu nav section".split())
ASIDE = frozenset("aside button dialog footer form label menu nav select".split())

# Names that pages give to their parts (element names first, then words of classes and ids).
PARTS = {
    "header": ("header", "header masthead topbar top branding banner site-header page-header logo hero-bar"),
    "nav": ("nav", "nav menu navbar navigation main-menu links topnav breadcrumb breadcrumbs subnav drawer"),
    "notice": ("div section dialog", "notice cookie cookies consent gdpr alert banner popup modal overlay message announcement privacy paywall warning cookie-bar disclaimer"),
    "ad": ("div aside section", "ad ads advert advertisement adslot sponsor sponsored promo promotion banner-ad dfp adsense native-ad marketing"),
    "sidebar": ("aside", "sidebar side aside rail widget widgets secondary right-column left-column col-right complementary toc"),
    "share": ("div ul", "share social sharing share-buttons follow tools toolbar actions"),
    "related": ("div section aside", "related recommended more-stories read-more popular trending latest also-like teaser recirculation"),
    "comments": ("section div", "comments comment-list discussion responses disqus replies feedback reader-comments thread respond"),
    "comment": ("article li div", "comment reply response comment-body post-comment"),
    "form": ("form", "form newsletter subscribe signup login search search-form contact register mailing subscription"),
    "footer": ("footer", "footer foot bottom site-footer copyright colophon legal imprint credits"),
    "tags": ("div ul", "tags tag-list categories meta-tags pager pagination prev-next"),
    "main": ("main", "main content container page wrapper primary column layout site-content"),
    "article": ("article", "article post entry story article-body post-content entry-content content-body text body prose single main-content articleBody hentry"),
}
WORDS = {
    "nav": "Home,About,News,Contact,Sport,Products,Blog,Archive,Help,Shop,Login,Menu,Skip to content,Services",
    "notice": "We use cookies to improve your experience.,Please accept our terms to continue.,This site uses cookies. By using it you agree.,Subscribe to read on.,Service will be interrupted tonight.",
    "ad": "Advertisement,Sponsored content,Buy now and save,Special offer,Limited time only,Ad",
    "share": "Share,Tweet,Facebook,Email,Print,Copy link,Like,Follow us,Pin it",
    "related": "Related articles,You may also like,Read more,More stories,Most popular,Recommended for you,Trending",
    "comments": "Comments,Leave a reply,Reply,3 comments,Report,Anonymous says:,Log in to comment,Join the discussion",
    "form": "Email address,Subscribe,Sign up,Search,Send,Your name,Password,Submit,Newsletter",
    "footer": "All rights reserved.,Privacy policy,Terms of use,Copyright 2024,Contact us,Imprint,Sitemap",
    "sidebar": "About the author,Categories,Archives,Latest posts,Tags,Newsletter,On this page",
    "header": "Daily news,The site,Your source of stories,Welcome",
    "tags": "Tags:,Previous,Next,Page 2,Filed under,Older posts",
}

#: The words of these texts: the only ones that are features, as those of a table's own texts tell only what was said.
VOCABULARY = frozenset(w.strip(".,:;!?|()").lower() for text in WORDS.values() for w in text.replace(",", " ").split())


class Page:
    """One made-up page."""

    def __init__(self, rng: random.Random, good: list[str], rest: list[str]) -> None:
        self.rng, self.good, self.rest = rng, good, rest
        self.telling, self.classes = rng.random() < 0.6, rng.random() < 0.8
        self.prose_aside = self.telling and rng.random() < 0.8 or self.classes  # prose outside the article needs a name to tell it

    def one(self, of: str, sep: str = " ") -> str:
        return self.rng.choice(of.split(sep))

    def made_up(self, n: int) -> str:
        words = ["".join(self.one("ta lo mi ren sa vor el un dis ka pe or an ti") for _ in range(self.rng.randint(1, 3))) for _ in range(n)]
        return " ".join(words).capitalize() + "."

    def para(self) -> str:
        if self.good and self.rng.random() < 0.8:
            return self.rng.choice(self.good)
        return " ".join(self.made_up(self.rng.randint(3, 14)) for _ in range(self.rng.choice([1, 1, 2, 3, 5])))

    def some(self, least: int, most: int) -> str:
        """A few words."""
        words = (self.rng.choice(self.rest) if self.rest and self.rng.random() < 0.5 else self.para()).split(" ")
        at = self.rng.randrange(len(words))
        return " ".join(words[at : at + self.rng.randint(least, most)])

    def words(self, part: str, share: float = 0.5) -> str:
        return self.one(WORDS[part], ",") if part in WORDS and self.rng.random() < share else self.some(1, 4)

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(10**6)}">{escape(text)}</a>'

    def open(self, part: str, label: int | None, tag: str | None = None) -> tuple[str, str]:
        tags, names = PARTS[part]
        tag = tag or (self.one(tags) if self.telling else "li" if part == "comment" and self.rng.random() < 0.3 else "div")
        attrs = ""
        if self.classes or (part in ("ad", "comments", "comment") and not self.telling):
            name = self.one(names)
            name = self.rng.choice([name, name, f"{name}-{self.one('wrap inner box area block list item')}", f"{self.one('site page js main c u mod')}-{name}", f"{name} {self.one('clearfix row grid wide x1 mt-4')}", name.title()])
            attrs = f' {self.rng.choice(["class", "class", "class", "id"])}="{name}"'
        label_attr = "" if label is None else f' data-label="{label}"'
        return f"<{tag}{attrs}{label_attr}>", f"</{tag}>"

    def wrap(self, part: str, inside: str, label: int | None = 0) -> str:
        start, end = self.open(part, label)
        if self.rng.random() < 0.3:
            inside = f"<div>{inside}</div>"
        return start + inside + (end if label == 0 or self.rng.random() < 0.97 else "")

    def links(self, part: str, n: int | None = None) -> str:
        n = n or self.rng.randint(2, 9)
        shape = self.rng.choice(["ul", "ul", "div", "plain"])
        own = [self.link(self.words(part)) for _ in range(n)]
        if shape == "ul":
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (self.rng.random() < 0.9) for x in own) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in own) if shape == "div" else self.rng.choice([" | ", " ", " &middot; "]).join(own)

    def prose(self, tag: str = "p") -> str:
        text = self.para() if self.rng.random() < 0.9 else self.some(1, 6)
        if self.rng.random() < 0.08:  # articles use such words too
            text = self.one(WORDS[self.rng.choice(sorted(WORDS))], ",")
        text = escape(text, quote=self.rng.random() < 0.5)
        if self.rng.random() < 0.15:
            text = f"<b>{text}</b>" if self.rng.random() < 0.7 else f"<b>{text}"
        if self.rng.random() < 0.15:
            text += " " + self.link(self.some(1, 5)) + " " + escape(self.some(1, 9))
        if self.rng.random() < 0.1:
            text = text.replace(". ", ".<br>", 1)
        return f"<{tag}>{text}" + f"</{tag}>" * (tag != "p" or self.rng.random() < 0.85)

    def aside(self, part: str, depth: int = 0) -> str:
        """A part that isn't main text."""
        r, heading = self.rng, lambda p: (f"<h{(k := r.randint(2, 4))}>{escape(self.words(p, 0.8))}</h{k}>" if r.random() < 0.6 else "")
        if part == "comments":
            own = "".join(self.wrap("comment", r.choice(["", f"<b>{self.some(1, 2)}</b> ", f"<div>{escape(self.words(part))}</div>", f"<h4>{escape(self.some(1, 3))}</h4>"]) + self.prose() * r.randint(1, 2) + (self.link("Reply") if r.random() < 0.3 else ""), None) for _ in range(r.randint(1, 6)))
            return self.wrap(part, heading(part) + own + (self.aside("form", 1) if r.random() < 0.3 else ""))
        if part == "form":
            fields = "".join(r.choice([f"<label>{escape(self.words(part))}</label>", "<input name=q>", f"<button>{escape(self.words(part))}</button>", f"<select><option>{escape(self.some(1, 2))}<option>{escape(self.some(1, 2))}</select>", f"<p>{escape(self.some(3, 12))}</p>", "<textarea>x</textarea>"]) for _ in range(r.randint(1, 4)))
            return self.wrap(part, heading(part) + fields)
        if part in ("nav", "share", "tags"):
            return self.wrap(part, (heading(part) if r.random() < 0.2 else "") + self.links(part))
        own = [heading(part)]
        for _ in range(r.randint(1, 3)):
            own.append(r.choice([
                lambda: self.links(part), lambda: f"<p>{escape(self.words(part, 0.7))}</p>", lambda: escape(self.words(part, 0.7)), lambda: escape(self.some(4, 12)) if self.prose_aside else self.links(part),
                lambda: self.prose(r.choice(["p", "p", "div"])) if self.prose_aside else self.links(part)])())
        if part == "footer":
            own.append(f"&copy; {escape(self.some(1, 3))} &middot; {escape(self.some(3, 12))}")
        if part == "notice" and r.random() < 0.6:
            own.append(f"<button>{escape(self.some(1, 2))}</button>")
        return self.wrap(part, "".join(own))

    def main(self) -> str:
        """The article, with parts inside that aren't its text."""
        r = self.rng
        own = [f"<h1>{escape(self.some(3, 12))}</h1>"] if r.random() < 0.85 else []
        if own and r.random() < 0.2:
            own = [f"<header>{own[0]}</header>"] if self.telling else [f"<div>{own[0]}</div>"]
        for _ in range(r.choice([1, 2, 3, 4, 6, 10] * 4 + [40, 120])):
            own.append(r.choices([
                self.prose, lambda: self.prose("div"), lambda: f"<h{(k := r.randint(2, 4))}>{escape(self.some(2, 8))}</h{k}>" + self.prose(), lambda: "<ul>" + "".join(f"<li>{escape(self.some(2, 15))}" for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f"<blockquote>{self.prose()}</blockquote>", lambda: f"<figure><img src=x><figcaption>{escape(self.some(3, 12))}</figcaption></figure>", lambda: f"<pre>{escape(self.some(5, 20))}</pre>", lambda: "<table>" + "".join(f"<tr><td>{escape(self.some(1, 3))}<td>{escape(self.some(1, 3))}</tr>" for _ in range(r.randint(1, 4))) + "</table>",
                lambda: f"<div>{self.prose()}{self.prose()}</div>", lambda: f"<section>{self.prose()}</section>"], (12, 1, 2, 2, 1, 0.7, 0.5, 0.7, 1, 1))[0]())
        if r.random() < 0.15 and (self.telling or self.classes):  # an article of short lines, perhaps one over and over
            line = escape(self.some(1, 6))
            own += [f"<p>{line if r.random() < 0.7 else escape(self.some(1, 6))}" + "</p>" * (r.random() < 0.9) for _ in range(r.choice([5, 15, 60]))]
        for part, share in (("ad", 0.35), ("share", 0.25), ("related", 0.2), ("form", 0.12), ("notice", 0.12), ("tags", 0.15), ("nav", 0.05)):
            if r.random() < share:
                own.insert(r.randint(0, len(own)), self.aside(part))
        if r.random() < 0.2:
            own.append(self.aside("comments"))
        return self.wrap("article", "".join(own), 1)

    def html(self) -> str:
        r = self.rng
        if r.random() < 0.12:  # little or nothing but the article
            return self.rng.choice(["", "<html><body data-label=0>", "<body data-label=0>"]) + self.main() + (self.aside("footer") if r.random() < 0.3 else "")
        top = [self.aside(p) for p, share in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("form", 0.1), ("ad", 0.3), ("nav", 0.1)) if r.random() < share]
        r.shuffle(top)
        under = [self.aside(p) for p, share in (("share", 0.15), ("tags", 0.15), ("related", 0.3), ("comments", 0.4), ("form", 0.15), ("ad", 0.2)) if r.random() < share]
        side = [self.aside("sidebar")] if r.random() < 0.4 else []
        middle = [self.main(), *under]
        middle = side + middle if r.random() < 0.5 else middle + side
        inside = "".join(middle)
        if r.random() < 0.6:
            inside = self.wrap("main", inside, None)
        if r.random() < 0.5:
            top = [self.wrap("header", "".join(top), 0)] if r.random() < 0.3 else top
        low = [self.aside(p) for p, share in (("form", 0.1), ("nav", 0.15), ("footer", 0.85), ("notice", 0.15)) if r.random() < share]
        body = "".join(top) + inside + "".join(low)
        if r.random() < 0.3:
            body = f"<div>{body}</div>"
        if r.random() < 0.2:
            body = escape(self.some(1, 3)) + body if r.random() < 0.2 else "\n".join(body.split("\n"))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body data-label=0>{body}" + "</body></html>" * (r.random() < 0.9)


def pages(n: int, good: list[str], rest: list[str], seed: int) -> Iterator[str]:
    """``n`` labelled pages, the same each time; ``good`` and ``rest``: texts to fill articles and other parts with."""
    rng = random.Random(seed)
    good, rest = sorted({x for x in good if x})[:4000], sorted({x for x in rest if x})[:4000]
    for _ in range(n):
        yield Page(rng, good, rest).html()
