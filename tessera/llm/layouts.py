"""Labelled pages for HTML extraction, made by a seeded generator: whole pages of many layouts, each a list of (markup, whether it is main text).

Words are made up, so that places and phrases teach, not topics. Main text stands in an article, a main element, a named division or none at all; around it, and
inside it, stand menus, headers, notices, adverts, forms, sidebars, teasers, reader comments and footers, some under the usual names and some under none.
"""

from __future__ import annotations

import random

Segment = tuple[str, bool]
_SYLLABLES = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("", "n", "r", "s")]
_MENUS = ("nav", "ul class='menu'", "div class='navbar'", "div id='nav'", "div class='navigation'", "div role='navigation'", "div class='topbar'", "div class='menu'")
_SIDES = ("aside", "aside", "aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "div role='complementary'", "section class='promo'")
_COMMENTS = ("section id='comments'", "div class='comments'", "div id='comments'", "ol class='commentlist'", "div class='comment'", "div id='disqus_thread'")
_FOOTERS = ("footer", "div class='footer'", "div id='footer'", "div role='contentinfo'", "div class='site-footer'", "div")
_NOTICES = ("div class='cookie-notice'", "div class='notice'", "div id='cookie-banner'", "div class='consent'", "div class='alert'", "div class='popup'", "dialog")
_ADVERTS = ("div class='ad'", "div class='ads'", "div class='advert'", "div class='banner'", "div class='sponsored'", "div class='advertisement'", "aside class='ad'")
_SHARES = ("div class='share'", "div class='social'", "ul class='sharing'", "div class='newsletter'", "div class='subscribe'", "div class='pagination'", "div class='toolbar'")
_HEADERS = ("header", "div class='header'", "div id='header'", "div class='masthead'", "div role='banner'", "div class='site-header'")
_MAINS = ("article", "article", "article", "main", "main", "div class='content'", "div id='content'", "div class='post'", "section class='entry'", "div", "")


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out = rng, []

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(2, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        said = self.words(3, 18).split()
        for _ in range(self.rng.choice((0, 0, 0, 1, 1, 2))):
            i, n = self.rng.randrange(len(said)), self.rng.randint(1, 4)
            said[i : i + n] = [self.rng.choice(("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<code>{}</code>", "<a href='/y'><i>{}</i></a>")).format(" ".join(said[i : i + n]))]
        return " ".join(said).capitalize() + self.rng.choice("....?!")

    def links(self, low: int, high: int) -> str:
        a = [f"<a href='/{self.word()}'>{self.rng.choice(('Home', 'About', 'Contact', 'Login', 'News', 'Privacy policy', self.words(1, 4).capitalize()))}</a>" for _ in range(self.rng.randint(low, high))]
        return self.rng.choice((" ".join(a), " | ".join(a), "<ul>" + "".join(f"<li>{x}</li>" for x in a) + "</ul>", "<p>" + " ".join(a) + "</p>"))

    def wrap(self, opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def plain(self, low: int, high: int) -> str:
        return " ".join(f"<p>{' '.join(self.sentence() for _ in range(self.rng.randint(1, 4)))}</p>" for _ in range(self.rng.randint(low, high)))

    def boilerplate(self) -> str:
        """One element that is not main text, wherever it stands."""
        kind, pick = self.rng.choice((0, 1, 1, 1, 2, 3, 4, 5, 6, 7)), self.rng.choice
        if kind == 0:
            return self.wrap(pick(_MENUS), self.links(3, 12))
        if kind == 1:
            return self.wrap(pick(_SIDES), pick((self.links(2, 8), self.plain(1, 8), f"<h3>Related articles</h3>{self.links(2, 6)}", self.wrap("article", f"<h3>{self.words(3, 7)}</h3>{self.plain(1, 3)}"))))
        if kind == 2:
            return self.wrap(pick(_ADVERTS), pick((self.words(2, 10), self.plain(1, 2), f"<a href='/buy'>{self.words(2, 6)}</a>")))
        if kind == 3:
            return self.wrap(pick(_SHARES), pick((f"Share this {self.links(2, 5)}", f"<p>Subscribe to our newsletter {self.words(2, 8)}</p>", self.links(2, 6))))
        if kind == 4:
            return self.wrap("form", f"<label>{self.words(1, 4)}</label><input><select><option>{self.word()}<option>{self.word()}</select><p>{self.words(2, 9)}</p><button>{self.word()}</button>")
        if kind == 5:
            return self.wrap(pick(_NOTICES), pick((f"<p>We use cookies. {self.sentence()}</p><button>Accept</button>", f"We use cookies {self.links(1, 2)}", self.sentence())))
        if kind == 6:
            return f"<script>var {self.word()} = '<p>{self.words(1, 5)}</p>';</script>"
        return self.wrap("div hidden", self.plain(1, 2))

    def stray(self) -> str:
        """A short text beyond other elements, under no name."""
        said = self.rng.choice((self.sentence(), self.words(1, 6), f"{self.words(1, 3)} 2024"))
        return self.rng.choice((f"<p>{said}</p>", f"<div><p>{said}</p></div>", f"<div>{said}</div>", said))

    def main_block(self) -> str:
        kind, own = self.rng.randrange(14), f" class='{self.word()}-{self.word()}'" if self.rng.random() < 0.3 else ""
        if kind <= 5 and self.rng.random() < 0.25:
            return f"<p{own}>{self.words(1, 6)}{self.rng.choice(('', '', '.', '!', ':', ' ***', '%'))}</p>"
        if kind <= 5:
            return f"<p{own}>{' '.join(self.sentence() for _ in range(self.rng.randint(1, 6)))}</p>"
        if kind == 6:
            return f"<h2{own}>{self.words(2, 8).capitalize()}</h2>"
        if kind == 7:
            return self.wrap(self.rng.choice(("ul", "ol")) + own, "".join(f"<li>{self.rng.choice((self.words(1, 8), self.sentence()))}</li>" for _ in range(self.rng.randint(2, 6))))
        if kind == 8:
            return self.wrap("blockquote" + own, self.plain(1, 2))
        if kind == 9:
            return self.wrap("table" + own, "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.rng.randint(2, 5))))
        if kind in (10, 12, 13):
            return self.wrap(self.rng.choice(("section", "div")) + own, self.rng.choice(("", f"<h3>{self.words(2, 5)}</h3>")) + self.plain(1, 3))
        return self.rng.choice((f"<figure><img src='x'><figcaption>{self.sentence()}</figcaption></figure>", f"<pre>{self.words(3, 20)}</pre>", f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl>", f"<div{own}>{self.sentence()} {self.sentence()}</div>"))

    def page(self) -> list[Segment]:
        pick, chance, add = self.rng.choice, self.rng.random, lambda markup, main=False: self.out.append((markup, main))
        if chance() < 0.1:
            return [(" ".join(self.sentence() for _ in range(self.rng.randint(1, 8))) if chance() < 0.6 else self.words(2, 30), True)]
        title = self.words(2, 9).capitalize()
        add(f"<!DOCTYPE html><html><head><title>{title}</title><meta charset='utf-8'><style>p{{margin:0}}</style></head><body>")
        if chance() < 0.3:
            add(self.wrap(pick(_NOTICES), f"<p>We use cookies. {self.sentence()}</p>"))
        if chance() < 0.6:
            add(self.wrap(pick(_HEADERS), pick((f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 8)}</p>", self.words(1, 4)))))
        if chance() < 0.8:
            add(pick((self.wrap(pick(_MENUS), self.links(3, 12)), f"<div>{self.links(3, 8)}</div>", self.links(3, 8))))
        for _ in range(self.rng.randint(0, 2)):
            add(self.boilerplate())
        if chance() < 0.4:
            add(self.stray())
        wrapper = pick(_MAINS)
        outer = chance() < 0.3
        add("<div>" * outer + (f"<{wrapper}>" if wrapper else ""))
        if chance() < 0.75:
            heading = f"<h1>{title}</h1>"
            add(f"<header>{heading}<p>{self.words(2, 6)}</p></header>" if wrapper in ("article", "main") and chance() < 0.3 else heading, True)
        for i in range(self.rng.randint(2, 16)):
            if i and chance() < 0.35:
                add(self.boilerplate())
            add(self.main_block(), True)
        add((f"</{wrapper.split()[0]}>" if wrapper else "") + "</div>" * outer)
        if chance() < 0.4:
            reader = lambda: pick((self.plain(1, 2), f"<p>{self.word()}: {self.sentence()}</p>", f"<li><b>{self.word()}</b> {self.sentence()}</li>"))
            add(self.wrap(pick(_COMMENTS), f"<h3>Comments</h3>{''.join(reader() for _ in range(self.rng.randint(1, 5)))}"))
        for _ in range(self.rng.randint(0, 3)):
            add(self.boilerplate())
        if chance() < 0.4:
            add(self.stray())
        if chance() < 0.2:
            add(f"<div>{self.links(3, 8)}</div>")
        if chance() < 0.85:
            own = f"{pick(('&copy;', 'Copyright', '&copy; Copyright', 'Copyright &copy;'))} {pick(('', '2019', '2024'))} {self.words(1, 4)}{pick(('', '.', ' &middot; ' + self.sentence()))} {pick(('', 'All rights reserved.', 'All rights reserved'))}"
            add(self.wrap(pick(_FOOTERS), pick((own, f"<p>{own}</p>", f"{own} {self.links(1, 4)}", self.links(2, 6)))))
        add("</body></html>")
        return self.out


def labelled_pages(count: int = 240, seed: int = 20_261) -> list[list[Segment]]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(count)]
