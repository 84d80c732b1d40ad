"""Web pages made for training: random texts in random layouts, each block marked as main text or not."""

from __future__ import annotations

import numpy as np

MAIN, SIDE = "\ue000", "\ue001"  # marks before the text of a block

# What menus, footers, notices, adverts, bylines, forms and comment lists often say.
PHRASES = {
    "nav": "Home|About us|Contact|News|Products|Blog|Log in|Archive|Menu|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Acerca de",
    "footer": "All rights reserved|&copy; 2024 Example Ltd|Privacy policy|Terms of use|Copyright 2019|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Back to top",
    "notice": "We use cookies to improve your experience|Accept all cookies|This site uses cookies|Please enable JavaScript|Wir verwenden Cookies|Nous utilisons des cookies|Usamos cookies",
    "ad": "Advertisement|Sponsored|Buy now|Sale: 50% off today|Special offer|Anzeige|Publicité|Publicidad|Download our app",
    "share": "Share this|Tweet|Print this page|By Jane Smith|Posted on 3 May 2021|Tags: news, world|5 min read|Teilen|Partager|Compartir",
    "form": "Subscribe|Your email address|Sign up for our newsletter|Search|Password|Submit|Suche|Abonnieren|S'inscrire|Buscar",
    "comments": "3 comments|Reply|Leave a comment|Posted by guest|2 hours ago|Kommentare|Commentaires|Comentarios|Report",
    "sidebar": "Related articles|Most read|Recent posts|Popular|Categories|See also|Trending|Mehr zum Thema|À lire aussi|Lo más leído",
}
PHRASES = {kind: said.split("|") for kind, said in PHRASES.items()}
# Frequent words of four languages.
SMALL = "the of and to in is that it was for on with as der die und das von zu le la les de et un des que est el los en por con una".split()
LETTERS = "abcdefghijklmnopqrstuvwxyzéèüöñçß"


class Maker:
    """One page; every choice comes from rng."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.plain = self.chance(0.4)  # neither classes nor elements tell what a part of the page is
        self.junk = self.pick("", "", "", "", "###", "&amp;&amp;", "%%%", "!!")
        self.small = self.chance(0.5)

    def pick(self, *xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def between(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high))

    def word(self) -> str:
        if self.small and self.chance(0.4):
            return self.pick(*SMALL)
        if self.chance(0.04):
            return self.pick(str(self.between(1, 3000)), f"{self.between(1, 99)},{self.between(100, 999)}", f"{self.between(0, 24)}:30")
        return "".join(LETTERS[int(k)] for k in self.rng.integers(0, len(LETTERS), self.between(1, 12)))

    def words(self, low: int, high: int) -> str:
        end = lambda: self.junk if self.junk and self.chance(0.7) else self.pick("", "", "", "", "", "", ",", ".")
        return " ".join(self.word() + end() for _ in range(self.between(low, high)))

    def main(self, low: int, high: int) -> str:
        return MAIN + self.words(low, high).capitalize() + self.pick(".", ".", ".", ".", "", "!", "?")

    def side(self, kind: str, low: int = 1, high: int = 12) -> str:
        if self.chance(0.5):
            more = " " + self.words(1, high) if self.chance(0.3) else ""
            return SIDE + self.pick(*PHRASES[kind]) + more
        return SIDE + self.words(low, high).capitalize() + self.pick(".", "", "", "!")

    def attr(self, *names: str) -> str:
        """A class or id; on plain pages one that tells nothing, or none."""
        name = self.pick("", "", f"c{self.between(1, 99)}", "col", "row", "box", "wrap", "block", "grid", "left", "inner") if self.plain or self.chance(0.1) else self.pick(*names)
        return f' {self.pick("class", "class", "id")}="{name}"' if name else ""

    def tag(self, *names: str) -> str:
        return self.pick("div", "div", "td", "section") if self.plain and self.chance(0.7) else self.pick(*names)

    def wrap(self, tag: str, attr: str, body: str) -> str:
        if tag == "td":
            return f"<table><tr><td{attr}>{body}</td></tr></table>"
        return f"<{tag}{attr}>{body}</{tag}>"

    def links(self, kind: str = "nav") -> str:
        one = [f'<a href="/{self.word()}">{self.side(kind, 1, 4)}</a>' for _ in range(self.between(2, 9))]
        form = self.pick("li", "li", "li", "div", "p", "td", "br", "|")
        if form in ("br", "|"):
            return self.pick("<br>", " ").join(one) if form == "br" else " | ".join(one)
        if form == "td":
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in one) + "</tr></table>"
        return ("<ul>{}</ul>" if form == "li" else "{}").format("".join(f"<{form}>{x}</{form}>" for x in one))

    # Parts around the article

    def nav(self) -> str:
        return self.wrap(self.tag("nav", "div", "header"), self.attr("menu", "nav", "navigation", "main-nav", "topbar", "breadcrumbs"), self.links())

    def header(self) -> str:
        inside = self.pick("h1", "div", "p")
        return self.wrap(self.tag("header", "header", "div"), self.attr("site-header", "header", "masthead", "logo"), f"<{inside}>{SIDE}{self.words(1, 5)}</{inside}>" + (self.links() if self.chance(0.3) else ""))

    def ad(self) -> str:
        body = self.side("ad", 2, 25)
        return self.wrap(self.tag("div", "div", "aside", "section"), self.pick(' class="ad"', self.attr("ad", "ads", "advert", "promo", "sponsored", "banner ad", "ad-slot")), self.pick(body, f"<p>{body}</p>"))

    def notice(self) -> str:
        body = f"<p>{self.side('notice', 4, 25)}</p>" + self.pick("", f"<button>{SIDE}{self.pick('OK', 'Accept', 'Close')}</button>")
        return self.wrap("div", self.attr("notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "popup"), body)

    def sidebar(self) -> str:
        body = f"<h3>{self.side('sidebar', 1, 4)}</h3>" + (self.links("sidebar") if self.chance(0.7) else f"<p>{self.side('sidebar', 5, 40)}</p>")
        return self.wrap(self.tag("aside", "div", "aside"), self.attr("sidebar", "side", "widget", "related", "right-column"), body)

    def form(self) -> str:
        body = f"<label>{self.side('form', 1, 5)}</label><input name=q><p>{self.side('form', 2, 15)}</p><button>{SIDE}{self.pick('Go', 'Send', 'OK', 'Search')}</button>"
        return f"<form{self.attr('search', 'newsletter', 'subscribe', 'login')}>{body}</form>"

    def comment(self, depth: int = 0) -> str:
        by = f"<div>{self.side('comments', 1, 4)}</div>" if self.chance(0.4) else ""
        text = f"<p>{SIDE}{self.words(3, 40).capitalize()}{self.pick('.', '!', '')}</p>"
        text = f"<blockquote>{text}</blockquote>{text}" if self.chance(0.1) else text
        under = f"<ul{self.pick('', ' class=children')}>{self.comment(depth + 1)}</ul>" if depth < 3 and self.chance(0.3) else ""
        inner = self.pick("{}", "{}", '<div class="comment-body">{}</div>', "<article>{}</article>").format(by + text)
        return f"<li{self.pick('', ' class=comment', ' class=reply')}>{inner}{under}</li>"

    def comments(self) -> str:
        head = f"<h3>{self.side('comments', 1, 4)}</h3>" if self.chance(0.6) else ""
        many = "".join(self.comment() for _ in range(self.between(1, 6)))
        return f'<{(t := self.pick("div", "section", "ol"))} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "commentlist", "discussion", "responses")}">{head}{many}</{t}>'

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'tags', 'meta', 'byline', 'share-buttons')}>{self.side('share', 1, 5)}</div>"

    def footer(self) -> str:
        line = self.side("footer", 2, 14)
        body = self.pick(line, f"<p>{line}</p>", line + " &middot; " + self.word(), f"<p>{line}</p>{self.links('footer')}")
        return self.wrap(self.tag("footer", "footer", "footer", "div"), self.attr("footer", "site-footer", "copyright", "bottom"), body)

    # The article

    def inner(self, low: int, high: int) -> str:
        text = self.main(low, high)
        if self.chance(0.2):
            text = text.replace(" ", " <a href='/x'>", 1) + "</a>"
        if self.chance(0.3):
            text = text.replace(MAIN, f"{self.pick('<b>', '<em>', '<strong>', '<span>')}{MAIN}", 1)
        return text

    def piece(self) -> str:
        r = self.rng.random()
        if r < 0.62:
            return f"<p>{self.inner(1, self.pick(6, 40, 150))}" + self.pick("</p>", "</p>", "</p>", "<br>", "")
        if r < 0.70:
            k = self.pick(2, 2, 3, 4)
            return f"<h{k}>{self.main(1, 8)}</h{k}>"
        if r < 0.76:
            kind = self.pick("ul", "ul", "ol")
            return f"<{kind}>" + "".join(f"<li>{self.inner(2, 20)}</li>" for _ in range(self.between(1, 6))) + f"</{kind}>"
        if r < 0.80:
            return f"<blockquote>{self.pick('', '<p>')}{self.main(4, 40)}</blockquote>"
        if r < 0.83:
            cells = "".join(f"<tr><{(c := self.pick('td', 'td', 'th'))}>{self.main(1, 4)}</{c}><td>{self.main(1, 4)}</td></tr>" for _ in range(self.between(1, 4)))
            return f"<table{self.pick('', ' class=data')}>{cells}</table>"
        if r < 0.86:
            return f"<pre>{self.pick('', '<code>')}{self.main(2, 30)}</pre>"
        if r < 0.89:
            return "<dl>" + "".join(f"<dt>{self.main(1, 3)}</dt><dd>{self.main(3, 25)}</dd>" for _ in range(self.between(1, 5))) + "</dl>"
        if r < 0.91:
            return f"<figure><img src=x><figcaption>{self.main(2, 14)}</figcaption></figure>"
        if r < 0.92:
            return f"<div{self.pick('', '', ' class=text')}>{self.main(4, 40)}</div>"
        return self.pick(self.ad, self.share, self.sidebar, self.notice, self.form)()

    def article(self) -> str:
        title = f"<h1>{self.main(2, 12)}</h1>" if self.chance(0.9) else ""
        under = self.share() if self.chance(0.1) else ""
        body = title + under + "".join(self.piece() for _ in range(self.between(1, self.pick(4, 12, 26))))
        if self.plain:
            return self.wrap(self.pick("div", "div", "td", "section", "body"), self.attr("content"), body).replace("<body", "<div").replace("</body", "</div")
        tag, *names = self.pick(
            ("article",), ("article",), ("article", "post", "entry", "article", "story"), ("main",), ("main", "content", "main"),
            ("div", "content", "article", "post-content", "entry-content", "article-body", "story", "main", "text"), ("section", "article", "content", "post"),
        )
        return f"<{tag}{self.attr(*names) if names else ''}>{body}</{tag}>"

    def page(self) -> str:
        before = [part() for part in (self.header, self.nav, self.notice, self.ad, self.form, self.sidebar) if self.chance(0.4)]
        after = [part() for part in (self.share, self.comments, self.sidebar, self.ad, self.form, self.nav, self.notice, self.footer) if self.chance(0.4)]
        if self.chance(0.4):
            after = [*(part() for part in (self.comments, self.sidebar) if self.chance(0.3)), self.footer()]
        self.rng.shuffle(before)
        main = self.article()
        if self.plain and self.chance(0.3):  # columns of a layout table
            left, right = "".join(before), "".join(after[:1])
            body = f"<table{self.pick('', ' border=0')}><tr><td>{left}</td><td>{main}</td><td>{right}</td></tr><tr><td colspan=3>{''.join(after[1:])}</td></tr></table>"
        else:
            body = "".join(before) + main + "".join(after)
        start, end = self.pick(("", ""), ("", ""), ('<div class="container">', "</div>"), ('<div id="page"><div class="row">', "</div></div>"))
        html = f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{start}{body}{end}</body></html>"
        return html[: self.between(len(html) // 3, len(html))] if self.chance(0.12) else html


def made_page(rng: np.random.Generator) -> str:
    """A page of random words in a random layout; each block of main text begins with MAIN, each other with SIDE."""
    return Maker(rng).page()
