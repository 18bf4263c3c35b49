"""Made-up pages around given fragments of text, whose main text is known: what the main-text model learns from.

The main text's runs begin with ``MARK``. Layouts vary in elements, attribute words, order, nesting and mistakes, so that no single
clue decides. The word lists are common attribute words of web pages.
"""

from __future__ import annotations

import random
from html import escape

#: A private-use code point before every run of main text.
MARK = "\ue000"

# fixed values: attribute words by the part of a page that carries them
MAIN = "article post entry content story main body text page single prose markdown blog news detail read inhalt artikel beitrag contenido articulo contenu texte".split()
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination pager tabs toc skip site-menu menue navegacion".split(),
    "header": "header masthead top logo branding tagline banner title-bar toolbar".split(),
    "footer": "footer copyright colophon bottom legal imprint credits site-info fuss fusszeile impressum pie pied pied-de-page mentions".split(),
    "sidebar": "sidebar aside widget related recommended popular trending tags archive promo-list secondary rail read-more more seitenleiste lateral".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense commercial marketing".split(),
    "notice": "cookie cookies consent gdpr notice alert privacy popup modal overlay paywall message disclaimer warning banner announcement hinweis aviso avis".split(),
    "form": "search newsletter subscribe login signup contact-form subscription register".split(),
    "comments": "comments comment comment-list reader-comments responses replies discussion feedback reactions disqus respond thread guestbook user-comments kommentare comentarios commentaires".split(),
    "share": "share social sharing follow buttons toolbar".split(),
}
ELEMENTS = {
    "nav": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"],
    "sidebar": ["aside", "div", "section", "aside"], "ad": ["div", "aside", "section", "p"], "notice": ["div", "section", "p", "aside"],
    "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul", "aside"], "share": ["div", "ul"],
}
NOISE = "row container col wrapper inner outer clearfix grid flex box block item module group wide left right dark".split()


class Page:
    """One page put together from fragments."""

    def __init__(self, rng: random.Random, fragments: list[str]):
        self.rng, self.fragments = rng, fragments

    def some(self, most: int) -> str:
        """A fragment of at most about ``most`` code points, cut at a space."""
        text = self.rng.choice(self.fragments)
        if len(text) > most:
            text = text[:most].rpartition(" ")[0] or text[:most]
        return text

    def prose(self, most: int = 400) -> str:
        return escape(self.some(self.rng.choice([40, 120, most])), quote=False)

    def attributes(self, words: list[str], bare: float) -> str:
        rng = self.rng
        if rng.random() < bare:
            return rng.choice(["", f' class="{rng.choice(NOISE)}"', f' class="x{rng.randrange(10**6)}"'])
        chosen = rng.sample(words, min(len(words), rng.choice([1, 1, 2])))
        if rng.random() < 0.3:
            chosen.insert(rng.randrange(len(chosen) + 1), rng.choice(NOISE))
        joined = rng.choice([" ", "-", "_"]).join(chosen)
        return rng.choice([f' class="{joined}"', f' id="{joined}"', f' class="{joined}" id="x{rng.randrange(999)}"', f" class='{joined}'", f' class="{joined}" data-v="{rng.randrange(99)}"'])

    def links(self, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{rng.randrange(999)}">{escape(self.some(rng.choice([8, 15, 40])))}</a>' for _ in range(n)]
        form = rng.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if form == 1:
            return "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        return rng.choice([" ", " | ", " &middot; ", " &raquo; "]).join(items)

    def part(self, kind: str) -> str:
        """A part of the page that is no main text."""
        rng = self.rng
        tag = rng.choice(ELEMENTS[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form")
        words = self.attributes(PARTS[kind], 0.6 if telling else 0.04)
        if kind in ("nav", "share"):
            inside = self.links(rng.randrange(2, 9))
            if tag == "ul":
                inside = "".join(f'<li><a href="#">{escape(self.some(20))}</a></li>' for _ in range(rng.randrange(2, 9)))
            if not telling and not words:
                words = ' class="menu"'
        elif kind == "header":
            inside = rng.choice(["", f"<h1>{escape(self.some(25))}</h1>", f"<p>{self.prose(60)}</p>"]) + f'<a href="/">{escape(self.some(20))}</a>' + rng.choice(["", self.part("nav")])
        elif kind == "footer":
            inside = rng.choice([f"&copy; {self.prose(90)}", f"<p>&copy; {rng.randrange(1990, 2030)} {self.prose(60)}</p>", self.prose(200), self.links(4) + f"<p>{self.prose(200)}</p>"])
        elif kind == "sidebar":
            inside = rng.choice([f"<h{k}>{escape(self.some(25))}</h{k}>" for k in (2, 3, 4)] + [""]) + rng.choice([self.links(5), f"<p>{self.prose()}</p>", "".join(f"<p>{self.prose(150)}</p>" for _ in range(3)), f"<div><a href='#'>{self.prose(80)}</a><p>{self.prose(150)}</p></div>"])
        elif kind == "form":
            inside = f"<label>{escape(self.some(25))}</label><input name='q'>" + rng.choice(["", f"<p>{self.prose(150)}</p>", self.prose(100)]) + f"<button>{escape(self.some(10))}</button>"
        elif kind == "comments":
            one = lambda: rng.choice([f"<div{self.attributes(['comment', 'reply', 'response'], 0.3)}>{x}</div>" if tag not in ("ol", "ul") else f"<li>{x}</li>" for x in (f"<b>{escape(self.some(12))}</b><p>{self.prose()}</p>", f"<p>{self.prose()}</p><p>{self.prose()}</p>", self.prose())])
            inside = rng.choice(["", f"<h3>{escape(self.some(20))}</h3>"]) * (tag not in ("ol", "ul")) + "".join(one() for _ in range(rng.randrange(1, 6)))
        else:
            inside = rng.choice([self.prose(), self.prose(), f"<p>{self.prose()}</p>", f"<h4>{escape(self.some(20))}</h4><p>{self.prose()}</p>", f'<a href="#">{self.prose(100)}</a>', f'{self.prose(120)} <a href="#">{escape(self.some(12))}</a>', f"<div><p>{self.prose()}</p></div>"])
            if tag == "p":
                inside = self.prose()
        role = rng.choice(["", "", {"nav": ' role="navigation"', "header": ' role="banner"', "footer": ' role="contentinfo"', "sidebar": ' role="complementary"', "notice": ' role="alert"', "form": ' role="search"'}.get(kind, "")])
        return f"<{tag}{words}{role}>{inside}" + (f"</{tag}>" if rng.random() < 0.97 or tag != "p" else "")

    def marked(self, most: int) -> str:
        text = escape(self.some(most), quote=False)
        rng, words = self.rng, None
        if rng.random() < 0.25:
            words = text.split(" ")
            k = rng.randrange(len(words))
            t = rng.choice(["a href='#'", "b", "i", "em", "strong", "span", "code", "a href='/x' class='link'"])
            words[k] = f"<{t}>{words[k]}</{t.split()[0]}>"
        return MARK + (" ".join(words) if words else text)

    def piece(self) -> str:
        """One or a few blocks of main text."""
        rng = self.rng
        form = rng.random()
        long = rng.choice([30, 90, 300, 300])
        if form < 0.68:
            return rng.choice([f"<p>{self.marked(long)}</p>"] * 5 + [f"<p>{self.marked(long)}", f"<p><b>{self.marked(long)}<br>", f"<p><b>{self.marked(60)}</b></p>", f"<div>{self.marked(long)}</div>", f"<p{self.attributes(['lead', 'intro', 'text', 'paragraph', 'first'], 0.4)}>{self.marked(long)}</p>"])
        if form < 0.77:
            k = rng.randrange(2, 5)
            return f"<h{k}>{self.marked(30)}</h{k}>"
        if form < 0.86:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.marked(rng.choice([15, 60, 150]))}" + rng.choice(["</li>", ""]) for _ in range(rng.randrange(1, 6))) + f"</{tag}>"
        if form < 0.91:
            return rng.choice([f"<blockquote>{self.marked(long)}</blockquote>", f"<blockquote><p>{self.marked(long)}</p></blockquote>", f"<pre>{self.marked(long)}</pre>"])
        if form < 0.95:
            return f"<figure><img src='x.png'><figcaption>{self.marked(80)}</figcaption></figure>"
        if form < 0.98:
            return "<table>" + "".join(f"<tr><th>{self.marked(12)}<td>{self.marked(30)}</tr>" for _ in range(rng.randrange(1, 5))) + "</table>"
        return f"<dl><dt>{self.marked(20)}<dd>{self.marked(100)}</dl>"

    def main(self) -> str:
        """The element of the main text, parts strewn in."""
        rng = self.rng
        body = [self.piece() for _ in range(rng.choice([1, 2, 3, 5, 8, 14]))]
        if rng.random() < 0.75:
            k = rng.choice([1, 1, 2])
            head = f"<h{k}>{self.marked(rng.choice([25, 80]))}</h{k}>"
            body.insert(0, head if rng.random() < 0.8 else f"<header{rng.choice(['', ' class=entry-header'])}>{head}</header>")
        for kind, chance in (("ad", 0.2), ("share", 0.2), ("sidebar", 0.12), ("form", 0.1), ("notice", 0.1)):
            if rng.random() < chance:
                body.insert(rng.randrange(len(body) + 1), self.part(kind))
        if rng.random() < 0.15:
            body.append(self.part("comments"))
        if rng.random() < 0.08:
            body.append(self.part("footer"))
        inside = "".join(body)
        if rng.random() < 0.3:
            inside = f"<div{self.attributes(MAIN, 0.4)}>{inside}</div>"
        tag = rng.choice(["article"] * 4 + ["main", "section", "div", "div", "div", "td"])
        words = self.attributes(MAIN, 0.7 if tag in ("article", "main") else 0.25)
        if tag == "td":
            # a page laid out as a table: cells beside the main text hold menus
            cells = [f"<td{words}>{inside}</td>"]
            for _ in range(rng.choice([0, 1, 1, 2])):
                side = self.links(rng.randrange(2, 9)) if rng.random() < 0.7 else "<br>".join(f'<a href="/{k}">{escape(self.some(15))}</a>' for k in range(rng.randrange(2, 6)))
                cells.insert(rng.randrange(len(cells) + 1), f"<td{self.attributes(PARTS['nav'], 0.7)}>{side}</td>")
            return "<table><tr>" + "".join(cells) + "</tr></table>"
        return f"<{tag}{words}>{inside}</{tag}>"

    def page(self) -> str:
        rng = self.rng
        shape = rng.random()
        if shape < 0.03:  # nothing but text
            return MARK + escape(self.some(300), quote=False)
        if shape < 0.10:  # nothing but blocks
            return "".join(self.piece() for _ in range(rng.randrange(1, 8)))
        before, after = [], []
        for kind, chance in (("notice", 0.25), ("header", 0.45), ("nav", 0.7), ("ad", 0.4), ("form", 0.2), ("sidebar", 0.2)):
            if rng.random() < chance:
                before.append(self.part(kind))
        for kind, chance in (("comments", 0.3), ("sidebar", 0.35), ("nav", 0.2), ("ad", 0.3), ("form", 0.2), ("footer", 0.75), ("notice", 0.2)):
            if rng.random() < chance:
                after.append(self.part(kind))
        if rng.random() < 0.3:
            rng.shuffle(before)
        main = self.main() if rng.random() < 0.95 else ""
        if rng.random() < 0.1:
            main += self.main()
        if rng.random() < 0.3:
            main = f"<{rng.choice(['main', 'div', 'div class=wrapper', 'div id=content'])}>" + main + (self.part("sidebar") if rng.random() < 0.4 else "") + rng.choice(["</div>", "</main></div>"])
        body = "".join(before) + main + "".join(after)
        if rng.random() < 0.25:
            body = f"<div{self.attributes(NOISE, 0)}>{body}</div>"
        title = f"<title>{escape(self.some(40))}</title><style>p{{color:red}}</style><script>var t='<p>x</p>';</script>"
        return rng.choice([f"<!DOCTYPE html><html><head><meta charset=utf-8>{title}</head><body>{body}</body></html>", f"<html><head>{title}<body>{body}", f"{title}{body}", f"<HTML><HEAD>{title}</HEAD><BODY>{body}</BODY></HTML>"])


def pages(fragments: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [Page(rng, fragments).page() for _ in range(n)]
