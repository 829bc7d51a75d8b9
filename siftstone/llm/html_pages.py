"""Seeded generator of labelled pages for the block labeller: layouts, class names and wording are drawn at random."""

from __future__ import annotations

import random

#: Names that page authors give to the parts of a page (fixed values)
MAIN = "content main article post entry story body text article-body post-content entry-content main-content page-content articleBody prose markdown".split()
WRAP = "wrapper container page site layout inner row col grid outer app root".split()
MENU = "nav menu navbar topnav navigation breadcrumb breadcrumbs tabs toolbar sitenav skip pagination pager links".split()
HEAD = "header masthead top banner site-header branding logo hero topbar".split()
FOOT = "footer site-footer bottom copyright colophon legal foot".split()
SIDE = "sidebar aside widget related recommended side rail trending popular recent tags archive".split()
ADS = "ad ads advert advertisement sponsor sponsored promo adsbox banner-ad adslot ad-unit".split()
NOTE = "notice cookie cookies consent alert gdpr popup modal warning message paywall newsletter".split()
FORM = "search form subscribe login signup contact newsletter-form searchform".split()
SAID = "comments comment commentlist comment-body discussion replies reply responses disqus reader-comments respond".split()
SHARE = "share social sharing buttons toolbar follow".split()


def _syllables(r: random.Random) -> list[str]:
    return ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouyéäöñ") + r.choice(["", "n", "r", "s", "t"]) for _ in range(r.randrange(1, 3))) for _ in range(40)]


class _Page:
    def __init__(self, r: random.Random) -> None:
        self.r, self.out, self.labels = r, [], []
        self.syllables = _syllables(r)
        self.style = r.choice(["semantic", "classes", "ids", "bare", "both", "both", "semantic"])
        self.entities = r.random() < 0.4
        # signs that one would expect in menus and footers stand in some pages' articles, in some between all words
        self.sign = r.choice("||||»»©·–•/")
        self.signs = r.choice([0, 0, 0, 0, 0, 0, 0.02, 0.1, 0.3, 1])

    def said(self, low: int, high: int, stop: bool = True) -> str:
        """Words of an article."""
        text = self.words(low, high, stop)
        if self.signs:
            ws = text.split(" ")
            text = " ".join(w + (f" {self.sign}" if self.r.random() < self.signs else "") for w in ws)
            if self.r.random() < 0.2:
                text += f" {self.sign}"
        return text

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.r
        n = int(low * (high / low) ** r.random())
        ws = ["".join(r.choice(self.syllables) for _ in range(r.randrange(1, 4))) for _ in range(n)]
        ws = [w + "," if r.random() < 0.06 else w for w in ws]
        ws[0] = ws[0].capitalize()
        if r.random() < 0.05:
            ws = [w.upper() + "!!" for w in ws]
        text = " ".join(ws) + ("." if stop else "")
        return text + r.choice(["&amp;", " &lt;b&gt;", "&nbsp;x", " &#233;"]) if self.entities and r.random() < 0.2 else text

    def open(self, tags: list[str], names: list[str]) -> str:
        r = self.r
        tag = r.choice(tags) if self.style in ("semantic", "both") else "div"
        attrs = ""
        if self.style != "bare" and (self.style != "semantic" or tag == "div" or r.random() < 0.3):
            name = r.choice(names) + (r.choice(["", "", "-box", "-area", " clearfix", "-1", "_wrap"]))
            attrs = f' {"id" if self.style == "ids" or r.random() < 0.2 else "class"}="{name}"'
        elif self.style == "bare" and r.random() < 0.5:
            attrs = f' style="{r.choice(["float:left", "margin:0"])}"'
        self.out.append(f"<{tag}{attrs}>")
        return tag

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>" + self.r.choice(["", "\n", "\n  "]))

    def block(self, tag: str, text: str, main: bool, closed: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag}>" if closed else ""))
        self.labels.append(int(main))

    def menu(self) -> None:
        r = self.r
        tag = self.open(["nav", "nav", "div"], MENU)
        if r.random() < 0.7:
            self.out.append("<ul>")
            for _ in range(r.randrange(1, 9)):
                self.block("li", f'<a href="/{r.random():.3f}">{self.words(1, 4, False)}</a>', False, r.random() < 0.9)
            self.out.append("</ul>")
        else:
            self.block("div", " | ".join(f'<a href="/{k}">{self.words(1, 3, False)}</a>' for k in range(r.randrange(2, 9))), False)
        self.close(tag)

    def plain(self, tags: list[str], names: list[str], n: tuple[int, int], size: tuple[int, int], lead: str = "") -> None:
        r = self.r
        tag = self.open(tags, names)
        if r.random() < 0.4:
            self.out.append(lead + self.words(*size))
            self.labels.append(0)
        else:
            for _ in range(r.randint(*n)):
                text = lead + self.words(*size)
                self.block(r.choice(["p", "p", "div", "li", "h3", "h4", "span><p"]).split(">")[0].replace("span", "p"), f'<a href="#">{text}</a>' if r.random() < 0.3 else text, False)
        self.close(tag)

    def form(self) -> None:
        r = self.r
        self.out.append(f'<form action="/s" class="{r.choice(FORM)}">' if r.random() < 0.7 else '<form method="post">')
        if r.random() < 0.7:
            self.block("p" if r.random() < 0.5 else "div", f"<label>{self.words(1, 12, False)}</label>", False)
        self.out.append('<input type="text" name="q" placeholder="x"><textarea name="t">typed text</textarea><select><option>one<option>two</select>')
        self.block("button", self.words(1, 3, False), False)
        self.out.append("</form>")

    def comments(self) -> None:
        r = self.r
        tag = self.open(["section", "div", "aside"], SAID) if self.style not in ("bare", "semantic") else "section"
        if self.style in ("bare", "semantic"):
            self.out.append(f'<section {r.choice(["id", "class"])}="{r.choice(SAID)}">')
        if r.random() < 0.7:
            self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 4, False), False)
        for _ in range(r.randrange(1, 7)):
            inner = r.choice(["div", "li", "article", "div"])
            self.out.append(f'<{inner} class="{r.choice(SAID)}">' if r.random() < 0.6 else f"<{inner}>")
            if r.random() < 0.5:
                self.block(r.choice(["div", "p", "h5"]), f"<b>{self.words(1, 3, False)}</b> " + self.words(1, 3, False), False)
            for _ in range(r.randrange(1, 3)):
                self.block("p", self.words(2, 90), False)
            self.out.append(f"</{inner}>")
        self.out.append(f"</{tag}>")

    def ad(self) -> None:
        self.plain(["div", "aside", "div"], ADS, (1, 2), (2, 25))

    def share(self) -> None:
        self.plain(["div"], SHARE, (1, 3), (1, 4))

    def notice(self) -> None:
        self.plain(["div", "section", "aside"], NOTE, (1, 2), (3, 40))

    def side(self) -> None:
        r = self.r
        tag = self.open(["aside", "aside", "div"], SIDE)
        for _ in range(r.randrange(1, 4)):
            if r.random() < 0.6:
                self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 5, False), False)
            if r.random() < 0.5:
                self.out.append("<ul>")
                for _ in range(r.randrange(1, 7)):
                    self.block("li", f'<a href="/x">{self.words(1, 9, False)}</a>', False)
                self.out.append("</ul>")
            else:
                self.block("p", self.words(3, 40), False)
        self.close(tag)

    def article(self) -> None:
        r = self.r
        outer = self.open(["main", "div", "section"], WRAP + MAIN) if r.random() < 0.4 else None
        tag = self.open(["article", "article", "main", "section", "div"], MAIN)
        if r.random() < 0.85:
            self.block(r.choice(["h1", "h1", "h2"]), self.said(2, 14, False), True)
        for k in range(int(r.choice([28] * 14 + [200]) ** r.random())):
            x = r.random()
            if x < 0.72:
                text = self.said(1, 160)
                if r.random() < 0.15:
                    text = f"<{r.choice(['b', 'i', 'em', 'strong', 'span'])}>" + text
                elif r.random() < 0.15:
                    text += f' <a href="/r">{self.said(1, 4, False)}</a> ' + self.said(1, 20)
                self.block("p", text, True, r.random() < 0.9)
                if r.random() < 0.1:
                    self.out.append("<br>" + self.said(1, 30))
                    self.labels.append(1)
            elif x < 0.80:
                self.block(r.choice(["h2", "h3"]), self.said(1, 8, False), True)
            elif x < 0.86:
                kind = r.choice(["ul", "ol"])
                self.out.append(f"<{kind}>")
                for _ in range(r.randrange(2, 6)):
                    self.block("li", self.said(1, 30), True, r.random() < 0.8)
                self.out.append(f"</{kind}>")
            elif x < 0.89:
                self.out.append("<blockquote>")
                self.block("p", self.said(4, 60), True)
                self.out.append("</blockquote>")
            elif x < 0.91:
                self.out.append("<table>")
                for _ in range(r.randrange(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(r.randrange(1, 4)):
                        self.block("td", self.said(1, 5, False), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif x < 0.93:
                self.block("pre", self.said(3, 40), True)
            else:
                r.choice([self.ad, self.ad, self.share, self.notice, self.form, self.side])()
        if r.random() < 0.15:
            self.plain(["footer", "div"], SHARE + SIDE, (1, 2), (1, 10))
        self.close(tag)
        if outer:
            if r.random() < 0.3:
                r.choice([self.comments, self.side, self.ad])()
            self.close(outer)


def generated_page(r: random.Random) -> tuple[str, list[int]]:
    """(html, label of each block: 1 for main text)."""
    p = _Page(r)
    p.out.append('<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>' + p.words(2, 9, False) + "</title><style>p{margin:0}</style><script>var t=\"</p>\";f(0);</script></head><body>")
    wrap = r.random() < 0.3
    if wrap:
        p.out.append(f'<div class="{r.choice(WRAP)}">')
    before = []
    if r.random() < 0.45:
        before.append(lambda: p.plain(["header", "div"], HEAD, (1, 3), (1, 9)))
    if r.random() < 0.8:
        before.append(p.menu)
    for f, x in ((p.ad, 0.4), (p.notice, 0.3), (p.form, 0.25), (p.side, 0.2), (p.share, 0.1)):
        if r.random() < x:
            before.append(f)
    if r.random() < 0.4:
        r.shuffle(before)
    for f in before:
        f()
    if r.random() < 0.3:
        p.out.append("<!-- start <p>not text</p> -->")
    if r.random() < 0.97:
        p.article()
    after = [f for f, x in ((p.comments, 0.4), (p.side, 0.35), (p.ad, 0.2), (p.form, 0.15), (p.notice, 0.15), (p.menu, 0.1), (p.share, 0.15)) if r.random() < x]
    r.shuffle(after)
    for f in after:
        f()
    if r.random() < 0.8:
        p.plain(["footer", "footer", "div"], FOOT, (1, 3), (1, 22), r.choice(["", "&copy; ", "© 2020 ", "&copy; a.example.org &middot; "]))
    if wrap:
        p.out.append("</div>")
    if r.random() < 0.8:
        p.out.append("</body></html>")
    return "".join(p.out), p.labels
