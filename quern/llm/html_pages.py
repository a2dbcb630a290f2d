"""Generated pages of many layouts for training the block labeller.

Elements that hold main text carry data-main="1" and what lies in them but is none data-main="0";
the labeller never sees that attribute.
"""

from __future__ import annotations

import random
import re
from html import escape
from string import ascii_lowercase, punctuation

SYLLABLES = "a an ar be ca co da de di do e el en er es fa for ge ha he i in is ka la le lo ma me mi na ne no o on or pa per po ra re ri ro sa se si so ta te ti to tra u un ur va ve vi ver wa we é ó ü ß".split()
COMMON = "the of and to in is that for it as was with on by at from de la que el en los der die und den le les des et".split()
CUES = {
    "nav": "home news about contact world sport shop blog menu more start".split(),
    "ad": "advertisement sponsored buy now offer deal sale save click".split(),
    "notice": "cookies accept settings privacy consent browser please agree policy updated".split(),
    "form": "email subscribe login search name password newsletter send submit sign".split(),
    "comment": "reply comment says posted ago wrote agree thanks report like".split(),
    "footer": "© copyright rights reserved terms privacy imprint contact".split(),
    "side": "popular recent archive tags related latest trending follow".split(),
}
MAIN_NAMES = "content post entry article story text main body page-content post-content entry-content article-body".split()
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu links pagination pager skip".split(),
    "ad": "ad ads advert adverts advertisement banner sponsored promo ad-box adsense promotion".split(),
    "notice": "cookie cookie-notice cookie-banner consent notice alert popup modal gdpr overlay message warning".split(),
    "form": "search login newsletter signup subscribe form contact-form".split(),
    "comment": "comments comment comment-list replies discussion responses disqus reader-comments reactions".split(),
    "footer": "footer foot site-footer bottom copyright colophon".split(),
    "side": "sidebar side widget related aside right-column popular share social tags recommended".split(),
    "header": "header masthead top site-header logo branding".split(),
}


#: Parts of names that say nothing, or little, about what an element holds.
NEUTRAL = """site page main primary secondary top inner outer wrap wrapper container content area body block box row col grid list item
    section module group panel region holder text title link first last left right default single view layout app root theme
    entry post component desktop mobile fixed wide small large clearfix screen info meta""".split()
ROLES = {"nav": "navigation", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "dialog", "header": "banner"}
NAMED = re.compile(r' (class|id)=("[^"]*"|[^\s>]+)')


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        # many pages have a language of their own, so that words count for less than the page's structure
        letters = self.r.choice([ascii_lowercase, ascii_lowercase + "äöüßéèçñóí", "абвгдежзиклмнопрстуфхцчшыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"])
        self.own = ["".join(self.r.choices(letters, k=self.r.randint(1, 11))) for _ in range(200)] if self.r.random() < 0.5 else []

    def name(self, base: str) -> str:
        """A class name around a base: site-nav, nav__inner, page-nav-list."""
        k, sep = self.r.random(), self.r.choice(["-", "-", "_", "__"])
        parts = [base] if k < 0.4 else [self.r.choice(NEUTRAL), base] if k < 0.65 else [base, self.r.choice(NEUTRAL)]
        return sep.join(parts if k < 0.9 else [self.r.choice(NEUTRAL), *parts])

    def neutral(self) -> str:
        names = [self.name(self.r.choice(NEUTRAL)) for _ in range(self.r.choice([0, 1, 1, 2, 3]))]
        return f' {self.r.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else ""

    def wrapped(self, html: str) -> str:
        """The element in up to three more, whose names say nothing."""
        for _ in range(self.r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            tag = self.r.choice(["div", "div", "div", "div", "section"])
            html = f"<{tag}{self.neutral()}>{html}</{tag}>"
        return html

    def word(self) -> str:
        if self.own:
            return self.r.choice(self.own)
        if self.r.random() < 0.35:
            return self.r.choice(COMMON)
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, cue: str = "") -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if cue and self.r.random() < 0.6:
            for _ in range(self.r.randint(1, 3)):
                out.insert(self.r.randint(0, len(out)), self.r.choice(CUES[cue]))
        return " ".join(out)

    def sentences(self, low: int, high: int, cue: str = "") -> str:
        junk = self.r.random() < 0.08
        out = []
        for _ in range(self.r.randint(low, high)):
            text = self.words(2, 18, cue).capitalize()
            if junk:
                text = " ".join(self.noisy(word) for word in text.split())
            out.append(text + self.r.choice([".", ".", ".", "!", "?"]))
        if self.r.random() < 0.05:
            out = out[:1] * self.r.randint(2, 12)
        return " ".join(out)

    def noisy(self, word: str) -> str:
        """The word with any ASCII punctuation in it, in capitals, or with digits."""
        k = self.r.random()
        if k < 0.4:
            at = self.r.randint(0, len(word))
            return word[:at] + escape("".join(self.r.choice(punctuation) for _ in range(self.r.randint(1, 4)))) + word[at:]
        if k < 0.5:
            return f"{word} {escape(self.r.choice(punctuation))}"
        return word.upper() if k < 0.6 else word + str(self.r.randint(0, 9999)) if k < 0.7 else f"{word} {word} {word}" if k < 0.75 else word

    def prose(self) -> str:
        if self.r.random() < 0.15:
            return self.sentences(1, 1)
        return self.sentences(1, 9)

    def rich(self, text: str) -> str:
        """The text with some of its words in inline elements, of which some are never closed, and line breaks."""
        words = text.split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            a = self.r.randrange(len(words))
            b = self.r.randint(a, len(words) - 1)
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a", "code", "u", "mark", "small", "font"])
            words[a] = f'<a href="/{a}">{words[a]}' if tag == "a" else f"<{tag}>{words[a]}"
            if self.r.random() < 0.9:
                words[b] += f"</{tag}>"
        if self.r.random() < 0.08:
            words.insert(self.r.randint(0, len(words)), self.r.choice(["<br>", "<br/>", "<wbr>", '<img src="x">']))
        return " ".join(words)

    def style(self) -> str:
        """A style sheet or script of any rules, or none."""
        if self.r.random() < 0.4:
            return ""
        body = "".join(f".{self.word()}{{{self.word()}:{self.r.randint(0, 99)}px}}" for _ in range(self.r.randint(0, 4)))
        script = f'<script>if(a<b){{{self.word()}("<p>{self.word()}")}}</script>' if self.r.random() < 0.5 else ""
        return f"<style>{body}</style>{script}"

    def attributes(self, kind: str) -> str:
        if self.r.random() < 0.1:
            return ""
        names = [self.name(self.r.choice(NAMES[kind]))]
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            names.insert(self.r.randint(0, 1), self.word() if self.r.random() < 0.5 else self.name(self.r.choice(NEUTRAL)))
        role = f' role="{ROLES[kind]}"' if kind in ROLES and self.r.random() < 0.15 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{" ".join(names)}"{role}'

    def links(self, cue: str) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3, cue)}</a>' for k in range(self.r.randint(2, 9))]
        style = self.r.random()
        if style < 0.6:
            own = self.neutral() if self.r.random() < 0.3 else ""
            return f"<ul{self.neutral() if self.r.random() < 0.3 else ''}>" + "".join(f"<li{own}>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" ", " | ", "", "<br>"]).join(items) if style < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def skip(self) -> str:
        """Links and lines of a page's own that stand alone."""
        text = self.words(1, 4, self.r.choice(["nav", "footer", "form"]))
        return self.r.choice([f'<a href="#x"{self.neutral()}>{text}</a>', f"<div{self.attributes('header')}>{text}</div>", f"<button{self.neutral()}>{text}</button>"])

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{self.attributes('nav') if tag == 'div' or self.r.random() < 0.4 else ''}>{self.links('nav')}</{tag}>"

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", f"<p>{self.words(2, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>'])
        if self.r.random() < 0.4:
            inner = f'<{self.r.choice(["p", "div", "h1", "span"])}{self.neutral()}><a href="/">{self.words(1, 3)}</a></{self.r.choice(["p", "div"])}><p{self.neutral()}>{self.words(2, 7)}</p>'
        tag = self.r.choice(["header", "header", "div"])
        return f"<{tag}{self.attributes('header')}>{inner}{self.nav() if self.r.random() < 0.4 else ''}</{tag}>"

    def ad(self) -> str:
        text = self.sentences(1, 3, "ad") if self.r.random() < 0.75 else f'<a href="/x">{self.words(2, 8, "ad")}</a>'
        text = self.words(1, 2, "ad") if self.r.random() < 0.15 else text
        tag = self.r.choice(["div", "div", "div", "aside", "section", "p"])
        if tag != "p" and self.r.random() < 0.4:
            text = f"<p>{text}</p>" if self.r.random() < 0.7 else f"<span>{text}</span>"
        return f'<{tag} class="{self.name(self.r.choice(NAMES["ad"]))}">{text}</{tag}>'

    def notice(self) -> str:
        button = f"<button>{self.words(1, 2, 'notice')}</button>" if self.r.random() < 0.5 else ""
        text = self.sentences(1, 3, "notice")
        tag = self.r.choice(["div", "div", "section", "aside", "dialog"])
        if self.r.random() < 0.5:
            text = f"<p>{text}</p>"
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.name(self.r.choice(NAMES["notice"]))}">{text}{button}</{tag}>'

    def form(self) -> str:
        text = self.words(1, 12, "form")
        field = self.r.choice(['<input name="q">', "<textarea></textarea>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>"])
        return f"<form{self.attributes('form')}>{self.r.choice(['<label>%s</label>', '<p>%s</p>', '%s']) % text}{field}<button>{self.words(1, 2, 'form')}</button></form>"

    def side(self) -> str:
        body = "".join(
            self.r.choice([f"<h3>{self.words(1, 4, 'side')}</h3>{self.links('side')}", f"<p>{self.sentences(1, 3, 'side')}</p>", self.ad(), f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 2)}</p>"])
            for _ in range(self.r.randint(1, 3))
        )
        tag = self.r.choice(["aside", "aside", "div", "section"])
        bare = tag == "aside" and self.r.random() < 0.5
        return f"<{tag}{'' if bare else f' class={chr(34)}{self.name(self.r.choice(NAMES["side"]))}{chr(34)}'}>{body}</{tag}>"

    def comments(self) -> str:
        name = self.name(self.r.choice(NAMES["comment"]))
        inner = self.r.choice(["li", "div", "article", "p", "blockquote"])
        items = []
        for _ in range(self.r.randint(1, 6)):
            text = self.sentences(1, 5, "comment")
            who = f"<{self.r.choice(['b', 'h4', 'span', 'cite'])}>{self.words(1, 2)}</b>" if self.r.random() < 0.4 else ""
            items.append(f"<{inner}{' class=comment' if self.r.random() < 0.6 else ''}>{who}{text if inner == 'p' or self.r.random() < 0.4 else f'<p>{text}</p>'}</{inner}>")
        outer = self.r.choice(["section", "div", "div", "ol" if inner == "li" else "aside"])
        head = f"<h{self.r.randint(2, 4)}>{self.words(1, 3, 'comment')}</h3>" if self.r.random() < 0.6 else ""
        return f'<{outer} {self.r.choice(["class", "id"])}="{name}" data-main="0">{head}{self.wrapped("".join(items)) if outer != "ol" else "".join(items)}{self.form() if self.r.random() < 0.2 else ""}</{outer}>'

    def footer(self) -> str:
        inner = self.r.choice([self.words(2, 10, "footer"), f"<p>{self.sentences(1, 2, 'footer')}</p>", self.links("footer"), f"&copy; {self.word()} &middot; {self.sentences(1, 2)}"])
        tag = self.r.choice(["footer", "footer", "div"])
        return f"<{tag}{self.attributes('footer') if tag == 'div' else ''}>{inner}</{tag}>"

    def noise(self) -> str:
        return self.r.choice([self.ad, self.ad, self.notice, self.form, self.side, self.comments])()

    def main_part(self) -> str:
        k = self.r.random()
        end = "" if self.r.random() < 0.15 else "</p>"
        if k < 0.62:
            return f"<p>{self.rich(self.prose())}{end}"
        if k < 0.72:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if k < 0.79:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.rich(self.words(2, 14))}{'</li>' if end else ''}" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if k < 0.83:
            return f"<blockquote>{self.prose()}</blockquote>"
        if k < 0.86:
            return f"<figure><img src=x alt=y><figcaption>{self.words(2, 10)}</figcaption></figure>"
        if k < 0.89:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(2)) + "</table>"
        if k < 0.92:
            return f"<pre>{self.words(3, 12)}</pre>"
        return f"<div>{self.prose()}</div>"

    def main(self) -> str:
        title = f"<h1>{self.words(1, 10).capitalize()}</h1>" if self.r.random() < 0.8 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [self.main_part() for _ in range(self.r.choice([1, 2, 3, 5, 8, 13, 20]))]
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            extra = self.r.choice([self.ad, self.form, self.side, self.notice, self.comments])()
            at = extra.index(">")
            extra = extra if "data-main" in extra[:at] else f'{extra[:at]} data-main="0"{extra[at:]}'
            parts.insert(self.r.randint(0, len(parts)), extra)
        text = "".join(parts)
        body, k = title + (self.wrapped(text) if self.r.random() < 0.5 else text), self.r.random()
        role = ' role="main"' if self.r.random() < 0.1 else ""
        if k < 0.5:
            out = f'<article data-main="1"{role}{self.neutral() if self.r.random() < 0.5 else ""}>{self.wrapped(body)}</article>'
            return f"<main>{out}</main>" if self.r.random() < 0.3 else out
        if k < 0.65:
            return f'<main data-main="1"{role}{self.neutral() if self.r.random() < 0.5 else ""}>{self.wrapped(body)}</main>'
        tag = self.r.choice(["div", "div", "section"])
        body = self.wrapped(body)
        own, other = self.r.sample(["class", "id"], 2)
        more = f' {other}="{self.name(self.r.choice([*NEUTRAL, self.word()]))}"' if self.r.random() < 0.4 else ""
        return f'<{tag} {own}="{self.name(self.r.choice(MAIN_NAMES))}"{more}{role} data-main="1">{body}</{tag}>'

    def table_page(self, before: list[str], main: str, after: list[str]) -> str:
        """A page laid out in a table: a banner, a column beside the text, and what stands below."""
        side, width = self.r.choice(before or [""]), self.r.randint(90, 200)
        head = f"<tr><td colspan=2>{self.r.choice([self.header(), self.words(1, 4), f'<font size=5>{self.words(1, 4)}</font>'])}</td></tr>"
        cells = [f"<td width={width} valign=top>{side or self.links('nav')}</td>", f"<td valign=top>{main}</td>"]
        foot = "".join(f"<tr><td colspan=2>{part}</td></tr>" for part in after) or f"<tr><td>{self.words(2, 9, 'footer')}</td></tr>"
        return f"<table width=100%>{head if self.r.random() < 0.8 else ''}<tr>{''.join(cells if self.r.random() < 0.8 else cells[::-1])}</tr>{foot}</table>"

    def unnamed(self, html: str) -> str:
        """The page with names that say nothing in place of all classes and ids."""
        made: dict[str, str] = {}
        return NAMED.sub(lambda m: f" {m[1]}=" + made.setdefault(m[2], "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=self.r.randint(2, 6)))), html)

    def page(self) -> str:
        r = self.r
        unnamed = r.random() < 0.05  # nothing tells comments from text there, so there are none
        before = [f() for f, p in ((self.skip, 0.15), (self.notice, 0.15), (self.header, 0.45), (self.nav, 0.75), (self.form, 0.15), (self.ad, 0.4), (self.side, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0 if unnamed else 0.3), (self.ad, 0.2), (self.side, 0.3), (self.form, 0.15), (self.nav, 0.15), (self.footer, 0.75), (self.notice, 0.1), (self.skip, 0.1)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        main = self.main() if r.random() > 0.03 else ""
        if r.random() < 0.06:
            inner = self.table_page(before, main, after)
        else:
            cut = r.randint(0, len(after)) if r.random() < 0.3 else 0  # some stand in one element with the text
            middle = "".join(map(self.wrapped, [main, *after[:cut]]))
            if cut or r.random() < 0.2:
                tag = r.choice(["div", "div", "main", "section"])
                middle = f"<{tag}{self.neutral()}>{middle}</{tag}>"
            parts = [*map(self.wrapped, before), middle, *map(self.wrapped, after[cut:])]
            inner = "".join(parts if r.random() > 0.08 else [*parts[len(before) :], *parts[: len(before)]])  # some have the text first
        if r.random() < 0.4:
            inner = f"<div{self.neutral()}>{inner}</div>"
        end = "</body></html>" if r.random() < 0.8 else ""
        body = f"<body{self.neutral() if r.random() < 0.4 else ''}>{inner}"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 10)}</title>{self.style()}</head>{self.unnamed(body) if unnamed else body}{end}"


def training_pages(n: int, seed: int = 3) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
