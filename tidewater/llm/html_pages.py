"""Labelled pages for fitting the extractor, composed by a seeded grammar: layouts, containers with and without telling names,
articles of one word to thousands, and all that stands around them. Words of what is no article end in NOT_ARTICLE.

No table labels the nodes of pages, so the extractor learns from these. The lists are fixed values: names that
web pages commonly give to their parts.
"""

from __future__ import annotations

import random

NOT_ARTICLE = ""
ARTICLE_NAMES = "content article post entry story body text main entry-content post-content article-body story-body page-content post-body main-content article-text copy single".split()
WRAPPER_NAMES = "wrapper container page site app root layout row col inner wrap outer grid block module".split()
AROUND_NAMES = {
    "nav": "nav navigation menu navbar topnav breadcrumb breadcrumbs pagination pager tabs links toc site-nav main-menu".split(),
    "header": "header masthead top topbar site-header banner branding logo".split(),
    "footer": "footer foot bottom site-footer copyright colophon legal".split(),
    "side": "sidebar side aside widget rail secondary right-column related recommended popular trending archive tags categories".split(),
    "notice": "cookie notice consent gdpr alert banner message cookie-banner privacy popup modal overlay toast warning disclaimer".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot banner-ad dfp partner".split(),
    "form": "form search newsletter subscribe signup login contact search-form".split(),
    "comments": "comments comment respond reply discussion disqus comment-list comment-body thread responses feedback".split(),
    "share": "share social sharing follow buttons share-links likes meta-tools".split(),
}
INLINE = "b i em strong span code u small a mark".split()


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.letters = r.choice(["etaoinshrdlu", "aeiounrstldmké", "abcdefghijklmnopqrstuvwxyz", "аеиностврлкм", "的一是不了人我在有他", "enisratdhuüöß"])
        self.ends = r.choice(["", "", "", " |", "***", "###", ",", "1"])
        self.named = r.random() < 0.75

    def word(self, mark: str) -> str:
        r = self.r
        w = "".join(r.choices(self.letters, k=r.randint(1, 9)))
        return (w.capitalize() if r.random() < 0.08 else w) + (r.choice(",.;:") if r.random() < 0.12 else "") + mark

    def words(self, n: int, mark: str = "") -> str:
        ends = self.ends if not mark else ""
        return " ".join(self.word(mark) + (ends if self.r.random() < 0.3 else "") for _ in range(n)) + ("." if self.r.random() < 0.7 and n > 3 else "")

    def some(self, most: int) -> int:
        """From 1, mostly few."""
        return 1 + int(most * self.r.random() ** 3)

    def marked(self, n: int, mark: str = "") -> str:
        """Words with inline elements among them."""
        r, out = self.r, []
        while n > 0:
            k = min(n, self.some(40))
            text = self.words(k, mark)
            if r.random() < 0.2:
                tag = r.choice(INLINE)
                text = f'<{tag} href="/x">{text}</{tag}>' if tag == "a" else f"<{tag}>{text}</{tag}>" if r.random() < 0.9 else f"<{tag}>{text}"
            out.append(text)
            n -= k
        return r.choice([" ", " ", "<br>", "\n"]).join(out)

    def name(self, part: str | None, sure: bool = False) -> str:
        r = self.r
        names = ARTICLE_NAMES if part == "article" else WRAPPER_NAMES if part is None else AROUND_NAMES[part]
        if not sure and r.random() > (0.85 if self.named else 0.3):
            return ""
        made = " ".join(r.sample(names, r.choice([1, 1, 1, 2])) + (r.sample(WRAPPER_NAMES, 1) if r.random() < 0.2 else []))
        return f' {r.choice(["class", "class", "id"])}="{made}{r.choice(["", "", "-" + str(r.randint(1, 99))])}"'

    def links(self, n: int, part: str) -> str:
        r, m = self.r, NOT_ARTICLE
        items = [f'<a href="/{k}">{self.words(r.choice([1, 1, 2, 6]), m)}</a>' for k in range(n)]
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.9 else "") for x in items) + "</ul>"
        return r.choice([f" |{m} ", " ", f" &middot;{m} ", "\n"]).join(items)

    # what stands around an article

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        body = self.links(self.r.randint(2, 12), "nav")
        return f"<nav>{body}</nav>" if tag == "nav" else f"<div{self.name('nav', True)}>{body}</div>"

    def header(self) -> str:
        r, m = self.r, NOT_ARTICLE
        inner = r.choice([f'<a href="/">{self.words(2, m)}</a>', f"<h1>{self.words(r.randint(1, 4), m)}</h1>", f"<div{self.name('header')}>{self.words(2, m)}</div><p>{self.words(r.randint(2, 9), m)}</p>"])
        inner += self.nav() if r.random() < 0.5 else ""
        return f"<header{self.name('header')}>{inner}</header>" if r.random() < 0.7 else f"<div{self.name('header', True)}>{inner}</div>"

    def footer(self) -> str:
        r, m = self.r, NOT_ARTICLE
        inner = r.choice(["&copy; ", "", "(c) 2020 "]) + f"x{m}.example {r.choice(['&middot; ', '- ', ''])}" + self.marked(r.randint(1, 40), m)
        inner = r.choice([inner, f"<p>{inner}</p>", self.links(r.randint(2, 9), "footer") + f"<p>{inner}</p>"])
        return f"<footer{self.name('footer')}>{inner}</footer>" if r.random() < 0.75 else f"<div{self.name('footer', True)}>{inner}</div>"

    def side(self) -> str:
        r, m, out = self.r, NOT_ARTICLE, []
        for _ in range(r.randint(1, 4)):
            what = r.choice([self.links(r.randint(2, 9), "side"), f"<p>{self.marked(r.randint(3, 60), m)}</p>", self.advert(), self.form()])
            out.append(f"<div{self.name('side')}>{r.choice(['', f'<h3>{self.words(2, m)}</h3>'])}{what}</div>")
        return f"<aside{self.name('side')}>{''.join(out)}</aside>" if r.random() < 0.6 else f"<div{self.name('side', True)}>{''.join(out)}</div>"

    def notice(self) -> str:
        r, m = self.r, NOT_ARTICLE
        tag = r.choice(["div", "div", "section", "p", "aside", "dialog"])
        inner = self.marked(r.randint(4, 70), m)
        inner = r.choice([inner, f"<p>{inner}</p>"]) if tag != "p" else inner
        button = r.choice(["", f"<button>{self.words(1, m)}</button>", f'<a href="#" class="button">{self.words(1, m)}</a>'])
        return f"<{tag}{self.name('notice', True)}{r.choice(['', '', ' hidden'])}>{inner}{button}</{tag}>"

    def advert(self) -> str:
        r, m = self.r, NOT_ARTICLE
        tag = r.choice(["div", "div", "div", "aside", "section", "p", "ins"])
        inner = self.marked(r.randint(1, 40), m)
        inner = r.choice([inner, inner, f'<a href="http://x">{inner}</a>', f"<p>{inner}</p>"]) if tag not in ("p", "ins") else inner
        return f"<{tag}{self.name('advert', True)}>{inner}</{tag}>"

    def form(self) -> str:
        r, m = self.r, NOT_ARTICLE
        inner = f"<label>{self.words(r.randint(1, 5), m)}</label><input name=q><button>{self.words(1, m)}</button>"
        inner = r.choice(["", f"<p>{self.words(r.randint(3, 25), m)}</p>", f"<h3>{self.words(3, m)}</h3>"]) + inner
        out = f"<form{self.name('form')} action='/s'>{inner}</form>"
        return out if r.random() < 0.6 else f"<div{self.name('form')}>{out}</div>"

    def comments(self) -> str:
        r, m, out = self.r, NOT_ARTICLE, []
        tag = r.choice(["div", "li", "article", "section"])
        for _ in range(self.some(12)):
            body = "".join(f"<p>{self.marked(self.some(90), m)}</p>" for _ in range(self.some(4)))
            who = r.choice(["b", "cite", "h4", "p"])
            out.append(f"<{tag}{self.name('comments', tag == 'article')}><{who}>{self.words(1, m)}</{who}>{body}" + r.choice(["", f'<a href="#">{self.words(1, m)}</a>']) + f"</{tag}>")
        inner = r.choice(["", f"<h2>{self.words(r.randint(1, 3), m)}</h2>"]) + ("<ol>" + "".join(out) + "</ol>" if tag == "li" else "".join(out)) + (self.form() if r.random() < 0.5 else "")
        return self._boxed("comments", inner)

    def _boxed(self, part: str, inner: str) -> str:
        tag = self.r.choice(["div", "section", "aside"] if part != "comments" else ["div", "section"])
        return f"<{tag}{self.name(part, True)}>{inner}</{tag}>"

    def share(self) -> str:
        return self._boxed("share", self.links(self.r.randint(2, 6), "share"))

    def related(self) -> str:
        r, m = self.r, NOT_ARTICLE
        return self._boxed("side", f"<h3>{self.words(2, m)}</h3>" + r.choice([self.links(r.randint(2, 6), "side"), "".join(f'<div><h4><a href="/">{self.words(6, m)}</a></h4><p>{self.words(r.randint(5, 30), m)}</p></div>' for _ in range(3))]))

    # the article

    def paragraph(self) -> str:
        r = self.r
        text = self.marked(r.choice([self.some(8), self.some(60), self.some(160)]))
        return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p class="{r.choice(["lead", "intro", "p1", "text"])}">{text}</p>'])

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.78:
            return self.paragraph()
        few = lambda tag: "".join(f"<{tag}>{self.marked(self.some(25))}</{tag}>" for _ in range(r.randint(1, 6)))
        made = [f"<h2>{self.words(r.randint(1, 8))}</h2>", f"<ul>{few('li')}</ul>", f"<ol>{few('li')}</ol>", f"<blockquote>{self.paragraph()}</blockquote>", f"<table><tr>{few('td')}</tr><tr>{few('td')}</tr></table>"]
        made += [f"<pre>{self.words(r.randint(2, 40))}</pre>", f"<figure><img src=x><figcaption>{self.words(r.randint(2, 15))}</figcaption></figure>", f"<dl><dt>{self.words(2)}<dd>{self.words(9)}</dl>", f"<section>{self.paragraph()}{self.paragraph()}</section>", f"<div>{self.marked(self.some(80))}</div>"]
        return r.choice(made)

    def article(self, inside: bool) -> str:
        r = self.r
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 14])
        out = [f"<h1>{self.words(r.randint(1, 12))}</h1>"] if r.random() < 0.85 or not n else []
        if r.random() < 0.1:
            out.append(self.marked(self.some(200)))
        out += [self.block() for _ in range(n)]
        if inside and r.random() < 0.4:
            for _ in range(r.randint(1, 2)):
                what = r.choice([self.advert, self.share, self.related, self.comments, self.form, self.notice])
                out.insert(r.randint(1, len(out)) if what not in (self.comments,) else len(out), what())
        return r.choice(["", "\n", "\n  "]).join(out)

    def page(self) -> str:
        r, m = self.r, NOT_ARTICLE
        if r.random() < 0.04:
            return r.choice([self.article(False), self.marked(self.some(80)), "<body>" + self.article(False)])
        box = r.random()
        if box < 0.45:
            own = f"<article{self.name('article') if r.random() < 0.5 else ''}>{self.article(True)}</article>"
        elif box < 0.6:
            own = f"<main{self.name('article') if r.random() < 0.4 else ''}>{self.article(True)}</main>"
        elif box < 0.7:
            own = f"<main><article>{self.article(True)}</article>{r.choice([self.comments, self.related, str])()}</main>"
        elif box < 0.93:
            own = f"<{r.choice(['div', 'div', 'section'])}{self.name('article', True)}>{self.article(True)}</div>"
        else:
            own = f"<div{self.name(None)}>{self.article(False)}</div>"
        maybe = lambda chance, *parts: [r.choice(parts)()] if r.random() < chance else []
        before = maybe(0.45, self.header) + maybe(0.6, self.nav) + maybe(0.35, self.notice, self.advert) + maybe(0.35, self.advert) + maybe(0.15, self.side, self.form)
        after = maybe(0.3, self.side) + maybe(0.3, self.comments, self.comments, self.related) + maybe(0.2, self.form, self.share, self.advert) + maybe(0.75, self.footer) + maybe(0.1, self.notice)
        if r.random() < 0.4:
            # article and side columns in a wrapper
            k = r.randint(0, len(after))
            own, after = f"<div{self.name(None)}>{own}{''.join(after[:k])}</div>", after[k:]
        body = r.choice(["", "\n", "<!-- x -->"]).join([*before, own, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.name(None)}>{body}</div>"
        head = f"<!DOCTYPE html><html><head><title>{self.words(4, m)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{self.name(None)}>"
        return head + body + r.choice(["</body></html>", ""])


def pages(n: int, seed: int) -> list[str]:
    return [Grammar(seed * 1_000_003 + k).page() for k in range(n)]
