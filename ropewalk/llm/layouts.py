"""Generated pages with known main text, to train the extractor on.

The page tables carry no labels, so layouts are drawn by a seeded generator: frames, columns, tables or flat pages; menus,
headers, footers, sidebars, notices, adverts, forms, related links and reader comments around and inside an article, with
telling, neutral or no names, unclosed tags, cut pages and articles of one word to dozens of paragraphs. A character for
private use marks every run of article text.
"""

from __future__ import annotations

import random

MARK = "\ue000"

# Names that authors of pages give to such parts.
NAMES = {
    "nav": "nav navbar menu main-menu navigation topbar tabs breadcrumb breadcrumbs pager pagination site-links toc skip",
    "header": "header site-header masthead banner logo branding top page-header hero-bar",
    "footer": "footer site-footer bottom copyright colophon legal credits foot",
    "side": "sidebar side rail right-column left-column widget widgets aside secondary related popular recent archives categories tags tagcloud blogroll trending",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message subscribe paywall announcement disclaimer privacy toast",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion ad-slot ad-container banner-ad commercial dfp adbox",
    "form": "search search-form login signup newsletter contact-form register",
    "comments": "comments comment-list comment-section discussion responses replies disqus respond reviews user-comments",
    "comment": "comment reply response comment-body review user-comment",
    "more": "related more read-more recommended share social sharing tags meta-links author-box next-prev also-like teaser",
    "main": "main content main-content primary page-content container-main center column-main site-content",
    "article": "article post entry story article-body entry-content post-content text body news-article blog-post story-body article-content main-text",
    "plain": "box block wrapper container row col inner outer section c1 x7 item grid css-a1b2 module clearfix layout",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SYLLABLES = "ba ne ti ro su la mi ko ver en the an ing er st al on re ion ent qu ch".split()


class Layout:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = self.r.choice([1.0, 1.0, 0.9, 0.6, 0.2])   # how often parts bear telling names
        self.semantic = self.r.choice([1.0, 0.7, 0.3, 0.0])     # how often the page uses elements made for the part
        self.letters = self.r.choice(["", "", "éàç", "äöüß", "日本語", "яжд"])

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice([1, 1, 2, 2, 3, 4])))
        return w + self.r.choice(self.letters) if self.letters and self.chance(0.3) else w

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        s = self.words(self.r.randint(1, self.r.choice([4, 12, 25])))
        s = ", ".join(s.split(" ", 1)) if self.chance(0.3) else s
        return s.capitalize() + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def sentences(self, least: int, most: int) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(least, most)))
        if self.chance(0.05):
            out = " ".join(w + self.r.choice(["", "***", "###", "%%%", "&amp;"]) for w in out.split())
        return out.replace(". ", self.r.choice([". ", ".\n", ". "]))

    def attributes(self, kind: str) -> str:
        if not self.chance(self.named):
            return f' class="{self.r.choice(NAMES["plain"])}"' if self.chance(0.5) else ""
        name = self.r.choice(NAMES[kind])
        if self.chance(0.15):
            name = f"{self.r.choice(NAMES['plain'])}-{name}" if self.chance(0.5) else f"{name}{self.r.randint(1, 9)}"
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def telling(self, kind: str) -> str:
        return f' class="{self.r.choice(NAMES[kind])}"'

    def part(self, kind: str, inner: str, tags: str, own: str) -> str:
        """An element for a part: its own tag if the page is semantic, else a neutral one."""
        if self.chance(self.semantic):
            return f"<{own}{self.attributes(kind) if self.chance(0.3) else ''}>{inner}</{own}>"
        tag = self.r.choice(tags.split())
        return f"<{tag}{self.attributes(kind)}>{inner}</{tag}>"

    def link(self, n: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(self.r.randint(1, n))}</a>'

    def link_list(self, n: int) -> str:
        items = [self.link() for _ in range(self.r.randint(2, n))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; ", "<br>"]).join(items)

    def nav(self) -> str:
        return self.part("nav", self.link_list(9), "div div ul", "nav")

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(2)}</h1>", f"<a href='/'>{self.words(2)}</a>", f"<p>{self.words(4)}</p>",
                               f"<div>{self.words(2)}</div><p>{self.sentence()}</p>"])
        return self.part("header", inner + (self.nav() if self.chance(0.4) else ""), "div div table", "header").replace("<table", "<div").replace("</table", "</div")

    def footer(self) -> str:
        inner = f"&copy; {self.words(2)} &middot; {self.sentences(1, 2)}"
        if self.chance(0.5):
            inner = f"<p>{inner}</p>" + (self.link_list(6) if self.chance(0.6) else "")
        return self.part("footer", inner, "div div p", "footer")

    def notice(self) -> str:
        inner = self.sentences(1, 3) + self.r.choice(["", " <button>OK</button>", f" <a href='#'>{self.word()}</a>"])
        inner = f"<p>{inner}</p>" if self.chance(0.5) else inner
        hidden = self.r.choice(["", "", ' style="display:none"', " hidden", ' role="alert"', ' role="dialog"'])
        tag = self.r.choice(["div", "div", "section", "aside"])
        return f"<{tag}{self.attributes('notice')}{hidden}>{inner}</{tag}>"

    def ad(self) -> str:
        inner = self.r.choice([self.sentences(1, 2), self.sentences(1, 4), self.link(5), f"<p>{self.sentences(1, 2)}</p>",
                               f"<img src='a.png'>{self.words(3)}"])
        tag = self.r.choice(["div", "div", "div", "aside", "section", "p"])
        return self.r.choice(["", "<!-- ad -->"]) + f"<{tag}{self.telling('ad') if tag == 'p' else self.attributes('ad')}>{inner}</{tag}>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(2)}</label><input name='{self.word()}'>" for _ in range(self.r.randint(1, 4)))
        fields += self.r.choice(["", f"<select><option>{self.word()}</select>", "<textarea></textarea>"])
        return f"<form{self.attributes('form')}>{self.r.choice(['', f'<h3>{self.words(2)}</h3>', f'<p>{self.sentence()}</p>'])}{fields}<button>{self.word()}</button></form>"

    def side(self) -> str:
        some = [self.r.choice([lambda: f"<h3>{self.words(2)}</h3>{self.link_list(7)}", self.ad, self.form,
                               lambda: f"<p>{self.sentences(1, 3)}</p>", lambda: f"<h4>{self.words(2)}</h4><p>{self.sentences(1, 2)}</p>",
                               lambda: "".join(f"<div><a href='/x'>{self.sentence()}</a><p>{self.sentences(1, 2)}</p></div>" for _ in range(3))])()
                for _ in range(self.r.randint(1, 4))]
        return self.part("side", "".join(some), "div div div", "aside")

    def comments(self) -> str:
        each = self.r.choice(["div", "li", "article", "section"])
        one = lambda: (f"<{each}{self.attributes('comment')}>" + self.r.choice(["", f"<b>{self.word()}</b> ", f"<span>{self.words(2)} {self.r.randint(1, 28)}</span>"])
                       + "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 2)))
                       + (f"<a href='#'>{self.word()}</a>" if self.chance(0.5) else "") + f"</{each}>")
        inner = f"<h{3}>{self.r.randint(1, 99)} {self.word()}</h3>" if self.chance(0.7) else ""
        inner += "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.chance(0.5) else "")
        kept = self.named
        self.named = max(self.named, 0.9)  # nothing but the name tells a comment from an article
        tag = self.r.choice(["div", "section", "ol" if each == "li" else "div"])
        out = f"<{tag}{self.attributes('comments')}>{inner}</{tag}>"
        self.named = kept
        return out

    def more(self) -> str:
        inner = self.r.choice([f"<h4>{self.words(2)}</h4>", ""]) + self.link_list(6)
        return self.part("more", inner, "div div section", self.r.choice(["aside", "div"]))

    def inline(self, text: str) -> str:
        """Links and emphasis in article text; every run keeps its mark at the front."""
        w = text.split(" ")
        if len(w) > 3 and self.chance(0.4):
            i = self.r.randrange(len(w) - 1)
            tag = self.r.choice(["b", "em", "a href='/x'", "i", "strong", "span", "code"])
            w[i] = f"<{tag}>{w[i]}</{tag.split()[0]}>"
        if len(w) > 6 and self.chance(0.1):
            w[len(w) // 2] += "<br>"
        return MARK + " ".join(w)

    def paragraph(self) -> str:
        text = self.inline(self.sentences(1, self.r.choice([1, 3, 9])))
        return self.r.choice([f"<p>{text}</p>"] * 12 + [f"<p>{text}", f"<p><b>{text}<br>", f"<p class='{self.word()}'>{text}</p>"])

    def article(self) -> str:
        size = self.r.choice([1, 1, 2, 3, 5, 8, 14, 25, 40])
        paragraph = self.paragraph
        if self.chance(0.12):
            paragraph = lambda: f"<div>{self.inline(self.sentences(1, 6))}</div>"
        rare = [lambda: f"<h{self.r.randint(2, 4)}>{MARK}{self.words(self.r.randint(1, 6))}</h2>",
                lambda: "<ul>" + "".join(f"<li>{self.inline(self.sentence())}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>",
                lambda: f"<blockquote><p>{self.inline(self.sentences(1, 3))}</p></blockquote>",
                lambda: f"<figure><img src='x.jpg'><figcaption>{self.inline(self.sentence())}</figcaption></figure>",
                lambda: f"<pre>{MARK}{self.sentences(1, 3)}</pre>",
                lambda: "<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{MARK}{self.r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>"]
        body = [paragraph() if i == 0 or self.chance(0.85) else self.r.choice(rare)() for i in range(size)]
        kept, self.named = self.named, max(self.named, 0.9)  # inside an article nothing but a name tells such parts
        for extra, p in ((self.ad, 0.15), (self.more, 0.08), (lambda: "<script>var a = '<p>';</script>", 0.1)):
            if self.chance(p):
                body.insert(self.r.randint(1, len(body)), extra())
        self.named = kept
        title = f"<h1>{MARK}{self.words(self.r.randint(1, 9)).capitalize()}{self.r.choice(['', '.'])}</h1>" if self.chance(0.85) else ""
        if title and self.chance(0.12):
            title = f"<header>{title}<p>{MARK}{self.words(3)} {self.r.randint(1, 28)}</p></header>"
        text = "".join(body)
        if title and self.chance(0.3):
            text = f"<div{self.attributes('article')}>{text}</div>"
        for extra, p in ((self.more, 0.15), (self.comments, 0.06), (self.form, 0.04)):
            if self.chance(p):
                text += extra()
        how = self.r.random()
        if how < 0.12:
            return title + text
        return self.part("article", title + text, "div div div section td", "article").replace("<td", "<div").replace("</td", "</div")

    def page(self) -> str:
        r = self.r
        main = [self.article()] if self.chance(0.95) else []
        for extra, p in ((self.ad, 0.15), (self.notice, 0.1), (self.nav, 0.15)):
            if self.chance(p):
                main.insert(0, extra())
        for extra, p in ((self.more, 0.25), (self.comments, 0.3), (self.ad, 0.15), (self.form, 0.1)):
            if self.chance(p):
                main.append(extra())
        middle = "".join(main)
        if self.chance(0.5):
            middle = self.part("main", middle, "div div section", "main")
        sides = [self.side() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        parts = sides[:1] + [middle] + sides[1:] if self.chance(0.5) else [middle] + sides
        if self.chance(0.08):
            middle = "<table><tr>" + "".join(f"<td>{p}</td>" for p in parts) + "</tr></table>"
        else:
            middle = "".join(parts)
            for _ in range(r.choice([0, 0, 1, 2])):
                middle = f"<div{self.attributes('plain')}>{middle}</div>"
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.6), (self.notice, 0.2), (self.ad, 0.3), (self.form, 0.15))
                  if self.chance(p)]
        after = [f() for f, p in ((self.ad, 0.1), (self.more, 0.1), (self.footer, 0.75), (self.notice, 0.2)) if self.chance(p)]
        body = "".join(before) + middle + "".join(after)
        if self.chance(0.04):
            body = f"<form action='/'>{body}</form>"
        if self.chance(0.2):
            body = f"<div id='page'>{body}</div>"
        head = f"<head><meta charset='utf-8'><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        html = f"<!DOCTYPE html><html>{head}<body>{body}"
        return html + ("</body></html>" if self.chance(0.9) else "")


def page(seed: int) -> str:
    return Layout(seed).page()
