"""Labelled training pages: random layouts in which every element's part (main text or not) is known."""

from __future__ import annotations

import random
from html import escape

#: Noise parts: candidates for tag and class or id; {} is filled with sentences, links or fields.
NOISE = {
    "menu": ([("nav", ""), ("div", "menu"), ("ul", "nav-list"), ("div", "breadcrumb"), ("div", "pagination"), ("div", "")], "links"),
    "header": ([("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header")], "short"),
    "footer": ([("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright")], "short"),
    "side": ([("aside", ""), ("div", "sidebar"), ("section", "related"), ("div", "widget"), ("aside", "rail")], "mixed"),
    "ad": ([("div", "ad"), ("div", "advert"), ("div", "sponsored"), ("section", "promo"), ("div", "banner"), ("aside", "ads")], "sentence"),
    "notice": ([("div", "cookie-notice"), ("div", "notice"), ("div", "newsletter"), ("section", "popup"), ("div", "alert"), ("div", "consent")], "sentence"),
    "form": ([("form", ""), ("form", "search"), ("div", "login-form")], "fields"),
    "comments": ([("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "discussion")], "replies"),
    "share": ([("div", "share"), ("div", "social"), ("ul", "share-links")], "links"),
}
MAIN = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "post-body"), ("section", "entry"), ("div", "story"), ("div", "")]
PARTS = "an be cor dis el fra gre hon in jo ka lor men nis op pre qua ris sen tor un ver wil zu che öl é ñar".split()


class Layout:
    """One page: html, and the gold mark ``data-gold`` on elements that hold main text directly."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(PARTS, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        return escape(" ".join(out))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.r.choice(".....,!?") for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> str:
        row = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in row) + "</ul>" if self.r.random() < 0.6 else " | ".join(row)

    def noise(self, kind: str) -> str:
        r = self.r
        shapes, what = NOISE[kind]
        tag, name = r.choice(shapes)
        attr = f' {r.choice(("class", "id"))}="{name}"' if name else ""
        p = r.choice(("p", "div", "span"))
        if what == "links":
            body = self.links(r.randint(2, 12))
        elif what == "short":
            body = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<{p}>{self.sentences(1, 2)}</{p}>", self.links(r.randint(2, 6)), f"<h2>{self.words(1, 4)}</h2>"))
        elif what == "mixed":
            body = f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(r.randint(2, 8)), f"<p>{self.sentences(1, 4)}</p>"))
        elif what == "sentence":
            body = r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f"<{p}>{self.sentences(1, 2)}</{p}><a href='#'>{self.words(1, 2)}</a>", f"<{p}>{self.sentences(1, 2)}</{p}><button>{self.words(1, 2)}</button>"))
        elif what == "fields":
            body = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + r.choice(("", f"<p>{self.sentences(1, 1)}</p><select><option>{self.words(1, 1)}</option></select>"))
        else:
            one = r.choice(("li", "div", "p", "article"))
            cls = r.choice(('class="comment"', 'class="reply"', ""))
            body = r.choice((f"<h3>{self.words(1, 2)}</h3>", "")) + "".join(f"<{one} {cls}><b>{self.words(1, 2)}</b> <p>{self.sentences(1, 4)}</p></{one}>" for _ in range(r.randint(1, 6)))
        return f"<{tag}{attr}>{body}</{tag}>"

    def main(self) -> str:
        r = self.r
        out = [f'<{h} data-gold>{self.words(2, 9)}</{h}>' for h in (r.choice(("h1", "h1", "h2")),) if r.random() < 0.8]
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.72:
                out.append(f'<p data-gold>{self.marked(self.sentences(1, r.choice((1, 2, 6, 12))))}' + r.choice(("</p>", "</p>", "</p>", "")))
            elif x < 0.8:
                out.append(f'<h2 data-gold>{self.words(1, 6)}</h2>')
            elif x < 0.87:
                out.append(f"<{r.choice(('ul', 'ol'))}>" + "".join(f'<li data-gold>{self.marked(self.sentences(1, 2))}</li>' for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.91:
                out.append(f'<blockquote data-gold>{self.sentences(1, 3)}</blockquote>')
            elif x < 0.94:
                out.append("<table>" + "".join(f'<tr><td data-gold>{self.words(1, 4)}</td><td data-gold>{self.words(1, 4)}</td></tr>' for _ in range(3)) + "</table>")
            else:
                out.append(self.noise(r.choice(("ad", "share", "notice", "side", "form"))))
        return "".join(out)

    def marked(self, text: str) -> str:
        r = self.r
        return r.choice((text, text, text, f"<b>{text}<br>", f"<b data-gold>{text}</b> {self.words(1, 9)}.", f'{text} <a data-gold href="/y">{self.words(1, 5)}</a>.', f"<em data-gold>{self.words(1, 3)}</em> {text}"))

    def page(self) -> str:
        r = self.r
        tag, name = r.choice(MAIN)
        attr = f' {r.choice(("class", "id"))}="{name}"' if name else ""
        body = self.main()
        if r.random() < 0.12:
            body += self.noise("comments")
        block = f"<{tag}{attr}>{body}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            block = f"<div{r.choice(('', ' class=wrap', ' id=page', ' class=container'))}>{block}{self.noise(r.choice(('side', 'ad'))) if r.random() < 0.3 else ''}</div>"
        before = [self.noise(k) for k in ("menu", "header", "ad", "notice", "form") if r.random() < 0.5]
        after = [self.noise(k) for k in ("side", "comments", "share", "form", "ad", "notice", "footer") if r.random() < 0.4]
        if r.random() < 0.03:
            block = ""
        r.shuffle(before)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}{block}{''.join(after)}</body></html>"
