"""Made-up pages with known main text: what the extractor of ``html`` learns from.

Words are random syllables, and class names of two pages in five say nothing or are missing, so structure has to do. ``data-main`` marks the element that holds the article and
``data-not`` what inside it is not part of it; the extractor reads neither as a feature.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tu sha bel on er ti da vos qui ner al est um por ci ge".split()
#: Tags and class words of page parts that are not main text.
PARTS = {
    "nav": (["nav", "div", "ul", "section"], "nav navigation navbar menu topmenu breadcrumb breadcrumbs topnav submenu toc pagination pager skip links toolbar tabs"),
    "header": (["header", "div", "section"], "header masthead banner topbar site branding logo hero tagline"),
    "sidebar": (["aside", "div", "section"], "sidebar side aside widget rail right secondary column panel"),
    "ad": (["div", "aside", "section", "p"], "ad ads advert advertisement adsense sponsored sponsor promo promotion banner dfp outbrain taboola"),
    "notice": (["div", "section", "p", "aside"], "notice cookie cookies consent gdpr alert newsletter subscribe subscription disclaimer popup modal overlay message warning paywall signup privacy policy"),
    "form": (["form", "div", "fieldset"], "form search login contact signup poll survey feedback"),
    "comments": (["section", "div", "ol", "ul", "aside"], "comments comment discussion replies reply responses disqus thread respond reviews reader"),
    "related": (["div", "section", "aside", "ul"], "related recommended recommendations more stories popular trending readmore also latest teaser"),
    "share": (["div", "ul", "p"], "share sharing social tools buttons follow print meta byline tags tag"),
    "footer": (["footer", "div", "section"], "footer foot bottom colophon copyright legal imprint credits sitemap"),
}
#: Class words of the main element, and of wrappers that say nothing.
MAIN = "content article post entry story body main text blog single maincontent articlebody prose page hentry section"
NEUTRAL = "wrapper container row col inner outer grid site layout box wrap block group area flex center clearfix"


class Maker:
    def __init__(self, seed: int, naming: tuple[str, ...] = ("words", "words", "words", "opaque", "none")) -> None:
        """naming: how a page names its elements, one of these at random; only words can be told by what they say."""
        self.r, self.naming = random.Random(seed), naming
        self.style = ""
        self.named = "words"

    def words(self, n: int) -> str:
        r, out = self.r, []
        for k in range(n):
            w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
            out.append(w.capitalize() if k == 0 or r.random() < 0.08 else w)
            if r.random() < 0.1:
                out[-1] += r.choice([".", ",", ".", "!", "?", " &amp;", "&amp;&amp;", "***", "%%%"])
        if self.style == "marks":
            out = [w + r.choice(["***", "$$$", "%%%", "&amp;&amp;&amp;", "###"]) for w in out]
        elif self.style == "capitals":
            out = [w.upper() + "!!" for w in out]
        return (" | " if self.style == "bars" and n > 2 else " ").join(out)

    def attributes(self, words: str, sure: bool = False) -> str:
        r, own = self.r, words.split()
        if self.named == "none":
            return ""
        if self.named == "opaque":  # as generated style sheets name elements
            return f' class="{r.choice(["css-", "", "_", "sc-", "x"])}{"".join(r.choices("abcdefghkmnprstxyz0123456789", k=r.choice([1, 2, 5, 7])))}"' if r.random() < 0.85 else ""
        if not sure and r.random() < 0.25:
            return ""
        name = r.choice(["-", "_", " "]).join(r.sample(own, min(len(own), r.choice([1, 1, 1, 2]))))
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def link(self, n: int) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(n)}</a>'

    def paragraph(self) -> str:
        r = self.r
        parts = []
        for _ in range(r.choice([1, 1, 2, 3])):
            t = self.words(r.choice([1, 1, 3, 3, 8, 20, 40, 90]))
            x = r.random()
            parts.append(self.link(r.randint(1, 4)) if x < 0.1 else f"<{(b := r.choice(['b', 'em', 'i', 'strong', 'span', 'code']))}>{t}</{b}>" if x < 0.2 else t)
        end = "</p>" if r.random() < 0.85 else ""
        lead = r.choice(["", "", "", "<b>", "<br>"])
        return f"<p>{lead}{' '.join(parts)}{end}"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(r.randint(1, 10))}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            x = r.random()
            if x < 0.72:
                out.append(self.paragraph())
            elif x < 0.8:
                out.append(f"<h2>{self.words(r.randint(1, 7))}</h2>")
            elif x < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.words(r.randint(1, 20))}{r.choice(['</li>', ''])}" for _ in range(r.randint(1, 6))) + f"</{tag}>")
            elif x < 0.9:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(r.randint(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.96:
                out.append(f"<figure><img src='x.png'><figcaption>{self.words(r.randint(2, 12))}</figcaption></figure>")
            elif x < 0.98:
                out.append(f"<pre>{self.words(15)}</pre>")
            else:
                out.append(f"<div>{self.words(r.randint(5, 60))}</div>")
            if r.random() < 0.06:
                out.append(self.part(r.choice(["ad", "share", "related", "notice", "form", "nav", "sidebar"]), " data-not", True))
        if r.random() < 0.12:
            out.append(self.part(r.choice(["comments", "related", "share"]), " data-not", True))
        return "\n".join(out) if r.random() < 0.5 else "".join(out)

    def part(self, kind: str, extra: str = "", sure: bool = False) -> str:
        r, (tags, words) = self.r, PARTS[kind]
        tag = r.choice([t for t in tags if t != "p" or self.named == "words"])  # a paragraph without a telling name is text
        plain = tag in ("div", "section", "p", "ul", "ol")
        return f"<{tag}{self.attributes(words, sure or plain)}{extra}>{self.inside(kind, tag)}</{tag}>"

    def inside(self, kind: str, tag: str) -> str:
        r = self.r
        links = lambda k, n: [self.link(r.randint(1, n)) for _ in range(k)]
        listed = lambda items: "".join(f"<li>{x}</li>" for x in items) if tag in ("ul", "ol") else f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>"
        if kind == "nav":
            return listed(links(r.randint(2, 9), 3)) if r.random() < 0.8 else " | ".join(links(r.randint(2, 6), 2))
        if kind in ("ad", "notice"):
            body = self.words(r.choice([2, 6, 12, 25, 50]))
            return (body if tag == "p" or r.random() < 0.5 else f"<p>{body}</p>") + (self.link(2) if r.random() < 0.3 else "") + ("<button>Ok</button>" if r.random() < 0.2 and tag != "p" else "")
        if kind == "header":
            return r.choice([f"<h1>{self.words(2)}</h1>", self.link(2), f"<p>{self.words(5)}</p>"]) + (self.part("nav") if r.random() < 0.3 else "")
        if kind == "form":
            return "".join(f"<label>{self.words(2)}<input name=a></label>" for _ in range(r.randint(1, 4))) + f"<p>{self.words(r.randint(2, 15))}</p><button>{self.words(1)}</button>"
        if kind == "comments":
            one = lambda: f"<span>{self.words(2)}</span><p>{self.words(r.choice([3, 10, 30, 60]))}</p>"
            items = [one() for _ in range(r.randint(1, 8))]
            return listed(items) if tag in ("ul", "ol") else f"<h3>{self.words(1)}</h3>" + "".join(f'<div class="{r.choice(["comment", "reply", "item", "c"])}">{x}</div>' for x in items)
        if kind == "related":
            return (listed(links(r.randint(2, 8), 9)) if tag == "ul" or r.random() < 0.6 else "".join(f"<div>{self.link(6)}<p>{self.words(12)}</p></div>" for _ in range(r.randint(1, 5)))) if tag != "p" else self.link(5)
        if kind == "share":
            return listed(links(r.randint(2, 5), 1)) if tag in ("ul", "ol") else " ".join(links(r.randint(1, 5), 1)) + self.words(2)
        if kind == "sidebar":
            return "".join(r.choice([f"<h3>{self.words(2)}</h3><ul>{''.join(f'<li>{x}</li>' for x in links(4, 4))}</ul>", f"<p>{self.words(r.randint(4, 40))}</p>", self.part("ad", "", True)]) for _ in range(r.randint(1, 4)))
        return "&copy; " + self.words(r.randint(1, 12)) + (" ".join(links(r.randint(1, 6), 2)) if r.random() < 0.5 else "") + (f"<p>{self.words(20)}</p>" if r.random() < 0.3 else "")

    def wrap(self, html: str) -> str:
        return f"<div{self.attributes(NEUTRAL)}>{html}</div>"

    def page(self) -> str:
        r = self.r
        style = r.choice(["", "", "", "", "marks", "capitals", "bars"])
        self.named = r.choice(self.naming)
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        self.style = style
        article = self.article()
        self.style = r.choice(["", "", style])
        main = f"<{tag}{self.attributes(MAIN, tag in ('div', 'section') and r.random() < 0.8)} data-main>{article}</{tag}>"
        if r.random() < 0.2:
            main = f"<{r.choice(['main', 'div', 'section'])}{self.attributes(MAIN)}>{main}" + (self.part("comments", "", True) if r.random() < 0.5 else "") + (self.part("sidebar", "", True) if r.random() < 0.3 else "") + "</div>"
        if r.random() < 0.4:
            main = self.wrap(main + (self.part("sidebar") if r.random() < 0.5 else ""))
        top = [self.part(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.45]
        bottom = [self.part(k) for k in ("comments", "related", "sidebar", "share", "ad", "notice", "form", "nav", "footer") if r.random() < 0.3]
        r.shuffle(top)
        body = "".join([*top, main, *bottom])
        if r.random() < 0.3:
            body = self.wrap(body)
        if r.random() < 0.5:
            body += self.part("footer")
        return f'<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}' + ("</body></html>" if r.random() < 0.9 else "")


def made(pages: int = 1000, seed: int = 7, **options: tuple) -> list[str]:
    m = Maker(seed, **options)
    return [m.page() for _ in range(pages)]
