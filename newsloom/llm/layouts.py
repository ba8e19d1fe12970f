"""Labelled web pages to learn from: invented articles in many layouts, each with the main text that it holds.

Sections around an article bear the tags and class names that sites commonly give them, at times one, at times the
other, at times neither; prose stands in adverts, notices and comments too, and short lines in articles, so that no
single sign tells them apart.
"""

from __future__ import annotations

import html as entities
import random
import re

# Names that sites give to the parts of a page.
PARTS: dict[str, tuple[str, str]] = {  # part -> (tags, class or id names)
    "menu": ("nav nav ul div div", "nav navbar menu main-menu topnav navigation breadcrumb breadcrumbs site-nav pagination pager"),
    "header": ("header header div", "header site-header masthead top topbar banner branding logo"),
    "footer": ("footer footer div", "footer site-footer copyright legal bottom colophon"),
    "sidebar": ("aside aside div section", "sidebar side related related-posts recommended widget trending popular read-more most-read more-stories teaser rail"),
    "notice": ("div div section aside dialog", "notice cookie cookie-notice cookie-banner consent gdpr alert warning disclaimer paywall popup modal overlay message subscribe-notice"),
    "advert": ("div div aside section ins", "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense ad-slot partner"),
    "form": ("form form div", "form search newsletter subscribe signup login contact-form search-form"),
    "comments": ("section div div ol", "comments comment comment-list discussion responses replies reader-comments disqus respond thread feedback"),
    "share": ("div ul", "share social sharing share-buttons tags tag-list follow toolbar"),
}
ARTICLE = ("article article article main div div section", "article content post entry entry-content article-body post-content story body main main-content text story-body page-content")
NEUTRAL = "wrapper container row col inner outer block section box grid page site layout left right center".split()
CONSONANTS, VOWELS = "b c d f g h l m n p r s t v w z th st ch".split(), "a e i o u ä é ou ei ü ó".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(CONSONANTS) + self.r.choice(VOWELS) for _ in range(self.r.randint(1, 4))) for _ in range(300)]
        self.junk = self.r.random() < 0.15

    def some(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        return " ".join(w + self.r.choice(("***", "%%%", "&", "###", "$", "")) if self.junk else w for w in words)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.some(low, high)
        if self.r.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        return s[:1].upper() + s[1:] + self.r.choice("......?!")

    def prose(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def paragraph(self) -> str:
        return self.sentence(1, 4) if self.r.random() < 0.25 else self.prose(9)


def page(seed: int) -> tuple[str, str]:
    """A page and its main text: its blocks joined by two line ends."""
    w = Writer(seed)
    r, kept = w.r, []

    def wrap(part: str, inner: str) -> str:
        tags, names = PARTS[part]
        tag, named = r.choice(tags.split()), r.random()
        name = r.choice(names.split())
        mark = f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", " " + r.choice(NEUTRAL)))}"' if named < 0.75 or tag in ("div", "section", "ul", "ol", "ins") else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def p(text: str, tag: str = "p", open_end: bool = False) -> str:
        text = entities.escape(text, quote=False)
        if r.random() < 0.1:
            text = f"<b>{text}<br>" if open_end else f"<b>{text}</b>"
        elif r.random() < 0.1:
            text += f' <a href="/x">{w.some(1, 3)}</a>' if tag == "p" and not open_end else ""
        return f"<{tag}>{text}" + ("" if open_end else f"</{tag}>")

    def shown(html: str) -> str:
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", html)).split())

    def main(html: str) -> str:
        kept.append(shown(html))
        return html

    def menu() -> str:
        items = [f'<a href="/{i}">{w.some(1, 2)}</a>' for i in range(r.randint(2, 9))]
        return wrap("menu", "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.75 else r.choice((" | ", " › ", " ")).join(items))

    def header() -> str:
        return wrap("header", f'<a href="/">{w.some(1, 2)}</a>' + r.choice(("", f"<p>{w.sentence()}</p>", f"<h1>{w.some(1, 3)}</h1>", f"<div>{w.some(2, 5)}</div>")))

    def footer() -> str:
        line = r.choice(("&copy; ", "© 2024 ", "", "Copyright ")) + w.some(1, 3) + r.choice((" &middot; ", " | ", ". ")) + r.choice((w.sentence(), w.prose(3)))
        return wrap("footer", r.choice((line, f"<p>{line}</p>", f'<p>{line}</p><ul><li><a href="/p">{w.some(1, 2)}</a></li></ul>')))

    def sidebar() -> str:
        items = [f'<a href="/s{i}">{w.some(3, 9)}</a>' for i in range(r.randint(1, 5))]
        return wrap("sidebar", r.choice(("", f"<h3>{w.some(1, 3)}</h3>")) + r.choice(("".join(f"<p>{x}</p>" for x in items), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", f"<p>{w.prose(3)}</p>", f"<h4>{items[0]}</h4><p>{w.prose(2)}</p>")))

    def notice() -> str:
        return wrap("notice", r.choice((w.prose(3), f"<p>{w.prose(3)}</p>", f'<p>{w.prose(2)} <a href="/c">{w.some(1, 2)}</a></p><button>{w.some(1, 2)}</button>')))

    def advert() -> str:
        return wrap("advert", r.choice((w.prose(3), f"<p>{w.prose(3)}</p>", f'<a href="/ad">{w.sentence()}</a>', f"<h4>{w.some(1, 4)}</h4><p>{w.sentence()}</p>")))

    def form() -> str:
        return wrap("form", f"<label>{w.some(1, 4)}</label><input name=q>" + r.choice(("", f"<p>{w.prose(2)}</p>", f"<h3>{w.some(2, 4)}</h3>")) + f"<button>{w.some(1, 2)}</button>")

    def comments() -> str:
        say = lambda: r.choice((f"<p>{w.prose(4)}</p>", f"<b>{w.some(1, 2)}</b> <p>{w.prose(4)}</p>", f"<h4>{w.some(1, 2)}</h4><p>{w.sentence(1, 9)}</p><p>{w.prose(3)}</p>"))
        each = r.choice(("<div>{}</div>", '<div class="comment">{}</div>', "<li>{}</li>", '<article class="comment">{}</article>', '<div class="reply">{}</div>', "{}"))
        return wrap("comments", r.choice(("", f"<h3>{w.some(1, 3)}</h3>", f"<h2>{w.some(1, 2)}</h2>")) + "".join(each.format(say()) for _ in range(r.randint(1, 5))) + (form() if r.random() < 0.3 else ""))

    def share() -> str:
        return wrap("share", "".join(f'<li><a href="/t{i}">{w.some(1, 1)}</a></li>' for i in range(r.randint(2, 4))))

    def body() -> str:
        out, loose = [], r.random() < 0.3
        title = p(w.some(3, 11), r.choice(("h1", "h1", "h1", "h2")))
        if r.random() < 0.85:
            out.append(f"<header>{main(title)}</header>" if r.random() < 0.15 else main(title))
        if r.random() < 0.15:
            out.append(main(f'<p class="{r.choice(("byline", "meta", "author", "dateline", "lead", "intro"))}">{w.some(2, 5)}</p>'))
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            x = r.random()
            if x < 0.76:
                out.append(main(p(w.paragraph(), "p", loose and r.random() < 0.4)))
            elif x < 0.83:
                out.append(main(p(w.some(1, 6), r.choice(("h2", "h3")))))
            elif x < 0.87:
                out.append("<ul>" + "".join(main(f"<li>{w.sentence(1, 12)}</li>") for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.90:
                out.append("<blockquote>" + main(f"<p>{w.prose(3)}</p>") + "</blockquote>")
            elif x < 0.92:
                out.append('<figure><img src="/i.png">' + main(f"<figcaption>{w.some(2, 9)}</figcaption>") + "</figure>")
            elif x < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(main(f"<td>{w.some(1, 3)}</td>") for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.96:
                out.append(main(f"<div>{w.paragraph()}</div>"))
            else:
                out.append(r.choice((advert, advert, sidebar, form, share, notice))())
        if r.random() < 0.12:
            out.append(r.choice((share, comments, sidebar, advert, form))())
        tags, names = ARTICLE
        tag = r.choice(tags.split())
        mark = f' {r.choice(("class", "id"))}="{r.choice(names.split())}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        if r.random() < 0.12:
            return "".join(out)
        whole = f"<{tag}{mark}>" + "".join(out) + f"</{tag}>"
        return f"<main>{whole}</main>" if tag == "article" and r.random() < 0.2 else whole

    def often(f, share: float) -> str:
        return f() if r.random() < share else ""

    before = often(notice, 0.25) + often(header, 0.5) + often(menu, 0.7) + often(advert, 0.4) + often(form, 0.1) + often(sidebar, 0.15) + often(menu, 0.15)
    middle = body()
    after = often(share, 0.15) + often(advert, 0.3) + often(comments, 0.4) + often(sidebar, 0.35) + often(form, 0.25) + often(notice, 0.2) + often(footer, 0.75)
    whole = middle if r.random() < 0.15 else before + middle + after
    if r.random() < 0.4:
        whole = f'<div class="{r.choice(NEUTRAL)}">{whole}</div>'
    return f'<!DOCTYPE html><html><head><title>{w.some(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{whole}</body></html>', "\n\n".join(kept)
