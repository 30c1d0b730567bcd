"""Labelled pages for training: texts of given pages, dressed in many layouts.

Pages come without labels of their blocks. Those that mark their article with `article` or `main`
are labelled by it; and the texts of all are set anew in layouts whose parts are known, with the
names that sites give to elements, or with names that say nothing.
"""

from __future__ import annotations

from html import escape
from random import Random

from colloquy.llm.dom import Block, Frames, blocks_of

#: Words that sites use in classes and ids, by the part they name.
NAMES = {
    "main": "content main article post entry story text body page-content post-body entry-content article-body main-content story-text prose single".split(),
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs toc tabs pagination pager links sitemap dropdown".split(),
    "header": "header masthead top site-header page-header branding logo site-title topbar banner hero tagline".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal credits imprint foot".split(),
    "sidebar": "sidebar side aside widget widgets rail related recommended popular trending secondary complementary teaser more author-box".split(),
    "notice": "notice cookie cookies consent gdpr alert message warning popup modal overlay banner toast disclaimer subscribe newsletter paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense adbox ad-slot banner-ad dfp commercial".split(),
    "form": "form search search-form login signup contact subscribe-form newsletter-form feedback comment-form respond".split(),
    "comments": "comments comment comment-list commentlist comment-body replies reply responses discussion disqus reader-comments user-comments thread".split(),
    "share": "share social sharing share-buttons social-links follow tags tag-list categories meta".split(),
}
#: Elements that hold each part, plain ones first.
HOLDERS = {
    "main": ["div", "article", "main", "section"], "menu": ["div", "nav", "ul"], "header": ["div", "header"], "footer": ["div", "footer"], "sidebar": ["div", "aside"],
    "notice": ["div", "section", "aside"], "advert": ["div", "aside"], "form": ["div", "form"], "comments": ["div", "section", "ol"], "share": ["div", "ul"],
}


class Material:
    """Texts to dress: short and long ones, as their pages hold them."""

    def __init__(self, texts: list[str], rng: Random):
        self.rng = rng
        self.words = [w for t in texts for w in t.split()][:200_000] or ["word"]
        self.long = [t for t in texts if len(t.split()) >= 12] or [" ".join(self.words[:40])]

    def phrase(self, least: int, most: int) -> str:
        at = self.rng.randrange(max(1, len(self.words) - most))
        return " ".join(self.words[at : at + self.rng.randint(least, most)])

    def paragraph(self) -> str:
        return self.rng.choice(self.long) if self.rng.random() < 0.6 else self.phrase(4, 60).rstrip(".,") + "."


def semantic(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own `article` or `main`; None if it has neither."""
    around = [b.frame.said for b in blocks]
    held = "in article" if any("in article" in s for s in around) else "in main"
    labels = [int(held in s and not {"in nav", "in aside", "in footer", "in form", "in button"} & s) for s in around]
    return labels if any(labels) else None


def dressed(material: Material, rng: Random) -> tuple[str, list[int]]:
    """A page in a drawn layout, and the labels of its blocks in order."""
    named, plain = rng.random() < 0.8, rng.random() < 0.4
    labels: list[int] = []

    def attributes(part: str) -> str:
        if not named or rng.random() < 0.1:
            return rng.choice(["", f' class="{rng.choice("qwzkx")}{rng.choice("rtlpm")}{rng.randint(1, 99)}"'])
        kind = rng.choice(["class", "class", "id"])
        return f' {kind}="{rng.choice(NAMES[part])}{rng.choice(["", "", " col", " wrap clearfix", "-1"])}"'

    def leaf(tag: str, text: str, label: int) -> str:
        labels.append(label)
        text = escape(text, quote=False)
        if rng.random() < 0.2 and " " in text:
            head, rest = text.split(" ", 1)
            mark = rng.choice(["b", "i", "em", "a", "span"])
            text = f"<{mark}>{head}</{mark}> {rest}"
        return f"<{tag}>{text}</{tag}>" if tag else text

    def held(part: str, inner: str) -> str:
        tag = HOLDERS[part][0] if plain or tag_dice() else rng.choice(HOLDERS[part][1:])
        return f"<{tag}{attributes(part)}>{inner}</{tag}>"

    def tag_dice() -> bool:
        return rng.random() < 0.5

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_said(material.phrase(1, 4))}</a></li>' for i in range(n)) + "</ul>"

    def _said(text: str) -> str:
        labels.append(0)
        return escape(text, quote=False)

    def other(part: str) -> str:
        say = lambda tag, a, b: leaf(tag, material.phrase(a, b) + (rng.choice(".!?") if b > 5 and tag_dice() else ""), 0)
        if part in ("menu", "share"):
            return held(part, links(rng.randint(2, 8)))
        if part == "form":
            return held(part, say("label", 1, 4) + '<input name="q">' + (say("p", 3, 12) if tag_dice() else "") + say("button", 1, 2))
        if part == "comments":
            said = [f"<{h}{attributes(part)}>" + say("p", 1, 3) + leaf("p", material.paragraph(), 0) + f"</{h}>" for h in [rng.choice(["div", "li", "section", "article" if named else "div"])] for _ in range(rng.randint(1, 4))]
            return held(part, (say("h3", 1, 3) if tag_dice() else "") + "".join(said))
        if part == "sidebar":
            return held(part, say("h3", 1, 4) + (links(rng.randint(2, 6)) if tag_dice() else leaf("p", material.paragraph(), 0)))
        if part == "header":
            return held(part, say(rng.choice(["h1", "div", "p", "h2"]), 1, 5) + (say("p", 2, 9) if tag_dice() else ""))
        if part == "footer":
            return held(part, leaf(rng.choice(["", "p", "div"]), rng.choice(["© ", "", "© 2024 "]) + material.phrase(3, 20), 0) + (links(3) if tag_dice() else ""))
        return held(part, say(rng.choice(["", "p", "div"]), 3, 30) + (say("button", 1, 2) if part == "notice" and tag_dice() else ""))

    title = material.phrase(3, 12)

    def article() -> str:
        out = [f"<header>{leaf('h1', title, 1)}</header>" if rng.random() < 0.2 else leaf("h1", title, 1)] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            dice = rng.random()
            if dice < 0.68:
                out.append(leaf("p", material.paragraph(), 1))
            elif dice < 0.74:
                out.append(leaf(rng.choice(["h2", "h3"]), material.phrase(2, 8), 1))
            elif dice < 0.80:
                out.append("<ul>" + "".join(leaf("li", material.phrase(3, 20), 1) for _ in range(3)) + "</ul>")
            elif dice < 0.84:
                out.append(f"<blockquote>{leaf('p', material.paragraph(), 1)}</blockquote>")
            elif dice < 0.87:
                out.append("<table><tr>" + "".join(leaf("td", material.phrase(1, 4), 1) for _ in range(4)) + "</tr></table>")
            else:
                out.append(other(rng.choice(["advert", "notice", "form", "sidebar", "share"])))
        if rng.random() < 0.2:
            out.append(other(rng.choice(["comments", "share", "advert"])))
        return held("main", "".join(out))

    before = [p for p in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [p for p in ("comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    body = "".join(map(other, before)) + article() + "".join(map(other, after))
    for _ in range(rng.randint(0, 2)):
        body = f"<div>{body}</div>"
    return f"<html><head><title>{escape(title)}</title></head><body>{body}</body></html>", labels


def labelled(pages: list[str], dressings: int, seed: int = 5) -> list[tuple[str, list[Block], list[int]]]:
    """Title, blocks and labels of the given pages that mark their article, and of `dressings` layouts of all pages' texts."""
    rng, found, texts = Random(seed), [], []
    for html in pages:
        title, blocks = blocks_of(html, Frames())
        texts += [b.text for b in blocks]
        labels = semantic(blocks)
        if labels:
            found.append((title, blocks, labels))
    material = Material(texts, rng)
    for _ in range(dressings):
        html, labels = dressed(material, rng)
        title, blocks = blocks_of(html, Frames())
        if len(blocks) == len(labels):
            found.append((title, blocks, labels))
    return found
