"""Training pages for the block labeller: prose of sampled pages set into drawn layouts, each block with its label."""

from __future__ import annotations

import html
import random

# Class names and wordings usual on web pages, by what a part of a page is for.
NAMES = {
    "main": "content post entry article story body text main page-content entry-content post-body article-body news blog-post prose copy",
    "menu": "menu nav navigation navbar topnav breadcrumb breadcrumbs links toolbar pager pagination skip tabs main-menu sitenav",
    "header": "header masthead banner logo branding site-header topbar page-header site-title tagline",
    "footer": "footer foot bottom colophon copyright legal imprint site-footer page-footer credits",
    "sidebar": "sidebar side widget rail related recommended popular trending secondary more archive tags most-read latest teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning message disclaimer paywall cookie-notice notification",
    "advert": "ad ads advert adverts advertisement adslot sponsor sponsored promo promotion commercial ad-box ad-banner adsense partner",
    "form": "search newsletter subscribe login signup contact search-form mailing-list register",
    "comments": "comments comment comment-list replies discussion respond disqus feedback reviews reader-comments thread guestbook responses comment-body",
    "share": "share social sharing follow buttons share-bar social-links",
}
TAGS = {
    "menu": "nav nav nav div ul", "header": "header header div", "footer": "footer footer footer div", "sidebar": "aside aside div section",
    "notice": "div div section p", "advert": "div div aside section ins", "form": "form form form div", "comments": "section div div ol",
    "share": "div ul p",
}
#: Tags that say enough without a class.
TELLING = frozenset("nav header footer aside form".split())
WORDING = {
    "notice": [
        "We use cookies to improve your experience.", "This site uses cookies. Accept all", "Please enable JavaScript to view this page.",
        "Cookie settings", "I agree", "Wir verwenden Cookies. Akzeptieren", "Nous utilisons des cookies. Accepter", "Usamos cookies. Aceptar",
        "Subscribe to continue reading.", "You have reached your limit of free articles.", "By using this site you agree to the privacy policy.",
    ],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 50%", "Anzeige", "Publicité", "Publicidad", "Limited offer: click here", "Ad"],
    "footer": [
        "© 2024 All rights reserved.", "Copyright © 2023", "Privacy policy", "Terms of use", "Impressum", "Contact us", "Powered by",
        "Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.",
    ],
    "menu": ["Home", "About", "Contact", "News", "Login", "Next page", "Previous", "Skip to content", "Startseite", "Accueil", "Inicio"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "Recent posts", "Tags", "Archive", "You may also like", "Read more", "Read also"],
    "form": ["Search", "Your email", "Subscribe", "Sign up", "Name", "Send", "Password", "Suche", "Rechercher", "Buscar", "Sign up for our newsletter"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "Reply", "Add a comment", "Join the discussion"],
    "share": ["Share on Facebook", "Tweet", "Share", "Print", "Email this", "Follow us", "Teilen", "Partager"],
    "header": ["Daily News", "The Blog", "Welcome to our site"],
}
OUTER = ["wrapper", "container", "page", "site", "layout", "row", "col", "inner", "wrap", "grid", "box", "root", "app", "block"]


class Layouts:
    """Draws pages. ``prose`` and ``short`` are texts of real pages; equal seeds draw equal pages."""

    def __init__(self, prose: list[str], short: list[str], seed: int):
        self.draw = random.Random(seed)
        filler = ["ba" * (k % 4 + 1) + "ri" * (k % 3) for k in range(40)]
        self.words = [t.split() for t in prose if t.strip()] or [filler]
        self.short = [t for t in short if t.strip()] or filler
        self.parts: list[str] = []
        self.labels: list[int] = []

    def page(self) -> tuple[str, list[int]]:
        """A page's HTML and the label of each of its leaf blocks, 1 for main text."""
        draw = self.draw
        self.parts, self.labels = [], []
        self.naming = draw.choices(["named", "bare", "coded"], [7, 2, 1])[0]
        self.closing = draw.random() < 0.8
        self.minified = draw.random() < 0.6
        self.plain = "div" if draw.random() < 0.15 else "p"
        if draw.random() < 0.05:  # nothing but text
            for _ in range(draw.randint(1, 6)):
                self.leaf(draw.choice(["p", self.plain]), self.inline(self.text(1, 80)), 1)
            if len(self.labels) == 1 and draw.random() < 0.7:
                self.parts = [self.text(1, 200)]
            return "\n".join(self.parts), self.labels
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "share", "form") if draw.random() < {"menu": 0.8, "header": 0.6}.get(k, 0.25)]
        after = [k for k in ("share", "sidebar", "comments", "advert", "form", "notice", "menu", "footer") if draw.random() < {"footer": 0.9, "comments": 0.45}.get(k, 0.25)]
        if draw.random() < 0.3:
            draw.shuffle(before)
        nested = draw.random() < 0.3 and "comments" in after
        if nested:
            after.remove("comments")
        outer = draw.randrange(0, 4)
        self.add("<!DOCTYPE html><html><head><title>" + self.text(1, 9) + "</title><script>var a='<p>';</script></head><body>")
        for _ in range(outer):
            self.add(f"<div{self.attribute(draw.choice(OUTER))}>")
        for kind in before:
            self.boilerplate(kind)
        self.main(nested)
        for kind in after[:-1] if after and after[-1] == "footer" and outer else after:
            self.boilerplate(kind)
        for _ in range(outer):
            self.add("</div>")
        if after and after[-1] == "footer" and outer:
            self.boilerplate("footer")
        self.add("</body></html>")
        return ("" if self.minified else "\n").join(self.parts), self.labels

    # Pieces

    def add(self, markup: str) -> None:
        self.parts.append(markup)

    def leaf(self, tag: str, content: str, label: int, name: str = "") -> None:
        self.add(f"<{tag}{self.attribute(name) if name else ''}>{content}" + (f"</{tag}>" if self.closing or tag not in ("p", "li", "td") else ""))
        self.labels.append(label)

    def attribute(self, name: str, always: bool = False) -> str:
        draw = self.draw
        if self.naming == "coded" and not always:
            return f' class="{"".join(draw.choice("abcdefgxyz") for _ in range(3))}{draw.randrange(100)}"'
        if self.naming == "bare" and not always:
            return ""
        if draw.random() < 0.3:
            name = draw.choice(["{}-{}", "{}_{}", "{} {}"]).format(name, draw.choice(OUTER))
        elif draw.random() < 0.1:
            name = "".join(p if not k else p.capitalize() for k, p in enumerate(name.split("-") + [draw.choice(OUTER)]))
        return f' {draw.choice(["class", "class", "class", "id"])}="{name}"'

    def text(self, least: int, most: int) -> str:
        words = self.draw.choice(self.words)
        count = self.draw.randint(least, max(least, most))
        start = self.draw.randrange(max(1, len(words) - count + 1))
        return html.escape(" ".join(words[start : start + count]) or words[0])

    def few(self, kind: str) -> str:
        draw = self.draw
        if kind in WORDING and draw.random() < 0.5:
            return html.escape(draw.choice(WORDING[kind]))
        return html.escape(draw.choice(self.short)) if draw.random() < 0.6 else self.text(1, 4)

    def link(self, inner: str) -> str:
        return f'<a href="/{self.draw.randrange(9999)}">{inner}</a>'

    def inline(self, prose: str) -> str:
        draw = self.draw
        words = prose.split(" ")
        while draw.random() < 0.35:
            k = draw.randrange(len(words))
            tag = draw.choice(["b", "i", "em", "strong", "span", "code", "a href='/x'"])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    # Parts of a page

    def main(self, with_comments: bool) -> None:
        draw = self.draw
        shell = draw.choice(["article", "article", "article", "main", "div", "div", "section", "main article", "td", ""]).split()
        if shell == ["td"]:
            self.add("<table><tr><td>")
        elif not shell and self.naming == "named":
            shell = ["div"]
        for tag in shell if shell != ["td"] else []:
            named = draw.random() < 0.8 or tag in ("div", "section")
            self.add(f"<{tag}{self.attribute(draw.choice(NAMES['main'].split())) if named else ''}>")
        if draw.random() < 0.85:
            head = draw.random() < 0.2
            self.add("<header>" if head else "")
            self.leaf(draw.choice(["h1", "h1", "h1", "h2"]), self.text(1, 12), 1, draw.choice(["", "", "title", "headline", "entry-title"]))
            self.add("</header>" if head else "")
        size = draw.choice([1, 2, 4, 8, 14, 25])
        for _ in range(draw.randint(1, size)):
            if shell and draw.random() < 0.06:  # main text may use any wording
                self.leaf(draw.choice(["p", "p", "li", "h3"]), html.escape(draw.choice(WORDING[draw.choice(list(WORDING))])), 1)
            else:
                self.passage()
            if draw.random() < 0.07:
                self.boilerplate(draw.choice(["advert", "advert", "sidebar", "share", "notice", "form"]))
        if with_comments:
            self.boilerplate("comments")
        if shell == ["td"]:
            self.add("</td></tr></table>")
        for tag in reversed(shell if shell != ["td"] else []):
            self.add(f"</{tag}>")

    def passage(self) -> None:
        draw = self.draw
        kind = draw.choices(["p", "bold", "h", "list", "quote", "table", "pre", "div", "dl", "figure"], [60, 4, 7, 6, 4, 3, 2, 5, 1, 2])[0]
        length = draw.choice([1, 3, 8, 20, 50, 120])
        if kind == "p":
            self.leaf(self.plain, self.inline(self.text(1, length)), 1)
        elif kind == "bold":
            self.leaf("p", f"<b>{self.text(1, length)}<br>", 1)
        elif kind == "h":
            self.leaf(draw.choice(["h2", "h3", "h4"]), self.text(1, 8), 1)
        elif kind == "list":
            tag = draw.choice(["ul", "ol"])
            self.add(f"<{tag}>")
            for _ in range(draw.randint(1, 6)):
                self.leaf("li", self.inline(self.text(1, length)), 1)
            self.add(f"</{tag}>")
        elif kind == "quote":
            self.add("<blockquote>")
            self.leaf("p", self.text(1, length), 1)
            self.add("</blockquote>")
        elif kind == "table":
            self.add("<table>")
            for _ in range(draw.randint(1, 4)):
                self.add("<tr>")
                for _ in range(draw.randint(1, 4)):
                    self.leaf(draw.choice(["td", "td", "th"]), self.text(1, 5), 1)
                self.add("</tr>")
            self.add("</table>")
        elif kind == "dl":
            self.add("<dl>")
            for _ in range(draw.randint(1, 3)):
                self.leaf("dt", self.text(1, 3), 1)
                self.leaf("dd", self.text(1, length), 1)
            self.add("</dl>")
        elif kind == "figure":
            self.add("<figure><img src='x.png' alt='a'>")
            self.leaf("figcaption", self.text(1, 12), 1)
            self.add("</figure>")
        else:
            self.leaf(kind, self.inline(self.text(1, length)), 1)

    def boilerplate(self, kind: str) -> None:
        draw = self.draw
        tag = draw.choice(TAGS[kind].split())
        # prose in a plain element can only be told by a name or by its wording
        named = tag not in TELLING and kind in ("advert", "notice", "comments", "sidebar", "share") or draw.random() < 0.6
        name = self.attribute(draw.choice(NAMES[kind].split()), always=tag not in TELLING) if named else ""
        if tag == "p":
            self.add(f"<p{name}>{self.text(2, 25)}</p>")
            self.labels.append(0)
            return
        self.add(f"<{tag}{name}>")
        getattr(self, f"_{kind}")(tag)
        self.add(f"</{tag}>")

    def _items(self, kind: str, least: int, most: int, tag: str, linked: float = 0.9) -> None:
        listed = self.draw.random() < 0.7 and tag not in ("ul", "ol", "ins")
        self.add("<ul>" if listed else "")
        leaf = "li" if listed or tag in ("ul", "ol") else self.draw.choice(["div", "p", "div"])
        for _ in range(self.draw.randint(least, most)):
            inner = self.few(kind)
            self.leaf(leaf, self.link(inner) if self.draw.random() < linked else inner, 0)
        self.add("</ul>" if listed else "")

    def _menu(self, tag: str) -> None:
        self._items("menu", 1, 12, tag)

    def _share(self, tag: str) -> None:
        self._items("share", 1, 5, tag)

    def _header(self, tag: str) -> None:
        draw = self.draw
        self.leaf(draw.choice(["h1", "div", "p", "h2"]), self.link(self.few("header")) if draw.random() < 0.6 else self.few("header"), 0, draw.choice(["", "logo", "site-title"]))
        if draw.random() < 0.5:
            self.leaf("p", self.text(2, 12), 0)
        if draw.random() < 0.3:
            self.add("<nav>")
            self._items("menu", 2, 8, "nav")
            self.add("</nav>")

    def _footer(self, tag: str) -> None:
        draw = self.draw
        for _ in range(draw.randint(1, 3)):
            self.leaf(draw.choice(["p", "div", "p"]), draw.choice(["&copy; ", ""]) + self.few("footer") + draw.choice([" &middot; ", " "]) + self.text(1, draw.choice([4, 15])), 0)
        if draw.random() < 0.5:
            self._items("footer", 1, 8, tag)

    def _sidebar(self, tag: str) -> None:
        draw = self.draw
        for _ in range(draw.randint(1, 3)):
            if draw.random() < 0.8:
                self.leaf(draw.choice(["h2", "h3", "h4", "p"]), self.few("sidebar"), 0)
            if draw.random() < 0.5:
                self.leaf("p", self.text(3, draw.choice([10, 50])), 0)
            if draw.random() < 0.7:
                self._items("sidebar", 1, 8, tag)

    def _notice(self, tag: str) -> None:
        self.leaf(self.draw.choice(["p", "div"]), self.few("notice") + " " + self.text(2, 25), 0)
        if self.draw.random() < 0.5:
            self.leaf(self.draw.choice(["button", "p"]), self.few("notice"), 0)

    def _advert(self, tag: str) -> None:
        draw = self.draw
        if draw.random() < 0.5 or tag == "ins":
            self.add(self.text(2, 30) if draw.random() < 0.7 else self.link(self.few("advert")))
            self.labels.append(0)
            return
        if draw.random() < 0.4:
            self.leaf("p", self.few("advert"), 0)
        for _ in range(draw.randint(1, 3)):
            self.leaf(draw.choice(["p", "div", "h3"]), self.text(2, draw.choice([8, 40])), 0)

    def _form(self, tag: str) -> None:
        draw = self.draw
        for _ in range(draw.randint(1, 4)):
            self.add(f"<label>{self.few('form')}</label><input name='q'>")
            self.labels.append(0)
        if draw.random() < 0.4:
            self.leaf("p", self.text(2, 20), 0)
        if draw.random() < 0.3:
            self.add("<select>")
            for _ in range(draw.randint(1, 5)):
                self.add(f"<option>{self.few('form')}</option>")
                self.labels.append(0)
            self.add("</select>")
        if draw.random() < 0.7:
            self.leaf("button", self.few("form"), 0)

    def _comments(self, tag: str) -> None:
        draw = self.draw
        if draw.random() < 0.8 and tag != "ol":
            self.leaf(draw.choice(["h2", "h3", "h4", "p"]), self.few("comments"), 0)
        shell = "li" if tag == "ol" else draw.choice(["div", "div", "article", "li", "p"])
        for _ in range(draw.randint(1, 6)):
            if shell == "p":
                self.leaf("p", self.text(3, draw.choice([10, 80])), 0, draw.choice(["", "comment"]))
                continue
            self.add(f"<{shell}{self.attribute('comment') if draw.random() < 0.8 else ''}>")
            if draw.random() < 0.7:
                self.leaf(draw.choice(["div", "p", "h4"]), self.text(1, 2) + draw.choice([" says:", " wrote", ", 3 May 2021", " 12:40"]), 0, draw.choice(["", "author", "meta"]))
            for _ in range(draw.choice([1, 1, 2])):
                self.leaf("p", self.text(3, draw.choice([10, 80])), 0)
            if draw.random() < 0.3:
                self.leaf("div", self.link(self.few("comments")), 0)
            self.add(f"</{shell}>")
        if draw.random() < 0.3:
            self.add("<form>")
            self._form("form")
            self.add("</form>")
