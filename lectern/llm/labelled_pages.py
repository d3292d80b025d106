"""Labelled web pages for training: invented sites of many layouts, each leaf block marked as main
text or not. Deterministic; blocks of a page come in page order."""

from __future__ import annotations

import random

#: Names of classes and ids that sites give to what isn't the article (fixed values).
NAMES = {
    "nav": "nav navbar navigation menu mainmenu topnav breadcrumb breadcrumbs pagination pager toc skip tabs toolbar subnav sitenav links",
    "header": "header masthead banner site-header top topbar branding logo hero-bar site-title tagline page-header",
    "footer": "footer site-footer bottom copyright legal colophon foot disclaimer imprint credits",
    "sidebar": "sidebar aside side rail widget widgets right-col left-col secondary related recommended popular trending more-stories see-also tags archive",
    "ad": "ad ads advert adverts advertisement advertising adsbygoogle banner-ad sponsor sponsored promo promotion promoted ad-slot ad-unit commercial affiliate",
    "form": "form search searchbox login signup register newsletter subscribe subscription contact-form comment-form feedback poll survey",
    "notice": "notice notices cookie-notice cookie cookies cookie-banner consent gdpr alert warning popup modal overlay paywall message announcement toast privacy notification info-bar",
    "comments": "comments comment comment-list commentlist comment-body reply replies disqus discussion responses reader-comments respond thread feedback-list user-comments",
    "share": "share social sharing social-links share-bar follow follow-us buttons",
}
CONTENT = "content article post entry main story body text article-body post-content entry-content story-body main-content blog-post prose copy c1 wrap-inner box col-8 page article-text".split()
NEUTRAL = "wrap wrapper container outer inner page site row col grid layout clearfix block section main-wrap root app c2 x1 box2 left center".split()
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "notice": "alertdialog", "ad": "complementary"}
TAGS = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "aside", "aside", "div", "div", "section"], "ad": ["div", "div", "ins", "section", "aside"], "form": ["form", "form", "div"], "notice": ["div", "div", "section", "dialog"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}
#: Words that such blocks often hold (fixed values).
SAID = {
    "nav": "Home|About|Contact|News|Sports|Next|Previous|Archive|Blog|Login|Start|Accueil|Inicio",
    "header": "The Daily News|Welcome|Your source for news|Skip to content",
    "footer": "© 2024 All rights reserved.|Copyright 2023|Terms of use|Privacy policy|Powered by|Impressum|Contact us",
    "sidebar": "Related articles|Most read|Popular posts|Recent comments|Tags|Categories|See also",
    "ad": "Advertisement|Sponsored|Buy now|Click here|Special offer|Shop today|Anzeige|Publicité|Publicidad",
    "form": "Search|Email address|Your name|Subscribe|Password|Log in|Submit|Sign up for our newsletter|Send",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies.|Please enable JavaScript.|Wir verwenden Cookies.",
    "comments": "Leave a reply|Comments|3 comments|Reply|Posted by user|Great article!|I disagree|says:|Report",
    "share": "Share|Tweet|Facebook|Like|Email|Print|Follow us",
}
#: Words that any text may hold, so they say nothing about what it is (fixed values).
COMMON = "the a an of and to in on by for with is was are at from this that it as or we you your our all not more have has be will one their new use site may please de la le les et un du der die und das ist für en el los del y que con para".split()
_PARTS = ["an on er the in re st ion ed to of and ha", "eau ou en le re ment qui ai é ç an", "ung ver sch ein ge be ä ö ß er zu", "ción es la o ra do ñ qu el ar"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.parts = self.r.choice(_PARTS).split()

    def prose(self, low: int, high: int) -> str:
        r, out = self.r, []
        noise = r.choice(["", "", "", "", "###", "!!", "&amp;&amp;"])
        common = r.choice([0.0, 0.2, 0.4])
        for i in range(r.randint(low, high)):
            w = r.choice(COMMON) if r.random() < common else "".join(r.choice(self.parts) for _ in range(r.randint(1, 4)))
            out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + (noise if r.random() < 0.5 else "") + ("." if r.random() < 0.09 else "," if r.random() < 0.06 else ""))
        return " ".join(out) + r.choice([".", ".", ".", ".", "", ":", "?"])

    def attrs(self, names: list[str], role: str = "") -> str:
        r, out = self.r, []
        if names and r.random() < 0.85:
            out.append(f'{r.choice(["class", "class", "class", "id"])}="{" ".join(r.sample(names, min(len(names), r.choice([1, 1, 1, 2]))))}"')
        if role and r.random() < 0.25:
            out.append(f'role="{role}"')
        return "".join(" " + x for x in out)

    def off(self, kind: str) -> list[tuple[str, int | None]]:
        """Markup of what isn't the article."""
        r = self.r
        tag = r.choice(TAGS[kind])
        names = NAMES[kind].split()
        if r.random() < 0.5:
            names = names[:4]  # the most usual
        bare = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        out: list[tuple[str, int | None]] = [(f"<{tag}{'' if bare else self.attrs(names, ROLES.get(kind, ''))}>", None)]
        said = SAID[kind].split("|")
        wordy = r.random() < 0.3  # as long as paragraphs of an article
        text = lambda: self.prose(8, r.choice([40, 140])) if wordy and kind not in ("nav", "share", "form") else r.choice(said) if r.random() < 0.5 else self.prose(1, r.choice([3, 8, 25, 60, 140]) if kind not in ("nav", "share", "form") else r.choice([3, 8, 25]))
        style = r.random()
        if kind in ("nav", "share") or style < 0.25:
            ul = "" if tag in ("ul", "ol") else "ul"
            out.append((f"<{ul}>" if ul else "", None))
            for _ in range(r.randint(2, 8)):
                link = r.random() < (0.95 if kind in ("nav", "share", "sidebar") else 0.5)
                out += [("<li>" + ('<a href="/x">' if link else ""), None), (text() if r.random() < 0.4 else self.prose(1, 2).rstrip("."), 0), (("</a>" if link else "") + "</li>", None)]
            out.append((f"</{ul}>" if ul else "", None))
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                out += [r.choice([("<label>", None), ("<p>", None), ("<div>", None)]), (text(), 0), ("<input type='text' name=q><br>", None), ("</label></p></div>", None)]
            out += [("<select><option>", None), (self.prose(1, 2), 0), ("</option><option>", None), (self.prose(1, 2), 0), ("</option></select>", None), ("<button>", None), (r.choice(said), 0), ("</button>", None)]
        elif kind == "comments":
            out += [("<h3>", None), (r.choice(said), 0), ("</h3>", None)]
            for _ in range(r.randint(1, 5)):
                inner = r.choice(["p", "div", "li"])
                out += [(f"<{inner}{self.attrs(NAMES['comments'].split())}>", None), (self.prose(2, r.choice([10, 40, 140])), 0), (f"</{inner}>", None)]
        else:
            for _ in range(r.choice([1, 1, 2, 3, 6])):
                inner = r.choice(["", "p", "p", "p", "div", "span", "h3", "h4"])
                a = r.random() < 0.3
                out += [((f"<{inner}>" if inner else "") + ("<a href='/y'>" if a else ""), None), (text() + (" &middot; " + self.prose(2, 12) if r.random() < 0.3 else ""), 0), (("</a>" if a else "") + (f"</{inner}>" if inner else "<br>"), None)]
                if not inner:
                    break
        out.append((f"</{tag}>", None))
        return out

    def article(self) -> list[tuple[str, int | None]]:
        r = self.r
        out: list[tuple[str, int | None]] = []
        if r.random() < 0.9:
            wrap = r.random() < 0.2
            h = r.choice(["h1", "h1", "h1", "h2"])
            out += [(("<header>" if wrap else "") + f"<{h}>", None), (self.prose(1, 12), 1), (f"</{h}>" + ("</header>" if wrap else ""), None)]
        short = r.random() < 0.35
        for _ in range(r.choice([1, 2, 4, 8, 14, 25])):
            k = r.random()
            size = (1, r.choice([3, 12, 30])) if short else (8, r.choice([25, 60, 140]))
            if k < 0.72:
                odd = r.random()
                a, b = ("<p>", "</p>") if odd < 0.7 else ("<p>", "") if odd < 0.85 else ("<p><b>", "<br>") if odd < 0.95 else (f"<div{self.attrs(CONTENT)}>", "</div>")
                if r.random() < 0.2:
                    out += [(a, None), (self.prose(*size) + " <a href='/z'>" + self.prose(1, 4) + "</a> <em>" + self.prose(1, 3) + "</em>", 1), (b, None)]
                else:
                    out += [(a, None), (self.prose(*size), 1), (b, None)]
            elif k < 0.8:
                h = r.choice(["h2", "h3", "h4"])
                out += [(f"<{h}>", None), (self.prose(1, 7), 1), (f"</{h}>", None)]
            elif k < 0.86:
                t = r.choice(["ul", "ol"])
                out.append((f"<{t}>", None))
                for _ in range(r.randint(2, 6)):
                    out += [("<li>", None), (self.prose(1, 14), 1), ("</li>", None)]
                out.append((f"</{t}>", None))
            elif k < 0.9:
                out += [("<blockquote><p>", None), (self.prose(4, 30), 1), ("</p></blockquote>", None)]
            elif k < 0.93:
                out += [("<figure><img src=i.png><figcaption>", None), (self.prose(3, 12), 1), ("</figcaption></figure>", None)]
            elif k < 0.96:
                out.append(("<table>", None))
                for _ in range(r.randint(1, 4)):
                    out.append(("<tr>", None))
                    for _ in range(r.randint(2, 4)):
                        out += [("<td>", None), (self.prose(1, 5), 1), ("</td>", None)]
                    out.append(("</tr>", None))
                out.append(("</table>", None))
            else:
                out += [("<pre>", None), (self.prose(5, 30), 1), ("</pre>", None)]
            if r.random() < 0.06:
                out += self.off(r.choice(["ad", "ad", "notice", "share", "form", "sidebar"]))
        if r.random() < 0.2:
            out += self.off("comments")
        return out

    def page(self) -> list[tuple[str, int | None]]:
        """Markup (None) and texts with their labels (1 the article, 0 not)."""
        r = self.r
        out: list[tuple[str, int | None]] = [("<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body>", None)]
        depth = r.choice([0, 0, 1, 2])
        for _ in range(depth):
            out.append((f"<div{self.attrs(NEUTRAL)}>", None))
        some = 0.0 if r.random() < 0.3 else 1.0  # some pages begin with their article
        for kind, p in (("notice", 0.25), ("header", 0.55), ("nav", 0.85), ("ad", 0.4), ("form", 0.2), ("sidebar", 0.15)):
            if r.random() < p * some:
                out += self.off(kind)
        kind = r.random()
        before = [(f"<{r.choice(['main', 'div', 'section'])}{self.attrs(CONTENT + NEUTRAL, 'main')}>", None)] if r.random() < 0.3 else []
        tag = "article" if kind < 0.5 else "main" if kind < 0.65 else "div"
        names = CONTENT if tag == "div" else [] if r.random() < 0.6 else CONTENT
        out += before + [(f"<{tag}{self.attrs(names)}>", None)]
        if r.random() > 0.02:
            out += self.article()
        out.append((f"</{tag}>" + (f"</{before[0][0][1:].split()[0].rstrip('>')}>" if before else ""), None))
        for kind_, p in (("share", 0.25), ("comments", 0.35), ("sidebar", 0.45), ("form", 0.25), ("ad", 0.25), ("notice", 0.2), ("nav", 0.2), ("footer", 0.85)):
            if r.random() < p:
                out += self.off(kind_)
        out.append(("</div>" * depth + ("</body></html>" if r.random() < 0.8 else ""), None))
        return out

    def bare_off(self, kind: str, around: str, link: float = 0.9) -> list[tuple[str, int | None]]:
        """What isn't the article, in markup that names nothing."""
        r = self.r
        said = SAID[kind].split("|")
        a, b = (f"<{around}>", f"</{around}>") if around else ("", "<hr>")
        out: list[tuple[str, int | None]] = [(a, None)]
        if kind in ("nav", "share"):
            between = r.choice([" ", " ", " | ", "<br>", " &middot; "])
            for i in range(r.randint(2, 9)):
                on = r.random() < link
                out += [(between if i else "", None), ("<a href='/x'>" if on else "", None), (r.choice(said) if r.random() < 0.5 else self.prose(1, 2).rstrip("."), 0), ("</a>" if on else "", None)]
        elif kind == "comments":
            out += [("<h3>" if r.random() < 0.7 else "<b>", None), (r.choice(said[:3]), 0), ("</h3></b>", None)]
            inner = r.choice(["p", "div"])
            for _ in range(r.randint(1, 5)):
                out += [(f"<{inner}>", None), (self.prose(1, 2) + " " + r.choice(["says:", "wrote:", ":"]) + " " + self.prose(3, 30), 0), (f"</{inner}>", None)]
        elif kind == "form":
            out += [(r.choice(said), 0), ("<form><input name=q><button>", None), (r.choice(said), 0), ("</button></form>", None)]
        else:
            inner, on = r.choice(["", "", "p", "b", "span"]), r.random() < 0.3
            for _ in range(r.choice([1, 1, 1, 2])):
                out += [((f"<{inner}>" if inner else "") + ("<a href='/y'>" if on else ""), None), (r.choice(said) + (" " + self.prose(1, 10) if r.random() < 0.4 else ""), 0), (("</a>" if on else "") + (f"</{inner}>" if inner else " "), None)]
        return [*out, (b, None)]

    def bare_article(self, style: str) -> list[tuple[str, int | None]]:
        """Title and paragraphs: p or div elements, or one run of text with line breaks."""
        r = self.r
        out: list[tuple[str, int | None]] = []
        if r.random() < 0.65:
            h = r.choice(["h1", "h1", "h2", "h3"]) if style != "text" else ""
            out += [(f"<{h}>" if h else "", None), (self.prose(1, 10), 1), (f"</{h}>" if h else "\n\n", None)]
        size = r.choice([(2, 12), (8, 40), (15, 120)])
        for _ in range(r.choice([1, 2, 3, 6, 12])):
            a, b = {"p": ("<p>", "</p>"), "div": ("<div>", "</div>"), "br": ("", "<br><br>"), "text": ("", "\n\n")}[style]
            out += [(a, None), (self.prose(*size), 1), (b, None)]
            if style in ("p", "div", "br") and r.random() < 0.08:
                out += [("<h2>", None), (self.prose(1, 6), 1), ("</h2>", None)]
        return out

    def bare_page(self) -> list[tuple[str, int | None]]:
        """A page without classes, ids and elements that say what they hold: text alone, one element of text,
        unnamed divisions, or a table that lays the page out."""
        r = self.r
        kind = r.random()
        if kind < 0.2:
            wrap = r.choice(["", "", "div", "p", "pre", "section"])
            return [(f"<{wrap}>" if wrap else "", None), *self.bare_article("text"), (f"</{wrap}>" if wrap else "", None)]
        style = r.choice(["p", "div", "br"])
        head = [(r.choice(["<!DOCTYPE html><html><head><title>x</title></head><body>", "<html><body>", "<body>", ""]), None)]
        above = [k for k, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.8), ("ad", 0.25), ("form", 0.1)) if r.random() < p]
        below = [k for k, p in (("share", 0.2), ("comments", 0.3), ("sidebar", 0.3), ("ad", 0.3), ("form", 0.15), ("nav", 0.15), ("footer", 0.75)) if r.random() < p]
        if kind < 0.6:
            around = r.choice(["div", "div", "p"])
            out = [x for k in above for x in self.bare_off(k, around)]
            wrap = r.random() < 0.8
            out += [("<div>" if wrap else "", None), *self.bare_article(style), ("</div>" if wrap else "", None)]
            return head + out + [x for k in below for x in self.bare_off(k, around)]
        row = lambda cells: [("<tr>", None), *[x for cell in cells for x in [(r.choice(["<td>", "<td valign=top>", "<td width=150>"]), None), *cell, ("</td>", None)]], ("</tr>", None)]
        side = lambda: r.choice(["nav", "nav", "sidebar", "ad", "share"])
        middle = [self.bare_article(style)]
        if r.random() < 0.8:
            middle.insert(0, self.bare_off(side(), "", 0.7))
        if r.random() < 0.5:
            middle.append(self.bare_off(r.choice(["ad", "ad", "sidebar"]), ""))
        out = [("<table>", None)]
        for k in above[:2]:
            out += row([self.bare_off(k, "")])
        out += row(middle)
        for k in below[-2:]:
            out += row([self.bare_off(k, "")])
        return head + out + [("</table>", None)]


def labelled_pages(n: int, seed: int = 1) -> list[list[tuple[str, int | None]]]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]


def bare_pages(n: int, seed: int = 1) -> list[list[tuple[str, int | None]]]:
    return [Maker(seed * 1_000_003 + 500_000 + i).bare_page() for i in range(n)]
