"""Labelled pages for the extraction of main text: layouts with and without semantic elements, filled with words.

Every text of a page is drawn once and labelled with the part it was drawn for, so that labels are exact. The
layouts vary in their containers, class names and order; the words matter little, the cues of notices and menus do.
"""

from __future__ import annotations

from collections.abc import Callable
from html import escape
from random import Random

PAGES = 420
# Words and phrases that fill the layouts.
WORDS = (
    "river stone window market garden letter winter morning captain village history science number measure paper water "
    "engine theory result journey mountain language people question answer system change study music silver forest "
    "road bridge house train signal light color shape field story method record island harbor station evening summer"
).split()
SMALL = "the a of and to in that is for with on as by from was are at or".split()
MENU = "Home,About,About us,Contact,News,Sports,Politics,Products,Services,Blog,Archive,Help,Login,Sign in,Register,Careers,Shop,Support,Search,Menu,Skip to content,FAQ,Team".split(",")
NOTICES = (
    "We use cookies to improve your experience",
    "This site uses cookies. By continuing you accept our privacy policy",
    "Accept all cookies and settings",
    "Subscribe to our newsletter",
    "Sign up now and get updates by email",
    "Please enable notifications in your settings",
)
ADVERTS = ("Advertisement", "Sponsored", "Buy now and save", "Promoted content", "Download our app", "Limited offer click here")
FOOTERS = ("© 2024 Example. All rights reserved.", "Copyright 2023 Example", "Terms of use", "Privacy policy", "Contact us", "Follow us", "© site")
FORMS = ("Email", "Password", "Your name", "Submit", "Username", "Send message", "Search", "Remember me")
SOCIAL = ("Share", "Tweet", "Share this page", "Follow us", "Email this", "Print")


class _Page:
    def __init__(self, draw: Random) -> None:
        self.draw, self.labels = draw, {}

    def put(self, text: str, main: bool) -> str:
        """``text``, made unique, as markup."""
        while text in self.labels:
            text = f"{text} {self.draw.choice(WORDS)}"
        self.labels[text] = main
        return escape(text, quote=False)

    def sentence(self, least: int, most: int) -> str:
        words = [self.draw.choice(SMALL if self.draw.random() < 0.4 else WORDS) for _ in range(self.draw.randint(least, most))]
        words = [w + "," if self.draw.random() < 0.08 else w for w in words]
        return " ".join(words).strip(",").capitalize() + self.draw.choice("...!?")

    def prose(self, main: bool, least: int = 1, most: int = 4) -> str:
        return self.put(" ".join(self.sentence(3, 22) for _ in range(self.draw.randint(least, most))), main)

    def sentence_of(self, main: bool) -> str:
        return self.put(self.sentence(3, 14), main)

    def short(self, main: bool) -> str:
        return self.put(" ".join(self.draw.choice(WORDS) for _ in range(self.draw.randint(1, 5))).capitalize(), main)

    def box(self, tags: str, names: str, inner: str) -> str:
        """An element with one of ``tags``, mostly with one of ``names`` as its class or id."""
        tag, name = self.draw.choice(tags.split()), self.draw.choice(names.split() or [""])
        noise = self.draw.choice(["", "", " js", " wrap", " col-2"])
        kind = self.draw.choice(["class", "class", "id"])
        marked = name and (tag in ("div", "section", "ul") or self.draw.random() < 0.5)
        return f"<{tag}" + (f' {kind}="{name}{noise}"' if marked else "") + f">{inner}</{tag}>"

    def links(self, count: int, texts: tuple[str, ...] | list[str] = MENU) -> str:
        return "".join(f'<li><a href="/x">{self.put(self.draw.choice(texts), False)}</a></li>' for _ in range(count))


def _menu(p: _Page) -> str:
    words = p.draw.random() < 0.5
    texts = WORDS + [f"{w}." for w in SMALL] + [f"{w}," for w in WORDS] if words else MENU
    return p.box("nav nav div header", "nav navbar menu topnav site-nav navigation", f"<ul>{p.links(p.draw.randint(2, 9), texts)}</ul>")


def _banner(p: _Page) -> str:
    inner = f"<a href='/'>{p.short(False)}</a>" + (f"<p>{p.sentence_of(False)}</p>" if p.draw.random() < 0.5 else "")
    return p.box("header header div", "header masthead banner site-header topbar brand", inner)


def _crumbs(p: _Page) -> str:
    return p.box("nav div ol", "breadcrumb breadcrumbs crumbs", f"<a href='/'>{p.short(False)}</a>")


def _notice(p: _Page) -> str:
    text = p.put(p.draw.choice(NOTICES), False) if p.draw.random() < 0.6 else p.sentence_of(False)
    return p.box("div div section aside", "notice cookie cookie-banner consent alert popup modal newsletter gdpr banner", f"<p>{text}</p>" if p.draw.random() < 0.6 else text)


def _advert(p: _Page) -> str:
    text = p.put(p.draw.choice(ADVERTS), False) if p.draw.random() < 0.4 else p.sentence_of(False)
    return p.box("div div aside section", "ad ads advert advertisement sponsor promo promotion sponsored banner-ad", text)


def _sidebar(p: _Page) -> str:
    inner = f"<h3>{p.short(False)}</h3><ul>{p.links(p.draw.randint(2, 6), WORDS)}</ul>"
    if p.draw.random() < 0.4:
        inner += f"<p>{p.prose(False)}</p>"
    return p.box("aside aside div", "sidebar side widget related recommended trending popular more", inner)


def _social(p: _Page) -> str:
    return p.box("div ul", "share social sharing follow tools", p.links(p.draw.randint(1, 4), SOCIAL))


def _form(p: _Page) -> str:
    fields = "".join(f"<label>{p.put(p.draw.choice(FORMS), False)}</label><div></div><input name='x'>" for _ in range(p.draw.randint(1, 3)))
    note = f"<p>{p.sentence_of(False)}</p>" if p.draw.random() < 0.4 else ""
    return f"<form action='/s'>{note}{fields}<button>{p.put(p.draw.choice(FORMS), False)}</button></form>"


def _comments(p: _Page) -> str:
    if p.draw.random() < 0.5:
        return _blog_comments(p)
    each = "".join(
        p.box("div li article p", "comment reply comment-body user", f"<b>{p.short(False)}</b><p>{p.prose(False, 1, 2)}</p>")
        for _ in range(p.draw.randint(1, 4))
    )
    return p.box("section div", "comments comment-list discussion responses replies disqus", f"<h3>{p.put('Comments', False)}</h3>{each}")


def _blog_comments(p: _Page) -> str:
    """Readers' comments as blogs mark them: a list of articles, each with who said it and when."""
    draw = p.draw
    title = p.put(draw.choice((f"{draw.randint(2, 30)} thoughts on {p.sentence(1, 3)}", f"{draw.randint(1, 90)} Comments", "Join the discussion", "What readers say")), False)
    each = ""
    for _ in range(draw.randint(1, 4)):
        who, when = p.draw.choice(WORDS).capitalize(), f"{draw.choice(WORDS)} {draw.randint(1, 28)}, 20{draw.randint(10, 24)}"
        said = f"<b class=fn>{who}</b> <span class=says>says:</span>"
        p.labels[f"{who} says:"] = False
        about = f"<div class='comment-author vcard'>{said}</div><div class=comment-metadata><a href=x>{p.put(when, False)}</a></div>"
        meta = draw.choice((f"<footer class=comment-meta>{about}</footer>", f"<header class='comment-meta'>{about}</header>", about))
        words = "".join(f"<p>{p.prose(False, 1, 3)}</p>" for _ in range(draw.randint(1, 2)))
        body = draw.choice((f"<div class=comment-content>{words}</div>", f"<section class='comment-content comment'>{words}</section>", words))
        reply = f"<div class=reply><a href=x>{p.put('Reply', False)}</a></div>" if draw.random() < 0.5 else ""
        inner = f"{meta}{body}{reply}"
        inner = f"<article class=comment-body>{inner}</article>" if draw.random() < 0.6 else f"<div class=comment-body>{inner}</div>"
        each += f"<li class='comment depth-1'>{inner}</li>"
    respond = f"<div id=respond class=comment-respond><h3>{p.put('Leave a reply', False)}</h3>{_form(p)}</div>" if draw.random() < 0.4 else ""
    tag, name = draw.choice(("div", "div", "section")), draw.choice(("comments", "comments-area", "post-comments", "comment-section", "responses"))
    kind = draw.choice(("id", "class", "id=comments class"))
    return f"<{tag} {kind}={name}><h2 class=comments-title>{title}</h2><ol class=comment-list>{each}</ol>{respond}</{tag}>"


def _entry_footer(p: _Page) -> str:
    """What stands under an article about it: where it was posted, its tags, its author's other work."""
    draw = p.draw
    text = draw.choice(("Posted in {}. Tagged {}", "Filed under {}, {}", "Tags: {}, {}", "Categories: {} {}", "This entry was posted in {} and tagged {}.", "By {}, {}"))
    text = p.put(text.format(*(draw.choice(WORDS).capitalize() for _ in range(2))), False)
    name = draw.choice(("entry-footer", "entry-meta", "post-meta", "post-footer", "meta", "tags", "article-footer"))
    return draw.choice((f"<footer class={name}>{text}</footer>", f"<footer><p>{text}</p></footer>", f"<div class={name}><span>{text}</span></div>", f"<p class='{name}'>{text}</p>"))


def _unseen(p: _Page) -> str:
    """Text that no reader sees."""
    mark = p.draw.choice(("hidden", "hidden=hidden", "style='display:none'", 'style="color:red; display: none;"', "style='visibility:hidden'", "aria-hidden=true", "aria-hidden='true' class=note"))
    text = p.prose(False) if p.draw.random() < 0.6 else p.short(False)
    return p.draw.choice((f"<div {mark}><p>{text}</p></div>", f"<p {mark}>{text}</p>", f"<section {mark}>{text}</section>", f"<div {mark}>{text}</div>"))


def _footer(p: _Page) -> str:
    inner = "".join(f"<p>{p.put(p.draw.choice(FOOTERS), False)}</p>" for _ in range(p.draw.randint(0, 3)))
    inner += f"&copy; {p.draw.choice(WORDS)}.example.com &middot; {p.sentence(3, 9)}" if p.draw.random() < 0.6 else ""
    if inner.endswith((".", "!", "?")):
        raw = inner[inner.rindex("&copy;") :]
        p.labels[raw.replace("&copy;", "©").replace("&middot;", "·")] = False
    return p.box("footer footer div", "footer site-footer bottom copyright legal", inner or p.put(FOOTERS[0], False))


def _article(p: _Page) -> str:
    parts = []
    if p.draw.random() < 0.85:
        named = p.draw.choice(("", "", " class=entry-title", " class='post-title'", " itemprop=headline"))
        heading = f"<h1{named}>{p.short(True) if p.draw.random() < 0.6 else p.sentence_of(True)}</h1>"
        header = p.draw.choice(("", "", " class=entry-header", " class='post-header'", " class=article-header"))
        parts.append(f"<header{header}>{heading}</header>" if p.draw.random() < 0.3 else heading)
    for _ in range(p.draw.randint(1, 9)):
        kind = p.draw.random()
        if kind < 0.1:
            # An article may talk like a notice or a footer; it stays an article.
            words = p.draw.choice((*NOTICES, *FOOTERS[:2], "All rights reserved.", "Released under the MIT License.", *ADVERTS))
            parts.append(f"<p>{p.put(words, True)}</p>")
        elif kind < 0.68:
            text = p.prose(True) if p.draw.random() < 0.7 else p.sentence_of(True)
            if p.draw.random() < 0.15:
                first, _, rest = text.partition(" ")
                text = f"<b>{first}</b> {rest}" if "&" not in text else text
            parts.append(f"<p>{text}</p>")
        elif kind < 0.78:
            parts.append(f"<h2>{p.short(True)}</h2>")
        elif kind < 0.86:
            items = "".join(f"<li>{p.short(True) if p.draw.random() < 0.5 else p.sentence_of(True)}</li>" for _ in range(p.draw.randint(2, 5)))
            parts.append(f"<ul>{items}</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{p.prose(True, 1, 2)}</p></blockquote>")
        elif kind < 0.94:
            cells = "".join(f"<tr><td>{p.short(True)}</td><td>{p.short(True)}</td></tr>" for _ in range(p.draw.randint(1, 3)))
            parts.append(f"<table>{cells}</table>")
        elif kind < 0.97:
            parts.append(f"<pre>{p.short(True)}</pre>")
        elif p.draw.random() < 0.4:
            parts.append(_advert(p))
        else:
            parts.append(p.draw.choice([_social, _form, _sidebar, _unseen])(p))
    if p.draw.random() < 0.25:
        parts.append(_entry_footer(p))
    style = p.draw.random()
    if style < 0.2:
        # As blogs do it: a main element with the article and its comments, or an article that holds them.
        inside = p.draw.random() < 0.5
        comments = _comments(p) if p.draw.random() < 0.6 else ""
        body = f"<div class={p.draw.choice(('entry-content', 'post-content', 'article-body', 'content'))}>{''.join(parts)}</div>" if p.draw.random() < 0.5 else "".join(parts)
        article = f"<article class='{p.draw.choice(('post', 'hentry post', 'entry', 'post-7 type-post'))}'>{body}{comments if inside else ''}</article>"
        return f"<main{p.draw.choice(('', ' id=main', ' class=site-main', ' role=main'))}>{article}{'' if inside else comments}</main>"
    if style < 0.5:
        return p.box("article article main", "post entry article", "".join(parts))
    if style < 0.8:
        return p.box("div section", "content article post entry main body story text article-body post-content entry-content", "".join(parts))
    return f"<div>{''.join(parts)}</div>" if style < 0.93 else "".join(parts)


def _page(draw: Random) -> tuple[str, dict[str, bool]]:
    p = _Page(draw)
    some: Callable[[Callable, float], str] = lambda part, chance: part(p) if draw.random() < chance else ""
    before = [some(_banner, 0.4), some(_menu, 0.8), some(_crumbs, 0.2), some(_notice, 0.3), some(_advert, 0.4), some(_sidebar, 0.2), some(_unseen, 0.1)]
    draw.shuffle(before)
    after = [some(_comments, 0.35), some(_sidebar, 0.3), some(_social, 0.2), some(_form, 0.25), some(_notice, 0.2), some(_advert, 0.25), some(_unseen, 0.1)]
    draw.shuffle(after)
    body = "".join(before) + _article(p) + "".join(after) + some(_footer, 0.8)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>", p.labels


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, dict[str, bool]]]:
    """Pages, and for each text block whether it is main text; the same for the same arguments."""
    return [_page(Random(f"{seed} {n}")) for n in range(count)]
