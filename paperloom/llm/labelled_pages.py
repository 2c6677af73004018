"""Labelled pages for operator 9: page layouts filled with words, and the blocks of each that are its main text."""

from __future__ import annotations

import random

_WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()
#: Small words, which stand in every third place or so of a sentence, and words of no meaning, as of a language that the rest says nothing of.
_SMALL = "the a an and or of to in on for with by is are was be this that it as at from not no we you your our all has have its more".split()
#: What parts of pages that are no article are called.
_CALLED = {
    "nav": "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs links toc pagination pager tabs toolbar skip".split(),
    "header": "header masthead brand logo banner hero topbar head".split(),
    "footer": "footer foot copyright legal disclaimer contentinfo bottom colophon credits imprint".split(),
    "ad": "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted promobox".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall dialog warning".split(),
    "side": "sidebar aside widget widgets related recommended recommendations trending popular more rail social share sharing tags complementary teaser teasers".split(),
    "comments": "comment comments commentlist disqus respond reply replies responses discussion reviews".split(),
    "form": "form search login contact feedback register signup poll".split(),
}
_CONTENT = "content post entry article story body main text page single entry-content post-body article-body main-content".split()
_ENDS = ["", "", "", "-list", "-area", "-section", "-wrap", "-box", "-container", "s"]
_SAYS = {
    "nav": ["Home", "About us", "News", "Contact", "Sign in", "Products", "Archive", "Help", "Next page", "Previous", "Top"],
    "footer": ["Copyright {y} {w} Inc.", "© {y} {w}", "© {w}.example · {s}", "All rights reserved", "Terms of use", "Privacy policy", "{s}", "{w} Ltd. All rights reserved. {y}"],
    "notice": ["We use cookies to improve your visit.", "Accept all cookies", "This site uses cookies. {s}", "Subscribe to our newsletter", "{s}", "You have read your last free story. {s}"],
    "ad": ["Advertisement", "Buy now and save", "{s}", "{s} {s}", "Sponsored", "Best offers for you", "{s} Click here"],
    "form": ["Your name", "Your email", "Search this site", "{s}", "Leave a reply", "Password", "Sign up for {w}"],
    "comments": ["{s}", "{s} {s}", "Reply", "{w} says:", "I agree. {s}", "Posted by {w}", "3 comments"],
    "side": ["{s}", "Related stories", "Most read", "Share this", "{w} {w}", "{s} {s}", "Read more"],
    "header": ["{w} {w}", "{s}", "The {w} Times", "Your daily {w}"],
}
#: What stands over such parts.
_HEADS = {
    "comments": ["Comments", "Comments", "Responses", "Leave a reply", "2 comments", "Reader comments", "Discussion", "Replies", "Leave a comment", "Add a comment", "Comments (12)", "Join the conversation"],
    "ad": ["Advertisement", "Advertisement", "Sponsored", "Advert", "Sponsored content", "Ad", "Promoted", "From our partners"],
    "side": ["Related", "More stories", "Related articles", "Related stories", "Read next", "You may also like", "Most read", "Popular", "Trending"],
}
_TAGS = {
    "nav": ["nav", "div", "div", "ul", "header", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div", "div", "section"], "ad": ["div", "div", "aside", "section", "ins"],
    "notice": ["div", "div", "section", "aside", "dialog"], "side": ["aside", "aside", "div", "section"], "comments": ["section", "div", "div", "ol", "aside"], "form": ["form", "form", "div"],
}


#: Stands where the article goes on under a heading of its own.
_NEXT = "<!--next-->"


def _made_up(r: random.Random) -> str:
    """A name that says nothing."""
    return "".join(r.choices("abcdefghijklmnoprstuvwxyz", k=r.randint(3, 10)))


def _sentence(r: random.Random, low: int = 6, high: int = 22) -> str:
    strange = r.random() < 0.3
    words = ["".join(r.choices("aeioubdghklmnrst", k=r.randint(2, 9))) if strange else r.choice(_SMALL if r.random() < 0.35 else _WORDS) for _ in range(r.randint(low, high))]
    text = " ".join(words)
    return (text.upper() if r.random() < 0.02 else text.capitalize()) + r.choice([".", ".", ".", ".", ".", ".", "!", "?", "", " |"])


def _paragraph(r: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


def _attributes(r: random.Random, called: list[str], unnamed: float = 0.35) -> str:
    """class, id or role with a word that says what a part is, or nothing."""
    if r.random() < unnamed:
        return ""
    word = r.choice(called)
    value = r.choice(["", "", "", "site-", "page-", "top-", "left-"]) + word + r.choice(_ENDS)
    kind = r.choice(["class", "class", "class", "id", "role"])
    other = f" {r.choice(_WORDS)}" if kind == "class" and r.random() < 0.3 else ""
    quote = r.choice(['"', '"', '"', "'"])
    return f" {kind}={quote}{value}{other}{quote}"


def _said(r: random.Random, kind: str) -> str:
    text = r.choice(_SAYS[kind])
    while "{" in text:
        text = text.replace("{s}", _sentence(r, 3, 16), 1).replace("{w}", r.choice(_WORDS).capitalize(), 1).replace("{y}", str(r.randint(1999, 2026)), 1)
    return text


def _linked(text: str) -> str:
    return f'<a href="/{text.split()[0].lower()}">{text}</a>'


def _part(r: random.Random, kind: str, long: bool = False) -> str:
    """A part of a page that is no main text."""
    tag = r.choice(_TAGS[kind])
    own = _attributes(r, _CALLED[kind], 0.5 if tag in ("nav", "footer", "aside", "form", "header", "menu") else 0.2)
    if kind == "nav":
        items = [_linked(r.choice([_said(r, "nav"), r.choice(_WORDS).capitalize()])) for _ in range(r.randint(2, 9))]
        shape = r.choice(["list", "list", "plain", "lines"])
        if tag == "ul" or shape == "list":
            inner = "".join(f"<li>{x}{r.choice(['', '</li>'])}" for x in items)
            inner = inner if tag in ("ul", "menu") else f"<ul>{inner}</ul>"
        else:
            inner = " | ".join(items) if shape == "plain" else "".join(f"<div>{x}</div>" for x in items)
        # a menu in plain elements says nothing but its links
        return f"<{tag}{own if r.random() < 0.7 else ''}>{inner}</{tag}>"
    texts = [_paragraph(r) if long or kind == "comments" and r.random() < 0.5 else _said(r, kind) for _ in range(r.randint(6, 14) if long else r.randint(1, 7) if kind == "comments" else r.randint(1, 3))]
    if kind == "comments":
        one = r.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<li>{}</li>" if tag == "ol" else "<div>{}</div>", '<article class="comment"><p>{}</p></article>'])
        head = r.choice(["", *[f"<{h}>{x}</{h}>" for h in ("h2", "h3") for x in _HEADS["comments"]]])
        if r.random() < 0.5:  # nothing but the heading says what it is
            named = r.choice(["<li><b>{w}</b><p>{t}</p></li>", "<li><p>{t}</p>", "<p>{t}</p>", "<h4>{w}</h4><p>{t}</p>"])
            inner = "".join(named.format(w=r.choice(_WORDS).capitalize(), t=t) for t in texts)
            return (head or f"<h3>{r.choice(_HEADS['comments'])}</h3>") + (f"<ul>{inner}</ul>" if named.startswith("<li") else inner)
        own = own or r.choice([' class="comments"', ' id="comments"', ' id="disqus_thread"', ' id="comment-thread"'])
        return f"<{tag}{own}>{head}{''.join(one.format(t) for t in texts)}</{tag}>"
    if kind == "form":
        own = own if tag == "form" else own or ' class="form"'
        return f"<{tag}{own}>" + "".join(r.choice(["<p>{}</p>", "<label>{} <input></label><br>", "<div>{}</div>"]).format(t) for t in texts) + "<button>Send</button>" * r.randint(0, 1) + f"</{tag}>"
    if kind == "side" and r.random() < 0.4:
        cards = "".join(r.choice(["<article><h3>{}</h3><p>{}</p></article>", "<div><h4>{}</h4><p>{}</p></div>"]).format(_linked(_sentence(r, 3, 7).rstrip(".!?| ")), _sentence(r)) for _ in range(r.randint(2, 6)))
        return f"<{tag}{own or ' class=related'}>{r.choice(['', *[f"<{h}>{x}</{h}>" for h in ("h2", "h3") for x in _HEADS["side"]]])}{cards}</{tag}>"
    if kind == "ad" and r.random() < 0.4:  # a heading and paragraphs up to the article's next heading
        return r.choice(["<h3>{}</h3>", "<h2>{}</h2>", "<h4>{}</h4>"]).format(r.choice(_HEADS["ad"])) + "".join(f"<p>{t}</p>" for t in texts) + _NEXT
    if kind in ("ad", "notice", "side"):
        own = own or (f' class="{r.choice(_CALLED[kind])}"' if tag in ("div", "section", "ins") else "")
    shapes = ["<p>{}</p>", "<p>{}</p>", "{}<br>", "<div>{}</div>", "<span>{}</span> "]
    if kind in ("footer", "header"):
        texts = [_linked(t) if r.random() < 0.2 else t for t in texts]
    return f"<{tag}{own}>" + "".join(r.choice(shapes).format(t) for t in texts) + f"</{tag}>"


def _body(r: random.Random) -> list[tuple[str, list[str]]]:
    """An article's parts: the markup of each, and the texts of its blocks."""
    title = _sentence(r, 3, 9).rstrip(".!?| ")
    parts = [(f"<h1>{title}</h1>", [title])]
    paragraph = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class=lead>{}</p>"])
    for _ in range(r.randint(1, 9)):
        kind = r.choice(["p", "p", "p", "p", "p", "short", "h2", "ul", "quote", "bold", "link", "table", "figure", "section", "section"])
        if kind == "ul":
            texts = [_sentence(r, 2, 9).rstrip(r.choice(["", ".!?| "]) + " ") for _ in range(r.randint(2, 4))]
            markup = "<ul>" + "".join(f"<li>{x}</li>" for x in texts) + "</ul>"
        elif kind == "table":
            texts = [r.choice([_sentence(r, 1, 3).rstrip(".!?| "), str(r.randint(1, 999))]) for _ in range(4)]
            markup = "<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*texts)
        elif kind == "section":
            words = [r.choice(_WORDS), r.choice([w for own in _CALLED.values() for w in own])]
            r.shuffle(words)
            texts = [" ".join(words).capitalize(), _paragraph(r, 3)]
            markup = '<section id="{}"><h2>{}</h2><p>{}</p></section>'.format("-".join(words), *texts)
        else:
            text = _sentence(r, 2, 6).rstrip(".!?| ") if kind == "h2" else _sentence(r, 1, 5) if kind == "short" else _paragraph(r)
            texts = [text]
            if kind == "link":
                words = text.split()
                k = r.randrange(len(words))
                markup = paragraph.format(" ".join([*words[:k], _linked(words[k]), *words[k + 1 :]]))
            else:
                shape = {"h2": r.choice(["<h2>{}</h2>", "<h3>{}</h3>", '<h2 id="{1}-x">{0}</h2>']), "quote": "<blockquote><p>{}</p></blockquote>", "bold": "<p><b>{}</b></p>", "figure": "<figure><img src=x><figcaption>{}</figcaption></figure>"}.get(kind, paragraph)
                markup = shape.format(text, r.choice(_CALLED[r.choice([*_CALLED])]))
        if r.random() < 0.25:  # a name that is met nowhere else
            markup = r.choice(['<div class="{n}">{x}</div>', '<section class="{n}">{x}</section>', '<div id="{n}">{x}</div>', '<div class="{n} {m}-{n}">{x}</div>']).format(n=_made_up(r), m=_made_up(r), x=markup)
        parts.append((markup, texts))
    return parts


def _wrapper(r: random.Random) -> str:
    """An element around the article whose name may mislead."""
    word = r.choice([w for own in _CALLED.values() for w in own])
    value = r.choice([f"has-{word}", f"{word}-open", f"no-{word}", f"{word}-page", f"layout with-{word}", "layout", "container", "wrapper site", word, f"{word} {r.choice(_CONTENT)}"])
    return r.choice([f'<div class="{value}">{{}}</div>', f'<div id="{value}">{{}}</div>', f'<section class="{value}">{{}}</section>', "<div>{}</div>"])


def labelled_pages(count: int = 800, seed: int = 1) -> list[tuple[str, list[str]]]:
    """html and the list of its main text's blocks, of so many made-up pages in many layouts.

    Parts beside the article may be named, or may say nothing in plain elements; wrappers of the article may have the
    names of such parts; some pages stand in one form; some articles have a part amid them that is none of it.
    """
    r = random.Random(seed)
    out = []
    for _ in range(count):
        body = _body(r)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            at = r.randint(1, len(body))
            part, own = _part(r, r.choice(["ad", "side", "form", "notice", "nav"]), r.random() < 0.3), []
            if part.endswith(_NEXT) and at < len(body):  # the article goes on under a heading
                own = [_sentence(r, 2, 5).rstrip(".!?| ")]
                part += f"<h2>{own[0]}</h2>"
            body.insert(at, (part, own))
        if r.random() < 0.3:  # what readers say, at the end of the article's own element
            body.append((_part(r, "comments", r.random() < 0.2), []))
        parts, texts = [x for x, _ in body], [t for _, own in body for t in own]
        called = r.choice(_CONTENT)
        box = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", f'<div class="{called}">{{}}</div>', f'<div id="{called}"><section>{{}}</section></div>', "<main><article>{}</article></main>", "<div>{}</div>", f'<article class="{called} {r.choice(_CALLED["side"])}">{{}}</article>', "<table><tr><td>{}</td></tr></table>", "{}"])
        head = r.choice(["", "", f"<header>{parts.pop(0)}</header>"]) if box.startswith(("<article", "<main><article")) else ""
        inner = box.format(head + "".join(parts))
        # what follows in the same column as the article
        if r.random() < 0.3:
            inner += _part(r, r.choice(["comments", "side", "form"]), r.random() < 0.2)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            inner = _wrapper(r).format(inner)
        before = "".join(_part(r, k, k in ("ad", "notice") and r.random() < 0.15) for k in r.sample(["nav", "nav", "header", "notice", "ad", "form", "side"], r.randint(1, 4)))
        after = "".join(_part(r, k, k in ("side", "comments") and r.random() < 0.3) for k in r.sample(["side", "ad", "comments", "comments", "form", "nav"], r.randint(0, 3))) + r.choice(["", _part(r, "footer"), _part(r, "footer"), _part(r, "footer")])
        page = before + inner + after
        if r.random() < 0.08:
            page = f"<form action=x>{page}</form>"
        title = f"<head><title>{texts[0]}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        out.append((f"<!DOCTYPE html><html>{title}<body>{page}</body></html>", texts))
    return out
