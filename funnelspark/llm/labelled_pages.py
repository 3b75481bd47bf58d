"""Labelled pages for the main-text model: made by a seeded generator that knows what each part of a page is.

A page is put together from parts; every part carries ``data-y="1"`` (main text) or ``data-y="0"``
(menus, notices, forms, comments and the like) on its outermost element, and what stands inside an
element has its mark unless marked itself.  The text is filler: only its shape (length, links,
punctuation) matters to the model.
"""

from __future__ import annotations

import random

#: Words that sites put into class and id attributes of parts that are not main text.
ASIDE_NAMES = (
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "bottom",
    "copyright", "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored",
    "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "form",
    "share", "social", "related", "recommended", "trending", "tags", "pagination", "pager", "skip", "toolbar", "legal", "disclaimer")
COMMENT_NAMES = ("comments", "comment", "respond", "replies", "reply", "discussion", "disqus", "responses")
MAIN_NAMES = ("article", "post", "content", "entry", "main", "story", "text", "body", "blog", "page", "prose", "richtext")
#: What parts that are not main text say of themselves, where no class or id does.
COMMENT_HEADS = ("Comments", "3 Comments", "Comments (12)", "1 Comment", "Leave a comment", "Leave a reply", "Replies", "Responses", "Reader comments",
                 "What readers say", "Readers write", "Join the discussion", "Discussion")
ADVERT_HEADS = ("Advertisement", "Advert", "Ad", "Sponsored", "Sponsored content", "Promoted", "Promotion", "Anzeige")
BOX_HEADS = ("Related", "Related stories", "Related articles", "Read next", "More from us", "Recommended", "You may also like", "Most read", "Trending", "Popular",
             "Newsletter", "Subscribe", "Sign up", "Follow us", "Share this", "Share", "About us", "Tags", "Categories", "Archive")
NOTICES = ("This site uses cookies to {}", "We use cookies and {}", "By using this site you accept our cookies {}", "Sign up for {}", "Subscribe to {}",
           "Log in to {}", "Copyright 2020 {}. All rights reserved.", "© {}. All rights reserved.", "All rights reserved {}")
SOURCE_HEADS = ("Sources", "References", "Notes", "See also", "Further reading", "Bibliography", "Links")
_FILLER = ("ta remo kelin sor vane the ilo of musk dera pont and arel fin oro be tansel mir coda with hest lupa "
           "galen is orvel sint da meru plax on torin").split()


def _sentence(rng: random.Random, n: int) -> str:
    words = [rng.choice(_FILLER) for _ in range(max(1, n))]
    if n > 6:
        words[rng.randrange(1, n - 1)] += ","
    return " ".join(words).capitalize() + "."


def _prose(rng: random.Random) -> str:
    n = rng.choice((1, 1, 2, 3, 5, 9))
    out = " ".join(_sentence(rng, rng.choice((1, 2, 4, 8, 14, 25))) for _ in range(n))
    if rng.random() < 0.2:
        out += f' <a href="/x">{rng.choice(_FILLER)}</a> {_sentence(rng, 6)}'
    return out if rng.random() < 0.85 else f"<b>{out}</b>"


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_sentence(rng, rng.choice((1, 1, 2, 5)))[:-1]}</a></li>' for i in range(n))


def _named(rng: random.Random, names: tuple[str, ...]) -> str:
    name = rng.choice(names)
    if rng.random() < 0.3:
        name += rng.choice(("-wrapper", "-box", "_inner", " block", "-1"))
    return f' {rng.choice(("class", "class", "id"))}="{name}"'


def _box(rng: random.Random) -> str:
    """A part that is not main text and has no telling names: its words, links and place have to do."""
    kind = rng.randrange(7)
    tag = rng.choice(("div", "div", "section", "aside"))
    head = lambda names: f"<{rng.choice(('h2', 'h3', 'h4', 'h4', 'b', 'p'))}>{rng.choice(names)}</>"
    close = lambda text: text.replace("</>", f"</{text[1:text.index('>')]}>", 1)
    if kind == 0:
        return f'<{tag} data-y="0">{close(head(BOX_HEADS[:10]))}<ul>{_links(rng, rng.randrange(2, 6))}</ul></{tag}>'
    if kind == 1:
        return f'<div data-y="0"><a href="/x">{_sentence(rng, rng.choice((3, 6)))[:-1]}</a></div>'
    if kind == 2:
        label = rng.choice(("<small>{}</small>", "<span>{}</span><br>", "<p>{}</p>", "<h4>{}</h4>")).format(rng.choice(ADVERT_HEADS))
        return f'<{tag} data-y="0">{label}<p>{_sentence(rng, rng.choice((4, 8, 12)))}</p></{tag}>'
    if kind == 3:
        return f'<{tag} data-y="0">{close(head(BOX_HEADS[10:]))}<p>{_sentence(rng, rng.choice((4, 9)))}</p>{rng.choice(("<form><input><button>" + rng.choice(_FILLER) + "</button></form>", ""))}</{tag}>'
    if kind == 4:
        text = rng.choice(NOTICES).format(_sentence(rng, rng.choice((2, 5)))[:-1].lower())
        inner = rng.choice((f"<p>{text}</p><button>{rng.choice(_FILLER)}</button>", f"<p>{text}</p>", text))
        return f'<div data-y="0"{rng.choice(("", "", " role=dialog"))}>{inner}</div>'
    if kind == 5:
        between = rng.choice((" | ", " ", " / ", "<br>"))
        return f'<{rng.choice(("div", "p", "div"))} data-y="0">{between.join(f"<a href=/{i}>{rng.choice(_FILLER)}</a>" for i in range(rng.randrange(2, 7)))}</div>'
    return f'<ol data-y="0">{_links(rng, 2)}<li>{rng.choice(_FILLER)}</li></ol>'


def _aside(rng: random.Random) -> str:
    if rng.random() < 0.35:
        return _box(rng)
    kind = rng.randrange(9)
    if kind == 0:
        return f'<nav data-y="0"{_named(rng, ASIDE_NAMES[:5]) if rng.random() < .5 else ""}><ul>{_links(rng, rng.randrange(2, 9))}</ul></nav>'
    if kind == 1:
        name = _sentence(rng, 2)[:-1]
        name = f'<a href="/">{name}</a>' if rng.random() < 0.4 else name
        rest = "".join(rng.sample((f"<p>{_sentence(rng, 4)}</p>", f"<ul>{_links(rng, 3)}</ul>", f"<nav><ul>{_links(rng, 4)}</ul></nav>"), rng.randrange(3)))
        return f'<header data-y="0"{_named(rng, ASIDE_NAMES) if rng.random() < .3 else ""}><h1>{name}</h1>{rest}</header>'
    if kind == 2:
        if rng.random() < 0.35:
            return f'<footer data-y="0">{rng.choice(("", "<nav>"))}<ul>{_links(rng, rng.randrange(1, 5))}</ul></footer>'
        return f'<footer data-y="0">&copy; {_sentence(rng, 2)} <a href="/a">{rng.choice(_FILLER)}</a> {_sentence(rng, rng.choice((0, 3, 9)))}</footer>'
    if kind == 3:
        return f'<aside data-y="0"><h3>{_sentence(rng, 2)[:-1]}</h3><ul>{_links(rng, 5)}</ul><p>{_sentence(rng, 9)}</p></aside>'
    if kind == 4:
        return (f'<form data-y="0" action="/s"><label>{_sentence(rng, 2)[:-1]}</label><input name="q"><select><option>{rng.choice(_FILLER)}</option>'
                f'</select><button>{rng.choice(_FILLER)}</button><p>{_sentence(rng, 8)}</p></form>')
    tag = rng.choice(("div", "div", "div", "section", "ul" if kind == 5 else "div", "p" if kind == 6 else "div"))
    inner = _links(rng, 4) if tag == "ul" else (_sentence(rng, rng.choice((3, 9, 20))) if tag == "p" or rng.random() < 0.6 else
                                               f"<h4>{_sentence(rng, 2)[:-1]}</h4><p>{_prose(rng)}</p>")
    return f'<{tag} data-y="0"{_named(rng, ASIDE_NAMES)}>{inner}</{tag}>'


def _comments(rng: random.Random) -> str:
    named = rng.random() < 0.5
    names = lambda: _named(rng, COMMENT_NAMES) if named else ""
    t = rng.choice(("div", "div", "li", "li", "article"))
    who = lambda: rng.choice(("", f"<b>{rng.choice(_FILLER).capitalize()}</b> ", f"<span>{rng.choice(_FILLER).capitalize()}, 3 May</span>"))
    each = "".join(f"<{t}{names()}>{who()}<p>{_prose(rng)}</p></{t}>" for _ in range(rng.randrange(1, 5)))
    each = f"<{rng.choice(('ul', 'ol'))}>{each}</ul>" if t == "li" and rng.random() < 0.7 else each
    h = rng.choice(("h2", "h3", "h4"))
    head = _sentence(rng, rng.choice((1, 2)))[:-1] if named and rng.random() < 0.5 else rng.choice(COMMENT_HEADS)
    box = "section" if rng.random() < 0.4 else "div"
    return f'<{box} data-y="0"{names()}><{h}>{head}</{h}>{each}</{box}>'


def _table(rng: random.Random) -> str:
    cell = lambda tag: f"<{tag}>{_sentence(rng, rng.choice((1, 1, 2, 4)))[:-1]}</{tag}>"
    wide = rng.choice((2, 2, 3))
    caption = f"<caption>{_sentence(rng, 4)[:-1]}</caption>" if rng.random() < 0.4 else ""
    head = "<tr>" + cell("th") * wide + "</tr>"
    head = f"<thead>{head}</thead>" if rng.random() < 0.5 else head
    rows = "".join("<tr>" + (cell("th") if rng.random() < 0.3 else cell("td")) + "".join(cell("td") for _ in range(wide - 1)) + "</tr>" for _ in range(rng.randrange(1, 4)))
    return f"<table>{caption}{head if rng.random() < .7 else ''}{f'<tbody>{rows}</tbody>' if rng.random() < .5 else rows}</table>"


def _main(rng: random.Random) -> str:
    parts = [f"<h1>{_sentence(rng, rng.choice((1, 2, 6, 10)))[:-1]}</h1>"] if rng.random() < 0.8 else []
    plain = rng.random() < 0.12  # no paragraphs, only divs
    for _ in range(rng.choice((1, 2, 4, 8))):
        kind = rng.random()
        if kind < 0.6:
            text = _prose(rng)
            parts.append(f"<div>{text}</div>" if plain else f"<p>{text}</p>" if rng.random() < 0.8 else f"<p>{text}")
        elif kind < 0.68:
            parts.append(f"<h2>{_sentence(rng, 3)[:-1]}</h2>")
        elif kind < 0.74:
            parts.append("<ul>" + "".join(f"<li>{_prose(rng)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.76:
            parts.append(f"<ul><li>{_sentence(rng, 1)[:-1]}<ul><li>{_sentence(rng, 2)[:-1]}</li></ul></li><li>{_sentence(rng, 1)[:-1]}</li></ul>")
        elif kind < 0.81:
            note = rng.choice(("", f"<footer>{_sentence(rng, 3)[:-1]}</footer>", f"<p><cite>{_sentence(rng, 2)[:-1]}</cite></p>"))
            parts.append(f"<blockquote><p>{_prose(rng)}</p>{note}</blockquote>")
        elif kind < 0.85:
            parts.append(rng.choice(("<pre>{}</pre>", "<pre><code>{}</code></pre>")).format(_sentence(rng, 5)))
        elif kind < 0.9:
            parts.append(_table(rng))
        elif kind < 0.95:
            parts.append(f"<figure><img src=a.jpg><figcaption>{_sentence(rng, rng.choice((3, 8)))}</figcaption></figure>")
        else:
            parts.append("<dl>" + "".join(f"<dt>{_sentence(rng, 1)[:-1]}</dt><dd>{_sentence(rng, rng.choice((2, 6)))}</dd>" for _ in range(2)) + "</dl>")
    if rng.random() < 0.3:
        kind = rng.choice(("ul", "ol"))
        parts.append(f"<h2>{rng.choice(SOURCE_HEADS)}</h2><{kind}>{_links(rng, rng.randrange(1, 5))}</{kind}>")
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        parts.insert(rng.randrange(len(parts) + 1), _aside(rng))
    if rng.random() < 0.25 and parts[0].startswith("<h1"):
        parts[0] = f"<header>{parts[0]}<p>{rng.choice((_sentence(rng, 3), 'By ' + _sentence(rng, 2)[:-1]))}</p></header>"
    tag = "div" if plain else rng.choice(("article", "article", "article", "main", "main", "div", "div", "div", "section", "td", "td"))
    names = "" if plain else _named(rng, MAIN_NAMES) if tag in ("div", "td", "section") and rng.random() < 0.8 or rng.random() < 0.3 else ""
    if rng.random() < 0.25:
        parts.append(_comments(rng))
    whole = f'<{tag} data-y="1"{names}>{"".join(parts)}</{tag}>'
    if tag == "td":
        menu = "<br>".join(f"<a href=/{i}>{rng.choice(_FILLER)}</a>" for i in range(rng.randrange(2, 6)))
        return f'<table><tr>{f"<td data-y=0>{menu}</td>" if rng.random() < .85 else ""}{whole}</tr></table>'
    return f'<main data-y="1">{whole}</main>' if tag != "main" and rng.random() < 0.15 else whole


def labelled_pages(n: int = 400, seed: int = 3) -> list[str]:
    """``n`` marked pages, the same for the same seed."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if rng.random() < 0.08:  # hardly any markup
            bare = rng.choice(('<p data-y="1">{}</p>', '<body><div data-y="1">{}</div></body>', '<div data-y="1">{}<br>{}</div>', '<body><p data-y="1">{}</p></body>',
                               '<h1 data-y="1">{}</h1><p data-y="1">{}</p>', '<p data-y="1">{}</p><p data-y="1">{}</p><p data-y="1">{}</p>'))
            out.append("".join(x + (_prose(rng) if rng.random() < 0.6 else _sentence(rng, rng.choice((1, 3, 5)))[:-1]) for x in bare.split("{}")[:-1]) + bare.split("{}")[-1])
            continue
        top = [_aside(rng) for _ in range(rng.randrange(0, 4))]
        end = [_aside(rng) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.4:
            end.insert(0, _comments(rng))
        middle = _main(rng)
        if rng.random() < 0.4:
            middle = f'<div{_named(rng, ("wrapper", "container", "page", "site", "row", "layout"))}>{middle}{_aside(rng)}</div>'
        out.append(f"<html><body>{''.join(top)}{middle}{''.join(end)}</body></html>")
    return out
