"""The labelled table that the page classifier is trained on: pages as fragments, marked + where their blocks are main text.

Layouts of different sites (with and without elements that say what they are, with class names that mislead) are filled with sentences of several
languages, so that word counts and neighbours vary while the labels stay.
"""

from __future__ import annotations

import itertools
import re

# Sentences, longer ones, titles and short names, by language.
_TEXTS = {
    "en": (
        ["The council met on Monday and agreed to repair the old bridge.", "Work begins next week.", "It rained.", "Nobody was hurt, the fire brigade said.", "The mill stood still for a hundred years before a young couple bought it from the town."],
        [
            "Work begins next week and should end in spring, though the engineers warn that heavy rain may delay the plan by a month or more, as it did last year when the river rose above the lower road and cut off two farms.",
            "Members of the council said in a long statement that the money had been set aside two years ago, and that the town would not have to borrow for the repairs, whatever the price of stone and timber might be by then.",
            "Whoever walks along the river in the early morning meets herons, a few anglers and, since last summer, a family of beavers that has built its lodge where the old ferry used to land.",
        ],
        ["Old bridge to be repaired", "A river and its people", "How the town got its name"],
        ["Home", "News", "Sport", "About us", "Contact", "Archive", "Terms of use", "Privacy"],
    ),
    "de": (
        ["Der Rat beschloss am Montag, die alte Brücke zu erneuern.", "Die Arbeiten beginnen bald.", "Es regnete.", "Verletzt wurde niemand, teilte die Feuerwehr mit.", "Die Mühle stand hundert Jahre lang still, ehe ein junges Paar sie der Stadt abkaufte."],
        [
            "Die Arbeiten beginnen in der nächsten Woche und sollen im Frühjahr enden, doch warnen die Fachleute, dass starker Regen alles um einen Monat verzögern könnte, so wie im letzten Jahr, als der Fluss über die Ufer trat.",
            "Das Geld liege seit zwei Jahren bereit, hieß es in einer langen Erklärung, und die Stadt müsse für die Arbeiten keine Schulden machen, was immer Stein und Holz bis dahin kosten würden.",
        ],
        ["Alte Brücke wird erneuert", "Ein Fluss und seine Leute"],
        ["Start", "Nachrichten", "Sport", "Über uns", "Kontakt", "Archiv", "Impressum", "Datenschutz"],
    ),
    "fr": (
        ["Le conseil a décidé lundi de réparer le vieux pont.", "Les travaux commencent bientôt.", "Il pleuvait.", "Personne n'a été blessé, ont dit les pompiers.", "Le moulin est resté cent ans sans tourner avant qu'un jeune couple ne l'achète à la ville."],
        [
            "Les travaux commenceront la semaine prochaine et devraient finir au printemps, mais les ingénieurs préviennent que de fortes pluies pourraient tout retarder d'un mois, comme l'an dernier quand la rivière a coupé la route.",
            "L'argent est prêt depuis deux ans, disent les membres du conseil dans une longue lettre, et la ville n'aura pas à emprunter, quel que soit alors le prix de la pierre et du bois.",
        ],
        ["Le vieux pont sera réparé", "La rivière et ses gens"],
        ["Accueil", "Actualités", "Sport", "Qui sommes-nous", "Contact", "Archives", "Mentions légales"],
    ),
    "es": (
        ["El consejo decidió el lunes reparar el viejo puente.", "Las obras empiezan pronto.", "Llovía.", "Nadie resultó herido, dijeron los bomberos.", "El molino estuvo parado cien años hasta que una joven pareja se lo compró al pueblo."],
        [
            "Las obras empezarán la próxima semana y deberían terminar en primavera, aunque los ingenieros avisan de que las lluvias podrían retrasarlo todo un mes, como el año pasado, cuando el río cortó el camino de abajo.",
            "El dinero está listo desde hace dos años, dicen los miembros del consejo en una larga carta, y el pueblo no tendrá que pedir prestado, cueste lo que cueste entonces la piedra y la madera.",
        ],
        ["El viejo puente será reparado", "El río y su gente"],
        ["Inicio", "Noticias", "Deportes", "Quiénes somos", "Contacto", "Archivo", "Aviso legal"],
    ),
}

_NAV = "<ul><li><a href=/1>{N}</a></li><li><a href=/2>{N}</a></li><li><a href=/3>{N}</a></li><li><a href=/4>{N}</a></li></ul>"
_ROW = "<a href=/1>{N}</a> | <a href=/2>{N}</a> | <a href=/3>{N}</a>"

#: Layouts: {S} a sentence, {L} a longer one, {T} a title, {N} a short name.
_LAYOUTS: list[list[tuple[str, str]]] = [
    # Pages that say what their parts are.
    [
        ("-", f"<head><title>x</title></head><body><nav>{_NAV}</nav><div class='ad'>{{S}}</div>"),
        ("+", "<article><h1>{T}</h1><p>{S}</p><p>{N}?</p><p>{L}</p><p>{S}</p><p>{N}.</p><p>{L}<br>{S}</p><p>{N}</article>"),
        ("-", "<footer>&copy; 2020 {N} &middot; {S}</footer></body>"),
    ],
    [
        ("-", f"<header><div>{{N}}</div><div>{{S}}</div></header><div id=menu>{_ROW}</div>"),
        ("+", "<main><h1>{T}</h1><p>{S}</p><ul><li>{N}</li><li>{S}</li></ul><p>{L}</p></main>"),
        ("-", "<aside><h3>{T}</h3><ul><li><a href=1>{T}</a></li><li><a href=2>{T}</a></li></ul><p>{L}</p><p>{S}</p></aside>"),
        ("-", "<section class='comments'><h2>3 {N}</h2><p>{L}</p><p>{N}!</p><p>{S}</p></section><footer><p>{N}</p><p>{L}</p></footer>"),
    ],
    [
        ("+", "<article><header><h1>{T}</h1><p>{N}</p></header><p>{L} <a href=x>{N}</a></p><h2>{T}</h2><p><a href=y>{S}</a></p><figure><figcaption>{T}</figcaption></figure><p>{S}</p>"),
        ("-", "<div class='share-buttons'><a href=f>{N}</a> <a href=t>{N}</a></div><div class='newsletter-box'><p>{S}</p></div><aside><p>{L}</p></aside><p class=advert>{S}</p><div class=notice>{S}</div><div class='alert'><p>{N}</p></div><form action=f><p>{N}</p><p>{S}</p></form>"),
        ("+", "<p>{N}.</p><div><p>{S}</p></div></article>"),
        ("-", "<section id=comments><article><p>{S}</p><p>{L}</p><p>{N}</p></article></section>"),
    ],
    [
        ("-", f"<div class='promo banner'>{{S}}</div><nav><p>{{N}}</p></nav><nav>{_NAV}</nav><div class=ads>{{T}}</div>"),
        ("+", "<article><h1>{T}</h1><p>{S}</p></article>"),
        ("-", "<footer>{N} {S} {S}</footer>"),
    ],
    [("-", f"<nav>{_NAV}</nav><div class=ad>{{L}}</div>"), ("+", "<article><p>{N}</p></article>"), ("-", "<footer>&copy; {L}</footer>")],
    [
        ("-", "<body><div>{S}</div><div>{T}</div>"),
        ("+", "<article><h1>{T}</h1><p>{S}</p><p><a href=y>{S}</a></p><p>{L}</p><p>{L}</p><p>{S}</p></article>"),
        ("-", "<div><p>{S}</p><p>{S}</p></div><ul><li><a href=1>{T}</a></li><li><a href=2>{T}</a></li></ul><div class=widget><p>{L}</p></div></body>"),
    ],
    [("-", f"<nav>{_NAV}</nav><div class=ad>{{S}}</div>"), ("+", "<article><h1>{N}</h1><p>{N}</p></article>"), ("-", "<footer>{S} {N}</footer>")],
    [("-", f"<nav>{_NAV}</nav><div class=sponsor>{{T}}</div><aside>{{L}}</aside>"), ("+", "<main><p>{T}</p></main>"), ("-", "<aside>{N}</aside><footer>{L} {S}</footer>")],
    [("-", "<header><p>{S}</p></header><nav>{N}</nav><nav>{T}</nav>"), ("+", "<div><p>{L}</p><p>{L}</p><p>{S}</p><p>{L}</p></div>"), ("-", "<aside><p>{S}</p><p>{N}</p><p>{L}</p></aside><footer><p>{S}</p></footer>")],
    [("-", "<nav><a href=1>{N}</a></nav><aside><p>{S}</p></aside>"), ("+", "<div><p>{L}</p><p>{S}</p></div>"), ("-", "<aside><p>{S}</p></aside>"), ("+", "<div><p>{S}</p><p>{L}</p></div>"), ("-", "<footer><p>{L}</p><p>{N}.</p></footer>")],
    # Class names that mislead.
    [
        ("-", f"<div class=top>{_ROW}</div>"),
        ("+", "<article class='search-page'><h1>{T}</h1><div class='alert-news'><p>{L}</p><p>{N}</p><p>{S}</p></div><p class=legal>{S}</p><p class='legal'>{L}</p><div class='header-image-text'><p>{N}.</p></div><div class=widget><p>{L} {L}</p></div><h2 class=tags>{T}</h2></article>"),
        ("-", "<div class='cookie-notice'>{S} <a href=c>{N}</a></div>"),
    ],
    [
        ("-", "<div class='site-header'><div>{N}</div></div>"),
        ("+", "<div class='post-search-results'><article class='menu-review'><h1>{T}</h1><p>{S}</p><div class='side-by-side'><p>{S}</p><p>{N}</p></div><p>{L}</p></article></div>"),
        ("-", "<div class='related'><h4>{N}</h4><p><a href=1>{T}</a></p></div>"),
    ],
    [
        ("-", f"<div class=social>{_ROW}</div>"),
        ("+", "<div class='left-rail-free sidebar-off'><article class=banner-less><p>{L}</p><p>{S}</p><div class='social-history'><p>{L}</p><p>{S}</p></div><section class='ad-campaign-analysis'><p>{L}</p><p>{L}</p></section></article></div>"),
        ("-", "<div id='site-footer'>{N} {S}</div>"),
    ],
    [
        ("-", f"<form action=s><label>{{N}}</label><p>{{N}}</p><p>{{S}}</p></form><div>{_ROW}</div>"),
        ("+", "<form id=page><div><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{L}</p></div></form>"),
        ("-", "<form><p>{N}</p><fieldset><legend>{N}</legend><p>{T}</p></fieldset></form>"),
    ],
    [
        ("-", f"<form id=all><div class=navbar>{_ROW}</div>"),
        ("+", "<article><h1>{T}</h1><p>{S}</p><p>{N}</p><p>{L}</p></article>"),
        ("-", "<div class=footer>{N}</div></form>"),
    ],
    # Pages whose parts are only boxes: words, links and neighbours tell.
    [
        ("-", f"<div class=navbar>{_ROW}</div><div class='cookie-notice'><p>{{S}} <a href=c>{{N}}</a></p></div>"),
        ("+", "<div class=content><h1>{T}</h1><p>{L}</p><p>{S}</p><p>{N}.</p><blockquote>{S}</blockquote><p>{L}</p></div>"),
        ("-", "<div class=related><h4>{N}</h4><p><a href=1>{T}</a></p></div><form action=s><p>{N}</p><label>{N}</label></form><div id='footer'>{S}</div>"),
    ],
    [
        ("-", f"<body><div>{_ROW}</div>"),
        ("+", "<div><h1>{T}</h1><p>{S}</p><p>{L}</p><p>{L} {S}</p><p>{S}</p><p>{L}</p></div>"),
        ("-", "<div><a href=d>{N}</a> | <a href=e>{N}</a></div>"),
    ],
    [
        ("-", "<table><tr><td><a href=1>{N}</a></td><td><a href=2>{N}</a></td><td><a href=3>{N}</a></td></tr></table>"),
        ("+", "<table><tr><td><p>{L}</p><p>{S}</p><p>{L}</p><p>{L}</p></td></tr></table>"),
        ("-", "<p><a href=4>{N}</a> <a href=5>{N}</a></p><p><a href=6>{N}</a></p>"),
    ],
    [
        ("-", "<p><a href=1>{T}</a></p><p><a href=2>{S}</a></p><p><a href=3>{T}</a></p>"),
        ("+", "<div><h1>{T}</h1><p>{S}</p><p>{L}</p><p>{S} <a href=x>{N}</a></p><p>{L}</p></div>"),
        ("-", "<p><a href=4>{S}</a></p><p><a href=5>{T}</a></p><p><a href=6>{N}</a></p>"),
    ],
    [
        ("-", "<div>{N}</div><div>{N}</div><div>{T}</div><div>{N}</div><div>{N}</div>"),
        ("+", "<div>{L}</div><div>{L}</div><div>{S}</div><div>{L}</div>"),
        ("-", "<div>{N}</div><div>{N}</div><div>{N}</div><div>{N}</div><div>{T}</div>"),
    ],
    [
        ("-", "<ul><li>{N}</li><li>{N}</li><li>{N}</li><li>{N}</li></ul><div>{N}</div><div>{N}</div>"),
        ("+", "<section><h2>{T}</h2><p>{L}</p><p>{L}</p><ul><li>{S}</li><li>{N}</li></ul><p>{L}</p></section>"),
        ("-", "<div class=widget><p>{L}</p></div><div>{N}</div><div>{N}</div><div>{N}</div>"),
    ],
    [("-", f"<nav>{_NAV}</nav>"), ("+", "<section><h2>{T}</h2><p>{L}</p><p>{L}</p></section>"), ("-", "<div class='comments'><p>{L}</p><p>{S}</p><div class=replies><p>{L}</p></div></div>")],
    [("+", "{L} {S}<p>{L}<p>{S}"), ("-", f"<hr>{_ROW}")],
    [("+", "{S}")], [("+", "{T}")], [("+", "<p>{N}</p>")], [("+", "<div>{N} {T}</div>")],
    [("+", "<p>{L}</p>")],
    [("+", "<h1>{T}</h1><p>{S}</p>")],
    # Long paragraphs between short lines, headings and lists.
    [
        ("-", f"<div><a href=/>{{N}}</a></div><div>{_ROW}</div>"),
        ("+", "<h1>{N}</h1><p>{L} <a href=x>{N}</a>.</p>"), ("-", "<div class=toc role=navigation><h2>{N}</h2><ul><li><a href=1>{N}</a></li><li><a href=2>{T}</a></li></ul></div>"),
        ("+", "<h2>{T}</h2><p>{S} {L}</p><ul><li>{T}</li><li>{T}</li></ul><p>{L}</p><h2>{N}</h2><p>{L}</p><h3>{T}</h3><p>{S} {S}</p>"),
        ("-", "<div>{N}</div><ul><li><a href=3>{N}</a></li></ul>"),
    ],
    [("-", "<div>{N}</div><div>{T}</div><div>{N}</div>"), ("+", "<div>{L}</div>"), ("-", "<div>{N}</div><div>{N}</div>"), ("+", "<div>{S} {L}</div>"), ("-", "<div>{T}</div><div>{N}</div>")],
    [("-", "<td><a href=1>{N}</a></td>"), ("+", "<td>{L}</td>"), ("-", "<td><a href=2>{N}</a></td><td>{N}</td>")],
    [("-", f"{_ROW}<hr>"), ("+", "<h1>{T}</h1><p>{L}</p>"), ("-", "<p>{N}</p><p><a href=1>{N}</a></p>")],
    [("-", "<div id=top>{N}</div>"), ("+", "<div role=main><h1>{N}</h1><p>{S}</p><p>{N}</p><ul><li>{N}</li><li>{T}</li></ul></div>"), ("-", "<div role=contentinfo>{S}</div>")],
    # Little outside an article, much outside it, and two articles.
    [
        ("-", "<div>{N}</div>"), ("+", "<article><h2>{T}</h2><p>{S}</p></article>"), ("-", "<div class=promo>{S}</div>"),
        ("+", "<article><h2>{T}</h2><p>{L}</p></article>"), ("-", "<div>{S}</div><div class=pagination><a href=2>{N}</a></div>"),
    ],
    [
        ("-", "<aside><article><h4>{T}</h4><p>{S}</p></article></aside><div class='sidebar'><p>{L}</p><p>{L}</p><p>{S}</p></div>"),
        ("+", "<div class=post><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{S}</p><p>{L}</p></div>"),
        ("-", "<footer><p>{L}</p></footer>"),
    ],
]


#: Blocks of every length, in what says what it is: an opening and closing tag, and the mark of what is inside (? stands for + from
#: ``LONG`` words: in an article, a class that names boilerplate is not believed of long texts).
_SHELLS = [
    ("<article>", "</article>", "+"), ("<main><div>", "</div></main>", "+"), ("<article class='tag-news side'><div class=header>", "</div></article>", "+"),
    ("<form><article>", "</article></form>", "+"), ("<nav>", "</nav>", "-"), ("<aside>", "</aside>", "-"), ("<footer>", "</footer>", "-"), ("<header>", "</header>", "-"),
    ("<article><aside>", "</aside></article>", "-"), ("<div class='comment-list'>", "</div>", "-"), ("<article><div id=comments>", "</div></article>", "-"),
    ("<article><nav>", "</nav></article>", "-"), ("<article><div class='share-links'>", "</div></article>", "-"),
    ("<div class='cookie-notice'>", "</div>", "-"), ("<div id=sidebar>", "</div>", "-"), ("<div class=ad>", "</div>", "-"),
    ("<article><div class='promo'>", "</div></article>", "?"), ("<main><section class='banner box'>", "</section></main>", "?"),
    ("<section id=comments><article>", "</article></section>", "-"), ("<article><section class=comments><article>", "</article></section></article>", "-"),
]
_LENGTHS = (1, 2, 4, 1, 9, 30, 2, 75, 5, 200, 15, 3, 1, 45)
LONG = 45


def _of_any_length(words: list[str], turn: int) -> list[tuple[str, str]]:
    """A page of shells with blocks whose lengths go through ``_LENGTHS``; every other one ends within an article."""
    at, out = turn, []
    for k in range(4):
        opening, closing, mark = _SHELLS[(turn + k * (1 + turn % 3)) % len(_SHELLS)]
        out.append((mark, opening))
        for _ in range(1 + (turn + k) % 5):
            n = _LENGTHS[at % len(_LENGTHS)]
            at += 1
            own = " ".join(words[(at + j) % len(words)] for j in range(n)) + ("." if at % 3 else "")
            tag = ("p", "li", "p", "h3", "div")[(turn * 2 + k + at) % 5] if mark != "?" else "p"
            block = f"<{tag}><a href=x>{own}</a></{tag}>" if (turn + k) % 3 == 0 and mark != "?" else f"<{tag}>{own}</{tag}>"
            out.append((mark if mark != "?" else "+" if n >= LONG else "-", block))
        out.append((mark, closing))
    if turn % 2:
        out.append(("+", "<article><h1>" + words[turn % len(words)] + "</h1><p>" + " ".join(words[: 1 + turn % 7])))
    return out


def _of_boxes(words: list[str], turn: int) -> list[tuple[str, str]]:
    """A page without names: lists of links and short lines around paragraphs, of which only some are short or end like sentences."""

    def line(n: int, k: int, end: str = "") -> str:
        return " ".join(words[(turn * 7 + k * 5 + j) % len(words)] for j in range(n)) + end

    tag = ("p", "div", "td", "li")[turn % 4]
    links = "".join(f"<{tag}><a href={k}>{line(1 + (turn + k) % 6, k)}</a></{tag}>" for k in range(2 + turn % 5))
    lines = "".join(f"<{tag}>{line(1 + (turn * k) % 5, k, '.' if (turn + k) % 4 == 0 else '')}</{tag}>" for k in range(1, 3 + turn % 3))
    sizes = [n for k in range(3 + turn % 5) for n in ((18, 60, 35, 120, 25)[(turn + k) % 5], (4, 9, 0, 2, 0, 14)[(turn * 2 + k) % 6]) if n]
    linked = [f"<a href=x>{line(n // 3, k)}</a> " if n > 15 and (turn + k) % 3 == 0 else "" for k, n in enumerate(sizes)]
    text = "".join(f"<p>{a}{line(n, k, '.' if n < 15 or (turn + k) % 2 else '')}</p>" for k, (a, n) in enumerate(zip(linked, sizes, strict=True))) + f"<p>{line(30, 1, '.' if turn % 2 else '')}</p>"
    head = f"<h1>{line(3 + turn % 5, 2)}</h1>" if turn % 3 else ""
    return [("-", "<div>" + (links if turn % 2 else lines + links) + "</div>"), ("+", f"<div>{head}{text}</div>"), ("-", f"<div>{links if turn % 3 else lines + links + lines}</div>")]


def pages() -> list[list[tuple[str, str]]]:
    """The labelled pages: every layout in every language, and some made by rule."""
    out = []
    for sentences, longer, titles, names in _TEXTS.values():
        for k, layout in enumerate(_LAYOUTS):
            turns = {kind: itertools.cycle(own[k % len(own) :] + own[: k % len(own)]) for kind, own in (("S", sentences), ("L", longer), ("T", titles), ("N", names))}
            out.append([(mark, re.sub(r"\{([SLTN])\}", lambda m, t=turns: next(t[m[1]]), fragment)) for mark, fragment in layout])
        words = " ".join(longer).split()
        out += [_of_any_length(words, turn) for turn in range(40)] + [_of_boxes(words, turn) for turn in range(30)]
    return out
