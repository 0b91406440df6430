"""A page's tree of block elements and its text blocks in page order.

Written for broken pages: unclosed and crossed tags, pages that end anywhere.
Inline elements don't break a block; they only mark text as linked.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard, in natural order.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg math canvas object audio video select".split())
#: Tags without an element of their own; what a head may hold is void, raw or dropped, and other text ends it.
BARE = frozenset("html head body".split())
#: Start tags of these end svg and math, except inside the elements of HTML_IN.
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_IN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: So many unclosed dropped elements of a name are looked for to their end; later ones end at the next block.
LOOKED_FOR = 8
#: Start tags of these end an open paragraph; the others in CLOSES end their own kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table body article section div main aside nav".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


@dataclass
class Tree:
    """Parallel lists over the nodes, parents before children; node 0 is the page."""

    tag: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    hint: list[str] = field(default_factory=lambda: [""])
    label: list[int | None] = field(default_factory=lambda: [None])  # of labelled pages
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])  # sentence marks
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text


class Skip:
    """The open elements of a dropped element, itself first."""

    def __init__(self, tag: str):
        self.tag, self.block = tag, None  # where the first block in it starts
        self.names, self.counts = [tag], {tag: 1}

    def open(self, tag: str):
        self.names.append(tag)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def close(self, tag: str) -> bool:
        """Close the innermost ``tag`` and what is inside it; whether that is all."""
        while True:
            last = self.names.pop()
            self.counts[last] -= 1
            if not self.counts[last]:
                del self.counts[last]
            if last == tag:
                return not self.names

    def html_in(self) -> bool:
        return not HTML_IN.isdisjoint(self.counts)


def parse(page: str) -> Tree:
    t = Tree()
    stack = [0]
    run: list[str] = []
    in_link = 0

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                n = stack[-1]
                t.blocks.append((n, text))
                t.chars[n] += len(text)
                t.marks[n] += sum(map(text.count, ".!?,;"))

    def add_text(raw: str):
        text = html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if in_link:
            t.linked[stack[-1]] += len(text.strip())

    def close(tags, scope=frozenset()):
        """Close the innermost open element among ``tags`` and what is inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if t.tag[stack[i]] in tags:
                flush()
                del stack[i:]
                return
            if t.tag[stack[i]] in scope:
                return

    pos, skip, end = 0, None, len(page)
    lost: dict[str, int] = {}  # dropped elements without their end tag, by name

    def unclosed(at):
        """End a skip without its end tag: at the first block in it, or ``at``."""
        nonlocal skip
        lost[skip.tag] = lost.get(skip.tag, 0) + 1
        at, skip = at if skip.block is None else skip.block, None
        return at

    while pos < end or (skip is not None and (pos := unclosed(end)) < end):
        lt = page.find("<", pos)
        if lt < 0:
            lt = end
        if lt > pos and skip is None:
            add_text(page[pos:lt])
        if lt == end:
            pos = end
            continue
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            pos = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                pos = end  # the page ends inside a tag
                continue
            if skip is None:
                add_text("<")
            pos = lt + 1
            continue
        pos = m.end()
        closing, tag = bool(m[1]), m[2].lower()
        if skip is not None and skip.tag in FOREIGN and not closing and tag in BREAKOUT and not skip.html_in():
            skip = None
        if tag in RAW and (skip is None or skip.tag not in FOREIGN or skip.html_in()):
            if not closing:
                flush()
                stop = re.compile(f"</{tag}", re.I).search(page, pos)
                if stop is None:
                    pos = end
                    continue
                gt = page.find(">", stop.end())
                pos = end if gt < 0 else gt + 1
            continue
        if skip is not None:
            if closing:
                if tag in skip.counts:
                    if skip.close(tag):
                        skip = None
                elif tag in ("body", "html") or any(t.tag[n] == tag for n in stack[1:]):
                    pos = unclosed(lt)
                continue
            if skip.block is None and (tag in ENDS_P or tag == "body"):
                skip.block = lt
                if lost.get(skip.tag, 0) >= LOOKED_FOR:
                    pos = unclosed(lt)
                    continue
            if tag not in VOID and not m[3].endswith("/"):
                skip.open(tag)
            continue
        if tag in DROPPED:
            if not closing and not m[3].endswith("/"):
                flush()
                skip = Skip(tag)
            continue
        if tag == "br":
            run.append(" ")
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        if tag in INLINE and not any(k in attrs for k in ("class", "id", "data-label")):
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in INLINE and (closing or not boilerplate_hint(hint_of(attrs))):
            if closing:
                close({tag}, SCOPES)
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in BARE and (not closing or tag == "head"):
            if tag == "body" and attrs.get("data-label") in ("0", "1"):
                t.label[0] = int(attrs["data-label"])
            flush()
            in_link = 0
            continue
        if closing:
            if tag == "p" and "p" not in (t.tag[n] for n in stack):
                flush()
            close({tag})
            in_link = 0
            continue
        flush()
        in_link = 0
        if tag in ENDS_P:
            close({"p"}, SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES)
        if tag in VOID:
            continue
        node = len(t.tag)
        t.tag.append(tag)
        t.parent.append(stack[-1])
        t.hint.append(hint_of(attrs))
        t.label.append(int(attrs["data-label"]) if attrs.get("data-label") in ("0", "1") else t.label[stack[-1]])
        t.chars.append(0)
        t.linked.append(0)
        t.marks.append(0)
        if not m[3].endswith("/"):
            stack.append(node)
    flush()
    return t


# Words of class, id and role names in English, German, French and Spanish, without accents, by what
# they usually mark.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip navegacion fil ariane migas",
    "advert": "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion promoted werbung anzeige "
    "anzeigen publicite pub publicidad anuncio anuncios",
    "side": "sidebar side aside widget related recommended more share sharing social follow tags popular trending "
    "seitenleiste teilen lateral laterale partager compartir relacionados",
    "comment": "comment comments commentlist disqus reply replies respond discussion kommentar kommentare antworten "
    "commentaire commentaires reponses comentario comentarios respuestas leserbriefe",
    "foot": "footer foot bottom copyright legal colophon credits fusszeile impressum pied mentions pie",
    "head": "header masthead top topbar logo brand branding hero kopf kopfzeile entete cabecera",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "search form paywall toast dialog hinweis anmeldung suche avis connexion recherche aviso suscripcion buscar",
    "content": "article content post entry story text main body prose page paragraph artikel inhalt beitrag contenu "
    "corps contenido articulo noticia cuerpo",
}
_HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}


def hint_of(attrs: dict[str, str]) -> str:
    """The kinds of words in class, id and role, joined by spaces."""
    named = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "aria-label"))
    if not named.strip():
        return ""
    split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()
    return " ".join(sorted({_HINT_OF[w] for w in re.split(r"[^a-z]+", split) if w in _HINT_OF}))


def boilerplate_hint(hint: str) -> bool:
    return bool(hint) and "content" not in hint
