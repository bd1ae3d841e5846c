"""Main text of web pages: flat text blocks, classified by a small decision tree.

The page is cut into blocks at block-level tags.  A block's features are its word count and link density,
those of the blocks before and after it, how surely an enclosing element is boilerplate (menu, header, footer,
sidebar, notice, advert, form, comments), whether one is main (article, main), if the page has any, and which
share of the page's words stands in the element around it that perhaps is boilerplate: a wrapper of nearly the
whole page is none.  A class or id says so surely only if its head noun does ('story-comments', 'ad-slot'); a word
that qualifies another ('comments-open', 'overlay-networks') is a hint.  The tree is grown here, by
Gini impurity, on the labelled blocks of the small pages in PAGES, whose neighbours are their real ones: it
tells a heading from a menu entry, or a linked sentence from a list of links, by what stands beside it.

Edge cases: null html is empty; unclosed and stray tags are tolerated; a page cut in the middle of a tag or
comment loses only that rest; attributes may be of any length and hold '>' in quotes; a quote that is never
closed is an ordinary character; white space of any kind inside a block becomes one space; links may enclose
blocks; very long pages are read once, in linear time and memory; other columns, whatever their names, never
reach Python, and repeated rows come out as often as they came in.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_texts

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*(?:-[a-zA-Z0-9-]*)?)")
STOP = re.compile("[<>\"']")
VALUE = re.compile(r"=\s*\Z")
#: Elements that are never shown, and what ends them.
UNSEEN = {name: re.compile(rf"</{name}(?=[\s>/]|\Z)[^>]*(?:>|\Z)", re.I) for name in "script style noscript template svg iframe textarea select title".split()}
ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN_ATTR = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words that mark boilerplate as a whole class or id, or as its head: the last word but for those of HOLDERS.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion navbar submenu breadcrumb breadcrumbs masthead sidebar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login paywall searchbox comment comments commentlist reply replies respond disqus pagination".split()
)
#: Words that name a box or its place, after the word that tells what is in it.
HOLDERS = frozenset(
    "list lists section area box block container wrapper wrap inner outer item items body text content title heading header footer head slot unit bar form panel pane "
    "message banner button link links top bottom left right center middle inline main small large fixed sticky primary secondary wide mobile desktop".split()
)
#: Of these words, those that an article element or an id within a main element may bear.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())
#: A heading that opens reader comments, in the languages of the pages at hand.
COMMENT_HEADING = re.compile(r"(?:\(?\d+\)? )?(?:(?:reader |readers' |user |leave a |post a |add a |all )?(?:comments?|reply|replies)|(?:leser)?kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of an article of its own beside which an article inside it is a reader's comment.
OWN_WORDS = 20
#: Words that do so only as a whole class or id, and only outside a main element: a hint that the tree weighs.
WEAK_WORDS = frozenset(
    "banner nav navigation menu header topbar footer foot bottombar side aside widget widgets rail alert subscription form search discussion share sharing social "
    "related recommended recommendations pager tags copyright legal disclaimer".split()
)
#: Beginnings of classes that only tell what a page has ('with-sidebar', 'no-comments').
ABOUT = ("no-", "with-", "without-", "has-", "is-")

#: Small labelled pages.  A block: enclosing elements, words/words in links, 1 if main text.
PAGES = (
    "nav,ul,li 1/1 0; nav,ul,li 2/2 0; nav,ul,li 1/1 0; div.ad 14/0 0; article,h1 9/0 1; article,p 60/0 1; article,p 1/0 1; article,p 45/4 1; footer 12/1 0",
    "header 3/3 0; header 6/0 0; main,h1 5/0 1; main,p 2/0 1; main,p 120/0 1; main,p 4/4 1; main,p 80/2 1; main,ul,li 6/0 1; main,ul,li 9/0 1; aside,h3 2/0 0; aside,p 60/0 0; footer 30/0 0",
    "article,h1 7/0 1; article,div.comments,p 40/0 0; article,div.comments,p 90/0 0; article,p 300/10 1; article,p.advert 25/0 0; article,p 50/0 1; article,form,p 30/0 0; article,p 12/9 1; article,p 70/0 1",
    "article,h2 4/0 1; article,p 55/0 1; article,ul,li 5/5 0; article,ul,li 4/4 0; article,ul,li 6/6 0; article,ul,li 3/3 0",
    "article,p 30/0 1; article,p 6/6 1; article,p 40/0 1; article,h3 3/0 1; article,p 25/8 1; article,h3 2/2 1; article,p 33/0 1; article,ul,li 7/7 0; article,ul,li 9/9 0; article,ul,li 5/5 0",
    "div,a 2/2 0; div,a 1/1 0; div,p 1/0 0; div,a 3/3 0; div,h1 8/0 1; div,p 70/2 1; div,p 5/0 1; div,p 90/0 1; div,p 2/0 1; div,p 40/0 1; div,a 3/3 0; div,p 4/0 0; div,a 2/2 0; div,p 3/1 0",
    "div.header,p 5/0 0; div.header,a 2/2 0; div,h1 6/0 1; div,p 50/0 1; div,p 80/10 1; div.legal,p 60/0 1; div,p 35/0 1; div.related,a 6/6 0; div.related,a 5/5 0; div.footer,p 15/2 0",
    "div.menu,a 1/1 0; div.menu,p 3/0 0; div.menu,a 2/2 0; div,h2 3/0 1; div,p 25/0 1; div,p 8/0 1; div,p 36/0 1; div,p 14/13 0; div,a 4/4 0; div,a 2/2 0; div.share,p 3/0 0; div,a 1/1 0",
    "div,p 10/9 0; div,p 2/0 0; div,p 12/11 0; div,p 3/0 0; div,p 9/9 0; div,p 4/2 0; div,p 40/35 0; div,p 6/5 0; div.search,p 4/0 0",
    "p 18/0 1; p 22/0 1; p 3/0 1; p 31/3 1; p 7/0 1; p 200/12 1; p 3/3 0; p 2/2 0; p 4/0 0; p 3/3 0",
    "div,p 3/3 0; div,p 15/0 1; div,p 60/0 1; div,p 20/0 1; div,a 2/2 0; div,p 9/0 0; div,a 2/2 0; div.widget,p 20/0 0; div,a 2/2 0; div,p 11/1 0; div,a 4/4 0",
    "article,h1 5/5 1; article,p 10/0 1; article,p 8/0 1; article,p 20/0 1; article,p 8/8 1", "article,p 30/0 1; article,p 2/2 1; article,p 9/0 1; article,h2 3/3 1; article,p 15/0 1; article,p 12/12 1",
    "div,p 1/0 0; article,h1 5/0 1; article,p 60/0 1; div,p 30/0 0; div,p 12/0 0", "div,h2 3/0 0; main,p 80/0 1; main,p 20/0 1; div,p 45/0 0; div,p 9/0 0; div,a 2/2 0",
    "h1 5/0 1; p 36/0 1", "p 12/0 1", "div.banner,p 12/0 0; article,p 40/0 1; div.social,a 1/1 0; div.social,a 1/1 0",
    "nav,a 2/2 0; div.comments-open,h1 7/0 1; div.comments-open,p 60/0 1; div.comments-open,p 2/0 1; div.comments-open,p 45/3 1; div.comments-open,h2 3/0 1; div.comments-open,p 70/0 1; footer 8/1 0",
    "div.ad-free,h1 5/0 1; div.ad-free,p 12/0 1; div.ad-free,p 50/0 1; div.ad-free,p 4/4 1; div.ad-free,p 66/5 1; div.ad-free,a 2/2 0; div.ad-free,a 3/3 0; div.ad-free,a 2/2 0",
    "div,h1 6/0 1; div,p 80/0 1; div,p 55/4 1; div.notice-of-copyright,p 24/0 0; div.widget,p 30/0 0; div.signup-offer,p 18/0 0; div.signup-offer,p 3/0 0",
    "div.newsletter-archive,h2 4/0 1; div.newsletter-archive,p 22/0 1; div.newsletter-archive,p 31/0 1; div.newsletter-archive,p 5/0 1; div.newsletter-archive,p 28/2 1; div.banner,p 9/0 0",
    "article,h1 5/0 1; article,p 60/0 1; article,p 8/0 1; article,aside,p 15/0 0; article,p 33/0 1; article,aside,p 10/0 0; article,div.promo,p 9/0 0; article,div.ad,p 9/0 0; article,p 50/0 1; article,div.comments,p 9/0 0; article,div.comments,p 17/0 0",
    "main,h1 4/0 1; main,p 44/0 1; main,p 70/1 1; div.comments,h2 1/0 0; div.comments,p 9/0 0; div.comments,p 12/0 0; div.comments,p 30/0 0; div.comments,p 8/0 0; div.comments,p 64/0 0; div.comments,p 14/0 0; footer 12/0 0",
    "header 4/0 0; header,p 12/0 0; div.cookies,p 16/0 0; div,h1 6/0 1; div,p 52/0 1; div,p 9/0 1; div,p 38/2 1; div.sidebar,p 14/0 0; div.sidebar,p 28/0 0; div.comments,p 11/0 0; div.comments,p 58/0 0; div.comments,p 13/0 0; footer 10/0 0",
    "div,a 1/1 0; div,a 3/3 0; div,a 1/1 0; article,h1 4/0 1; article,p 40/0 1; article,p 64/2 1; article,p 6/1 1; article,p 70/6 1; article,p 11/0 1; article,h2 3/0 1; article,p 58/4 1; div,a 6/6 0; div,a 2/2 0",
    "div,a 2/2 0; div,h1 5/0 1; div,p 61/3 1; div,p 48/1 1; div,p 7/1 1; div,p 33/0 1; div.tags,p 6/1 0; div.widget,p 14/0 0; div.related,p 12/1 0; div.widget,p 26/3 0; div.share,p 5/0 0; div.copyright,p 18/1 0",
    "div.topbar,p 8/1 0; div.topbar,p 15/0 0; div,h1 5/0 1; div,p 9/1 1; div,p 47/2 1; div,p 4/0 1; div,p 66/5 1; div,p 12/1 1; div,p 29/0 1; div.widget,p 40/2 0; div.widget,p 3/0 0; div.tags,p 9/2 0",
)
FEATURES = ("boilerplate", "main", "words", "density", "words_before", "density_before", "words_after", "density_after", "share")


def labelled_blocks(pages: tuple[str, ...] = PAGES) -> list[tuple]:
    """The labelled pages as rows for the tree: FEATURES and the label."""
    out = []
    for page in pages:
        html, labels = [], []
        for part in page.split("; "):
            path, size, label = part.split(" ")
            n, linked = map(int, size.split("/"))
            names = [x.partition(".") for x in path.split(",")]
            text = ("<a href='#'>" + "x " * linked + "</a> " if linked else "") + "y " * (n - linked)
            html.append("".join(f"<{t} class='{c}'>" if c else f"<{t}>" for t, _, c in names) + text + "".join(f"</{t}>" for t, _, _ in reversed(names)) + "<hr>")
            labels.append(int(label))
        rows = features(blocks("".join(html)))
        out += [(*row, label) for row, label in zip(rows, labels, strict=True)]
    return out


def grow_tree(rows: list[tuple], depth: int = 7) -> tuple:
    """CART by Gini impurity: (feature, threshold, left, right) or (None, share of 1)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (None, ones / len(rows) if rows else 0.5)
    gini = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            score = gini([r for r in rows if r[f] <= cut]) + gini([r for r in rows if r[f] > cut])
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut)
    if best is None:
        return (None, ones / len(rows))
    _, f, cut = best
    return (f, cut, grow_tree([r for r in rows if r[f] <= cut], depth - 1), grow_tree([r for r in rows if r[f] > cut], depth - 1))


def tree_says(tree: tuple, row: tuple) -> float:
    while tree[0] is not None:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def _named(name: str) -> int:
    """3 if a class or id names boilerplate by its head, 4 if a word of it hints at that, else 0."""
    if name.startswith(ABOUT):
        return 0
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if STRONG_WORDS.isdisjoint(parts):
        return 4 if name in WEAK_WORDS else 0
    head = next((w for w in reversed(parts) if w not in HOLDERS and not w[0].isdigit()), "")
    return 3 if head in STRONG_WORDS else 4


def _kind(tag: str, raw: str, in_main: bool) -> int:
    """1 boilerplate, 2 main, 3 boilerplate by its class or id only, 4 perhaps boilerplate by a word of them, 0 neither."""
    if tag in BOILER_TAGS or (tag == "header" and not in_main):
        return 1
    soft = weak = False
    if "=" in raw or " hidden" in raw:
        if HIDDEN_ATTR.search(raw):
            return 1
        for m in ATTR.finditer(raw):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value in BOILER_ROLES:
                    return 1
                if value in ("main", "article"):
                    return 3 if soft and value == "article" else 2
            elif tag not in ("body", "html", "main") and (by := m[1].lower()) in ("class", "id"):
                for name in value.split():
                    kind = _named(name)
                    if kind == 3 and (tag == "article" or (by == "id" and in_main and tag != "div")) and COMMENT_WORDS.isdisjoint(name.split("-")):
                        kind = 4  # an article tells what it has, an id within one may be the anchor of a chapter
                    soft |= kind == 3
                    weak |= kind == 4
    return 3 if soft else 2 if tag in MAIN_TAGS else 4 if weak and not in_main else 0


def tokens(page: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of every tag ('/name' for an end tag) and of what is never shown (name '').

    A pass from left to right: a quoted value is skipped by finding its end, and a quote that has none left is
    remembered, so that the rest of the page is never searched again for it.
    """
    n = len(page)
    closed = {"'": True, '"': True}
    at = page.find("<")
    while at >= 0:
        m = NAME.match(page, at)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield at, (end := n if end < 0 else end + 3), ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            yield at, (end := n if end < 0 else end + 1), ""
        elif not m:
            at = page.find("<", at + 1)
            continue
        else:
            end = m.end()
            while True:
                stop = STOP.search(page, end)
                if not stop:
                    end = n
                    break
                c, end = stop[0], stop.end()
                if c == ">":
                    break
                if c == "<":  # the tag was never closed: the next one begins
                    end -= 1
                    break
                if closed[c] and VALUE.search(page, max(at, end - 64), end - 1):
                    close = page.find(c, end)
                    closed[c] = close >= 0
                    end = close + 1 if close >= 0 else end
            name = m[1].lower()
            if page[at + 1] == "/":
                yield at, end, "/" + name
            elif name in UNSEEN and not (name == "svg" and page[end - 2 : end] == "/>"):
                gone = UNSEEN[name].search(page, end)
                yield at, (end := gone.end() if gone else n), ""
            else:
                yield at, end, "" if name == "svg" else name
        at = page.find("<", end)


def blocks(page: str | None) -> list[tuple[str, int, int, float, bool, float]]:
    """(text, words, words in links, boilerplate around: 1, perhaps 0.5 or 0, within main, share) of each non-empty block, in page order.

    A class or id that names boilerplate marks all that is inside.  If that leaves no main element of the
    page, the wrappers around the main element with most words are pardoned in main elements.  share: of the
    words that nothing surely marks, those in the outermost element around the block that perhaps is boilerplate.
    An article within another that has text of its own, and what follows a heading such as 'Comments' in the
    heading's parent (unless that is a main element or the page), are reader comments.
    """
    out: list[tuple[str, int, int, float, bool]] = []
    hints: list[int] = []  # of each block: the number of the outermost element around it that perhaps is boilerplate, or 0
    wraps: list[tuple[int, ...] | None] = []  # of each block in a main element marked by words outside it only: the marked wrappers
    if not page:
        return out
    stack: list[tuple[str, int]] = []  # open block elements and their kind
    text: list[str] = []
    linked = bad = good = weak = opened = 0
    link = -1  # how many block elements were open when the open link began
    tags: dict[str, int] = {}  # how many block elements of a name are open
    hint = hinted = articles = own = 0  # own: words in one open article, but for those that are surely none of it
    heads = -1  # how many blocks there were when the open heading began
    soft: list[int] = []  # numbers of the open wrappers that are marked by a word
    outer: tuple[int, ...] = ()  # those around the outermost open main element

    def add(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece)
        text.append(piece)
        if link >= 0:
            linked += len(piece.split())

    def flush() -> None:
        nonlocal linked, own
        if text:
            words = "".join(text).split()
            if words:
                boiler = 1.0 if bad or soft else 0.5 if weak and not good else 0.0  # a weak word outside a main element says nothing in it
                out.append((" ".join(words), len(words), min(linked, len(words)), boiler, good > 0))
                hints.append(hint if boiler == 0.5 else 0)
                own += len(words) if articles == 1 and boiler < 1 else 0
                wraps.append(outer if good and not bad and len(soft) == len(outer) > 0 else None)
        text.clear()
        linked = 0

    def close(n: int) -> None:
        nonlocal bad, good, weak, link, articles, own
        for name, kind in stack[n:]:
            tags[name] -= 1
            bad -= kind == 1
            good -= kind == 2
            weak -= kind == 4
            if name == "article" and kind == 2:
                articles -= 1
                own = own if articles else 0
            if kind == 3:
                soft.pop()
        del stack[n:]
        if link > n:
            link = -1  # a link ends with the element it began in

    def comments_from_here() -> None:
        """The open heading's parent holds comments, from the heading on."""
        nonlocal bad, weak
        k = len(stack) - 2
        if k >= 0 and stack[k][0] in ("section", "div") and stack[k][1] in (0, 4):
            weak -= stack[k][1] == 4
            bad += 1
            stack[k] = (stack[k][0], 1)
            out[-1] = (*out[-1][:3], 1.0, out[-1][4])
            hints[-1] = 0

    at = 0
    for start, end, tag in tokens(page):
        if start > at:
            add(page[at:start])
        at = end
        closing = tag.startswith("/")
        tag = tag.lstrip("/")
        if not tag:
            continue  # comments, declarations and invisible elements
        if tag == "a":
            link = -1 if closing else len(stack)
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if tag in HEADINGS and heads >= 0 and tags.get(tag):
                if len(out) == heads + 1 and COMMENT_HEADING.fullmatch(out[-1][0]):
                    comments_from_here()
                heads = -1
            if tags.get(tag):  # else a stray end tag; what is walked over here is closed, so the walk is paid for
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
        else:
            if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)  # these end where the next one begins
            raw = page[start:end]
            if not raw.endswith("/>"):
                kind = _kind(tag, raw, good > 0)
                if tag == "article" and kind == 2:
                    if articles and own >= OWN_WORDS:
                        kind = 1
                    else:
                        articles += 1
                if tag in HEADINGS:
                    heads = len(out)
                stack.append((tag, kind))
                tags[tag] = tags.get(tag, 0) + 1
                if kind == 4 and not weak:
                    hinted += 1
                    hint = hinted
                bad += kind == 1
                weak += kind == 4
                if kind == 2:
                    outer = outer if good else tuple(soft)
                    good += 1
                elif kind == 3:
                    opened += 1
                    soft.append(opened)
    if at < len(page):
        add(page[at:])
    flush()
    if any(wraps) and not any(main and boiler < 1 for _, _, _, boiler, main in out):
        words: dict[tuple[int, ...], int] = {}
        for w, b in zip(wraps, out):
            if w:
                words[w] = words.get(w, 0) + b[1]
        pardoned = set(max(words, key=words.get))
        out = [(*b[:3], 0.0 if w and pardoned.issuperset(w) else b[3], b[4]) for w, b in zip(wraps, out)]
    held = [0] * (hinted + 1)
    for h, b in zip(hints, out):
        held[h] += b[1] if b[3] < 1 else 0
    unmarked = sum(held)
    return [(*b, held[h] / unmarked if h else 0.0) for h, b in zip(hints, out)]


def features(found: list[tuple]) -> list[tuple]:
    """FEATURES of each block; beyond the page's ends stand empty blocks.

    main is 1 within a main element, -1 outside of those that the page has, and 0 if it has none.
    """
    outside = -1 if any(good and bad < 1 for *_, bad, good, _ in found) else 0
    sizes = [(0, 0.0), *((n, k / n) for _, n, k, *_ in found), (0, 0.0)]
    return [(bad, 1 if good else outside, *sizes[i], *sizes[i - 1], *sizes[i + 1], share) for i, (*_, bad, good, share) in enumerate(found, 1)]


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, row in zip(found, features(found)) if tree_says(tree, row) >= 0.5)


#: The tree's training rows: FEATURES and the label of every block of PAGES.
LABELLED = labelled_blocks()


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: list[tuple] = LABELLED) -> DataFrame:
    """keep columns, text and n_chars (code points) of every page; a map over rows without a shuffle."""
    tree = grow_tree(list(labelled))

    def texts(page: list) -> dict[str, list]:
        got = [main_text(h, tree) for h in page]
        return {"text": got, "n_chars": [len(t) for t in got]}

    return map_texts(pages, html_col, keep, texts, "text string, n_chars long")
