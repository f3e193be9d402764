"""HTML extraction by wrapper induction over the pages of a host.

Pages become trees of block elements; inline markup belongs to its block's text. A host's pages are dealt to blocks by
their hashes, and the number of blocks follows from the host's pages and characters, so which pages meet depends on the
tables alone, and a host with a third of all pages is many blocks. Within a block, a wrapper is induced: trees are aligned
one after the other with the wrapper so far by simple tree matching (two nodes match if their tags and classes do, and
children match in order so that most nodes match in total), and nodes that it does not know yet are added to it. Aligned
once more with the finished wrapper, each page says what stands at its nodes. A text that most pages have at a node is
template; outside articles also the texts of a node that has few different ones, such as rotating notices. Nodes with
varying text are slots; the slots are a page's text, in page order. Only clearly different articles are counted, each
once, so copies of an article, with other dates, counts or sidebars too, do not erase it.

What varies is not always the article: tags, roles, classes and ids say so beforehand. Frames, forms, adverts and reader
comments are left out; a class or id alone does not leave out what holds most of the text over all the block's pages that
have it, and within an article only words for adverts, sharing, comments and the like count. If pages have article or
main elements, only slots within them count, unless the aligned slots outside hold three times as much text. Lists of links outside articles
are menus.

Long lists of children are cut at anchors: equal shapes that come in the same order in both, then equal labels between
them, again and again until the pieces between the anchors have MOST_CELLS pairs at most, which are matched exactly; so
time and memory stay near linear. Trees may be of any depth.

Defined results: null, empty or tagless html and html without article text give the empty text (html without any tag
gives its text). A page alone in its block has no other page to agree with: its tags, roles and names decide. Broken
markup: tags are read as HTML says, so a tag that never ends is markup to the end of the page, and so is an open comment,
script or style; a quote that never closes ends with its tag. Unclosed elements end where HTML ends them or with their
parent, stray end tags are ignored. Pages with a null url or without host share blocks. Rows that are repeated MANY_COPIES times or more count as one page for the wrapper, others each.
Other columns are not looked at. The time for a page grows with its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import spread_join
from ..operators.markup import Source, decoded
from .common import table, written
from .url_filter import host_of

#: Pages and characters in a block, about; hosts of several blocks that are broadcast at most (some 100 bytes each).
BLOCK_PAGES, BLOCK_CHARS, BROADCAST_HOSTS = 64, 4_000_000, 200_000

#: Rows from which equal ones (in page_id, url and html) are extracted once for all.
MANY_COPIES = 256

#: Share of agreeing pages for template outside and inside an article, and at least so many different articles; share of
#: different texts up to which a node outside articles rotates.
AGREE, AGREE_INSIDE, LEAST_PAGES, LEAST_INSIDE, ROTATES = 0.6, 0.9, 2, 8, 0.5

#: How much text outside counts against text in article elements; share of link text from which a list is a menu.
ARTICLE_PRIOR, LINKS = 3, 0.8

#: Characters from which a text is prose, and share of the smaller of two pages' texts from which they are copies.
PROSE, COPY = 100, 0.43

#: Pairs of children up to which lists are matched exactly.
MOST_CELLS = 40_000

#: Fixed values of HTML: elements without content, whose content is no markup, left out whole, inline, and those that a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
WHOLE = frozenset("template svg math object canvas video audio".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt".split()
)
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div nav aside main body html".split())
SCOPE_OF_ITEMS = SCOPE - {"div", "section"}
LISTS = frozenset("ul ol dl menu dir".split())
ARTICLES = frozenset(("article", "main"))

#: Elements, roles and words in classes or ids that speak against the article; the second words do so within articles too.
NOT_TAGS = frozenset("head nav footer aside form button select dialog menu script style noscript template".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
FRAME_WORDS = r"banner\w*|notices?|alerts?|overlay|side|widgets?|header|masthead|search|skip"
INNER_WORDS = r"ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|sidebar\w*|menus?|nav|navbar|navigation|breadcrumbs?|footer|comments?|disqus|repl(?:y|ies)|respond|paginat\w*|pager|login|toolbar|hidden"
NOT_WORDS = re.compile(rf"(?:^|[\s_-])(?:{FRAME_WORDS}|{INNER_WORDS})(?:$|[\s_-])", re.I)
NOT_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{INNER_WORDS})(?:$|[\s_-])", re.I)
NOT_CONTENT = re.compile(r"(?:^|[\s_-])(?:comments?|comment(?:list|box|area|section|form|thread|er)s?|disqus|repl(?:y|ies)|respond|related|teasers?)(?:$|[\s_-])", re.I)

#: Words that a class or id says the element comes with or without: they do not name it.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:with|without|no|not|has)[_-]+)+[^\s_-]+", re.I)

#: A class or id of just such a word: a comment section even if it is long.
ONLY_NOT_CONTENT = re.compile(r"(?:^|\s)(?:comments?|comment-?(?:list|box|area|section|form|thread|er)s?|disqus|repl(?:y|ies)|respond|related|teasers?)(?:$|\s)", re.I)

#: How surely an element is not the article: by role or comment words, by a frame's tag, by other words or as a form.
SOFT, FRAME, HARD = 1, 2, 3

_DIGITS = re.compile(r"[0-9]+")


class Element:
    """A block element: its label, children in order (elements and texts), how surely it is not the article."""

    __slots__ = ("tag", "label", "children", "parent", "kind", "name", "shape", "size", "text", "links", "closed", "has_article", "inside")

    def __init__(self, tag: str, label: str, parent: Element | None, kind: int):
        self.tag, self.label, self.parent, self.kind = tag, label, parent, kind
        self.children: list[Element] = []
        self.text = self.name = ""
        self.links = 0
        self.closed = self.has_article = False
        self.inside = tag in ARTICLES or parent is not None and parent.inside

    @property
    def noise(self) -> bool:
        """HARD noise is never the article; an UNCLOSED frame and a SOFT one are not noise if the article is within."""
        return self.kind == HARD or self.kind and not (self.has_article and (self.kind == SOFT or not self.closed))


def kind_of(tag: str, found: dict[str, str], parent: Element) -> tuple[int, str]:
    """How surely an element with these attributes is not the article, and its class and id if only they say so."""
    if found.get("role", "").lower() in NOT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return HARD, ""
    named = BESIDE.sub("", f"{found.get('class', '')} {found.get('id', '')}").strip()
    sure = named and tag not in ("html", "body", "main") and NOT_CONTENT.search(named)
    if tag == "header":
        kind = 0 if parent.inside else FRAME
    else:
        kind = (SOFT if tag == "form" else FRAME) if tag in NOT_TAGS else 0
    if kind or not named:
        return HARD if sure else kind, ""
    if sure:
        return HARD, named
    if tag in ("html", "body", "main", "article") or not NOT_WORDS.search(named):
        return 0, ""
    return (0, "") if parent.inside and not NOT_INSIDE.search(named) else (SOFT, named)


def weighed(root: Element, named: list[Element]) -> list[tuple[Element, int, int, bool]]:
    """For each element that a name alone speaks against: its text, the page's, and whether the name may be overruled at all.

    Text that roles or tags leave out does not count. A page with another article says itself where its article is: there
    only articles and elements within them may be taken back, and not those named just comments or the like.
    """
    mass: dict[int, int] = {}
    articles: dict[int, int] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.noise or node.name or node.kind == SOFT:
            order.append(node)
            stack.extend(node.children)
    for node in reversed(order):
        mass[id(node)] = len(node.text) + sum(mass.get(id(c), 0) for c in node.children)
        articles[id(node)] = (node.tag in ARTICLES and not node.kind) + sum(articles.get(id(c), 0) for c in node.children)
    every = articles[id(root)]
    return [
        (x, mass.get(id(x), 0), mass[id(root)], articles.get(id(x), 0) == every or x.inside and not ONLY_NOT_CONTENT.search(x.name)) for x in named
    ]


def taken_back(claims: list[tuple[Element, int, int, bool]]) -> None:
    """Overrules names that, over all the block's pages that have them, hold most of the text."""
    own: Counter = Counter()
    every: Counter = Counter()
    key = lambda x: (x.tag, _DIGITS.sub("0", x.name))
    for node, mass, total, _ in claims:
        own[key(node)] += mass
        every[key(node)] += total
    for node, _, _, may in claims:
        if may and 2 * own[key(node)] > every[key(node)]:
            node.kind = 0
            up = node.parent if node.tag == "article" else None
            while up is not None and not up.has_article:
                up.has_article, up = True, up.parent


def pruned(root: Element) -> None:
    """Without what is in elements that can't be the article: it needs no alignment."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.noise:
            node.children = []
        stack.extend(node.children)


def parsed(html: str) -> tuple[Element, list[Element]]:
    """The page's tree, and its elements that a name alone speaks against. Text directly in an element becomes children of it that are labelled #text, one for each run between block elements."""
    root = node = Element("#root", "#root", None, 0)
    open_tags: list[Element] = [root]
    where: defaultdict[str, list[int]] = defaultdict(list)  # by tag, the places of its open elements
    named: list[Element] = []
    run: list[str] = []
    source, at, end, links, in_link = Source(html), 0, len(html), 0, False

    def say(piece: str) -> None:
        nonlocal links
        piece = decoded(piece)
        run.append(piece)
        if in_link:
            links += len("".join(piece.split()))

    def pop() -> Element:
        out = open_tags.pop()
        where[out.tag].pop()
        return out

    def flush() -> None:
        nonlocal run, links
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Element("#text", "#text", node, 0)
                leaf.text, leaf.links = text, links
                node.children.append(leaf)
            run, links = [], 0

    while at < end:
        open_at = html.find("<", at)
        if open_at < 0:
            say(html[at:])
            break
        if open_at > at:
            say(html[at:open_at])
        what, tag, found, slash, at = source.tag(open_at)
        if what == "data":
            say("<")
        if what in ("data", "other"):
            continue
        if what == "end":
            if tag == "a":
                in_link = False
            if tag in INLINE:
                continue
            if tag in VOID:
                flush()
                continue
            if where[tag]:
                flush()
                while open_tags[-1].tag != tag:
                    pop()
                pop().closed = True
                node = open_tags[-1]
            continue
        if tag in RAW:
            at = source.after_element(tag, at)
            if at < 0:
                break
            continue
        if tag in WHOLE:
            if not (slash and tag in ("svg", "math")):
                after = source.after_element(tag, at)
                at = after if after >= 0 else at
            continue
        if tag == "a":
            in_link = "href" in found
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if open_tags[-1].tag == "head":  # anything but metadata begins the body
            pop()
        if tag in ENDS_P and open_tags[-1].tag == "p":
            pop()
        if tag in SAME_ENDS:
            last = lambda tags: max((where[t][-1] for t in tags if where[t]), default=0)
            depth = last(SAME_ENDS[tag])
            if depth > last(SCOPE_OF_ITEMS):
                while len(open_tags) > depth:
                    pop()
        node = open_tags[-1]
        kind, own_name = kind_of(tag, found, node) if found or tag in NOT_TAGS or tag == "header" else (0, "")
        own = Element(tag, f"{tag}.{_DIGITS.sub('0', found.get('class', ''))}" if found else tag, node, kind)
        if own_name:
            own.name = own_name
            named.append(own)
        node.children.append(own)
        if tag in ARTICLES and not own.kind:
            for up in reversed(open_tags):
                if up.has_article:
                    break
                up.has_article = True
        if not slash:
            where[tag].append(len(open_tags))
            open_tags.append(own)
            node = own
    flush()
    return root, named


def shaped(root: Element, shapes: dict[tuple, int]) -> None:
    """Numbers equal shapes (labels of the whole subtree) alike, and counts nodes."""
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if ready or not node.children:
            node.shape = shapes.setdefault((node.label, *(c.shape for c in node.children)), len(shapes))
            node.size = 1 + sum(c.size for c in node.children)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children)


def in_order(x: list, y: list) -> list[tuple[int, int]]:
    """Places of equal keys, the k-th of a key in x with the k-th in y, as many as come in the same order in both."""
    seen: Counter = Counter()
    place = {}
    for j, key in enumerate(y):
        place[key, seen[key]] = j
        seen[key] += 1
    seen.clear()
    pairs = []
    for i, key in enumerate(x):
        if (key, seen[key]) in place:
            pairs.append((i, place[key, seen[key]]))
        seen[key] += 1
    ends: list[int] = []  # the longest rising run of j by its last value, and where each pair's predecessor is
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1] = [j]
        last[k : k + 1] = [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Matcher:
    """Simple tree matching, with the scores of shapes kept.

    Scores of children are asked for by yielding the pair; `run` answers from what is known or puts the question on a
    stack of its own, so trees may be of any depth.
    """

    def __init__(self):
        self.scores: dict[tuple[int, int], int] = {}

    def known(self, a: Element, b: Element) -> int | None:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        return self.scores.get((a.shape, b.shape))

    def score(self, a: Element, b: Element) -> int:
        """How many nodes the best matching of two trees matches."""
        told = self.known(a, b)
        return self.run(self.scored(a, b)) if told is None else told

    def run(self, asked):
        """What the generator `asked` returns, its questions answered."""
        stack, key, answer = [asked], [None], None
        while True:
            try:
                a, b = stack[-1].send(answer)
            except StopIteration as done:
                stack.pop()
                of = key.pop()
                if not stack:
                    return done.value
                answer = self.scores[of] = done.value
                continue
            stack.append(self.scored(a, b))
            key.append((a.shape, b.shape))
            answer = None

    def scored(self, a: Element, b: Element):
        total = 1
        for p, q in (yield from self.matched(a, b)):
            s = self.known(p, q)
            total += (yield p, q) if s is None else s
        return total

    def children(self, a: Element, b: Element) -> list[tuple[Element, Element]]:
        """Matched children."""
        return self.run(self.matched(a, b))

    def matched(self, a: Element, b: Element):
        """Equal shapes at either end match each other in some best matching, so only the rest is compared."""
        x, y, out, tail = a.children, b.children, [], []
        low, high_x, high_y = 0, len(x), len(y)
        while low < min(high_x, high_y) and x[low].shape == y[low].shape:
            out.append((x[low], y[low]))
            low += 1
        while high_x > low and high_y > low and x[high_x - 1].shape == y[high_y - 1].shape:
            high_x, high_y = high_x - 1, high_y - 1
            tail.append((x[high_x], y[high_y]))
        return out + (yield from self.between(x[low:high_x], y[low:high_y])) + tail[::-1]

    def between(self, x: list[Element], y: list[Element]):
        """Long lists are cut at anchors, equal shapes and then equal labels in the same order, until the pieces between
        them are short enough for exact matching. Each cut takes an anchor at least, unless the pieces share no label."""
        out: list[tuple[int, int]] = []
        todo = [(0, len(x), 0, len(y), True)]
        while todo:
            i, end_i, j, end_j, shapes = todo.pop()
            if i == end_i or j == end_j:
                continue
            if (end_i - i) * (end_j - j) <= MOST_CELLS:
                out += [(i + k, j + m) for k, m in (yield from self.best(x[i:end_i], y[j:end_j]))]
                continue
            key = (lambda e: e.shape) if shapes else (lambda e: e.label)
            anchors = in_order([key(e) for e in x[i:end_i]], [key(e) for e in y[j:end_j]])
            if not anchors:
                todo += [(i, end_i, j, end_j, False)] if shapes else []
                continue
            at_i, at_j = i, j
            for k, m in anchors:
                out.append((i + k, j + m))
                todo.append((at_i, i + k, at_j, j + m, False))
                at_i, at_j = i + k + 1, j + m + 1
            todo.append((at_i, end_i, at_j, end_j, False))
        return [(x[k], y[m]) for k, m in sorted(out)]

    def best(self, x: list[Element], y: list[Element]):
        """The places of the matching in order with the highest score."""
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            above, row = best[i], best[i + 1]
            for j, q in enumerate(y):
                s = self.known(p, q)
                if s is None:
                    s = yield p, q
                row[j + 1] = max(above[j] + s if s else 0, above[j + 1], row[j])
        i, j, found = len(x), len(y), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]

    def pairs(self, a: Element, b: Element) -> Iterator[tuple[Element, Element]]:
        """All matched nodes of two trees with equal roots."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            yield p, q
            if p.children and q.children:
                stack.extend(zip(p.children, q.children, strict=True) if p.shape == q.shape else self.children(p, q))

    def merge(self, a: Element, b: Element) -> bool:
        """Adds to the tree `a` what `b` has besides; whether that is anything."""
        stack, grown = [(a, b)], False
        while stack:
            p, q = stack.pop()
            if p.shape == q.shape:
                continue
            partner = {id(d): c for c, d in self.children(p, q)}
            out, i = [], 0
            for d in q.children:
                c = partner.get(id(d))
                if c is None:
                    out.append(copied(d, p))
                    grown = True
                    continue
                while p.children[i] is not c:
                    out.append(p.children[i])
                    i += 1
                out.append(c)
                i += 1
                stack.append((c, d))
            p.children = out + p.children[i:]
        return grown


def copied(node: Element, parent: Element | None) -> Element:
    out = Element(node.tag, node.label, parent, node.kind)
    stack = [(node, out)]
    while stack:
        a, b = stack.pop()
        b.children = [Element(c.tag, c.label, b, c.kind) for c in a.children]
        stack.extend(zip(a.children, b.children, strict=True))
    return out


def texts(root: Element) -> Iterator[Element]:
    """The text leaves in page order, without those in elements that can't be the article."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        if node.tag == "#text":
            yield node
        stack.extend(reversed(node.children))


class Articles:
    """The clearly different articles among some pages: pages that share much of their prose, word by word, are copies.

    Pages without prose are compared by their whole texts.
    """

    def __init__(self):
        self.sizes: list[int] = []
        self.holders: dict[int | str, list[int]] = {}

    def is_new(self, page: Element) -> bool:
        """Whether the page's article is none of those before; it is one of them from now on."""
        told = article_text(page)
        parts: dict[int | str, int] = {}
        for words in (x.split() for x in told if len(x) >= PROSE):
            parts.update(dict.fromkeys(map(hash, zip(words, words[1:], words[2:])) if len(words) > 2 else words, 1))
        parts = parts or {x: len(x) for x in told}
        if not parts:
            return False
        size = sum(parts.values())
        shared = [0] * len(self.sizes)
        for part, weight in parts.items():
            for i in self.holders.get(part, ()):
                shared[i] += weight
        if any(n >= COPY * min(size, m) for n, m in zip(shared, self.sizes, strict=True)):
            return False
        for part in parts:
            self.holders.setdefault(part, []).append(len(self.sizes))
        self.sizes.append(size)
        return True


def article_text(root: Element) -> tuple[str, ...]:
    """The texts in article or main elements; without such elements, all."""
    every = list(texts(root))
    return tuple(x.text for x in every if x.inside) or tuple(x.text for x in every)


class Told:
    """What different articles' pages have at a text node of the wrapper."""

    __slots__ = ("texts", "pages", "menu")

    def __init__(self, menu: Element | None):
        self.texts: Counter = Counter()
        self.pages = 0
        self.menu = menu

    def is_template(self, text: str, inside: bool) -> bool:
        share, least = (AGREE_INSIDE, LEAST_INSIDE) if inside else (AGREE, LEAST_PAGES)
        if self.pages >= least and self.texts[text] >= share * self.pages:
            return True
        return not inside and self.pages >= LEAST_INSIDE and self.texts[text] > 1 and len(self.texts) <= ROTATES * self.pages


class Wrapper:
    """The merged tree of some pages of a host, and what stands at its nodes."""

    def __init__(self, trees: list[Element]):
        self.trees, self.matcher = trees, Matcher()
        shapes: dict[tuple, int] = {}
        for tree in trees:
            shaped(tree, shapes)
        seed = sorted(trees, key=lambda t: t.size)[len(trees) // 2]
        self.root = copied(seed, None)
        shaped(self.root, shapes)
        for tree in trees:
            if tree is not seed and self.matcher.merge(self.root, tree):
                shaped(self.root, shapes)
        self.learn(seed)

    def learn(self, seed: Element) -> None:
        self.told: dict[int, Told] = {}
        self.chars: Counter = Counter()  # of lists: their text, of it link text, and how many texts
        self.links: Counter = Counter()
        self.items: Counter = Counter()
        self.at: list[dict[int, Told]] = []
        lists: dict[int, Element | None] = {}
        articles = Articles()
        new = {id(t): articles.is_new(t) for t in [seed, *(t for t in self.trees if t is not seed)]}
        for tree in self.trees:
            places: dict[int, Told] = {}
            for a, b in self.matcher.pairs(self.root, tree):
                if a.tag != "#text":
                    continue
                told = self.told.get(id(a))
                if told is None:
                    told = self.told[id(a)] = Told(list_of(a, lists))
                places[id(b)] = told
                if told.menu is not None:
                    self.chars[id(told.menu)] += len(b.text) - b.text.count(" ")
                    self.links[id(told.menu)] += b.links
                    self.items[id(told.menu)] += 1
                if new[id(tree)]:
                    told.pages += 1
                    told.texts[b.text] += 1
            self.at.append(places)

    def is_menu(self, told: Told | None) -> bool:
        menu = told and told.menu
        return menu is not None and self.items[id(menu)] > 1 and self.links[id(menu)] >= LINKS * self.chars[id(menu)]

    def found(self) -> list[list[str]]:
        """The texts that are each page's article."""
        slots: list[tuple[list[Element], list[Element]]] = []
        for tree, places in zip(self.trees, self.at, strict=True):
            inside, outside, menus = [], [], []
            for x in texts(tree):
                told, within = places.get(id(x)), x.inside
                if told is not None and told.is_template(x.text, within):
                    continue
                (inside if within else menus if self.is_menu(told) else outside).append(x)
            if mass(menus) > mass(outside):  # a page that is nothing but a list
                kept = {id(x) for x in menus + outside}
                outside = [x for x in texts(tree) if id(x) in kept]
            slots.append((inside, outside))
        # The elements that say they are the article are believed, unless the alignment finds far more text outside.
        with_both = [(mass(i), mass(o)) for i, o in slots if i]
        believed = ARTICLE_PRIOR * sum(i for i, _ in with_both) >= sum(o for _, o in with_both)
        out = []
        for tree, (inside, outside) in zip(self.trees, slots, strict=True):
            if inside and believed:
                out.append([x.text for x in inside])
            else:
                kept = {id(x) for x in inside + outside}
                out.append([x.text for x in texts(tree) if id(x) in kept])
        return out


def mass(leaves: list[Element]) -> int:
    return sum(len(x.text) for x in leaves)


def list_of(node: Element, known: dict[int, Element | None]) -> Element | None:
    """The outermost list that the node is in; `known` has those of elements above."""
    path, out = [], None
    while node is not None and id(node) not in known:
        path.append(node)
        node = node.parent
    out = known[id(node)] if node is not None else None
    for x in reversed(path):
        out = out if out is not None else x if x.tag in LISTS else None
        known[id(x)] = out
    return out


def extract_block(pages: list[str]) -> tuple[list[str], Wrapper]:
    """The texts of some pages of one host, and their wrapper."""
    read = [parsed(x) for x in pages]
    taken_back([claim for root, named in read if named for claim in weighed(root, named)])
    for root, _ in read:
        pruned(root)
    wrapper = Wrapper([root for root, _ in read])
    return [" ".join(x) for x in wrapper.found()], wrapper


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host")
    )
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_PAGES), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    large = written(sizes.select("host", blocks.alias("blocks")).where("blocks > 1"), "hosts")
    rows = rows.withColumn("hash", F.xxhash64("page_id", "url", "html"))
    # Pages that stand in many rows are extracted once; a row's key is the digest of all that it has.
    repeated = written(rows.groupBy("hash").count().where(F.col("count") >= MANY_COPIES).select("hash"), "repeated")
    many, copies = repeated.count(), None
    if many:
        close = F.broadcast(repeated) if many <= BROADCAST_HOSTS else repeated
        copies = rows.join(close, "hash", "left_semi").withColumn("same", F.md5(F.concat(F.to_json(F.struct("page_id", "url")), F.lit("\n"), "html")))
        once = copies.groupBy("same").agg(*(F.first(c).alias(c) for c in rows.columns)).select(*rows.columns, "same")
        rows = rows.join(close, "hash", "left_anti").withColumn("same", F.lit(None).cast("string")).unionByName(once)
    else:
        rows = rows.withColumn("same", F.lit(None).cast("string"))
    if large.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(large), "host", "left")
    else:
        rows = spread_join(rows, large, "host", "left")
    rows = rows.withColumn("block", F.pmod("hash", F.coalesce("blocks", F.lit(1)))).select("page_id", "url", "html", "same", "host", "block", "hash")
    dealt = rows.repartition("host", "block").sortWithinPartitions("host", "block", "hash").drop("hash")

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns)
                if held and row[4:] != held[0][4:]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches):
            found, _ = extract_block([r[2] for r in block])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in block], pa.int64()), pa.array([r[1] for r in block], pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array([r[3] for r in block], pa.string())],
                ["page_id", "url", "text", "n_chars", "same"],
            )

    out = dealt.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, same string")
    if copies is None:
        return out.drop("same")
    out = written(out, "extracted")
    told = out.where("same IS NOT NULL").select("same", "text", "n_chars")
    again = spread_join(copies.select("page_id", "url", "same"), told, "same").select("page_id", "url", "text", "n_chars")
    return out.where("same IS NULL").drop("same").unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


#: What is left of these tables' pages without head, menus, adverts, scripts, comments, footers and markup.
SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_replace(html, '(?s)<head>.*?</head>|<script>.*?</script>|<nav>.*?</nav>|<!--.*?-->|<div class="ad">.*?</div>|<aside.*?</aside>|<form.*?</form>|<footer>.*?</footer>', '', 'g'), '') AS a FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(b|i|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS b FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS c FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(c, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
