"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page's leaf blocks (text between the edges of block elements) form a chain. Features of a block are the tags and hashed class
words of its ancestors, facts of its text (length, punctuation, links), the same of its neighbours, its place and depth, and how the page's running
text is spread over its elements; a conditional random field scores chains of the labels content and boilerplate, and Viterbi's
algorithm picks the best chain. No feature knows a class name or a word: a class word counts by its hash. The model is trained here by stochastic
gradient ascent on the conditional likelihood (forward-backward), on some 3.3 * TRAINING_PAGES labelled pages. No table has labels, so those
pages are composed (seeded) from layouts with known main text: of ten pages, six with semantic elements or names that pages use by convention,
three of bare divisions, layout tables and made-up names, one of few sentences or without markup. The words in them are random, of SCRIPTS.

Scale: map-only. Pages go through one at a time and whole; the model, some thousand weights, travels with the task.

Defined results: null or empty html, or a page without content, gives an empty text of 0 characters. A tag runs to its closing sign, whatever
stands before that; pages that break off inside a tag lose that tag only. An element of HIDDEN that is not closed hides text until its parent closes; one of RAW, as HTML reads it, to the end of the page.
Very long pages are read whole, in time linear in their length, however deep their elements. Of equally good chains the one with fewer content blocks is taken.
Repeated rows give repeated rows; an empty table an empty result; extra columns are left alone.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wharfline.llm.common import map_arrow

TRAINING_PAGES = 1000
EPOCHS = 5
#: Blocks that the model is so sure of move no weight.
LEAST_ERROR = 1e-3
SEED = 11
#: Different words of a script on training pages.
WORDS = 2000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attributes>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?P<whole>>|\Z)|<[!?][^>]*+(?:>|\Z)|</?\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Fixed values of HTML: elements whose inside is read raw up to their end tag, others whose inside is no text, those of them that do not keep
#: a tag inside from ending their parent, elements without an inside, and elements that begin no block.
RAW = frozenset("script style iframe textarea".split())
HIDDEN = frozenset("template noscript svg select object canvas audio video".split())
THROUGH = frozenset("svg canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of the key's kind ends when one of these begins.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]), "head": frozenset(["body"]),
}


@dataclass(slots=True)
class Element:
    """An element on the way to blocks. What holds of a whole path is kept with its last element, so that no path is walked again."""

    tag: str
    parent: Element | None
    number: int
    depth: int
    fresh: tuple[str, ...]  # features of the path that its parent's path does not have
    inner: tuple[str, ...]  # features of the nearest class words
    semantic: bool
    framed: bool


@dataclass(slots=True)
class Block:
    text: str
    at: Element | None  # the innermost element that began a block
    linked: int  # characters inside links
    label: int | None = None


@dataclass
class _Open:
    path: list = field(default_factory=list)  # elements
    tags: Counter = field(default_factory=Counter)  # the same, by tag
    facts: Counter = field(default_factory=Counter)  # features of the path, by how many of its elements have them
    parts: list = field(default_factory=list)
    linked: int = 0
    in_link: int = 0
    hidden: int | None = None  # length of the path outside the outermost open element of HIDDEN
    inline: tuple = field(default_factory=lambda: (Counter(), Counter()))  # open inline elements, outside of it and inside


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order: references decoded, white space one space, trimmed."""
    now, blocks, at, number = _Open(), [], 0, count()
    page = page or ""

    def close_block() -> None:
        text = " ".join("".join(now.parts).split())
        if text:
            blocks.append(Block(text, now.path[-1] if now.path else None, now.linked))
        now.parts, now.linked = [], 0

    def add(text: str) -> None:
        if text and now.hidden is None:
            text = html.unescape(text)
            now.parts.append(text)
            if now.in_link:
                now.linked += len(text)

    def push(name: str, attributes: str) -> None:
        parent, words = now.path[-1] if now.path else None, names_in(attributes)
        facts = {f"class={_hashed(w)}": None for w in words} | ({f"in={name}": None} if name in TELLING else {})
        fresh = tuple(f for f in facts if not now.facts[f])
        now.facts.update(fresh)
        inner = tuple({f"inner={_hashed(w)}": None for w in words}) or (parent.inner if parent else ())
        semantic, framed = name in ("article", "main") or bool(parent and parent.semantic), name in FRAMES or bool(parent and parent.framed)
        now.path.append(Element(name, parent, next(number), len(now.path) + 1, fresh, inner, semantic, framed))
        now.tags[name] += 1

    def pop() -> str:
        last = now.path.pop()
        now.tags[last.tag] -= 1
        now.facts.subtract(last.fresh)
        return last.tag

    def show() -> None:
        if now.hidden is not None:
            while len(now.path) > now.hidden:
                pop()
            now.hidden = None
            now.inline[1].clear()

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["name"] is None or not m["whole"]:
            continue
        name = m["name"].lower()
        outer, inner = now.inline
        if name == "br":
            add(" ")
        elif name in INLINE:
            own = outer if now.hidden is None else inner
            if not m["end"]:
                own[name] += name not in VOID
            elif own[name]:
                own[name] -= 1
            elif outer[name]:  # the parent of what is hidden
                outer[name] -= 1
                show()
            if name == "a" and now.hidden is None:
                now.in_link = 0 if m["end"] else 1
        elif m["end"]:
            close_block()
            if now.tags[name]:
                while pop() != name:
                    pass
                if now.hidden is None or len(now.path) < now.hidden:
                    now.in_link = 0
                if now.hidden is not None and len(now.path) <= now.hidden:
                    show()
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            close_block()
            at = close.end() if close else len(page)
        else:
            close_block()
            if now.hidden and len(now.path) == now.hidden + 1 and now.path[-1].tag in THROUGH and name in ENDED_BY.get(now.path[-2].tag, ()):
                show()
            while now.path and name in ENDED_BY.get(now.path[-1].tag, ()):
                pop()
            if name not in VOID and not m["attributes"].rstrip().endswith("/"):
                if name in HIDDEN and now.hidden is None:
                    now.hidden = len(now.path)
                push(name, m["attributes"])
    close_block()
    return blocks


def names_in(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    if "=" not in attributes:
        return ()
    return tuple(w for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for w in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower()))


#: Fixed values of HTML: elements that say something of what is in them, and those that frame a page.
TELLING = frozenset("article main nav header footer aside form head title figure ul ol table section dl blockquote pre button label".split())
FRAMES = frozenset("nav header footer aside form head title".split())
CLASS_BITS = 16
#: Ends of sentences and clauses, and those of other scripts; where words are written without spaces, a space is one.
STOP = re.compile(r"[.!?;:…](?:[\"'”’»)\]]|\s|$)|,\s")
OTHER_STOP = re.compile(r"[。！？，；：、؟،؛।॥።፣፤]|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff](?=\s)")
#: Characters that say about as much as three letters.
WIDE = re.compile("[\u2e80-\u2fff\u3040-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]+")
#: A block with so many letters that are no link counts as running text.
RUNNING = 80


def _length(text: str) -> int:
    return len(text) + 2 * sum(len(w) for w in WIDE.findall(text)) if not text.isascii() else len(text)


def _scale(n: float) -> int:
    return min(9, int(math.log2(n + 1)))


def _hashed(word: str) -> int:
    """A class word's number; a plural has its singular's."""
    return crc32(word.removesuffix("s").encode()) >> (32 - CLASS_BITS)


def local_features(blocks: list[Block]) -> list[list[str]]:
    """For each block the names of what holds of it beside the classes and telling tags of its path."""
    lengths = [_length(b.text) for b in blocks]
    free = [n * (len(b.text) - min(b.linked, len(b.text))) // max(1, len(b.text)) for b, n in zip(blocks, lengths, strict=True)]
    stops = [len(STOP.findall(b.text)) + (0 if b.text.isascii() else len(OTHER_STOP.findall(b.text))) for b in blocks]
    # running text by the elements that hold it directly or as parents of a block's own element
    held: Counter = Counter()
    for b, n in zip(blocks, free, strict=True):
        if n >= RUNNING and b.at:
            held[b.at.number] += n
            if b.at.parent:
                held[b.at.parent.number] += n
    best, most = held.most_common(1)[0] if held else (None, 0)
    whole = sum(n for n in free if n >= RUNNING)
    longest = max(free, default=0)
    semantic = [bool(b.at and b.at.semantic) for b in blocks]
    marked, total, before = any(semantic), sum(free) or 1, 0
    below: dict[int, bool] = {}  # elements known to be inside the best one, or not

    def inside_best(e: Element | None) -> bool:
        way = []
        while e is not None and e.number not in below and e.number != best:
            way.append(e.number)
            e = e.parent
        found = e is not None and below.get(e.number, True)
        below.update(dict.fromkeys(way, found))
        return found

    kinds = []
    for b, n, k in zip(blocks, free, stops, strict=True):
        share = b.linked / max(1, len(b.text))
        kinds.append(("link" if share > 0.7 else "run" if n >= RUNNING and k else "long" if n >= RUNNING else "line" if k else "short", share))
    out = []
    for i, b in enumerate(blocks):
        e = b.at
        state = "in" if semantic[i] else "out" if marked else "none"
        found = ["bias", state, *(e.inner if e else ())]
        if e and e.framed:
            found.append("framed")
        if b.text.startswith("©"):
            found.append("copyright")
        kind, share = kinds[i]
        own, parent = e.tag if e else "", e.parent.tag if e and e.parent else ""
        if whole or marked:
            near = "away" if e is None or best is None else "direct" if best in (e.number, e.parent.number if e.parent else None) else "inside" if inside_best(e) else "away"
        else:  # neither names nor running text: the longest block says most
            near = "longest" if free[i] == longest and longest else "shorter"
        around = f"{kinds[i - 1][0] if i else ''}/{kind}/{kinds[i + 1][0] if i + 1 < len(blocks) else ''}"
        local = [
            f"own={own}", f"parent={parent}", f"size={_scale(lengths[i])}", f"free={_scale(free[i])}", f"kind={kind}",
            f"stops={min(4, stops[i])}", f"density={min(5, stops[i] * 100 // max(1, len(b.text)))}",
            "links=all" if share > 0.9 else "links=many" if share > 0.3 else "links=few" if share else "links=none",
            f"prev={kinds[i - 1][0] if i else ''}", f"next={kinds[i + 1][0] if i + 1 < len(blocks) else ''}", f"around={around}",
            f"best={near}", f"best={near}/{kind}", f"best={near}/{own}", f"share={most * 4 // max(1, whole)}/{near}", f"depth={min(8, e.depth if e else 0)}", f"before={before * 5 // total}",
            "place=only" if len(blocks) == 1 else "place=first" if i == 0 else "place=last" if i == len(blocks) - 1 else "place=inside",
        ]
        out.append(found + [f"{state}|{x}" for x in local])
        before += free[i]
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The same with those of the path."""
    out = []
    for b, found in zip(blocks, local_features(blocks), strict=True):
        e = b.at
        while e:
            found.extend(e.fresh)
            e = e.parent
        out.append(found)
    return out


@dataclass
class Field:
    """Weights towards content of each feature, and of each pair of labels in a row."""

    weight: dict[str, float]
    pair: list[list[float]]

    def scores(self, blocks: list[Block]) -> list[float]:
        """Each block's score; that of a path is its parent's and what is new on it."""
        get, paths = self.weight.get, {}

        def of_path(e: Element | None) -> float:
            way = []
            while e is not None and e.number not in paths:
                way.append(e)
                e = e.parent
            score = paths[e.number] if e else 0.0
            for e in reversed(way):
                score += sum(get(f, 0.0) for f in e.fresh)
                paths[e.number] = score
            return score

        return [sum(get(f, 0.0) for f in found) + of_path(b.at) for b, found in zip(blocks, local_features(blocks), strict=True)]


def viterbi(scores: list[float], pair: list[list[float]]) -> list[int]:
    """The best chain of labels; label 1 at place i scores scores[i], label 0 nothing."""
    if not scores:
        return []
    best, back = [0.0, scores[0]], []
    for s in scores[1:]:
        came = [0 if best[0] + pair[0][y] >= best[1] + pair[1][y] else 1 for y in (0, 1)]
        best = [best[came[y]] + pair[came[y]][y] + (s if y else 0.0) for y in (0, 1)]
        back.append(came)
    label = 0 if best[0] >= best[1] else 1
    labels = [label]
    for came in reversed(back):
        label = came[label]
        labels.append(label)
    return labels[::-1]


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(scores: list[float], pair: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """By forward-backward: each place's chance of label 1, and the expected number of each pair of labels."""
    n = len(scores)
    ahead = [[0.0, scores[0]]]
    for s in scores[1:]:
        p = ahead[-1]
        ahead.append([_log_sum(p[0] + pair[0][y], p[1] + pair[1][y]) + (s if y else 0.0) for y in (0, 1)])
    behind = [[0.0, 0.0]]
    for s in reversed(scores[1:]):
        q = behind[-1]
        behind.append([_log_sum(pair[y][0] + q[0], pair[y][1] + s + q[1]) for y in (0, 1)])
    behind.reverse()
    whole = _log_sum(*ahead[-1])
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        for x in (0, 1):
            for y in (0, 1):
                pairs[x][y] += math.exp(ahead[i - 1][x] + pair[x][y] + (scores[i] if y else 0.0) + behind[i][y] - whole)
    return [math.exp(a[1] + b[1] - whole) for a, b in zip(ahead, behind, strict=True)], pairs


def fit(pages: list[list[Block]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.3, shrink: float = 1e-4) -> Field:
    """Stochastic gradient ascent on the conditional log-likelihood of labelled chains, with L2 shrinkage and steps that shrink with what a weight has moved,
    so that rare features learn too: its squared errors summed block by block. Each chain is one step, taken for all of its features at once."""
    rng, ids, chains = random.Random(seed), {}, []
    for p in filter(None, pages):
        found = features(p)
        flat = np.array([ids.setdefault(f, len(ids)) for fs in found for f in fs])
        used, place = np.unique(flat, return_inverse=True)
        block = np.repeat(np.arange(len(found)), [len(fs) for fs in found])
        chains.append((used, place, block, np.array([b.label or 0 for b in p])))
    weight, moved, pair = np.zeros(len(ids)), np.full(len(ids), 0.1), [[0.0, 0.0], [0.0, 0.0]]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        rng.shuffle(chains)
        for used, place, block, labels in chains:
            scores = np.bincount(block, weight[used][place], len(labels))
            chance, pairs = marginals(scores.tolist(), pair)
            error = labels - np.array(chance)
            error[np.abs(error) <= LEAST_ERROR] = 0.0
            if error.any():
                old = weight[used]
                g = np.bincount(place, error[block], len(used)) - shrink * old
                moved[used] += np.bincount(place, np.square(error)[block], len(used))
                weight[used] = old + rate * g / np.sqrt(moved[used])
            for a, b in zip(labels, labels[1:], strict=False):
                pairs[a][b] -= 1
            for x in (0, 1):
                for y in (0, 1):
                    pair[x][y] -= step * 0.3 * (pairs[x][y] + shrink * pair[x][y])
    return Field({f: float(weight[n]) for f, n in ids.items() if weight[n]}, pair)


# --- labelled pages

#: Words of class names that pages use by convention. Training pages bear them; the model sees hashes.
CONVENTIONS = {
    "ads": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager",
    "frame": "header footer masthead copyright colophon foot head",
    "side": "sidebar aside widget widgets related recommended rail",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer newsletter subscribe subscription paywall signup",
    "share": "share sharing social follow tags meta byline author",
    "comments": "comment comments reply replies respond disqus discussion",
    "form": "form search login input contact",
    "body": "article content post entry story main text body maintext prose",
}
MARK = "\u0001"


@dataclass(frozen=True)
class Script:
    """How training pages are written: letters, the longest word, what is between words, clauses and sentences, what ends a sentence."""

    letters: str
    longest: int = 9
    space: str = " "
    comma: str = ", "
    stop: str = "."
    gap: str = " "


SCRIPTS = {
    "latin": Script("aeioulnrst"), "cyrillic": Script("оеаинтсрвл"), "greek": Script("αοιετσνηυρ"), "arabic": Script("اليمونترب", 7, comma="، "),
    "devanagari": Script("कनरतसहमलयप", 6, stop="।"), "hangul": Script("가나다라마바사아자하", 4),
    "han": Script("的一是不了人我在有他这中大来上国", 2, "", "，", "。", ""), "kana": Script("のにはをたがでてとしれさ", 4, "", "、", "。", ""), "thai": Script("กนรวมลยสตดาเ", 8, "", " ", "", " "),
}


@lru_cache(maxsize=len(SCRIPTS))
def vocabulary(script: Script) -> list[str]:
    """Random words."""
    rng = random.Random(SEED)
    return ["".join(rng.choices(script.letters, k=rng.randint(1, script.longest))) for _ in range(WORDS)]


class Composer:
    """Random pages; blocks of main text begin with MARK."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.script = SCRIPTS["latin"] if rng.random() < 0.6 else rng.choice(list(SCRIPTS.values()))

    def word(self) -> str:
        return self.rng.choice(vocabulary(self.script))

    def words(self, n: int) -> str:
        return self.script.space.join(self.rng.choices(vocabulary(self.script), k=n)).capitalize()

    def text(self, low: int, high: int) -> str:
        return self.words(self.rng.randint(low, high)) + self.rng.choice([self.script.stop] * 3 + ["", "!!", "%%%"])

    def prose(self, low: int, high: int) -> str:
        """Sentences with commas."""
        comma, stop, gap = self.script.comma, self.script.stop, self.script.gap
        clause = lambda: self.words(self.rng.randint(2, 9))
        return gap.join(clause() + (comma + clause().lower() if self.rng.random() < 0.5 else "") + stop for _ in range(self.rng.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        quoted = self.rng.choice(["", "", f' title="{self.word()} > {self.word()}"'])
        return f'<a href="/{self.word()}"{quoted}>{self.text(low, high)}</a>'

    def many(self, make, most: int = 6) -> str:
        return "".join(make() for _ in range(self.rng.randint(1, most)))

    def content(self) -> str:
        """A piece of main text."""
        rng, text = self.rng, self.text
        body = MARK + text(*rng.choice([(1, 3), (4, 30), (20, 120)]))
        form = rng.random()
        if form < 0.6:
            return rng.choice([f"<p>{body}</p>", f"<p><b>{body}", f"<p>{body}<br>", f"<p>{body} {rng.choice([self.link(), text(1, 60), text(1, 4)])} {text(1, 9)}</p>"])
        if form < 0.7:
            return "<ul>" + self.many(lambda: f"<li>{MARK}{text(1, 20)}</li>", 5) + "</ul>"
        if form < 0.78:
            return f"<h2>{MARK}{text(1, 8)}</h2>"
        if form < 0.84:
            return f"<blockquote><p>{body}</p></blockquote>"
        if form < 0.9:
            return f"<figure><figcaption>{MARK}{text(2, 12)}</figcaption></figure>"
        if form < 0.95:
            return f"<table><tr><td>{MARK}{text(1, 5)}</td><td>{MARK}{text(1, 5)}</td></tr></table>"
        return rng.choice([f"<pre>{body}</pre>", f"<div>{body}</div>", body])

    def boiler(self, inside: bool) -> str:
        """Something beside the main text, inside its element or outside."""
        rng, text, many = self.rng, self.text, self.many
        links = lambda: many(lambda: f"<li>{self.link()}</li>")
        whole = lambda tag, family, inner: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "page "])}{rng.choice(CONVENTIONS[family].split())}">{inner}</{tag}>'
        of = lambda family, inner: whole(rng.choice(["div", "div", "section"]), family, inner)
        some = lambda: rng.choice([text(1, 40), f"<p>{text(1, 60)}</p>", many(lambda: f"<p>{text(3, 30)}</p>")])
        either = [
            lambda: of("ads", some()), lambda: of("share", f"<ul>{links()}</ul>"), lambda: of("notice", some()), lambda: of("comments", many(lambda: f"<p>{text(2, 80)}</p>")),
            lambda: f"<aside>{some()}</aside>", lambda: f"<form><label>{text(1, 4)}</label><button>{text(1, 2)}</button></form>", lambda: of("form", f"<form>{text(1, 8)}</form>"), lambda: of("side", some()), lambda: f"<footer>{text(1, 20)}</footer>",
        ]
        outer = [
            lambda: f"<nav><ul>{links()}</ul></nav>", lambda: of("menu", f"<ul>{links()}</ul>"), lambda: f"<header><h1>{text(1, 5)}</h1>{some()}</header>",
            lambda: f"<footer>© {some()}</footer>", lambda: of("frame", some()), lambda: f"<ul>{links()}</ul>", lambda: f"<footer><p>{some()}</footer>",
        ]
        return rng.choice(either if inside else either + outer)()

    def title(self) -> str:
        return f"<title>{self.text(1, 9)}</title>" if self.rng.random() < 0.9 else ""

    def named(self) -> str:
        """A page with semantic elements or conventional names."""
        rng = self.rng
        inner = f"<h1>{MARK}{self.text(1, 9)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 12)):
            inner += self.content()
            if rng.random() < 0.15:
                inner += self.boiler(True)
        kind = rng.random()
        if kind < 0.55:
            main = f"<article>{inner}</article>"
        elif kind < 0.7:
            main = f"<main><article>{inner}</article></main>"
        elif kind < 0.8:
            main = f"<main>{inner}</main>"
        else:
            main = f'<div {rng.choice(["class", "id"])}="{rng.choice(["", "post-", "main "])}{rng.choice(CONVENTIONS["body"].split())}">{inner}</div>'
        before, after = ("".join(self.boiler(False) for _ in range(rng.randint(0, 4))) for _ in range(2))
        return f"{self.title()}</head><body>{before}{main}{after}</body></html>"

    def plain(self) -> str:
        """A text without markup, or with line breaks alone."""
        return MARK + self.rng.choice(["\n", "<br>", " "]).join(self.prose(1, 6) if self.rng.random() < 0.7 else self.text(1, 12) for _ in range(self.rng.randint(1, 5)))

    def short(self) -> str:
        """A page of few sentences, none of them long, beside links and a line of copyright."""
        rng, end = self.rng, self.script.stop
        sentence = lambda: self.words(rng.randint(3, 9)) + end
        tag = rng.choice(["p", "div", "div"])
        main = "".join(f"<{tag}>{MARK}{sentence()}</{tag}>" for _ in range(rng.choice([1, 1, 2, 3])))
        if rng.random() < 0.3:
            main = f"<h1>{MARK}{self.words(rng.randint(1, 4))}</h1>" + main
        beside = [lambda: f"<div>{self.link()}</div>", self.link, lambda: f"<ul>{self.many(lambda: f'<li>{self.link()}</li>')}</ul>", lambda: f"<div>© {rng.randint(1995, 2030)} {self.words(2)}</div>"]
        before, after = ("".join(rng.choice(beside)() for _ in range(rng.randint(0, 2))) for _ in range(2))
        return f"{self.title()}</head><body>{before}{f'<div>{main}</div>' if rng.random() < 0.4 else main}{after}</body></html>"

    def bare(self) -> str:
        """A page whose elements and names say nothing: only the shape of its text tells."""
        rng, text = self.rng, self.text
        name = lambda: rng.choice(["", "", f' class="{rng.choice("cxbq")}{rng.randint(1, 99)}"', f' id="{self.word()}"', f' class="{self.word()} {self.word()}"'])
        box = lambda inner: f"<div{name()}>{inner}</div>"
        parts = [f"<h1>{MARK}{text(2, 9)}</h1>"] if rng.random() < 0.7 else []
        wrap = rng.choice(["p", "p", "p", "div", "br"])
        for _ in range(rng.randint(2, 10)):
            form, body = rng.random(), MARK + self.prose(2, 9)
            if form < 0.8:
                parts.append(body + "<br><br>" if wrap == "br" else f"<{wrap}{name()}>{body}</{wrap}>")
            elif form < 0.84:
                parts.append(f"<p>{MARK}{self.prose(1, 3)} {self.link(1, 4)} {self.prose(1, 3)}</p>")
            elif form < 0.88 and wrap != "br":
                parts.append(f"<{wrap}>{MARK}{text(1, 7)}</{wrap}>")
            elif form < 0.93:
                parts.append(f"<h3>{MARK}{text(1, 7)}</h3><p>{MARK}{self.prose(2, 6)}</p>")
            else:
                parts.append("<ul>" + self.many(lambda: f"<li>{MARK}{self.prose(1, 2)}</li>", 4) + "</ul>" + f"<p>{MARK}{self.prose(2, 6)}</p>")
        inner = "".join(parts)
        rows = lambda: self.many(lambda: rng.choice([f"<li>{self.link()}</li>", f"<p>{self.link(1, 6)}</p>", f"<div{name()}>{self.link()}</div>"]), 8)
        beside = [
            lambda: box(f"<ul>{rows()}</ul>"), lambda: box(rows()), lambda: box(" | ".join(self.link() for _ in range(rng.randint(2, 6)))), lambda: box(text(1, 5)), lambda: box(f"{text(3, 12)} {self.link()}"),
            lambda: box(f"<h4>{text(1, 3)}</h4><ul>{rows()}</ul>"), lambda: box(f"© {rng.randint(1995, 2030)} {text(1, 6)}"), lambda: box(f"<p>{text(1, 8)}</p>"), lambda: box(f"{text(1, 3)} {rng.randint(1995, 2030)} {text(1, 4)}"), lambda: box(f"<p>{self.prose(1, 2)}</p><button>{text(1, 2)}</button>"), lambda: box(f"<span>{text(1, 3)}</span><span>{text(1, 3)}</span>"), lambda: f"<form{name()}>{text(1, 4)}<button>{text(1, 2)}</button></form>",
        ]
        before, after = ([rng.choice(beside)() for _ in range(rng.randint(0, 4))] for _ in range(2))
        if rng.random() < 0.3:  # a layout table
            cell = lambda x: f"<td{name()}>{x}</td>"
            line = lambda *xs: "<tr>" + "".join(cell(x) for x in xs) + "</tr>"
            loose = lambda: rng.choice(["<br>", " | ", " "]).join(self.link() for _ in range(rng.randint(1, 5))) if rng.random() < 0.6 else text(1, 5)
            before, after = ([loose() if rng.random() < 0.4 else x for x in xs] for xs in (before, after))
            sides = [loose() if rng.random() < 0.5 else rng.choice(beside)()] if rng.random() < 0.7 else []
            cells = [*sides, inner] if rng.random() < 0.5 else [inner, *sides]
            body = "<table>" + "".join(line(x) for x in before) + line(*cells) + "".join(line(x) for x in after) + "</table>"
        else:
            main = inner if rng.random() < 0.15 else box(inner) if rng.random() < 0.6 else box(box(inner) + (rng.choice(beside)() if rng.random() < 0.3 else ""))
            body = "".join(before) + main + "".join(after)
            body = box(body) if rng.random() < 0.4 else body
        return f"{self.title()}</head><body>{body}</body></html>"


def _labelled(page: str, rng: random.Random, framed: bool = True) -> list[Block]:
    page = "<!DOCTYPE html><html><head><meta charset='utf-8'>" + page if framed else page
    if framed and rng.random() < 0.1:
        page = page[: rng.randint(len(page) // 2, len(page))]
    blocks = leaf_blocks(page)
    for b in blocks:
        b.label = int(MARK in b.text)
        b.text = b.text.replace(MARK, "")
    return blocks


def labelled_page(rng: random.Random) -> list[Block]:
    """A page with semantic elements or conventional names; blocks of its main text are labelled 1."""
    return _labelled(Composer(rng).named(), rng)


def bare_page(rng: random.Random) -> list[Block]:
    """A page without either; labelled alike."""
    return _labelled(Composer(rng).bare(), rng)


def short_page(rng: random.Random) -> list[Block]:
    """A page of a few short sentences, or, a fifth of the time, a text without markup; labelled alike."""
    return _labelled(Composer(rng).short(), rng) if rng.random() < 0.8 else _labelled(Composer(rng).plain(), rng, False)


@lru_cache(maxsize=1)
def default_field() -> Field:
    rng = random.Random(SEED)
    return fit([make(rng) for n in range(TRAINING_PAGES) for make in (labelled_page, labelled_page, bare_page, *([short_page] if n % 3 == 0 else []))])


def main_text(page: str | None, model: Field) -> str:
    """The content blocks in page order, an empty line between them."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(model.scores(blocks), model.pair), strict=True) if y)


def extract(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars)."""
    model = model or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    source = pages.select(id_col, url_col, html_col)
    return map_arrow(source, run, source.drop(html_col).schema.add("text", "string").add("n_chars", "long"))
