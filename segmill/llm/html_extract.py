"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into leaf blocks, the runs of text between block-level tags, each with the tags, classes and ids of its
ancestors. Features of a block come from its ancestors and its text, transitions from its neighbours; Viterbi decoding
says which blocks are main text. The weights are trained in numpy on generated labelled pages of many layouts, among them
pages without any element or class that says what a block is.

Defined results: a null or empty page has an empty text; scripts, styles, comments and the head are never text; malformed
pages (unclosed tags, quotes or comments) are read to their end in time that is linear in their length, however deep they
nest; character references are decoded within a run of text, never across tags; repeated rows give repeated rows; other columns are
ignored; a page of any length is read whole.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, slices

# Fixed values of the HTML standard: elements without an end tag, elements whose content isn't markup, and elements that
# run within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that the head may hold; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: The end of a tag that closes itself; a slash at the end of an unquoted value doesn't.
_UNQUOTED = re.compile(r"""=\s*[^\s"'>][^\s>]*/>$""")


#: Elements that tell what their content is; the innermost of them counts for itself.
REGIONS = frozenset("article main nav aside footer header form section".split())


@dataclass(frozen=True)
class Place:
    """What a block's ancestors say of it; shared by all blocks of one element, and by elements that add nothing."""

    parent: str = ""  # innermost element that doesn't run within a line
    near: str = ""  # innermost of REGIONS
    depth: int = 0
    tags: frozenset[str] = frozenset()  # of all ancestors that don't run within a line
    names: frozenset[str] = frozenset()  # words of the classes, ids and roles of all ancestors

    def within(self, tag: str, words: set[str], known: tuple[frozenset[str], frozenset[str]] | None) -> Place:
        """The place inside of an element; tags and words that aren't ``known`` are left out, which bounds the sets."""
        names = words if known is None else words & known[1]
        names = self.names if names <= self.names else self.names | names
        if tag in INLINE:
            return self if names is self.names else Place(self.parent, self.near, self.depth, self.tags, names)
        tags = self.tags if tag in self.tags or known is not None and tag not in known[0] else self.tags | {tag}
        return Place(tag, tag if tag in REGIONS else self.near, self.depth + 1, tags, names)


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters within links


def _tag_end(page: str, at: int) -> int:
    """Place after the > of the tag that starts at ``at``, beyond quoted values; -1 if it has none."""
    close = page.find(">", at)
    if close < 0:
        return -1
    quote = re.compile(r"""=\s*(["'])""")
    i = at
    while (m := quote.search(page, i, close)) is not None:
        end = page.find(m[1], m.end())
        if end < 0:
            return close + 1
        i = end + 1
        if end > close:
            close = page.find(">", end)
            if close < 0:
                return -1
    return close + 1


def blocks(page: str | None, known: tuple[frozenset[str], frozenset[str]] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; blocks without text are left out. ``known`` are the tags and the words of names
    that a model tells apart (default: all)."""
    page = page or ""
    stack: list[tuple[str, Place]] = []
    at: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, where it is in the stack
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    low = None
    top = Place()
    last = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not at["head"]:
                out.append(Block(text, stack[-1][1] if stack else top, linked))
            parts.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and stack and stack[-1][0] == "head" and not s.isspace():
            close_to(at["head"][0])
        if s:
            s = html.unescape(s) if "&" in s else s
            parts.append(s)
            if at["a"]:
                linked += len(s.strip())

    def close_to(k: int) -> None:
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            at[t].pop()
        del stack[k:]

    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            text(page[i:])
            break
        text(page[i:j])
        if page.startswith("<!--", j):
            end = page.find("-->", j + 4)
            i = n if end < 0 else end + 3
        elif page[j + 1 : j + 2] in ("!", "?"):
            end = page.find(">", j)
            i = n if end < 0 else end + 1
        elif j > last or (m := _NAME.match(page, j + 2 if page.startswith("</", j) else j + 1)) is None or (end := _tag_end(page, m.end())) < 0:
            text("<")
            i = j + 1
        else:
            name, i = m[0].lower(), end
            if page[j + 1] == "/":
                if at[name]:
                    close_to(at[name][-1])
                elif name not in INLINE:
                    flush()
                continue
            if at["head"] and (name == "body" or name not in HEAD and not at["noscript"]):
                close_to(at["head"][0])
            if name == "br":
                parts.append(" ")
                continue
            if name not in INLINE:
                flush()
                if name in ENDS_P and at["p"]:
                    close_to(at["p"][-1])
                if name in ENDS_OWN and at[name] and at[name][-1] > max((at[t][-1] for t in ENDS_OWN[name] if at[t]), default=-1):
                    close_to(at[name][-1])
            if name in ("svg", "math") and page.startswith("/>", end - 2) and not _UNQUOTED.search(page, m.end(), end):
                continue
            if name in RAW:
                if low is None:
                    low = page.lower()
                if len(low) != n:  # a character whose lower case is longer
                    low = "".join(c.lower() if c.isascii() else c for c in page)
                end = low.find("</" + name, i)
                close = low.find(">", end) if end >= 0 else -1
                i = n if close < 0 else close + 1
            elif name not in VOID:
                found = (a or b or c for _, a, b, c in _ATTRIBUTE.findall(page, m.end(), end))
                words = {w for v in found for w in _TOKEN.findall(v.lower())}
                at[name].append(len(stack))
                stack.append((name, (stack[-1][1] if stack else top).within(name, words, known)))
    flush()
    return out


#: Words of notices and furniture; as features only.
CUES = "cookie cookies subscribe newsletter share comment comments reply advertisement sponsored privacy terms rights reserved copyright menu login related follow sign search home contact accept".split()


#: Words by which pages name the element of their main text; as features only.
CONTENT = frozenset("content main post article entry story text body".split())


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    # A page on which nothing is said to be the main text is read by its texts alone, with weights of their own.
    bare = not any({"article", "main"} & b.place.tags or CONTENT & b.place.names for b in page)
    for k, b in enumerate(page):
        p = b.place
        words = b.text.split()
        look = [f"length={min(7, len(words).bit_length())}", f"links={int(4 * b.linked / max(1, len(b.text)))}", f"stop={b.text[-1] in '.!?…:;'}", f"parent={p.parent}", f"sign={b.text[0] in '©»›|·'}", f"near={p.near}"]
        f = ["always", *look, f"deep={min(6, p.depth)}"]
        if bare:
            f += [f"bare,{x}" for x in look]
        f += [f"in={t}" for t in p.tags]
        f += [f"name={w}" for w in p.names]
        low = {w.strip(".,:;!?()").lower() for w in words} if len(words) < 40 else set()
        f += [f"cue={c}" for c in CUES if c in low]
        if k == 0 or k == len(page) - 1:
            f.append("edge")
        out.append(f)
    return out


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # (features, 2)
    trans: np.ndarray  # (2, 2)

    @cached_property
    def known(self) -> tuple[frozenset[str], frozenset[str]]:
        """Tags and words of names that the weights tell apart."""
        of = lambda kind: frozenset(n.removeprefix(kind) for n in self.index if n.startswith(kind))
        return of("in=") | {"article", "main"}, of("name=") | CONTENT

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for k, names in enumerate(features(page)):
            rows = [i for n in names if (i := self.index.get(n)) is not None]
            out[k] = self.weights[rows].sum(axis=0)
        return out

    def decode(self, page: list[Block]) -> np.ndarray:
        """Viterbi: whether each block is main text."""
        e = self.scores(page)
        if not len(e):
            return np.zeros(0, bool)
        back, s = np.zeros((len(e), 2), int), e[0]
        for t in range(1, len(e)):
            z = s[:, None] + self.trans
            back[t] = z.argmax(axis=0)
            s = z.max(axis=0) + e[t]
        y = np.zeros(len(e), int)
        y[-1] = s.argmax()
        for t in range(len(e) - 1, 0, -1):
            y[t - 1] = back[t, y[t]]
        return y == 1

    def main_text(self, page: str | None) -> str:
        b = blocks(page, self.known)
        return "\n".join(x.text for x, y in zip(b, self.decode(b), strict=True) if y)


# Labelled pages: main text is written between the marks \1 and \2, so that a block's label is in its text.


def labelled_page(rng: random.Random) -> str:
    """A page of an invented layout; each piece of main text starts with \\x01."""
    pick = rng.choice
    word = lambda: "".join(pick(("en", "re", "th", "ion", "er", "an", "é", "ñ", "sch", "ble", "ou", "ü", "ti", "a", "o", "ing")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(1, 18).capitalize() + pick((".", ".", ".", "!", "?", ""))
    prose = lambda: " ".join(sentence() for _ in range(pick((1, 1, 2, 4, 7))))
    main = lambda s: "\1" + s
    link = lambda s: f'<a href="/{word()}">{s}</a>'
    cls = lambda *names: f' {pick(("class", "class", "id"))}="{pick(names)}{pick(("", "", "-" + word(), str(rng.randint(1, 9))))}"' if rng.random() < 0.75 else ""

    # A page of plain elements; its menus and the like may be plain, too.
    bare = rng.random() < 0.2

    def paragraph() -> str:
        t = prose()
        if bare:
            t = t if rng.random() < 0.3 else t + " " + prose()
            return pick((f"<div>{main(t)}</div>", f"<p>{main(t)}</p>", f"{main(t)}<br><br>", f"<div>{main(t)}", f"<p>{main(t)}"))
        k = rng.random()
        if k < 0.05:
            return f"<h{rng.randint(2, 4)}>{main(words(1, 8))}</h2>"
        if k < 0.1:
            return "<ul>" + "".join(f"<li>{main(sentence())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if k < 0.13:
            return f"<blockquote><p>{main(t)}</p></blockquote>"
        if k < 0.17:
            return f"<p>{main(words(3, 9))} {link(words(1, 3))} {words(2, 9)}.</p>"
        if k < 0.2:
            return f"<p><b>{main(t)}<br>"
        if k < 0.22:
            return f"<pre>{main(t)}</pre>"
        if k < 0.26:
            return f"<div>{main(t)}</div>"
        return f"<p>{main(pick(('', '<b>', '<i>')) + t)}</p>"

    def nav() -> str:
        items = [link(words(1, 2)) for _ in range(rng.randint(3, 8))]
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)
        if bare and rng.random() < 0.5:
            return pick((f"<div>{body}</div>", body, "".join(f"<div>{x}</div>" for x in items)))
        return pick((f"<nav{cls('menu', 'navbar', 'nav')}>{body}</nav>", f"<div class=\"{pick(('menu', 'nav', 'navigation', 'breadcrumbs'))}\">{body}</div>"))

    def ad() -> str:
        return f"<{(t := pick(('div', 'aside', 'section')))} class=\"{pick(('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner'))}\">{pick((prose(), f'<p>{prose()}</p>'))}</{t}>"

    def aside() -> str:
        rows = "".join(pick((f"<li>{link(words(2, 7))}</li>", f"<li>{words(2, 5)}</li>")) for _ in range(rng.randint(2, 6)))
        return pick((f"<aside{cls('sidebar', 'related', 'widget')}><h3>{words(1, 3)}</h3><ul>{rows}</ul>{pick(('', f'<p>{prose()}</p>'))}</aside>", f"<div class=\"{pick(('sidebar', 'related', 'widget', 'recommended'))}\"><p>{prose()}</p><ul>{rows}</ul></div>"))

    def notice() -> str:
        said = pick(("We use cookies", "Subscribe to our newsletter", "Accept all cookies", "Sign up", "")) + " " + prose()
        return f"<div class=\"{pick(('cookie', 'cookies', 'notice', 'consent', 'popup', 'modal', 'newsletter', 'alert'))}\"><p>{said}</p><button>{words(1, 2)}</button></div>"

    def form() -> str:
        return f"<form{cls('search', 'signup', 'login')}><label>{words(1, 3)}</label><input name=\"q\"><p>{sentence()}</p><select><option>{word()}<option>{word()}</select><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        each = "".join(f"<div class=\"comment\"><b>{words(1, 2)}</b><p>{prose()}</p>{link('Reply')}</div>" for _ in range(rng.randint(1, 5)))
        return f"<{(t := pick(('section', 'div', 'aside')))} {pick(('class', 'id'))}=\"{pick(('comments', 'comment-list', 'responses', 'discussion'))}\"><h3>{pick(('Comments', words(1, 2)))}</h3>{each}</{t}>"

    def footer() -> str:
        t = f"&copy; {word()}.example &middot; {prose()}"
        if bare and rng.random() < 0.5:
            return f"<div>{t}</div>"
        return pick((f"<footer{cls('footer', 'site')}>{pick((t, f'<p>{t}</p>', nav() + t))}</footer>", f"<div class=\"footer\">{t}</div>"))

    def header() -> str:
        return f"<header{cls('header', 'masthead', 'top')}>{pick(('', f'<div class=\"logo\">{words(1, 3)}</div>', f'<h2>{words(1, 3)}</h2>'))}{nav()}</header>"

    def body() -> str:
        title = words(1, 11)
        parts = [f"<h1>{main(title)}</h1>" if rng.random() < 0.9 else ""] + [paragraph() for _ in range(pick((1, 1, 2, 4, 8, 14)))]
        for extra in (ad, aside, form, notice):
            if rng.random() < 0.12:
                parts.insert(rng.randint(1, len(parts)), extra())
        if rng.random() < 0.15:
            parts.append(comments())
        if rng.random() < 0.1:
            parts.append(f"<footer>{sentence()}</footer>")
        inner = "".join(parts)
        if bare:
            return pick(("{}", "<div>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "<div><div>{}</div></div>", "<center>{}</center>")).format(inner)
        k = rng.random()
        if k < 0.55:
            return f"<article{cls('post', 'article', 'entry', 'story')}>{inner}</article>"
        if k < 0.75:
            return f"<main{cls('content', 'main', 'page')}>{inner}</main>"
        return f"<div {pick(('class', 'id'))}=\"{pick(('content', 'main', 'post', 'article', 'entry', 'story', 'text', 'body'))}\">{inner}</div>"

    before = [x() for x in (header, nav, notice, ad, form) if rng.random() < 0.4]
    after = [x() for x in (aside, comments, ad, form, notice) if rng.random() < 0.25]
    rng.shuffle(before)
    rng.shuffle(after)
    if bare:
        before, after = [x() for x in (nav, form) if rng.random() < 0.3], [x() for x in (nav, aside) if rng.random() < 0.15]
    if rng.random() < (0.4 if bare else 0.85):
        after.append(footer())
    wrap = pick(("{}", "{}", "<div class=\"wrapper\">{}</div>", "<div id=\"page\"><div class=\"container\">{}</div></div>"))
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>" + wrap.format("".join(before) + body() + "".join(after)) + pick(("</body></html>", ""))


@cache
def train(pages: int = 500, rounds: int = 120, seed: int = 9, ridge: float = 1e-4) -> Model:
    """Maximum conditional likelihood by Adam over all generated pages at once; the same arguments give the same model."""
    rng = random.Random(seed)
    read = [blocks(labelled_page(rng)) for _ in range(pages)]
    labels = [[int("\1" in b.text) for b in page] for page in read]
    for page in read:
        for b in page:
            b.text = b.text.replace("\1", "").strip() or "."
    named = [features(page) for page in read]
    index = {n: i for i, n in enumerate(sorted({n for page in named for f in page for n in f}))}
    steps = max(map(len, read))
    x = np.zeros((len(read), steps, len(index)), np.float32)
    y, on = np.zeros((len(read), steps), int), np.zeros((len(read), steps), bool)
    for r, page in enumerate(named):
        for t, f in enumerate(page):
            x[r, t, [index[n] for n in f]] = 1
        y[r, : len(page)], on[r, : len(page)] = labels[r], True
    flat = x.reshape(-1, len(index))
    w, trans = np.zeros((len(index), 2), np.float32), np.zeros((2, 2), np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    total = on.sum()
    for step in range(1, rounds + 1):
        e = (flat @ w).reshape(len(read), steps, 2).astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], a, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            b = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(on[:, t + 1, None], b, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        gt = np.zeros((2, 2))
        for t in range(1, steps):
            m = on[:, t]
            joint = np.exp(alpha[m, t - 1, :, None] + trans + (e[m, t] + beta[m, t])[:, None, :] - z[m, None, None])
            gt += joint.sum(axis=0)
            np.subtract.at(gt, (y[m, t - 1], y[m, t]), 1)
        gold = np.eye(2)[y] * on[:, :, None]
        gw = flat.T @ (p - gold).reshape(-1, 2).astype(np.float32) / total + ridge * w
        for a, g, k in ((w, gw, 0), (trans, gt / total + ridge * trans, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
            a -= (0.1 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(index, w.astype(np.float64), trans.astype(np.float64))


def extract(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(train())
    kinds = [pages.select(pages[c]).schema[0].dataType.simpleString() for c in (id_col, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "html"):
                found = [model.main_text(t) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].alias("k"), pages[url].alias("u"), pages[page].alias("html")).transform(arrow, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
