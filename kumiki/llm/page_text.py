"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Labelled pages that the model is trained on; they are generated from the layouts below.
TRAIN_PAGES = 600

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea option datalist".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
_SECTIONS = frozenset("article main nav header footer aside form section body figure table".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEAD = frozenset("html head base link meta title style script noscript template".split())
_IMPLIED = {"li": ("li",), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
#: Characters of a tag within which quotes may hide its end; in a longer one the first ">" ends it.
_QUOTED = 1 << 14
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LINK = re.compile(r"https?://|www\.")
_NOTICE = re.compile(r"\b(cookies?|consent|subscribe|newsletter|sign (?:in|up)|log ?in|register|accept|advertis\w+|sponsored|all rights reserved|privacy|terms|share|follow us|related|read more|comments?|repl(?:y|ies)|says|posted by|ago|search|menu|copyright)\b|©|&copy;", re.I)


class Block:
    __slots__ = ("text", "leaf", "near", "tags", "names", "linked")

    def __init__(self, text, leaf, near, tags, names, linked):
        self.text, self.leaf, self.near, self.tags, self.names, self.linked = text, leaf, near, tags, names, linked


class _Open:
    """The open elements of a page: each is pushed and popped once, and what a block asks of them is counted as they come and go."""

    def __init__(self, known):
        self.known, self.stack, self.blocks, self.inline = known, [], [], [Counter()]
        self.sections, self.tags, self.names, self.unseen, self.links = [], Counter(), Counter(), 0, 0

    def push(self, tag: str, parts: tuple[str, ...]) -> None:
        parts = tuple(p for p in parts if self.known is None or f"name={p}" in self.known)
        self.stack.append((tag, parts))
        self.names.update(parts)
        self.unseen += tag in _UNSEEN
        self.links += tag == "a"
        if tag in _INLINE:
            self.inline[-1][tag] += 1
        else:
            self.blocks.append(len(self.stack) - 1)
            self.inline.append(Counter())
            self.tags[tag] += 1
            if tag in _SECTIONS:
                self.sections.append(tag)

    def cut(self, to: int) -> None:
        """Close all elements from place ``to`` on."""
        while len(self.stack) > to:
            tag, parts = self.stack.pop()
            for p in parts:
                self.names[p] -= 1
                if not self.names[p]:
                    del self.names[p]
            self.unseen -= tag in _UNSEEN
            self.links -= tag == "a"
            if tag in _INLINE:
                self.inline[-1][tag] -= 1
            else:
                self.blocks.pop()
                self.inline.pop()
                self.tags[tag] -= 1
                if not self.tags[tag]:
                    del self.tags[tag]
                if tag in _SECTIONS:
                    self.sections.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the last open element of its name; an inline one none beyond its block."""
        if tag in _INLINE:
            if self.inline[-1][tag]:
                self.cut(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))
        elif self.tags[tag]:
            self.cut(next(k for k in reversed(self.blocks) if self.stack[k][0] == tag))

    def innermost(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else "none"


def _tags(page: str):
    """(start, end, name, closing, attributes) of each tag and comment (name None), in time that grows with the page.

    After a raw element's start tag the scan goes on at its end tag.  A tag whose quote is never closed ends at its
    first ">", so that no text is lost; the text after it is text of the page.
    """
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif at > last:
            return
        elif m := _NAME.match(page, at):
            end = page.find(">", m.end()) + 1
            if any(page.count(q, m.end(), min(end, m.end() + _QUOTED)) % 2 for q in "\"'"):
                quoted = _ATTRIBUTES.match(page, m.end(), m.end() + _QUOTED)
                end = quoted.end() if quoted else end
            name, closing = m[1].lower(), page[at + 1] == "/"
            yield at, end, name, closing, page[m.end() : end - 1]
            if name in _RAW and not closing:
                shut = _SHUT[name].search(page, end)
                end = shut.start() if shut else len(page)
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
        else:
            end = at + 1
        at = page.find("<", end)


_SHUT = {name: re.compile(rf"</{name}\b", re.I) for name in _RAW}


def leaf_blocks(page: str, known=None) -> list[Block]:
    """Runs of text between block-level tags, with the tags and name parts of their ancestors.

    Scripts, styles, comments and the head are left out; the head ends at its end tag or
    at the first tag that cannot stand in it.  Inline tags do not cut a block and a line
    break is white space.  Character references are decoded.  With ``known``, only the
    name parts that are features of a model are kept, so that a block has a bounded number.
    """
    out, held, raw, link, at = [], _Open(known), [], 0, 0

    def text(end):
        nonlocal link
        if end > at:
            raw.append(page[at:end])
            if held.links:
                link += len(page[at:end].strip())

    def flush():
        nonlocal link
        if raw and not held.unseen:
            words = " ".join(html.unescape("".join(raw)).split())
            if words:
                near = held.sections[-1] if held.sections else "none"
                out.append(Block(words, held.innermost(), near, list(held.tags), list(held.names), min(1.0, link / len(words))))
        raw.clear()
        link = 0

    skipped = 0
    for start, end, name, closing, attrs in _tags(page):
        if skipped:  # the end of a raw element, whose text is no text of the page
            at, skipped = start, 0
        text(start)
        at = end
        if name is None:
            continue
        if name == "br":
            raw.append(" ")
        if not closing and name not in _HEAD and held.tags["head"]:
            flush()
            held.close("head")
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        if name not in _INLINE:
            flush()
        if closing:
            held.close(name)
            continue
        if name not in _INLINE:
            inner = held.innermost()
            if inner == "p" and name in _CLOSES_P or inner in _IMPLIED.get(name, ()):
                held.cut(held.blocks[-1])
        names = tuple(p.lower() for a in _NAMES.findall(attrs) for p in _PART.findall("".join(a))) if attrs else ()
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path"):
            held.push(name, names)
        skipped = name in _RAW
    if not skipped:
        text(len(page))
    flush()
    return out


def _features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        near, leaf = b.near, b.leaf
        f = ["1", f"leaf={leaf}", f"near={near}", f"leaf={leaf} near={near}", f"words={min(6, words.bit_length())}", f"linked={int(b.linked * 4)}", f"place={4 * i // n}"]
        f += [f"in={t}" for t in b.tags]
        f += [f"name={p}" for p in b.names]
        f.append(f"words={min(6, words.bit_length())} linked={b.linked > 0.5}")
        f.append(f"stop={b.text[-1] in '.!?…:;»”\"'}")
        if _NOTICE.search(b.text):
            f += ["notice", f"notice short={words < 25}"]
        if _LINK.search(b.text):
            f.append("address")
        out.append(f)
    return out


class ChainCRF:
    """Two labels (0 around, 1 main text), indicator features, transition weights."""

    def __init__(self, ridge: float = 0.5, steps: int = 120):
        self.ridge, self.steps = ridge, steps

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]]) -> "ChainCRF":
        """Conditional likelihood by forward-backward over all pages at once, with Adam steps."""
        self.at = {k: i for i, k in enumerate(sorted({f for page in pages for block in page for f in block}))}
        m, count, longest = len(self.at), len(pages), max(map(len, pages))
        page, place, what, gold = [], [], [], np.full((count, longest), -1)
        for p, (blocks, y) in enumerate(zip(pages, labels)):
            gold[p, : len(y)] = y
            for t, block in enumerate(blocks):
                page += [p] * len(block)
                place += [t] * len(block)
                what += [self.at[f] for f in block]
        cell, what, live = np.array(page) * longest + np.array(place), np.array(what), gold >= 0
        w, trans = np.zeros(m), np.zeros((2, 2))
        both = live[:, 1:]
        moves = np.zeros((2, 2))
        np.add.at(moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        size, first, second = m + 4, np.zeros(m + 4), np.zeros(m + 4)
        for k in range(1, self.steps + 1):
            s = np.bincount(cell, w[what], count * longest).reshape(count, longest)
            emit = np.stack([np.zeros_like(s), s], axis=2)
            fore, back = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
            fore[:, 0] = emit[:, 0]
            for t in range(1, longest):
                step = np.logaddexp(fore[:, t - 1, 0, None] + trans[0], fore[:, t - 1, 1, None] + trans[1]) + emit[:, t]
                fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = emit[:, t + 1] + back[:, t + 1]
                step = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
                back[:, t] = np.where(live[:, t + 1, None], step, 0.0)
            z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
            one = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None]) * live
            gap = ((gold == 1) - one) * live
            pair = np.exp(fore[:, :-1, :, None] + trans + (emit + back)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            g = np.concatenate([np.bincount(what, gap.reshape(-1)[cell], m) - self.ridge * w, (moves - pair.sum((0, 1))).reshape(-1)]) / count
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            step = 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
            w, trans = w + step[:m], trans + step[m:].reshape(2, 2)
        assert size == len(step)
        self.w, self.trans = w.tolist(), trans.tolist()
        return self

    def decode(self, page: list[list[str]]) -> list[int]:
        """The labels of the best chain, by Viterbi; unseen features have no weight."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.trans
        zero = one = None
        back = []
        for block in page:
            s = sum(self.w[self.at[f]] for f in block if f in self.at)
            if zero is None:
                zero, one = 0.0, s
                continue
            from_zero, from_one = zero + aa >= one + ba, zero + ab >= one + bb
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + s
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A generated page and the texts of its main blocks, in one of many layouts."""
    r = random.Random(seed)
    letters = [a + b for a in ("b", "d", "th", "r", "s", "k", "l", "m", "n", "pr", "v", "") for b in "aeiou"]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 4))) + r.choice(["", "n", "s", "t"])
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice(".....!?")
    said = ["comments", "the cookie", "all rights reserved.", "privacy terms", "subscribe", "https://x.example.com/a", "(c) 2020 copyright", "search", "related menu", "a reply", "years ago", "share", "sponsored", "log in"]
    brief = lambda: r.choice([words(1, 1), words(1, 2), r.choice(said)]).capitalize() + r.choice([".", ".", "!", "!!", "?", ""])
    para = lambda: brief() if r.random() < 0.15 else " ".join(sentence() + (" " + r.choice(said) if r.random() < 0.12 else "") for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    names = lambda *c: r.choice(["", r.choice([f' class="{x}"', f' id="{x}"', f" class='{word()} {x}'", f' class="site-{x}"', f' class="{x}-{word()}"'])]) if (x := r.choice(c)) else ""
    must = lambda *c: r.choice([f' class="{(x := r.choice(c))}"', f' id="{x}"', f' class="{x} {word()}"', f' class="{x}-{word()}"', f' class="main-{x}"' if x in ("nav", "menu") else f' class="{x}"']) if (x := r.choice(c)) else ""
    main: list[str] = []

    def keep(text):
        main.append(" ".join(html.unescape(re.sub(r"<br ?/?>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", text))).split()))
        return text

    def rich(text):
        w = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(w))
            w[i] = r.choice([f"<b>{w[i]}</b>", f"<em>{w[i]}</em>", f'<a href="/{word()}">{w[i]}</a>', w[i] + "<br>", w[i] + " &amp;", f"<span>{w[i]}</span>"])
        return " ".join(w)

    def nav():
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return r.choice([f"<nav{names('nav', 'menu')}><ul>{items}</ul></nav>", f"<div{must('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs')}><ul>{items}</ul></div>", f"<nav>{' '.join(link() for _ in range(r.randint(2, 6)))}</nav>"])

    def header():
        inside = r.choice([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{sentence()}</p>", link()]) + r.choice(["", nav(), f"<form><input name=q><button>Search</button></form>"])
        return r.choice([f"<header{names('header', 'masthead', 'top')}>{inside}</header>", f"<div{must('header', 'masthead', 'topbar')}>{inside}</div>"])

    def footer():
        inside = r.choice([f"&copy; {word()}.example.com &middot; {para()}", f"<p>Copyright {word()} {para()}</p>", f"<p>{sentence()}</p><ul><li>{link()}</li><li>{link()}</li></ul>", f"<small>{words(2, 8)}. All rights reserved.</small>", para(), f"<p>{para()}</p>"])
        return r.choice([f"<footer{names('footer', 'colophon')}>{inside}</footer>"] * 3 + [f"<div{must('footer', 'copyright', 'legal', 'bottom')}>{inside}</div>"])

    def aside():
        inside = r.choice([f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>", f"<p>{para()}</p>", para(), f"<h2>{words(1, 3)}</h2><p>{para()}</p><p>{para()}</p>"])
        return r.choice([f"<aside{names('sidebar', 'widget')}>{inside}</aside>", f"<div{must('sidebar', 'widget', 'related', 'popular', 'recommended', 'trending', 'tags', 'share', 'social', 'author', 'toc')}>{inside}</div>"])

    def ad():
        inside = r.choice([para(), f"<p>{para()}</p>", link(), f"<a href='/x'>{sentence()}</a>"])
        return f"<{(t := r.choice(['div', 'div', 'div', 'section', 'aside', 'p']))}{must('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsor', 'sponsored', 'adsbox')}>{inside if t != 'p' else para()}</{t}>"

    def notice():
        inside = r.choice([f"<p>{para()}</p>", para(), f"<p>We use cookies. {sentence()}</p><button>Accept</button>", f"<p>Subscribe to our newsletter. {sentence()}</p>"])
        return f"<div{must('cookie', 'cookies', 'notice', 'consent', 'alert', 'gdpr', 'newsletter', 'subscribe', 'popup', 'modal', 'paywall', 'message', 'warning', 'disclaimer')}>{inside}</div>"

    def form():
        return f"<form{names('login', 'search', 'contact', 'newsletter', 'signup')}><label>{words(1, 3)}</label><input name=x>{r.choice(['', f'<p>{para()}</p>', f'<textarea>{sentence()}</textarea>', f'<select><option>{word()}</option></select>'])}<button>{words(1, 2)}</button></form>"

    def comments():
        each = lambda: r.choice([f"<p>{para()}</p>", f"<div{must('comment', 'reply')}><b>{word()}</b> says <p>{para()}</p></div>", f"<li><p>{para()}</p></li>", f"<article class='comment'><p>{para()}</p></article>", f"<div>{para()}</div>"])
        return f"<{(t := r.choice(['section', 'div', 'div', 'ol', 'ul', 'aside']))}{must('comments', 'comment-list', 'responses', 'discussion', 'disqus', 'replies', 'comment')}>{r.choice(['', f'<h3>{words(1, 2)}</h3>', '<h3>Comments</h3>'])}{''.join(each() for _ in range(r.randint(1, 4)))}</{t}>"

    def body():
        out = []
        if r.random() < 0.85:
            title = keep(words(3, 11).capitalize() + r.choice(["", "", ".", "&amp;"]))
            out.append(f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1{names('title', 'headline')}>{title}</h1></header>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 10, 18])):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p{names('text', 'lead', 'paragraph')}>{keep(rich(para()))}" + r.choice(["</p>", "</p>", "", "<br>"]))
            elif kind < 0.70:
                out.append(f"<h{(k := r.randint(2, 4))}>{keep(words(2, 7).capitalize())}</h{k}>")
            elif kind < 0.77:
                out.append("<ul>" + "".join(f"<li>{keep(rich(sentence()))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.81:
                out.append(f"<blockquote>{keep(para())}</blockquote>")
            elif kind < 0.84:
                out.append(f"<pre>{keep(words(3, 20))}</pre>")
            elif kind < 0.88:
                out.append("<table>" + "".join(f"<tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.92:
                out.append(f"<div>{keep(rich(para()))}</div>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>")
            elif kind < 0.97:
                out.append(ad())
            else:
                out.append(r.choice([notice, aside])())
        inside = "".join(out)
        return r.choice([f"<article{names('post', 'entry', 'story', 'article')}>{inside}</article>"] * 4 + [f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", f"<div{must('content', 'post', 'entry', 'article', 'story', 'body', 'text')}>{inside}</div>", f"<article><section>{inside}</section></article>", f"<section{must('content', 'post', 'article')}>{inside}</section>"])

    chance = lambda p, f: f() if r.random() < p else ""
    top = chance(0.3, notice) + chance(0.6, header) + chance(0.7, nav) + chance(0.3, ad) + chance(0.1, form)
    side = chance(0.3, aside)
    core = body()
    if r.random() < 0.3:
        core = f"<div{names('wrapper', 'container', 'page', 'row')}>{core}{chance(0.5, comments)}{chance(0.4, aside)}</div>"
    low = chance(0.3, ad) + chance(0.4, comments) + chance(0.3, aside) + chance(0.2, form) + chance(0.2, notice) + chance(0.85, footer)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{top}{side}{core}<!-- {word()} -->{low}</body></html>", main


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES) -> ChainCRF:
    found, labels = [], []
    for seed in range(pages):
        page, main = labelled_page(seed)
        blocks = leaf_blocks(page)
        todo, y = list(main), []
        for b in blocks:
            y.append(int(bool(todo) and b.text == todo[0]))
            if y[-1]:
                todo.pop(0)
        if blocks:
            found.append(_features(blocks))
            labels.append(y)
    return ChainCRF().fit(found, labels)


def main_text(page: str | None, model: ChainCRF) -> str:
    """The blocks that the field labels as main text, joined by two line feeds."""
    blocks = leaf_blocks(page or "", model.at)
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(_features(blocks))) if y)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``.

    The blocks that the field labels as main text, in page order, joined by two line
    feeds.  A null or empty page, or one without such a block, has the empty text.
    Repeated rows give repeated rows; null ids and urls stay null.
    """
    model = trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(W.tidy(run), "page_id long, url string, text string, n_chars long")
