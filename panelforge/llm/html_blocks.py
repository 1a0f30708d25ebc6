"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of tags, classes and ids
above it. A block's vector hashes its path and its words and adds a few shapes (length, share of linked text, marks,
place). A bidirectional LSTM in numpy reads the page's whole sequence of vectors and gives each block a chance of being
main text, so a block is judged with all others in view. It is trained here, on pages that sample_page() makes from a
grammar of page parts whose labels are known; no page of the input is learned from, and the model's size is fixed.

Defined cases: a null or empty html gives an empty text, as does a page of which no block is main text; unclosed and
crossed tags are closed as browsers do for paragraphs and items, others by their parent's end; scripts and styles without
an end reach to the page's end; rows are kept one for one; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PATH_DIMS, WORD_DIMS, SHAPES = 96, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + SHAPES
HIDDEN = 16
#: Made pages to learn from, rounds over them, and the seed of both.
PAGES, ROUNDS, SEED = 240, 45, 7
#: Pages labelled at once.
LANES = 64

RESULT = "page_id long, url string, text string, n_chars long"

#: Tags that begin and end blocks, tags without content, and tags whose text isn't shown.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN_TEXT = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title")
#: A tag that opens while one of these is open ends it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Ends of open items don't reach beyond these.
SCOPES = frozenset("ul ol dl table body html article section div main aside nav".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.DOTALL)
MARKED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def read_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append(Block(path, text, linked))
        pieces, linked = [], 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            if not pieces:
                path = tuple(s for _, signs in stack for s in signs)
            piece = page[at:stop]
            pieces.append(piece)
            if any(n == "a" for n, _ in stack[-3:]):
                linked += len(piece)
        if not m:
            break
        at = max(m.end(), stop + 1)
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if name in HIDDEN_TEXT:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if name not in ("noscript", "object") or close:
                at = close.end() if close else end
            continue
        if name == "br":
            if pieces:
                pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
            closes = ENDS.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        signs = [name]
        for s in MARKED.findall(m[3]):
            signs += [f".{w}" for w in NAME.findall(s.lower())[:6]]
        stack.append((name, tuple(signs)))
    flush()
    return out


_slots: dict[str, tuple[int, float]] = {}


def slot(sign: str, dims: int) -> tuple[int, float]:
    """A sign's place in a hashed vector, and its direction."""
    got = _slots.get(sign)
    if got is None:
        if len(_slots) > 300_000:
            _slots.clear()
        h = zlib.crc32(sign.encode("utf-8", "replace"))
        got = _slots[sign] = (h % dims, 1.0 if h >> 16 & 1 else -1.0)
    return got


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block: hashed path, hashed words, shapes."""
    out = np.zeros((len(blocks), DIMS))
    for i, b in enumerate(blocks):
        row = out[i]
        for s in b.path:
            k, _ = slot("<" + s, PATH_DIMS)
            row[k] = 1.0
        if b.path:
            k, _ = slot("<<" + b.path[-1], PATH_DIMS)
            row[k] = 1.0
        words = b.text.split()
        for w in words:
            k, v = slot(w, WORD_DIMS)
            row[PATH_DIMS + k] += v
        seen = row[PATH_DIMS : PATH_DIMS + WORD_DIMS]
        seen *= 0.3 / max(1.0, float(np.sqrt(seen @ seen)))
        row[-SHAPES:] = min(1.15, np.log1p(len(words)) / 4), b.linked / max(1, len(b.text)), min(1.0, sum(b.text.count(c) for c in ".,;") / len(words)), i / len(blocks), 1.0 - i / len(blocks), 1.0
    return out


@dataclass
class Labeller:
    """Weights of a bidirectional LSTM and its read-out."""

    inward: list[np.ndarray] = field(default_factory=list)
    across: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    read: np.ndarray = field(default_factory=lambda: np.zeros(2 * HIDDEN + 1))

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        one = cls()
        for _ in range(2):
            one.inward.append(rng.normal(0, 0.15, (DIMS, 4 * HIDDEN)))
            one.across.append(rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)))
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1.0
            one.bias.append(b)
        one.read = rng.normal(0, 0.2, 2 * HIDDEN + 1)
        return one

    def weights(self) -> list[np.ndarray]:
        return [*self.inward, *self.across, *self.bias, self.read]

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """Chances (pages, blocks), and what the backward pass needs. x: pages, blocks, dims; live marks real blocks."""
        pages, length, _ = x.shape
        states, tapes = [], []
        for d in range(2):
            drive = x @ self.inward[d] + self.bias[d]
            h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
            hs, tape = np.zeros((pages, length, HIDDEN)), []
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                z = drive[:, t] + h @ self.across[d]
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                on = live[:, t, None]
                new = f * c + i * g
                squashed = np.tanh(new)
                tape.append((t, h, c, i, f, o, g, squashed, on))
                c = np.where(on, new, c)
                h = np.where(on, o * squashed, h)
                hs[:, t] = h
            states.append(hs)
            tapes.append(tape)
        both = np.concatenate([*states, np.ones((pages, length, 1))], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.read, -30, 30))), [both, tapes]

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over real blocks, in the order of weights()."""
        chance, (both, tapes) = self.forward(x, live)
        slope = np.where(live, chance - y, 0) / live.sum()
        read = np.einsum("pl,plh->h", slope, both)
        inward, across, bias = [], [], []
        for d in range(2):
            down = slope[..., None] * self.read[d * HIDDEN : (d + 1) * HIDDEN]
            drive = np.zeros((*slope.shape, 4 * HIDDEN))
            over = np.zeros_like(self.across[d])
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, squashed, on in reversed(tapes[d]):
                whole = dh + down[:, t]
                inner = np.where(on, whole, 0)
                cell = np.where(on, dc, 0) + inner * o * (1 - squashed**2)
                z = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), inner * squashed * o * (1 - o), cell * i * (1 - g**2)], axis=1)
                drive[:, t] = z
                over += h.T @ z
                dh = np.where(on, z @ self.across[d].T, whole)
                dc = np.where(on, cell * f, dc)
            inward.append(np.einsum("pld,plz->dz", x, drive, optimize=True))
            across.append(over)
            bias.append(drive.sum(axis=(0, 1)))
        return [*inward, *across, *bias, read]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max((len(p) for p in pages), default=0)
    x, live = np.zeros((len(pages), length, DIMS)), np.zeros((len(pages), length), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], live[i, : len(p)] = p, True
    return x, live


SYLLABLES = "the an re er in on ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def sample_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of the grammar: what stands around, before, in and after an article, and each block's label."""
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))) + rng.choice([".", ".", "", ","])
    parts: list[tuple[str, int]] = []

    def other(kinds: tuple[str, ...]) -> None:
        kind = rng.choice(kinds)
        if kind == "nav":
            box = rng.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', "<header><nav>{}</nav></header>", '<div id="nav">{}</div>', '<ul class="navigation">{}</ul>'])
            parts.append((box.format("<ul>" + "".join(f"<li><a href=x>{line(1, 3)}</a></li>" for _ in range(rng.randint(2, 8))) + "</ul>"), 0))
        elif kind == "header":
            parts.append((rng.choice(["<header><div>{}</div></header>", '<div class="header">{}</div>', '<div id="banner"><p>{}</p></div>']).format(line(1, 8)), 0))
        elif kind == "ad":
            parts.append((rng.choice(['<div class="ad">{}</div>', '<div class="ads"><p>{}</p></div>', '<div class="advert">{}</div>', '<aside class="promo"><p>{}</p></aside>', '<div class="sponsored">{}</div>', '<div class="banner">{}</div>', '<div class="ad-slot"><a href=x>{}</a></div>']).format(line(3, 25)), 0))
        elif kind == "aside":
            parts.append((rng.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related">{}</div>', '<section class="widget">{}</section>']).format("".join(rng.choice(["<p>{}</p>", "<h3>{}</h3>", "<li><a href=x>{}</a></li>"]).format(line(2, 20)) for _ in range(rng.randint(1, 4)))), 0))
        elif kind == "notice":
            parts.append((rng.choice(['<div class="cookie-notice">{}</div>', '<div class="notice"><p>{}</p></div>', '<div id="consent">{}</div>', '<div class="newsletter"><p>{}</p></div>', '<div role="alert">{}</div>']).format(line(4, 30)), 0))
        elif kind == "form":
            parts.append((f"<form><label>{line(1, 3)}</label><p>{line(1, 10)}</p><button>{line(1, 2)}</button></form>", 0))
        elif kind == "comments":
            box = rng.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="discussion">{}</div>'])
            parts.append((box.format(f"<h3>{line(1, 3)}</h3>" + "".join(rng.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p>{}</p>"]).format(line(4, 60)) for _ in range(rng.randint(1, 6)))), 0))
        elif kind == "share":
            parts.append((rng.choice(['<div class="share">{}</div>', '<ul class="social">{}</ul>', '<div class="tags">{}</div>']).format("".join(f"<a href=x>{word()}</a> " for _ in range(rng.randint(2, 5)))), 0))
        else:
            parts.append((rng.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>']).format("&copy; " + line(2, 20)), 0))

    for _ in range(rng.randint(0, 3)):
        other(("nav", "nav", "header", "notice", "ad", "form"))
    opened, closed = rng.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article">', "</div>"), ('<div class="post"><div class="entry">', "</div></div>"), ('<section class="story">', "</section>")])
    parts.append((opened, 2))
    for k in range(rng.randint(1, 14)):
        body = line(1, 12) if k == 0 else line(1, 90)
        shape = "<h1>{}</h1>" if k == 0 and rng.random() < 0.8 else rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}<br>", "<p>{} <a href=x>" + word() + "</a></p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figcaption>{}</figcaption>"])
        parts.append((shape.format(body), 1))
        if k and rng.random() < 0.06:
            other(("ad", "share", "aside", "notice"))
    if rng.random() < 0.12:
        other(("comments", "share", "form"))
    parts.append((closed, 2))
    for _ in range(rng.randint(0, 3)):
        other(("aside", "comments", "footer", "footer", "form", "share", "ad"))
    marked = "".join(p if kind == 2 else re.sub(r">([^<]+)", lambda m, k=kind: f">{chr(0xE000 + k)}{m[1]}", p) for p, kind in parts)
    blocks = read_blocks(f"<html><body>{marked}</body></html>")
    labels = [int("\ue001" in b.text) for b in blocks]
    return [Block(b.path, t, b.linked) for b in blocks if (t := b.text.replace("\ue000", "").replace("\ue001", ""))], labels


def train(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> Labeller:
    """Learn from made pages by Adam, in batches; the same arguments give the same weights."""
    rng = random.Random(seed)
    made = [sample_page(rng) for _ in range(pages)]
    made = sorted((m for m in made if m[0]), key=lambda m: len(m[0]))
    one = Labeller.fresh(seed)
    moment = [np.zeros_like(w) for w in one.weights()]
    square = [np.zeros_like(w) for w in one.weights()]
    batches = []
    for at in range(0, len(made), 40):
        part = made[at : at + 40]
        x, live = padded([vectors(b) for b, _ in part])
        y = np.zeros(live.shape)
        for i, (_, labels) in enumerate(part):
            y[i, : len(labels)] = labels
        batches.append((x, y, live))
    step = 0
    for r in range(rounds):
        rate = 0.02 * (0.5 if r > rounds * 0.6 else 1) * (0.4 if r > rounds * 0.85 else 1)
        for k in rng.sample(range(len(batches)), len(batches)):
            step += 1
            for w, g, m, s in zip(one.weights(), one.gradients(*batches[k]), moment, square, strict=True):
                g = g + 1e-4 * w
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return one


def label(pages: list[list[Block]], labeller: Labeller) -> list[np.ndarray]:
    """For each page the chance of each block to be main text."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        lanes = max(1, min(LANES, 20_000 // len(pages[order[-1]])))
        order, now = order[:-lanes], order[-lanes:]
        chance, _ = labeller.forward(*padded([vectors(pages[i]) for i in now]))
        for i, c in zip(now, chance, strict=True):
            out[i] = c[: len(pages[i])]
    return out


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    blocks = [read_blocks(p) for p in pages]
    return ["\n".join(b.text for b, c in zip(bs, cs, strict=True) if c >= 0.5) for bs, cs in zip(blocks, label(blocks, labeller), strict=True)]


def extracted(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars). The weights (about 90 kB) go to every task."""
    common.session_setup(pages.sparkSession)
    labeller = labeller or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(batch.column(2).to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(common.each(run), RESULT)
