"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: maximal stretches of text between tags of block elements, each with the elements open
around it.  A block's features are its ancestors' tags and the words of their class, id and role, the innermost
element, and its text (length, share of link text, sentence ends, symbols).  A two-label chain (main text or not) is
trained on labelled pages by maximum likelihood (forward-backward, Adam) and decoded by Viterbi.

Labelled pages are of two kinds: pages whose main text is known (rows of ``labelled``) and the hand-labelled layouts
below, filled with invented words, which show elements that a given crawl may not hold.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import map_arrow

MAX_PAGES = 300  #: labelled pages trained on, besides the layouts
MAX_BLOCKS = 120  #: blocks of a page that is trained on
LAYOUT_COPIES = 12  #: fillings of each layout

#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template)\b.*?(?:</(?P=raw)\s*>|\Z)|<[/a-z!?](?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>?|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)(.*)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。][\"')\]]*$")

#: Hand-labelled layouts: each line is a block's path of elements (tag, then .words of its class), its label (1: main text), how
#: often it stands there and about how many words it has; "link" marks text inside links.
LAYOUTS = (
    ("header.site-header h1|0|1|3", "header nav ul li|0|6|1|link", "main article h1|1|1|8", "main article p|1|8|40", "main article blockquote p|1|1|30",
     "main article aside.related ul li|0|4|6|link", "main section.comments h2|0|1|2", "main section.comments div.comment p|0|5|20", "footer.site-footer p|0|2|8"),
    ("div.cookie-notice p|0|1|20", "div.cookie-banner button|0|2|1", "div.header div.logo|0|1|2", "div.menu ul li|0|8|1|link", "div.content div.post h2|1|1|7",
     "div.content div.post p|1|10|50", "div.content div.post ul li|1|4|12", "div.content div.share a|0|4|1|link", "div.content div.comments ul li p|0|6|15",
     "div.sidebar div.widget ul li|0|6|4|link", "div.sidebar div.widget p|0|2|12", "div.footer|0|1|12"),
    ("nav.navbar ul li|0|7|1|link", "div.ad|0|1|10", "div.article-body h1|1|1|9", "div.article-body p|1|6|60", "div.article-body div.advert p|0|1|12",
     "div.article-body p|1|5|45", "div.article-body table tr td|1|6|4", "div.newsletter form label|0|2|4", "div.newsletter form p|0|1|12", "footer ul li|0|5|2|link"),
    ("header p|0|1|6", "nav a|0|5|1|link", "aside.sidebar h3|0|1|2", "aside.sidebar p|0|3|15", "article header h1|1|1|8", "article p|1|7|55", "article pre|1|1|25",
     "article h2|1|1|5", "article p|1|4|45", "article form label|0|3|2", "article footer.share p|0|1|6", "section#comments article.comment p|0|4|25", "footer p|0|1|10"),
    ("div.alert.notice p|0|1|15", "div.breadcrumb a|0|3|1|link", "main h1|1|1|7", "main p|1|9|50", "main figure figcaption|1|1|9", "main div.promo p|0|1|10",
     "main div.reply p|0|2|18", "main form.search label|0|1|2", "div.advertisement p|0|1|9", "div.banner|0|1|7", "footer small|0|1|8"),
    ("nav ul li|0|6|1|link", "div.ad|0|1|14", "article h1|1|1|9", "article p|1|12|45", "article div.ads|0|1|12", "article section.comments p|0|4|22",
     "article aside p|0|2|15", "article nav ul li|0|4|2|link", "footer|0|1|12"),
)


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: float  #: share of the text inside links


def _element(tag: str, rest: str) -> str:
    """An open element as its tag and the words of its class, id and role."""
    words = [tag]
    for m in _ATTRIBUTE.finditer(rest):
        words += [f".{w}" for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())]
    return " ".join(dict.fromkeys(words))


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; character references decoded, white space turned into single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, element)
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            if not parts and not token.isspace():
                path = tuple(e for _, e in stack)
            if parts or not token.isspace():
                parts.append(token)
                if any(t == "a" for t, _ in stack):
                    linked += len(token.strip())
            continue
        found = _TAG.match(token)
        if found is None or m["raw"]:
            continue
        closing, tag = found[1], found[2].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
        elif tag not in VOID and not token.endswith("/>"):
            if tag not in INLINE:
                # a block element ends an open paragraph, a list item or table cell its like
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSED_BY_BLOCK or (tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[i][0] == tag):
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            stack.append((tag, _element(tag, found[3]) if "=" in found[3] else tag))
    flush()
    return out


def _path_features(path: tuple[str, ...]) -> list[str]:
    """Features of the elements around a block."""
    out = {f"in {word}" for element in path for word in element.split()}
    blocks = [e for e in path if e.split()[0] not in INLINE]
    if blocks:
        out.add(f"leaf {blocks[-1].split()[0]}")
    return sorted(out)


def _text_features(block: Block) -> list[str]:
    """Features of a block's text."""
    n = len(block.text)
    out = ["any", f"length {min(n.bit_length(), 11)}", f"links {int(block.linked * 3)}"]
    if _SENTENCE.search(block.text):
        out.append("sentence")
    if block.text[0] in "©|»›":
        out.append("symbol")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    return [_path_features(b.path) + _text_features(b) for b in blocks]


@dataclass
class ChainModel:
    """Weights of a two-label chain: (features, 2) emissions, (2, 2) transitions, (2,) start."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def labels(self, scores: np.ndarray) -> list[int]:
        """The best label sequence (Viterbi) for emission scores (n, 2)."""
        (a0, a1), (m00, m01), (m10, m11) = (self.start + scores[0]).tolist(), *self.move.tolist()
        back = []
        for e0, e1 in scores[1:].tolist():
            from0, from1 = a0 + m00 >= a1 + m10, a0 + m01 >= a1 + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a0, a1 = (a0 + m00 if from0 else a1 + m10) + e0, (a0 + m01 if from1 else a1 + m11) + e1
        label = 0 if a0 >= a1 else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train_chain(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 150, rate: float = 0.1, decay: float = 1e-3) -> ChainModel:
    """Maximum likelihood for (features of each block, label of each block) per page, by forward-backward and Adam."""
    pages = [p for p in pages if p[0]]
    index = {f: i for i, f in enumerate(sorted({f for page, _ in pages for block in page for f in block}))}
    if not pages:
        return ChainModel(index, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2))
    longest = max(len(p) for p, _ in pages)
    x = np.zeros((sum(len(p) for p, _ in pages), len(index)))
    gold = np.zeros((len(pages), longest, 2))
    there = np.zeros((len(pages), longest), dtype=bool)
    row = 0
    for r, (blocks, labels) in enumerate(pages):
        for t, (names, label) in enumerate(zip(blocks, labels)):
            x[row, [index[f] for f in names]] = 1
            row += 1
            gold[r, t, label] = 1
            there[r, t] = True
    w = np.zeros(len(index) * 2 + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        emit, move, start = w[:-6].reshape(-1, 2), w[-6:-2].reshape(2, 2), w[-2:]
        e = np.zeros_like(gold)
        e[there] = x @ emit
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(there[:, t, None], np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + e[:, t], forward[:, t - 1])
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            after = backward[:, t + 1] + e[:, t + 1]
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:]), backward[:, t + 1])
        p = np.where(there[:, :, None], np.exp(forward + backward - z[:, None, None]), 0)
        pair = np.exp(forward[:, :-1, :, None] + move + (e + backward)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        seen = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
        grad = np.concatenate([(x.T @ (p - gold)[there]).ravel(), (pair.sum(axis=(0, 1)) - seen).ravel(), (p[:, 0] - gold[:, 0]).sum(axis=0)]) / len(pages)
        grad += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ChainModel(index, w[:-6].reshape(-1, 2), w[-6:-2].reshape(2, 2), w[-2:])


def layout_pages(seed: int = 5) -> list[tuple[str, list[int]]]:
    """The hand-labelled layouts filled with invented words: (page, label of each block)."""
    rng = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vor", "el", "ni", "du", "sha", "por", "ec"]
    pages = []
    for layout in LAYOUTS:
        for _ in range(LAYOUT_COPIES):
            body, labels = [], []
            for line in layout:
                path, label, times, words, *kind = line.split("|")
                for _ in range(max(1, int(rng.poisson(int(times))))):
                    n = max(1, int(rng.poisson(int(words) * rng.choice([0.4, 1, 2]))))
                    text = " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)) + ("." if n > 4 else "")
                    text = f'<a href="#">{text}</a>' if kind else text
                    for element in reversed(path.split(" ")):
                        tag, *names = re.split(r"[.#]", element)
                        text = f'<{tag} class="{" ".join(names)}">{text}</{tag}>' if names else f"<{tag}>{text}</{tag}>"
                    body.append(text)
                    labels.append(int(label))
            pages.append((f"<html><head><title>{labels[0]}</title></head><body>{''.join(body)}</body></html>", [0, *labels]))
    return pages


def label_blocks(page: str, main: str) -> list[int] | None:
    """Labels of a page's blocks from its known main text: blocks that are a line of it, and headings that begin it, are main
    text, but for those in the page's head.  None when no block matches, so the text is of another page."""
    lines = {" ".join(line.split()) for line in main.split("\n")} - {""}
    head = " ".join(main.split())
    blocks = leaf_blocks(page)
    def is_main(block: Block) -> bool:
        tags = {e.split()[0] for e in block.path}
        return "head" not in tags and (block.text in lines or (bool(tags & {"h1", "h2"}) and head.startswith(block.text[:40])))

    labels = [int(is_main(b)) for b in blocks]
    return labels if any(labels) else None


def fit_html(labelled: DataFrame, page_id: str = "page_id", html_col: str = "html", main_col: str = "main") -> ChainModel:
    """Train on at most ``MAX_PAGES`` labelled pages (by least hash of the id, so reruns agree) and on the layouts."""
    rows = (labelled.filter(F.col(html_col).isNotNull() & F.col(main_col).isNotNull()).orderBy(F.xxhash64(page_id, F.lit("html")), page_id)
            .limit(MAX_PAGES).select(html_col, main_col).collect())
    pages = [(features(leaf_blocks(page)), labels) for page, main in rows if (labels := label_blocks(page, main))]
    pages += [(features(leaf_blocks(page)), labels) for page, labels in layout_pages()]
    return train_chain([p for p in pages if len(p[0]) <= MAX_BLOCKS])


def extract_main(pages: DataFrame, model: ChainModel, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text, its blocks in page order joined by one line feed; empty if there is none.

    A null page counts as empty.  A column named ``out`` is replaced; all others are kept.
    """
    kept = [c for c in pages.columns if c != out]
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit("")).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around: dict[tuple[str, ...], np.ndarray] = {}  # emission scores of the paths seen
        weights = {f: model.emit[i] for f, i in model.index.items()}
        none = np.zeros(2)

        def text_of(page: str) -> str:
            blocks = leaf_blocks(page)
            if not blocks:
                return ""
            scores = np.zeros((len(blocks), 2))
            for t, b in enumerate(blocks):
                score = around.get(b.path)
                if score is None:
                    if len(around) > 100_000:
                        around.clear()
                    score = around[b.path] = sum((weights.get(f, none) for f in _path_features(b.path)), none)
                scores[t] = score + sum(weights.get(f, none) for f in _text_features(b))
            return "\n".join(b.text for b, y in zip(blocks, model.labels(scores)) if y)

        for batch in batches:
            texts = [text_of(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])
    return map_arrow(pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("__html")), job, schema)
