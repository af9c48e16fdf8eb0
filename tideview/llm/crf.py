"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: the text between two block-level tags, with references
decoded and white space turned into single spaces. A block's features are its ancestors' tags, the
words of their class, id and role, and what its text looks like (length, share of links, punctuation, place
in the page, words of short blocks). The chain's two labels are main text and the rest; transitions
depend on whether two blocks have the same container. Weights maximise the conditional likelihood of labelled pages
(forward-backward, AdaGrad), and a page is decoded by Viterbi.

The labelled pages are of two kinds. At most ``max_train`` pages of the table (those with the smallest hash of their
id, of at most ``max_train_bytes``) that have an article element are labelled by it. As many pages are laid out anew from
their sentences, with containers, menus, sidebars, notices, forms, adverts and reader comments of many names, so that the model
doesn't rest on one layout. Extraction covers every page and its whole html.

Defined results: null and empty html give an empty text. Markup that isn't closed is closed where its
parent ends. A ``<`` that opens no tag is text. Repeated rows are extracted alike. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.common import by_batch

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,5000}+\"|'[^']{0,5000}+')*+)(?:>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z]+")
# Names of html elements.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr br img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea select iframe svg math object canvas audio video title".split())
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "pre section table ul".split()
)
_IN_HEAD = frozenset("base link meta script style title noscript template".split())

Block = tuple[str, tuple, int, int]  # text, stack of (tag, names, number), characters, of them in links


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...], int]] = [("html", (), 0)]
    pieces: list[str] = []
    state = {"link": 0, "linked": 0, "n": 0}

    def flush() -> None:
        text = "".join(pieces)
        pieces.clear()
        linked, state["linked"], state["link"] = state["linked"], 0, 0
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text and not any(s[0] == "head" for s in stack):
            out.append((text, tuple(stack), len(text), linked))

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if state["link"]:
                state["linked"] += len(text.strip())

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in _INLINE:
            if name == "a":
                state["link"] = 0 if closing else 1
            elif name in ("br", "img", "wbr") and name != "wbr":
                pieces.append(" ")
            continue
        if closing:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            if name == "title" or stack[-1][0] != "head":
                flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "template"):
                at = len(page)
            continue
        flush()
        if name in _VOID:
            continue
        if stack[-1][0] == "head" and name not in _IN_HEAD:
            stack.pop()
        ends = _CLOSES.get(name, set()) | ({"p"} if name in _CLOSE_P else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body") and name not in ("body",):
                break
        state["n"] += 1
        found = [n.lower() for a in _ATTRIBUTE.findall(tag[3]) for n in _NAME.findall(" ".join(a))] if tag[3] else []
        if name not in ("html",):
            stack.append((name, tuple(found), state["n"]))
    flush()
    return out


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def features(page: list[Block], log_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed places of each block's features; for each but the first, whether it shares its container with the one before."""
    mask, rows, same, last = (1 << log_features) - 1, [], [], None
    for i, (text, stack, chars, linked) in enumerate(page):
        words = text.split()
        f = {"bias", f"len{_bucket(len(words))}", f"link{(4 * linked + chars - 1) // max(1, chars)}", f"place{min(9, 10 * i // len(page))}"}
        f.add("first" if i == 0 else "last" if i == len(page) - 1 else "mid")
        f.add(f"end{text[-1] if text[-1] in '.!?:,' else 'x'}")
        f.add(f"stops{_bucket(text.count('.'))}")
        if "©" in text or "@" in text:
            f.add("sign")
        f.add("tag:" + stack[-1][0])
        for tag, names, _ in stack[1:]:
            f.add("in:" + tag)
            f.update("name:" + n for n in names)
        if stack[-1][1]:
            f.update("own:" + n for n in stack[-1][1])
        if len(words) <= 12:
            f.update("word:" + w.lower().strip(".,:;!?") for w in words)
        rows.append(np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) & mask for x in f), np.int64)))
        container = stack[-2][2] if len(stack) > 1 else -1
        same.append(int(container == last))
        last = container
    return rows, np.array(same, np.int64)


def _likelihood(emit: np.ndarray, same: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each block's label, and expected transitions (same container, from, to)."""
    n = len(emit)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = emit[0]
    for i in range(1, n):
        x = forward[i - 1][:, None] + moves[same[i]]
        top = x.max(axis=0)
        forward[i] = top + np.log(np.exp(x - top).sum(axis=0)) + emit[i]
    for i in range(n - 2, -1, -1):
        x = moves[same[i + 1]] + (emit[i + 1] + backward[i + 1])[None, :]
        top = x.max(axis=1)
        backward[i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
    total = np.logaddexp(*forward[-1])
    marginal = np.exp(forward + backward - total)
    expected = np.zeros((2, 2, 2))
    for i in range(1, n):
        x = forward[i - 1][:, None] + moves[same[i]] + (emit[i] + backward[i])[None, :]
        expected[same[i]] += np.exp(x - total)
    return marginal, expected


def viterbi(emit: np.ndarray, same: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest labels; of two equally likely, the rest wins over main text."""
    n = len(emit)
    best, back = emit[0], np.zeros((n, 2), np.int64)
    for i in range(1, n):
        x = best[:, None] + moves[same[i]]
        back[i] = x.argmax(axis=0)
        best = x.max(axis=0) + emit[i]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def fit(
    pages: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], log_features: int, passes: int = 12, rate: float = 0.3, decay: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (place, label) and transitions (same container, from, to) from (features, same, labels) of pages."""
    w, moves = np.zeros((1 << log_features, 2)), np.zeros((2, 2, 2))
    seen_w, seen_m = np.full(w.shape, 1e-2), np.full(moves.shape, 1e-2)
    order = np.random.default_rng(3)
    for _ in range(passes):
        for k in order.permutation(len(pages)):
            rows, same, labels = pages[k]
            if not rows:
                continue
            emit = np.stack([w[f].sum(axis=0) for f in rows])
            marginal, expected = _likelihood(emit, same, moves)
            actual = np.zeros((2, 2, 2))
            np.add.at(actual, (same[1:], labels[:-1], labels[1:]), 1)
            slope = np.eye(2)[labels] - marginal
            for f, g in zip(rows, slope):
                g = g - decay * w[f]
                seen_w[f] += g * g
                w[f] += rate * g / np.sqrt(seen_w[f])
            g = actual - expected - decay * moves
            seen_m += g * g
            moves += rate * g / np.sqrt(seen_m)
    return w, moves


# Names under which sites keep each part of a page; the generator draws from them.
_PARTS = {
    "main": "content post entry story article-body main-content text body-text post-content entry-content page-content prose",
    "menu": "nav menu navbar navigation topnav main-menu breadcrumbs breadcrumb toc tabs",
    "header": "header site-header masthead top banner-top branding logo tagline",
    "footer": "footer site-footer bottom copyright legal colophon",
    "side": "sidebar side aside widget related recommended popular trending rail right-column teaser more-stories",
    "notice": "cookie cookie-notice consent gdpr banner alert notice popup modal privacy-notice warning message subscribe-notice paywall",
    "advert": "ad ads advert advertisement sponsored promo sponsor banner-ad adsense promoted ad-slot",
    "form": "form search login newsletter signup subscribe contact-form search-box",
    "comments": "comments comment comment-list discussion replies reader-comments responses thread disqus respond reply",
    "share": "share social sharing tags meta byline author pagination pager",
}
_TAGS = {"menu": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form"]}
_SAYINGS = {
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept", "Please accept our terms.", "Breaking news alert"],
    "form": ["Search", "Your email", "Subscribe", "Log in", "Password", "Send"],
    "comments": ["Comments", "Leave a reply", "Reply", "3 comments", "Posted by a reader"],
    "share": ["Share", "Tweet", "Tags:", "By the editor", "Next page"],
    "footer": ["© all rights reserved", "Terms of use", "Privacy policy", "© example.com"],
    "advert": ["Advertisement", "Sponsored", "Buy now!"],
    "header": ["The daily page", "Welcome"],
    "side": ["Related", "Most read", "Popular stories"],
    "menu": ["Home", "About", "Contact", "News"],
}


def laid_out(sentences: list[str], draw: random.Random) -> list[tuple[str, tuple, int, int, int]]:
    """The blocks of a page of a random layout, each with its label.

    While the page is made, a private-use character before each text says which it is.
    """
    say = lambda: entities.escape(draw.choice(sentences), quote=False)
    mark = {0: "\ue000", 1: "\ue001"}

    def opened(part: str) -> tuple[str, str]:
        name = draw.choice(_PARTS[part].split())
        tags = _TAGS.get(part, [])
        tag = draw.choice([*tags, *tags, "div", "section"])
        as_attribute = draw.random() < (0.5 if tag in tags else 1.0)
        attribute = f' {draw.choice(["class", "class", "id"])}="{name}"' if as_attribute else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def lines(part: str) -> list[str]:
        few = draw.randint(1, 4)
        texts = [draw.choice(_SAYINGS[part]) if draw.random() < 0.4 else say() for _ in range(few)]
        if part in ("side", "comments", "notice", "advert", "footer") and draw.random() < 0.6:
            texts += [" ".join(say() for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 3))]
        return texts

    def rest(part: str) -> str:
        a, z = opened(part)
        if part == "menu" or draw.random() < 0.2:
            short = [" ".join(t.split()[: draw.randint(1, 3)]) for t in lines(part)]
            return a + "<ul>" + "".join(f'<li><a href="/x">{mark[0]}{t}</a></li>' for t in short) + "</ul>" + z
        tags = ["label", "button", "p"] if part == "form" else ["p", "p", "div", "h3", "span", "li"]
        tags = ["h1", "h1", "h2", "p", "div"] if part == "header" else tags
        inner = [draw.choice(tags) for _ in range(6)]
        texts = lines(part)
        if draw.random() < 0.3:
            return a + mark[0] + " ".join(texts) + z
        return a + "".join(f"<{inner[i % 6]}>{mark[0]}{t}</{inner[i % 6]}>" for i, t in enumerate(texts)) + z

    def article() -> str:
        tag = draw.choice(["article", "main", "div", "div", "section", ""])
        name = draw.choice(_PARTS["main"].split())
        title = f"<{(h := draw.choice(['h1', 'h1', 'h2']))}>{mark[1]}{say()}</{h}>" if draw.random() < 0.8 else ""
        body = []
        for _ in range(draw.randint(1, 10)):
            text = mark[1] + " ".join(say() for _ in range(draw.randint(1, 6)))
            kind = draw.random()
            if kind < 0.8:
                body.append(f"<p>{text}</p>")
            elif kind < 0.86:
                body.append(f"<h2>{mark[1]}{say()}</h2>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                body.append("<ul>" + "".join(f"<li>{mark[1]}{say()}</li>" for _ in range(3)) + "</ul>")
            else:
                body.append(f"<div>{text}</div>")
        for part in ("advert", "share", "side"):
            if draw.random() < 0.25:
                body.insert(draw.randint(0, len(body)), rest(part))
        inner = title + "".join(body)
        if not tag:
            return inner
        attribute = f' {draw.choice(["class", "id"])}="{name}"' if tag in ("div", "section") or draw.random() < 0.4 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    before = [rest(p) for p in ("header", "menu", "notice", "advert", "form", "side") if draw.random() < 0.45]
    after = [rest(p) for p in ("share", "comments", "side", "advert", "form", "notice", "menu", "footer") if draw.random() < 0.45]
    page = "".join(before) + article() + "".join(after)
    if draw.random() < 0.3:
        page = f'<div class="{draw.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
    return [(t.replace(mark[0], "").replace(mark[1], ""), s, n, k, int(mark[1] in t)) for t, s, n, k in blocks(f"<body>{page}</body>")]


def _by_article(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that has an article element."""
    outside = {"nav", "aside", "footer", "form", "header"}
    tags = [{s[0] for s in b[1]} for b in page]
    labels = np.array([int("article" in t and not t & outside) for t in tags])
    return labels if labels.any() else None


#: Words for layouts where the table has no page to take them from.
_FILLER = ["The river rose in the night.", "Nobody had seen it before.", "They went on, as the road was good.", "It was late."]


def train(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", max_train: int = 300, max_train_bytes: int = 50_000, log_features: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    picked = pages.select(F.col(page_id).cast("long").alias("id"), F.col(html).cast("string").alias("html"))
    picked = picked.where(F.octet_length("html").between(1, max_train_bytes)).select("*", F.xxhash64("html").alias("hash"))
    first = picked.select("id", "hash").orderBy(F.xxhash64("id", F.lit(5)), "id", "hash").limit(max_train)  # no html moves here
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    chosen = picked.join(F.broadcast(first.toDF("i", "h").distinct()), same, "left_semi").select("id", "html").distinct()
    taken = [blocks(r.html) for r in sorted(chosen.take(max_train), key=lambda r: (zlib.crc32(str(r.id).encode()), r.html))]
    data, sentences = [], []
    for page in taken:
        labels = _by_article(page)
        if labels is not None:
            data.append((*features(page, log_features), labels))
            sentences += [s.strip() for b, one in zip(page, labels) if one for s in re.split(r"(?<=[.!?])\s", b[0])[:4]]
    draw = random.Random(17)
    for _ in range(2 * max_train):
        laid = laid_out(sentences or _FILLER, draw)
        data.append((*features([b[:4] for b in laid], log_features), np.array([b[4] for b in laid], np.int64)))
    return fit(data, log_features)


def main_text(page: str | None, weights: np.ndarray, moves: np.ndarray) -> tuple[str, int]:
    """The main text of a page, and the number of its blocks."""
    found = blocks(page)
    if not found:
        return "", 0
    rows, same = features(found, int(len(weights)).bit_length() - 1)
    labels = viterbi(np.stack([weights[f].sum(axis=0) for f in rows]), same, moves)
    return " ".join(b[0] for b, one in zip(found, labels) if one), len(found)


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages``."""
    weights, moves = model or train(pages, page_id, html)
    sent = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float32), moves))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, m = sent.value
        found = [main_text(h, w, m) for h in batch.column(2).to_pylist()]
        text = pa.array([t for t, _ in found], pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), text, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_blocks"],
        )

    picked = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return picked.mapInArrow(by_batch(work), "page_id long, url string, text string, n_chars long, n_blocks long")
