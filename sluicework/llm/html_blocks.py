"""HTML to main text with a recurrent block labeller.

A page is cut into leaf blocks, each with the path of open tags (and their classes and ids). A bidirectional LSTM
in numpy reads, block after block, a hashed vector of the path, a hashed vector of all the block's words and a few
counts, and says of each block whether it belongs to the article. It is trained here, from layouts that a
generator writes with known labels; the model has a fixed size and is the same in every run.
"""

from __future__ import annotations

import functools
import hashlib
import html
import random
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.batches import cuts, handing_back
from sluicework.session import shared_dir, small_batches

PATH_DIMS, WORD_DIMS, COUNTS, HIDDEN = 192, 48, 5, 16
DIMS = PATH_DIMS + WORD_DIMS + COUNTS
PAGES, EPOCHS, RATE = 1800, 9, 0.01
#: Blocks that are labelled together, unless a single page has more.
TOGETHER = 16384
#: Bytes of pages that are read together.
SLICE = 1 << 20

# HTML's void, block, raw-text and implied-end elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body title p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th article section header footer nav aside main form fieldset legend blockquote pre figure figcaption address details summary hr button select option label dialog menu template noscript xmp".split())
RAW = frozenset("script style iframe noembed noframes".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul xmp".split())
SCOPES = frozenset("ul ol dl table div article section body td th main aside nav header footer form blockquote button".split())

#: A quote counts only after an equals sign and if it is closed; a tag that never ends goes to the end of the page.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(path, text, share of it in links) of each leaf block with text, in page order.

    Script and style text, comments and markup are left out. Character references are decoded; white space in a
    block becomes one space. Unclosed and stray tags are taken as browsers take them, roughly.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((" ".join(n for _, n in stack), joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text.append(page[at:stop])
            linked += (stop - at) * (links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            ended = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    close(k)
                elif stack[k][0] in SCOPES:
                    break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            named = [w for a in _NAME.findall(m[3]) for w in _PART.findall("".join(a).lower())]
            stack.append((tag, " ".join([f"<{tag}", *named, *(["hidden"] if _HIDDEN.search(m[3]) else [])])))
            links += tag == "a"
    flush()
    return out


@functools.lru_cache(maxsize=1 << 14)
def _path_vector(path: str) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for w in set(path.split()):
        h = zlib.crc32(w.encode())
        for k in (h, h * 2654435761 >> 13, h * 40503 >> 5):  # three places each, so that few tokens share all
            v[k % PATH_DIMS] += 1 if k >> 20 & 1 else -1
    return v


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def features(found: list[tuple[str, str, float]]) -> np.ndarray:
    """One row for each block."""
    n = len(found)
    out = np.zeros((n, DIMS), np.float32)
    if not n:
        return out
    for k, (path, _, _) in enumerate(found):
        out[k, :PATH_DIMS] = _path_vector(path)
    raw = np.frombuffer(("\n".join(t.replace("\n", " ") for _, t, _ in found) + "\n").lower().encode("utf-8", "surrogatepass"), np.uint8)
    space = (raw == 32) | (raw == 10)
    start = ~space & np.concatenate(([True], space[:-1]))
    line = np.cumsum(raw == 10) - (raw == 10)
    at = np.flatnonzero(start)
    word = np.cumsum(start) - 1
    place = np.minimum(np.arange(len(raw)) - at[np.maximum(word, 0)], 63)
    value = np.where(space, np.uint64(0), raw.astype(np.uint64) * _POWERS[place])
    hashes = np.add.reduceat(value, at)
    bucket = ((hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % WORD_DIMS
    words = np.bincount(line[at] * WORD_DIMS + bucket, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    total = words.sum(axis=1, keepdims=True)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = words / np.maximum(np.sqrt((words.astype(float) ** 2).sum(axis=1, keepdims=True)), 1) / 2
    out[:, -5] = np.log1p(total[:, 0]) / 4
    out[:, -4] = [x for _, _, x in found]
    out[:, -3] = [("." in t[-2:]) for _, t, _ in found]
    out[:, -2] = np.arange(n) / max(1, n - 1)
    out[:, -1] = 1 / n
    return out


# ---- the network -------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(given: np.ndarray, mask: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T x B x H) of one direction, from what the input gives to each step's gates; what training needs of each step if ``keep``."""
    steps, rows = given.shape[:2]
    h, c, out, kept = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        z = given[t] + h @ wh
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before_h, before_c, m = h, c, mask[t][:, None]
        c = m * (f * c + i * u) + (1 - m) * c
        tc = np.tanh(c)
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
        if keep:
            kept.append((before_h, before_c, i, f, o, u, tc, m))
    return out, kept


def _backward(x: np.ndarray, dout: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz_all, dwh = np.empty((len(kept), dout.shape[1], 4 * HIDDEN), np.float32), np.zeros_like(wh)
    for t in range(len(kept) - 1, -1, -1):
        before_h, before_c, i, f, o, u, tc, m = kept[t]
        dh = dh + dout[t]
        own = dh * m
        do = own * tc
        dcc = own * o * (1 - tc * tc) + dc * m
        dz = np.concatenate([dcc * u * i * (1 - i), dcc * before_c * f * (1 - f), do * o * (1 - o), dcc * i * (1 - u * u)], axis=1)
        dz_all[t] = dz
        dwh += before_h.T @ dz
        dh = dz @ wh.T + dh * (1 - m)
        dc = dcc * f + dc * (1 - m)
    return np.tensordot(x, dz_all, ([0, 1], [0, 1])), dwh, dz_all.sum(axis=(0, 1))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _states(given: np.ndarray, mask: np.ndarray, model: list[np.ndarray], keep: bool = False) -> tuple:
    """Hidden states of both directions, from what is given to the gates of both."""
    left, kept_left = _forward(given[:, :, : 4 * HIDDEN], mask, model[1], keep)
    right, kept_right = _forward(given[::-1, :, 4 * HIDDEN :], mask[::-1], model[4], keep)
    return np.concatenate([left, right[::-1]], axis=2), kept_left, kept_right


def _given(x: np.ndarray, model: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x @ model[0] + model[2], x @ model[3] + model[5]], axis=-1)


def label(pages: list[np.ndarray], model: list[np.ndarray]) -> list[np.ndarray]:
    """For each page's blocks, from what is given to the gates, the chance that each belongs to the article."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(pages[order[n]]) <= TOGETHER:
            n += 1
        own, order = order[:n], order[n:]
        h, _, _ = _states(*_padded([pages[k] for k in own]), model)
        p = _sigmoid(h @ model[6] + model[7])[:, :, 0]
        for j, k in enumerate(own):
            out[k] = p[: len(pages[k]), j]
    return out


def fit(pages: list[np.ndarray], truth: list[np.ndarray], epochs: int = EPOCHS) -> list[np.ndarray]:
    rng = np.random.default_rng(9)
    model = [(rng.normal(0, 0.5 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in _shapes()]
    for b in (model[2], model[5]):
        b[HIDDEN : 2 * HIDDEN] = 1
    first, second, step = [np.zeros_like(w) for w in model], [np.zeros_like(w) for w in model], 0
    alike = np.argsort([len(p) for p in pages], kind="stable")  # pages of about one length train together
    for epoch in range(epochs):
        for k in rng.permutation(range(0, len(pages), 32)).tolist():
            own = alike[k : k + 32]
            x, mask = _padded([pages[i] for i in own])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(own):
                y[: len(truth[i]), j] = truth[i]
            h, kept_left, kept_right = _states(_given(x, model), mask, model, True)
            d = ((_sigmoid(h @ model[6] + model[7])[:, :, 0] - y) * mask / mask.sum())[:, :, None]
            dh = d @ model[6].T
            grads = [*_backward(x, dh[:, :, :HIDDEN], kept_left, model[1]), *_backward(x[::-1], dh[::-1, :, HIDDEN:], kept_right, model[4]), np.tensordot(h, d, ([0, 1], [0, 1])), d.sum(axis=(0, 1))]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for w, g, a, b in zip(model, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---- layouts with known labels -----------------------------------------------------------------------------------

# Names and phrases that pages use for what surrounds an article.
AROUND = {
    "nav": (["nav", "div class=menu", "div id=navigation", "ul class=nav-menu", "div class=navbar", "nav class=breadcrumbs", "div role=navigation", "div class=pagination"], "Home About Contact News Sport World Login Menu Search Topics Archive Next Previous".split()),
    "header": (["header", "div class=site-header", "div id=header", "header class=masthead", "div class=top-bar", "div role=banner", "div id=masthead"], ["Sign in", "Subscribe", "The Daily", "Search", "Menu", "Language", "My account"]),
    "footer": (["footer", "div class=footer", "div id=site-footer", "div class=copyright", "div role=contentinfo", "div class=legal"], ["© 2024", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Contact us"]),
    "side": (["aside", "div class=sidebar", "div id=secondary", "div class=related", "section class=related-posts", "aside class=widget", "div class=trending", "div class=recommended", "div role=complementary", "div class=author-bio", "div class=tags", "section class=most-read"], ["Related articles", "Most read", "Trending now", "More from us", "Follow us", "Tags", "Read more"]),
    "notice": (["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div role=alert", "div class=gdpr-consent", "div class=alert", "dialog", "div class=modal", "div class=popup", "section class=disclaimer", "div class=paywall", "p class=notice"], ["We use cookies", "Accept all", "This site uses cookies to improve your experience", "Notice:", "Your browser is not supported", "Consent"]),
    "ad": (["div class=ad", "div class=advert", "div id=ads", "div class=ad-slot", "aside class=advertisement", "div class=sponsored", "div class=promo", "section class=banner-ad", "ins class=adsbygoogle", "div class=sponsor", "div class=promotion"], ["Advertisement", "Sponsored", "Buy now", "Special offer", "Promoted content"]),
    "form": (["form", "form class=newsletter", "div class=newsletter-signup", "form id=search", "form class=comment-form", "div class=login-box", "div class=subscribe"], ["Your e-mail", "Subscribe", "Send", "Name", "Password", "Search", "Sign up for our newsletter"]),
    "comments": (["div class=comments", "section id=comments", "ol class=comment-list", "div class=comment", "div id=disqus-thread", "div class=responses", "section class=reader-comments", "div class=replies", "article class=comment", "div class=discussion", "section class=user-comments"], ["Comments", "Reply", "says:", "Report", "I agree with this", "Log in to comment"]),
    "share": (["div class=share", "div class=social", "ul class=share-buttons", "div class=social-links"], ["Share", "Tweet", "Facebook", "Print", "E-mail this"]),
}
MAIN = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "section class=article-body", "div class=story", "div role=main", "div class=article", "div id=main", "section", "div class=text"]
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu eau ment sch ung ción que é ü ñ ж а к о н 的 是 在".split()


def _prose(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(max(1, words))]
    return " ".join(w + rng.choice(["", "", "", "", "", ",", "."]) for w in out).capitalize() + rng.choice([".", ".", ".", "", "!!", "***", "…"])


def _open(spec: str) -> tuple[str, str]:
    tag, _, rest = spec.partition(" ")
    key, _, value = rest.partition("=")
    return f'<{tag} {key}="{value}">' if rest else f"<{tag}>", f"</{tag}>"


def layout(rng: random.Random) -> tuple[str, list[bool]]:
    """A page, and for each of its blocks whether it belongs to the article. Article text begins with 'Α', which the labeller does not see."""
    def surrounding(kind: str) -> str:
        specs, phrases = AROUND[kind]
        a, b = _open(rng.choice(specs))
        say = lambda: rng.choice([rng.choice(phrases), rng.choice(phrases), _prose(rng, rng.randint(1, 12)), _prose(rng, rng.choice([20, 60]))])
        form = rng.random()
        if kind in ("nav", "share") or form < 0.15:
            items = "".join(f'<li><a href="/x">{say() if rng.random() < 0.3 else _prose(rng, 1)}</a></li>' for _ in range(rng.randint(2, 8)))
            inner = items if a.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>"
        elif form < 0.45:
            inner = say()
        else:
            inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h3>{}</h3>", "<span>{}</span> ", '<a href="#">{}</a>', "<div>{}<div>{}</div>{}</div>"]).format(say(), say(), say()) for _ in range(rng.randint(1, 5)))
        if kind == "form":
            inner = "<label>" + say() + "</label><input name=q>" + inner + "<button>" + rng.choice(phrases) + "</button>"
        if kind == "comments":
            inner = "<h3>" + rng.choice(phrases) + "</h3>" + "".join(f'<div class="{rng.choice(["comment", "comment-body", "reply"])}"><p>{_prose(rng, rng.randint(3, 60))}</p></div>' for _ in range(rng.randint(1, 6))) + inner
        return f"{a}{inner}{b}"

    def body() -> list[str]:
        parts = []
        title = "Α" + _prose(rng, rng.randint(1, 12))
        head = rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h1 class=title>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", ""])
        parts.append(head.format(title))
        bare = rng.random() < 0.3
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            t = "Α" + _prose(rng, rng.choice([1, 1, 2, 5, 20, 40, 80, 150]))
            if bare and rng.random() < 0.4:
                parts.append(f"<p><b>{t}<br>")
                continue
            if rng.random() < 0.15:  # text beside blocks
                more = ["Α" + _prose(rng, rng.choice([1, 3, 15, 60])) for _ in range(2)]
                parts.append(rng.choice(["<div>{}<div>{}</div>{}</div>", "{}<p>{}</p>{}", "<section>{}<p>{}</p>{}</section>", "<div><div>{}</div>{}<p>{}</p></div>", "<blockquote>{}<p>{}</p>{}</blockquote>", "<div>{}<ul><li>{}</li></ul>{}</div>"]).format(t, *more))
                continue
            parts.append(rng.choice(["<p>{}</p>"] * 6 + ["<xmp>{}</xmp>", "<template><p>{}</p></template>", "<object>{}</object><br>", "<p><math>{}</math></p>","<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", '<p><a href="/y">{}</a></p>']).format(t))
        if parts == [""]:
            parts.append("<p>Α" + _prose(rng, 30) + "</p>")
        if rng.random() < 0.4:  # inside the article's element, but not of it
            parts.insert(rng.randint(1, len(parts)), surrounding(rng.choice(["ad", "side", "notice", "form", "share", "ad"])))
        if rng.random() < 0.15:
            parts.append(surrounding("comments"))
        return parts

    a, b = _open(rng.choice([MAIN[0]] * 6 + MAIN))
    before = [surrounding(k) for k in rng.sample(["nav", "header", "notice", "ad", "form", "side"], rng.randint(0, 4))]
    after = [surrounding(k) for k in rng.sample(["comments", "side", "ad", "form", "share", "notice", "nav"], rng.randint(0, 4))]
    if rng.random() < 0.8:
        after.append(surrounding("footer"))
    wrap = rng.choice(["{}", "{}", "<div class=wrapper>{}</div>", "<div id=page><div class=container>{}</div></div>", "<main>{}</main>"])
    page = f"<html><head><title>{_prose(rng, 6)}</title></head><body>{''.join(before)}{wrap.format(a + ''.join(body()) + b)}{''.join(after)}</body></html>"
    return page, [t.startswith("Α") for _, t, _ in blocks(page)]


@functools.lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, ...]:
    """The model; a few seconds in one process, with the same result each time."""
    rng = random.Random(99)
    pages, truth = [], []
    for _ in range(PAGES):
        page, y = layout(rng)
        pages.append(features([(p, t.removeprefix("Α"), s) for p, t, s in blocks(page)]))
        truth.append(np.array(y, np.float32))
    return tuple(fit(pages, truth))


def _shapes() -> list[tuple[int, ...]]:
    return [(DIMS, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (4 * HIDDEN,)] * 2 + [(2 * HIDDEN, 1), (1,)]


def stored(spark: SparkSession) -> tuple[np.ndarray, ...]:
    """The model from the shared folder; where it isn't there yet it is trained and put there, so that later sessions read it.

    The folder's name has a digest of this file, which is all that the model comes from.
    """
    path = f"{shared_dir(spark)}/sluicework/html-labeller-{hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]}"
    try:
        rows = spark.read.parquet(path).orderBy("at").collect()  # one row for each of the model's eight arrays
        return tuple(np.frombuffer(r["weights"], np.float32).reshape(s) for r, s in zip(rows, _shapes(), strict=True))
    except (AnalysisException, ValueError):  # not there, or not yet whole
        model = trained()
    made = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(model)], "at int, weights binary")
    made.coalesce(1).write.mode("overwrite").parquet(path)
    return model


def texts(pages: list[str], model: tuple[np.ndarray, ...]) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    every = [b for f in found for b in f]
    sizes = np.array([len(f) for f in found])
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    given = [np.empty((0, 8 * HIDDEN), np.float32)]
    for k in range(0, len(every), 4096):  # features are wide, so only a few blocks' at once
        x = features(every[k : k + 4096])
        x[:, -2], x[:, -1] = (place / np.maximum(size - 1, 1))[k : k + 4096], (1 / size)[k : k + 4096]
        given.append(_given(x, list(model)))
    own = np.split(np.concatenate(given), np.cumsum(sizes)[:-1]) if len(sizes) else []
    return ["\n".join(t for (_, t, _), p in zip(f, chance, strict=True) if p >= 0.5) for f, chance in zip(found, label(own, list(model)), strict=True)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or blank page, or one without an article, has an empty text. Null ids and urls and repeated rows stay.
    Very long pages are read whole: pages are taken by ``SLICE`` bytes, and of one page about 700 bytes a block are held
    at once. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    model = stored(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(2), SLICE):
                part = batch.slice(a, b - a)
                out = texts([x.as_py() or "" for x in part.column(2)], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(handing_back(run), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
