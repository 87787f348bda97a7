"""Main text of pages by a recurrent block labeller: a bidirectional LSTM in numpy over the leaves of a page."""

from __future__ import annotations

import random
import zlib
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .html_blocks import Block, blocks

PATHS, WORDS = 1024, 512
PATH_SIZE, WORD_SIZE, SHAPE, HIDDEN = 24, 12, 8, 24
#: Training: pages made up for it, steps, pages a step; all bounds of the fitted model.
PAGES, STEPS, BATCH, SEED = 1600, 420, 24, 5
#: Blocks times pages that are labelled at once.
HELD = 1 << 15


class _Buckets(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        k = self[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return k


_path_bucket, _word_bucket = _Buckets(PATHS), _Buckets(WORDS)


def features(found: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets of the tag path and of all words of each block, and its shape: lengths, links, punctuation."""
    paths, words = [], []
    shape = np.empty((len(found), SHAPE), np.float32)
    n = len(found)
    for k, b in enumerate(found):
        paths.append(np.fromiter(map(_path_bucket.__getitem__, b.path or ("",)), np.int64))
        own = b.text.lower().split()
        words.append(np.fromiter(map(_word_bucket.__getitem__, own), np.int64, len(own)))
        t = b.text
        shape[k] = (np.log1p(len(own)) / 4, b.linked / len(t), t[-1] in ".!?…\"”»", min(1.0, (t.count(".") + t.count(",")) / len(own)), len(own) < 5, k == 0, k == n - 1, t[0].isupper())
    return paths, words, shape


def _mean_rows(table: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The mean of the table's rows that each list names."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    out = np.empty((len(lists), table.shape[1]), np.float32)
    step = 1 << 18
    ends = np.cumsum(sizes)
    first = 0
    while first < len(lists):
        base = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, base + step, "right")))
        if last == first + 1:
            out[first] = np.bincount(flat[base : ends[first]], minlength=len(table)).astype(np.float32) @ table / sizes[first]
        else:
            out[first:last] = np.add.reduceat(table[flat[base : ends[last - 1]]], ends[first:last] - sizes[first:last] - base, axis=0) / sizes[first:last, None]
        first = last
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, an LSTM in each direction and a logistic output; forward and backward passes in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + SHAPE
        small = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"path": small(PATHS, PATH_SIZE) * 2, "word": small(WORDS, WORD_SIZE)}
        for d in "fb":
            self.w |= {f"x{d}": small(size, 4 * HIDDEN), f"h{d}": small(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w |= {"out": small(2 * HIDDEN + size), "bias": np.zeros(1, np.float32)}

    def inputs(self, feats) -> np.ndarray:
        paths, words, shape = feats
        return np.concatenate([_mean_rows(self.w["path"], paths), _mean_rows(self.w["word"], words), shape], 1)

    def _pass(self, x, mask, d, keep=None):
        """x: steps, pages, size. Backward passes go through the steps from the last one; gaps leave the state as it is."""
        steps, pages, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h))
            h, c = h2, c2
            out[t] = h
        return out

    def logits(self, x, mask, keep=None):
        hf = self._pass(x, mask, "f", None if keep is None else keep["f"])
        hb = self._pass(x, mask, "b", None if keep is None else keep["b"])
        full = np.concatenate([hf, hb, x], 2)
        if keep is not None:
            keep["full"] = full
        return full @ self.w["out"] + self.w["bias"][0]

    def gradients(self, feats, x, mask, y, place):
        """Cross entropy over all blocks, and its gradient for each weight."""
        keep = {"f": [], "b": []}
        p = _sigmoid(self.logits(x, mask, keep))
        n = mask.sum()
        d = ((p - y) * mask / n).astype(np.float32)
        grad = {"out": np.einsum("tbk,tb->k", keep["full"], d), "bias": np.array([d.sum()], np.float32)}
        dfull = d[:, :, None] * self.w["out"]
        dx = dfull[:, :, 2 * HIDDEN :].copy()
        for k, name in enumerate("fb"):
            dh_out = dfull[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            wh, dwh = self.w[f"h{name}"], np.zeros_like(self.w[f"h{name}"])
            for t, i, f, o, g, c, tc, h in reversed(keep[name]):
                m = mask[t][:, None]
                total = dh + dh_out[t]
                inner = total * m
                dct = dc * m + inner * o * (1 - tc * tc)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), inner * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
                dpre[t] = dz
                dwh += h.T @ dz
                dh = dz @ wh.T + total * (1 - m)
                dc = dct * f + dc * (1 - m)
            grad |= {f"h{name}": dwh, f"x{name}": np.einsum("tbi,tbj->ij", x, dpre, optimize=True), f"c{name}": dpre.sum((0, 1))}
            dx += dpre @ self.w[f"x{name}"].T
        flat = dx[place]
        for name, lists, a, b in (("path", feats[0], 0, PATH_SIZE), ("word", feats[1], PATH_SIZE, PATH_SIZE + WORD_SIZE)):
            sizes = np.array([len(v) for v in lists])
            grad[name] = np.zeros_like(self.w[name])
            np.add.at(grad[name], np.concatenate(lists), np.repeat(flat[:, a:b] / sizes[:, None], sizes, 0))
        loss = -np.sum(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))) / n
        return float(loss), grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length go together."""
        out: list = [np.empty(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[take]]) <= HELD:
                take += 1
            group, order = order[:take], order[take:]
            feats = [features(pages[k]) for k in group]
            x, mask, _ = _stack([self.inputs(f) for f in feats])
            got = self.logits(x, mask) > 0
            for j, k in enumerate(group):
                out[k] = got[: len(pages[k]), j]
        return out


def _stack(inputs: list[np.ndarray]):
    steps = max(len(v) for v in inputs)
    x = np.zeros((steps, len(inputs), inputs[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(inputs)), np.float32)
    for j, v in enumerate(inputs):
        x[: len(v), j], mask[: len(v), j] = v, 1
    t = np.concatenate([np.arange(len(v)) for v in inputs])
    return x, mask, (t, np.repeat(np.arange(len(inputs)), [len(v) for v in inputs]))


#: Words that sites use in class names and texts of the parts of a page.
MAIN = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "blog", "news", "detail"]
BOILER = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "topbar", "links", "toc", "tabs"],
    "header": ["header", "masthead", "banner", "logo", "branding", "top", "site"],
    "footer": ["footer", "foot", "copyright", "bottom", "legal", "credits", "imprint", "colophon"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "more", "archive", "promo"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promotion", "adsense", "commercial", "banner"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "warning", "message", "paywall", "subscribe", "privacy"],
    "form": ["form", "newsletter", "signup", "login", "search", "subscribe", "contact", "register"],
    "comments": ["comment", "comments", "discussion", "replies", "reply", "respond", "disqus", "thread", "user", "reader"],
    "share": ["share", "social", "sharing", "follow", "buttons", "tools", "print"],
}
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Sport", "Start", "Products", "Blog", "Next", "Previous", "Sitemap", "Login"],
    "header": ["Welcome", "Daily news", "Menu", "Skip to content"],
    "footer": ["All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Impressum", "Copyright", "© 2020"],
    "aside": ["Related articles", "Popular posts", "Most read", "Tags", "Archive", "Read more"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Anzeige", "Publicité"],
    "notice": ["We use cookies", "Accept all", "Accept", "Your privacy", "Please enable JavaScript", "Subscribe to continue"],
    "form": ["Email address", "Sign up", "Subscribe", "Search", "Submit", "Your name", "Password", "Send"],
    "comments": ["Comments", "Leave a reply", "Reply", "Posted by", "Add comment", "Report", "says"],
    "share": ["Share", "Tweet", "Facebook", "Print this", "Email this"],
}


class _PageMaker:
    """Pages with known main text, of many builds, in made-up words."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = "abcdefghijklmnoprstuvwzéèüöñ"

    def word(self):
        return "".join(self.r.choices(self.letters, k=self.r.randint(1, 9)))

    def prose(self, low, high, end=None):
        words = [self.word() for _ in range(self.r.randint(low, high))]
        words[0] = words[0].capitalize()
        text = " ".join(w + ("," if self.r.random() < 0.06 else "." if self.r.random() < 0.04 else "") for w in words).rstrip(" ,.")
        return text + (self.r.choice([".", ".", ".", "!", "?"]) if (self.r.random() < 0.85 if end is None else end) else "")

    def cls(self, names):
        picked = self.r.sample(names, k=min(len(names), self.r.randint(1, 2)))
        name = self.r.choice(["-", "_", " "]).join(picked) if self.r.random() < 0.8 else picked[0] + "".join(p.capitalize() for p in picked[1:])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def noise(self):
        return f' class="{self.word()}"' if self.r.random() < 0.3 else ""

    def leaf(self, tag, text, y):
        self.blocks.append((text, y))
        if self.r.random() < 0.15:
            text = self.r.choice(["<b>{}</b>", "<em>{}</em>", "<b>{}", "<span>{}</span>", "{}<br>"]).format(text)
        return f"<{tag}{self.noise()}>{text}</{tag}>" if tag != "p" or self.r.random() < 0.9 else f"<p>{text}"

    def linked(self, text, y):
        self.blocks.append((text, y))
        return f'<li><a href="/x">{text}</a></li>'

    def boiler(self, kind):
        r = self.r
        names = BOILER[kind]
        phrase = lambda: r.choice(PHRASES[kind]) if r.random() < 0.5 else self.prose(1, 4, False)
        build = r.random()
        if kind in ("nav", "share", "aside") and build < 0.65:
            inner = "<ul>" + "".join(self.linked(phrase(), 0) for _ in range(r.randint(2, 7))) + "</ul>"
        elif kind == "comments":
            inner = self.leaf(r.choice(["h3", "h2", "p"]), phrase(), 0) if r.random() < 0.6 else ""
            for _ in range(r.randint(1, 4)):
                parts = (self.leaf("p", self.prose(1, 3, False), 0) if r.random() < 0.4 else "") + "".join(self.leaf("p", self.prose(4, 60), 0) for _ in range(r.randint(1, 2)))
                inner += f"<{'li' if build < .3 else 'div'}{self.cls(names) if r.random() < .6 else ''}>{parts}</{'li' if build < .3 else 'div'}>"
        elif kind == "form":
            inner = "<form>" + "".join(self.leaf(r.choice(["p", "div", "button"]), phrase() if r.random() < 0.7 else self.prose(3, 12), 0) for _ in range(r.randint(1, 3))) + '<input name="q"></form>'
        elif build < 0.45:
            text = phrase() if r.random() < 0.5 else self.prose(3, 40)
            self.blocks.append((text, 0))
            inner = text
        else:
            inner = "".join(self.leaf(r.choice(["p", "p", "div", "h3", "h4", "li"]), phrase() if r.random() < 0.5 else self.prose(3, 40), 0) for _ in range(r.randint(1, 4)))
        own = kind if kind in ("nav", "header", "footer", "aside") and r.random() < 0.6 else "form" if kind == "form" and r.random() < 0.3 else "div" if r.random() < 0.75 else "section"
        bare = own in ("nav", "footer", "aside", "header", "form") and r.random() < 0.6
        return f"<{own}{'' if bare else self.cls(names)}>{inner}</{own}>"

    def article(self):
        r = self.r
        inner = ""
        if r.random() < 0.85:
            head = self.leaf(r.choice(["h1", "h1", "h2"]), self.prose(2, 14), 1)
            inner += f"<header>{head}</header>" if r.random() < 0.1 else head
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            u = r.random()
            if u < 0.74:
                inner += self.leaf("p", self.prose(*r.choice([(1, 5), (4, 25), (20, 90)])), 1)
            elif u < 0.80:
                inner += self.leaf(r.choice(["h2", "h3"]), self.prose(1, 8, False), 1)
            elif u < 0.85:
                inner += "<ul>" + "".join(self.leaf("li", self.prose(1, 20), 1) for _ in range(r.randint(2, 5))) + "</ul>"
            elif u < 0.88:
                inner += f"<blockquote>{self.leaf('p', self.prose(5, 30), 1)}</blockquote>"
            elif u < 0.90:
                inner += "<table><tr>" + "".join(self.leaf("td", self.prose(1, 6, False), 1) for _ in range(r.randint(2, 4))) + "</tr></table>"
            elif u < 0.92:
                inner += self.leaf(r.choice(["pre", "figcaption", "div"]), self.prose(3, 20), 1)
            else:
                inner += self.boiler(r.choice(["ad", "ad", "aside", "share", "form", "notice"]))
        build = r.random()
        if build < 0.45:
            return f"<article{self.cls(MAIN) if r.random() < .3 else ''}>{inner}</article>"
        if build < 0.6:
            return f"<main>{inner}</main>"
        if build < 0.9:
            return f"<{'div' if build < .85 else 'section'}{self.cls(MAIN)}>{inner}</{'div' if build < .85 else 'section'}>"
        return f"<div{self.noise()}>{inner}</div>"

    def page(self):
        """(html, whether each block is main text)."""
        r = self.r
        self.blocks: list = []
        top = [k for k in ("notice", "header", "nav", "ad", "form") if r.random() < {"header": 0.5, "nav": 0.8, "ad": 0.45}.get(k, 0.25)]
        r.shuffle(top)
        end = [k for k in ("share", "comments", "aside", "ad", "form", "nav", "footer", "notice") if r.random() < {"footer": 0.8, "comments": 0.4, "aside": 0.35}.get(k, 0.15)]
        body = "".join(self.boiler(k) for k in top)
        if r.random() < 0.15:
            body += self.boiler("aside")
        main = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.2 and main:
            main = f"<div{self.cls(['wrapper', 'container', 'row', 'site', 'page', 'layout'])}>{main}{self.boiler('aside') if r.random() < .5 else ''}</div>"
        body += main + "".join(self.boiler(k) for k in end)
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def made_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of n made-up pages; pages whose blocks can't be told apart from their neighbours are left out."""
    maker, out = _PageMaker(seed), []
    while len(out) < n:
        page = maker.page()
        found = blocks(page)
        if found and len(found) == len(maker.blocks) and all(b.text == " ".join(t.split()) for b, (t, _) in zip(found, maker.blocks)):
            out.append((found, np.array([y for _, y in maker.blocks], np.float32)))
    return out


def train(pages: int = PAGES, steps: int = STEPS, seed: int = SEED) -> Labeller:
    """Fits the labeller by Adam to made-up pages: it sees no row of any table, and is the same in every run."""
    data = made_pages(pages, seed)
    model = Labeller(seed)
    prepared = [(features(found), y) for found, y in data]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    by_length = np.array(sorted(range(len(prepared)), key=lambda k: len(prepared[k][1])))
    for step in range(1, steps + 1):
        start = int(rng.integers(0, len(by_length) - BATCH + 1))
        rows = [prepared[k] for k in by_length[start : start + BATCH]]
        feats = ([p for f, _ in rows for p in f[0]], [w for f, _ in rows for w in f[1]])
        x, mask, place = _stack([model.inputs(f) for f, _ in rows])
        y = np.zeros_like(mask)
        y[place] = np.concatenate([v for _, v in rows])
        _, grad = model.gradients(feats, x, mask, y, place)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.01 * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


#: Weights that train() has fitted, kept beside this module; a change of the features, the pages or the fitting takes a new version.
WEIGHTS = "block_labeller_v1.npz"
_fitted: list[Labeller] = []


def labeller() -> Labeller:
    """The fitted labeller, read once a process; fitted anew where the package has no weights."""
    if not _fitted:
        kept = resources.files(__package__) / WEIGHTS
        model = Labeller(SEED) if kept.is_file() else train()
        if kept.is_file():
            with kept.open("rb") as f:
                model.w = dict(np.load(f))
        _fitted.append(model)
    return _fitted[0]


def main() -> None:
    """Fits the labeller and writes its weights: python -m mensura.llm.html_text"""
    with open(resources.files(__package__) / WEIGHTS, "wb") as f:
        np.savez_compressed(f, **train().w)


def main_text(found: list[Block], kept: np.ndarray) -> str:
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    text is the blocks labelled as main text, in page order, two line feeds between; nothing else is dropped
    or cut. A null or empty page, or one without main text, has the empty text. Null ids and urls
    are kept, repeated rows give a row each, other columns aren't read; no rows in, no rows out.
    """
    spark = pages.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model or labeller())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [blocks(h) for h in b.column(2).to_pylist()]
            texts = [main_text(f, k) for f, k in zip(found, shared.value.label(found))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return got.withColumnsRenamed({"id": id_col, "url": url_col})


if __name__ == "__main__":
    main()
