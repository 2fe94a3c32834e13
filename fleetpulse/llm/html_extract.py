"""Main-text extraction with a recurrent block labeller.

A page is a sequence of leaf blocks (see ``html_blocks``).  A bidirectional
LSTM in numpy reads the sequence and labels every block as main text or not,
with the context of the whole page in both directions.  A block's input is the
sum of learned vectors for its tag path (each open element and each word of
its class, id and role, hashed; the two innermost once more), a hashed-word
vector of its text, and a few measures (length, link share, place).

The network is trained on the driver on a bounded sample of ``train_pages``
pages, drawn by a hash of the id.  Labels come from the pages' own markup:
blocks under article or main elements are main text.  As the pages of one site
look alike, each is also taken apart and laid out anew ``LAYOUTS`` times with
other containers, class names and kinds of boilerplate, inside the article
too, so that the labeller learns roles and not one template.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.html_blocks import leaf_blocks
from fleetpulse.llm.near_dup import word_hashes

TRAIN_PAGES = 300
LAYOUTS = 5
PATH_BUCKETS = 4096
WORDS = 32
MEASURES = 10
HIDDEN = 12
STEPS = 450
BATCH = 24
PART_BYTES = 1 << 20

# Words of class, id and role attributes, by what the element holds.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs toolbar links pagination pager skip sitemap",
    "header": "header masthead topbar banner logo brand branding hero site top",
    "footer": "footer foot bottom copyright legal colophon credits imprint",
    "sidebar": "sidebar side aside widget rail related recommended recommendations popular trending more also tags archive",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall promo message",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promoted promotion banner dfp outbrain taboola",
    "form": "form search login signin register contact subscribe feedback poll survey input",
    "comments": "comment comments reply replies discussion disqus respond thread responses reader feedback commentlist",
    "share": "share sharing social follow buttons toolbar tools actions byline meta",
}
MAIN_WORDS = "article content post entry story main body text page single prose copy blog news detail maincontent"
OTHER_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"),
              "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside", "dialog"),
              "advert": ("div", "aside", "section", "ins"), "form": ("form", "div"),
              "comments": ("section", "div", "ol", "ul"), "share": ("div", "ul")}


# ---------------------------------------------------------------- inputs of a block
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % PATH_BUCKETS


class PathBuckets(dict):
    """Buckets of a tag path, remembered as paths repeat."""

    def __missing__(self, path: tuple) -> np.ndarray:
        tokens = set()
        for near, (tag, names) in enumerate(reversed(path)):
            for word in (tag, *(f".{n}" for n in names), *(f"^{n[:4]}" for n in names if len(n) > 4)):
                tokens.add(word)
                if near < 2:
                    tokens.add(f"{near}{word}")
        if not path:
            tokens.add("top")
        found = np.array(sorted(_bucket(t) for t in tokens), np.int64)
        if len(self) < 50_000:
            self[path] = found
        return found


def page_inputs(pages: list[list[tuple]], paths: PathBuckets) -> tuple[list[np.ndarray], np.ndarray]:
    """Path buckets of every block of some pages, and the dense inputs (blocks, WORDS + MEASURES)."""
    blocks = [b for p in pages for b in p]
    dense = np.zeros((len(blocks), WORDS + MEASURES), np.float32)
    if not blocks:
        return [], dense
    data = [b[1].encode("utf-8", "replace") for b in blocks]
    sizes = np.array([len(d) for d in data])
    hashes, count = word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes)
    owner = np.repeat(np.arange(len(blocks)), count)
    words = np.maximum(count, 1)
    dense[:, :WORDS] = np.sqrt(np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64),
                                           minlength=len(blocks) * WORDS).reshape(-1, WORDS) / words[:, None])
    chars = np.array([max(1, len(b[1])) for b in blocks])
    linked = np.array([b[2] for b in blocks])
    ends = np.array([b[1][-1] in ".!?…:;\"”»" for b in blocks])
    length = np.array([len(p) for p in pages])
    row = np.arange(len(blocks)) - np.repeat(np.cumsum(length) - length, length)
    of = np.repeat(length, length)
    dense[:, WORDS:] = np.column_stack([
        np.log1p(chars) / 6, np.log1p(count) / 4, np.minimum(linked / chars, 1), linked > 0, ends,
        count < 4, row / of, row == 0, row == of - 1, np.array(["©" in b[1][:40] for b in blocks])])
    return [paths[b[0]] for b in blocks], dense


# ---------------------------------------------------------------- network
def _logistic(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over blocks; arrays are (steps, pages, features)."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 13):
        rng = np.random.default_rng(seed)
        n = 4 * hidden
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}p": np.zeros((PATH_BUCKETS, n), np.float32),
                       f"{d}x": (rng.standard_normal((WORDS + MEASURES, n)) * 0.1).astype(np.float32),
                       f"{d}h": (rng.standard_normal((hidden, n)) * 0.2).astype(np.float32),
                       f"{d}b": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}
        self.p |= {"o": (rng.standard_normal(2 * hidden) * 0.2).astype(np.float32), "ob": np.zeros(1, np.float32)}

    @staticmethod
    def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step and page of every block, pages one after another."""
        start = np.cumsum(lengths) - lengths
        page = np.repeat(np.arange(len(lengths)), lengths)
        return np.arange(int(lengths.sum())) - start[page], page

    def _given(self, d: str, buckets: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        sizes = np.array([len(b) for b in buckets])
        rows = self.p[f"{d}p"][np.concatenate(buckets)]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) + dense @ self.p[f"{d}x"] + self.p[f"{d}b"]

    def _run(self, d: str, given: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        n, (steps, width, _) = self.hidden, given.shape
        h, c = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        out = np.empty((steps, width, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"{d}h"]
            ifo, g, m = _logistic(z[:, :3 * n]), np.tanh(z[:, 3 * n:]), mask[t][:, None]
            i, f, o = ifo[:, :n], ifo[:, n:2 * n], ifo[:, 2 * n:]
            new = f * c + i * g
            tc = np.tanh(new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, tc))
            c = m * new + (1 - m) * c                        # beyond the end of a page the state stands still
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def _forward(self, buckets, dense, lengths, tapes=None):
        step, page = self._grid(lengths)
        mask = np.zeros((int(lengths.max()), len(lengths)), np.float32)
        mask[step, page] = 1
        states = {}
        for d in "fb":
            given = np.zeros((*mask.shape, 4 * self.hidden), np.float32)
            given[step, page] = self._given(d, buckets, dense)
            states[d] = self._run(d, given, mask, tapes[d] if tapes else None)
        both = np.concatenate([states["f"][step, page], states["b"][step, page]], axis=1)
        return step, page, mask, both, _logistic(both @ self.p["o"] + self.p["ob"][0])

    def label(self, pages: list[list[tuple]], paths: PathBuckets) -> list[np.ndarray]:
        """Probability of each block of each page; pages of like length run together."""
        out = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            some = [order.pop(0)]
            while order and len(some) < 256 and len(pages[order[0]]) <= 1.25 * len(pages[some[0]]) + 2:
                some.append(order.pop(0))
            lengths = np.array([len(pages[k]) for k in some])
            prob = self._forward(*page_inputs([pages[k] for k in some], paths), lengths)[4]
            for k, p in zip(some, np.split(prob, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = p
        return out

    def gradients(self, buckets, dense, lengths, label) -> tuple[float, dict]:
        n, tapes = self.hidden, {"f": [], "b": []}
        step, page, mask, both, prob = self._forward(buckets, dense, lengths, tapes)
        loss = -float(np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)))
        d_out = ((prob - label) / len(label)).astype(np.float32)
        g = {"o": d_out @ both, "ob": np.array([d_out.sum()], np.float32)}
        sizes, flat = np.array([len(b) for b in buckets]), np.concatenate(buckets)
        for side, d in enumerate("fb"):
            dh_all = np.zeros((*mask.shape, n), np.float32)
            dh_all[step, page] = d_out[:, None] * self.p["o"][side * n:(side + 1) * n]
            dz_all = np.zeros((*mask.shape, 4 * n), np.float32)
            dh, dc = np.zeros((mask.shape[1], n), np.float32), np.zeros((mask.shape[1], n), np.float32)
            g[f"{d}h"] = np.zeros_like(self.p[f"{d}h"])
            for t, h, c, i, f, o, gg, tc in reversed(tapes[d]):
                m = mask[t][:, None]
                dh = dh + dh_all[t]
                dn = dc * m + dh * m * o * (1 - tc * tc)
                dz = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), dh * m * tc * o * (1 - o),
                                     dn * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                g[f"{d}h"] += h.T @ dz
                dh = dh * (1 - m) + dz @ self.p[f"{d}h"].T
                dc = dc * (1 - m) + dn * f
            dz = dz_all[step, page]
            g[f"{d}x"], g[f"{d}b"] = dense.T @ dz, dz.sum(axis=0)
            g[f"{d}p"] = np.zeros_like(self.p[f"{d}p"])
            np.add.at(g[f"{d}p"], flat, np.repeat(dz, sizes, axis=0))
        return loss, g

    def fit(self, pages: list[list[tuple]], labels: list[list[int]], steps: int = STEPS, batch: int = BATCH,
            seed: int = 17) -> BlockLabeller:
        """Adam over pages of like length; a tenth of the path words is left out at random."""
        rng, paths = np.random.default_rng(seed), PathBuckets()
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            at = rng.integers(0, max(1, len(order) - batch + 1))
            some = order[at:at + batch]
            buckets, dense = page_inputs([pages[k] for k in some], paths)
            buckets = [b[keep] if (keep := rng.random(len(b)) > 0.1).any() else b for b in buckets]
            y = np.array([v for k in some for v in labels[k]], np.float32)
            _, g = self.gradients(buckets, dense, np.array([len(pages[k]) for k in some]), y)
            rate = 0.02 * (1 - 0.9 * s / steps)
            for k, v in g.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** s)) / (np.sqrt(square[k] / (1 - 0.99 ** s)) + 1e-6)
                              ).astype(np.float32)
        return self


# ---------------------------------------------------------------- training pages
_MARK = "\ue000"                                             # private use: marks main text in laid-out pages


def weak_labels(blocks: list[tuple]) -> list[int]:
    """Main text by markup: under article or main, and under no boilerplate element."""
    out = []
    for path, _, _ in blocks:
        tags = {tag for tag, _ in path}
        out.append(int(bool(tags & {"article", "main"}) and not tags & {"nav", "footer", "aside", "form"}))
    return out


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def lay_out(main: list[str], other: list[str], rng: random.Random) -> str:
    """A page with the given main blocks (marked) amid boilerplate, in a random layout."""
    spare = [t for t in [*main, *other] if t] or ["text"]

    def words(role: str) -> str:
        pick = rng.sample(ROLES[role].split(), rng.choice([1, 1, 2]))
        return rng.choice(["-", "_", " "]).join(pick)

    def some_text(long: bool) -> str:
        parts = rng.choice(spare).split()
        size = rng.randint(8, 60) if long else rng.randint(1, 7)
        at = rng.randint(0, max(0, len(parts) - size))
        return _escape(" ".join(parts[at:at + size]))

    def boilerplate(role: str) -> str:
        tag = rng.choice(OTHER_TAGS[role])
        telling = tag in ("nav", "header", "footer", "aside", "form")
        attr = "" if telling and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id"])}="{words(role)}"'
        if role in ("menu", "share") or role in ("footer", "sidebar", "header") and rng.random() < 0.5:
            item = lambda: f'<a href="/x">{some_text(False)}</a>'
            inner = "".join(f"<li>{item()}</li>" for _ in range(rng.randint(1, 8)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif role == "form":
            inner = f'<label>{some_text(False)}</label><input name="q"><button>{some_text(False)}</button>'
        elif role == "comments":
            row = "li" if tag in ("ul", "ol") else "div"
            name = rng.choice(["", f' class="{words(role)}"'])
            inner = "".join(f"<{row}{name}><p>{some_text(True)}</p></{row}>" for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.5 and row == "div":
                inner = f"<h3>{some_text(False)}</h3>{inner}"
        else:
            inner = "".join(rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>"]).format(
                some_text(rng.random() < 0.5)) for _ in range(rng.randint(1, 3)))
            if role == "footer" and rng.random() < 0.7:
                inner = f"&copy; {some_text(False)} &middot; {inner}"
        if rng.random() < 0.04:
            holder = rng.choice(["noscript", "iframe", "video", "object"])
            inner = f"<{holder}>{some_text(rng.random() < 0.5)}</{holder}>{inner}"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def body_block(text: str) -> str:
        text = _MARK + _escape(text)
        return rng.choice(["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br></p>", "<div>{}</div>", "<blockquote>{}</blockquote>",
                                               "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>", "<p><a href='/y'>{}</a></p>",
                                               "<section><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>",
                                               "<object><p>{}</p></object>", "<noscript>{}</noscript>",
                                               "<p><math><mi>{}</mi></math></p>", "<svg><p>{}</p>"]).format(text)

    inside = [rng.choice(["<h1>{}</h1>"] * 3 + ["<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(_MARK + _escape(main[0]))]
    for text in main[1:]:
        inside.append(body_block(text))
        if rng.random() < 0.12:
            inside.append(boilerplate(rng.choice(["advert", "advert", "sidebar", "notice", "form", "share", "menu"])))
    if rng.random() < 0.25:
        inside.append(boilerplate(rng.choice(["comments", "share", "sidebar", "form"])))
    named = rng.choice(["-", "_", " "]).join(rng.sample(MAIN_WORDS.split(), rng.choice([1, 2])))
    shell = rng.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>",
                                                        f'<div class="{named}">{{}}</div>', f'<div id="{named}">{{}}</div>',
                                                        f'<section class="{named}">{{}}</section>',
                                                        f'<article class="{named}">{{}}</article>', "<div>{}</div>", "{}"])
    draw = lambda roles, p: [boilerplate(r) for r in roles if rng.random() < p]
    if rng.random() < 0.06:                                  # a page without any markup of its own
        return rng.choice(["{}", "<html><body>{}</body></html>", "<pre>{}</pre>"]).replace("{}", _MARK + _escape(rng.choice(main)))
    page = [*draw(["notice", "header", "menu", "advert", "form", "sidebar"], 0.4), shell.replace("{}", "".join(inside)),
            *draw(["share", "comments", "comments", "advert", "sidebar", "form", "notice", "footer", "footer"], 0.4)]
    return f"<html><head><title>{some_text(False)}</title></head><body>{''.join(page)}</body></html>"


def training_set(htmls: list[str], layouts: int = LAYOUTS, seed: int = 23) -> tuple[list, list]:
    rng, pages, labels = random.Random(seed), [], []
    for html in htmls:
        blocks = leaf_blocks(html)
        label = weak_labels(blocks)
        if sum(label):
            pages.append(blocks)
            labels.append(label)
        main = [b[1] for b, k in zip(blocks, label, strict=True) if k] or [b[1] for b in blocks][:8]
        other = [b[1] for b, k in zip(blocks, label, strict=True) if not k]
        for _ in range(layouts if main else 0):
            keep = main[:1] + main[1:][:rng.randint(0, 24)]
            made = leaf_blocks(lay_out(keep, other, rng))
            pages.append([(path, text.replace(_MARK, "") or ".", links) for path, text, links in made])
            labels.append([int(_MARK in text) for _, text, _ in made])
    return pages, labels


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = 100_000, id_col: str = "page_id",
          html_col: str = "html") -> BlockLabeller:
    """A labeller fitted to at most ``train_pages`` pages of at most ``train_chars`` characters, the first by a hash
    of id and content (so rows that share an id, or have none, are drawn apart), and their new layouts."""
    html = F.col(html_col).cast("string")
    sample = pages.select(F.xxhash64(F.col(id_col), html).alias("draw"), html.alias("html")) \
        .where(F.length("html").between(1, train_chars)).orderBy("draw").limit(train_pages)
    found, labels = training_set(sorted(r["html"] for r in sample.collect()))
    return BlockLabeller().fit(found, labels) if found else BlockLabeller()


def extract(pages: DataFrame, model: BlockLabeller, least: float = 0.5, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars, n_blocks, n_main``.

    The main blocks in page order, joined by two line breaks; white space
    inside a block is one space.  Null and empty pages, and pages without a
    main block, give an empty text.  Repeated rows get equal results; null ids
    and urls stay null.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = PathBuckets()
        for batch in batches:
            htmls, at = batch.column(2), 0
            sizes = [len(x.as_py() or "") for x in htmls]
            while at < len(sizes):                           # parts of like bytes, one page at least
                stop, total = at, 0
                while stop < len(sizes) and (stop == at or total + sizes[stop] <= PART_BYTES):
                    total += sizes[stop]
                    stop += 1
                blocks = [leaf_blocks(x) for x in htmls.slice(at, stop - at).to_pylist()]
                prob = model.label(blocks, paths)
                main = [[b[1] for b, p in zip(bs, ps.tolist(), strict=True) if p >= least]
                        for bs, ps in zip(blocks, prob, strict=True)]
                text = ["\n\n".join(m) for m in main]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64()), pa.array([len(b) for b in blocks], pa.int64()),
                     pa.array([len(m) for m in main], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])
                at = stop

    key_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        label, f"page_id {key_type}, url {url_type}, text string, n_chars bigint, n_blocks bigint, n_main bigint")
