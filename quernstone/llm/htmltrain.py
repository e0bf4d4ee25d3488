"""Trains the block labeller of htmltext on pages of its own making: `python -m quernstone.llm.htmltrain`.

The pages are drawn from many layouts: menus, headers, footers, sidebars, notices, adverts, forms, comments and sharing
bars around, before, after and inside an article, under many class names and tags, with text of made-up words so that the
network learns from structure and shape. The text of each block tells its label: parts of the article are kept."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from .htmltext import NUMBERS, PATH_CELLS, WORD_CELLS, Labeller, blocks, lstm, numbers, path_cells, sigmoid

HIDDEN, INPUT = 24, 32
_SYLLABLES = "an er on th in re ti es or ou st ed he at en nd ha ea wh sh of ly ing tion ble le la qu ai eu é ö ü ñ ción lich keit ung che ra do mo ka zu pi ve ".split()
_SMALL = "the of and to in a is der die und le la les de el que en y un".split()
NAMES = {
    "nav": ["nav", "menu", "navbar", "main-nav", "navigation", "topnav", "site-menu", "breadcrumb", "breadcrumbs", "nav-links", "pager", "pagination", "toc", "tabs"],
    "header": ["header", "site-header", "masthead", "top", "topbar", "banner", "logo", "page-header", "brand", "hero-bar", "skip-link"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal", "footer-links", "page-footer", "imprint"],
    "side": ["sidebar", "side", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "tags", "archive", "right-col", "secondary", "more-stories", "teaser"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "cookie-banner", "disclaimer", "message", "privacy-notice", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsbox", "ad-slot", "banner-ad", "commercial", "partner"],
    "form": ["form", "newsletter", "subscribe", "search", "login", "signup", "contact-form", "search-box"],
    "comments": ["comments", "comment", "comment-list", "discussion", "responses", "reply", "disqus", "reader-comments", "feedback"],
    "share": ["share", "social", "sharing", "follow", "share-buttons", "like", "addthis", "meta", "byline-tools"],
}
MAIN = ["content", "post", "entry", "article", "main", "main-content", "post-content", "article-body", "story", "text", "body-text", "entry-content", "page-content", "single", "column", "wrapper", "inner", ""]
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Sports", "Next", "Previous", "Menu", "Start", "Inicio", "Accueil", "Kontakt"],
    "header": ["Welcome to", "Skip to content", "Your daily source", "Log in", "Sign up"],
    "footer": ["© 2024", "© ", "All rights reserved", "Copyright", "Privacy policy", "Terms of use", "Imprint", "Powered by", "&copy; ", "&copy; site.example.org &middot; "],
    "side": ["Related articles", "Most read", "Popular", "Tags", "Archive", "See also", "Recent posts"],
    "notice": ["We use cookies", "This site uses cookies to improve", "Accept all", "By continuing you agree", "Please enable JavaScript", "Subscribe to read"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Anzeige", "Shop today"],
    "form": ["Search", "Your email", "Subscribe", "Password", "Name", "Send", "Enter your email address"],
    "comments": ["Comments", "Reply", "says:", "Leave a reply", "3 comments", "posted on", "Report"],
    "share": ["Share", "Tweet", "Facebook", "Print", "Email", "Share this", "Follow us"],
}


class Maker:
    """Draws pages; keeps what it put into articles, to label the blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return r.choice(_SMALL) if r.random() < 0.3 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        words = [self.word() + ("," if self.r.random() < 0.06 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize().rstrip(",") + self.r.choice("....!?")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def attribute(self, kind: str) -> str:
        r = self.r
        name = r.choice(NAMES[kind])
        if r.random() < 0.2:
            name += r.choice(["-wrapper", "_box", "-1", "-area", "-section", "Block", " clearfix", " col-md-4", " hidden"])
        return f' {r.choice(["class", "id", "class", "role"])}="{name}"'

    def open_tag(self, kind: str) -> tuple[str, str]:
        """A tag with a name or a tag that says it all, so that either must do."""
        r = self.r
        own = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form"]}.get(kind, [])
        tag = r.choice([*own, *own, "div", "section", "div"])
        named = "" if tag in own and r.random() < 0.6 else self.attribute(kind)
        return f"<{tag}{named}>", f"</{tag}>"

    def junk(self, kind: str) -> str:
        r = self.r
        a, b = self.open_tag(kind)
        short = lambda: r.choice(PHRASES[kind]) if r.random() < 0.35 else " ".join(self.word() for _ in range(r.randint(1, 5)))
        link = lambda: f'<a href="/{self.word()}">{short()}</a>'
        plain = lambda: (r.choice(PHRASES[kind]) + " " if r.random() < 0.35 else "") + self.prose(1, r.choice([1, 2, 5]))
        if kind in ("nav", "share") or kind in ("footer", "header", "side") and r.random() < 0.5:
            items = [link() for _ in range(r.randint(1, 9))]
            body = r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])()
        elif kind == "form":
            body = f"<label>{short()}</label><input><p>{plain()}</p><button>{short()}</button>" if r.random() < 0.6 else f"{short()}<input type=text>"
        elif kind == "comments":
            body = f"<h3>{short()}</h3>" + "".join(r.choice(["<div class=comment><b>{0}</b><p>{1}</p></div>", "<li>{0}<p>{1}</p></li>", "<p>{1}</p>", '<article class="comment"><header>{0}</header><p>{1}</p></article>']).format(short(), plain()) for _ in range(r.randint(1, 5)))
        else:
            body = r.choice([lambda: plain(), lambda: f"<p>{plain()}</p>", lambda: f"<h3>{short()}</h3><p>{plain()}</p>", lambda: f"{plain()}{link()}", lambda: short()])()
        return a + body + b

    def article(self, kept: list[str]) -> str:
        r, parts = self.r, []

        def put(text: str, shape: str) -> None:
            kept.append(text)
            parts.append(shape.format(text))

        if r.random() < 0.85:
            put(r.choice([self.sentence(3, 12), self.sentence(1, 4).rstrip(".!?"), self.prose(1, 3)[:60]]), r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<h1 class="title">{}</h1>', "<header><h1>{}</h1></header>"]))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.62:
                text = self.prose(1, r.choice([1, 3, 8, 20]))
                shape = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><i>{}</i></p>"])
                if r.random() < 0.15:
                    w = text.split()
                    k = r.randrange(len(w))
                    w[k] = f'<a href="/x">{w[k]}</a>'
                    kept.append(text)
                    parts.append(shape.format(" ".join(w)))
                else:
                    put(text, shape)
            elif x < 0.72:
                put(self.sentence(1, 6).rstrip(".!?"), r.choice(["<h2>{}</h2>", "<h3>{}</h3>"]))
            elif x < 0.82:
                parts.append("<ul>")
                for _ in range(r.randint(1, 6)):
                    put(self.sentence(2, 14), r.choice(["<li>{}</li>", "<li>{}"]))
                parts.append("</ul>")
            elif x < 0.87:
                put(self.prose(1, 4), r.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]))
            elif x < 0.9:
                put(self.sentence(3, 10), "<figure><img src=x><figcaption>{}</figcaption></figure>")
            elif x < 0.93:
                parts.append("<table>")
                for _ in range(r.randint(1, 3)):
                    put(self.sentence(1, 4), "<tr><td>{}</td>")
                    put(self.sentence(1, 4), "<td>{}</td></tr>")
                parts.append("</table>")
            else:
                parts.append(self.junk(r.choice(["ad", "share", "side", "form", "notice", "ad"])))
        return "".join(parts)

    def page(self) -> tuple[str, set[str]]:
        r, kept = self.r, []
        made = "-".join(self.word() for _ in range(r.randint(1, 2)))
        name = r.choice([r.choice(MAIN), r.choice(MAIN), r.choice(MAIN) + "-" + self.word(), made])
        wraps = [("<article>", "</article>")] * 3 + [("<main>", "</main>")] + [("<main><article>", "</article></main>"), ("", ""), ("<td>", "</td>"), ("<div>", "</div>")]
        wraps += [(f'<div class="{name}">', "</div>")] * 3 + [(f'<div id="{name}">', "</div>"), (f'<section class="{name}">', "</section>"), (f'<article class="{name}">', "</article>")]
        wraps += [(f'<div class="{made}"><div class="{name}">', "</div></div>")] * 2
        a, b = r.choice(wraps)
        body = self.article(kept)
        inner = self.junk("comments") if r.random() < 0.12 else ""
        if r.random() < 0.08:
            inner += self.junk("footer")
        main = a + body + inner + b
        before = [self.junk(k) for k in ("header", "nav", "notice", "ad", "form", "side", "nav") if r.random() < 0.4]
        after = [self.junk(k) for k in ("comments", "side", "share", "ad", "form", "notice", "nav", "footer") if r.random() < 0.4]
        if r.random() < 0.5:
            r.shuffle(before)
        text = "".join(before) + main + "".join(after)
        if r.random() < 0.2:  # main text and sidebar in one frame
            frame = self.word()
            text = "".join(before) + f'<div class="{frame}">' + main + self.junk("side") + "</div>" + "".join(after)
        if r.random() < 0.3:
            text = r.choice(['<div id="page">{}</div>', '<div class="container"><div class="row">{}</div></div>', "<div>{}</div>", f'<div class="{self.word()}">{{}}</div>']).replace("{}", text)
        head = f"<head><title>{self.sentence()}</title><style>p{{}}</style><script>var t='</p>';</script></head>" if r.random() < 0.8 else ""
        out = f"<!DOCTYPE html><html>{head}<body>{text}" + ("</body></html>" if r.random() < 0.9 else "")
        return out, {" ".join(k.split()) for k in kept}


def labelled(pages: int, seed: int) -> list[tuple[list, np.ndarray]]:
    """(blocks, 1 where main) of made pages."""
    maker, out = Maker(seed), []
    while len(out) < pages:
        page, kept = maker.page()
        cut = blocks(page)
        if cut:
            out.append((cut, np.array([text in kept for _, text, _ in cut], "f4")))
    return out


def features(page: list, own: Labeller) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    words = [text.split(" ") for _, text, _ in page]
    return [path_cells(p) for p, _, _ in page], np.array([own.bag(w) for w in words], "f4"), np.array([numbers(t, len(w), n, k / len(page)) for k, ((_, t, n), w) in enumerate(zip(page, words, strict=True))], "f4")


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *s, scale: (rng.standard_normal(s) * scale).astype("f4")
    w = {"path": n(PATH_CELLS, INPUT, scale=0.15), "word": n(WORD_CELLS, INPUT, scale=0.1), "number": n(NUMBERS, INPUT, scale=0.3), "in_bias": n(INPUT, scale=0.01), "out": n(2 * HIDDEN, scale=0.2), "out_bias": np.zeros((), "f4")}
    for way in "fb":
        w |= {f"{way}_x": n(INPUT, 4 * HIDDEN, scale=0.2), f"{way}_h": n(HIDDEN, 4 * HIDDEN, scale=0.2), f"{way}_bias": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype("f4")}
    return w


def _back(x: np.ndarray, lengths: np.ndarray, w: dict, way: str, grad: np.ndarray, into: dict) -> np.ndarray:
    """Gradient of one direction by its inputs; adds the weights' gradients. Runs the states again."""
    steps, batch, _ = x.shape
    size = HIDDEN
    order = list(range(steps) if way == "f" else range(steps - 1, -1, -1))
    h, c, kept = np.zeros((batch, size), "f4"), np.zeros((batch, size), "f4"), []
    pre = x @ w[f"{way}_x"] + w[f"{way}_bias"]
    for t in order:
        z = pre[t] + h @ w[f"{way}_h"]
        g, u, on = sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :]), (t < lengths)[:, None]
        new = np.where(on, g[:, size : 2 * size] * c + g[:, :size] * u, 0)
        kept.append((h, c, g, u, new, on))
        c, h = new, np.where(on, g[:, 2 * size :] * np.tanh(new), 0)
    dh, dc, dx = np.zeros((batch, size), "f4"), np.zeros((batch, size), "f4"), np.zeros_like(x)
    for t, (before, c0, g, u, c1, on) in zip(reversed(order), reversed(kept), strict=True):
        dh = np.where(on, dh + grad[t], 0)
        th = np.tanh(c1)
        dc = np.where(on, dc, 0) + dh * g[:, 2 * size :] * (1 - th * th)
        dz = np.concatenate([dc * u * g[:, :size] * (1 - g[:, :size]), dc * c0 * g[:, size : 2 * size] * (1 - g[:, size : 2 * size]), dh * th * g[:, 2 * size :] * (1 - g[:, 2 * size :]), dc * g[:, :size] * (1 - u * u)], axis=1) * on
        into[f"{way}_x"] += x[t].T @ dz
        into[f"{way}_h"] += before.T @ dz
        into[f"{way}_bias"] += dz.sum(axis=0)
        dx[t] = dz @ w[f"{way}_x"].T
        dh, dc = dz @ w[f"{way}_h"].T, dc * g[:, size : 2 * size]
    return dx


def train(pages: int = 6000, epochs: int = 6, seed: int = 1, batch: int = 64, rate: float = 4e-3, say=None) -> dict[str, np.ndarray]:
    w = start(seed)
    own = Labeller(w)
    data = [(features(p, own), y) for p, y in labelled(pages, seed)]
    data.sort(key=lambda d: len(d[1]))
    groups = [data[k : k + batch] for k in range(0, len(data), batch)]
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        wrong = total = 0
        for at in rng.permutation(len(groups)):
            some = groups[at]
            lengths = np.array([len(y) for _, y in some])
            flat = [c for (cells, _, _), _ in some for c in cells]
            rows, cells = np.repeat(np.arange(len(flat)), [len(c) for c in flat]), np.concatenate(flat)
            # drop some path features, so that no single name decides
            keep = rng.random(len(cells)) > 0.25
            rows, cells = rows[keep], cells[keep]
            paths = np.zeros((len(flat), PATH_CELLS), "f4")
            paths[rows, cells] = 1
            bags, nums = np.concatenate([b for (_, b, _), _ in some]), np.concatenate([n for (_, _, n), _ in some])
            first = np.tanh(paths @ w["path"] + bags @ w["word"] + nums @ w["number"] + w["in_bias"])
            time = np.concatenate([np.arange(n) for n in lengths])
            page = np.repeat(np.arange(len(some)), lengths)
            x = np.zeros((lengths.max(), len(some), INPUT), "f4")
            x[time, page] = first
            both = np.concatenate([lstm(x, lengths, w, "f"), lstm(x, lengths, w, "b")], axis=2)
            z = (both @ w["out"] + w["out_bias"])[time, page]
            y = np.concatenate([y for _, y in some])
            d = (sigmoid(z) - y).astype("f4") / len(some)
            wrong, total = wrong + int(((z > 0) != (y > 0)).sum()), total + len(y)
            g = {k: np.zeros_like(a) for k, a in w.items()}
            g["out"], g["out_bias"] = both[time, page].T @ d, np.asarray(d.sum(), "f4")
            grad = np.zeros_like(both)
            grad[time, page] = d[:, None] * w["out"]
            dx = _back(x, lengths, w, "f", grad[:, :, :HIDDEN], g) + _back(x, lengths, w, "b", grad[:, :, HIDDEN:], g)
            dx = dx[time, page] * (1 - first * first)
            g |= {"path": paths.T @ dx, "word": bags.T @ dx, "number": nums.T @ dx, "in_bias": dx.sum(axis=0)}
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            now = rate * (1 - 0.9 * step / (epochs * len(groups)))
            for k in w:
                a = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")
        if say:
            say(f"epoch {epoch}: {wrong / total:.4f} of {total} blocks wrong")
    return w


def accuracy(w: dict[str, np.ndarray], pages: int, seed: int) -> float:
    own, right, total = Labeller(w), 0, 0
    data = labelled(pages, seed)
    for (_, y), z in zip(data, own.logits([own.inputs(p) for p, _ in data]), strict=True):
        right, total = right + int(((z > 0) == (y > 0)).sum()), total + len(y)
    return right / total


if __name__ == "__main__":
    made = train(say=lambda x: print(x, flush=True))
    print(f"held-out accuracy {accuracy(made, 500, 99):.4f}")
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else Path(__file__).with_name("htmltext.npz"), **{k: a.astype("f2") for k, a in made.items()})
