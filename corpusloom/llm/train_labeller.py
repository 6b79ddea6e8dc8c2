"""Trains the block labeller on generated pages: python -m corpusloom.llm.train_labeller

Every page is made of a random layout whose blocks are known to be main text or not; words are invented, so the net
learns tag paths, names, typical furniture words, lengths, links and the order of blocks, not a vocabulary."""

from __future__ import annotations

import random

import numpy as np

from .html_blocks import blocks
from .html_extract import HIDDEN, NUMBERS, PATHS, WEIGHTS, WORDS, Labeller, vectors

# fixed values: names and words of page furniture
_NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links toc".split(),
    "header": "header masthead banner top site-header branding logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal".split(),
    "aside": "sidebar aside widget related recommended popular trending tags social share newsletter author-bio more".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbygoogle sponsor".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal subscribe paywall".split(),
    "form": "search search-form login signup contact subscribe-form comment-form".split(),
    "comments": "comments comment comment-list discussion replies reply disqus responses".split(),
    "main": "content main article post entry story body text page article-body post-content entry-content main-content story-body".split(),
}
_WORDS = {
    "nav": "home about contact news sport blog products services login menu help archive".split(),
    "header": "welcome daily site the official portal".split(),
    "footer": "copyright all rights reserved terms privacy policy contact imprint sitemap © 2024".split(),
    "aside": "related most read share follow us popular tags recent posts more".split(),
    "ad": "advertisement buy now sale offer sponsored discount free shipping".split(),
    "notice": "we use cookies accept consent policy subscribe to continue agree".split(),
    "form": "search submit name email password sign in send your message".split(),
    "comments": "says reply posted by guest ago thanks great i agree like comment".split(),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("th er an in on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce é ä ö ü ñ ß è ch pf".split()) for _ in range(r.choice([1, 2, 2, 3, 3, 4])))

    def sentence(self, least: int, most: int, mix: str = "") -> str:
        r = self.r
        w = [self.word() for _ in range(r.randint(least, most))]
        if mix:
            w = [r.choice(_WORDS[mix]) if r.random() < 0.35 else x for x in w]
        noise = r.random()
        if noise < 0.04:
            w = [x + r.choice(["%%%", "###", "&amp;&amp;&amp;", "***", "$$$", "!!", ","]) for x in w]
        elif noise < 0.06:
            w = [x.upper() for x in w]
        elif noise < 0.08:
            w = [x + " |" for x in w]
        elif noise < 0.10:
            w = [w[0]] * len(w)
        return " ".join(w).capitalize() + r.choice([".", ".", ".", ".", "", "!", "?"])

    def attrs(self, kind: str, sure: bool = False) -> str:
        r = self.r
        if not sure and r.random() < 0.3:
            return ""
        name = r.choice(_NAMES[kind])
        return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", "-1", " clearfix", " col"])}"'

    def furniture(self, kind: str, inside: bool = False) -> list[tuple[str, bool]]:
        """Pieces of markup, of which none is main text."""
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = r.random() < 0.35
        tag, a = ("div", self.attrs(kind, True)) if plain and kind != "form" else (tag, self.attrs(kind, tag in ("div", "section")))
        out = [(f"<{tag}{a}>", False)]
        if kind == "nav" or (kind in ("header", "footer", "aside") and r.random() < 0.5):
            items = r.randint(2, 9)
            out.append(("<ul>", False))
            for _ in range(items):
                out.append((f'<li><a href="/{self.word()}">{self.sentence(1, 3, kind if r.random() < 0.5 else "")}</a></li>', False))
            out.append(("</ul>", False))
        if kind == "comments":
            for _ in range(r.randint(1, 5)):
                out += [(f'<div{self.attrs("comments")}>', False), (f"<p>{self.sentence(3, 60, r.choice(['', 'comments']))}</p>", False), ("</div>", False)]
        elif kind == "form":
            out.append((f'<label>{self.sentence(1, 3, "form")}</label><input name="q"><button>{self.sentence(1, 2, "form")}</button>', False))
        elif kind != "nav" or r.random() < 0.2:
            lead = r.choice(["", "", "&copy; ", "&middot; "]) if kind == "footer" else ""
            body = lead + self.sentence(2, 30 if kind != "header" else 6, r.choice(["", kind]))
            out.append((body if r.random() < 0.5 else f"<p>{body}</p>", False))
        out.append((f"</{tag}>", False))
        return out

    def article(self) -> list[tuple[str, bool]]:
        r = self.r
        style = r.random()
        if style < 0.4:
            opening, closing = f"<article{self.attrs('main') if r.random() < 0.5 else ''}>", "</article>"
        elif style < 0.6:
            opening, closing = f"<main{self.attrs('main') if r.random() < 0.5 else ''}>", "</main>"
        elif style < 0.92:
            opening, closing = f"<div{self.attrs('main', True)}>", "</div>"
        else:
            opening, closing = "<div>", "</div>"
        out = [(opening, False)]
        title = self.sentence(1, 12)
        if r.random() < 0.85:
            out.append((f"<h1>{title}</h1>", True))
        if r.random() < 0.15:
            out.append((f"<p><b>{title}<br>", True))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 20])):
            k = r.random()
            text = self.sentence(1, r.choice([3, 12, 40, 90]))
            if k < 0.07:
                out.append((f"<p><b>{text}<br>", True))
            elif k < 0.7:
                inline = f'<a href="/{self.word()}">{self.word()}</a> ' if r.random() < 0.15 else ""
                out.append((f"<p>{inline}{text}" + ("</p>" if r.random() < 0.95 else ""), True))
            elif k < 0.78:
                out.append((f"<h2>{self.sentence(1, 8)}</h2>", True))
            elif k < 0.84:
                out.append(("<ul>", False))
                out += [(f"<li>{self.sentence(1, 20)}</li>", True) for _ in range(r.randint(1, 5))]
                out.append(("</ul>", False))
            elif k < 0.88:
                out.append((f"<blockquote>{text}</blockquote>", True))
            elif k < 0.91:
                out.append((f"<pre>{text}</pre>", True))
            elif k < 0.94:
                out += [("<table><tr>", False), *[(f"<td>{self.sentence(1, 4)}</td>", True) for _ in range(3)], ("</tr></table>", False)]
            else:
                out += self.furniture(r.choice(["ad", "aside", "notice", "form", "nav"]), True)
        if r.random() < 0.15:
            out += self.furniture("comments", True)
        out.append((closing, False))
        return out

    def page(self) -> list[tuple[str, bool]]:
        r = self.r
        title = self.sentence(1, 8)
        out = [(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>', False)]
        for kind in ("header", "nav", "notice", "ad", "form"):
            if r.random() < {"header": 0.4, "nav": 0.75, "notice": 0.2, "ad": 0.45, "form": 0.2}[kind]:
                out += self.furniture(kind)
        if r.random() < 0.3:
            out.append((f"<div{self.attrs('main') if r.random() < 0.3 else r.choice(['', ' class=wrapper', ' class=container'])}>", False))
        before = r.random() < 0.15
        if before:
            out += self.furniture("aside")
        if r.random() < 0.96:
            out += self.article()
        for kind in ("comments", "aside", "ad", "notice", "form", "footer"):
            if r.random() < {"comments": 0.3, "aside": 0.35, "ad": 0.2, "notice": 0.1, "form": 0.1, "footer": 0.8}[kind]:
                out += self.furniture(kind)
        if r.random() < 0.9:
            out.append(("</body></html>", False))
        return out

    def example(self):
        """Blocks of a page and whether each is main text. Every text is marked by a number that the parse keeps."""
        parts = self.page()
        marked, truth = "", []
        for markup, main in parts:
            marked += markup
            n = len(blocks(marked))
            truth += [main] * (n - len(truth))
            truth = truth[:n]
        found = blocks(marked)
        return found, np.array((truth + [False] * len(found))[: len(found)], np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _forward(w, x, mask, d):
    """x: steps x pages x features. Returns hidden states and what the backward pass needs."""
    t_max, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gates = x @ w[f"wx{d}"] + w[f"b{d}"]
    hs, saved = np.zeros((t_max, n, HIDDEN), np.float32), []
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        z = gates[t] + h @ w[f"wh{d}"]
        ifo, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * g
        tc = np.tanh(c_new)
        saved.append((t, h, c, ifo, g, tc, m))
        c = m * c_new + (1 - m) * c
        h = m * (ifo[:, 2 * HIDDEN :] * tc) + (1 - m) * h
        hs[t] = h
    return hs, saved


def _backward(w, x, dh_out, saved, d, grads):
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.zeros((x.shape[0], n, 4 * HIDDEN), np.float32)
    for t, h, c, ifo, g, tc, m in reversed(saved):
        dh = dh + dh_out[t]
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        dhm, dcm = dh * m, dc * m
        dct = dcm + dhm * o * (1 - tc**2)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
        dz_all[t] = dz
        grads[f"wh{d}"] += h.T @ dz
        dh = dz @ w[f"wh{d}"].T + dh * (1 - m)
        dc = dct * f + dc * (1 - m)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grads[f"wx{d}"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[f"b{d}"] += flat.sum(0)


def train(pages: int = 3000, epochs: int = 10, seed: int = 7) -> tuple[dict[str, np.ndarray], float]:
    made = Pages(seed)
    examples = [made.example() for _ in range(pages)]
    examples = [(vectors([b]), y) for b, y in examples if b]
    rng = np.random.default_rng(seed)
    size = PATHS + WORDS + NUMBERS
    w = {"wo": rng.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(())}
    for d in "fb":
        w |= {f"wx{d}": rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN)), f"wh{d}": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, held = 0, examples[: len(examples) // 10]
    rest = examples[len(held) :]
    for epoch in range(epochs):
        order = rng.permutation(len(rest))
        for at in range(0, len(order), 32):
            batch = [rest[i] for i in order[at : at + 32]]
            t_max = max(len(y) for _, y in batch)
            x, y, mask = np.zeros((t_max, len(batch), size), np.float32), np.zeros((t_max, len(batch)), np.float32), np.zeros((t_max, len(batch)), np.float32)
            for j, (v, t) in enumerate(batch):
                x[: len(t), j], y[: len(t), j], mask[: len(t), j] = v, t, 1
            # words drop out often, so that names and order carry the label
            x[:, :, PATHS : PATHS + WORDS] *= rng.random((t_max, len(batch), 1)) < 0.6
            hf, sf = _forward(w, x, mask, "f")
            hb, sb = _forward(w, x, mask, "b")
            both = np.concatenate([hf, hb], 2)
            p = _sigmoid(both @ w["wo"] + w["bo"])
            e = (p - y) * mask / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            grads["wo"] = np.einsum("tnh,tn->h", both, e)
            grads["bo"] = np.asarray(e.sum(), np.float32)
            back = e[:, :, None] * w["wo"]
            _backward(w, x, back[:, :, :HIDDEN], sf, "f", grads)
            _backward(w, x, back[:, :, HIDDEN:], sb, "b", grads)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            rate = 0.006 * (1 - epoch / epochs) + 0.0005
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9)) + 1e-6 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g**2
                w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net = Labeller(w)
    right = total = 0
    for v, y in held:
        right += int(((net.main(v, [len(y)]) >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    return w, right / total


if __name__ == "__main__":
    weights, accuracy = train()
    np.savez_compressed(WEIGHTS, **weights)
    print(f"held-out accuracy {accuracy:.4f}")
