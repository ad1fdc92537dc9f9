"""Labelled pages from a seeded grammar, and the fit of the block classifier on them.

Public labelled pages are not at hand, so pages are made: an article of headings, paragraphs, lists, tables and
quotes, in one of many containers and wrappers, among the usual boilerplate with names of its usual kinds. Content
carries a mark that is taken out before a block's features are computed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from marlstone.llm.html_text import FEATURES, Block, Model, Page, features

MARK, PAGES, SEED = "\ue000", 300, 17
_SYLLABLES = "an ter on da li mo re sa vi tu ke no pra sti el or".split()


class Grammar:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *of):
        return of[self.rng.integers(len(of))]

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join("".join(self.pick(*_SYLLABLES) for _ in range(self.rng.integers(1, 4))) + ("," if self.rng.random() < 0.06 else "") for _ in range(n))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        return self.words(low, high).capitalize() + (self.pick(".", ".", ".", "!", "?", ":") if self.rng.random() < 0.9 else "")

    def prose(self, mark: str) -> str:
        return mark + " ".join(self.sentence() for _ in range(self.rng.integers(1, 6)))

    def links(self, n: int) -> list[str]:
        return [f"<a href=/{i}>{self.words(1, 4)}</a>" for i in range(n)]

    def menu(self) -> str:
        items = "".join(f"<li>{a}</li>" for a in self.links(int(self.rng.integers(2, 9))))
        return self.pick(f"<nav><ul>{items}</ul></nav>", f"<div class=menu><ul>{items}</ul></div>", f"<div id=top-nav><ul>{items}</ul></div>", f"<ul class=breadcrumbs>{items}</ul>", f"<ul>{items}</ul>", f"<div class=tags>{' '.join(self.links(4))}</div>")

    def text(self) -> str:
        return self.pick(self.words(1, 6), self.sentence(), self.prose(""), f"<p>{self.prose('')}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.sentence()}</p>", f"<p>{self.sentence()}</p><p>{self.links(1)[0]}</p>")

    def boilerplate(self) -> str:
        t, name = self.text(), f"class=c{self.rng.integers(100)}"
        if self.rng.random() < 0.4:  # names that say nothing
            short = self.pick(self.words(1, 5), self.sentence(1, 8), self.links(1)[0])
            return self.pick(f"<div {name}>{short}</div>", f"<div {name}><p>{short}</p></div>", f"<div {name}><p>{short}</p><p>{self.words(1, 4)}</p></div>", f"<span {name}>{short}</span><hr>", f"<ul {name}><li>{short}</li><li>{self.words(1, 3)}</li></ul>")
        return self.pick(
            self.menu(), f"<aside>{t}</aside>", f"<footer>{t}</footer>", f"<div class={self.pick('footer', 'site-footer')}>{t}</div>", f"<form><label>{self.words(1, 3)}</label><input>{t}<button>{self.words(1, 2)}</button></form>",
            f"<div class={self.pick('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo')}>{t}</div>", f"<div id={self.pick('cookie-notice', 'gdpr-consent', 'notice', 'alert')}>{t}</div>", f"<div class={self.pick('sidebar', 'widget', 'related', 'share', 'newsletter', 'popup')}>{t}</div>",
            f"<div class={self.pick('post-comments', 'article-footer', 'entry-share', 'content-sidebar', 'post-related', 'story-newsletter')}>{t}</div>",
            f"<section class={self.pick('comments', 'comment-list', 'replies')}>{''.join(f'<p>{self.prose(chr(32))}</p>' for _ in range(3))}</section>", f"<div id=comments><article class=comment><p>{self.prose('')}</p></article></div>",
        )

    def block(self) -> str:
        m = MARK
        items = lambda tag, low, high: "".join(f"<{tag}>{m}{self.words(low, high)}</{tag}>" for _ in range(self.rng.integers(2, 6)))
        return self.pick(
            *[f"<p>{self.prose(m)}</p>"] * 8, *[f"<p>{m}{self.sentence(1, 4)}</p>"] * 3, f"<p>{m}{self.words(1, 3)}</p>", f"<h2>{m}{self.words(1, 8)}</h2>", f"<ul>{items('li', 1, 12)}</ul>", f"<ol>{items('li', 3, 25)}</ol>",
            f"<table><tr>{items('th', 1, 2)}</tr><tr>{items('td', 1, 4)}</tr></table>", f"<blockquote>{self.prose(m)}</blockquote>", f"<pre>{m}{self.words(2, 30)}</pre>", f"<figure><figcaption>{m}{self.words(2, 12)}</figcaption></figure>",
            f"<p>{m}{self.words(2, 9)} {self.links(1)[0]} {self.sentence()}</p>", f"<div>{self.prose(m)}</div>", f"{self.prose(m)}<br><br>{self.prose('')}",
        )

    def page(self) -> str:
        some = lambda p, n=1: "".join(self.boilerplate() for _ in range(n) if self.rng.random() < p)
        size = self.pick(0, 1, 2, 4, 8, 12)
        body = f"<h1>{MARK}{self.words(1, 9)}</h1>" * (self.rng.random() < 0.8)
        for _ in range(size + (not body)):
            body += self.block() + some(0.15)
        head = f"<header><h2>{self.words(1, 4)}</h2>{self.menu()}</header>"
        kind = self.pick("article", "article", "article", "main", "main><article", 'div class="content"', 'div class="post-body"', "div id=story", 'section class="entry"', "div")
        if kind == "div":
            body += f"<p>{self.prose(MARK)}</p>" * 2
        end = "".join(f"</{t.split()[0]}>" for t in reversed(kind.split("><")))
        inner = f"<{kind}>{body}{end}"
        if self.rng.random() < 0.2:
            inner = f"<{kind}>{body}{self.boilerplate()}{end}"
        for _ in range(self.rng.integers(0, 3)):
            wrapper = self.pick('class="page with-sidebar"', 'class="content has-comments"', "id=main-search-page", 'class="layout side-right"', "class=container", "id=wrapper", "")
            inner = f"<div {wrapper}>{some(0.2)}{inner}{some(0.2)}</div>"
        foot = f"<footer>{self.text()}</footer>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{head if self.rng.random() < 0.5 else self.menu()}{some(0.3, 2)}{inner}{some(0.4, 3)}{foot}</body></html>"


def labelled(pages: int, seed: int) -> list[tuple[list[Block], list[bool]]]:
    """Blocks of made pages without the mark, and which of them are content."""
    grammar, out = Grammar(seed), []
    for _ in range(pages):
        found = Page(grammar.page()).blocks()
        labels = [MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "") or " "
            b.linked = min(b.linked, len(b.text))
        out.append((found, labels))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


@lru_cache(4)
def fitted(pages: int = PAGES, seed: int = SEED) -> Model:
    """Weights fitted on ``pages`` made pages, and of a few smoothnesses the one with fewest errors on a third as many others."""
    train, held = labelled(pages, seed), labelled(pages // 3, seed + 1)
    x, y = np.vstack([features(b) for b, _ in train if b]), np.concatenate([np.array(s, float) for b, s in train if b])
    weights = tuple(np.round(logistic(x, y), 6).tolist())
    assert len(weights) == len(FEATURES)
    models = [Model(weights, across, within) for across in (0.0, 0.1, 0.3) for within in (1.0, 2.0, 3.0)]
    errors = [sum(a != b for blocks, want in held for a, b in zip(m.labels(blocks), want, strict=True)) for m in models]
    return models[int(np.argmin(errors))]
