"""Trains the block labeller on generated pages and writes its weights: python -m quern.llm.train_labeller

About half a minute of CPU. The seeds are fixed, so the same library versions give the same weights.
"""

from __future__ import annotations

import numpy as np

from quern.llm.html import INPUT, WEIGHTS, Labeller, blocks, is_marked, vectors
from quern.llm.html_pages import training_pages

#: Pages that the labeller is trained on.
TRAIN_PAGES = 16_000


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, live = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], live[: len(page), k] = page, True
    return x, live


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Train on pages of block vectors and their labels, with Adam steps over pages of like length."""
    net, rng = Labeller(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    order = np.argsort([len(p) for p in pages], kind="stable")
    groups = [order[k : k + batch] for k in range(0, len(order), batch)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, live = padded([pages[i] for i in groups[k]])
            y = np.zeros(live.shape, np.float32)
            for column, i in enumerate(groups[k]):
                y[: len(labels[i]), column] = labels[i]
            _, g = net.gradients(x, live, y)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                by = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                net.p[name] = (net.p[name] - rate * 0.7**epoch * by).astype(np.float32)
    return net


def train(pages: int = TRAIN_PAGES) -> Labeller:
    """A labeller for generated pages, with weights of half precision as they are stored."""
    made = [page for page in map(blocks, training_pages(pages)) if page.texts]
    net = fit([vectors(page) for page in made], [is_marked(page) for page in made])
    net.p = {name: weight.astype(np.float16).astype(np.float32) for name, weight in net.p.items()}
    return net


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{name: weight.astype(np.float16) for name, weight in train().p.items()})
