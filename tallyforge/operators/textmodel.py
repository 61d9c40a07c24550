"""A small text classifier over exact TF-IDF vocabularies: what one task trains or applies, and the steps that several tasks share.

Word 1-2-grams and character 3-5-grams within words are two blocks, each of unit length; the labels' logistic regressions are one
against the rest, trained by scaled gradient steps over sparse rows, so equal rows give equal weights in any order.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_WORD = re.compile(r"\b\w\w+\b")
#: Shortest and longest character grams, rows a term must be in, rows a label must have, and what a weight loses.
SHORTEST, LONGEST, LEAST_ROWS, LEAST_LABELS, PENALTY = 3, 5, 2, 2, 1e-5
#: Steps of the training, and how far a step goes.
ROUNDS, RATE = 150, 0.5


def word_terms(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def char_terms(text: str) -> list[str]:
    """Of each word between blanks all grams; a word not longer than a gram gives itself once and no longer grams."""
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(SHORTEST, LONGEST + 1):
            out += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
            if len(padded) <= n:
                break
    return out


BLOCKS = (word_terms, char_terms)


def counted(texts: list[str], numbers: list[int]) -> list[Counter[str]]:
    """Of each block the rows that each term is in."""
    out = []
    for terms in BLOCKS:
        rows: Counter[str] = Counter()
        for text, number in zip(texts, numbers, strict=True):
            for t in set(terms(text)):
                rows[t] += number
        out.append(rows)
    return out


class Vectors:
    """Rows of (place, weight) for texts, by the vocabularies of the texts it was fitted to."""

    def __init__(self, texts: list[str], numbers: list[int] | None = None):
        """Each text is so many rows."""
        numbers = [1] * len(texts) if numbers is None else numbers
        self._hold(counted(texts, numbers), sum(numbers))

    @classmethod
    def of_counts(cls, counts: list[Counter[str]], total: int) -> Vectors:
        """Of each block the rows that each term is in, of so many rows in all."""
        made = cls.__new__(cls)
        made._hold(counts, total)
        return made

    def _hold(self, counts: list[Counter[str]], total: int) -> None:
        self.places: list[dict[str, int]] = []
        idf: list[float] = []
        for rows in counts:
            kept = sorted(t for t, n in rows.items() if n >= LEAST_ROWS)
            self.places.append({t: len(idf) + i for i, t in enumerate(kept)})
            idf += [np.log((1 + total) / (1 + rows[t])) + 1 for t in kept]
        self.idf = np.array(idf)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, place, weight of all terms; sublinear counts times idf, of unit length in each block."""
        rows, columns, weights = [], [], []
        for i, text in enumerate(texts):
            for terms, places in zip(BLOCKS, self.places, strict=True):
                counts = sorted((places[t], n) for t, n in Counter(terms(text)).items() if t in places)
                if counts:
                    at = np.array([p for p, _ in counts])
                    w = (1 + np.log([n for _, n in counts])) * self.idf[at]
                    rows.append(np.full(len(at), i))
                    columns.append(at)
                    weights.append(w / np.sqrt(w @ w))
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(columns), np.concatenate(weights)) if rows else (none, none, np.zeros(0))


class Block:
    """Rows that a model learns from: vectors, places of their labels, and their shares of all rows."""

    def __init__(self, vectors: Vectors, texts: list[str], places: list[int], shares: np.ndarray):
        self.row, self.column, self.weight = vectors.of(texts)
        self.target, self.share = np.array(places), shares

    def slopes(self, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What these rows add to the slopes of each label's weights and bias; blocks of rows add up."""
        n, (labels, terms) = len(self.target), weights.shape
        gw, gb = np.zeros((labels, terms)), np.zeros(labels)
        for k in range(labels):
            z = np.bincount(self.row, weights[k][self.column] * self.weight, n) + bias[k]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - (self.target == k)) * self.share
            gw[k], gb[k] = np.bincount(self.column, g[self.row] * self.weight, terms), g.sum()
        return gw, gb


class TextModel:
    """Labels in order, their weights by term, and biases. Labels with one row only are left out; fewer than two labels make no model."""

    def __init__(self, texts: list[str], labels: list[str], numbers: list[int] | None = None, rounds: int = ROUNDS):
        """Each text with its label is so many rows."""
        numbers = [1] * len(texts) if numbers is None else numbers
        support: Counter[str] = Counter()
        for y, n in zip(labels, numbers, strict=True):
            support[y] += n
        each: Counter[tuple[str, str]] = Counter()
        for t, y, n in zip(texts, labels, numbers, strict=True):
            if support[y] >= LEAST_LABELS:
                each[t, y] += n
        self.labels = sorted({y for _, y in each})
        self.ready = len(self.labels) >= 2
        if not self.ready:
            return
        # sums then do not depend on the order that rows come in; equal rows are one that weighs as much as they are
        rows, numbers = map(list, zip(*sorted(each.items()), strict=True))
        self._begin(Vectors([t for t, _ in rows], numbers))
        block = self.block([t for t, _ in rows], [y for _, y in rows], numbers, sum(numbers))
        for _ in range(rounds):
            self.step(*block.slopes(self.weights, self.bias))
        self.end()

    @classmethod
    def begun(cls, labels: list[str], vectors: Vectors) -> TextModel:
        """A model before its first step, for labels and terms that were counted elsewhere."""
        made = cls.__new__(cls)
        made.labels, made.ready = labels, True
        made._begin(vectors)
        return made

    def _begin(self, vectors: Vectors) -> None:
        self.vectors, shape = vectors, (len(self.labels), len(vectors.idf))
        self.weights, self.bias = np.zeros(shape), np.zeros(shape[0])
        self._seen = np.full(shape, 1e-8), np.full(shape[0], 1e-8)

    def block(self, texts: list[str], labels: list[str], numbers: list[int], total: int) -> Block:
        place = {y: i for i, y in enumerate(self.labels)}
        return Block(self.vectors, texts, [place[y] for y in labels], np.array(numbers) / total)

    def step(self, gw: np.ndarray, gb: np.ndarray) -> None:
        """One step against the slopes of all rows."""
        gw = gw + PENALTY * self.weights
        seen_w, seen_b = self._seen
        seen_w += gw * gw
        seen_b += gb * gb
        self.weights = self.weights - RATE * gw / np.sqrt(seen_w)
        self.bias = self.bias - RATE * gb / np.sqrt(seen_b)

    def end(self) -> None:
        """What only training needs is not held any longer."""
        del self._seen

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts x labels): each label's own, divided by their sum."""
        row, column, weight = self.vectors.of(texts)
        z = np.stack([np.bincount(row, w[column] * weight, len(texts)) + b for w, b in zip(self.weights, self.bias, strict=True)], 1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p / p.sum(1, keepdims=True)
