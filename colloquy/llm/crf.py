"""Linear-chain conditional random field with two labels, trained on padded batches and decoded by Viterbi."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np


class Field(NamedTuple):
    """Scores of label 1 over label 0 for each feature, of label pairs, and of the first and last label."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def _expected(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Log of the normaliser of each chain, and the chances of labels at each place and of pairs, summed over places.

    Chains come longest first, so those that still run at a place are the first ones.
    """
    n, most = scores.shape[:2]
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    running = (lengths[:, None] > np.arange(most)).sum(0)
    forward[:, 0] = first + scores[:, 0]
    for t in range(1, most):
        k = running[t]
        forward[:k, t] = _logsum(forward[:k, t - 1, :, None] + pairs, 1) + scores[:k, t]
    backward[np.arange(n), lengths - 1] = last
    for t in range(most - 2, -1, -1):
        k = running[t + 1]
        backward[:k, t] = _logsum(pairs + (scores[:k, t + 1] + backward[:k, t + 1])[:, None, :], 2)
    total = _logsum(forward[np.arange(n), lengths - 1] + last, 1)
    chances = np.exp(forward + backward - total[:, None, None])
    together = np.zeros((2, 2))
    for t in range(1, most):
        k = running[t]
        together += np.exp(forward[:k, t - 1, :, None] + pairs + (scores[:k, t] + backward[:k, t])[:, None, :] - total[:k, None, None]).sum(0)
    return total, chances, together


def fit(chains: list[tuple[list[frozenset[str]], list[int]]], rounds: int = 250, penalty: float = 1e-5, rate: float = 0.25, least: int = 3) -> Field:
    """The field that makes the labels of `chains` most likely, less a penalty on the squares of its scores.

    A chain is the features of each place and its label. Features met in fewer than `least` places
    are left out. All chains take part in each of `rounds` steps, whose size each score's own
    gradients set; nothing is random.
    """
    chains = sorted((c for c in chains if c[1]), key=lambda c: -len(c[1]))
    if not chains:
        return Field({}, np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    met = Counter(f for places, _ in chains for said in places for f in said)
    names = sorted(f for f, n in met.items() if n >= least)
    number = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(labels) for _, labels in chains])
    labels = np.zeros((len(chains), lengths[0]), int)
    inside = lengths[:, None] > np.arange(lengths[0])
    labels[inside] = np.concatenate([y for _, y in chains])
    lists = [[number[f] for f in sorted(said) if f in number] for places, _ in chains for said in places]
    counts = np.array([len(x) for x in lists])
    flat, place = np.concatenate([np.array(x, int) for x in lists]), np.repeat(np.arange(len(lists)), counts)
    last_labels = labels[np.arange(len(chains)), lengths - 1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][inside[:, 1:]], labels[:, 1:][inside[:, 1:]]), 1)
    x = np.zeros(len(names) + 8)
    mean, square, size = np.zeros_like(x), np.zeros_like(x), len(lists)
    for step in range(1, rounds + 1):
        w, pairs, first, last = np.split(x, [len(names), len(names) + 4, len(names) + 6])
        scores = np.zeros((*labels.shape, 2))
        scores[..., 1][inside] = np.bincount(place, w[flat], len(lists))
        _, chances, together = _expected(scores, lengths, pairs.reshape(2, 2), first, last)
        off = (chances[..., 1] - labels)[inside]
        ends = chances[np.arange(len(chains)), lengths - 1]
        gradient = np.concatenate([
            np.bincount(flat, off[place], len(names)), (together - seen).ravel(),
            chances[:, 0].sum(0) - np.bincount(labels[:, 0], minlength=2), ends.sum(0) - np.bincount(last_labels, minlength=2),
        ]) / size + penalty * x
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        pace = rate * min(1, 2 * (1 - step / (rounds + 1)))
        x = x - pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    w, pairs, first, last = np.split(x, [len(names), len(names) + 4, len(names) + 6])
    return Field(dict(zip(names, w.tolist())), pairs.reshape(2, 2), first, last)


def decoded(scores: list[float], field: Field) -> list[int]:
    """The most likely labels by Viterbi, given each place's score of label 1 over label 0."""
    if not scores:
        return []
    (stay, come), (leave, go) = field.pairs.tolist()
    a, b = field.first[0], field.first[1] + scores[0]
    back = []
    for s in scores[1:]:
        to_a, to_b = leave + b > stay + a, go + b >= come + a
        back.append((to_a, to_b))
        a, b = (leave + b if to_a else stay + a), (go + b if to_b else come + a) + s
    label = int(b + field.last[1] >= a + field.last[0])
    labels = [label]
    for choice in reversed(back):
        label = int(choice[label])
        labels.append(label)
    return labels[::-1]
