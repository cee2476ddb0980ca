"""A linear-chain conditional random field in numpy: binary features, trained by gradient ascent, decoded by Viterbi over batches of sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Padded positions decoded at once; positions of a piece of a long sequence.
POSITIONS, CUT = 1 << 17, 128


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class LinearChain:
    """``emit`` (features x labels), ``move`` (label x next label), ``start`` (labels)."""

    def __init__(self, n_features: int, n_labels: int):
        self.emit, self.move, self.start = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)

    def scores(self, features: Sequence[Sequence[int]]) -> np.ndarray:
        """(positions x labels) sums of the weights of each position's features."""
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((f for x in features for f in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(features)), sizes)
        return np.stack([np.bincount(owner, self.emit[flat, k], len(features)) for k in range(self.emit.shape[1])], axis=1)

    @staticmethod
    def padded(scores: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of sequences of like length: (their numbers, their lengths, scores padded with zeros). A sequence begins at its place in ``starts``."""
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * lengths[order[to]] <= POSITIONS:
                to += 1
            which = order[at:to]
            own = lengths[which]
            place = np.arange(int(own.max(initial=0)))[None, :]
            index = np.minimum(starts[which][:, None] + place, max(0, len(scores) - 1))
            yield which, own, np.where((place < own[:, None])[..., None], scores[index], 0.0) if len(scores) else np.zeros((len(which), 0, scores.shape[1]))
            at = to

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each position; scores holds the sequences end to end.

        A sequence longer than CUT is decoded in pieces side by side, each once for every label that may stand before it: a piece is then a
        max-plus matrix from the label before to its last label, the matrices' product along the sequence settles the labels at the cuts, and each
        piece is traced back from there. Time is linear in the positions, whatever the lengths.
        """
        n_labels = scores.shape[1]
        starts, out = np.cumsum(lengths) - lengths, np.zeros(len(scores), np.int8)
        counts = -(-lengths // CUT)
        owner = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        piece_start, piece_length = starts[owner] + nth * CUT, np.minimum(CUT, lengths[owner] - nth * CUT)
        # a first piece begins with the start weights; a later one is decoded for each label before it
        ways = np.where(nth == 0, 1, n_labels)
        first_run = np.cumsum(ways) - ways
        piece = np.repeat(np.arange(len(owner)), ways)
        before = np.where(nth[piece] == 0, -1, np.arange(len(piece)) - first_run[piece])
        begin, length = piece_start[piece], piece_length[piece]
        offset = np.cumsum(length) - length
        back, ends = np.zeros((int(length.sum()), n_labels), np.int8), np.zeros((len(piece), n_labels))
        entry = np.concatenate([self.move, self.start[None]])  # the last row, -1, is the start
        for which, own, x in self.padded(scores, length, begin):
            best = x[:, 0] + entry[before[which]]
            for t in range(1, x.shape[1]):
                steps = best[:, :, None] + self.move[None]
                live = t < own
                back[offset[which[live]] + t] = steps.argmax(axis=1)[live]
                best = np.where(live[:, None], steps.max(axis=1) + x[:, t], best)
            ends[which] = best
        run, label = first_run.copy(), np.zeros(len(owner), np.int64)
        last = np.cumsum(counts) - 1
        single = np.flatnonzero(counts == 1)
        label[last[single]] = ends[first_run[last[single]]].argmax(axis=1)
        for k in np.flatnonzero(counts > 1).tolist():
            a, b = int(last[k] - counts[k] + 1), int(last[k])
            total, came = ends[first_run[a]], np.zeros((b - a + 1, n_labels), np.int64)
            for p in range(a + 1, b + 1):
                paths = total[:, None] + ends[first_run[p] : first_run[p] + n_labels]
                came[p - a], total = paths.argmax(axis=0), paths.max(axis=0)
                total -= total.max()  # a difference is all that counts; sums of long sequences stay small
            label[b] = total.argmax()
            for p in range(b, a, -1):
                label[p - 1] = came[p - a, label[p]]
                run[p] = first_run[p] + label[p - 1]
        for t in range(int(piece_length.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero(t < piece_length)
            out[piece_start[live] + t] = label[live]
            if t:
                label[live] = back[offset[run[live]] + t, label[live]]
        return out

    def fit(self, features: Sequence[Sequence[Sequence[int]]], labels: Sequence[Sequence[int]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> LinearChain:
        """Adam on the mean log-likelihood of the labelled sequences less an L2 term; a small table, so every round takes it whole."""
        flat = [p for s in features for p in s]
        lengths = np.array([len(s) for s in features])
        gold = np.concatenate([np.asarray(x) for x in labels])
        owner = np.repeat(np.arange(len(flat)), [len(p) for p in flat])
        ids = np.array([f for p in flat for f in p])
        n, first = self.emit.shape[1], np.cumsum(lengths) - lengths
        pairs = np.setdiff1d(np.arange(len(flat)), first)
        weights = [self.emit, self.move, self.start]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, rounds + 1):
            scores = self.scores(flat)
            marginal, joint = np.zeros_like(scores), np.zeros((n, n))
            for a, length in zip(first, lengths, strict=True):
                x = scores[a : a + length]
                ahead, behind = np.zeros_like(x), np.zeros_like(x)
                ahead[0] = x[0] + self.start
                for t in range(1, length):
                    ahead[t] = logsumexp(ahead[t - 1][:, None] + self.move, 0) + x[t]
                for t in range(length - 2, -1, -1):
                    behind[t] = logsumexp(self.move + (x[t + 1] + behind[t + 1])[None], 1)
                total = logsumexp(ahead[-1], 0)
                marginal[a : a + length] = np.exp(ahead + behind - total)
                for t in range(1, length):
                    joint += np.exp(ahead[t - 1][:, None] + self.move + (x[t] + behind[t])[None] - total)
            off = -marginal
            off[np.arange(len(gold)), gold] += 1
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[pairs - 1], gold[pairs]), 1)
            grads = [np.stack([np.bincount(ids, off[owner, k], len(self.emit)) for k in range(n)], 1), seen - joint, off[first].sum(axis=0)]
            for w, g, (m, v) in zip(weights, grads, state, strict=True):
                g = g / len(lengths) - decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self
