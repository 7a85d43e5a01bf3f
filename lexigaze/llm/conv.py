"""A small convolutional network over bytes in numpy, with learned filters, max pooling and Adam."""

from __future__ import annotations

import numpy as np

_VOWELS = b"aeiouyAEIOUY"


def byte_features() -> np.ndarray:
    """Fixed description of the 256 bytes: classes, and a few pseudo-random coordinates that tell letters apart."""
    b = np.arange(256)
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    blank, line = (b == 32) | (b == 9), (b == 10) | (b == 13)
    symbol = np.isin(b, list(b"#*$%&|<>@^~\\{}[]"))
    mark = np.isin(b, list(b".,;:!?'\"()-"))
    classes = np.stack([lower, upper, digit, blank, line, symbol, mark, b >= 128, np.isin(b, list(_VOWELS)), np.isin(b, list(b"=:+/_"))], 1)
    spread = np.sin(np.outer(b + 1.0, [12.9898, 78.233, 37.719, 4.581])) * 43758.5453
    table = np.concatenate([classes, spread - np.floor(spread) - 0.5], 1).astype(np.float32)
    table[0] = 0  # padding
    return table


BYTES = byte_features()


class ConvNet:
    """relu(filters over windows) -> max over each segment -> max and mean over a text's segments -> one logit.

    ``regions`` splits a segment's positions into that many parts, pooled apart.
    """

    def __init__(self, width: int, stride: int, filters: int, regions: int = 1, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.stride, self.regions = width, stride, regions
        size = width * BYTES.shape[1]
        self.filters = (rng.standard_normal((size, filters)) * np.sqrt(2.0 / size)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = (rng.standard_normal(2 * filters * regions) * 0.05).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0  # calibration of the logit

    def windows(self, segments: np.ndarray) -> np.ndarray:
        """(segments, positions, width * features) of the byte rows, ending at the last whole stride."""
        x = BYTES[segments]
        n, length, e = x.shape
        count = (length - self.width) // self.stride + 1
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, count, self.width * e), (s[0], s[1] * self.stride, s[2]), writeable=False)

    def pooled(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest response of each filter in each region of each segment, its place, and the windows."""
        view = self.windows(segments)
        n, count, size = view.shape
        win = view.reshape(n * count, size)
        hidden = (win @ self.filters).reshape(n, count, -1)
        cuts = np.linspace(0, count, self.regions + 1).astype(int)
        tops, places = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = hidden[:, a:b]
            at = part.argmax(1)
            tops.append(np.take_along_axis(part, at[:, None], 1)[:, 0] + self.bias)
            places.append(at + a)
        top = np.stack(tops, 1)
        return np.maximum(top, 0), np.stack(places, 1), win.reshape(n, count, size)

    def highest(self, segments: np.ndarray) -> np.ndarray:
        view = self.windows(segments)
        n, count, size = view.shape
        hidden = (view.reshape(n * count, size) @ self.filters).reshape(n, count, -1)
        cuts = np.linspace(0, count, self.regions + 1).astype(int)
        return np.maximum(np.stack([hidden[:, a:b].max(1) for a, b in zip(cuts[:-1], cuts[1:])], 1) + self.bias, 0)

    def combine(self, top: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features of the texts whose segments start at ``first``."""
        flat = top.reshape(len(top), -1)
        counts = np.diff(np.append(first, len(flat)))[:, None]
        return np.concatenate([np.maximum.reduceat(flat, first), np.add.reduceat(flat, first) / counts], 1)

    def logits(self, segments: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.combine(self.highest(segments), first) @ self.out + self.shift[0]

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.offset, -30, 30)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int, batch: int = 64,
              rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> None:
        """``texts``: the segments of each text. Adam on the weighted logistic loss."""
        rng = np.random.default_rng(seed)
        params = [self.filters, self.bias, self.out, self.shift]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                counts = np.array([len(texts[i]) for i in some])
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))
                grads = self._gradients(np.concatenate([texts[i] for i in some]), first, counts, labels[some], weights[some])
                step += 1
                lr = rate * (1 - 0.9 * epoch / max(epochs, 1))
                for p, g, a, b in zip(params, grads, m, v):
                    g = g + decay * p
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= lr * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, segments, first, counts, labels, weights):
        top, places, win = self.pooled(segments)
        n, regions, filters = top.shape
        flat = top.reshape(n, -1)
        features = self.combine(top, first)
        z = features @ self.out + self.shift[0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / weights.sum()
        g_out = features.T @ d
        width = regions * filters
        owner = np.repeat(np.arange(len(first)), counts)
        back = d[owner, None] * self.out[width:] / counts[owner, None]
        best = flat == features[owner, :width]
        ties = np.add.reduceat(best.astype(np.float32), first)[owner]
        back = (back + best * d[owner, None] * self.out[:width] / ties) * (flat > 0)
        back = back.reshape(n, regions, filters).astype(np.float32)
        g_filters = np.zeros_like(self.filters)
        rows = np.arange(n)
        for f in range(filters):
            for r in range(regions):
                g_filters[:, f] += back[:, r, f] @ win[rows, places[:, r, f]]
        return g_filters, back.sum((0, 1)), g_out.astype(np.float32), np.array([d.sum()], np.float32)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> None:
        """Slope and offset of the logit by Newton steps on held-back rows."""
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            g = weights * (p - labels)
            h = weights * p * (1 - p)
            ga, gb = (g * logits).sum() + 1e-2 * (a - 1), g.sum() + 1e-2 * b
            haa, hab, hbb = (h * logits * logits).sum() + 1e-2, (h * logits).sum(), h.sum() + 1e-2
            det = haa * hbb - hab * hab
            if det < 1e-12:
                break
            a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
        self.scale, self.offset = max(float(a), 0.05), float(b)


def overlapping(data: np.ndarray, length: int, overlap: int) -> np.ndarray:
    """Rows of ``length`` bytes that cover all of ``data`` with ``overlap`` bytes in common; the last is padded with zeros."""
    step = length - overlap
    rows = max(1, -(-max(len(data) - overlap, 1) // step))
    padded = np.zeros(rows * step + overlap, np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::step]
