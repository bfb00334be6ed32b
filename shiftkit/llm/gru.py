"""A bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Words of a window and words from one window's start to the next, so neighbours share WINDOW - STRIDE words.
WINDOW, STRIDE = 48, 36
#: Width of an embedding, of a direction's state, of the attention; buckets of the character n-grams; bytes of a step and its two marks.
DIM, HIDDEN, ATTEND, BUCKETS, WIDTH = 12, 8, 8, 4096, 24
#: Words whose n-grams are taken at a time: the arrays in between have about 1 KB a word.
SLICE = 4096


def steps(text: bytes) -> list[bytes]:
    """The steps of a text: its words, those above WIDTH - 2 bytes in pieces of so many, which share 3 bytes with the next.

    So each 3- and 4-byte n-gram of a word is in some piece, also in texts that have no spaces.
    """
    words, size = text.split(), WIDTH - 2
    if max(map(len, words), default=0) <= size:
        return words
    return [w[at : at + size] for w in words for at in range(0, max(1, len(w) - 3), size - 3)]


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-byte n-grams of ``^word$`` (a column per place) and the weight of each (mean)."""
    if len(words) > SLICE:
        grams, weight = zip(*(char_grams(words[i : i + SLICE]) for i in range(0, len(words), SLICE)))
        return np.concatenate(grams), np.concatenate(weight)
    m = np.array([b"^" + w[: WIDTH - 2] + b"$" for w in words], dtype=f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH).astype(np.uint32)
    n = np.array([min(len(w), WIDTH - 2) + 2 for w in words])
    at, ok = [], []
    for size in (3, 4):
        code = np.zeros((len(words), WIDTH - size + 1), np.uint32)
        for i in range(size):
            code = code * np.uint32(16777619) ^ m[:, i : WIDTH - size + 1 + i]
        code ^= code >> np.uint32(15)
        at.append((code * np.uint32(2654435761)) >> np.uint32(20))
        ok.append(np.arange(WIDTH - size + 1) + size <= n[:, None])
    valid = np.concatenate(ok, axis=1)
    return np.concatenate(at, axis=1).astype(np.uint16), (valid / np.maximum(valid.sum(axis=1, keepdims=True), 1)).astype(np.float16)


def start(vocabulary: int, seed: int) -> dict[str, np.ndarray]:
    """Random parameters; row 0 of ``word`` stands for all words outside the vocabulary."""
    rng = np.random.default_rng(seed)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"word": normal(vocabulary + 1, DIM, scale=0.1), "char": normal(BUCKETS, DIM, scale=0.3)}
    for d in "fb":
        p |= {f"x{d}": normal(2 * DIM, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return p | {"a": normal(2 * HIDDEN, ATTEND, scale=0.3), "v": normal(ATTEND, scale=0.5), "o": normal(2 * HIDDEN, scale=0.3), "o0": np.full(1, -1, np.float32)}


def inputs(p: dict, ids: np.ndarray, grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The input of each word: its own embedding next to the mean of its n-grams'."""
    chars = np.zeros((len(ids), DIM), np.float32)
    for i in range(grams.shape[1]):
        chars += p["char"][grams[:, i]] * weight[:, i : i + 1]
    return np.concatenate([p["word"][ids], chars], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _recur(pre: Iterable[np.ndarray], live: np.ndarray, u: np.ndarray, keep: bool) -> tuple[list[np.ndarray], list]:
    """States at each step of one direction; with ``keep`` also what :func:`_recur_back` needs."""
    h, states, kept = np.zeros((len(live), HIDDEN), np.float32), [], []
    for t, a in enumerate(pre):
        g = h @ u
        rz = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z, q = rz[:, :HIDDEN], rz[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * q)
        new = n + z * (h - n)
        m = live[:, t : t + 1]
        new = h + m * (new - h)
        if keep:
            kept.append((h, r, z, q, n, m))
        states.append(new)
        h = new
    return states, kept


def _recur_back(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs (steps first) and of ``u``."""
    d_pre, du, d = [], np.zeros_like(u), 0
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, q, n, m = kept[t]
        d = d + d_states[t]
        dn_pre = d * m * (1 - z) * (1 - n * n)
        dz = d * m * (h - n) * z * (1 - z)
        dr = dn_pre * q * r * (1 - r)
        d_pre.append(np.concatenate([dr, dz, dn_pre], axis=1))
        du_pre = np.concatenate([dr, dz, dn_pre * r], axis=1)
        du += h.T @ du_pre
        d = d * (1 - m) + d * m * z + du_pre @ u.T
    return np.stack(d_pre[::-1]), du


def forward(p: dict, rows: np.ndarray, live: np.ndarray, pre_f: np.ndarray, pre_b: np.ndarray, keep: bool = False):
    """Logit of each window. rows: each step's row in the projected inputs pre_f and pre_b; live: 1 at words."""
    n = rows.shape[1]
    f, kept_f = _recur((pre_f[rows[:, t]] for t in range(n)), live, p["uf"], keep)
    b, kept_b = _recur((pre_b[rows[:, t]] for t in range(n - 1, -1, -1)), live[:, ::-1], p["ub"], keep)
    h = np.concatenate([np.stack(f), np.stack(b[::-1])], axis=2)
    u = np.tanh(h @ p["a"])
    s = np.where(live.T > 0, u @ p["v"], -1e9)
    e = np.exp(s - s.max(axis=0)) * live.T
    alpha = e / np.maximum(e.sum(axis=0), 1e-9)
    c = (alpha[:, :, None] * h).sum(axis=0)
    return c @ p["o"] + p["o0"][0], (kept_f, kept_b, h, u, alpha, c)


def gradients(p: dict, rows: np.ndarray, live: np.ndarray, word_ids: np.ndarray, grams: np.ndarray, weight: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """Gradients of the weighted logistic loss for one batch; the words of the batch are given once each."""
    x = inputs(p, word_ids, grams, weight)
    logit, (kept_f, kept_b, h, u, alpha, c) = forward(p, rows, live, x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"], keep=True)
    dl = ((_sigmoid(logit) - y) * w / w.sum()).astype(np.float32)
    g = {"o": c.T @ dl, "o0": dl.sum(keepdims=True)}
    dc = dl[:, None] * p["o"]
    d_alpha = (h * dc).sum(axis=2)
    ds = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    du = ds[:, :, None] * p["v"] * (1 - u * u)
    g |= {"v": (ds[:, :, None] * u).sum(axis=(0, 1)), "a": np.einsum("tnh,tna->ha", h, du)}
    dh = alpha[:, :, None] * dc + du @ p["a"].T
    dx = 0
    for d, kept, states in (("f", kept_f, dh[:, :, :HIDDEN]), ("b", kept_b, dh[::-1, :, HIDDEN:])):
        d_pre, g[f"u{d}"] = _recur_back(states, kept, p[f"u{d}"])
        d_pre = d_pre if d == "f" else d_pre[::-1]
        by_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(by_word, rows.T.ravel(), d_pre.reshape(-1, 3 * HIDDEN))
        g[f"x{d}"], g[f"c{d}"] = x.T @ by_word, by_word.sum(axis=0)
        dx = dx + by_word @ p[f"x{d}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], word_ids, dx[:, :DIM])
    at = grams.ravel().astype(np.int64)
    for i in range(DIM):
        g["char"][:, i] = np.bincount(at, (dx[:, DIM + i, None] * weight).ravel(), BUCKETS)
    return g


def cut_windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all overlapping windows in the concatenation of texts, each followed by WINDOW pads; and their texts."""
    starts, owner, at = [], [], 0
    for i, n in enumerate(lengths):
        k = 1 + max(0, -(-(n - WINDOW) // STRIDE))
        starts.append(at + STRIDE * np.arange(k))
        owner.append(np.full(k, i))
        at += n + WINDOW
    return np.concatenate(starts), np.concatenate(owner)


class Network:
    """The fitted network: whole texts in, the probability of label 1 out."""

    def __init__(self, params: dict, vocabulary: dict[bytes, int], scale: tuple[float, float]) -> None:
        self.params, self.vocabulary, self.scale = params, vocabulary, scale
        self.forget()

    def forget(self) -> None:
        """Forget the words seen so far; row 0 of the projected inputs is the pad."""
        self.rows, self.fresh = {}, []
        self.pre = [np.zeros((1, 3 * HIDDEN), np.float32) for _ in range(2)]

    def number(self, words: list[bytes]) -> np.ndarray:
        """The row of each word; new words get the next rows."""
        for w in set(words).difference(self.rows):
            self.fresh.append(w)
            self.rows[w] = len(self.rows) + 1
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def project(self) -> None:
        """Project the inputs of the new words, once for all places they stand at."""
        if self.fresh:
            p, made = self.params, ([], [])
            for at in range(0, len(self.fresh), SLICE):
                words = self.fresh[at : at + SLICE]
                x = inputs(p, np.array([self.vocabulary.get(w, 0) for w in words]), *char_grams(words))
                for rows, d in zip(made, "fb", strict=True):
                    rows.append(x @ p[f"x{d}"] + p[f"c{d}"])
            self.pre = [np.concatenate([old, *rows]) for old, rows in zip(self.pre, made, strict=True)]
            self.fresh = []

    def logits(self, texts: list[np.ndarray], rows: int = 512) -> np.ndarray:
        """The largest logit of each text's windows; a text without words has the logit of an empty window."""
        self.project()
        pad = np.zeros(WINDOW, np.int32)
        stream = np.concatenate([x for t in texts for x in (t, pad)])
        starts, owner = cut_windows([len(t) for t in texts])
        out = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), rows):
            ids = stream[starts[at : at + rows, None] + np.arange(WINDOW)]
            out[at : at + rows] = forward(self.params, ids, (ids > 0).astype(np.float32), *self.pre)[0]
        return np.maximum.reduceat(out, np.searchsorted(owner, np.arange(len(texts))))

    def scores(self, texts: list[bytes], words: int = 50_000, known: int = 100_000) -> np.ndarray:
        """Probabilities of UTF-8 texts, about ``words`` steps at a time; more than ``known`` different ones are forgotten.

        A longer text is cut where a window starts, so its parts have the windows of the whole.
        """
        best, ids, owner, n = np.full(len(texts), -np.inf, np.float32), [], [], 0
        part, shared = -(-words // STRIDE) * STRIDE, WINDOW - STRIDE

        def flush() -> None:
            nonlocal ids, owner, n
            if ids:
                np.maximum.at(best, owner, self.logits(ids))
                ids, owner, n = [], [], 0
                if len(self.rows) > known:
                    self.forget()

        for i, text in enumerate(texts):
            of_text = steps(text)
            for at in range(0, max(1, len(of_text) - shared), part):
                ids.append(self.number(of_text[at : at + part + shared]))
                owner.append(i)
                n += len(ids[-1])
                if n >= words:
                    flush()
        flush()
        a, b = self.scale
        return _sigmoid(a * best.astype(np.float64) + b)


def log_odds(of_text: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """How much likelier each of n features is in positive texts than in negative ones (smoothed logarithm)."""
    counts = np.full((2, n), 0.5)
    for at, y in zip(of_text, labels, strict=True):
        counts[int(y), at] += 1
    totals = np.array([[(labels == 0).sum() + 1], [(labels == 1).sum() + 1]])
    ratio = np.log(counts / totals)
    return np.clip((ratio[1] - ratio[0]) / 2, -1.5, 1.5).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, least: int = 3, seed: int = 1) -> Network:
    """Fit the network to whole texts with a label each.

    Which window makes a text toxic is unknown, so a positive text teaches by its highest window, a
    negative one by its highest and by random ones; in the first epoch positive texts teach by all.
    Words (steps, see :func:`steps`) in ``least`` texts or more have an embedding of their own. The first number of each embedding starts
    as the log odds of its word or n-gram between the labels. Deterministic.
    """
    rng = np.random.default_rng(seed)
    row: dict[bytes, int] = {}
    rows = [np.fromiter((row.setdefault(w, len(row) + 1) for w in steps(t)), np.int32) for t in texts]  # numbers, not words, are kept
    every, used = list(row), [np.unique(r) for r in rows]
    in_texts = np.bincount(np.concatenate(used), minlength=len(every) + 1)[1:]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in zip(every, in_texts, strict=True) if n >= least))}
    word_ids, (grams, weight) = np.array([0, *(vocabulary.get(w, 0) for w in every)]), char_grams([b"", *every])
    del row, every
    pad = np.zeros(WINDOW, np.int32)
    stream = np.concatenate([x for r in rows for x in (r, pad)])
    starts, owner = cut_windows([len(r) for r in rows])
    windows, y = stream[starts[:, None] + np.arange(WINDOW)], labels.astype(np.float32)
    p = start(len(vocabulary), seed)
    p["word"][:, 0] = log_odds([np.unique(word_ids[r]) for r in used], labels, len(vocabulary) + 1)
    p["word"][0] = 0
    p["char"][:, 0] = log_odds([np.unique(grams[r][weight[r] > 0]) for r in used], labels, BUCKETS)
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    first = np.searchsorted(owner, np.arange(len(texts)))

    def all_logits() -> np.ndarray:
        x = inputs(p, word_ids, grams, weight)
        pre_f, pre_b = x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"]
        return np.concatenate([forward(p, windows[i : i + 2048], (windows[i : i + 2048] > 0).astype(np.float32), pre_f, pre_b)[0] for i in range(0, len(windows), 2048)])

    for epoch in range(epochs):
        chosen = np.flatnonzero(rng.random(len(windows)) < 0.25)
        if epoch:
            logit = all_logits()
            order = np.lexsort((logit, owner))
            top = order[np.append(first[1:], len(windows)) - 1]
            chosen = np.concatenate([top, chosen[y[owner[chosen]] == 0]])
        else:
            chosen = np.union1d(chosen, np.flatnonzero(y[owner] == 1))
        target = y[owner[chosen]]
        balance = np.where(target == 1, max(1.0, (target == 0).sum() / max(1, (target == 1).sum()) / 3), 1.0)
        for at in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
            ids = windows[chosen[at]]
            words, places = np.unique(ids, return_inverse=True)
            g = gradients(p, places.reshape(ids.shape), (ids > 0).astype(np.float32), word_ids[words], grams[words], weight[words], target[at], balance[at])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1, 2 * (1 - epoch / epochs))
            for k, v in g.items():
                v = v * min(1, 1 / max(norm, 1e-9)) + 1e-5 * p[k]
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                p[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    best = np.maximum.reduceat(all_logits(), first).astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(50):  # a logistic curve over the highest logits, slightly drawn to the identity
        q = _sigmoid(a * best + b)
        s = q * (1 - q)
        hess = np.array([[(s * best * best).sum() + 1, (s * best).sum()], [(s * best).sum(), s.sum() + 1]])
        move = np.linalg.solve(hess, [((q - y) * best).sum() + (a - 1), (q - y).sum() + b])
        a, b = a - move[0], b - move[1]
    return Network({k: v.astype(np.float32) for k, v in p.items()}, vocabulary, (float(a), float(b)))
