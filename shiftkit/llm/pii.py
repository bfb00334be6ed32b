"""Personal data: patterns and a skip-chain conditional random field with loopy message passing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# Starts inside a run of digits or behind a failed run give nothing new, so runs are read whole and once;
# a text of any shape takes time in proportion to its length.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A token that can be part of personal data has a digit or an at sign; all others are outside, surely.
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_HINT = "[0-9@]"


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses, found from their at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns, by start and kind; matches that fail their check are dropped."""
    out = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


LABELS = ("out", *KINDS)
N = len(LABELS)


def features(token: str, before: str) -> list[str]:
    """What the field sees of a token: its shape's first 12 signs, counts, and the last 8 letters of the word before it (looked for in the
    24 characters before). No check sums, no ranges."""
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", token))
    digits = sum(map(str.isdigit, token))
    return ["bias", f"shape={shape[:12]}", f"digits={min(digits, 20)}", f"dots={min(token.count('.'), 4)}", f"at={'@' in token}", f"plus={token[:1] == '+'}", f"letters={any(map(str.isalpha, token))}", f"before={before[-8:].lower()}"]


#: Digits that make two numbers similar: the last so many are equal, and one number ends with the other.
TAIL = 7
#: A number is written in at most so many neighbouring tokens.
WINDOW = 6
_NUMBER = re.compile(r"[^A-Za-z@]*")


def graph(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], list[list[str]], list[tuple[int, int]], list[list[int]]]:
    """Tokens (spans without closing punctuation), their features, chain edges, and hubs.

    Chain edges join neighbouring tokens with only separators between. A hub stands for one entity and joins, however far apart, all tokens
    that are the same or similar: the parts of numbers that end in the same digits as a number of the base spans (see TAIL), addresses with
    the local part of one, and besides tokens of TAIL digits or more that repeat as they are.
    """
    spans, chain, feats, digits, words = [], [], [], [], []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".,;:!?\"'").lstrip("\"'")
        start = m.start() + len(m[0]) - len(m[0].lstrip("\"'"))
        i = len(spans)
        head = text[max(0, start - 24) : start].split()
        feats.append(features(token, head[-1] if head else ""))
        if i and not text[spans[-1][1] : start].strip(" "):
            chain.append((i - 1, i))
        spans.append((start, start + len(token)))
        words.append(token.lower())
        digits.append(re.sub(r"[^0-9]", "", token) if _NUMBER.fullmatch(token) else "")
    hubs: dict = {}
    known: dict[str, set[str]] = {}
    for lo, hi, kind in base:
        if kind in ("card", "phone"):
            number = re.sub(r"[^0-9]", "", text[lo:hi])
            known.setdefault(number[-TAIL:], set()).add(number)
    locals_ = {text[lo:hi].lower().split("@")[0] for lo, hi, kind in base if kind == "email"}
    follows = {j for _, j in chain}
    for i, word in enumerate(words):
        if "@" in word:
            local = word.split("@")[0]
            hubs.setdefault(("email", local) if local in locals_ and len(local) > 2 else word, set()).add(i)
        elif sum(map(str.isdigit, word)) >= TAIL:
            hubs.setdefault(word, set()).add(i)
        number = ""
        for j in range(i, min(i + WINDOW, len(words))):
            if not digits[j] or (j > i and j not in follows):
                break
            number += digits[j]
            for whole in known.get(number[-TAIL:], ()) if len(number) >= TAIL else ():
                if whole.endswith(number) or number.endswith(whole):
                    hubs.setdefault(("number", whole), set()).update(range(i, j + 1))
    return spans, feats, chain, [sorted(h) for h in hubs.values() if len(h) > 1]


class Field:
    """Weights of the field: a row of label scores for each feature, and one matrix for each sort of edge."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.node, self.chain, self.skip = np.zeros((0, N)), np.zeros((N, N)), agreement(np.zeros((N, N)))

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([sum((self.node[self.names[f]] for f in fs if f in self.names), np.zeros(N)) for fs in feats]).reshape(-1, N)

    def marginals(self, feats: list[list[str]], chain: list[tuple[int, int]], hubs: list[list[int]], damp: float = 0.3, known: np.ndarray | None = None, tolerance: float = 1e-4) -> np.ndarray:
        """Label probabilities of the tokens by loopy sum-product messages along chain edges and between tokens and their hubs.

        ``known`` has the labels of tokens inside pattern spans (0: none); they are evidence. In two steps it reaches all tokens of its hub.
        A hub's tokens without evidence are alike, so together they have one vote there: their messages count by one over
        their number. Messages go on until they change less than ``tolerance``, at most for as many rounds as the longest chain takes and thirty more.
        """
        own, n = self.scores(feats), len(feats)
        free = np.ones(n, bool)
        if known is not None:
            at = np.flatnonzero(known)
            own[at, known[at]] += 50
            free[at] = False
        own = np.concatenate([own, np.zeros((len(hubs), N))])
        joins = [(i, n + h) for h, members in enumerate(hubs) for i in members]
        votes = [1 / max(1, sum(free[i] for i in members)) for members in hubs]
        edges = np.array([*chain, *joins], dtype=np.int64).reshape(-1, 2)
        belief = own
        if len(edges):
            pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(joins), 0)])
            weight = np.array([1.0] * len(chain) + [votes[h - n] if free[i] else 1.0 for i, h in joins] + [1.0] * len(edges))[:, None]
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pot, back = np.concatenate([pot, pot.transpose(0, 2, 1)]), np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(src), N))
            for _ in range(30 + 2 * longest(chain)):
                belief = own.copy()
                np.add.at(belief, dst, message)
                x = (belief[src] - message[back])[:, :, None] + pot
                top = x.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
                new = (new - new.max(axis=1, keepdims=True)) * weight
                change = np.abs(new - message).max()
                message = damp * message + (1 - damp) * new
                if change < tolerance:
                    break
            belief = own.copy()
            np.add.at(belief, dst, message)
        belief = belief[:n]
        e = np.exp(belief - belief.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def agreement(counts: np.ndarray, agree: float = 100.0, differ: float = 1e-5) -> np.ndarray:
    """Potentials of a token's label and its hub's from how often they were seen together, with counts ahead of the data that say an entity
    has one label. Labels that are seen to differ weaken it."""
    seen = counts + np.where(np.eye(N) > 0, agree, differ)
    return np.log(seen / seen.sum(axis=0, keepdims=True))


def longest(chain: list[tuple[int, int]]) -> int:
    """Edges of the longest chain."""
    best = here = 0
    for (_, j), (i, _) in zip([(0, -1), *chain], chain, strict=False):
        here = here + 1 if i == j else 1
        best = max(best, here)
    return best


def silver(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """The label of each token: the kind of the base span it lies in, or out."""
    out, i = np.zeros(len(spans), np.int64), 0
    base = sorted(base)
    for t, (a, b) in enumerate(spans):
        while i < len(base) and base[i][1] <= a:
            i += 1
        if i < len(base) and base[i][0] < b:
            out[t] = LABELS.index(base[i][2])
    return out


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, least: int = 2) -> Field:
    """Fit the field to texts that the patterns label: token and chain weights by pseudo-likelihood, each token given its neighbours'
    labels; the hubs' potentials from the labels that tokens of one entity have.

    A token outside the patterns that shares a hub with one inside is no example of anything: that the patterns leave it out doesn't say what it is.
    """
    field, rows, y, left, counts, pairs = Field(), [], [], [], {}, np.zeros((N, N))
    for text in texts:
        base = base_spans(text)
        spans, feats, chain, hubs = graph(text, base)
        labels = silver(spans, base)
        use = np.ones(len(spans), bool)
        for members in hubs:
            told = labels[members]
            inside = told[told > 0]
            if len(inside):
                use[np.array(members)[told == 0]] = False
                label = int(np.bincount(inside).argmax())
                np.add.at(pairs, (inside, label), 1)
            else:
                pairs[0, 0] += len(members)
        sides = [np.zeros((len(spans), N)) for _ in range(2)]
        for i, j in chain:
            sides[0][j, labels[i]] += 1
            sides[1][i, labels[j]] += 1
        keep = np.flatnonzero(use)
        for i in keep:
            for f in feats[i]:
                counts[f] = counts.get(f, 0) + 1
        rows += [feats[i] for i in keep]
        y += labels[keep].tolist()
        left.append(np.concatenate(sides, axis=1)[keep])
    field.names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    field.node, field.skip = np.zeros((len(field.names), N)), agreement(pairs)
    if not rows:
        return field
    at = [(i, field.names[f]) for i, fs in enumerate(rows) for f in fs if f in field.names]
    r, c = (np.array(x) for x in zip(*at, strict=True))
    y, context = np.array(y), np.concatenate(left)
    truth = np.eye(N)[y]
    for _ in range(steps):
        s = np.zeros((len(y), N))
        np.add.at(s, r, field.node[c])
        s += context[:, :N] @ field.chain + context[:, N:] @ field.chain.T
        e = np.exp(s - s.max(axis=1, keepdims=True))
        wrong = (truth - e / e.sum(axis=1, keepdims=True)) / len(y)
        g = np.zeros_like(field.node)
        np.add.at(g, c, wrong[r])
        field.node += rate * (g - 1e-4 * field.node)
        field.chain += rate * (context[:, :N].T @ wrong + wrong.T @ context[:, N:] - 1e-4 * field.chain)
    return field


def added_spans(text: str, base: list[Span], field: Field, sure: float) -> list[Span]:
    """Spans the field adds: runs of tokens of one kind with a probability above ``sure``, apart from all base spans."""
    spans, feats, chain, hubs = graph(text, base)
    if not spans:
        return []
    known = silver(spans, base)
    p = field.marginals(feats, chain, hubs, known=known)
    kind, linked, out = np.where(p[:, 1:].max(axis=1) >= sure, p[:, 1:].argmax(axis=1), -1), set(chain), []
    free = known == 0
    for i, (a, b) in enumerate(spans):
        if kind[i] < 0 or not free[i]:
            continue
        k = KINDS[kind[i]]
        if out and out[-1][2] == k and (i - 1, i) in linked and out[-1][1] == spans[i - 1][1]:
            out[-1] = (out[-1][0], b, k)
        else:
            out.append((a, b, k))
    return out


def fit_field(docs: DataFrame, sample: int = 2000, most_chars: int = 20_000) -> Field:
    """Fit on a bounded sample: ``sample`` documents of at most ``most_chars`` with a digit or at sign, by hash of doc_id."""
    hinted = docs.select("text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("draw")).where(F.col("text").rlike(_HINT) & (F.length("text") <= most_chars))
    drawn = hinted.select("draw").distinct().orderBy("draw").limit(sample)  # numbers only: each task sends its best to one place
    rows = hinted.join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["draw"])])


def find_personal(docs: DataFrame, sure: float = 0.9, sample: int = 2000) -> DataFrame:
    """Personal data of every whole text: ``doc_id, base, added``, arrays of ``start, end, kind`` in code points.

    ``base`` has the spans of the patterns. ``added`` has what the field finds besides: its tokens are joined to their neighbours
    and, however far apart, through one hub an entity to the same or similar tokens of the document, and messages along these edges
    bring their labels to agree; so a number written without its mark is found, however often, if the document shows elsewhere what it
    is. The field learns from what the patterns label in ``sample`` documents. A text without digits and at
    signs has no spans.

    A null text is empty. Repeated rows are searched alike; a null doc_id stays null. An empty table gives no rows;
    further columns are ignored.
    """
    ship_by_value()
    field, hint = fit_field(docs, sample), re.compile(_HINT)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            base = [base_spans(t) if t and hint.search(t) else [] for t in batch["text"]]
            more = [added_spans(t, b, field, sure) if t and hint.search(t) else [] for t, b in zip(batch["text"], base, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [as_rows(b) for b in base], "added": [as_rows(m) for m in more]})

    span = "array<struct<start: long, end: long, kind: string>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, f"doc_id long, base {span}, added {span}")
