"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The network is trained here, in numpy, on windows around spans that the patterns
mark, in their own form and in changed forms (an address spelt out, a number
with other separators). Texts are decoded in overlapping windows; every
character takes the label of the window in whose middle it lies nearest, and
spans are read from the labels of the whole text.

A span must hold a digit, an ``@`` or an "at" in brackets and may not be longer than ``LONGEST``. So
only windows that can reach such a character need decoding: the result is the
same as from all windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- fixed patterns --------------------------------------------------------------
# Each is written so that its leftmost matches are found in one pass, also in very long runs.

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")  # what every form of ``varied`` holds
WRITTEN_OUT = re.compile(r"[A-Za-z0-9._%+-]+\s?[\[(]at[\])]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PLAIN_ANCHOR = re.compile(r"[0-9@]")  # windows around others train as no span


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    found: list[Span] = []
    at = text.find("@")
    free = 0  # where the last address ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        # A part may be longer than int() accepts; leading zeros do not change a value.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- network ---------------------------------------------------------------------

SINGLE = "abcdefghijklmnopqrstuvwxyz0123456789 @.-+()_%/:=\"',[]{}#*\n"
CLASS = {c: i + 1 for i, c in enumerate(SINGLE)}
PAD, LETTER, OTHER = 0, len(SINGLE) + 1, len(SINGLE) + 2
CLASSES = len(SINGLE) + 3
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STEP = 96, 48
LONGEST = 64
HIDDEN = 16
DECODED = 512  # windows decoded at a time
TRAIN_DOCS, TRAIN_WINDOWS = 800, 1800  # bounds of the sample
EPOCHS, BATCH, RATE = 12, 32, 0.03
MARGIN = 0.5  # a span is added if its labels beat "O" by this much per character


def char_classes(text: str) -> np.ndarray:
    """Class of each character; letters count in lower case."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(codes, 128)].copy()
    for i in np.flatnonzero(codes >= 128):
        out[i] = LETTER if text[i].isalpha() else OTHER
    return out


_ASCII = np.array([CLASS.get(chr(c).lower(), OTHER) for c in range(128)] + [OTHER])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Cell:
    """One direction of the LSTM over a batch of windows (time, batch)."""

    def __init__(self, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
        self.wx, self.wh, self.b = wx, wh, b

    def forward(self, x: np.ndarray, keep: bool = False):
        steps, n = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps):
            z = self.wx[x[t]] + h @ self.wh + self.b
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                saved.append((h, c, i, f, o, g, squashed))
            c, h = new, o * squashed
            out[t] = h
        return out, saved

    def backward(self, x: np.ndarray, saved, slope: np.ndarray):
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh = np.zeros_like(slope[0])
        dc = np.zeros_like(slope[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, squashed = saved[t]
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1
            )
            np.add.at(dwx, x[t], dz)
            dwh += h.T @ dz
            db += dz.sum(0)
            dh, dc = dz @ self.wh.T, dc * f
        return [dwx, dwh, db]


def allowed() -> np.ndarray:
    """Scores of transitions: an inside label follows only its own kind."""
    t = np.zeros((LABELS, LABELS), np.float32)
    for to in range(2, LABELS, 2):
        t[:, to] = -1e4
        t[to - 1, to] = t[to, to] = 0.0
    return t


@dataclass
class Tagger:
    params: list[np.ndarray]  # forward wx, wh, b; backward wx, wh, b; output weights, bias; transitions

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Label scores of windows ``x`` (time, batch)."""
        p = self.params
        ahead, saved_a = Cell(*p[0:3]).forward(x, keep)
        behind, saved_b = Cell(*p[3:6]).forward(x[::-1], keep)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        return both @ p[6] + p[7], (both, saved_a, saved_b)

    def loss(self, x: np.ndarray, y: np.ndarray):
        """Negative log-likelihood of the label sequences per character, and its slopes."""
        p = self.params
        e, (both, saved_a, saved_b) = self.emissions(x, keep=True)
        steps, n, _ = e.shape
        trans = p[8] + allowed()
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            m = alpha[t - 1][:, :, None] + trans
            top = m.max(1)
            alpha[t] = e[t] + top + np.log(np.exp(m - top[:, None, :]).sum(1))
        top = alpha[-1].max(1, keepdims=True)
        logz = (top + np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)))[:, 0]
        beta = np.zeros((n, LABELS), np.float32)
        de = np.empty_like(e)
        dtrans = np.zeros_like(p[8])
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - logz[:, None])
            if t:
                ahead = e[t] + beta
                joint = alpha[t - 1][:, :, None] + trans + ahead[:, None, :] - logz[:, None, None]
                dtrans += np.exp(joint).sum(0)
                m = trans[None] + ahead[:, None, :]
                top = m.max(2)
                beta = top + np.log(np.exp(m - top[:, :, None]).sum(2))
        rows = np.arange(n)
        score = e[0, rows, y[0]].copy()
        de[0, rows, y[0]] -= 1
        for t in range(1, steps):
            score += e[t, rows, y[t]] + trans[y[t - 1], y[t]]
            de[t, rows, y[t]] -= 1
            np.add.at(dtrans, (y[t - 1], y[t]), -1)
        size = np.float32(steps * n)
        de /= size
        grads = [np.tensordot(both, de, ([0, 1], [0, 1])), de.sum((0, 1)), dtrans / size]
        dboth = de @ p[6].T
        ahead = Cell(*p[0:3]).backward(x, saved_a, dboth[:, :, :HIDDEN])
        behind = Cell(*p[3:6]).backward(x[::-1], saved_b, dboth[::-1, :, HIDDEN:])
        return float((logz - score).sum() / size), [*ahead, *behind, *grads]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (time, batch) of windows, and how much each label's score beats that of O."""
        e, _ = self.emissions(x)
        steps, n, _ = e.shape
        trans = self.params[8] + allowed()
        back = np.empty((steps, n, LABELS), np.int8)
        best = e[0]
        for t in range(1, steps):
            m = best[:, :, None] + trans
            back[t] = m.argmax(1)
            best = e[t] + m.max(1)
        labels = np.empty((steps, n), np.int64)
        labels[-1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            labels[t - 1] = back[t, rows, labels[t]]
        lead = np.take_along_axis(e, labels[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return labels, lead


def new_tagger(seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)

    def matrix(rows: int, cols: int) -> np.ndarray:
        return (rng.standard_normal((rows, cols)) * np.sqrt(1 / max(HIDDEN, 1)) * 0.6).astype(np.float32)

    params = []
    for _ in range(2):
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        params += [matrix(CLASSES, 4 * HIDDEN), matrix(HIDDEN, 4 * HIDDEN), bias]
    params += [matrix(2 * HIDDEN, LABELS), np.zeros(LABELS, np.float32), np.zeros((LABELS, LABELS), np.float32)]
    return Tagger(params)


def fit_tagger(x: np.ndarray, y: np.ndarray) -> Tagger:
    """Adam over windows ``x`` and their labels ``y`` (rows are windows); without windows, the start values."""
    tagger = new_tagger()
    rng = np.random.default_rng(12)
    m = [np.zeros_like(p) for p in tagger.params]
    v = [np.zeros_like(p) for p in tagger.params]
    step, total = 0, EPOCHS * max(1, -(-len(x) // BATCH))
    for _ in range(EPOCHS if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _, grads = tagger.loss(x[rows].T, y[rows].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                lead = m[k] / (1 - 0.9**step)
                tagger.params[k] = (tagger.params[k] - rate * lead / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return tagger


# --- training data ---------------------------------------------------------------


def varied(kind: str, text: str, pick: int) -> str:
    """A changed form of a span that is the same personal data; ``pick`` chooses which."""
    if kind == "email":
        name, _, domain = text.partition("@")
        return [f"{name} [at] {domain}", f"{name} @ {domain}", f"{name}(at){domain}"][pick % 3]
    if kind == "ip":
        return [text.replace(".", "[.]"), text.replace(".", " . "), text.replace(".", "-")][pick % 3]
    digits = digits_of(text)
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".", "/", "_"][pick % 3].join(groups)
    if len(digits) < 7:
        return text
    return [f"00{digits}", f"({digits[:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[:-7]}/{digits[-7:]}"][pick % 3]


def window_labels(length: int, spans: list[Span], start: int) -> np.ndarray:
    labels = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        a, b = a - start, b - start
        labels[max(0, a) : max(0, b)] = k + 1
        if 0 <= a < length:
            labels[a] = k
    return labels


def training_windows(text: str, rng: np.random.Generator) -> list[tuple[list[int], list[int]]]:
    """Windows around the spans of a text, as they are and changed, and windows around other digits."""
    spans = []
    for s in base_spans(text):  # where kinds overlap, the earlier one stands
        if not spans or s[1] >= spans[-1][2]:
            spans.append(s)
    made = []

    def add(whole: str, marked: list[Span], middle: int) -> None:
        start = max(0, middle - int(rng.integers(WINDOW // 4, 3 * WINDOW // 4)))
        part = whole[start : start + WINDOW]
        x = np.zeros(WINDOW, np.int64)
        y = np.zeros(WINDOW, np.int64)
        x[: len(part)] = char_classes(part)
        y[: len(part)] = window_labels(len(part), [s for s in marked if s[2] > start and s[1] < start + len(part)], start)
        made.append((x.tolist(), y.tolist()))

    for kind, a, b in spans:
        add(text, spans, (a + b) // 2)
        near = [max(0, a - WINDOW), b + WINDOW]
        form = varied(kind, text[a:b], int(rng.integers(3)))
        head, tail = text[near[0] : a], text[b : near[1]]
        inside = [(k, s - near[0], e - near[0]) for k, s, e in spans if s >= near[0] and e <= a]
        shift = len(head) + len(form) - b
        inside += [(kind, len(head), len(head) + len(form))]
        inside += [(k, s + shift, e + shift) for k, s, e in spans if s >= b and e <= near[1]]
        add(head + form + tail, inside, len(head) + len(form) // 2)
    others = [m.start() for m in PLAIN_ANCHOR.finditer(text) if all(not s[1] <= m.start() < s[2] for s in spans)]
    for at in others[:: max(1, len(others) // 2)][:2]:
        add(text, spans, at)
    return made


def train(docs: DataFrame) -> Tagger:
    """Fit the tagger on windows of at most ``TRAIN_DOCS`` texts with digits, picked by a hash of the text."""
    prepare(docs.sparkSession)
    # Only hashes are sorted; the texts of the few that are picked follow by a broadcast join.
    keyed = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    picked = keyed.select("h").distinct().orderBy("h").limit(TRAIN_DOCS)

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for h, text in zip(frame["h"], frame["text"]):
                rng = np.random.default_rng(abs(int(h)))
                windows = training_windows(text, rng)
                rows += [(h, i, x, y) for i, (x, y) in enumerate(windows)]
            yield pd.DataFrame(rows, columns=["h", "i", "x", "y"])

    chosen = keyed.join(F.broadcast(picked), "h").dropDuplicates(["h"])
    windows = chosen.mapInPandas(collect, "h long, i int, x array<long>, y array<long>")
    # One window of each text before the second of any: dense texts do not crowd out the others.
    got = windows.orderBy("i", "h").limit(TRAIN_WINDOWS).toPandas()
    if not len(got):
        return new_tagger()
    return fit_tagger(np.vstack(got["x"]), np.vstack(got["y"]))


# --- whole texts -----------------------------------------------------------------


def plausible(kind: str, text: str) -> bool:
    """What a kind must hold, in whatever form it is written."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text)) and "." in text and any(c.isalpha() for c in text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return (12 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 7 <= len(digits) <= 15


def needed_windows(length: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of the windows (multiples of ``STEP``) that decide about characters within reach of an anchor."""
    starts = np.arange(0, max(1, length - WINDOW + STEP), STEP)
    first = np.searchsorted(anchors, starts - LONGEST - 2)
    last = np.searchsorted(anchors, starts + WINDOW + LONGEST + 2)
    return starts[last > first]


def merged(length: int, starts: np.ndarray, labels: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One label per character: that of the window in which it lies farthest from an edge, the earlier on ties."""
    out, score = np.zeros(length, np.int64), np.zeros(length)
    edge = np.full(length, -1)
    inside = np.arange(WINDOW)
    for w, start in enumerate(starts.tolist()):
        n = min(WINDOW, length - start)
        left = inside[:n] + (WINDOW if start == 0 else 0)  # the ends of the text are no edges
        right = np.minimum(WINDOW - 1 - inside[:n], 10**6) + (WINDOW if start + WINDOW >= length else 0)
        far = np.minimum(left, right)
        better = far > edge[start : start + n]
        at = start + np.flatnonzero(better)
        out[at], score[at], edge[at] = labels[:n][better, w], lead[:n][better, w], far[better]
    return out, score


def read_spans(labels: np.ndarray, lead: np.ndarray, text: str) -> list[Span]:
    """Runs of one kind that start at a B label or where the kind changes, edges without white space."""
    found = []
    kind = (labels + 1) // 2
    marked = np.flatnonzero(labels)
    if not len(marked):
        return []
    fresh = np.r_[True, (np.diff(marked) > 1) | (kind[marked[1:]] != kind[marked[:-1]]) | (labels[marked[1:]] % 2 == 1)]
    firsts = np.flatnonzero(fresh)
    for a, b in zip(firsts, [*firsts[1:], len(marked)]):
        start, end = int(marked[a]), int(marked[b - 1]) + 1
        if lead[start:end].mean() < MARGIN:
            continue
        raw = text[start:end]
        start, end = start + len(raw) - len(raw.lstrip()), end - (len(raw) - len(raw.rstrip()))
        name = KINDS[int(kind[marked[a]]) - 1]
        if name == "email":  # an address with "at" in brackets is a span as a whole
            near = max(0, start - LONGEST)
            for m in WRITTEN_OUT.finditer(text[near : end + LONGEST]):
                if near + m.start() < end and near + m.end() > start:
                    start, end = min(start, near + m.start()), max(end, near + m.end())
        body = text[start:end]
        if 0 < end - start <= LONGEST and ANCHOR.search(body) and plausible(name, body) and (name, start, end) not in found[-1:]:
            found.append((name, start, end))
    return found


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of the network in each text, decoded in batches of windows from all of them."""
    jobs: list[tuple[int, np.ndarray]] = []
    classes = {}
    for i, text in enumerate(texts):
        anchors = np.fromiter((m.start() for m in ANCHOR.finditer(text)), np.int64)
        if len(anchors):
            starts = needed_windows(len(text), anchors)
            classes[i] = char_classes(text)
            jobs.append((i, starts))
    result: list[list[Span]] = [[] for _ in texts]
    pending: list[tuple[int, np.ndarray]] = []

    def decode(group: list[tuple[int, np.ndarray]]) -> None:
        x = np.zeros((sum(len(s) for _, s in group), WINDOW), np.int64)
        row = 0
        for i, starts in group:
            for start in starts.tolist():
                part = classes[i][start : start + WINDOW]
                x[row, : len(part)] = part
                row += 1
        pieces = [tagger.decode(x[a : a + DECODED].T) for a in range(0, len(x), DECODED)]
        labels = np.concatenate([p[0] for p in pieces], axis=1)
        lead = np.concatenate([p[1] for p in pieces], axis=1)
        row = 0
        for i, starts in group:
            cols = slice(row, row + len(starts))
            result[i] = read_spans(*merged(len(texts[i]), starts, labels[:, cols], lead[:, cols]), texts[i])
            row += len(starts)

    size = 0
    for job in jobs:
        pending.append(job)
        size += len(job[1])
        if size >= DECODED:
            decode(pending)
            pending, size = [], 0
    if pending:
        decode(pending)
    return result


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) per text: an added span overlaps no base span."""
    out = []
    for text, added in zip(texts, tagged_spans(texts, tagger)):
        base = base_spans(text)
        free = [s for s in added if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append((base, sorted(base + free, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def personal_data(tagger: Tagger, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(tagger)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, every in all_spans([t or "" for t in texts], shared.value):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return find(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Whole texts are searched; a null text counts as empty. The counts and the
    digest are of the fixed patterns, ``spans`` lists those and what the network
    adds beside them, in code points, the end exclusive. Repeated rows are
    searched each; an empty table gives no rows. Without any digit in the corpus
    there is nothing to learn from, and nothing is added.
    """
    tagger = train(docs)
    found = docs.select("doc_id", personal_data(tagger, F.col("text"), docs.sparkSession).alias("found"))
    return found.select("doc_id", "found.*")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first stands."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*parts, text[at:]])
