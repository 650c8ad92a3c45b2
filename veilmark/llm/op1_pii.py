"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from four patterns, each found in time linear in the text. The tagger is trained
in numpy, in one task, from labelled spans: written forms of the four kinds, also such that the
patterns miss (spaced or hyphenated cards, telephone numbers without +, spaced @), are put into
contexts made of words of a bounded sample of documents (FIT_DOCS, in the order of a hash of doc_id and
text; of each its first FIT_WORDS words, those of 20 characters or less), with
unlabelled numbers, secrets and words as negatives. It sees character classes and digits, so it
carries over to any text.

Windows of WINDOW characters, half overlapping, are tagged by Viterbi decoding. Every kind's
written form has a digit or an @, so a window without either is decoded only if a piece in its
neighbour reaches their common edge. Pieces that touch an inner window edge are left to a whole span
of any window that they overlap; the others are stitched with the overlapping pieces of the same kind
in the neighbours, so a span may be of any length. A stitched span needs both its ends inside
windows. The spans of all windows are reconciled over the whole text: of overlapping ones the set of greatest total score is chosen by dynamic
programming (of equal totals the one whose last span ends first). A chosen span is added if it overlaps no base span and meets its kind's own rule
(an @ inside; four parts at most 255; 13 to 19 digits passing Luhn; 9 to 15 digits). Base spans
always stay.

Null text counts as empty and has no spans. Offsets are code points, end exclusive. Repeated rows
give repeated rows; a null doc_id stays null. Without any text a tagger is trained on one stand-in word. Other columns
are not read, whatever their names; redact keeps them.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, only, small_batches

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
FIT_DOCS = 200
FIT_WORDS = 200
EXAMPLES = 2304
EPOCHS = 8
HIDDEN = 16
EMBED = 12
WINDOW = 64
SEED = 7

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]").search
_TRIGGERS = re.compile(r"[0-9@]+")


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    left, at = 0, text.find("@")  # nothing left of left can be part of an address any more
    while at >= 0:
        start = left + len(text[left:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            left = m.end()
        else:
            left = at + 1
        at = text.find("@", left)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _TRIGGER(text):
        out += [(1, s, e) for s, e in _ips(text)]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def plausible(kind: int, form: str) -> bool:
    d = digits(form)
    if kind == 0:
        return form.count("@") == 1 and "." in form.split("@")[1] and len(form) >= 6
    if kind == 1:
        parts = re.findall("[0-9]+", form)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and form[0] in "+(0123456789"


# ---- the tagger: tags are 0, and for kind k 1 + 2k (begin) and 2 + 2k (inside)

_EXACT = {c: i + 1 for i, c in enumerate("0123456789@.+-() :=_\"'/,\n#%*")}
_CLASSES = len(_EXACT) + 6
TAGS = 1 + 2 * len(KINDS)


def _class(c: str) -> int:
    if c in _EXACT:
        return _EXACT[c]
    base = len(_EXACT)
    if c.isascii() and c.isalpha():
        return base + (1 if c.islower() else 2)
    return base + (3 if c.isalpha() else 4 if c.isspace() else 5)


_TABLE = np.array([_class(chr(i)) for i in range(0x250)], np.int64)


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], len(_EXACT) + 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, list]:
    """x (time, batch, EMBED) -> hidden (time, batch, HIDDEN), and what the backward pass needs."""
    pre = x @ w[f"x{way}"] + w[f"b{way}"]
    h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
    out, kept = np.empty((*x.shape[:2], HIDDEN), x.dtype), []
    for t in range(len(x)):
        z = pre[t] + h @ w[f"h{way}"]
        g = _sigmoid(z[:, : 3 * HIDDEN])
        u = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        last, c = c, f * c + i * u
        tc = np.tanh(c)
        kept.append((h, last, i, f, o, u, tc))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, w: dict, way: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), x.dtype)
    dh = dc = np.zeros((x.shape[1], HIDDEN), x.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, last, i, f, o, u, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * last * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dz_all[t] = dz
        grad[f"h{way}"] += h.T @ dz
        dh, dc = dz @ w[f"h{way}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad[f"x{way}"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"b{way}"] += flat.sum(axis=0)
    return dz_all @ w[f"x{way}"].T


def emissions(codes: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
    """codes (batch, time) -> tag scores (time, batch, TAGS)."""
    x = w["embed"][codes.T]
    fore, kf = _lstm(x, w, "f")
    back, kb = _lstm(x[::-1], w, "r")
    both = np.concatenate([fore, back[::-1]], axis=2)
    return both @ w["out"] + w["bias"], (x, both, kf, kb)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(codes: np.ndarray, tags: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood of the CRF per text and its gradient; codes and tags (batch, time)."""
    e, (x, both, kf, kb) = emissions(codes, w)
    time, batch, _ = e.shape
    move, y = w["move"], tags.T
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + w["start"]
    for t in range(1, time):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + move, 1) + e[t]
    for t in range(time - 2, -1, -1):
        beta[t] = _logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    rows = np.arange(batch)
    gold = w["start"][y[0]] + sum(e[t, rows, y[t]] for t in range(time)) + sum(move[y[t - 1], y[t]] for t in range(1, time))
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    de = np.exp(alpha + beta - z[None, :, None])
    grad["start"] = de[0].sum(axis=0)
    np.subtract.at(grad["start"], y[0], 1)
    for t in range(1, time):
        pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None])
        grad["move"] += pair.sum(axis=0)
        np.subtract.at(grad["move"], (y[t - 1], y[t]), 1)
    de[np.arange(time)[:, None], rows[None, :], y] -= 1
    grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
    grad["bias"] = de.sum(axis=(0, 1))
    dboth = de @ w["out"].T
    dx = _lstm_back(x, w, "f", kf, dboth[:, :, :HIDDEN], grad)
    dx = dx + _lstm_back(x[::-1], w, "r", kb, dboth[::-1, :, HIDDEN:], grad)[::-1]
    np.add.at(grad["embed"], codes.T, dx)
    return float((z - gold).sum()) / batch, {k: g / batch for k, g in grad.items()}


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"embed": normal(_CLASSES, EMBED) * 3, "out": normal(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    for way in "fr":
        w |= {f"x{way}": normal(EMBED, 4 * HIDDEN), f"h{way}": normal(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1
    for k in range(len(KINDS)):  # inside follows only its own kind
        ok = {1 + 2 * k, 2 + 2 * k}
        w["start"][2 + 2 * k] = -30
        for t in range(TAGS):
            if t not in ok:
                w["move"][t, 2 + 2 * k] = -30
    return w


def _card(rng: np.random.Generator) -> str:
    body = "".join(str(x) for x in rng.integers(0, 10, int(rng.choice([12, 14, 15, 15, 15, 18]))))
    return body + next(c for c in "0123456789" if luhn(body + c))


def _word(rng: np.random.Generator, words: list[str]) -> str:
    return words[int(rng.integers(len(words)))]


def _ascii(word: str) -> str:
    return re.sub("[^a-z0-9]", "", word.lower()) or "x"


def _form(kind: int, rng: np.random.Generator, words: list[str]) -> str:
    n = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    pick = int(rng.integers(4))
    if kind == 0:
        more = str(rng.choice([".", "_", "", "-"])) + (n(2) if pick else _ascii(_word(rng, words)))
        local = _ascii(_word(rng, words)) + (more if rng.random() < 0.7 else "")
        return f"{local}{' @ ' if pick == 3 else '@'}{_ascii(_word(rng, words))}{n(1) if pick == 1 else ''}.{rng.choice(['com', 'org', 'example.com', 'net', 'co.uk', 'de'])}"
    if kind == 1:
        return (" . " if pick == 3 else ".").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        c = _card(rng)
        return c if pick < 2 else str(rng.choice([" ", "-", ".", "  "])).join(c[i : i + 4] for i in range(0, len(c), 4))
    return [f"+{rng.integers(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(6)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}"][pick]


def _negative(rng: np.random.Generator) -> str:
    n = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    hexes = "".join(rng.choice(list("0123456789abcdef"), 40))
    return [n(int(rng.integers(1, 9))), f'token = "{hexes}"', f"{n(1)}.{n(2)}", f"{n(4)}-{n(2)}-{n(2)}", f"#{n(3)}", f"{n(2)}:{n(2)}", "@", f"v{n(1)}.{n(1)}.{n(1)}", f"{n(1)}. {n(1)}."][int(rng.integers(9))]


def examples(words: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags (count, WINDOW) of written forms among words."""
    codes, tags = np.zeros((count, WINDOW), np.int64), np.zeros((count, WINDOW), np.int64)
    for r in range(count):
        text, marks = "", []
        while len(text) < WINDOW * 2:
            u = rng.random()
            if u < 0.22:
                kind = int(rng.integers(4))
                form = _form(kind, rng, words)
                marks.append((kind, len(text), len(text) + len(form)))
                text += form
            else:
                text += _negative(rng) if u < 0.34 else _word(rng, words)
            text += str(rng.choice([" ", " ", " ", " ", ", ", ". ", "\n"]))
        y = np.zeros(len(text), np.int64)
        for kind, s, e in marks:
            y[s:e] = 2 + 2 * kind
            y[s] = 1 + 2 * kind
        at = int(rng.integers(0, WINDOW))
        y = y[at : at + WINDOW]
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1
        codes[r], tags[r] = encode(text[at : at + WINDOW]), y
    return codes, tags


def train(words: list[str]) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    w = start_weights(rng)
    codes, tags = examples(words, EXAMPLES, rng)
    m, v, step, batch = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0, 48
    for epoch in range(EPOCHS):
        order = rng.permutation(EXAMPLES)
        for a in range(0, EXAMPLES, batch):
            part = order[a : a + batch]
            _, grad = loss_and_gradient(codes[part], tags[part], w)
            step += 1
            rate = 0.02 * (1 - (epoch * EXAMPLES + a) / (EPOCHS * EXAMPLES)) + 0.001
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def decode(codes: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi tags (batch, time) and each position's margin of its tag's emission over the tag 0."""
    e, _ = emissions(codes, w)
    time, batch, _ = e.shape
    best, back = e[0] + w["start"], np.empty((time, batch, TAGS), np.int8)
    for t in range(1, time):
        s = best[:, :, None] + w["move"]
        back[t] = s.argmax(axis=1)
        best = s.max(axis=1) + e[t]
    tags = np.empty((time, batch), np.int64)
    tags[-1] = best.argmax(axis=1)
    rows = np.arange(batch)
    for t in range(time - 1, 0, -1):
        tags[t - 1] = back[t, rows, tags[t]]
    margin = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
    return tags.T, margin.T


def window_starts(text: str) -> list[int]:
    """Starts of the windows on the fixed grid that hold a digit or an @."""
    half, last = WINDOW // 2, max(0, (len(text) - 1) // (WINDOW // 2))
    out: dict[int, None] = {}
    for m in _TRIGGERS.finditer(text):
        for g in range(max(0, (m.start() - WINDOW) // half + 1), min(last, (m.end() - 1) // half) + 1):
            out[g * half] = None
    return list(out)


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, score) the non-overlapping set of greatest total score."""
    best: dict[tuple[int, int, int], float] = {}
    for k, s, e, x in spans:
        best[k, s, e] = max(x, best.get((k, s, e), 0.0))
    order = sorted(((k, s, e, x) for (k, s, e), x in best.items() if x > 0), key=lambda z: (z[2], z[1], z[0]))
    ends, total, take = [z[2] for z in order], [0.0], []
    for i, (_, s, _, x) in enumerate(order):
        j = bisect_right(ends, s, 0, i)
        take.append((j, total[j] + x > total[-1]))
        total.append(max(total[-1], total[j] + x))
    out, i = [], len(order)
    while i:
        j, yes = take[i - 1]
        if yes:
            out.append(order[i - 1][:3])
        i = j if yes else i - 1
    return out[::-1]


def pieces(tags: np.ndarray, margin: np.ndarray, n: int) -> Iterator[tuple[int, int, int, float]]:
    """Kind, start, end and score of the spans in the first n positions of a window."""
    t = 0
    while t < n:
        if not tags[t]:
            t += 1
            continue
        kind, b = (int(tags[t]) - 1) // 2, t
        t += 1
        while t < n and tags[t] == 2 + 2 * kind:
            t += 1
        yield kind, b, t, float(margin[b:t].sum())


def stitch(whole: list[tuple[int, int, int, float]], cut: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """Spans of the cut pieces (kind, start, end, score, open to the left, to the right) that no whole span overlaps."""
    order = sorted(whole, key=lambda x: x[1])
    starts, upto = [x[1] for x in order], [0]
    for x in order:
        upto.append(max(upto[-1], x[2]))
    out, last = [], None
    for k, s, e, x, left, right in [*sorted(c for c in cut if upto[bisect_left(starts, c[2])] <= c[1]), (-1, 0, 0, 0.0, True, True)]:
        if last and last[0] == k and s < last[2]:
            new = max(0, e - last[2])
            left = last[4] and (left or s > last[1])
            right = right if new else last[5] and (right or e < last[2])
            last = (k, last[1], max(e, last[2]), last[3] + x * new / (e - s), left, right)
            continue
        if last and not last[4] and not last[5]:
            out.append(last[:4])
        last = (k, s, e, x, left, right)
    return out


def tag_texts(texts: list[str], w: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of the tagger in each text."""
    where = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    seen, half = set(where), WINDOW // 2
    whole: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    cut: list[list[tuple[int, int, int, float, bool, bool]]] = [[] for _ in texts]
    a = 0
    while a < len(where):
        part = where[a : a + 512]
        a += len(part)
        codes = np.zeros((len(part), WINDOW), np.int64)
        for r, (i, s) in enumerate(part):
            x = encode(texts[i][s : s + WINDOW])
            codes[r, : len(x)] = x
        tags, margin = decode(codes, w)
        for r, (i, s) in enumerate(part):
            for kind, b, t, x in pieces(tags[r], margin[r], min(WINDOW, len(texts[i]) - s)):
                left, right = b == 0 and s > 0, t == WINDOW and s + t < len(texts[i])
                if not left and not right:
                    whole[i].append((kind, s + b, s + t, x))
                    continue
                cut[i].append((kind, s + b, s + t, x, left, right))
                for to in [s - half] * left + [s + half] * right:
                    if (i, to) not in seen:
                        seen.add((i, to))
                        where.append((i, to))
    return [reconcile(x + stitch(x, y)) for x, y in zip(whole, cut, strict=True)]


def all_spans(texts: list[str], w: dict[str, np.ndarray]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and base and added ones, of each text."""
    bases = [base_spans(t) for t in texts]
    for text, base, tagged in zip(texts, bases, tag_texts(texts, w), strict=True):
        added = []
        for k, s, e in tagged:
            form = text[s:e].strip()
            s += len(text[s:e]) - len(text[s:e].lstrip())
            e = s + len(form)
            if form and plausible(k, form) and not any(a < e and s < b for _, a, b in base):
                added.append((k, s, e))
        yield base, sorted(base + added)


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """The tagger, its contexts made of words of FIT_DOCS documents; a bound on their hash first, so tasks send few rows."""
    rows = only(docs, "doc_id", "text").where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    share = min(1.0, 3 * FIT_DOCS / max(1, rows.count()))
    few = rows.where(F.col("h") <= int(share * 2.0**64) - (1 << 63) - (share == 1.0)).select("h", F.expr(f"slice(split(text, '[\\\\s0-9@]+'), 1, {FIT_WORDS})").alias("words"))
    words = sorted({x for r in few.orderBy("h", "words").limit(FIT_DOCS).collect() for x in r["words"] if 0 < len(x) <= 20})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(words or ["word"]))], pa.binary())], names=["weights"])

    # in a task, whose linear algebra has one thread; a lost executor's work is repeated with the same seed
    return pickle.loads(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "weights binary").collect()[0]["weights"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    w = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            texts, rows = [t or "" for t in batch.column("text").to_pylist()], []
            for base, every in all_spans(texts, w):
                rows.append((*([k for k, _, _ in base].count(i) for i in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """All columns, with each span of text replaced by its kind in angle brackets; null text stays null."""
    w = fit(docs)
    plain, places = numbered(docs)
    names = plain.columns
    at = names.index(places["text"])
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            texts, new = [t or "" for t in old], []
            for text, (_, every) in zip(texts, all_spans(texts, w), strict=True):
                out, upto = [], 0
                for k, s, e in sorted(every, key=lambda x: (x[1], -x[2])):
                    if e > upto:
                        out += [text[upto:max(s, upto)], f"<{KINDS[k].upper()}>" if s >= upto else ""]
                        upto = e
                new.append("".join([*out, text[upto:]]))
            yield pa.RecordBatch.from_arrays([pa.array([None if o is None else n for o, n in zip(old, new, strict=True)], pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
