"""Personal data in text: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on generated lines with labelled spans (e-mail addresses, IP addresses, card numbers, phone
numbers and secrets in several notations, among numbers and codes that are none). Every character of a text that is a
digit or an @ calls for the windows around it; what is looked for has such a character, so windows without any hold none.
Overlapping windows share their characters: the tag scores of a character are averaged over its windows, those near a
window's middle counting more, and one Viterbi pass over each stretch of connected windows decodes it as a whole. A
long stretch is decoded in parts side by side, by the best scores from every tag to every tag, with the same result.

Spans of the patterns always stay. Decoded spans that touch none of them are added if an exact check agrees: a card number
has 14 to 19 digits and the right check digit, parts of an IP address are at most 255, a phone number has 9 to 15 digits, an
address has an @ within. So a number that fails its check is never added, whatever the network says. Secrets (keys and
tokens of 16 characters or more, with digits) are a kind of their own, apart from the spans.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; a text of any length is
read whole, with some 60 bytes of memory for each character of its longest stretch; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, slices

KINDS = ("email", "ip", "card", "phone")
#: What the network tells apart.
TOLD = (*KINDS, "secret")
Span = tuple[int, str, int]  # start, kind, end

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, each kind leftmost and non-overlapping, in order of start and kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # from each @ outwards, so that a long run of letters is read once
        a = at
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, "email", m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# The tagger

WINDOW, STRIDE, HIDDEN = 96, 48, 16
TAGS = 1 + 2 * len(TOLD)  # outside; then the first and the further characters of each kind
SIGNS = "@.+-()_%:/ \n,=\"'#|"
CLASSES = len(SIGNS) + 29


@cache
def _class_table() -> np.ndarray:
    """Class of each code point below 128: a sign, a digit, one of the letters in either case, or another. 128 is for all
    others."""
    n = len(SIGNS)
    t = np.full(129, n + 27, np.uint8)
    for c in range(128):
        s = chr(c)
        if s in SIGNS:
            t[c] = SIGNS.index(s)
        elif s.isdigit():
            t[c] = n
        elif s.isalpha():
            t[c] = n + 1 + ord(s.lower()) - ord("a")
    t[128] = n + 28
    return t


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _class_table()[np.minimum(codes, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _both(x: np.ndarray) -> np.ndarray:
    """Classes (2, time, rows): forwards and backwards."""
    return np.stack((x, x[::-1]))


def _scores(x: np.ndarray, p: dict[str, np.ndarray], keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Tag scores (time, rows, TAGS) over classes (time, rows); with ``keep``, what the gradient needs. Both directions run
    side by side: w (2, CLASSES, 4 HIDDEN), u (2, HIDDEN, 4 HIDDEN)."""
    steps, rows = x.shape
    xx, w, u = _both(x), p["w"], p["u"]
    h = np.zeros((2, rows, HIDDEN), np.float32)
    c, out, memory = h, np.empty((2, steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        z = np.stack((w[0][xx[0, t]], w[1][xx[1, t]])) + h @ u
        s = _sigmoid(z[:, :, : 3 * HIDDEN])
        i, f, o, g = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :], np.tanh(z[:, :, 3 * HIDDEN :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            memory.append((h, c, i, f, o, g, tc))
        h, c = o * tc, c_new
        out[:, t] = h
    states = np.concatenate((out[0], out[1, ::-1]), axis=2)
    return states @ p["v"] + p["c"], (states, memory)


def _back(x: np.ndarray, u: np.ndarray, memory: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by w and u from those by the states (time, rows, 2 HIDDEN)."""
    steps, rows = x.shape
    dout = np.stack((dstates[:, :, :HIDDEN], dstates[::-1, :, HIDDEN:]))
    dz_all = np.empty((2, steps, rows, 4 * HIDDEN), np.float32)
    dh = np.zeros((2, rows, HIDDEN), np.float32)
    dc, ut = np.zeros_like(dh), u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        _, c, i, f, o, g, tc = memory[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=2)
        dz_all[:, t] = dz
        dh, dc = dz @ ut, dc * f
    flat = dz_all.reshape(2, steps * rows, -1)
    before = np.stack([m[0] for m in memory], axis=1).reshape(2, steps * rows, HIDDEN)
    seen = np.eye(CLASSES, dtype=np.float32)[_both(x).reshape(2, -1)]
    return seen.transpose(0, 2, 1) @ flat, before.transpose(0, 2, 1) @ flat


def _forbidden() -> np.ndarray:
    """Tag pairs that can't follow each other: a further character needs a character of its kind before it."""
    t = np.zeros((TAGS, TAGS), bool)
    for k in range(len(TOLD)):
        for before in range(TAGS):
            t[before, 2 + 2 * k] = before not in (1 + 2 * k, 2 + 2 * k)
    return t


def _crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags ``y`` (time, rows), and its gradients by scores and transitions. Forward and
    backward sums are kept as shares of each step's sum ``c``."""
    steps, rows, tags = e.shape
    high = e.max(axis=2, keepdims=True)
    psi, step = np.exp(e - high), np.exp(trans)
    alpha, beta, c = np.empty_like(psi), np.ones_like(psi), np.empty((steps, rows, 1), psi.dtype)
    a = psi[0]
    for t in range(steps):
        a = a if t == 0 else (alpha[t - 1] @ step) * psi[t]
        c[t] = a.sum(axis=1, keepdims=True)
        alpha[t] = a / c[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (psi[t + 1] * beta[t + 1]) @ step.T / c[t + 1]
    z = (np.log(c) + high).sum(axis=(0, 2))
    de = alpha * beta
    dt = step * (alpha[:-1].reshape(-1, tags).T @ (psi[1:] * beta[1:] / c[1:]).reshape(-1, tags))
    np.subtract.at(dt, (y[:-1], y[1:]), 1)
    at = np.arange(steps)[:, None], np.arange(rows)[None, :], y
    gold = e[at].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
    de[at] -= 1
    return float((z - gold).mean()), (de / rows).astype(np.float32), (dt / rows).astype(np.float32)


def _generated(rng: random.Random) -> tuple[str, list[Span]]:
    """One labelled window of text."""
    word = lambda n=8: "".join(rng.choice(("en", "re", "th", "ion", "er", "an", "é", "ñ", "sch", "ble", "ou", "ü", "ti", "a", "o")) for _ in range(rng.randint(1, n // 2)))
    plain = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzetaoinshr") for _ in range(rng.randint(1, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ascii_ = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))

    pick = rng.choice
    said = lambda *cues: pick((*cues, *[""] * len(cues)))

    def number() -> str:
        n = rng.choice((14, 15, 16, 16, 16, 16, 19)) - 1
        first = d(n)
        return first + next(c for c in "0123456789" if luhn(first + c))

    def item() -> tuple[str, str, str | None]:
        """What stands before, the item, its kind."""
        k = rng.randint(0, 15)
        if k <= 1:
            name = ascii_(rng.randint(2, 8)) + pick(("", ".", "_", "-", "+")) + pick((d(2), ascii_(4), "", "é" + ascii_(2)))
            return "", name.rstrip("._-+") + pick(("@", "@", "@", " @ ")) + ascii_(rng.randint(3, 8)) + pick(("", d(1), "ü")) + "." + pick(("example.com", "com", "org", "co.uk", "example.net")), "email"
        if k <= 3:
            return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip"
        if k <= 5:
            n, sep = number(), pick(("", "", " ", "-", ".", "/", " - ", "|"))
            cut = (4, 10, 15) if len(n) == 15 else range(4, len(n), 4)
            return said("card ", "visa ", "card: ", "credit card "), sep.join(n[i:j] for i, j in zip((0, *cut), (*cut, len(n)), strict=True)), "card"
        if k <= 8:
            return said("tel ", "phone: ", "call "), pick((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)}.{d(3)}.{d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}")), "phone"
        if k <= 10:
            hexes = "".join(pick("0123456789abcdef") for _ in range(pick((16, 24, 32, 40, 64))))
            mixed = "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz0123456789") for _ in range(rng.randint(16, 40)))
            if k == 9:
                return pick(('token = "', 'api_key = "', "secret: ", 'key="', "password=", "token ")), pick((hexes, hexes, mixed)), "secret"
            return pick(("sha ", "commit ", "id ", "md5 ", "file ", "hash: ")), hexes, None
        if k == 11:
            return "", pick((f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}", f"{d(1)},{d(3)}", f"{d(1)}.", f"{d(3)}.{d(3)}.{d(2)}", ".".join(d(rng.randint(1, 4)) for _ in range(rng.choice((4, 5, 6)))))), None
        if k == 12:
            return "", pick((d(4), d(1), d(2), d(6), d(9), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}/{d(2)}/{d(4)}")), None
        if k == 13:
            return "", pick(("@" + ascii_(6), "a @ b", "@", "= \"" + d(3) + ascii_(5) + "\"")), None
        if k == 14:
            return pick(("order ", "order no. ", "tracking ", "invoice ", "ref ", "isbn ", "number ")), pick((d(16), d(14), d(10), d(13), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(10)}")), None
        return "", pick((d(22), d(30), d(12))), None

    parts, spans, n = [], [], 0
    while n < WINDOW + 40:
        before, s, kind = ("", rng.choice((word, plain))(), None) if rng.random() < 0.72 else item()
        if rng.random() < 0.1:
            s = s.upper() if kind is None else s
        if kind:
            spans.append((n + len(before), kind, n + len(before) + len(s)))
        parts.append(before + s + (pick(('" ', '"\n')) if before.endswith('"') else pick((" ", " ", " ", " ", ", ", ". ", "\n", " | ", "!! "))))
        n += len(parts[-1])
    at = rng.randint(0, 40)
    text = "".join(parts)[at : at + WINDOW]
    return text, [(max(0, a - at), k, min(WINDOW, b - at)) for a, k, b in spans if b > at and a < at + WINDOW]


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (time, rows) of ``n`` generated windows."""
    rng = random.Random(seed)
    x, y = np.zeros((WINDOW, n), np.uint8), np.zeros((WINDOW, n), np.int64)
    for r in range(n):
        text, spans = _generated(rng)
        x[:, r] = classes(text)
        for a, kind, b in spans:
            y[a, r] = 1 + 2 * TOLD.index(kind)
            y[a + 1 : b, r] = 2 + 2 * TOLD.index(kind)
    return x, y


@cache
def train(steps: int = 600, rows: int = 64, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's parameters, by Adam over generated windows; on the driver, once a process, in some seconds. The same
    arguments give the same parameters."""
    r = np.random.default_rng(seed)
    shape = {"w": (2, CLASSES, 4 * HIDDEN), "u": (2, HIDDEN, 4 * HIDDEN), "v": (2 * HIDDEN, TAGS), "c": (TAGS,), "t": (TAGS, TAGS)}
    p = {k: (r.normal(size=s) * (0.3 if k == "w" else 0.2)).astype(np.float32) for k, s in shape.items()}
    p["w"][:, :, HIDDEN : 2 * HIDDEN] += 1  # gates that forget start open
    stop = np.where(_forbidden(), np.float32(-1e4), np.float32(0))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    xs, ys = labelled(rows * 90, seed)
    for step in range(1, steps + 1):
        pick = r.integers(0, xs.shape[1], rows)
        x, y = xs[:, pick], ys[:, pick]
        e, (states, memory) = _scores(x, p, keep=True)
        _, de, dt = _crf_gradient(e, p["t"] + stop, y)
        g = {"v": np.einsum("trh,trk->hk", states, de), "c": de.sum(axis=(0, 1)), "t": np.where(_forbidden(), 0, dt)}
        g["w"], g["u"] = _back(x, p["u"], memory, de @ p["v"].T)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, a in g.items():
            a = a * min(1.0, 5 / norm)
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    p["t"] = p["t"] + stop
    return p


def _viterbi(e: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (rows, time) of stretches padded to one length; a stretch may start within a span."""
    rows, steps, _ = e.shape
    back = np.zeros((rows, steps, TAGS), np.int8)
    s = e[:, 0]
    for t in range(1, steps):
        z = s[:, :, None] + trans[None]
        back[:, t] = z.argmax(axis=1)
        s = np.where((t < length)[:, None], z.max(axis=1) + e[:, t], s)
    tags = np.zeros((rows, steps), np.int8)
    now = s.argmax(axis=1)
    r = np.arange(rows)
    for t in range(steps - 1, -1, -1):
        inside = t < length
        tags[:, t] = np.where(inside, now, 0)
        now = np.where(inside & (t > 0), back[r, t, now], now)
    return tags


#: Steps of the parts in which a long stretch is decoded, and the length from which it is.
PART, LONG = 256, 4096


def _viterbi_long(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of one long stretch (time, TAGS): the same as ``_viterbi``, in parts of ``PART`` steps side by side. First
    the best score through each part from every tag before it to its last tag, then the best chain of parts, then the
    best path within each part whose ends are known."""
    n = len(e)
    head = n % PART or PART
    first = _viterbi_tables(e[None, :head], trans, None)
    parts = (n - head) // PART
    body = e[head:].reshape(parts, PART, TAGS)
    through = trans[None] + body[:, 0][:, None, :]  # part, tag before, tag now
    for t in range(1, PART):
        through = (through[:, :, :, None] + trans).max(axis=2) + body[:, t][:, None, :]
    score, back = first[0][0], np.zeros((parts, TAGS), np.int8)
    for k in range(parts):
        z = score[:, None] + through[k]
        back[k] = z.argmax(axis=0)
        score = z.max(axis=0)
    last = np.zeros(parts + 1, np.int64)
    last[parts] = score.argmax()
    for k in range(parts - 1, -1, -1):
        last[k] = back[k, last[k + 1]]
    out = np.empty(n, np.int8)
    out[:head] = _follow(first[1], last[:1])[0]
    if parts:
        out[head:] = _follow(_viterbi_tables(body, trans, last[:-1])[1], last[1:]).ravel()
    return out


def _viterbi_tables(e: np.ndarray, trans: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Final scores (rows, TAGS) and the tag before each (rows, time, TAGS), after the tags ``before``, if any."""
    back = np.zeros(e.shape, np.int8)
    s = e[:, 0] if before is None else trans[before] + e[:, 0]
    for t in range(1, e.shape[1]):
        z = s[:, :, None] + trans[None]
        back[:, t] = z.argmax(axis=1)
        s = z.max(axis=1) + e[:, t]
    return s, back


def _follow(back: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Tags (rows, time) that lead to the last tags ``now``."""
    tags, r = np.empty(back.shape[:2], np.int8), np.arange(len(back))
    for t in range(back.shape[1] - 1, -1, -1):
        tags[:, t] = now
        now = back[r, t, now]
    return tags


def stretches(text: str) -> list[tuple[int, int]]:
    """Unions (start, end in windows of the grid) of the windows around digits and @."""
    last = max(0, (len(text) - 1) // STRIDE)
    cells = np.unique(np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64) // STRIDE)
    if not cells.size:
        return []
    # Window w covers cells w and w + 1, so a cell is in windows w - 1 and w; one more on each side holds what hangs over.
    w = np.unique(np.clip((cells[:, None] + np.arange(-2, 2)).ravel(), 0, last))
    cut = np.flatnonzero(np.diff(w) > 1)
    return list(zip(w[np.append(0, cut + 1)].tolist(), (w[np.append(cut, len(w) - 1)] + 1).tolist(), strict=True))


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _merged(cls: np.ndarray, a: int, b: int, p: dict[str, np.ndarray], limit: int) -> np.ndarray:
    """Tag scores (characters, TAGS) of the windows a..b of a text, ``limit`` windows at a time."""
    n = min((b - 1 - a) * STRIDE + WINDOW, len(cls) - a * STRIDE)
    total, weight = np.zeros(((b - 1 - a) * STRIDE + WINDOW, TAGS), np.float32), np.zeros((b - 1 - a) * STRIDE + WINDOW, np.float32)
    for lo in range(a, b, limit):
        hi = min(b, lo + limit)
        x = np.full(((hi - lo - 1) * STRIDE + WINDOW,), SIGNS.index("\n"), np.uint8)
        part = cls[lo * STRIDE : lo * STRIDE + len(x)]
        x[: len(part)] = part
        scores = _scores(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STRIDE].T, p)[0]
        for w in range(lo, hi):
            at = (w - a) * STRIDE
            total[at : at + WINDOW] += scores[:, w - lo] * _WEIGHT[:, None]
            weight[at : at + WINDOW] += _WEIGHT
    total /= weight[:, None]
    return total[:n]


def _runs(row: np.ndarray, offset: int) -> list[Span]:
    """Spans of a stretch's tags."""
    begins = np.flatnonzero((row > 0) & ((row % 2 == 1) | (np.append(0, row[:-1]) == 0)))
    # A span goes on while the tag is that of further characters, of one kind.
    stops = np.flatnonzero(np.append((row[1:] == 0) | (row[1:] % 2 == 1), True)) + 1
    ends = stops[np.searchsorted(stops, begins, "right")]
    return [(offset + s, TOLD[(int(row[s]) - 1) // 2], offset + t) for s, t in zip(begins.tolist(), ends.tolist(), strict=True)]


def model_spans(texts: list[str], p: dict[str, np.ndarray], limit: int = 1024) -> list[list[Span]]:
    """Decoded spans of each text; about ``limit`` windows are run at a time."""
    found: list[list[Span]] = [[] for _ in texts]
    short: list[tuple[int, int, int]] = []

    def run(group: list[tuple[int, int, int]]) -> None:
        """Short stretches: their windows are run together, and those of like length are decoded together."""
        x = np.full((sum(b - a for _, a, b in group), WINDOW), SIGNS.index("\n"), np.uint8)
        k, known = 0, (-1, np.zeros(0, np.uint8))
        for i, a, b in group:
            known = known if known[0] == i else (i, classes(texts[i]))
            for w in range(a, b):
                part = known[1][w * STRIDE : w * STRIDE + WINDOW]
                x[k, : len(part)] = part
                k += 1
        scores = _scores(np.ascontiguousarray(x.T), p)[0].transpose(1, 0, 2)
        merged, k = [], 0
        for i, a, b in group:
            size = (b - 1 - a) * STRIDE + WINDOW
            total, weight = np.zeros((size, TAGS), np.float32), np.zeros(size, np.float32)
            for w in range(b - a):
                total[w * STRIDE : w * STRIDE + WINDOW] += scores[k] * _WEIGHT[:, None]
                weight[w * STRIDE : w * STRIDE + WINDOW] += _WEIGHT
                k += 1
            merged.append((total / weight[:, None])[: len(texts[i]) - a * STRIDE])
        order = sorted(range(len(group)), key=lambda j: len(merged[j]))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            length = np.array([len(merged[j]) for j in part])
            e = np.zeros((len(part), length.max(), TAGS), np.float32)
            for r, j in enumerate(part):
                e[r, : length[r]] = merged[j]
            tags = _viterbi(e, length, p["t"])
            for r, j in enumerate(part):
                i, a, _ = group[j]
                found[i] += _runs(tags[r, : length[r]], a * STRIDE)

    for i, t in enumerate(texts):
        for a, b in stretches(t):
            if (b - a) * STRIDE > LONG:
                found[i] += _runs(_viterbi_long(_merged(classes(t[a * STRIDE : (b - 1) * STRIDE + WINDOW]), 0, b - a, p, limit), p["t"]), a * STRIDE)
                continue
            if short and sum(y - x for _, x, y in short) + b - a > limit:
                run(short)
                short = []
            short.append((i, a, b))
    if short:
        run(short)
    return [sorted(f) for f in found]


def valid(text: str, span: Span) -> bool:
    """The exact check of a decoded span."""
    s = text[span[0] : span[2]]
    digits = "".join(c for c in s if c in "0123456789")
    if span[1] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", s)
    if span[1] == "ip":
        return bool(_IP.fullmatch(s)) and all(len(q.lstrip("0")) <= 3 and int(q) <= 255 for q in s.split("."))
    if span[1] == "phone":
        return 9 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", s)
    if span[1] == "email":
        return bool(re.search(r"\w ?@ ?\w[^@]*\.\w", s))
    return len(s) >= 16 and bool(digits) and bool(re.fullmatch(r"[A-Za-z0-9_+/=-]+", s)) and bool(re.search(r"[A-Za-z]", s))


def find(texts: list[str | None], p: dict[str, np.ndarray]) -> Iterator[tuple[list[Span], list[Span], list[Span]]]:
    """For each text its spans by the patterns, those with the added ones, and the secrets."""
    given = [t or "" for t in texts]
    hot = [i for i, t in enumerate(given) if _TRIGGER.search(t)]
    decoded = dict(zip(hot, model_spans([given[i] for i in hot], p), strict=True))
    for i, t in enumerate(given):
        base = base_spans(t) if i in decoded else []
        free, taken, k, reach = [], sorted((a, b) for a, _, b in base), 0, 0
        for s in decoded.get(i, ()):  # in order of their starts
            while k < len(taken) and taken[k][0] < s[2]:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= s[0] and valid(t, s):
                free.append(s)
        order = lambda s: (s[0], TOLD.index(s[1]))
        yield base, sorted(base + [s for s in free if s[1] != "secret"], key=order), [s for s in free if s[1] == "secret"]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256, spans, n_added, secrets (spans, too) and n_found (spans
    and secrets), a row for each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = list(find(part.column("text").to_pylist(), shared.value))
                n = [pa.array([sum(s[1] == k for s in base) for base, _, _ in rows], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in rows])
                all_, secrets = pa.array([written(every) for _, every, _ in rows]), pa.array([written(keys) for _, _, keys in rows])
                added, total = pa.array([len(every) - len(base) for base, every, _ in rows], pa.int64()), pa.array([len(every) + len(keys) for _, every, keys in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *n, digest, all_, added, secrets, total], ["doc_id", *counts, "base_sha256", "spans", "n_added", "secrets", "n_found"])

    names = "".join(f"{c} long, " for c in counts)
    return docs.select(docs[id_col].alias("k"), docs[text].alias("text")).transform(arrow, run, f"doc_id {kind}, {names}base_sha256 string, spans string, n_added long, secrets string, n_found long")
