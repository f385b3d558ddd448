"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Trained from labelled spans; all arrays are (time, window, ...).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_MARKS = "@.-+() /:,_#%\n\"'[]"
CLASSES = 26 + 4 + len(_MARKS)


def _table() -> np.ndarray:
    out = np.full(0x250, 28, np.int64)  # other characters
    for c in range(26):
        out[97 + c] = c
        out[65 + c] = 26
    out[48:58] = 27
    out[0xC0:0x250] = 29
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 30 + i
    return out


_TABLE = _table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 0x24F)]


def _allowed() -> np.ndarray:
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside - 1, inside):
                out[before, inside] = -1e4
    return out


_ALLOWED = _allowed()


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        make = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"out": make(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": make(CLASSES, 4 * hidden), f"h{d}": make(hidden, 4 * hidden)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; ``keep`` gets what training needs."""
        steps, n = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        out = np.empty((steps, n, self.h), np.float32)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        wx, wh, k = self.p[f"x{d}"], self.p[f"h{d}"], self.h
        for t in order:
            z = wx[x[t]] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of every window."""
        e = self.emissions(x)
        trans = self.p["trans"] + _ALLOWED
        steps, n, _ = e.shape
        score, back = e[0].copy(), np.empty((steps, n, TAGS), np.int8)
        score[:, 2::2] -= 1e4
        for t in range(1, steps):
            total = score[:, :, None] + trans
            back[t] = total.argmax(1)
            score = total.max(1) + e[t]
        tags = np.empty((steps, n), np.int8)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        steps, n = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        trans = (self.p["trans"] + _ALLOWED).astype(np.float64)
        top = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = top(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = top(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = top(alpha[-1], 1)[:, None]
        de = np.exp(alpha + beta - total)
        dtrans = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, :, None]).sum(0)
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
        steps_at, windows_at = np.indices(y.shape)
        de[steps_at, windows_at, y] -= 1
        de = (de / n).astype(np.float32)
        grad = {"trans": (dtrans / n).astype(np.float32), "bias": de.sum((0, 1)), "out": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, TAGS)}
        dboth = de @ self.p["out"].T
        one_hot = np.eye(CLASSES, dtype=np.float32)[x.ravel()]
        for d, part in (("f", dboth[:, :, : self.h]), ("b", dboth[:, :, self.h :])):
            dh_w = np.zeros_like(self.p[f"h{d}"])
            dh = dc = np.zeros((n, self.h), np.float32)
            each = np.empty((steps, n, 4 * self.h), np.float32)
            for t, h, c, i, f, o, g, th in reversed(kept[d]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                each[t] = dz
                dh_w += h.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            grad |= {f"x{d}": one_hot.T @ each.reshape(steps * n, -1), f"h{d}": dh_w}
        return grad

    def fit(self, texts: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 6) -> Tagger:
        """Adam over random batches of labelled windows; (window, time) arrays."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(texts), batch)
            grad = self.gradients(texts[pick].T, tags[pick].T)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                now = rate * min(1, 3 * (1 - step / (steps + 1)))
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def labelled_windows(count: int, length: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented prose with labelled personal data and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def word():
        return "".join(pick(("th", "en", "er", "an", "re", "ou", "st", "ti", "de", "la", "que", "ch", "io", "é", "ü", "ma", "bo", "s", "t", "a")) for _ in range(rng.integers(1, 5)))

    def luhn():
        body = [int(c) for c in digits(15)]
        total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(body))
        return "".join(map(str, body)) + str(-total % 10)

    def email():
        at, dot = pick((("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", ".")))
        return word() + pick((".", "_", "", "-")) + pick((word(), digits(2))) + at + word() + pick(("", digits(1))) + dot + pick((word(), "example")) + dot + pick(("com", "org", "net", "de"))

    def ip():
        return pick((".", ".", " . ", "[.]")).join(str(rng.integers(0, 256)) for _ in range(4))

    def card():
        n, sep = luhn(), pick(("", " ", "-", ".", "/"))
        return sep.join(n[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"00{pick(('49', '33', '34', '44'))} {a} {b}{c}", f"0{a}/{b}{c}", f"({a}) {b} {c}"))

    def other():
        return pick((f"{digits(4)}-{digits(2)}-{digits(2)}", digits(rng.integers(1, 9)), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"#{digits(5)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}", "token = \"" + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', f"({digits(4)})", f"@{word()}", f"{word()}{digits(2)}"))

    texts, tags = np.empty((count, length), np.int64), np.zeros((count, length), np.int64)
    makers = (email, ip, card, phone)
    for row in range(count):
        text, marks = "", []
        while len(text) < length + 40:
            roll = rng.random()
            if roll < 0.12:
                kind = int(rng.integers(4))
                value = makers[kind]()
                marks.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += other() if roll < 0.2 else word()
            text += pick((" ", " ", " ", ". ", ", ", "\n", "### ", " | "))
        cut = int(rng.integers(0, 40))
        for a, b, kind in marks:
            a, b = a - cut, b - cut
            if 0 <= a < length:
                tags[row, a : min(b, length)] = 2 + 2 * kind
                tags[row, a] = 1 + 2 * kind
            elif a < 0 < b:
                tags[row, : min(b, length)] = 2 + 2 * kind
                tags[row, 0] = 1 + 2 * kind
        texts[row] = classes(text[cut : cut + length])
    return texts, tags


@lru_cache(maxsize=2)
def trained(windows: int = 1500, length: int = 64, steps: int = 260) -> Tagger:
    """The production model: ``windows`` labelled windows bound its training."""
    return Tagger().fit(*labelled_windows(windows, length), steps)
