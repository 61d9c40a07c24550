"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, decoding."""

from __future__ import annotations

import random

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
#: Outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters 32-126 one by one, then line ends and tabs, letters beyond ASCII, all others.
SYMBOLS = 95 + 3
#: Characters of a training text.
WINDOW = 64
#: Characters the tagger reads at once in a text, and from one such window to the next.
READ, STRIDE = 256, 240
#: Transitions stay within this, so that characters that are plainly outside can be told by their own scores (may_be_inside()).
MOST_TRANSITION = 1.5


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.full(len(points), SYMBOLS - 1)
    plain = (points >= 32) & (points < 127)
    out[plain] = points[plain] - 32
    out[(points == 9) | (points == 10) | (points == 13)] = SYMBOLS - 3
    out[points >= 0xC0] = SYMBOLS - 2
    return out


def examples(n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: made-up words around made-up personal data, and around numbers that are none. Spans are (kind, start, end)."""
    r = random.Random(seed)
    syllables = ["an", "ber", "che", "do", "en", "fi", "ga", "ho", "ing", "ja", "ko", "le", "mi", "ne", "or", "pa", "qui", "re", "st", "tion", "un", "ver", "wa", "xo", "yl", "zu", "é", "ö", "ñ", "ß"]
    letters = "eeeeettttaaaaooooiiiinnnnsssshhhrrrrddlllcccuuummwfgypbvkxqjzéèêàçùñöäüßíóú"

    def word() -> str:
        """Of syllables or of letters, at times with a capital or all in capitals."""
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 5))) if r.random() < 0.4 else "".join(r.choice(letters) for _ in range(r.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 11, 14])))
        u = r.random()
        return w.capitalize() if u < 0.15 else w.upper() if u < 0.18 else w

    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    plain = lambda: "".join(c for c in word() if c.isascii()) or "ab"

    def email() -> str:
        name = plain() + r.choice(["", ".", "_", "-", "+"]).join(["", plain() if r.random() < 0.5 else digits(2)])
        host = plain() + r.choice(["", digits(1)]) + "." + r.choice(["com", "org", "net", "example.com", "de", "fr", "co.uk"])
        return r.choice([name + "@" + host] * 5 + [name + " [at] " + host, name + " (at) " + host, name + "[at]" + host])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        """In groups: of plain runs of digits the check digit alone tells a card, which the base pattern reads and a tagger can't."""
        k = r.choice([14, 15, 16, 16, 16, 16, 16, 17, 19])
        d = digits(k)
        return r.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, k, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice(["+{} ({}) {}-{}", "+{} ({}) {}-{}", "+{} {} {} {}", "+{}-{}-{}-{}", "+{}{}{}{}"]).format(r.randint(1, 99), a, b, c) if r.random() < 0.7 else r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(a, b, c)

    def secret() -> str:
        k = r.choice([20, 24, 32, 32, 40, 40, 40, 64])
        hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return r.choice(["", "", "", "sk-", "AKIA", "ghp_"]) + "".join(r.choice(hexed if k >= 32 and k != 64 or r.random() < 0.5 else mixed) for _ in range(k))

    def iban() -> str:
        land = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "AT", "PT"])
        body = digits(r.randint(11, 24)) if r.random() < 0.7 else "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + digits(r.randint(10, 16))
        whole = land + f"{98 - iban_rest(body + land + '00'):02}" + body
        return whole if r.random() < 0.4 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def other() -> str:
        """Numbers and signs that are no personal data."""
        return r.choice(
            [
                lambda: digits(r.randint(1, 9)), lambda: f"{r.randint(0, 99)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2050)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 999)},{digits(3)}.{digits(2)}",
                lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([4, 6, 8]))) + '"', lambda: "@" + plain(), lambda: "(" + digits(4) + ")", lambda: "$" + digits(r.randint(1, 6)),
                lambda: digits(r.randint(24, 40)), lambda: digits(r.randint(11, 23)), lambda: f"{r.randint(0, 999)}/{r.randint(0, 999)}", lambda: plain() + digits(3), lambda: "+" + digits(2) + "%",
            ]
        )()

    makers = [email, ip, card, phone, secret, iban]
    shares = [2, 2, 4, 4, 2, 1]
    out = []
    for _ in range(n):
        text, spans = "", []
        plain_text, upper, tail = r.random() < 0.35, r.random() < 0.1, r.choice(["", "", "", "", "!!", "###", "%%%", "$$$", "***", "&&&", " |"])
        while len(text) < WINDOW:
            u = r.random()
            kind = r.choices(range(len(makers)), shares)[0] if u < 0.25 and not plain_text else None
            piece = makers[kind]() if kind is not None else other() if u < (0.03 if plain_text else 0.42) else word() + r.choice(["", "", "", "", ",", ".", "-" + word(), "'" + word(), ";", "?"])
            piece = piece.upper() if upper else piece
            if kind is not None and r.random() < 0.1:
                text += r.choice(["(", "<", '"', ":"])
            if kind == 4 and r.random() < 0.5:
                text += r.choice(['token = "', 'key: ', 'secret="', "api_key = '"])
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + (r.choice([".", ",", ")", ";"]) if r.random() < 0.15 else "") + tail + r.choice([" ", " ", " ", "\n"])
        # start anywhere, so that windows also begin and end inside of spans
        start = r.randint(0, max(0, len(text) - WINDOW))
        cut = text[start : start + WINDOW]
        inside = [(k, max(0, a - start), min(len(cut), b - start)) for k, a, b in spans if b > start and a < start + WINDOW]
        out.append((cut, inside))
    return out


def iban_rest(text: str) -> int:
    """The remainder by 97 of digits and letters, letters counting from 10."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, start, end in spans:
        tags[start:end] = 2 + 2 * kind
        if start < end:
            tags[start] = 1 + 2 * kind
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def initial(hidden: int, embedding: int, seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {"embedding": g.normal(0, 0.3, (SYMBOLS, embedding)), "out": g.normal(0, 0.2, (2 * hidden, TAGS)), "out_bias": np.zeros(TAGS), "transition": g.normal(0, 0.05, (TAGS, TAGS)), "first": np.zeros(TAGS)}
    for way in ("forward", "backward"):
        p[way] = g.normal(0, 1 / np.sqrt(embedding + hidden), (embedding + hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0  # remember at first
        p[way + "_bias"] = bias
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """(steps, rows, embedding) -> (steps, rows, hidden) and what the way back needs. Gates: in, forget, out, candidate."""
    steps, rows, width = x.shape
    hidden = w.shape[1] // 4
    h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    out, held = np.empty((steps, rows, hidden), np.float32), []
    projected = x.reshape(-1, width) @ w[:width] + b
    projected = projected.reshape(steps, rows, -1)
    recurrent = w[width:]
    for t in range(steps):
        z = projected[t] + h @ recurrent
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before_c, before_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            held.append((i, f, o, g, before_c, before_h, tc))
    return out, held


def _lstm_back(x: np.ndarray, w: np.ndarray, held: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, rows, width = x.shape
    hidden = w.shape[1] // 4
    dz_all = np.empty((steps, rows, 4 * hidden), np.float32)
    dw_h = np.zeros((hidden, 4 * hidden), np.float32)
    dh, dc = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before_c, before_h, tc = held[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :hidden] = dc * g * i * (1 - i)
        dz[:, hidden : 2 * hidden] = dc * before_c * f * (1 - f)
        dz[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        dz[:, 3 * hidden :] = dc * i * (1 - g * g)
        dw_h += before_h.T @ dz
        dh = dz @ w[width:].T
        dc = dc * f
    flat = dz_all.reshape(steps * rows, -1)
    dw = np.concatenate([x.reshape(steps * rows, width).T @ flat, dw_h])
    return (flat @ w[:width].T).reshape(x.shape), dw, flat.sum(0)


def emissions(p: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """(rows, steps) codes -> (steps, rows, TAGS) scores."""
    x = p["embedding"][windows.T]
    ahead, held_a = _lstm(x, p["forward"], p["forward_bias"], keep)
    back, held_b = _lstm(x[::-1], p["backward"], p["backward_bias"], keep)
    h = np.concatenate([ahead, back[::-1]], 2)
    return h @ p["out"] + p["out_bias"], (x, h, held_a, held_b)


def _crf(p: dict[str, np.ndarray], scores: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean negative log-likelihood of tags (steps, rows), gradients of the transitions, and of the scores."""
    steps, rows, _ = scores.shape
    trans, first = p["transition"], p["first"]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = first + scores[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    grad = np.exp(alpha + beta - z[:, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, steps):
        d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    at = np.arange(rows)
    gold = first[tags[0]] + scores[0, at, tags[0]]
    d_first = grad[0].sum(0)
    np.subtract.at(d_first, tags[0], 1)
    for t in range(steps):
        if t:
            gold = gold + trans[tags[t - 1], tags[t]] + scores[t, at, tags[t]]
            np.subtract.at(d_trans, (tags[t - 1], tags[t]), 1)
        grad[t, at, tags[t]] -= 1
    return float((z - gold).mean()), {"transition": d_trans / rows, "first": d_first / rows}, grad / rows


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], hidden: int = 16, embedding: int = 12, steps: int = 1000, rows: int = 160, rate: float = 0.015, seed: int = 3, joint: int = 150) -> dict[str, np.ndarray]:
    """Fits the tagger to labelled texts of WINDOW characters by Adam: on the characters' own likelihoods at first, which is cheap, in the last ``joint`` steps on the CRF's."""
    x = np.full((len(labelled), WINDOW), SYMBOLS - 3)
    y = np.zeros((len(labelled), WINDOW), np.int64)
    for i, (text, spans) in enumerate(labelled):
        x[i, : len(text)] = codes(text)
        y[i, : len(text)] = tags_of(len(text), spans)
    p = initial(hidden, embedding, seed)
    g = np.random.default_rng(seed)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        pick = g.integers(0, len(x), rows)
        scores, (emb, h, held_a, held_b) = emissions(p, x[pick], True)
        tags = y[pick].T
        if step > steps - joint:
            _, grads, d = _crf(p, scores, tags)
        else:
            d = np.exp(scores - scores.max(2, keepdims=True))
            d /= d.sum(2, keepdims=True)
            np.put_along_axis(d, tags[:, :, None], np.take_along_axis(d, tags[:, :, None], 2) - 1, 2)
            d /= rows
            grads = {k: np.zeros_like(p[k]) for k in ("transition", "first")}
        d = d.astype(np.float32)
        flat = d.reshape(-1, TAGS)
        grads["out"], grads["out_bias"] = h.reshape(len(flat), -1).T @ flat, flat.sum(0)
        dh = d @ p["out"].T
        dx_a, grads["forward"], grads["forward_bias"] = _lstm_back(emb, p["forward"], held_a, dh[:, :, :hidden])
        dx_b, grads["backward"], grads["backward_bias"] = _lstm_back(emb[::-1], p["backward"], held_b, dh[::-1, :, hidden:])
        d_embedding = np.zeros_like(p["embedding"])
        np.add.at(d_embedding, x[pick].T, dx_a + dx_b[::-1])
        grads["embedding"] = d_embedding
        norm = np.sqrt(sum(float((a * a).sum()) for a in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        now = rate * (1 - 0.9 * step / steps)
        for k, a in grads.items():
            a = a * scale
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        for k in ("transition", "first"):
            p[k] = np.clip(p[k], -MOST_TRANSITION, MOST_TRANSITION)
    return p


def _reader(p: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol adds to the gates, and the recurrent weights; the gates' halves, so that one tanh serves for all."""
    hidden, width = p[way].shape[1] // 4, p["embedding"].shape[1]
    half = np.where(np.arange(4 * hidden) < 3 * hidden, 0.5, 1.0).astype(np.float32)
    return (p["embedding"] @ p[way][:width] + p[way + "_bias"]) * half, p[way][width:] * half


def _states(table: np.ndarray, recurrent: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """(steps, rows) symbols -> (steps, rows, hidden); the same as _lstm() without what training needs."""
    steps, rows = symbols.shape
    hidden = recurrent.shape[0]
    out = np.empty((steps, rows, hidden), np.float32)
    h, c, tc = (np.zeros((rows, hidden), np.float32) for _ in range(3))
    z, added = np.empty((rows, 4 * hidden), np.float32), np.empty((rows, 4 * hidden), np.float32)
    i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
    for t in range(steps):
        np.take(table, symbols[t], axis=0, out=added, mode="clip")
        np.matmul(h, recurrent, out=z)
        z += added
        np.tanh(z, out=z)
        # a gate is (1 + tanh) / 2
        f += 1
        i += 1
        c *= f
        np.multiply(i, g, out=tc)
        c += tc
        c *= 0.5
        np.tanh(c, out=tc)
        o += 1
        h = out[t]
        np.multiply(o, tc, out=h)
        h *= 0.5
    return out


def surely_outside(p: dict[str, np.ndarray]) -> float:
    """By how much "outside" must lead all other tags of a character for the best path to pass through it, whatever stands around."""
    trans, first = p["transition"], p["first"]
    after = (trans[1:] - trans[0]).max(1)  # what any other tag gains over "outside" towards the next one
    before = max(float(trans[a, tag] - trans[a, 0] + after[tag - 1]) for a in range(TAGS) for tag in range(1, TAGS))
    return max(before, float((first[1:] - first[0] + after).max()), 0.0) + 1e-3


def may_be_inside(p: dict[str, np.ndarray], leads: np.ndarray) -> np.ndarray:
    """Which characters the best path may pass by another tag than "outside", by how far that leads at each.

    A stretch of other tags gains at most what these lead by at its characters, the best transition between two of them for each step, and
    the best ways in and out. A character is in question only if the best stretch around it, from sums to both sides, gains.
    """
    trans, first = p["transition"], p["first"]
    step = float((trans[1:, 1:] - trans[0, 0]).max())
    ends = max(float((trans[0, 1:] - trans[0, 0]).max()), float((first[1:] - first[0]).max())) + max(float((trans[1:, 0] - trans[0, 0]).max()), 0.0) - step
    gain = step - leads.astype(np.float64)

    def best(g: np.ndarray) -> np.ndarray:
        """The best sum of a stretch that ends at each place."""
        sums = np.cumsum(g)
        return sums - np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))

    return best(gain) + best(gain[::-1])[::-1] - gain + ends > -1e-3


def marked(p: dict[str, np.ndarray], texts: list[str], rows: int = 1024, zones: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each whole text: overlapping windows are read, their scores merged by the distance from a window's
    edge, and one best path over the text is found. Where "outside" surely leads, the path is known, so that only the stretches
    between go through the search; scores are held for these alone.

    With ``zones`` (start, end) of each text only the spans of that same path are wanted that touch a zone. The stretches around zones are then
    searched, and the windows that these reach into are read; spans elsewhere may be left out.
    """
    if zones is None:
        return _marked(p, texts, [[(0, len(t))] if t else [] for t in texts], 0, rows)[0]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    todo, reach = [i for i, z in enumerate(zones) if z], 0
    while todo:
        found, closed = _marked(p, [texts[i] for i in todo], [zones[i] for i in todo], reach, rows)
        for i, spans, whole in zip(todo, found, closed, strict=True):
            if whole:
                out[i] = spans
        # a stretch that leaves the windows read so far: more of them to both sides, all in the end
        todo, reach = [i for i, whole in zip(todo, closed, strict=True) if not whole], 2 * reach + 1
    return out


def _marked(p: dict[str, np.ndarray], texts: list[str], zones: list[list[tuple[int, int]]], reach: int, rows: int) -> tuple[list[list[tuple[int, int, int]]], list[bool]]:
    """Spans from the windows that touch a zone and ``reach`` more to both sides, and whether no stretch that touches a zone leaves these."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    flat = np.concatenate([codes(t) for t in texts if t]) if sizes.sum() else np.zeros(0, np.int64)
    shared = READ - STRIDE
    starts, ends, read = [], [], []
    wanted, known = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    for at, n, own_zones in zip(offsets.tolist(), sizes.tolist(), zones, strict=True):
        if n:
            own = np.arange(at, at + max(1, n - shared), STRIDE)
            starts.append(own)
            ends.append(np.minimum(own + READ, at + n))
            taken = np.zeros(len(own), bool)
            for x, y in own_zones:
                # with a character to both sides
                x, y = max(0, x - 1), min(n, y + 1)
                wanted[at + x : at + y] = True
                taken[max(0, (x - READ) // STRIDE + 1 - reach) : (y - 1) // STRIDE + 1 + reach] = True
            read.append(taken)
    if not starts:
        return [[] for _ in texts], [True] * len(texts)
    starts, ends, read = np.concatenate(starts), np.concatenate(ends), np.concatenate(read)
    # whether the window before, and the one behind, are of the same text: it then reaches into this one's beginning, or end
    after = np.concatenate([[False], (np.diff(starts) == STRIDE) & (ends[:-1] == starts[:-1] + READ) & (ends[:-1] > starts[1:])])
    before = np.append(after[1:], False)
    # a beginning that is shared with a window that is not read stays unknown
    lone = (after & ~np.append(False, read[:-1]))[read]
    starts, ends, after, before = starts[read], ends[read], after[read] & ~lone, before[read]
    ahead, back = _reader(p, "forward"), _reader(p, "backward")
    hidden = ahead[1].shape[0]
    rising = np.arange(1, shared + 1, dtype=np.float32)[:, None, None] / (shared + 1)
    sure = surely_outside(p)
    steps = np.arange(READ)[:, None]
    # what is not read is told from what leads surely by ``known`` alone
    leads, kept_at, kept, tail = np.full(len(flat), sure + 1, np.float32), [], [], np.zeros((shared, 1, TAGS), np.float32)
    for a in range(0, len(starts), rows):
        some, upto, joins = starts[a : a + rows], ends[a : a + rows], after[a : a + rows]
        places = some + steps
        inside = places < upto
        symbols = np.take(flat, places, mode="clip")
        symbols[~inside] = SYMBOLS - 3
        scores = _states(*ahead, symbols) @ p["out"][:hidden]
        scores += _states(*back, symbols[::-1])[::-1] @ p["out"][hidden:]
        scores += p["out_bias"]
        tails = np.concatenate([tail, scores[STRIDE:]], 1)
        tail = scores[STRIDE:, -1:].copy()
        scores[:shared, joins] = scores[:shared, joins] * rising + tails[:, :-1][:, joins] * rising[::-1]
        other = scores[:, :, 1].copy()
        for k in range(2, TAGS):
            np.maximum(other, scores[:, :, k], out=other)
        lead = scores[:, :, 0] - other
        inside[STRIDE:, before[a : a + rows]] = False
        inside[:shared, lone[a : a + rows]] = False
        leads[places[inside]] = lead[inside]
        known[places[inside]] = True
        t, w = np.nonzero(inside & (lead <= sure))
        at = some[w] + t
        order = np.argsort(at)
        kept_at.append(at[order])
        kept.append(scores[t, w][order])
    at, scores = np.concatenate(kept_at), np.concatenate(kept)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    closed = np.ones(len(texts), bool)
    if not len(at):
        return out, closed.tolist()
    of = np.searchsorted(offsets, at, "right") - 1
    while (empty := sizes[of] == 0).any():
        of = np.where(empty, of - 1, of)
    # stretches that end at a character that was not read
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]))
    ending = np.append(begins[1:], len(at)) - 1
    left, right = at[begins] > offsets[of[begins]], at[ending] + 1 < (offsets + sizes)[of[ending]]
    left[left] = ~known[at[begins[left]] - 1]
    right[right] = ~known[at[ending[right]] + 1]
    open_run = left | right
    closed[of[begins[open_run & np.logical_or.reduceat(wanted[at], begins)]]] = False
    keep = may_be_inside(p, leads)[at] & ~np.repeat(open_run, ending - begins + 1)
    at, scores, of = at[keep], scores[keep], of[keep]
    if not len(at):
        return out, closed.tolist()
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
    runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True))
    trans, first = p["transition"], p["first"]
    for a, b in runs:
        text = of[a]
        if at[a] > offsets[text]:
            scores[a] += trans[0] - first
        if at[b - 1] + 1 < offsets[text] + sizes[text]:
            scores[b - 1] += trans[:, 0]
    for (a, _), tags in zip(runs, viterbi(p, [scores[a:b] for a, b in runs]), strict=True):
        base = int(at[a] - offsets[of[a]])
        out[of[a]].extend((kind, base + x, base + y) for kind, x, y in spans_of(tags))
    return out, closed.tolist()


def viterbi(p: dict[str, np.ndarray], scores: list[np.ndarray], rows: int = 256) -> list[np.ndarray]:
    """The best tags of each whole region; regions of similar length go through the steps together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    for a in range(0, len(order), rows):
        group = order[a : a + rows]
        lengths = np.array([len(scores[i]) for i in group])
        steps = int(lengths.max())
        # a region beyond a few thousand characters goes alone, so that no padding is held for the others
        if steps > 4096 and len(group) > 1:
            for i in group:
                out[i] = viterbi(p, [scores[i]], 1)[0]
            continue
        x = np.zeros((steps, len(group), TAGS), np.float32)
        for j, i in enumerate(group):
            x[: lengths[j], j] = scores[i]
        back = np.zeros((steps, len(group), TAGS), np.int8)
        best = p["first"] + x[0]
        for t in range(1, steps):
            through = best[:, :, None] + p["transition"]
            back[t] = through.argmax(1)
            now = through.max(1) + x[t]
            best = np.where((t < lengths)[:, None], now, best)
        tag = best.argmax(1)
        tags = np.zeros((steps, len(group)), np.int64)
        for t in range(steps - 1, -1, -1):
            tags[t] = tag
            if t:
                tag = np.where(t < lengths, back[t, np.arange(len(group)), tag], tag)
        for j, i in enumerate(group):
            out[i] = tags[: lengths[j], j]
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs of a kind; a beginning inside of a run starts another."""
    out: list[list[int]] = []
    for at in np.flatnonzero(tags):
        kind, begins = (int(tags[at]) - 1) // 2, tags[at] % 2 == 1
        if out and not begins and out[-1][0] == kind and out[-1][2] == at:
            out[-1][2] = int(at) + 1
        else:
            out.append([kind, int(at), int(at) + 1])
    return [tuple(x) for x in out]
