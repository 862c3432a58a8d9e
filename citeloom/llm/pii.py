"""Personal data: fixed rules, and a character BiLSTM-CRF that adds what the rules miss.

The rules give the base spans. The model is a character-level bidirectional LSTM with a linear-chain CRF,
trained in numpy from labelled spans: generated carriers with e-mail addresses, IP addresses, card and phone
numbers in usual and unusual spellings, and with numbers and tokens that are none of these. It reads
overlapping windows; the emission scores of windows that share a character are averaged with weights that fall
off to a window's edges, and one Viterbi pass over the whole stretch decodes them, so windows never disagree.

Each kind holds a digit, an @ or a spelled-out one ("at" in brackets, or "at NAME dot" as words), so only stretches around
such characters are read; a text without any has no span by definition. What the model finds must also make sense as its kind (digit counts,
Luhn, parts up to 255) and must not touch a base span.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
AT = r"(?:@|[\[(]at[\])]|(?<=\s)at(?=\s))"
DOT = r"(?:\.|[\[(]dot[\])]|(?<=\s)dot(?=\s))"
CLUE = re.compile(r"[0-9@]|[\[(]at[\])]|\sat\s(?=\S{1,63}\s(?:dot|[\[(]dot[\])])\s)", re.I)
SPELLED = re.compile(rb"[\[(]at[\])]|\sat\s\S{1,63}\s(?:dot|[\[(]dot[\])])\s", re.I)
OTHERS = bytes(c for c in range(256) if not (48 <= c <= 57 or c == 64))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The rules' spans by kind and start; linear in the text, also over long runs of digits or letters."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the model -------------------------------------------------------------------------------------------------

TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]  # B of kind k: 1 + 2k, I: 2 + 2k
WINDOW, STRIDE, MARGIN = 80, 40, 32
VOCAB = 100


def char_ids(text: str) -> np.ndarray:
    """1..95 printable ASCII, 96 newline, 97 other blanks, 98 letters and 99 marks beyond ASCII; 0 pads."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ids = np.where((c >= 32) & (c < 127), c.astype(np.int64) - 31, np.where(c == 10, 96, np.where(c < 32, 97, np.where(c < 0x2000, 98, 99))))
    return ids.astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM-CRF over character ids; parameters in one dict of arrays."""

    def __init__(self, hidden: int = 20, seed: int = 1):
        rng, h, k = np.random.default_rng(seed), hidden, len(TAGS)
        self.h, self.p = h, {}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (VOCAB, 4 * h)), f"u{d}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"c{d}": np.concatenate([np.ones(h), np.zeros(3 * h)])}
        self.p |= {"o": rng.normal(0, 0.3, (2 * h, k)), "ob": np.zeros(k), "t": np.zeros((k, k))}
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}
        self.allowed = np.zeros((k, k), np.float32)  # an I follows its own B or I only
        for j in range(2, k, 2):
            self.allowed[[i for i in range(k) if i not in (j, j - 1)], j] = -1e4

    def _run(self, ids: np.ndarray, d: str, cache: list | None = None) -> np.ndarray:
        h = self.h
        n, t = ids.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((t, n, h), np.float32)
        x, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            g = x[ids[:, s]] + state @ u + c
            gates = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h :])
            before, prior = cell, state
            cell = gates[:, :h] * cell + gates[:, h : 2 * h] * new
            tc = np.tanh(cell)
            state = gates[:, 2 * h :] * tc
            keep = (ids[:, s] > 0)[:, None]
            cell, state = cell * keep, state * keep
            out[s] = state
            if cache is not None:
                cache.append((s, gates, new, before, prior, tc, keep))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, characters, tags)."""
        both = np.concatenate([self._run(ids, "f"), self._run(ids, "b")], axis=2)
        return (both @ self.p["o"] + self.p["ob"]).transpose(1, 0, 2)

    def _back(self, ids: np.ndarray, d: str, cache: list, dout: np.ndarray, grads: dict) -> None:
        h, n = self.h, ids.shape[0]
        u = self.p["u" + d]
        ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        made, priors, order = [], [], []
        for s, gates, new, before, prior, tc, keep in reversed(cache):
            ds = (ds + dout[s]) * keep
            dc = dc * keep + ds * gates[:, 2 * h :] * (1 - tc * tc)
            dg = np.concatenate([dc * before, dc * new, ds * tc], axis=1) * gates * (1 - gates)
            dg = np.concatenate([dg, dc * gates[:, h : 2 * h] * (1 - new * new)], axis=1)
            dc = dc * gates[:, :h]
            made.append(dg)
            priors.append(prior)
            order.append(ids[:, s])
            ds = dg @ u.T
        every = np.concatenate(made)
        grads["u" + d] += np.concatenate(priors).T @ every
        grads["x" + d] += np.eye(VOCAB, dtype=np.float32)[np.concatenate(order)].T @ every
        grads["c" + d] += every.sum(axis=0)

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        caches: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(ids, "f", caches["f"]), self._run(ids, "b", caches["b"])], axis=2)
        e = both @ self.p["o"] + self.p["ob"]  # (t, n, k)
        t, n, k = e.shape
        mask = (ids > 0).T
        # forward and backward passes on probabilities, scaled at each character
        trans = self.p["t"] + self.allowed
        step, top = np.exp(trans), e.max(axis=2, keepdims=True)
        w = np.exp(e - top)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((t, n, 1), e.dtype)
        for s in range(t):
            a = w[s] if s == 0 else (alpha[s - 1] @ step) * w[s]
            on = mask[s][:, None]
            scale[s] = np.where(on, a.sum(axis=1, keepdims=True), 1)
            alpha[s] = np.where(on, a / scale[s], alpha[s - 1])
        for s in range(t - 2, -1, -1):
            b = (w[s + 1] * beta[s + 1] / scale[s + 1]) @ step.T
            beta[s] = np.where(mask[s + 1][:, None], b, beta[s + 1])
        z = ((np.log(scale) + top)[:, :, 0] * mask).sum()
        marginals = alpha * beta * mask[:, :, None]
        gold = np.eye(k, dtype=np.float32)[tags.T] * mask[:, :, None]
        grads = {name: np.zeros_like(a) for name, a in self.p.items()}
        flat = lambda x: x.reshape(-1, k)
        pairs = step * (flat(alpha[:-1] * mask[1:, :, None]).T @ flat(w[1:] * beta[1:] / scale[1:]))
        seen = flat(gold[:-1] * mask[1:, :, None]).T @ flat(gold[1:])
        score = (gold * e).sum() + (seen * trans).sum()
        grads["t"] = (pairs - seen) / n
        de = (marginals - gold) / n
        flat, back = both.reshape(-1, 2 * self.h), de.reshape(-1, k)
        grads["o"], grads["ob"] = flat.T @ back, back.sum(axis=0)
        dboth = de @ self.p["o"].T
        self._back(ids, "f", caches["f"], dboth[:, :, : self.h], grads)
        self._back(ids, "b", caches["b"], dboth[:, :, self.h :], grads)
        return float((z - score) / n), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.018, seed: int = 2) -> float:
        """Adam; the last epoch's mean loss."""
        rng, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        total = epochs * (-(-len(ids) // batch))
        for _ in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                loss, grads = self.loss_and_grads(ids[part], tags[part])
                losses.append(loss)
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    self.p[name] -= (rate * (1 - 0.9 * step / total) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of emissions (sequences, characters, tags), each up to its length."""
        n, t, k = e.shape
        trans = self.p["t"] + self.allowed
        start = np.where(np.arange(k) % 2 == 0, np.where(np.arange(k) > 0, -1e4, 0), 0)
        score, back = e[:, 0] + start, np.zeros((t, n, k), np.int8)
        for s in range(1, t):
            x = score[:, :, None] + trans
            back[s] = x.argmax(axis=1)
            on = (s < lengths)[:, None]
            back[s] = np.where(on, back[s], np.arange(k))
            score = np.where(on, x.max(axis=1) + e[:, s], score)
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[s][np.arange(n), tags[:, s]]
        return tags


# --- labelled spans --------------------------------------------------------------------------------------------


def _word(rng: np.random.Generator, low: int = 2, high: int = 9) -> str:
    return "".join(rng.choice(list("etaoinshrdlucmfwypvbgkéäüñ"), int(rng.integers(low, high))))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = _digits(rng, 15)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def labelled_item(rng: np.random.Generator) -> tuple[str, str | None]:
    """(text, kind) of a span in one of its spellings, or of something that is none (kind None)."""
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    kind = pick("email", "email", "ip", "card", "phone", None, None)
    if kind == "email":
        local = pick(_word(rng), _word(rng) + "." + _word(rng), _word(rng) + _digits(rng, 2), _word(rng) + "." + _digits(rng, 2))
        parts = [_word(rng, 3), pick("com", "org", "net", "de", "example.com", "fr")]
        if rng.random() < 0.4:
            parts[0] += _digits(rng, 1)
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), (" AT ", " DOT "))
        return (local + at + dot.join(".".join(parts).split("."))).encode("ascii", "ignore").decode(), kind
    if kind == "ip":
        return pick(".", ".", ".", "[.]", " . ").join(map(str, rng.integers(0, 256, 4))), kind
    if kind == "card":
        c, sep = _card(rng), pick("", "", " ", "-", ".", "  ", "/")
        return sep.join(c[i : i + 4] for i in range(0, 16, 4)), kind
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_digits(rng, 2)} {a} {b}{c}", f"({a}) {b} {c}", f"00{_digits(rng, 2)} {a} {b} {c}"), kind
    token = "".join(rng.choice(list("0123456789abcdef"), 40))
    return pick(f'token = "{token}"', token, _digits(rng, int(rng.integers(1, 5))), f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"${_digits(rng, 2)}.{_digits(rng, 2)}", f"{_digits(rng, 1)}.{_digits(rng, 1)}.{_digits(rng, 1)}", f"{_digits(rng, 1)},{_digits(rng, 3)},{_digits(rng, 3)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", _digits(rng, int(rng.integers(20, 30))), f"v{_digits(rng, 2)}", f"@{_word(rng)}"), None


def labelled_windows(n: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tags) of `n` generated windows."""
    rng = np.random.default_rng(seed)
    ids, tags = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = "", []
        noise = ["", "", "", "", "!!", "###", "&&&", "$$$", "%%%", "***", ",", ".", " |"][int(rng.integers(0, 13))]
        upper = rng.random() < 0.15
        while len(text) < WINDOW:
            if rng.random() < 0.22:
                item, kind = labelled_item(rng)
                if kind:
                    spans.append((kind, len(text), len(text) + len(item)))
            else:
                item = _word(rng)
                item = item.upper() if upper else item
            text += item + noise + ("\n" if rng.random() < 0.05 else " ")
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        ids[i] = char_ids(text)[cut : cut + WINDOW]
        for kind, s, e in spans:
            k = KINDS.index(kind)
            for c in range(max(s, cut), min(e, cut + WINDOW)):
                tags[i, c - cut] = 1 + 2 * k if c == max(s, cut) else 2 + 2 * k
    return ids, tags


@lru_cache(maxsize=2)
def trained(n: int = 5000, seed: int = 1) -> Tagger:
    """The tagger fitted on `n` generated windows; the same in every run."""
    tagger = Tagger(seed=seed)
    tagger.fit(*labelled_windows(n))
    return tagger


# --- reading texts ---------------------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """The stretches around clues, MARGIN characters to each side, merged."""
    out: list[tuple[int, int]] = []
    for m in CLUE.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def tag_stretches(pieces: list[np.ndarray], tagger: Tagger, batch: int = 512) -> list[np.ndarray]:
    """Tags of each piece: windows scored in batches, averaged where they overlap, decoded over the whole piece."""
    plan = [(x, s) for x, p in enumerate(pieces) for s in range(0, max(1, len(p) - WINDOW + STRIDE), STRIDE)]
    sums = [np.zeros((len(p), len(TAGS)), np.float32) for p in pieces]
    weight = [np.zeros((len(p), 1), np.float32) for p in pieces]
    fall = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None]
    for i in range(0, len(plan), batch):
        part = plan[i : i + batch]
        ids = np.zeros((len(part), WINDOW), np.uint8)
        for r, (x, s) in enumerate(part):
            got = pieces[x][s : s + WINDOW]
            ids[r, : len(got)] = got
        e = tagger.emissions(ids)
        for r, (x, s) in enumerate(part):
            n = min(WINDOW, len(pieces[x]) - s)
            sums[x][s : s + n] += e[r, :n] * fall[:n]
            weight[x][s : s + n] += fall[:n]
    tags: list[np.ndarray] = [np.empty(0, np.int8)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda x: len(pieces[x]))
    i = 0
    while i < len(order):
        j, longest = i, len(pieces[order[i]])
        while j < len(order) and j - i < 256 and len(pieces[order[j]]) <= 1.5 * longest + 16:
            j += 1
        part = order[i:j]
        lengths = np.array([len(pieces[x]) for x in part])
        e = np.zeros((len(part), lengths.max(), len(TAGS)), np.float32)
        for r, x in enumerate(part):
            e[r, : len(pieces[x])] = sums[x] / weight[x]
        best = tagger.viterbi(e, lengths)
        for r, x in enumerate(part):
            tags[x] = best[r, : lengths[r]]
        i = j
    return tags


def sensible(kind: str, text: str) -> bool:
    """Whether the model's span can be its kind at all."""
    digits = "".join(DIGITS.findall(text))
    if kind == "email":
        m = re.fullmatch(rf"[A-Za-z0-9._%+-]+\s*{AT}\s*[A-Za-z0-9-]+(?:\s*{DOT}\s*[A-Za-z0-9-]+)+", text, re.I)
        return m is not None
    if kind == "ip":
        parts = DIGITS_RUN.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not text[-1:].isalpha() and sum(not c.isdigit() for c in text) >= 2


DIGITS_RUN = re.compile(r"[0-9]+")


def added_spans(tags: np.ndarray, text: str, offset: int, base: list[Span]) -> list[Span]:
    """The model's spans in one stretch that make sense and touch no base span."""
    out = []
    for s in np.flatnonzero(tags % 2 == 1).tolist():
        k = (int(tags[s]) - 1) // 2
        e = s + 1
        while e < len(tags) and tags[e] == 2 + 2 * k:
            e += 1
        piece = text[offset + s : offset + e]
        a, b = offset + s + len(piece) - len(piece.lstrip()), offset + e - (len(piece) - len(piece.rstrip()))
        if a < b and sensible(KINDS[k], text[a:b]) and not any(x < b and a < y for _, x, y in base):
            # a number that goes on beyond the span is another number
            if not (text[a - 1 : a].isalnum() and text[a].isalnum()) and not (text[b : b + 1].isalnum() and text[b - 1].isalnum()):
                out.append((KINDS[k], a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(texts: list[bytes | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed and start."""
    found: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    pieces, where = [], []
    for i, t in enumerate(texts):
        if t and (t.translate(None, OTHERS) or SPELLED.search(t)):
            text = t.decode("utf-8", "replace")
            base = base_spans(text)
            found[i] = (base, list(base))
            ids = char_ids(text)
            for s, e in stretches(text):
                pieces.append(ids[s:e])
                where.append((i, text, s))
    for tags, (i, text, s) in zip(tag_stretches(pieces, tagger), where, strict=True):
        if tags.any():
            near = [x for x in found[i][0] if x[1] < s + len(tags) and x[2] > s]
            found[i][1].extend(added_spans(tags, text, s, near))
    for _, every in found:
        every.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return found


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def detect(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and spans: an array of (kind, start, end, base), code points, by kind as listed and start.

    Null and empty texts have no spans. Whole texts are read, however long; repeated rows get equal spans; null
    ids stay. Other columns are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tagger or trained()).p)

    def run(texts: list[bytes | None]) -> list:
        model = Tagger()
        model.p = shared.value
        out = []
        for i in range(0, len(texts), 2000):
            for base, every in find_spans(texts[i : i + 2000], model):
                rules = set(base)
                out.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in rules} for k, s, e in every])
        return [out]

    return map_text(docs, text, [("spans", T.ArrayType(SPAN))], run, keep)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans of every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rules = F.filter("spans", lambda x: x["base"])

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(rules, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(said(rules), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
