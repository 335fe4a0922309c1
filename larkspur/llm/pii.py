"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules find what their patterns define. The network is trained in
numpy from labelled spans (begin, inside and outside tags for each kind; the
loss is the CRF's negative log likelihood) and adds what the patterns miss. It
reads windows of characters that overlap by half. All kinds need a digit or an
at sign; every window that has one is decoded. A span counts in the window in which it lies
furthest from an edge; the spans of all windows of a text are then reconciled:
base spans stay, a new span may not overlap a base span or a better new span, nor
be a match that the base rule refused.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import least_by_hash, written
from larkspur.llm.kernels import blocks

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, HIDDEN = 64, 32, 16

# The base patterns. An address is found from its at sign, and a
# run of digits only from its first, which gives the same leftmost matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base rules by kind, then start; and the matches that their checks refuse."""
    found, refused = [], []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                found.append((0, start, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") for x in m[0].split(".")]
            ok = all(len(x) <= 3 and int(x or "0") <= 255 for x in parts)
            found.append((1, *m.span())) if ok else refused.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            found.append((2, *m.span())) if 16 <= len(digits) <= 19 and luhn(digits) else refused.append((2, *m.span())) if len(digits) > 12 else None
        for m in _PHONE.finditer(text):
            found.append((3, *m.span())) if 8 <= len(_only_digits(m[0])) <= 15 else refused.append((3, *m.span()))
    return found, refused


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _symbols() -> np.ndarray:
    """Class of every code point of the Basic Multilingual Plane."""
    out = np.full(1 << 16, 1, np.int8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 2 if c.isspace() else 3 if c.isupper() else 4 if c.isalpha() else 1
    for i, c in enumerate("aeiou"):
        out[ord(c)] = 5
    for c in "0123456789":
        out[ord(c)] = 6
    for i, c in enumerate("@.-+()_%:/,\n#=\"'|"):
        out[ord(c)] = 7 + i
    return out


_made: list[np.ndarray] = []
CLASSES = 7 + 17
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _codes(text: str) -> np.ndarray:
    if not _made:
        _made.append(_symbols())
    return _made[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]


def _windows(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Starts of all windows that have a hot character; 0 pads both ends of a text."""
    last = np.unique(hot // STRIDE) * STRIDE
    return np.unique((last[:, None] - np.arange(0, WIDTH, STRIDE)).ravel())


def _cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(codes) + 2 * WIDTH, np.int8)
    padded[WIDTH : WIDTH + len(codes)] = codes
    return padded[(starts + WIDTH)[:, None] + np.arange(WIDTH)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Tagger:
    """The network. ``fit`` trains it, ``tags`` decodes windows by Viterbi."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *n: (r.standard_normal(n) * 0.2).astype(np.float32)
        h = HIDDEN
        self.w = {"xf": small(CLASSES, 4 * h), "hf": small(h, 4 * h), "xb": small(CLASSES, 4 * h), "hb": small(h, 4 * h), "o": small(2 * h, TAGS), "ob": small(TAGS), "t": small(TAGS, TAGS)}
        for k in ("xf", "xb"):
            self.w[k][:, h : 2 * h] += 1.0  # remember at first

    def _run(self, codes: np.ndarray, way: str, keep: bool):
        """Hidden states of one direction, in text order, and what the backward pass needs."""
        n, steps = codes.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        saved = []
        k = HIDDEN
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = self.w["x" + way][codes[:, t]] + h @ self.w["h" + way]
            s = _sigmoid(z[:, : 3 * k])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((t, i, f, o, g, before, tc, last))
        return out, saved

    def _scores(self, codes: np.ndarray, keep: bool = False):
        f, sf = self._run(codes, "f", keep)
        b, sb = self._run(codes, "b", keep)
        both = np.concatenate((f, b), axis=2)
        return both @ self.w["o"] + self.w["ob"], both, sf, sb

    def tags(self, codes: np.ndarray) -> np.ndarray:
        e, *_ = self._scores(codes)
        best = e[0]
        steps = len(e)
        link = np.zeros((steps, len(codes), TAGS), np.int8)
        for t in range(1, steps):
            all_ways = best[:, :, None] + self.w["t"][None]
            link[t] = all_ways.argmax(axis=1)
            best = np.take_along_axis(all_ways, link[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        out = np.zeros((len(codes), steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(codes))
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = link[t][rows, out[:, t]]
        return out

    def fit(self, codes: np.ndarray, gold: np.ndarray, rounds: int = 600, size: int = 96, rate: float = 0.02, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, rounds + 1):
            pick = r.integers(0, len(codes), size)
            grad = self._gradient(codes[pick], gold[pick])
            pace = rate * (1 - 0.9 * step / rounds)
            for k, g in grad.items():
                g = np.clip(g / size, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradient(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        e, both, sf, sb = self._scores(codes, keep=True)
        steps, n, _ = e.shape
        trans = self.w["t"]
        top = lambda x, axis: (y := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(y, axis)).sum(axis=axis))
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            a[t] = top(a[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = top(trans[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = top(a[-1], 1)
        de = np.exp(a + b - z[None, :, None])
        dt = np.zeros_like(trans)
        rows = np.arange(n)
        for t in range(steps):
            de[t, rows, gold[:, t]] -= 1
            if t:
                dt += np.exp(a[t - 1][:, :, None] + trans[None] + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.add.at(dt, (gold[:, t - 1], gold[:, t]), -1)
        flat = de.reshape(-1, TAGS)
        grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ flat, "ob": flat.sum(axis=0), "t": dt}
        dh = de @ self.w["o"].T
        for way, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            gx, gh = np.zeros_like(self.w["x" + way]), np.zeros_like(self.w["h" + way])
            hn, cn = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, g, before, tc, last in reversed(saved):
                d = part[t] + hn
                dc = cn + d * o * (1 - tc * tc)
                dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                np.add.at(gx, codes[:, t], dz)
                gh += last.T @ dz
                hn, cn = dz @ self.w["h" + way].T, dc * f
            grad |= {"x" + way: gx, "h" + way: gh}
        return grad


def _made_up(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines: data of all kinds in the shapes that people write, among numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    makers = (
        lambda: f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{r.choice([' @ ', '@', '@', ' @', '@ '])}{word()}.{r.choice(['com', 'org', 'de', 'example.net'])}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) if r.random() < 0.7 else r.choice([" . ", ". "]).join(str(r.randint(0, 255)) for _ in range(4)),
        card,
        lambda: r.choice([f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
    )
    others = (
        lambda: str(r.randint(1, 2030)), lambda: f"{r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"AKIA{digits(4)}{word().upper()}{digits(3)}", lambda: f"@{word()}", lambda: digits(r.choice([5, 6, 8])), lambda: f"2.0.", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(3, 12)):
            x = r.random()
            if x < 0.12:
                k = r.randrange(4)
                own = makers[k]()
                spans.append((k, len(text), len(text) + len(own)))
                text += own
            elif x < 0.3:
                text += r.choice(others)()
            else:
                own = word()
                text += own.capitalize() if r.random() < 0.2 else own
            text += r.choice([" ", " ", " ", ", ", ". ", "\n", "*** ", "### ", "%%% ", " | "])
        out.append((text, spans))
    return out


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of all windows of a text that have a trigger."""
    own = _codes(text)
    tags = np.zeros(len(own), np.int8)
    for k, lo, hi in spans:
        if not tags[lo:hi].any():
            tags[lo:hi], tags[lo] = 2 * k + 2, 2 * k + 1
    starts = _windows(own, np.flatnonzero((own == 6) | (own == 7)))
    return _cut(own, starts), _cut(tags, starts)


def _learnable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in which every digit and at sign belongs to a base span, so that nothing the rules miss is taught as outside."""
    for batch in blocks(batches, "_text"):
        codes, tags = [], []
        for text in batch.column("_text").to_pylist():
            spans = base_spans(text)[0]
            if spans:
                c, t = _labelled(text, spans)
                good = ((t > 0) | (c != 6) & (c != 7)).all(axis=1) & (t > 0).any(axis=1)
                codes.append(c[good]), tags.append(t[good])
        if codes:
            out = [pa.array([row.tobytes() for row in np.concatenate(x).astype(np.int8)], pa.binary()) for x in (codes, tags)]
            yield pa.RecordBatch.from_arrays(out, ["_codes", "_tags"])


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], windows: list[tuple[bytes, bytes]] = (), seed: int = 7, rounds: int = 600) -> Tagger:
    """Fit a tagger on texts with their spans (kind, start, end), and on windows of codes with their tags."""
    pairs = [_labelled(text, spans) for text, spans in labelled]
    pairs += [tuple(np.frombuffer(x, np.int8).reshape(1, -1) for x in pair) for pair in windows]
    tagger = Tagger(seed)
    if sum(len(c) for c, _ in pairs):
        tagger.fit(*(np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True)), rounds)
    return tagger


def _plausible(kind: int, text: str, lo: int, hi: int) -> bool:
    """Whether a decoded span can be of its kind at all."""
    own = text[lo:hi]
    if (lo and text[lo - 1].isalnum()) or (hi < len(text) and text[hi].isalnum()) or "\n" in own:
        return False
    digits = len(_only_digits(own))
    if kind == 0:
        return "@" in own and "." in own.partition("@")[2]
    if kind == 1:
        parts = [x.strip() for x in own.split(".")]
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 16 <= digits <= 19 and luhn(_only_digits(own)) and not any(c.isalpha() for c in own)
    return 9 <= digits <= 15 and own[:1] in "+(0123456789" and all(c in "+().- 0123456789" for c in own) and any(c in " -)" for c in own)


def reconcile(text: str, base: list[tuple[int, int, int]], refused: list[tuple[int, int, int]], starts: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans of a text: the base ones and those of its windows, by kind, then start."""
    new: dict[tuple[int, int, int], int] = {}
    for w, row in zip(starts.tolist(), tags, strict=True):
        if not row.any():
            continue
        i = 0
        while i < WIDTH:
            tag = int(row[i])
            if tag and tag % 2:
                j = i + 1
                while j < WIDTH and row[j] == tag + 1:
                    j += 1
                span = ((tag - 1) // 2, w + i, w + j)
                new[span] = max(new.get(span, -1), min(i, WIDTH - j))
                i = j
            else:
                i += 1
    taken, refused = [(lo, hi) for _, lo, hi in base], set(refused)
    out = list(base)
    for (kind, lo, hi), edge in sorted(new.items(), key=lambda x: (-x[1], x[0][1], x[0])):
        lo, hi = max(lo, 0), min(hi, len(text))
        if edge > 0 and lo < hi and not any(a < hi and lo < b for a, b in taken) and (kind, lo, hi) not in refused and _plausible(kind, text, lo, hi):
            out.append((kind, lo, hi))
            taken.append((lo, hi))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in blocks(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            found, held, many = [], [], 0
            counts = np.zeros((len(texts), 4), np.int64)
            sums, spans = [], []
            for i, text in enumerate(texts):
                base, refused = base_spans(text)
                for k, _, _ in base:
                    counts[i, k] += 1
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base))
                if _TRIGGER.search(text):
                    codes = _codes(text)
                    starts = _windows(codes, np.flatnonzero((codes == 6) | (codes == 7)))
                    if len(starts):
                        found.append((i, base, refused, starts))
                        held.append(_cut(codes, starts))
            if held:
                every = np.concatenate(held).astype(np.int64)
                tags = np.concatenate([tagger.tags(every[j : j + 2048]) for j in range(0, len(every), 2048)])
                for i, base, refused, starts in found:
                    own = tags[many : many + len(starts)]
                    many += len(starts)
                    spans[i] = _joined(reconcile(texts[i], base, refused, starts, own))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(counts[:, k].copy()) for k in range(4)], pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, sample: int = 4000, made_up: int = 3000, rounds: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every row.

    The network learns from ``made_up`` generated lines and from at most
    ``sample`` different windows of 64 characters of the texts, labelled by the base
    rules, the least by a hash: the bound on what reaches the driver. Returns
    ``id_col``, ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` (base spans),
    ``base_sha256`` of the base spans, and ``spans``, base and new ones, as
    kind:start:end by kind, then start, in code points. Base spans have any
    length; a new one lies inside a window, so it has at most 62 characters.
    Null text is empty text. Rows are judged one by one, so repeated rows give
    equal results, and a very long text is read whole. An empty table gives an
    empty table. Other columns are ignored, so none can clash.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    windows = rows.filter(F.col("_text").rlike("[0-9@]")).select("_text").mapInArrow(_learnable, "_codes binary, _tags binary").distinct()
    some = least_by_hash(written(windows, "pii-windows"), sample, "_codes", "_tags").collect()
    shared = spark.sparkContext.broadcast(train(_made_up(made_up), [(bytes(x["_codes"]), bytes(x["_tags"])) for x in some], rounds=rounds))
    out = rows.mapInArrow(_find(shared), f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)
