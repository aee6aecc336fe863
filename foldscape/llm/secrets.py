"""Secret scan: fixed patterns, and a character convolutional network over candidates.

The patterns (BASE) always count.  A candidate is a maximal run of at least SHORTEST
characters of [A-Za-z0-9+/_.=-] with a letter and a digit that overlaps no base finding.
The network sees its characters and those around it: BEFORE ahead, up to INSIDE of it and
AFTER behind, each as one symbol and whether it is inside.  Of a longer candidate it sees, without
what is around them, windows of INSIDE characters too: one each STEP characters, the last INSIDE, and one from each
place behind some of / _ . = -; and the parts between these.  Windows and parts have at least SHORTEST
characters, a letter and a digit, as candidates do; the candidate has the largest probability and is found whole.
The network is one convolution, maximum and mean over places, one hidden layer.  It is trained by
`train` on labelled findings, on the driver, with numpy; Platt scaling on findings kept
aside makes its output a probability, and the threshold is the highest that keeps the
wanted recall on them.  Without labelled findings of one's own, `generated_findings` makes
them from the formats of keys and of what is often taken for one, by a seed.

Defined results: a null or empty text has no spans; repeated documents are each scanned;
spans count code points, the end is exclusive.  A very long
text is scanned whole, in time in proportion to it and its findings.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
import inspect
import io
import random
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_root
from .common import add_from_text, chunks, filesystem, flat, write_bytes

#: kind, pattern, group whose length counts, least length
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
LEARNT = "learnt"
KINDS = [k for k, *_ in BASE] + [LEARNT]
SHORTEST = 16
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
RECALL = 0.97
STEP = INSIDE // 2
KERNEL, FILTERS, HIDDEN = 5, 24, 16

_B = np.arange(256)
_ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_CANDIDATE = _ALNUM | np.isin(_B, list(b"+/_.=-"))
_SPLIT = np.isin(_B, list(b"/_.=-"))
_LETTER = _ALNUM & (_B > 57)
_DIGIT = (_B >= 48) & (_B <= 57)
_HEX = _DIGIT | ((_B >= 97) & (_B <= 102))
#: 0 nothing, 1-26 small, 27-52 capital, 53-62 digits, then others
_SYMBOL = np.full(256, 79, dtype=np.int64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n,;()@"):
    _SYMBOL[_c] = _i + 1
_SYMBOLS = 81  # the last: inside the candidate


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the patterns' findings, leftmost and not overlapping for each kind."""
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _runs(mask: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least `least` in mask, which begins[] part."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], mask[:-1]]) & ~begins[:-1]
    after = np.concatenate([mask[1:], [False]]) & ~begins[1:]
    a, z = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = z - a >= least
    return a[long], z[long]


def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Symbols of each candidate and its context, within [low, high) of its text."""
    place = np.arange(LENGTH)
    at = starts[:, None] + place - BEFORE
    inside = (place >= BEFORE) & (place < BEFORE + INSIDE)
    behind = place >= BEFORE + INSIDE
    at = np.where(behind, ends[:, None] + place - BEFORE - INSIDE, at)
    ok = (at >= low[:, None]) & (at < high[:, None]) & ~(inside & (at >= ends[:, None]))
    return np.where(ok, _SYMBOL[data[np.clip(at, 0, max(len(data) - 1, 0))]], 0)


def views(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, start, end) of what the network sees of each: the candidate, and of a long one its windows and parts."""
    of, a, z = [np.arange(len(starts))], [starts], [ends]
    for c in np.flatnonzero(ends - starts > INSIDE).tolist():
        x, y = int(starts[c]), int(ends[c])
        run = data[x:y]
        split = _SPLIT[run]
        begin = np.flatnonzero(~split & np.concatenate([[True], split[:-1]]))
        end = np.flatnonzero(~split & np.concatenate([split[1:], [True]])) + 1
        slide = np.unique(np.concatenate([np.arange(0, y - x - INSIDE, STEP), [y - x - INSIDE], begin]))
        s, e = np.concatenate([slide, begin]), np.concatenate([np.minimum(slide + INSIDE, y - x), np.minimum(end, begin + INSIDE)])
        letters, digits = (np.concatenate([[0], np.cumsum(k[run])]) for k in (_LETTER, _DIGIT))
        ok = (e - s >= SHORTEST) & (letters[e] > letters[s]) & (digits[e] > digits[s])
        of.append(np.full(int(ok.sum()), c))
        a.append(x + s[ok])
        z.append(x + e[ok])
    return np.concatenate(of), np.concatenate(a), np.concatenate(z)


@dataclass
class Network:
    """Weights; logit(x) = calibrated; threshold on the probability."""

    conv: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def inputs(symbols: np.ndarray) -> np.ndarray:
        """One-hot windows of KERNEL places: rows (example, place)."""
        n = len(symbols)
        hot = np.zeros((n, LENGTH, _SYMBOLS), dtype=np.float32)
        i, j = np.nonzero(symbols)
        hot[i, j, symbols[i, j]] = 1
        hot[:, BEFORE : BEFORE + INSIDE, _SYMBOLS - 1] = symbols[:, BEFORE : BEFORE + INSIDE] > 0
        places = LENGTH - KERNEL + 1
        return np.concatenate([hot[:, k : k + places] for k in range(KERNEL)], axis=2).reshape(n * places, KERNEL * _SYMBOLS)

    def forward(self, x: np.ndarray, n: int) -> tuple:
        places = LENGTH - KERNEL + 1
        a = np.maximum(x @ self.conv + self.bias, 0).reshape(n, places, FILTERS)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ self.w1 + self.b1, 0)
        return a, top, pooled, h, h @ self.w2 + self.b2

    def probability(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols))
        for i in range(0, len(symbols), 256):
            part = symbols[i : i + 256]
            z = self.forward(self.inputs(part), len(part))[-1]
            out[i : i + 256] = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))
        return out

    def judge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The probability of each candidate: the largest of its views."""
        of, a, z = views(data, starts, ends)
        out = np.zeros(len(starts))
        for i in range(0, len(of), 4096):
            k = slice(i, i + 4096)
            cut = np.arange(len(of))[k] >= len(starts)  # windows and parts are seen without what is around them
            np.maximum.at(out, of[k], self.probability(encode(data, a[k], z[k], np.where(cut, a[k], low[of[k]]), np.where(cut, z[k], high[of[k]]))))
        return out


def train(findings: list[tuple[str, int, int, int]], seed: int = 7, epochs: int = 5, rate: float = 3e-3, recall: float = RECALL) -> Network:
    """findings: (text, start, end, label) in bytes of ASCII text. A quarter is kept aside to calibrate."""
    rng = np.random.default_rng(seed)
    symbols = np.concatenate([encode(d, np.array([a]), np.array([z]), np.array([0]), np.array([len(d)])) for d, a, z in ((np.frombuffer(t.encode(), np.uint8), a, z) for t, a, z, _ in findings)])
    y = np.array([f[3] for f in findings], dtype=np.float32)
    more: list[np.ndarray] = []
    aside = np.arange(len(y)) % 4 == 0
    for i in np.flatnonzero(~aside & (y == 0)).tolist():  # windows and parts of what is no key are none either
        text, start, end, _ = findings[i]
        if end - start > INSIDE:
            d = np.frombuffer(text.encode(), np.uint8)
            _, a, z = (x[1:] for x in views(d, np.array([start]), np.array([end])))
            more.append(encode(d, a, z, a, z))
    symbols = np.concatenate([symbols, *more])
    extra = len(symbols) - len(y)
    y, aside = np.concatenate([y, np.zeros(extra, np.float32)]), np.concatenate([aside, np.zeros(extra, bool)])
    init = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
    net = Network(init(KERNEL * _SYMBOLS, FILTERS) * 4, np.zeros(FILTERS, np.float32), init(2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN), 0.0)
    names = ["conv", "bias", "w1", "b1", "w2", "b2"]
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    rows = np.flatnonzero(~aside)
    places = LENGTH - KERNEL + 1
    for _ in range(epochs):
        rng.shuffle(rows)
        for i in range(0, len(rows), 64):
            k = rows[i : i + 64]
            n = len(k)
            x = net.inputs(symbols[k])
            a, top, pooled, h, z = net.forward(x, n)
            dz = (1 / (1 + np.exp(-z)) - y[k]) / n
            dh = dz[:, None] * net.w2 * (h > 0)
            dp = dh @ net.w1.T
            da = np.broadcast_to(dp[:, None, FILTERS:] / places, a.shape).copy()
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :FILTERS], 1)
            da = (da * (a > 0)).reshape(n * places, FILTERS)
            grads = {"conv": x.T @ da, "bias": da.sum(0), "w1": pooled.T @ dh, "b1": dh.sum(0), "w2": h.T @ dz, "b2": float(dz.sum())}
            step += 1
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                setattr(net, name, getattr(net, name) - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7))
    z = np.concatenate([net.forward(net.inputs(symbols[k]), len(k))[-1] for k in np.array_split(np.flatnonzero(aside), 8)])
    from .toxicity import fit_logistic

    net.slope, net.shift = fit_logistic(z.astype(float), y[aside].astype(float), np.ones(int(aside.sum())))
    kept = [(np.frombuffer(findings[i][0].encode(), np.uint8), *(np.array([k]) for k in findings[i][1:3])) for i in np.flatnonzero(aside & (y == 1)).tolist()]
    p = np.sort([float(net.judge(d, a, z, np.array([0]), np.array([len(d)]))[0]) for d, a, z in kept])
    net.threshold = float(p[int((1 - recall) * len(p))]) if len(p) else 0.5
    return net


def generated_findings(n: int = 10000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings by a seed: keys in many formats, and strings that are often taken for keys."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    syllables = ["".join(rng.choice(lower) for _ in range(rng.randint(2, 3))) for _ in range(80)] + "the an ing tion er st con de re in on at en".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    mixed = lower + upper + digits
    keys = [
        lambda: some(mixed, 20, 48),
        lambda: some(mixed + "+/", 24, 64) + rng.choice(["", "=", "=="]),
        lambda: some(mixed + "_-", 20, 44),
        lambda: rng.choice(["ghp_", "gho_", "sk_live_", "pk_test_", "sk-", "xoxb-", "glpat-", "npm_", "hf_"]) + some(mixed, 20, 40),
        lambda: "eyJ" + some(mixed, 16, 30) + "." + some(mixed + "_-", 20, 40) + "." + some(mixed + "_-", 20, 40),
        lambda: some(upper + digits, 18, 40),
        lambda: some("0123456789abcdef", 20, 31),
        lambda: some("0123456789ABCDEF", 24, 64),
        lambda: some(lower + digits, 20, 40),
    ]
    others = [
        lambda: "-".join(word() for _ in range(rng.randint(2, 6))) + some(digits, 1, 3),
        lambda: "/".join(word() for _ in range(rng.randint(2, 5))) + rng.choice([".html", ".php", "2", "/v1", ".mp3"]),
        lambda: f"{word()}{word()}.{some(digits, 1, 2)}.{rng.choice(['example.com', 'org', 'net'])}",
        lambda: f"mail{some(digits, 1, 1)}.{word()}.example.com",
        lambda: "_".join(word() for _ in range(rng.randint(2, 5))) + some(digits, 1, 4),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: word() + word() + word() + some(digits, 1, 4),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + some(digits, 1, 2),
        lambda: ".".join(some(digits, 1, 3) for _ in range(4)) + "-" + word() + word(),
        lambda: "=" * rng.randint(8, 20) + word() + some(digits, 1, 1) + "=" * rng.randint(4, 20),
        lambda: f"{word()}-{some(digits, 1, 2)}.{some(digits, 1, 2)}.{some(digits, 1, 2)}-{word()}.tar.gz",
        lambda: "".join(word() + rng.choice([".", "-", ""]) for _ in range(3)) + some(digits, 2, 2) + word(),
        lambda: word().upper() + word().upper() + word().upper() + some(digits, 1, 3),
        lambda: rng.choice("/-_.").join(word() for _ in range(rng.randint(8, 18))) + rng.choice(["/", "-", ""]) + word() + some(digits, 1, 4) + rng.choice(["", ".html", "/" + word()]),
    ]
    leads = ["key: ", "key=", "Authorization: Bearer ", "credentials ", 'auth "', "export X=", "private ", "access ", "with ", "and ", "", "", "", ""]
    out = []
    while len(out) < n:
        label = rng.random() < 0.5
        made = rng.choice(keys if label else others)()
        kinds = {c.isalpha() * 1 + c.isdigit() * 2 for c in made}
        if len(made) < SHORTEST or not {1, 2} <= kinds:
            continue
        lead = " ".join(word() for _ in range(rng.randint(0, 6)))
        if rng.random() < (0.6 if label else 0.15):
            lead += " " + rng.choice(leads)
        else:
            lead += rng.choice([" ", " ", "\n", '"', " (", "", "@", "://"] if not label else [" ", " ", "\n", '"', "", " ("])
        tail = rng.choice([" ", ".", "\n", '"', ", ", ""]) + " ".join(word() for _ in range(rng.randint(0, 4)))
        a, z = len(lead), len(lead) + len(made)
        while a and _CANDIDATE[ord(lead[a - 1])]:
            lead, a, z = lead[:-1] + " ", a, z
        while tail and _CANDIDATE[ord(tail[0])]:
            tail = " " + tail[1:]
        out.append((lead + made + tail, a, z, int(label)))
    return out


_trained: Network | None = None


def default_network(spark: SparkSession | None = None) -> Network:
    """The network trained on the generated findings, once for each driver; with a session, once for each shared folder,
    where it is kept under a digest of this module."""
    global _trained
    if _trained is None:
        if spark is None:
            _trained = train(generated_findings())
            return _trained
        own = hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:32]
        uri = f"{shared_root(spark)}/secrets-network-{own}.npz"
        where, path = filesystem(uri)
        if where.get_file_info(path).size:
            with where.open_input_file(path) as f:
                held = np.load(io.BytesIO(f.read()))
            _trained = Network(**{k: held[k] if held[k].ndim else float(held[k]) for k in held.files})
        else:
            _trained = train(generated_findings())
            blob = io.BytesIO()
            np.savez(blob, **vars(_trained))
            write_bytes(uri, [blob.getvalue()])
    return _trained


def scan_column(column: pa.Array, net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, number of kind, end) of all findings of each text, in order."""
    data, offsets = flat(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for i, j in chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        begins = np.zeros(len(part) + 1, dtype=bool)
        begins[off] = True
        hexes, _ = _runs(_HEX[part], begins, BASE[2][3])
        texts: dict[int, str] = {}
        whole = part.tobytes()
        low = whole.lower()
        marked = set((np.searchsorted(off, hexes, side="right") - 1).tolist())
        for word in (b"passw", b"secret", b"token", b"api", b"akia"):
            at = low.find(word)
            while at >= 0:
                d = int(np.searchsorted(off, at, side="right")) - 1
                marked.add(d)
                at = low.find(word, int(off[d + 1]))
        for d in marked:
            texts[d] = whole[off[d] : off[d + 1]].decode()
            out[i + d] = base_spans(texts[d])
        a, z = _runs(_CANDIDATE[part], begins, SHORTEST)
        letters, digits = (np.concatenate([[0], np.cumsum(x[part])]) for x in (_LETTER, _DIGIT))
        ok = (letters[z] > letters[a]) & (digits[z] > digits[a])
        a, z = a[ok], z[ok]
        if len(a):
            doc = np.searchsorted(off, a, side="right") - 1
            yes = net.judge(part, a, z, off[doc], off[doc + 1]) >= net.threshold
            doc, a, z = doc[yes], a[yes], z[yes]
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points ahead of each byte
            start = points[a] - points[off[doc]]
            end = start + z - a
            for d in np.unique(doc).tolist():
                x, y = np.searchsorted(doc, [d, d + 1])
                base = np.array(sorted(out[i + d]), dtype=np.int64).reshape(-1, 3)
                reach = np.maximum.accumulate(base[:, 2])  # the furthest end so far
                ahead = np.searchsorted(base[:, 0], end[x:y])  # base findings that begin ahead of the candidate's end
                free = (ahead == 0) | (np.append(reach, 0)[ahead - 1] <= start[x:y])
                out[i + d] += [(p, len(BASE), q) for p, q in zip(start[x:y][free].tolist(), end[x:y][free].tolist(), strict=True)]
        for d in range(i, j):
            out[d].sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def scan_secrets(docs: DataFrame, net: Network | None = None, text_col: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans."""
    net = net or default_network(docs.sparkSession)

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for column in columns:
            found = scan_column(column, net)
            base = [[s for s in x if s[1] < len(BASE)] for x in found]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], type=pa.int64()) for k in range(len(BASE))]
            yield [*counts, pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([_joined(x) for x in found], type=pa.string())]

    return add_from_text(docs, work, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", text_col)


def redact_secrets(docs: DataFrame, net: Network | None = None, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by the mask; overlapping findings become one."""
    net = net or default_network(docs.sparkSession)

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for column in columns:
            texts = column.to_pylist()
            for i, spans in enumerate(scan_column(column, net)):
                if spans:
                    pieces, done = [], 0
                    for a, _, z in spans:
                        if a >= done:
                            pieces += [texts[i][done:a], mask]
                        done = max(done, z)
                    texts[i] = "".join([*pieces, texts[i][done:]])
            yield [pa.array(texts, type=pa.string())]

    order = docs.columns
    return add_from_text(docs, work, f"`{text_col}` string", text_col).select(*[f"`{c}`" for c in order])
