"""Secret scans: rules find the base spans; a character convolutional network judges every candidate with its surrounding text.

Candidates are runs of MIN_RUN or more characters that keys, tokens and passwords are made of, if they hold a digit or a capital after a small letter, or
if a word that announces a secret stands shortly before, or in them before a sign of equality: nothing but its surroundings tells a password of plain letters from a word. The network is trained on the driver in numpy, on labelled findings: a
seeded set of written-out secrets and look-alikes, with and without a keyword, set into text of the corpus, and what rules label in a bounded sample of
the corpus (secrets by the base rules; addresses, dates and numbers as clean). What no rule knows is left unlabelled. Its scores are calibrated on
findings held out of training; bare findings, named ones and named ones of plain letters have thresholds of their own, each the highest that keeps the recall asked for there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_of, tidy, utf8, words

#: The rules' patterns; group 1 of the first is the value. The kinds in the order that spans at one start take.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "model")

#: Words that announce a secret; they tell which threshold a finding takes.
NAMES = re.compile(rb"(?i:passw|pwd|pass|secret|token|key|auth|bearer|cred)")
#: The same within a run, before the value that it holds.
INNER = re.compile(NAMES.pattern + rb"[A-Za-z_]*=")
#: What makes a run a candidate by itself.
TELLING = re.compile(rb"\d|[a-z][A-Z]")
#: Formats that are no secrets: addresses, dates, times, phone and plain numbers, web and mail addresses.
CLEAN = re.compile(rb"(?:\d{1,3}\.){3}\d{1,3}|[\d.+/_=-]{0,15}|\d{4}-\d\d-\d\d[A-Za-z0-9.+-]{0,12}|(?:www\.|http)[^@]*|[\w.+-]+@[\w-]+\.[\w.-]+")

MIN_RUN = 8
#: Characters before, inside and after that the network sees at once; a longer run is judged in windows, the highest counts.
BEFORE, INSIDE, AFTER = 24, 40, 8
#: Expected documents in the corpus sample, written findings of each label, and the share of held-out secrets that each threshold must keep.
SAMPLE_DOCS, WRITTEN, RECALL = 2000, 3000, 0.99
WIDTH, FILTERS = 5, 24

_VALUE = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-!@#$%^&*~?" for b in range(256)])
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_LOW, _UP, _DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((97, 122), (65, 90), (48, 57)))


def _classes() -> np.ndarray:
    """The class of each byte inside a candidate, where kinds of characters matter. 0 is beyond the text."""
    table = np.full(256, 1, np.uint8)
    for chars, c in (("abcdef", 2), ("ghijklmnopqrstuvwxyz", 3), ("ABCDEF", 4), ("GHIJKLMNOPQRSTUVWXYZ", 5), ("0123456789", 6), ("+/", 7), ("_", 8), (".", 9), ("=", 10), ("-", 11), ("\"'", 12), (":", 13), (" ", 14), ("\n\t\r", 15), ("@", 16)):
        for ch in chars:
            table[ord(ch)] = c
    table[128:] = 17
    return table


_CLASS, N_CLASSES = _classes(), 18
#: Outside of the candidate the network reads letters, without their case.
_READ = np.where(_LOW, np.arange(256) - 97 + N_CLASSES, np.where(_UP, np.arange(256) - 65 + N_CLASSES, _CLASS)).astype(np.uint8)
N_READ = N_CLASSES + 26
_SPAN = BEFORE + INSIDE + AFTER


def views(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees of each run [starts, ends) in a text [lo, hi): symbols, from N_READ on inside the run; and the run of each view."""
    per = np.maximum(1, -(-(ends - starts) // INSIDE))
    run = np.repeat(np.arange(len(starts)), per)
    first = starts[run] + INSIDE * (np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per))
    at = first[:, None] + np.arange(-BEFORE, INSIDE + AFTER)
    seen = (at >= lo[run][:, None]) & (at < hi[run][:, None])
    inside = (at >= starts[run][:, None]) & (at < ends[run][:, None])
    byte = raw[np.clip(at, 0, max(len(raw) - 1, 0))]
    return np.where(seen, np.where(inside, _CLASS[byte] + N_READ, _READ[byte]), 0).astype(np.uint8), run


def _near_names(body: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word that announces a secret begins in each run or in the BEFORE bytes before it, whatever text it is of: most runs are ruled out by this at once."""
    at = np.array([m.start() for m in NAMES.finditer(body)], np.int64)
    if not len(at):
        return np.zeros(len(starts), bool)
    last = np.searchsorted(at, ends) - 1
    return (last >= 0) & (at[np.maximum(last, 0)] >= starts - BEFORE)


def named(raw: np.ndarray, lo: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word that announces a secret stands shortly before each run, or in it before a sign of equality."""
    told = lambda a, s, e: NAMES.search(raw[max(a, s - BEFORE) : s].tobytes()) or INNER.search(raw[s:e].tobytes())
    return np.array([told(*place) is not None for place in zip(lo.tolist(), starts.tolist(), ends.tolist())], bool)


def kinds(raw: np.ndarray, lo: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each run which threshold it takes: 0 bare, 1 named, 2 named and of plain letters."""
    plain = np.array([TELLING.search(raw[s:e].tobytes()) is None for s, e in zip(starts.tolist(), ends.tolist())], bool)
    return named(raw, lo, starts, ends) * (1 + plain.astype(np.int64))


class Net:
    """One convolution over symbols, the maximum and the mean over positions, one output."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        n = N_READ + N_CLASSES
        self.params = {"w": rng.normal(0, 0.15, (WIDTH, n, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.3, 2 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.thresholds = 1.0, 0.0, (0.5, 0.5, 0.5)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Activations at all positions, where each filter's maximum is, and the pooled values."""
        w, n = self.params["w"].astype(np.float32), x.shape[1] - WIDTH + 1
        out = w[0][x[:, :n]]
        for k in range(1, WIDTH):
            out += w[k][x[:, k : k + n]]
        out = np.maximum(out + self.params["b"].astype(np.float32), 0)
        top = out.argmax(1)
        return out, top, np.concatenate([np.take_along_axis(out, top[:, None], 1)[:, 0], out.mean(1)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._pool(x[k : k + 256])[2] @ self.params["v"] + self.params["c"] for k in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 10, rate: float = 0.006) -> None:
        rng, weight = np.random.default_rng(seed), np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in self.params.items()}
        t, n, symbols = 0, _SPAN - WIDTH + 1, np.eye(N_READ + N_CLASSES, dtype=np.float32)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                out, top, pooled = self._pool(x[part])
                p = 1 / (1 + np.exp(-(pooled @ self.params["v"] + self.params["c"])))
                d = (p - y[part]) * weight[part] / len(part)
                back = np.repeat((np.outer(d, self.params["v"][FILTERS:]) / n).astype(np.float32)[:, None], n, 1)
                np.put_along_axis(back, top[:, None], np.take_along_axis(back, top[:, None], 1) + np.outer(d, self.params["v"][:FILTERS])[:, None], 1)
                back *= out > 0
                flat = back.reshape(-1, FILTERS)
                grads = {"w": np.stack([symbols[x[part][:, k : k + n].ravel()].T @ flat for k in range(WIDTH)]), "b": flat.sum(0), "v": pooled.T @ d, "c": np.array([d.sum()])}
                t += 1
                for name, g in grads.items():
                    m, s = state[name]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    self.params[name] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then of each kind the highest threshold that keeps the recall."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
            r = p * (1 - p)
            h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        good = [np.sort(self.score(x[(y == 1) & (kind == k)])) for k in range(3)]
        self.thresholds = tuple(float(g[int(np.floor((1 - recall) * len(g)))]) if len(g) else 1.0 for g in good)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def judge(self, score: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return score >= np.array(self.thresholds)[kind]


def written_findings(n: int, seed: int, contexts: list[tuple[str, str]] | None = None) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, label): n secrets in the ways that they are written down, and n of what looks like them. contexts: text before and after, of the corpus."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    draw = lambda chars, lo, hi: "".join(pick(chars) for _ in range(rng.integers(lo, hi + 1)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    letters = lower + upper + digits
    syllables = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "on")]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    number = lambda lo, hi: str(rng.integers(lo, hi))
    keys = ["password", "passwd", "pwd", "pass", "secret", "token", "api_key", "apikey", "auth", "bearer", "private_key", "access_key", "client_secret", "credential", "auth_token", "db_pass"]
    tokens = [
        lambda: draw("0123456789abcdef", 16, 64), lambda: draw(letters, 16, 48), lambda: draw(letters + "+/", 24, 60) + pick(["", "=", "=="]), lambda: "AKIA" + draw(upper + digits, 14, 18),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-", "pk.", "AIza", "npm_"]) + draw(letters + "_-", 16, 40), lambda: "-".join(draw(letters, 8, 14) for _ in range(3)),
        lambda: ".".join(draw(letters + "_-", 12, 40) for _ in range(3)),
    ]
    passwords = [lambda: draw(letters + "!@#$%^&*_-", 9, 20), lambda: pick([str.capitalize, str.lower])(word() + word()) + number(1, 9999) + pick("!@#$%&*"), lambda: draw(letters, 8, 16)]
    # of letters of one case: several words on end, or none; only what stands before tells them from a word
    plain = [lambda: "".join(word() for _ in range(rng.integers(3, 6)))[:30], lambda: draw(lower, 12, 24), lambda: draw(upper, 14, 32)]
    prose = lambda: pick([str.lower, str.lower, str.lower, str.capitalize, str.upper])((word() + word())[: rng.integers(8, 14)])
    camel = lambda: word() + "".join(word().capitalize() for _ in range(rng.integers(1, 4)))
    clean = [
        lambda: ".".join(number(1, 256) for _ in range(4)), lambda: f"{number(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}" + pick(["", f"T{rng.integers(10, 24)}:00Z"[:4]]), lambda: number(10**7, 10**15),
        lambda: f"www.{word()}{number(1, 99)}.example.{pick(['com', 'org', 'net'])}", lambda: "/".join([word(), word() + number(1, 999), word()]), lambda: f"{word()}_{number(1, 9999)}_{word()}.{pick(['py', 'txt', 'pdf', 'html', 'json'])}",
        camel, camel, lambda: camel() + number(1, 99), lambda: f"v{number(1, 20)}.{number(0, 20)}.{number(0, 99)}-{pick(['rc', 'beta', 'alpha'])}{number(1, 9)}", lambda: f"{draw(upper, 2, 4)}-{number(100, 10**6)}",
        lambda: f"{word()}.{word()}{number(1, 99)}@{word()}.com", lambda: word() + number(1, 2100) + pick(["", "s", "th"]), lambda: f"+{number(1, 99)}-{number(100, 999)}-{number(1000, 9999)}", lambda: f"{word()}-{number(1, 99)}-{word()}", lambda: f"${number(1000, 10**6)}.{number(10, 99)}",
        lambda: word().capitalize() + pick(["%%%", "###", "&&&", "***", "$$$"]) + number(1, 99), lambda: "".join(pick([str.upper, str.lower])(ch) for ch in word() + word()) if rng.random() < 0.3 else camel(),
        lambda: f"get_{word()}_v{number(1, 9)}", lambda: f"{word().upper()}_{word().upper()}_{number(1, 99)}", lambda: f"{word()}={number(1, 10**5)}", lambda: f"{word()}#{number(1, 10**6)}",
    ]
    out = []
    while len(out) < 2 * n:
        label = len(out) % 2
        before, after = pick(contexts) if contexts and rng.random() < 0.6 else (" ".join(word() for _ in range(4)), " ".join(word() for _ in range(2)))
        before, after = before + " ", " " + after
        way = rng.integers(6 if label else 5)
        key, sign, quote = pick([str.upper, str.lower, str.capitalize])(pick(keys)), pick([" = ", "=", ": ", ":", " => ", ":= "]), pick(["", '"', "'"])
        bare_letters = rng.random() < 0.25
        if bare_letters:
            value = pick(plain)() if label else prose()
            way = rng.integers(3, 6) if label else rng.integers(0, 2)
        else:
            value = None
        value = value or (pick(tokens) if label == 1 and (way < 3 or rng.random() < 0.5) else pick(passwords) if label else pick(clean))()
        if label:
            if way == 3 or way == 4:
                before, after = before + key + sign + quote, quote + after
            elif way == 5:
                before += pick([f"{key} is ", f"{key} = ", f"your {key}: ", f"the {key}: "] if bare_letters and not value.isupper() else [f"{key} is ", f"{key} ", f"your {key}: ", f"Authorization: {key} ", *([] if bare_letters else [f"//{word()}:"])])
            else:
                before, after = before + quote, quote + after
        elif bare_letters:  # an ordinary word after a word that announces a secret, mostly in a sentence
            before += pick([f"{key} ", f"{key} {word()} ", f"the {key} of ", f"{key}s and ", f"{key}ing the ", f"no {key}, ", f"{key} is ", key + sign])
        elif way == 0:  # a look-alike with a word that announces a secret
            before += pick([key + sign, f"{key} ", f"the {key} of "])
        elif way == 1:
            before += pick(["see", "note", "size", "name", "id", "version", "file"]) + pick([" = ", ": ", " "])
        value = re.sub(r"[^!-~]", "", value)
        if len(value) < MIN_RUN or not (bare_letters or any(c.isdigit() for c in value) or re.search("[a-z][A-Z]", value)):
            continue
        text = (before + value + after).encode()
        start, end = len(before.encode()), len((before + value).encode())
        while start and _VALUE[text[start - 1]]:  # the run as a scan finds it
            start -= 1
        while end < len(text) and _VALUE[text[end]]:
            end += 1
        out.append((text, start, end, label))
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the rules' assign and access findings; hex runs are found for all texts at once."""
    found, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found


def scan(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: base spans (row, kind, start, end) and all candidates (row, start, end), in bytes of raw."""
    base = []
    body = raw.tobytes()
    for row in range(len(offsets) - 1):
        base += [(row, k, a + int(offsets[row]), b + int(offsets[row])) for k, a, b in base_spans(body[offsets[row] : offsets[row + 1]])]
    starts, ends, _ = words(raw, offsets, ~_HEX)
    long = ends - starts >= MIN_HEX
    base += [(int(np.searchsorted(offsets, a, "right")) - 1, 2, int(a), int(b)) for a, b in zip(starts[long], ends[long])]
    starts, ends, _ = words(raw, offsets, ~_VALUE)
    telling = _DIGIT[raw]
    telling[1:] |= _UP[raw[1:]] & _LOW[raw[:-1]]
    sums = np.append(0, np.cumsum(telling))
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    row = np.searchsorted(offsets, starts, "right") - 1
    use = sums[ends] > sums[np.minimum(starts + 1, len(raw))] - _DIGIT[raw[starts]]
    ask = np.flatnonzero(~use & _near_names(body, starts, ends))
    use[ask] = named(raw, offsets[row[ask]], starts[ask], ends[ask])
    return base, row[use], starts[use], ends[use]


def _covered(base: list[tuple[int, int, int, int]], starts: np.ndarray, ends: np.ndarray, kinds: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """Which candidates lie within one base span of these kinds, but for marks at their ends."""
    spans = np.array(sorted((a, b) for _, k, a, b in base if k in kinds), np.int64).reshape(-1, 2)
    if not len(spans):
        return np.zeros(len(starts), bool)
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.searchsorted(spans[:, 0], starts, "right")  # spans that begin where the candidate does or before
    return (before > 0) & (reach[np.maximum(before - 1, 0)] >= ends)


@tidy
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Views, labels and kinds of the candidates that a rule labels, and (label null) a place of each text: what stands before and after it."""
    for batch in batches:
        raw_all, offsets_all = utf8(batch.column("text"))
        for lo, hi in steps(offsets_all):
            raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
            base, row, starts, ends = scan(raw, offsets)
            secret = _covered(base, starts, ends, (0, 1))
            clean = np.array([CLEAN.fullmatch(raw[a:b].tobytes()) is not None for a, b in zip(starts.tolist(), ends.tolist())], bool) & ~_covered(base, starts, ends)
            x, run = views(raw, offsets[row], offsets[row + 1], starts, ends)
            use = (secret | clean)[run]
            out = [(v.tobytes(), int(s), int(k)) for v, s, k in zip(x[use], secret[run][use], kinds(raw, offsets[row], starts, ends)[run][use])]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                body = raw[a:b].tobytes()
                cut = body.find(b" ", len(body) // 2)
                if cut > 0:
                    out.append((body[max(0, cut - BEFORE) : cut] + b"\0" + body[cut + 1 : cut + 1 + AFTER], None, None))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["x", "y", "kind"]).astype({"y": "Int64", "kind": "Int64"}), schema=pa.schema([("x", pa.binary()), ("y", pa.int64()), ("kind", pa.int64())]), preserve_index=False)


def placed(found: list[tuple[bytes, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views, labels and kinds of written findings, and the finding of each view."""
    raw = np.frombuffer(b"".join(t for t, *_ in found), np.uint8)
    hi = np.cumsum([len(t) for t, *_ in found])
    lo = hi - np.array([len(t) for t, *_ in found])
    starts = lo + np.array([a for _, a, _, _ in found])
    ends = lo + np.array([b for _, _, b, _ in found])
    x, run = views(raw, lo, hi, starts, ends)
    return x, np.array([label for *_, label in found])[run], kinds(raw, lo, starts, ends)[run], run


def train(docs: DataFrame, text_col: str = "text", seed: int = 5) -> Net:
    """The calibrated network. The corpus sample is the documents whose hash lies below a cut, SAMPLE_DOCS of them on average, drawn where they are read;
    only views of their labelled candidates, and one place of each, come to the driver. All labelled ones are used, repeated views once."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    drawn = docs.select(text_of(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = drawn.mapInArrow(_sampled, "x binary, y long, kind long").distinct().toPandas().drop_duplicates("x").sort_values("x")
    places = [p.split(b"\0") for p in sample.x[sample.y.isna()]]
    contexts = [(a.decode(errors="ignore"), b.decode(errors="ignore")) for a, b in (p for p in places if len(p) == 2)]
    x, y, kind, _ = placed(written_findings(WRITTEN, seed, contexts))
    if len(sample := sample[sample.y.notna()]):
        x = np.concatenate([x, np.stack([np.frombuffer(v, np.uint8) for v in sample.x])])
        y, kind = np.concatenate([y, sample.y.to_numpy(np.int64)]), np.concatenate([kind, sample.kind.to_numpy(np.int64)])
    by_rule = np.arange(len(y)) >= len(y) - len(sample)
    held = np.random.default_rng(seed).random(len(y)) < 0.3
    net = Net(seed)
    net.fit(x[~held], y[~held].astype(float), seed)
    told = held & ~(by_rule & (y == 1))  # findings that the rules name do not set the thresholds
    net.calibrate(x[told], y[told].astype(float), kind[told], RECALL)
    return net


def _scanner(net: Net) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offsets_all = utf8(batch.column("text"))
            found: list[tuple[int, int, int, int, float]] = []
            for lo, hi in steps(offsets_all):
                raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
                base, row, starts, ends = scan(raw, offsets)
                x, of = views(raw, offsets[row], offsets[row + 1], starts, ends)
                score = np.zeros(len(starts))
                np.maximum.at(score, of, net.score(x))
                add = net.judge(score, kinds(raw, offsets[row], starts, ends)) & ~_covered(base, starts, ends)
                spans = [(r, a, k, b, 1.0) for r, k, a, b in base] + [(int(r), int(a), 3, int(b), float(s)) for r, a, b, s in zip(row[add], starts[add], ends[add], score[add])]
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                found += [(lo + r, int(points[a] - points[offsets[r]]), k, int(points[b] - points[offsets[r]]), s) for r, a, k, b, s in spans]
            found.sort()
            rows = np.array([f[0] for f in found], np.int64)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            items = pa.StructArray.from_arrays([pa.array([KINDS[f[2]] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.float64())], ["kind", "start", "end", "score"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """One row per input row: doc_id, spans: array of (kind, start, end, score) in code points, end exclusive, by start and kind.

    Kinds: assign, access and hex by rule; model for candidates that the network names and that reach beyond any rule's span. A null text is empty and
    has no spans; repeated rows are told alike; an empty table gives an empty result (the network then knows the written findings only).
    Other columns are not read.
    """
    net = net or train(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scanner(net), f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of find_secrets()."""
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
