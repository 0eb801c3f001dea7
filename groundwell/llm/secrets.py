"""Secret scans: rules, and a small character convolutional network over every candidate in its context.

Rules find assignments, access keys and long hex strings. Candidates are, besides these, all runs of 16 or more characters
of ``[A-Za-z0-9+/_.=-]`` with a digit or an inner capital. The network reads a window of a candidate and its surroundings
as character classes: one convolution, maxima over the context before, the candidate and the context after, one logistic
unit. It is trained in numpy on labelled findings from a bounded sample of ``SAMPLE_DOCS`` documents (rule findings against
other text) and on generated keys and look-alikes set into contexts of that sample. Each label has bounds of its own, so
that neither crowds the other out: ``DOC_FINDINGS`` of a document and ``SAMPLE_FINDINGS`` in all, the smallest hashes. They
bound what the network learns from and never what is scanned. Half of the findings is held out, and further keys are
generated; those that no rule covers, as only these are left to the network, calibrate its scores by Platt scaling, and the
threshold is the highest that keeps a recall of ``RECALL`` for each shape of key among them. Accepted candidates that no
rule covers become spans of kind ``model``; rule spans always stay.

Text that no rule covers counts as harmless in training unless it looks like a key itself (``suspect``): such text is left
out, so that keys without a keyword do not teach the network to drop keys.

Defined results: a null or empty text has no spans; without a usable sample the generated findings train the network;
repeated rows are scanned one by one; an empty table gives no rows. Other columns pass through in ``row``.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import query, table, whole_texts
from groundwell.operators.stages import materialize

KINDS = ("assign", "access", "hex", "model")
SAMPLE_DOCS = 20_000
SAMPLE_FINDINGS = 3_000
DOC_FINDINGS = 50
RECALL = 0.95
BEFORE, INSIDE, AFTER = 24, 48, 16
WIDTH, FILTERS = 5, 16

#: The rules.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_SHAPE = bytes(97 if c in b"abcdefghijklmnopqrstuvwxyz" else 65 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
               else 48 if c in b"0123456789" else 46 if c in b"+/_.=-" else 32 for c in range(256))
_RUN = re.compile(rb"[aA0.]{16,}")
#: Keys of known services, and ids of a known harmless form.
_KNOWN = re.compile(
    r"""(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{20,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}
    |xox[abeoprs]-[A-Za-z0-9-]{16,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}|A[KS]IA[A-Z0-9]{16,}|npm_[A-Za-z0-9]{30,})""", re.A | re.X)
_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_OPAQUE = re.compile("[A-Za-z0-9+/=]{16,}")
_CODES = np.zeros(256, np.uint8)
for _place, _char in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:;,'\"<>()[]{}@# \n"):
    _CODES[ord(_char)] = _place + 2
_CODES[128:] = 1
CLASSES = int(_CODES.max()) + 1

Span = tuple[int, int, int]


def rule_spans(text: str, raw: bytes) -> list[Span]:
    """(start, end, kind) in code points. The scans of the raw bytes only skip texts that cannot match."""
    found: list[Span] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_IS_HEX):
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str | None, raw: bytes) -> list[tuple[int, int]]:
    """Runs that could hold a secret, in code points."""
    found, place, start = [], 0, 0
    for m in _RUN.finditer(raw.translate(_SHAPE)):
        shape = m.group().strip(b".")
        if len(shape) >= 16 and (b"0" in shape or b"A" in shape[1:] and b"a" in shape):
            begins = m.start() + len(m.group()) - len(m.group().lstrip(b"."))
            start += len(raw[place:begins].decode("utf-8", "ignore"))
            place = begins
            found.append((start, start + len(shape)))
    return found


def window(text: str, start: int, end: int) -> bytes:
    """A candidate and its surroundings, of fixed length; a long candidate shows its head and tail."""
    inside = text[start:end] if end - start <= INSIDE else text[start:start + INSIDE // 2] + text[end - INSIDE // 2:end]
    parts = (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), inside.ljust(INSIDE, "\0"),
             text[end:end + AFTER].ljust(AFTER, "\0"))
    return b"".join(p.encode("latin-1", "replace").replace(b"?", b"\x80") for p in parts)


class Network:
    """Convolution over character classes. A class has its own weights per filter and offset, so that no one-hot input
    is formed: a convolution is a sum of looked-up rows."""

    edges = (0, BEFORE, BEFORE + INSIDE, BEFORE + INSIDE + AFTER)

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.kernel = draw.normal(0, 0.15, (WIDTH, CLASSES, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.dense = draw.normal(0, 0.3, 3 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        padded = np.pad(codes, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        length = codes.shape[1]
        signal = self.shift + sum(self.kernel[k][padded[:, k:k + length]] for k in range(WIDTH))
        where = [signal[:, a:b].argmax(1) + a for a, b in zip(self.edges, self.edges[1:])]
        top = np.concatenate([np.take_along_axis(signal, w[:, None, :], 1)[:, 0] for w in where], 1)
        return padded, where, top, np.maximum(top, 0) @ self.dense + self.bias[0]

    def logits(self, windows: list[bytes]) -> np.ndarray:
        out = [self._forward(_codes(windows[i:i + 512]))[3] for i in range(0, len(windows), 512)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def chance(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(windows).astype(np.float64) + self.offset)))

    def fit(self, windows: list[bytes], labels: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 2) -> None:
        codes, draw = _codes(windows), np.random.default_rng(seed)
        weights = [self.kernel, self.shift, self.dense, self.bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(codes))
            for i in range(0, len(order), 64):
                batch = order[i:i + 64]
                padded, where, top, logit = self._forward(codes[batch])
                error = (1 / (1 + np.exp(-logit)) - labels[batch]) / len(batch)
                back = error[:, None] * self.dense * (top > 0)
                kernel = np.zeros_like(self.kernel)
                for part, at in enumerate(where):
                    share = back[:, part * FILTERS:(part + 1) * FILTERS]
                    for k in range(WIDTH):
                        row = np.take_along_axis(padded, at + k, 1)
                        np.add.at(kernel[k], (row, np.arange(FILTERS)), share)
                slopes = [kernel, back.reshape(len(batch), 3, FILTERS).sum((0, 1)), np.maximum(top, 0).T @ error,
                          error.sum(keepdims=True)]
                step += 1
                for w, g, (m, v) in zip(weights, slopes, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def calibrate(self, windows: list[bytes], labels: np.ndarray, shapes: list[int], recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall for each shape of key."""
        x = self.logits(windows).astype(np.float64)
        good = max(1, int(labels.sum()))
        aim = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
        theta = np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            bend = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(2)
            theta -= np.linalg.solve(bend, design.T @ (p - aim) + 1e-3 * (theta - [1.0, 0.0]))
        self.slope, self.offset = float(max(theta[0], 1e-3)), float(theta[1])
        scores, of = self.chance(windows), np.array(shapes)
        lowest = [np.sort(scores[(labels > 0) & (of == k)]) for k in sorted({k for k, y in zip(shapes, labels) if y})]
        self.threshold = float(min((x[int(np.floor((1 - recall) * len(x)))] for x in lowest), default=0.5))


def _codes(windows: list[bytes]) -> np.ndarray:
    return _CODES[np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1)]


def generated(contexts: list[str], count: int = 1200, seed: int = 5) -> list[tuple[bytes, int]]:
    """Keys of known shapes and harmless look-alikes, each set into a piece of sample text."""
    return [(w, label) for w, label, _, _ in shaped(contexts, count, seed)]


def shaped(contexts: list[str], count: int, seed: int) -> list[tuple[bytes, int, int, bool]]:
    """(window, label, shape, free): free are those that the scan leaves to the network, with the window that it shows."""
    draw = random.Random(seed)
    letters, lower, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    word = lambda k, chars=letters: "".join(draw.choices(chars, k=k))
    keys = (
        lambda: "ghp_" + word(36), lambda: "sk-" + word(40), lambda: f"xoxb-{word(11, '0123456789')}-{word(24)}",
        lambda: "AIza" + word(35), lambda: f"eyJ{word(30)}.eyJ{word(40)}.{word(32)}", lambda: word(40),
        lambda: word(draw.randint(18, 44), letters + "+/") + "==",
        # Half are too short for the rule, so that the network has to know them.
        lambda: word(draw.randint(*draw.choice(((20, 23), (24, 64)))), hexes),
        lambda: "AKIA" + word(16, letters[:26] + "0123456789"),
    )
    plain = (
        lambda: f"20{word(2, '0123456789')}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}T10:00:00.000",
        lambda: f"www.{word(8, lower)}.com/{word(6, lower)}/{word(9, lower)}.html", lambda: "-".join(word(6, lower) for _ in range(4)),
        lambda: "_".join(word(5, lower) for _ in range(4)) + "_1", lambda: word(18, "0123456789"), lambda: "=" * 20 + "1",
        lambda: word(5, lower).title() + word(7, lower).title() + word(9, lower).title(), lambda: "1." * 9 + "0",
        lambda: f"{word(7, lower)}.{word(6, lower)}.{word(8, lower)}2", lambda: word(20, lower),
    )
    out = []
    for i in range(count):
        text = contexts[draw.randrange(len(contexts))] if contexts else "text of no sample " * 5
        at = draw.randint(0, max(0, len(text) - 1))
        shape = draw.randrange(len((keys, plain)[i % 2]))
        key = (keys, plain)[i % 2][shape]()
        joined = f"{text[:at]} {key} {text[at:]}"
        start, end = at + 1, at + 1 + len(key)
        raw = joined.encode()
        free = [c for c in uncovered(joined, raw, rule_spans(joined, raw)) if c[0] < end and start < c[1]]
        out.append((window(joined, *(free or [(start, end)])[0]), 1 - i % 2, shape, bool(free)))
    return out


def uncovered(text: str, raw: bytes, rules: list[Span]) -> list[tuple[int, int]]:
    """The candidates that are left to the network."""
    covered = Covered((a, b) for a, b, _ in rules)
    return [(s, e) for s, e in candidates(text, raw) if not covered.meets(s, e)]


class Covered:
    """Places that are taken, joined where they overlap, so that one look-up tells whether a span meets any."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def suspect(value: str) -> bool:
    """Whether a candidate looks like a key: a known service's, or a piece with many different characters in which lower case,
    capitals and digits change places far more often than in words, names, numbers and dates."""
    if _KNOWN.search(value):
        return True
    for piece in _OPAQUE.findall(_UUID.sub(" ", value)):
        kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in piece.rstrip("=")]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        entropy = -sum(n / len(piece) * math.log2(n / len(piece)) for n in Counter(piece).values())
        if changes >= 0.3 * len(kinds) and entropy >= 3:
            return True
    return False


def findings(text: str, raw: bytes) -> list[tuple[bytes, int]]:
    """Labelled windows of one text: what rules find, candidates that neither they nor ``suspect`` take for keys, and one long
    word outside of both; of each label the ``DOC_FINDINGS`` smallest hashes."""
    rules = rule_spans(text, raw)
    free = uncovered(text, raw, rules)
    keys = [(s, e) for s, e in free if suspect(text[s:e])]
    out = [(window(text, s, e), 1) for s, e, _ in rules]
    out += [(window(text, *c), 0) for c in sorted(set(free) - set(keys))]
    taken = Covered([(s, e) for s, e, _ in rules] + keys)
    for m in re.finditer(r"[^\W\d]{12,}", text):
        if not taken.meets(m.start(), m.end()):
            out.append((window(text, m.start(), m.end()), 0))
            break
    return [(w, label) for label in (1, 0) for w in sorted({w for w, y in out if y == label}, key=_hash)[:DOC_FINDINGS]]


def _hash(window: bytes) -> bytes:
    return hashlib.md5(window).digest()


def sample(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[tuple[bytes, int]]:
    """Labelled windows of the documents with the smallest id hashes, at most ``SAMPLE_FINDINGS`` of each label."""
    ids = (documents.select(F.col(doc_id).alias("id")).filter("id IS NOT NULL").distinct()
           .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS))

    @F.arrow_udf("array<struct<window:binary,label:int>>")
    def labelled(texts: pa.Array) -> pa.Array:
        rows = [[{"window": w, "label": y} for w, y in findings(t.decode("utf-8", "replace"), t)] if t else []
                for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("window", pa.binary()), ("label", pa.int32())])))

    rows = materialize(
        documents.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(ids), "id", "left_semi").select("id", F.explode(labelled("text")).alias("f"))
        .select("id", "f.window", "f.label").distinct())
    return [(bytes(r["window"]), label) for label in (1, 0) for r in rows.filter(F.col("label") == label)
            .orderBy(F.xxhash64("id", "window"), "window").limit(SAMPLE_FINDINGS).collect()]


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network:
    """Fit on a bounded sample and generated findings."""
    return fitted(sample(documents, doc_id, text))


def fitted(found: list[tuple[bytes, int]]) -> Network:
    contexts = [w.decode("latin-1").strip("\0") for w, y in found if not y][:500]
    # A rule decides on its findings, so they are learned from but calibrate nothing.
    known = [(w, y, 0, not y) for w, y in found] + shaped(contexts, 1200, 5)
    known.sort(key=lambda f: _hash(f[0]))
    half = len(known) // 2
    network = Network()
    network.fit([f[0] for f in known[:half]], np.array([f[1] for f in known[:half]], np.float32))
    held = [f for f in known[half:] + shaped(contexts, 6000, 6) if f[3]]
    network.calibrate([f[0] for f in held], np.array([f[1] for f in held], np.float32), [f[2] for f in held])
    return network


def all_spans(raw: bytes | None, network: Network) -> list[Span]:
    if not raw:
        return []
    text = raw.decode("utf-8", "replace")
    rules = rule_spans(text, raw)
    if free := uncovered(text, raw, rules):
        chances = network.chance([window(text, s, e) for s, e in free])
        rules += [(s, e, 3) for (s, e), p in zip(free, chances) if p >= network.threshold]
    return sorted(rules, key=lambda s: (s[0], s[2]))


def scan_secrets(documents: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``row`` (all columns) and ``spans``, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in all_spans(t, network)]
                         for t in texts.to_pylist()], kind)

    return whole_texts(documents).select(F.struct("*").alias("row"), scan(F.col(text).cast("binary")).alias("spans"))


@query("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = scan_secrets(documents, train(documents))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "row.doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(told(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        told("spans").alias("spans"), of("model"))
