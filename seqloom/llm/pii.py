"""Personal data: candidate spans scored by gradient-boosted trees.

Base spans (e-mail, IPv4, card and phone numbers by fixed patterns and checks) always stay. Generators of high recall propose
more, overlapping spans: written-out addresses, numbers with other separators, phone numbers without a country sign. Boosted
trees score each from its format and from the words before and after it; a logistic calibration and a threshold for each
kind, the lowest that reaches ``PRECISION`` on rows kept out of the fit, select those that are added. Added spans don't
overlap base spans or each other; of overlapping ones the likelier wins, then the earlier, then the longer.

There are no labels for personal data, so the trees are fitted on generated sentences with known spans, from a fixed seed:
fictitious data of each kind and look-alikes (versions, dates, order numbers, prices).

Offsets are code points, the end exclusive. Nulls and empty texts have no spans. Repeated rows get equal results. Texts are
read whole, in time that grows with their length, even if they are one run of digits or letters; those without a digit, an @
sign or a written-out one are skipped after one look at their bytes. An empty table gives an empty result. Only doc_id and text
are looked at, and n_chars where texts are redacted, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import flattext as ft
from .tables import table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# only tried where a run of digits begins: what fails there fails at all later digits of the run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_AT = r"(?:@|[\[({]\s?at\s?[\])}])"
_DOT = r"(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}]|\x20dot(?=\x20))"
_GENERATORS = (
    ("email", re.compile(rf"(?i)[a-z0-9][a-z0-9._%+-]{{0,63}}\x20?{_AT}\x20?[a-z0-9-]+(?:\x20?{_DOT}\x20?[a-z0-9-]+)+")),
    ("email", re.compile(r"(?i)[a-z0-9][a-z0-9._%+-]{0,63}\x20at\x20[a-z0-9-]+(?:\x20dot\x20[a-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|,)\x20?[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20./_-][0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[\x20-]?)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")),
)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass the kind's check."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # every e-mail match has its @ as the first sign after the local part, so only those are looked at
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    return in_order([(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)])


_FOR = {
    "email": ("mail", "write", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "ping", "login"),
    "card": ("card", "visa", "credit", "pay", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "ring", "anruf"),
}
_AGAINST = ("version", "order", "invoice", "isbn", "section", "date", "no.", "ref", "page", "build", "price", "serial", "on ")
_WORD = re.compile(r"[^\W\d_]+")


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a span as numbers."""
    kind, a, b = span
    own = text[a:b]
    digits = _NOT_DIGIT.sub("", own)
    groups = re.findall(r"[0-9]+", own)
    letters = sum(c.isalpha() for c in own)
    signs = [c for c in own if not c.isalnum()]
    before, after = text[max(0, a - 32) : a].lower(), text[b : b + 16].lower()
    sizes = [len(g) for g in groups] or [0]
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    tail = re.split(r"[^a-z]+", own.lower())[-1]
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return [
        *(float(kind == k) for k in KINDS),
        float(len(own)),
        float(len(digits)),
        float(letters),
        float(len(signs)),
        float(len(set(signs))),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(sizes[0]),
        float(sizes[-1]),
        float(bool(digits) and luhn(digits)),
        float(all(int(g) <= 255 for g in groups if len(g) < 6) and max(sizes) <= 3),
        float(sum(len(g) > 1 and g[0] == "0" for g in groups)),
        float(year and len(groups) <= 3),
        float(any(c in own for c in "([{")),
        float(len(set(sizes)) == 1),
        float(len(tail)),
        float(int(digits[0]) if digits else -1),
        float(edge(text[a - 1 : a])),
        float(edge(text[b : b + 1])),
        float(any(w in before for w in _FOR[kind])),
        float(any(w in before for k in KINDS if k != kind for w in _FOR[k])),
        float(any(w in before for w in _AGAINST)),
        float(any(w in after for w in _FOR[kind])),
        float(len(_WORD.findall(before))),
    ]


@dataclass
class Trees:
    """Boosted regression trees of depth 3 on the logistic loss, with splits at quantiles."""

    depth: int = 3
    rate: float = 0.2
    rounds: int = 60
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.prior = float(np.log(share / (1 - share)))
        z, inner = np.full(len(y), self.prior), 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for k in range(inner):
                here = node == k
                best, total_g, total_h = 1e-6, g[here].sum(), h[here].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[here, j], weights=g[here], minlength=len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[here, j], weights=h[here], minlength=len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[k], cut[k] = gain[i], j, c[i]
                right = here & (x[:, feature[k]] > cut[k])
                node[here] = 2 * k + 1
                node[right] = 2 * k + 2
            leaf = node - inner
            value = np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
            self.trees.append((feature, cut, self.rate * value))
            z += self.rate * value[leaf]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return z


def _sentence(rng, n: int) -> str:
    parts = ("the", "an", "in", "er", "on", "tion", "re", "st", "nd", "ou", "es", "le", "de", "sch", "ung")
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def examples(n: int = 3000, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Generated sentences with the spans of fictitious personal data that they hold (none for look-alikes)."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def card(sep):
        body = pick("4", "5", "37", "6") + num(16)
        body = body[:15]
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email():
        user, host, top = _sentence(rng, 1), pick("mail", "example", "post") + num(1), pick("com", "org", "net", "de")
        at, dot = pick(("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " dot "), (" at ", " dot "), (" @ ", "."), ("{at}", " (dot) "))
        return f"{user}{at}{host}{dot}{top}"

    def ip():
        return pick(".", "[.]", " . ", "(.)").join(str(rng.integers(1, 255)) for _ in range(4))

    def phone():
        sep = pick("-", " ", ".")
        return pick(f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"00{pick('1', '33', '49')} {num(3)} {num(3)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}")

    good = {"email": email, "ip": ip, "card": lambda: card(pick(".", "/", "_")), "phone": phone}
    bad = (
        lambda: f"version {num(1)}.{num(2)}.{num(1)}.{num(3)}",
        lambda: f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}",
        lambda: f"{num(2)}/{num(2)}/{pick('19', '20')}{num(2)}",
        lambda: f"order {num(4)}-{num(4)}-{num(4)}",
        lambda: f"no. {num(3)} {num(3)} {num(4)}",
        lambda: f"{num(3)}, {num(2)}, {num(3)}, {num(2)}",
        lambda: f"isbn {num(3)}-{num(4)}-{num(4)}",
        lambda: f"{num(4)}.{num(4)}.{num(4)}",
        lambda: f"{_sentence(rng, 1)} at {_sentence(rng, 1)} dot {_sentence(rng, 1)}ing",
        lambda: f"{_sentence(rng, 1)}@{_sentence(rng, 1)}",
        lambda: f"price {num(3)}.{num(3)}.{num(3)}",
        lambda: f"serial {num(10)}",
        lambda: f"{num(3)} {num(3)} {num(3)} {num(3)}",
    )
    out = []
    for _ in range(n):
        before, after = _sentence(rng, int(rng.integers(1, 7))), _sentence(rng, int(rng.integers(1, 5)))
        if rng.random() < 0.5:
            kind = pick(*KINDS)
            value = good[kind]()
            if rng.random() < 0.6:
                before += " " + pick(*_FOR[kind])
            text = f"{before} {value} {after}."
            out.append((text, [(kind, len(before) + 1, len(before) + 1 + len(value))]))
        else:
            out.append((f"{before} {pick(*bad)()} {after}.", []))
    return out


@dataclass
class Model:
    trees: Trees
    slope: float
    shift: float
    threshold: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap neither base spans nor likelier candidates."""
        proposed = [c for c in candidates(text) if not any(c[1] < b and a < c[2] for _, a, b in _near(base, c))]
        if not proposed:
            return []
        z = self.slope * self.trees.decision(np.array([describe(text, c) for c in proposed])) + self.shift
        p = 1 / (1 + np.exp(-z))
        kept: list[Span] = []
        for q, c in sorted(((-q, c) for q, c in zip(p, proposed, strict=True) if q >= self.threshold[c[0]]), key=lambda r: (r[0], r[1][1], -r[1][2])):
            at = bisect_left(kept, c[1], key=lambda s: s[1])
            if not any(c[1] < b and a < c[2] for _, a, b in kept[max(0, at - 1) : at + 1]):
                kept.insert(at, c)
        return in_order(kept)


def _near(base: list[Span], c: Span) -> list[Span]:
    """Base spans that may overlap c: spans of a kind don't overlap, so a few neighbours by start are enough."""
    at = bisect_left(base, c[1], key=lambda s: s[1])
    end = at
    while end < len(base) and base[end][1] < c[2]:
        end += 1
    return base[max(0, at - len(KINDS)) : end]


def train(n: int = 3000, seed: int = 5) -> Model:
    from .toxicity import _platt

    x, y, kind = [], [], []
    for text, truth in examples(n, seed):
        for c in candidates(text):
            x.append(describe(text, c))
            y.append(float(c in truth))
            kind.append(c[0])
    x, y, kind = np.array(x), np.array(y), np.array(kind)
    fold = np.arange(len(y)) % 5
    trees = Trees().fit(x[fold < 3], y[fold < 3])
    z = trees.decision(x)
    slope, shift = _platt(z[fold == 3], y[fold == 3])
    p = 1 / (1 + np.exp(-(slope * z + shift)))
    threshold = {}
    for k in KINDS:
        own = (fold == 4) & (kind == k)
        levels = [t for t in np.linspace(0.5, 0.95, 10) if (chosen := own & (p >= t)).any() and y[chosen].mean() >= PRECISION]
        threshold[k] = float(min(levels, default=0.99))
    return Model(trees, slope, shift, threshold)


_MODEL: Model | None = None


def model() -> Model:
    """The fitted trees; a process fits them once, from a fixed seed, so all processes have the same."""
    global _MODEL
    if _MODEL is None:
        _MODEL = train()
    return _MODEL


def all_spans(text: str, own: Model) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, own.added(text, base)


_ANCHOR = ft.DIGIT.copy()
_ANCHOR[ord("@")] = True
_WRITTEN = re.compile(rb"[\[({]\s?at\s?[\])}]| dot ", re.I)


def scan(texts: pa.Array, own: Model):
    """(base spans, added spans) of each text."""
    for _, _, data, offsets in ft.chunks(texts):
        total = np.concatenate([[0], np.cumsum(_ANCHOR[data])])
        look = total[offsets[1:]] > total[offsets[:-1]]
        body = data.tobytes()
        for m in _WRITTEN.finditer(body):
            look[np.searchsorted(offsets, m.start(), side="right") - 1] = True
        for i, wanted in enumerate(look.tolist()):
            yield all_spans(body[offsets[i] : offsets[i + 1]].decode(), own) if wanted else ([], [])


def spans(documents: DataFrame, own: Model | None = None) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (kind, start, end)."""
    shared = documents.sparkSession.sparkContext.broadcast(own or model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches):
        for batch in batches:
            rows = list(scan(ft.filled(batch.column("text")), shared.value))
            columns = [[[{"kind": k, "start": a, "end": b} for k, a, b in row[i]] for row in rows] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c in columns)], ["doc_id", "base", "added"])

    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return documents.select("doc_id", "text").mapInArrow(found, f"doc_id long, base {item}, added {item}")


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, a, b in found:
        if a >= done:
            out.append(text[done:a] + f"[{kind.upper()}]")
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(documents: DataFrame, own: Model | None = None) -> DataFrame:
    """The same rows and columns, with personal data replaced in text and n_chars counted anew; a null text stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(own or model())
    names, schema = documents.columns, documents.schema

    def changed(batches):
        for batch in batches:
            column = batch.column("text")
            texts = ft.filled(column)
            valid = column.is_valid().to_pylist()
            out = [None if not ok else redacted(t, in_order(base + more)) if base or more else t for ok, t, (base, more) in zip(valid, texts.to_pylist(), scan(texts, shared.value), strict=True)]
            new = {"text": pa.array(out, column.type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in out], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return documents.mapInArrow(changed, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.broadcast(model())

    def digest(batches):
        for batch in batches:
            rows = list(scan(ft.filled(batch.column("text")), shared.value))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            every = pa.array([listed(in_order(base + more)) for base, more in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, every], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
