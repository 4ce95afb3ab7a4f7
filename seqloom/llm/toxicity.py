"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word vector beside two character vectors: the mean over its hashed trigrams, and the mean over
its hashed beginnings of 4 to 10 bytes, by which inflected forms share what is known of a stem. A text is read in windows
of ``WIDTH`` words that overlap by half, all of them; the text's score is its worst window's, calibrated to a probability.
Training sees labels of texts only, so it is a multiple-instance fit: the first windows are chosen by the words' own
log-odds, later ones by the network itself, and the calibration uses labelled rows that the fit hasn't seen.

Scoring computes the input part of the gates once for each distinct word of a chunk, then steps all windows together.

Nulls and texts without a word have no window and get the lowest score that the model gives. Repeated rows get equal scores.
With no usable label, or labels of one kind only, every score is that share of toxic labels (0 with none). An empty table gives
an empty result. Texts are scored whole, however long, in chunks; a text is fitted on whole or not at all. Only doc_id and text
are looked at, and doc_id and toxic of the labels, whatever other columns there are.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .tables import label_sample, remainder, sample_texts, table

#: Labelled rows that the network is fitted on, at most; they are taken in the order of a hash of the id.
FIT_ROWS = 4000
WIDTH, STRIDE = 32, 16
WORD_BITS, CHAR_BITS, STEM_BITS = 18, 12, 18
WORD_DIM, CHAR_DIM, STEM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8, 8
STEMS = range(4, 11)
INPUT = WORD_DIM + CHAR_DIM + STEM_DIM
BLOCK = 4096
#: Words whose input is computed at a time.
SLICE = 1 << 15


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and of each word its start, end and hash; words with equal hashes count as one word."""
    low = ft.LOWER[data]
    starts, ends = ft.runs(ft.WORD[data], offsets)
    return low, starts, ends, ft.hash_runs(low, starts, ends)


def trigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of words with an edge sign on either side, and the first trigram of each word."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
    padded = np.full(int((size + 2).sum()) + 2, 1, dtype=np.uint32)
    padded[ft.spread(first + 1, size)] = low[ft.spread(starts, size)]
    code = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    code = code[ft.spread(first, size)] * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - CHAR_BITS)).astype(np.int32), np.concatenate([[0], np.cumsum(size)])[:-1]


def stems(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the beginnings of words, and the first of each word; a shorter word is its own only beginning."""
    size = ends - starts
    many = np.clip(size - STEMS[0] + 1, 1, len(STEMS))
    first = np.cumsum(many) - many
    word = np.repeat(np.arange(len(starts)), many)
    length = np.minimum(ft.spread(np.full(len(starts), STEMS[0]), many), size[word])
    length[first[size >= STEMS[0]]] = STEMS[0]
    return (ft.Hashes(low)(starts[word], starts[word] + length) >> np.uint64(64 - STEM_BITS)).astype(np.int32), first


def parts_of(hashes, low, starts, ends):
    """What the input of words is made of: buckets of the words, then buckets and first places of trigrams and beginnings."""
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), trigrams(low, starts, ends), stems(low, starts, ends)


def subset(parts, words):
    """The parts of some of the words."""
    at, *lists = parts
    out = [at[words]]
    for bucket, first in lists:
        many = np.diff(np.append(first, len(bucket)))[words]
        out.append((bucket[ft.spread(first[words], many)], np.cumsum(many) - many))
    return tuple(out)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, words) of every window; the last one of a long row ends with the row."""
    many = np.where(counts > WIDTH, -(-(counts - WIDTH) // STRIDE) + 1, (counts > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(counts)), many)
    k = ft.spread(np.zeros(len(counts), dtype=np.int64), many)
    size = np.minimum(counts[rows], WIDTH)
    return rows, np.minimum(k * STRIDE, counts[rows] - size), size


def _glorot(rng, *shape):
    return rng.normal(0, np.sqrt(2 / sum(shape)), shape).astype(np.float32)


@dataclass
class Network:
    """Weights. Gates stand in the order update, reset, candidate; activations have a column for each window."""

    words: np.ndarray
    chars: np.ndarray
    stems: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(rng.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)).astype(np.float32), rng.normal(0, 0.1, (1 << CHAR_BITS, CHAR_DIM)).astype(np.float32), rng.normal(0, 0.05, (1 << STEM_BITS, STEM_DIM)).astype(np.float32))
        for d in "fb":
            net.dense |= {f"x{d}": _glorot(rng, 3 * HIDDEN, INPUT), f"h{d}": _glorot(rng, 3 * HIDDEN, HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}
        net.dense |= {"wa": _glorot(rng, ATTENTION, 2 * HIDDEN), "va": _glorot(rng, ATTENTION, 1)[:, 0], "wo": _glorot(rng, 2 * HIDDEN, 1)[:, 0], "bo": np.full(1, -1.0, dtype=np.float32)}
        return net

    def inputs(self, parts):
        """Vectors of words, a column each."""
        at, *lists = parts
        out = np.empty((INPUT, len(at)), dtype=np.float32)
        for a in range(0, len(at), SLICE):
            b, start = min(a + SLICE, len(at)), WORD_DIM
            out[:WORD_DIM, a:b] = self.words[at[a:b]].T
            for weight, (bucket, first) in zip((self.chars, self.stems), lists, strict=True):
                cut = np.append(first[a:b], first[b] if b < len(at) else len(bucket))
                means = np.add.reduceat(weight[bucket[cut[0] : cut[-1]]], cut[:-1] - cut[0], axis=0) / np.diff(cut)[:, None].astype(np.float32)
                out[start : start + means.shape[1], a:b] = means.T
                start += means.shape[1]
        return out

    def _direction(self, d, gates, index, order, keep, mask):
        """Hidden states [step][HIDDEN, windows] in the order of the text."""
        h = np.zeros((HIDDEN, index.shape[1]), dtype=np.float32)
        states, cache = [None] * len(index), []
        weight = self.dense[f"h{d}"]
        for t in order:
            x = gates.take(index[t], axis=1)
            g = weight @ h
            zr = x[: 2 * HIDDEN]
            zr += g[: 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = r * g[2 * HIDDEN :]
            n += x[2 * HIDDEN :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep:
                cache.append((t, h, z, r, n, g[2 * HIDDEN :]))
            h = states[t] = new
        return states, cache

    def forward(self, x, index, mask=None, keep=False):
        """Logits of windows. x: word vectors; index [step, windows]: their columns; mask: false where a window has ended."""
        p, steps = self.dense, range(len(index))
        fwd, cf = self._direction("f", (p["xf"] @ x + p["cf"][:, None]).astype(np.float32), index, steps, keep, mask)
        bwd, cb = self._direction("b", (p["xb"] @ x + p["cb"][:, None]).astype(np.float32), index, steps[::-1], keep, mask)
        a = np.empty(index.shape, dtype=np.float32)
        hidden = []
        for t in steps:
            u = p["wa"][:, :HIDDEN] @ fwd[t]
            u += p["wa"][:, HIDDEN:] @ bwd[t]
            np.tanh(u, out=u)
            a[t] = p["va"] @ u
            if keep:
                hidden.append(u)
        if mask is not None:
            a[~mask] = -1e9
        a -= a.max(axis=0)
        np.exp(a, out=a)
        a /= a.sum(axis=0)
        pool_f, pool_b = np.zeros_like(fwd[0]), np.zeros_like(bwd[0])
        for t in steps:
            pool_f += a[t] * fwd[t]
            pool_b += a[t] * bwd[t]
        logit = p["wo"][:HIDDEN] @ pool_f + p["wo"][HIDDEN:] @ pool_b + p["bo"][0]
        return (logit, (fwd, bwd, cf, cb, a, hidden, pool_f, pool_b)) if keep else logit

    def backward(self, x, index, mask, kept, dlogit):
        """Gradients of the dense weights and of x."""
        p, (fwd, bwd, cf, cb, a, hidden, pool_f, pool_b) = self.dense, kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["wo"] = np.concatenate([pool_f @ dlogit, pool_b @ dlogit])
        g["bo"][0] = dlogit.sum()
        dpool = [p["wo"][:HIDDEN, None] * dlogit, p["wo"][HIDDEN:, None] * dlogit]
        da = np.stack([(dpool[0] * fwd[t]).sum(0) + (dpool[1] * bwd[t]).sum(0) for t in range(len(index))])
        da = a * (da - (a * da).sum(0))
        into = [[], []]
        for t in range(len(index)):
            g["va"] += hidden[t] @ da[t]
            du = p["va"][:, None] * da[t] * (1 - hidden[t] ** 2)
            for i, states in enumerate((fwd, bwd)):
                half = slice(i * HIDDEN, (i + 1) * HIDDEN)
                g["wa"][:, half] += du @ states[t].T
                into[i].append(a[t] * dpool[i] + p["wa"][:, half].T @ du)
        dx = np.zeros_like(x)
        for i, (d, cache) in enumerate((("f", cf), ("b", cb))):
            dh = np.zeros_like(fwd[0])
            for t, h, z, r, n, gn in reversed(cache):
                dh = dh + into[i][t]
                dnew = dh if mask is None else dh * mask[t]
                dz = dnew * (h - n) * z * (1 - z)
                dn = dnew * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn * r])
                dinput = np.concatenate([dz, dr, dn])
                g[f"h{d}"] += dgate @ h.T
                g[f"c{d}"] += dinput.sum(1)
                g[f"x{d}"] += dinput @ x[:, index[t]].T
                np.add.at(dx.T, index[t], (p[f"x{d}"].T @ dinput).T)
                dh = dnew * z + (0 if mask is None else dh * ~mask[t]) + p[f"h{d}"].T @ dgate
        return g, dx

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The largest window logit of each text; -inf where there is no window."""
        out = np.full(len(texts), -np.inf)
        for low, high, data, offsets in ft.chunks(texts):
            body, starts, ends, hashes = words_of(data, offsets)
            if not len(hashes):
                continue
            _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
            x = self.inputs(parts_of(hashes[first], body, starts[first], ends[first]))
            cut = np.searchsorted(starts, offsets)
            rows, begin, size = windows(np.diff(cut))
            begin = begin + cut[rows]
            best = np.full(high - low, -np.inf)
            for part in (np.flatnonzero(size == WIDTH), np.flatnonzero(size < WIDTH)):
                for a in range(0, len(part), BLOCK):
                    w = part[a : a + BLOCK]
                    step = np.arange(WIDTH)[:, None]
                    mask = None if size[w[0]] == WIDTH else step < size[w]
                    at = begin[w] + (step if mask is None else np.minimum(step, size[w] - 1))
                    np.maximum.at(best, rows[w], self.forward(x, code[at], mask))
            out[low:high] = best
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.logits(texts), -30, 30) + self.shift, -30, 30)))


def _chosen(rank, rows, n):
    """The window of each row with the largest rank; -1 for a row without windows."""
    order = np.lexsort((np.arange(len(rank)), -rank, rows))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = rows[order][1:] != rows[order][:-1]
    out = np.full(n, -1, dtype=np.int64)
    out[rows[order][lead]] = order[lead]
    return out


def _log_odds(code, cut, labels, held, n, root, many, group, n_stems):
    """Shrunk log-odds of the fitted texts with a word being toxic, for n words and the stems they have."""
    word, stem = np.zeros((2, n)), np.zeros((2, n_stems))
    for i in np.flatnonzero(~held):
        own = np.unique(code[cut[i] : cut[i + 1]])
        word[labels[i], own] += 1
        stem[labels[i], np.unique(group[ft.spread(root[own], many[own])])] += 1
    q, p = np.bincount(labels[~held], minlength=2)
    out = []
    for good, bad in (word, stem):
        odds = np.log((bad + 0.5) / (p + 1)) - np.log((good + 0.5) / (q + 1))
        out.append(np.clip(odds * (bad + good) / (bad + good + 4), -3, 4).astype(np.float32))
    return out


def fit(texts: pa.Array, labels: np.ndarray, *, rounds: tuple[int, ...] = (6, 3, 3), batch: int = 128, seed: int = 11) -> Network:
    """Fits on labelled texts. rounds: passes over the chosen windows, before each of which the windows are chosen anew."""
    n, positive = len(labels), int(np.sum(labels))
    if not n or positive in (0, n):
        return Network(*[np.zeros((1, 1))] * 3, constant=positive / n if n else 0.0)
    rng = np.random.default_rng(seed)
    net = Network.new(seed)
    body, starts, ends, hashes, counts, base = [], [], [], [], [], 0
    for _, _, data, offsets in ft.chunks(texts):  # only the bytes of a chunk's distinct words are kept
        low, s, e, h = words_of(data, offsets)
        _, lead = np.unique(h, return_index=True)
        size = e[lead] - s[lead]
        body.append(low[ft.spread(s[lead], size)])
        starts.append(np.cumsum(size) - size + base)
        ends.append(np.cumsum(size) + base)
        base += int(size.sum())
        hashes.append((h, h[lead]))
        counts.append(np.diff(np.searchsorted(s, offsets)))
    counts = np.concatenate(counts)
    distinct, first = np.unique(np.concatenate([u for _, u in hashes]), return_index=True)
    if not len(distinct):
        return Network(*[np.zeros((1, 1))] * 3, constant=positive / n)
    code = np.concatenate([np.searchsorted(distinct, h).astype(np.int32) for h, _ in hashes])
    body, starts, ends = np.concatenate(body), np.concatenate(starts)[first], np.concatenate(ends)[first]
    del hashes
    cut = np.concatenate([[0], np.cumsum(counts)])
    held = rng.random(n) < 0.2  # for the calibration
    if not (0 < labels[~held].sum() < (~held).sum()):
        held[:] = False
    parts = parts_of(distinct, body, starts, ends)
    at, (roots, root) = parts[0], parts[2]
    many = np.diff(np.append(root, len(roots)))
    known, group = np.unique(roots, return_inverse=True)
    group = group.astype(np.int32)
    word_odds, stem_odds = _log_odds(code, cut, labels, held, len(distinct), root, many, group, len(known))
    net.words[at, 0] = word_odds / 2  # a word's vector starts with its own log-odds, and a stem's with the stem's
    net.stems[known, 0] = stem_odds / 2
    odds = np.maximum(word_odds, np.maximum.reduceat(stem_odds[group], root))
    rows, begin, size = windows(counts)
    begin += cut[rows]

    def where(w):
        return np.minimum(np.arange(WIDTH)[:, None], size[w] - 1) + begin[w]

    lexical = np.concatenate([odds[code[where(slice(a, a + BLOCK))]].max(axis=0) for a in range(0, len(rows), BLOCK)])
    moment: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}
    squares = {k: np.full(len(getattr(net, k)), 1e-8, dtype=np.float32) for k in ("words", "chars", "stems")}
    step = 0
    for turn, epochs in enumerate(rounds):
        rank = lexical if turn == 0 else _rank(net, parts, code, where, size)
        top = _chosen(rank, rows, n)
        clean = _chosen(rng.random(len(rank)), rows, n)
        pick = np.concatenate([top[(top >= 0) & ~held], clean[(clean >= 0) & ~held & (labels == 0)]])
        size_of = min(batch, max(8, len(pick) // 32))
        for _ in range(epochs):
            rng.shuffle(pick)
            for a in range(0, len(pick), size_of):
                w = pick[a : a + size_of]
                y = labels[rows[w]].astype(np.float32)
                mask = np.arange(WIDTH)[:, None] < size[w]
                used, index = np.unique(code[where(w)], return_inverse=True)
                index = index.reshape(WIDTH, -1)
                own = subset(parts, used)
                x = net.inputs(own)
                logit, kept = net.forward(x, index, mask, keep=True)
                prob = 1 / (1 + np.exp(-logit))
                grad, dx = net.backward(x, index, mask, kept, ((prob - y) * np.where(y == 1, 2.0, 1.0) / len(w)).astype(np.float32))
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.dense[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                shares = np.split(dx.T, [WORD_DIM, WORD_DIM + CHAR_DIM], axis=1)
                for name, (bucket, lead_at), part in zip(("words", "chars", "stems"), ((own[0], np.arange(len(used))), *own[1:]), shares, strict=True):
                    many = np.diff(np.append(lead_at, len(bucket)))
                    touched, inverse = np.unique(bucket, return_inverse=True)
                    g = np.zeros((len(touched), part.shape[1]), dtype=np.float32)
                    np.add.at(g, inverse, np.repeat(part / many[:, None], many, axis=0))
                    squares[name][touched] += (g * g).mean(axis=1)
                    getattr(net, name)[touched] -= 0.05 * g / np.sqrt(squares[name][touched])[:, None]
    best = np.full(n, -30.0)
    np.maximum.at(best, rows, np.clip(_rank(net, parts, code, where, size), -30, 30))
    use = held if held.any() and 0 < labels[held].sum() < held.sum() else np.ones(n, dtype=bool)
    net.slope, net.shift = _platt(best[use], labels[use].astype(float))
    return net


def _rank(net, parts, code, where, size):
    """Logits of all training windows; the words of a block of windows are looked up for that block alone."""
    out = np.empty(len(size))
    for a in range(0, len(size), BLOCK):
        part = slice(a, a + BLOCK)
        used, index = np.unique(code[where(part)], return_inverse=True)
        out[part] = net.forward(net.inputs(subset(parts, used)), index.reshape(WIDTH, -1), np.arange(WIDTH)[:, None] < size[part])
    return out


def _release() -> None:
    """Gives freed memory back to the system, lest a long-lived driver keeps what a fit took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression of y on z, by Newton steps with a small penalty."""
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * (w - np.array([1.0, 0.0]))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        delta = np.linalg.solve(hessian, gradient)
        w = w - np.clip(delta, -1, 1)
        if np.abs(delta).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(documents: DataFrame, labels: DataFrame, *, bound: int = FIT_ROWS) -> Network:
    """Fits on at most ``bound`` labelled rows of ``tables.FIT_BYTES`` at most together, which go to the driver; their ids are
    broadcast to find their texts."""
    chosen = label_sample(labels, "toxic", 4, 2, bound)
    rows = sample_texts(documents, chosen).toArrow().sort_by("doc_id")
    net = fit(ft.filled(rows["text"]), rows["label"].to_numpy())
    del rows
    _release()
    return net


def score(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row, from all windows of its whole text. The broadcast has the network's fixed size, 9 MB."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(ft.filled(batch.column("text"))).astype(np.float64))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def without_toxic(documents: DataFrame, net: Network, threshold: float) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, all columns unchanged, in one pass and without a join."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def kept(batches):
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array(own.scores(ft.filled(batch.column("text"))) < threshold))

    return documents.mapInArrow(kept, documents.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = train(documents, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return score(documents, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
