"""Slow, plain versions that the operators are held against, and made-up prose."""

import math
import re

import numpy as np

from seqloom.llm import pii


def prose(rng, n):
    parts = ["the", "an", "in", "er", "on", "tion", "re", "st", "nd", "ou", "es", "le"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return pii.in_order(out)


def united(values, linked):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            if linked(x, y):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {x: root(x) for x in values}


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & MASK
    return x ^ x >> 29


def hashed(word):
    return mixed(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK)


def scrambled(code, bits):
    code = code * 0x9E3779B1 & 0xFFFFFFFF
    code = (code ^ code >> 15) * 0x85EBCA77 & 0xFFFFFFFF
    return code >> 32 - bits


def quality(model, text):
    """The score of one text by a sum over its n-grams, one at a time."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode())
    kind = lambda b: 2 if 0x30 <= b <= 0x39 else 1 if 0x41 <= b <= 0x5A else 0 if 0x61 <= b <= 0x7A or b >= 0x80 else 3
    shape = lambda t: (kind(t[0]) * 4 + kind(t[-1])) * 16 + min(len(t), 15)
    grams = [hashed(t) for t in tokens]
    for a, b in zip(tokens, tokens[1:]):
        grams.append(0x5DEECE66D if a == b else mixed((hashed(a) * 3 + hashed(b)) & MASK))
        grams.append(mixed((shape(a) * 1024 + shape(b) + 0xABCD1234) & MASK))
    total = sum(float(model.weights[(g * BASE & MASK) >> 64 - model.bits]) for g in grams)
    return 1 / (1 + math.exp(-(model.bias + 24.0 * total / max(1, len(grams)))))


def language(model, text):
    """(name, probability) of one text by a sum over its n-grams, one at a time."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    folded = b""
    for b in text.encode().lower():
        b = b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
        if b != 0x20 or folded[-1:] != b" ":
            folded += bytes([b])
    z = [float(p) for p in model.log_prior]
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            h = scrambled((int.from_bytes(folded[i : i + n], "big") + n * 0x3C6EF372) & 0xFFFFFFFF, model.bits)
            z = [x + float(column[h]) for x, column in zip(z, model.log_prob)]
    top = max(range(len(z)), key=lambda i: (z[i], -i))
    return model.languages[top], 1 / sum(math.exp(x - z[top]) for x in z)


def toxicity(net, text):
    """The score of one text: each window by itself, one step at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 1 / (1 + math.exp(-max(-30, net.slope * -30 + net.shift)))

    def vector(w):
        padded = b"\x01" + w + b"\x01"
        trigrams = [scrambled(int.from_bytes(padded[i : i + 3], "big"), 12) for i in range(len(w))]
        stems = [hashed(w[:k]) >> 64 - 18 for k in range(4, min(10, len(w)) + 1)] or [hashed(w) >> 64 - 18]
        return np.concatenate([net.words[hashed(w) >> 64 - 18], net.chars[trigrams].mean(0), net.stems[stems].mean(0)])

    x = {w: vector(w).astype(np.float64) for w in set(words)}
    p = {k: v.astype(np.float64) for k, v in net.dense.items()}
    size = min(32, len(words))
    starts = sorted({min(s, len(words) - size) for s in range(0, max(1, len(words) - size + 16), 16)})
    best = -math.inf
    for s in starts:
        states = {}
        for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            h, states[d] = np.zeros(8), {}
            for t in order:
                gx, gh = p[f"x{d}"] @ x[words[s + t]] + p[f"c{d}"], p[f"h{d}"] @ h
                z, r = sigmoid(gx[:8] + gh[:8]), sigmoid(gx[8:16] + gh[8:16])
                h = z * h + (1 - z) * np.tanh(gx[16:] + r * gh[16:])
                states[d][t] = h
        both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(size)])
        a = np.exp(np.tanh(both @ p["wa"].T) @ p["va"])
        best = max(best, float(p["wo"] @ ((a / a.sum()) @ both) + p["bo"][0]))
    return 1 / (1 + math.exp(-(net.slope * best + net.shift)))


def passages(text, item):
    """The diagonals on which a text holds a passage of an item: all those with equal words are looked at, window by window."""
    split = lambda t: re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    words, item = split(text or ""), [w for w in split(item or "") if w]
    size, places, equal = min(20, len(item)), {}, {}
    for i, w in enumerate(item):
        places.setdefault(w, []).append(i)
    for p, w in enumerate(words):
        for i in places.get(w, ()):
            equal.setdefault(p - i, set()).add(i)
    return [d for d, at in equal.items() if 10 * len(at) >= 8 * size and any(10 * sum(k in at for k in range(i, i + size)) >= 8 * size for i in range(len(item) - size + 1))]
