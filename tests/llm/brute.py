"""Plain versions of the operators that SQL can't express, for small tables."""

import hashlib
import math
import re
from collections import Counter


def suffixes(rows, depth=400, words=50):
    """rows: (doc_id, text) to sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + depth] for _, t in texts for p in range(len(t) - depth + 1))
    runs = Counter(tuple(w[p : p + words]) for _, t in texts for w in [t.split()] for p in range(len(w) - words + 1))
    out = []
    for i, t in texts:
        w = t.split()
        met = {q for p in range(len(w) - words + 1) if runs[tuple(w[p : p + words])] > 1 for q in range(p, p + words)}
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - depth + 1):
            if seen[t[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), len(met)))
    return out


# The base patterns and alphabets of secrets.
SECRETS = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def tail(z):
    return math.erfc(z / 2**0.5) / 2


def p_random(t, alphabet):
    """The battery's p-value, symbol by symbol."""
    k, n, seen = len(alphabet), len(t), Counter(t)
    pairs = sum(c * (c - 1) / 2 for c in seen.values())
    if n < 5 * k:
        rate = n * (n - 1) / (2 * k)
        uniform = 1.0 if pairs < 1 else tail((1 - 1 / (9 * pairs) - (rate / pairs) ** (1 / 3)) * 3 * pairs**0.5)
    else:
        chi = sum((seen[a] - n / k) ** 2 for a in alphabet) * k / n
        v = 2 / (9 * (k - 1))
        uniform = tail(((chi / (k - 1)) ** (1 / 3) - (1 - v)) / v**0.5)
    at = [alphabet.index(c) for c in t]
    turns = sum((a < k // 2) != (b < k // 2) for a, b in zip(at, at[1:]))
    runs = 2 * tail(max(abs(turns - (n - 1) / 2) - 0.5, 0) / ((n - 1) / 4) ** 0.5)
    mid = (k - 1) / 2
    product = sum((a - mid) * (b - mid) for a, b in zip(at, at[1:]))
    serial = 2 * tail(abs(product) / ((k * k - 1) / 12 * (n - 1) ** 0.5))
    return min(1.0, 3 * min(uniform, runs, serial))


def secrets(rows, rate=0.05):
    """rows: (doc_id, text) to {doc_id: (n_assign, n_access, n_hex, base_sha256, spans)}, by
    Python's patterns, place by place, and p-values in bins of a quarter of a decade."""
    base, tokens = {}, []
    for i, t in rows:
        t = t or ""
        hits = [[m.span() for m in re.finditer(p, t) if len(m[2] if k == 0 else m[0]) >= least] for k, (p, least) in enumerate(zip(SECRETS, (6, 20, 24)))]
        base[i] = hits
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t):
            if not any(a < m.end() and m.start() < b for h in hits for a, b in h):
                token = m[0].replace("-", "+").replace("_", "/")
                kind, alphabet = next((k, a) for k, a in enumerate((HEX, HEX.upper(), BASE32, BASE32.lower(), BASE64)) if set(token) <= set(a))
                p = p_random(token, alphabet)
                length = sum(len(token) >= c for c in (24, 32, 48, 64))
                tokens.append((i, m.span(), (kind, length), min(59, math.floor(-4 * math.log10(max(p, 1e-15)))), p))
    random = {i: [] for i in base}
    for cls in {t[2] for t in tokens}:
        mine = sorted((t for t in tokens if t[2] == cls), key=lambda t: -t[3])
        least = 60  # step up: the last bin whose bound holds for all tokens at it or above
        for b in {t[3] for t in mine}:
            above = sum(t[3] >= b for t in mine)
            if 10 ** (-b / 4) <= rate * above / len(mine):
                least = min(least, b)
        for i, span, _, b, p in mine:
            if b < least and (cls[1] > 0 or p >= 0.1):
                random[i].append(span)
    out = {}
    for i, hits in base.items():
        said = lambda found: ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in sorted(found))
        own = [(a, k, b) for k, h in enumerate(hits) for a, b in h]
        out[i] = (*map(len, hits), hashlib.sha256(said(own).encode()).hexdigest(), said(own + [(a, 3, b) for a, b in random[i]]))
    return out


def ftrl(rows, k, bits, alpha=0.5, beta=1.0, l1=0.1, l2=1e-6, orders=()):
    """Weights by follow the regularised leader, one coordinate at a time: rows (class,
    features, values), each epoch in its given order; the last feature is the bias."""
    bias = 1 << bits
    z, n = {}, {}

    def weight(f, c):
        at = z.get((f, c), 0.0)
        if abs(at) <= l1:
            return 0.0
        return -(at - math.copysign(l1, at)) / ((beta + math.sqrt(n.get((f, c), 0.0))) / alpha + l2)

    for order in orders:
        for i in order:
            own, some, values = rows[i]
            x = [*zip(some, values), (bias, 1.0)]
            w = {(f, c): weight(f, c) for f, _ in x for c in range(k)}
            score = [math.exp(sum(v * w[f, c] for f, v in x)) for c in range(k)]
            for f, v in x:
                for c in range(k):
                    g = v * (score[c] / sum(score) - (c == own))
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[f, c]
                    n[f, c] = old + g * g
    return [[weight(f, c) for c in range(k)] for f in range(bias + 1)]
