"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return [tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def repeats(docs, length=400):
    """(n_bytes, n_removed, n_spans, digest) per row of (doc_id, text)."""
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def near(docs, percent=85):
    """doc_id to component for rows of (doc_id, text) without repeated ids."""
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in inverted[x] if j > i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def leaks(docs, items, least=0.8):
    out = {}
    for d, text in docs:
        s = shingles(text)
        for i, item in items:
            own = Counter(shingles(item))
            m, best = sum(own.values()), 0.0
            if not m or not set(s) & set(own):
                continue
            for start in range(max(1, len(s) - m + 1)):
                window = Counter(s[start : start + m])
                both = sum((window & own).values())
                best = max(best, both / (sum(window.values()) + m - both))
            if best >= least:
                out[(d, i)] = best
    return out


def base_scores(docs):
    rows = [(i, words(t) + ["\0"]) for i, t in docs]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(x for i, w in rows if not held[i] for x in w)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in rows}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return [f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (s[1], order.index(s[0])))]


def entropies(value, width=20):
    """Bits per character of every window."""
    out = []
    for i in range(len(value) - width + 1):
        counts = Counter(value[i : i + width]).values()
        out.append(-sum(c / width * math.log2(c / width) for c in counts))
    return out


def sections_of(text, encoding, sections=None):
    """(n_tokens, n_sections, n_crossing, n_outside, tokens per section), byte by byte."""
    raw = (text or "").encode()
    if sections is None:
        spans, at = [], 0
        for line in raw.split(b"\n"):
            end = min(at + len(line) + 1, len(raw))
            if end > at:
                spans.append((at, end))
            at = end
    else:
        place = [len(text[:i].encode()) for i in range(len(text) + 1)]
        spans = [(place[a], place[b]) for a, b in sections]
    counts, crossing, outside, at = [0] * len(spans), 0, 0, 0
    tokens = encoding.encode_ordinary(text or "")
    for token in tokens:
        end = at + len(encoding.decode_single_token_bytes(token))
        shares = [len(set(range(at, end)) & set(range(a, b))) if a < end and at < b else 0 for a, b in spans]
        if not any(shares):
            outside += 1
        else:
            counts[shares.index(max(shares))] += 1
            crossing += max(shares) < end - at
        at = end
    assert at == len(raw)
    return len(tokens), len(spans), crossing, outside, counts


def lm_scores(docs, grid=8, rounds=60, buckets=24):
    """doc_id to log10 probability under the interpolated bigram model, and the weights by bucket of the context."""
    rows = [(zlib.crc32(str(i).encode()) % 10, i, words(t) + ["\0"]) for i, t in docs]

    def count(folds):
        one, two = Counter(), Counter()
        for fold, _, w in rows:
            if fold in folds:
                one.update(w)
                two.update(zip(["\0", *w], w))
        return one, two

    bucket = lambda n: min(n.bit_length(), buckets - 1)
    one, two = count(set(range(2, 10)))
    every, pairs = count(set(range(1, 10)))
    total, uniform = max(sum(one.values()), 1), 1 / (len(every) + 1)
    step = lambda p: round(-math.log2(p) * grid) if p > 0 else None
    value = lambda q: 0.0 if q is None else 2.0 ** (-q / grid)
    cells = defaultdict(Counter)
    for fold, _, w in rows:
        if fold == 1:
            for v, x in zip(["\0", *w], w):
                cells[bucket(one[v])][step(two[v, x] / one[v] if one[v] else 0), step(one[x] / total)] += 1
    weights = {b: [0.4, 0.4, 0.2] if b else [0.0, 0.7, 0.3] for b in range(buckets)}
    for b, own in cells.items():
        w = weights[b]
        for _ in range(rounds):
            got = [0.0] * 3
            for (q2, q1), n in own.items():
                share = [w[0] * value(q2), w[1] * value(q1), w[2] * uniform]
                got = [g + s / sum(share) * n for g, s in zip(got, share)]
            w = [max(g / sum(own.values()), 1e-6 if b or j else 0.0) for j, g in enumerate(got)]
            w = [x / sum(w) for x in w]
        weights[b] = w
    n = max(sum(every.values()), 1)
    out = {}
    for _, i, w in rows:
        out[i] = 0.0
        for v, x in zip(["\0", *w], w):
            a = weights[bucket(every[v])]
            out[i] += math.log10(a[0] * (pairs[v, x] / every[v] if every[v] else 0) + a[1] * every[x] / n + a[2] * uniform)
    return out, weights


def languages(docs, trigrams, least=0.5):
    """doc_id to (language, posterior) for rows of (doc_id, text, declared, source), from all labelled rows."""
    import numpy as np

    names = sorted({d for _, t, d, _ in docs if d is not None and t is not None})
    counts = np.zeros((len(names), 1 << 16))
    for _, t, d, _ in docs:
        if d is not None and t is not None:
            np.add.at(counts[names.index(d)], trigrams(t), 1)
    model = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * (1 << 16))).astype(np.float32)
    lik = {}
    for i, t, *_ in docs:
        if t is not None and any(c.isalpha() for c in t) and len(trigrams(t)):
            own = model[:, trigrams(t)].sum(1, dtype=np.float64) / 3
            lik[i] = own - own.max()
    k, vote = len(names), {i: int(np.argmax(x)) for i, x in lik.items()}
    of = lambda rows: np.bincount([vote[r[0]] for r in rows if r[0] in vote], minlength=k).astype(float)
    top = (of(docs) + 1) / (len(vote) + k)
    suffix = (of(docs) + 200 * top) / (len(vote) + 200)
    known = {d for i, _, d, _ in docs if d is not None and i in vote}
    said = of([r for r in docs if r[2] is not None])
    out = {}
    for i, _, d, source in docs:
        if i not in lik:
            out[i] = ("und", 0.0)
            continue
        x = lik[i].copy()
        host = of([r for r in docs if source is not None and r[3] == source])
        x += np.log((host + 20 * suffix) / (host.sum() + 20)) if source is not None else np.log(top)
        if d in known:
            x += np.log((of([r for r in docs if r[2] == d]) + 1) / (said + len(known) + 1))
        p = 1 / np.exp(x - x.max()).sum()
        out[i] = (names[int(np.argmax(x))] if p >= least else "und", p)
    return out


def mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """doc_id to words taken, for rows of (doc_id, text, source) without repeated ids: documents of a source in the order of
    a hash, cut where its target ends."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full = set()
    while True:
        rest = [s for s in sources if s not in full]
        level = (share * sum(own.values()) - sum(most * own[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0.0
        more = {s for s in rest if weight[s] * level >= most * own[s]}
        if not more:
            break
        full |= more
    out = {}
    for s in sources:
        target = math.floor(most * own[s] if s in full else weight[s] * level)
        epochs = target // own[s] if own[s] else 0
        left = target - epochs * own[s]
        for d in sorted((d for d, _, x in docs if x == s), key=lambda d: (hashlib.md5(f"{d}:mix-1".encode()).hexdigest()[:15], d)):
            out[d] = epochs * size[d] + min(size[d], max(left, 0))
            left -= size[d]
    return out
