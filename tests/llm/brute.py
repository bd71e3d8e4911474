"""Plain-Python versions of the contracts, a text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def item_words(text):
    return ITEM_WORD.findall(lower(text or ""))


def contamination(docs, items, window=13):
    phrases = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[k : k + n])].add(str(item))
    lengths = sorted({len(p) for p in phrases})
    out = {}
    for doc, text in docs:
        w = item_words(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if p := phrases.get(tuple(w[k : k + n])):
                    found |= p
                    hit[k : k + n] = [True] * n
        h = sum(hit)
        out[doc] = (len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return out


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(docs, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                held[line_key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(line_key(x), ())) < min_docs or max(held[line_key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(prints):
    """{doc: fingerprint} -> {doc: smallest doc reachable}."""
    by = defaultdict(list)
    for doc, fp in prints.items():
        by[fp].append(doc)
    fps = list(by)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for f in fps:
        least[root(f)] = min(least[root(f)], *by[f], 1 << 62)
    return {doc: least[root(fp)] for doc, fp in prints.items()}


def importance(docs, target, buckets=10_000, percent=10, min_words=20, seed=2024, max_run=1):
    """[(doc, n_features, weight, score, rank)] in the order of docs."""

    def features(text):
        w = item_words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_run + 1) for k in range(len(w) - n + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for (doc, _), f in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(out, docs, strict=True) if len(item_words(text)) >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def ranked(docs, items, k=10):
    """{item: [(doc, score)]} of the k best documents, every document scored."""
    own = [(d, Counter(item_words(t))) for d, t in docs if d is not None and item_words(t)]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = {}
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(item_words(text)) if c[w])
            if score > 0:
                scored.append((-score, doc))
        out[item] = [(doc, -score) for score, doc in sorted(scored)[:k]]
    return out


def exact_groups(docs):
    """[(doc, keep, size, kept, sha256)] in the order of docs."""
    text = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    ids, size = defaultdict(list), Counter(text(t) for _, t in docs)
    for doc, t in docs:
        ids[text(t)] += [doc] * (doc is not None)
    keep = {t: min(x, default=None) for t, x in ids.items()}
    return [(doc, keep[text(t)], size[text(t)], doc == keep[text(t)], hashlib.sha256(text(t).encode()).hexdigest()) for doc, t in docs]
