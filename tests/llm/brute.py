"""Plain versions of the rules that the operators' queries must follow, for small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    n = Counter(x[3] for x in out)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


PATTERNS = (ASSIGN, re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}"))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def random_tokens(texts, min_ratio=16.0, weight=20.0):
    """Spans of each text whose ratio under the two Markov models is min_ratio or more; all texts are in the sample."""
    values, seen = [], Counter()
    for t in texts:
        for k, pattern in enumerate(PATTERNS):
            found = [m for m in pattern.finditer(t or "") if k or len(m[2]) >= 6]
            values += [re.search("[A-Za-z0-9+/_=-]*$", m[0])[0] for m in found]
        bare = t or ""
        for pattern in PATTERNS:
            bare = pattern.sub(" ", bare)
        seen.update(set(re.findall("[A-Za-z0-9+/_=-]{8,}", bare)))
    ordinary = [w for w, n in seen.items() if n >= 3]
    logs = []
    for tokens in (values, ordinary):
        pairs = Counter(p for w in tokens for p in zip(w, w[1:]))
        first, second, total = Counter(), Counter(), sum(pairs.values()) + len(ALPHABET)
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        logs.append({(a, b): math.log((pairs[a, b] + weight * (second[b] + 1) / total) / (first[a] + weight)) for a in ALPHABET for b in ALPHABET})
    out = []
    for t in texts:
        masked = t or ""
        if secrets(t)[4]:
            for pattern in PATTERNS:
                masked = pattern.sub(lambda m: " " * len(m[0]), masked)
        spans = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", masked):
            ratio = sum(logs[0][p] - logs[1][p] for p in zip(m[0], m[0][1:]))
            if re.search("[A-Za-z]", m[0]) and ratio >= min_ratio:
                spans.append((m.start(), m.end()))
        out.append(spans)
    return out


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def containment(text, templates, share, block=64):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
    blocks, text = [], lower(text or "")
    for w in map(split, text.split("\n")):
        blocks += [w] if len(w) <= block else [w[i : i + block] for i in range(0, len(w) - block // 2, block // 2)]
    w = split(text)
    blocks += [w[i : i + block] for i in range(0, max(1, len(w) - block * 3 // 4), block // 4)]
    best = {}
    for b in map(set, blocks):
        for t, label in templates.items():
            t = set(t.split())
            held = len(t & b) / len(t)
            if held >= share - 1e-9:
                best[label] = max(best.get(label, 0), held)
    return best


def line_dedup(docs, min_docs=10):
    seen = {}
    for i, text in docs:
        for x in (text or "").split("\n"):
            seen.setdefault(lower(x.strip(SPACE)), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not lower(x.strip(SPACE)) or len(seen[lower(x.strip(SPACE))]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fingerprints, radius=3):
    """fingerprints: [(doc_id, fingerprint)]; the smallest doc_id that each reaches."""
    ids = [i for i, _ in fingerprints]
    f = np.array([x for _, x in fingerprints], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.arange(len(ids))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    smallest = {}
    for i, c in zip(ids, label):
        smallest[c] = min(smallest.get(c, i), i)
    return {i: smallest[c] for i, c in zip(ids, label)}
