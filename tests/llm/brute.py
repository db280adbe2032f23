"""Plain restatements of what the queries must return, one document at a time or all pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    places = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def top5(rows):
    """rows: (vec_id, vector) -> sorted (query_id, rank, vec_id, score)."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(good):
        if qid is None or qid % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, i) for b, (i, v) in enumerate(good) if b != a and len(v) == len(q)]
        out += [(qid, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda t: t[:3])[:5], 1)]
    return sorted(out, key=str)


def targets(sizes, weights=(1, 2, 3), limit=3.0):
    """{source: size} -> {source: target} by sharing out again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, done = set(order), float(sum(sizes.values())), {}
    while True:
        share = {s: total * w[s] / sum(w[x] for x in left) for s in left}
        above = [s for s in left if share[s] > limit * sizes[s]]
        if not above:
            return done | share
        for s in above:
            done[s] = limit * sizes[s]
            total -= done[s]
            left.discard(s)


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """rows: (doc_id, text) -> (doc_id, hex, component) for each, all pairs compared."""
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n
    )


KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def secrets_base(text):
    found = []
    for n, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    count = Counter(f[3] for f in found)
    line = ",".join(f[2] for f in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(line.encode()).hexdigest(), line


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def check_packing(rows, texts, tok, tokens=2048):
    """rows: (doc_id, piece, start, length, crc, seq, offset); texts: {doc_id: text}. Returns the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc_id, piece, start, length, crc, seq, offset in rows:
        by_doc[doc_id].append((piece, start, length, crc))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(by_doc[doc_id])):
            assert (piece, start) == (i, at) and 0 < length <= tokens
            assert i == 0 or length == tokens
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by_seq)
