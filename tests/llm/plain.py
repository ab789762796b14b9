"""Plain restatements of the operators' rules, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if t else []
    windows = {}
    for name, text in items:
        w = words(text)
        spans = [w] if 0 < len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)]
        for s in spans:
            windows.setdefault(tuple(s), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def simhash(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, most=4):
    """fps: {doc_id: fingerprint}; the smallest reachable id of each."""
    ids = sorted(fps)
    root = {}
    for first in ids:
        if first in root:
            continue
        todo = [first]
        root[first] = first
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in root and bin(fps[x] ^ fps[y]).count("1") <= most:
                    root[y] = first
                    todo.append(y)
    return root


def removed_words(docs, window=20):
    """docs: (doc_id, text); doc_id, words, removed, digest of the kept words."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lm_base(docs, learn):
    """docs: (doc_id, text); tokens, known tokens, training tokens and unigram score of each."""
    import collections
    import math

    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), ""] for d, t in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if learn(d) for w in ws)
    n = sum(counts.values())
    z = n + 0.5 * (len(counts) + 1)
    return {
        d: (len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.5) / z) for w in ws))
        for d, ws in tokens.items()
    }


def lm_bigram(docs, learn, frequent, discount):
    """The class-based bigram score without shards, trie or quantisation. frequent: set of words."""
    import collections
    import math

    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), ""] for d, t in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if learn(d) for w in ws)
    z = sum(counts.values()) + 0.5 * (len(counts) + 1)
    share = lambda w: (counts[w] + 0.5) / z
    rare = 1 - sum(share(w) for w in [*frequent, ""])
    kind = lambda w: w if w in frequent or not w else None
    pairs, uses, types = collections.Counter(), collections.Counter(), collections.Counter()
    for d, ws in tokens.items():
        if learn(d):
            for v, w in zip([0, *ws], ws):
                types[v] += (v, kind(w)) not in pairs
                pairs[v, kind(w)] += 1
                uses[v] += 1
    out = {}
    for d, ws in tokens.items():
        total = 0.0
        for v, w in zip([0, *ws], ws):
            k = kind(w)
            own = rare if k is None else share(w)
            p = own if not uses[v] else max(pairs[v, k] - discount, 0) / uses[v] + discount * types[v] / uses[v] * own
            total += math.log10(p) + (math.log10(share(w) / rare) if k is None else 0)
        out[d] = total
    return out
