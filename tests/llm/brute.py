"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

import xxhash

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(rows, max_share=0.05, min_docs=20, min_left=30):
    """[(doc_id, text, host)] -> [(doc_id, counts..., base_failed, kept, clean)], rows in order."""
    norm = lambda x: " ".join(SPACE.findall(x.lower()))
    held, docs = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        docs[host or ""].add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                held[host or "", norm(line)].add(text or "")
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = SPACE.findall(text)
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i:i + 8])].append(i)
        repeat = {i + j for s in at.values() if len(s) > 1 for i in s for j in range(8)}
        gone = [x for x in text.split("\n") if norm(x) and len(held[host or "", norm(x)]) > min_docs
                and len(held[host or "", norm(x)]) > max_share * len(docs[host or ""])]
        removed = sum(len(SPACE.findall(x)) for x in gone)
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        kept = not failed and 100 * (len(words) - removed) >= min_left * len(words)
        clean = "\n".join(x for x in text.split("\n") if x not in gone) if gone else text
        out.append((doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
                    len(lines) - len(set(lines)), len(repeat), failed, kept, clean))
    return out


def fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """[(doc_id, text)] -> {doc_id: smallest id reachable}."""
    prints = [(d, fingerprint(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1:]:
            if (x ^ y).bit_count() <= 3 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def substrings(rows, window=13):
    """[(doc_id, text)] -> {doc_id: kept words}."""
    split = {d: SPACE.findall(t or "") for d, t in rows}
    least = {}
    for d, words in split.items():
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, words in split.items():
        gone = {i + j for i in range(len(words) - window + 1) if least[tuple(words[i:i + window])] < d for j in range(window)}
        out[d] = [w for i, w in enumerate(words) if i not in gone]
    return out


def contamination(rows, items, window=13):
    """[(doc_id, text)], [(item, text)] -> [(doc_id, words, hit, items, contaminated)]."""
    wins = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            wins[tuple(words[i:i + size])].add(item)
    sizes = {len(w) for w in wins}
    out = []
    for d, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if key := wins.get(tuple(words[i:i + size])):
                    hit |= set(range(i, i + size))
                    found |= key
        out.append((d, len(words), len(hit), sorted(str(x) for x in found if x is not None),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return out
