"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_rules(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def normalised(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line)).strip(" ").lower()


def frequent_lines(docs, min_documents=20):
    """docs: (doc_id, host, text); host -> normalised line -> text of the document with the smallest id that holds it."""
    holders = defaultdict(list)
    for doc, host, text in docs:
        for line in {normalised(x) for x in (text or "").split("\n") if words(x)}:
            holders[host, line].append((doc is None, doc if doc is not None else 0, text))
    found = defaultdict(dict)
    for (host, line), held in holders.items():
        if len({(none, doc, text if none else None) for none, doc, text in held}) > min_documents:
            found[host][line] = min(held, key=lambda h: h[:2])[2]
    return found


def clean(text, frequent):
    """(kept, text without the frequent lines of its host that another text keeps)"""
    n = len(words(text))
    lost = [x for x in (text or "").split("\n") if frequent and words(x) and frequent.get(normalised(x), text) != text]
    rest = "\n".join(x for x in (text or "").split("\n") if x not in lost) if lost else text
    left = len(words(rest))
    gone = bool(lost) and (left < 10 or 100 * left < 20 * n)
    return not base_rules(text)[5] and not gone, rest


def fingerprint(text):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest node of each node's group; linked(a, b) says whether two nodes are linked."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if root(a) != root(b) and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def simhash_components(docs):
    """docs: doc_id -> text"""
    prints = {d: fingerprint(t) for d, t in docs.items()}
    return prints, groups(docs, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def mix(docs, weights=(5, 2, 1), most=3, seed=17):
    """docs: (doc_id, source, text) -> rows (doc_id, size, source_size, target, copies)"""
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: float(most * sizes[s]) if s in capped else level * weight[s] for s in order}
    out = []
    for s in order:
        rows = [(hashlib.md5(f"{'' if d is None else d}:{seed}".encode()).hexdigest(), d, len(words(t))) for d, x, t in docs if x == s]
        whole = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        for _, d, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            out.append((d, n, sizes[s], target[s], whole + (before + n / 2 <= rest)))
            before += n
    return out


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def kneser(train, texts):
    """(n_tokens, n_known, base, score) of every text under an interpolated modified Kneser-Ney bigram model."""
    def run(text):
        return [*words(ascii_lower(text or "")), "\n"]

    pairs, uni = Counter(), Counter()
    for text in train:
        seq = run(text)
        uni.update(seq)
        pairs.update(zip([None, *seq], seq))
    follow, fan, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        follow[b] += 1
        fan[a][min(c, 3)] += 1
        total[a] += c

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            if all(0 < x <= k for k, x in enumerate(d, 1)):
                return [0, *d]
        return [0, 0.5, 1, 1.5]

    dp, dw = discounts(pairs.values()), discounts(follow.values())
    n, v, m = sum(uni.values()), len(uni), len(pairs)
    spare = sum(dw[min(c, 3)] for c in follow.values()) / m if m else 1

    def low(b):
        return ((follow[b] - dw[min(follow[b], 3)]) / m if m else 0) + spare / (v + 1)

    def prob(a, b):
        if not total[a]:
            return low(b)
        gamma = sum(dp[k] * x for k, x in fan[a].items()) / total[a]
        return (pairs[a, b] - dp[min(pairs[a, b], 3)]) / total[a] + gamma * low(b)

    out = []
    for text in texts:
        seq = run(text)
        out.append(
            (
                len(seq), sum(uni[t] > 0 for t in seq), sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in seq),
                sum(math.log10(prob(a, b)) for a, b in zip([None, *seq], seq)),
            )
        )
    return out, n, v, prob, [*uni]
