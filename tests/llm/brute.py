"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(_LOWER)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(found) - 7):
        windows[tuple(found[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


END = object()


def tokens(text):
    return [*words(lower(text)), END]


def base_scores(docs):
    """{row: (n_tokens, n_known, N, base_score)} of a list of (doc_id, text)."""
    counts = Counter(t for i, text in docs if not is_held_out(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, text in docs:
        found = tokens(text)
        out.append((len(found), sum(counts[t] > 0 for t in found), total, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found)))
    return out


def bigram_scores(docs, mu=256.0, step=1.5):
    """The model of lm_score with exact tables in place of its filter."""
    train = [tokens(text) for i, text in docs if not is_held_out(i)]
    counts = Counter(t for x in train for t in x)
    pairs = Counter((v, w) for x in train for v, w in zip([END, *x], x, strict=False))
    level = lambda n: 1 + math.floor(math.log(n) / math.log(step) + 1e-9)
    held = {p: math.ceil(step ** (level(n) - 1) - 1e-9) for p, n in pairs.items()}
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, text in docs:
        found, score = tokens(text), 0.0
        for v, w in zip([END, *found], found, strict=False):
            p = (counts[w] + 0.1) / (total + 0.1 * (distinct + 1))
            score += math.log10((held.get((v, w), 0) + mu * p) / (counts[v] + mu))
        out.append(score)
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_path_rule(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = lower(host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def removals(texts, size=35):
    """[(n_words, n_removed, kept_sha256)]."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def pieces(text, encode, capacity=2048):
    """{piece: (start, length, crc)} of one document, its ids by ``encode``."""
    ids = np.array([*encode(text or ""), 0], dtype="<u4")
    first = len(ids) % capacity or capacity
    bounds = [(0, first)] + [(a, capacity) for a in range(first, len(ids), capacity)]
    return {k: (a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(bounds)}


def simhash(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, radius=4):
    """Smallest id of each row's component."""
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    at = {int(v): find(i) for i, v in enumerate(values)}
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[at[p]] = min(i, least.get(at[p], i))
    return [least.get(at[p]) for p in prints]


def edited_texts(rows):
    """[(doc_id, text, edited text, next text)] in order of id."""
    rows = sorted(rows)
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        half = len(text or "") // 2
        out.append((i, text or "", (text or "")[: len(text or "") - half] + after[:half], after))
    return out


def jaccard(a, b, size=5):
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def similar_components(rows, least=0.8):
    """Smallest id of each row's group of texts that are connected by similarities of ``least`` or more."""

    def shingles(text):
        w = words(lower(text))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    kinds = sorted(set(sets), key=sorted)
    root = list(range(len(kinds)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(kinds):
        for j in range(i):
            if a and kinds[j] and len(a & kinds[j]) >= least * len(a | kinds[j]):
                root[find(i)] = find(j)
    at = {k: find(i) for i, k in enumerate(kinds)}
    ids = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            ids[at[s]] = min(i, ids.get(at[s], i))
    return [ids.get(at[s]) for s in sets]


def filter_audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good lost, toxic lost, shapley)} of (doc_id, part, text) rows."""
    from itertools import permutations

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    failed = []
    for i, part, text in docs:
        text, found = text or "", words(text)
        fails = {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        failed.append((i, part or "", {f for f, bad in fails.items() if bad}))
    out = {}
    for part in {p for _, p, _ in failed}:
        here = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                bad = [x for _, x in here if f in x]
                out[part, "".join(order), step] = [len(left), len(gone), len(bad) - len(gone), sum(x == {f} for x in bad), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {key: tuple(row) for key, row in out.items()}


def merkle(groups):
    """(root, {group: subroot}, [(group, position, siblings, rights)]) of {group: leaves in order}, groups in order of their keys."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def tree(leaves):
        levels = [list(leaves)]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
        proofs = []
        for i in range(len(leaves)):
            at = [(i >> k, level) for k, level in enumerate(levels[:-1])]
            proofs.append(([level[j ^ 1] if j ^ 1 < len(level) else None for j, level in at], [bool(j & 1) for j, _ in at]))
        return levels[-1][0], proofs

    below = {g: tree(leaves) for g, leaves in groups.items()}
    root, above = tree([below[g][0] for g in sorted(groups)])
    found = []
    for at, g in enumerate(sorted(groups)):
        found += [(g, i, s + above[at][0], r + above[at][1]) for i, (s, r) in enumerate(below[g][1])]
    return root, {g: x[0] for g, x in below.items()}, found
