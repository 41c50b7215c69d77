"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re

import numpy as np

WORD_LOWER = re.compile("[A-Z]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(value) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def substring(rows, window):
    """id -> (words, removed, kept)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def suffixes(rows, window):
    """id -> (bytes, removed, runs, kept)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            key = raw[s : s + window]
            if key in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(key)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), kept)
    return out


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def near(rows, k, least=80):
    """id -> (set size, smallest id of the group)."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def exact(rows):
    """id -> (id that stays, group size, digest)."""
    groups = {}
    one = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    for i, t in one.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), sha(t)) for i, t in one.items()}


def nearest(vectors, k, every):
    """query -> ids of the k nearest others."""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        order = [o for o in np.lexsort((ids, d)) if np.isfinite(d[o])][:k]
        out[int(ids[q])] = [(int(ids[o]), float(d[o])) for o in order]
    return out


def best_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then those left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left, right = best_segments(scores[: at[0]]), best_segments(scores[at[1] :])
    return left + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in right]


def least_padding(lengths, buckets):
    """The least sum of bucket lengths over all choices of buckets for these lengths."""
    from itertools import combinations

    tops = sorted(set(lengths))
    if len(tops) <= buckets:
        return sum(lengths)
    return min(sum(min(b for b in (*c, tops[-1]) if b >= n) for n in lengths) for c in combinations(tops[:-1], buckets - 1))


def rebuilt(rows):
    """conv -> its turns (role, text), family heads put before; rows of (conv, turn, role, text)."""
    import zlib

    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, sha(f"{len((r or '').encode())}:{r or ''}{x or ''}"), (r or "", x or "")))
    own = {c: [v[3] for v in sorted(o)] for c, o in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def trie(turns):
    """Rows of the prefix trie of conv -> turns."""
    members = {}
    for c, o in turns.items():
        for d in range(len(o) + 1):
            members.setdefault(tuple(o[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    totals = {}
    for key in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(key, [])]
        saved = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        totals[key] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), *totals[k], sha(",".join(str(c) for c in sorted(m) if len(turns[c]) == len(k))))
        for k, m in members.items()
    )


def merkle(rows, run=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars), sorted."""
    import zlib

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + run])) for k in range(0, len(levels[-1]), run)])
        return levels

    def sides(levels, at):
        out = []
        for nodes in levels[:-1]:
            a = at - at % run
            out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + run])))
            at //= run
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = climb([levels[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for k, (_, _, h, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = sides(levels[s], k) + sides(top, n)
            seen = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                seen = leaf(r[0], WORD_LOWER.sub(lambda m: m[0].lower(), r[1]), *r[2:])
            for a, b in path:
                seen = sha(a + seen + b)
            out.append((r[0], h, levels[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), seen, seen == top[-1][0]))
    return sorted(out, key=str)
