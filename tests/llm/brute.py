"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring(rows, window=13):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text); a null id ranks last."""
    rank = lambda i: (i is None, i or 0)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(A_TO_Z))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(rows):
    """(doc_id, n, component) of rows (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [(i, len(sets[i]), find(i)) for i in ids]


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    repeated = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def exact(rows):
    """(doc_id, keep_id, size, kept, sha) of rows (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return out


_RULES = [
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ("key_block", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
]


def secrets(text):
    spans = []
    for n, (kind, pattern, group, least) in enumerate(_RULES):
        spans += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans.sort()
    base = ",".join(s for _, n, s in spans if n < 3)
    return [sum(n == k for _, n, _ in spans) for k in range(3)] + [hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, _, s in spans)]
