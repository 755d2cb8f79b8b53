"""Plain Python versions of the corpus operators' contracts, for small inputs: lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62                      # a null id


def low(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def covered(n, starts, k):
    return sorted({i for s in starts for i in range(s, min(n, s + k))})


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        rep = len(covered(len(w), [i for i, g in enumerate(grams) if n[g] > 1], 5))
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep,
                    len(w) < 10 or 100 * rep > 20 * len(w)))
    return out


def line_verdicts(docs, max_docs, min_words, min_share):
    """[(doc_id, words in boilerplate lines, depleted)] of (doc_id, source, text)."""
    norm = lambda x: " ".join(WORD.findall(low(x)))
    holders = defaultdict(set)
    for d, s, t in docs:
        for line in (t or "").split("\n"):
            if norm(line):
                holders[s, norm(line)].add(t)
    out = []
    for d, s, t in docs:
        n = len(WORD.findall(t or ""))
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if norm(x) and len(holders[s, norm(x)]) > max_docs)
        out.append((d, gone, gone > 0 and (n - gone < min_words or n - gone < min_share * n)))
    return out


def earlier_bytes(docs, k=50):
    first = {}
    raws = [(LAST if d is None else d, (t or "").encode()) for d, t in docs]
    for d, b in raws:
        for i in range(len(b) - k + 1):
            first[b[i:i + k]] = min(first.get(b[i:i + k], LAST), d)
    out = []
    for (d, _), (key, b) in zip(docs, raws):
        cut = covered(len(b), [i for i in range(len(b) - k + 1) if first[b[i:i + k]] < key], k)
        spans = sum(1 for i, x in enumerate(cut) if not i or cut[i - 1] + 1 < x)
        gone = set(cut)
        out.append((d, len(b), len(cut), spans, sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def repeated_words(docs, k=35):
    n, texts = Counter(), [(d, WORD.findall(t or "")) for d, t in docs]
    for _, w in texts:
        n.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for d, w in texts:
        cut = set(covered(len(w), [i for i in range(len(w) - k + 1) if n[tuple(w[i:i + k])] > 1], k))
        out.append((d, len(w), len(cut), sha(" ".join(x for i, x in enumerate(w) if i not in cut))))
    return out


def licence_base(docs):
    phrases = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    out = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        hits = [(i, label) for p, label in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15))


def personal(docs):
    out = []
    for d, t in docs:
        spans = [(k, m.start(), m.end()) for k, p, ok in PERSONAL for m in re.finditer(p, t or "") if ok(m.group(0))]
        out.append((d, *(sum(s[0] == k for s in spans) for k, _, _ in PERSONAL), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    return out


def copies(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[low(t or "")].append(d)
    out, used = [], set()
    for d, t in docs:
        key = low(t or "")
        keep = max((x for x in groups[key] if x is not None), default=None)
        kept = d == keep and key not in used
        if kept:
            used.add(key)
        out.append((d, keep, len(groups[key]), kept, sha(key)))
    return out


def components(docs, size=4, percent=85):
    sets = []
    for _, t in docs:
        w = WORD.findall(low(t or ""))
        n = min(size, len(w)) or 1
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)})
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    low_id = {}
    for i, (d, _) in enumerate(docs):
        low_id[root(i)] = min(low_id.get(root(i), LAST), LAST if d is None else d)
    return [(d, len(sets[i]), None if low_id[root(i)] == LAST else low_id[root(i)]) for i, (d, _) in enumerate(docs)]
