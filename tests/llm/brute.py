"""Plain-Python versions of the query contracts, for small tables."""

import hashlib
import re

PII_KINDS = ("email", "ip", "card", "phone")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii(text):
    """Base spans as (start, place of kind, end)."""
    out = []
    for o, kind in enumerate(PII_KINDS):
        for m in re.finditer(PII[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{PII_KINDS[o]}:{s}:{e}" for s, o, e in spans)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def byte_words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]


def repeated_words(docs, size=35):
    """doc_id -> (words, removed, digest): windows that start anywhere else are removed."""
    words = {d: byte_words(t) for d, t in docs.items()}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            seen[tuple(w[i:i + size])] = seen.get(tuple(w[i:i + size]), 0) + 1
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), sha(b" ".join(kept)))
    return out


def repeated_bytes(docs, size=100):
    """doc_id -> (bytes, removed, runs, digest): strings that start earlier are removed."""
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            s = b[i:i + size]
            if s in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingle_set(text, size=4):
    w = [x.lower() for x in byte_words(text)]           # bytes.lower() folds A-Z only
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_components(docs, percent=80):
    """doc_id -> (shingles, component): all pairs, union-find."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}
