"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(rows):
    """[(id, keep_id, size, kept, sha)] of (id, text) rows with unique ids."""
    groups = {}
    for key, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), key))
    out = []
    for plain, members in groups.items():
        keep = min(members)[1]
        out += [(key, keep, len(members), key == keep, hashlib.sha256(plain.encode()).hexdigest()) for _, key in members]
    return sorted(out)


def shingles(text, size=5):
    words = RUN.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def components(rows, percent=85, size=5):
    """[(id, n, component)]."""
    sets = {key: shingles(text, size) for key, text in rows}
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(key, len(sets[key]), root(key)) for key in keys]


def contamination(rows, items, window=10):
    """[(id, n_words, n_hit, item ids, spans)]."""
    patterns = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if words else 0):
            patterns.setdefault(tuple(words[k : k + m]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for key, text in rows:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(words) - m + 1):
                if (got := patterns.get(tuple(words[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= got
        out.append((key, len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licences(text):
    """(n_words, n_base, first, last, labels)."""
    words = WORD.findall(lower(text))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))
