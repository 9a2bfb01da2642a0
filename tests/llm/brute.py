"""Plain, quadratic versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def equal_groups(docs):
    groups = defaultdict(list)
    for i, (_, text) in enumerate(docs):
        groups[(text or "").translate(LOWER)].append(i)
    return groups


def classes(docs):
    """component_id per document: smallest doc_id reachable by links."""
    sets = {}
    for d, text in docs:
        w = split_words((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def without_repeats(docs):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        w = split_words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = pattern.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(str(item))
    out = {}
    for d, text in docs:
        w, found = pattern.findall((text or "").translate(LOWER)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit[s : s + n] = [True] * n
        out[d] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """Base spans by kind as listed, then start."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def secrets(text):
    """Base spans by start, then kind as listed."""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = (
        ("assign", rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [s for _, _, s in sorted(found)]
