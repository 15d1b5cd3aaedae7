"""The contracts of the text operators in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None, pattern=WORD) -> list[str]:
    return pattern.findall((text or "").translate(AZ))


def fold(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for other in {o for x in s for o in holders[x] if o < k}:
            j, t = sets[other]
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m[0])) <= 15),
}
SECRET = {
    "assign": (r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def spans(text: str | None, kinds: dict, by_start: bool) -> tuple[list[int], str]:
    """Counts by kind, and ``kind:start:end``, comma-joined."""
    found = [(k, m.start(), m.end()) for k, (_, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
    found.sort(key=lambda x: (x[1], x[0]) if by_start else (x[0], x[1]))
    names = list(kinds)
    return [sum(1 for x in found if x[0] == k) for k in range(len(names))], ",".join(f"{names[k]}:{s}:{e}" for k, s, e in found)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_scores(docs: list[tuple[int, str | None]]) -> tuple[int, list[tuple]]:
    """Training tokens, and for each document (doc_id, held out, tokens, known, base score)."""
    end = object()
    counts: Counter = Counter()
    for i, t in docs:
        if fold(i, 7) != 2:
            counts.update([*words(t), end])
    n, v, out = sum(counts.values()), len(counts), []
    for i, t in docs:
        tokens = [*words(t), end]
        score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        out.append((i, fold(i, 7) == 2, len(tokens), sum(counts[x] > 0 for x in tokens), score))
    return n, out


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple]) -> dict[int, bool]:
    windows = set()
    for item, text in items:
        w = words(text, ALNUM)
        if w:
            windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    lengths, out = sorted({len(w) for w in windows}), {}
    for i, t in docs:
        w, hit = words(t, ALNUM), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        out[i] = bool(hit) and 20 * len(hit) >= len(w)
    return out


def repeats(docs: list[tuple[int, str | None]], least: int) -> set[tuple[int, int, int]]:
    """(doc_id, start, end) of the longest spans of words covered by runs of ``least`` words that a smaller doc_id holds as well."""
    seen, out = {}, set()
    for i, t in sorted(docs):
        w, hit = words(t), set()
        for k in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[k : k + least]), i) != i:
                hit |= set(range(k, k + least))
        starts = sorted(x for x in hit if x - 1 not in hit)
        out |= {(i, s, next(e for e in range(s, len(w) + 1) if e not in hit)) for s in starts}
    return out
