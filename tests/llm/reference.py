"""Brute-force versions of the operators' digests, in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeat = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def contamination(docs, items):
    windows = {}
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= who
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def luhn(s):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(map(int, s[::-1]))) % 10 == 0


def spans(text, kinds):
    found = sorted((m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in pattern.finditer(text or "") if ok(m))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in found)


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]
SECRET = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(docs, bits=3):
    """The smallest id reachable from each row over fingerprints at most ``bits`` apart."""
    codes = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 62), d)
    return [(d, f"{codes[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)]


def base_scores(docs, train):
    words = {i: WORD.findall((t or "").translate(LOW)) + [None] for i, (_, t) in enumerate(docs)}
    c = Counter(w for i, ws in words.items() if train(docs[i][0]) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(docs[i][0], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words.items()]


def targets(sizes):
    """Water filling by repeated resharing: {source: size} to {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in done}
        left = total - sum(done.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in over}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
