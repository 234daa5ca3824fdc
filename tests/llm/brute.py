"""Plain versions of what the operators must return."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def _digits(x):
    return [int(c) for c in x if c in "0123456789"]


def luhn(x):
    n = _digits(x)
    return 16 <= len(n) <= 19 and (sum(n[-1::-2]) + sum(sum(divmod(2 * q, 10)) for q in n[-2::-2])) % 10 == 0


def pii(text):
    tests = (("email", EMAIL, lambda x: True), ("ip", IP, lambda x: all(int(q) <= 255 for q in x.split("."))), ("card", CARD, luhn), ("phone", PHONE, lambda x: 8 <= len(_digits(x)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in tests for m in p.finditer(text or "") if ok(m[0])]


def payload(text):
    b = (text or "").encode()
    p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes):
    """sizes: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * sizes[s]
            free.discard(s)
    return {s: full[s] if s in full else level * weight[s] for s in order}


def licenses(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def trigrams(text, buckets):
    """Counts by bucket, a character at a time."""
    out, kept = Counter(), " "
    for c in text.lower():
        c = c if "a" <= c <= "z" or c >= "\x80" else " "
        kept += "" if c == " " and kept[-1] == " " and len(kept) > 1 else c
    kept += " "
    for i in range(len(kept) - 2):
        x, y, z = map(ord, kept[i : i + 3])
        h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**64
        h ^= h >> 15
        out[(h * 0x2C1B3C6D % 2**64 >> 12) % buckets] += 1
    return out


def languages(text, langs, logp):
    """[(language, proportion)] of the best of all sets of languages, fitted long."""
    if text is None or not any(c.isalpha() for c in text) or not langs:
        return []
    counts = trigrams(text, len(logp))
    total, best = sum(counts.values()), None
    rows = [(n, [math.exp(x) for x in logp[b]]) for b, n in counts.items()]
    for size in range(1, len(langs) + 1):
        for some in itertools.combinations(range(len(langs)), size):
            share = [1 / size] * size
            for _ in range(60 if size > 1 else 0):
                sums = [0.0] * size
                for n, p in rows:
                    parts = [s * p[i] for s, i in zip(share, some, strict=True)]
                    for k, q in enumerate(parts):
                        sums[k] += n * q / sum(parts)
                share = [x / total for x in sums]
            value = sum(n * math.log(sum(s * p[i] for s, i in zip(share, some, strict=True))) for n, p in rows) - (size - 1) * (0.5 * math.log(total + 1) + 1)
            if best is None or value > best[0]:
                best = value, sorted(((langs[i], s) for s, i in zip(share, some, strict=True)), key=lambda x: (-x[1], x[0]))
    return best[1]


def license_labels(text, templates, k=3, neighbours=4, least=0.6, stretch=1.5):
    """Labels of the templates of which a chain of runs, ascending in the text and in the template, is found; every chain is tried."""
    w, out = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), set()
    for phrase, label in templates:
        own = phrase.split()
        hits = [(i, t) for i in range(len(w) - k + 1) for t in range(len(own) - k + 1) if w[i : i + k] == own[t : t + k]]
        diagonals = sorted({i - t for i, t in hits})
        group = {d: sum(b - a > neighbours for a, b in zip(diagonals[: n + 1], diagonals[1 : n + 1], strict=False)) for n, d in enumerate(diagonals)}
        longest = {}  # (first, hit): runs of the longest chain that begins and ends so
        for i, t in hits:
            longest[i, (i, t)] = 1
            for (first, (j, s)), n in list(longest.items()):
                if j < i and s < t and group[j - s] == group[i - t] and i + k - first <= int(stretch * len(own)):
                    longest[first, (i, t)] = max(longest.get((first, (i, t)), 0), n + 1)
        if longest and max(longest.values()) >= least * (len(own) - k + 1):
            out.add(label)
    return out


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(texts):
    """The least index of each text's class."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(i, j):
        a, b = sorted((root(i), root(j)))
        parent[b] = a

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            holders[h].append(i)
    same = {}
    for i, t in enumerate(texts):
        join(i, same.setdefault(t or "", i))
    for i, s in enumerate(sets):
        for j in {j for h in s for j in holders[h] if j < i}:
            o = sets[j]
            both = sum((s & o).values())
            if both / (sum(s.values()) + sum(o.values()) - both) >= 0.8 or len(s.keys() & o.keys()) / len(s.keys() | o.keys()) >= 0.8:
                join(i, j)
    return [root(i) for i in range(len(texts))]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("the", "an", "er", "on", "st", "re", "in")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edit(text: str, every: int, seed: int) -> str:
    rng, words = random.Random(seed), text.split()
    for i in range(rng.randrange(every), len(words), every):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)
