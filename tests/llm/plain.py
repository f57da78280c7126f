"""Plain versions of the operators: every pair, every window, every match, in Python."""

import hashlib
import re
from collections import defaultdict


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SECRETS = [
    ("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
]


def spans_hash(found) -> str:
    return sha(",".join(f"{kind}:{a}:{b}" for kind, a, b in found))


def secrets(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    found.sort()
    return tuple(sum(f[1] == k for f in found) for k in range(3)) + (spans_hash([(f[2], f[0], f[3]) for f in found]),)


def luhn(s: str) -> bool:
    return sum(v if i % 2 == 0 else v * 2 // 10 + v * 2 % 10 for i, v in enumerate([int(c) for c in s if c.isdigit()][::-1])) % 10 == 0


def count_digits(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count_digits(s) <= 19 and luhn(s)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count_digits(s) <= 15),
]


def pii(text):
    found = [(k, m.start(), m.end(), name) for k, (name, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0])]
    return tuple(sum(f[0] == k for f in found) for k in range(4)) + (spans_hash([(f[3], f[1], f[2]) for f in sorted(found)]),)


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(docs):
    """id: (number of shingles, component)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def repeats(docs, length=50):
    """id: (bytes, removed, runs, hash of the rest)."""
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), sha(kept))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def overlaps(docs, items, window=10):
    held = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[k : k + window])].add(str(i))
    sizes = {len(x) for x in held}
    out = {}
    for d, t in docs:
        w, hit, ids = WORD.findall(lower(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if s := held.get(tuple(w[k : k + n])):
                    ids |= s
                    hit.update(range(k, k + n))
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


def warc(pages):
    first = {}
    for p, h in pages:
        b = (h or "").encode()
        if len(b) >= 100:
            first[sha(b)] = min(p, first.get(sha(b), p))
    out = {}
    for p, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[sha(b)] != p
        out[p] = (len(b), sha(b), "revisit" if revisit else "response", first[sha(b)] if revisit else None)
    return out


def domain(source: str) -> str:
    return f"domain{int(hashlib.md5(source.encode()).hexdigest()[:4], 16) % 3}"


def mix(rows, weights, share=(1, 2), most=3, seed=17):
    """Of (id, text, lang, source, domain): (id, domain, lang, source, tokens, epoch) rows."""
    docs = [(i, hashlib.md5((t or "").encode()).hexdigest(), (d or "(none)", lg or "(none)", s or "(none)"), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, lg, s, d in rows]
    leaf = defaultdict(int)
    for d in docs:
        leaf[d[2]] += d[3]

    def fill(budget, kids, level):
        weight = {k: weights.get(level, {}).get(k[-1], 1) for k in kids}
        out = dict.fromkeys(kids, 0)
        order = sorted((k for k in kids if weight[k] > 0), key=lambda k: (kids[k] / weight[k], k[-1]))
        left, rest = budget, sum(weight[k] for k in order)
        for n, k in enumerate(order):
            if kids[k] * rest > weight[k] * left:
                return out | {q: min(weight[q] * left // rest, kids[q]) for q in order[n:]}
            out[k], left, rest = kids[k], left - kids[k], rest - weight[k]
        return out

    budget = {(): sum(leaf.values()) * share[0] // share[1]}
    for n, level in enumerate(("domain", "lang", "source"), 1):
        below = {}
        for p, b in budget.items():
            room = defaultdict(int)
            for k, v in leaf.items():
                if k[: n - 1] == p:
                    room[k[:n]] += v * most
            below |= fill(b, room, level)
        budget = below
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    out = []
    for k, mine in groups.items():
        whole, rest = divmod(budget[k], leaf[k]) if leaf[k] else (0, 0)
        out += [(d[0], *k, d[3], e) for e in range(whole) for d in mine]
        run = 0
        for d in sorted(mine, key=lambda d: hashlib.md5(f"{seed}|{whole}|{'' if d[0] is None else d[0]}|{d[1]}".encode()).hexdigest()) if rest else []:
            run += d[3]
            if run > rest:
                break
            out.append((d[0], *k, d[3], whole))
    return out
