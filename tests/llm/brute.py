"""Plain Python versions of the contract queries, for small inputs."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in BASE[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(UPPER)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def contaminated(docs, items, window=13):
    """docs, items: [(id, text)]. Yields (n_words, n_hit, n_items, digest, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    lengths = {len(k) for k in windows}
    for _, text in docs:
        w, hit, names = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[k]
        yield len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)


def substrings(docs, window=35):
    every = [WORD.findall(t or "") for t in docs]
    n = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    for w in every:
        gone = {i + j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(window)}
        yield len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def fingerprint(text):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, distance=3):
    """rows: [(id, fingerprint)]. {id: least id reachable}"""
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in rows}


def lm_scores(docs, alpha=0.4, order=2, own=1):
    """docs: texts. Yields (n_words, log10 score) by stupid backoff over the texts' own counts, less own."""
    every = [WORD.findall((t or "").translate(UPPER)) for t in docs]
    n = Counter(tuple(w[i : i + k]) for w in every for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, every))

    def score(gram):
        if len(gram) == 1:
            return max(n[gram] - own, 1) / max(total - own, 1)
        return (n[gram] - own) / (n[gram[:-1]] - own) if n[gram] - own > 0 else alpha * score(gram[1:])

    for w in every:
        yield len(w), sum(math.log10(score(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))


def kept_lines(docs, min_chars=10, least=2):
    """docs: [(id, text)]. Yields (n_lines, n_dropped, kept text); rows without id are one document, after all others."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(rank(i))
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= least and min(holders[key(x)]) != rank(i) for x in lines]
        yield len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)


def audit(docs, labels):
    """docs: [(id, text, source)], labels: [(id, quality, toxic)]. Rows of every part, order and step."""
    from itertools import permutations

    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = "".join(c for c, f in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and firsts[t] < i], strict=True) if f)
        parts.setdefault(s or "", []).append((fails, i in good, i in toxic))
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part, rows in parts.items():
        out, total = {}, Counter()
        for o in orders:
            left = rows
            for step, f in enumerate(o, 1):
                lost, earlier = [r for r in left if f in r[0]], [r for r in rows if f in r[0] and any(x in r[0] for x in o[: step - 1])]
                left = [r for r in left if f not in r[0]]
                total[f] += len(lost)
                out[o, step] = (len(left), len(lost), len(earlier), sum(r[0] == f for r in rows), sum(r[1] for r in lost), sum(r[2] for r in lost))
        for (o, step), x in out.items():
            yield (part, o, step, *x, total[o[step - 1]])


def collocations(docs, least=30, longest=4, cover=80, top=2000):
    """docs: [(text, lang)]. Rows (lang, rank, phrase, a, l, r, n, score)."""
    f, sizes = {}, Counter()
    for t, lang in docs:
        c = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang if lang is not None else "und"] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        most = Counter()
        for p, n in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], n)
        rows = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if not 100 * most[p] >= cover * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, p.decode(), -a, left, right, sizes[lang], -score
