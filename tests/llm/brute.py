"""Plain versions of what the operators return, and frames with awkward rows."""

from __future__ import annotations

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n long, words string, key string, n_words int, spans string"


def frame(spark, texts, schema=DOCS):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, 7, "x", "k", 1, "s") for i, t, lang, source in ((*r, "en", "a")[:4] if len(r) == 2 else r for r in texts)], schema)


def words(text):
    return (text or "").encode().split()


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def repeats(rows, width=13):
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def shingles(text, width=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, kind, m.end()))
    line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))
    return line, hashlib.sha256(line.encode()).hexdigest()


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict
