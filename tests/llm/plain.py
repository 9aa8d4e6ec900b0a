"""Slow, plain readings of what the operators promise."""

import hashlib
import re

import xxhash

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(t):
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def telling(texts, threshold=0.75, support=3, around=8):
    """For each text the spans of its disclosing terms, by counting all pairs of a term and an entity of a document."""
    import math
    import unicodedata

    def words(t):
        out, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and unicodedata.category(t[end])[0] in "LN":
                end += 1
            if end > at:
                out.append((t[at:end].lower(), at, end))
            at = max(end, at + 1)
        return out

    mentions, found, pairs, df, de = [], [], {}, {}, {}
    for t in texts:
        spans = personal(t or "")
        mentions.append({(k, t[a:b].lower() if k in ("email", "ip") else digits(t[a:b])) for k, a, b in spans})
        found.append((spans, words(t or "")))
        for e in mentions[-1]:
            de[e] = de.get(e, 0) + 1
        own = {}
        for i, (w, _, _) in enumerate(found[-1][1]):
            own.setdefault(w, set()).add(tuple(x[0] for x in found[-1][1][max(0, i - around):i + around + 1]))
        for w, contexts in own.items():
            df[w] = df.get(w, 0) + 1
            for e in mentions[-1]:
                pairs.setdefault((w, e), []).append(contexts)
    n, good = len(texts), set()
    for (w, e), contexts in pairs.items():
        c, d = len(contexts), len({min(x) for x in contexts})
        if c >= support and d >= support and 2 * d >= c and n > de[e] and math.log(c * n / (df[w] * de[e])) >= threshold * math.log(n / de[e]) - 1e-12:
            good.add((w, e))
    return [[(a, b) for w, a, b in ws if any((w, e) in good for e in m) and not any(a < y and x < b for _, x, y in spans)]
            for (spans, ws), m in zip(found, mentions)]


def secret(t):
    out = [("assign", m) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [("hex", m) for m in HEX.finditer(t) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], order.index(x[0])))


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, threshold):
    """Smallest reachable number of each of the fingerprints [(id, fingerprint)], by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (n, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), n), n)
    return [least[root(i)] for i in range(len(prints))]


def similar(docs, words=5, least=(4, 5)):
    """Smallest id reachable over links of a similarity of least[0] / least[1], for each of docs [(id, text)], by counting shared shingles."""
    sets = []
    for _, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else {()})
    parent, where = list(range(len(docs))), {}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        common = {}
        for s in own:
            for j in where.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            where[s].append(i)
        for j, c in common.items():
            if least[1] * c >= least[0] * (len(own) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for i, (n, _) in enumerate(docs):
        smallest[root(i)] = min(smallest.get(root(i), n), n)
    return [smallest[root(i)] for i in range(len(docs))]


def cut_lines(text):
    """Pieces of a text that begin at a word after a line break or after a word that ends with a punctuation mark."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    edges = [0]
    for a, b in zip(words, words[1:]):
        if a[0][-1] in ",.;:!?" or re.search(r"[\r\n]", text[a.end():b.start()]):
            edges.append(b.start())
    edges.append(len(text))
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def line_dedup(docs, least=20):
    """docs: [(id, text)] with different ids; every piece goes that lies in a run an earlier one has."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        pieces = cut_lines(text or "")
        words = [re.findall(r"[^\x20\x09-\x0D]+", p) for p in pieces]
        gone, now = [False] * len(pieces), set()
        for s in range(len(pieces)):
            e, n = s, 0
            while words[s] and e < len(pieces) and n < least:
                n += len(words[e])
                e += 1
            if words[s] and n >= least:
                run = tuple(p.strip(" \t\n\r\x0b\x0c") for p in pieces[s:e])
                now.add(run)
                if run in seen:
                    gone[s:e] = [True] * (e - s)
        seen |= now
        out[i] = "".join(p for p, g in zip(pieces, gone) if not g) if any(gone) else text
    return out


def segments(scores):
    """Maximal scoring segments: the best one (shortest, then first), then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    return segments(scores[:best[1]]) + [best[0]] + segments(scores[best[2] + 1:])
