"""Plain restatements of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib


def words_alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def words_space(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def contamination(docs, items, span=13):
    windows = {}
    for item_id, text in items:
        w = words_alnum(text)
        size = min(len(w), span)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w = words_alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= names
        out.append(
            (doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
        )
    return out


def components(docs):
    sets = {}
    for doc_id, text in docs:
        w = words_space(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                if 100 * len(x & y) >= 80 * len(x | y):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(sets[d]), root(d)) for d in ids]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def prefix_nodes(rows):
    """rows: (conv_id, turn, role, text). Nodes of the trie of rebuilt conversations, as tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        todo = [node]
        while todo:
            yield (node := todo.pop())
            todo += kids.get(node, [])

    out = []
    for node, own_members in members.items():
        tree = list(below(node))
        ends = sorted(c for c in own_members if len(rebuilt[c]) == len(node))
        out.append(
            (
                min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members),
                len(kids.get(node, [])), sum(n not in kids for n in tree),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in tree if n), sha(",".join(map(str, ends))),
            )
        )
    return sorted(out)


def resampled(docs, items, percent=25, least_words=20):
    """doc_id, n_features, weight, score, rank of each document (doc_ids distinct)."""

    def features(text):
        w = words_alnum(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def buckets(texts):
        out = [0] * 10_000
        for text in texts:
            for f in features(text):
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    s, t = buckets(x for _, x in docs), buckets(x for _, x in items)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)
    ]
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(words_alnum(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(tuple(r[:5]) for r in out)
