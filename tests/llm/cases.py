"""Rows that every operator must bear, and brute-force models."""

import random

ODD = [
    (1, None, "en", "s"), (2, "", "en", None), (3, " \t\n ", None, "s"), (4, "one", "en", "s"), (4, "one", "en", "s"),
    (4, "other text with same id", "de", "s"), (None, "null id here", "en", "s"), (None, None, None, None),
    (5, "1234 5678 !!", "en", "t"), (6, "été 日本語 \U0001F600 end", "fr", "t"),
    (7, "word " * 30000, "en", "t"), (8, "  x\u0085y", "fr", "t"), (9, "a\x00b", "en", "t"),
]


def words(text):
    return (text or "").encode().split()


def roots(nodes, links):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text, k):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_roots(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return roots(ids, links)


def kept_words(rows, width):
    """{id: kept words} after removing windows that start in a document of a smaller id."""
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j:j + width]), i)
    out = {}
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j:j + width])] < i:
                gone.update(range(j, j + width))
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def copied_texts(count, seed, vocabulary=400, size=(5, 90), noise=0.04):
    """Texts of random words with exact copies, near copies and passages of earlier ones."""
    rnd, out = random.Random(seed), []
    for i in range(count):
        w = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(*size))]
        if out and rnd.random() < 0.6:
            other = rnd.choice(out)[1].split()
            how = rnd.random()
            if how < 0.3:
                w = other
            elif how < 0.7:
                w = [x if rnd.random() > noise else f"w{rnd.randrange(vocabulary)}" for x in other]
            else:
                a = rnd.randrange(len(other))
                w[rnd.randrange(len(w)):1] = other[a:a + rnd.randint(10, 40)]
        out.append((i * 3 + 1, " ".join(w)))
    return out
