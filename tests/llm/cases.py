"""Small documents with every odd case, and plain versions of the operators."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, start string, mini long, `key` string, label int"


def prose(n, seed=1):
    x, out = seed, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(("th er on an re he in ed nd ha".split())[x >> 60 & 7] + ("a é o u".split())[x >> 40 & 3] + str(x >> 33 & 7))
    return " ".join(out)


def texts():
    """doc_id, text."""
    p, q = prose(300), prose(120, 9)
    shared = prose(70, 5)
    near = p.split()
    near[40] = "edited"
    out = [None, "", " \n\t ", "one", "one", "one two", "ONE two", p, p, " ".join(near), p.replace(" ", "\n"), q + " " + shared, shared + "\n" + prose(90, 7), prose(80, 8) + " " + shared + " " + prose(60, 3), "a" * 3000, "ab " * 900]
    out += [prose(5000, 77), "\x85 é ü  " + q, "line one here\nline one here\nother #$%|<>\n\n \nline one here", prose(49, 4), prose(50, 4), prose(51, 4), "x퟿ y " * 3]
    out += [f"{shared} {prose(30, 1000 + k)}" for k in range(12)]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def rows(extra=True):
    """Rows of SCHEMA; with extra, also rows without doc_id and repeated ones."""
    own = texts()
    if extra:
        own += [(None, own[7][1]), (None, None), own[9], (own[3][0], prose(60, 21))]
    return [(i, t, "en", None, None, 1, "s", 2, "k", 0) for i, t in own]


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeated_words(docs, width):
    """docs: (doc_id, text). For each row the words that stay."""
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_bytes(docs, n):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingle_set(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def near_components(docs, n, percent):
    """docs with distinct ids: id to (set size, smallest id reachable)."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
