"""Small tables that every operator must take, and plain-Python versions of them."""

import collections
import hashlib
import random
import re

import numpy as np

# Names that the operators use inside, as extra columns of the input.
CLASHING = ("id", "row", "key", "label", "tokens", "found", "hashes", "salt", "item", "rep", "at")


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text) as a table with clashing extra columns."""
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    return df.selectExpr("*", *(f"'x' as `{c}`" for c in CLASHING)) if extra else df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(text, seed, changes):
    rng = random.Random(seed)
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


MESSY = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one"),
    (6, "Ünï çode 漢字 🤗 words\nand lines\r\n\n"),
    (7, "a " * 40000),
    (8, prose(1, 300)),
    (8, prose(1, 300)),
    (None, prose(2, 200)),
    (None, None),
]


def near_components(texts, percent):
    """Shingle count and component of each id, by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in texts:
        w = space_words(lower(text))
        if len(w) >= 5:
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        else:
            sets[i] = frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(texts, length, keep_first):
    """Bytes, removed bytes, removed runs and what is left of each document."""
    docs = [(i, (t or "").encode()) for i, t in sorted(texts)]
    places = collections.Counter(
        b[s : s + length] for _, b in docs for s in range(len(b) - length + 1)
    )
    out, done = {}, set()
    for i, b in docs:
        covered = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            passage = b[s : s + length]
            if places[passage] > 1 and (not keep_first or passage in done):
                covered[s : s + length] = True
            done.add(passage)
        runs = int((np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1).sum())
        left = np.frombuffer(b, dtype=np.uint8)[~covered].tobytes()
        out[i] = (len(b), int(covered.sum()), runs, left)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
