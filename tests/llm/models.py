"""Plain models that the operators are compared with, and a small table of documents."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu re sa ti vo".split() for b in "l m n r s t".split()]


def rows(texts):
    """Rows of documents from {doc_id: text} or pairs."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS)


def prose(rng: random.Random, words: int) -> str:
    out = [rng.choice(WORDS) for _ in range(words)]
    return "".join(w + (".\n" if rng.random() < 0.1 else " ") for w in out).strip()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def shingle_sets(texts):
    out = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        out[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
    return out


def components(texts):
    """(n_shingles, smallest reachable key) by comparing all pairs."""
    sets = shingle_sets(texts)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
