"""Plain Python versions of a few operators, for small fixtures only."""

import re
from difflib import SequenceMatcher

SUFFIXES = {"limited", "ltd", "inc", "corp", "corporation", "company", "co"}


def tokens(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def normalize(text):
    words = re.sub("[^a-z0-9 ]", " ", (text or "").lower()).split()
    return " ".join(w for w in words if w not in SUFFIXES)


def similarity(a, b):
    return SequenceMatcher(None, normalize(a), normalize(b)).ratio()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def greedy(titles, t):
    """Positions kept when the titles are read in order."""
    kept = []
    for at, title in titles:
        bag = tokens(title)
        if all(jaccard(bag, other) < t for _, other in kept):
            kept.append((at, bag))
    return [at for at, _ in kept]


def top_articles(suppliers, articles, terms, limit):
    """``{supplier: [(article, score), …]}`` by comparing every pair."""
    best = {}
    for key, name, location in suppliers:
        names, places, scored = tokens(name), tokens(location), []
        for at, text in articles:
            bag = tokens(text)
            score = round(
                0.5 * len(bag & names) / max(len(names), 1)
                + 0.3 * len(bag & places) / max(len(places), 1)
                + 0.2 * min(len(bag & set(terms)) / 2, 1.0),
                4,
            )
            if score > 0.2:
                scored.append((at, score))
        best[key] = sorted(scored, key=lambda s: -s[1])[:limit]
    return best
