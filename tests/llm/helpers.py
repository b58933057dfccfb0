"""What the tests of this folder share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LETTERS = "etaoinshrdlucmfwypvbgkqjxz"


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(3, 9))) for _ in range(n)]


def prose(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def edited(r, text, vocab, changes):
    words = text.split()
    for _ in range(changes):
        i = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[i] = r.choice(vocab)
        elif kind == 1:
            words.insert(i, r.choice(vocab))
        elif len(words) > 1:
            del words[i]
    return " ".join(words)


def docs(spark, rows):
    """Rows of (doc_id, text) or whole rows as a documents table."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=repr)
