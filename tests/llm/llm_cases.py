"""Small documents with every odd case, and plain versions of the operators to hold them against."""

import random
import string

LETTERS = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def documents():
    """Near and exact copies, shared passages, nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    passage = " ".join(some_words(rng, 50, 10**6))
    base = some_words(rng, 120, 10**6)
    rows = []

    def add(text, lang="en", source="a"):
        rows.append((len(rows), text, lang, source, None if text is None else len(text)))

    for _ in range(12):
        add(" ".join(some_words(rng, rng.randrange(1, 90))), source=rng.choice(["a", "b", "ä", None]))
    for _ in range(6):  # near copies of one document, apart from each other
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = "changed%d" % rng.randrange(99)
        add(" ".join(copy), source="b")
    add(" ".join(base))
    add(" ".join(base).upper())
    add(" ".join(base))
    for _ in range(4):
        add(" ".join(some_words(rng, 20) + [passage] + some_words(rng, 10)), lang="fr")
    add("\t".join(some_words(rng, 35, 10**6) * 3))  # repeats within one document
    add("x y " * 40)
    add(None)
    add(None, lang=None, source=None)
    add("")
    add(" \n\t\x0b\x0c\r ")
    add("one two three")
    add("One TWO\x0bthree")
    add("a\x1cb\x85c\xa0d é Σας ΣΑΣ İ ß <|endoftext|>")
    add(" ".join(some_words(rng, 9000, 10**6)), source="hot")
    rows.append(rows[0])  # a repeated row
    rows.append((None, "text without an id, but with words of its own", "en", "a", 45))
    rows.append((None, None, None, None, None))
    return rows


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        clash = ["shard", "slot", "size", "target", "copies", "taken", "ids", "start", "length", "n_words", "kept_text",
                 "lang_pred", "score", "host", "kept", "component_id", "_a", "_b", "_part", "node"]
        df = df.withColumns({c: F.lit("clash") for c in clash})
    return df


def words(text):
    return [] if text is None else text.encode().split()


def shingles(text):
    got = [] if text is None else text.encode().translate(LETTERS).split()
    return {tuple(got[i : i + 5]) for i in range(max(1, len(got) - 4))} if got else set()


def near_components(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, window):
    """(doc_id, kept words, removed) per row, by counting every window."""
    seen = {}
    for _, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] = seen.get(tuple(w[j : j + window]), 0) + 1
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone)))
    return out
