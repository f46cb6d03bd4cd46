"""Documents that operators must handle, and plain versions of what they compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["_words", "_Measures", "h", "norm", "digest", "keep_id", "node", "component", "block", "_key", "_pass", "_block", "tokens", "start", "length", "band", "_gone", "_digest", "key"]


def documents(seed=5, n=60):
    """Prose with exact and near copies, ties, nulls, empty, blank and very long texts, and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [prose(rng.randint(3, 120)) for _ in range(n)]
    base = prose(80).split(" ")
    for k in range(12):  # near copies of one text, from very alike to unlike
        words = list(base)
        for at in rng.sample(range(80), k):
            words[at] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[3]] * 4 + [texts[4].replace(" ", "  "), texts[4].replace(" ", "\n\t"), texts[5].upper()]
    texts += ["", "", None, " \n ", "one", "one two three", "ONE two three", prose(9000), "the of and " * 40, "a\0b <|endoftext|> 'll ١٢ é́  x", "x" * 5000, "same line here\n" * 30]
    rows = [(i * 7 % 1009, t, "en", None if i % 11 == 0 else f"src{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, clashes=True, parts=3):
    """Rows as a table, with further columns whose names operators might trip over."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near_components(rows, width, percent=80):
    """doc_id to (set size, component), from all pairs."""
    sets = {r[0]: shingles(r[1], width) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
