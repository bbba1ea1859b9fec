"""Documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, key string, content string, spans string, idx int, _score double"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = words(rng, 120)
    edited = base.split()
    edited[40] = "changed"
    passage = words(rng, 60, 5000)
    out = [None, "", " ", "one", "one two", "one two three", base, base, " ".join(edited), words(rng, 100) + " " + passage, passage + " " + words(rng, 80), "A" * 30_000, words(rng, 6_000), "ÄÖ ß 日本語 🙂 text", "a\n" * 50, "\x1c x y \x0b z"]
    return out + [words(rng, rng.randrange(1, 200)) for _ in range(25)]


def rows():
    out = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "x", "y", "z", "c", "s", 1, 0.5) for i, t in enumerate(texts())]
    out[3] = (3, "one", None, None, None, None, None, None, None, None, None, None)
    return out


def documents(spark, with_null_id=True, repeated=True):
    data = rows()
    if repeated:
        data += [data[6], data[6], data[1]]
    if with_null_id:
        data.append((None, "no id here at all", "en", "s0", 17, "x", "y", "z", "c", "s", 1, 0.5))
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
