import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, links string, mix_source string, starts string"


def words(seed: int, n: int) -> str:
    """n invented words in sentences of up to nine."""
    r = random.Random(seed)
    out, left = [], 0
    for _ in range(n):
        if left == 0:
            left = r.randrange(3, 10)
        left -= 1
        w = "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(1, 5)))
        out.append(w + ("." if left == 0 else ""))
    return " ".join(out)


def documents(spark, rows):
    """A documents table from (doc_id, text[, lang[, source]]) with extra columns of clashing names."""
    full = [(d, t, *rest, *([None] * (2 - len(rest))), len(t) if t is not None else None, "x", "y", "z", "s") for d, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)
