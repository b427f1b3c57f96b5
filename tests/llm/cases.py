"""Small documents with nulls, ties, repeated rows, very long texts and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _sha string, label string, id string"

EN, DE = "the and of that with this from have were been which there", "der die und das nicht mit sich auch werden einer noch nach"


def sentence(words: str, n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(words.split()) + draw.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


def rows() -> list[tuple]:
    out = []

    def add(text, lang="en", doc=0):
        out.append((doc if doc is None or doc else len(out) + 10, text, lang, None, None, "x", None, "y", "z"))

    for i in range(8):
        add(sentence(EN, 40 + i, i))
        add(sentence(DE, 40 + i, 100 + i), "de")
    base = sentence(EN, 200, 500).split()
    for i in range(6):  # near copies: a chain of single edits
        add(" ".join(base[:i] + [f"edit{i}"] + base[i + 1:]))
    for _ in range(3):
        add(" ".join(base))
    add(None)
    add("")
    add("", None)
    add("  \t\n ")
    add("12 34 !!", None)
    add("one")
    add("One")
    add("two words")
    add("x" * 5000 + " é日本 " * 300)
    add(sentence(EN, 30_000, 9))
    add(" ".join(base), "en", None)
    out.append(out[3])  # a repeated row
    out.append((out[5][0], *out[6][1:]))  # a doc_id with two texts
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
