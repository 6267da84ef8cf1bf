"""Small documents with the cases every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))


def word(i: int) -> str:
    return "w" + "".join("aeioulnrst"[int(d)] for d in str(i))


def frame(spark, rows, extra=False):
    """Rows (doc_id, text, lang, source); extra adds columns whose names operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    made = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("n_words", "key", "row", "hash", "fp", "kept", "component_id", "ids", "words", "hits"):
            made = made.selectExpr("*", f"'x' AS {name}")
    return made


def odd_rows():
    rng = random.Random(7)
    base = prose(rng, 60)
    return [
        (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, base, "en", "a"), (4, base, "en", "b"),
        (5, base + " tail", "en", "a"), (5, base + " tail", "en", "a"), (6, prose(rng, 30_000), "en", "a"), (7, "one", None, "a"), (8, "É à ß " * 5, "fr", "a"),
        (None, "no id here at all", "en", "a"), (9, "日本語 テスト <|endoftext|> x", "ja", "c"),
    ]
