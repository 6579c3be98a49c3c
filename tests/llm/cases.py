"""Small documents that the tests of several operators share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, _bucket int"
HARD = ["", None, " ", "a", "x " * 30_000, "Ünïcödé ßtraße 🙂 é 日本語 x", "a  b\t\tc\n\n d ", "tab\x0bsep", "it's 12,000. e.g., \x01 end", "same text here now ok", "same text here now ok"]


def docs_of(spark, texts, source=lambda i: f"s{i % 3}"):
    """Texts as documents, with null ids, repeated rows and columns whose names operators use themselves."""
    rows = [(i, t, "en", source(i), len(t or ""), 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioutnrsl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(3, words))) for _ in range(n)]
