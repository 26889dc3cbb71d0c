"""Small documents with odd cases, shared by the tests of this folder."""

import random

WORDS = "the of and ein der die que los para with under stone river light paper green quick brown table winter".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_documents():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, ties."""
    rnd = random.Random(5)
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d e", "A B C D E", "Ünï cödé 漢字 😀 é"]
    base = [sentence(rnd, rnd.randint(3, 120)) for _ in range(60)]
    texts += base
    texts += base[:10]  # exact copies
    for text in base[10:40]:  # near copies
        words = text.split()
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append(sentence(rnd, 9000))
    texts.append("x" * 30000)
    texts.append("mail me: jo.doe@mail.example.com or +1 (974) 555-3436, ip 10.1.2.3, card 4111 1111 1111 1111.")
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[12], None, None, None), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=""):
    """The documents; ``extra`` names further columns that hold their own name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({name: F.lit(name) for name in extra.split()}) if extra else df
