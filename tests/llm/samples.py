"""Small odd inputs: nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, shard string, start string, score string, hash string, _id string, _hash string, _covered string, _lines string, _kept string, _text string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    pool = ["the", "of", "über", "ñandú", "reed", "than", "onth", "er", "ing", "lyes", "tion", "ouv", "énor", "zu", "ble"]
    out = []
    for i in range(words):
        out.append("".join(r.choice(pool) for _ in range(r.randint(1, 3))))
        if i % 9 == 8:
            out[-1] += "." if i % 27 != 26 else ".\n"
    return " ".join(out).replace("\n ", "\n")


def odd_documents(spark, more=()):
    base, passage = prose(1, 300), prose(2, 80)
    texts = [None, "", "a", "  \n\t ", base, base, base + " tail words", "x " + passage + " y", prose(3, 120) + "\n" + passage + "\n" + prose(4, 50),
             "B <|im_end|> c  d\r\n e f", "🙂 emoji ñ " * 40, prose(5, 6000), "l1\nl2\nl3\nl4\nl1\nl2\nl3\n", "same same same"]
    rows = [(i, t, "en", "s", len(t) if t else None, "x", "y", "z", None, "h", *"uvwxyz") for i, t in enumerate([*texts, *more])]
    rows += [(None, prose(6, 30), *[None] * 14), rows[5], rows[5]]
    return spark.createDataFrame(rows, COLUMNS)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
