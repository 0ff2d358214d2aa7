"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "the of and a in is it you that he was for on are with as his they be at one have this from".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(words))


def awkward_texts() -> list:
    passage, base = prose(1, 120), prose(2, 300)
    return [
        None, "", "   \n\t ", "!!! ... 123", "a", "two words", base, base, base.replace("the", "THE"), base + " tail",
        prose(3, 80) + " " + passage + " " + prose(4, 80), passage + prose(5, 100), prose(6, 40) + passage, "x" * 1500, "ab" * 900,
        prose(7, 30_000), passage + " " + passage, "é" * 450 + "ñ" * 450, "Ελληνικά " * 90, "\U0001f600" * 300, "zero\u0000byte " * 50,
        'password = "hunter2hunter2" and token: short secret=abcdefgh12', "AKIA" + "A1B2C3D4E5F6" + " " + "0123456789abcdef" * 3,
        prose(8, 5) + " api-key: zzz apikey='qqqqqqqqqqqq' " + "deadbeef" * 5, "token=secret: aaaaaaaaaa", "é password=ABCDEFGHIJ ü",
    ]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, rank int, size string, shard string, blob string, _key string, _kept string, row string"


def documents(spark, texts=None, ids=None, langs=None):
    texts = awkward_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or [None] * len(texts)
    rows = [(i, t, g, "s", 7, "k", "i", 3, "z", "h", "b", "u", "w", "r") for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(frame, key="doc_id"):
    return {row[key]: row for row in frame.collect()}
