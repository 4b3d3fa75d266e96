import random

import pytest

BASE = [
    "The harbour office would rather paint the old bridge than repair the broken lamp near the quiet market tonight",
    "Nobody in the valley asked why the museum closed its green garden before the summer concert began again",
    "Please send the green parcel to the clinic before noon and tell the driver to wait outside the gate",
    "Почему старый поезд опять стоит около нового вокзала и никто не знает когда он снова поедет домой сегодня вечером",
]


def near(text: str, rng: random.Random, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k] = rng.choice(["lamp", "river", "again", "seven", "cloud"])
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus_rows():
    """(row_id, text, label, source, split): copies, near copies, look-alikes, nulls, ties, long texts."""
    rng = random.Random(3)
    texts = [None, "", "   ", "!!! ... ---", "​‍"]
    for b in BASE:
        texts += [b, b.upper(), b.replace(" ", "  ") + "!!", b.replace(" ", " ", 3), near(b, rng, 1), near(b, rng, 2), near(b, rng, 3), near(b, rng, 6)]
    texts += [BASE[0].replace("e", "е", 4), BASE[0].replace("o", "ο", 3), BASE[1].replace("a", "ａ"), BASE[2].replace("e", "e​", 2)]
    texts += ['{"name": "Ann", "mood": "Calm day"}', "mood: calm day | name: ann", "name=Ann; mood=Calm, day", "Mood: calm day\nName: Ann", "name ann mood calm day", "name: Ann | mood: Loud day"]
    texts += ["straße " + BASE[3], "STRASSE " + BASE[3], "café " + BASE[1], "café " + BASE[1], "cafe " + BASE[1]]
    long = " ".join(f"word{k % 311}" for k in range(6000))
    texts += [long, long + " tail", long.upper()]
    texts += ["hot post " + BASE[0]] * 40 + ["short"] * 30
    splits = ["train", "train", "train", "validation", "test", None, "train ", "other"]
    sources = ["plaza", " Plaza ", "lake", "hill", None, "", "unknown one", "lake\t"]
    rows = [(k, t, rng.choice([0, 1, 1, None, -1]), sources[(k // 3) % 8], splits[(k * 7) % 8]) for k, t in enumerate(texts)]
    return rows + [rows[9]]  # one row twice


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    df = spark.createDataFrame(corpus_rows, "row_id long, text string, label int, source string, split string")
    # extra columns whose names clash with inner ones
    return df.selectExpr("*", "1 as key_hi", "'x' as words", "2 as held", "3 as bucket", "4 as n").repartition(5)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.filter("false")
