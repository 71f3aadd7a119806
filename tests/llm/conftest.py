import random

import pytest

LONG = " ".join(f"w{i % 997}" for i in range(60_000)) + " " + "x" * 50_000
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo za".split() for b in "dor lin mat nes pol rik sun tal ver wim".split()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, very long texts, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, "same words in two rows here"),
        (7, "same words in two rows here"), (7, "same words in two rows here"), (8, "one key"), (8, "two texts"),
        (None, "a row without a key"), (None, None), (9, "l1\nl2\nl3\n\n\n\nl4"), (10, "ünï çödé ١٢ 中文 \U0001F600"), (11, "...\n---"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns named like those that the operators add or use."""
    extra = "lang string, source string, n_chars long, n_lines string, removed string, shard string, score string, kept string, " \
            "component_id string, h string, id string, at string, n string, k string, held_out string, entities string, size string"
    schema = "doc_id long, text string, " + extra
    rows = [(i, t, "en" if t else None, "s", len(t or ""), *["clash"] * 14) for i, t in odd_rows]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture()
def rng():
    return random.Random(17)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at, how = rng.randrange(len(words)), rng.random()
        if how < 0.4:
            words[at] = rng.choice(WORDS)
        elif how < 0.7:
            del words[at]
        else:
            words.insert(at, rng.choice(WORDS))
    return " ".join(words)
