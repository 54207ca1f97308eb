import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 long, h long, n_words long, spans string, `_row` string, best double"


def make_documents():
    """Random prose with copies, near copies, shared passages, junk, ties, repeated rows, nulls and a long text."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("aeioubcdfgé ß"[:12]) for _ in range(rnd.randint(1, 8))).strip() or "x" for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(rnd.randint(1, 200)) for _ in range(70)]
    texts += [texts[3]] * 4 + [texts[7].upper(), texts[7].replace(" ", "\n", 5)]
    long = prose(150).split()
    for _ in range(4):
        near = list(long)
        near[rnd.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [f"{prose(30)}\n{passage} {prose(20)}" for _ in range(5)]
    texts += [None, None, "", "   ", "\t\n\x0b", "one", "a b c", "x " * 400, "line\nline\n\nline", "### $$$ %%% &&&", "a b  c 漢字 🙂 é", prose(8000), "Z" * 5000, passage, passage]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[9]), (None, "nobody has this text but this row with no id at all"), (None, "nobody has this text but this row with no id at all")]
    return [(i, t, "en", "s", len(t) if t is not None else None, 1, 2, 3, 4, "s", "r", 0.5) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in make_documents()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    """Even documents are good; every fifth is toxic; some labels and ids are missing."""
    found = [(r[0], int((r[0] // 3) % 7 != 0), int((r[0] // 3) % 5 == 0)) for r in make_documents() if r[0] is not None]
    return spark.createDataFrame([*found, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
