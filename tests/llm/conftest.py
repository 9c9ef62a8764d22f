import random

import pytest

DOCS = "doc_id long, text string"
#: Columns that operators might use inside, to be carried or ignored without harm.
CLASHING = "id long, th string, pos int, key string, k long, node int, sig string, count int, first string, n_lines string, score string, `a.b` int"


def corpus(seed=5, n=60, words=40):
    """Random documents of a small vocabulary with exact copies, near copies, shared passages, and odd texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(words)] + ["the", "of", "and"]
    say = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage, line = say(70), " ".join(say(8))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            body = say(draw.randint(1, 160))
        elif kind == 1:
            body = draw.choice(texts).split(" ")
        elif kind == 2:
            body = draw.choice(texts).split(" ")
            for _ in range(draw.randint(1, 3)):
                body[draw.randrange(len(body))] = draw.choice(vocabulary)
        elif kind == 3:
            at = draw.randint(0, 15)
            body = say(draw.randint(0, 40)) + passage[at:] + say(draw.randint(0, 40))
        elif kind == 4:
            body = say(3) * draw.randint(1, 40)
        else:
            body = "\n".join([" ".join(say(4)), line, line + "2", line + "3", " ".join(say(3))]).split(" ")
        texts.append(" ".join(body))
    odd = [None, "", " ", "\n\n\n", "x", "!!! ???", "the the the", "Ünï çødé", "a" * 900, " ".join(["same"] * 300), "tab\tsep\x0bbreak\x0cfeed", "nul\x00byte"]
    rows = [(i * 3, t) for i, t in enumerate([*texts, *odd])]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, ids with several texts."""
    text = "one two three four five six seven eight nine ten " * 9
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 9
    return spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (2, other), (3, other + "x"), (None, None), (4, ""), (1, "short")], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide_docs(spark, rows):
    """The documents with extra columns of clashing names."""
    names = [c.split()[0].strip("`") for c in CLASHING.split(", ")]
    values = {"long": 7, "int": 7, "string": "z"}
    kinds = [c.split()[1] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *(values[k] for k in kinds)) for r in rows], f"{DOCS}, {CLASHING}"), names
