import random

import pytest

#: Rows that every operator must stand: nulls, empty and blank texts, one word, very long words and
#: lines, repeated rows, ids that repeat.
ODD = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900005, "One"), (900006, "a b"),
       (900007, "z" * 3000), (900008, "x " * 1500), (900008, "x " * 1500), (900009, "\n" * 300), (900010, "é🙂漢 ß")]


def with_extra(spark, docs):
    """documents-like table whose extra columns have clashing names."""
    rows = [(d, t, "s" if d is None else f"s{d % 3}" if d % 5 else None, 1, 2.0, "k", "r", True) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, score double, "
                                       "key string, r string, cell boolean")


@pytest.fixture(scope="session")
def mixed_docs():
    """Texts made of shared passages with edits, and the odd rows."""
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(250)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 10, 11, 30, 60, 120]))] for _ in range(18)]
    docs = []
    for i in range(260):
        w = []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < .6:
                p = list(rng.choice(passages))
                for _ in range(rng.randint(0, 2)):
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
                w += p
            else:
                w += [rng.choice(vocabulary) for _ in range(rng.randint(1, 70))]
        text = " ".join(x.upper() if rng.random() < .1 else x for x in w)
        docs.append((i * 7 - 300, text.replace(" ", "\n", 2)))
    docs += [(10_000 + i, docs[3][1]) for i in range(12)]          # exact copies
    return docs + ODD
