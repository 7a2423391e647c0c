import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and blank texts, exact and near copies, repeated rows, a null id and clashing extra columns."""
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(30, 120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(6)]
    for i in range(12):
        w = base[5].split()
        w[rng.randrange(len(w))] = "edit"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, ""), (301, "  \n "), (302, None), (303, "one two"), (304, "one two"), (305, "a\nb\nc\nd"), (306, "x\na\nb\nc\nd\ny"), (307, "a\nb\nc"), (None, "no id here at all, five words"), (308, base[1]), (308, base[1]), (309, base[0] + " " + base[2])]
    rows.append((310, prose(rng, 30000)))
    rows = [(i, t, f"score{k}", "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _range string, removed int").repartition(5).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
