import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "té", "zo") for b in ("n", "st", "ra", "ven", "ló", "x")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", ",", ".", ".\n")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, repeats in one text, odd white space, null, empty and very long ones."""
    r = random.Random(5)
    base = [prose(r, n) for n in (5, 19, 20, 21, 60, 200, 400, 400, 3000)]
    passage = prose(r, 40)
    near = base[5].split(" ")
    near[50] = "changed"
    out = [*base, base[5], base[5], " ".join(near), passage + " " + base[4], base[3] + "\t\x0b" + passage + "\r\n" + passage, None, "", "  \n\t ", "x", "X x", "a b c " * 30, "same " * 50, base[6].upper(), "\n\n".join([base[2]] * 3), base[4] + "\n" + base[4], "İKſ ss " * 9]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(10 * k + 3, t, ("en", "fr", None)[k % 3], f"src{k % 2}" if k % 7 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
