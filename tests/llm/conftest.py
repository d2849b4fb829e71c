import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, h long, sig binary, v array<double>, label int"


def sentence(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, ties, and columns with clashing names."""
    near = sentence(7, 120)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, sentence(1, 30_000), "b"), (5, sentence(2, 80), "b"), (5, sentence(2, 80), "b"), (6, sentence(3, 60), None),
        (None, sentence(4, 70), "c"), (7, sentence(2, 80), "c"), (8, near, "c"), (9, near + " tail", "a"), (10, "one two", "a"), (11, "one two", "b"), (5, sentence(5, 50), "a"),
        (12, "a" * 5000, "c"), (13, "été naïve ça 日本語 😀 " * 40, "b"), (14, sentence(8, 30) + "\n" + sentence(9, 60), "b"), (15, sentence(10, 30) + "\n" + sentence(9, 60), None),
    ]
    return spark.createDataFrame([(d, t, None, s, None if t is None else len(t), 3, None, 4, None, None, 1) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
