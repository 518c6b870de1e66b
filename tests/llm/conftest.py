import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def passage(seed: int, n: int = 60) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows and a clashing extra column."""
    a, b = passage(1), passage(2)
    near = a.split()
    near[5] = "changed"
    texts = [a, b, a, " ".join(near), None, "", " \n\t", "un", "ça été où", b + "\n" + a, "x" * 3000, passage(3, 2500), "ab " * 400, a + " tail words here", "日本語 テキスト"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4], len(t or ""), 7) for i, t in enumerate(texts)]
    return [*out, (None, passage(9), "en", "s1", 1, None), out[1], out[1], (3, passage(4), "de", "s2", None, 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
