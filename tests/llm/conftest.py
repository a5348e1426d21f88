import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, quality string, score string, spans string"
LONG = " ".join(f"word{k % 977} other{k % 13}." for k in range(9000))


def rows():
    prose = [f"The {a} house stands on the {b} hill and waits for the {c} night to come over it again." for a in ("red", "old", "tall") for b in ("green", "far") for c in ("long", "cold", "dark")]
    texts = [None, "", "  \n\t ", "one", "Zwölf Boxkämpfer jagen Viktor.\nZwölf Boxkämpfer jagen Viktor.\n", LONG, prose[0] + " " + prose[1], prose[0] + " " + prose[1], *prose]
    out = [(k, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t), "q", "x", "y") for k, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, prose[2], "en", None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that tie, columns with clashing names."""
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
