import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the awkward cases: nulls, empty and repeated rows, extra columns with results' names."""
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words[:120])
    rows = [
        (1, long, "en", "a", 1),
        (2, long + " tail of its own", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "en", "b", 0),
        (6, " ".join(words[200:260]), "en", "c", 9),
        (6, " ".join(words[200:260]), "en", "c", 9),
        (7, "x " * 300, "en", "c", 9),
        (8, "Ünïcode wörds  and one " + " ".join(words[205:240]), "fr", "d", 3),
        (None, "a row without an id " + long, "en", None, 3),
        (9, " ".join(words), "en", "a", 3),
    ]
    return spark.createDataFrame([(*r, "was here") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
