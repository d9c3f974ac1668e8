import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]])."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:3] or ("en",)), *(r[3:4] or ("s",)),
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


def hostile_rows():
    """Nulls in every column, empty, blank and long texts, control characters, ties and
    repeated rows."""
    long = " ".join(f"word{i % 977} and" for i in range(20_000))
    words = "one two three four five six seven eight nine ten " * 6
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "é ü ñ \x00 \x1f x"),
            (6, words), (6, words), (7, words, None, None), (None, words), (None, None, None),
            (8, long), (8, "another text of the same id"), (9, "x" * 70_000),
            (10, "漢字 かな 한글 слово λόγος"), (11, "🙂 🙂🙂 ﷽"), (12, "1 2 3 ... !!!"),
            (-5, "negative id with a few plain words"), (13, words.upper(), "xx", "")]
