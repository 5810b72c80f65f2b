import pytest

EXTRA = "grp long, bucket string, key string, n int, node long, comp long, item long, bin long, row string, slot int, shard int, sig string, y int, score double, range long, before long, sketch string, media binary, _id long, _row string, _text string, _lines string, _chunks string, _repeated string, _topic string, _tokens long, _weight string, _source string, n_removed string, n_removed_lines string"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang, source]) as documents, with extra columns of clashing names."""

    def build(*rows, extra=True):
        n_extra = EXTRA.count(",") + 1 if extra else 0
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), *[None] * n_extra) for r in rows]
        return spark.createDataFrame(full, COLUMNS + (", " + EXTRA if extra else ""))

    return build


PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, odd white space."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    base = " ".join(f"b{i}" for i in range(40))
    return [
        (1, None), (2, ""), (3, " \t\n"), (None, "null id text of some words here"), (4, long), (5, base), (6, base), (6, base), (7, base + " tail"), (8, "one two"), (9, "One  TWO"),
        (10, "é x   y 😀 z"), (11, f"start {PASSAGE} end"), (12, f"other {PASSAGE} words"), (13, "a\nb\na\nb\na\nb"), (14, None, None, None), (15, "x" * 200_000), (16, "<|endoftext|> \x1c it's 12"),
    ]
