"""A small table of awkward documents, and the given ones as Python lists."""

import pyarrow.parquet as pq

#: Columns beside those of documents bear names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, line string, n int, doc string, gone string, digest string, size string, c string, bucket string, keep_id string, kept string, n_lines int, _id long"
P = "the quick brown fox jumps over the lazy dog and runs away from the very large bear in the wood "
TEXTS = [
    (1, P * 3, "en", "a"),
    (2, P * 3, "en", "a"),
    (2, P * 3, "en", "a"),  # a repeated row
    (3, "  " + P * 3, "en", None),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \n\t ", "en", "b"),
    (None, "a document without an id\nsecond line of it", "en", "b"),
    (7, "word", "en", "Z"),
    (7, "another text under the same id\nand a line", "en", "é"),
    (8, P.upper() * 3, "en", "a"),
    (9, "x" * 60000 + " " + "y z " * 20000, "de", "c"),
    (10, "ÄÖÜ straße ñandú 漢字かな " * 5, "de", "c"),
    (11, "first line here that is long enough\nsecond line here that is long enough\n\nfirst line here that is long enough", "en", "c"),
    (12, "first line here that is long enough!\nthird", "en", "c"),
    (13, "a\x00b \x1f|>#<*$%&", "en", "d"),
]


def awkward(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 0, "l", 1, "d", "g", "x", "s", "c", "b", "k", "e", 3, 1) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()
