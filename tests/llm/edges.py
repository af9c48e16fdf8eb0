"""A small table of documents with everything that may go wrong in one."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(15_000))
PROSE = "The river rose in the night and nobody had seen it before. They went on, as the road was good."
ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, PROSE + " Once more.", "en", "b", 5),
    (4, LONG, "de", "a", len(LONG)),
    (5, PROSE, "en", "a", 10),
    (5, PROSE, "en", "a", 10),
    (6, " \t\r\n\x0b\x0c ", "fr", "c", 6),
    (7, "\x00 \x85   é É İ ß 漢字 \U0001f600", "xx", "c", 3),
    (8, "###\n###\n\n a | b\r\n a | b", None, "c", 3),
    (8, "another text of the same id", "en", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = "fp root u v node n first hash words chunk start end m k win label scores p rate _id _repeated marks r_id bad_id text_hash html n_removed_words".split()


def documents(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES if clashes else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def nothing(spark, clashes=True):
    return documents(spark, [], clashes)
