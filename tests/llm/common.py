"""Small documents with the hard cases: nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, length int, bucket string, rank int, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", 2, "b", 3, "z") for i, t, lang in rows], SCHEMA)


def plain(rows):
    return [(i, t, "en") for i, t in rows]
