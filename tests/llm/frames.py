"""Small awkward tables that every training-data operator must survive."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    words = " ".join(f"w{i}" for i in range(40))
    return spark.createDataFrame(
        [
            (1, "", "en", "a", 0),
            (2, None, None, None, None),
            (3, words, "en", "a", 1),
            (4, words + " x", "en", "b", 1),
            (4, words + " x", "en", "b", 1),
            (5, words.upper(), "en", "b", 1),
            (None, words, "de", "b", 1),
            (6, "one two", "fr", None, 7),
            (7, "ONE\ttwo", "fr", None, 7),
            (8, "long " * 30_000, "en", "a", 150_000),
            (9, "x" * 20_000, "en", "a", None),
            (10, "\n\n \n", "en", "a", 4),
            (11, "a<|endoftext|>b é 漢字 \u0085   'll", "en", "a", 9),
        ],
        DOCS,
    )


def stored(df, path):
    """The table as a file, with extra columns whose names the operators use themselves."""
    for name in ("kept", "_digest", "_text", "node", "score", "part", "n_tokens", "block", "keys"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))
