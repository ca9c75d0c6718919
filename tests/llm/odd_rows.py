"""Tables with everything that may go wrong in them."""

LONG = "lorem ipsum dolor sit amet " * 8000  # 40,000 words
WORD = "x" * 50_000

# id, text
DOCUMENTS = [
    (1, "The cat sat on the mat. " * 5),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, WORD),
    (7, "The cat sat on the mat. " * 5),
    (8, "a"),
    (9, "ünï çödé 日本語 \U0001f600   <|endoftext|> \x00 a b"),
    (10, "1234 5678 ... !!!"),
    (None, "no id here"),
    (11, "repeated row"),
    (11, "repeated row"),
]

CLASHING = {
    "fp": "1",
    "task": "2",
    "rank": "3",
    "count": "4",
    "score": "5",
    "_id": "6",
    "_text": "7",
    "_class": "8",
    "n_words": "9",
    "votes": "10",
    "length": "11",
    "start": "12",
    "block": "13",
    "q": "14",
    "row": "15",
    "id": "16",
    "payload": "17",
    "address": "18",
    "kept": "19",
    "lang_pred": "20",
    "component_id": "21",
    "_root": "22",
    "_key_hash": "23",
    "value": "24",
}


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in df.columns})


def documents(spark, rows=DOCUMENTS):
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def tuples(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
