"""Documents to packed training sequences, in four stages.

Each stage is a function of the session, the documents its predecessor kept and the folder
of tables; all but the last return documents with all their columns. Models are fitted on
the rows the operators' contracts leave for training, among the stage's own documents.

Results by case: language ID drops documents without a text or a letter in it; the classifier
scores an empty text by what it knows of all texts; of near copies, exact ones and repeated
rows included, one row stays, NULL ids among them; packing places every row, an empty text as
its end id alone. An id that occurs several times counts once in training and is otherwise
several documents. Very long texts are taken whole. An empty table gives an empty one in every
stage. All columns but id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.llm import language_id, packing, quality_classifier, simhash
from receivables.llm.common import held_out, stored, table

#: A document is kept if its language is known and at least this probable.
LANGUAGE_SCORE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """``docs`` with its columns numbered, so that none clashes with an operator's results,
    the numbered names, and those of the id and the text."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    return docs.toDF(*names), names, own["doc_id"], own["text"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is probable; operator 9."""
    trees = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    plain, names, doc_id, text = _plain(docs)
    found = language_id.predict_language(plain, trees, doc_id, text, keep=tuple(names))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)
    return found.filter(known).select(*names).toDF(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier takes for good ones; operator 2."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = quality_classifier.train(docs, labels)
    plain, names, doc_id, text = _plain(docs)
    found = quality_classifier.score_quality(plain, model, doc_id, text, keep=tuple(names))
    return found.filter("predicted = 1").select(*names).toDF(*docs.columns)


def _with_places(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """As ``_plain``, with ``_row``, by which a row can be told from all others however often it
    is read: its place in its file. What is not read from files is written to some first."""
    plain, names, doc_id, text = _plain(docs)
    own = [F.col(f"`{name}`").alias(plain_name) for name, plain_name in zip(docs.columns, names)]
    place = F.concat_ws(":", F.col("_metadata.row_index"), F.col("_metadata.file_path")).alias("_row")
    try:
        rows = docs.select(*own, place)
    except AnalysisException:
        rows = stored(plain, "numbered").select(*names, place)
    return rows, names, doc_id, text


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that with the smallest id; operator 3.

    Rows are told apart where an id occurs in several of them or there is none: of equal ids one
    row leads, and a row without an id only where no row of its group has one. Groups come from
    narrow rows.
    """
    rows, names, doc_id, text = _with_places(docs)
    grouped = simhash.near_duplicate_groups(rows, "_row", text, keep=(doc_id,))
    first = F.min(F.struct(F.col(doc_id).isNull(), doc_id, "_row")).alias("first")
    leads = grouped.groupBy("component_id").agg(first).select("first._row")
    # The leads grow with the documents, so they are not for broadcasting, however few they are.
    kept = rows.join(leads.hint("merge"), "_row", "left_semi")
    return kept.select(*names).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence; operator 1."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The stages' models and searches are beyond SQL; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
