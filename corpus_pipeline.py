"""The corpus pipeline: rules, near-dedup, secrets, mixing, packing.

``STAGES`` are applied to ``documents`` in order; each stage's rows are written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark.llm import mixing, packing, quality_rules, secrets, simhash
from housemark.llm.tables import table
from housemark.sources.scratch import stage


# Stages keep a row as the struct ``_doc`` beside what their operator adds, so that no added
# column can clash with one of the documents. ``_row`` is the file of a row and its place in it,
# which every scan finds alike, however it cuts the files.
_DOC = "_doc"


def _beside(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias(_DOC), *names)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with an identity; those that are no scan of Parquet files are written first."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")
    try:
        return docs.select(F.struct(*docs.columns).alias(_DOC), place)
    except AnalysisException:
        return _numbered(stage(docs, "documents"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: neither too short nor repetitive, no outliers.

    A null text is too short, as is an empty one. A null language or source is a value of its
    own, and repeated rows share their verdict. An empty table stays empty.
    """
    rows = _beside(docs, "lang", "source", "text")
    counted = quality_rules.with_statistics(rows).drop("text")
    return quality_rules.with_verdict(counted).where("kept").select(f"{_DOC}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints: that of smallest id.

    Of rows with equal ids the first one stays; null ids come last. Null texts count as empty, and
    empty texts as equal.
    """
    rows = _numbered(docs)
    texts = rows.select(f"{_DOC}.doc_id", f"{_DOC}.text", "_row")
    marked = simhash.with_fingerprints(texts).drop("text")
    classes = simhash.near_duplicates(stage(marked, "marked"))
    # Folded before the shuffle: a component may hold a third of all documents.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    best = classes.groupBy("component").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(best, "_row", "left_semi").select(f"{_DOC}.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of the text masked and ``n_chars`` counted anew.

    Null texts stay null and empty ones empty, with the ``n_chars`` that they had; repeated rows
    are masked alike.
    """
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias(_DOC)
    masked = secrets.with_spans(docs.select(rest, "text"), mask=True)
    chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    own = F.col(f"{_DOC}.n_chars")
    changed = {
        "text": F.col("text"),
        "n_chars": F.when(F.size("secrets") > 0, chars).otherwise(own).alias("n_chars"),
    }
    return masked.select(*(changed.get(c, F.col(f"{_DOC}.{c}")) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, none included.

    A null source is one of its own. Null and empty texts have no words but take part; a source
    without any words gives no document. Repeated rows are documents of their own.
    """
    rows = _numbered(docs)
    texts = rows.select(f"{_DOC}.doc_id", f"{_DOC}.source", f"{_DOC}.text", "_row")
    sized = stage(mixing.measured(texts).drop("text"), "sized")
    taken = mixing.with_copies(sized).where("copies > 0").select("_row", "copies")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.join(taken, "_row").withColumn("_copy", copies).select(f"{_DOC}.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, inferred automata and subword ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
