"""Tables, words and shared scratch tables used by the operators of this package."""

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from candlewright.session import hadoop_path, shared_folder

# Words are runs of anything but ASCII white space, as bytes.split() sees them.
WORD = "[^\\x20\\x09-\\x0D]+"


# What tells the rows of a table of documents apart: id, and hash of the text. A null id is a key of its own.
ROW = ["doc_of_row", "no_id_of_row", "hash_of_row"]


def row_keys(text="text"):
    """The columns ``ROW``, never null; rows that agree in them have one id and one text."""
    doc = F.col("doc_id").cast("long")
    return [F.coalesce(doc, F.lit(0)).alias(ROW[0]), doc.isNull().alias(ROW[1]),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(ROW[2])]


def doc_of_row():
    """The id, null where there was none, from the columns ``ROW``."""
    return F.when(~F.col(ROW[1]), F.col(ROW[0]))


def quoted(names):
    """Column names that may hold dots, as select() takes them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def let_go():
    """Give memory back that a Python worker no longer needs; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text):
    """Words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_path(spark):
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df):
    """Write ``df`` to a scratch table and return that table.

    It cuts the lineage, survives lost executors, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables):
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        p, fs = hadoop_path(t.sparkSession, t.scratch)
        fs.delete(p, True)
