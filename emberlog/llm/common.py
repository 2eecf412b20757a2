"""Help shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of word rules, ``[\x20\x09-\x0D]``; ``bytes.split()`` cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may go without the setting; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="emberlog-corpus-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation.

    The folder is scratch space; its owner empties it once results are written.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(*names: str) -> list[str]:
    """Column names that no table has: the names given, each with a random end."""
    return [f"{name}_{uuid.uuid4().hex}" for name in names]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def fold(key: Column, modulus: int) -> Column:
    """The fold of a row: crc32 of the key as text."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, label: str, most: dict | int, key: str = "doc_id", seed: int = 7) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each label, by a seeded hash of the key, and each label's count before.

    A label's rows are kept with probability ``most / count``, so nothing is sorted or gathered; null labels are left out.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    kept = F.lit(0.0)
    for value, n in counts.items():
        bound = most if isinstance(most, int) else most.get(value, 0)
        kept = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(kept)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(F.col(label).isNotNull() & (place < kept)), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training, most: dict, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """``text, label`` of a bounded sample of the labelled rows for which ``training`` holds; of a key's labels the largest counts.

    The sampled keys, at most about the sum of ``most``, are broadcast to the scan of the texts.
    """
    rows = labels.where(training(labels[key])).select(labels[key].alias("_key"), labels[label].cast("int").alias("_label"))
    sample, counts = bounded_sample(rows, "_label", most, "_key")
    sample = staged(sample.groupBy("_key").agg(F.max("_label").alias("_label")), "sample")
    joined = docs.select(docs[key].alias("_doc"), docs[text].alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_key"))
    return joined.select(text_of("_text").alias("text"), F.col("_label").alias("label")), counts
