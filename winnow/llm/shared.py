"""Text rules, measured joins and connected components shared by the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import materialise as store
from winnow.session import release as discard

WHITE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000
MARK_BITS = 1 << 26
BITS_PER_KEY = 32


def word_count(text: str | Column) -> Column:
    """Number of words of a text as long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, bytes_per_row: int = 64) -> DataFrame:
    """Mark a stored frame for broadcast when its counted rows are few; beyond that Spark shuffles both sides."""
    limit = BROADCAST_ROWS * 64 // bytes_per_row
    return F.broadcast(df) if df.count() <= limit else df


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, late: str | None = None, max_bits: int = MARK_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of a frame whose `key` may be among `keys`, and those whose key is not, so that only the first need a join.

    `key` is a hash (long) and `keys` a frame of one column of such hashes. A bitmap that every executor gets, of 32
    bits a key and at most 8 MB by default, tells the rows apart: no key is missed, and some others are taken for one,
    more as it fills up. Null keys are not among the keys. Both frames read `df`.
    What is computed from the column `late` runs on the rows of one side only: filters on it would else be pushed below
    the test and run on all rows, twice.
    """
    bits = min(max_bits, BITS_PER_KEY * max(1, keys.count()))
    spot = lambda hashed: F.pmod(hashed, F.lit(bits).cast("long")) + 1
    places = keys.select(spot(F.col(keys.columns[0])).alias("place")).dropna()
    paged = places.select(F.bitmap_bucket_number("place").alias("_page"), F.bitmap_bit_position("place").alias("at")).repartition("_page")
    pages = store(paged.groupBy("_page").agg(F.bitmap_construct_agg("at").alias("_bits")), "key-bits")
    placed = df.withColumn("_place", spot(key)).withColumn("_page", F.bitmap_bucket_number("_place"))
    found = placed.join(F.broadcast(pages), "_page", "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))

    def side(test: Column) -> DataFrame:
        rows = found.filter(test)
        return (rows.withColumn(late, F.when(test, F.col(late))) if late else rows).select(*df.columns)

    return side(held), side(~held)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's linked group, for links between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Alternates large-star and small-star steps: each is one aggregation and one join on a node, so hubs are summed
    before the shuffle and split by the skew join. Every step is stored in the shared folder, and it ends when a step
    changes no edge. Self loops and repeated edges are allowed; null ends are not links.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    links = store(links.filter("u <> v").distinct(), "links")
    everything = store(edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).dropna().distinct(), "nodes")
    while True:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.filter("u <> v").distinct(), "links")
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = store(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        same = small.count() == links.count() and small.join(links, ["u", "v"], "left_anti").isEmpty()
        discard(links)
        discard(large)
        links = small
        if same:
            break
    found = everything.join(links.withColumnRenamed("u", "node"), "node", "left")
    return found.select("node", F.coalesce("v", "node").alias("component"))


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a mounted folder of files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file:{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bytes(df: DataFrame, path: str, separator: bytes, value: str = "value") -> None:
    """Write the binary column of a frame as files: the values of a partition in order, each followed by `separator`.

    Spark's text writer puts bytes down unchanged, so the files go to any store and a lost task leaves no half file.
    """
    lines = df.select(F.col(value).cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that `write_bytes` left."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
