"""Where texts come from: a registry of public-domain works, text files, and tables."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_boilerplate

#: Fixed values: (slug, number, title, author, bundled) of each collection.
COLLECTIONS = {
    "novels": (
        ("moby-dick", 2701, "Moby-Dick", "Melville", True),
        ("frankenstein", 84, "Frankenstein", "Shelley", False),
        ("pride-and-prejudice", 1342, "Pride and Prejudice", "Austen", False),
        ("middlemarch", 145, "Middlemarch", "Eliot", False),
        ("war-and-peace", 2600, "War and Peace", "Tolstoy", False),
        ("monte-cristo", 1184, "The Count of Monte Cristo", "Dumas", False),
    ),
    "expository": (
        ("origin-of-species", 1228, "On the Origin of Species", "Darwin", False),
        ("voyage-of-the-beagle", 944, "The Voyage of the Beagle", "Darwin", False),
        ("descent-of-man", 2300, "The Descent of Man", "Darwin", False),
        ("wealth-of-nations", 3300, "The Wealth of Nations", "Smith", False),
        ("leviathan", 3207, "Leviathan", "Hobbes", False),
        ("republic", 1497, "The Republic", "Plato", False),
        ("meditations", 2680, "Meditations", "Aurelius", False),
        ("beyond-good-and-evil", 4363, "Beyond Good and Evil", "Nietzsche", False),
        ("problems-of-philosophy", 5827, "The Problems of Philosophy", "Russell", False),
    ),
}
SCHEMA = "ord int, slug string, gutenberg_id int, title string, author string, bundled boolean, collection string, filename string, url string"


def works(spark: SparkSession, collection: str = "novels") -> DataFrame:
    if collection not in COLLECTIONS:
        raise KeyError(f"unknown collection {collection!r}; one of {', '.join(COLLECTIONS)}")
    rows = [(k, *w, collection, f"{w[0]}.txt", f"https://www.gutenberg.org/cache/epub/{w[1]}/pg{w[1]}.txt") for k, w in enumerate(COLLECTIONS[collection])]
    return spark.createDataFrame(rows, SCHEMA)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the text files in a folder of any store; a missing folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in names], "filename string")


def available(spark: SparkSession, folder: str, collection: str = "novels") -> DataFrame:
    return works(spark, collection).join(_files(spark, folder), "filename", "left_semi").orderBy("ord")


def missing(spark: SparkSession, folder: str, collection: str = "novels") -> DataFrame:
    return works(spark, collection).join(_files(spark, folder), "filename", "left_anti").orderBy("ord")


def fetch(spark: SparkSession, folder: str, collection: str = "novels", timeout: int = 60, opener=urllib.request.urlopen) -> list[str]:
    """Download what is missing into a local folder; a file appears whole or not at all. Returns the slugs fetched."""
    os.makedirs(folder, exist_ok=True)
    got = []
    for w in missing(spark, folder, collection).collect():
        target = os.path.join(folder, w["filename"])
        with opener(w["url"], timeout=timeout) as r, open(f"{target}.part", "wb") as f:
            f.write(r.read())
        os.replace(f"{target}.part", target)
        got.append(w["slug"])
    return got


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, text, path): whole files in path order, bytes that are no UTF-8 replaced, boilerplate stripped.

    Ids come from a sort of the paths, which is small: a row a file.
    """
    files = spark.read.format("binaryFile").load(paths)
    order = files.select("path").withColumn("doc_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", strip_boilerplate(text).alias("text")).join(order, "path").select("doc_id", "text", "path")
