"""Sources and sinks: explicit schemas in, atomic publication out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from heddle.session import observed, scratch

SKIPPED = frozenset({"script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "form", "template"})
BLOCKS = frozenset({"p", "div", "section", "article", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "figure", "main"})


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; never infers a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_to_text(html: str | None) -> str | None:
    """Visible text of a page, a line per block; null stays null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def pages_to_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of HTML pages, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [html_to_text(x) for x in b[html]]})

    return df.select(key, html).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, digest) of files as they are, for provenance."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key of both tables, by a partial aggregate; a tie goes to ``new``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in both.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("__r")
    return both.groupBy(*key).agg(best).select(*[F.col(k) if k in key else F.col("__r")[k].alias(k) for k in old.columns])


def cached(df: DataFrame, cache: DataFrame | None, key: str, digest: str, work) -> DataFrame:
    """Results of ``work`` for rows whose (key, digest) the cache lacks, and the cache's for the others."""
    if cache is None:
        return work(df)
    known = cache.select(key, digest).distinct()
    return cache.join(df.select(key, digest).distinct(), [key, digest], "left_semi").unionByName(work(df.join(known, [key, digest], "left_anti")))


def write_snapshot(df: DataFrame, folder: str) -> str:
    """Write a version, check its columns and rows, then point to it.

    The pointer is a file that another takes the place of in one rename, so a
    reader finds the old version or the new one, whole, at any time.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    rows, seen = observed(df, n=F.count(F.lit(1)))
    rows.write.parquet(f"{folder}/versions/{version}")
    made = spark.read.parquet(f"{folder}/versions/{version}")
    if made.schema.names != df.schema.names or made.count() != seen()["n"]:
        raise RuntimeError("the snapshot is not what was written")
    publish(spark, f"{folder}/ACTIVE", version)
    return version


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one at ``path``, in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = final.getFileSystem(conf).create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(conf).getUri(), conf)
    context.rename(draft, final, how)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    version = spark.read.text(f"{folder}/ACTIVE").first()[0]
    return spark.read.parquet(f"{folder}/versions/{version}")


def split_mapped(df: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the dimension has, and those for the dead-letter table."""
    known = dimension.select(key).distinct()
    return df.join(known, key, "left_semi"), df.join(known, key, "left_anti")


def to_markdown(df: DataFrame, limit: int = 100) -> str:
    """A report table for people: at most ``limit`` rows; a last line says if there are more."""
    rows = df.limit(limit + 1).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    more = [f"More than {limit} rows."] if len(rows) > limit else []
    return "\n".join([line(df.columns), "|" + " --- |" * len(df.columns), *[line(r) for r in rows[:limit]], *more])


def running_pages(df: DataFrame, group: str, order: str, pages: str) -> DataFrame:
    """First page number of each file of a group when files are read one after the other."""
    before = F.sum(pages).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("first_page", F.coalesce(before, F.lit(0)) + 1)


def overlay(pages: DataFrame, verified: DataFrame, key: list[str], text: str) -> DataFrame:
    """Text that a person has verified takes the place of what was read; ``source`` says which it is."""
    v = verified.select(*key, F.col(text).alias("__v"))
    both = pages.join(v, key, "left")
    return both.withColumn("source", F.when(F.col("__v").isNotNull(), "verified").otherwise("read")).withColumn(text, F.coalesce("__v", text)).drop("__v")


def corrected(text: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after find and replace in order, and how many rules found something at their turn."""
    applied = F.lit(0)
    for old, new in rules:
        applied = applied + F.contains(text, F.lit(old)).cast("int")
        text = F.replace(text, F.lit(old), F.lit(new))
    return text, applied
