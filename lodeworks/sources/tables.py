"""Readers and writers: parquet tables, tab- and comma-separated text, HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LISTENING_LOG = strings("userid", "ts", "artid", "artname", "traid", "traname")
ADS = strings("links", "titles", "timestamps", "locations", "descriptions", "prices")
SONGS = T.StructType([T.StructField("idx", T.LongType()), T.StructField("song", T.StringType()), T.StructField("song_year", T.IntegerType()), *strings("artist", "genre", "lyrics")])

#: The listening log's table name in the test data.
LOG = "userid_timestamp_artid_artname_traid_traname"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a table for costly work by row: one of fewer splits than cores, such as a single small file, is dealt out first."""
    rows, cores = table(spark, sf_dir, name).select(*columns), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: What stands for null in text written here, where every value is quoted, so that empty strings stay what they are.
NULL = "\\N"
_QUOTES = {"quote": '"', "escape": '"'}


def _written_here(null: str | None) -> dict[str, str]:
    return {} if null is None else {"nullValue": null, "emptyValue": ""}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False, null: str | None = None) -> DataFrame:
    """Tab-separated text with an explicit schema; short rows get nulls, as do empty values unless null names another mark."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, mode="PERMISSIVE", enforceSchema=True, **_QUOTES, **_written_here(null))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", null: str | None = None) -> DataFrame:
    """Separated text with header whose quoted fields may span lines (lyrics)."""
    return spark.read.csv(path, sep=sep, schema=schema, header=True, multiLine=True, **_QUOTES, **_written_here(null))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    _write_text(df, path, "\t", header)


def write_csv(df: DataFrame, path: str) -> None:
    _write_text(df, path, ",", True)


def _write_text(df: DataFrame, path: str, sep: str, header: bool) -> None:
    options = {"quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").csv(path, sep=sep, header=header, **_QUOTES, **_written_here(NULL), **options)


def with_file_order(rows: DataFrame) -> DataFrame:
    """A table just read from parquet files with __file and __row: the order in which its rows are stored."""
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


class _Fields(HTMLParser):
    """Collects, for each item element within the scope, the first text or attribute of the named fields."""

    def __init__(self, item: tuple[str, str], fields: dict[str, tuple[str, str, str | None]], scope: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.item, self.fields, self.rows, self.open = item, fields, [], None
        self.scope, self.within, self.depth = scope, None, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        classes = (have.get("class") or "").split()
        if self.scope is not None:
            if self.within is None and have.get("id") == self.scope:
                self.within = tag
            if tag == self.within:
                self.depth += 1
            if self.within is None:
                return
        if tag == self.item[0] and self.item[1] in classes:
            self.rows.append(dict.fromkeys(self.fields))
        self.open = None
        for name, (wanted, kind, attribute) in self.fields.items():
            if self.rows and tag == wanted and kind in classes and self.rows[-1][name] is None:
                if attribute:
                    self.rows[-1][name] = have.get(attribute)
                else:
                    self.open = name

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            self.rows[-1][self.open] = data.strip()
            self.open = None

    def handle_endtag(self, tag: str) -> None:
        self.open = None
        if tag == self.within:
            self.depth -= 1
            if not self.depth:
                self.within = None


#: Where an ads page holds each field (tag, class, attribute or None for the text).
AD_FIELDS = {
    "links": ("a", "cta", "href"),
    "titles": ("a", "cta", None),
    "timestamps": ("p", "timestamp", None),
    "locations": ("p", "locale", None),
    "descriptions": ("p", "description", None),
    "prices": ("h4", "price", None),
}


def extract_ads(pages: DataFrame, html: str = "html", item: tuple[str, str] = ("div", "item"), scope: str | None = "search-result") -> DataFrame:
    """One row per ad of each page; fields missing in an item are null.

    Only items inside the element whose id is scope are taken (all of the
    page's if scope is None), which leaves out advertisements around it. Fields are taken within their item, so a missing one shifts nothing.
    Null or empty pages give no rows.
    """

    def parse(batches):
        for batch in batches:
            rows = []
            for text in batch["html"].dropna():
                parser = _Fields(item, AD_FIELDS, scope)
                parser.feed(text)
                rows += parser.rows
            yield pd.DataFrame(rows, columns=list(AD_FIELDS), dtype=object)

    return pages.select(F.col(html).alias("html")).mapInPandas(parse, schema=strings(*AD_FIELDS))


def non_empty(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column) != "")
