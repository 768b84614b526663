"""Pages of a wiki from recorded answers of its API: listings, contents, categories.

Answers are JSON; unknown keys are ignored. A Python data source reads recorded files, one
partition a file, and leaves out what a title range excludes before contents are decoded.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANSWER = (
    "continue map<string,string>, error struct<code:string,info:string,lag:double>, query struct<pages:array<struct<title:string,missing:boolean,"
    "revisions:array<struct<slots:struct<main:struct<content:string>>>>,categories:array<struct<title:string>>>>>"
)
PAGE = "title string, missing boolean, content string, categories array<string>"
#: Titles that one request may list.
BATCH = 50


def batch_size(asked: int) -> int:
    """Titles of a request; what is out of bounds counts as the most."""
    return asked if 0 < asked <= BATCH else BATCH


def decoded(answers: DataFrame, body: str = "body") -> DataFrame:
    """Rows with `answer`, the body by ANSWER; null where it is no JSON."""
    return answers.withColumn("answer", F.from_json(F.col(body), ANSWER))


def pages_of(answers: DataFrame, body: str = "body") -> DataFrame:
    """One row per page of the answers; content is null without revisions, and `problem` says why."""
    each = decoded(answers, body).select(F.explode("answer.query.pages").alias("p"))
    rows = each.select(F.col("p.title").alias("title"), F.coalesce("p.missing", F.lit(False)).alias("missing"), F.get("p.revisions", 0)["slots"]["main"]["content"].alias("content"), F.coalesce("p.categories.title", F.array().cast("array<string>")).alias("categories"))
    return rows.withColumn("problem", F.when(F.col("missing"), "missing").when(F.col("content").isNull(), "no revisions"))


def lookup(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """(title) rows with their page's content and categories; a title without a page has a `problem`."""
    found = titles.join(pages.withColumn("met", F.lit(True)), "title", "left")
    return found.withColumn("problem", F.when(F.col("met").isNull(), "missing").otherwise(F.col("problem"))).drop("met")


def batches(titles: DataFrame, asked: int = BATCH) -> DataFrame:
    """(seq, title) rows as the requests for them: batch, titles in order."""
    size = batch_size(asked)
    return titles.groupBy(F.floor(F.col("seq") / F.lit(size)).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("titles"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_File(str(p)) for p in sorted(Path(self.options["path"]).glob("*.json"))]

    def read(self, partition):
        first, title = self.options.get("from_title", ""), self.options.get("title", "")
        for line in Path(partition.value).read_text(encoding="utf-8").splitlines():
            if not line.strip():
                continue
            for page in ((json.loads(line).get("query") or {}).get("pages")) or []:
                name = page.get("title")
                if name is None or name < first or (title and name != title):
                    continue
                held = page.get("revisions") or [{}]
                content = ((held[0].get("slots") or {}).get("main") or {}).get("content")
                yield name, bool(page.get("missing")), content, [c["title"] for c in page.get("categories") or []]


class RecordedPages(DataSource):
    """`spark.read.format("recorded_pages")`: files *.json below `path` (on a folder that all
    executors mount), an answer a line; options `title` and `from_title`."""

    @classmethod
    def name(cls):
        return "recorded_pages"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _Reader(self.options)


def read_recorded(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").options(path=path, **options).load()
