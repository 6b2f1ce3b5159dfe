"""File corpora, eval sets, snapshots and fetched pages as DataFrames."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from urllib import request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators.graph import TABLES, Graph


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file_name, stem, body): a row per file, read whole."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    name = F.col("_metadata.file_name")
    return df.select(name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("body"))


def article_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The .md files but for README.md; with a limit, the first ones by name."""
    df = whole_files(spark, path, "*.md").filter(F.col("file_name") != "README.md")
    return df if limit is None else df.orderBy("file_name").limit(limit)


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, body, sidecar): .txt files with the .tt.txt file of the same stem, "" where there is none."""
    files = whole_files(spark, path, "*.txt")
    side = F.col("file_name").endswith(".tt.txt")
    sidecars = files.filter(side).select(F.regexp_replace("file_name", r"\.tt\.txt$", "").alias("stem"), F.col("body").alias("sidecar"))
    return files.filter(~side).join(sidecars, "stem", "left").select("stem", "body", F.coalesce("sidecar", F.lit("")).alias("sidecar"))


def catalogue(spark: SparkSession, entries: Iterable[dict] | str) -> DataFrame:
    """(url, che_do, ngay_hieu_luc, stem) of entries, or of a JSON file of them."""
    schema = "url string, che_do array<string>, ngay_hieu_luc string"
    df = spark.read.json(entries, schema=schema, multiLine=True) if isinstance(entries, str) else spark.createDataFrame([(e["url"], e.get("che_do", []), e.get("ngay_hieu_luc")) for e in entries], schema)
    return df.withColumn("stem", text.url_slug(F.col("url")))


def catalogued(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their files, and the entries that have none (listed, not failed)."""
    return entries.join(files, "stem"), entries.join(files.select("stem"), "stem", "left_anti")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """An eval set {"questions": [...]}: a row per question, with its place at."""
    return spark.read.json(path, multiLine=True).select(F.posexplode("questions").alias("at", "q")).select("at", "q.*")


# fetching
class NotFound(Exception):
    """A page that will never be there; not tried again."""


def fetch_with_retry(fetch: Callable[[str], tuple[str, str]], url: str, tries: int = 3, pause: float = 2.0) -> tuple[str, str]:
    """fetch(url), again after a growing pause on any error but NotFound."""
    for n in range(1, tries + 1):
        try:
            return fetch(url)
        except NotFound:
            raise
        except Exception:
            if n == tries:
                raise
            time.sleep(pause * n)
    raise AssertionError


def fetch_pages(entries: DataFrame, fetch: Callable[[str], tuple[str, str]], tries: int = 3, pause: float = 2.0) -> DataFrame:
    """(stem, url, body, sidecar, error) for each entry; an item's error doesn't stop the others. fetch is
    given (a browser, a client, a stub) and returns the page's text and its metadata's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for stem, url in zip(b["stem"], b["url"], strict=True):
                try:
                    rows.append((stem, url, *fetch_with_retry(fetch, url, tries, pause), None))
                except Exception as e:
                    rows.append((stem, url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["stem", "url", "body", "sidecar", "error"])

    return entries.select("stem", "url").mapInPandas(run, "stem string, url string, body string, sidecar string, error string")


def write_pages(fetched: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fetched pages as a table of records, the sink of a crawl."""
    fetched.filter("error IS NULL").select("stem", "body", "sidecar").write.mode(mode).parquet(path)


def fetch_source(name: str, fetch: Callable[[str], tuple[str, str]], tries: int = 3, pause: float = 2.0) -> type:
    """A data source of fetched pages around a given fetch: spark.dataSource.register(fetch_source("pages", fetch)), then
    spark.read.format("pages").option("urls", "one a line").load() has the columns of fetch_pages. Each url is a
    partition, so that a page that fails or hangs holds up no other."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema = "stem string, url string, body string, sidecar string, error string"

    class Reader(DataSourceReader):
        def __init__(self, urls: list[str]) -> None:
            self.urls = urls

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(u) for u in self.urls]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            url = partition.value
            stem = url.rstrip("/").rpartition("/")[2].partition("--")[0][:100]
            try:
                yield (stem, url, *fetch_with_retry(fetch, url, tries, pause), None)
            except Exception as e:
                yield (stem, url, None, None, f"{type(e).__name__}: {e}")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader([u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()])

    return Source


def write_page_files(fetched: DataFrame, path: str) -> DataFrame:
    """Fetched pages as two files each, stem.txt and stem.tt.txt, which document_files reads back; path is a folder that
    all executors reach (a local path or a uri). (stem, url, error) of every page; files are written as the
    result is read, and writing one again replaces it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for b in batches:
            for stem, body, sidecar, error in zip(b["stem"], b["body"], b["sidecar"], b["error"], strict=True):
                if error is None:
                    for end, said in ((".txt", body), (".tt.txt", sidecar)):
                        with where.open_output_stream(f"{folder}/{stem}{end}") as out:
                            out.write((said or "").encode("utf-8"))
            yield b[["stem", "url", "error"]]

    return fetched.mapInPandas(run, "stem string, url string, error string")


def search(keywords: DataFrame, find: Callable[[str, int, str], list[dict]], most: int = 5, search_in: str = "title") -> DataFrame:
    """(keyword, title, url, trang_thai, ngay_ban_hanh, ngay_hieu_luc): what a given portal search finds. Document
    numbers are searched as numbers."""
    if search_in not in ("title", "number", "content"):
        raise ValueError("search_in is title, number or content")
    asked = keywords.select("keyword", F.when(text.looks_like_so_hieu(F.col("keyword")), "number").otherwise(search_in).alias("where"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, h.get("title"), h.get("url"), h.get("text", "")) for k, w in zip(b["keyword"], b["where"], strict=True) for h in find(k, most, w)[:most]]
            yield pd.DataFrame(rows, columns=["keyword", "title", "url", "item"])

    found = asked.mapInPandas(run, "keyword string, title string, url string, item string")
    return found.select("keyword", "title", "url", text.hit_metadata(F.col("item")).alias("m")).select("keyword", "title", "url", "m.*")


def http_generator(url: str, model: str, timeout: float = 120.0, options: dict | None = None) -> Callable[[], Callable[[str], str]]:
    """A generator for retrieve.generate: posts {model, prompt, stream: false[, options]} and returns "response"."""

    def make() -> Callable[[str], str]:
        def ask(prompt: str) -> str:
            body = {"model": model, "prompt": prompt, "stream": False} | ({"options": options} if options else {})
            r = request.Request(f"{url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with request.urlopen(r, timeout=timeout) as answer:
                return json.loads(answer.read())["response"]

        return ask

    return make


# snapshots
def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.sc().hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def replace(df: DataFrame, path: str) -> None:
    """Writes df to path, which df may be read from: beside it first, then in its place."""
    df.write.mode("overwrite").parquet(f"{path}.new")
    settle(df.sparkSession, path)


def settle(spark: SparkSession, path: str) -> None:
    """Finishes a replace that was cut off between its two steps."""
    fs, where = _fs(spark, path)
    new = _fs(spark, f"{path}.new")[1]
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS")):
        fs.delete(where, True)
        fs.rename(new, where)


def save_graph(graph: Graph, path: str, keep: int = 2) -> None:
    """A new snapshot of all tables. It becomes the current one by its marker, written last; of the older ones the last
    keep - 1 stay, for those who still read them."""
    spark = next(iter(graph.values())).sparkSession
    stamp = f"{path}/snapshot-{time.time_ns()}"
    for name, df in graph.items():
        df.write.parquet(f"{stamp}/{name}")
    spark.createDataFrame([(stamp,)], "stamp string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    fs, where = _fs(spark, path)
    held = sorted(str(f.getPath()) for f in fs.listStatus(where) if f.getPath().getName().startswith("snapshot-"))
    for old in held[: max(len(held) - keep, 0)]:
        delete(spark, old)


def load_graph(spark: SparkSession, path: str) -> Graph:
    stamp = spark.read.parquet(f"{path}/current").agg(F.max("stamp")).first()[0]
    return {name: spark.read.schema(schema).parquet(f"{stamp}/{name}") for name, (schema, _) in TABLES.items()}


def save_delta(graph: Graph, path: str, batch: int) -> None:
    """What one batch wrote; the same batch again replaces it."""
    for name, df in graph.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def load_deltas(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """All deltas, with batch; None where there is none."""
    if not exists(spark, path):
        return None
    return {name: spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}") for name, (schema, _) in TABLES.items()}


VECTORS = "vec_id string, doc_id string, so_dieu int, document string, embedding array<float>"


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with new (with seq) by vec_id; the last one written wins."""
    both = vectors.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    return both.groupBy("vec_id").agg(F.max_by(F.struct(*[c for c in vectors.columns if c != "vec_id"]), "seq").alias("v")).select("vec_id", "v.*")


def vector_texts(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(article_id, full_text) of ids (article_id) that are there; an empty text is a text."""
    return vectors.select(F.col("vec_id").alias("article_id"), F.col("document").alias("full_text")).join(ids, "article_id", "left_semi")


def without_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id"), "vec_id", "left_anti")
