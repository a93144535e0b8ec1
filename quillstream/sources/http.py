"""Outcomes of (conditional) fetches as columns; and a fetching data source for machines with a network."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillstream.operators.store import first_rows


def normalize_etag(header: Column) -> Column:
    """Without a weak prefix and the quotes."""
    return F.regexp_replace(F.regexp_replace(header, r"^W/", ""), r"^\"|\"\z", "")


def classify(responses: DataFrame) -> DataFrame:
    """Adds ``ok, unchanged, fetch_error`` to responses (``status, body``; status 0: timed out) and drops bodies that don't count."""
    status = F.col("status")
    ok, same = status.between(200, 299) | (status == 304), status == 304
    error = F.when(status == 0, "Request timeout").when(~ok, F.concat(F.lit("HTTP "), status.cast("string")))
    return responses.select("*", ok.alias("ok"), same.alias("unchanged"), error.alias("fetch_error")).withColumn("body", F.when(F.col("ok") & ~F.col("unchanged"), F.col("body")))


def request_headers(etag: Column, last_modified: Column) -> Column:
    """Conditional headers as a map; those without a value are left out."""
    pairs = F.array_compact(F.array(F.when(etag.isNotNull(), F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v"))), F.when(last_modified.isNotNull(), F.struct(F.lit("If-Modified-Since").alias("k"), last_modified.alias("v")))))
    return F.map_from_entries(pairs)


USER_AGENT = "Mozilla/5.0 (compatible; quillstream)"
#: Bytes of a body that are kept in one row; a longer body counts as an error, or comes in several rows.
MOST_BYTES = 16 << 20
#: Rows of a stored table that one task fetches, and requests that it has under way at once.
PER_TASK, THREADS = 500, 8
READ = 1 << 20


def fetch_list(rows: list[tuple[str, str | None, str | None]]) -> str:
    """The ``urls`` option of a PageSource: url, ETag and Last-Modified of each fetch."""
    return json.dumps([[url, etag, modified] for url, etag, modified in rows])


class PageSource(DataSource):
    """Fetched pages: ``url, status`` (0: timed out or not reached), ``etag, last_modified, body, body_bytes, piece``.

    What to fetch is a stored table, option ``path``: Parquet files with ``url`` and, where there are any, ``etag`` and ``last_modified``. A
    partition names a file, one of its row groups and a range of rows; the rows themselves are read by the task, so the
    driver holds none. As a stream, each batch takes the files that are newer than those before (files have to be put in place whole, and
    none may be given an older time than one already taken); where it stopped is kept in the stream's checkpoint.

    For a few URLs the option ``urls`` takes a ``fetch_list``, or plain URLs, one a line (not as a stream).

    A URL with an ETag or date is asked for conditionally; 304 has no body. A body of more than ``mostbytes`` has status 413, no text
    and its length in ``body_bytes``; with ``pieces`` set to true it comes whole, in rows numbered by ``piece``. Other options: ``timeoutms``,
    ``pertask`` (URLs a task), ``threads`` (requests of a task at once), ``useragent``.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, etag string, last_modified string, body string, body_bytes long, piece int"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[tuple[int, str]]]:
    """The file system of a path and its Parquet files with their times, oldest first; hidden ones are left out."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    every = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    shown = lambda x: x.is_file and x.path.endswith(".parquet") and not any(p[:1] in ("_", ".") for p in x.path[len(root) :].split("/") if p)
    return fs, sorted((x.mtime_ns or 0, x.path) for x in every if shown(x))


class Fetcher:
    """The requests of one task."""

    def __init__(self, options: dict):
        self.path, self.options = options.get("path"), dict(options)
        self.timeout, self.agent = int(options.get("timeoutms", 10_000)) / 1000, options.get("useragent", USER_AGENT)
        self.most, self.pieces = int(options.get("mostbytes", MOST_BYTES)), options.get("pieces", "false").lower() == "true"
        self.threads = int(options.get("threads", THREADS))

    def splits(self, files: list[tuple[int, str]], fs: pyarrow.fs.FileSystem) -> list[InputPartition]:
        """File, row group, first row in it and how many, for each task."""
        each, out = int(self.options.get("pertask", PER_TASK)), []
        for _, name in files:
            with fs.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
                sizes = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
            out += [InputPartition((name, g, a, min(each, n - a))) for g, n in enumerate(sizes) for a in range(0, n, each)]
        return out

    def asked(self, split: tuple[str, int, int, int]) -> Iterator[tuple[str, str | None, str | None]]:
        """The rows of a split; their file's other rows are read past."""
        name, group, first, many = split
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), "")
        with fs.open_input_file(name) as f:
            file = pq.ParquetFile(f)
            wanted = [c for c in ("url", "etag", "last_modified") if c in file.schema_arrow.names]
            at = 0
            for b in file.iter_batches(batch_size=10_000, row_groups=[group], columns=wanted):
                part = b.slice(max(0, first - at), max(0, min(first + many - at, b.num_rows) - max(0, first - at)))
                for r in part.to_pylist() if at < first + many and at + b.num_rows > first else []:
                    if r.get("url"):
                        yield r["url"], r.get("etag"), r.get("last_modified")
                at += b.num_rows

    def fetch(self, ask: tuple[str, str | None, str | None]) -> list[tuple]:
        url, etag, modified = ask
        headers = {"User-Agent": self.agent, "Accept": "text/html,application/xhtml+xml,application/xml"}
        headers |= {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
        try:
            with urlopen(Request(url, headers=headers), timeout=self.timeout) as r:
                known, bodies = (r.headers.get("ETag"), r.headers.get("Last-Modified")), []
                body, text = r.read(self.most + 1), codecs.getincrementaldecoder("utf-8")("replace")
                size = len(body)
                while len(body) > self.most and self.pieces:
                    bodies.append(text.decode(body[: self.most]))
                    more = r.read(self.most + 1 - len(body[self.most :]))
                    body, size = body[self.most :] + more, size + len(more)
                if len(body) > self.most:
                    while more := r.read(READ):
                        size += len(more)
                    return [(url, 413, *known, None, size, 0)]
                bodies.append(text.decode(body, True))
                return [(url, r.status, *known, b, size, i) for i, b in enumerate(bodies)]
        except HTTPError as e:
            return [(url, e.code, e.headers.get("ETag"), e.headers.get("Last-Modified"), None, 0, 0)]
        except (URLError, OSError, ValueError):
            return [(url, 0, None, None, None, 0, 0)]

    def fetch_all(self, asked: Iterator[tuple]) -> Iterator[tuple]:
        """Pages in the order asked for; a task holds those of ``threads`` requests."""
        with ThreadPoolExecutor(self.threads) as pool:
            waiting: list = []
            for ask in asked:
                waiting.append(pool.submit(self.fetch, ask))
                if len(waiting) >= self.threads:
                    yield from waiting.pop(0).result()
            for w in waiting:
                yield from w.result()


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher, given = Fetcher(options), options.get("urls", "")
        self.given = json.loads(given) if given.startswith("[") else [[u, None, None] for u in given.split("\n") if u]
        self.each = int(options.get("pertask", 5))

    def partitions(self) -> list[InputPartition]:
        if self.fetcher.path:
            fs, files = _files(self.fetcher.path)
            return self.fetcher.splits(files, fs)
        return [InputPartition(self.given[i : i + self.each]) for i in range(0, len(self.given), self.each)]

    def read(self, partition: InputPartition):
        asked = self.fetcher.asked(partition.value) if self.fetcher.path else map(tuple, partition.value)
        yield from self.fetcher.fetch_all(asked)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.fetcher = Fetcher(options)
        if not self.fetcher.path:
            raise ValueError("a stream of pages needs the option path")

    def initialOffset(self) -> dict:
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.fetcher.path)[1]
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, files = _files(self.fetcher.path)
        after, until = (start["time"], start["file"]), (end["time"], end["file"])
        return self.fetcher.splits([f for f in files if after < f <= until], fs)

    def read(self, partition: InputPartition):
        yield from self.fetcher.fetch_all(self.fetcher.asked(partition.value))

    def commit(self, end: dict) -> None:
        pass


def fetch_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The pages of a stored table of URLs. Inside a stream's batches the source has to be registered before the stream starts, as they run in a clone of the session."""
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").options(path=path, **options).load()


def next_validators(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """``url, etag, last_modified`` for the next fetch of each known URL.

    A page that came brings its own (null if the server sent none); one that didn't change keeps what it had but for what the server sent anew;
    after an error, and where nothing was fetched, all stays. Of a URL in several rows the first piece counts.
    """
    got = first_rows(fetched.select("url", "status", F.col("etag").alias("__etag"), F.col("last_modified").alias("__modified"), "piece"), ["url"], "piece", "status").drop("piece")
    came, same = F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.coalesce(F.col("status") == 304, F.lit(False))
    pick = lambda new, old: F.when(came, F.col(new)).when(same, F.coalesce(new, old)).otherwise(F.col(old)).alias(old)
    return known.join(got, "url", "left").select("url", pick("__etag", "etag"), pick("__modified", "last_modified"))
