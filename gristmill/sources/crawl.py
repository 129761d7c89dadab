"""Crawl archives and JSON lines as frames, text out of HTML, and the choice of inputs."""
from __future__ import annotations

import gzip
import os
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Rows of an archive that are handed on at once; bytes read at once.
ROWS, BLOCK = 200, 1 << 20


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """JSON lines under ``schema``; lines that are no JSON are left out.

    ``limit`` counts valid rows, the first ones by ``order_by``, which makes them the same
    in every run.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if limit is None:
        return df
    return (df.orderBy(order_by) if order_by else df).limit(limit)


def _stream(path: str):
    """The bytes of a file of any file system that pyarrow knows, unpacked while they are read."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    raw = files.open_input_stream(inner, compression=None, buffer_size=BLOCK)
    return gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw


def records(stream) -> Iterator[tuple[str, str, bytes]]:
    """``(type, address, body)`` of each record of an archive, one after the other by their stated lengths; no more than one record is held."""
    buffer = b""

    def more() -> bool:
        nonlocal buffer
        got = stream.read(BLOCK)
        buffer += got
        return bool(got)

    while True:
        while (at := buffer.find(b"WARC/")) < 0 or (end := buffer.find(b"\r\n\r\n", at)) < 0:
            buffer = buffer[max(0, at) if at >= 0 else max(0, len(buffer) - 4) :]
            if not more():
                return
        head = {}
        for line in buffer[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = int(head.get(b"content-length") or 0)
        while len(buffer) < end + 4 + length and more():
            pass
        yield head.get(b"warc-type", ""), head.get(b"warc-target-uri", ""), buffer[end + 4 : end + 4 + length]
        buffer = buffer[end + 4 + length :]


def paths(path: str, suffixes: tuple[str, ...] = (".warc", ".wet", ".warc.gz", ".wet.gz", ".gz")) -> list[str]:
    """The files under ``path``: itself, or those of the folder with one of the endings, in order."""
    from pyarrow import fs

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    files, inner = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = files.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [path]
    found = files.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(scheme + i.path for i in found if i.type == fs.FileType.File and i.path.endswith(suffixes))


def _read(spark: SparkSession, path: str, pick: Callable[[str, bytes], str | None]) -> DataFrame:
    files = paths(path)

    def run(pdfs):
        for pdf in pdfs:
            for source in pdf["path"]:
                rows = []
                with _stream(source) as stream:
                    for kind, url, body in records(stream):
                        text = pick(kind, body)
                        if text is not None:
                            rows.append((url, text, source))
                        if len(rows) >= ROWS:
                            yield pd.DataFrame(rows, columns=["url", "text", "source"])
                            rows = []
                yield pd.DataFrame(rows, columns=["url", "text", "source"], dtype=object)

    names = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)), "path")
    return names.mapInPandas(run, "url string, text string, source string")


def read_wet(spark: SparkSession, path: str, min_chars: int = 50) -> DataFrame:
    """``url, text, source`` of plain-text records longer than ``min_chars``.

    A file, or every archive of a folder; a task reads a file as a stream, of which it holds
    one record and ``ROWS`` rows. Broken UTF-8 is replaced.
    """
    def pick(kind: str, body: bytes):
        text = body.decode("utf-8", "replace").strip()
        return text if kind == "conversion" and len(text) > min_chars else None

    return _read(spark, path, pick)


def read_warc(spark: SparkSession, path: str, min_chars: int = 50) -> DataFrame:
    """``url, text, source`` of HTML responses, as text, longer than ``min_chars``; read like ``read_wet``."""
    def pick(kind: str, body: bytes):
        page = body.partition(b"\r\n\r\n")[2] or body
        if kind != "response" or b"<html" not in page[:1000].lower():
            return None
        text = visible_text(page.decode("utf-8", "replace"))
        return text if len(text) > min_chars else None

    return _read(spark, path, pick)


class _Visible(HTMLParser):
    """Text outside of scripts, tables, navigation and the like, however these are nested; blocks as lines."""

    HIDDEN = frozenset("script style nav header footer aside form noscript table head template svg".split())
    BLOCKS = frozenset("br p div li h1 h2 h3 h4 h5 h6 tr section article ul ol blockquote pre main".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.open.append(tag)
        elif tag in self.BLOCKS and not self.open:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in self.BLOCKS and not self.open:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            if tag in self.open:  # an end closes what was left open inside of it, too
                while self.open.pop() != tag:
                    pass
        elif tag in self.BLOCKS and not self.open:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.open:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    """Main text of a page; '' for none. A hidden part that is never closed hides the rest."""
    if not html:
        return ""
    p = _Visible()
    p.feed(html)
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def html_text(html: Column) -> Column:
    """``visible_text`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(visible_text)

    return run(T.text_of(html))


def sanitized(c: Column) -> Column:
    """Text without what no UTF-8 can hold: broken bytes replaced."""
    return F.make_valid_utf8(c)


def choose_input(folder: str, doc_limit: int, small: int = 12_000, full: str = "cc_wet_full.jsonl", sample: str = "cc_wet_sample.jsonl") -> str:
    """The input for a run: the full file for more than ``small`` documents, else the sample, else any archive, else any JSON lines.

    Raises ``FileNotFoundError`` where there is none of them.
    """
    wanted = [full] if doc_limit > small else [sample]
    for name in (*wanted, sample, full):
        if os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    for ending in (".warc.gz", ".jsonl"):
        for name in names:
            if name.endswith(ending):
                return os.path.join(folder, name)
    raise FileNotFoundError(f"no input in {folder}")


def read_input(spark: SparkSession, path: str, schema: str = "text string, url string, source string", limit: int | None = None) -> DataFrame:
    """A chosen input by its ending; one that isn't known raises ``ValueError``."""
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema, limit)
    if path.endswith((".wet", ".wet.gz")):
        rows = read_wet(spark, path)
    elif path.endswith((".warc", ".warc.gz")):
        rows = read_warc(spark, path)
    else:
        raise ValueError(f"unknown kind of input: {path}")
    return rows if limit is None else rows.limit(limit)
