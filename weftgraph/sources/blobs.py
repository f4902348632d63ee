"""Blob buckets on any Hadoop file system, page readers and SQL scripts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlobStore:
    """Buckets are folders below ``root``; only the base name of a blob's path counts. Small objects, driver side; bulk reads go by ``read``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop

    def _path(self, bucket: str, name: str = ""):
        base = name.rsplit("/", 1)[-1]
        p = self._hadoop.fs.Path(f"{self.root}/{bucket}" + (f"/{base}" if base else ""))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def upload(self, bucket: str, name: str, data: bytes) -> str:
        p, fs = self._path(bucket, name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return p.toString()

    def download(self, bucket: str, name: str) -> bytes:
        p, fs = self._path(bucket, name)
        if not fs.exists(p):
            raise FileNotFoundError(p.toString())
        rows = self.spark.read.format("binaryFile").load(p.toString()).select("content").collect()
        return bytes(rows[0]["content"])

    def delete(self, bucket: str, name: str) -> bool:
        p, fs = self._path(bucket, name)
        return bool(fs.delete(p, False))

    def clear(self, bucket: str) -> None:
        p, fs = self._path(bucket)
        fs.delete(p, True)
        fs.mkdirs(p)

    def read(self, bucket: str, pattern: str = "*") -> DataFrame:
        """``path, name, content`` of a bucket's blobs, read by the executors; the reader skips empty ones."""
        got = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{self.root}/{bucket}")
        return got.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def text_pages(blobs: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` of plain-text blobs whose pages end in form feeds."""
    text = F.split(F.decode("content", "UTF-8"), "\f")
    return blobs.select(F.col("name").alias("doc_id"), F.posexplode(text).alias("page_no", "text"))


def pdf_pages(blobs: DataFrame) -> DataFrame:
    """``doc_id, page_no, text, error`` of PDF blobs, where the optional ``pypdf`` is installed; a blob that cannot be read is one row with its error."""

    def run(batches):
        import io

        import pyarrow as pa
        from pypdf import PdfReader

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, i, p.extract_text() or "", None) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages)]
                except Exception as e:  # noqa: BLE001  unreadable input is data
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "page_no", "text", "error"])

    return blobs.select("name", "content").mapInArrow(run, "doc_id string, page_no int, text string, error string")


def page_dump(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: the raw pages of each document in order, a marker line before each."""
    one = F.concat(F.lit("--- PAGE "), (F.col("page_no") + 1).cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    got = pages.where("page_no is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", one.alias("t")))).alias("p"))
    return got.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def statements(script: str) -> list[str]:
    """The statements of a script, parted by semicolons; comments are left out.

    A semicolon, a comment's mark or another kind of quote inside quotes (single, double or backticks) is text; a backslash takes the next character's meaning inside the first
    two, and a doubled quote closes and opens again. Comments: from ``--`` to the end of a line, from ``//`` where nothing but white space stands before it in the line, and
    between ``/*`` and ``*/``. A quote or block comment that is left open is an error.
    """
    out, own, quote, at = [], [], "", 0
    while at < len(script):
        c, two = script[at], script[at : at + 2]
        if quote:
            step = 2 if c == "\\" and quote != "`" else 1
            own.append(script[at : at + step])
            quote = "" if c == quote else quote
            at += step
        elif two == "/*":
            end = script.find("*/", at + 2)
            if end < 0:
                raise ValueError("a comment is not closed")
            own.append(" ")
            at = end + 2
        elif two == "--" or two == "//" and not script[script.rfind("\n", 0, at) + 1 : at].strip():
            end = script.find("\n", at)
            at = len(script) if end < 0 else end
        elif c == ";":
            out.append("".join(own).strip())
            own, at = [], at + 1
        else:
            quote = c if c in "'\"`" else ""
            own.append(c)
            at += 1
    if quote:
        raise ValueError(f"a quote is not closed: {quote}")
    out.append("".join(own).strip())
    return [x for x in out if x]


def run_script(spark: SparkSession, script: str) -> int:
    """Run the ``statements`` of a script one after another; returns how many there were."""
    parts = statements(script)
    for p in parts:
        spark.sql(p)
    return len(parts)
