"""Files as rows: discovery, checks, content hashes and format detection from bytes. Bad files are rows with an issue."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

MOST_BYTES = 50 * 1024 * 1024
# How formats begin.
XLS_SIGNATURE = "D0CF11E0A1B11AE1"
FORMATS = ("pdf", "xml", "xlsx", "xls", "csv")


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files below a folder, by Spark's own reader (any store it reads).

    That reader passes over empty files; their names come from a listing, as rows without content. A path that is not there is one row
    without length or content, whose issue described() tells.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return spark.createDataFrame([(path, None, None)], "path string, length long, content binary")
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    listing = system.listFiles(root, True)
    empty = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            empty.append((status.getPath().toString(), 0, b""))
    return full.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else full


def described(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Adds name, extension, sha256, short_hash and the issue of files that are empty or too large."""
    name = F.substring_index("path", "/", -1)
    issue = F.when(F.col("length").isNull(), "file_not_found").when(F.col("length") == 0, "file_empty").when(F.col("length") > most, "file_too_large")
    return files.select(
        "*", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 12).alias("short_hash"), issue.alias("issue")
    )


def _is_spreadsheet_package():
    """Defined in here, the function travels to the workers by value."""

    def listed(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> bool | None:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return b"spreadsheetml" in z.read("[Content_Types].xml")
            except (zipfile.BadZipFile, KeyError):
                return False
            except Exception:  # a locked part or an unknown compression must not stop the other files
                return None

        return content.map(one).astype("boolean")

    return F.pandas_udf(listed, BooleanType())


#: Whether a zip's list of content types names a spreadsheet; null where the zip can't be read for another reason than being broken.
is_spreadsheet_package = _is_spreadsheet_package()


# What the bytes 0x80-0x9F stand for in Windows' Western code page; five of them stand for nothing.
WINDOWS_BYTES = "".join(chr(b) for b in range(0x80, 0xA0))
WINDOWS_CHARS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def text_of(content: Column) -> Column:
    """UTF-8 with or without a mark, else Windows' Western code page."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.translate(F.decode(content, "iso-8859-1"), WINDOWS_BYTES, WINDOWS_CHARS)), "^\ufeff", "")


def delimiter_of(text: Column) -> Column:
    """The first of semicolon, tab, comma that splits the first lines alike: one count among those that have any, the first two lines among them."""
    lines = F.slice(F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x) != ""), 1, 8)

    def counted(d: str) -> Column:
        return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))

    out = None
    for d in (";", "\t", ","):
        counts = counted(d)
        some = F.array_distinct(F.filter(counts, lambda c: c > 0))
        ok = (F.size(lines) >= 2) & (F.size(some) == 1) & F.forall(F.slice(counts, 1, 2), lambda c: c > 0)
        out = F.when(ok, d) if out is None else out.when(ok, d)
    return out


def detected(files: DataFrame) -> DataFrame:
    """Adds format (from the content alone) and the warning where the extension says another.

    The zip is only opened for files that begin like one.
    """
    head = F.substring(F.col("content"), 1, 4096)
    hexed = F.hex(head)
    pdf = F.contains(F.hex(F.substring(F.col("content"), 1, 1024)), F.lit("255044462D"))
    xml = hexed.rlike("^(?:EF|BB|BF|00|09|0A|0D|20)*3C")
    zip_ = F.startswith(hexed, F.lit("504B0304"))
    xls = F.startswith(hexed, F.lit(XLS_SIGNATURE))
    text = text_of(head)
    csv = ~F.contains(text, F.lit("\x00")) & delimiter_of(text).isNotNull()
    packages = files.withColumn("_package", F.when(zip_, is_spreadsheet_package(F.col("content"))).otherwise(False))
    kind = F.when(pdf, "pdf").when(xml, "xml").when(F.col("_package"), "xlsx").when(xls, "xls").when(csv, "csv")
    failed = F.when(F.col("issue").isNull() & F.col("_package").isNull(), "unexpected_processing_error")
    out = packages.withColumns({"format": F.when(F.col("issue").isNull(), kind), "issue": F.coalesce("issue", failed)}).drop("_package")
    claimed = F.when(F.substring("extension", 2, 9).isin(*FORMATS), F.substring("extension", 2, 9))
    mismatch = F.col("issue").isNull() & ~claimed.eqNullSafe(F.col("format")) & (claimed.isNotNull() | F.col("format").isNotNull())
    return out.withColumn("warning", F.when(mismatch, "extension_content_mismatch")).withColumn("issue", F.coalesce("issue", F.when(F.col("format").isNull(), "unknown_format")))
