"""Zip archives as tables: one row per member, and back.

Opening and writing the container is the only Python here; container bytes go
through the standard ``zipfile`` module, one archive per row, and everything
around it stays in Spark. The functions are plain row functions: they get a
hundred rows at once, so a worker holds no more, where an Arrow batch of
ten thousand packages stood several times in every worker.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
import zlib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Ship the functions below inside the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_DIRECTORY = "no archive: its directory is missing"


MAX_MEMBER = 1 << 30  # bytes one member may inflate to; beyond it the member gives an error, not a dead worker


def _open(content: bytes) -> tuple[zipfile.ZipFile | None, str | None]:
    """The archive, or why it can't be opened: whatever a crafted file raises stays with its row."""
    try:
        return zipfile.ZipFile(io.BytesIO(content)), None
    except zipfile.BadZipFile:
        return None, NO_DIRECTORY
    except Exception as bad:  # noqa: BLE001 - a row of data, not a fault of the job
        return None, f"unreadable zip: {bad}"


def _inflate(content: bytes, info: zipfile.ZipInfo, limit: int = MAX_MEMBER) -> tuple[bytes | None, str | None]:
    """Member bytes for stored and deflated members, or an error; other methods give no data.

    Sizes and check sums stay claims of the directory: a member whose bytes do
    not match them is still returned, so that an audit can compare.
    """
    head = content[info.header_offset : info.header_offset + 30]
    if head[:4] != b"PK\x03\x04":
        return b"", None
    skip = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    start = info.header_offset + 30 + skip
    raw = content[start : start + info.compress_size]
    if info.compress_type == zipfile.ZIP_STORED:
        return raw, None
    if info.compress_type != zipfile.ZIP_DEFLATED:
        return b"", None
    stream = zlib.decompressobj(-15)
    try:
        data = stream.decompress(raw, limit)
    except zlib.error as bad:
        return None, str(bad)
    return (None, f"member inflates beyond {limit} bytes") if stream.unconsumed_tail else (data, None)


def explode_archives(df: DataFrame, content: str = "content", data: bool = True) -> DataFrame:
    """One row per member of every archive; ``content`` itself is not carried along.

    A row whose content is NULL keeps one empty row, one that is no readable archive a row with
    ``error``. With ``data=False`` only the directory is read and nothing is inflated.
    """
    rest = [c for c in df.columns if c != content]
    fields = "name:string,method:int,crc:bigint,comp_size:bigint,size:bigint,data:binary,error:string"
    names = [f.split(":")[0] for f in fields.split(",")]

    def members(value: bytes | None) -> list[tuple]:
        if value is None:
            return []
        value = bytes(value)
        archive, error = _open(value)
        if archive is None:
            return [(*[None] * (len(names) - 1), error)]
        rows = []
        for i in archive.infolist():
            body, error = _inflate(value, i) if data else (None, None)
            rows.append((i.orig_filename, i.compress_type, i.CRC, i.compress_size, i.file_size, body, error))
        return rows

    listed = F.udf(members, f"array<struct<{fields}>>", useArrow=False).asNondeterministic()
    opened = df.select(*rest, listed(F.col(content)).alias("_members"))
    return opened.select(*rest, F.explode_outer("_members").alias("m")).select(
        *rest, "m.name", "m.method", "m.crc", "m.comp_size", "m.size", *(["m.data"] if data else []), "m.error"
    )


MEMBERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("data", T.BinaryType())]))
LISTING = T.StructType(
    [
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("members", MEMBERS),
        T.StructField("error", T.StringType()),
    ]
)


def read_members(content: Column, wanted: str) -> Column:
    """``struct(names, members, error)``: all names, but only the members matching ``wanted`` inflated.

    Keeps a package in its row, so reading a document needs no regrouping. Pass
    NULL content for rows that failed a byte check: they cost nothing here.
    """
    pattern = re.compile(wanted)

    def listing(content: bytes | None) -> tuple:
        if content is None:
            return None, None, None
        content = bytes(content)
        archive, error = _open(content)
        if archive is None:
            return None, None, error
        members = []
        for i in archive.infolist():
            if error is None and pattern.search(i.orig_filename):
                data, error = _inflate(content, i)
                members.append((i.orig_filename, data))
        return [i.orig_filename for i in archive.infolist()], None if error else members, error

    # Declared non-deterministic so the optimizer neither repeats it nor folds the
    # projections between two Python steps into one expression.
    return F.udf(listing, LISTING, useArrow=False).asNondeterministic()(content)


def _stored(members: list[tuple[str, bytes]]) -> bytes:
    """A store-method archive; fixed dates, so equal members give equal bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
        for name, data in members:
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return buffer.getvalue()


def _pack(members: list | None) -> bytes | None:
    return None if members is None else _stored([(x["name"], bytes(x["data"])) for x in members])


def pack_members(members: Column) -> Column:
    """``array<struct<name,data>>`` of one row to archive bytes; NULL stays NULL."""
    return F.udf(_pack, T.BinaryType(), useArrow=False).asNondeterministic()(members)


def bundle_archives(
    parts: DataFrame, key: str, name: str, data: str, order: str, volumes: int = 1
) -> DataFrame:
    """Pack the parts of every ``key`` into store-method archives, ``volumes`` of them for every bundle alike.

    Parts go to a volume by a hash of their name and order. An archive is one value of one row, so
    choose ``volumes`` such that the largest bundle divided by it fits a task; a bundle with a third
    of all rows is then written by as many tasks, and no part is lost. ``(key, volume)`` identifies
    an archive.
    """
    spread = parts.select(
        F.col(key).alias("bundle"), F.col(name).alias("name"), F.col(data).alias("data"), F.col(order).alias("ord")
    ).withColumn("volume", F.pmod(F.xxhash64("name", "ord"), F.lit(volumes)).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "name"], kind="stable")
        content = _stored(list(zip(group["name"], group["data"])))
        declared = int(group["data"].map(len).sum())
        return pd.DataFrame(
            {
                "bundle": [group["bundle"].iloc[0]],
                "volume": [int(group["volume"].iloc[0])],
                "entries": [len(group)],
                "declared": [declared],
                "content": [content],
            }
        )

    kind = parts.schema[key].dataType.simpleString()
    return (
        spread.groupBy("bundle", "volume")
        .applyInPandas(
            pack, f"bundle {kind}, volume int, entries bigint, declared bigint, content binary"
        )
        .withColumn("declared_ratio", F.col("declared") / F.octet_length("content"))
        .withColumnRenamed("bundle", key)
    )
