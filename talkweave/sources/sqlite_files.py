"""SQLite files as DataFrames.

Files are read through Spark's own binary source, so any storage that Spark reaches will do, and each
is opened from memory where it was read. One file is one row; columns and tables that a file lacks
come back null or empty; a file that cannot be read is a warning, not an error."""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkweave import schema as S
from talkweave.functions import text

NUMBERED = r".*/message_[0-9]+\.db$"


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a name below root."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def columns_of(db: sqlite3.Connection, table: str) -> set[str]:
    return {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}


def rows_of(db: sqlite3.Connection, table: str, wanted: list[str]) -> Iterator[tuple]:
    """The wanted columns of a table, None for those it lacks."""
    have = columns_of(db, table)
    if have:
        yield from db.execute(f'SELECT {", ".join(f"""\"{c}\"""" if c in have or c == "rowid" else "NULL" for c in wanted)} FROM "{table}"')


def read(found: DataFrame, schema: T.StructType, rows: Callable[[sqlite3.Connection, str], Iterator[tuple]], at_once: int = 5000) -> DataFrame:
    """rows(db, path) of every file, plus (path, warning) for those that failed."""
    out = T.StructType([*schema.fields, T.StructField("path", T.StringType()), T.StructField("warning", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_fit(r[k], f.type) for r in part], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part: list[tuple] = []
                try:
                    db = _open(data.as_py())
                    db.text_factory = lambda x: x.decode(errors="replace")
                    for r in rows(db, path):
                        part.append((*r, path, None))
                        if len(part) >= at_once:
                            yield made(part)
                            part = []
                    db.close()
                except sqlite3.Error as e:
                    part.append((*[None] * len(schema), path, str(e)))
                if part:
                    yield made(part)

    return found.select("path", "content").mapInArrow(run, out)


def _open(data: bytes) -> sqlite3.Connection:
    """A database from its bytes. One in write-ahead mode is marked as plain, since its log is not here: the last checkpoint is read."""
    if data[18:20] == b"\2\2":
        data = data[:18] + b"\1\1" + data[20:]
    if hasattr(sqlite3.Connection, "deserialize"):
        db = sqlite3.connect(":memory:")
        db.deserialize(data)
        return db
    with tempfile.NamedTemporaryFile(delete=False) as f:  # builds without deserialize
        f.write(data)
    try:
        disk, db = sqlite3.connect(f.name), sqlite3.connect(":memory:")
        disk.backup(db)
        disk.close()
        return db
    finally:
        os.unlink(f.name)


def _fit(v, kind: pa.DataType):
    if v is None:
        return None
    if pa.types.is_string(kind):
        return v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    if pa.types.is_binary(kind):
        return v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytes) else str(v).encode()
    if pa.types.is_integer(kind):
        try:
            return int(v)
        except (TypeError, ValueError):
            return None
    return v


def good(d: DataFrame) -> DataFrame:
    """Rows without those that stand for failed files."""
    return d.filter("warning is null").drop("path", "warning")


def warnings(d: DataFrame) -> DataFrame:
    """(path, warning)."""
    return d.filter("warning is not null").select("path", "warning")


def shards(spark: SparkSession, root: str) -> DataFrame:
    """Numbered message files alone; their helpers (index, resources) have other names."""
    return files(spark, root, "message_*.db").filter(F.col("path").rlike(NUMBERED))


def shard_starts(found: DataFrame) -> DataFrame:
    """(shard_id, start_time, path); an unreadable start is 0."""
    d = read(found, T.StructType([T.StructField("timestamp", T.LongType())]), lambda db, _: rows_of(db, "Timestamp", ["timestamp"]))
    d = found.select("path").join(d.filter("warning is null").groupBy("path").agg(F.min("timestamp").alias("timestamp")), "path", "left")
    return d.select(text.shard_id(F.col("path")).alias("shard_id"), F.coalesce("timestamp", F.lit(0).cast("long")).alias("start_time"), "path")


def raw_messages(found: DataFrame) -> DataFrame:
    """Rows of all conversation tables (schema RAW_MESSAGE), with path and warning."""
    wanted = ["sort_seq", "server_id", "local_type", "real_sender_id", "create_time", "message_content", "packed_info_data", "compress_content", "WCDB_CT_message_content", "status"]

    def rows(db: sqlite3.Connection, path: str) -> Iterator[tuple]:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE 'Msg\\_%' ESCAPE '\\' ORDER BY name").fetchall():
            for r in rows_of(db, name, wanted):
                yield (path, name, *r)

    return read(found, S.RAW_MESSAGE, rows)


def sender_names(found: DataFrame) -> DataFrame:
    """(shard, id, user_name) of the files' sender dictionaries, with path and warning."""
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("id", T.LongType()), T.StructField("user_name", T.StringType())])
    return read(found, schema, lambda db, p: ((p, *r) for r in rows_of(db, "Name2Id", ["rowid", "user_name"])))


def table(found: DataFrame, name: str, columns: dict[str, T.DataType]) -> DataFrame:
    """The columns of one table of every file, with path and warning."""
    return read(found, T.StructType([T.StructField(c, t) for c, t in columns.items()]), lambda db, _: rows_of(db, name, list(columns)))


_TEXT, _LONG, _BLOB = T.StringType(), T.LongType(), T.BinaryType()
SESSION_COLUMNS = {"username": _TEXT, "sort_timestamp": _LONG, "summary": _BLOB, "last_msg_type": _LONG, "last_msg_sender": _TEXT, "last_sender_display_name": _TEXT}
CONTACT_COLUMNS = {**dict.fromkeys(("username", "alias", "remark", "nick_name", "description"), _TEXT), "extra_buffer": _BLOB, "small_head_url": _TEXT, "big_head_url": _TEXT}
LABEL_COLUMNS = {"label_id_": _TEXT, "label_name_": _TEXT, "sort_order_": _LONG}
ROOM_COLUMNS = {"username": _TEXT, "owner": _TEXT, "ext_buffer": _BLOB}
VOICE_COLUMNS = {"svr_id": _TEXT, "voice_data": _BLOB, "chat_name_id": _LONG}
LINK_COLUMNS = {"md5": _TEXT, "file_name": _TEXT, "file_size": _LONG, "modify_time": _LONG, "dir1": _LONG, "dir2": _LONG}
INDEX_COLUMNS = {"acontent": _TEXT, **dict.fromkeys(("message_local_id", "sort_seq", "local_type", "session_id", "sender_id", "create_time"), _LONG)}

# The tables of an index file.
INDEX_SHARDS = ("message_fts_v4_0", "message_fts_v4_1", "message_fts_v4_2", "message_fts_v4_3")


def link_table(found: DataFrame, kind: str) -> DataFrame:
    """Link entries of image, video or file: of the v3 table where a file has one, else of v4."""
    if kind not in ("image", "video", "file"):
        raise ValueError(f"no links of kind {kind}")

    def rows(db: sqlite3.Connection, _: str) -> Iterator[tuple]:
        name = f"{kind}_hardlink_info_v3"
        yield from rows_of(db, name if columns_of(db, name) else f"{kind}_hardlink_info_v4", list(LINK_COLUMNS))

    return read(found, T.StructType([T.StructField(c, t) for c, t in LINK_COLUMNS.items()]), rows)


def _declared(db: sqlite3.Connection, name: str) -> list[str]:
    """Columns of an index table in the order in which they were declared; its tokenizer need not be there."""
    row = db.execute("SELECT sql FROM sqlite_master WHERE name = ?", (name,)).fetchone()
    parts = row[0][row[0].index("(") + 1 : row[0].rindex(")")].split(",") if row else []
    return [p.split()[0].strip("\"'") for p in parts if p.strip() and "=" not in p]


def index_rows(found: DataFrame) -> DataFrame:
    """Rows of the four shards of every index file, with path and warning: all that was indexed, whatever the tokenizer was."""

    def rows(db: sqlite3.Connection, _: str) -> Iterator[tuple]:
        for name in INDEX_SHARDS:
            kept, declared = f"{name}_content", _declared(db, name)
            if not columns_of(db, kept):
                yield from rows_of(db, name, list(INDEX_COLUMNS))
                continue
            place = {c: f"c{k}" for k, c in enumerate(declared)}
            yield from rows_of(db, kept, [place.get(c, "") for c in INDEX_COLUMNS])

    return read(found, T.StructType([T.StructField(c, t) for c, t in INDEX_COLUMNS.items()]), rows)


def index_names(found: DataFrame) -> DataFrame:
    """(id, username) of the index files' dictionary, with path and warning."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("username", T.StringType())])
    return read(found, schema, lambda db, _: rows_of(db, "name2id", ["rowid", "username"]))


def is_voice_file(path: str) -> bool:
    return bool(re.search(r"(^|/)media(_[0-9]+)?\.db$", path))
