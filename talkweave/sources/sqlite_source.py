"""SQLite files as a data source of Spark, with filters pushed down to the files.

A partition is a part of the tables of one file. With pushdown, filters on the path and on the table's name leave out
files and tables, and comparisons of whole numbers become the SQL of the file, so that its indexes serve them. Spark keeps
one set of pushed filters for each loaded relation, so pushdown is asked for, and is for a relation that one query uses
once (see conversation()). A file in a mounted
folder is opened where it lies, and read in rows of bounded number, so memory does not grow with it. A file that has
a log beside it (name and "-wal") is copied with it to a folder that lasts as long as the task, where SQLite recovers
both: what the log has committed is seen, an unfinished tail is not, and the source stays as it is. The same is done
for files of other stores that pyarrow reaches; for stores that Spark alone reaches, see sqlite_files.

Columns that a table lacks are null; a damaged file is a row with a warning, whatever the pushed filters are, if the schema has
that column, else an error."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import shutil
import sqlite3
import tempfile
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from talkweave import schema as S
from talkweave.sources.sqlite_files import NUMBERED, _fit

LOG = "-wal"
#: What a column of the schema means that is not one of the tables.
PATH, TABLE, WARNING = "path", "table_name", "warning"
COMPARES = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def place(path: str):
    """(file system, path in it); the local one is None."""
    if re.match("file:/", path) or "://" not in path:
        return None, re.sub("^file:/+", "/", path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def listed(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, the path as it was named."""
    system, base = place(root)
    if system is None:
        found = [(os.path.join(at, n)) for at, _, names in os.walk(base) for n in names]
        return sorted((p, os.path.getsize(p)) for p in found)
    from pyarrow import fs

    head = root[: len(root) - len(base)]
    return sorted((head + f.path, f.size) for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file)


def exists(path: str) -> bool:
    system, at = place(path)
    return os.path.exists(at) if system is None else system.get_file_info(at).is_file


def fetch(path: str, to: str) -> None:
    """A copy, in pieces of bounded size."""
    system, at = place(path)
    with open(to, "wb") as out, open(at, "rb") if system is None else system.open_input_stream(at) as source:
        shutil.copyfileobj(source, out, 1 << 20)


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    """A database for reading, with what its log has committed."""
    system, at = place(path)
    if system is None and not exists(path + LOG):
        db = sqlite3.connect(f"file:{urllib.parse.quote(at)}?mode=ro&immutable=1", uri=True)
        try:
            yield db
        finally:
            db.close()
        return
    with tempfile.TemporaryDirectory(prefix="talkweave-") as folder:
        fetch(path, f"{folder}/copy.db")
        if exists(path + LOG):
            fetch(path + LOG, f"{folder}/copy.db{LOG}")
        db = sqlite3.connect(f"{folder}/copy.db")
        try:
            yield db
        finally:
            db.close()


@dataclass
class Part(InputPartition):
    """Those tables of a file whose hash modulo parts is part."""

    path: str
    part: int
    parts: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.schema = dict(options), schema
        self.filters: list[Filter] = []

    def _allowed(self, name: str, value: str) -> bool:
        """Whether a path or a table's name passes the filters on it."""
        for f in self.filters:
            if f.attribute == (name,) and isinstance(f, EqualTo | In) and value not in (f.value if isinstance(f, In) else (f.value,)):
                return False
        return True

    def partitions(self) -> list[Part]:
        o = self.options
        if "files" in o:
            found = [tuple(x) for x in json.loads(o["files"])]
        else:
            found = [(p, n) for p, n in listed(o["path"]) if fnmatch.fnmatch(p.rsplit("/", 1)[-1], o.get("glob", "*.db")) and re.search(o.get("pattern", ""), p)]
        split = int(o.get("splitbytes", 256 << 20))
        return [Part(p, k, parts) for p, n in found if self._allowed(PATH, p) for parts in [max(1, -(-n // split))] for k in range(parts)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows_at_once = int(self.options.get("rows", 4096))
        try:
            with opened(partition.path) as db:
                db.text_factory = lambda x: x.decode(errors="replace")
                names = [n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name GLOB ? ORDER BY name", (self.options.get("tables", "*"),))]
                for name in names:
                    if zlib.crc32(name.encode()) % partition.parts == partition.part and self._allowed(TABLE, name):
                        cursor = db.execute(*self._sql(db, name))
                        while rows := cursor.fetchmany(rows_at_once):
                            yield self._batch(rows, partition.path, name, None)
        except (sqlite3.Error, OSError) as e:
            if WARNING not in self.schema.names:
                raise
            if partition.part == 0:
                yield self._batch([(None,) * len(self._columns())], partition.path, None, f"{'io' if isinstance(e, OSError) else 'damaged'}: {e}")

    def _columns(self) -> list[str]:
        return [n for n in self.schema.names if n not in (PATH, TABLE, WARNING)]

    def _sql(self, db: sqlite3.Connection, table: str) -> tuple[str, list]:
        """The wanted columns, with the comparisons of columns declared as whole numbers; bounds are wider by one, as a
        stored fraction is cut, and the batch is filtered exactly afterwards."""
        own = {r[1]: (r[2] or "").upper() for r in db.execute(f'PRAGMA table_info("{table}")')}
        chosen = ", ".join(f'"{c}"' if c in own or c == "rowid" else "NULL" for c in self._columns()) or "NULL"
        where, values = [], []
        for f in self.filters:
            c = f.attribute[0]
            if type(f) in COMPARES and "INT" in own.get(c, "") and abs(f.value) < 1 << 62:
                if not isinstance(f, LessThan | LessThanOrEqual):
                    where.append(f'"{c}" > ?'), values.append(f.value - 1)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    where.append(f'"{c}" < ?'), values.append(f.value + 1)
        return f'SELECT {chosen} FROM "{table}"' + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def _batch(self, rows: list[tuple], path: str, table: str | None, warning: str | None) -> pa.RecordBatch:
        at, arrays, schema = {c: k for k, c in enumerate(self._columns())}, [], to_arrow_schema(self.schema)
        for f in schema:
            fixed = {PATH: path, TABLE: table, WARNING: warning}
            arrays.append(pa.array([fixed[f.name]] * len(rows) if f.name in fixed else [_fit(r[at[f.name]], f.type) for r in rows], f.type))
        batch = pa.RecordBatch.from_arrays(arrays, schema=schema)
        if warning is not None:
            return batch
        for f in self.filters:
            column = batch.column(schema.get_field_index(f.attribute[0]))
            keep = COMPARES[type(f)](column, pa.scalar(f.value, column.type)) if type(f) in COMPARES and f.attribute[0] not in (PATH, TABLE) else pc.is_valid(column) if isinstance(f, IsNotNull) else None
            batch = batch if keep is None else batch.filter(keep, null_selection_behavior="drop")
        return batch


class PushingReader(SqliteReader):
    """One that takes filters; Spark asks for this method only where filters may be pushed."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            whole = isinstance(kinds.get(name), T.IntegralType)
            if type(f) in COMPARES and whole and isinstance(f.value, int) or isinstance(f, EqualTo | In) and name in (PATH, TABLE) or isinstance(f, IsNotNull) and (whole or name in (PATH, TABLE)):
                self.filters.append(f)
            else:
                yield f


class SqliteSource(DataSource):
    """Format "sqlite_tables". load(root): the folder; glob, pattern: names of files; files: a JSON list of (path, bytes)
    instead; tables: a GLOB of table names; splitbytes: bytes of a file for each of its partitions; pushdown: "true"."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def reader(self, schema: T.StructType) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(self.options, schema)


def reaches(root: str) -> bool:
    """Whether pyarrow can open the files of a folder; else Spark alone can."""
    try:
        place(root)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def tables(spark: SparkSession, root: str, schema: T.StructType, names: str = "*", pushdown: bool = False, **options) -> DataFrame:
    """Rows of the tables of a name (GLOB) of all files below root, with path, table_name and warning."""
    spark.dataSource.register(SqliteSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options["pushdown"] = "true"
    own = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in (PATH, TABLE, WARNING))])
    return spark.read.format(SqliteSource.name()).schema(own).options(tables=names, **options).load(root)


_STORED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("sort_seq", "server_id", "local_type", "real_sender_id", "create_time")), *(T.StructField(c, T.BinaryType()) for c in ("message_content", "packed_info_data", "compress_content")), T.StructField("WCDB_CT_message_content", T.IntegerType()), T.StructField("status", T.IntegerType())])


def raw_messages(spark: SparkSession, root: str, **options) -> DataFrame:
    """Rows of all conversation tables of the message shards (schema RAW_MESSAGE), with path and warning."""
    d = tables(spark, root, _STORED, "Msg_*", **{"glob": "message_*.db", "pattern": NUMBERED} | options)
    renamed = {"shard": PATH, "codec": "WCDB_CT_message_content"}
    return d.select(*(F.col(renamed.get(f.name, f.name)).alias(f.name) for f in S.RAW_MESSAGE.fields), PATH, WARNING)


def conversation(spark: SparkSession, root: str, talker: str, since: int = 0, until: int = S.MAX_LONG, local_type: int | None = None, **options) -> DataFrame:
    """Stored rows of one conversation in a time range, and of one type: the files give no others. For one use in one query."""
    d = raw_messages(spark, root, pushdown=True, **options).filter((F.col(TABLE) == "Msg_" + hashlib.md5(talker.encode()).hexdigest()) & F.col("create_time").between(since, until))
    return d if local_type is None else d.filter(F.col("local_type") == local_type)


def sender_names(spark: SparkSession, root: str, **options) -> DataFrame:
    """(shard, id, user_name) of the shards' sender dictionaries, with path and warning."""
    schema = T.StructType([T.StructField("rowid", T.LongType()), T.StructField("user_name", T.StringType())])
    d = tables(spark, root, schema, "Name2Id", **{"glob": "message_*.db", "pattern": NUMBERED} | options)
    return d.select(F.col(PATH).alias("shard"), F.col("rowid").alias("id"), "user_name", PATH, WARNING)


_RESOURCE = T.StructType([T.StructField("local_id", T.LongType()), T.StructField("packed_info", T.BinaryType())])


def resources(spark: SparkSession, root: str, local_id: int | None = None, **options) -> DataFrame:
    """(local_id, packed_info) of the resource files, with path and warning; of one local id, for which the files are asked, or of all."""
    how = {"glob": "message_resource*.db"} | options
    d = tables(spark, root, _RESOURCE, "MessageResourceInfo", pushdown=local_id is not None, **how).select(*_RESOURCE.names, PATH, WARNING)
    return d if local_id is None else d.filter(F.col("local_id") == local_id)
