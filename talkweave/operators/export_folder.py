"""A conversation written to a folder: its text or JSON, the media that it names, and a report of these.

The text is written in ordered parts which, one after another, are the whole (`whole` reads them so): a long
conversation is many tasks' work, and nothing of it passes the driver. Media are copied by tasks, each
file once and under a name of its own until it is complete, so a task that runs again does no harm."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions import text
from talkweave.operators import export, media
from talkweave.operators.messages import ordered
from talkweave.operators.running import running
from talkweave.session import shared, ship

FORMATS = ("txt", "json")
REPORT = "filename string, task_kind string, key string, size long, reason string"


@dataclass(frozen=True)
class Names:
    """Whose conversation is written, and what it and the account's owner are called."""

    talker: str
    shown: str
    own: str

    @property
    def group(self) -> bool:
        return self.talker.endswith(S.GROUP_SUFFIX)


def _part(d: DataFrame, part: int, line: Column, position: Column | None = None) -> DataFrame:
    return d.select(F.lit(part).alias("part"), (F.lit(0) if position is None else position).cast("long").alias("position"), line.alias("line"))


def _about(messages: DataFrame) -> DataFrame:
    """One row (n, first_time, last_time), of no messages too."""
    return messages.agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def text_parts(messages: DataFrame, names: Names, exported_at: str, show_emoji: bool = False) -> DataFrame:
    """(part, position, line) whose lines in order are the text of export.txt(). messages have media_kind and filename."""
    head = (export.HEADER_GROUP if names.group else export.HEADER_PRIVATE).format(talker=names.shown, own=names.own)
    span = F.concat(F.lit(f"\n{export.RANGE}"), text.short_date(F.col("first_time")), F.lit(" ~ "), text.short_date(F.col("last_time")))
    top = F.concat(F.lit(f"{head}\n\n{export.EXPORTED}{exported_at}\n{export.COUNTED}"), F.col("n").cast("string"), F.coalesce(span, F.lit("")))
    lines = export.txt_lines(messages, names.own, show_emoji)
    files = lines.filter("label is not null")
    parts = [
        _part(_about(messages), 0, top),
        _part(lines, 1, F.expr("substr(line, 1, length(line) - 1)"), F.col("position")),  # the writer ends each line
        _part(files.limit(1), 2, F.lit(f"\n{export.ATTACHMENTS}")),
        _part(files, 3, F.concat(F.lit("\n["), "label", F.lit("] media/"), "filename"), F.col("position")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def json_parts(messages: DataFrame, names: Names, exported_at: str, paging: dict, stats: dict) -> DataFrame:
    """(part, position, line) whose lines in order are one JSON object: export information, conversation, items with the media
    of each, names of all media, paging and statistics. paging: limit, offset and total; null fields are left out."""
    about = _about(messages)
    conversation = F.struct(F.lit(names.talker).alias("talker"), F.lit(names.shown).alias("display_name"), F.lit("group" if names.group else "private").alias("type"), F.col("n").alias("message_count"), "first_time", "last_time")
    top = F.concat(F.lit(f'{{"export_info":{json.dumps({"exported_at": exported_at}, ensure_ascii=False)},"conversation":'), F.to_json(conversation), F.lit(',"items":['))
    own = F.when(F.col("filename").isNotNull(), F.array(F.concat(F.lit("media/"), "filename"))).alias("media_files")
    shown = [c for c in messages.columns if c not in ("media_kind", "filename")]
    items = running(messages.select(F.lit(0).alias("__all"), F.struct(*(F.col(f"`{c}`") for c in shown), own).alias("item"), *(F.col(k).alias(f"__{k}") for k in ("sort_seq", "create_time", "server_id"))), ["__all"], ordered(True, ("__sort_seq", "__create_time", "__server_id")), "position")
    held = running(messages.filter("filename is not null").select(F.lit(0).alias("__all"), "filename").distinct(), ["__all"], [F.col("filename").asc()], "position")
    comma = F.when(F.col("position") > 1, ",").otherwise("")
    name = F.expr("substr(to_json(array(concat('media/', filename))), 2, length(to_json(array(concat('media/', filename)))) - 2)")
    ended = F.struct(F.lit(paging["limit"]).alias("limit"), F.lit(paging["offset"]).alias("offset"), F.lit(paging["total"]).alias("total"), F.col("n").alias("returned"), (F.lit(paging["offset"]) + F.col("n") < F.lit(paging["total"])).alias("has_more"))
    counted = json.dumps({"scanned": paging["total"], "skipped": 0} | stats, ensure_ascii=False)
    return (
        _part(about, 0, top)
        .unionByName(_part(items, 1, F.concat(comma, F.to_json("item")), F.col("position")))
        .unionByName(_part(about, 2, F.lit('],"media_files":[')))
        .unionByName(_part(held, 3, F.concat(comma, name), F.col("position")))
        .unionByName(_part(about, 4, F.concat(F.lit('],"paging":'), F.to_json(ended), F.lit(f',"stats":{counted}}}'))))
    )


def whole(spark: SparkSession, at: str) -> DataFrame:
    """(file, body) of the parts of a written text, whose bodies in the order of file are the whole."""
    return spark.read.text(at, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def claims(located: DataFrame) -> DataFrame:
    """(filename, task_kind, key, path, voice_data): one row for each file to write, of several tasks that of the smallest path, then key."""
    first = F.struct("path", "task_key")
    d = located.filter("filename is not null").groupBy("filename").agg(F.min_by(F.struct("media_kind", "task_key", "path", "voice_data"), first).alias("m"))
    return d.select("filename", F.col("m.media_kind").alias("task_kind"), F.col("m.task_key").alias("key"), "m.path", "m.voice_data")


def write_media(claimed: DataFrame, folder: str) -> DataFrame:
    """Writes the files of claims() below folder; REPORT rows, lazy, with the reason where one could not be written.

    Names that would leave the folder are not written."""
    ship(claimed.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from talkweave.sources.sqlite_source import place

        system, at = place(folder)
        system = system or fs.LocalFileSystem()
        system.create_dir(at, recursive=True)
        for b in batches:
            sizes, reasons = [], []
            names, paths, data = (b.column(c) for c in ("filename", "path", "voice_data"))
            for name, path, held in zip(names, paths, data, strict=True):
                name, size, reason = name.as_py(), None, None
                if "/" in name or "\\" in name or name in ("", ".", ".."):
                    reason = "name leaves the folder"
                else:
                    own = f"{at}/.{uuid.uuid4().hex}"
                    try:
                        with system.open_output_stream(own) as out:
                            if held.is_valid:
                                size = out.write(held.as_buffer())
                            else:
                                source, where = place(path.as_py())
                                size = 0
                                with (source or fs.LocalFileSystem()).open_input_stream(where) as f:
                                    while piece := f.read(1 << 20):
                                        size += out.write(piece)
                        system.move(own, f"{at}/{name}")
                    except (OSError, ValueError) as e:
                        size, reason = None, f"copy: {type(e).__name__}"
                        if system.get_file_info(own).is_file:
                            system.delete_file(own)
                sizes.append(size)
                reasons.append(reason)
            columns = [names, b.column("task_kind"), b.column("key"), pa.array(sizes, pa.int64()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["filename", "task_kind", "key", "size", "reason"])

    return claimed.mapInArrow(put, REPORT)


def missing(located: DataFrame) -> DataFrame:
    """REPORT rows of the first task of each image and voice that has nothing to write; videos and files are told by their tags."""
    lost = located.filter("filename is null and not is_dup and media_kind in ('image', 'voice')")
    return lost.select("filename", F.col("media_kind").alias("task_kind"), F.col("task_key").alias("key"), F.lit(None).cast("long").alias("size"), F.lit("nothing found").alias("reason"))


def write(messages: DataFrame, folder: str, names: Names, exported_at: str, format: str = "txt", media_in: tuple[DataFrame, DataFrame, DataFrame] | None = None, show_emoji: bool = False, paging: dict | None = None, stats: dict | None = None) -> dict:  # noqa: A002
    """Writes enriched messages of one conversation below folder: `conversation.<format>`, a folder of ordered parts; with
    media_in (files, links, blobs of media.located()) also `media` with each file once and `report` with a row for each.

    Only files that were written are named in the text; a message whose file was not keeps its one-line rendering. What
    the folder held is replaced, but for media of other names. Returns messages, media (files written), errors by
    kind (media.errors_by_kind) and tags (media.tag_stats), the last two as DataFrames or None without media."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    spark, errors, tags, written = messages.sparkSession, None, None, 0
    kept = shared(spark)
    messages.write.parquet(f"{kept}/messages")  # decoded and rendered once
    messages = spark.read.schema(messages.schema).parquet(f"{kept}/messages")
    if media_in is None:
        none = F.lit(None).cast("string")
        d = messages.withColumns({"media_kind": none, "filename": none})
    else:
        at = f"{kept}/located"
        media.located(media.with_canonical(media.classify(messages)), *media_in).write.parquet(at)
        located = spark.read.parquet(at)
        write_media(claims(located), f"{folder}/media").unionByName(missing(located)).write.mode("overwrite").parquet(f"{folder}/report")
        report = spark.read.schema(REPORT).parquet(f"{folder}/report")
        done = report.filter("reason is null").select("filename", F.lit(True).alias("__done"))
        written, tags = done.count(), media.tag_stats(located)
        errors = media.errors_by_kind(report.filter("reason is not null"))
        found = located.join(done, "filename", "left")
        found = found.select(*messages.columns, *(F.when(F.col("__done"), F.col(c)).alias(c) for c in ("media_kind", "filename")))
        d = messages.filter(~media.has_media()).unionByName(found, allowMissingColumns=True)
    parts = text_parts(d, names, exported_at, show_emoji) if format == "txt" else json_parts(d, names, exported_at, paging or {"limit": 0, "offset": 0, "total": messages.count()}, stats or {})
    parts.orderBy("part", "position").select("line").write.mode("overwrite").text(f"{folder}/conversation.{format}")
    return {"messages": messages.count(), "media": written, "errors": errors, "tags": tags}
