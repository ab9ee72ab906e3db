"""Media of messages: tasks, their duplicates, and the files and blobs they mean. Only paths and bytes
are resolved here; nothing is transcoded.

File listings are DataFrames (path), read by Spark's file sources, so every lookup is a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.functions import text

# Which tags count again for a duplicate message.
COUNTS_AGAIN = {"thumbnail_image": False, "wxgf_transcoded": False, "wxgf_fallback": False, "silk_voice": True, "fallback_video": True, "fallback_file": True, "skipped_video": True, "skipped_file": True}


def has_media() -> Column:
    """Whether a message is classified as media; never null."""
    k = F.col("content_kind")
    return F.coalesce((k == "Voice") | (k.isin("Image", "Video", "File") & F.col("content")["md5"].isNotNull()), F.lit(False))


def classify(messages: DataFrame) -> DataFrame:
    """Messages with media: all their columns, media_kind, md5, title and task_key. Media but voice need a hash."""
    c, k = F.col("content"), F.col("content_kind")
    d = messages.filter(has_media())
    t = F.col("create_time").cast("string")
    key = (
        F.when(k == "Image", F.concat(F.lit("img:"), c["md5"]))
        .when(k == "Voice", F.concat(F.lit("voi:"), F.col("server_id").cast("string")))
        .when(k == "Video", F.concat(F.lit("vid:"), c["md5"], F.lit(":"), t))
        .otherwise(F.concat(F.lit("fil:"), c["md5"], F.lit(":"), t, F.lit(":"), F.coalesce(c["title"], F.lit(""))))
    )
    return d.withColumns({"media_kind": F.lower(k), "md5": c["md5"], "title": c["title"], "task_key": key})


def with_canonical(tasks: DataFrame, order: tuple[str, ...] = ("sort_seq", "create_time", "server_id")) -> DataFrame:
    """Adds canonical (order key of the first task of the same key) and is_dup.

    The first task is an aggregate by key with map-side combining, and both sides of the join with it are dealt anew,
    so that adaptive execution can split a much-forwarded file; only tasks of equal order keys meet in a window."""
    own = F.struct(*order)
    first = tasks.groupBy("task_key").agg(F.min(own).alias("canonical")).withColumn("__h", F.xxhash64("task_key"))
    again = Window.partitionBy("task_key", *order).orderBy("task_key")
    d = tasks.withColumns({"__r": F.row_number().over(again), "__h": F.xxhash64("task_key")}).join(first.hint("merge"), ["__h", "task_key"])
    return d.withColumn("is_dup", (own != F.col("canonical")) | (F.col("__r") > 1)).drop("__h", "__r")


def image_files(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path and quality ("full" or "thumbnail") of the best <md5(talker)>/*/Img/<md5>*.dat: _h, then exact, then the first."""
    found = files.select("path", F.regexp_extract("path", r"([0-9a-f]{32})/[^/]+/Img/([^/]+)\.dat$", 1).alias("owner"), F.regexp_extract("path", r"/Img/([^/]+)\.dat$", 1).alias("stem")).filter("owner != ''")
    found = found.withColumn("own_md5", F.substring("stem", 1, 32))
    images = tasks.filter("media_kind = 'image'").withColumn("owner", F.md5(F.col("talker").cast("binary")))
    rank = F.when(F.col("stem") == F.concat("own_md5", F.lit("_h")), 0).when(F.col("stem") == F.col("own_md5"), 1).otherwise(2)
    best = found.groupBy("owner", "own_md5").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    d = images.join(best.withColumnRenamed("own_md5", "md5"), ["owner", "md5"], "left").drop("owner")
    return d.withColumn("quality", F.when(F.col("path").endswith("_t.dat"), "thumbnail").when(F.col("path").isNotNull(), "full"))


def hardlinks(table: DataFrame, dirs: DataFrame, key: str) -> DataFrame:
    """Entries (md5, file_name, dir1, dir2 as names) of a hash or a file name's start, high-quality names first."""
    d = table.filter((F.col("md5") == key) | F.col("file_name").startswith(key))
    for c in ("dir1", "dir2"):
        d = d.join(dirs.select(F.col("id").alias(c), F.col("username").alias(f"{c}_name")), c, "left").drop(c).withColumn(c, F.coalesce(f"{c}_name", F.lit(""))).drop(f"{c}_name")
    return d.orderBy(F.col("file_name").contains("_h.").desc(), "file_name").select("md5", "file_name", "file_size", "modify_time", "dir1", "dir2")


def _linked(tasks: DataFrame, links: DataFrame, files: DataFrame, shapes: list[list[str]]) -> DataFrame:
    """Adds link_path: the first of the shapes (of dir1, dir2, file_name and literals) that exists for a task's first link."""
    first = links.groupBy("md5").agg(F.min_by(F.struct("dir1", "dir2", "file_name"), F.struct(~F.col("file_name").contains("_h."), "file_name")).alias("link"))
    d = tasks.join(first, "md5", "left")
    part = lambda x: F.col(f"link.{x}") if x in ("dir1", "dir2", "file_name") else F.lit(x)
    tries = d.select("md5", F.posexplode(F.array(*(F.concat_ws("/", *map(part, s)) for s in shapes))).alias("rank", "tail")).filter("tail != ''").distinct()
    # Paths are compared by their last parts, as many as a shape has.
    hit = None
    for n in sorted({len(s) for s in shapes}):
        tail = F.element_at(F.split("path", "/"), -1) if n == 1 else F.array_join(F.slice(F.split("path", "/"), -n, n), "/")
        f = files.filter(F.size(F.split("path", "/")) >= n).select("path", tail.alias("tail"))
        j = tries.filter(F.size(F.split("tail", "/")) == n).join(f, "tail")
        hit = j if hit is None else hit.unionByName(j)
    best = hit.groupBy("md5").agg(F.min_by("path", F.struct("rank", "path")).alias("link_path"))
    return d.join(best, "md5", "left")


def video_files(tasks: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path, filename and tags: by the link table, else <YYYY-MM>/<md5>.mp4 (the message's month first), else skipped."""
    videos = tasks.filter("media_kind = 'video'")
    d = _linked(videos, links, files, [["dir1", "dir2", "Video", "file_name"], ["dir1", "dir2", "file_name"], ["dir1", "Video", "file_name"]])
    by_month = files.select("path", F.regexp_extract("path", r"([0-9]{4}-(0[1-9]|1[0-2]))/([^/]+)\.mp4$", 1).alias("month"), F.regexp_extract("path", r"/([^/]+)\.mp4$", 1).alias("md5")).filter("month != ''")
    near = videos.select("md5", "create_time").distinct().join(by_month, "md5")
    best = near.groupBy("md5", "create_time").agg(F.min_by("path", F.struct(F.col("month") != text.month(F.col("create_time")), "path")).alias("month_path"))
    d = d.join(best, ["md5", "create_time"], "left")
    return _told(d, F.col("link.file_name"), F.concat("md5", F.lit(".mp4")), "video")


def plain_files(tasks: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path, filename and tags: by the link table, else <YYYY-MM>/<title> of the message's month alone, else skipped."""
    own = tasks.filter("media_kind = 'file'")
    d = _linked(own, links, files, [["dir1", "dir2", "file_name"], ["dir1", "file_name"]])
    by_month = files.select(F.col("path").alias("month_path"), F.regexp_extract("path", r"([0-9]{4}-[0-9]{2})/([^/]+)$", 1).alias("m"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("base")).filter("m != ''")
    by_month = by_month.groupBy("m", "base").agg(F.min("month_path").alias("month_path"))
    d = d.withColumns({"m": text.month(F.col("create_time")), "base": F.regexp_extract("title", r"([^/]+)/*$", 1)}).join(by_month, ["m", "base"], "left").drop("m")
    return _told(d, F.concat("md5", F.lit("_"), "link.file_name"), F.col("base"), "file").drop("base")


def _told(d: DataFrame, linked, fallen, kind: str) -> DataFrame:
    by_link, by_month = F.col("link_path").isNotNull(), F.col("month_path").isNotNull()
    tags = F.when(by_link, F.array().cast("array<string>")).when(by_month, F.array(F.lit(f"fallback_{kind}"))).otherwise(F.array(F.lit(f"skipped_{kind}")))
    return d.withColumns({"path": F.coalesce("link_path", "month_path"), "filename": F.when(by_link, linked).when(by_month, fallen), "tags": tags}).drop("link", "link_path", "month_path")


def voices(tasks: DataFrame, blobs: DataFrame, hint_col: str | None = None) -> DataFrame:
    """Adds voice_data: the first non-empty blob (svr_id, voice_data, db, optionally chat_name_id) of the server id, hinted rows first, then by db."""
    held = blobs.filter(F.length("voice_data") > 0).withColumn("server_id", F.col("svr_id").try_cast("long"))
    own = tasks.filter("media_kind = 'voice'")
    if hint_col and "chat_name_id" in blobs.columns:
        j = own.select("task_key", "server_id", hint_col).distinct().join(held, "server_id")
        best = j.groupBy("task_key").agg(F.min_by("voice_data", F.struct(~F.coalesce(F.col("chat_name_id") == F.col(hint_col), F.lit(False)), "db")).alias("voice_data"))
        return own.join(best, "task_key", "left")
    best = held.groupBy("server_id").agg(F.min_by("voice_data", "db").alias("voice_data"))
    return own.join(best, "server_id", "left")


def tag_stats(resolved: DataFrame) -> DataFrame:
    """(tag, n) of rows with tags and is_dup; duplicates count only for tags that count again."""
    again = F.col("tag").isin([t for t, a in COUNTS_AGAIN.items() if a])
    return resolved.select("is_dup", F.explode("tags").alias("tag")).filter(~F.col("is_dup") | again).groupBy("tag").agg(F.count("*").alias("n"))


def errors_by_kind(errors: DataFrame) -> DataFrame:
    """(task_kind, n, failures) of rows (task_kind, key, reason)."""
    return errors.groupBy("task_kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat("key", F.lit(": "), "reason"))).alias("failures"))


def one_per_filename(resolved: DataFrame) -> DataFrame:
    """One row for each file to write, the smallest path of a name."""
    return resolved.filter("filename is not null").groupBy("filename").agg(F.min("path").alias("path"))


def located(tasks: DataFrame, files: DataFrame, links: DataFrame, blobs: DataFrame) -> DataFrame:
    """Tasks with path, filename, voice_data and tags, by their kinds: of images the file's own name, of voices <server id>.silk."""
    base = F.element_at(F.split("path", "/"), -1)
    told = lambda tag, when: F.when(when, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    none = lambda *names: {c: F.lit(None).cast("binary" if c == "voice_data" else "string") for c in names}
    parts = [
        image_files(tasks, files).withColumns({"filename": base, "tags": told("thumbnail_image", F.col("quality") == "thumbnail")}).withColumns(none("voice_data")),
        video_files(tasks, links, files).withColumns(none("voice_data")),
        plain_files(tasks, links, files).withColumns(none("voice_data")),
        voices(tasks, blobs).withColumns(none("path")).withColumns({"filename": F.when(F.col("voice_data").isNotNull(), F.concat(F.col("server_id").cast("string"), F.lit(".silk"))), "tags": told("silk_voice", F.col("voice_data").isNotNull())}),
    ]
    columns = [*tasks.columns, "path", "filename", "voice_data", "tags"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def media_of(messages: DataFrame, talker: str, server_id: int) -> DataFrame:
    """The media task of one message."""
    return classify(messages.filter((F.col("talker") == talker) & (F.col("server_id") == server_id)))


def with_resource(messages: DataFrame, resources: DataFrame) -> DataFrame:
    """Messages (with local_id) and resource_md5, the digest in the packed information of the resource of that id.

    Null where there is no resource, or no digest in it. Of several resources of one id the first path's counts, then the
    least bytes. Each blob is read once, before the join."""
    from talkweave.functions import wire

    first = resources.filter("warning is null and local_id is not null").groupBy("local_id").agg(F.min(F.struct("path", "packed_info")).alias("r"))
    return messages.join(first.select("local_id", wire.md5_in_resource(F.col("r.packed_info")).alias("resource_md5")), "local_id", "left")
