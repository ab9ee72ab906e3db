import json
import os

import pytest
from pyspark.sql import functions as F
from test_operators import store

from talkweave.operators import export
from talkweave.operators import export_folder as E

M1, M2 = "%032x" % 1, "%032x" % 2


def joined(spark, at):
    return "".join(r.body for r in sorted(E.whole(spark, at).collect()))


def with_media(spark, s, talker):
    """The talker's messages again and again, as two images of one hash, a lost image, voices, a file that leaves the folder, and text."""
    d = s.messages.filter(F.col("talker") == talker).limit(1).drop("sort_seq", "server_id", "content_kind")
    rows = [(1, 1, "Image", M1, None), (2, 2, "Image", M1, None), (3, 3, "Image", M2, None), (4, 4, "Voice", None, None), (5, 5, "Voice", None, None), (6, 6, "File", M1, "a.pdf"), (7, 7, "Text", None, None), (7, 7, "Text", None, None)]
    made = spark.createDataFrame(rows, "sort_seq long, server_id long, content_kind string, m string, t string")
    d = made.join(d, F.lit(True)).withColumn("content", F.col("content").withField("md5", F.col("m")).withField("title", F.col("t")).withField("text", F.lit("said"))).select(*s.messages.columns)
    s.messages = d
    return s


def media_in(spark, tmp_path, talker):
    owner = __import__("hashlib").md5(talker.encode()).hexdigest()
    at = tmp_path / "in" / owner / "2024-01" / "Img"
    at.mkdir(parents=True)
    (at / f"{M1}.dat").write_bytes(b"image")
    files = spark.createDataFrame([(f"{at}/{M1}.dat",), ("/absent/d1/d2/../x.pdf",), ("/absent/d1/d2/x.pdf",)], "path string")
    links = spark.createDataFrame([(M1, "x.pdf", "d1", "d2")], "md5 string, file_name string, dir1 string, dir2 string")
    blobs = spark.createDataFrame([("4", b"four", "db")], "svr_id string, voice_data binary, db string")
    return files, links, blobs


def test_text_with_media(spark, tmp_path):
    s, at = with_media(spark, store(spark), "alice"), str(tmp_path / "out")
    told = s.export_to(at, "alice", "now", media_in=media_in(spark, tmp_path, "alice"), everything=True)
    out = joined(spark, f"{at}/conversation.txt")
    assert (told["messages"], told["media"]) == (8, 2)
    assert sorted(n for n in os.listdir(f"{at}/media") if not n.startswith(".")) == [f"{M1}.dat", "4.silk"]
    assert open(f"{at}/media/4.silk", "rb").read() == b"four" and open(f"{at}/media/{M1}.dat", "rb").read() == b"image"
    assert [out.count(x) for x in ("图片1（可在附件中查看）", "图片2（可在附件中查看）", "图片3", "语音1（可在附件中查看）", "语音2", "文件1", "\nsaid\n")] == [1, 1, 0, 1, 0, 0, 2]
    assert out.endswith(f"\n附件：\n\n[图片1] media/{M1}.dat\n\n[图片2] media/{M1}.dat\n\n[语音1] media/4.silk\n")
    errors = {r.task_kind: (r.n, r.failures) for r in told["errors"].collect()}
    assert errors["image"] == (1, [f"img:{M2}: nothing found"]) and errors["voice"] == (1, ["voi:5: nothing found"]) and errors["file"][0] == 1 and "copy: FileNotFoundError" in errors["file"][1][0]
    assert {r.tag: r.n for r in told["tags"].collect()} == {"silk_voice": 1}
    # Without media the text is that of export.txt, whatever was there before.
    told = s.export_to(at, "alice", "now", no_media=True, everything=True)
    assert joined(spark, f"{at}/conversation.txt") == s.export_text("alice", "now", everything=True)
    assert told["errors"] is None and told["media"] == 0


def test_json_and_empty(spark, tmp_path):
    s, at = with_media(spark, store(spark), "alice"), str(tmp_path / "out")
    s.export_to(at, "alice", "now", "json", media_in=media_in(spark, tmp_path, "alice"), limit=5)
    o = json.loads(joined(spark, f"{at}/conversation.json"))
    assert [i["server_id"] for i in o["items"]] == [1, 2, 3, 4, 5] and o["media_files"] == [f"media/{M1}.dat", "media/4.silk"]
    assert [i.get("media_files") for i in o["items"]] == [[f"media/{M1}.dat"]] * 2 + [None, ["media/4.silk"], None]
    assert o["paging"] == {"limit": 5, "offset": 0, "total": 8, "returned": 5, "has_more": True} and o["conversation"]["type"] == "private"
    none = s.export("alice", everything=True).limit(0)
    who = E.Names("alice", 'A "x"', "me")
    E.write(none, at, who, "now", "json")
    o = json.loads(joined(spark, f"{at}/conversation.json"))
    assert o["items"] == [] and o["conversation"] == {"talker": "alice", "display_name": 'A "x"', "type": "private", "message_count": 0}
    E.write(none, at, who, "now")
    columns = {c: F.lit(None).cast("string") for c in ("media_kind", "filename")}
    assert joined(spark, f"{at}/conversation.txt") == export.txt(none.withColumns(columns), 'A "x"', "me", False, "now")
    with pytest.raises(ValueError):
        E.write(none, at, who, "now", "html")


def test_names_that_leave_the_folder_are_not_written(spark, tmp_path):
    rows = [(n, "file", n, None, b"x") for n in ("../a", "a/b", "..", "", "fine")]
    got = {r.filename: r.reason for r in E.write_media(spark.createDataFrame(rows, "filename string, task_kind string, key string, path string, voice_data binary"), f"{tmp_path}/m").collect()}
    assert got == {n: "name leaves the folder" for n in ("../a", "a/b", "..", "")} | {"fine": None}
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["m"]
