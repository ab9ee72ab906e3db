"""Text functions of the chat model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave import schema as S

#: Character ranges that are split one by one for the index.
CJK = r"[\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"


def is_group(talker: Column) -> Column:
    return talker.endswith(S.GROUP_SUFFIX)


def group_sender(talker: Column, text: Column, sender: Column) -> tuple[Column, Column]:
    """(sender, text): in groups what stands before the first colon with a line end is the sender."""
    at = F.instr(text, ":\n")
    has = is_group(talker) & (at > 0)
    return F.when(has, F.substr(text, F.lit(1), at - 1)).otherwise(sender), F.when(has, F.substr(text, at + 2)).otherwise(text)


def group_summary(username: Column, summary: Column) -> Column:
    """Summary without a sender's prefix: in groups a first line that ends in a colon and has no space."""
    at = F.instr(summary, "\n")
    first = F.substr(summary, F.lit(1), at - 1)
    return F.when(is_group(username) & (at > 0) & first.endswith(":") & ~first.contains(" "), F.substr(summary, at + 1)).otherwise(summary)


def table_name(talker: Column) -> Column:
    return F.concat(F.lit("Msg_"), F.md5(talker.cast("binary")))


def full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_name(remark: Column, nick: Column, alias: Column, user: Column) -> Column:
    return F.coalesce(full(remark), full(nick), full(alias), user)


def display_with_id(name: Column, user: Column) -> Column:
    return F.when(name.isNotNull() & (name != user), F.concat(name, F.lit("（"), user, F.lit("）"))).otherwise(user)


def direction(sender: Column, own: str) -> Column:
    return F.when(sender == own, "outgoing").otherwise("incoming")


def session_direction(sender: Column, own: str) -> Column:
    trimmed = F.regexp_replace(sender, r"(?U)^\s+|\s+\z", "")
    return F.when(full(trimmed).isNotNull(), direction(trimmed, own))


def avatar(small: Column | None, big: Column | None) -> Column:
    parts = [full(c) for c in (small, big) if c is not None]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def cjk_split(c: Column) -> Column:
    """Spaces around each character of the ranges above, none at the end and no two in a row beside them."""
    spaced = F.regexp_replace(c, f"({CJK})", "$1 ")
    spaced = F.regexp_replace(spaced, f"(?<=[^ ])({CJK})", " $1")
    return F.regexp_replace(spaced, r"(?U)\s+\z", "")


def index_query(keyword: str) -> str:
    """Match expression of a keyword: its words as quoted phrases, all of which must match."""
    import re

    def split(word: str) -> str:
        out = ""
        for c in word:
            if re.match("[　-〿㐀-鿿豈-﫿＀-￯\U00020000-\U0002fa1f]", c):
                out += ("" if not out or out.endswith(" ") else " ") + c + " "
            else:
                out += c
        return out.rstrip()

    return " AND ".join('"' + split(w).replace('"', '""') + '"' for w in keyword.split())


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}_.-]", "_")


def month(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def short_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "y-M-d")


def clock(seconds: Column, pattern: str = "MM-dd HH:mm") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def is_month_dir(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])\z")


def is_account_like(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*\z")


def shard_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"message_([0-9]+)\.db$", 1), F.lit("")).cast("long")


# Magic bytes (hexadecimal) of media files, tested in this order.
MAGICS = (("wxgf", "77786766"), ("jpg", "FFD8FF"), ("png", "89504E47"), ("gif", "47494638"), ("tif", "49492A00"), ("bmp", "424D"))


def media_type(data: Column) -> Column:
    """Kind of a media file by its first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    c = F.when(head.startswith(MAGICS[0][1]), MAGICS[0][0]).when(webp, "webp")
    for name, magic in MAGICS[1:]:
        c = c.when(head.startswith(magic), name)
    return c.otherwise("unknown")
