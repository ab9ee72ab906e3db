"""Fields of XML-like message bodies, found by the first opening and the first closing tag after it.

Plain Column expressions: bodies may be malformed, so nothing parses them, and nothing fails. No expression is repeated
inside another, as the code that Spark generates for all kinds of bodies must stay below 64 KB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CDATA = r"(?s)^<!\[CDATA\[(.*)\]\]>\z"
#: What stands for quoted media.
QUOTED_IMAGE, QUOTED_VIDEO, QUOTED_EMOJI = "[图片]", "[视频]", "[表情]"
# Entities in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def empty_as_null(c: Column) -> Column:
    return without(c, "")


def without(c: Column, value: str) -> Column:
    """Null for that value; other than nullif, c is evaluated in one place."""
    return F.get(F.array_remove(F.array(c), F.lit(value)), F.lit(0))


def _block(xml: Column, tag: str) -> Column:
    """What stands between the first <tag> and the first </tag> after it; empty if there is no such pair, and in it no tag is found."""
    return F.regexp_extract(xml, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def _unwrapped(c: Column) -> Column:
    return F.regexp_replace(c, CDATA, "$1")


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def tag_text(xml: Column, tag: str) -> Column:
    """Unescaped text of the first <tag>, without a CDATA wrapper; null if missing or empty."""
    return unescape(empty_as_null(_unwrapped(_block(xml, tag))))


def shown_text(xml: Column, tag: str) -> Column:
    """tag_text() of a display field, where the word null means nothing."""
    return without(tag_text(xml, tag), "null")


def unsigned(c: Column, most: int) -> Column:
    """A whole number of digits alone, null for all else or above most."""
    n = F.try_to_number(F.regexp_extract(c, r"^\+?([0-9]+)\z", 1), F.lit("9" * 20))
    return F.when(n <= F.lit(most), n.cast("long"))


def quote_sender(xml: Column) -> Column:
    """Id of the quoted message's sender: in groups chatusr, else fromusr."""
    block = _block(xml, "refermsg")
    return F.coalesce(tag_text(block, "chatusr"), tag_text(block, "fromusr"))


def quote_parts(xml: Column) -> tuple[Column, Column]:
    """The quoted block and what was quoted, as columns that quote_fields() takes."""
    block = _block(xml, "refermsg")
    return block, tag_text(block, "content")


def quote_fields(xml: Column, block: Column, content: Column) -> dict[str, Column]:
    """Fields of a quote; block and content: quote_parts(), best as columns of their own, as they are used again and again."""
    kind = unsigned(tag_text(block, "type"), 2**32 - 1)
    shown = (
        F.when((kind == 49) & content.contains("<appmsg"), F.coalesce(tag_text(content, "title"), content))
        .when((kind == 3) & content.contains("<img"), QUOTED_IMAGE)
        .when((kind == 43) & content.contains("<videomsg"), QUOTED_VIDEO)
        .when((kind == 47) & content.contains("<emoji"), QUOTED_EMOJI)
        .otherwise(content)
    )
    return {"reply_text": tag_text(xml, "title"), "refer_sender": F.coalesce(tag_text(block, "displayname"), tag_text(block, "fromusr")), "refer_content": shown, "refer_type": kind}


def transfer_fields(xml: Column) -> dict[str, Column]:
    block = _block(xml, "wcpayinfo")
    return {"amount_desc": tag_text(block, "feedesc"), "pay_memo": tag_text(block, "pay_memo"), "pay_sub_type": unsigned(tag_text(block, "paysubtype"), 2**32 - 1)}


def file_fields(xml: Column) -> dict[str, Column]:
    return {"title": tag_text(xml, "title"), "file_ext": tag_text(xml, "fileext"), "file_size": unsigned(tag_text(xml, "totallen"), 2**63 - 1), "md5": tag_text(xml, "md5")}


def system_text(c: Column) -> Column:
    """Readable text of a recall notice; all other system messages as they are."""
    recall = c.contains("<sysmsg") & (c.contains('type="revokemsg"') | c.contains("type='revokemsg'"))
    return F.coalesce(F.when(recall, tag_text(_block(c, "revokemsg"), "content")), c)


def indexed_fields(xml: Column) -> Column:
    """Title and description as the search index takes them: trimmed, not unescaped, on lines of their own; '' if neither."""

    def field(tag: str) -> Column:
        return _trimmed(_unwrapped(_trimmed(_block(xml, tag))))

    return F.array_join(F.array_remove(F.array(field("title"), field("des")), F.lit("")), "\n")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
