"""Types, limits and code tables of the chat model."""

from __future__ import annotations

from pyspark.sql import types as T

MAX_LIMIT = 20_000
DEFAULT_LIMIT = 1_000
DEFAULT_CONTEXT = 50
MAX_LONG = 2**63 - 1
GROUP_SUFFIX = "@chatroom"
PASS_THROUGH_PREFIX = "wxid_"
PASS_THROUGH_IDS = ("filehelper",)
HIDDEN_SUMMARY = "[消息已隐藏]"

# Primary message codes.
MSG_TYPES = {1: "text", 3: "image", 34: "voice", 43: "video", 47: "emoji", 48: "location", 49: "app", 10000: "system", 10002: "revoke"}
TEXT, IMAGE, VOICE, VIDEO, EMOJI, LOCATION, APP, SYSTEM, REVOKE = MSG_TYPES

# Labels of the sub types of app messages.
APP_SUB_TYPES = {
    1: "text_share",
    2: "image_share",
    3: "audio_share",
    4: "video_share",
    5: "link",
    6: "file",
    7: "webview",
    8: "gif",
    10: "location_sharing",
    13: "brand",
    14: "chat_log_backup",
    15: "chat_log_migrate",
    16: "card_ticket",
    17: "realtime_location",
    19: "merged_messages",
    21: "mini_program_promo",
    24: "note",
    33: "mini_program",
    35: "message_history",
    36: "mini_program",
    40: "channel_forward",
    44: "channel_live_product",
    51: "channel_video",
    53: "group_chat_reference",
    57: "quote",
    62: "pat",
    63: "channel_live",
    74: "channel_files",
    87: "group_announcement",
    88: "group_note",
    92: "music",
    100: "sticker_set",
    101: "ad",
    107: "open_link",
    113: "video_account_intro",
    116: "channel_show_card",
    117: "channel_product",
    124: "wechat_gift",
    2000: "transfer",
    2001: "red_envelope",
    2003: "red_envelope_cover",
}

# Display labels of app messages that have no variant of their own.
APP_DISPLAY = {
    1: "文本分享",
    2: "图片分享",
    3: "音频分享",
    7: "网页应用",
    8: "GIF表情",
    10: "位置共享",
    13: "品牌消息",
    14: "聊天备份",
    15: "聊天迁移",
    16: "卡券",
    17: "实时位置",
    21: "小程序推广",
    24: "笔记",
    35: "消息历史",
    40: "视频号转发",
    44: "直播商品",
    53: "群聊引用",
    74: "视频号文件",
    87: "群公告",
    88: "群笔记",
    100: "表情包",
    101: "广告",
    107: "微信链接",
    113: "视频号名片",
    116: "视频号橱窗",
    117: "视频号商品",
    124: "微信礼物",
    2003: "红包封面",
}

# Which variant an app sub type is read as; all others are AppGeneric.
APP_KINDS = {4: "Link", 5: "Link", 7: "Link", 92: "Link", 6: "File", 33: "MiniProgram", 36: "MiniProgram", 19: "MergedMessages", 57: "Quote", 2000: "Transfer", 2001: "RedEnvelope", 2003: "RedEnvelope", 51: "ChannelVideo", 63: "ChannelVideo", 62: "Pat"}
KINDS = {TEXT: "Text", IMAGE: "Image", VOICE: "Voice", VIDEO: "Video", EMOJI: "Emoji", LOCATION: "Location", SYSTEM: "System", REVOKE: "Revoke"}

_S, _L = T.StringType(), T.LongType()
#: One wide struct for all variants of a message body; content_kind says which fields a variant has.
CONTENT = T.StructType([
    *(T.StructField(c, _S) for c in ("text", "md5")),
    T.StructField("sub_type", _L),
    *(T.StructField(c, _S) for c in ("title", "des", "url", "file_ext")),
    T.StructField("file_size", _L),
    *(T.StructField(c, _S) for c in ("reply_text", "refer_sender", "refer_content")),
    T.StructField("refer_type", _L),
    *(T.StructField(c, _S) for c in ("amount_desc", "pay_memo")),
    T.StructField("pay_sub_type", _L),
    T.StructField("raw_xml", _S),
    T.StructField("unknown_type", _L),
])
#: Decoded messages, the table that queries read. Written by month and clustered by (talker, sort_seq).
MESSAGE = T.StructType([
    *(T.StructField(c, _L) for c in ("sort_seq", "server_id", "msg_type", "sub_type")),
    *(T.StructField(c, _S) for c in ("sender", "talker")),
    T.StructField("create_time", _L),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_kind", _S),
    T.StructField("content", CONTENT),
])
#: Rows as they are stored, before decoding.
RAW_MESSAGE = T.StructType([
    *(T.StructField(c, _S) for c in ("shard", "table_name")),
    *(T.StructField(c, _L) for c in ("sort_seq", "server_id", "local_type", "real_sender_id", "create_time")),
    *(T.StructField(c, T.BinaryType()) for c in ("message_content", "packed_info_data", "compress_content")),
    T.StructField("codec", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
])
SESSION = T.StructType([T.StructField("username", _S), T.StructField("sort_timestamp", _L), T.StructField("summary", _S), T.StructField("last_msg_type", _L), T.StructField("last_msg_sender", _S), T.StructField("last_sender_display_name", _S)])
CONTACT = T.StructType([
    *(T.StructField(c, _S) for c in ("user_name", "alias", "remark", "nick_name", "memo", "phone", "signature", "region", "avatar_url")),
    T.StructField("gender", _L),
    T.StructField("source_scene", _L),
    T.StructField("labels", T.ArrayType(_S)),
])
MEMBER = T.StructType([T.StructField("user_name", _S), T.StructField("display_name", _S)])
CHATROOM = T.StructType([T.StructField("username", _S), T.StructField("owner", _S), T.StructField("members", T.ArrayType(MEMBER))])

# Genders and the ways a contact was added.
GENDERS = {1: "male", 2: "female"}
SOURCE_SCENES = {1: "通过QQ号添加", 3: "通过微信号添加", 6: "通过手机号添加", 10: "通过名片添加", 14: "通过群聊添加", 30: "通过扫一扫添加"}
