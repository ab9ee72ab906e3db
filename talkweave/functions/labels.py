"""Codes and names of messages and contacts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave import schema as S

LOW = 0xFFFFFFFF


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    c = None
    by_name: dict[str, list[int]] = {}
    for k, v in names.items():
        by_name.setdefault(v, []).append(k)
    for v, ks in by_name.items():
        test = code.isin(ks)
        c = F.when(test, v) if c is None else c.when(test, v)
    return c.otherwise(other)


def msg_type(local_type: Column) -> Column:
    """Low 32 bits of a composite code."""
    return local_type.bitwiseAND(F.lit(LOW).cast("long"))


def sub_type(local_type: Column) -> Column:
    """High 32 bits of a composite code."""
    return F.shiftrightunsigned(local_type, 32)


def msg_type_label(code: Column) -> Column:
    return _named(code, S.MSG_TYPES, F.lit("unknown"))


def msg_sub_type_label(code: Column, sub: Column) -> Column:
    return F.when(code == S.APP, _named(sub, S.APP_SUB_TYPES, F.lit("app"))).otherwise(msg_type_label(code))


def app_display_label(sub: Column) -> Column:
    return _named(sub, S.APP_DISPLAY, F.concat(F.lit("app type="), sub.cast("string")))


def gender_label(code: Column) -> Column:
    return _named(code, S.GENDERS, F.lit("unknown"))


def source_scene_label(code: Column) -> Column:
    return _named(code, S.SOURCE_SCENES, F.concat(F.lit("场景码 "), code.cast("string")))


def parse_msg_type(name: str | None) -> int | None:
    """Code of a name or a number as text, case aside; None for anything else, which filters nothing."""
    if name is None:
        return None
    by_name = {v: k for k, v in S.MSG_TYPES.items()}
    if (low := name.lower()) in by_name:
        return by_name[low]
    digits = name.removeprefix("+")
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) <= LOW else None
