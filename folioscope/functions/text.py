"""Scalar functions over text, dates, hashes and labels, all as column expressions except title keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as browsers and Python see it: Unicode space, and the byte order mark.
SPACE = r"(?U)[\s﻿]+"
CJK = r"一-鿿"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often use names it: nested rules stay linear in size."""
    return F.transform(F.array(x), use)[0]


def filled(x: Column | str) -> Column:
    """x, or null where it is empty."""
    return F.nullif(_c(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[filled(x) for x in xs], F.lit(""))


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE, " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def title_key(x: Column | str) -> Column:
    """Compatibility-normalised title with collapsed white space."""
    return collapse(_nfkc(F.coalesce(_c(x), F.lit(""))))


def relaxed_title_key(x: Column | str) -> Column:
    """title_key in lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(title_key(x)), r"(?U)[\s\p{P}\p{S}]+", "")


def normal_date(x: Column | str) -> Column:
    """YYYY-MM-DD of a text that begins with a date by dashes or slashes, else empty."""
    at = F.regexp_extract(_c(x), r"^\s*(\d{4})[-/](\d{2})[-/](\d{2})", 0)
    return F.when(at != "", F.regexp_replace(F.trim(at), "/", "-")).otherwise(F.lit(""))


def date_slug(x: Column | str) -> Column:
    """YYYYMMDD of a text that begins with year, month and day, one digit or two; else empty."""
    pattern = r"^(\d{4})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})"
    y, m, d = (F.regexp_extract(F.coalesce(_c(x), F.lit("")), pattern, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.lit(""))


def publish_epoch(x: Column | str) -> Column:
    """Epoch second of a YYYY-MM-DD at 00:00 +08:00; null for other shapes and days that do not exist."""
    d = _c(x)
    day = F.try_to_date(d, "yyyy-MM-dd")
    ok = d.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.isNotNull()
    return F.when(ok, F.unix_date(day).cast("long") * 86400 - 8 * 3600)


def floor_epoch(x: Column | str, now: Column) -> Column:
    """A floor in seconds: a number in range, a date, else 366 days before now."""
    d = _c(x).cast("string")
    given = F.coalesce(F.when(d.rlike(r"^\d+$"), d.try_cast("long")), publish_epoch(d))
    return F.when((given > 0) & (given <= now), given).otherwise(now - 366 * 86400)


def seconds_from(x: Column | str) -> Column:
    """Seconds of an epoch that may be in milliseconds."""
    return F.when(_c(x) > 10_000_000_000, F.floor(_c(x) / 1000)).otherwise(_c(x)).cast("long")


def epoch_of(x: Column | str) -> Column:
    """Epoch second of a time without zone, whatever the session's zone is: rounded to milliseconds (halves away from zero), then cut off."""
    t = _c(x)
    minutes = (F.unix_date(t.cast("date")).cast("long") * 24 + F.hour(t)) * 60 + F.minute(t)
    # the seconds are decimals of six places, so that round() is exact
    milliseconds = F.round((minutes * 60 + F.date_part(F.lit("SECOND"), t)) * 1000).cast("long")
    return (milliseconds / 1000).cast("long")


def format_epoch(x: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(x)), "yyyy-MM-dd HH:mm:ss")


def format_elapsed(x: Column | str) -> Column:
    """Hours, minutes and seconds, without those that are zero."""
    s = _c(x).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("小时"))).otherwise(F.lit("")), F.when(m > 0, F.concat(m.cast("string"), F.lit("分"))).otherwise(F.lit("")))
    return F.when((r > 0) | (parts == ""), F.concat(parts, r.cast("string"), F.lit("秒"))).otherwise(parts)


def duration_seconds(x: Column | str) -> Column:
    """Seconds of m:ss; of h:mm:ss too the first two parts count, as minutes and seconds. Null and empty: 0."""
    parts = F.split(filled(x), ":")
    return F.coalesce(F.get(parts, F.lit(0)).try_cast("long") * 60 + F.get(parts, F.lit(1)).try_cast("long"), F.when(filled(x).isNull(), F.lit(0).cast("long")))


#: Labels of item kinds (fixed values).
ITEM_TYPES = {0: "普通图文", 5: "视频分享", 6: "音乐分享", 7: "音频分享", 8: "图片分享", 10: "文本分享", 11: "文章分享", 17: "短文"}
#: Kinds of accounts by their number (fixed values).
ACCOUNT_TYPES = {0: "订阅号", 1: "订阅号", 2: "服务号"}
UNKNOWN_ITEM = "未识别"


def labelled(x: Column | str, labels: dict, otherwise: str) -> Column:
    """The label of a key, as a chain that the optimiser sees."""
    out = F.lit(otherwise)
    for k, v in reversed(labels.items()):
        out = F.when(_c(x) == k, v).otherwise(out)
    return out


def item_type(x: Column | str) -> Column:
    return labelled(x, ITEM_TYPES, UNKNOWN_ITEM)


def ellipsis(x: Column | str, most: int = 35) -> Column:
    return F.when(F.char_length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit("..."))).otherwise(_c(x))


def safe_filename(x: Column | str) -> Column:
    return F.trim(F.left(F.regexp_replace(_c(x), r"[^一-龥a-zA-Z0-9()（）]", "_"), F.lit(100)))


def path_segment(x: Column | str, fallback: str, most: int) -> Column:
    """A directory name: control and reserved characters as dashes, collapsed white space, at most so many code points."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', "-")
    return F.left(first_filled(collapse(s), F.lit(fallback)), F.lit(most))


def hash31(x: Column | str) -> Column:
    """h * 31 + unit over the UTF-16 units of a text, in 32 bits unsigned; 0 becomes 1."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(_c(x), "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: F.pmod(a * 31 + u, F.lit(4294967296)))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def canonical_base64(x: Column | str) -> Column:
    """Whether a text is base64 as an encoder writes it."""
    return F.coalesce(F.base64(F.try_to_binary(_c(x), F.lit("base64"))) == _c(x), F.lit(False))


def slug(x: Column | str) -> Column:
    """Lower case, word characters, CJK and dashes kept, white space and underscores as one dash, 120 characters."""
    kept = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), rf"(?U)[^\w\s{CJK}-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_]+", "-"), F.lit(120))


def short_slug(x: Column | str) -> Column:
    """Lower case, anything but a-z, 0-9 and CJK as one dash, none at the ends, 60 characters."""
    kept = F.regexp_replace(F.lower(F.trim(_c(x))), rf"[^a-z0-9{CJK}]+", "-")
    return F.left(F.regexp_replace(kept, "^-+|-+$", ""), F.lit(60))


def quality_key(x: Column | str) -> Column:
    """Lower case, a-z, 0-9 and CJK alone."""
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), rf"[^a-z0-9{CJK}]+", "")


def stable_hash(length: int, *xs: Column) -> Column:
    """Leading hex digits of the SHA-256 of the values, one a line."""
    return F.left(F.sha2(F.concat_ws("\n", *[F.coalesce(x.cast("string"), F.lit("")) for x in xs]), 256), F.lit(length))


def distinct_filled(x: Column | str) -> Column:
    """Trimmed non-empty members in first-seen order."""
    return F.array_distinct(F.filter(F.transform(_c(x), lambda v: collapse_ends(v)), lambda v: v.isNotNull() & (v != "")))


def collapse_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def recency(ts: Column | str, now: Column | str) -> Column:
    """Today, Yesterday, 2 days ago, n days, 1 week ago, month/day or year/month/day of an epoch second."""
    t, day = _c(ts), (F.floor(_c(now) / 86400) * 86400).cast("long")
    year = F.unix_timestamp(F.date_trunc("year", F.timestamp_seconds(_c(now))))
    at = F.timestamp_seconds(t)
    return (
        F.when(t >= day, "Today")
        .when(t >= day - 86400, "Yesterday")
        .when(t >= day - 172800, "2 days ago")
        .when(t >= day - 518400, F.concat(F.floor((day - t) / 86400).cast("string"), F.lit("天前")))
        .when(t >= day - 1209600, "1 week ago")
        .when(t >= year, F.date_format(at, "MM/dd"))
        .otherwise(F.date_format(at, "yyyy/MM/dd"))
    )


#: Parts of a key that mark its value as sensitive (fixed values).
SENSITIVE = ("auth", "authorization", "cookie", "key", "passwd", "password", "secret", "session", "sessionid", "sid", "token", "uin", "uuid")


def redact(x: Column | str, mark: str = "[REDACTED]") -> Column:
    """Values of sensitive keys in query strings, key=value and key: value text give way to mark."""
    key = rf"(?:[A-Za-z0-9.-]*[_.-])?(?:{'|'.join(SENSITIVE)})(?:[_.-][A-Za-z0-9_.-]*)?|[A-Za-z0-9_.-]*(?:pass_ticket|wap_sid)[A-Za-z0-9_.-]*"
    quoted = F.regexp_replace(_c(x), rf"""(?i)(["'])({key})\1(\s*:\s*)(["']).*?\4""", f"$1$2$1$3$4{mark}$4")
    pairs = F.regexp_replace(quoted, rf"(?i)(^|[?&;,\s])({key})(\s*=\s*)[^&;,\s]*", f"$1$2$3{mark}")
    return F.regexp_replace(pairs, rf"(?i)(^|[,{{;\s])({key})(\s*:\s*)[^,}}\s]+", f"$1$2$3{mark}")


def format_bytes(x: Column | str) -> Column:
    """A size in B, KB, MB or GB with two decimals."""
    n = _c(x).cast("double")
    out = F.format_string("%.2f GB", n / (1 << 30))
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        out = F.when(n < size * 1024, F.format_string(f"%.2f {unit}", n / size)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", _c(x).cast("long"))).otherwise(out)


def content_hash(*names: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces, nulls as null."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


#: Word lists by which a region is guessed, first hit wins; and whether it is domestic (fixed values).
REGIONS = (
    (("oyun", "yazilim", "teknoloji", "taskin", "temel", "simsek", "yalcinkaya"), "土耳其", False),
    (("korzhov", "pidvirnyy", "ukraine", "ukr"), "乌克兰", False),
    (("러시아", "russian", "matryoshka"), "俄罗斯", False),
    (("brasil", "brazil", "wildlife"), "巴西", False),
    (("korea", "korean", ".kr", "wemade", "netmarble", "devsisters", "com2us", "111%", "risingwings", "treenod", "doublegames", "doubleugames"), "韩国", False),
    (("finland", "oy", "metacore", "rovio", "small giant"), "芬兰", False),
    (("japan", "japanese", "square enix", "株式会社"), "日本", False),
    (("france", "french", "voodoo", "homa", "ketchapp"), "法国", False),
    (("vietnam", "vietnamese", "viet", "gplay jsc"), "越南", False),
    (("hong kong", "hk", "limited", "holdings"), "可能香港/中国", None),
    (("beijing", "shanghai", "shenzhen", "guangzhou", "hangzhou", "chengdu", "china", "中国", "北京", "上海", "深圳"), "中国", True),
)

#: The wider lists of another importer (fixed values).
REGIONS_WIDE = (
    (("oyun", "yazilim", "sirketi", "teknoloji"), "土耳其", False),
    (("korea", "korean", "wemade", "netmarble", "kakaogames", "ncsoft", "neowiz", "com2us"), "韩国", False),
    (("finland", "oy ", "rovio", "metacore", "supercell"), "芬兰", False),
    (("japan", "japanese", "square enix", "kabam", "gumi", "gungho"), "日本", False),
    (("france", "french", "voodoo", "homa", "ketchapp", "ubisoft"), "法国", False),
    (("vietnam", "viet", "vng", "gplay jsc"), "越南", False),
    (("brazil", "brasil", "wildlife"), "巴西", False),
    (("russia", "russian", "matryoshka", "noodlecake", "belka"), "俄罗斯", False),
    (("sweden", "swedish", "g5 entertainment", "king ab"), "瑞典", False),
    (("usa", "united states", "inc.", "llc", "corp.", "electronic arts", "zynga", "supercent", "scopely", "jam city"), "美国", False),
    (("beijing", "shanghai", "shenzhen", "guangzhou", "hangzhou", "chengdu", "nanjing", "china"), "中国", True),
    (("zplay", "dhgames", "funplus", "lilith", "igg", "centurygames", "topgames", "tap4fun", "4399"), "中国", True),
    (("limited", "holding", "pte. ltd.", "co., ltd"), "可能香港/中国/新加坡", None),
)


def region(x: Column | str, rules: tuple = REGIONS) -> Column:
    """Struct (region, domestic) of the first word list with a hit."""
    low = F.lower(_c(x))
    out = F.struct(F.lit("未知").alias("region"), F.lit(None).cast("boolean").alias("domestic"))
    for words, name, domestic in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.struct(F.lit(name).alias("region"), F.lit(domestic).cast("boolean").alias("domestic"))).otherwise(out)
    return out
