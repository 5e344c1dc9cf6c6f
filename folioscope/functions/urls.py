"""URL parts, canonical URLs and article identities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions.text import _c, filled, hash31

#: Query keys that name an article (fixed values).
IDENTITY_KEYS = ("__biz", "idx", "mid", "sn")


def host(u: Column | str) -> Column:
    return F.lower(F.try_parse_url(_c(u), F.lit("HOST")))


def path(u: Column | str) -> Column:
    return F.try_parse_url(_c(u), F.lit("PATH"))


def param(u: Column | str, key: str) -> Column:
    """Decoded value of a query key."""
    return F.try_url_decode(F.try_parse_url(_c(u), F.lit("QUERY"), F.lit(key)))


def sorted_query(u: Column | str, keys: tuple[str, ...] | None = None) -> Column:
    """key=value pairs sorted by key, equal keys in their order; only those of `keys` if given; null without any."""
    pairs = F.filter(F.split(F.try_parse_url(_c(u), F.lit("QUERY")), "&"), lambda p: p != "")
    if keys:
        pairs = F.filter(pairs, lambda p: F.split(p, "=")[0].isin(*keys))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p"))))
    return F.nullif(F.array_join(F.transform(keyed, lambda s: s["p"]), "&"), F.lit(""))


def canonical(u: Column | str, keys: tuple[str, ...] | None = None, https: bool = False) -> Column:
    """URL without fragment and user, host in lower case, sorted query; null if it cannot be parsed."""
    scheme = F.lit("https") if https else F.lower(F.try_parse_url(_c(u), F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(_c(u), F.lit("AUTHORITY")), r"(:\d+)$", 1)
    query = sorted_query(u, keys)
    plain = F.concat(scheme, F.lit("://"), host(u), port, F.when(path(u) == "", F.lit("/")).otherwise(path(u)))
    return F.when(query.isNotNull(), F.concat(plain, F.lit("?"), query)).otherwise(plain)


def article_key(account: Column | str, aid: Column | str) -> Column:
    return F.concat_ws(":", _c(account), _c(aid))


def message_of(aid: Column | str) -> Column:
    """An aid up to its last underscore, if that is not its first character."""
    cut = F.regexp_extract(_c(aid), r"^(.+)_[^_]*$", 1)
    return F.when(cut != "", cut).otherwise(_c(aid))


def positive(x: Column) -> Column:
    """Whether a text is a positive whole number that a double holds exactly."""
    return F.coalesce(x.rlike(r"^\d+$") & x.try_cast("long").between(1, (1 << 53) - 1), F.lit(False))


def message_id(u: Column | str) -> Column:
    return F.coalesce(filled(param(u, "mid")), param(u, "appmsgid"))


def item_index(u: Column | str) -> Column:
    return F.coalesce(filled(param(u, "idx")), param(u, "itemidx"))


def export_link(u: Column | str, allowed_host: str = "mp.weixin.qq.com") -> Column:
    """The canonical form of an https URL of the allowed host, without port and user; null for any other."""
    authority = F.lower(F.try_parse_url(_c(u), F.lit("AUTHORITY")))
    ok = (F.lower(F.try_parse_url(_c(u), F.lit("PROTOCOL"))) == "https") & authority.isin(allowed_host, f"{allowed_host}:443")
    return F.when(ok, F.regexp_replace(canonical(u), r"^(https://[^/]*):443(?=/|$)", "$1"))


def aid_of(link: Column | str) -> Column:
    """mid_idx of a canonical URL, or local-<hash of the URL>_idx without a positive mid; an idx that is no positive number is 1."""
    mid, idx = message_id(link), item_index(link)
    number = F.when(positive(idx), idx.try_cast("long")).otherwise(F.lit(1).cast("long")).cast("string")
    return F.when(positive(mid), F.concat_ws("_", mid, number)).otherwise(F.concat(F.lit("local-"), hash31(link).cast("string"), F.lit("_"), number))


def stable_identity(u: Column | str, allowed_host: str) -> Column:
    """biz:mid:idx of a URL of the allowed host's /s path with positive numbers; else null."""
    biz, mid, idx = (param(u, k) for k in ("__biz", "mid", "idx"))
    ok = F.try_parse_url(_c(u), F.lit("PROTOCOL")).isin("http", "https") & (host(u) == allowed_host) & path(u).isin("/s", "/s/") & mid.rlike(r"^[1-9]\d*$") & idx.rlike(r"^[1-9]\d*$") & (biz != "")
    return F.when(ok, F.concat_ws(":", biz, mid, idx))


def host_allowed(u: Column | str, hosts: tuple[str, ...]) -> Column:
    """Whether the host is one of `hosts` or below one."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host(u) == h) | host(u).endswith(f".{h}")
    return F.coalesce(out, F.lit(False))


def store_identity(links: Column, package: Column) -> Column:
    """Package id, else the store id in the first store link, else empty."""
    play = F.transform(F.filter(links, lambda u: host_allowed(u, ("play.google.com",))), lambda u: F.lower(F.coalesce(param(u, "id"), F.lit(""))))
    apple = F.transform(F.filter(links, lambda u: host_allowed(u, ("apps.apple.com",))), lambda u: F.regexp_extract(F.coalesce(path(u), F.lit("")), r"/id([1-9][0-9]*)(?:/|$)", 1))
    named = F.concat(F.filter(play, lambda x: x != ""), F.transform(F.filter(apple, lambda x: x != ""), lambda x: F.concat(F.lit("app-store:"), x)))
    return F.coalesce(F.nullif(F.lower(F.trim(package)), F.lit("")), F.get(named, F.lit(0)), F.lit(""))
