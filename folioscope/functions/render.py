"""Parsed articles as HTML by their kind, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions.text import _c, filled, first_filled

#: What a paid article shows in place of its content (fixed values).
PREVIEW = "mp-pay-preview-filter"
PAID, PAID_HINT, YUAN, COINS = "付费", "本文为付费文章，完整内容需购买后查看", "元", "微币"
PICTURE = "图"


def escape_html(x: Column | str) -> Column:
    out = F.coalesce(_c(x), F.lit(""))
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def text_section(name: str, x: Column | str) -> Column:
    """A text as a section of HTML: escaped, line breaks kept."""
    body = F.regexp_replace(escape_html(x), "\r?\n", "<br />")
    return F.concat(F.lit(f'<section class="{name}">\n<p class="text_content">'), body, F.lit("</p>\n</section>"))


def _number(x: Column) -> Column:
    """A number as JavaScript prints it, without a fraction of zero."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def paid_section(info: Column) -> Column:
    """The notice of a paid article: price (fee in hundredths, coins, or none) and description."""
    fee, coins = info["fee"], info["wecoin_amount"]
    price = F.when(F.coalesce(fee, F.lit(0)) != 0, F.concat(_number(fee / 100), F.lit(f" {YUAN}"))).when(F.coalesce(coins, F.lit(0)) != 0, F.concat(coins.cast("string"), F.lit(f" {COINS}"))).otherwise(PAID)
    told = F.regexp_replace(escape_html(info["desc"]), "\r?\n", "<br />")
    shown = F.when(told != "", F.concat(F.lit('<div class="pay_subscribe_desc">'), told, F.lit("</div>"))).otherwise("")
    return F.concat(F.lit(f'<section class="pay_subscribe_notice">\n<div class="pay_subscribe_badge">{PAID}内容 · '), price, F.lit("</div>\n"), shown, F.lit(f'\n<div class="pay_subscribe_hint">{PAID_HINT}</div>\n</section>'))


def picture_section(content: Column, pictures: Column) -> Column:
    """A picture article: its text with links to the pictures, and the pictures in order."""
    body = F.replace(F.coalesce(content, F.lit("")), F.lit("\n"), F.lit("<br />"))
    refers = rf'(<a class="wx_img_refer_link" data-seq="(\d+)" data-refer="{PICTURE}\2" style="[^"]*")>(\s*{PICTURE}\2\s*</a>)'
    linked = F.regexp_replace(body, refers, rf'$1 href="#{PICTURE}$2">$3')

    def shown(item: Column, i: Column) -> Column:
        n = F.concat(F.lit(PICTURE), (i + 1).cast("string"))
        address = escape_html(F.replace(item["cdn_url"], F.lit("&amp;"), F.lit("&")))
        return F.concat(F.lit('<div class="picture_item" id="'), n, F.lit('">\n    <img class="picture_item_img" src="'), address, F.lit('" alt="'), n, F.lit('" />\n    <p class="picture_item_label">'), n, F.lit("</p>\n</div>"))

    listed = F.array_join(F.transform(F.coalesce(pictures, F.array().cast("array<struct<cdn_url:string>>")), shown), "\n")
    return F.concat(F.lit('<section class="item_show_type_8">\n<p class="text_content">'), linked, F.lit('</p>\n<div class="picture_content">'), listed, F.lit("</div>\n</section>"))


def article_section(content: Column, title: Column) -> Column:
    """A plain article: lazy images get their address, heights go; without text and images the title stands for it."""
    def drawn(x: Column) -> Column:
        lazy = F.regexp_replace(x, r"""(?i)(<img\b[^>]*?)\ssrc=(?:"[^"]*"|'[^']*')([^>]*\sdata-src=)""", "$1$2")
        named = F.regexp_replace(lazy, r"""(?i)(<img\b[^>]*?)\sdata-src=("[^"]+"|'[^']+')""", '$1 src=$2 loading="eager"')
        return F.regexp_replace(named, r"""(?i)(<img\b[^>]*?)\sheight=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "$1")

    body = drawn(F.coalesce(content, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", ""), r"(?U)[\s\x{A0}]+|&nbsp;", "")
    empty = (bare == "") & ~body.rlike(r"(?i)<img\b") & filled(title).isNotNull()
    return F.when(empty, text_section("item_show_type_0", title)).otherwise(F.concat(F.lit('<section class="item_show_type_0">'), body, F.lit("</section>")))


def article_html(row: Column) -> Column:
    """HTML of a parsed page by its kind (0 article, 8 pictures, 10 text); paid ones that hold a placeholder show their notice."""
    content, kind = row["content_noencode"], row["item_show_type"]
    hidden = F.trim(F.coalesce(content, F.lit("")))
    paid = (row["is_pay_subscribe"] == 1) & ((hidden == "") | hidden.contains(PREVIEW))
    told = first_filled(row["text_page_info"]["content_noencode"], row["title"])
    return (
        F.when(F.coalesce(paid, F.lit(False)), paid_section(row["pay_subscribe_info"]))
        .when(kind == 8, picture_section(content, row["picture_page_info_list"]))
        .when(kind == 10, text_section("item_show_type_10", told))
        .when(kind == 0, article_section(content, row["title"]))
        .otherwise("(unknown)")
    )
