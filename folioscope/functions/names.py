"""Rules over names and lines: noise, suspicious names, publishers, fields and candidates, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from folioscope.functions.text import _c, bind

# The word lists and patterns that decide what is a product name.
NOISE_EXACT = ("merge", "rpg", "rpg类", "slg", "slg类", "竞技对战", "天天射击")
NOISE_PREFIXES = (
    "发行商", "差异点", "锐评", "素材侧", "素材上", "目前素材", "目前游戏", "游戏内", "本作", "后续", "预测", "粗略预估",
    "玩家", "如果", "随着", "通过", "即", "把", "收集资源", "建造", "画风", "白天", "弹幕", "极其重视",
)
NOISE_PARTS = (
    "原创不易", "下次不迷路", "可以保持关注", "心流", "商业化内容", "大地图玩法", "核心玩法", "低成本理解钩子",
    "用户更追求", "留存", "数值碾压", "模拟经营+slg", "战斗副玩法", "轻量副玩法",
)
OLD_NOISE_PARTS = ("的", "是", "了", "在", "也", "以上", "比如")
LABEL_START = r"^(发行商|开发商|平台|链接|亮点|差异点|锐评)\s*[：:]"
SENTENCE_WORDS = r"(我们|玩家|产品|游戏|可以|通过|目前|因此|如果|以及|整体|主要)"
EXCLUDED = (
    "新游", "冒泡", "观察", "总结", "前置", "小结", "番外", "附链接", "视频", "比如", "以下", "注意", "Tips", "另外", "即将", "期待", "例如",
    "回归", "更新", "上线", "测试", "上架", "发布", "以及", "点评", "综合", "观感", "体验", "分析", "整体", "感受",
)
COMPANY = r"(?i)\b(Ltd|Limited|Studio|Inc|Corp|LLC|Publishing|Entertainment|Network|Software|Co\.)\b"
FIELDS = {
    "publishers": ("发行商", "发行公司", "出版商", "厂商", "游戏公司"),
    "developers": ("开发商", "研发商"),
    "platforms": ("平台", "上线平台", "发布平台"),
    "links": ("链接", "产品链接", "商店链接", "下载链接"),
    "highlights": ("亮点", "产品亮点"),
    "differences": ("差异点", "差异化", "差异"),
    "critique": ("锐评", "点评", "评价"),
    "description": ("简介", "描述", "产品描述", "玩法", "核心玩法", "游戏类型"),
}
NAME_LABELS = ("产品名", "产品名称", "游戏名", "游戏名字", "游戏名称")
HEADINGS = (
    "产品", "产品列表", "游戏", "游戏列表", "新游", "新游列表", "本期产品", "本期新游", "正文", "前言", "总结", "小结", "结语", "其他", "其它",
    "亮点", "产品亮点", "差异点", "差异化", "锐评", "点评", "平台", "链接", "发行商", "开发商", "基础信息", "项目信息", "产品信息", "游戏信息",
    "Merge", "RPG", "SLG",
)
UNKNOWN, CONFLICT = "未知", "冲突待审"
ENTITIES = {
    "海彼 (Habby)": "上海海彼网络科技有限公司（Habby）",
    "111%": "111% Inc.（中国）",
    "Voodoo": "Voodoo（法国，合作商多为中国团队）",
    "Voodoo (Rollic)": "Voodoo Rollic（土耳其/Voodoo系）",
    "Voodoo (Rivvy)": "Voodoo Rivvy（Voodoo系）",
    "点点互动 (Dian Dian)": "点点互动（中国）",
    "游族网络": "游族网络股份有限公司（上海，A股 002174）",
    "卓航互动": "成都卓杭网络科技（DHGames）",
    "西安墨焰": "西安墨焰网络科技有限公司",
    "功夫特牛 / PeakX": "PeakX Games（功夫特牛，中国独立工作室）",
    "哈喽沃德 (Hello World)": "武汉哈乐沃德网络科技有限公司",
    "IGG": "IGG Inc.（互动游戏，香港上市 0799.HK）",
    "Supercell": "Supercell（芬兰，腾讯控股84%）",
    "Lion Studios": "Lion Studios（美国/AppLovin系）",
    "Homa Games": "Homa Games（法国）",
    "网易 (NetEase)": "网易公司（Mattel163 Limited）",
    "莉莉丝 (Lilith)": "上海莉莉丝科技股份有限公司（Lilith Games）",
    "波克城市 (Bokul)": "波克城市（中国）",
    "途游游戏": "途游游戏（中国）",
    "凉屋游戏": "凉屋游戏（中国）",
    "重力社": "重力社（中国）",
    "壳木软件": "壳木软件（中国）",
    "益世界": "益世界（中国）",
    "FunPlus": "FunPlus International AG（趣加，中国）",
    "多益网络": "多益网络（中国）",
    "智明星通": "智明星通（中国）",
    "超燃互动": "超燃互动（中国）",
    "4399": "4399（中国）",
    "魔兔游戏": "魔兔游戏（中国）",
    "育碧 (Ubisoft)": "育碧（法国）",
    "Square Enix": "Square Enix（日本）",
    "Tap4Fun": "成都创人所爱科技股份有限公司（Tap4Fun）",
    "Fansipan": "Fansipan（越南）",
    "Codigame": "Codigame（海外）",
    "SayGame": "SayGame（中国）",
    "王铲铲工作室": "王铲铲工作室（中国独立）",
}
ENDINGS = r"[。，；：:]$"
CJK_CHAR = r"[一-鿿]"
WIDE_GAP = r"[ \t 　]{2,}"
#: The characters of (?U)\s, for trimming: a pattern looks at each white space of a text, btrim() at its ends alone.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: How a line begins that is a heading or has a number in front, or is Latin words alone.
MAY_NAME = r"^(?U:\s)*(?:#{2,4}\s|\d|[A-Z][A-Za-z0-9][A-Za-z0-9\s:!&\-'.]{2,55}(?U:\s)*$)"


def _any(x: Column, words: tuple[str, ...], how: str) -> Column:
    """Whether x contains, or starts with, one of the words, as a single pattern."""
    start = "^" if how == "startswith" else ""
    return x.rlike(start + "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")


def _cjk(x: Column) -> Column:
    return F.regexp_count(x, F.lit(CJK_CHAR))


def is_noise(x: Column | str) -> Column:
    """Whether a name is no product's: too short or long, a listed word, beginning or part, a label or a sentence."""
    return bind(F.coalesce(_c(x), F.lit("")), lambda name: bind(F.lower(F.regexp_replace(name, r"(?U)\s+", "")), lambda plain: _noise(name, plain)))


def _noise(name: Column, plain: Column) -> Column:
    size = F.char_length(name)
    sentence = (_cjk(name) >= 12) & name.rlike(SENTENCE_WORDS)
    return (size < 2) | (size > 60) | plain.isin(*NOISE_EXACT) | _any(plain, NOISE_PREFIXES, "startswith") | _any(plain, NOISE_PARTS, "contains") | name.rlike(ENDINGS) | name.rlike(LABEL_START) | sentence


def is_noise_old(x: Column | str) -> Column:
    """The older, broader rule: any of seven common words marks noise."""
    def noise(name: Column) -> Column:
        return (F.char_length(name) < 2) | (F.char_length(name) > 60) | _any(name, OLD_NOISE_PARTS, "contains") | name.rlike("[。：:]$")

    return bind(F.coalesce(_c(x), F.lit("")), noise)


def clean_value(x: Column | str) -> Column:
    """Text without list marks, heading marks, emphasis and surrounding white space."""
    def clean(text: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(WHITE)), r"^\s*[-+*]\s+", ""), r"^#{1,6}\s+", "")
        # few texts have emphasis, and only those are searched for it
        plain = F.when(text.contains("**") | text.contains("__"), F.regexp_replace(s, r"\*\*|__", "")).otherwise(s)
        return F.btrim(F.btrim(plain, F.lit(WHITE)), F.lit("*` \t"))

    return bind(F.coalesce(_c(x), F.lit("")), clean)


def field_key(label: Column) -> Column:
    def key_of(plain: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, labels in FIELDS.items():
            out = F.when(plain.isin(*labels), key).otherwise(out)
        return out

    return bind(F.regexp_replace(clean_value(label), r"(?U)[\s*：:]", ""), key_of)


def field_line(x: Column | str) -> Column:
    """Struct (key, value) of a `label: value` line with a known label, else null."""
    pattern = r"^([^：:]{1,16})\s*[：:]\s*(.*?)\s*$"

    def parse(line: Column) -> Column:
        value = clean_value(F.regexp_extract(line, pattern, 2))
        return bind(field_key(F.regexp_extract(line, pattern, 1)), lambda key: F.when(key.isNotNull(), F.struct(key.alias("key"), value.alias("value"))))

    # a label ends in a colon: lines without one are not taken apart
    return F.when(F.coalesce(_c(x), F.lit("")).rlike("[：:]"), bind(clean_value(x), parse))


def is_heading(x: Column | str) -> Column:
    """Whether a text is a chapter heading: a generic one, a label, a number, a genre or a round-up."""
    return bind(F.lower(F.regexp_replace(F.regexp_replace(clean_value(x), r"^[.。]+|[.。]+$", ""), r"(?U)\s+", "")), _heading)


def _heading(plain: Column) -> Column:
    return (
        plain.isin(*[re.sub(r"\s+", "", h).lower() for h in HEADINGS])
        | field_key(plain).isNotNull()
        | plain.rlike(r"^(?:第)?[一二三四五六七八九十百0-9]+(?:[章节部分、.．):：]|$)")
        | plain.rlike(r"(?i)^[a-z0-9+#-]{2,16}类$")
        | plain.rlike(r"^(?:本期|今日|近期|一周|每周).*(?:汇总|盘点|观察|总结|推荐)$")
    )


def suspicious(x: Column | str) -> Column:
    """Reasons for which a product name is doubted, in a fixed order."""
    return bind(clean_value(x), _doubts)


def _doubts(name: Column) -> Column:
    size, cjk = F.char_length(name), _cjk(name)
    tags = (
        ("invalid_length", (size < 2) | (size > 80)),
        ("chapter_heading", is_heading(name)),
        ("metadata_label", field_line(name).isNotNull() | name.rlike(LABEL_START)),
        ("sentence_punctuation", name.rlike(ENDINGS)),
        ("sentence_question", name.rlike("[?？]$") & (cjk >= 3)),
        ("url", name.rlike(r"(?i)https?://|www\.")),
        ("inline_publisher_suffix", name.rlike(WIDE_GAP)),
        ("sentence_like", (cjk >= 10) & name.rlike(SENTENCE_WORDS)),
    )
    return F.filter(F.array(*[F.when(hit, F.lit(tag)) for tag, hit in tags]), lambda t: t.isNotNull())


def is_plausible(x: Column | str) -> Column:
    return bind(clean_value(x), lambda name: (F.size(suspicious(name)) == 0) & ~_any(name, EXCLUDED, "contains") & ~name.rlike(COMPANY))


def candidate(x: Column | str) -> Column:
    """Struct (name, publisher) of a line that names a product: labelled, bold, heading, columns or a Latin title; else null."""
    raw = F.coalesce(_c(x), F.lit(""))
    line = F.btrim(raw, F.lit(WHITE))
    return F.when(_may_name(raw), bind(line, lambda line: bind(clean_value(line), lambda cleaned: _candidate(line, cleaned))))


def _may_name(line: Column) -> Column:
    """Whether a line holds what one that names a product has at least: a colon, emphasis, a heading, a number in front, a wide gap, or Latin words alone."""
    wide = line.contains("  ") | line.contains("\t") | line.contains("\u00a0") | line.contains("\u3000")
    return line.contains(":") | line.contains("：") | line.contains("*") | line.rlike(MAY_NAME) | (wide & line.rlike(rf"\S{WIDE_GAP}"))


def _found(name: Column, publisher: Column | None = None, ok: Column | None = None) -> Column:
    told = F.lit(None).cast("string") if publisher is None else publisher
    return bind(name, lambda n: F.when((F.lit(True) if ok is None else ok) & is_plausible(n), F.struct(n.alias("name"), told.alias("publisher"))))


def _columned(value: Column, numbered: Column) -> Column:
    """The product of a line of columns: name and publisher, apart by a wide gap, or a numbered name."""
    def parse(columns: Column) -> Column:
        name, second = clean_value(columns[0]), clean_value(F.coalesce(F.get(columns, F.lit(1)), F.lit("")))
        return bind(second, lambda p: bind(name, lambda n: _found(n, F.nullif(p, F.lit("")), fits(columns, n, p))))

    def fits(columns: Column, name: Column, publisher: Column) -> Column:
        short = (F.char_length(publisher) <= 80) & ~publisher.rlike(r"(?i)https?://|www\.") & ~publisher.rlike("[。，；！!？?]$")
        return (numbered | (F.size(columns) > 1)) & (name != "") & ((publisher == "") | short)

    return bind(F.split(value, WIDE_GAP, 2), parse)


def _candidate(line: Column, cleaned: Column) -> Column:
    none = F.lit(None).cast("struct<name:string,publisher:string>")
    labelled_at = r"^([^：:]{1,16})\s*[：:]\s*(.+?)\s*$"
    label = F.regexp_replace(clean_value(F.regexp_extract(cleaned, labelled_at, 1)), r"(?U)\s+", "")
    labelled = clean_value(F.regexp_extract(cleaned, labelled_at, 2))
    bold_at, heading_at = r"^\*{1,2}(?:\d+[.、]\s*)?(.+?)\*{1,2}[.。]?$", r"^#{2,4}\s+(.+?)\s*$"
    number = F.regexp_extract(line, r"^\s*\d+\s*(?:\\\.|[.．、])\s*(.+?)\s*$", 1)
    inline = bind(number, lambda n: _columned(F.when(n != "", n).otherwise(line), n != ""))
    latin = _found(cleaned, None, line.rlike(r"^[A-Z][A-Za-z0-9][A-Za-z0-9\s:!&\-'\.]{2,55}$"))
    marked = (
        F.when(label.isin(*NAME_LABELS), labelled)
        .when(line.rlike(bold_at), clean_value(F.regexp_extract(line, bold_at, 1)))
        .when(line.rlike(heading_at), clean_value(F.regexp_extract(line, heading_at, 1)))
    )
    chosen = bind(marked, lambda name: F.when(name.isNotNull(), _found(name)).otherwise(F.coalesce(inline, latin)))
    return F.when((line == "") | field_line(line).isNotNull(), none).otherwise(chosen)


def split_values(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[、,，|；;]+"), clean_value), lambda v: v != "")


def detect(x: Column | str, rules: list[tuple[str, str]], words: dict[str, str] | None = None) -> Column:
    """Name of the first rule whose pattern hits, else of the first word that a text holds in any case, else null.

    Rules are literals of a chain, not rows of a join: their order is their rank.
    """
    def name_of(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, name in reversed((words or {}).items()):
            out = F.when(F.lower(text).contains(word.lower()), name).otherwise(out)
        for pattern, name in reversed(rules):
            out = F.when(text.rlike(pattern), name).otherwise(out)
        return out

    return bind(_c(x), name_of)


def publishers_of(x: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The detected publisher alone, else the parts of the value."""
    return bind(clean_value(x), lambda value: bind(detect(value, rules), lambda known: F.when(known.isNotNull(), F.array(known)).otherwise(split_values(value))))


def resolve(names: Column) -> Column:
    """The one publisher, or the marks for none and for several."""
    return bind(names, lambda n: F.when(F.size(n) == 1, n[0]).when(F.size(n) == 0, UNKNOWN).otherwise(CONFLICT))
