"""Team-name aliases. Sources disagree, so each keeps its own table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias -> canonical name, per source.
ALIASES: dict[str, dict[str, str]] = {
    "results": {
        "Bosnia-Herzegovina": "Bosnia and Herzegovina",
        "Bosnia And Herzegovina": "Bosnia and Herzegovina",
        "Cabo Verde": "Cape Verde",
        "Congo DR": "DR Congo",
        "Curaçao": "Curacao",
        "Czechia": "Czech Republic",
        "Côte d'Ivoire": "Ivory Coast",
        "Cote d'Ivoire": "Ivory Coast",
        "D.R. Congo": "DR Congo",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "Türkiye": "Turkey",
        "USA": "United States",
        "United States of America": "United States",
    },
    "legacy": {
        "USA": "United States",
        "Korea Republic": "South Korea",
        "Czechia": "Czech Republic",
        "Curaçao": "Curacao",
        "Bosnia-Herzegovina": "Bosnia and Herzegovina",
    },
    "squad": {
        "Bosnia And Herzegovina": "Bosnia and Herzegovina",
        "Cabo Verde": "Cape Verde",
        "Congo DR": "DR Congo",
        "Côte D'Ivoire": "Ivory Coast",
        "Curaçao": "Curacao",
        "Czechia": "Czech Republic",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "Türkiye": "Turkey",
        "USA": "United States",
    },
    # Player files' nationalities: these after the squad names above.
    "nationality": {
        "Bosnia-Herzegovina": "Bosnia and Herzegovina",
        "Bosnia And Herzegovina": "Bosnia and Herzegovina",
        "Cabo Verde": "Cape Verde",
        "Czechia": "Czech Republic",
        "Curaçao": "Curacao",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "Korea, South": "South Korea",
        "Türkiye": "Turkey",
        "Turkiye": "Turkey",
        "United States of America": "United States",
        "USA": "United States",
        "Cote d'Ivoire": "Ivory Coast",
        "Côte d'Ivoire": "Ivory Coast",
        "Ivory Coast": "Ivory Coast",
        "Cape Verde Islands": "Cape Verde",
        "Holland": "Netherlands",
    },
    # The same by folded key, with keys of names whose accented letters were lost.
    "nationality_key": {
        "cote d ivoire": "Ivory Coast",
        "c te d ivoire": "Ivory Coast",
        "cape verde islands": "Cape Verde",
        "cura ao": "Curacao",
        "holland": "Netherlands",
        "t rkiye": "Turkey",
    },
    # Club statistics' squads; three names are as the file has them, decoded wrongly.
    "transfermarkt": {
        "Bosnia-Herzegovina": "Bosnia and Herzegovina",
        "Bosnia And Herzegovina": "Bosnia and Herzegovina",
        "Cabo Verde": "Cape Verde",
        "Czechia": "Czech Republic",
        "Cote d'Ivoire": "Ivory Coast",
        "C么te d'Ivoire": "Ivory Coast",
        "Cura莽ao": "Curacao",
        "DR Congo": "DR Congo",
        "D.R. Congo": "DR Congo",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "Korea, South": "South Korea",
        "Turkiye": "Turkey",
        "T眉rkiye": "Turkey",
        "USA": "United States",
        "United States of America": "United States",
    },
    "club_stats": {
        "Bosnia-Herzegovina": "Bosnia and Herzegovina",
        "Bosnia And Herzegovina": "Bosnia and Herzegovina",
        "Cabo Verde": "Cape Verde",
        "Congo DR": "DR Congo",
        "Czechia": "Czech Republic",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "USA": "United States",
        "United States of America": "United States",
    },
    "odds": {
        "Cabo Verde": "Cape Verde",
        "Bosnia & Herzegovina": "Bosnia and Herzegovina",
        "Côte d'Ivoire": "Ivory Coast",
        "Cote d'Ivoire": "Ivory Coast",
        "Curaçao": "Curacao",
        "Czechia": "Czech Republic",
        "D.R. Congo": "DR Congo",
        "Congo DR": "DR Congo",
        "IR Iran": "Iran",
        "Korea Republic": "South Korea",
        "USA": "United States",
        "United States of America": "United States",
    },
    # Old rating files use the federation's own names.
    "ratings": {"Iran": "IR Iran", "South Korea": "Korea Republic", "United States": "USA"},
    "schedule": {
        "UEFA Path A Winner": "Bosnia and Herzegovina",
        "UEFA Path B Winner": "Sweden",
        "UEFA Path C Winner": "Turkey",
        "UEFA Path D Winner": "Czech Republic",
        "IC Path 1 Winner": "DR Congo",
        "IC Path 2 Winner": "Iraq",
        "Curaçao": "Curacao",
    },
    "subject": {
        "united states": "usa",
        "us": "usa",
        "u.s.": "usa",
        "south korea": "korea republic",
        "iran": "ir iran",
    },
    # Names in the files of past matches.
    "chinese": {
        "丹麦": "Denmark", "乌拉圭": "Uruguay", "伊朗": "Iran", "克罗地亚": "Croatia", "加拿大": "Canada", "加纳": "Ghana",
        "卡塔尔": "Qatar", "厄瓜多尔": "Ecuador", "哥斯达黎加": "Costa Rica", "喀麦隆": "Cameroon", "塞内加尔": "Senegal",
        "塞尔维亚": "Serbia", "墨西哥": "Mexico", "威尔士": "Wales", "巴西": "Brazil", "德国": "Germany", "摩洛哥": "Morocco",
        "日本": "Japan", "比利时": "Belgium", "沙特": "Saudi Arabia", "法国": "France", "波兰": "Poland",
        "澳大利亚": "Australia", "瑞士": "Switzerland", "突尼斯": "Tunisia", "美国": "United States", "英格兰": "England",
        "荷兰": "Netherlands", "葡萄牙": "Portugal", "西班牙": "Spain", "阿根廷": "Argentina", "韩国": "South Korea",
        "俄罗斯": "Russia", "瑞典": "Sweden", "哥伦比亚": "Colombia", "冰岛": "Iceland", "尼日利亚": "Nigeria",
        "巴拿马": "Panama", "秘鲁": "Peru", "埃及": "Egypt", "希腊": "Greece", "意大利": "Italy", "智利": "Chile",
        "波黑": "Bosnia and Herzegovina", "洪都拉斯": "Honduras", "科特迪瓦": "Ivory Coast", "阿尔及利亚": "Algeria",
    },
    # Names on the markets' pages.
    "chinese_page": {
        "西班牙": "Spain", "佛得角": "Cape Verde", "比利时": "Belgium", "埃及": "Egypt", "沙特阿拉伯": "Saudi Arabia",
        "乌拉圭": "Uruguay", "伊朗": "Iran", "新西兰": "New Zealand", "法国": "France", "塞内加尔": "Senegal",
        "伊拉克": "Iraq", "挪威": "Norway", "阿根廷": "Argentina", "阿尔及利亚": "Algeria", "奥地利": "Austria",
        "约旦": "Jordan", "葡萄牙": "Portugal", "刚果(金)": "DR Congo", "英格兰": "England", "克罗地亚": "Croatia",
        "加纳": "Ghana", "巴拿马": "Panama", "乌兹别克斯坦": "Uzbekistan", "哥伦比亚": "Colombia", "瑞典": "Sweden",
        "突尼斯": "Tunisia", "澳大利亚": "Australia", "波黑": "Bosnia and Herzegovina", "巴西": "Brazil", "加拿大": "Canada",
        "库拉索": "Curacao", "捷克": "Czech Republic", "厄瓜多尔": "Ecuador", "德国": "Germany", "海地": "Haiti",
        "科特迪瓦": "Ivory Coast", "日本": "Japan", "墨西哥": "Mexico", "摩洛哥": "Morocco", "荷兰": "Netherlands",
        "巴拉圭": "Paraguay", "卡塔尔": "Qatar", "苏格兰": "Scotland", "南非": "South Africa", "韩国": "South Korea",
        "瑞士": "Switzerland", "土耳其": "Turkey", "美国": "United States",
    },
}


def lookup(col: Column, mapping: dict[str, str]) -> Column:
    """Mapped value, or the input where the map has none."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, col), col)


def title_cased(source: str) -> dict[str, str]:
    """Lower-cased names of a source whose own spelling is the title case: what a title-cased name can be found by."""
    return {name.lower(): canonical for name, canonical in ALIASES[source].items() if name.title() == name}


def canonical_squad_team(col: Column | str) -> Column:
    """Trimmed name by the club-statistics table, by title case where the spelling itself is unknown."""
    name = F.trim(F.col(col) if isinstance(col, str) else col)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(ALIASES["transfermarkt"].items())])
    titled = F.create_map(*[F.lit(x) for x in chain.from_iterable(title_cased("transfermarkt").items())])
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(titled, F.lower(name)), name)


def canonical_team(col: Column | str, source: str = "results", missing: str | None = None) -> Column:
    """Trimmed name with the source's aliases applied; ``missing`` replaces null."""
    col = F.col(col) if isinstance(col, str) else col
    name = lookup(F.trim(col), ALIASES[source])
    return name if missing is None else F.coalesce(name, F.lit(missing))
