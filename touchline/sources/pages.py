"""Profile candidates of raw web pages."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rating phrases, tried in this order.
RATING_PATTERNS = [r"(\d{2})\s+Overall rating", r"overall rating is\s+(\d{2})", r"(\d{2})\s+Overall"]
#: An entity: a number with or without its semicolon, a name with one, or one of the names that need none.
ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:%s))" % "|".join(
    sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Numbers that pages take from the Windows character set.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}


def _table(mapping: dict[str, str]) -> Column:
    """A constant map, written as one text."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in mapping.items())), F.lit("\x02"), F.lit("\x01"))


def unescape(col: Column) -> Column:
    """HTML entities as their characters, by name (all names of HTML 5), decimal or hexadecimal number; unknown names stay."""
    def character(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9a-fA-F]+);?$", 1)
        number = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        known = F.coalesce(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.lit(False))
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        numbered = F.when(~known, "\ufffd").otherwise(F.coalesce(
            F.try_element_at(_table({str(n): c for n, c in WINDOWS.items()}), number.cast("string")), sign))
        named = F.coalesce(F.try_element_at(_table(html5), F.substr(entity, F.lit(2))), entity)
        return F.when(entity.startswith("&#"), numbered).otherwise(named)

    found = F.transform(F.regexp_extract_all(col, F.lit(f"({ENTITY})"), 1), character)
    # Texts between entities and the entities' characters, by turns.
    parts = F.zip_with(F.split(col, ENTITY), found, lambda text, sign: F.concat(text, F.coalesce(sign, F.lit(""))))
    return F.when(F.contains(col, F.lit("&")), F.array_join(parts, "")).otherwise(col)


def percent_decoded(url: Column) -> Column:
    """Percent-encoded bytes as their characters; ``+`` stays, and so does a text whose bytes are no characters."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def strip_tags(col: Column) -> Column:
    """Readable text of an HTML fragment: no scripts, styles or tags, single blanks."""
    col = F.regexp_replace(col, r"(?is)<script.*?</script>", " ")
    col = F.regexp_replace(col, r"(?is)<style.*?</style>", " ")
    col = F.regexp_replace(col, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(col), r"[\s\p{Z}]+", " "))


def _link(url: Column) -> Column:
    """A link decoded, up to a quote or ampersand that its pattern took in."""
    url = percent_decoded(url)
    for end in ('"', "&quot;", "&amp;"):
        url = F.substring_index(url, end, 1)
    return url


def page_candidates(pages: DataFrame, url_pattern: str, key: str, html: str, skip: str = "/customized",
                    first: int | None = None, around: tuple[int, int] | None = None, snippet: int | None = None) -> DataFrame:
    """The distinct profile links of each page, in order, with name, rating and text.

    All links and the page's whole text count, unless asked otherwise: ``first`` keeps so many links, ``around`` looks at so
    many characters before and after a link's first place (at the whole page if those hold under 80 characters of text),
    ``snippet`` shortens the returned text.
    """
    page = pages.select(key, unescape(F.col(html)).alias("doc"))
    links = F.transform(F.regexp_extract_all("doc", F.lit(f"({url_pattern})"), 1), _link)
    links = F.array_distinct(F.filter(links, lambda u: ~u.contains(skip)))
    links = links if first is None else F.slice(links, 1, first)

    def rating(window: Column) -> Column:
        return F.coalesce(*[F.regexp_extract(window, f"(?i){p}", 1).try_cast("int") for p in RATING_PATTERNS])

    whole = page.withColumn("_links", links).withColumn("window", strip_tags(F.col("doc")))
    if around is None:
        # The text is the page's: it is cleaned and searched once, not once per link.
        whole = whole.withColumn("overall", rating(F.col("window"))).drop("doc")
        rows = whole.select(key, "window", "overall", F.posexplode("_links").alias("position", "url"))
    else:
        before, after = around
        rows = whole.select(key, "doc", F.col("window").alias("_whole"), F.posexplode("_links").alias("position", "url"))
        at = F.instr("doc", F.col("url"))
        start = F.greatest(at - before, F.lit(1))
        rows = rows.withColumn("_near", strip_tags(F.substring("doc", start, at + after - start)))
        rows = rows.withColumn("window", F.when(F.length("_near") < 80, F.col("_whole")).otherwise(F.col("_near")))
        rows = rows.withColumn("overall", rating(F.col("window")))
    slug = F.regexp_extract("url", r"/player/\d+/([^/]+)/", 1)
    text = F.col("window") if snippet is None else F.substring("window", 1, snippet)
    return rows.select(
        key, "position", "url", F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("slug_name"), "overall", text.alias("snippet"))
