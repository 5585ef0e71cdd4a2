"""Secrets in texts, told from widely copied examples by who owns them; in DataFrame functions only.

Patterns give candidates with their places. The hash of every candidate's value is counted by distinct owners and
repositories over the whole corpus: what many owners share is an example, what few do and looks random is taken as live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage

#: Fixed patterns: kind, pattern, group of the value, least length of the value. Order counts for equal starts.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that count only where a value belongs to few owners: keys with a service's prefix, and private keys.
OWNED = (
    ("service", r"\b(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 48),
)
#: A value that so many owners hold is an example; a live value has so many distinct characters.
EXAMPLE_OWNERS, LIVE_CHARACTERS = 5, 6
_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,value:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one kind, in code points.

    What lies between the matches (``split``) and the matches themselves alternate, so summed lengths give the places.
    """
    whole, regex = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(pattern)
    value = whole if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, match: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size")))
    steps = F.zip_with(sizes, value, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("found"))

    def add(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        (first + x["size"]).alias("stop"), x["value"].alias("value"))
        keep = F.when(F.length(x["value"]) >= least, F.array(span)).otherwise(F.array().cast(_SPAN))
        return F.struct((first + x["size"]).alias("at"), F.concat(state["found"], keep).alias("found"))

    found = F.aggregate(steps, start, add, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _row(id: Column, owner: Column, repository: Column, text: Column) -> Column:
    return F.xxhash64(id, owner, repository, text)


def candidates(docs: DataFrame, id: str, text: str, owner: str, repository: str, kinds=BASE + OWNED) -> DataFrame:
    """_id, _row (hash of the row), _owner, _repository and found, the array of spans of every kind sorted by start and
    kind, of each row; a null text is empty. The texts are read once and not shuffled."""
    body = F.coalesce(docs[text], F.lit(""))
    found = reduce(F.concat, [_spans(F.col("_text"), i, *kind) for i, kind in enumerate(kinds)])
    return docs.select(
        docs[id].alias("_id"), docs[owner].cast("string").alias("_owner"), docs[repository].cast("string").alias("_repository"),
        _row(docs[id], docs[owner], docs[repository], docs[text]).alias("_row"), body.alias("_text"),
    ).select("_id", "_row", "_owner", "_repository", F.array_sort(found).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_owners and n_repositories of every candidate value. Pairs are made distinct before they are counted,
    so a value that a third of all rows hold is no large group. Null owners and repositories are not counted."""
    each = found.select("_owner", "_repository", F.explode("found").alias("s")).select(
        F.xxhash64("s.value").alias("value_hash"), "_owner", "_repository")
    owners = each.select("value_hash", "_owner").distinct().groupBy("value_hash").agg(F.count("_owner").alias("n_owners"))
    rooms = each.select("value_hash", "_repository").distinct().groupBy("value_hash").agg(
        F.count("_repository").alias("n_repositories"))
    return owners.join(rooms, "value_hash")


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """_id, _row and spans (sorted; with n_owners, n_repositories, live) of the distinct rows of ``found`` that have any."""
    each = found.where(F.size("found") > 0).select("_id", "_row", F.explode("found").alias("s")).distinct()
    each = each.withColumn("_k", F.bitwise_not(F.xxhash64("s.value")))
    owned = ownership(found).withColumn("_k", F.bitwise_not("value_hash"))
    live = (F.col("n_owners") < example_owners) & (
        F.size(F.array_distinct(F.split("s.value", ""))) >= LIVE_CHARACTERS)
    return (
        each.join(owned, "_k")
        .select("_id", "_row", F.struct("s.start", "s.rank", "s.kind", "s.stop", "n_owners", "n_repositories",
                                        live.alias("live")).alias("s"))
        .groupBy("_id", "_row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )


def scan(docs: DataFrame, id: str, text: str, owner: str, repository: str,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row: id and spans, an array of (start, rank, kind, stop, n_owners, n_repositories, live) sorted by start and
    kind: all matches of the base kinds, and of the owned kinds those that are live.

    Places count code points, the stop is exclusive. A null text is empty; ids, owners and repositories may be null;
    rows may repeat (each gets the same result, and they count once); other columns are ignored. The scan's findings, not the
    texts, are stored in the shared checkpoint folder.
    """
    found = cut_lineage(candidates(docs, id, text, owner, repository))
    mine = judged(found, example_owners).withColumnRenamed("_id", "_other").withColumnRenamed("_row", "_row2")
    joined = found.join(mine, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    kept = F.filter("spans", lambda s: (s["rank"] < len(BASE)) | s["live"])
    return joined.select(F.col("_id").alias(id), F.coalesce(kept, F.array().cast(mine.schema["spans"].dataType)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, id: str, text: str, owner: str, repository: str, length: str | None = None,
           mark: str = "[SECRET]", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every live secret replaced by ``mark`` (overlapping ones together); examples stay. All rows and columns
    are kept; ``length`` names a column that is set to the new number of code points where a text changes."""
    found = cut_lineage(candidates(docs, id, text, owner, repository))
    hits = (
        judged(found, example_owners).select("_id", "_row", F.filter("spans", lambda s: s["live"]).alias("_hits"))
        .where(F.size("_hits") > 0).withColumnRenamed("_id", "_other").withColumnRenamed("_row", "_row2")
    )
    # The caller's other columns travel in one, so none can have the name of an inner one.
    own = docs.select(
        docs[id].alias("_id"), docs[text].alias("_text"), _row(docs[id], docs[owner], docs[repository], docs[text]).alias("_row"),
        F.struct(*[docs[c] for c in docs.columns if c != text]).alias("_rest"))
    joined = own.join(hits, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("at"), F.lit("").alias("out"))

    def cut(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        marked = F.struct(x["stop"].alias("at"), F.concat(s["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], marked).otherwise(inside)

    rest = lambda s: F.concat(s["out"], F.substr(F.col("_text"), (s["at"] + 1).cast("int")))
    out = joined.withColumn("_new", F.when(F.col("_hits").isNotNull(), F.aggregate("_hits", state, cut, rest)))
    result = {c: F.col("_rest").getField(c) for c in docs.columns if c != text} | {text: F.coalesce("_new", "_text")}
    if length:
        result[length] = F.coalesce(F.length("_new").cast(docs.schema[length].dataType), result[length])
    return out.select(*[result[c].alias(c) for c in docs.columns])
