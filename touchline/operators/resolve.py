"""Entity resolution: ladders of exact rules and token rules inside (birthdate, country) blocks.

No rule compares all members of a block. Exact rules meet on equal keys. Fuzzy rules look names up in an inverted index:
of the shorter token list only as many of its rarest tokens as a match can't do without, of a text that may be contained
its rarest run of three letters. Candidates are then compared in full. Copies of a name in a block are one entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage

#: Letters of the runs that containment is looked up by; shorter texts are their own key.
RUN = 3


@dataclass(frozen=True)
class Rule:
    """One rung: ``left`` keys (one, or one per candidate name) meet ``right`` keys of the same kind.

    ``stage`` orders rungs; inside a stage the candidate's position decides first, then the rung's
    order, unless ``by_rung`` puts the rung first. ``keep`` says which of several right rows counts.
    """

    method: str
    stage: int
    left: Sequence[str]
    right: Sequence[str]
    keep: str = "last"
    names: bool = True


def _key(parts: Sequence[str], null_safe: bool) -> Column:
    texts = [F.col(p).cast("string") for p in parts]
    if null_safe:
        return F.concat_ws("\u0001", *[F.coalesce(t, F.lit("\u0002")) for t in texts])
    return F.when(_all_set(texts), F.concat_ws("\u0001", *texts))


def _all_set(cols: Sequence[Column]) -> Column:
    out = F.lit(True)
    for col in cols:
        out = out & col.isNotNull()
    return out


def ladder(left: DataFrame, right: DataFrame, left_id: str, names: str, rules: Sequence[Rule], seq: str,
           payload: Sequence[str], null_safe: bool = False) -> DataFrame:
    """One row per matched ``left_id``: the payload of the best rule, with ``method``.

    ``names`` is the left side's ordered array of candidate names; a rule's ``left`` columns may use
    ``name``. All rules share one equi-join on (rule, key). Null key parts match nothing unless
    ``null_safe``.
    """
    people = left.where(F.size(names) > 0).select("*", F.posexplode(names).alias("_pos", "name"))
    entries, targets = [], []
    for number, rule in enumerate(rules):
        entries.append(F.struct(
            F.lit(number).alias("rule"), F.lit(rule.stage).alias("stage"),
            (F.col("_pos") if rule.names else F.lit(0)).alias("pos"), _key(rule.left, null_safe).alias("key")))
        order = F.col(seq) if rule.keep == "first" else -F.col(seq)
        targets.append(F.struct(F.lit(number).alias("rule"), _key(rule.right, null_safe).alias("key"), order.alias("order")))
    wanted = people.select(F.col(left_id).alias("_id"), F.inline(F.array(*entries))).where("key is not null")
    offered = (
        right.select(F.struct(*payload).alias("_row"), F.explode(F.array(*targets)).alias("_t")).where("_t.key is not null")
        .groupBy(F.col("_t.rule").alias("rule"), F.col("_t.key").alias("key")).agg(F.min_by("_row", "_t.order").alias("_row"))
    )
    methods = F.array(*[F.lit(r.method) for r in rules])
    return (
        wanted.join(offered, ["rule", "key"])
        .groupBy("_id").agg(F.min_by(F.struct("rule", "_row"), F.struct("stage", "pos", "rule")).alias("_m"))
        .select(F.col("_id").alias(left_id), F.get(methods, F.col("_m.rule")).alias("method"), "_m._row.*")
    )


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written once and joined by key alone: names, blocks and letters repeat, so a file of a few MB may hold many
    millions of rows, which Spark would take for small enough to pass through the driver."""
    return cut_lineage(df).hint("merge")


def name_tokens(name: Column) -> Column:
    """Sorted distinct tokens of a normalized name."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, " "), lambda t: t != "")))


def _rarest(entries: DataFrame, others: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Per ``by``: ``_order``, its keys with their number of rows among ``others``, the rarest first. Block columns are
    all of ``others`` but the key."""
    shared = [c for c in others.columns]
    seen = others.groupBy(*shared).agg(F.count("*").alias("_n"))
    return entries.join(seen, shared, "left").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col(key).alias("key")))).alias("_order"))


def best_token_overlap(left: DataFrame, right: DataFrame, left_id: str, tokens: str, right_tokens: str,
                       block: Sequence[str], seq: str, payload: Sequence[str]) -> DataFrame:
    """Per left row the right row of the same block sharing most tokens (at least one), first ``seq`` on ties.

    One shared token is looked up in an index that keeps the first row per (block, token). Two or more need a meeting
    among all but the most frequent token of either list: these meet in the index and are counted in full. Null lists
    and null blocks match nothing.
    """
    keys = list(block)
    l = left.dropna(subset=keys).select(F.col(left_id).alias("_id"), *keys, F.array_sort(F.array_distinct(tokens)).alias("_l"))
    r = right.dropna(subset=keys).select(*keys, F.col(seq).alias("_seq"), F.array_sort(F.array_distinct(right_tokens)).alias("_r"),
                                         F.struct(*payload).alias("_row"))
    # Equal lists are one entry on either side; only blocks of both sides matter.
    r = r.groupBy(*keys, "_r").agg(F.min("_seq").alias("_seq"), F.min_by("_row", "_seq").alias("_row")).join(
        l.select(*keys).distinct(), keys, "left_semi")
    r = _stored(r)
    l = _stored(l.join(r.select(*keys).distinct(), keys, "left_semi"))
    lists = l.select(*keys, "_l").distinct()
    l_tokens = lists.select(*keys, "_l", F.explode("_l").alias("token"))
    r_tokens = r.select(*keys, "_r", "_seq", F.explode("_r").alias("token"))
    first = r_tokens.groupBy(*keys, "token").agg(F.min_by(F.struct("_seq", "_r"), "_seq").alias("_f"))
    one = l_tokens.join(first, [*keys, "token"]).select(*keys, "_l", "_f._r", "_f._seq")

    def prefix(entries: DataFrame, list_: str) -> DataFrame:
        """All tokens but the most frequent one; both sides order them by their lists on the right."""
        ordered = _rarest(entries, r_tokens.select(*keys, "token"), [*keys, list_], "token")
        return ordered.where(F.size("_order") > 1).select(
            *keys, list_, F.explode(F.slice("_order", F.lit(1), F.size("_order") - 1)["key"]).alias("token"))

    more = prefix(l_tokens, "_l").join(prefix(r_tokens, "_r"), [*keys, "token"]).select(*keys, "_l", "_r").distinct()
    more = more.join(r.select(*keys, "_r", "_seq"), [*keys, "_r"]).select(*keys, "_l", "_r", "_seq")
    best = one.unionByName(more).withColumn("_size", F.size(F.array_intersect("_l", "_r"))).groupBy(*keys, "_l").agg(
        F.min_by("_r", F.struct(-F.col("_size"), "_seq")).alias("_r"))
    return l.join(best, [*keys, "_l"]).join(r.select(*keys, "_r", "_row"), [*keys, "_r"]).select(F.col("_id").alias(left_id), "_row.*")


def sole_in_block(left: DataFrame, right: DataFrame, left_id: str, block: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Left rows whose block holds exactly one right row."""
    keys = list(block)
    single = right.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*payload)).alias("_row")).where("_n = 1")
    return left.join(single, keys).select(left_id, "_row.*")


def _compact(name: str) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def _runs(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` letters."""
    return F.array_distinct(F.filter(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, size)),
        lambda s: F.length(s) == size))


def _indexed(names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of a name: its tokens (with their number), its runs of letters, and its shorter runs (with a mark
    where one is the whole text)."""
    tokens, text = name_tokens(F.col("_name")), _compact("_name")

    def entries(kind: str, of: Column, whole: Column) -> Column:
        return F.transform(of, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), (whole == k).alias("_whole")))

    listed = F.concat(entries("token", tokens, text), entries("run", _runs(text, RUN), text),
                      *[entries("short", _runs(text, n), text) for n in range(1, RUN)])
    return names.select(*keys, "_name", "_seq", F.size(tokens).alias("_size"), F.inline(listed))


def fuzzy_block_match(left: DataFrame, right: DataFrame, left_id: str, names: str, right_name: str, block: Sequence[str],
                      seq: str, payload: Sequence[str], accept: float = 0.67, min_tokens: int = 2, contained: float = 0.92) -> DataFrame:
    """Best fuzzy name match inside a block, accepted from ``accept`` on.

    The score of two names is the share of the shorter token list they have in common, at least ``contained`` when one,
    written without blanks, contains the other. The first best right row wins, and its shorter token list must have
    ``min_tokens``.

    A list of n tokens that shares ``accept`` of them can miss n - ceil(accept * n) only, so one more of its rarest tokens
    are looked up among all tokens of the longer lists. A contained text is looked up by its rarest run of letters. Lists
    of one token and texts shorter than a run meet the first row of their key. Null blocks match nothing.
    """
    keys = list(block)
    l = left.dropna(subset=keys).select(F.col(left_id).alias("_id"), *keys, F.posexplode(names).alias("_pos", "_name")).where("_name <> ''")
    l = _stored(l)
    # Copies of a name in a block are one target: the first of them.
    r = _stored(
        right.dropna(subset=keys).where(F.length(right_name) > 0).join(l.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys, F.col(right_name).alias("_name"))
        .agg(F.min_by(F.struct(F.col(seq).alias("seq"), F.struct(*payload).alias("row")), seq).alias("_r")))
    ours = _stored(_indexed(l.join(r.select(*keys).distinct(), keys, "left_semi").select(*keys, "_name").distinct().withColumn("_seq", F.lit(0)), keys))
    theirs = _stored(_indexed(r.select(*keys, "_name", F.col("_r.seq").alias("_seq")), keys))
    at = [*keys, "kind", "key"]

    def needed(entries: DataFrame, others: DataFrame) -> DataFrame:
        """The keys of which a name that matches enough has at least one: its rarest tokens, its rarest run."""
        ordered = _rarest(entries.where("kind = 'run' or kind = 'token' and _size > 1"), others.select(*at), [*keys, "_name", "kind"], "key")
        size = F.size("_order")
        count = F.when(F.col("kind") == "run", 1).otherwise(size - F.ceil(size * F.lit(accept) - 1e-9) + 1)
        return ordered.select(*keys, "_name", "kind", F.explode(F.slice("_order", F.lit(1), count.cast("int"))["key"]).alias("key"))

    def first_of(entries: DataFrame) -> DataFrame:
        return entries.where("kind <> 'run'").groupBy(*at).agg(F.min_by("_name", "_seq").alias("_other"))

    all_of = lambda d, name: d.select(*at, F.col("_name").alias(name))
    alone = "kind = 'token' and _size = 1 or kind = 'short' and _whole"
    pairs = (
        all_of(theirs, "_other").join(needed(ours, theirs), at).select(*keys, "_name", "_other")
        .unionByName(all_of(ours, "_name").join(needed(theirs, ours).withColumnRenamed("_name", "_other"), at).select(*keys, "_name", "_other"))
        .unionByName(all_of(ours.where(alone), "_name").join(first_of(theirs), at).select(*keys, "_name", "_other"))
        .unionByName(all_of(ours, "_name").join(first_of(theirs.where(alone)), at).select(*keys, "_name", "_other"))
        .distinct()
    )
    x, y = name_tokens(F.col("_name")), name_tokens(F.col("_other"))
    floor = F.least(F.size(x), F.size(y))
    u, v = _compact("_name"), _compact("_other")
    overlap = F.size(F.array_intersect(x, y)) / floor
    score = F.when(F.contains(u, v) | F.contains(v, u), F.greatest(overlap, F.lit(contained))).otherwise(overlap)
    scored = pairs.withColumns({"_score": score, "_floor": floor}).where(F.col("_score") >= accept)
    rows = r.select(*keys, F.col("_name").alias("_other"), "_r")
    # One best right row per name, then per left row.
    best = scored.join(rows.select(*keys, "_other", F.col("_r.seq").alias("_seq")), [*keys, "_other"]).groupBy(*keys, "_name").agg(
        F.min_by(F.struct("_other", "_seq", "_score", "_floor"), F.struct(-F.col("_score"), "_seq")).alias("_b"))
    chosen = l.join(best, [*keys, "_name"]).groupBy("_id").agg(
        F.min_by(F.struct(*keys, "_b._other", "_b._score", "_b._floor"), F.struct(-F.col("_b._score"), "_b._seq", "_pos")).alias("_m")).where(
        F.col("_m._floor") >= min_tokens)
    return chosen.select("_id", "_m.*").join(rows, [*keys, "_other"]).select(
        F.col("_id").alias(left_id), F.round("_score", 2).alias("match_score"), "_r.row.*")
