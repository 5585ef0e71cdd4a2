"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Every word of a text is a term, its count the weight. A draw takes for each term gamma variates r and c and a uniform b from
a hash of the term, sets t = floor(ln w / r + b), and keeps the term with the least ln a = ln c - r * (t - b + 1). Its
(term, t) is the sample; two texts agree in it with a probability equal to the generalised Jaccard similarity of their
counts. A count's units are terms of weight 1, dealt by hash to ``BINS`` bins, which leaves minima and unions of counts as they
are; each bin has ``DRAWS`` draws, so a unit takes part in a few draws instead of all, and a fingerprint's samples all see different parts or draws of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fingerprint has BINS * DRAWS samples, 8 hex digits each.
BINS, DRAWS = 16, 4
#: Gamma variates are taken from a pool of so many (a power of two).
POOL = 4096
#: Words are what stands between these signs, lower-cased.
SEPARATORS = "[ \\t-\\r]+"
_LOW = (1 << 32) - 1
EMPTY = -1


def _pools(spark: SparkSession) -> tuple[Column, Column]:
    """Pools of r and of ln c, with r and c from the gamma distribution of shape 2 (minus ln of two uniforms' product)."""
    def uniform(k: int) -> Column:
        return (F.xxhash64("id", F.lit(k)).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) * F.lit(2.0**-52)

    drawn = spark.range(POOL).select(
        (-F.log(uniform(1) * uniform(2))).alias("r"), F.log(-F.log(uniform(3) * uniform(4))).alias("c"))
    return tuple(drawn.agg(F.array_sort(F.collect_list(x)).alias("x")).scalar() for x in ("r", "c"))


def _sample(bits: Column, log_weight: Column, pools: tuple[Column, Column]) -> Column:
    """ln a in fixed point in the upper half of a long, 32 bits of the term's hash in the lower half."""
    pick = lambda pool, shift: F.get(
        pool, F.shiftrightunsigned(bits, shift).bitwiseAND(POOL - 1).cast("int"))
    r, log_c = pick(pools[0], 0), pick(pools[1], 12)
    b = F.shiftrightunsigned(bits, 32) * F.lit(2.0**-32)
    log_a = log_c - r * (F.floor(log_weight / r + b) - b + 1)
    # r is below 20 and a count's ln below 60, which keeps ln a between -128 and 127.
    order = F.shiftleft(((log_a + 128) * F.lit(float(1 << 23))).cast("long"), 32)
    return order.bitwiseOR(bits.bitwiseAND(_LOW))


def samples(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``samples`` (array of longs below 2**32, ``EMPTY`` in bins without terms) of every text that has a word;
    others give no row.

    ``keys`` must tell texts apart: repeated keys are sampled as one text. If ``texts`` is already dealt by some of the keys,
    nothing is shuffled; else terms are counted before the shuffle.
    """
    counted = (
        texts.select(*keys, F.explode(F.split(F.lower(text), SEPARATORS)).alias("_word")).where("_word <> ''")
        .select(*keys, F.xxhash64("_word").alias("_term")).groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
        # Units of a count are dealt one by one, so a heavy term takes part in all bins.
        .select(*keys, "_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_unit"), "_term")
        .select(*keys, F.xxhash64("_term", "_unit").alias("_term"))
        .select(*keys, F.pmod("_term", F.lit(BINS)).cast("int").alias("_bin"), F.lit(0.0).alias("_w"),
                *[F.xxhash64("_term", F.lit(k)).alias(f"_h{k}") for k in range(DRAWS)])
    )
    pools = _pools(texts.sparkSession)
    least = [F.min(_sample(F.col(f"_h{k}"), F.col("_w"), pools)).alias(f"_s{k}") for k in range(DRAWS)]
    # ln a tells the t of a term apart, so both halves together stand for (term, t).
    mark = [F.col(f"_s{k}").bitwiseXOR(F.shiftrightunsigned(f"_s{k}", 32)).bitwiseAND(_LOW) for k in range(DRAWS)]
    drawn = counted.groupBy(*keys, "_bin").agg(*least).select(*keys, "_bin", F.array(*mark).alias("_m"))
    found = F.map_from_entries(F.collect_list(F.struct("_bin", "_m")))
    none = F.array(*[F.lit(EMPTY).cast("bigint")] * DRAWS)
    return drawn.groupBy(*keys).agg(found.alias("_all")).select(*keys, F.flatten(
        F.array(*[F.coalesce(F.try_element_at("_all", F.lit(i)), none) for i in range(BINS)])).alias("samples"))


def whole(found: Column | str) -> Column:
    """``found``, or the samples of a text without words where there are none."""
    return F.coalesce(found, F.array_repeat(F.lit(EMPTY).cast("bigint"), BINS * DRAWS))


def fingerprint(found: Column | str) -> Column:
    """Samples as text of 8 characters each: hex digits, or dashes in bins without terms."""
    return F.array_join(F.transform(found, lambda x: F.when(x == EMPTY, F.lit("-" * 8)).otherwise(
        F.lpad(F.lower(F.hex(x)), 8, "0"))), "")


def likeness(one: Column | str, two: Column | str) -> Column:
    """Share of equal samples of two arrays of samples where either has one: an estimate of the texts' generalised Jaccard
    similarity. Two texts without words are equal (1)."""
    marks = F.zip_with(one, two, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), None).otherwise((x == y).cast("int")))
    told = F.filter(marks, lambda x: x.isNotNull())
    equal = F.size(F.filter(told, lambda x: x == 1))
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(equal / F.greatest(F.lit(1), F.size(told)))


def fingerprints(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id and fingerprint of each distinct (id, text) of ``docs``.

    A null text is empty; a text without words has no samples; equal texts have equal fingerprints; ids may be null or
    repeat; other columns are ignored; an empty table gives an empty one.
    """
    keyed = docs.select(docs[id].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_key", F.xxhash64("_id", "_text")).repartition("_key").distinct()
    return (
        keyed.select("_key", "_id").join(samples(keyed, ["_key"], "_text"), "_key", "left")
        .select(F.col("_id").alias(id), fingerprint(whole("samples")).alias("fingerprint"))
    )
