"""Mixing sources to target weights by entropy balancing.

Each document i gets a rate 0 <= r_i <= 2 of copies. Among all rates under which a source's words come to its
target, the balanced ones have the largest entropy, summed over r and 2 - r. The solution is an exponential
tilt, r_i / (2 - r_i) = exp(tilt * x_i) with x_i the document's size in units of its source's, and the dual in
the one multiplier of each source is convex: Newton steps, each a distributed sum, solve it. Rates become whole
copies by a threshold on a repeatable number of each doc_id, chosen so that the source meets its target to
within half a document.

A null source is a source of its own, the last; a null or blank text has size 0 and adds nothing. Rows of equal
doc_id and size are treated alike, so that repeated rows get equal copies. An empty input gives an empty result.
The tables of sources have one row per source; no list of documents leaves the executors.
Texts of any length count whole; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hash_unit, materialise, n_words_of, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SALT = 1.5, 2.0, 9
MOST_STEPS, NEAR = 80, 1e-9
BINS, ROUNDS = 1024, 4


def source_key(source: str) -> Column:
    """A key that equals itself for null too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size, target of each source, from rows of (key, size). Sources take the weights in turn, by
    code point, null last. What would lie above cap times a source's size is shared again by weight."""
    order = Window.orderBy(F.col("key") == "", "key")
    turn = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    by_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_source = materialise(by_source.select("key", "source_size", turn.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    whole = by_source.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round settles one source at least
        at_cap = F.col("most") <= F.lit(level) * F.col("weight")
        row = by_source.agg(F.sum(F.when(at_cap, F.col("most")).otherwise(0.0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))), F.count_if(at_cap)).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (share * whole - row[0]) / row[1]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return by_source.select("key", "source_size", target.cast("double").alias("target"), (F.col("most") <= F.lit(level) * F.col("weight")).alias("full"))


def tilts(histogram: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """wanted with unit and tilt. histogram: key, size, n. Newton's method on each source's dual, kept within
    the bracket that the signs so far have left."""
    units = histogram.groupBy("key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("unit"))
    state = wanted.join(units, "key").select(
        *wanted.columns, F.greatest("unit", F.lit(1.0)).alias("unit"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.col("full").alias("done"),
    )
    state = materialise(state, "tilts")
    rate = rate_of(F.col("size"), F.col("tilt"), F.col("unit"), cap)
    for _ in range(MOST_STEPS):
        if state.filter("not done").isEmpty():
            break
        words = F.col("n") * F.col("size")
        sums = (
            histogram.join(state.filter("not done").select("key", "unit", "tilt"), "key")
            .groupBy("key")
            .agg(F.sum(words * rate).alias("taken"), F.sum(words * rate * (1 - rate / cap) * F.col("size") / F.col("unit")).alias("slope"))
        )
        miss = F.col("taken") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        between = F.when(low.isNull(), high * 2 - 1).when(high.isNull(), low * 2 + 1).otherwise((low + high) / 2)
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("tilt")) < 4)
        met = F.col("done") | (F.abs(miss) <= F.lit(NEAR) * F.col("target"))
        step = F.when(met, F.col("tilt")).when(inside, newton).otherwise(between)
        state = materialise(state.join(sums, "key", "left").select(*wanted.columns, "unit", step.alias("tilt"), low.alias("low"), high.alias("high"), F.coalesce(met, F.col("done")).alias("done")), "tilts")
    return state.select(*wanted.columns, "unit", "tilt")


def rate_of(size: Column, tilt: Column, unit: Column, cap: float = CAP) -> Column:
    return F.lit(cap) / (1 + F.exp(F.least(F.lit(700.0), -tilt * size / unit)))


def shifts(rows: DataFrame, state: DataFrame, cap: float = CAP) -> DataFrame:
    """state with shift: a document has as many copies as there are k of 1..cap with k - rate - u <= shift, for
    its number u. The words of a source that are taken grow with the shift; it is found by sums over ever finer
    bins, and of the two sides of the last bin the one nearer to the target is taken."""
    steps = F.array(*[F.lit(float(k)) for k in range(1, int(cap) + 1)])
    bounds = state.filter("not full").select("key", "target", "unit", "tilt", F.lit(-cap).alias("from"), F.lit(2 * cap).alias("width"), F.lit(0.0).alias("below"), F.lit(0.0).alias("within"))
    bounds = materialise(bounds, "shifts")
    for _ in range(ROUNDS):
        events = rows.join(bounds, "key").select("key", "size", "from", "width", F.explode(F.transform(steps, lambda k: k - rate_of(F.col("size"), F.col("tilt"), F.col("unit"), cap) - F.col("u"))).alias("at"))
        bin_ = F.floor((F.col("at") - F.col("from")) / F.col("width") * BINS)
        sums = events.withColumn("bin", bin_).filter((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("key", "bin").agg(F.sum("size").cast("double").alias("words"))
        upto = Window.partitionBy("key").orderBy("bin")
        reached = sums.join(bounds, "key").withColumn("sum", F.col("below") + F.sum("words").over(upto))
        first = reached.filter(F.col("sum") > F.col("target")).groupBy("key").agg(F.min(F.struct("bin", "sum", "words")).alias("b"))
        width = F.col("width") / BINS
        bounds = materialise(
            bounds.join(first, "key", "left").select(
                "key", "target", "unit", "tilt",
                F.coalesce(F.col("from") + F.col("b.bin") * width, F.col("from") + F.col("width")).alias("from"),
                F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(width).alias("width"),
                F.coalesce(F.col("b.sum") - F.col("b.words"), F.col("below")).alias("below"),
                F.coalesce(F.col("b.words"), F.lit(0.0)).alias("within"),
            ),
            "shifts",
        )
        bounds = bounds.withColumn("width", F.greatest("width", F.lit(1e-15)))
    over = F.col("below") + F.col("within") - F.col("target")
    shift = F.col("from") + F.when(over < F.col("target") - F.col("below"), F.col("width")).otherwise(0.0)
    return state.join(bounds.select("key", shift.alias("shift")), "key", "left")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, key, size, u), and for each source what copies_of() needs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("key"), n_words_of(text_or_empty(text)).alias("size"), hash_unit(F.col(doc_id), SALT).alias("u"))
    rows = materialise(rows, "sizes")
    histogram = materialise(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "histogram")
    wanted = targets(histogram.select("key", (F.col("size") * F.col("n")).alias("size")), weights)
    return rows, materialise(shifts(rows, tilts(histogram, wanted)), "mix")


def copies_of(size: Column, u: Column, cap: float = CAP) -> Column:
    """Whole copies, from the columns of plan()'s second table."""
    r = rate_of(size, F.col("tilt"), F.col("unit"), cap)
    n = sum(((F.lit(float(k)) - r - u < F.col("shift")).cast("long") for k in range(1, int(cap) + 1)), F.lit(0).cast("long"))
    return F.when(F.col("full"), F.lit(int(cap)).cast("long")).otherwise(n)


def report(docs: DataFrame) -> DataFrame:
    """For each document its size, its source's size and target, and the words that the mix takes of it."""
    rows, mix = plan(docs)
    return rows.join(mix, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("size"), F.col("u"))).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    _, sources = plan(docs, doc_id, text, source)
    whole = docs.select(F.struct("*").alias("row"), source_key(source).alias("key"), n_words_of(text_or_empty(text)).alias("size"), hash_unit(F.col(doc_id), SALT).alias("u"))
    n = copies_of(F.col("size"), F.col("u"))
    taken = whole.join(sources, "key").select("row", n.cast("int").alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")
