"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Everything is DataFrame expressions: one projection turns a text into counts,
the counts (a few numbers a document) are written once, and concentration steps
run over them as grouped aggregates. No text is shuffled, and no row of a group
either: a task sums up its own rows, and what is known of a group comes to the
rows in a broadcast whose size is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chi2_cdf, chi2_quantile, table, words

#: Characters that count as symbols, and letters that count as capitals.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Smallest standard deviation of each transformed statistic; keeps a group whose
#: values hardly differ (no symbols at all, say) from rejecting every small departure.
FLOORS = {"x_len": 0.05, "x_sym": 0.05, "x_cap": 0.05, "x_dup": 0.15, "x_rep": 0.12}
WINDOW = 5
#: Rows up to which a table of groups is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 50_000
#: Steps of a quantile's bins: of medians and deviations, and a doubling of a distance.
FINE, PER_DOUBLING = 4096, 64
#: Fall of a determinant's logarithm below which an estimate has settled.
SETTLED = 1e-4
STARTS = ("deviations", "tanh", "signs")


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of each whole text next to the columns in ``keep``.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (those equal to an earlier line), n_repeat_words (words in
    5-word windows that occur twice or more), n_capitals. Null text counts as empty.

    Repeated windows: windows are hashed; where a text has fewer distinct hashes
    than windows, (hash, position) pairs are sorted within the row, positions whose
    neighbour has the same hash are marked, and the union of the marked intervals is
    measured: O(n log n) in the text's length, no exploded rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*keep, t.alias("_t"))
    a = a.select(
        *keep,
        words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).cast("long").alias("n_capitals"),
    )
    more = ["word_chars", "n_symbols", "n_capitals"]
    n = F.size("_w")
    a = a.select(
        *keep, *more,
        n.cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(WINDOW)])
        )).alias("_h"),
    )
    more += ["n_words", "n_lines", "n_dup_lines"]
    a = a.select(
        *keep, *more,
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
               F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    s = F.col("_s")
    same = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | (
        (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])
    )
    a = a.select(
        *keep, *more,
        F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(same(x, j), x["i"])), lambda x: x.isNotNull())).alias("_m"),
    )
    m = F.col("_m")
    covered = F.aggregate(
        F.transform(m, lambda p, j: F.when(j == F.size(m) - 1, WINDOW).otherwise(
            F.least(F.lit(WINDOW), m[F.least(j + 1, F.size(m) - 1)] - p))),
        F.lit(0), lambda x, y: x + y,
    )
    return a.select(*keep, *more, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Transformed statistics: the log of the mean word length, and roots of shares."""
    share = lambda a, b: F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))))
    return {
        "x_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_sym": share("n_symbols", "word_chars"),
        "x_cap": share("n_capitals", "word_chars"),
        "x_dup": share("n_dup_lines", "n_lines"),
        "x_rep": share("n_repeat_words", "n_words"),
    }


def _sum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _small(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The table written, and broadcast where its rows, counted, are few."""
    df = scratch.write(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lowest_bin(rows: DataFrame, by: list[str], bin_: str, share: float) -> DataFrame:
    """(by, cut): the smallest bin up to which at least ``share`` of the rows lie. Counts of bins don't depend on how rows are dealt."""
    counts = rows.groupBy(*by, bin_).agg(F.count("*").alias("n"))
    all_, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(bin_)
    counts = counts.select(*by, bin_, F.sum("n").over(up_to).alias("have"), F.sum("n").over(all_).alias("total"))
    return counts.where(F.col("have") >= F.lit(share) * F.col("total")).groupBy(*by).agg(F.min(bin_).alias("cut"))


def _medians(rows: DataFrame, group: str, values: dict[str, Column], name: str) -> DataFrame:
    """(group, <name>_x for each x): the group's medians, to within a step of 1/FINE."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.floor(v * FINE + 0.5).alias("bin")) for x, v in values.items()])).alias("e")
    cuts = _lowest_bin(rows.select(group, each).select(group, "e.x", "e.bin"), [group, "x"], "bin", 0.5)
    return cuts.groupBy(group).agg(*[(F.max(F.when(F.col("x") == x, F.col("cut"))) / FINE).alias(f"{name}_{x}") for x in values])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _factored(est: DataFrame, keys: list[str], xs: list[str], floors: dict[str, float]) -> DataFrame:
    """(keys, m_x, l_i_j, det): centre, Cholesky factor and log-determinant of covariances v_i_j, column by column."""
    for j in range(len(xs)):
        for i in range(j, len(xs)):
            rest = F.col(f"v_{i}_{j}") - (_sum(F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)) if j else 0)
            est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[xs[i]] ** 2 * 0.25))) if i == j else rest / F.col(f"l_{j}_{j}"))
    det = 2 * _sum(F.log(f"l_{i}_{i}") for i in range(len(xs)))
    return est.select(*keys, *[f"m_{x}" for x in xs], *[f"l_{i}_{j}" for i, j in _pairs(len(xs))], det.alias("det"))


def _starts(rows: DataFrame, scratch: Scratch, group: str, xs: list[str], floors: dict[str, float]) -> DataFrame:
    """Starts by group: medians with deviations alone, or with the correlations of tanh(z) or of z's direction, z being in deviations from the median."""
    med = _small(_medians(rows, group, {x: F.col(x) for x in xs}, "m"), scratch, "median")
    near = rows.join(med, group)
    mad = _medians(near, group, {x: F.abs(F.col(x) - F.col(f"m_{x}")) for x in xs}, "s")
    scale = _small(med.join(mad, group).select(group, *[f"m_{x}" for x in xs], *[F.greatest(1.4826 * F.col(f"s_{x}"), F.lit(floors[x])).alias(f"s_{x}") for x in xs]), scratch, "scale")
    z = [(F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}") for x in xs]
    norm = F.greatest(_sum(v * v for v in z), F.lit(1e-12))
    moment = {"tanh": lambda i, j: F.tanh(z[i]) * F.tanh(z[j]), "signs": lambda i, j: z[i] * z[j] / norm}
    found = rows.join(scale, group).groupBy(group).agg(*[F.avg(f(i, j)).alias(f"{k}_{i}_{j}") for k, f in moment.items() for i, j in _pairs(len(xs))])
    found = found.join(scale, group)

    def start(k: int, name: str) -> DataFrame:
        s = [F.col(f"s_{x}") for x in xs]
        by = lambda i, j: F.col(f"{name}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"{name}_{i}_{i}"), F.lit(1e-6)) * F.greatest(F.col(f"{name}_{j}_{j}"), F.lit(1e-6)))
        v = lambda i, j: s[i] * s[j] if i == j else F.lit(0.0) if name == "deviations" else by(i, j) * s[i] * s[j] * 0.99
        return found.select(group, F.lit(k).alias("start"), *[f"m_{x}" for x in xs], *[v(i, j).alias(f"v_{i}_{j}") for i, j in _pairs(len(xs))])

    every = reduce(DataFrame.union, [start(k, name) for k, name in enumerate(STARTS)])
    return _factored(every, [group, "start"], xs, floors)


def _estimate(core: DataFrame, keys: list[str], xs: list[str], floors: dict[str, float], consistency: float) -> DataFrame:
    """Mean and covariance of the rows of ``core``; deviations are from the last centre, which keeps second moments from cancelling."""
    p = len(xs)
    dev = [F.col(x) - F.col(f"m_{x}") for x in xs]
    agg = core.groupBy(*keys).agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in xs],
        *[F.avg(dev[i]).alias(f"a_{i}") for i in range(p)],
        *[F.avg(dev[i] * dev[j]).alias(f"b_{i}_{j}") for i, j in _pairs(p)],
    )
    agg = agg.select(
        *keys,
        *[(F.col(f"m_{x}") + F.col(f"a_{i}")).alias(f"m_{x}") for i, x in enumerate(xs)],
        *[((F.col(f"b_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")) * consistency + (floors[xs[i]] ** 2 if i == j else 0)).alias(f"v_{i}_{j}") for i, j in _pairs(p)],
    )
    return _factored(agg, keys, xs, floors)


def mcd_distance(
    stats: DataFrame,
    scratch: Scratch,
    group: str,
    xs: list[str],
    usable: str,
    floors: dict[str, float] = FLOORS,
    share: float = 0.75,
    max_steps: int = 20,
) -> DataFrame:
    """Adds ``distance``: squared Mahalanobis distance from the group's reweighted MCD estimate.

    From each of three starts, a concentration step keeps the rows whose distance is
    at most the group's ``share`` quantile (in bins of 1/64 of a doubling) and
    re-estimates mean and covariance from them, until that no longer lowers the
    determinant's logarithm by 1e-4 (at most ``max_steps`` times). A group's estimate is that of the smallest determinant,
    re-estimated once from all rows within the chi-square quantile 0.975. The square
    of a statistic's floor is added to its variance in every estimate, so a
    statistic that doesn't vary has one.

    Groups are reduced map-side (counts of bins, moments), so a group with a third
    of all rows costs no task more than its own rows. Rows that aren't ``usable``
    take no part in the estimates. A group without usable rows has a null distance.
    """
    p = len(xs)
    rows = stats.where(F.col(usable)).select(group, *xs)
    consistency = lambda q: q / chi2_cdf(chi2_quantile(q, p), p + 2)  # noqa: E731 - of a truncated normal's covariance
    keys = [group, "start"]
    active = _small(_starts(rows, scratch, group, xs, floors), scratch, "start")
    settled = []
    for k in range(max_steps):
        low, high = 2.0**-30, 2.0**30
        far = _with_distance(rows.join(active, group), xs).withColumn("bin", F.floor(F.log2(F.least(F.greatest("distance", F.lit(low)), F.lit(high))) * PER_DOUBLING))
        cut = _small(_lowest_bin(far, keys, "bin", share), scratch, f"cut{k}")
        core = far.join(cut, keys).where(F.col("bin") <= F.col("cut"))
        new = _estimate(core, keys, xs, floors, consistency(share)).join(active.select(*keys, F.col("det").alias("was")), keys)
        new = scratch.write(new.withColumn("settled", (F.col("det") > F.col("was") - SETTLED) & F.lit(k > 0)).drop("was"), f"step{k}")
        settled.append(new.where("settled").drop("settled"))
        rest = new.where("not settled").drop("settled")
        left = rest.count()
        if not left:
            break
        active = F.broadcast(rest) if left <= BROADCAST_ROWS else rest
    else:
        settled.append(rest)
    est = reduce(DataFrame.union, settled)
    best = est.groupBy(group).agg(F.min(F.struct(F.round("det", 9).alias("det"), "start")).alias("b")).select(group, F.col("b.start").alias("start"))
    best = _small(est.join(best, keys), scratch, "best").drop("start")
    inside = _with_distance(rows.join(F.broadcast(best), group) if best.count() <= BROADCAST_ROWS else rows.join(best, group), xs).where(F.col("distance") <= chi2_quantile(0.975, p))
    final = _small(_estimate(inside, [group], xs, floors, consistency(0.975)), scratch, "final")
    return _with_distance(stats.join(final, group, "left"), xs).drop(*final.drop(group).columns)


def _with_distance(df: DataFrame, xs: list[str]) -> DataFrame:
    """Forward substitution y = L^-1 (x - m); the distance is |y|^2."""
    names = []
    for i, x in enumerate(xs):
        y = F.col(x) - F.col(f"m_{x}")
        if i:
            y = y - _sum(F.col(f"l_{i}_{j}") * F.col(names[j]) for j in range(i))
        names.append(f"y_{i}")
        df = df.withColumn(names[-1], y / F.col(f"l_{i}_{i}"))
    return df.withColumn("distance", _sum(F.col(y) * F.col(y) for y in names)).drop(*names)


def score_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    keys: tuple[str, str] = ("lang", "source"),
    min_group: int = 30,
    tail: float = 1e-6,
    scatter_words: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: its id, counts, base_failed, distance and kept.

    Groups are (language, source); sources with fewer than ``min_group`` usable
    documents of a language are pooled within that language, and a pool that is
    still smaller judges nobody, as a covariance of five statistics needs rows. Null
    keys are a key of their own. kept is false for base failures and for distances
    beyond the chi-square quantile 1 - ``tail``. A text of n words has its squared
    distance multiplied by n / (n + ``scatter_words``), as its own shares and means
    scatter more than those of the long texts that make up a group's covariance.
    Empty tables give no rows; repeated rows give repeated rows; columns besides
    those named are not read. ``_hash`` identifies the text for a later join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    lang, source = keys
    own = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("_lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("_source"),
        F.xxhash64(F.col(text), F.col(lang), F.col(source)).alias("_hash"),
        F.col(text).alias("_text"),
    )
    stats = text_counts(own, ["_id", "_lang", "_source", "_hash"], "_text")
    stats = stats.withColumn("base_failed", base_failed())
    for name, x in _vector().items():
        stats = stats.withColumn(name, x)
    stats = scratch.write(stats, "stats")
    sizes = stats.where(~F.col("base_failed")).groupBy("_lang", "_source").count()
    sizes = _small(sizes.where(F.col("count") >= min_group).select("_lang", "_source", F.lit(True).alias("_big")), scratch, "sizes")
    stats = stats.join(sizes, ["_lang", "_source"], "left").select(
        "*",
        F.when(F.col("_big"), F.concat_ws("\x01", "_lang", "_source")).otherwise(F.col("_lang")).alias("_group"),
        (~F.col("base_failed")).alias("_usable"),
    )
    far = mcd_distance(stats, scratch, "_group", list(FLOORS), "_usable")
    far = far.withColumn("distance", F.col("distance") * F.col("n_words") / (F.col("n_words") + scatter_words))
    enough = stats.where("_usable").groupBy("_group").count().where(F.col("count") >= min_group).select("_group", F.lit(True).alias("_enough"))
    limit = chi2_quantile(1 - tail, len(FLOORS))
    out = far.join(_small(enough, scratch, "enough"), "_group", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("_enough") & (F.col("distance") > limit), F.lit(False))
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("_id").alias(id_col), *counts, "base_failed", "kept", "distance", "_hash")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    good = score_quality(docs).where("kept").select(F.col("doc_id").alias("_gid"), F.col("_hash").alias("_gh")).distinct()
    h = F.xxhash64("text", "lang", "source")
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_gid"]) & (h == good["_gh"]), "left_semi")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust outlier verdicts for every row of ``documents``."""
    return score_quality(table(spark, sf_dir, "documents")).drop("_hash")
