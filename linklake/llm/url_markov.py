"""URL filter by the ratio of two character language models, in DataFrame operations alone.

Method: rules of host and path settle some URLs. The URLs that rules accept and those that they reject
train one variable-order Markov model each: the chance of a character after its three, two, one or no
predecessors, every order smoothed with the next shorter one by the number of different characters
seen there (Witten-Bell). A URL's score is the logarithm of the ratio of its chances under the two models,
divided by its length. The threshold is the one that tells accepted from rejected URLs best
on the fifth of the ruled URLs that the models don't see. URLs without a rule are allowed at or above it.

Characters are Unicode code points as they stand, case, digits and marks included. One aggregation counts the grams
of all URLs, with none for those that don't train; the ratios of these grams are a table that grows with the corpus.
A URL's grams meet it in an ordinary join, and are summed by URL. A gram that neither model saw gets what the shorter
grams give.

Defined results: a null URL or one without "://" has an empty host and path and no rule; a null or empty URL scores 0.
Without accepted or without rejected URLs the ratio is what the other model and uniform chances give, and the
threshold is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Nothing is folded. The tests' brute force numbers the characters of its ASCII URLs by these three.
ALPHABET = "".join(map(chr, range(33, 127)))
FOLD_FROM = FOLD_TO = ""
ORDER = 3
SIZE = 32  # a character that a model never saw has the chance 1 / SIZE in both, before smoothing
STEP = 0.01  # width of a score class in calibration
SPAN = 1000  # score classes on either side of zero


def parts(url: str | Column) -> dict[str, Column]:
    url = F.col(url) if isinstance(url, str) else url
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return {"host": F.translate(host, UPPER, LOWER), "path": path}


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null; the later text wins among equals."""
    found = []
    for verdict, rule in rules:
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def symbols(url: str) -> Column:
    """The URL's characters."""
    return F.filter(F.split(F.coalesce(F.col(url), F.lit("")), ""), lambda ch: ch != "")


def ratios(rows: DataFrame) -> DataFrame:
    """(gram, ratio): log ratio of the two models' chances for every gram of ``rows``.

    ``rows``: (codes, accepted); a row whose ``accepted`` is null trains neither model.
    """
    each = rows.select("accepted", F.explode(_windows("codes")).alias("gram"))
    counted = each.groupBy("gram").agg(F.count_if("accepted").alias("n_yes"), F.count_if(~F.col("accepted")).alias("n_no"))
    counted = cut_lineage(counted)
    chances = None
    for order in range(ORDER + 1):
        # the last order + 1 characters; their predecessors; the shorter gram drops the farthest of these
        some = counted.groupBy(F.slice("gram", ORDER + 1 - order, order + 1).alias("gram")).agg(F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"))
        some = some.withColumn("before", F.slice("gram", 1, order)).withColumn("rest", F.slice("gram", 2, order))
        seen = some.groupBy("before").agg(
            *[F.sum(f"n_{s}").alias(f"all_{s}") for s in ("yes", "no")], *[F.count_if(F.col(f"n_{s}") > 0).alias(f"kinds_{s}") for s in ("yes", "no")]
        )
        met = some.join(seen, "before")
        if chances is None:
            met = met.withColumns({f"q_{s}": F.lit(1 / SIZE) for s in ("yes", "no")})
        else:
            met = met.join(chances.select(F.col("gram").alias("rest"), F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no")), "rest")
        new = {}
        for s in ("yes", "no"):
            n, whole, kinds, shorter = (F.col(f"{k}_{s}") for k in ("n", "all", "kinds", "q"))
            new[f"p_{s}"] = F.when(whole == 0, shorter).otherwise((n + kinds * shorter) / (whole + kinds))
        chances = met.select("gram", *[v.alias(k) for k, v in new.items()])
    return chances.select("gram", F.log(F.col("p_yes") / F.col("p_no")).cast("float").alias("ratio"))


def _windows(codes: str) -> Column:
    """All grams of an array of characters, by position: no state, so long URLs take linear time. The start is the empty text."""
    padded = F.concat(F.array_repeat(F.lit(""), ORDER), F.col(codes))
    n = F.size(codes)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array(*[F.element_at(padded, i + k) for k in range(ORDER + 1)]))


def scored(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``score``, the mean log ratio of the grams of ``codes``, and drop ``codes`` and ``_row``.

    ``rows`` have a number ``_row`` of their own and are written already. Only the numbers and grams meet the table,
    whose common grams Spark splits.
    """
    each = rows.select("_row", F.explode(_windows("codes")).alias("gram"))
    mean = F.avg(F.col("ratio").cast("decimal(20,9)")).cast("double")
    means = each.join(table, "gram").groupBy("_row").agg(mean.alias("score"))
    found = rows.drop("codes").join(means, "_row", "left")
    return found.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_row")


def threshold(scored: DataFrame) -> DataFrame:
    """One row with the score that parts accepted from rejected best: most of both classes' shares right.

    ``scored``: (score, accepted). At most 2 * SPAN + 1 score classes are compared; ties take the score next to zero.
    """
    step = F.greatest(F.least(F.floor(F.col("score") / STEP), F.lit(SPAN)), F.lit(-SPAN)).cast("int").alias("step")
    rows = scored.groupBy(step).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    held = rows.agg(F.collect_list(F.struct("step", "yes", "no")).alias("held"), F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))

    def right(at: Column) -> Column:
        above = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.when(x["step"] >= at, x["yes"]).otherwise(0))
        below = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.when(x["step"] < at, x["no"]).otherwise(0))
        return above / F.col("all_yes") + below / F.col("all_no")

    tried = F.transform("held", lambda x: F.struct(right(x["step"]).alias("right"), (-F.abs(x["step"])).alias("near"), x["step"].alias("step")))
    best = F.when((F.col("all_yes") > 0) & (F.col("all_no") > 0), F.array_max(tried)["step"] * STEP)
    return held.select(F.coalesce(best, F.lit(0.0)).alias("least"))


def judged(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score."""
    p = parts(url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), p["host"].alias("host"), p["path"].alias("path"))
    rows = rows.withColumn("ruling", ruling(F.col("host"), F.col("path"), rules))
    part = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5
    rows = rows.select("page_id", "host", "path", "ruling", (part == 0).alias("calibrates"), symbols("url").alias("codes"))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    trains = F.when(~F.col("calibrates"), F.col("ruling.verdict") == "allow")  # null without a ruling, too
    table = cut_lineage(ratios(rows.select("codes", trains.alias("accepted"))))
    found = cut_lineage(scored(rows, table))
    held_out = found.filter("ruling IS NOT NULL AND calibrates").select("score", (F.col("ruling.verdict") == "allow").alias("accepted"))
    least = cut_lineage(threshold(held_out)).scalar()
    verdict = F.coalesce("ruling.verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", F.col("ruling.rule").alias("rule"), verdict.alias("verdict"), "score")
