"""Operator 7 [native]: URL filters by the ratio of character language models.

Rules decide the urls they fit: a rule fits its host and all subdomains where
the url's path starts with the rule's path; the longest rule wins.  Every
other url is judged by two variable-order Markov models over the characters
of host and path, one of accepted and one of rejected urls, trained on the
urls that rules decide:

    P(c | context) = (N(context c) + BETA * P(c | shorter context)) / (N(context) + BETA)

down to a uniform distribution.  The log ratio of both models is kept for every
n-gram of the decided urls, in a stored table that grows with them; an unseen
n-gram falls back to its shorter context, as variable-order models do.  A url's
score is the mean over its characters of the log ratio of the longest known
n-gram that ends there; it is blocked below a threshold calibrated on the
fifth of the decided urls that training leaves out (the cut with the best
balanced accuracy over a bounded histogram).  Scoring joins: the distinct
windows of ORDER + 1 characters are looked up once, order by order, then every
character of every url takes the ratio of its window; windows of a large share
of all characters (hot hosts) are salted.

DataFrame functions only.  Cases: null and empty urls and urls without "://"
have empty host and path and, as nothing speaks against them, verdict allow;
the same holds for all undecided urls if rules accept none or reject none;
very long urls are read whole; repeated rows are judged alike (ratios are summed
as integers of 1/UNIT, so no order of rows shows); an empty table gives an empty
result; other columns pass through ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored, table

# The rules of the contract (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER, BETA = 4, 2.0
#: Ratios are summed in steps of 1/UNIT.
UNIT = 10**9
#: A window with more than 1/HOT of all characters is dealt over SALTS keys; so there are at most HOT of them.
HOT, SALTS = 512, 64
#: Histogram of calibration scores: cells a unit, and the largest absolute score told apart.
CELLS, LIMIT = 50, 10
FOLDS = 5
ROW, FOLD, GIVEN = "__url_row", "__url_fold", "__url_given"


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` with host and path."""
    rest = F.when(F.contains("url", F.lit("://")), F.col("url"))
    host = F.regexp_extract(rest, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", F.coalesce(lower, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` with rule and decision, null where no rule fits."""
    rule = decision = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, decision = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(decision)
    return urls.withColumn("rule", rule).withColumn("decision", decision)


def with_chars(urls: DataFrame) -> DataFrame:
    """``urls`` with the characters that the models read, a start mark in front."""
    text = F.concat("host", "path")
    return urls.withColumn("chars", F.when(text != "", F.concat(F.array(F.lit("\x02")), F.split(text, ""))).otherwise(F.array().cast("array<string>")))


def gram(chars: Column, i: Column, order: int) -> Column:
    """The character at ``i`` (from 0) with ``order`` characters before it; null if there are fewer."""
    return F.concat(*[F.get(chars, i - k) for k in range(order, -1, -1)])


def positions(chars: Column) -> Column:
    return F.when(F.size(chars) > 1, F.sequence(F.lit(1), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))


def ngram_counts(train: DataFrame) -> DataFrame:
    """(g, accepted, rejected) of the n-grams of all orders in the decided urls."""
    chars = F.col("chars")
    grams = F.flatten(F.transform(positions(chars), lambda i: F.array(*[gram(chars, i, o) for o in range(ORDER + 1)])))
    rows = train.select((F.col("decision") == "allow").cast("long").alias("yes"), F.explode(grams).alias("g")).where(F.col("g").isNotNull())
    return rows.groupBy("g").agg(F.sum("yes").alias("accepted"), F.sum(1 - F.col("yes")).alias("rejected"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(g, n, ratio): smoothed log P_accepted - log P_rejected of every n-gram."""
    length = F.length("g")
    level = None
    parts = []
    for order in range(ORDER + 1):
        own = counts.where(length == order + 1).withColumn("context", F.substring("g", 1, order))
        seen = own.groupBy("context").agg(F.sum("accepted").alias("all_accepted"), F.sum("rejected").alias("all_rejected"))
        rows = own.join(seen, "context")
        if level is None:
            below = rows.withColumn("pa", F.lit(1.0 / 256)).withColumn("pr", F.lit(1.0 / 256))
        else:  # the last characters of an n-gram are an n-gram of the order below
            below = rows.withColumn("tail", F.expr(f"substring(g, 2, {order})")).join(level, "tail")
        smooth = [((F.col(c) + BETA * F.col(p)) / (F.col("all_" + c) + BETA)).alias(p) for c, p in (("accepted", "pa"), ("rejected", "pr"))]
        now = stored(below.select("g", (F.col("accepted") + F.col("rejected")).alias("n"), *smooth), f"order-{order}")
        parts.append(now)
        level = now.select(F.col("g").alias("tail"), "pa", "pr")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("g", "n", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def model(train: DataFrame) -> DataFrame:
    """(g, ratio) of every n-gram of the decided urls; a stored table."""
    return stored(log_ratios(stored(ngram_counts(train), "ngrams")).select("g", "ratio"), "model")


def windows(chars: Column) -> Column:
    """For every character, the ORDER characters before it (fewer at the start) and itself."""
    return F.transform(positions(chars), lambda i: F.array_join(
        F.slice(chars, F.greatest(i - ORDER, F.lit(0)) + 1, F.least(i, F.lit(ORDER)) + 1), ""))


def looked_up(seen: DataFrame, fitted: DataFrame) -> DataFrame:
    """(w, n, points) of distinct windows (w, n): the log ratio of the longest known n-gram at their end, in steps of 1/UNIT."""
    rows = seen.withColumn("ratio", F.lit(None).cast("double"))
    for size in range(ORDER + 1, 0, -1):
        level = fitted.where(F.length("g") == size).select("g", F.col("ratio").alias("own"))
        # Windows that have their ratio keep their own key, so that they are not gathered under one.
        key = F.when(F.col("ratio").isNull() & (F.length("w") >= size), F.expr(f"right(w, {size})")).otherwise(F.col("w"))
        rows = rows.withColumn("key", key).join(level, F.col("key") == F.col("g"), "left").select("w", "n", F.coalesce("ratio", "own").alias("ratio"))
    return rows.select("w", "n", F.coalesce(F.round(F.col("ratio") * UNIT), F.lit(0.0)).cast("long").alias("points"))


def scored(urls: DataFrame, fitted: DataFrame) -> DataFrame:
    """``urls`` with score: the mean log ratio a character, null without characters."""
    urls = stored(urls.drop("score").withColumn(ROW, F.monotonically_increasing_id()), "urls")
    places = urls.select(ROW, F.explode(windows(F.col("chars"))).alias("w"))
    known = stored(looked_up(places.groupBy("w").agg(F.count(F.lit(1)).alias("n")), fitted), "windows")
    everywhere = known.agg(F.sum("n")).first()[0] or 0
    hot = [r["w"] for r in known.where(F.col("n") > everywhere / HOT).select("w").collect()]  # less than HOT rows
    is_hot = F.col("w").isin(hot) if hot else F.lit(False)
    dealt = places.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(ROW), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = known.select("w", "points", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    sums = dealt.join(copies, ["w", "salt"]).groupBy(ROW).agg(F.sum("points").alias("points"))
    score = F.round(F.col("points") / UNIT / (F.size("chars") - 1), 6)
    return urls.join(sums, ROW, "left").withColumn("score", score).drop(ROW, "points")


def calibrated(held: DataFrame) -> float | None:
    """The threshold with the best balanced accuracy on held-out decided urls; None if a class is missing."""
    cell = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * CELLS).cast("int")
    rows = (held.where("score IS NOT NULL").groupBy(cell.alias("cell")).agg(
        F.sum((F.col("decision") == "allow").cast("long")).alias("yes"), F.sum((F.col("decision") == "block").cast("long")).alias("no"))
        .orderBy("cell").collect())  # at most 2 * LIMIT * CELLS + 1 rows
    yes, no = sum(r["yes"] for r in rows), sum(r["no"] for r in rows)
    if not yes or not no:
        return None
    best, cuts, kept, blocked = -1.0, [], yes, 0
    for i in range(len(rows) + 1):  # everything below the cut is blocked
        if kept / yes + blocked / no > best + 1e-12:
            best, cuts = kept / yes + blocked / no, []
        if kept / yes + blocked / no > best - 1e-12:
            low = rows[i - 1]["cell"] + 1 if i else rows[0]["cell"] - 1
            high = rows[i]["cell"] if i < len(rows) else low
            cuts.append((low + high) / 2 / CELLS)
        if i < len(rows):
            kept, blocked = kept - rows[i]["yes"], blocked + rows[i]["no"]
    return cuts[len(cuts) // 2]


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``urls`` with host, path, rule, score and verdict; other columns pass through, but those named like one of these are replaced."""
    new = ["host", "path", "rule", "score", "verdict"]
    rows = urls.select("url", F.struct(*urls.columns).alias(GIVEN))  # one column, so that no other one's name can clash
    known = with_chars(ruled(parsed(rows), rules)).withColumn(FOLD, F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    decided = known.where(F.col("decision").isNotNull()).select("decision", "chars", FOLD)
    fitted = model(decided.where(F.col(FOLD) > 0))
    rated = stored(scored(known, fitted).drop("chars"), "scores")
    threshold = calibrated(rated.where(F.col("decision").isNotNull() & (F.col(FOLD) == 0)))
    method = F.lit("allow") if threshold is None else F.when(F.col("score") < threshold, "block").otherwise("allow")
    kept = [F.col(GIVEN).getField(c).alias(c) for c in urls.columns if c not in new]
    return rated.withColumn("verdict", F.coalesce("decision", method)).select(*kept, *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
