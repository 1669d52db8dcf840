"""Operator 1 [native]: secret scans by known forms and a randomness battery.

Base spans are matches of three known forms (assign, access, hex).  The method
adds ``random`` spans: runs of ``[A-Za-z0-9+/_-]``, with the padding behind
them, that look drawn at random.  A ``=`` that is not padding ends a run, so
the value of ``NAME=value`` is judged on its own.
The encoding of a run (decimal, hex, base32, base36, base62, base64 ...) is
inferred from the characters in it, and three tests are made against the
hypothesis "ordinary text in that alphabet":

* chi-squared uniformity: ordinary text repeats its letters (two letters agree
  with a chance of at least COINCIDENCE), which inflates the statistic in
  proportion to the length;
* runs: ordinary text seldom changes between lower case, upper case, digits
  and signs, random text does at a rate given by the alphabet;
* serial correlation of neighbouring symbols: ordinary text is at least
  CORRELATION away from none.

Each gives the chance that ordinary text looks as random as the run does;
Fisher's method combines them, and the Benjamini-Hochberg rule controls the
share of false discoveries among all runs of the corpus, separately for every
band of lengths (a short run has little power, so its band needs a smaller
chance).  p-values are rounded up to steps of 1/STEPS of a decimal digit, so
the rule needs one bounded histogram.

DataFrame functions only.  Cases: null and empty texts have no spans; texts
are taken whole; several rows with one id are judged each on its own; matches
that touch are separate; a ``random`` span inside a base span is left out;
empty tables give empty results; extra columns pass through ``scan``, but
those named base and runs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let, narrowed, total, widened
from .scratch import stored, table

# The known forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs end at their first "=" unless only padding follows; LEAST characters with the padding.
PADDED, LEAST = r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?", 20
KINDS = ["assign", "access", "hex", "random"]

COINCIDENCE, CORRELATION, CHANGES = 0.062, 0.35, 0.25
STEPS, MOST = 20, 60  # steps in a decimal digit; p-values below 10**-MOST count as that
LEVEL = 0.01

# Alphabets by the characters in a run: (name, pattern, symbols, classes' sizes).
ALPHABETS = [
    ("decimal", r"\A[0-9]+\z", "0123456789"),
    ("hex", r"\A([0-9a-f]+|[0-9A-F]+)\z", "0123456789abcdef"),
    ("base32", r"\A[A-Z2-7]+=*\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", r"\A[a-z]+\z", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"\A[A-Z]+\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", r"\A([0-9a-z]+|[0-9A-Z]+)\z", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"\A[0-9A-Za-z]+\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"\A[0-9A-Za-z+/_-]+=*\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def step(acc, v, i):
        start = acc["at"] + F.get(v["gaps"], i)
        match = F.get(v["matches"], i)
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(
            F.struct(start.alias("start"), end.alias("end"), match.alias("match")))).alias("found"))

    kind = "array<struct<start:int,end:int,match:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    all_ = let(F.struct(matches.alias("matches"), gaps.alias("gaps")), lambda v: F.aggregate(
        F.sequence(F.lit(0), F.size(v["matches"]) - 1), zero, lambda acc, i: step(acc, v, i), lambda acc: acc["found"]))
    return F.when(F.rlike(text, F.lit(pattern)), all_).otherwise(F.array().cast(kind))


def normal_tail(z: Column) -> Column:
    """P(Z <= z), from a fit of erfc whose relative error is small in the tails."""
    def upper(z):
        def fit(t):
            # The coefficients of a published Chebyshev fit of erfc.
            poly = F.lit(0.17087277)
            for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
                poly = poly * t + c
            return 0.5 * t * F.exp(-z * z / 2 + poly)

        return let(let(1.0 / (1.0 + 0.5 * F.abs(z) / math.sqrt(2)), fit), lambda p: F.when(z < 0, p).otherwise(1.0 - p))

    return let(z, upper)


def alphabet(run: Column) -> tuple[Column, Column]:
    """Symbols of the inferred encoding, and the run folded to them."""
    name = F.lit(None).cast("string")
    for _, pattern, symbols in reversed(ALPHABETS):
        name = F.when(run.rlike(pattern), symbols).otherwise(name)
    body = F.rtrim(F.translate(run, "-_", "+/"), F.lit("="))
    folded = F.when(run.rlike(r"\A[0-9A-F]+\z") | run.rlike(r"\A[0-9A-Z]+\z") & ~run.rlike(r"\A[A-Z2-7]+\z"), F.lower(body)).otherwise(body)
    return name, folded


def p_uniform(v: Column) -> Column:
    """Chi-squared: the chance that ordinary text repeats its symbols so little."""
    agree = total(F.array_distinct(v["chars"]), lambda c: F.pow(v["n"] - F.length(F.replace(v["body"], c, F.lit(""))), F.lit(2.0)))
    extra = v["n"] * (v["k"] * F.greatest(F.lit(COINCIDENCE), 1.6 / v["k"]) - 1.0)
    return normal_tail((v["k"] / v["n"] * agree - v["n"] - (v["k"] - 1 + extra)) / F.sqrt(2 * (v["k"] - 1) + 4 * extra))


def p_changes(v: Column) -> Column:
    """Runs: the chance that ordinary text changes its class so often."""
    kinds = F.translate(v["body"], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "A" * 26 + "a" * 26 + "0" * 10 + "++")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
    return normal_tail((CHANGES * (v["n"] - 1) + 0.5 - changes) / F.sqrt(CHANGES * (1 - CHANGES) * (v["n"] - 1)))


def p_serial(v: Column) -> Column:
    """Serial correlation: the chance that neighbours in ordinary text are so little related."""
    def with_mean(m):
        centred = F.transform(v["values"], lambda x: x - m)

        def ratio(c):
            spread = total(c, lambda x: x * x)
            lag = total(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x * y), lambda x: x)
            return let(spread, lambda s: F.when(s > 0, F.abs(lag / s)).otherwise(1.0))

        return let(centred, ratio)

    return normal_tail((let(total(v["values"], lambda x: x) / v["n"], with_mean) - CORRELATION) * F.sqrt(v["n"]))


def battery(run: Column) -> Column:
    """-log10 of the combined chance that ordinary text looks as random, in steps rounded down (null: no alphabet)."""
    symbols, body = alphabet(run)

    def spelled(s):
        return F.struct(
            s["body"].alias("body"), F.length(s["body"]).cast("double").alias("n"), F.length(s["symbols"]).cast("double").alias("k"),
            F.split(s["body"], "").alias("chars"),
            F.transform(F.split(s["body"], ""), lambda c: F.instr(s["symbols"], c).cast("double")).alias("values"))

    def tests(v):
        small = F.lit(1e-300)
        x = -(F.log(F.greatest(p_uniform(v), small)) + F.log(F.greatest(p_changes(v), small)) + F.log(F.greatest(p_serial(v), small)))
        tail = let(x, lambda t: (t - F.log(1 + t + t * t / 2)) / math.log(10))  # Fisher's method, three tests
        return F.floor(F.least(tail, F.lit(float(MOST))) * STEPS).cast("int")

    return let(F.struct(symbols.alias("symbols"), body.alias("body")), lambda s: F.when(
        s["symbols"].isNotNull() & (F.length(s["body"]) >= 16), let(spelled(s), tests)))


def band(run_length: Column) -> Column:
    """Length bands of half an octave."""
    return F.floor(F.log2(run_length.cast("double")) * 2).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (spans of known forms) and ``runs`` (candidate spans with band and p step)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def spans(kind, found):
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assign = F.filter(located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    base = F.concat(spans(0, assign), spans(1, located(text, ACCESS)), spans(2, located(text, HEX)))
    long = F.filter(located(text, PADDED), lambda m: m["end"] - m["start"] >= LEAST)
    runs = F.transform(long, lambda m: F.struct(
        m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"),
        band(m["end"] - m["start"]).alias("band"), battery(m["match"]).alias("step")))
    return (docs.withColumn("base", base).withColumn("runs", runs)
            .withColumn("runs", F.filter("runs", lambda r: r["step"].isNotNull() & ~F.exists(
                F.col("base"), lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))))


def cutoffs(scanned: DataFrame, level: float = LEVEL) -> dict[int, int]:
    """The smallest p step discovered in every band, by the Benjamini-Hochberg rule over all runs."""
    cells = (scanned.select(F.explode("runs").alias("r")).groupBy("r.band", "r.step").agg(F.count(F.lit(1)).alias("n"))
             .collect())  # at most (bands of half an octave) x (STEPS x MOST) rows
    out = {}
    for b in {c["band"] for c in cells}:
        own = sorted(((c["step"], c["n"]) for c in cells if c["band"] == b), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for step, n in own:
            seen += n
            if 10 ** (-step / STEPS) <= level * seen / total:
                out[b] = step
    return out


def with_spans(scanned: DataFrame, found: dict[int, int]) -> DataFrame:
    """``scanned`` with ``all_spans``: base spans and discovered runs by start, then kind."""
    least = F.lit(None).cast("int")
    for b, step in sorted(found.items()):
        least = F.when(F.col("r.band") == b, step).otherwise(least)

    def discovered(r):
        ok = F.lit(False)
        for b, step in sorted(found.items()):
            ok = ok | ((r["band"] == b) & (r["step"] >= step))
        return ok

    extra = F.transform(F.filter("runs", discovered), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return scanned.withColumn("all_spans", F.array_sort(F.concat("base", extra)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, base and all_spans of every row; the texts are read once."""
    scanned = stored(scan(docs.select("doc_id", "text")).drop("text"), "secret-scan")
    return with_spans(scanned, cutoffs(scanned, level))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans (sorted by start) replaced by ``mask``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        # A span that starts inside what is already masked only lengthens it.
        gap = F.when((s["start"] >= acc["at"]), F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.array_sort("base")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their secrets masked.  Scans twice, so that no text is stored or shuffled."""
    found = cutoffs(scan(docs.select("doc_id", "text")).select("runs"))
    spans = with_spans(scan(narrowed(docs)), found)
    return widened(spans, docs.columns, F.when(F.size("all_spans") > 0, redacted(F.col("text"), F.col("all_spans"))).otherwise(F.col("text")))


def _sql() -> str:
    """DuckDB SQL of the query: the same spans from split texts, the same battery over exploded characters."""
    def found(kind: int, pattern: str, keep: str = "true", match: str = "matches[i]") -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  SELECT row, kind, start, start + length(match) AS stop, match FROM (
    SELECT row, {kind} AS kind, {match} AS match,
           list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0) AS start
    FROM (SELECT row, matches, gaps, unnest(range(1, len(matches) + 1)) AS i FROM (
      SELECT row, regexp_extract_all(t, '{quoted}') AS matches, string_split_regex(t, '{quoted}') AS gaps FROM d))) WHERE {keep}"""

    def tail(z: str) -> str:
        t = f"(1.0 / (1.0 + 0.5 * abs({z}) / {math.sqrt(2)!r}::DOUBLE))"
        poly = "0.17087277::DOUBLE"
        for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
            poly = f"({poly} * {t} + ({c}::DOUBLE))"
        upper = f"(0.5 * {t} * exp(-({z}) * ({z}) / 2 + {poly}))"
        return f"(CASE WHEN {z} < 0 THEN {upper} ELSE 1.0 - {upper} END)"

    # There is no look-ahead: signs of equality are taken along and cut off again where the run goes on behind them.
    run = "[A-Za-z0-9+/_-]{16,}=*"
    goes_on = "(gaps[i + 1] = '' AND i < len(matches) OR regexp_matches(gaps[i + 1], '^[A-Za-z0-9+/_-]'))"
    unpadded = f"CASE WHEN {goes_on} THEN rtrim(matches[i], '=') ELSE matches[i] END"
    symbols = "CASE " + " ".join(f"WHEN regexp_matches(match, '{pattern}') THEN '{chars}'" for _, pattern, chars in ALPHABETS) + " END"
    assign = ASSIGN.replace("'", "''")
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), base AS ({found(0, ASSIGN, f"length(regexp_extract(match, '{assign}', 2)) >= 6")}
  UNION ALL {found(1, ACCESS)}
  UNION ALL {found(2, HEX)}
), runs AS (
  SELECT r.*, row_number() OVER () AS id FROM ({found(3, run, f"length(match) >= {LEAST}", unpadded)}) r
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = r.row AND b.start <= r.start AND b.stop >= r.stop)
), folded AS (
  SELECT id, row, kind, start, stop, {symbols} AS symbols,
         CASE WHEN regexp_matches(match, '\A[0-9A-F]+\z') OR regexp_matches(match, '\A[0-9A-Z]+\z') AND NOT regexp_matches(match, '\A[A-Z2-7]+\z')
              THEN lower(body) ELSE body END AS body
  FROM (SELECT *, rtrim(translate(match, '-_', '+/'), '=') AS body FROM runs)
), v AS (
  SELECT *, CAST(length(body) AS DOUBLE) AS n, CAST(length(symbols) AS DOUBLE) AS k FROM folded WHERE symbols IS NOT NULL AND length(body) >= 16
), c AS (
  SELECT id, pos, ch, CAST(instr(symbols, ch) AS DOUBLE) AS x,
         translate(ch, '{big}{big.lower()}0123456789+/', '{"A" * 26}{"a" * 26}{"0" * 10}++') AS class
  FROM (SELECT id, symbols, unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS pos FROM v)
), agree AS (
  SELECT id, sum(m * m) AS agree FROM (SELECT id, ch, CAST(count(*) AS DOUBLE) AS m FROM c GROUP BY id, ch) GROUP BY id
), centred AS (
  SELECT *, x - avg(x) OVER (PARTITION BY id) AS y, class <> lag(class) OVER (PARTITION BY id ORDER BY pos) AS change FROM c
), lagged AS (
  SELECT *, y * lead(y) OVER (PARTITION BY id ORDER BY pos) AS yy FROM centred
), series AS (
  SELECT id, CASE WHEN sum(y * y) > 0 THEN abs(sum(yy) / sum(y * y)) ELSE 1.0 END AS serial, CAST(count_if(change) AS DOUBLE) AS changes
  FROM lagged GROUP BY id
), extra AS (
  SELECT v.*, a.agree, s.serial, s.changes, n * (k * greatest({COINCIDENCE}, 1.6 / k) - 1.0) AS extra
  FROM v JOIN agree a USING (id) JOIN series s USING (id)
), z AS (
  SELECT *, (k / n * agree - n - (k - 1 + extra)) / sqrt(2 * (k - 1) + 4 * extra) AS z1,
         ({CHANGES} * (n - 1) + 0.5 - changes) / sqrt({CHANGES} * (1 - {CHANGES}) * (n - 1)) AS z2, (serial - {CORRELATION}) * sqrt(n) AS z3
  FROM extra
), p AS (
  SELECT *, -(ln(greatest({tail("z1")}, 1e-300)) + ln(greatest({tail("z2")}, 1e-300)) + ln(greatest({tail("z3")}, 1e-300))) AS f FROM z
), steps AS (
  SELECT *, CAST(floor(log2(CAST(stop - start AS DOUBLE)) * 2) AS INTEGER) AS band,
         CAST(floor(least((f - ln(1 + f + f * f / 2)) / ln(10), {MOST}) * {STEPS}) AS INTEGER) AS step
  FROM p
), cells AS (
  SELECT band, step, sum(count(*)) OVER (PARTITION BY band ORDER BY step DESC) AS seen, sum(count(*)) OVER (PARTITION BY band) AS total
  FROM steps GROUP BY band, step
), cut AS (
  SELECT band, min(step) AS least FROM cells WHERE pow(10.0, -step / {STEPS}.0) <= {LEVEL} * seen / total GROUP BY band
), found AS (
  SELECT row, kind, start, stop FROM base
  UNION ALL SELECT row, kind, start, stop FROM steps JOIN cut USING (band) WHERE step >= least
), said AS (
  SELECT row, kind, start, [{kinds}][kind + 1] || ':' || start || ':' || stop AS span FROM found
)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN said USING (row) GROUP BY d.row
"""


SQL = _sql()
