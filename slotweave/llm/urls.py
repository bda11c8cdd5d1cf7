"""URL filter: rules first, then the likelihood ratio of two character language models.

URLs that a rule accepts or rejects train one variable-order Markov model each: a character is predicted from up to
three before it, every order smoothed with the next lower one by the number of characters seen to follow
(Witten-Bell). The score is the difference of log-likelihoods per character; the threshold is the one that separates
accepted and rejected URLs of a calibration fold best. All of it is DataFrame expressions: a URL is cut into
character n-grams, counts are aggregated before they are shuffled, and the ratio of an n-gram is looked up in a
table of the n-grams met. Digits count as one character and rare characters as another, so there are 34 in all and at
most 34^4 n-grams, whatever the corpus: the table has a bound under which it is always sent to the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.session import broadcast_if_small, stage

ORDER = 4
FOLD = 5  # one in so many ids calibrates instead of training
STEPS = 100  # threshold steps per unit of the score
SIGNS = 34  # characters left after folding: letters, a digit, / . _ - *, start and end

# (host, path, verdict); a rule holds for its host and all subdomains.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS, _DIGIT = "123456789", "000000000"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules=None) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a list a person keeps; it becomes one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules or RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letters(host: Column, path: Column) -> Column:
    """The text the models read: host and path in lower case, digits and rare characters folded, start and end marked."""
    low = F.translate(F.concat(host, path), _UPPER + _DIGITS, _LOWER + _DIGIT)
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(low, r"[^a-z0/._\-]", "*"), F.lit("$"))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each character: the n-gram that ends with it."""
    places = F.sequence(F.lit(1), F.length("letters") - (ORDER - 1))
    return rows.select(*keep, "letters", F.explode(places).alias("at")).select(
        *keep, F.expr(f"substring(letters, at, {ORDER})").alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log p(accepted) - log p(rejected) of the last character, for every row of (gram, a, b)."""
    below = None
    for k in range(1, ORDER + 1):
        level = counts.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        around = Window.partitionBy(F.expr(f"left(gram, {k - 1})"))  # at most as many rows as there are characters
        for c in "ab":
            level = level.withColumn(f"n{c}", F.sum(c).over(around)).withColumn(
                f"t{c}", F.sum((F.col(c) > 0).cast("long")).over(around))
        if below is None:
            level = level.withColumn("pa", F.lit(1.0 / SIGNS)).withColumn("pb", F.lit(1.0 / SIGNS))
        else:
            level = level.join(below, F.expr(f"right(gram, {k - 1})") == below["lower"]).drop("lower")
        for c in "ab":
            n, t, p = F.col(f"n{c}"), F.col(f"t{c}"), F.col(f"p{c}")
            level = level.withColumn(f"p{c}", F.when(n > 0, (F.col(c) + t * p) / (n + t)).otherwise(p))
        below = level.select(F.col("gram").alias("lower"), "pa", "pb")
    return below.select(F.col("lower").alias("gram"), (F.log("pa") - F.log("pb")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score that gives the least mean error of both classes on (score, known), in the middle of its gap; 0 without both."""
    bins = scored.groupBy(F.floor(F.col("score") * STEPS).alias("bin")).agg(
        F.sum((F.col("known") == "allow").cast("long")).alias("a"), F.sum((F.col("known") == "block").cast("long")).alias("b"))
    # A few thousand bins at most: scores are logarithms of smoothed probabilities.
    every, upto = Window.partitionBy(), Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wrong = bins.select(
        "bin", F.lag("bin").over(Window.partitionBy().orderBy("bin")).alias("under"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"),
        F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("lost"),
        (F.sum("b").over(every) - F.coalesce(F.sum("b").over(upto), F.lit(0))).alias("passed"))
    best = wrong.where("na > 0 AND nb > 0").orderBy(
        F.col("lost") * F.col("nb") + F.col("passed") * F.col("na"), "bin").select("bin", "under").first()
    return (best["bin"] + (best["bin"] if best["under"] is None else best["under"] + 1)) / 2 / STEPS if best else 0.0


def judge(pages: DataFrame, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of ``pages(page_id, url)``, a row each.

    A null URL, or one without ``://``, has neither host nor path; the models judge it by its end sign alone. Without
    accepted or without rejected URLs the threshold is 0. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", found.alias("found")).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("known"),
        letters(F.col("host"), F.col("path")).alias("letters"))
    calibrates = F.coalesce(F.col("page_id") % FOLD == 0, F.lit(False))
    learns = rows.select("letters", *[
        ((F.col("known") == v) & ~calibrates).cast("long").alias(c) for c, v in (("a", "allow"), ("b", "block"))])
    counts = _grams(learns.na.fill(0), "a", "b").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratios = broadcast_if_small(stage(log_ratios(stage(counts, "grams")), "ratios"))
    tagged = rows.withColumn("row", F.monotonically_increasing_id())
    columns = ["row", "page_id", "host", "path", "rule", "known"]
    scored = _grams(tagged, *columns).join(ratios, "gram").groupBy(*columns).agg(
        F.round(F.sum("ratio") / F.count("*"), 6).alias("score"))
    scored = stage(scored.drop("row"), "scored")
    cut = threshold(scored.where(calibrates & F.col("known").isNotNull()))
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("known", by_score).alias("verdict"), "score")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{w}'{h}{p}'" for w, (h, p, _) in zip(fits, rules)) + " END"
    known = "CASE " + " ".join(f"{w}'{v}'" for w, (_, _, v) in zip(fits, rules)) + " END"
    lower = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"
    fold = f"translate(host || path, '{_UPPER}{_DIGITS}', '{_LOWER}{_DIGIT}')"
    parts = [f"""rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT row_number() OVER () AS r, *, {rule} AS rule, {known} AS known,
  '{"^" * (ORDER - 1)}' || regexp_replace({fold}, '[^a-z0/._-]', '*', 'g') || '$' AS letters FROM cut),
grams AS (SELECT r, coalesce(page_id % {FOLD} = 0, false) AS c, known, substr(letters, place, {ORDER}) AS gram
  FROM (SELECT r, page_id, known, letters, unnest(range(1, length(letters) - {ORDER - 2})) AS place FROM ruled)),
counts AS (SELECT gram, count(*) FILTER (known = 'allow' AND NOT c) AS a, count(*) FILTER (known = 'block' AND NOT c) AS b FROM grams GROUP BY gram)"""]
    for k in range(1, ORDER + 1):
        before = f"1.0::DOUBLE / {SIGNS}" if k == 1 else "{}"
        source = f"s{k}" if k == 1 else f"s{k} JOIN l{k - 1} p ON right(s{k}.gram, {k - 1}) = p.gram"
        probability = ", ".join(
            f"CASE WHEN n{c} > 0 THEN (s{k}.{c} + t{c} * {before.format('p.p' + c)}) / (n{c} + t{c}) ELSE {before.format('p.p' + c)} END AS p{c}" for c in "ab")
        parts.append(f"""c{k} AS (SELECT right(gram, {k}) AS gram, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
s{k} AS (SELECT gram, a::DOUBLE AS a, b::DOUBLE AS b, {", ".join(f"sum({c}) OVER w::DOUBLE AS n{c}, count(*) FILTER ({c} > 0) OVER w AS t{c}" for c in "ab").replace("OVER w::DOUBLE", "OVER w")} FROM c{k} WINDOW w AS (PARTITION BY left(gram, {k - 1}))),
l{k} AS (SELECT s{k}.gram, {probability} FROM {source})""")
    parts.append(f"""scored AS (SELECT r, round(sum(ln(pa) - ln(pb)) / count(*), 6) AS score FROM grams JOIN l{ORDER} USING (gram) GROUP BY r),
bins AS (SELECT floor(score * {STEPS}) AS bin, count(*) FILTER (known = 'allow') AS a, count(*) FILTER (known = 'block') AS b
  FROM scored JOIN ruled USING (r) WHERE page_id % {FOLD} = 0 AND known IS NOT NULL GROUP BY 1),
wrong AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS under, sum(a) OVER () AS na, sum(b) OVER () AS nb, coalesce(sum(a) OVER u, 0) AS lost, sum(b) OVER () - coalesce(sum(b) OVER u, 0) AS passed
  FROM bins WINDOW u AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT (bin + coalesce(under + 1, bin)) / 2 / {STEPS} AS cut FROM wrong WHERE na > 0 AND nb > 0 ORDER BY lost * nb + passed * na, bin LIMIT 1)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, host, path, rule, coalesce(known, CASE WHEN score >= coalesce((SELECT cut FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM ruled JOIN scored USING (r)"""
