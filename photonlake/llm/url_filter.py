"""URL filter: host and path rules, and a character language-model ratio for what no rule covers; DataFrame operations only.

The urls that rules allow and those that they block each give a Markov model of the characters of host and path, digits as one sign.
Orders 0 to ORDER - 1 are blended by Witten-Bell: a context weighs its own counts by how many different signs have followed it,
the rest comes from the next shorter context. A url's score is the mean log-likelihood difference of a sign. The models learn
from 3 of 4 different urls, by a hash, and the threshold is the one that best tells the classes apart on the fourth, in the
middle between the scores on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small, staged

ORDER = 4
#: Score bins a unit for the calibration, which looks at scores from -SPAN to SPAN.
BINS, SPAN = 100, 20
#: One part in so many is for the calibration.
FOLDS = 4
#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct rule, verdict of the longest rule that fits (of two as long the one with the longer host, then a blocking one), or null."""
    best = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _signs(url: str) -> Column:
    """Host and path as a string of at most 42 different signs: letters, 0 for digits, some marks, ~ for the rest; ^ before and $ behind."""
    text = F.translate(F.concat(host_of(url), path_of(url)), _UPPER + "123456789", _LOWER + "000000000")
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(text, r"[^a-z0./:_%=&+,;@!*'()\-]", "~"), F.lit("$"))


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each run of ORDER signs."""
    at = F.explode(F.sequence(F.lit(1), F.length("signs") - (ORDER - 1)))
    return df.select(*keep, "signs", at.alias("_i")).select(*keep, F.col("signs").substr(F.col("_i"), F.lit(ORDER)).alias("gram"))


def model(signed: DataFrame) -> DataFrame:
    """gram, ratio: the log of the likelihood of a run's last sign for allowed urls over that for blocked ones.

    signed: signs, verdict (null where nothing is to be learnt), n (times that it occurs). Runs without a counted context fall back to shorter ones, at last to
    an even chance for each sign. One row for each different run of signs, of which there are 42 ** ORDER at most.
    """
    base = staged(_grams(signed.withColumn("yes", F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).withColumn("no", F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)), "yes", "no").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    out = base.select("gram")
    prob = {c: F.lit(1 / 42) for c in ("yes", "no")}
    for order in range(1, ORDER + 1):
        tail = F.col("gram").substr(F.lit(ORDER - order + 1), F.lit(order))
        counts = base.groupBy(tail.alias(f"t{order}")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = F.col(f"t{order}").substr(F.lit(1), F.lit(order - 1)) if order > 1 else F.lit("")
        counts = counts.withColumn("_c", context)
        in_context = Window.partitionBy("_c")
        for c in ("yes", "no"):
            counts = counts.withColumn(f"{c}_all{order}", F.sum(c).over(in_context)).withColumn(f"{c}_kinds{order}", F.sum((F.col(c) > 0).cast("long")).over(in_context)).withColumnRenamed(c, f"{c}{order}")
        out = out.withColumn(f"t{order}", tail).join(counts.drop("_c"), f"t{order}")
        for c in ("yes", "no"):
            weight = F.col(f"{c}_all{order}") + F.col(f"{c}_kinds{order}")
            prob[c] = F.when(weight > 0, (F.col(f"{c}{order}") + F.col(f"{c}_kinds{order}") * prob[c]) / F.when(weight > 0, weight)).otherwise(prob[c])
    return out.select("gram", (F.log(prob["yes"]) - F.log(prob["no"])).alias("ratio"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url).

    A null url, or one without ``://``, has an empty host and path, no rule, and is judged by the models as an empty string is. Repeated rows
    are judged alike. If the calibration part has no url of one class, the threshold is 0. score is null where a rule decides. An
    empty table gives an empty one; more columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), _signs("url").alias("signs"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "signs", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("fixed"))
    texts = staged(rows.groupBy("signs", F.col("fixed").alias("verdict")).agg(F.count("*").alias("n")))
    held = F.conv(F.left(F.md5("signs"), F.lit(4)), 16, 10).cast("int") % FOLDS == 0
    ratios = staged(model(texts.withColumn("verdict", F.when(~held, F.col("verdict")))))
    n = ratios.count()
    grams = _grams(texts, "signs", "verdict", "n").join(small(ratios, n), "gram")
    scored = staged(grams.groupBy("signs", "verdict", "n").agg((F.sum("ratio") / F.count("*")).alias("score")))
    bins = scored.where(F.col("verdict").isNotNull() & held).groupBy(F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) * BINS).alias("bin")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("no"))
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.sum(c).over(every)
    best = bins.withColumn("_both", (F.sum("yes").over(every) > 0) & (F.sum("no").over(every) > 0)).where("_both").withColumn("_gain", share("no") - share("yes")).withColumn("_middle", F.coalesce((F.lag("bin").over(every.orderBy("bin")) + 1 + F.col("bin")) / 2, F.col("bin")))
    cut = best.agg(F.max(F.struct("_gain", (-F.abs("bin")).alias("a"), "bin", "_middle")).alias("m")).select(F.coalesce(F.col("m._middle") / BINS, F.lit(0.0)).alias("cut"))
    cut = cut.first().cut  # one number
    judged = scored.where("verdict is null").select("signs", "score")
    out = rows.where("fixed is null").join(judged, "signs", "left").unionByName(rows.where("fixed is not null").withColumn("score", F.lit(None).cast("double")))
    verdict = F.coalesce("fixed", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def _sql() -> str:
    """The same rows for the rules above."""
    marks = r"[^a-z0./:_%=&+,;@!*''()\-]"
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    best = sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), reverse=True)
    case = lambda pick: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{pick(v, h + p)}'" for v, h, p in best) + " END"
    orders, prior = "", "1 / 42.0::DOUBLE"
    prob = {"yes": prior, "no": prior}
    joins = ""
    for k in range(1, ORDER + 1):
        orders += f""",
c{k} AS (SELECT *, sum(yes) OVER (PARTITION BY left(t, {k - 1})) AS yes_all, sum(no) OVER (PARTITION BY left(t, {k - 1})) AS no_all, count(*) FILTER (yes > 0) OVER (PARTITION BY left(t, {k - 1})) AS yes_kinds, count(*) FILTER (no > 0) OVER (PARTITION BY left(t, {k - 1})) AS no_kinds
  FROM (SELECT right(gram, {k}) AS t, sum(yes)::DOUBLE AS yes, sum(no)::DOUBLE AS no FROM b GROUP BY ALL))"""
        joins += f" JOIN c{k} ON c{k}.t = right(b.gram, {k})"
        for c in prob:
            weight = f"(c{k}.{c}_all + c{k}.{c}_kinds)"
            prob[c] = f"CASE WHEN {weight} > 0 THEN (c{k}.{c} + c{k}.{c}_kinds * {prob[c]}) / {weight} ELSE {prob[c]} END"
    return f"""
WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS fixed,
  '{"^" * (ORDER - 1)}' || regexp_replace(translate(host || path, '{_UPPER}123456789', '{_LOWER}000000000'), '{marks}', '~', 'g') || '$' AS signs FROM h),
x AS (SELECT signs, fixed, count(*) AS n, CAST('0x' || left(md5(signs), 4) AS BIGINT) % {FOLDS} = 0 AS held FROM u GROUP BY ALL),
g AS (SELECT signs, fixed, n, held, substr(signs, i, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(signs) - {ORDER - 2})) AS i FROM x)),
b AS (SELECT gram, sum(CASE WHEN fixed = 'allow' AND NOT held THEN n ELSE 0 END) AS yes, sum(CASE WHEN fixed = 'block' AND NOT held THEN n ELSE 0 END) AS no FROM g GROUP BY gram){orders},
r AS (SELECT b.gram, ln({prob["yes"]}) - ln({prob["no"]}) AS ratio FROM b{joins}),
s AS (SELECT signs, fixed, n, held, sum(ratio) / count(*) AS score FROM g JOIN r USING (gram) GROUP BY ALL),
i AS (SELECT floor(greatest(-{SPAN}, least({SPAN}, score)) * {BINS}) AS bin, sum(n) FILTER (fixed = 'allow') AS yes, sum(n) FILTER (fixed = 'block') AS no FROM s WHERE held AND fixed IS NOT NULL GROUP BY bin),
k AS (SELECT bin, coalesce((lag(bin) OVER (ORDER BY bin) + 1 + bin) / 2, bin) AS middle, coalesce(sum(no) OVER w, 0) / sum(no) OVER () - coalesce(sum(yes) OVER w, 0) / sum(yes) OVER () AS gain FROM i WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT middle / {BINS} FROM k WHERE gain IS NOT NULL ORDER BY gain DESC, abs(bin), bin DESC LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(u.fixed, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM cut, u LEFT JOIN s ON s.signs = u.signs AND s.fixed IS NULL"""


ORACLE_SQL = _sql()
