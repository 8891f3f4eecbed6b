"""URL filters: fixed host/path rules, then association rules that FP-growth mines from labelled urls.

A url becomes a set of tokens (host suffixes, host labels, path segments with their numbers written ``#``, file extension, query keys,
fragment). Spark's FP-growth finds frequent token sets together with the label; rules ``tokens => label`` are kept by support (a
share of the labelled urls and at least ``min_count`` of them), confidence and lift, and a rule is dropped if a rule on fewer
tokens is as confident. The kept rules stand in an inverted index under their rarest token; a url looks its tokens up there and the
candidates are verified as subsets.

A host suffix implies its shorter ones and the labels in it, so that sets which hold both say nothing more, but there are
exponentially many of them. Mining therefore goes by levels: at level n a url has its suffix of n labels, the labels before it, and its
other tokens. No rule that is not redundant is lost: it holds one suffix at most, and stands at that suffix's level, or at the first
level if it has none.

Defined cases: a null url or one without ``://`` has an empty host and path and no tokens, so nothing fits and the verdict is
``allow``; an empty host or path of a rule fits every host or path; of rules of equal length that fit, the first in the list wins;
with fewer than ``min_count`` labelled urls, or where no rule is strong enough, the method allows; of association rules that fit the
most confident wins, then the best supported, then the later verdict and rule by name; repeated rows are each judged; an empty
table gives an empty result; extra columns pass through.

Scale: DataFrame functions and Spark's own FP-growth only. Urls with equal token sets are judged once, so a hot host is one row
of the search. Nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "=block", "=allow"


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, else null; a short list, written as one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}")) | F.lit(not h)) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """The distinct tokens of a url, sorted; digits in a path stand as ``#``."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.greatest(n, F.lit(1))), ".")))
    suffixes = F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>"))
    parts = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    ext = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    more = F.filter(F.array(F.when(ext != "", F.concat(F.lit("ext:"), ext)), F.when(F.contains(url, F.lit("#")), F.lit("fragment"))), lambda x: x.isNotNull())
    return F.when(F.contains(url, F.lit("://")), F.array_sort(F.array_distinct(F.concat(suffixes, parts, segments, keys, more)))).otherwise(F.array().cast("array<string>"))


def at_level(level: int) -> F.Column:
    """The tokens of a url at a level of mining: of what its host implies only the suffix of ``level`` labels and the labels before it."""
    host = F.filter("tokens", lambda x: x.startswith("host:"))
    dots = lambda x: F.size(F.split(F.substr(x, F.lit(6)), r"\."))
    own = F.get(F.filter(host, lambda x: dots(x) == level), 0)
    whole = F.split(F.substr(F.get(F.array_sort(host, lambda x, y: dots(y) - dots(x)), 0), F.lit(6)), r"\.")
    before = F.transform(F.slice(whole, 1, F.greatest(F.size(whole) - level, F.lit(0))), lambda x: F.concat(F.lit("label:"), x))
    other = F.filter("tokens", lambda x: ~x.startswith("host:") & ~x.startswith("label:"))
    return F.when(own.isNotNull(), F.array_distinct(F.concat(F.array(own), before, other))).otherwise(other if level == 1 else F.lit(None).cast("array<string>"))


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.8, min_lift: float = 1.2) -> DataFrame:
    """``labelled(tokens, blocked boolean)`` -> rules (antecedent, verdict, confidence, lift, support, token)."""
    spark = labelled.sparkSession
    mark = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    known = written(labelled.where(F.col("blocked").isNotNull()).select("tokens", mark.alias("mark")), "url-labelled")
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, lift double, support double, token string")
    n = known.count()
    if n < min_count:
        return empty
    least = max(min_support * n, min_count)
    shares = {r.mark: r.k / n for r in known.groupBy("mark").agg(F.count("*").alias("k")).collect()}
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, level = None, 0
    while True:
        level += 1
        baskets = known.withColumn("items", at_level(level)).where(F.col("items").isNotNull()).select(F.array_union("items", F.array("mark")).alias("items"))
        baskets = written(baskets.repartition(parts), "url-baskets")
        k = baskets.count()
        if k < least:
            break
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / k), minConfidence=min_confidence, numPartitions=parts).fit(baskets)
        rules = model.associationRules.where(F.element_at("consequent", 1).isin(BLOCK, ALLOW))
        if level > 1:  # sets without a suffix are counted at the first level, over all urls
            rules = rules.where(F.exists("antecedent", lambda x: x.startswith("host:")))
        # Supports are shares of all labelled urls, whatever the level; lift compares with the label's share among all.
        share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.element_at("consequent", 1))
        rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 9).alias("verdict"), "confidence", (F.col("confidence") / share).alias("lift"), (F.col("support") * k / n).alias("support"))
        found = rules if found is None else found.unionByName(rules)
    if found is None:
        return empty
    found = written(found.where(F.col("lift") >= min_lift), "url-rules")
    shorter = found.select("verdict", F.col("antecedent").alias("part"), F.col("confidence").alias("other"))
    dropped = found.where(F.size("antecedent") > 1).withColumn("drop", F.explode("antecedent")).withColumn("part", F.array_remove("antecedent", F.col("drop")))
    dropped = dropped.join(shorter, ["verdict", "part"]).where(F.col("other") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    rules = found.join(dropped, ["antecedent", "verdict"], "left_anti")
    single = known.select(F.explode("tokens").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
    rarest = rules.select("antecedent", F.explode("antecedent").alias("item")).join(single, "item").groupBy("antecedent").agg(F.min(F.struct("freq", "item")).alias("x"))
    return written(rules.join(rarest.select("antecedent", F.col("x.item").alias("token")), "antecedent").select(*empty.columns), "url-index")


def match(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys(key, tokens)``, distinct -> (key, found): the most confident rule that fits, larger support first among equals."""
    probes = keys.select("key", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
    fits = probes.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "verdict", F.array_join("antecedent", " ").alias("rule")))
    return fits.groupBy("key").agg(best.alias("found"))


def judge(pages: DataFrame, labels: DataFrame, *, url: str = "url", blocked: str = "blocked", rules: list[tuple[str, str, str]] | None = None, keep: list[str] | None = None, **mining) -> DataFrame:
    """Per page: ``row`` (the kept columns), host, path, rule, verdict, learned (the association rule that fits, else null).

    ``labels(url, blocked)`` are the labelled urls.
    """
    rules = RULES if rules is None else rules
    keep = pages.columns if keep is None else keep
    h, p = host_path(labels[url].cast("string"))
    learned = mine(labels.select(tokens(labels[url].cast("string"), h, p).alias("tokens"), labels[blocked].cast("boolean").alias("blocked")), **mining)
    raw = pages[url].cast("string")
    h, p = host_path(raw)
    df = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"), h.alias("host"), p.alias("path"), tokens(raw, h, p).alias("tokens"))
    df = df.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("key", F.array_join("tokens", " "))
    found = match(df.groupBy("key").agg(F.first("tokens").alias("tokens")), learned)
    df = df.join(found, "key", "left")
    return df.select("row", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "found.verdict", F.lit("allow")).alias("verdict"), F.col("found.rule").alias("learned"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls labelled by the document that they end in: blocked if it is toxic or of low quality."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?(?:[?#]|$)", 1)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    return pages.select("url", F.try_to_number(F.nullif(number, F.lit("")), F.lit("9" * 18)).cast("bigint").alias("doc_id")).join(marks, "doc_id").select("url", "blocked")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), keep=["page_id"])
    return out.select("row.*", "host", "path", "rule", "verdict", "learned")
