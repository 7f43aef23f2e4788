"""URL filter: listed rules, and association rules mined from labelled URLs.

A URL is a set of tokens (host labels, leading path segment, file type, query names,
fragment).  FP-growth mines frequent token sets together with their label; rules
"tokens -> label" with enough support and confidence stay unless a rule with fewer of
the same tokens is as confident.  Rules are matched by an inverted index: each lies
under its least frequent token, URLs look their tokens up, and candidates are checked
for the remaining tokens.  The most confident match decides; without one, and on a
tie, the verdict is allow.

Listed rules (host, path, verdict) come first: a rule fits its host and all its
subdomains if the path starts with the rule's; the longest fitting rule wins.

Defined results: the host runs from the first "://" to "/", "?", "#" or the end, A-Z
lower-cased; the path from there to "?", "#" or the end; a null URL or one without
"://" has neither, no tokens, no rule, and is allowed.  Repeated rows are judged each.
"""

from __future__ import annotations


from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import heavy_join, written

#: The listed rules: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: Mined rules up to which they are broadcast (counted first).
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers are left out, since they repeat too little to be mined."""
    hosts = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    lead = F.regexp_extract(path, r"^/([^/]*\D[^/]*)/", 1)
    kind = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    mark = F.regexp_extract(url, r"#(.*)$", 1)
    single = [F.when(x != "", F.concat(F.lit(f"{n}:"), x)) for n, x in (("path", lead), ("type", kind), ("mark", mark))]
    found = F.concat(hosts, names, F.array_compact(F.array(*single)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, label, confidence, support, token): pruned rules from ``labelled`` (tokens,
    label); ``token`` is the rule's least frequent one."""
    spark = labelled.sparkSession
    tag = "label="
    items = written(labelled.where(F.size("tokens") > 0).select(F.concat("tokens", F.array(F.concat(F.lit(tag), "label"))).alias("items")))
    empty = spark.createDataFrame([], "tokens array<string>, label string, confidence double, support double, token string")
    if items.isEmpty():
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith(tag) & ~F.exists("antecedent", lambda x: x.startswith(tag)))
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(tag) + 1})").alias("label"), "confidence", "support"))
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    # redundant: the rule without one of its tokens is as confident
    shorter = rules.select("tokens", "label", "confidence", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("less"))
    beaten = shorter.join(rules.select(F.col("tokens").alias("less"), "label", F.col("confidence").alias("other")), ["less", "label"]).where("other >= confidence").select("tokens", "label").distinct()
    kept = rules.join(beaten, ["tokens", "label"], "left_anti")
    keyed = kept.select("*", F.explode("tokens").alias("token")).join(counts, "token")
    return written(keyed.groupBy("tokens", "label", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("m")).select("tokens", "label", "confidence", "support", F.col("m.token").alias("token")))


def verdicts(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, confidence, matched): ``confidence`` and ``matched``
    are those of the mined rule that decided, if one did.

    Without ``labelled`` (tokens, label) the URLs that listed rules judge are the labels.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = written(base.select("id", "host", "path", name.alias("rule"), verdict.alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    mined = mine(labelled if labelled is not None else judged.where("listed is not null").select("tokens", F.col("listed").alias("label")), min_support, min_confidence)
    index = mined.select(F.col("tokens").alias("needs"), "label", "confidence", "token")
    if mined.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    # the same token set gets the same verdict: match each distinct one once
    is_open = F.col("listed").isNull() & (F.size("tokens") > 0)
    sets = judged.where(is_open).groupBy("tokens").agg(F.count("*").alias("weight"))
    hits = sets.select("tokens", "weight", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = written(hits.groupBy("tokens").agg(F.first("weight").alias("weight"), F.max(F.struct("confidence", F.col("label") == "allow", "needs", "label")).alias("best")))
    # sets without a match are joined as well, so that no row is lost
    every = written(sets.join(best.drop("weight"), "tokens", "left"))
    matched = heavy_join(judged.where(is_open), every, ["tokens"])
    columns = [F.col("id").alias(id_col), "host", "path", "rule"]
    mined_out = matched.select(*columns, F.coalesce("best.label", F.lit("allow")).alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.needs").alias("matched"))
    rest = judged.where(~is_open).select(*columns, F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("matched"))
    return mined_out.unionByName(rest)
