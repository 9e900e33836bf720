"""URL filter, in DataFrame functions only: a list of rules, then association rules mined from labelled URLs.

Every URL becomes a set of tokens (scheme, host labels with their place, path segments, query keys, suffix). FP-growth
over the tokens and labels of URLs that no listed rule judges gives rules tokens => block; those of enough support and
confidence, and not implied by a smaller rule of at least their confidence, go into an inverted index, each by the
rarest of its tokens. Each different token set is matched once. What the list says is never learned from.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import attach, checkpointed, scratch, written

#: (rule, verdict): host and path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Smallest share of the labelled URLs that a mined rule covers, and of those the smallest share that is blocked.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Least confidence less two standard errors: of the many rules tried, few pass by chance.
SURE = 0.7
#: A mined rule covers at least so many labelled URLs, however few there are.
LEAST_URLS = 20
BLOCK, ALLOW = "block", "allow"
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null for none."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL; numbers count as one token. A null url has the token ``no url``."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s, i: F.concat(F.lit("path"), F.least(i, F.lit(3)).cast("string"), F.lit("="), F.regexp_replace(s, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("query="), k))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "(?s)^(.*?)://", 1)))
    ends = F.array(F.concat(F.lit("end="), F.regexp_extract(path, r"(/|\.[A-Za-z0-9]{1,5})$", 1)))
    parts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    found = F.sort_array(F.array_distinct(F.filter(F.concat(scheme, parts, plain, keys, ends), lambda t: ~t.endswith("="))))
    return F.coalesce(found, F.array(F.lit("no url")))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, url, host, path, rule, listed, tokens) of every row."""
    d = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    d = d.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    return d.select("*", rule.alias("rule"), verdict.alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def labelled(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, label) of the URLs that no listed rule judges and that name a labelled document by the number at their path's end: block if its quality label is 0, else allow. Of several labels the smallest counts."""
    number = F.regexp_extract("path", r"([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    own = urls.where("listed is null").select("tokens", F.when(number != "", number.cast("long")).alias("doc")).where("doc is not null")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return own.join(marks, F.col("doc") == F.col("doc_id")).select("tokens", F.when(F.col("quality") == 0, BLOCK).otherwise(ALLOW).alias("label"))


def _by_rarest(rules: DataFrame, often: DataFrame) -> DataFrame:
    """rules with the token ``t`` of each that is rarest by ``often`` (t, f); rules with a token that isn't there are left out."""
    each = rules.select("name", F.explode("antecedent").alias("t"), F.size("antecedent").alias("size")).join(often, "t")
    least = each.groupBy("name").agg(F.min(F.struct("f", "t")).alias("least"), F.count("*").alias("known"), F.max("size").alias("size"))
    return rules.join(least.where("known = size").select("name", F.col("least.t").alias("t")), "name")


def mine(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sure: float = SURE) -> DataFrame:
    """(name, antecedent, confidence, support) of the block rules that stay after pruning; none if the labels support none. There are at most 2**t / support for URLs of t tokens, whatever the number of URLs."""
    spark = examples.sparkSession
    schema = "name string, antecedent array<string>, confidence double, support double"
    baskets = examples.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    n = baskets.count()
    if n < LEAST_URLS:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=max(support, LEAST_URLS / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == LABEL + BLOCK))
    found = found.where(F.col("confidence") - 2 * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) * F.col("confidence") / (F.col("support") * n)) >= sure)
    found = checkpointed(found.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support").withColumn("name", F.array_join("antecedent", " & ")))
    # a rule is implied if dropping some of its tokens leaves a rule of at least its confidence, whose rarest token it has
    often = found.select(F.explode("antecedent").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    small = _by_rarest(found, often).select("t", F.col("antecedent").alias("part"), F.col("confidence").alias("at_least"))
    large = found.select("name", "antecedent", "confidence", F.explode("antecedent").alias("t"))
    within = (F.size("part") < F.size("antecedent")) & (F.col("at_least") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    implied = large.join(small, "t").where(within).select("name").distinct()
    return checkpointed(found.join(implied, "name", "left_anti").select("name", "antecedent", "confidence", "support"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, n, learned) for each different token set of urls: the fitting rule of highest confidence (ties: larger support, then name), null for none."""
    sets = checkpointed(urls.groupBy("tokens").agg(F.count("*").alias("n")))
    each = sets.select("tokens", F.explode("tokens").alias("t"))
    index = _by_rarest(rules, each.groupBy("t").agg(F.count("*").alias("f")))
    hits = each.join(index, "t").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.min_by("name", F.struct(-F.col("confidence"), -F.col("support"), F.col("name"))).alias("learned"))
    return written(sets.join(best, "tokens", "left"), "url-sets", keep=True)


def evaluate(examples: DataFrame, share: float = 0.5, support: float = SUPPORT, confidence: float = CONFIDENCE) -> dict[str, float]:
    """Mines the rules from a share of the labelled URLs, chosen by a hash, and measures them on the others: number of rules, share of blocked URLs, precision and recall of blocking."""
    with scratch(examples.sparkSession):
        examples = checkpointed(examples.withColumn("part", F.pmod(F.xxhash64("tokens", F.monotonically_increasing_id()), F.lit(1 << 20))))
        learn = F.col("part") < int(share * (1 << 20))
        rules = mine(examples.where(learn), support, confidence)
        rest = checkpointed(examples.where(~learn))
        told = rest.join(match(rest, rules).select("tokens", "learned"), "tokens")
        hit, bad = F.col("learned").isNotNull().cast("int"), (F.col("label") == BLOCK).cast("int")
        r = told.agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.sum(bad).alias("bad"), F.sum(hit * bad).alias("both")).first()
        n_rules = rules.count()
    return {"rules": n_rules, "urls": r["n"], "base_rate": (r["bad"] or 0) / max(r["n"], 1), "precision": (r["both"] or 0) / r["hits"] if r["hits"] else 1.0, "recall": (r["both"] or 0) / r["bad"] if r["bad"] else 1.0}


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, learned) of every row.

    The listed rule decides; else a URL is blocked if a mined rule fits it, and allowed otherwise. A null URL, or one
    without ``://``, has an empty host and path; an empty or very long URL is read whole. Ties between mined rules go to the larger support, then the name. Repeated rows are judged alike; an empty table gives an empty table.
    """
    with scratch(pages.sparkSession):
        urls = written(parsed(pages, id_col, url_col, rules), "urls", keep=True)
        total = urls.count()
        matched = match(urls, mine(labelled(urls, labels), support, confidence))
    out = attach(urls, matched, ["tokens"], "n", total)
    verdict = F.coalesce("listed", F.when(F.col("learned").isNotNull(), BLOCK).otherwise(ALLOW))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("listed").isNull(), F.col("learned")).alias("learned"))
