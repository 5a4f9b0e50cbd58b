"""URL filters by association rules.

Explicit rules (host, path) decide first.  The other urls are judged by mined
rules: FP-growth finds combinations of url tokens that go with a label, and rules
of enough support and confidence are kept.  Labels are a table (url, verdict) of
the caller's, or ``builtin_labels``; they do not come from the explicit rules.
Rules are matched by an inverted index: each is filed under its rarest token, and
a url meets the rules filed under its tokens.  Urls are judged once each,
whatever the number of pages that have them.

Cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed; repeated rows are judged each; of rules that fit, the one of
highest confidence, then most tokens, then support, then the tokens in order,
decides; null labels are left out, and without labels no rule is mined and the
verdict is ``allow``; a url of any length is read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

# The explicit rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Words of the built-in labelled urls.  Cues and pairs are unwanted, plain and shared words are not.
CUES = "casino bets poker slots jackpot roulette pills pharma viagra adult xxx porn spam ads adserver banner payday".split()
PAIRS = ("link farm", "click track", "fast cash", "hot singles", "miracle diet", "work home")
SHARED = "free cheap win best top new online club shop live x track farm click cash fast hot home work diet link".split()
PLAIN = (
    "news library science school garden museum music city river book travel weather history art forum wiki docs code health kitchen sport radio photo "
    "theatre market mountain bridge harbour castle letter paper studio design energy water forest animal planet research college council village"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
BROADCAST_ROWS = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, SPLIT, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for text, say in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels with their place from the right, words of labels, path parts, query names; digits are one token."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(host, r"[._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), F.regexp_replace(x, r"[0-9]+", "0")))
    parts = F.transform(F.filter(F.split(F.translate(path, UPPER, LOWER), r"[/._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), F.translate(x, UPPER, LOWER)))
    scheme = F.array(F.concat(F.lit("s:"), F.translate(F.substring_index(F.coalesce(url, F.lit("")), "://", 1), UPPER, LOWER)))
    return F.array_distinct(F.concat(scheme, labels, words, parts, names))


def builtin_labels(spark: SparkSession, n: int = 8000, seed: int = 1) -> DataFrame:
    """(url, verdict): ``n`` labelled urls, half of them of unwanted sites.

    Unwanted names have a cue word or both words of a pair; the words of a pair, and
    those shared by both halves, stand in wanted names too.  All else is alike.
    """
    draw = lambda i, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(m)).cast("int")
    pick = lambda i, words: F.get(F.array(*[F.lit(w) for w in words]), draw(i, len(words)))
    pair = F.split(pick(2, PAIRS), " ")
    first, second = F.get(pair, draw(3, 2)), F.get(pair, 1 - draw(3, 2))
    style = draw(4, 5)
    named = lambda word: F.when(style == 0, word).when(style == 1, F.concat_ws("-", word, pick(5, SHARED))).otherwise(F.concat_ws("-", pick(5, SHARED), word))
    bad = F.when(style == 4, F.concat_ws("-", first, second)).otherwise(named(pick(6, CUES)))
    good = named(pick(6, PLAIN))
    site = F.concat(pick(7, ["", "", "www.", "m.", "blog."]), F.when(F.col("id") % 2 == 0, bad).otherwise(good), pick(8, [".com", ".net", ".org", ".example.com", ".example.net", ".example.org"]))
    path = F.concat(F.lit("/"), pick(9, ["en", "de", "fr", "es"]), F.lit("/"), draw(10, 10_000).cast("string"), pick(11, ["", "/", ".html", "?page=2", "#top"]))
    url = F.concat(pick(12, ["http://", "https://"]), site, path)
    return spark.range(n).select(url.alias("url"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9, lift: float = 1.0) -> DataFrame:
    """(antecedent, verdict, confidence, support) mined from (tokens, verdict), without rules that a shorter
    one with the same verdict and at least its confidence makes idle."""
    baskets = labelled.select(F.concat(F.array(F.concat(F.lit("="), "verdict")), "tokens").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")) & (F.col("lift") > lift))
    rules = scratch.stage(rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support"), "rules")
    longer = rules.filter(F.size("antecedent") > 1).withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, size(antecedent)) - 2)")))
    part = F.expr("array_join(filter(antecedent, (x, i) -> (shiftright(mask, i) & 1) = 1), '\\u0001')")
    known = rules.select(F.array_join("antecedent", "\x01").alias("part"), "verdict", F.col("confidence").alias("c"))
    idle = longer.withColumn("part", part).join(known, ["part", "verdict"]).filter("c >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(idle, ["antecedent", "verdict"], "left_anti")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of the best rule of each url of (url, tokens) that fits one: highest confidence, then most tokens, then support."""
    each = urls.select("url", "tokens", F.explode("tokens").alias("t"))
    seen = each.groupBy("t").agg(F.count("*").alias("n"))
    numbered = rules.withColumn("rule_key", F.array_join("antecedent", "\x01"))
    filed = numbered.select("*", F.explode("antecedent").alias("t")).join(seen, "t")
    rank = F.row_number().over(Window.partitionBy("rule_key", "verdict").orderBy("n", "t"))
    index = scratch.stage(filed.withColumn("rank", rank).filter("rank = 1").select("t", "antecedent", "verdict", "confidence", "support"), "index")
    size = index.count()
    met = each.join(F.broadcast(index) if size <= BROADCAST_ROWS else index, "t")
    fit = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", F.size("antecedent"), "support", F.array_join("antecedent", "\x01"), "verdict"))
    return fit.groupBy("url").agg(best.alias("mined"))


def with_tokens(urls: DataFrame) -> DataFrame:
    """``urls`` (url, ...) that have a host, with host, path and tokens."""
    host, path = host_and_path(F.col("url"))
    placed = urls.withColumns({"host": host, "path": path}).filter("host <> ''")
    return placed.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``labels`` (url, verdict) are ``builtin_labels`` by default."""
    labels = builtin_labels(pages.sparkSession) if labels is None else labels
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    judged = rows.withColumns({"rule": rule, "said": verdict})
    mined = mine(with_tokens(labels.select("url", "verdict").filter("verdict is not null")), support, confidence)
    open_ = judged.filter("host <> '' and said is null").select("url").distinct()
    other = apply_rules(scratch.stage(with_tokens(open_).select("url", "tokens"), "urls"), mined)
    out = judged.join(other, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "mined", F.lit("allow")).alias("verdict"))
