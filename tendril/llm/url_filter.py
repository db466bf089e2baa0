"""URL filter: fixed host and path rules, and association rules mined by FP-growth for the URLs that no fixed rule fits.

A URL is a set of tokens: its scheme, each suffix of its host, the words of its labels but the last, its path segments by place (digits
become `#`), the ending of the last, its query keys. From labelled URLs (label allow or block) Spark's FP-growth mines
token combinations with a label; rules under the support or the confidence go, and those of over LONGEST tokens, those
whose confidence is no more than MIN_LIFT times what the label has anyway, and those that a shorter one with the same
verdict and no less confidence covers. `held_out` measures the rules on labelled URLs that they were not mined from.

FP-growth lists every combination of the frequent tokens of a URL, 2^n for n of them, so the URLs are folded first: tokens
that stand in the same labelled URLs (equal counts and equal sums of two hashes of the rows) are one item, of which a rule
needs but one; afterwards each of them takes its place. Where a folded URL still has over FOLDED items, combinations are
counted level by level instead, which stops at LONGEST: the same rules, in time that grows with n^LONGEST at most.

Matching uses an inverted index of the rules: a rule is filed under its rarest token, found through that token, and then
its other tokens are looked for. Only tokens that some rule has matter, so URLs are first reduced to those: each
different reduced set is matched once, however many URLs share it. A URL has a bounded number of kinds of tokens and at
most 1/support tokens of a kind can be frequent, so there are no more frequent tokens than kinds/support, whatever the
input, and no more rules than combinations of LONGEST of them.

Defined cases: null urls and urls without `://` have an empty host and path, no tokens and the default verdict; repeated
rows are judged each; very long URLs are read whole; an empty table gives an empty result; without labels there are no
mined rules. Other columns are not read but for `carry`, where host, path, rule, verdict and confidence are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, dropped, stored
from .urls import host_of, path_of, query_of

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: And so many labelled URLs at least, however few there are.
MIN_COUNT = 5
DEFAULT = "allow"
LONGEST, MIN_LIFT = 4, 1.05
#: Items of a folded URL up to which FP-growth lists all combinations.
FOLDED = 14

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    inner = F.filter(labels, lambda _, i: i < F.size(labels) - 1)
    words = F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, "[-_]"))), lambda x: F.concat(F.lit("word:"), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#")
    places = F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), shape(x)))
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5}|/)\z", 1)
    keys = F.filter(F.transform(F.split(query_of(url), "&"), lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, r"\A([^=]*)", 1))), lambda x: x != "key:")
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    single = F.filter(F.array(F.concat(F.lit("scheme:"), F.lower(scheme)), F.concat(F.lit("end:"), ending)), lambda x: ~x.endswith(":"))
    return F.array_sort(F.array_distinct(F.concat(suffixes, words, places, keys, single)))


def folded(items: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (items, label) reduced to frequent tokens, one for those that always stand together, and stored (item, tokens): what each stands for.

    items: (items, label) with the tokens of each labelled URL. There are no more frequent tokens than kinds/support.
    """
    row = items.select("label", "items", F.monotonically_increasing_id().alias("row"))
    single = row.select(F.explode("items").alias("token"), F.xxhash64("row").cast("decimal(38,0)").alias("a"), F.xxhash64("row", F.lit(1)).cast("decimal(38,0)").alias("b"))
    frequent = single.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("n") >= least)
    groups = stored(frequent.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.get("tokens", F.lit(0)).alias("item"), "tokens"), "url-groups")
    kept = [r["item"] for r in groups.select("item").orderBy("item").collect()]
    wanted = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<string>")
    return stored(row.select("label", F.array_intersect("items", wanted).alias("items")), "url-folded"), groups


def grown(rows: DataFrame, least: int, total: int) -> DataFrame:
    """(antecedent, verdict, n, all): combinations of items with a label by FP-growth; n rows have both, `all` the items."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = rows.select(F.concat("items", F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    # the smallest support whose rounded-up count is `least`
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=0.0, numPartitions=partitions).fit(labelled)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    labels = F.filter("items", lambda x: x.startswith("="))
    bare = F.filter("items", lambda x: ~x.startswith("="))
    both = sets.filter(F.size(labels) == 1).select(bare.alias("antecedent"), F.substring(F.get(labels, F.lit(0)), 2, 9).alias("verdict"), F.col("freq").alias("n"))
    alone = sets.filter(F.size(labels) == 0).select(F.col("items").alias("antecedent"), F.col("freq").alias("all"))
    return both.join(alone, "antecedent")


def counted(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """As `grown` for combinations of up to `longest` items, level by level: each level extends the frequent combinations of the last by later items of the same URL."""
    distinct = stored(rows.groupBy(F.array_sort("items").alias("items")).agg(F.count_if(F.col("label") == "allow").alias("allow"), F.count_if(F.col("label") == "block").alias("block")), "url-distinct")
    level = distinct.select("items", "allow", "block", F.array().cast("array<string>").alias("antecedent"), F.lit(0).alias("next"))
    found: DataFrame | None = None
    for _ in range(longest):
        later = F.filter(F.sequence(F.lit(0), F.size("items")), lambda i: (i >= F.col("next")) & (i < F.size("items")))
        wider = level.select("items", "allow", "block", "antecedent", F.explode(later).alias("i"))
        wider = wider.select("items", "allow", "block", F.concat("antecedent", F.array(F.get("items", F.col("i")))).alias("antecedent"), (F.col("i") + 1).alias("next"))
        sums = stored(wider.groupBy("antecedent").agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block")).filter(F.greatest("n_allow", "n_block") >= least), "url-level")
        level = wider.join(sums.select("antecedent"), "antecedent", "left_semi")
        both = F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(f"n_{v}").alias("n")) for v in ("allow", "block")))
        each = sums.select("antecedent", F.explode(both).alias("v"), (F.col("n_allow") + F.col("n_block")).alias("all")).select("antecedent", "v.verdict", "v.n", "all").filter(F.col("n") >= least)
        found = each if found is None else found.unionByName(each)
    return found


def unfolded(rules: DataFrame, groups: DataFrame, longest: int) -> DataFrame:
    """Each rule once for every choice of one token for each of its items."""
    choice = groups.select("item", F.explode("tokens").alias("token"))
    for k in range(longest):
        chosen = rules.withColumn("item", F.get("antecedent", F.lit(k))).join(choice, "item", "left").withColumn("at", F.lit(k))
        rules = chosen.withColumn("antecedent", F.transform("antecedent", lambda x, i: F.when(i == F.col("at"), F.col("token")).otherwise(x))).drop("item", "token", "at")
    return rules


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, longest: int = LONGEST, min_lift: float = MIN_LIFT, most_folded: int = FOLDED) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support) from labelled URLs (url, label). Stored."""
    spark = labelled.sparkSession
    items = labelled.filter(F.col("label").isin("allow", "block") & F.col("url").isNotNull()).select("label", tokens(F.col("url")).alias("items"))
    items = stored(items, "url-items")
    labels = {r["label"]: r["n"] for r in items.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(labels.values())
    if not total:
        return stored(spark.createDataFrame([], "rule_id long, antecedent array<string>, verdict string, confidence double, support double"), "url-rules")
    least = max(min_count, math.ceil(min_support * total - 1e-9))
    rows, groups = folded(items, least)
    width = rows.agg(F.max(F.size("items"))).first()[0]
    mined = grown(rows, least, total) if width <= most_folded else counted(rows, least, longest)
    share = F.when(F.col("verdict") == "allow", labels.get("allow", 0) / total).otherwise(labels.get("block", 0) / total)
    mined = mined.filter((F.size("antecedent") > 0) & (F.size("antecedent") <= longest)).select("antecedent", "verdict", (F.col("n") / F.col("all")).alias("confidence"), (F.col("n") / total).alias("support"))
    mined = stored(mined.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") / share >= min_lift)), "url-mined")
    # a rule is covered by one with one token fewer, or by what covers that one
    shorter = mined.select(F.array_sort("antecedent").alias("part"), "verdict", F.col("confidence").alias("enough"))
    parts = mined.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_sort(F.array_except("antecedent", F.array(x))))).alias("part"))
    covered = parts.join(shorter, ["part", "verdict"]).filter("enough >= confidence").select("antecedent", "verdict").distinct()
    left = unfolded(mined.join(covered, ["antecedent", "verdict"], "left_anti"), groups, longest).withColumn("antecedent", F.array_sort("antecedent"))
    return stored(left.select(F.xxhash64("antecedent", "verdict").alias("rule_id"), "antecedent", "verdict", "confidence", "support"), "url-rules")


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, rule_id, antecedent, verdict, confidence, support): each rule under the token that fewest rules have."""
    single = rules.withColumn("token", F.explode("antecedent"))
    common = single.groupBy("token").agg(F.count("*").alias("rules"))
    rarest = single.join(common, "token").groupBy("rule_id").agg(F.min(F.struct("rules", "token")).alias("first"))
    return rules.join(rarest, "rule_id").select(F.col("first.token").alias("token"), "rule_id", "antecedent", "verdict", "confidence", "support")


def judge(urls: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns `carry`, host, path, rule, verdict, and confidence of the mined rule where one decided.

    Of several mined rules that match, the surest decides; of equally sure ones, the longest, then the first by tokens.
    """
    spark = urls.sparkSession
    known = [r["token"] for r in rules.select(F.explode("antecedent").alias("token")).distinct().orderBy("token").collect()]
    wanted = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    url = F.col("url")
    own = ("host", "path", "rule", "verdict", "confidence")
    carried = [c for c in carry if c not in own]
    row = F.struct(*(F.col(f"`{c}`") for c in carried)) if carried else F.lit(None)
    read = urls.select(row.alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.array_join(F.array_intersect(tokens(url), wanted), "\t").alias("reduced"))
    read = stored(read.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed)), "url-tokens")

    sets = read.filter("fixed is null and reduced <> ''").select("reduced").distinct()
    held = sets.withColumn("held", F.split("reduced", "\t"))
    found = held.withColumn("token", F.explode("held")).join(inverted_index(rules), "token").filter(F.size(F.array_except("antecedent", "held")) == 0)
    best = Window.partitionBy("reduced").orderBy(F.desc("confidence"), F.desc(F.size("antecedent")), "antecedent", "verdict")
    verdicts = stored(found.withColumn("place", F.row_number().over(best)).filter("place = 1").select("reduced", F.col("verdict").alias("mined"), "confidence"), "url-verdicts")
    if (verdicts.select(F.sum(F.length("reduced") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        verdicts = F.broadcast(verdicts)
    judged = read.join(verdicts, "reduced", "left")
    confidence = F.when(F.col("fixed").isNull(), F.col("confidence"))
    return judged.select(*(F.col(f"row.`{c}`").alias(c) for c in carried), "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined", F.lit(default)).alias("verdict"), confidence.alias("confidence"))


def held_out(labelled: DataFrame, folds: int = 5, **mining: float) -> dict[str, float]:
    """How rules mined from the other folds judge one fold of labelled URLs (by a hash of the URL).

    share of rows with a rule (coverage), of their verdicts that are right (precision), and of the fold's blocked URLs that are blocked (recall).
    """
    known = labelled.withColumn("fold", F.pmod(F.crc32("url"), F.lit(folds)))
    rules = mine(known.filter("fold <> 0"), **mining)
    judged = judge(known.filter("fold = 0"), rules, (), carry=("label",))
    ruled = F.col("confidence").isNotNull()
    right = F.col("verdict") == F.col("label")
    n, covered, correct, bad, blocked = judged.select(F.count("*"), F.count_if(ruled), F.count_if(ruled & right), F.count_if(F.col("label") == "block"), F.count_if((F.col("label") == "block") & right)).first()
    dropped(rules)
    return {"coverage": covered / max(n, 1), "precision": correct / max(covered, 1), "recall": blocked / max(bad, 1)}


def labelled_by_rules(urls: DataFrame, fixed: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(url, label): the URLs that a fixed rule decides, with its verdict as label."""
    url = F.col("url")
    return urls.select("url", fixed_rule(host_of(url), path_of(url), fixed)["verdict"].alias("label")).filter("label is not null")
