"""URL filter: rules first, then a ratio of two character language models.

The models are variable-order Markov models with Witten-Bell smoothing: a character's probability after
up to ``ORDER`` characters mixes the counts of that context with the probability after the next shorter
one, so an unseen context falls back to the longest that was seen. One is learned from urls that rules
accept, one from urls that they reject. A url's score is the difference of the two log-likelihoods per
character; its threshold is calibrated on rule-judged urls that were held out. Only DataFrame functions
are used: a character's score depends on its ``ORDER + 1``-gram alone, so grams are counted, smoothed
and scored as distinct rows and joined back.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_hot, settle

#: (verdict, rule): a rule is a host, which fits its subdomains too, and a prefix of the path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
ORDER = 4
#: Marks before and after a url.
START, END = "\x02", "\x03"
#: Characters that an untrained model takes for equally likely.
ALPHABET = 256
#: Scores are summed as whole numbers of this part, so that no order of summing changes them.
UNIT = 1e-6


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_for(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, prefix = rule.partition("/")
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """The other columns and g, one row per character and end of the url."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("url") + 1)
    cut = F.transform(places, lambda i: F.substring(F.col("s"), i, F.lit(ORDER + 1)))
    return urls.withColumn("s", padded).select("*", F.explode(cut).alias("g")).drop("s", "url")


def _suffixes() -> Column:
    """The gram's suffixes: for each order k, its last k + 1 characters."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"right(g, {k + 1})").alias("s")) for k in range(ORDER + 1)]))


def gram_scores(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """g and its log-ratio (in UNITs) for distinct ``grams`` (g), given training ``counts`` (g, a, r)."""
    counted = counts.select(_suffixes().alias("x"), "a", "r").groupBy("x.k", "x.s").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counted = settle(counted, "url-counts")
    context = F.expr("left(s, k)")
    contexts = counted.groupBy("k", context.alias("c")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
    )
    asked = grams.select("g", _suffixes().alias("x")).select("g", F.col("x.k").alias("k"), F.col("x.s").alias("s"))
    asked = settle(asked.withColumn("c", context), "url-asked")
    # short contexts, the empty one above all, are those of very many grams
    often = asked.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    known = settle(contexts.join(often, ["k", "c"]), "url-contexts")
    places = asked.count()
    found = settle(join_hot(asked, known, ["k", "c"], "n", places), "url-found")
    used = found.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))
    seen = settle(used.join(counted, ["k", "s"], "left"), "url-seen")
    found = join_hot(found, seen, ["k", "s"], "n", places)
    own = F.struct("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r"), "na", "nr", "ta", "tr")
    lists = found.groupBy("g").agg(F.sort_array(F.collect_list(own)).alias("orders"))

    def mix(p, n, total, kinds):
        return F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)

    flat = F.lit(1.0 / ALPHABET)
    both = F.aggregate(
        "orders",
        F.struct(flat.alias("pa"), flat.alias("pr")),
        lambda p, o: F.struct(mix(p["pa"], o["a"], o["na"], o["ta"]).alias("pa"), mix(p["pr"], o["r"], o["nr"], o["tr"]).alias("pr")),
        lambda p: F.round((F.log(p["pa"]) - F.log(p["pr"])) / F.lit(UNIT)).cast("long"),
    )
    return lists.select("g", both.alias("ratio"))


def judge(pages: DataFrame, rules=RULES, false_blocks: float = 0.01, hold: int = 5) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The host lies after the first ``://``, A-Z lower-cased; the path follows it up to ``?`` or ``#``.
    Both are empty where the url is null or has no ``://``. The longest fitting rule decides. Else the
    models do: a url is blocked if its score lies below the threshold, which lets ``false_blocks`` of the
    held-out accepted urls (every ``hold``-th by hash) fall. Without held-out accepted urls, or
    without rejected ones to learn from, nothing but rules blocks. A null url is scored as an empty one.
    Repeated urls are learned and scored once, and repeated rows stay. Urls are read whole; one of very
    many characters makes as many rows. Only page_id and url are read.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("pages")).withColumn("fit", rule_for(host(F.col("url")), path(F.col("url")), rules))
    urls = settle(
        urls.select(
            "url",
            "pages",
            # a number of 96 bits, shorter to carry along with every gram than the url
            F.xxhash64("url").alias("u"),
            F.hash("url").alias("v"),
            F.when(F.col("fit.verdict") == "allow", 1).when(F.col("fit.verdict") == "block", 0).alias("accepted"),
            (F.pmod(F.xxhash64("url", F.lit("hold")), F.lit(hold)) == 0).alias("held"),
        ),
        "urls",
    )
    taught = urls.where("accepted IS NOT NULL AND NOT held")
    asked = urls.where("accepted IS NULL OR held")
    counts = settle(
        _grams(taught.select("url", "accepted")).groupBy("g").agg(F.sum("accepted").alias("a"), F.sum(1 - F.col("accepted")).alias("r")), "url-grams"
    )
    # grams that very many urls share, such as those of a scheme, meet few ratios
    grams = _grams(asked.select("url", "u", "v"))
    shared = settle(grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "url-asked-grams")
    ratios = settle(gram_scores(shared.select("g"), counts).join(shared, "g"), "url-ratios")
    uses = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = join_hot(grams, ratios, ["g"], "n", uses).groupBy("u", "v").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
    score = F.expr("total div n")  # per character, in whole UNITs
    scores = asked.select("url", "pages", "u", "v", "accepted").join(total.select("u", "v", score.alias("score")), ["u", "v"])
    scores = settle(scores, "url-scores")
    taught_by = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    # bins of a thousandth: what the exact percentile holds stays bounded
    threshold = scores.where("accepted = 1").agg(F.percentile(F.expr("score div 1000"), F.lit(false_blocks))).first()[0]
    own = urls.select("url", "pages").join(scores.where("accepted IS NULL").select("url", "score"), "url", "left")
    able = threshold is not None and min(taught_by) > 0
    low = F.coalesce(F.col("score") < F.lit(float(threshold) * 1000), F.lit(False)) if able else F.lit(False)
    fit = rule_for(F.col("host"), F.col("path"), rules)
    return (
        join_hot(rows, settle(own, "url-own"), ["url"], "pages", rows.count())
        .select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "score")
        .withColumn("fit", fit)
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(low, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            (F.col("score") * UNIT).alias("score"),
        )
    )
