"""URL filter: list rules first, then logistic regression on hashed character n-grams.

Everything is a column expression or a DataFrame operation. The regression is fitted in its
dual form: over the labelled table (bounded by MAX_LABELLED) the Gram matrix of the n-gram
vectors is one join, gradient descent on it is one higher-order expression, and the weights
are the labelled vectors summed by their dual values, at most BUCKETS + 1 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
NGRAMS = (3, 4)
PATH_SHARE = 0.5
MAX_LABELLED = 200
MAX_RULES = 10_000

#: Labelled URLs to learn from: what common block and allow lists hold, on documentation domains.
BLOCKED_URLS = (
    "http://casino-royal.example.com/en/1", "https://www.best-casino.example.org/de/2", "http://online-casino.example.net/fr/3",
    "http://casino-bonus.example.org/en/4", "https://big-win.example.com/es/5", "http://m.jackpot-win.example.net/en/6",
    "http://slots-win.example.org/en/7", "https://poker-night.example.com/en/8", "http://free-poker.example.net/de/9",
    "http://sport-bets.example.com/fr/10", "https://www.live-bets.example.org/en/11", "http://bets-today.example.net/es/12",
    "http://free-spins.example.com/en/13", "https://free-money.example.org/en/14", "http://free-prize.example.net/fr/15",
    "http://spam-links.example.com/en/16", "https://spam-mail.example.org/de/17", "http://link-farm.example.net/en/18",
    "http://content-farm.example.com/es/19", "https://click-farm.example.org/en/20", "http://seo-spam.example.net/en/21",
    "http://cheap-meds.example.com/en/22", "https://www.cheap-drugs.example.org/fr/23", "http://discount-pills.example.net/en/24",
    "http://pills-online.example.com/de/25", "https://diet-pills.example.org/en/26", "http://cheap-watches.example.net/en/27",
    "http://no-pharmacy-rx.example.com/es/28", "https://viagra-shop.example.org/en/29", "http://cheap-viagra.example.net/en/30",
    "http://adult-video.example.com/en/31", "https://adult-chat.example.org/fr/32", "http://www.adult-cams.example.net/en/33",
    "http://xxx-tube.example.com/en/34", "https://porn-hd.example.org/de/35", "http://hot-porn.example.net/en/36",
    "http://sex-dating.example.com/es/37", "https://escort-girls.example.org/en/38", "http://adult-dating.example.net/en/39",
    "http://ads-server.example.com/en/40", "https://ads-click.example.org/fr/41", "http://ad-track.example.net/en/42",
    "http://click-track.example.com/de/43", "https://track-pixel.example.org/en/44", "http://banner-ads.example.net/en/45",
    "http://pop-ads.example.com/es/46", "https://malware-drop.example.org/en/47", "http://phish-login.example.net/en/48",
    "http://warez-crack.example.com/fr/49", "https://torrent-crack.example.org/en/50", "http://loan-fast.example.net/en/51",
    "http://payday-loan.example.com/en/52", "https://crypto-double.example.org/de/53", "http://replica-bags.example.net/en/54",
)
ALLOWED_URLS = (
    "http://thesis.example.com/en/1", "https://www.weather.example.org/de/2", "http://library.example.net/fr/3",
    "http://station.example.org/en/4", "https://nation.example.com/es/5", "http://m.theatre.example.net/en/6",
    "http://motion.example.org/en/7", "https://another.example.com/en/8", "http://gathering.example.net/de/9",
    "http://brother.example.com/fr/10", "https://www.education.example.org/en/11", "http://anthem.example.net/es/12",
    "http://blog.garden.example.com/en/13", "https://recipes.example.org/en/14", "http://together.example.net/fr/15",
    "http://blog.tradition.example.com/en/16", "https://other.example.org/de/17", "http://fiction.example.net/en/18",
    "http://science.example.com/es/19", "https://northern.example.org/en/20", "http://history.example.net/en/21",
    "http://m.thunder.example.com/en/22", "https://www.athens.example.org/fr/23", "http://mathematics.example.net/en/24",
    "http://rhythm.example.com/de/25", "https://blog.southern.example.org/en/26", "http://relation.example.net/en/27",
    "http://m.then.example.com/es/28", "https://thread.example.org/en/29", "http://thistle.example.net/en/30",
    "http://blog.earth.example.com/en/31", "https://health.example.org/fr/32", "http://www.within.example.net/en/33",
    "http://father.example.com/en/34", "https://m.section.example.org/de/35", "http://blog.tuition.example.net/en/36",
    "http://location.example.com/es/37", "https://www.lithium.example.org/en/38", "http://museum.example.net/en/39",
    "http://city-council.example.com/en/40", "https://open-source.example.org/fr/41", "http://m.public-radio.example.net/en/42",
    "http://town-hall.example.com/de/43", "https://book-club.example.org/en/44", "http://sheltie.example.net/en/45",
    "http://whether.example.com/es/46", "https://blog.shore.example.org/en/47", "http://m.reader.example.net/en/48",
    "http://ethical.example.com/fr/49", "https://notation.example.org/en/50", "http://blog.editing.example.net/en/51",
    "http://writing.example.com/en/52", "https://m.heating.example.org/de/53", "http://www.ointment.example.net/en/54",
)
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def grams(text: Column, field: str) -> Column:
    """Bucket of every n-gram of a field, between marks of its ends; linear in the length."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    found = []
    for n in NGRAMS:
        many = F.size(chars) - n
        cuts = F.transform(F.sequence(F.lit(0), many), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))  # noqa: B023
        hashed = F.transform(cuts, lambda c: F.pmod(F.xxhash64(F.lit(f"{field}{n}"), c), F.lit(BUCKETS)).cast("int"))  # noqa: B023
        found.append(F.when(many >= 0, hashed).otherwise(F.array().cast("array<int>")))
    return F.when(F.length(text) > 0, F.concat(*found)).otherwise(F.array().cast("array<int>"))


def _scale(buckets: Column, share: float) -> Column:
    """Value of one n-gram: fields of any length count alike."""
    return F.lit(share) / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))


def fit_weights(labelled: DataFrame, rounds: int = 1000, rate: float = 4.0, ridge: float = 1e-3) -> list[float]:
    """Weights by bucket, the constant last, from (url, blocked). Null labels are left out."""
    known = labelled.filter(F.col("blocked").isNotNull())
    n = known.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; the table may hold {MAX_LABELLED}")
    if n == 0:
        return [0.0] * (BUCKETS + 1)
    host, path = host_and_path(F.col("url"))
    rows = known.select("url", F.col("blocked").cast("double").alias("y")).distinct().select("*", grams(host, "h").alias("h"), grams(path, "p").alias("p"))
    term = lambda c, s: F.transform(F.col(c), lambda b: F.struct(b.alias("bucket"), _scale(F.col(c), s).alias("value")))
    constant = F.array(F.struct(F.lit(BUCKETS).alias("bucket"), F.lit(1.0).alias("value")))
    values = rows.select("url", "y", F.explode(F.concat(term("h", 1.0), term("p", PATH_SHARE), constant)).alias("t"))
    vectors = values.groupBy("url", "y", "t.bucket").agg(F.sum("t.value").alias("value"))
    # The Gram matrix of at most MAX_LABELLED rows, as one array per row, rows by url.
    left = vectors.select(F.struct("url", "y").alias("i"), "bucket", "value")
    right = vectors.select(F.struct("url", "y").alias("j"), "bucket", F.col("value").alias("other"))
    gram = left.join(right, "bucket").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("other")).alias("g"))
    line = gram.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "g"))).alias("row"))
    line = line.select("i", F.transform("row", lambda x: x["g"]).alias("row"))
    matrix = line.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("m"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(alpha: Column, _: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            miss = row["i"]["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(row["row"], alpha)))
            return F.get(alpha, i) * (1 - rate * ridge) + miss * (rate / n)

        return F.transform(F.col("m"), moved)

    start = F.transform(F.col("m"), lambda _: F.lit(0.0))
    fitted = matrix.select(F.col("m"), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("alpha"))
    dual = fitted.select(F.explode(F.arrays_zip(F.transform("m", lambda r: r["i"]).alias("i"), F.col("alpha").alias("alpha"))).alias("d"))
    dual = dual.select(F.col("d.i").alias("i"), F.col("d.alpha").alias("alpha"))
    total = left.join(dual, "i").groupBy("bucket").agg(F.sum(F.col("value") * F.col("alpha")).alias("w"))
    weights = [0.0] * (BUCKETS + 1)
    for r in total.collect():
        weights[r["bucket"]] = r["w"]
    return weights


def block_probability(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Probability of a block under the regression."""
    table = F.lit([float(w) for w in weights])

    def part(buckets: Column, share: float) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b)) * _scale(buckets, share)

    logit = part(grams(host, "h"), 1.0) + part(grams(path, "p"), PATH_SHARE) + F.lit(float(weights[-1]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (length, blocks, rule) of the longest rule that fits; null if none does.

    Rules are looked up by the host and each of its parent domains, so the work for a url
    does not grow with rules of other hosts. Of rules of one length a block wins, then
    the later one in text order.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the list may hold {MAX_RULES}")
    kind = "array<struct<size:int,blocks:int,rule:string,path:string>>"
    if not rules:
        return F.lit(None).cast("struct<size:int,blocks:int,rule:string,path:string>")
    by_host: dict[str, list[Column]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(
            F.lit(len(h + p)).alias("size"), F.lit(int(verdict == "block")).alias("blocks"), F.lit(h + p).alias("rule"), F.lit(p).alias("path")
        ))
    table = F.map_from_arrays(F.array(*[F.lit(h) for h in by_host]), F.array(*[F.array(*r) for r in by_host.values()]))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = F.filter(domains, lambda d: F.array_contains(F.map_keys(table), d))
    found = F.flatten(F.transform(listed, lambda d: F.element_at(table, d))).cast(kind)
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, weights: Sequence[float] | None = None, limit: float = 0.5
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, block_probability.

    The verdict is the rule's, else ``block`` from a probability of ``limit``. Null urls and
    urls without ``://`` have an empty host and path and are judged like any other; repeated
    rows are judged each; other columns are ignored. Reads page_id and url only.
    """
    weights = fit_weights(labelled_urls(pages)) if weights is None else weights
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = split.withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("block_probability", block_probability(F.col("host"), F.col("path"), weights))
    blocks = F.coalesce(F.col("_r.blocks") == 1, F.col("block_probability") >= limit)
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"), "block_probability")


def labelled_urls(pages: DataFrame) -> DataFrame:
    """The built-in labelled table: url, blocked."""
    one = pages.sparkSession.range(1)
    blocked = one.select(F.explode(F.lit(list(BLOCKED_URLS))).alias("url"), F.lit(1).alias("blocked"))
    return blocked.unionAll(one.select(F.explode(F.lit(list(ALLOWED_URLS))).alias("url"), F.lit(0).alias("blocked")))
