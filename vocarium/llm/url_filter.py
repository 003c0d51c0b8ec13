"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

All of it is DataFrame expressions. Features: length, depth, digit ratio, entropy of the host, parameter
count, hyphens, host labels, longest label, and how often URLs with the same suffix are blocked. The last
is counted over all labelled URLs, for every suffix of at least ``SUFFIX_ROWS`` of them (rarer ones have the
rate of all), and joined as a table. Trees are grown level by level: one grouped sum of gradients by node,
feature and bin a level, over a bounded sample of labelled URLs that is first reduced to its distinct
bins; the driver only sees those sums. Scoring is one CASE expression a tree.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features like any other. Repeated rows are judged each, extra columns stay out, an empty table gives no
rows, and without labelled rows of both kinds nothing but a block rule blocks.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled URLs that are learnt from, at most: those with the lowest hashes.
TRAIN_ROWS = 20_000
#: Labelled URLs that a suffix needs for a rate of its own.
SUFFIX_ROWS = 20
#: Characters and rows of suffixes that are broadcast, at most; a larger table meets the URLs by suffix and one of these salts.
SUFFIX_CHARS, SUFFIX_KEYS, SALTS = 8 << 20, 200_000, 32
TREES, DEPTH, BINS, RATE, SMOOTH = 12, 3, 16, 0.4, 1.0
#: Gradients are summed as whole numbers of this unit, so that the sums don't depend on task order.
UNIT = 1e6

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words in host names by which URLs are labelled for training.
BLOCKED_WORDS = ("adult", "bet", "bets", "betting", "casino", "gambling", "phishing", "pills", "poker", "porn", "slots", "spam", "warez", "xxx")

FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "host_labels", "longest_label", "host_length", "suffix_rate")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def count_of(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Every feature but the suffix statistic."""
    u = F.coalesce(url, F.lit(""))
    signs = F.array(*[F.lit(c) for c in string.ascii_lowercase + string.digits + "-."])
    size = F.greatest(F.length(host), F.lit(1))
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / size
    entropy = F.aggregate(signs, F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "length": F.length(u).cast("double"),
        "depth": count_of(path, "/").cast("double"),
        "digit_ratio": count_of(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "entropy": F.round(entropy, 6),
        "parameters": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1.0),
        "hyphens": count_of(host, "-").cast("double"),
        "host_labels": count_of(host, r"\.") + 1.0,
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "host_length": F.length(host).cast("double"),
    }


def seed_label(host: Column, words=BLOCKED_WORDS) -> Column:
    """1 where a word of the host, between dots and hyphens, is on the list."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in words])).cast("int")


@dataclass
class Boosted:
    """Trees as nested (feature, threshold, low, high) with leaf values; scored as one expression."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    rates: DataFrame | None = None
    rate: float = 0.0

    def margin(self, columns: dict[str, Column]) -> Column:
        def walk(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            name, cut, low, high = t
            return F.when(columns[name] <= cut, walk(low)).otherwise(walk(high))

        return reduce(lambda a, b: a + b, map(walk, self.trees), F.lit(self.prior))


def suffix_rates(known: DataFrame) -> tuple[DataFrame, float]:
    """(suffix, suffix_rate) over all of known(url, label), and the rate of all."""
    by = known.groupBy(suffix(host_and_path(F.col("url"))[0]).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    by = shared.saved(by)
    n, bad = by.agg(F.sum("n"), F.sum("bad")).first()
    share = bad / n if n else 0.0
    return by.where(F.col("n") >= SUFFIX_ROWS).select("suffix", ((F.col("bad") + SUFFIX_ROWS * share) / (F.col("n") + SUFFIX_ROWS)).alias("suffix_rate")), share


def with_suffix_rate(df: DataFrame, host: Column, rates: DataFrame | None, rate: float, chars: int = SUFFIX_CHARS) -> DataFrame:
    """df with ``suffix_rate``. A suffix may hold most rows, so a join by suffix spreads it over salts."""
    if rates is None:
        return df.withColumn("suffix_rate", F.lit(rate))
    keys, held = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("suffix")), F.lit(0))).first()
    df, on = df.withColumn("suffix", suffix(host)), ["suffix"]
    if keys <= SUFFIX_KEYS and held <= chars:
        rates = F.broadcast(rates)
    else:
        rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # of all columns, so that only equal rows always share a salt
        df, on = df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")), ["suffix", "salt"]
    return df.join(rates, on, "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(rate))).drop(*on)


def train(labelled: DataFrame, most: int = TRAIN_ROWS) -> Boosted:
    """Fit on labelled(url, label 0/1): trees on at most ``most`` rows, suffix statistics on all."""
    import math

    host, path = host_and_path(F.col("url"))
    every = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    known = every.orderBy(F.xxhash64("url"), "url", "label").limit(most).select("url", "label", host.alias("host"), path.alias("path"))
    known = shared.saved(known.select("label", "host", *[c.alias(n) for n, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()]))
    total, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not bad or bad == total:
        return Boosted(prior=0.0 if not total else -4.0 if not bad else 4.0)
    share = bad / total
    rates, rate = suffix_rates(every)
    model = Boosted(math.log(share / (1 - share)), rates=rates, rate=rate)
    known = with_suffix_rate(known, F.col("host"), rates, rate).drop("host")
    at = [k / BINS for k in range(1, BINS)]
    cuts = {n: sorted(set(q)) for n, q in known.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in FEATURES]).first().asDict().items()}
    bins = {n: sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)) for n in FEATURES}
    cells = shared.saved(known.select("label", *[b.alias(n) for n, b in bins.items()]).groupBy(*FEATURES).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).coalesce(2))

    binned = Boosted(prior=model.prior)
    by_bin = {n: F.col(n) for n in FEATURES}
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-binned.margin(by_bin)))
        sums = cells.select(*FEATURES, F.round((F.col("bad") - p * F.col("n")) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * F.col("n") * UNIT).cast("long").alias("h"))
        splits: dict[int, tuple[str, int] | None] = {}
        values: dict[int, float] = {}
        for depth in range(DEPTH + 1):
            node = F.lit(1)
            for d in range(depth):
                step = F.lit(None).cast("int")
                for k, s in splits.items():
                    if s and 1 << d <= k < 2 << d:
                        step = F.when(node == k, F.when(F.col(s[0]) <= s[1], 2 * k).otherwise(2 * k + 1)).otherwise(step)
                node = step
            long = sums.select(node.alias("node"), "g", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(FEATURES)])).alias("x"))
            rows = long.where("node is not null").groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in rows:
                hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"] / UNIT, r["h"] / UNIT)
            for k, by in hist.items():
                g, h = (sum(x[i] for x in by[0].values()) for i in (0, 1))
                values[k] = RATE * g / (h + SMOOTH)
                best, gain = None, 1e-6
                for f in sorted(by) if depth < DEPTH else ():
                    left = [0.0, 0.0]
                    for b in sorted(by[f])[:-1]:
                        left = [left[0] + by[f][b][0], left[1] + by[f][b][1]]
                        more = left[0] ** 2 / (left[1] + SMOOTH) + (g - left[0]) ** 2 / (h - left[1] + SMOOTH) - g * g / (h + SMOOTH)
                        if more > gain + 1e-9:
                            best, gain = (FEATURES[f], b), more
                splits[k] = best
            if not any(splits.get(k) for k in hist):
                break

        def grown(k: int, raw: bool):
            s = splits.get(k)
            if not s or 2 * k not in values or 2 * k + 1 not in values:
                return values.get(k, 0.0)
            return (s[0], cuts[s[0]][s[1]] if raw else s[1], grown(2 * k, raw), grown(2 * k + 1, raw))

        binned.trees.append(grown(1, False))
        model.trees.append(grown(1, True))
    return model


def judge(pages: DataFrame, model: Boosted, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score) of every page."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    out = with_suffix_rate(out, F.col("host"), model.rates, model.rate)
    named = lexical(F.col("url"), F.col("host"), F.col("path"))
    out = out.select("id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), "suffix_rate", *[c.alias(n) for n, c in named.items()])
    out = out.withColumn("block_score", 1 / (1 + F.exp(-model.margin({n: F.col(n) for n in FEATURES}))))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
