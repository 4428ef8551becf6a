"""URL filters: a rule list, and gradient-boosted trees on lexical features for the urls that no rule fits.

Everything that touches rows is a DataFrame expression. The trees are grown on the driver from counts of binned
feature rows of a bounded training sample, and scored as one nested CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, table

#: (verdict, host and path): a rule fits its host and all hosts under it if the path starts with the rule's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled urls that the trees are fitted on at most: those of least hash.
TRAIN_ROWS = 20_000
#: Trees, their depth, the step, and the bins of a feature.
TREES, DEPTH, RATE, BINS = 20, 3, 0.3, 16
FEATURES = ("length", "host_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "secure", "suffix_rate")
#: Parts into which labelled urls are dealt by hash, and the weight of the overall rate in that of a suffix.
FOLDS, SMOOTH = 4, 10


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end.

    Without ://, and for null, both are empty.
    """
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are tried longest first, equal lengths in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        cut_at = text.find("/")
        h, p = (text, "") if cut_at < 0 else (text[:cut_at], text[cut_at:])
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """pages with (host, path, url) and the features that need no statistics, as doubles."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    digits = size - F.length(F.regexp_replace(url, "[0-9]", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    named = {
        "length": size,
        "host_length": F.length("host"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digits": F.when(size > 0, digits / size).otherwise(0),
        "entropy": F.when(size > 0, entropy).otherwise(0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "hyphens": size - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "secure": url.startswith("https://").cast("int"),
    }
    out = pages.withColumns({k: v.cast("double") for k, v in named.items()})
    return out.withColumn("suffix", F.substring_index("host", ".", -3))


def fold() -> Column:
    """The part of a url, 0 to FOLDS - 1."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.col("url")), F.lit(FOLDS)).cast("int")


def _boost(rows: list[tuple[tuple[int, ...], int, int]]) -> tuple[float, list]:
    """Trees for rows (bins, blocked, allowed): the first log odds and nested (feature, bin, left, right) or a value."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = math.log((pos + 0.5) / (neg + 0.5))
    score = [base] * len(rows)

    def grow(own: list[int], depth: int, grad: list[float], hess: list[float]):
        g, h = sum(grad[i] for i in own), sum(hess[i] for i in own)
        best, split = 1e-6, None
        if depth:
            for f in range(len(FEATURES)):
                gs, hs = [0.0] * BINS, [0.0] * BINS
                for i in own:
                    gs[rows[i][0][f]] += grad[i]
                    hs[rows[i][0][f]] += hess[i]
                gl = hl = 0.0
                for b in range(BINS - 1):
                    gl, hl = gl + gs[b], hl + hs[b]
                    if hl > 1e-3 and h - hl > 1e-3:
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if gain > best + 1e-9:
                            best, split = gain, (f, b)
        if not split:
            value = RATE * g / (h + 1)
            for i in own:
                score[i] += value
            return value
        f, b = split
        left, right = [i for i in own if rows[i][0][f] <= b], [i for i in own if rows[i][0][f] > b]
        return (f, b, grow(left, depth - 1, grad, hess), grow(right, depth - 1, grad, hess))

    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p)]
        hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p)]
        trees.append(grow(list(range(len(rows))), DEPTH, grad, hess))
    return base, trees


def _binned(name: str, edges: Sequence[float]) -> Column:
    """The bin of a feature: the number of edges that it exceeds."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(F.col(name) > e, 1).otherwise(0)
    return out


def _tree_score(tree, edges: dict[str, list[float]]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, b, left, right = tree
    if b >= len(edges[FEATURES[f]]):
        return _tree_score(left, edges)
    return F.when(F.col(FEATURES[f]) <= edges[FEATURES[f]][b], _tree_score(left, edges)).otherwise(_tree_score(right, edges))


class UrlModel:
    """Fitted trees with their bin edges and the smoothed block rates of host suffixes (up to three labels)."""

    def __init__(self, base: float, trees: list, edges: dict[str, list[float]], rates: dict[str, float], prior: float):
        self.base, self.trees, self.edges, self.rates, self.prior = base, trees, edges, rates, prior

    def with_rates(self, df: DataFrame, key: Column | None = None) -> DataFrame:
        """df (suffix, or what key says) with suffix_rate; suffixes that weren't labelled have the overall rate."""
        rate = F.lit(self.prior)
        if self.rates:
            table_ = F.create_map(*[F.lit(x) for kv in self.rates.items() for x in kv])
            rate = F.coalesce(F.try_element_at(table_, F.col("suffix") if key is None else key), rate)
        return df.withColumn("suffix_rate", rate)

    def probability(self) -> Column:
        """That the url is one to block."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _tree_score(t, self.edges)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, kinds: int = 1000) -> UrlModel:
    """Trees for (url, host, path, blocked boolean).

    Fitted on at most `rows` rows, those whose url has the least hash; the block rates are kept for the `kinds` most
    frequent suffixes of these rows. The trees learn from rates that leave out the url's own part of the rows, so that
    a rate doesn't tell them the label of its row. Without labelled rows, every url's probability is a half.
    """
    sample = lexical(labelled.withColumn("at", F.xxhash64("url")).orderBy("at", "url").limit(rows))
    sample = cut(sample.select("blocked", "suffix", fold().alias("fold"), *[f for f in FEATURES if f != "suffix_rate"]))
    whole = sample.agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("int")).alias("b")).first()
    n, blocked = whole["n"], whole["b"] or 0
    prior = (blocked + 1) / (n + 2)
    mine = [F.col("fold") == i for i in range(FOLDS)]
    counts = [F.count_if(m).alias(f"n{i}") for i, m in enumerate(mine)] + [F.count_if(m & F.col("blocked")).alias(f"b{i}") for i, m in enumerate(mine)]
    seen = sample.groupBy("suffix").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), *counts).orderBy(F.desc("n"), "suffix").limit(kinds).collect()
    rate = lambda b, n: (b + SMOOTH * prior) / (n + SMOOTH)
    model = UrlModel(0.0, [], {}, {r["suffix"]: rate(r["b"], r["n"]) for r in seen}, prior)
    if not n:
        return model
    apart = UrlModel(0.0, [], {}, {f"{i} {r['suffix']}": rate(r["b"] - r[f"b{i}"], r["n"] - r[f"n{i}"]) for r in seen for i in range(FOLDS) if r[f"n{i}"]}, prior)
    full = apart.with_rates(sample, F.concat_ws(" ", F.col("fold").cast("string"), "suffix"))
    steps = [i / BINS for i in range(1, BINS)]
    cuts = full.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    model.edges = edges
    binned = full.select(*[_binned(f, edges[f]).alias(f) for f in FEATURES], "blocked")
    # one row for each set of bins, of the bounded sample
    grouped = binned.groupBy(*FEATURES).agg(F.count_if("blocked").alias("yes"), F.count_if(~F.col("blocked")).alias("no")).orderBy(*FEATURES).collect()
    model.base, model.trees = _boost([(tuple(r[f] for f in FEATURES), r["yes"], r["no"]) for r in grouped])
    return model


def held_out_auc(labelled: DataFrame, rows: int = TRAIN_ROWS) -> float | None:
    """The odds that a blocked url scores above an allowed one, on the fourth of (url, host, path, blocked) that isn't fitted on.

    None without rows of both kinds there.
    """
    model = fit(labelled.where(fold() != 0), rows)
    scored = model.with_rates(lexical(labelled.where(fold() == 0))).select("blocked", model.probability().alias("p"))
    won, below, all_yes = 0.0, 0, 0
    # as many rows as there are probabilities, of which the trees' leaves make a bounded number
    for r in scored.groupBy("p").agg(F.count_if("blocked").alias("yes"), F.count_if(~F.col("blocked")).alias("no")).orderBy("p").collect():
        won, below, all_yes = won + r["yes"] * (below + r["no"] / 2), below + r["no"], all_yes + r["yes"]
    return won / (below * all_yes) if below and all_yes else None


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages' columns page_id and url with host, path, rule, probability and verdict.

    A url that a rule fits gets that rule's verdict, the longest rule's. The urls with a rule are the labelled ones:
    the trees learn from them and judge the others by their probability. Null and malformed urls have empty host and
    path and are judged by the trees. Repeated rows each get their verdict; an empty table gives none; other columns
    are not read. Nothing is shuffled but the bounded training sample. The rule list is a literal of the plan, meant
    for up to some thousand rules.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    model = fit(rows.where("rule is not null").select("url", "host", "path", (F.col("said") == "block").alias("blocked")))
    scored = model.with_rates(lexical(rows)).withColumn("probability", model.probability())
    told = F.coalesce("said", F.when(F.col("probability") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", "rule", "probability", told.alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
