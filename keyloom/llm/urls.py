"""URL filter: host and path rules, and for the rest a ratio of two character language models.

Rules decide where they fit. Of the urls that rules allow or block three quarters train two variable-order Markov models (trigrams, backing
off to bigrams and single characters with Witten-Bell weights) of host and path. Any other url is judged by the difference of its log-likelihoods,
divided by its length, against a threshold calibrated on the last quarter, which the models have not seen: the value that separates them best
(Youden's J over steps of 0.01 nats), or 0 where that quarter has no allowed or no blocked url. A url's quarter hangs on a hash of host and path.

Everything is DataFrame expressions. Characters are mapped to ``SYMBOLS`` and a mark for others, so a model has 48**3 = 110,592
trigrams whatever the input: that bound is why it may be broadcast, and be made in one task. A url's trigrams are summed within
the task that made them before anything is shuffled. Up to ``FEW_RULES`` rules are one expression; more are joined by the suffixes of hosts.

A null url, or one without ``://``, has an empty host and path: no rule fits it, and the models judge the empty string. Of rules of equal length that fit
the one that sorts last wins, and of equal rules the last. If rules allow none or block none, urls without a rule are allowed. A very long url takes
time in proportion to its length. Repeated rows get equal verdicts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.textops import checkpointed

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./-_~%=&+"  # 45, and "^" start, "$" end, "*" other
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALL = SYMBOLS + "^$*"
N = len(ALL)
MICRO = 1_000_000
STEP = 10_000
FEW_RULES = 100
MOST_BROADCAST_RULES = 200_000
BOTH = ("allow", "block")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; ``rules`` are (verdict, "host/path")."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = verdict = F
    for _, (v, r) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]), x[1][1], x[0]), reverse=True):  # the first that fits counts
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = rule.when(fits, F.lit(r)), verdict.when(fits, F.lit(v))
    return rule, verdict


def with_rule(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls`` (with host and path) and the rule and verdict of the longest rule that fits."""
    if len(rules) <= FEW_RULES:
        rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
        return urls.withColumn("rule", rule).withColumn("verdict", verdict)
    made = ((*r.partition("/")[::2], r, v, i) for i, (v, r) in enumerate(rules))
    table = urls.sparkSession.createDataFrame([(h, f"/{p}", r, v, i) for h, p, r, v, i in made], "h string, p string, rule string, verdict string, i int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("h", F.explode(suffixes))
    fits = asked.join(F.broadcast(table) if len(rules) <= MOST_BROADCAST_RULES else table, "h").where(F.col("path").startswith(F.col("p")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule", "i")).alias("r"))
    return urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("r.rule")).withColumn("verdict", F.col("r.verdict")).drop("r")


def symbols(host: Column, path: Column) -> Column:
    """The codes of a url's characters, two start marks and an end mark included."""
    text = F.regexp_replace(F.translate(F.concat(host, path), UPPER, LOWER), f"[^{SYMBOLS}]".replace("-", r"\-").replace("/", r"\/"), "*")
    return F.transform(F.split(F.concat(F.lit("^^"), text, F.lit("$")), ""), lambda c: F.instr(F.lit(ALL), c) - 1)


def with_grams(rows: DataFrame) -> DataFrame:
    """A row for every trigram code of column ``codes``."""
    c = F.col("codes")
    return rows.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: (F.element_at(c, i) * N + F.element_at(c, i + 1)) * N + F.element_at(c, i + 2)))).drop("codes")


def ratios(trained: DataFrame) -> DataFrame:
    """(g, v): for every trigram code, the log of its likelihood ratio allow : block in millionths of a nat, from the rows' verdicts and codes. One task makes the table, which has N**3 rows."""
    seen = checkpointed(with_grams(trained.select("verdict", "codes")).groupBy("g").agg(*(F.sum((F.col("verdict") == v).cast("bigint")).alias(v) for v in BOTH)))
    grid = trained.sparkSession.range(0, N**3, 1, 1).select(F.col("id").cast("int").alias("g")).join(F.broadcast(seen), "g", "left")
    g = F.col("g")
    grid = grid.select("g", F.floor(g / N).alias("ab"), (g % N**2).alias("bc"), (F.floor(g / N) % N).alias("b"), (g % N).alias("c"), *(F.coalesce(v, F.lit(0)).alias(v) for v in BOTH))
    ab, bc, b, c, whole = (Window.partitionBy(*k) for k in (["ab"], ["bc"], ["b"], ["c"], []))
    grid = grid.withColumns({f"{k}_{v}": F.sum(v).over(w) for v in BOTH for k, w in (("ab", ab), ("bc", bc), ("b", b), ("c", c), ("n", whole))})
    # a pair stands in N rows of the grid, one for each symbol before it
    grid = grid.withColumns({f"t_ab_{v}": F.sum((F.col(v) > 0).cast("bigint")).over(ab) for v in BOTH} | {f"t_b_{v}": (F.sum((F.col(f"bc_{v}") > 0).cast("bigint")).over(b) / N).cast("bigint") for v in BOTH})
    logs = {}
    for v in BOTH:
        p0 = (F.col(f"c_{v}") + 1) / (F.col(f"n_{v}") + N - 1)
        p1 = F.when(F.col(f"b_{v}") > 0, (F.col(f"bc_{v}") + F.col(f"t_b_{v}") * p0) / (F.col(f"b_{v}") + F.col(f"t_b_{v}"))).otherwise(p0)
        p2 = F.when(F.col(f"ab_{v}") > 0, (F.col(v) + F.col(f"t_ab_{v}") * p1) / (F.col(f"ab_{v}") + F.col(f"t_ab_{v}"))).otherwise(p1)
        logs[v] = F.log(p2)
    return checkpointed(grid.select("g", F.round((logs["allow"] - logs["block"]) * MICRO).cast("bigint").alias("v")))


def scored(rows: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of rows and ``ratio``, the mean of v over their trigrams (in millionths, rounded down)."""
    grams = with_grams(rows.select(*columns, "codes").withColumn("_row", F.monotonically_increasing_id())).join(F.broadcast(model), "g")
    return grams.groupBy("_row", *columns).agg(F.floor(F.sum("v") / F.count("v")).alias("ratio")).drop("_row")


def threshold(ratios_: DataFrame) -> int | None:
    """The ratio, a multiple of STEP, at or above which urls are allowed: it separates urls with a rule best. None if one side is empty."""
    bins = ratios_.groupBy(F.floor(F.col("ratio") / STEP).alias("bin")).agg(*(F.sum((F.col("verdict") == v).cast("bigint")).alias(v) for v in BOTH)).orderBy("bin").collect()
    allow, block = sum(r.allow for r in bins), sum(r.block for r in bins)
    if not allow or not block:
        return None
    best, at, below_a, below_b = None, None, 0, 0
    for r in bins:  # at most a few thousand: ratios are bounded by the smoothing
        gain = below_b * allow - below_a * block
        if best is None or gain > best:
            best, at = gain, r.bin * STEP
        below_a, below_b = below_a + r.allow, below_b + r.block
    return at


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, id_col="page_id", url_col="url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, ratio (null where a rule decides)."""
    host, path = parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    base = with_rule(base, rules).withColumn("codes", symbols(F.col("host"), F.col("path")))
    ruled, rest = base.where("verdict is not null"), base.where("verdict is null")
    held = F.substring(F.md5(F.concat("host", "path")), 1, 1) < "4"
    trained = ruled.where(~held)
    sides = {r.verdict for r in trained.select("verdict").distinct().collect()}
    none = F.lit(None).cast("bigint")
    if len(sides) < 2:
        rest = rest.select("id", "host", "path", "rule", F.lit("allow").alias("verdict"), none.alias("ratio"))
    else:
        model = ratios(trained)
        limit = threshold(scored(ruled.where(held), model, ["verdict"])) or 0
        rest = scored(rest, model, ["id", "host", "path", "rule"]).select("id", "host", "path", "rule", F.when(F.col("ratio") >= limit, "allow").otherwise("block").alias("verdict"), "ratio")
    return ruled.select("id", "host", "path", "rule", "verdict", none.alias("ratio")).unionByName(rest).withColumnRenamed("id", id_col)
