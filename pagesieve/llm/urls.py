"""URL filter: explicit rules first, else gradient-boosted trees on lexical features.

Features of a URL: lengths, path depth, host labels, digit ratios, hyphens,
character entropy, number of parameters, and statistics of its host suffixes (the
last one, two and three labels) and file suffix: the smoothed block rate and the
count among labelled URLs. Suffixes are hashed into ``SUFFIX_BUCKETS`` buckets, so
the statistics, counted over all labelled URLs, have a fixed size. The trees are
fitted on a bounded sample of the labelled URLs (``TRAIN_ROWS``). Their suffix
statistics come from the other folds of the labelled URLs: with only the row's own
label taken out, the rate itself would tell the label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import llm_query
from .tables import load, write_table

TRAIN_ROWS = 20_000
LEAST_AUC = 0.55
FOLDS = 5
SUFFIX_BUCKETS = 1 << 16
SMOOTH = 20.0
TREES = 20
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
SUFFIXES = ("last1", "last2", "last3", "file")
PLAIN = ("f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy",
         "f_params")
FEATURES = [*PLAIN, *(f"f_{s}_{k}" for s in SUFFIXES for k in ("rate", "count"))]


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. Rules of equal length are tried by their text. The list is a setting,
    one condition each.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _ratio(part: F.Column, whole: F.Column) -> F.Column:
    return F.length(part) / F.greatest(F.length(whole), F.lit(1))


def lexical(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """``rows`` with host, path, the plain features and the bucket of each suffix."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(F.col(url_col))
    out = rows.withColumns({"host": host, "path": path, "_u": u})
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    query = F.regexp_extract("_u", r"(?s)\?([^#]*)", 1)
    chars = F.split("_u", "")
    # -sum p log2 p from the run lengths of the sorted characters
    runs = F.regexp_extract_all(F.array_join(F.array_sort(chars), ""), F.lit(r"(?s)((.)\2*)"), 1)
    size = F.length("_u")
    labels = F.split("host", r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    keys = {"last1": tail(1), "last2": tail(2), "last3": tail(3),
            "file": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)}
    out = out.withColumns({
        "f_length": size.cast("double"), "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "f_labels": F.size(labels).cast("double"), "f_digits": _ratio(digits(F.col("_u")), F.col("_u")),
        "f_host_digits": _ratio(digits(F.col("host")), F.col("host")),
        "f_hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
        "_runs": F.transform(runs, lambda r: F.length(r) / size),
        "f_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        **{f"b_{s}": F.pmod(F.xxhash64(F.lit(s), k), F.lit(SUFFIX_BUCKETS)).cast("int") for s, k in keys.items()}})
    entropy = F.aggregate("_runs", F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return out.withColumn("f_entropy", F.coalesce(entropy, F.lit(0.0))).drop("_u", "_runs")


@dataclass
class UrlModel:
    """Suffix statistics (bucket, count, blocked; at most SUFFIX_BUCKETS rows), the prior, the trees or one verdict."""
    stats: DataFrame
    prior: float
    trees: GBTClassificationModel | None
    auc: float | None = None          # on the held-out labels
    threshold: float = 0.5


def _other_folds(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``bucket, fold, n, blocked``: the statistics without the labelled rows of each fold."""
    own = _counted(rows, "fold").withColumnsRenamed({"n": "own_n", "blocked": "own_blocked"})
    folds = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    return folds.join(own, ["bucket", "fold"], "left").select(
        "bucket", "fold", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"),
        (F.col("blocked") - F.coalesce("own_blocked", F.lit(0))).alias("blocked"))


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """``bucket, n, blocked`` of rows with ``label, times``, by further columns."""
    buckets = rows.select(F.explode(F.array(*[f"b_{s}" for s in SUFFIXES])).alias("bucket"), "label", "times", *by)
    return buckets.groupBy("bucket", *by).agg(F.sum("times").alias("n"), F.sum(F.expr("times * label")).alias("blocked"))


def _with_stats(rows: DataFrame, stats: DataFrame, prior: float) -> DataFrame:
    """The suffix features of ``rows``; by fold, if ``stats`` are."""
    fold = ["fold"] if "fold" in stats.columns else []
    for s in SUFFIXES:
        side = stats.select(F.col("bucket").alias(f"b_{s}"), *fold, F.col("n").alias("_n"), F.col("blocked").alias("_b"))
        rows = rows.join(F.broadcast(side), [f"b_{s}", *fold], "left")       # FOLDS * SUFFIX_BUCKETS rows at most
        n, b = F.coalesce("_n", F.lit(0)), F.coalesce("_b", F.lit(0))
        rows = rows.withColumns({f"f_{s}_rate": (b + SMOOTH * prior) / (n + SMOOTH),
                                 f"f_{s}_count": F.log1p(n.cast("double"))}).drop("_n", "_b")
    return rows


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(rows)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked",
          train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on rows with a URL and a label (1 block, 0 allow); rows with a null in either take no part.

    Rows of one URL and label count as often as they occur, but are one training
    row, so a URL that repeats cannot make the sample larger than ``train_rows``,
    about. Both labels weigh the same. One fold of the URLs is held out: it gives the area under the ROC curve and the threshold (the largest
    difference of the rates of right and of wrong blocks). Where that area is under
    ``LEAST_AUC``, the features say nothing about the labels and the trees are not
    asked.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
    rows = write_table(lexical(rows.groupBy("url", "label").agg(F.count("*").alias("times"))).withColumn(
        "fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int")), "url-labelled")
    distinct, n, blocked = rows.agg(F.count("*"), F.sum("times"), F.sum(F.expr("times * label"))).first()
    stats = write_table(_counted(rows), "url-suffixes")
    prior = (blocked or 0.0) / n if n else 0.0
    if not n or blocked in (0, n):
        return UrlModel(stats, prior, None)
    share = min(1.0, train_rows / distinct)
    hashed = F.xxhash64("url", "label")
    sample = rows.where(F.pmod(hashed, F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = sample.withColumns({"weight": F.col("times") * F.when(F.col("label") == 1, n / (2 * blocked))
                                 .otherwise(n / (2 * (n - blocked))),
                                 "held": F.col("fold") == 0})
    sample = write_table(_assembled(_with_stats(sample, _other_folds(rows, stats), prior))
                         .select("_features", "label", "weight", "held"), "url-sample").coalesce(4)
    if sample.where("not held").select("label").distinct().count() < 2:
        return UrlModel(stats, prior, None)
    leaf = max(1, min(50, sample.count() // 200))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.2, maxBins=32, minInstancesPerNode=leaf, seed=17).fit(sample.where("not held"))
    auc, threshold = _held_out(trees.transform(sample.where("held")))
    return UrlModel(stats, prior, trees if auc >= LEAST_AUC else None, auc, threshold)


def _held_out(scored: DataFrame) -> tuple[float, float]:
    """Area under the ROC curve and the best threshold, from the weights in hundredths of the score."""
    from pyspark.ml.functions import vector_to_array
    cells = (scored.withColumn("cell", F.floor(vector_to_array("probability")[1] * 100).cast("int"))
             .groupBy("cell").agg(F.sum(F.expr("weight * label")).alias("bad"),
                                  F.sum(F.expr("weight * (1 - label)")).alias("good")).collect())     # 101 rows at most
    bad, good = sum(c.bad for c in cells), sum(c.good for c in cells)
    if not bad or not good:
        return 0.5, 0.5
    at = {c.cell: (c.bad / bad, c.good / good) for c in cells}
    area, caught, wrong, best = 0.0, 0.0, 0.0, []
    for cell in range(100, -1, -1):
        more_caught, more_wrong = at.get(cell, (0.0, 0.0))
        area += more_wrong * (caught + more_caught / 2)
        caught, wrong = caught + more_caught, wrong + more_wrong
        best.append((round(caught - wrong, 9), -abs(cell - 50), cell))      # of equal ones the nearest to one half
    return area, max(best)[2] / 100


def judge(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: its id, ``host, path, rule, verdict, blocked_score``.

    ``rule`` is null where none fits; then the trees decide (block from the model's
    threshold on; a model without trees gives the verdict of most labels, or allow
    without labels). A null or empty URL is judged by its (empty)
    features. Repeated rows each get a row, an empty table gives no row; other
    columns are left out.
    """
    rows = lexical(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url")
    rows = rows.withColumns(dict(zip(("rule", "_verdict"), rule_of(F.col("host"), F.col("path"), rules), strict=True)))
    if model.trees is None:
        scored = rows.withColumn("blocked_score", F.lit(float(model.prior)))
    else:
        from pyspark.ml.functions import vector_to_array
        scored = model.trees.transform(_assembled(_with_stats(rows, model.stats, model.prior)))
        scored = scored.withColumn("blocked_score", vector_to_array("probability")[1])
    own = F.when(F.col("blocked_score") >= (model.threshold if model.trees is not None else 0.5), "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("_verdict", own).alias("verdict"), "blocked_score")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, blocked`` of pages whose URL names a labelled document: blocked if it is toxic or of low quality."""
    number = F.regexp_extract("url", r"://[^/]*/[^/]*/([0-9]{1,18})", 1)
    return (pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
            .join(labels.select("doc_id", "quality", "toxic"), "doc_id")
            .select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("blocked")))


# Host, path and rule in SQL; the verdict without a rule comes from the trees, which SQL cannot express.
RULES_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS m
  FROM pages),
h AS (SELECT page_id, translate(m.h, '{UPPER}', '{LOWER}') AS host, m.p AS path FROM p),
r AS (SELECT unnest(['net', 'example.net', 'example.com', 'org']) AS rh, unnest(['/', '/en/', '/de/', '/fr/']) AS rp)
SELECT h.page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule
FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY h.page_id, host, path
"""


@llm_query("op8_url_filters")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(pages, load(spark, sf_dir, "labels"))))
