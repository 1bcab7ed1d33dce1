"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in
lower case. Path: from there to ``?``, ``#`` or the end. A rule such as ``block example.org/es/`` fits its
host and all subdomains where the path starts with the rule's path; the longest rule wins, and among
rules of equal length blocking ones. Where no rule fits, the regression decides. All of it is DataFrame
and JVM-side ML work.

The regression learns from a small labelled URL table (``url``, ``label`` 1 to block, 0 to allow). Without
one, the urls that rules decide are the labelled table; of each label the TRAIN_ROWS different urls of lowest
hash are taken, which bounds the table. Copies of a url count once.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; with fewer
than two labels to learn from, urls without a rule are allowed; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

from answerlab.session import materialise

TRAIN_ROWS = 10_000
FEATURES = 1 << 14
SIZES = (3, 5)
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    place: str

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or "/" not in self.place:
            raise ValueError(f"not a rule: {self}")

    @property
    def host(self) -> str:
        return self.place.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.place.split("/", 1)[1]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; empty where there are none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    place = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(place, "/", 1)
    path = F.substring(place, F.length(host) + 1, F.length(place))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, capitals, small), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that decides, as a struct of place and verdict; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ordered = sorted(set(rules), key=lambda r: (-len(r.place), r.verdict != "block", r.place))
    if not ordered:
        return F.lit(None).cast("struct<place: string, verdict: string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.place).alias("place"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ordered
    ]
    return F.coalesce(*fits)


def grams(text: Column, mark: str) -> Column:
    """All character n-grams of a text of the sizes in SIZES, each with a mark in front."""
    letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of_size(size: int) -> Column:
        last = F.size(letters) - size
        places = F.sequence(F.lit(0), last)
        found = F.transform(
            places, lambda i: F.concat(F.lit(mark), *[F.get(letters, i + k) for k in range(size)])
        )
        return F.when(last >= 0, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(size) for size in SIZES])


def _parsed(pages: DataFrame, url: str) -> DataFrame:
    rows = pages.withColumn("_url", F.coalesce(F.col(url).cast("string"), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    return rows.withColumns({"host": host, "path": path}).drop("_url")


def _featured(rows: DataFrame) -> DataFrame:
    held = rows.withColumn("_grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="_features").transform(held).drop("_grams")


def lowest_by_hash(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Of each label the ``rows`` different urls of lowest hash.

    The urls of a label are counted first, and those far above the expected hash left out, so that no task
    sorts more than a few times ``rows``.
    """
    labelled = materialise(labelled.select("host", "path", "label").distinct())
    hashed = labelled.withColumn("_h", F.shiftrightunsigned(F.xxhash64("host", "path"), 1))
    sizes = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    each = []
    for label in (0, 1):
        share = min(1.0, (2 * rows + 1000) / max(1, sizes.get(label, 0)))
        low = hashed.where((F.col("label") == label) & (F.col("_h") <= int(share * ((1 << 63) - 1025))))
        each.append(low.orderBy("_h", "host", "path").limit(rows))
    return each[0].unionByName(each[1]).drop("_h")


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """A regression on (host, path, label) rows, both labels with the same total weight; None without both."""
    held = materialise(labelled.select("host", "path", F.col("label").cast("double").alias("label")))
    sizes = {row["label"]: row["count"] for row in held.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0])
    data = _featured(held.withColumn("_weight", weight * sum(sizes.values())))
    regression = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=40, regParam=0.01
    )
    return regression.fit(data)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; one pass over the urls after training."""
    rows = _parsed(pages.select(pages[page_id].alias("page_id"), pages[url].alias("url")), "url").drop("url")
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    rule, verdict = F.col("_rule.place"), F.col("_rule.verdict")
    if labelled is None:
        known = rows.where(F.col("_rule").isNotNull())
        known = known.select("host", "path", (verdict == "block").cast("int").alias("label"))
    else:
        known = _parsed(labelled.select("url", "label"), "url").where(F.col("label").isin(0, 1))
        known = known.select("host", "path", F.col("label").cast("int").alias("label"))
    model = train(lowest_by_hash(known))
    if model is None:
        guess = F.lit("allow")
    else:
        model.setFeaturesCol("_features")
        rows = model.transform(_featured(rows))
        guess = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"))
