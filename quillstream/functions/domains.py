"""Public suffixes and registrable domains of hosts, by the published list of suffix rules.

A host's suffix is that of the matching rule with most labels; ``*`` stands for any one label, a rule with ``!`` is an
exception that wins over all and whose suffix is one label shorter; a host without a matching rule has its last label.
The registrable domain is the suffix and one label more.

Rules are a table. The suffixes of each different host are looked up in it by a join, so that a host costs as many rows as
it has labels (no more than the longest rule), and a URL nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where Spark's own jars have a copy of the list.
PUBLISHED = "/mozilla/public-suffix-list.txt"
#: As many rules as a broadcast takes: some MB. The published list has about 9,000.
MOST_RULES = 100_000
RULES = "suffix string, labels int, exception boolean"


def parsed(lines: Iterable[str], private: bool = False) -> list[tuple[str, int, bool]]:
    """Rules out of the list's lines: the text to match, how many labels the suffix has, whether it is an exception.

    A wildcard's text is what follows it. Names that aren't ASCII stand twice, also as a resolver sees them. ``private``
    takes in the suffixes that owners of domains have added.
    """
    found: dict[tuple[str, int], bool] = {}
    for line in lines:
        if "===BEGIN PRIVATE DOMAINS===" in line and not private:
            break
        rule = (line.split() or [""])[0].lower()
        if not rule or rule.startswith("//"):
            continue
        exception, any_ = rule.startswith("!"), rule.startswith("*.")
        text = rule.removeprefix("!").removeprefix("*.").strip(".")
        labels = text.count(".") + 1 + any_ - exception
        found[text, labels] = exception
        if not text.isascii():
            found[text.encode("idna").decode(), labels] = exception
    return [(text, labels, exception) for (text, labels), exception in found.items()]


def published(spark: SparkSession, private: bool = False) -> DataFrame:
    """The list that comes with Spark."""
    utf8 = spark._jvm.java.nio.charset.StandardCharsets.UTF_8
    text = spark._jvm.org.apache.commons.io.IOUtils.resourceToString(PUBLISHED, utf8)
    return spark.createDataFrame(parsed(text.splitlines(), private), RULES)


def domains(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """host, suffix, domain (registrable) and label (of the domain, without its suffix) of each different host.

    Hosts are taken in lower case without a last dot. Those that are empty, have empty labels or are IP addresses have no
    suffix; a host that is a suffix has no domain.
    """
    names = hosts.select(F.lower(F.regexp_replace(F.col(f"`{host}`"), r"\.$", "")).alias("name"), F.col(f"`{host}`").alias("host")).where("host is not null").distinct()
    proper = ~F.col("name").rlike(r"^$|^\.|\.\.|^[0-9.]+$|[:\[]")
    names = names.withColumn("parts", F.when(proper, F.split("name", r"\."))).withColumn("n", F.size("parts"))
    longest = rules.agg(F.max("labels"), F.count(F.lit(1))).first()
    depth = (longest[0] or 0) + 1
    at = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth))))
    tails = names.where("n > 0").select("host", "parts", "n", at.alias("k")).select("host", "n", F.array_join(F.slice("parts", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("tail"))
    ruled = rules.select(F.col("suffix").alias("tail"), "labels", "exception")
    met = tails.join(F.broadcast(ruled) if longest[1] <= MOST_RULES else ruled, "tail").where("labels <= n")
    best = met.groupBy("host").agg(F.max(F.struct("exception", "labels")).alias("rule")).select("host", F.col("rule.labels").alias("labels"))
    out = names.join(best, "host", "left").withColumn("k", F.when(F.col("n") > 0, F.coalesce("labels", F.lit(1))))
    last = lambda k: F.array_join(F.slice("parts", F.col("n") - k + 1, k), ".")
    more = F.col("k") < F.col("n")
    return out.select(
        "host",
        F.when(F.col("k").isNotNull(), last(F.col("k"))).alias("suffix"),
        F.when(more, last(F.col("k") + 1)).alias("domain"),
        F.when(more, F.get("parts", F.col("n") - F.col("k") - 1)).alias("label"),
    )


def with_domains(rows: DataFrame, host: str, rules: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` with suffix, domain and label of a column of hosts; NULL for hosts that are NULL."""
    found = domains(rows, host, rules).select(F.col("host").alias("__host"), *[F.col(c).alias(f"{prefix}{c}") for c in ("suffix", "domain", "label")])
    return rows.join(found, F.col(f"`{host}`") == F.col("__host"), "left").drop("__host")
