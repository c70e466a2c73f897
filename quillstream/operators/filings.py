"""Analysis of 8-K submissions in plain expressions; only the text of exhibits needs an HTML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, html, text

#: Items that matter, with their tier.
TIERS = {"2.02": 1, "4.02": 1, "1.01": 1, "5.02": 1, "3.01": 1, "2.04": 2, "2.05": 2, "2.06": 2, "4.01": 2, "1.02": 2}
#: Exhibits by priority, and those that are contracts.
EXHIBITS = ["ex-99.1", "ex-99.2", "ex-99.3", "ex-99.4"]
CONTRACTS = ["ex-10.1", "ex-2.1"]
#: Items are looked for in so many leading characters; that is the reference behaviour, not a limit of cost.
HEAD = 60_000


def items(submission: Column) -> Column:
    """Item numbers in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(F.substring(submission, 1, HEAD), F.lit(r"(?iU)\bItem\s+([0-9]+(?:\.[0-9]{1,2})?)\b"), F.lit(1)))


def tier_map(found: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    known = F.filter(found, lambda i: i.isin(list(TIERS)))
    return F.map_from_arrays(known, F.transform(known, lambda i: F.element_at(tiers, i)))


def documents(submission: Column) -> Column:
    return F.regexp_extract_all(submission, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))


def exhibit_types(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.regexp_extract(b, r"(?i)<TYPE>\s*([^\s<]+)", 1))


def _body(block: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(block, r"(?is)<TEXT>(.*?)</TEXT>", 1), F.lit("")), block)


def _first_of(blocks: Column, types: Column, wanted: str) -> Column:
    """The block of the first document of a type, else NULL."""
    at = F.array_position(F.transform(types, lambda t: F.lower(t)), wanted)
    return F.when(at > 0, F.get(blocks, (at - 1).cast("int")))


def analyse(submissions: DataFrame, column: str = "submission") -> DataFrame:
    """``submissions`` with items, tiers, exhibits, flags, acceptance time and the text that matters.

    The first of EX-99.1 to EX-99.4 gives the primary text. Without one, the text of the 8-K itself stands in if some
    item matters. Each row's HTML is read once: which block is to be read is settled before.
    """
    s = F.col(column)
    rows = submissions.withColumns({"items": items(s), "__blocks": documents(s), "acceptance_datetime_utc": dates.acceptance_to_utc(s)})
    rows = rows.withColumn("exhibits_found", exhibit_types(F.col("__blocks")))
    lower = F.transform("exhibits_found", lambda t: F.lower(t))
    primary = [F.struct(F.lit(x.upper()).alias("type"), _first_of(F.col("__blocks"), F.col("exhibits_found"), x).alias("block")) for x in EXHIBITS]
    chosen = F.get(F.filter(F.array(*primary), lambda p: p["block"].isNotNull()), F.lit(0))
    rows = rows.withColumns(
        {
            "items_tier_map": tier_map(F.col("items")),
            "has_material_contract_exhibit": F.arrays_overlap(lower, F.array(*[F.lit(c) for c in CONTRACTS])),
            "__primary": chosen,
            "__body": F.coalesce(_first_of(F.col("__blocks"), F.col("exhibits_found"), "8-k"), _first_of(F.col("__blocks"), F.col("exhibits_found"), "8-k/a")),
        }
    )
    impact = F.size("items_tier_map") > 0
    rows = rows.withColumn("highest_item_tier", F.array_min(F.map_values("items_tier_map")))
    read = F.struct(_body(F.col("__primary.block")).alias("primary"), F.when(impact, _body(F.col("__body"))).alias("fallback"))
    rows = rows.withColumn("__text", html.first_readable(read["primary"], read["fallback"]))
    rows = rows.withColumns({"primary_text": text.tidy(F.col("__text.primary")), "fallback_text": text.tidy(F.col("__text.fallback"))})
    rows = rows.withColumns({"primary_exhibit_type": F.col("__primary.type"), "fallback_used": F.col("primary_text").isNull() & F.col("fallback_text").isNotNull()})
    return rows.drop("__blocks", "__primary", "__body", "__text")


def exhibit_99(submission: Column) -> Column:
    """The body of exhibit 99.1, else 99.2, 99.3, 99.4; also where they are called EX-99.01 or have a space, as some filers write."""
    blocks = documents(submission)

    def of(n: int) -> Column:
        return F.filter(blocks, lambda b: b.rlike(rf"(?i)<TYPE>\s*EX[-\s]?99\.0?{n}\b"))

    found = [of(n) for n in (1, 2, 3, 4)]
    return _body(F.get(F.concat(*found), F.lit(0)))


def submission_url(index_html: Column) -> Column:
    """The link to the submission's text on an index page, made absolute."""
    link = F.nullif(F.regexp_extract(index_html, r'(?i)href="([^"]+\.txt)"', 1), F.lit(""))
    return F.when(F.startswith(link, F.lit("/")), F.concat(F.lit("https://www.sec.gov"), link)).otherwise(link)
