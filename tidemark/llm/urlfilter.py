"""URL lists as they stood when each page was fetched.

A list is a log of dated entries (domain, category, action add or remove, day). They become validity intervals: an
entry holds from the day it is added until the next remove of the same domain and category. An as-of join puts each
host and day against the intervals of the host and of every domain above it that hold on that day. Column expressions
only.

Distinct hosts and days are matched, not captures, so a host with very many captures is spread over its days and
costs one row for each; captures meet the result by host and day in a join with nothing after it, which AQE can split.

A domain near the top ("com") stands above a large share of all hosts. Domains above more than 1 in HOT_SHARE of the
hosts and days are counted first, and there are fewer than HOT_SHARE of them: one that no entry names is dropped before
rows move, one that is named is dealt to as many places as it has such shares, with its intervals at each of them. So
the join holds no hot key, however long the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: a domain above more than 1 in so many of the hosts and days is dealt to several places
HOT_SHARE = 1000
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and closing dot; an IPv6 host keeps its brackets. NULL where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:@\[]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and the domains above it, the longest first; nothing is above an address."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host.rlike(r"^[0-9.]+$|^\["), F.array(host)).otherwise(above)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to): days from valid_from on, before valid_to.

    Adding what holds already and removing what doesn't change nothing; on one day a remove comes after an add.
    Entries with a NULL domain or day are left out, a NULL category is one of its own.
    """
    rows = entries.where("domain IS NOT NULL AND day IS NOT NULL").select(F.lower("domain").alias("domain"), "category", "day", (F.col("action") == "remove").alias("ends")).distinct()
    order = Window.partitionBy("domain", "category").orderBy("day", "ends")
    state = rows.withColumn("before", F.lag("ends").over(order))
    turns = state.where(F.col("before").isNull() | (F.col("before") != F.col("ends")))
    spans = turns.withColumn("valid_to", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
    return spans.where(~F.col("ends") & (F.col("day") < F.col("valid_to"))).select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def _spread(wanted: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with `_place`, to be joined by (domain, _place): no place of a domain has more than about 1 in HOT_SHARE of wanted."""
    whole = wanted.count()
    hot = wanted.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > whole)
    named = hot.join(spans.select("domain", F.lit(True).alias("named")).distinct(), "domain", "left")
    places = F.when(F.col("named"), F.ceil(F.col("n") * HOT_SHARE / F.lit(float(max(whole, 1)))).cast("int")).otherwise(0)
    # fewer than HOT_SHARE rows: each stands above more than 1 in HOT_SHARE of them all
    hot = F.broadcast(stored(named.select("domain", places.alias("_places")), "url-hot"))
    dealt = wanted.join(hot, "domain", "left").where("_places IS NULL OR _places > 0")
    place = F.coalesce(F.pmod(F.xxhash64("host", "_day"), F.nullif(F.col("_places"), F.lit(0))), F.lit(0)).cast("int")
    each = F.sequence(F.lit(0), F.greatest(F.coalesce("_places", F.lit(1)), F.lit(1)) - 1)
    return dealt.withColumn("_place", place).drop("_places"), spans.join(hot, "domain", "left").withColumn("_place", F.explode(each)).drop("_places")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id, host, day, blocked, domain, categories), one row per capture; repeated captures have repeated rows.

    domain: the longest listed domain that holds; categories: all that hold, sorted, comma-joined (a NULL one is
    `unknown`); both empty where none does. A URL without a host and a capture without a day are not blocked. Without
    entries nothing is. Other columns of either table are not looked at.
    """
    asked = captures.select(F.col(id_col).alias("_id"), F.col(day_col).cast("date").alias("_day"), host_of(F.col(url_col)).alias("host"))
    wanted = asked.where("host IS NOT NULL AND _day IS NOT NULL").select("host", "_day").distinct()
    wanted = stored(wanted, "url-hosts").select("host", "_day", F.explode(domains_of(F.col("host"))).alias("domain"))
    wanted, spans = _spread(wanted, stored(intervals(entries), "url-intervals"))
    held = wanted.join(spans, ["domain", "_place"]).where((F.col("valid_from") <= F.col("_day")) & (F.col("_day") < F.col("valid_to")))
    longest = F.max(F.struct(F.length("domain").alias("n"), "domain"))["domain"]
    categories = F.array_join(F.array_sort(F.collect_set(F.coalesce("category", F.lit("unknown")))), ",")
    listed = held.groupBy("host", "_day").agg(longest.alias("domain"), categories.alias("categories"))
    judged = asked.join(listed, ["host", "_day"], "left")
    return judged.select(F.col("_id").alias(id_col), "host", F.col("_day").alias(day_col), F.col("domain").isNotNull().alias("blocked"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("categories", F.lit("")).alias("categories"))
