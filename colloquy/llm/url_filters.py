"""URL filters: dated list entries joined to captures as of their fetch, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import small, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
#: Hosts that are addresses, which have no parent domains.
ADDRESS = r"^(\[.*|[0-9.]+)$"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and last dot; null if there is none. An IPv6 address keeps its brackets."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first; an address is all there is of it."""
    labels = F.split(host, r"\.")
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(_parents(labels))


def _parents(labels: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame, domain_col: str = "domain", action_col: str = "action", date_col: str = "dated") -> DataFrame:
    """(domain, action, valid_from, valid_to): each dated entry holds until the domain's next; of entries of one day the last in order of action holds."""
    known = entries.where(F.col(domain_col).isNotNull() & F.col(date_col).isNotNull() & F.col(action_col).isNotNull())
    daily = known.groupBy(F.lower(domain_col).alias("domain"), F.col(date_col).alias("valid_from")).agg(F.max(action_col).alias("action"))
    return daily.select("domain", "action", "valid_from", F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from")).alias("valid_to"))


def filtered(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """`captures` with host, matched_domain, action, valid_from and blocked, by the list as it stood when they were fetched.

    `entries` (domain, action, dated): action is `block`, `allow` or `end`. An entry holds from
    its date until the next entry of its domain. A capture meets the entries of its host and its
    parent domains that hold at its fetch; the longest domain decides, unless its action is
    `end`, which counts as no entry.

    A capture without a host, or a null fetch time, meets no entry: the results are null, and
    blocked is false. Entries with a null are left out; repeated entries count once. Repeated
    captures are each judged. Columns of `captures` with a result's name are replaced; names
    that begin with `_` are reserved. URLs of any length are read whole. Empty
    tables give an empty result, or one without matches. A host that has many of the captures is
    no group here: the list's intervals are joined by domain, and broadcast if few.
    """
    spans = stored(intervals(entries).where("action <> 'end'"), "list-intervals")
    results = ["host", "matched_domain", "action", "valid_from", "blocked"]
    held = captures.select(*(c for c in captures.columns if c not in results)).withColumn("host", host_of(F.col(url_col)))
    count = spans.count()
    # one row for each host and day that occurs: captures of a busy host on a day share it
    asked = held.where(F.col("host").isNotNull() & F.col(time_col).isNotNull()).select("host", F.col(time_col).alias("_at")).distinct()
    tried = asked.select("host", "_at", F.explode(domains_of(F.col("host"))).alias("domain"))
    active = tried.join(small(spans, count, 128), "domain").where((F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    longest = active.groupBy("host", "_at").agg(F.max_by(F.struct(F.col("domain").alias("matched_domain"), "action", "valid_from"), F.length("domain")).alias("_entry"))
    longest = stored(longest, "list-matches").withColumnsRenamed({"host": "_host", "_at": "_on"})
    joined = held.join(small(longest, longest.count(), 160), (F.col("host") == F.col("_host")) & (F.col(time_col) == F.col("_on")), "left")
    out = joined.select(*held.columns, "_entry.matched_domain", "_entry.action", "_entry.valid_from")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))
