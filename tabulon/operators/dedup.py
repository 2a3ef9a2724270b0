"""Before a file is fetched: is it, by what its source says of it, among those that are stored and verified?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA1, SHA256 = r"^[a-f0-9]{40}$", r"^[a-f0-9]{64}$"


def verified_url(url: Column) -> Column:
    """An https address without user or fragment, its host in lower case; null for any other."""
    good = url.rlike(r"^(?i:https)://[^/?#@\s]+(?:[/?#]|$)")
    host = F.lower(F.regexp_extract(url, r"^(?i:https)://([^/?#]+)", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"^(?i:https)://[^/?#]+(.*)$", 1), "#.*$", "")
    return F.when(good, F.concat(F.lit("https://"), host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def fetch_decisions(queue: DataFrame, objects: DataFrame, urls: DataFrame, providers: list[str]) -> DataFrame:
    """(id, action, reason, sha256): which rows of a queue need no download, and why the others do.

    queue: (id, provider, url, sha1, bytes) as the source says; objects: (sha256, sha1, bytes) of what is stored; urls:
    (url, sha256) that were verified before.

    skip: the source's sha1 is that of exactly one stored object; or the address was verified into exactly one object and
    neither sha1 nor size says otherwise.  download: another provider; several objects for one address; one that is not
    in the index; an address whose sha1 or size has changed; nothing known.  A sha1 that two objects share proves nothing.
    """
    o = objects.filter(F.col("sha256").rlike(SHA256) & F.col("sha1").rlike(SHA1) & (F.col("bytes") > 0))
    by_sha1 = o.groupBy("sha1").agg(F.min("sha256").alias("_hit"), F.max("sha256").alias("_last")).filter("_hit = _last").select(F.col("sha1").alias("_sha1"), "_hit")
    by_url = urls.select(verified_url(F.col("url")).alias("_url"), F.col("sha256").alias("_known")).filter(F.col("_url").isNotNull() & F.col("_known").rlike(SHA256))
    by_url = by_url.groupBy("_url").agg(F.min("_known").alias("_known"), (F.min("_known") != F.max("_known")).alias("_several"))
    stored = o.groupBy(F.col("sha256").alias("_known")).agg(F.min("sha1").alias("_stored_sha1"), F.min("bytes").alias("_stored_bytes"))
    by_url = by_url.join(stored, "_known", "left")
    q = queue.select("id", "provider", verified_url(F.col("url")).alias("_url"), F.when(F.lower("sha1").rlike(SHA1), F.lower("sha1")).alias("_sha1"), F.when(F.col("bytes") > 0, F.col("bytes")).alias("_bytes"))
    d = q.join(by_sha1, "_sha1", "left").join(by_url, "_url", "left")
    reason = (
        F.when(~F.coalesce(F.col("provider").isin(providers), F.lit(False)), "other provider").when(F.col("_hit").isNotNull(), "same sha1").when(F.col("_known").isNull(), "nothing known").when(F.col("_several"), "several versions of the address")
        .when(F.col("_stored_sha1").isNull(), "object not in the index").when(F.col("_sha1") != F.col("_stored_sha1"), "sha1 has changed").when(F.col("_bytes") != F.col("_stored_bytes"), "size has changed").otherwise("same address")
    )
    out = d.withColumn("reason", reason)
    action = F.when(F.col("reason").isin("same sha1", "same address"), "skip").otherwise("download")
    return out.select("id", action.alias("action"), "reason", F.when(F.col("reason") == "same sha1", F.col("_hit")).when(F.col("reason") == "same address", F.col("_known")).alias("sha256"))
