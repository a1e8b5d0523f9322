"""Answer caches: two tiers replayed over a log, their policy, invalidation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import intents
from orderloom.plans.base import Tables, query
from orderloom.plans.dialogue_queries import ROUTER_SQL, routed
from orderloom.streaming import sessions

DIM = 64


def log(t: Tables) -> DataFrame:
    """The utterances as requests of 64 tenants, each with a cache an intent, ten seconds apart; one answer in eleven is blank, and one request in 97 clears its intent's stores."""
    i = F.col("utter_id")
    return routed(t).select(
        F.concat_ws(":", (F.expr("utter_id div 50") % 64).cast("string"), "intent").alias("cache"), "intent", i.alias("seq"), (i * 10).alias("seconds"), F.when(i % 97 == 0, "clear").alias("op"), tx.cache_key(F.col("intent"), F.col("text")).alias("key"), "text",
        F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("on "), "text")).alias("answer"), tx.hash_vector(tx.tokens(F.lower("text")), DIM).alias("embedding"),
        intents.domain_tags(F.col("text")).alias("tags"),
    )


@query()
def two_tier_lookup(t: Tables) -> DataFrame:
    return sessions.two_tier_cache(log(t), cache="cache")


@query()
def cache_statistics(t: Tables) -> DataFrame:
    return sessions.cache_statistics(sessions.two_tier_cache(log(t), cache="cache"))


@query(f"""WITH {ROUTER_SQL} SELECT utter_id, intent IN ('faq', 'consultant', 'ignore') AS asked, intent IN ('faq', 'consultant', 'ignore') AND utter_id % 11 <> 0 AS stored,
  intent IN ('consultant', 'ignore') AS unless_faq, CASE intent WHEN 'ignore' THEN 0.95 ELSE 0.92 END::DOUBLE AS threshold FROM routed""")
def cache_policy(t: Tables) -> DataFrame:
    """Who is asked, what is stored, the same where FAQ answers are skipped, and the similarity that serves."""
    answer = F.when(F.col("utter_id") % 11 == 0, " ").otherwise("x")
    asked, stored = sessions.cacheable(F.col("intent"), answer)
    unless, _ = sessions.cacheable(F.col("intent"), answer, skip=["faq"])
    off, _ = sessions.cacheable(F.col("intent"), answer, enabled=False)
    return routed(t).where(~off).select("utter_id", asked.alias("asked"), stored.alias("stored"), unless.alias("unless_faq"), sessions.threshold_of(F.col("intent")).alias("threshold"))


@query(f"""WITH {ROUTER_SQL}, e AS (SELECT DISTINCT intent, intent || ':' || trim(regexp_replace(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), '[?!。！？]+$', '')) AS key FROM routed WHERE intent IN ('faq', 'consultant', 'ignore'))
SELECT scope, count(*) AS entries, count(*) FILTER (scope = 'all' OR starts_with(key, scope || ':')) AS removed, count(*) FILTER (NOT (scope = 'all' OR starts_with(key, scope || ':'))) AS kept
FROM e, (SELECT unnest(['faq', 'consultant', 'order', 'all']) AS scope) GROUP BY scope""")
def cache_invalidation(t: Tables) -> DataFrame:
    """What clearing one intent's entries, or all, takes from the exact store."""
    entries = routed(t).where(F.col("intent").isin(lx.CACHEABLE)).select(tx.cache_key(F.col("intent"), F.col("text")).alias("key")).distinct()
    scopes = F.explode(F.array(*map(F.lit, ["faq", "consultant", "order", "all"]))).alias("scope")
    gone = sessions.invalidated(F.col("key"), F.col("scope"))
    return entries.select("key", scopes).groupBy("scope").agg(F.count("*").alias("entries"), F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))



TIERS = ["exact", "alias", "semantic", "miss", "skipped", "cleared"]


@query(f"""WITH l AS (SELECT ['faq', 'order', 'consultant'][event_id % 3 + 1] AS intent, {TIERS}[(event_id // 3) % 6 + 1] AS tier FROM events)
SELECT intent, count(*) FILTER (tier NOT IN ('skipped', 'cleared')) AS asked, count(*) FILTER (tier = 'exact') AS exact, count(*) FILTER (tier = 'alias') AS alias, count(*) FILTER (tier = 'semantic') AS semantic,
  count(*) FILTER (tier = 'miss') AS misses, count(*) FILTER (tier = 'skipped') AS skipped,
  round(count(*) FILTER (tier IN ('exact', 'alias', 'semantic')) / greatest(1, count(*) FILTER (tier NOT IN ('skipped', 'cleared'))), 4) AS hit_rate FROM l GROUP BY intent""")
def cache_tiers(t: Tables) -> DataFrame:
    """Statistics of a given table of lookups, here the events."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    found = t.events.select(pick(["faq", "order", "consultant"], F.col("event_id")).alias("intent"), pick(TIERS, F.expr("event_id div 3")).alias("tier"))
    return sessions.cache_statistics(found)
