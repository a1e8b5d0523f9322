"""Rule router, intent extraction and order slots, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import substrings


def keyword_score(n: Column, intent: str) -> Column:
    """The intent's base score with a bonus for each keyword after the first, from the number that matched."""
    return F.when(n > 0, lx.BASE_SCORES[intent] + F.least(F.lit(lx.MAX_EXTRA_BONUS), lx.EXTRA_MATCH_BONUS * (n - 1))).otherwise(0.0)


def is_availability_question(text: Column, hint: Column) -> Column:
    asked = F.lit(False)
    for pattern in lx.AVAILABILITY:
        asked = asked | text.rlike(tx.uni(pattern))
    return asked | (hint & text.rlike(tx.uni(lx.GENERIC_AVAILABILITY)))


def route(df: DataFrame, text: str = "text") -> DataFrame:
    """df with intent and confidence by rules.

    Order is taken first where it is clear; else the highest score, in the order
    order, consultant, faq, ignore on a tie; else ignore.
    """
    def signals(t: Column) -> dict[str, Column]:
        found = {i: tx.hits(t, lx.ROUTER_KEYWORDS[i]) for i in lx.INTENTS}
        hint = tx.any_of(t, lx.MENU_HINTS)
        return found | {
            "hint": hint, "asks": tx.any_of(t, lx.QUESTION_MARKERS), "wish": tx.any_of(t, lx.PREFERENCE_WORDS),
            "counted": hint & t.rlike(tx.uni(lx.QUANTITY)), "available": is_availability_question(t, hint), "short": F.length(t) <= lx.SHORT_NOISE_CHARS,
        }

    def scores(s: Column) -> dict[str, Column]:
        bonus = lambda cond, v: F.when(cond, v).otherwise(0.0)
        plain = (s["faq"] == 0) & (s["consultant"] == 0)
        order = keyword_score(s["order"], "order") + bonus(s["counted"], lx.QUANTITY_MENU_BONUS)
        return {
            "order": F.greatest(order, bonus(s["hint"] & plain, lx.MENU_ITEM_ALONE)),
            "consultant": keyword_score(s["consultant"], "consultant") + bonus(s["asks"] & s["hint"] & s["wish"], lx.PREFERENCE_BONUS),
            "faq": keyword_score(s["faq"], "faq"),
            "ignore": keyword_score(s["ignore"], "ignore") + bonus(s["short"] & (s["ignore"] > 0), lx.SHORT_NOISE_BONUS),
            "available": plain & s["available"],
            "store_info": (s["faq"] > 0) & s["asks"] & ~s["counted"],
            "bare": (s["order"] == 0) & ~s["counted"],
        }

    def decision(c: Column) -> Column:
        best = F.greatest(*[c[i] for i in lx.INTENTS])
        clear = (c["order"] >= lx.ORDER_PRIORITY) & ~c["store_info"]
        picked = F.coalesce(*[F.when(c[i] == best, F.lit(i)) for i in lx.INTENTS])
        intent = F.when(c["available"] | clear, "order").when(best > 0, picked).otherwise("ignore")
        sure = lambda v: F.least(v, F.lit(lx.MAX_CONFIDENCE))
        confidence = F.when(c["available"], lx.ORDER_PRIORITY).when(clear, sure(c["order"])).when(best > 0, sure(best)).otherwise(lx.NO_MATCH_SCORE)
        weak = (intent == "ignore") | ((intent == "order") & ~c["available"] & c["bare"])
        return F.struct(intent.alias("intent"), confidence.alias("confidence"), weak.alias("weak"))

    t = tx.router_text(F.coalesce(F.col(text), F.lit("")))
    made = tx.let({"t": t}, lambda v: tx.let(signals(v["t"]), lambda s: tx.let(scores(s), decision)))
    names = [c for c in df.columns if c not in ("intent", "confidence", "weak")]
    return df.select(*names, made.alias("_route")).select(*names, "_route.*")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def subject(text: Column, language: Column) -> Column:
    low = tx.strip(F.lower(text))
    found = [first_group(low, tx.uni(p)) for p in lx.SUBJECT_PATTERNS]
    me = F.when((language == "en") & low.rlike(tx.uni(lx.ENGLISH_SUBJECT)), "I")
    return F.coalesce(*[tx.strip(f) for f in found], me, F.lit(""))


def surroundings(text: Column) -> Column:
    """Distinct mentions of times, occasions, counts and wishes, in order of their patterns."""
    low = F.lower(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(tx.uni(p)), F.lit(0)) for p in lx.CONTEXT_PATTERNS]))
    return F.array_join(F.array_distinct(F.filter(F.transform(found, tx.strip), lambda x: x != "")), ", ")


def action_text(text: Column) -> Column:
    out = tx.cache_text(text)
    for pattern in lx.FILLER_EDGES:
        out = tx.strip(F.regexp_replace(out, f"(?Ui){pattern}", ""))
    return tx.strip(tx.squeeze(F.regexp_replace(out, f"(?Ui){lx.FILLER_WORDS}", " ")))


def preferences(t: Column) -> Column:
    named = F.array_compact(F.array(*[F.when(t.rlike(tx.uni(p)), F.lit(name)) for name, p in lx.PREFERENCES]))
    for dropped, present in lx.PREFERENCE_OVERRIDES.items():
        named = tx.let({"p": named}, lambda v, d=dropped, w=present: F.when(F.array_contains(v["p"], w), F.array_remove(v["p"], d)).otherwise(v["p"]))
    return F.concat(named, F.when(t.rlike(lx.BUDGET), tx.words_in([lx.BUDGET_PREFERENCE])).otherwise(F.array().cast("array<string>")))


def extract(df: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    """df with language, subject, context, action, cache_key and extraction_confidence by rules."""
    names = df.columns
    df = df.withColumn("_lang", tx.diacritic_language(F.col(text))).withColumn("_t", tx.cache_text(F.col(text)))
    df = df.withColumn("_action", action_text(F.col(text))).withColumn("_prefs", preferences(F.col("_t")))
    t, lang, routed, english = F.col("_t"), F.col("_lang"), F.col(intent), F.col("_lang") == "en"
    own = F.coalesce(F.nullif(F.col("_action"), F.lit("")), t)
    ordered = tx.strip(tx.squeeze(F.regexp_replace("_action", tx.uni(lx.ORDER_STRIP), " ")))
    result = lambda action, key, conf: F.struct(action.alias("action"), key.alias("cache_key"), F.lit(conf).alias("confidence"))
    cascade = None
    for pattern, only, conf, vi, en in lx.FAQ_RULES:
        holds = t.rlike(tx.uni(pattern)) & (F.lit(True) if only is None else routed == only)
        value = result(F.when(english, en[0]).otherwise(vi[0]), F.when(english, en[1]).otherwise(vi[1]), conf)
        cascade = F.when(holds, value) if cascade is None else cascade.when(holds, value)
    advice = (routed == "consultant") | t.rlike(lx.RECOMMEND)
    generic = F.when(english, lx.GENERIC_ADVICE["en"]).otherwise(lx.GENERIC_ADVICE["vi"])
    wished = F.concat(F.when(english, lx.ADVICE_PREFIX["en"]).otherwise(lx.ADVICE_PREFIX["vi"]), F.lit(" "), F.array_join("_prefs", " "))
    conf = lx.EXTRACTION_CONFIDENCE
    cascade = (
        cascade.when(advice & (F.size("_prefs") == 0), result(generic, generic, conf["consultant_generic"]))
        .when(advice, result(wished, wished, conf["consultant_with_preferences"]))
        .when(routed == "order", result(own, F.coalesce(F.nullif(ordered, F.lit("")), t), conf["order"]))
        .when(routed == "ignore", result(own, own, conf["ignore"]))
        .otherwise(result(own, own, conf["fallback"]))
    )
    return df.select(*names, "_lang", cascade.alias("_r")).select(
        *names, F.col("_lang").alias("language"), subject(F.col(text), F.col("_lang")).alias("subject"), surroundings(F.col(text)).alias("context"),
        F.col("_r.action").alias("action"), F.col("_r.cache_key").alias("cache_key"), F.col("_r.confidence").alias("extraction_confidence"),
    )


def domain_tags(text: Column) -> Column:
    t = tx.cache_text(text)
    return F.array_compact(F.array(*[F.when(t.rlike(tx.uni("|".join(f"(?:{p})" for p in ps))), F.lit(tag)) for tag, ps in lx.DOMAIN_TAGS.items()]))


def last_mentions(text: Column, patterns: dict[str, list[str]]) -> Column:
    """struct(start, value) of the last match of each pattern: the length of all before it."""
    found = []
    for value, ps in patterns.items():
        for p in ps:
            before = F.regexp_extract(text, f"(?Us)^(.*)(?:{p})", 1)
            found.append(F.when(text.rlike(tx.uni(p)), F.struct(F.length(before).alias("start"), F.lit(value).alias("value"))))
    return F.array_compact(F.array(*found))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(tx.uni(r"(\w+)")), F.lit(1))


def ordered_size(text: Column) -> Column:
    """The size mentioned last, a named one before any; else a bare size word at the end; else null."""
    t = F.lower(text)
    generic = F.when(
        t.rlike(tx.uni(lx.GENERIC_SIZE)),
        F.struct(F.length(F.regexp_extract(t, f"(?Us)^(.*){lx.GENERIC_SIZE}", 1)).alias("start"), F.upper(F.regexp_extract(t, f"(?Us)^.*{lx.GENERIC_SIZE}", 1)).alias("value")),
    )
    named = F.array_max(F.transform(last_mentions(t, lx.SIZE_PATTERNS), lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("named"), s["value"].alias("value"))))
    last = F.greatest(named, F.when(generic.isNotNull(), F.struct(generic["start"].alias("start"), F.lit(0).alias("named"), generic["value"].alias("value"))))
    # the last word that is not a trailing particle
    end = F.regexp_extract(t, rf"(?U)(\w+)(?:\W+(?:{'|'.join(lx.TRAILING_PARTICLES)})\b)*\W*$", 1)
    bare = F.coalesce(*[F.when(end.isin(ws), F.lit(size)) for size, ws in lx.BARE_SIZES.items()])
    return F.when(last.isNotNull(), last["value"]).otherwise(bare)


def ordered_quantity(text: Column) -> Column:
    """The number mentioned last, in digits or as a word with a unit; one where there is none."""
    t = F.lower(text)
    either = f"(?:{lx.QUANTITY_DIGITS}|{lx.QUANTITY_WITH_UNIT})"
    digits = F.regexp_extract(t, f"(?Us)^.*{either}", 1)
    word = F.regexp_extract(t, f"(?Us)^.*{either}", 2)
    numbers = F.create_map(*[F.lit(x) for kv in lx.QUANTITY_WORDS.items() for x in kv])
    n = F.when(digits != "", digits.cast("int")).when(word != "", F.try_element_at(numbers, word)).otherwise(1)
    return F.when(n > 0, n).otherwise(1)


def resolve_orders(orders: DataFrame, menu: DataFrame) -> DataFrame:
    """orders (query_id, text) with action, item, size, quantity and price against menu (name, size, price, available).

    What an order names depends on its text alone, so distinct texts are matched, by joins: names that a text holds
    by their rarest run of characters, names that share words with it by those words. Null text orders nothing.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    stock = menu.where(F.coalesce("available", F.lit(True)))
    names = stock.select("name").distinct().select("name", F.lower("name").alias("low"), F.array_distinct(words(F.lower("name"))).alias("ws"))
    found = named_items(orders.select(text).distinct(), names)
    df = orders.withColumn("_text", text).join(found.withColumnRenamed("text", "_text"), "_text", "left")
    df = df.withColumn("size", ordered_size(F.col("_text"))).withColumn("quantity", ordered_quantity(F.col("_text")))
    variants = stock.groupBy(F.col("name").alias("item")).agg(F.collect_set(F.struct("size", "price")).alias("_v"))
    df = df.join(variants, "item", "left")
    match = F.filter("_v", lambda v: v["size"] == F.col("size"))
    action = (
        F.when(F.size("unknown_words") > 0, "no_match")
        .when(F.col("item").isNull(), F.when(F.size("_fits") > 0, "ask_item").otherwise("no_match"))
        .when(F.size("_v") == 1, "confirm")
        .when(F.col("size").isNull(), "ask_size")
        .when(F.size(match) == 0, "size_unavailable")
        .otherwise("confirm")
    )
    price = F.when(F.size("_v") == 1, F.col("_v")[0]["price"]).when(F.size(match) > 0, match[0]["price"])
    choices = F.when(F.col("item").isNull() & (F.size("unknown_words") == 0), F.col("_fits"))
    names = [c for c in orders.columns]
    return df.select(*names, action.alias("action"), "item", "size", "quantity", F.when(action == "confirm", price).alias("price"), choices.alias("choices"), "unknown_words")


def named_items(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, item, unknown_words and _fits (names that hold all menu words of the text, MAX_ITEM_CHOICES at most) for distinct texts; names: name, low, ws."""
    sizes = [s for ss in lx.BARE_SIZES.values() for s in ss]
    ignored = set(lx.STOPWORDS) | set(lx.NON_ITEM_WORDS) | set(lx.TRAILING_PARTICLES) | set(sizes)
    fillers = set(lx.STOPWORDS) | set(lx.TRAILING_PARTICLES) | set(sizes) | set(lx.QUANTITY_WORDS) | set(lx.UNIT_WORDS)
    none = F.array().cast("array<string>")
    texts = texts.select("text", F.lower("text").alias("t")).withColumn("w", words(F.col("t")))
    inside = substrings.holding(texts.select("text", F.array("t").alias("t")), "text", "t", names, "low").join(names, "low")
    longest = inside.groupBy("text").agg(F.max(F.struct(F.length("name").alias("n"), "name"))["name"].alias("longest"))
    postings = names.select("name", "ws", F.explode("ws").alias("word"))
    counts = postings.groupBy("word").agg(F.count("*").alias("n"))
    known = texts.select("text", F.explode(F.array_distinct("w")).alias("word")).join(counts.select("word"), "word").groupBy("text").agg(F.collect_set("word").alias("known"))
    base = texts.join(longest, "text", "left").join(known, "text", "left").withColumn("known", F.coalesce("known", none))
    unknown = F.filter("w", lambda x: ~x.isin(sorted(ignored)) & ~x.rlike("^[0-9]+$") & ~F.array_contains("known", x))
    said = F.array_intersect(F.filter("w", lambda x: ~x.isin(sorted(fillers)) & ~x.rlike("^[0-9]+$")), F.col("known"))
    own = F.array_except(F.array_distinct("w"), tx.words_in(lx.GENERIC_ITEM_WORDS))
    base = base.select("text", "longest", F.when(F.col("longest").isNotNull(), none).otherwise(unknown).alias("unknown_words"), said.alias("said"), own.alias("own"))
    open_ = base.where(F.col("longest").isNull() & (F.size("unknown_words") == 0))
    shared = open_.select("text", F.explode("own").alias("word")).join(postings.select("word", "name"), "word").groupBy("text", "name").agg(F.count("*").alias("s"))
    leaders = shared.groupBy("text", "s").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    unique = leaders.groupBy("text").agg(F.max_by(F.struct("n", "name"), "s").alias("top")).select("text", F.when(F.col("top.n") == 1, F.col("top.name")).alias("unique"))
    rarest = F.min_by("word", F.struct("n", "word"))
    rare = open_.select("text", "said", F.explode("said").alias("word")).join(counts, "word").groupBy("text", "said").agg(rarest.alias("word"))
    fits = rare.join(postings, "word").where(F.size(F.array_except("said", "ws")) == 0).select("text", "name")
    place = F.row_number().over(Window.partitionBy("text").orderBy("name"))
    fits = fits.withColumn("place", place).where(F.col("place") <= lx.MAX_ITEM_CHOICES).groupBy("text").agg(F.array_sort(F.collect_list("name")).alias("_fits"))
    one = F.when(F.size("_fits") == 1, F.col("_fits")[0])
    item = F.when(F.size("unknown_words") == 0, F.coalesce("longest", "unique", one))
    met = base.join(unique, "text", "left").join(fits, "text", "left").withColumn("_fits", F.coalesce("_fits", none))
    return met.select("text", item.alias("item"), "unknown_words", "_fits")
