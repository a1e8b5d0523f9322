"""Catalog ETL, its property graph, and lookups into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import ranks, substrings

# --- fixed values: option groups and entities of the domain ----------------------------------
OPTION_GROUPS = {"sugar": ("Đường", "binh_thuong"), "ice": ("Đá", "binh_thuong"), "temperature": ("Nóng/Đá", "da")}
OPTION_ORDER = {"sugar": 0, "ice": 1, "temperature": 2}
SIZE_CLAUSE = r"\s*size\s+[SML]\s*\([^)]*\)"


def listed(c: Column, sep: str = r"\|") -> Column:
    """Parts of a separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, sep), tx.strip), lambda p: p != "")


def option_groups(category: Column, tags: Column) -> Column:
    has = lambda t: F.array_contains(tags, t)
    return (
        F.when(category == "food", F.array().cast("array<string>"))
        .when(has("hot"), tx.words_in(["sugar"]))
        .when(has("iced"), tx.words_in(["sugar", "ice"]))
        .when(category == "freeze", tx.words_in(["sugar"]))
        .when(category == "tea", tx.words_in(["sugar", "ice"]))
        .when(category == "coffee", tx.words_in(["sugar", "ice", "temperature"]))
        .otherwise(F.array().cast("array<string>"))
    )


def size_rank(size: Column) -> Column:
    return F.coalesce(*[F.when(size == s, F.lit(i)) for s, i in lx.SIZE_ORDER.items()], F.lit(99))


def status(available: Column) -> Column:
    return F.when(F.lower(tx.strip(available.cast("string"))) == "true", "active").otherwise("sold_out")


def first_seen_union(ord_: Column, values: Column) -> Column:
    """Distinct values of all rows' arrays, in the order in which they first occur."""
    rows = F.array_sort(F.collect_list(F.struct(ord_.alias("o"), values.alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def products(rows: DataFrame) -> DataFrame:
    """One product per slug of name from menu rows (ord, id, name, category, size, price, tags, ingredients, description, available).

    Scalars come from the first row; the description from the last row of size
    S, else from the first row that has one; variants are ordered by size.
    """
    r = rows.select(
        "ord", "id", "category", "size", F.col("price").cast("int").alias("price"), tx.slug(F.col("name")).alias("slug"), "name",
        listed(F.col("tags")).alias("tags"), listed(F.col("ingredients")).alias("ingredients"), status(F.col("available")).alias("status"),
        tx.strip(F.regexp_replace("description", SIZE_CLAUSE, "")).alias("description"),
    )
    small = F.max_by(F.when(F.col("size") == "S", F.col("description")), F.when(F.col("size") == "S", F.col("ord")))
    any_ = F.min_by(F.nullif("description", F.lit("")), F.when(F.col("description") != "", F.col("ord")))
    p = r.groupBy("slug").agg(
        F.min("ord").alias("first"), F.min_by("name", "ord").alias("name"), F.min_by("category", "ord").alias("category"), F.min_by("status", "ord").alias("status"),
        F.coalesce(small, any_, F.lit("")).alias("description"), first_seen_union(F.col("ord"), F.col("tags")).alias("tags"),
        first_seen_union(F.col("ord"), F.col("ingredients")).alias("ingredients"),
        F.array_sort(F.collect_list(F.struct(size_rank(F.col("size")).alias("rank"), "ord", "id", "size", "price"))).alias("variants"),
    )
    variants = F.transform("variants", lambda v: F.struct(v["id"].alias("id"), v["size"].alias("size"), v["price"].alias("price")))
    return p.withColumn("variants", variants).withColumn("option_groups", option_groups(F.col("category"), F.col("tags")))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows put in place of those with equal keys, or added."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def replace_children(target: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """target without the children of the rows' parents, and the rows."""
    return target.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def last_write(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the last written one."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def mention_edges(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, MENTIONS, target_id where a node's text holds one of an entity's keywords (entity_id, keywords)."""
    words = entities.select("entity_id", F.explode("keywords").alias("k")).select("entity_id", F.lower("k").alias("k"))
    low = nodes.select("source_id", F.array(F.lower("text")).alias("t"))
    found = substrings.holding(low, "source_id", "t", words, "k").join(words, "k")
    return found.select("source_id", F.lit("MENTIONS").alias("relation"), F.col("entity_id").alias("target_id")).distinct()


def next_edges(chunks: DataFrame, key: str = "source_id", within: str | None = None) -> DataFrame:
    """Edges from each chunk to the next by key: over all chunks, or within each document.

    Keys are chained in ranges of bounded size, whatever the size of a document.
    """
    found = ranks.chained(chunks, key, [within] if within is not None else [], "target_id").where("target_id is not null")
    return found.select(F.col(key).alias("source_id"), F.lit("NEXT").alias("relation"), "target_id")


def list_edges(nodes: DataFrame, values: str, relation: str, prefix: str = "") -> DataFrame:
    """Edges from each node to the lower-cased members of one of its arrays."""
    v = F.concat(F.lit(prefix), F.lower("v"))
    return nodes.select("source_id", F.explode(values).alias("v")).select("source_id", F.lit(relation).alias("relation"), v.alias("target_id")).distinct()


def vocabulary(texts: DataFrame, *columns: str) -> DataFrame:
    """Distinct words of the columns."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all(joined, F.lit(tx.uni(r"(\w+)")), F.lit(1)))).alias("word")).distinct()


def variants_of(names: DataFrame, menu: DataFrame) -> DataFrame:
    """Each asked name, as spelled, with its variants by size and price; none for a name that is not on the menu."""
    own = menu.where(F.coalesce("available", F.lit(True))).groupBy(F.lower("name").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct(size_rank(F.col("size")).alias("rank"), F.coalesce("price", F.lit(0)).alias("price"), "size"))).alias("variants")
    )
    found = names.withColumn("k", F.lower("name")).join(own, "k", "left")
    return found.select("name", F.transform(F.coalesce("variants", F.array().cast(own.schema["variants"].dataType)), lambda v: F.struct(v["size"].alias("size"), v["price"].alias("price"))).alias("variants"))


def seed_counts(products_: DataFrame, faqs: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind and n: how much a seed brings, each table counted by itself."""
    own = products_.agg(F.count("*").alias("products"), F.coalesce(F.sum(F.size("variants")), F.lit(0)).alias("variants"), F.coalesce(F.sum(F.size("option_groups")), F.lit(0)).alias("option_links"))
    found = own.select(F.explode(F.create_map(*[x for k in own.columns for x in (F.lit(k), F.col(k))])).alias("kind", "n"))
    for kind, df in (("faqs", faqs), ("chunks", chunks)):
        found = found.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return found


def projection(menu: DataFrame, faqs: DataFrame, chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """All edges of the graph: categories, tags and ingredients of menu items, topics that FAQ entries mention, chunks next to each other in their document."""
    edges = menu.select("source_id", F.lit("BELONGS_TO").alias("relation"), F.col("category").alias("target_id"))
    edges = edges.unionByName(list_edges(menu, "tags", "HAS_TAG", "tag::")).unionByName(list_edges(menu, "ingredients", "HAS_INGREDIENT"))
    return edges.unionByName(mention_edges(faqs, topics)).unionByName(next_edges(chunks, within="document"))
