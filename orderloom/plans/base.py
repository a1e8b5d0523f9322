"""Registered queries: a builder over the tables of a folder, and where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def sql_any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(n)})" for n in needles) + ")"


def sql_hits(text: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {quoted(n)})::INT" for n in needles) + ")"


#: Utterances made from the part table: what customers say, with an item, a number and a size put in.
TEMPLATES = [
    "cho anh {q} ly {i} size {s}", "{i} có ngon không?", "recommend {i} less sweet", "Quán có wifi không? mật khẩu là gì", "hello", "Mấy giờ đóng cửa", "order {q} {i} coffee size {s}",
    "còn {i} không ạ", "thanh toán momo được không", "what is good, cheap {i} tea?", "thêm {q} cà phê sữa", "ừm", "tôi muốn {i} nóng", "giao hàng {q} giờ", "vậy size {s}", "ok em", "xem đơn",
]
SIZES = ["S", "M", "L"]


def utterances(t: Tables) -> DataFrame:
    """utter_id, item, quantity, size, text and kind (the template's number)."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    key = F.col("p_partkey")
    p = t.part.select(key.alias("utter_id"), F.col("p_name").alias("item"), (F.col("p_size") % 5 + 1).alias("quantity"), pick(SIZES, key).alias("size"), (key % len(TEMPLATES)).cast("int").alias("kind"))
    text = pick(TEMPLATES, F.col("utter_id"))
    for mark, value in (("{i}", F.col("item")), ("{q}", F.col("quantity").cast("string")), ("{s}", F.col("size"))):
        text = F.replace(text, F.lit(mark), value)
    return p.withColumn("text", text)


UTTERANCES_SQL = f"""utterances AS (
  SELECT utter_id, item, quantity, size, kind,
    replace(replace(replace({sql_list(TEMPLATES)}[kind + 1], '{{i}}', item), '{{q}}', quantity::VARCHAR), '{{s}}', size) AS text
  FROM (SELECT p_partkey AS utter_id, p_name AS item, p_size % 5 + 1 AS quantity, {sql_list(SIZES)}[p_partkey % 3 + 1] AS size,
    (p_partkey % {len(TEMPLATES)})::INT AS kind FROM part))"""


def menu_rows(t: Tables) -> DataFrame:
    """The part table as menu rows: several rows of one name are sizes and versions of one product."""
    key = F.col("p_partkey")
    categories = F.array(*map(F.lit, ["coffee", "tea", "freeze", "food"]))
    return t.part.select(
        key.alias("ord"), F.concat(F.lit("menu_"), key).alias("id"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_brand")).alias("name"),
        F.element_at(categories, (F.col("p_size") % 4 + 1).cast("int")).alias("category"), F.element_at(F.array(*map(F.lit, SIZES)), (key % 3 + 1).cast("int")).alias("size"),
        F.floor("p_retailprice").cast("string").alias("price"), F.concat(F.lower("p_type"), F.lit("| iced |"), F.lower("p_brand")).alias("tags"),
        F.concat_ws("|", F.split("p_name", " ")).alias("ingredients"), F.concat("p_name", F.lit(" size S (1.000đ) — fine, "), F.lower("p_type"), F.lit(". Good.")).alias("description"),
        (F.col("p_size") > 5).cast("string").alias("available"),
    )


MENU_SQL = f"""menu AS (
  SELECT p_partkey AS ord, 'menu_' || p_partkey AS id,
    list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' ' || p_brand AS name,
    ['coffee', 'tea', 'freeze', 'food'][p_size % 4 + 1] AS category, {sql_list(SIZES)}[p_partkey % 3 + 1] AS size,
    floor(p_retailprice)::INT AS price, [lower(p_type), 'iced', lower(p_brand)] AS tags, string_split(p_name, ' ') AS ingredients,
    p_name || ' — fine, ' || lower(p_type) || '. Good.' AS description, p_size > 5 AS available
  FROM part)"""


def nodes(t: Tables) -> DataFrame:
    """Menu nodes from parts and FAQ nodes from the benchmark texts."""
    text = lambda c: F.col(c).cast("string")
    menu = t.part.where("p_size > 5").select(
        F.concat(F.lit("menu_"), F.col("p_partkey")).alias("source_id"), F.lit("menu").alias("source_type"), F.col("p_name").alias("name"),
        F.concat_ws(" | ", "p_name", "p_type", F.floor("p_retailprice").cast("string")).alias("text"), F.array("p_name", "p_brand", "p_type").alias("fields"),
        F.col("p_type").alias("category"), F.lit(None).cast("string").alias("topic"),
    )
    faq = t.benchmark.select(
        F.concat(F.lit("faq_"), text("item_id")).alias("source_id"), F.lit("faq").alias("source_type"), F.lit(None).cast("string").alias("name"), "text",
        F.array("text").alias("fields"), F.lit(None).cast("string").alias("category"), F.element_at(F.array(*map(F.lit, ["wifi", "delivery", "size"])), (F.col("item_id") % 3 + 1).cast("int")).alias("topic"),
    )
    return menu.unionByName(faq)


#: Searches ask for the ids divisible by this, against all rows.
EVERY = 20


def questions(t: Tables) -> DataFrame:
    """query_id, intent and text: one query a part, about that part and a word of the FAQ texts."""
    intent = F.element_at(F.array(*map(F.lit, ["order", "consultant", "faq"])), (F.floor(F.col("p_partkey") / EVERY) % 3 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("query_id"), intent.alias("intent"), F.concat(F.lit("Cho anh 1 "), "p_name", F.lit(" then, with the WIFI?")).alias("text"))


def asked(t: Tables) -> DataFrame:
    """The questions that are searched for."""
    return questions(t).where(F.col("query_id") % EVERY == 0)


RETRIEVAL_SQL = f"""nodes AS (
  SELECT 'menu_' || p_partkey AS source_id, 'menu' AS source_type, p_name AS name, p_name || ' | ' || p_type || ' | ' || floor(p_retailprice)::BIGINT AS text,
    [p_name, p_brand, p_type] AS fields, p_type AS category, NULL AS topic FROM part WHERE p_size > 5
  UNION ALL
  SELECT 'faq_' || item_id, 'faq', NULL, text, [text], NULL, ['wifi', 'delivery', 'size'][item_id % 3 + 1] FROM benchmark),
questions AS (
  SELECT p_partkey AS query_id, ['order', 'consultant', 'faq'][(p_partkey // {EVERY}) % 3 + 1] AS intent, 'Cho anh 1 ' || p_name || ' then, with the WIFI?' AS text FROM part),
asked AS (SELECT * FROM questions WHERE query_id % {EVERY} = 0),
words AS (
  SELECT query_id, intent, list_distinct(list_append(string_split(p_name, ' '), 'wifi') || ['then', 'with', 'the']) AS ws
  FROM questions JOIN part ON p_partkey = query_id),
all_terms AS (
  SELECT query_id, intent, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS r FROM (SELECT query_id, intent, unnest(ws) AS term FROM words)) WHERE r <= 6),
terms AS (SELECT * FROM all_terms WHERE query_id % {EVERY} = 0),
found AS (
  SELECT * FROM (
    SELECT term, source_id, source_type, name, text, row_number() OVER (PARTITION BY term, source_type ORDER BY source_id) AS r
    FROM (SELECT DISTINCT term FROM terms) JOIN nodes ON len(list_filter(fields, lambda f: contains(lower(f), term))) > 0) WHERE r <= 20),
hits AS (
  SELECT query_id, intent, n_terms, term, source_id, source_type, text,
    CASE WHEN source_type = 'menu' AND contains(lower(name), term) THEN 0.95 WHEN source_type = 'menu' THEN 0.85 WHEN source_type = 'faq' THEN 0.95 ELSE 0.70 END::DOUBLE AS score
  FROM terms JOIN found USING (term)
  WHERE (intent = 'order' AND source_type = 'menu') OR (intent = 'consultant' AND source_type IN ('menu', 'document')) OR (intent = 'faq' AND source_type IN ('faq', 'document'))),
covered AS (
  SELECT query_id, intent, source_id, source_type, min(text) AS text, max(score) * (0.6::DOUBLE + 0.4::DOUBLE * (count(DISTINCT term)::DOUBLE / max(n_terms))) AS score
  FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_id) AS place FROM covered)"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def as_text(c: Column) -> Column:
    return F.array_join(c, ",")
