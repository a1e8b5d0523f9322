"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share a key, and a word that differs by one added,
removed or exchanged letter has a key that differs by that letter's value, or by the difference of two. Instead of trying
every value, each word also states its key without each of its letters: a removal meets the shorter word's own key
there, and an exchange meets the other word's key without its letter.

Words whose keys meet share letters, not yet their order. Around one edit either the first half of what stays or the second half
is untouched, so that half is part of the join key, which keeps large sets of anagrams apart; the rest of the order
is verified by the edit distance. Each pair is found exactly once: fifth powers of letters have no two equal
differences, and where both halves are untouched the first one counts.

Words are counted before anything is joined, so a word that a third of all rows hold is one row a task. Joins are plain
ones that Spark can split where they are skewed; counts of near words are sums.

Null text has no words. Repeated rows count each time. A null id stands for the empty text in the checksum. Very long
runs of letters are words like others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, remove, table, text_of
from orderloom.llm.prefix_trie import CRC_TABLE, crc32_sql

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A near word this many times as frequent is the form.
TIMES = 5
#: Keys are taken modulo this prime, so that no length overflows.
PRIME = 2**61 - 1
#: One in so many occurrences loses a letter in the query's texts.
SLIP = 199


def value(letter: Column) -> Column:
    """A letter's power."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slip: bool = False) -> DataFrame:
    """word of every occurrence that is long enough."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(text_of(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS)
    low = F.translate("run", UPPER, LOWER)
    word = slipped(F.col("id"), low) if slip else low
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)


def vocabulary(occurrences: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n, its occurrences, where there are enough."""
    return occurrences.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def marks(vocab: DataFrame) -> DataFrame:
    """Keys under which words meet: word, n, the letter left out (null: none), the key and size of what stays, and one half of it."""
    letters = F.split("word", "")
    keyed = vocab.select("word", "n", letters.alias("letters"))
    keyed = keyed.withColumn("whole", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + value(c)) % PRIME)).withColumn("size", F.length("word"))
    out = keyed.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("letters"))).alias("letter")).drop("letters")
    stays = F.col("size") - F.col("letter").isNotNull().cast("int")
    key = F.when(F.col("letter").isNull(), F.col("whole")).otherwise(F.pmod(F.col("whole") - value(F.col("letter")), F.lit(PRIME)))
    out = out.select("word", "n", "letter", key.alias("key"), stays.alias("stays"), F.floor(stays / 2).cast("int").alias("half"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    first = F.substring("word", F.lit(1), F.col("half"))
    rest = F.substring("word", F.col("half") + 1, F.length("word"))
    last = F.substring("word", F.length("word") - (F.col("stays") - F.col("half")) + 1, F.col("stays") - F.col("half"))
    may = F.col("letter").isNull() | F.when(F.col("side") == 0, F.contains(rest, "letter")).otherwise(F.contains(first, "letter"))
    return out.where(may).select("word", "n", "letter", "key", "stays", "side", F.when(F.col("side") == 0, first).otherwise(last).alias("part"), first.alias("first"))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n: two words that differ by exactly one inserted, deleted or replaced letter, both ways."""
    all_ = marks(vocab)
    shorter = all_.where("letter IS NOT NULL").alias("a")
    on = " AND ".join(f"a.{c} = b.{c}" for c in ("key", "stays", "side", "part"))
    met = shorter.join(all_.alias("b"), F.expr(on + " AND (b.letter IS NULL OR (a.word < b.word AND a.letter <> b.letter)) AND (a.side = 0 OR a.first <> b.first)"))
    found = met.where(F.levenshtein("a.word", "b.word", 1) == 1)
    both = lambda x, y: F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n"))
    return found.select(F.inline(F.array(both("a", "b"), both("b", "a"))))


def forms(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, form (its most frequent near word, if it is times as frequent), n_near and form_n; vocab is read more than once."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    near = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = vocab.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= times * F.col("n")
    return named.select("word", "n", F.when(is_form, F.col("best.word")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))


def roots(named: DataFrame) -> DataFrame:
    """word and root of words that have a form; named (word, form) is read more than once.

    Every word jumps to where its root's own jump ends, so chains halve each time; forms grow by a factor with each step,
    so there are few.
    """
    now = materialize(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(after.where("moved").head(1))
        remove(now.sparkSession, now)
        if not moved:
            return after.select("word", "root")
        now = after


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of vocab (word, n)."""
    named = materialize(forms(materialize(vocab, "vocabulary"), times), "forms")
    return named.join(roots(named), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(words(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=True)))


OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
summed AS (SELECT run, k, {crc32_sql("id || ':' || run")} AS h FROM runs, crc_table),
slips AS (SELECT k, CASE WHEN h % {SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM slips WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY 1),
named AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * v.n THEN most END AS form_n,
    CASE WHEN most >= {TIMES} * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.other_n = most) END AS form
  FROM vocab v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM named UNION ALL SELECT w.word, f.form FROM walk w JOIN named f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM named f JOIN walk w ON w.word = f.word JOIN named e ON e.word = w.at AND e.form IS NULL
"""
