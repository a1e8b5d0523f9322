"""Personal data by weak supervision.

Patterns give candidate spans: four base kinds, which are always reported, and
wider kinds. Four labelers vote on each candidate, for, against or not at all: the
strict shape of its kind, gazetteers, the words before it, and the characters
around it. Votes over the whole corpus are counted by pattern; the number of
patterns is bounded (three values for each labeler, times the kinds), so
expectation-maximisation runs over those counts: the E step gives each pattern's
posterior, the M step each labeler's reliability on true and on false candidates
and each kind's prior. The posteriors then train the final span classifier, a
naive Bayes model over the votes and the span's own features, with one more
aggregate. Wider spans that it accepts are added to the base ones.

Matching is row-wise; what is shuffled are counts by pattern, one row for each
task and pattern. Fitted numbers (some dozens) go into the plan as literals.

Null and empty texts have no spans. Repeated rows count each. An empty table
fits priors alone and gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, table, text_of
from orderloom.llm.spans import Kind, apart_from, listed, once, with_spans


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Possessive groups and the look-behinds keep long runs linear and match what the plain patterns do.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, lambda v: v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, lambda v: F.length(digits(v)).between(13, 19) & F.call_function("luhn_check", digits(v))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(9, 15)),
)
STREETS = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|Place|Crescent|Highway|Parkway|Close|Row|Mews|Quay"
WIDER = (
    Kind("at_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", lambda t: t.rlike(r"[\[(]at[\])]")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    Kind("tel", r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    Kind("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?(?![A-Za-z])"),
    Kind("street", rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?\x20(?:{STREETS})(?![A-Za-z])"),
)
KINDS = [k.name for k in (*BASE, *WIDER)]
LABELERS = ("shape", "gazetteer", "context", "edges")
FEATURES = ("digits_9", "capital", "long_16", "spaced")
#: Gazetteers: common given names, top-level domains, countries of account numbers.
NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy "
    "Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Emily Andrew Michelle Paul Amanda Joshua Melissa Kenneth Laura Kevin Amy Brian Anna George Emma Peter Helen "
    "Maria Hans Klaus Jürgen Wolfgang Ursula Petra Monika Stefan Andreas Sabine Pierre Marie Jean Sophie Philippe Isabelle Luc Claire Juan Carlos Carmen Luis Ana José Pilar Javier "
    "Giulia Marco Paolo Francesca Giovanni Ahmed Fatima Mohammed Aisha Omar Wei Li Yuki Hiroshi Kenji Priya Raj Anil Ivan Olga Dmitri Natalia Anders Ingrid Lars Nguyen Linh Minh"
).split()
DOMAINS = "com org net edu gov mil int io co ai app dev biz info name de at ch fr be nl lu es pt it gr uk ie eu us ca mx br ar au nz jp cn kr in sg vn se no dk fi pl cz hu ro ru ua tr za".split()
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR UA".split()
FOR = r"\b(?:e-?mail|mail|contact|reach|write|call|phone|tel|mobile|fax|card|visa|credit|account|iban|ssn|social security|ip|address|name|lives? at|born|patient|customer)\b"
AGAINST = r"\b(?:version|ver|v|isbn|issn|order|invoice|part|sku|ref|figure|fig|table|section|chapter|page|build|release|serial)\b"
BEFORE = 40
ROUNDS = 12


def iban_checks(value: Column) -> Column:
    """Length and check digits of an account number: the rest of 97 is 1 with the first four characters last and letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4)), "")
    step = lambda n, c: (n * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.coalesce(F.conv(c, 36, 10).cast("int"), F.lit(0))) % 97
    return F.length(bare).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def votes(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote: 1, -1 or 0."""
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    nine = digits(value)
    strict = {
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "tel": nine.rlike("^[2-9][0-9]{2}[2-9]"),
        "iban": iban_checks(value),
        **dict.fromkeys((k.name for k in BASE), F.lit(True)),
    }
    strict_ = F.coalesce(*[F.when(kind == k, c) for k, c in strict.items()])  # null for kinds that have no stricter shape than their pattern
    known = {
        "email": F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS),
        "at_email": F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS),
        "iban": F.substring(value, 1, 2).isin(COUNTRIES),
        "name": value.rlike(rf"(?<!\p{{L}})(?:{'|'.join(NAMES)})(?!\p{{L}})"),
        "card": nine.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": nine.rlike("^(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"),
        "ip": ~value.rlike(r"^(?:0|127|255)\."),
    }
    listed_ = F.coalesce(*[F.when(kind == k, c) for k, c in known.items()])  # null for kinds without a gazetteer
    words = F.lower(before)
    glued = before.rlike(r"[A-Za-z0-9=/_#]$") | after.rlike(r"^[A-Za-z0-9=/_]")
    return {
        "shape": sign(strict_, ~strict_),
        "gazetteer": sign(listed_, ~listed_),
        "context": sign(words.rlike(FOR), words.rlike(AGAINST)),
        "edges": sign(~glued, glued),
    }


def features(value: Column) -> dict[str, Column]:
    return {
        "digits_9": F.length(digits(value)) >= 9,
        "capital": value.rlike("[A-Z]"),
        "long_16": F.length(value) >= 16,
        "spaced": value.contains(" "),
    }


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, whose text is not null, with base and wider: arrays of start, end, kind, and the votes and features of each span. Columns of docs by these two names are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("base", "wider")]
    inner = docs.select(F.struct(*names).alias("doc"), F.col(text).alias("t"))
    found = with_spans(inner, "t", [*BASE, *WIDER])
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    found = found.select("doc", "t", F.concat(*[F.col(k.name) for k in BASE]).alias("base"), *[k.name for k in WIDER])
    found = found.withColumn("wider", F.array().cast(found.schema["base"].dataType))
    for k in WIDER:
        free = apart_from(apart_from(F.col(k.name), F.col("base")), F.col("wider"))
        found = found.select(*[c for c in found.columns if c not in (k.name, "wider")], F.concat("wider", bare(free)).alias("wider"))

    def judged(s: Column) -> Column:
        lead = F.substring(F.col("t"), F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(F.lit(BEFORE), s["start"]))
        tail = F.substring(F.col("t"), s["end"] + 1, F.lit(1))
        def described(around: Column) -> Column:
            given = {**votes(s["kind"], s["value"], around["lead"], around["tail"]), **features(s["value"])}
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), *[c.cast("int").alias(n) for n, c in given.items()])

        return once({"lead": lead, "tail": tail}, described)

    return found.select("doc.*", F.transform("base", judged).alias("base"), F.transform("wider", judged).alias("wider"))


class Model(NamedTuple):
    """reliability: labeler to (P(for | true), P(for | false)) where it votes; weights: name to (weight if set, weight if not)."""

    prior: dict[str, float]
    reliability: dict[str, tuple[float, float]]
    bias: float
    weights: dict[str, tuple[float, float]]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def posterior(prior: dict[str, float], reliability: dict[str, tuple[float, float]]) -> Column:
    """The probability that a candidate with its kind and votes is personal data."""
    score = F.coalesce(*[F.when(F.col("kind") == k, F.lit(_logit(p))) for k, p in prior.items()], F.lit(0.0))
    for name, (true, false) in reliability.items():
        vote = F.col(name)
        score = score + F.when(vote == 1, math.log(true / false)).when(vote == -1, math.log((1 - true) / (1 - false))).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def indicators() -> dict[str, Column]:
    """The classifier's inputs."""
    found = {f"{n}_for": F.col(n) == 1 for n in LABELERS} | {f"{n}_against": F.col(n) == -1 for n in LABELERS}
    return found | {n: F.col(n) == 1 for n in FEATURES} | {f"kind_{k}": F.col("kind") == k for k in KINDS}


def fit(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM and the classifier, from the output of with_candidates."""
    spans = found.select(F.explode(F.concat("base", "wider")).alias("s")).select("s.*")
    patterns = materialize(spans.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")), "pii-patterns")
    prior, reliability = dict.fromkeys(KINDS, 0.7), dict.fromkeys(LABELERS, (0.8, 0.3))
    for _ in range(rounds):
        p = posterior(prior, reliability)
        sums = {"n": F.col("n"), "true": p * F.col("n")}
        for j in LABELERS:
            yes, any_ = (F.col(j) == 1).cast("double"), (F.col(j) != 0).cast("double")
            sums |= {f"{j}_tf": p * yes * F.col("n"), f"{j}_t": p * any_ * F.col("n"), f"{j}_ff": (1 - p) * yes * F.col("n"), f"{j}_f": (1 - p) * any_ * F.col("n")}
        rows = patterns.groupBy("kind").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect()  # one row per kind
        total = lambda k: sum(r[k] or 0.0 for r in rows)  # noqa: E731, B023
        prior = dict.fromkeys(KINDS, 0.7) | {r["kind"]: (r["true"] + 7.0) / (r["n"] + 10.0) for r in rows}
        # ten pseudo-votes keep the classes from trading places and every estimate off 0 and 1
        reliability = {
            j: ((total(f"{j}_tf") + 8.0) / (total(f"{j}_t") + 10.0), min((total(f"{j}_ff") + 3.0) / (total(f"{j}_f") + 10.0), 0.95))
            for j in LABELERS
        }
    p = posterior(prior, reliability)
    sums = {"all_t": p * F.col("n"), "all_f": (1 - p) * F.col("n")}
    for name, is_set in indicators().items():
        sums |= {f"{name}_t": p * is_set.cast("double") * F.col("n"), f"{name}_f": (1 - p) * is_set.cast("double") * F.col("n")}
    row = patterns.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()]).first()
    rate = lambda k, c: (row[f"{k}_{c}"] + 1.0) / (row[f"all_{c}"] + 2.0)
    weights = {k: (math.log(rate(k, "t") / rate(k, "f")), math.log((1 - rate(k, "t")) / (1 - rate(k, "f")))) for k in indicators()}
    return Model(prior, reliability, math.log((row["all_t"] + 1.0) / (row["all_f"] + 1.0)), weights)


def accepted(model: Model, span: Column) -> Column:
    """Whether the classifier takes a span for personal data."""

    def is_set(name: str) -> Column:
        if name.startswith("kind_"):
            return span["kind"] == name.removeprefix("kind_")
        if name.endswith("_for"):
            return span[name.removesuffix("_for")] == 1
        return span[name.removesuffix("_against")] == -1 if name.endswith("_against") else span[name] == 1

    score = F.lit(model.bias)
    for name, (yes, no) in model.weights.items():
        score = score + F.when(is_set(name), yes).otherwise(no)
    return score >= 0


def report(spark: SparkSession, model: Model) -> DataFrame:
    """labeler, and how often it votes for true and for false candidates where it votes."""
    rows = [F.struct(F.lit(n).alias("labeler"), F.lit(t).alias("for_true"), F.lit(f).alias("for_false")) for n, (t, f) in model.reliability.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_personal_data(found: DataFrame, model: Model) -> DataFrame:
    """The output of with_candidates, with wider reduced to the spans that the classifier accepts."""
    names = [c for c in found.columns if c != "wider"]
    return found.select(*names, F.filter("wider", lambda s: accepted(model, s)).alias("wider"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    found = materialize(with_candidates(docs).drop("text"), "pii-found")
    found = with_personal_data(found, fit(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k.name) for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", F.array_sort("wider"))).alias("spans"),
        F.size("wider").cast("long").alias("n_wider"), (F.size("base") + F.size("wider")).cast("long").alias("n_spans"),
    )
