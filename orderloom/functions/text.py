"""Text functions as Catalyst expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom import lexicon as lx


def words_in(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(values: dict[str, Column], body) -> Column:
    """body of the values, worked out once: a lambda's variable stays one reference where optimizer rules would copy an expression."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), lambda v: body(v))[0]


def uni(pattern: str) -> str:
    """A pattern whose \\w, \\s and \\b know all letters."""
    return f"(?U){pattern}"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, uni(r"\s+"), " ")


#: All characters that \\s matches where it knows all letters.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(SPACES))


def nfc(c: Column) -> Column:
    """Canonical composition. Spark has no such function; text of ASCII or composed letters passes through an Arrow batch."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return compose(c)


def query_text(c: Column) -> Column:
    """Lower case, only letters, digits and single spaces."""
    return squeeze(F.regexp_replace(strip(F.lower(c)), uni(r"[^\w\sÀ-ỹ]"), " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def clean_query(c: Column) -> Column:
    """The query without stopwords and numbers, in order; the query itself where nothing is left."""
    kept = F.filter(tokens(query_text(c)), lambda t: ~t.isin(lx.STOPWORDS) & ~t.rlike("^[0-9]+$"))
    return let({"kept": kept}, lambda v: F.when(F.size(v["kept"]) > 0, F.array_join(v["kept"], " ")).otherwise(c))


def search_terms(c: Column) -> Column:
    """Aliases' canonical words and the other words, longest first, six at most."""

    def found(q: Column) -> Column:
        named = [F.when(any_of(q, names), F.lit(term)) for term, names in lx.ALIASES.items()]
        words = F.filter(tokens(q), lambda t: (F.length(t) >= lx.MIN_TOKEN) & ~t.isin(lx.STOPWORDS))
        return F.array_distinct(F.concat(F.array_compact(F.array(*named)), words))

    def longest(q: Column, terms: Column) -> Column:
        ordered = F.transform(F.sort_array(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
        return F.when(F.size(terms) > 0, F.slice(ordered, 1, lx.MAX_TERMS)).otherwise(F.array(q))

    return let({"q": query_text(c)}, lambda v: let({"q": v["q"], "found": found(v["q"])}, lambda w: longest(w["q"], w["found"])))


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text, worked out once, holds one of the needles."""
    return let({"t": text}, lambda v: F.exists(words_in(needles), lambda n: F.contains(v["t"], n)))


def hits(text: Column, needles: list[str]) -> Column:
    """How many of the needles the text, worked out once, holds."""
    return let({"t": text}, lambda v: F.size(F.filter(words_in(needles), lambda n: F.contains(v["t"], n))))


def lexical_tokens(c: Column) -> Column:
    """Distinct words without punctuation and lexical stopwords."""
    return F.array_except(F.array_distinct(tokens(F.translate(F.lower(c), "?.,:;|-_", " " * 8))), words_in(lx.LEXICAL_STOPWORDS))


def lexical_overlap(query: Column, text: Column) -> Column:
    share = lambda q, t: F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))
    return let({"q": lexical_tokens(query), "t": lexical_tokens(text)}, lambda v: share(v["q"], v["t"]))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is empty, their lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def hash_slot(token: Column, dim: int = lx.EMBEDDING_DIM) -> Column:
    """The position of a token in a hashed bag of words; dim is a power of two up to 4096."""
    return F.conv(F.substring(F.md5(token), 30, 3), 16, 10).cast("int").bitwiseAND(dim - 1)


def hash_vector(words: Column, dim: int = lx.EMBEDDING_DIM, normal: bool = True) -> Column:
    """A hashed bag of words: how often each slot occurs, at length 1 if normal; null for no words."""

    @F.pandas_udf("array<double>")
    def counted(slots: pd.Series) -> pd.Series:
        out = []
        for s in slots:
            v = None if s is None or not len(s) else np.bincount(np.asarray(s), minlength=dim).astype(np.float64)
            out.append(v / np.sqrt((v * v).sum()) if normal and v is not None else v)
        return pd.Series(out, dtype=object)

    return counted(F.transform(words, lambda w: hash_slot(w, dim)))


def cache_text(c: Column) -> Column:
    return strip(F.regexp_replace(squeeze(strip(F.lower(c))), "[?!。！？]+$", ""))


def cache_key(intent: Column, c: Column) -> Column:
    return F.concat(intent, F.lit(":"), cache_text(c))


def router_text(c: Column) -> Column:
    """Trimmed, lower case, single spaces. Compose with nfc() first where text may be decomposed."""
    return squeeze(F.lower(strip(c)))


#: Letters with marks and what is left of them; composed forms of Vietnamese and the western languages.
PLAIN = {
    base: [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(c))[0] == base and len(unicodedata.normalize("NFD", chr(c))) > 1]
    for base in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
}


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, joined by hyphens."""
    marked = [(m, base) for base, ms in PLAIN.items() for m in ms] + [("đ", "d"), ("Đ", "D")]
    plain = F.translate(c, "".join(m for m, _ in marked), "".join(b for _, b in marked))
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def vnd(amount: Column) -> Column:
    """35000 as 35.000đ."""
    return F.concat(F.translate(F.format_number(amount.cast("long"), 0), ",", "."), F.lit("đ"))


def short_description(c: Column) -> Column:
    """What follows the first long dash, up to the first full stop."""
    rest = F.regexp_replace(c, "^[^—]*—", "")
    return strip(F.substring_index(rest, ".", 1))


def spoken(c: Column) -> Column:
    """Text for speech: prices in thousands, VAT and sizes as said."""
    out = F.regexp_replace(c, r"(\d{1,3})[.,](\d{3})\s*(đ|vnd|VND|VNĐ)", "$1k")
    out = F.regexp_replace(out, r"(?U)\b(\d{2,3})000\s*(đ|vnd|VND|VNĐ)\b", "$1k")
    out = F.regexp_replace(out, r"(?Ui)\bVAT\b", "thuế")
    for letter, said in (("S", "ét"), ("M", "mờ"), ("L", "lờ")):
        out = F.regexp_replace(out, rf"(?Ui)\bsize\s+{letter}\b", f"size {said}")
    return out


def marker_language(c: Column) -> Column:
    """vi or en by the count of each language's markers; unknown on a tie."""
    counts = {"vi": hits(c, lx.VI_MARKERS), "en": hits(c, lx.EN_MARKERS)}
    return let(counts, lambda n: F.when(n["vi"] > n["en"], "vi").when(n["en"] > n["vi"], "en").otherwise("unknown"))


def diacritic_language(c: Column) -> Column:
    """vi by diacritics or markers, else en."""
    low = F.lower(c)
    return F.when(low.rlike(lx.VI_DIACRITICS) | any_of(low, lx.EXTRACTOR_VI_MARKERS), "vi").otherwise("en")


def any_marker_language(c: Column) -> Column:
    """vi where any Vietnamese letter or pronoun occurs, else en: the rule of the trained router and of the dataset generator."""
    return F.when(any_of(F.lower(c), lx.ANY_VI_MARKERS), "vi").otherwise("en")


def item_name(passage: Column) -> Column:
    """What stands before a passage's first bar."""
    return strip(F.substring_index(passage, "|", 1))


def subject_vi(c: Column) -> Column:
    """Who a Vietnamese sample is for, in the dataset's terms; empty if it does not say."""
    low = strip(F.regexp_replace(F.lower(c), r"\s+#\d+$", ""))
    who = "anh|chị|em|mình|tôi|tui|bọn em|tụi em"
    found = [F.nullif(F.regexp_extract(low, uni(p), 1), F.lit("")) for p in (rf"\bcho\s+({who})\b", rf"\b({who})\s+(?:muốn|cần|hỏi|xin|đặt|gọi|lấy|order|thích)\b")]
    return F.coalesce(*found, F.lit(""))


def subject_en(c: Column) -> Column:
    said = lambda words: c.rlike(uni(rf"(?i)\b{words}\b"))
    return F.when(said("my friend and i"), "my friend and I").when(said("we"), "we").when(said("i"), "I").otherwise("")


def generated_language(c: Column) -> Column:
    """vi by diacritics, en by a common English word, else unknown."""
    low = F.lower(c)
    return F.when(low.rlike(lx.VI_DIACRITICS), "vi").when(low.rlike(uni(lx.ENGLISH_WORDS)), "en").otherwise("unknown")


def json_object(c: Column) -> Column:
    """The text of a JSON object in c: the whole, or from the first brace to the last; null if neither parses."""
    def valid(x: Column) -> Column:
        return F.when(strip(x).startswith("{") & F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(valid(c), valid(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))))


def clauses(c: Column) -> Column:
    """Clauses that end in punctuation and have twelve characters or more, and what remains after the last mark."""
    marks = lx.CLAUSE_MARKS.removesuffix("+")
    parts = F.split(c, f"(?<={marks})(?!{marks})")  # after each run of marks
    ended = F.slice(parts, F.lit(1), F.size(parts) - 1)
    kept = F.filter(F.transform(ended, strip), lambda x: F.length(x) >= lx.CLAUSE_MIN)
    rest = strip(F.element_at(parts, -1))
    return F.when(rest != "", F.array_append(kept, rest)).otherwise(kept)


def sse_frame(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), data.alias("data"))), F.lit("\n\n"))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / lx.CHARS_PER_TOKEN)).cast("long")
