"""Places of regular-expression matches, from built-in functions only.

regexp_extract_all gives the matches and split the pieces between them; running
sums of both lengths give each match's place in code points. Sums run within
blocks of matches, so that a text with very many of them stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


class Kind(NamedTuple):
    """A kind of span: its pattern, a cheap test that a text may hold it, and which matches count."""

    name: str
    pattern: str
    may: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None


def once(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of the values, each worked out a single time however often body uses it."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), lambda v: body(v))[0]


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _placed(kind: str, sizes: Column) -> Column:
    """Spans of matches whose gaps before them and own lengths are in sizes."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
    )
    total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"])
    offsets = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )

    def within(block: Column, offset: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(offset.alias("at"), no_spans().alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            (s["at"] + x["gap"]).alias("start"),
                            (s["at"] + x["gap"] + x["len"]).alias("end"),
                            F.lit(kind).alias("kind"),
                            x["value"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda s: s["out"],
        )

    return F.flatten(F.zip_with(blocks, offsets, within))


def with_spans(df: DataFrame, text: str, kinds: list[Kind]) -> DataFrame:
    """df and, for each kind, a column named after it with its spans in the (non-null) text."""
    names = df.columns
    t = F.col(text)

    def found(k: Kind) -> Column:
        all_ = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
        return all_ if k.may is None else F.when(k.may(t), all_).otherwise(F.array().cast("array<string>"))

    def sizes(k: Kind) -> Column:
        m = F.col(f"_m_{k.name}")
        gaps = F.slice(F.split(t, k.pattern, -1), F.lit(1), F.size(m))
        pairs = F.zip_with(gaps, m, lambda p, v: F.struct(F.length(p).alias("gap"), F.length(v).alias("len"), v.alias("value")))
        return F.when(F.size(m) > 0, pairs)

    def spans(k: Kind) -> Column:
        placed = _placed(k.name, F.col(f"_z_{k.name}"))
        if k.keep is not None:
            placed = F.filter(placed, lambda s: k.keep(s["value"]))
        return F.when(F.col(f"_z_{k.name}").isNull(), no_spans()).otherwise(placed)

    df = df.select(*names, *[found(k).alias(f"_m_{k.name}") for k in kinds])
    df = df.select(*names, *[sizes(k).alias(f"_z_{k.name}") for k in kinds])
    return df.select(*names, *[spans(k).alias(k.name) for k in kinds])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart_from(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of those taken."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with its spans, which may overlap, replaced by mark."""
    parts = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(parts)
