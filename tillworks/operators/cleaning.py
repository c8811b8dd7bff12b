"""Cleaning of raw sales rows: parse, flag, score, default, stamp, project.

Rows keep their raw content fingerprint (``record_key``) from here on.  It orders copies of a key, and it names rows
without a readable product id, so neither depends on how files were split into tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.functions import parse
from tillworks.schema import CURATED, MONEY, PENALTIES, PRICE, SCORE, UNCATEGORIZED

ONE = Decimal("1.0000")

#: output column -> (kind, raw column); kinds are the parsers of ``tillworks.functions.parse``
MAPPING = {
    "month": ("date", "month_raw"),
    "product_id": ("id", "product_id_raw"),
    "product_name": ("text", "product_name_raw"),
    "shop_name": ("text", "shop_name_raw"),
    "l1_category": ("text", "l1_category_raw"),
    "l2_category": ("text", "l2_category_raw"),
    "l3_category": ("text", "l3_category_raw"),
    "item_sold": ("int", "item_sold_raw"),
    "revenue_usd": ("money", "revenue_raw"),
    "avg_unit_price_usd": ("money", "avg_unit_price_raw"),
    "growth_points": ("points", "mom_growth_raw"),
}


@dataclass(frozen=True)
class Rule:
    """A named predicate on the parsed columns and what it takes off the score."""

    name: str
    predicate: Column
    penalty: Decimal


def rules(cfg: Config) -> list[Rule]:
    """The seven standard rules, in listing order."""
    suspicious = F.lit(False) if cfg.strict_reference else ~parse.in_percent_range(F.col("growth_points"))
    predicates = {
        "INVALID_DATE": F.col("month").isNull(),
        "SYNTHETIC_PRODUCT_ID": F.col("product_id").isNull(),
        "MISSING_PRODUCT_NAME": F.col("product_name").isNull(),
        "INVALID_REVENUE": F.col("revenue_usd").isNull(),
        "INVALID_AVG_PRICE": F.col("avg_unit_price_usd").isNull(),
        "MISSING_ITEMS": F.col("item_sold").isNull(),
        "SUSPICIOUS_GROWTH": F.coalesce(suspicious, F.lit(False)),
    }
    return [Rule(name, predicates[name], penalty) for name, penalty in PENALTIES.items()]


#: kind -> text before it is read, the reading, and what is made of it.  Each is a projection of its own: an expression over
#: a column is evaluated once, a nested one as often as the parser names it
STEPS = {
    "date": (parse.quick_strip, None, parse.date_of),
    "id": (lambda c: parse.number_text(c, parse.ID_DROPS), parse.number_of, parse.id_of),
    "int": (lambda c: parse.number_text(c, parse.ID_DROPS), parse.number_of, parse.items_of),
    "money": (lambda c: parse.number_text(c, parse.MONEY_DROPS), parse.number_of, parse.money_of),
    "points": (lambda c: parse.number_text(c, parse.POINTS_DROPS), None, lambda t: parse.number_of(t, parse.POINTS)),
}


def parse_columns(df: DataFrame, cfg: Config, mapping: Mapping[str, tuple[str, str]] = MAPPING) -> DataFrame:
    """Add one parsed column for each mapping entry whose raw column exists; unreadable values are NULL."""
    whole = {
        "id": lambda name, c: parse.parse_id(c, via_double=True),
        "text": lambda name, c: parse.parse_text(c, cfg.limit_for(name)),
        "percent": lambda name, c: parse.parse_percent(c),
    }
    present = {name: (kind, raw) for name, (kind, raw) in mapping.items() if raw in df.columns}
    stepwise = {name: kind for name, (kind, _) in present.items()
                if kind in STEPS and not (kind == "id" and cfg.legacy_float_ids)}
    texts = {f"_text_{name}": STEPS[kind][0](F.col(present[name][1])) for name, kind in stepwise.items()}
    reads = {f"_read_{name}": STEPS[kind][1](F.col(f"_text_{name}")) for name, kind in stepwise.items() if STEPS[kind][1]}
    made = {name: STEPS[kind][2](F.col(f"_read_{name}" if STEPS[kind][1] else f"_text_{name}"))
            for name, kind in stepwise.items()}
    rest = {name: whole[kind](name, F.col(raw)) for name, (kind, raw) in present.items() if name not in stepwise}
    final = {name: (made | rest)[name] for name in present}
    return df.withColumns(texts).withColumns(reads).withColumns(final).drop(*texts, *reads)


def with_record_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """128-bit fingerprint of the raw content: equal rows, and only those, share it (NULL differs from empty)."""
    parts = [F.coalesce(F.col(c), F.lit("\0")) for c in columns]
    return df.withColumn("record_key", F.md5(F.concat_ws("\x1f", *parts)))


def apply_rules(df: DataFrame, rule_list: Sequence[Rule]) -> DataFrame:
    """``flags`` (array), ``quality_flags`` (comma list) and ``data_quality_score`` = 1 - sum of penalties."""
    hits = [F.when(r.predicate, F.lit(r.name)) for r in rule_list]
    score = F.lit(ONE)
    for r in rule_list:
        score = score - F.when(r.predicate, F.lit(r.penalty)).otherwise(F.lit(Decimal("0.00")))
    return df.withColumns({"flags": F.array_compact(F.array(*hits)), "data_quality_score": score.cast(SCORE),
                           "quality_flags": F.concat_ws(",", *hits)})


def fill_defaults(df: DataFrame) -> DataFrame:
    """Categories -> Uncategorized, money and items -> 0; shop, name and growth stay NULL."""
    fills = {
        "l1_category": F.lit(UNCATEGORIZED), "l2_category": F.lit(UNCATEGORIZED), "l3_category": F.lit(UNCATEGORIZED),
        "revenue_usd": F.lit(0).cast(MONEY), "avg_unit_price_usd": F.lit(0).cast(MONEY), "item_sold": F.lit(0),
    }
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items() if c in df.columns})


def with_growth(df: DataFrame) -> DataFrame:
    """The stored growth ratio: inside the accepted range and inside its DECIMAL type, else NULL."""
    return df.withColumn("mom_growth_pct", parse.as_ratio(F.col("growth_points")).try_cast(SCORE)).drop("growth_points")


def with_partitions(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("month"), "month_num": F.month("month")})


def clean(df: DataFrame, cfg: Config, mapping: Mapping[str, tuple[str, str]] = MAPPING,
          key_columns: Sequence[str] | None = None, own_rules: Sequence[Rule] = ()) -> DataFrame:
    """Raw text columns to typed, flagged and scored rows; ``own_rules`` follow the standard ones.  ``product_id`` stays NULL where unreadable; the synthetic
    id is given after copies were counted (``tillworks.operators.dedup``)."""
    raw = [r for _, r in mapping.values() if r in df.columns]
    keyed = with_record_key(df, key_columns or (["source_file"] if "source_file" in df.columns else []) + raw)
    flagged = apply_rules(parse_columns(keyed, cfg, mapping), [*rules(cfg), *own_rules])
    return with_partitions(with_growth(fill_defaults(flagged))).drop(*raw, "flags")


def synthetic_id(record_key: Column, occurrence: Column) -> Column:
    """63-bit id from content and copy number: the same in every run, and distinct for equal rows."""
    return F.xxhash64(record_key, occurrence.cast("bigint")).bitwiseAND(F.lit(parse.MAX_ID))


def record_hash(cfg: Config) -> Column:
    names = ["product_id", "month", "shop_name", "product_name", "revenue_usd"]
    if cfg.legacy_hash:
        parts = [F.col(n).cast("double") if n == "revenue_usd" else F.col(n) for n in names]
        return F.md5(F.concat_ws("||", *[p.cast("string") for p in parts]))
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names]))


def add_governance(df: DataFrame, cfg: Config) -> DataFrame:
    """Run time, logic version, author and content hash."""
    return df.withColumns({
        "processed_timestamp": F.lit(cfg.executed_at).cast("timestamp"),
        "transformation_version": F.lit(cfg.version),
        "created_by": F.lit(cfg.created_by),
        "record_hash": record_hash(cfg),
    })


def to_curated(df: DataFrame) -> DataFrame:
    """The curated contract: column order and types; a value its DECIMAL cannot hold becomes NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CURATED])


def repair_numeric(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Numbers that travelled as text: missing, blank or unreadable -> 0."""
    return df.withColumns({c: parse.number_or_zero(F.col(c), t) for c, t in types.items() if c in df.columns})
