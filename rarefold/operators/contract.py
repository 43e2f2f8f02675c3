"""B: data contract, quarantine and quality warnings.

Row checks are one projection (no shuffle): each rule becomes a nullable
reason string and ``concat_ws`` joins the non-null ones, so every failure of a
row is reported (lazy validation).  Structural checks (column set, types) run
on the schema before any job and raise ``ContractError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.columns import reason_value
from rarefold.spec import ContractError, DatasetSpec, Field, QualityThresholds, QuarantineNotEmpty, Rule

REASON = "quarantine_reason"
#: Column with the reasons a text scan found before the rules (bad cells, short or long rows); null for none.
TYPE_REASON = "type_reason"


def _fmt(v: object) -> str:
    return repr(v)


def check_name(rule: Rule) -> str:
    """Check names as the reference's validation library prints them (fixed formats)."""
    if rule.kind == "ge":
        return f"greater_than_or_equal_to({_fmt(rule.value)})"
    if rule.kind == "le":
        return f"less_than_or_equal_to({_fmt(rule.value)})"
    if rule.kind == "gt":
        return f"greater_than({_fmt(rule.value)})"
    if rule.kind == "isin":
        return f"isin({list(rule.value)!r})"
    raise ValueError(rule.kind)


def rule_violated(c: Column, rule: Rule) -> Column:
    """True when a non-null value breaks the rule (null passes; not-null is its own check)."""
    if rule.kind == "ge":
        return c.isNotNull() & (c < F.lit(rule.value))
    if rule.kind == "le":
        return c.isNotNull() & (c > F.lit(rule.value))
    if rule.kind == "gt":
        return c.isNotNull() & (c <= F.lit(rule.value))
    if rule.kind == "isin":
        return c.isNotNull() & ~c.isin(*rule.value)
    raise ValueError(rule.kind)


def _is_string(f: Field) -> bool:
    return isinstance(f.dtype, T.StringType)


def check_structure(df: DataFrame, spec: DatasetSpec, allow: tuple[str, ...] = (), check_types: bool = True) -> None:
    """Closed column set and exact types; raise before anything is quarantined."""
    present = [c for c in df.columns if c not in allow]
    missing = [c for c in spec.columns if c not in present]
    extra = [c for c in present if c not in spec.columns]
    if missing or extra:
        raise ContractError(f"{spec.name}: missing columns {missing}, extra columns {extra}")
    if not check_types:
        return
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dtype.simpleString()}, got {types[f.name].simpleString()}"
        for f in spec.fields
        if types[f.name] != f.dtype
    ]
    if wrong:
        raise ContractError(f"{spec.name}: dtype mismatch: {'; '.join(wrong)}")


def violation_items(spec: DatasetSpec) -> list[tuple[str, str, Column, Column]]:
    """(column, check, violated?, value text) for every rule, in contract order."""
    items = []
    for f in spec.fields:
        c = F.col(f.name)
        if not f.nullable:
            items.append((f.name, "not_nullable", c.isNull(), F.lit("None")))
        for r in f.rules:
            items.append((f.name, check_name(r), rule_violated(c, r), reason_value(c, _is_string(f))))
    return items


def reason_expr(spec: DatasetSpec, typed: bool = False) -> Column:
    """B6: '<col>=<value> incumple <check>' joined by '; ', null for a valid row."""
    parts = [
        F.when(viol, F.concat(F.lit(f"{col}="), val, F.lit(f" incumple {chk}")))
        for col, chk, viol, val in violation_items(spec)
    ]
    if typed:
        parts.insert(0, F.col(TYPE_REASON))
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def rule_ok(c: Column, rule: Rule) -> Column:
    """Plain comparison form of a rule (Catalyst pushes these into the parquet scan)."""
    if rule.kind == "ge":
        return c >= F.lit(rule.value)
    if rule.kind == "le":
        return c <= F.lit(rule.value)
    if rule.kind == "gt":
        return c > F.lit(rule.value)
    if rule.kind == "isin":
        return c.isin(*rule.value)
    raise ValueError(rule.kind)


def valid_predicate(spec: DatasetSpec) -> Column:
    """True iff the row passes every check; never null.  A cheap conjunction of comparisons,
    so the valid branch needs no reason strings and its bounds reach the scan as PushedFilters."""
    pred = F.lit(True)
    for f in spec.fields:
        c = F.col(f.name)
        ok = F.lit(True)
        for r in f.rules:
            ok = ok & rule_ok(c, r)
        pred = pred & ((c.isNull() | ok) if f.nullable else (c.isNotNull() & ok))
    return pred


def tag(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Add the quarantine reason column (null = valid row)."""
    typed = TYPE_REASON in df.columns
    out = df.withColumn(REASON, reason_expr(spec, typed))
    return out.drop(TYPE_REASON) if typed else out


def split(df: DataFrame, spec: DatasetSpec, tagged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reason column, quarantined rows with it)."""
    if tagged is not None:
        return tagged.filter(F.col(REASON).isNull()).drop(REASON), tagged.filter(F.col(REASON).isNotNull())
    pred = valid_predicate(spec)
    typed = TYPE_REASON in df.columns
    if typed:
        pred = pred & F.col(TYPE_REASON).isNull()
    valid = df.filter(pred)
    bad = df.filter(~pred).withColumn(REASON, reason_expr(spec, typed))
    return (valid.drop(TYPE_REASON), bad.drop(TYPE_REASON)) if typed else (valid, bad)


def violations_long(df: DataFrame, spec: DatasetSpec, kinds: tuple[str, ...] | None = None, key: str = "row_id") -> DataFrame:
    """One row per (row, column, check) failure -- the failure-case table.

    ``kinds`` filters rule kinds: 'range' (ge/le/gt), 'isin', 'not_nullable'.
    """
    structs = []
    for f in spec.fields:
        c = F.col(f.name)
        if not f.nullable and (kinds is None or "not_nullable" in kinds):
            structs.append(F.when(c.isNull(), F.struct(F.lit(f.name).alias("column"), F.lit("not_nullable").alias("check"), F.lit(None).cast("string").alias("value"))))
        for r in f.rules:
            kind = "isin" if r.kind == "isin" else "range"
            if kinds is not None and kind not in kinds:
                continue
            structs.append(
                F.when(
                    rule_violated(c, r),
                    F.struct(F.lit(f.name).alias("column"), F.lit(check_name(r)).alias("check"), c.cast("string").alias("value")),
                )
            )
    if not structs:
        return df.sparkSession.createDataFrame([], f"{key} string, column string, check string, value string")
    arr = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return df.select(F.col(key), F.explode(arr).alias("v")).select(key, "v.column", "v.check", "v.value")


def type_violations(raw: DataFrame, spec: DatasetSpec, key: str = "row_id") -> DataFrame:
    """B2 on text input: cells whose raw text is present but does not parse as the declared type.

    A column with no parsable cell at all is structural and raises.
    """
    items = []
    for f in spec.fields:
        if isinstance(f.dtype, T.StringType):
            continue
        c = F.col(f.name).cast("string")
        bad = c.isNotNull() & F.trim(c).try_cast(f.dtype).isNull()
        items.append((f, bad))
    if not items:
        return raw.sparkSession.createDataFrame([], f"{key} string, column string, value string")
    structs = [
        F.when(bad, F.struct(F.lit(f.name).alias("column"), F.lit(f"dtype('{f.dtype.simpleString()}')").alias("check"), F.col(f.name).cast("string").alias("value")))
        for f, bad in items
    ]
    return raw.select(F.col(key), F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("v")).select(
        key, "v.column", "v.check", "v.value"
    )


def assert_columns_parse(raw: DataFrame, spec: DatasetSpec) -> None:
    """Raise ContractError if some typed column has text but not one parsable cell (one aggregate job)."""
    aggs = []
    names = []
    for f in spec.fields:
        if isinstance(f.dtype, T.StringType):
            continue
        c = F.col(f.name).cast("string")
        aggs.append(F.count(c).alias(f"n_{f.name}"))
        aggs.append(F.count(F.trim(c).try_cast(f.dtype)).alias(f"ok_{f.name}"))
        names.append(f.name)
    if not aggs:
        return
    row = raw.agg(*aggs).first()
    broken = [n for n in names if row[f"n_{n}"] > 0 and row[f"ok_{n}"] == 0]
    if broken:
        raise ContractError(f"{spec.name}: columns without any value of the declared type: {broken}")


def contract_summary(tagged: DataFrame) -> DataFrame:
    """Rows read / valid / quarantined in one aggregate."""
    return tagged.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(F.col(REASON).isNull()).alias("n_valid"),
        F.count_if(F.col(REASON).isNotNull()).alias("n_quarantined"),
    )


def reason_counts(tagged: DataFrame) -> DataFrame:
    """B9 at scale: quarantined rows counted by reason text."""
    return tagged.filter(F.col(REASON).isNotNull()).groupBy(REASON).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(tagged: DataFrame, enforce: bool = True) -> int:
    """Number of quarantined rows; raise when enforcing and it is > 0."""
    n = tagged.filter(F.col(REASON).isNotNull()).count()
    if enforce and n > 0:
        raise QuarantineNotEmpty(n)
    return n


def positive_value(spec: DatasetSpec) -> str:
    """Text of the positive target value as the contract admits it: the label, or 1 where the target is a 0/1 flag."""
    allowed = [str(v) for f in spec.fields if f.name == spec.target for r in f.rules if r.kind == "isin" for v in r.value]
    return spec.positive_label if not allowed or spec.positive_label in allowed else "1"


def warn_prevalence(valid: DataFrame, spec: DatasetSpec, th: QualityThresholds = QualityThresholds()) -> DataFrame:
    """Prevalence of the positive label and whether it is outside the closed warning range."""
    y = F.col(spec.target).cast("string")
    agg = valid.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == positive_value(spec)).alias("n_positive"))
    prev = F.when(F.col("n") > 0, F.col("n_positive") / F.col("n"))
    return agg.select(
        "n",
        "n_positive",
        prev.alias("prevalence"),
        F.when(F.col("n") == 0, F.lit(False))
        .otherwise(~((prev >= th.min_prevalence) & (prev <= th.max_prevalence)))
        .alias("warn"),
    )


def warn_null_rate(valid: DataFrame, spec: DatasetSpec, th: QualityThresholds = QualityThresholds()) -> DataFrame:
    """Null share per numeric attribute and whether it is strictly above the threshold."""
    attrs = spec.numeric_attributes()
    total = valid.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(a).isNull()).alias(a) for a in attrs]
    )
    long = total.unpivot(["n"], attrs, "attr", "nulls")
    rate = F.when(F.col("n") > 0, F.col("nulls") / F.col("n"))
    return long.select("attr", "nulls", "n", rate.alias("null_rate"), F.coalesce(rate > th.max_null_pct_per_column, F.lit(False)).alias("warn"))


def full_duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """All occurrences of a full-row duplicate except the first (GROUP BY treats nulls as equal)."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
